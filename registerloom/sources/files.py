"""Readers and writers of texts, JSON arrays, lists, run logs, graphs and spreadsheets."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X
from . import named


def texts(spark: SparkSession, path: str, recursive: bool = True, pattern: str = "*.txt") -> DataFrame:
    """path, file, text of whole UTF-8 files."""
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    # paths are reported as URIs
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    rows = reader.text(path, wholetext=True).select(plain.alias("path"), F.col("value").alias("text"))
    return rows.select("path", X.basename("path").alias("file"), "text")


def in_path_order(rows: DataFrame) -> DataFrame:
    """Files in order of their paths, in which they are processed."""
    return rows.orderBy("path")


def json_records(spark: SparkSession, path: str, tag: bool = True) -> DataFrame:
    """Records of JSON-array files, with fileName; a file that is not an array of objects is skipped as a whole."""
    rows = texts(spark, path, pattern="*.[jJ][sS][oO][nN]")
    generic = F.from_json("text", "array<string>")
    objects = F.forall(generic, lambda x: F.coalesce(F.startswith(F.ltrim(x), F.lit("{")), F.lit(False)))
    good = rows.filter(F.regexp_like("text", F.lit(r"\A\s*\[")) & generic.isNotNull() & objects)
    types = "array<struct<" + ",".join(f"{f.name}:string" for f in S.RECORD.fields) + ">>"
    rows = good.select("file", F.inline(F.from_json("text", types)))
    return rows.withColumnRenamed("file", "fileName") if tag else rows.drop("file")


def merged_objects(spark: SparkSession, path: str) -> DataFrame:
    """value: the elements of all top-level JSON arrays as JSON text; files without one are skipped."""
    rows = texts(spark, path, pattern="*.[jJ][sS][oO][nN]").filter(F.regexp_like("text", F.lit(r"\A\s*\[")))
    return rows.select(F.explode(F.from_json("text", "array<string>")).alias("value"))


def names(spark: SparkSession, path: str, comments: bool = False) -> DataFrame:
    """name: stripped lines without blank ones (and those that start with #, if comments)."""
    rows = spark.read.text(path).select(X.strip("value").alias("name")).filter("name <> ''")
    return rows.filter(~F.col("name").startswith("#")) if comments else rows


def companies(spark: SparkSession, path: str | None, default: list[str]) -> DataFrame:
    """company: names of a list file, or default where there is none or it has none."""
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            rows = names(spark, path, comments=True).select(F.col("name").alias("company"))
            if rows.limit(1).count():
                return rows
    return spark.createDataFrame([(n,) for n in default], "company string")


def run_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, total): a run log without its trailer, and file and seconds of the trailer; '-' chunks are null."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path).withColumn("log", F.col("_metadata.file_name"))
    trailer = F.col("File") == "Total runtime (s):"
    rows = raw.filter(~trailer & F.col("File").isNotNull())
    rows = rows.select("log", "File", "Mode", F.col("Chunks").try_cast("int").alias("Chunks"), F.col("Time (s)").try_cast("double").alias("Time (s)"), "Outcome")
    return rows, raw.filter(trailer).select("log", F.col("Mode").try_cast("double").alias("seconds"))


def index_statistics(spark: SparkSession, path: str) -> DataFrame:
    """One row of an index's statistics."""
    rows = spark.read.option("multiLine", True).json(path)
    pick = lambda name, part: F.col(f"`{name}`.`{part}`").cast("long")
    return rows.select(
        pick("num-triples", "normal").alias("triples"), pick("num-triples", "internal").alias("internal_triples"), pick("num-subjects", "normal").alias("subjects"),
        pick("num-objects", "normal").alias("objects"), pick("num-predicates", "normal").alias("predicates"),
    )


def _cells(data: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet of an .xlsx file, as texts."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter(main + "t")))
        sheet = min((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[1])[0]))
        at = 0
        for row in ElementTree.fromstring(z.read(sheet)).iter(main + "row"):
            number = int(row.get("r", at + 1))
            for _ in range(at + 1, number):  # rows that are not stored
                yield []
            at, out = number, []
            for cell in row.iter(main + "c"):
                letters = re.match(r"[A-Z]+", cell.get("r", ""))
                column = 0
                for letter in letters[0] if letters else "":
                    column = 26 * column + ord(letter) - 64
                column = column - 1 if letters else len(out)
                value = cell.find(main + "v")
                if cell.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(main + "t"))
                elif value is None or value.text is None:
                    text = None
                else:
                    text = shared[int(value.text)] if cell.get("t") == "s" else value.text
                out += [None] * (column + 1 - len(out))
                out[column] = text
            yield out


def registry_sheets(spark: SparkSession, path: str, skip: int = 7) -> DataFrame:
    """Register rows of spreadsheets named ...NN.xlsx: 7 columns after the first one, Version from the name, file and row.

    skip rows and a header come first. A file without a version in its name, or with other columns, is an error."""
    count = len(S.REGISTRY_COLUMNS)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                file = name.rsplit("/", 1)[-1]
                version = re.search(r"(\d{2})\.xlsx$", file)
                if not version:
                    raise ValueError(f"{file}: the name has no version (two digits before .xlsx)")
                table = list(_cells(data))[skip:]
                if table and len(table[0]) != count + 1:
                    raise ValueError(f"{file}: {count + 1} columns expected, {len(table[0])} found")
                rows = [(r + [None] * (count + 1))[1 : count + 1] for r in table[1:] if any(v is not None for v in r)]
                out = pd.DataFrame(rows, columns=list(S.REGISTRY_COLUMNS), dtype=object)
                yield out.assign(Version=int(version[1]), file=file, row=range(len(rows)))

    schema = ", ".join(f"{c} string" for c in S.REGISTRY_COLUMNS) + ", Version int, file string, row long"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(read, schema)


#: A statement of N-Triples; subjects and objects may be blank nodes.
_NT = r'^\s*(?:<([^>]*)>|(_:[^\s<>"]+))\s+<([^>]*)>\s+(?:<([^>]*)>|(_:[^\s<>"]+?)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*\.\s*(?:#.*)?$'
#: Escapes of N-Triples, backslash last for reading and first for writing.
_ESCAPED = (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ('"', '\\"'))


def _quoted(c):
    return X.replace_all(F.replace(c, F.lit("\\"), F.lit("\\\\")), _ESCAPED)


def _unquoted(c):
    """Text without its escapes: pieces between backslashes are read one by one."""
    names = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
    pieces = F.regexp_extract_all(c, F.lit(r"(?s)\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"), F.lit(0))

    def read(x):
        code = F.conv(F.substring(x, 3, 8), 16, 10).cast("int")
        # a code point as four bytes of UTF-32
        letter = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        out = F.when(~F.startswith(x, F.lit("\\")), x).when(F.regexp_like(x, F.lit(r"^\\[uU][0-9A-Fa-f]{4}")), letter)
        for name, value in names.items():
            out = out.when(x == "\\" + name, value)
        return out.otherwise(F.substring(x, 2, 1))

    return F.when(F.contains(c, F.lit("\\")), F.array_join(F.transform(pieces, read), "")).otherwise(c)


def ntriples(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Triples of N-Triples files; read line by line, in parts. Blank nodes are IRIs that start with _:.

    A line that is neither a statement nor blank nor a comment is an error, or is left out if not strict."""
    value = F.col("value")
    rows = spark.read.text(path).filter(~F.regexp_like(value, F.lit(r"^\s*(#.*)?$")))
    good = F.regexp_like(value, F.lit(_NT))
    if strict:
        value = F.when(good, value).otherwise(F.raise_error(F.concat(F.lit("not N-Triples: "), F.substring(value, 1, 80))).cast("string"))
        rows = rows.withColumn("value", value)
    else:
        rows = rows.filter(good)
    part = lambda i: F.nullif(F.regexp_extract("value", _NT, i), F.lit(""))
    iri = F.coalesce(part(4), part(5))
    return rows.select(
        F.coalesce(part(1), part(2)).alias("s"), part(3).alias("p"), F.coalesce(iri, _unquoted(F.regexp_extract("value", _NT, 6))).alias("o"),
        F.when(iri.isNotNull(), "iri").otherwise("literal").alias("o_kind"), F.nullif(part(7), F.lit(S.XSD + "string")).alias("o_dt"), part(8).alias("o_lang"),
    ).distinct()


def _term(c):
    return F.when(F.startswith(c, F.lit("_:")), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))


def _object():
    tail = F.coalesce(F.concat(F.lit("^^<"), F.col("o_dt"), F.lit(">")), F.concat(F.lit("@"), F.col("o_lang")), F.lit(""))
    return F.when(F.col("o_kind") == "iri", _term(F.col("o"))).otherwise(F.concat(F.lit('"'), _quoted(F.col("o")), F.lit('"'), tail))


def write_ntriples(triples: DataFrame, path: str) -> None:
    line = F.concat(_term(F.col("s")), F.lit(" <"), F.col("p"), F.lit("> "), _object(), F.lit(" ."))
    triples.select(line.alias("value")).write.mode("overwrite").text(path)


def write_turtle(triples: DataFrame, path: str) -> None:
    """Turtle in parts: each subject's statements together, full IRIs, sorted, so that every part stands alone."""
    pair = F.concat(F.lit("<"), F.col("p"), F.lit("> "), _object())
    rows = triples.groupBy("s").agg(F.array_join(F.array_sort(F.collect_set(pair)), " ;\n    ").alias("body"))
    rows.select(F.concat(_term(F.col("s")), F.lit("\n    "), F.col("body"), F.lit(" .\n")).alias("value"), "s").sortWithinPartitions("s").select("value").write.mode("overwrite").text(path)


def write_quads(quads: DataFrame, path: str) -> None:
    """Statements with their graph (g) as Parquet, a folder for each graph, sorted by property and subject within files."""
    quads.sortWithinPartitions("g", "p", "s").write.mode("overwrite").partitionBy("g").parquet(path)


def write_index(triples: DataFrame, path: str, batch: int = 100_000) -> None:
    """Triples by property, sorted by subject, in files of at most batch triples.

    The shuffle is by property and sized as it runs: a small property is one file, a large one is split into many tasks."""
    rows = triples.hint("rebalance", F.col("p")).sortWithinPartitions("p", "s")
    rows.write.mode("overwrite").option("maxRecordsPerFile", batch).partitionBy("p").parquet(path)


def index_counts(triples: DataFrame) -> DataFrame:
    """One row of an index's statistics: triples, subjects, objects, predicates."""
    terms = F.concat_ws("\u0001", "o_kind", "o", F.coalesce("o_dt", F.lit("")), F.coalesce("o_lang", F.lit("")))
    return triples.agg(F.count("*").alias("triples"), F.count_distinct("s").alias("subjects"), F.count_distinct(terms).alias("objects"), F.count_distinct("p").alias("predicates"))


_TURTLE = re.compile(
    r"""(?P<ws>\s+|\#[^\n]*)|(?P<prefix>@?(?:prefix|PREFIX)\b)|(?P<base>@?(?:base|BASE)\b)|<(?P<iri>[^<>"{}|^`\\\s]*)>
    |(?P<long>\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')|(?P<string>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')
    |@(?P<lang>[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<number>[+-]?(?:\d+\.\d+|\d+|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<blank>_:[\w](?:[\w.-]*[\w-])?)|(?P<pname>(?:[^\W\d][\w.-]*)?:(?:[\w:%-]|\\.|\.(?=[\w:%-]))*)|(?P<bool>true|false)\b|(?P<a>a)(?=[\s<])|(?P<op>[;,.\[\]()])""",
    re.X | re.S,
)


class Turtle:
    """A reader of one Turtle document, or of some of its statements, which then has the prefixes and the base before them.

    Blank nodes without a name are numbered after the text in unnamed; those with one get the text in named before it."""

    def __init__(self, text: str, prefixes: dict[str, str] | None = None, base: str = "", unnamed: str = "loom", named: str = ""):
        self.prefixes, self.base, self.at, self.out, self.fresh = dict(prefixes or {}), base, 0, [], 0
        self.unnamed, self.named = unnamed, named
        self.tokens, at = [], 0
        while at < len(text):
            m = _TURTLE.match(text, at)
            if not m:
                raise ValueError(f"not Turtle: {text[at : at + 30]!r}")
            if m.lastgroup != "ws":
                self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else "end"

    def take(self, op: str) -> bool:
        if self.at < len(self.tokens) and self.tokens[self.at] == ("op", op):
            self.at += 1
            return True
        return False

    def next(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise ValueError("not Turtle: the text ends within a statement")
        self.at += 1
        return self.tokens[self.at - 1]

    def document(self) -> list[tuple]:
        while self.kind() != "end":
            if self.kind() in ("prefix", "base"):
                if self.next()[0] == "prefix":
                    name = self.next()[1]
                    self.prefixes[name[:-1]] = self.next()[1]
                else:
                    self.base = self.next()[1]
                self.take(".")
                continue
            alone = self.kind() == "op" and self.tokens[self.at][1] == "["
            s = self.node()[0]
            if not (alone and self.take(".")):
                self.statements(s)
                self.take(".")
        return self.out

    def blank(self) -> str:
        self.fresh += 1
        return f"_:{self.unnamed}{self.fresh}"

    def name(self, k: str, v: str) -> str:
        if k == "a":
            return S.A
        if k == "blank":
            return f"_:{self.named}{v[2:]}"
        if k == "iri":
            return v if ":" in v else self.base + v
        if k != "pname":
            raise ValueError(f"not Turtle: a name expected at {v!r}")
        prefix, local = v.split(":", 1)
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def node(self) -> tuple:
        """(value, kind, datatype, language) of a subject or object."""
        k, v = self.next()
        if (k, v) == ("op", "["):
            s = self.blank()
            if not self.take("]"):
                self.statements(s)
                if not self.take("]"):
                    raise ValueError("not Turtle: ] expected")
            return s, "iri", None, None
        if (k, v) == ("op", "("):
            items = []
            while not self.take(")"):
                items.append(self.node())
            nodes = [self.blank() for _ in items]
            for n, item, after in zip(nodes, items, [*nodes[1:], S.RDF + "nil"]):
                self.out += [(n, S.RDF + "first", *item), (n, S.RDF + "rest", after, "iri", None, None)]
            return (nodes[0] if nodes else S.RDF + "nil"), "iri", None, None
        if k in ("string", "long"):
            dt = lang = None
            if self.kind() == "lang":
                lang = self.next()[1]
            elif self.kind() == "type":
                self.next()
                dt = self.name(*self.next())
            return self.text(k, v), "literal", None if dt == S.XSD + "string" else dt, lang
        if k in ("number", "bool"):
            t = "boolean" if k == "bool" else "double" if "e" in v.lower() else "decimal" if "." in v else "integer"
            return v, "literal", S.XSD + t, None
        return self.name(k, v), "iri", None, None

    @staticmethod
    def text(k: str, v: str) -> str:
        v = v[3:-3] if k == "long" else v[1:-1]
        plain = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
        return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else plain.get(m[3], m[3]), v, flags=re.S)

    def statements(self, s: str) -> None:
        while True:
            p = self.name(*self.next())
            while True:
                self.out.append((s, p, *self.node()))
                if not self.take(","):
                    break
            more = False
            while self.take(";"):
                more = True
            if not more or self.kind() == "end" or (self.kind() == "op" and self.tokens[self.at][1] in ".]"):
                return


def parse_turtle(text: str) -> list[tuple]:
    """Triples of a Turtle document. Blank nodes are IRIs that start with _:, those without a name are numbered."""
    return Turtle(text).document()


def turtle(spark: SparkSession, path: str) -> DataFrame:
    """Triples of Turtle files; a large file is split over many tasks."""
    from . import turtle as parts

    return parts.read(spark, path)


def write_named(rows: DataFrame, folder: str) -> None:
    """Files of given names: rows (path, content), text or bytes, each become folder/path, written by the executors.

    Files appear when the job is committed; of rows with one path, one is kept. Rows without a path or content write none."""
    named.save(rows.select("path", "content").filter("path is not null and content is not null"), folder)


def json_array(records) -> Column:
    """An array of structs as an indented JSON array, nulls kept, other letters than ASCII as they are."""
    fields = lambda r: F.to_json(r, {"ignoreNullFields": "false", "pretty": "true"})
    items = F.transform(records, lambda r: F.concat(F.lit("    "), F.replace(fields(r), F.lit("\n"), F.lit("\n    "))))
    return F.when(F.size(records) == 0, "[]").otherwise(F.concat(F.lit("[\n"), F.array_join(items, ",\n"), F.lit("\n]")))


def write_json_arrays(done: DataFrame, folder: str) -> None:
    """One JSON array for each file that has records, at the file's own path below folder with the ending .json."""
    rows = done.filter("records is not null").select(F.regexp_replace("file", r"\.[^./]*$", "").alias("stem"), json_array(F.col("records")).alias("content"))
    write_named(rows.select(F.concat("stem", F.lit(".json")).alias("path"), "content"), folder)


def write_merged(objects: DataFrame, folder: str) -> None:
    """JSON objects (value) as merged arrays: one file for each part of the table, written as it is read."""
    named.save(objects.select("value").filter("value is not null"), folder, merged=True)


def grid(df: DataFrame) -> DataFrame:
    """line: a table for the console, with a frame and a head; column widths take one pass, rows keep their order."""
    names = df.columns
    cell = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    widest = df.agg(*[F.coalesce(F.max(F.length(cell(c))), F.lit(0)).alias(f"w{i}") for i, c in enumerate(names)]).first()
    widths = [max(len(c), widest[i]) for i, c in enumerate(names)]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    head = "|" + "|".join(f" {c:<{w}} " for c, w in zip(names, widths)) + "|"
    body = df.select(F.concat(*[F.concat(F.lit("| "), F.rpad(cell(c), w, " "), F.lit(" ")) for c, w in zip(names, widths)], F.lit("|")).alias("line"))
    edge = lambda *lines: df.sparkSession.createDataFrame([(x,) for x in lines], "line string")
    return edge(rule, head, rule).unionByName(body).unionByName(edge(rule))


def head(df: DataFrame, n: int = 20, *order: str) -> DataFrame:
    """The first n rows, by order if there is one."""
    return (df.orderBy(*order) if order else df).limit(n)


def write_company_map(rows: DataFrame, path: str) -> None:
    """A line of JSON for each company: {company: record or status}."""
    value = F.when(F.col("record").isNotNull(), F.to_json("record")).otherwise(F.to_json(F.struct("status", "message")))
    # the name as JSON text is what a one-column object has between its key and its closing brace
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("company").alias("k"))), r"(?s)^\{\"k\":(.*)\}$", 1)
    rows.select(F.concat(F.lit("{"), quoted, F.lit(": "), value, F.lit("}")).alias("value")).write.mode("overwrite").text(path)


def write_run_log(log: DataFrame, path: str) -> None:
    """Rows of a run log and, in a folder beside them, its total."""
    log.write.mode("overwrite").option("header", True).csv(f"{path}/rows")
    log.agg(F.lit("Total runtime (s):").alias("label"), F.round(F.sum("Time (s)"), 2).alias("seconds")).write.mode("overwrite").csv(f"{path}/total")


def by_year(files: DataFrame, path: str) -> DataFrame:
    """Files (name, content) in folders of the last year in their names, each under its own name.

    Returns succeeded, failed and skipped: files written, those without content, and those without a year."""
    rows = files.withColumn("year", X.last_year("name"))
    named = rows.filter("year is not null").select(F.concat_ws("/", F.col("year").cast("string"), X.basename("name")).alias("path"), "content")
    write_named(named, path)
    dated, known = F.col("year").isNotNull(), F.col("content").isNotNull()
    return rows.agg(F.count_if(dated & known).alias("succeeded"), F.count_if(dated & ~known).alias("failed"), F.count_if(~dated).alias("skipped"))
