"""Queries that write a table out in a format, read it back, and go on from what was read; and the same in DuckDB SQL.

They go through the sources, sinks, streams and scorers as a user would. What is written lies in the shared folder.
"""

from __future__ import annotations

import io
import time
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import schemas as S
from .functions import text as X
from .operators import extraction, graph, imprint, matching, registry
from .plans import storage
from .queries import _REC, QUERIES, SQL, _pages_of_records, _register_rows, indexed, raw, records, register, table, term_index
from .sources import files
from .streaming import ingest

_NATIONS = """SELECT r_name || '/' || n_name || '.txt' AS path, string_agg(c_name, chr(10) ORDER BY c_custkey) AS content FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"""


def _nation_files(spark, sf_dir) -> DataFrame:
    """path, content of a text for each nation, in a folder for each region."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x["c_name"])
    return rows.groupBy("r_name", "n_name").agg(F.array_join(names, "\n").alias("content")).select(F.concat("r_name", F.lit("/"), "n_name", F.lit(".txt")).alias("path"), "content")


def _written(spark, sf_dir, rows: DataFrame, name: str) -> str:
    folder = storage.fresh(spark, name)
    files.write_named(rows, folder)
    return folder


@register("src_texts_recursive", f"WITH f AS ({_NATIONS}) SELECT path, split_part(path, '/', 2) AS file, replace(split_part(path, '/', 2), '.txt', '') AS stem, md5(content) AS h FROM f")
def _texts(spark, sf_dir):
    folder = _written(spark, sf_dir, _nation_files(spark, sf_dir), "texts")
    rows = files.in_path_order(files.texts(spark, folder))
    root = F.regexp_replace(F.lit(folder), "^file:/+", "/")
    return rows.select(X.relative_path(F.regexp_replace("path", "^file:/+", "/"), root).alias("path"), "file", X.stem("path").alias("stem"), F.md5("text").alias("h"))


@register("src_texts_in_path_order", f"WITH f AS ({_NATIONS}) SELECT path FROM f ORDER BY path LIMIT 7")
def _ordered(spark, sf_dir):
    folder = _written(spark, sf_dir, _nation_files(spark, sf_dir), "texts")
    rows = files.in_path_order(files.texts(spark, folder)).limit(7)
    return rows.select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("path"))


@register("src_texts_of_one_folder", "SELECT 'top_' || n_name || '.txt' AS file, n_name AS text FROM nation")
def _flat(spark, sf_dir):
    top = table(spark, sf_dir, "nation").select(F.concat(F.lit("top_"), "n_name", F.lit(".txt")).alias("path"), F.col("n_name").alias("content"))
    folder = _written(spark, sf_dir, top.unionByName(_nation_files(spark, sf_dir)), "texts")
    return files.texts(spark, folder, recursive=False).select("file", "text")


_FIVE = "Court_name, Date_of_article, Company_name, Registration_Code, Registration_year"


@register("json_records_round_trip", _REC + f"SELECT {_FIVE}, replace(fileName, ' ', '_') AS fileName FROM rec")
def _json(spark, sf_dir):
    fields = [f.name for f in S.RECORD.fields]
    rows = records(spark, sf_dir).select(*fields, F.concat_ws("/", "n_name", F.replace("fileName", F.lit(" "), F.lit("_"))).alias("file"))
    folder = storage.fresh(spark, "json")
    files.write_json_arrays(rows.groupBy("file").agg(F.collect_list(F.struct(*fields)).alias("records")), folder)
    # files that are no array of objects are left out as a whole
    files.write_named(spark.createDataFrame([("odd.json", "{}"), ("x/mixed.JSON", '[{"Court_name": "a"}, 3]'), ("broken.json", "[{")], "path string, content string"), folder)
    return files.json_records(spark, folder)


@register("merged_json_round_trip", "SELECT CAST(event_id AS VARCHAR) AS id, CAST(props AS VARCHAR) AS props FROM events")
def _merged(spark, sf_dir):
    value = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), "props"))
    folder, again = storage.fresh(spark, "json"), storage.fresh(spark, "json")
    files.write_merged(table(spark, sf_dir, "events").select(value.alias("value")).repartition(3), folder)
    files.write_named(spark.createDataFrame([("object.json", "{}"), ("broken.json", '[{"id"')], "path string, content string"), folder)
    files.write_merged(files.merged_objects(spark, folder), again)
    return files.merged_objects(spark, again).select(F.get_json_object("value", "$.id").alias("id"), F.get_json_object("value", "$.props").alias("props"))


_XLSX = "SELECT n_nationkey AS k, n_name, r_name, v FROM nation JOIN region ON n_regionkey = r_regionkey, (SELECT unnest([1, 2, 3]) AS v)"


def _sheets(spark, sf_dir) -> DataFrame:
    """path, content of a spreadsheet for each of three versions: seven rows, a head, and a row for most nations."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name").orderBy("n_nationkey").collect()  # 25 rows

    def cell(column: str, row: int, value) -> str:
        return "" if value is None else f'<c r="{column}{row}" t="inlineStr"><is><t>{escape(str(value))}</t></is></c>'

    out = []
    for v in (1, 2, 3):
        lines = [(1, ["Codes"]), (8, ["Nr", *S.REGISTRY_COLUMNS])]
        for k, name, region in nations:
            if k % 4 != v:
                lines.append((len(lines) + 7, [k, f"X{k}", f"Court <{name}>", "HRA", region, None if k % 2 else f"{v}{k}", "1.2.2020" if k % 3 == 0 and v < 3 else None, None]))
        body = "".join(f'<row r="{n}">' + "".join(cell("ABCDEFGH"[i], n, x) for i, x in enumerate(values)) + "</row>" for n, values in lines)
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
        out.append((f"sub/codes_{v:02d}.xlsx", bytearray(data.getvalue())))
    return spark.createDataFrame(out, "path string, content binary")


_ROWS = f"""WITH x AS ({_XLSX}), rows AS (SELECT 'X' || k AS XJustizID, 'Court <' || n_name || '>' AS RegisterCourt, 'HRA' AS RegisterType, r_name AS State, CASE WHEN k % 2 = 0 THEN v || '' || k END AS PLZ,
  CASE WHEN k % 3 = 0 AND v < 3 THEN '1.2.2020' END AS ValidUntil, CAST(NULL AS VARCHAR) AS FutureCode, CAST(v AS INTEGER) AS Version, k FROM x WHERE k % 4 <> v)
"""


@register("registry_sheets", _ROWS + "SELECT * EXCLUDE (k), 'codes_0' || Version || '.xlsx' AS file FROM rows")
def _registry_sheets(spark, sf_dir):
    return files.registry_sheets(spark, _written(spark, sf_dir, _sheets(spark, sf_dir), "sheets")).drop("row")


@register("registry_combined", _ROWS + """, firsts AS (SELECT *, row_number() OVER (PARTITION BY XJustizID, RegisterCourt, RegisterType, State, PLZ, ValidUntil ORDER BY Version) AS pos FROM rows)
    SELECT * EXCLUDE (k, pos, last) FROM (SELECT *, row_number() OVER (PARTITION BY XJustizID ORDER BY ValidUntil IS NULL, Version DESC) AS last FROM firsts WHERE pos = 1) WHERE last = 1""")
def _combined(spark, sf_dir):
    return registry.combine(files.registry_sheets(spark, _written(spark, sf_dir, _sheets(spark, sf_dir), "sheets")))


def _list_file(spark, sf_dir) -> str:
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("c_name")), lambda x: F.concat(F.lit("  "), x, F.lit(" \t\n\n# note "), x)), "\n")
    return _written(spark, sf_dir, table(spark, sf_dir, "customer").agg(lines.alias("content")).select(F.lit("names.txt").alias("path"), "content"), "lists") + "/names.txt"


@register("src_name_list", "SELECT c_name AS name FROM customer UNION ALL SELECT '# note ' || c_name FROM customer")
def _names(spark, sf_dir):
    return files.names(spark, _list_file(spark, sf_dir))


@register("src_company_list", "SELECT 'list' AS of, c_name AS company FROM customer UNION ALL SELECT 'default', unnest(['Alpha', 'Beta'])")
def _companies(spark, sf_dir):
    path = _list_file(spark, sf_dir)
    found = files.companies(spark, path, []).withColumn("of", F.lit("list"))
    return found.unionByName(files.companies(spark, path + ".missing", ["Alpha", "Beta"]).withColumn("of", F.lit("default"))).select("of", "company")


def _court_triples(spark, sf_dir) -> DataFrame:
    return registry.triples(_register_rows(spark, sf_dir))


@register("turtle_round_trip", SQL["registry_triples"])
def _turtle(spark, sf_dir):
    folder = storage.fresh(spark, "turtle")
    files.write_turtle(_court_triples(spark, sf_dir), folder)
    return files.turtle(spark, folder).select("s", "p", "o")


@register("ntriples_round_trip", SQL["registry_triples"])
def _ntriples(spark, sf_dir):
    folder = storage.fresh(spark, "ntriples")
    files.write_ntriples(_court_triples(spark, sf_dir), folder)
    return files.ntriples(spark, folder).select("s", "p", "o")


@register("cleaned_turtle_round_trip", SQL["clean_graph_counts"])
def _cleaned(spark, sf_dir):
    folder = storage.fresh(spark, "turtle")
    files.write_turtle(graph.clean(raw(spark, sf_dir)), folder)
    return files.turtle(spark, folder).groupBy("p").agg(F.count("*").alias("n"))


@register("turtle_blank_nodes", """SELECT CAST(n_nationkey AS INTEGER) AS k, n_name || ' ü' || chr(9) AS name, 'b' || n_nationkey AS first FROM nation""")
def _blank(spark, sf_dir):
    text = F.format_string("@prefix e: <http://e/> .\ne:n%d e:k %d ; e:court [ e:name \"%s \\u00fc\\t\" ] ; e:list (\"b%d\" _:x) .", "n_nationkey", "n_nationkey", "n_name", "n_nationkey")
    one = table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit(".ttl")).alias("path"), text.alias("content"))
    t = files.turtle(spark, _written(spark, sf_dir, one, "turtle"))
    folder = storage.fresh(spark, "ntriples")
    files.write_ntriples(t, folder)
    of = lambda p, s, o: files.ntriples(spark, folder).filter(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o))
    rows = of("http://e/k", "n", "k").join(of("http://e/court", "n", "c"), "n").join(of("http://e/name", "c", "name"), "c").join(of("http://e/list", "n", "l"), "n").join(of(S.RDF + "first", "l", "first"), "l")
    return rows.select(F.col("k").cast("int").alias("k"), "name", "first")


@register("graph_index_counts", f"WITH t AS ({SQL['registry_triples']}) SELECT p, count(*) AS n FROM t GROUP BY 1")
def _index(spark, sf_dir):
    folder = storage.fresh(spark, "index")
    files.write_index(_court_triples(spark, sf_dir), folder)
    return spark.read.schema(S.TRIPLE).parquet(folder).groupBy("p").agg(F.count("*").alias("n"))


@register("index_statistics", f"WITH t AS ({SQL['registry_triples']}) SELECT count(*) AS triples, CAST(7 AS BIGINT) AS internal_triples, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects, count(DISTINCT p) AS predicates FROM t")
def _statistics(spark, sf_dir):
    pair = lambda c, extra: F.struct(F.col(c).alias("normal"), F.lit(extra).alias("internal"))
    rows = files.index_counts(_court_triples(spark, sf_dir).withColumns({"o_dt": F.lit(None).cast("string"), "o_lang": F.lit(None).cast("string"), "o_kind": F.lit("x")}))
    names = {"triples": "num-triples", "subjects": "num-subjects", "objects": "num-objects", "predicates": "num-predicates"}
    text = F.to_json(F.struct(*[pair(c, 7 if c == "triples" else 0).alias(n) for c, n in names.items()]))
    return files.index_statistics(spark, _written(spark, sf_dir, rows.select(F.lit("meta.json").alias("path"), text.alias("content")), "index"))


_OUTCOME = "CASE l_returnflag WHEN 'N' THEN 'success' WHEN 'A' THEN 'partial success (missing chunks [1, 2])' ELSE 'parse failed' END"


def _log(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat("l_orderkey", F.lit("_"), "l_linenumber", F.lit(".txt")).alias("File"), F.lit("parallel").alias("Mode"), F.col("l_linenumber").alias("Chunks"), F.round("l_quantity", 2).alias("Time (s)"), F.expr(_OUTCOME).alias("Outcome")
    )


@register("run_log_round_trip", f"SELECT Outcome, Chunks, count(*) AS files, CAST(sum(l_quantity) AS DOUBLE) AS seconds FROM (SELECT {_OUTCOME} AS Outcome, l_linenumber AS Chunks, l_quantity FROM lineitem) GROUP BY ALL")
def _run_log(spark, sf_dir):
    folder = storage.fresh(spark, "log")
    files.write_run_log(_log(spark, sf_dir), folder)
    rows, _ = files.run_log(spark, folder + "/rows")
    return rows.groupBy("Outcome", "Chunks").agg(F.count("*").alias("files"), F.sum("Time (s)").alias("seconds"))


@register("run_log_totals", "SELECT count(*) AS files, CAST(sum(l_linenumber) AS BIGINT) AS chunks, CAST(sum(l_quantity) AS DOUBLE) AS seconds, count(*) FILTER (l_returnflag = 'N') AS succeeded, count(*) FILTER (l_returnflag = 'A') AS partial, count(*) FILTER (l_returnflag = 'R') AS failed FROM lineitem")
def _log_totals(spark, sf_dir):
    return extraction.log_summary(_log(spark, sf_dir))


@register("run_log_with_trailer", "SELECT 'a.txt' AS File, CAST(3 AS INTEGER) AS Chunks, CAST(5.5 AS DOUBLE) AS seconds, CAST(7.0 AS DOUBLE) AS total UNION ALL SELECT 'b.txt', NULL, 1.5, 7.0")
def _trailer(spark, sf_dir):
    text = 'File,Mode,Chunks,Time (s),Outcome\na.txt,parallel,3,5.5,success\nb.txt,parallel,-,1.5,"failed chunks [1, 2]"\n\nTotal runtime (s):,7.0\n'
    folder = _written(spark, sf_dir, spark.createDataFrame([("log.csv", text)], "path string, content string"), "log")
    rows, total = files.run_log(spark, folder + "/log.csv")
    return rows.join(total.withColumnRenamed("seconds", "total"), "log").select("File", "Chunks", F.col("Time (s)").alias("seconds"), "total")


@register("company_map_round_trip", "SELECT c_name AS company, CASE WHEN c_custkey % 3 = 2 THEN c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'Not Found' WHEN c_custkey % 3 = 1 THEN 'Failed' END AS status FROM customer")
def _company_map(spark, sf_dir):
    companies = table(spark, sf_dir, "customer").select(F.col("c_name").alias("company"), "c_custkey")
    found = companies.filter("c_custkey % 3 > 0").select("company", F.when(F.col("c_custkey") % 3 == 2, F.struct(F.col("company").alias("Company_Name"))).alias("record"), F.lit(1).alias("found_pages"))
    folder = storage.fresh(spark, "map")
    files.write_company_map(imprint.results(companies.select("company"), found), folder)
    lines = spark.read.text(folder).select(F.explode(F.from_json("value", "map<string, struct<Company_Name: string, status: string, message: string>>")).alias("company", "v"))
    return lines.select("company", F.col("v.Company_Name").alias("name"), "v.status")


_MONTHS = "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2"


def _downloads(spark, sf_dir) -> DataFrame:
    """name, content of a file for each month of orders; those of every third month have no year in their names, those of each
    seventh one no content."""
    per = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n"))
    name = F.when(F.col("m") % 3 == 0, F.concat(F.lit("dir/none_"), "m", F.lit("_"), F.substring(F.col("y").cast("string"), 3, 2), F.lit(".txt")))
    name = name.otherwise(F.concat(F.lit("dir/f_"), "m", F.lit("_"), "y", F.lit(".txt")))
    return per.select(name.alias("name"), F.when(F.col("m") % 7 != 0, F.col("n").cast("string")).alias("content"))


@register("files_by_year", f"SELECT y || '/f_' || m || '_' || y || '.txt' AS path, n AS content FROM ({_MONTHS}) WHERE m % 3 <> 0 AND m % 7 <> 0")
def _by_year(spark, sf_dir):
    folder = storage.fresh(spark, "years")
    files.by_year(_downloads(spark, sf_dir), folder)
    return files.texts(spark, folder).select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("path"), F.col("text").cast("long").alias("content"))


@register("files_by_year_counters", f"SELECT count(*) FILTER (m % 3 <> 0 AND m % 7 <> 0) AS succeeded, count(*) FILTER (m % 3 <> 0 AND m % 7 = 0) AS failed, count(*) FILTER (m % 3 = 0) AS skipped FROM ({_MONTHS})")
def _counters(spark, sf_dir):
    return files.by_year(_downloads(spark, sf_dir), storage.fresh(spark, "years"))


@register(
    "console_grid",
    """WITH w AS (SELECT greatest(11, max(length(CAST(n_nationkey AS VARCHAR)))) AS a, greatest(6, max(length(n_name))) AS b FROM nation)
    SELECT '| ' || rpad(CAST(n_nationkey AS VARCHAR), CAST(a AS INTEGER), ' ') || ' | ' || rpad(n_name, CAST(b AS INTEGER), ' ') || ' |' AS line FROM nation, w
    UNION ALL SELECT '| ' || rpad('n_nationkey', CAST(a AS INTEGER), ' ') || ' | ' || rpad('n_name', CAST(b AS INTEGER), ' ') || ' |' FROM w
    UNION ALL SELECT '+' || repeat('-', CAST(a AS INTEGER) + 2) || '+' || repeat('-', CAST(b AS INTEGER) + 2) || '+' FROM w, (SELECT unnest([1, 2, 3]))""",
)
def _grid(spark, sf_dir):
    return files.grid(table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey"))


@register("head_sample", "SELECT c_custkey, c_name FROM customer ORDER BY c_name LIMIT 20")
def _head(spark, sf_dir):
    return files.head(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), 20, "c_name")


@register("result_cap", _REC + "SELECT Company_name AS name FROM rec ORDER BY 1 LIMIT 100")
def _cap(spark, sf_dir):
    return indexed(spark, sf_dir).query("SELECT ?name WHERE { ?c ex:companyName ?name } ORDER BY ?name", cap=100)


@register("internal_sort_by", _REC + "SELECT Company_name AS name FROM rec ORDER BY 1 DESC LIMIT 15")
def _internal(spark, sf_dir):
    return indexed(spark, sf_dir).query("SELECT ?name WHERE { ?c ex:companyName ?name } INTERNAL SORT BY DESC(?name) LIMIT 15")


@register("text_words", _REC + "SELECT DISTINCT Date_of_article AS t FROM rec WHERE starts_with(Date_of_article, '11. ')")
def _text_words(spark, sf_dir):
    return term_index(spark, sf_dir).query('SELECT ?t WHERE { ?t ql:contains-word "11 sept*" . ?t ql:contains-entity ?c . ?c ex:articleDate ?t } GROUP BY ?t')


@register("language_filter", "SELECT 'Köln (' || n_name || ')' AS label, 'de' AS lang FROM nation")
def _language(spark, sf_dir):
    from .plans import sparql

    return sparql.Graph(_court_triples(spark, sf_dir)).query('SELECT ?label (LANG(?label) AS ?lang) WHERE { ?c rdfs:label ?label FILTER(LANGMATCHES(LANG(?label), "DE")) }')


@register("select_nodes_by_property", """SELECT 'node' AS of, CAST(n_nationkey AS VARCHAR) AS id FROM nation WHERE n_regionkey IN (1, 3)
    UNION ALL SELECT 'edge', CAST(k AS VARCHAR) FROM (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 2 AND n_nationkey < 20 UNION SELECT n_nationkey + 5 FROM nation WHERE n_regionkey = 2 AND n_nationkey < 20)""")
def _selected(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    nodes = nation.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_regionkey").cast("string").alias("kind"))
    edges = nation.filter("n_nationkey < 20").select(F.col("n_nationkey").cast("string").alias("src"), (F.col("n_nationkey") + 5).cast("string").alias("dst"), F.col("n_regionkey").cast("string").alias("label"))
    found = graph.selected_nodes(nodes, edges, "kind", ["1", "3"]).withColumn("of", F.lit("node"))
    return found.unionByName(graph.selected_nodes(nodes, edges, "label", ["2"], of="edges").withColumn("of", F.lit("edge"))).select("of", "id")


@register("prompt_of_chunk", "SELECT doc_id, md5('Extract: ' || text) AS h FROM documents WHERE text IS NOT NULL")
def _prompt(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.md5(extraction.prompt("Extract: ", "text")).alias("h"))


@register("provider_answers", "SELECT event_id, unnest(['ollama', 'openai', 'generate']) AS provider, event_type || ' \"ü\"' AS answer FROM events")
def _answers(spark, sf_dir):
    said = F.concat("event_type", F.lit(' "ü"')).alias("content")
    shapes = {
        "ollama": F.struct(F.struct(said).alias("message")), "openai": F.struct(F.array(F.struct(F.struct(said).alias("message"))).alias("choices")),
        "generate": F.struct(F.concat("event_type", F.lit(' "ü"')).alias("response")),
    }
    events = table(spark, sf_dir, "events")
    parts = [events.select("event_id", F.lit(name).alias("provider"), X.answer_text(F.to_json(shape), name).alias("answer")) for name, shape in shapes.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("version_of_file", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 90 + 10 END AS INTEGER) AS version FROM orders")
def _version(spark, sf_dir):
    name = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("codes_"), F.col("o_orderkey") % 90 + 10, F.lit(".xlsx"))).otherwise(F.concat(F.lit("codes_12."), "o_orderkey", F.lit(".xls")))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.version_of(name).alias("version"))


@register("path_parts", "SELECT o_orderkey, 'f.' || o_orderkey || '.txt' AS base, 'f.' || o_orderkey AS stem, CASE WHEN o_orderkey % 2 = 0 THEN 'b/f.' || o_orderkey || '.txt' END AS below, '/out/f.' || o_orderkey || '.json' AS joined FROM orders")
def _paths(spark, sf_dir):
    path = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "/a/b/f.").otherwise("/ab/f."), "o_orderkey", F.lit(".txt"))
    joined = X.join_path(F.lit("/out/"), F.concat(X.stem(path), F.lit(".json")))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.basename(path).alias("base"), X.stem(path).alias("stem"), X.relative_path(path, F.lit("/a/")).alias("below"), joined.alias("joined"))


@register("retried_calls", "SELECT CAST(n_nationkey AS VARCHAR) AS file, CAST(least(n_nationkey % 5 + 1, 3) AS INTEGER) AS attempts, CASE WHEN n_nationkey % 5 < 3 THEN 'answer ' || n_nationkey END AS answer FROM nation")
def _retried(spark, sf_dir):
    def make():
        tries: dict[str, int] = {}

        def ask(chunk: str) -> str:
            tries[chunk] = tries.get(chunk, 0) + 1
            if tries[chunk] <= int(chunk) % 5:  # an empty answer and an exception are failures alike
                if tries[chunk] % 2:
                    raise OSError(chunk)
                return ""
            return f"answer {chunk}"

        return ask

    file = F.col("n_nationkey").cast("string")
    chunks = extraction.chunks(table(spark, sf_dir, "nation").select(file.alias("file"), file.alias("text")))
    return extraction.answers(chunks, make, extraction.Options(backoff=0.0)).select("file", F.col("attempts").cast("int").alias("attempts"), "answer")


@register("calls_with_time_limit", "SELECT CAST(r_regionkey AS VARCHAR) AS file, CASE WHEN r_regionkey <> 2 THEN 'in time' END AS answer FROM region")
def _timed(spark, sf_dir):
    def make():
        def ask(chunk: str) -> str:
            time.sleep(2.0 if chunk == "2" else 0.0)
            return "in time"

        return ask

    file = F.col("r_regionkey").cast("string")
    chunks = extraction.chunks(table(spark, sf_dir, "region").select(file.alias("file"), file.alias("text")))
    return extraction.answers(chunks, make, extraction.Options(backoff=0.0, attempts=1, timeout=0.5)).select("file", "answer")


QUERIES.pop("imprint_links")


@register("imprint_links", r"""WITH l AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1)) AS href FROM pages)
    SELECT DISTINCT url, regexp_extract(url, '^[a-z]+://[^/]+') || href AS link FROM l""")
def _links(spark, sf_dir):
    return imprint.distinct_links(table(spark, sf_dir, "pages"))


#: Pages of records whose similarities are known: runs of one letter are alike by twice the shorter over both lengths.
_PAIRS = """
SELECT c_custkey // 12 AS doc, c_custkey AS row, repeat(substr('abc', CAST(c_custkey % 3 + 1 AS INT), 1), CAST(c_custkey % 5 + 1 AS INT)) AS Court_name, '1. Mai' AS Date_of_article,
  repeat(substr('uvwxyz', CAST(c_custkey % 6 + 1 AS INT), 1), CAST(c_custkey % 7 + 2 AS INT)) AS Company_name, CASE WHEN c_custkey % 4 > 0 THEN 'HRB ' || CAST(c_custkey % 3 AS {string}) END AS Registration_Code, '1927' AS Registration_year
FROM {customer}
UNION ALL SELECT -1, -1, NULL, NULL, NULL, NULL, NULL FROM {customer} WHERE c_custkey < 0
"""
_OTHER = """
SELECT doc, row, CASE WHEN row % 2 = 0 THEN Court_name ELSE repeat(substr(Court_name, 1, 1), length(Court_name) + 1) END AS Court_name, Date_of_article,
  CASE WHEN row % 3 = 0 THEN upper(Company_name) ELSE repeat(substr(Company_name, 1, 1), length(Company_name) + CAST(row % 2 AS INT)) END AS Company_name, CASE WHEN row % 5 > 0 THEN Registration_Code END AS Registration_Code,
  CASE WHEN row % 8 > 0 THEN Registration_year ELSE '1928' END AS Registration_year
FROM {pairs} WHERE row % 6 <> 1
"""


def _known_pages(spark, sf_dir):
    truth = spark.sql(_PAIRS.format(string="STRING", customer="{c}").replace(" // ", " div "), c=table(spark, sf_dir, "customer")).withColumn("doc", F.col("doc").cast("string"))
    return truth, spark.sql(_OTHER.format(pairs="{t}"), t=truth)


def _greedy(fuzzy: bool, truth: str, parsed: str) -> str:
    """Greedy matching in SQL, a record of truth for each step of the recursion."""
    alike = "CASE WHEN substr(lower({a}), 1, 1) = substr(lower({b}), 1, 1) THEN 2.0 * least(length({a}), length({b})) / (length({a}) + length({b})) ELSE 0.0 END"
    inside = "CASE WHEN coalesce({a}, '') <> '' AND coalesce({b}, '') <> '' AND (contains(lower({a}), lower({b})) OR contains(lower({b}), lower({a}))) THEN 1.0 ELSE 0.0 END"
    same = "CASE WHEN coalesce({a}, '') = coalesce({b}, '') THEN 1.0 ELSE 0.0 END" if fuzzy else "CASE WHEN coalesce({a}, '') <> '' AND {a} = {b} THEN 1.0 ELSE 0.0 END"
    of = lambda form, c: form.format(a=f"t.{c}", b=f"p.{c}")
    text = alike if fuzzy else inside
    day = "1.0" if fuzzy else of(inside, "Date_of_article")  # the same everywhere in pages of known similarities
    total = f"2 * ({of(text, 'Court_name')}) + {day} + 2 * ({of(text, 'Company_name')}) + 2 * ({of(same, 'Registration_Code')}) + 2 * ({of(same, 'Registration_year')})"
    rank = f"({of(text, 'Court_name')}) + ({of(text, 'Company_name')})" if fuzzy else total
    least = ">= 0.5" if fuzzy else "> 0"
    code = "coalesce(t.Registration_Code, '') <> coalesce(p.Registration_Code, '')"
    year = "coalesce(t.Registration_year, '') <> coalesce(p.Registration_year, '')"
    return f"""WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY row) AS pos FROM ({truth})), p AS ({parsed}),
    pair AS (SELECT t.doc, t.pos, p.row, {rank} AS rank, {total} AS score, {code} AS code, {year} AS other_year FROM t JOIN p ON t.doc = p.doc),
    g AS (SELECT doc, CAST(0 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS used, CAST(NULL AS STRUCT(row BIGINT, score DOUBLE, code BOOLEAN, other_year BOOLEAN)) AS hit FROM (SELECT DISTINCT doc FROM t)
      UNION ALL SELECT x.doc, x.pos, CASE WHEN x.hit IS NULL THEN x.used ELSE list_append(x.used, x.hit.row) END, x.hit FROM (
        SELECT g.doc, t.pos, g.used, (SELECT arg_min({{'row': CAST(pair.row AS BIGINT), 'score': CAST(pair.score AS DOUBLE), 'code': pair.code, 'other_year': pair.other_year}}, (-round(pair.rank, 12), pair.row)) FROM pair
          WHERE pair.doc = g.doc AND pair.pos = t.pos AND NOT list_contains(g.used, pair.row) AND round(pair.rank, 12) {least}) AS hit FROM g JOIN t ON t.doc = g.doc AND t.pos = g.pos + 1) x),
    found AS (SELECT g.doc, g.hit, t.Registration_Code FROM g JOIN t ON t.doc = g.doc AND t.pos = g.pos)
    SELECT CAST(doc AS VARCHAR) AS doc, round(sum(coalesce(hit.score, 0)), 6) AS score, CAST(9 * count(*) AS BIGINT) AS ideal, count(hit.row) AS matched, count(*) FILTER (coalesce(hit.code, {'false' if fuzzy else 'Registration_Code IS NOT NULL'}) OR coalesce(hit.other_year, false)) AS mismatched,
      count(*) FILTER (coalesce(hit.code, {'false' if fuzzy else 'Registration_Code IS NOT NULL'})) AS code_mismatches FROM found GROUP BY 1"""


_TRUTH = _PAIRS.format(string="VARCHAR", customer="customer")


@register("score_fuzzy_known", _greedy(True, _TRUTH, _OTHER.format(pairs="t")))
def _fuzzy(spark, sf_dir):
    return matching.summary(matching.match_records(*_known_pages(spark, sf_dir), "fuzzy")).withColumn("score", F.round("score", 6)).drop("ratio")


@register("score_containment_known", _greedy(False, _TRUTH, _OTHER.format(pairs="t")))
def _containment(spark, sf_dir):
    return matching.summary(matching.match_records(*_known_pages(spark, sf_dir), "containment")).withColumn("score", F.round("score", 6)).drop("ratio")


QUERIES.pop("score_containment")
_PAGES = _REC + f"SELECT n_name || '-' || CAST(id % 40 AS VARCHAR) AS doc, id AS row, {_FIVE} FROM rec"
_PARSED = """SELECT doc, row, Court_name, Date_of_article, CASE WHEN row % 3 = 0 THEN lower(Company_name) ELSE Company_name || ' AG' END AS Company_name,
  CASE WHEN row % 6 < 4 THEN Registration_Code END AS Registration_Code, Registration_year FROM t WHERE row % 4 <> 0"""


@register("score_containment", _greedy(False, _PAGES, _PARSED))
def _containment_of_records(spark, sf_dir):
    return matching.summary(matching.match_records(*_pages_of_records(spark, sf_dir), "containment")).withColumn("score", F.round("score", 6)).drop("ratio")


@register("stream_of_texts", f"WITH f AS ({_NATIONS}) SELECT split_part(path, '/', 2) AS file, md5(content) AS h, count(*) AS times FROM f GROUP BY ALL")
def _stream(spark, sf_dir):
    folder, out, state = (storage.fresh(spark, n) for n in ("in", "out", "state"))
    rows = _nation_files(spark, sf_dir)
    for half in (F.hash("path") % 2 == 0, F.hash("path") % 2 != 0):  # what the first run took up, the second doesn't
        files.write_named(rows.filter(half), folder)
        ingest.take_up(ingest.new_texts(spark, folder), lambda df: df.select("file", F.md5("text").alias("h")), out, state).awaitTermination()
    return spark.read.option("basePath", out).parquet(out).groupBy("file", "h").agg(F.count("*").alias("times"))


@register("stream_event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY ALL")
def _windows(spark, sf_dir):
    out, state = storage.fresh(spark, "out"), storage.fresh(spark, "state")
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*").withColumn("value", F.round(F.col("value") * 100))
    counted = ingest.event_windows(stream)
    # every batch holds all windows so far and replaces the last one
    counted.writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.col("total").cast("long").alias("total"))
