"""The register graph: records to triples, cleaning, ranks, neighbourhoods and closures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X
from ..plans.storage import stored


#: Steps along edges in one job.
UNROLLED = 4


def iri(s: Column, p: str, o: Column) -> Column:
    """A triple with an IRI for object, as a struct."""
    return F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))


def literal(s: Column, p: str, o: Column, datatype: Column | None = None, lang: str | None = None) -> Column:
    dt = F.lit(None).cast("string") if datatype is None else datatype
    return F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit("literal").alias("o_kind"), dt.alias("o_dt"), F.lit(lang).cast("string").alias("o_lang"))


def emit(df: DataFrame, triples: list[Column]) -> DataFrame:
    """Distinct triples of each row; structs that are null are left out."""
    found = df.select(F.explode(F.filter(F.array(*triples), lambda t: t.isNotNull())).alias("t")).select("t.*")
    return found.distinct()


def fixed(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(s, p, o, kind, dt, lang) for s, p, o, kind, dt, lang in rows], S.TRIPLE)


def required(records: DataFrame) -> DataFrame:
    """Records with a court and a company."""
    return records.filter("Court_name <> '' AND Company_name <> ''")


def triplify(records: DataFrame) -> DataFrame:
    """Triples of extraction records (with optional fileName): five for each, and up to four for what is known.

    A record becomes many triples in the task that has it, so records are dealt anew first: one file may hold all of them.
    The shuffle is sized as it runs."""
    records = records if "fileName" in records.columns else records.withColumn("fileName", F.lit(None).cast("string"))
    records = required(records).select(*S.RECORD.names, "fileName").hint("rebalance", F.col("Company_name"), F.col("Court_name"))
    company = F.concat(F.lit(S.COMPANY), X.clean_uri("Company_name"))
    court = F.concat(F.lit(S.COURT), X.clean_uri("Court_name"))
    said = lambda name: F.coalesce(F.col(name), F.lit("")) != ""
    year, is_year = X.year_value("Registration_year")
    return emit(
        records,
        [
            iri(company, S.A, F.lit(S.EX + "Company")),
            iri(court, S.A, F.lit(S.EX + "Court")),
            literal(company, S.EX + "companyName", F.col("Company_name")),
            literal(court, S.EX + "courtName", F.col("Court_name")),
            iri(company, S.EX + "registeredAt", court),
            F.when(said("Registration_Code"), literal(company, S.EX + "registrationCode", F.col("Registration_Code"))),
            F.when(year.isNotNull(), literal(company, S.EX + "registrationYear", year, F.when(is_year, S.XSD + "gYear"))),
            F.when(said("Date_of_article"), literal(company, S.EX + "articleDate", F.col("Date_of_article"))),
            F.when(said("fileName"), literal(company, S.EX + "fileName", F.col("fileName"))),
        ],
    )


def historical_ontology(spark: SparkSession) -> DataFrame:
    classes = [(S.EX + n, S.A, S.RDFS + "Class", "iri", None, None) for n in ("Company", "Court")]
    names = ("companyName", "courtName", "registeredAt", "registrationCode", "registrationYear", "articleDate", "fileName")
    return fixed(spark, classes + [(S.EX + n, S.A, S.RDF + "Property", "iri", None, None) for n in names])


def registry_ontology(spark: SparkSession) -> DataFrame:
    """Classes and properties of the register graph, with labels, domains and ranges."""
    label = lambda n, text: (S.EXH + n, S.RDFS + "label", text, "literal", None, "en")
    rows = []
    for name, text in (("RegisterCourt", "Register Court"), ("XJustizID", "XJustiz Identifier"), ("RegisterType", "Register Type"), ("State", "State")):
        rows += [(S.EXH + name, S.A, S.RDFS + "Class", "iri", None, None), label(name, text)]
    properties = (
        ("hasXJustizID", "RegisterCourt", S.EXH + "XJustizID", "has XJustiz ID"),
        ("hasPostalCode", "XJustizID", S.XSD + "string", "Postal Code"),
        ("hasRegisterType", "XJustizID", S.EXH + "RegisterType", "Has Register Type"),
        ("locatedIn", "XJustizID", S.EXH + "State", "Located In"),
        ("validUntil", "XJustizID", S.XSD + "date", "Valid Until"),
        ("hasFutureCode", "XJustizID", S.XSD + "string", "Future Code"),
    )
    for name, domain, range_, text in properties:
        s = S.EXH + name
        rows += [(s, S.A, S.RDF + "Property", "iri", None, None), (s, S.RDFS + "domain", S.EXH + domain, "iri", None, None), (s, S.RDFS + "range", range_, "iri", None, None), label(name, text)]
    return fixed(spark, rows)


def match(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Triples of one pattern; None matches all."""
    tests = [F.col(c) == v for c, v in (("s", s), ("p", p), ("o", o)) if v is not None]
    return triples.filter(reduce(lambda a, b: a & b, tests)) if tests else triples


def pivot(triples: DataFrame) -> DataFrame:
    """A row for each company: uri, companyName, courtName, registrationCode, registrationYear, courtURI, fileName.

    Values are normalised. Of several values of one property the greatest counts."""
    names = ("companyName", "registrationCode", "registrationYear", "fileName")
    is_ = lambda name: F.col("p") == S.EX + name
    value = X.normalize_text(X.strip("o"))
    kind = F.max(((F.col("p") == S.A) & (F.col("o") == S.EX + "Company")).cast("int"))
    aggs = [F.max(F.when(is_(n), value)).alias(n) for n in names]
    rows = triples.groupBy(F.col("s").alias("uri")).agg(kind.alias("is_company"), *aggs, F.max(F.when(is_("registeredAt"), F.col("o"))).alias("courtURI"))
    courts = match(triples, p=S.EX + "courtName").groupBy(F.col("s").alias("courtURI")).agg(F.max(value).alias("courtName"))
    return rows.filter("is_company = 1").join(courts, "courtURI", "left").select("uri", "companyName", "courtName", "registrationCode", "registrationYear", "courtURI", "fileName")


def plausible(entities: DataFrame) -> DataFrame:
    """Entities that may be registered companies, by five rules on lower-case values.

    Two of the words of the second rule cannot occur in normalised text; they stay for parity."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    name, court, code, year = (low(c) for c in ("companyName", "courtName", "registrationCode", "registrationYear"))
    same = (name == court) & (court == code) & (code == year)
    office = reduce(lambda a, b: a | b, [F.contains(court, F.lit(w)) for w in ("polizei", "stadtkämmerei", "juſtizminiſter")])
    nothing = (court == "") & (code == "")
    register = F.contains(court, F.lit("amt")) | F.contains(court, F.lit("regricht"))
    form = F.trim(name) == "gesellschaft mit beschraenkter haftung"
    return entities.filter(~same & ~office & ~nothing & register & ~form)


def fewest_nulls(entities: DataFrame, key: tuple[str, ...] = ("companyName",)) -> DataFrame:
    """One entity for each name (or name and court): the one with the fewest gaps, then of the smallest uri."""
    gaps = reduce(lambda a, b: a + b, [(F.coalesce(F.col(c), F.lit("")) == "").cast("int") for c in ("courtName", "registrationCode", "registrationYear")])
    w = Window.partitionBy(*key).orderBy("gaps", "uri")
    rows = entities.filter("companyName <> ''").withColumn("gaps", gaps)
    return rows.withColumn("pos", F.row_number().over(w)).filter("pos = 1").drop("pos", "gaps")


def rebuild(entities: DataFrame) -> DataFrame:
    """Triples of cleaned entities: all literals plain, dates of articles dropped, a court named where it has no IRI."""
    company, court = F.col("uri"), F.coalesce(F.col("courtURI"), F.concat(F.lit(S.COURT), F.replace(F.col("courtName"), F.lit(" "), F.lit("_"))))
    said = lambda name: F.coalesce(F.col(name), F.lit("")) != ""
    parts = [F.when(said(n), literal(company, S.EX + n, F.col(n))) for n in ("registrationCode", "registrationYear", "fileName")]
    at = said("courtName")
    parts += [
        iri(company, S.A, F.lit(S.EX + "Company")),
        literal(company, S.EX + "companyName", F.col("companyName")),
        F.when(at, iri(court, S.A, F.lit(S.EX + "Court"))),
        F.when(at, literal(court, S.EX + "courtName", F.col("courtName"))),
        F.when(at, iri(company, S.EX + "registeredAt", court)),
    ]
    return emit(entities, parts)


def clean(triples: DataFrame, key: tuple[str, ...] = ("companyName",)) -> DataFrame:
    """The cleaned graph of a raw one."""
    return rebuild(fewest_nulls(plausible(pivot(triples)), key))


def companies_per_court(triples: DataFrame) -> DataFrame:
    """court, n: distinct companies registered at each court's IRI."""
    companies = match(triples, p=S.A, o=S.EX + "Company").select("s")
    return match(triples, p=S.EX + "registeredAt").join(companies, "s", "left_semi").groupBy(F.col("o").alias("court")).agg(F.count_distinct("s").alias("n"))


def top_courts(triples: DataFrame, lo: int = 91, hi: int = 100) -> DataFrame:
    """court, n, rank of the courts ranked lo to hi by companies, ties by IRI; the published slice is 91 to 100."""
    head = companies_per_court(triples).orderBy(F.desc("n"), "court").limit(hi)  # a top-k, then ranks of hi rows
    return head.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "court"))).filter(F.col("rank") >= lo)


def subgraph(triples: DataFrame, courts: DataFrame) -> DataFrame:
    """Triples about the given courts (court) or companies registered there, as subject or object.

    Two semi-joins and a union; a join on either would become a nested loop."""
    courts = courts.select(F.col("court").alias("node"))
    registered = match(triples, p=S.EX + "registeredAt")
    members = registered.join(courts, registered["o"] == F.col("node"), "left_semi").select(F.col("s").alias("node"))
    nodes = courts.unionByName(members).distinct()
    return triples.join(nodes, triples["s"] == nodes["node"], "left_semi").unionByName(triples.join(nodes, triples["o"] == nodes["node"], "left_semi")).distinct()


def nodes(triples: DataFrame) -> DataFrame:
    """id, label, title, kind, color, size of all IRIs of a subgraph but classes and properties of type statements."""
    typed = F.col("p") == S.A
    ids = triples.select(F.col("s").alias("id")).unionByName(triples.filter(~typed & (F.col("o_kind") == "iri")).select(F.col("o").alias("id"))).distinct()
    facts = triples.groupBy(F.col("s").alias("id")).agg(
        F.array_join(F.array_sort(F.collect_set(F.when(typed, X.clean_label("o")))), ", ").alias("kind"),
        F.array_join(F.array_sort(F.collect_set(F.when(~typed, F.concat(X.clean_label("p"), F.lit(": "), F.col("o"))))), "<br>").alias("title"),
        F.max(F.when(F.col("p") == S.EX + "companyName", F.col("o"))).alias("company"),
        F.max(F.when(F.col("p") == S.EX + "courtName", F.col("o"))).alias("court"),
    )
    rows = ids.join(facts, "id", "left").withColumn("kind", F.when(F.coalesce("kind", F.lit("")) == "", "Unknown").otherwise(F.col("kind")))
    label = F.coalesce("company", "court", X.clean_label("id"))
    return rows.select("id", label.alias("label"), F.coalesce("title", F.lit("")).alias("title"), "kind", X.node_color("kind").alias("color"), X.node_size("kind").alias("size"))


def edges(triples: DataFrame) -> DataFrame:
    """src, dst, label of the statements between IRIs, without types."""
    return triples.filter((F.col("p") != S.A) & (F.col("o_kind") == "iri")).select(F.col("s").alias("src"), F.col("o").alias("dst"), X.clean_label("p").alias("label"))


def select_by_property(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    return rows.filter(F.col(column).isin(values))


def selected_nodes(node_rows: DataFrame, edge_rows: DataFrame, column: str, values: list[str], of: str = "nodes") -> DataFrame:
    """id of the nodes whose property has one of the values, or of both ends of such edges (of = 'edges')."""
    if of == "nodes":
        return select_by_property(node_rows, column, values).select("id").distinct()
    ends = select_by_property(edge_rows, column, values).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return ends.join(node_rows.select("id"), "id", "left_semi")


def neighbours(edge_rows: DataFrame, start: DataFrame, hops: int = 2) -> DataFrame:
    """node, distance of all nodes within hops of start (node), along edges (src, dst) in either direction."""
    both = edge_rows.select("src", "dst").unionByName(edge_rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = start.select("node").distinct().withColumn("distance", F.lit(0))
    front = seen
    for d in range(1, hops + 1):
        step = front.join(both, front["node"] == both["src"]).select(F.col("dst").alias("node")).distinct()
        front = step.join(seen, "node", "left_anti").withColumn("distance", F.lit(d))
        seen = seen.unionByName(front)
    return seen


def closure(edge_rows: DataFrame, max_depth: int | None = None, starts: DataFrame | None = None) -> DataFrame:
    """src, dst, depth: what each node reaches along edges (src, dst), by the fewest steps; cycles end by themselves.

    starts (node), if given, are the only sources: nothing else is followed. UNROLLED steps are taken in one job, each from
    what the last one found; their results are stored, so the plan does not grow."""
    step = stored(edge_rows.select("src", "dst").filter("src is not null and dst is not null").distinct())
    seen = step if starts is None else step.join(starts.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    front = seen = seen.withColumn("depth", F.lit(1))
    depth = 1
    while max_depth is None or depth < max_depth:
        steps = []
        for depth in range(depth + 1, min(depth + UNROLLED, max_depth or depth + UNROLLED) + 1):
            front = front.select(F.col("src").alias("a"), F.col("dst").alias("m")).join(step, F.col("m") == step["src"]).select(F.col("a").alias("src"), "dst").distinct()
            front = front.withColumn("depth", F.lit(depth))
            steps.append(front)
        found = reduce(DataFrame.unionByName, steps).groupBy("src", "dst").agg(F.min("depth").alias("depth"))
        found = stored(found.join(seen.select("src", "dst"), ["src", "dst"], "left_anti"))
        seen, front = seen.unionByName(found), found.filter(F.col("depth") == depth)
        if front.isEmpty():
            break
    return seen


def align(historical: DataFrame, register: DataFrame) -> DataFrame:
    """historical_court, register_court: courts of both graphs with the same normalised name."""
    names = lambda t, p, c: match(t, p=p).select(F.col("s").alias(c), F.lower(X.normalize_text("o")).alias("name"))
    left = names(historical, S.EX + "courtName", "historical_court")
    right = match(register, p=S.RDFS + "label").filter(F.col("s").startswith(S.REGISTER_COURT)).select(F.col("s").alias("register_court"), F.lower(X.normalize_text("o")).alias("name"))
    return left.join(right, "name").select("historical_court", "register_court", "name").distinct()
