import pytest
from pyspark.sql import functions as F

from registerloom import schemas as S
from registerloom.operators import graph, registry
from registerloom.plans import sparql
from registerloom.sources import files

RECORDS = [
    ("Amtsgericht Essen", "2. September 1927", "Alpha AG", "HRB 1", "1927"),
    ("Amtsgericht Essen", None, "Beta GmbH", None, "?"),
    ("Amtsgericht Kassel", "3. Mai 1930", "Gamma", "unbekannt", "um 1930"),
    ("Landgericht Ulm", None, "Delta", "HRA 2", None),
    ("", None, "Nobody", None, None),
    ("Amtsgericht Essen", None, None, None, None),
]


@pytest.fixture(scope="module")
def raw(spark):
    return graph.triplify(spark.createDataFrame(RECORDS, S.RECORD).withColumn("fileName", F.lit("page.json"))).cache()


def test_triplify(raw):
    counts = {r["p"].rsplit("/", 1)[-1].rsplit("#", 1)[-1]: r["count"] for r in raw.groupBy("p").count().collect()}
    assert counts == {"type": 7, "companyName": 4, "courtName": 3, "registeredAt": 4, "registrationCode": 3, "registrationYear": 2, "articleDate": 2, "fileName": 4}
    years = {(r["o"], r["o_dt"]) for r in raw.filter(F.col("p") == S.EX + "registrationYear").collect()}
    assert years == {("1927", S.XSD + "gYear"), ("um 1930", None)}


def test_clean(raw):
    cleaned = graph.clean(raw)
    assert {r["o"] for r in graph.match(cleaned, p=S.EX + "companyName").collect()} == {"Alpha AG", "Beta GmbH", "Gamma"}
    assert not graph.match(cleaned, p=S.EX + "articleDate").count()
    assert all(r["o_dt"] is None for r in cleaned.collect())


def test_fewest_nulls(spark):
    rows = spark.createDataFrame([("u2", "A", "c1", None, None), ("u1", "A", "c2", "x", None), ("u0", None, "c", "x", "y")], "uri string, companyName string, courtName string, registrationCode string, registrationYear string")
    assert [r["uri"] for r in graph.fewest_nulls(rows).collect()] == ["u1"]
    assert {r["uri"] for r in graph.fewest_nulls(rows, ("companyName", "courtName")).collect()} == {"u1", "u2"}


def test_ranks_and_subgraph(raw):
    top = graph.top_courts(raw, 1, 1)
    assert [(r["court"], r["n"]) for r in top.collect()] == [(S.COURT + "Amtsgericht_Essen", 2)]
    assert not graph.top_courts(raw).count()  # no rank from 91 to 100
    sub = graph.subgraph(raw, top)
    assert {r["label"] for r in graph.nodes(sub).collect()} == {"Alpha AG", "Beta GmbH", "Amtsgericht Essen"}
    assert graph.edges(sub).count() == 2


def test_closure_with_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    reached = {(r["src"], r["dst"], r["depth"]) for r in graph.closure(edges).collect()}
    assert ("a", "a", 3) in reached and ("a", "c", 2) in reached and len(reached) == 10
    near = {(r["node"], r["distance"]) for r in graph.neighbours(edges, spark.createDataFrame([("b",)], "node string"), 1).collect()}
    assert near == {("b", 0), ("a", 1), ("c", 1)}


def test_registry(spark):
    rows = [
        ("A1", "Köln (Süd)", "HRA", "NRW", "1", None, None, 1, "v01.xlsx", 0),
        ("A1", "Köln (Süd)", "HRA", "NRW", "1", None, None, 2, "v02.xlsx", 0),
        ("A1", "Köln (Süd)", "HRA", "NRW", "2", None, None, 3, "v03.xlsx", 0),
        ("B1", "Ulm", None, "BW", None, "1.2.2020", "C1", 1, "v01.xlsx", 1),
        ("B1", "Ulm", None, "BW", None, None, "nan", 3, "v03.xlsx", 1),
        (None, "Ulm", None, "BW", None, None, None, 3, "v03.xlsx", 2),
    ]
    schema = ", ".join(f"{c} string" for c in S.REGISTRY_COLUMNS) + ", Version int, file string, row int"
    final = registry.combine(spark.createDataFrame(rows, schema))
    assert [(r["XJustizID"], r["PLZ"], r["Version"], r["ValidUntil"]) for r in final.collect()] == [("A1", "2", 3, None), ("B1", None, 1, "1.2.2020")]
    triples = registry.triples(final).collect()
    assert (S.XJUSTIZ + "B1", S.EXH + "validUntil", "2020-02-01") in {(t["s"], t["p"], t["o"]) for t in triples}
    assert (S.XJUSTIZ + "B1", S.EXH + "hasPostalCode", "") in {(t["s"], t["p"], t["o"]) for t in triples}
    assert [tuple(r) for r in registry.successors(final).collect()] == [("B1", "C1")]


def ask(raw, text, **options):
    return sorted(map(tuple, sparql.Graph(raw, **options).query(text).collect()), key=repr)


def test_sparql(raw):
    assert ask(raw, "SELECT ?n WHERE { ?c ex:courtName ?n . ?x ex:registeredAt ?c } GROUP BY ?n HAVING (COUNT(?x) > 1)") == [("Amtsgericht Essen",)]
    assert ask(raw, 'SELECT ?n ?code WHERE { ?x ex:companyName ?n OPTIONAL { ?x ex:registrationCode ?code FILTER(STRSTARTS(?code, "HRB")) } }') == [("Alpha AG", "HRB 1"), ("Beta GmbH", None), ("Delta", None), ("Gamma", None)]
    assert ask(raw, 'SELECT (COUNT(*) AS ?n) WHERE { ?x ex:registrationYear ?y FILTER(?y < 1930) }') == [(1,)]
    assert ask(raw, 'SELECT (COUNT(*) AS ?n) WHERE { ?x ex:registrationYear ?y FILTER(?y < 1930) }', strict_types=True) == [(0,)]
    assert ask(raw, "SELECT ?n WHERE { ?x ex:companyName ?n MINUS { ?x ex:registrationCode ?c } }") == [("Beta GmbH",)]
    assert ask(raw, 'SELECT ?v WHERE { BIND(CONCAT("a", "b") AS ?v) }') == [("ab",)]
    assert ask(raw, 'SELECT DISTINCT ?l WHERE { ?x ex:companyName ?n BIND(IF(REGEX(?n, "ag$", "i"), "yes", "no") AS ?l) }') == [("no",), ("yes",)]
    assert ask(raw, "SELECT ?n WHERE { ?c ex:courtName ?n . ?c ^ex:registeredAt/ex:companyName \"Delta\" }") == [("Landgericht Ulm",)]
    assert ask(raw, 'SELECT ?x ?d WHERE { ?x ex:registrationYear ?y BIND(DATATYPE(?y) AS ?d) FILTER(?y IN (1927)) }')[0][1] == S.XSD + "gYear"


def test_sparql_values_with_unbound(raw):
    text = 'SELECT ?n ?k WHERE { VALUES (?n ?k) { ("Gamma" "g") (UNDEF "any") } ?x ex:companyName ?n }'
    assert len(ask(raw, text)) == 1 + 4


def test_star_scan_is_the_same(raw):
    text = "SELECT ?n ?code WHERE { ?x ex:companyName ?n ; ex:registrationCode ?code ; ex:fileName ?f ; a ex:Company }"
    wide = sparql.wide_table(raw, [S.EX + p for p in ("companyName", "registrationCode", "fileName")])
    assert ask(raw, text, wide=wide) == ask(raw, text)
    plan = sparql.Graph(raw, wide).query(text)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_filters_reach_the_scan_and_no_nested_loops(spark, raw, tmp_path):
    raw.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    plan = sparql.Graph(stored).query('SELECT ?n WHERE { ?x ex:registeredAt court:Amtsgericht_Essen ; ex:companyName ?n }')._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(p)" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_errors():
    for text in ("SELECT ?x WHERE { ?x nope:y ?z }", "ASK { }", "SELECT ?x WHERE { ?x"):
        with pytest.raises(sparql.SparqlError):
            sparql.parse(text)


def test_template():
    template = "# IF A AND !B #\none %X%\n# ELSE #\ntwo\n# ENDIF #"
    assert sparql.expand(template, {"X": "%Y%", "Y": "z"}, {"A"}) == "one z"
    assert sparql.expand(template, {}, {"A", "B"}) == "two"


def test_ontologies(spark):
    assert graph.historical_ontology(spark).count() == 9
    assert graph.registry_ontology(spark).count() == 8 + 24


def test_paths_from_bound_ends(spark):
    rows = [(f"http://e/{a}", S.EX + "next", f"http://e/{b}", "iri", None, None) for a, b in ("ab", "bc", "cd", "de", "ef", "fg", "gb", "xy")]
    t = spark.createDataFrame(rows, S.TRIPLE)
    ends = lambda text: sorted(r[0][-1] for r in sparql.Graph(t).query(text).collect())
    assert ends("SELECT ?o WHERE { <http://e/a> ex:next+ ?o }") == list("bcdefg")
    assert ends("SELECT ?o WHERE { <http://e/x> ex:next* ?o }") == list("xy")
    assert ends("SELECT ?s WHERE { ?s ex:next+ <http://e/y> }") == ["x"]
    assert ends("SELECT ?s WHERE { ?s ex:next/ex:next <http://e/c> }") == list("ag")
    assert ends("SELECT ?s WHERE { ?s (ex:next|^ex:next)? <http://e/x> }") == list("xy")
    assert sorted(r[0][-1] for r in sparql.Graph(t).query("SELECT ?o WHERE { <http://e/a> ex:next/ex:next+ ?o }").distinct().collect()) == list("bcdefg")


def test_joins_over_unbound_variables_are_on_equal_values(raw):
    text = "SELECT ?n ?v WHERE { ?c ex:companyName ?n OPTIONAL { ?c ex:registrationCode ?v } ?d ex:registrationYear ?v }"
    plan = sparql.Graph(raw).query(text)._jdf.queryExecution().optimizedPlan().toString()
    assert " OR " not in plan and "||" not in plan
    assert len(ask(raw, text)) == 2  # the one company without a code goes with both years


def test_text_relations_and_cap(raw):
    assert [r[0] for r in ask(raw, 'SELECT ?t WHERE { ?t ql:contains-word "amts* kassel" }')] == ["Amtsgericht Kassel"]
    assert len(sparql.Graph(raw).query("SELECT ?s WHERE { ?s ?p ?o }", cap=3).collect()) == 3
    with pytest.raises(sparql.SparqlError):
        ask(raw, "SELECT ?s WHERE { ?s ex:companyName ?o FILTER(REGEX(?o, ?s)) }")


@pytest.fixture(scope="module")
def quads(spark):
    """Two graphs that share a statement, with a chain each and a cycle in one, and a third of few statements."""
    e = lambda x: f"http://e/{x}"
    next_of = {"one": ("ab", "bc", "cd"), "two": ("ab", "bx", "xa", "cy"), "three": ("yz",)}
    rows = [(e(a), S.EX + "next", e(b), "iri", None, None, e(g)) for g, edges in next_of.items() for a, b in edges]
    names = {"one": {"a": "old A", "b": "old B"}, "two": {"a": "new A", "x": "new X", "b": "old B"}}
    rows += [(e(x), S.EX + "name", n, "literal", None, None, e(g)) for g, of in names.items() for x, n in of.items()]
    return spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_dt string, o_lang string, g string")


@pytest.mark.parametrize(
    "group",
    [
        "?s ex:next ?o . ?o ex:next ?z",
        "?s ex:next+ ?o",
        "<http://e/a> ex:next* ?o",
        "?s ex:next* <http://e/a>",
        "?s (ex:next|^ex:next)? <http://e/b>",
        "?s ex:next ?o OPTIONAL { ?o ex:name ?n }",
        "OPTIONAL { ?s ex:name ?n }",
        "VALUES ?s { <http://e/a> <http://e/q> }",
        "VALUES ?s { <http://e/a> <http://e/q> } OPTIONAL { ?s ex:name ?n }",
        "?s ex:next ?o MINUS { ?o ex:name ?n }",
        "?s ex:next ?o MINUS { ?x ex:name ?n }",
        "{ ?s ex:name ?n } UNION { VALUES ?s { <http://e/k> } }",
        '?s ex:name ?n FILTER(STRSTARTS(?n, "old"))',
        '?t ql:contains-word "old b" . ?s ex:name ?t',
        "?t ql:contains-entity <http://e/b>",
        "{ SELECT ?s (COUNT(?o) AS ?n) WHERE { ?s ?p ?o } GROUP BY ?s }",
        "{ SELECT DISTINCT ?p WHERE { ?s ?p ?o } }",
        "GRAPH <http://e/three> { ?y ex:next ?z } ?s ex:name ?n",
        "",
    ],
)
def test_each_graph_is_asked_by_itself(quads, group):
    got = sparql.Graph(quads).query(f"SELECT * WHERE {{ GRAPH ?g {{ {group} }} }}")
    names = [c for c in got.columns if c != "g"]
    want = []
    for g in ("one", "two", "three"):
        of = quads.filter(F.col("g") == f"http://e/{g}")
        alone = sparql.Graph(quads if "GRAPH" in group else of.drop("g"))
        inner = f"GRAPH <http://e/{g}> {{ {group} }}" if "GRAPH" in group else group
        want += [(f"http://e/{g}", *r) for r in (alone.query(f"SELECT {' '.join('?' + n for n in names)} WHERE {{ {inner} }}").collect() if names else [()])]
    assert sorted(map(repr, (tuple(r) for r in got.select("g", *names).collect()))) == sorted(map(repr, want))
    assert len(want) > 1


def test_graphs_of_a_query(quads):
    q = lambda text: sorted(tuple(r) for r in sparql.Graph(quads).query(text).collect())
    e = "http://e/"
    assert q("SELECT (COUNT(*) AS ?n) WHERE { ?s ?p ?o }") == [(11,)]  # 13 quads, two statements stand in two graphs
    assert q("SELECT (COUNT(*) AS ?n) FROM <http://e/one> WHERE { ?s ?p ?o }") == [(5,)]
    assert q("SELECT (COUNT(*) AS ?n) FROM <http://e/one> FROM <http://e/two> WHERE { ?s ?p ?o }") == [(10,)]
    assert q("SELECT (COUNT(*) AS ?n) FROM NAMED <http://e/one> WHERE { ?s ?p ?o }") == [(0,)]
    assert q("SELECT ?g FROM <http://e/two> WHERE { GRAPH ?g { ?s ?p ?o } }") == []
    assert q("SELECT DISTINCT ?g FROM NAMED <http://e/one> FROM NAMED <http://e/no> WHERE { GRAPH ?g { ?s ?p ?o } }") == [(e + "one",)]
    # a chain through two graphs exists in their union only
    assert q("SELECT ?o FROM <http://e/one> FROM <http://e/three> FROM <http://e/two> WHERE { <http://e/c> ex:next+ ?o }") == [(e + "d",), (e + "y",), (e + "z",)]
    # the graph is a variable of joins, also with itself
    assert q("SELECT ?h WHERE { GRAPH ?g { ?s ex:name \"old A\" } GRAPH ?h { ?s ex:name ?n } FILTER(?g != ?h) }") == [(e + "two",)]
    assert q("SELECT ?g WHERE { VALUES ?g { <http://e/two> <http://e/no> } GRAPH ?g { ?s ex:name \"old B\" } }") == [(e + "two",)]
    assert q("SELECT ?g WHERE { GRAPH ?g { ?g ex:next ?o } }") == []
    assert q("SELECT ?s WHERE { ?s ex:name \"old B\" MINUS { GRAPH <http://e/three> { ?s ?p ?o } } }") == [(e + "b",)]


def test_graphs_are_files_of_their_own(spark, quads, tmp_path):
    files.write_quads(quads, str(tmp_path / "q"))
    stored = spark.read.schema(quads.schema).parquet(str(tmp_path / "q"))
    assert sorted(map(tuple, stored.collect()), key=repr) == sorted(map(tuple, quads.collect()), key=repr)
    df = sparql.Graph(stored).query("SELECT ?n WHERE { GRAPH <http://e/one> { ?s ex:next ?o ; ex:name ?n } }")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(g") == plan.count("FileScan") == 2 and "Cartesian" not in plan
    assert sorted(r[0] for r in df.collect()) == ["old A", "old B"]


def test_what_graphs_cannot_be_asked(raw, quads):
    with pytest.raises(sparql.SparqlError):
        ask(raw, "SELECT ?s WHERE { GRAPH ?g { ?s ?p ?o } }")
    for text in ("SELECT ?s WHERE { GRAPH \"g\" { ?s ?p ?o } }", "SELECT ?s WHERE { GRAPH ?g { { SELECT ?s WHERE { ?s ?p ?o } LIMIT 1 } } }", "SELECT ?s FROM ?g WHERE { ?s ?p ?o }"):
        with pytest.raises(sparql.SparqlError):
            sparql.Graph(quads).query(text)


def test_records_are_dealt_before_they_become_triples(spark):
    """One file may hold all records; a task that made all of their triples would keep them all."""
    rows = [("AG Essen", None, f"Firma {i % 50}", f"HRB {i % 100}", "1927", i) for i in range(400)] + [("", None, "x", None, None, 0), (None, None, "y", None, None, 0)]
    records = spark.createDataFrame(rows, "Court_name string, Date_of_article string, Company_name string, Registration_Code string, Registration_year string, other int").coalesce(1)
    found = graph.triplify(records)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE_PARTITIONS_BY_COL" in plan[plan.index("Generate explode") :]
    per = {r["p"].rsplit("/")[-1].rsplit("#")[-1]: r["n"] for r in found.groupBy("p").agg(F.count("*").alias("n")).collect()}
    assert per == {"type": 51, "companyName": 50, "courtName": 1, "registeredAt": 50, "registrationCode": 100, "registrationYear": 50}
