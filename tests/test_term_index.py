"""The dictionary of terms and the index of words: the same answers as the plain graph, from less that is read."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from registerloom import schemas as S
from registerloom.plans import dictionary, sparql

PREFIX = "PREFIX ex: <http://example.org/schema/> PREFIX n: <http://n.example/>\n"


def rows(n=400, seed=4):
    rng = random.Random(seed)
    words = ["Köln", "köln", "Ulm", "Amts", "amtsgericht", "GmbH", "gmbh", "a", "ab", "ß", "\U0001f642", "x-y", "1927"]
    out = []
    for i in range(n):
        s = f"http://n.example/{rng.choice('abcä')}{i % 60}"
        out.append((s, S.EX + "name", " ".join(rng.choices(words, k=rng.randint(0, 4))), "literal", None, rng.choice([None, "de"])))
        out.append((s, S.EX + "year", str(1900 + i % 50), "literal", S.XSD + "gYear", None))
        out.append((s, S.EX + "next", f"http://n.example/{rng.choice('abcä')}{rng.randint(0, 59)}", "iri", None, None))
        if i % 3 == 0:
            out.append((s, S.A, S.EX + "Company", "iri", None, None))
    return out + out[:5]


@pytest.fixture(scope="module")
def graphs(spark):
    triples = spark.createDataFrame(rows(), S.TRIPLE)
    return sparql.Graph(triples.distinct().cache()), dictionary.indexed(triples)


@pytest.mark.parametrize(
    "query",
    [
        "SELECT ?s ?n WHERE { ?s ex:name ?n FILTER(STRSTARTS(STR(?s), 'http://n.example/ä')) }",
        "SELECT ?s ?n WHERE { ?s ex:name ?n FILTER REGEX(?n, '^Kö?') }",
        "SELECT ?s ?n WHERE { ?s ex:name ?n FILTER REGEX(?n, '^Amts|^Ulm') }",
        "SELECT ?s ?n WHERE { ?s ex:name ?n FILTER REGEX(?n, '^ulm', 'i') }",
        "SELECT ?n (COUNT(?s) AS ?k) WHERE { ?s ex:name ?n FILTER(STRSTARTS(?n, 'K') && STRLEN(?n) > 3) } GROUP BY ?n HAVING(COUNT(?s) > 1)",
        "SELECT * WHERE { ?s a ex:Company ; ex:year ?y . ?s ex:next ?t . ?t ex:year ?y }",
        "SELECT (COUNT(DISTINCT *) AS ?k) WHERE { ?s ex:next ?t . ?t ex:next ?u }",
        "SELECT DISTINCT ?s WHERE { ?s ex:next ?t . ?t ex:next ?s }",
        "SELECT ?s ?y WHERE { ?s a ex:Company . OPTIONAL { ?s ex:next ?t . ?t ex:year ?y FILTER(?y > 1930) } FILTER(STRSTARTS(STR(?s), 'http://n.example/b')) }",
        "SELECT ?s WHERE { { ?s ex:year '1907'^^<http://www.w3.org/2001/XMLSchema#gYear> } UNION { ?s ex:next n:a1 } MINUS { ?s a ex:Company } }",
        "SELECT ?p (COUNT(?o) AS ?k) WHERE { n:a3 ?p ?o } GROUP BY ?p",
        "SELECT ?a ?k WHERE { ?a ex:next n:b7 { SELECT ?a (COUNT(?n) AS ?k) WHERE { ?a ex:name ?n FILTER REGEX(?n, '^U') } GROUP BY ?a } }",
        "SELECT ?s ?t WHERE { ?s ex:next/ex:next ?t . ?s ex:year ?y FILTER(STRSTARTS(STR(?s), 'http://n.example/c1')) }",
        "SELECT ?s WHERE { ?s ex:nothing ?o }",
        "SELECT ?s WHERE { ?s ex:next n:nobody FILTER(STRSTARTS(STR(?s), 'urn:')) }",
        "SELECT ?n (LANG(?n) AS ?l) WHERE { ?s ex:name ?n ; ex:year ?y VALUES ?y { '1903'^^<http://www.w3.org/2001/XMLSchema#gYear> } }",
        "SELECT ?s ?s WHERE { ?s ex:next ?s }",
        "SELECT ?t WHERE { ?t ql:contains-word 'amts* köln' }",
        "SELECT ?t ?s WHERE { ?t ql:contains-word 'ab' . ?t ql:contains-entity ?s . ?s a ex:Company }",
        "SELECT ?t WHERE { ?t ql:contains-entity n:a3 }",
        "SELECT ?t WHERE { ?t ql:contains-word 'nowhere' }",
        "SELECT ?s ?k WHERE { ?s ex:year ?y BIND(?y + 1 AS ?k) { SELECT (?t AS ?s) WHERE { ?t a ex:Company } } }",
        "SELECT ?s ?n WHERE { { { ?s ex:name ?n VALUES ?n { 'Ulm' 'ab' } } } }",
    ],
)
def test_same_answers(graphs, query):
    plain, indexed = (Counter(tuple(r) for r in g.query(PREFIX + query).collect()) for g in graphs)
    assert plain == indexed


def test_terms_keep_their_order(graphs):
    terms = [r["term"] for r in graphs[1].index.terms.orderBy("id").collect()]
    assert terms == sorted(set(terms), key=str.encode) and terms[0][0] == '"' and terms[-1][0] == "<"
    assert [r["id"] for r in graphs[1].index.terms.orderBy("id").collect()] == list(range(len(terms)))
    for prefix in ("<http://n.example/ä", '"Amts', '"', "<urn:"):
        own = [i for i, t in enumerate(terms) if t.startswith(prefix)]
        assert graphs[1].index.interval(prefix) == ((own[0], own[-1]) if own else None)


def test_score(graphs):
    texts = {(r["o"], r["o_lang"], r["o_dt"]) for r in graphs[0].triples.filter("o_kind = 'literal'").collect()}
    split = {t: [w for w in re.split(r"[\W_]+", t[0].lower()) if w] for t in texts}
    hits = lambda t, q: sum(w.startswith(q[:-1]) if q.endswith("*") else w == q for w in split[t])
    df = {q: sum(hits(t, q) > 0 for t in texts) for q in ("a*", "gmbh")}
    want = Counter((t[0], round(sum(hits(t, q) * math.log(1 + len(texts) / df[q]) for q in df), 9)) for t in texts if all(hits(t, q) for q in df))
    got = graphs[1].query("SELECT ?t (SCORE(?t) AS ?k) WHERE { ?t ql:contains-word 'A* GmbH' }")
    assert Counter((r["t"], round(r["k"], 9)) for r in got.collect()) == want and want
    assert not re.search(r"[ (]split\(", got._jdf.queryExecution().optimizedPlan().toString())  # no literal is split when asked
    assert set(scanned(got)) == {"postings", "terms"}



def scanned(df):
    """Rows that each scan of files of the plan gave, by the table's folder."""
    df.collect()
    out = Counter()

    def walk(p):
        if p.nodeName() == "AdaptiveSparkPlan":
            walk(p.executedPlan())
        elif "QueryStage" in p.nodeName():
            walk(p.plan())
        elif p.nodeName().startswith("Scan parquet"):
            out[p.relation().location().rootPaths().apply(0).getName()] += p.metrics().apply("numOutputRows").value()
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return out


def test_a_prefix_reads_its_row_groups_only(spark):
    n = 60_000
    subject = F.concat(F.lit("http://n.example/company/"), F.format_string("%08d", F.pmod(F.col("id") * 7919, F.lit(n))))
    null = F.lit(None).cast("string")
    triples = spark.range(n).select(subject.alias("s"), F.lit(S.EX + "companyName").alias("p"), F.concat(F.lit("Firm "), F.sha2(F.col("id").cast("string"), 256)).alias("o"), F.lit("literal").alias("o_kind"), null.alias("o_dt"), null.alias("o_lang"))
    graph = dictionary.indexed(triples, group_bytes=16 << 10)
    for query, expected in (
        ("SELECT ?s ?n WHERE { ?s ex:companyName ?n FILTER(STRSTARTS(STR(?s), 'http://n.example/company/000123')) }", 100),
        ("SELECT ?s ?n WHERE { ?s ex:companyName ?n FILTER REGEX(?n, '^Firm 00a') }", None),
    ):
        found = graph.query(PREFIX + query)
        got = found.count()
        assert got == expected or expected is None and 0 < got < 40
        read = scanned(graph.query(PREFIX + query))
        triples_read = sum(v for k, v in read.items() if k.startswith("by_"))
        assert triples_read < n / 8, read
    assert graph.index.terms.count() == 2 * n + 1


def test_order_of_joins(spark):
    """A selective last pattern is joined first, and what it leaves is all that the other scans read."""
    n, null = 40_000, F.lit(None).cast("string")
    ids = spark.range(n)
    iri = lambda name, i: F.concat(F.lit(f"http://n.example/{name}"), F.format_string("%06d", i))
    triple = lambda s, p, o, kind: ids.select(s.alias("s"), F.lit(S.EX + p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), null.alias("o_dt"), null.alias("o_lang"))
    i = F.col("id")
    triples = triple(iri("c", i), "registeredAt", iri("court", i % 2000), "iri").unionByName(triple(iri("c", i), "companyName", F.concat(F.lit("Firm "), i), "literal"))
    triples = triples.unionByName(triple(iri("court", i % 2000), "courtName", F.concat(F.lit("Court "), i % 2000), "literal").distinct())
    triples = triples.unionByName(triple(iri("court", i % 2000), "lost", F.lit("true"), "literal").filter("s like '%court001234'").distinct())
    graph = dictionary.indexed(triples, group_bytes=16 << 10)
    query = PREFIX + "SELECT ?n ?k WHERE { ?c ex:companyName ?n ; ex:registeredAt ?court . ?court ex:courtName ?k . ?court ex:lost 'true' }"
    found = graph.query(query)
    assert sorted(tuple(r) for r in found.collect()) == sorted((f"Firm {x}", "Court 1234") for x in range(1234, n, 2000))
    read = scanned(found)
    whole = scanned(sparql.Graph(triples).query(query)) or {"": 2 * n}  # plain scans take every triple of each property
    assert read["by_subject"] + read["by_object"] < 12_000 < 2 * n, (read, whole)
    subjects, rows = graph.index.star([graph.index.ids([f"<{S.EX}{p}"])[f"<{S.EX}{p}"] for p in ("companyName", "registeredAt")])
    assert (subjects, rows) == (n, n)


def test_characteristic_sets(spark, monkeypatch):
    data = [(1, 10, 1), (1, 10, 2), (1, 11, 1), (2, 10, 1), (2, 11, 5), (3, 10, 1), (4, 12, 4)]
    sets = dictionary.characteristic_sets(spark.createDataFrame(data, "s long, p long, o long"))
    assert {(tuple(r["properties"]), r["subjects"], tuple(r["counts"])) for r in sets.collect()} == {((10, 11), 2, (3, 2)), ((10,), 1, (1,)), ((12,), 1, (1,))}
    graph = dictionary.indexed(spark.createDataFrame(rows(60), S.TRIPLE))
    p = list(graph.index.ids([f"<{S.EX}name", f"<{S.EX}year"]).values())
    few = graph.index.star(p)
    monkeypatch.setattr(dictionary, "FEW_SETS", 0)
    many = dictionary.TermIndex(spark, graph.index.folder).star(p)
    assert few[0] == many[0] and abs(few[1] - many[1]) < 1e-6 and few[0] == graph.triples.filter(F.col("p") == S.EX + "name").select("s").distinct().count()


def test_empty_graph(spark):
    graph = dictionary.indexed(spark.createDataFrame([], S.TRIPLE))
    assert graph.query("SELECT ?s ?t WHERE { ?s ?p ?o . ?t ql:contains-word 'a*' }").count() == 0
    assert graph.index.terms.count() == 0


def test_prefixes_of_filters():
    def of(text):
        q = sparql.parse("SELECT ?x WHERE { ?x ?p ?y FILTER(" + text + ") }")
        return dictionary.prefixes(next(e[1] for e in q.where if e[0] == "filter"))

    assert of("REGEX(?x, '^ab+c')") == {"x": "ab"} and of("REGEX(?x, '^ab?c')") == {"x": "a"} and of("REGEX(?x, '^a*')") == {}
    assert of("REGEX(?x, 'ab')") == {} and of("REGEX(?x, '^a|b')") == {} and of("REGEX(?x, '^a', 'i')") == {}
    assert of("STRSTARTS(STR(?x), 'u') && STRSTARTS(?y, 'v')") == {"x": "u", "y": "v"}
    assert of("STRSTARTS(STR(?x), 'u') || STRSTARTS(?y, 'v')") == {} and of("STRSTARTS(?x, ?y)") == {} and of("STRSTARTS(LCASE(?x), 'u')") == {}
