import json
import threading
import time
import zipfile

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from registerloom import queries
from registerloom import schemas as S
from registerloom.operators import extraction, imprint, matching
from registerloom.sources import files
from registerloom.streaming import ingest

RECORD = {"Court_name": "AG", "Date_of_article": None, "Company_name": "X", "Registration_Code": None, "Registration_year": "1920"}


def test_json_files_are_all_or_nothing(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "good.json").write_text(json.dumps([RECORD, {**RECORD, "Company_name": None}]))
    (tmp_path / "sub" / "more.JSON").write_text(json.dumps([RECORD]))
    (tmp_path / "object.json").write_text(json.dumps(RECORD))
    (tmp_path / "mixed.json").write_text(json.dumps([RECORD, 3]))
    (tmp_path / "broken.json").write_text('[{"Court_name": "AG"')
    rows = files.json_records(spark, str(tmp_path))
    assert sorted(r["fileName"] for r in rows.collect()) == ["good.json", "good.json", "more.JSON"]
    assert files.merged_objects(spark, str(tmp_path)).count() == 5


def test_lists_and_logs(spark, tmp_path):
    (tmp_path / "names.txt").write_text("# c\n Alpha \n\nBeta")
    assert [r[0] for r in files.companies(spark, str(tmp_path / "names.txt"), []).collect()] == ["Alpha", "Beta"]
    assert [r[0] for r in files.companies(spark, str(tmp_path / "missing.txt"), ["Z"]).collect()] == ["Z"]
    (tmp_path / "log.csv").write_text('File,Mode,Chunks,Time (s),Outcome\na.txt,parallel,3,5.5,✅ success\nb.txt,parallel,-,1.5,"❌ failed chunks [1, 2]"\n\nTotal runtime (s):,7.0\n')
    rows, total = files.run_log(spark, str(tmp_path / "log.csv"))
    assert [(r["Chunks"], r["Outcome"]) for r in rows.collect()] == [(3, "✅ success"), (None, "❌ failed chunks [1, 2]")]
    assert [r["seconds"] for r in total.collect()] == [7.0]
    summary = extraction.log_summary(rows).first()
    assert (summary["files"], summary["chunks"], summary["succeeded"], summary["failed"]) == (2, 3, 1, 1)


def sheet(path, rows):
    cell = lambda c, r, v: f'<c r="{c}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if v is not None else ""
    body = "".join(f'<row r="{i}">' + "".join(cell("ABCDEFGH"[j], i, v) for j, v in enumerate(row)) + "</row>" for i, row in enumerate(rows, 1) if row)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')


def test_spreadsheets(spark, tmp_path):
    head = ["n", *S.REGISTRY_COLUMNS]
    sheet(tmp_path / "codes_02.xlsx", [["t"], [], [], [], [], [], [], head, ["1", "X1", "Köln", "HRA", "NRW", None, "1.2.2020", None]])
    rows = files.registry_sheets(spark, str(tmp_path)).collect()
    assert [(r["XJustizID"], r["PLZ"], r["ValidUntil"], r["Version"], r["row"]) for r in rows] == [("X1", None, "1.2.2020", 2, 0)]
    sheet(tmp_path / "codes.xlsx", [head])
    with pytest.raises(Exception, match="no version"):
        files.registry_sheets(spark, str(tmp_path)).collect()


LITERAL = st.text(alphabet='ab"\\\n\t\r ü', max_size=8)


@settings(max_examples=8, deadline=None)
@given(values=st.lists(LITERAL, min_size=1, max_size=4, unique=True))
def test_graph_files_round_trip(spark, tmp_path_factory, values):
    path = str(tmp_path_factory.mktemp("g"))
    rows = [("http://e/s", "http://e/p", v, "literal", None, None) for v in values] + [("http://e/s", "http://e/p", "http://e/o", "iri", None, None), ("http://e/s", "http://e/y", "1927", "literal", S.XSD + "gYear", None), ("http://e/t", "http://e/l", "Köln", "literal", None, "de")]
    triples = spark.createDataFrame(rows, S.TRIPLE)
    files.write_ntriples(triples, path + "/nt")
    files.write_turtle(triples, path + "/ttl")
    want = sorted(map(repr, triples.distinct().collect()))
    assert sorted(map(repr, files.ntriples(spark, path + "/nt").collect())) == want
    assert sorted(map(repr, files.turtle(spark, path + "/ttl").collect())) == want


def test_turtle_syntax():
    text = """@prefix ex: <http://e/> . # note
    ex:a a ex:C ; ex:p "x"@en, 'y', 12, 1.5, true ;
      ex:q "1"^^<http://www.w3.org/2001/XMLSchema#string> .
    <http://e/b> ex:p ex:a."""
    got = files.parse_turtle(text)
    assert len(got) == 8 and got[0] == ("http://e/a", S.A, "http://e/C", "iri", None, None) and ("http://e/a", "http://e/q", "1", "literal", None, None) in got


def test_index_layout(spark, tmp_path):
    triples = spark.createDataFrame([(f"http://e/{i}", f"http://e/p{i % 3}", "x", "literal", None, None) for i in range(30)], S.TRIPLE)
    files.write_index(triples, str(tmp_path / "i"), 5)
    back = spark.read.parquet(str(tmp_path / "i"))
    assert back.count() == 30 and "PartitionFilters: [isnotnull(p" in back.filter("p = 'http://e/p1'")._jdf.queryExecution().executedPlan().toString()


def test_extraction(spark):
    texts = spark.createDataFrame([("a", "one two three four five"), ("b", "bad words"), ("c", "  "), ("d", None), ("e", "nothing here"), ("f", "broken x")], "file string, text string")

    def make():
        def ask(chunk):
            if "bad" in chunk or chunk == "five":
                raise OSError
            if "broken" in chunk:
                return "{not json}"
            return "" if not chunk else "none" if "nothing" in chunk else 'x {"Court_name": "AG", "Company_name": "' + chunk + '"} y'

        return ask

    options = extraction.Options(max_words=2, backoff=0.0, concurrent=2)
    done = extraction.files(texts, extraction.answers(extraction.chunks(texts, options), make, options), options)
    got = {r["file"]: (r["status"], len(r["records"] or []), r["failed"]) for r in done.collect()}
    assert got == {
        "a": ("partial success (missing chunks [3])", 2, [3]), "b": ("no data extracted", 0, [1]), "c": ("empty file", 0, []), "d": ("file not found", 0, []),
        "e": ("no data extracted", 0, []), "f": ("parse failed", 0, []),
    }
    strict = extraction.files(texts, extraction.answers(extraction.chunks(texts, options), make, options), extraction.Options(max_words=2, strict=True))
    assert {r["file"]: r["status"] for r in strict.collect()}["a"] == "failed chunks [3]"


def test_a_call_without_a_thread_is_no_failed_attempt(spark):
    texts = spark.createDataFrame([("a", "one")], "file string, text string").coalesce(1)

    def make():
        start = threading.Thread.start

        def short(thread):  # in this worker, which the failing task ends
            if threading.current_thread() is not threading.main_thread():
                raise RuntimeError("no thread to be had")
            start(thread)

        threading.Thread.start = short
        return lambda chunk: chunk

    with pytest.raises(Exception, match="no thread to be had"):
        extraction.answers(extraction.chunks(texts), make, extraction.Options(backoff=0.0)).collect()

    def exhausted():
        def ask(chunk):
            raise MemoryError("no memory to be had")

        return ask

    for timeout in (0.0, 9.0):
        with pytest.raises(Exception, match="no memory to be had"):
            extraction.answers(extraction.chunks(texts), exhausted, extraction.Options(backoff=0.0, timeout=timeout)).collect()


def test_calls_that_hang_hold_up_no_others(spark):
    texts = spark.createDataFrame([(str(i), "hangs" if i < 6 else "well") for i in range(9)], "file string, text string").coalesce(1)

    def make():
        def ask(chunk):
            time.sleep(5.0 if chunk == "hangs" else 0.0)
            return chunk

        return ask

    options = extraction.Options(concurrent=2, attempts=1, timeout=0.5)
    assert [r["answer"] for r in extraction.answers(extraction.chunks(texts), make, options).collect()] == [None] * 6 + ["well"] * 3


def test_each_row_of_documents_is_a_file(spark, tmp_path):
    rows = [(1, "one two"), (2, ""), (3, " \u2028\n"), (4, None), (5, "a b"), (5, "w " * 501), (6, "same"), (6, "same"), (None, "x"), (None, "y"), (7, "w " * 1000), (7, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.QUERIES["extract_chunks_to_records"](spark, str(tmp_path)).collect()]
    counts = [1, 0, 0, None, 1, 2, 1, 1, 1, 1, 2, 0]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(((None if i is None else str(i), "success", n) for (i, _), n in zip(rows, counts)), key=key)


def records(spark, rows):
    return spark.createDataFrame([("p", i, *r) for i, r in enumerate(rows)], "doc string, row long, Court_name string, Date_of_article string, Company_name string, Registration_Code string, Registration_year string")


def test_scores(spark):
    truth = records(spark, [("AG Essen", "1. Mai", "Alpha", None, "1927"), ("AG Ulm", None, "Beta", "HRB 1", "1927")])
    same = matching.summary(matching.match_records(truth, truth, "fuzzy")).first()
    assert (same["score"], same["ideal"], same["matched"]) == (18.0, 18, 2)
    same = matching.summary(matching.match_records(truth, truth, "containment")).first()
    assert (same["score"], same["code_mismatches"]) == (7 + 8, 0)  # two nulls score nothing here
    none = matching.match_records(truth, records(spark, [("zzz", None, "qqq", None, None)]), "fuzzy").collect()
    assert [r["parsed_row"] for r in sorted(none, key=lambda r: r["truth_row"])] == [None, None]
    lost = matching.summary(matching.match_records(truth, records(spark, [("zzz", None, "qqq", None, None)]), "containment")).first()
    assert (lost["matched"], lost["code_mismatches"]) == (0, 1)
    assert 0.0 <= matching.similarity("abc", "abd") <= 1.0 and matching.similarity(None, "") == 1.0


def test_imprint(spark):
    pages = spark.createDataFrame([("http://e.de/x/", '<a href="../Impressum">i</a><a class=b href="http://o.de/about">o</a><a href="z">z</a>')], "url string, html string")
    assert {r["link"] for r in imprint.imprint_links(pages).collect()} == {"http://e.de/Impressum", "http://o.de/about"}
    tried = spark.createDataFrame([("A", 0, "u0", 404), ("A", 1, "u1", 301), ("A", 2, "u2", 200)], "company string, pos int, url string, status int")
    assert [tuple(r) for r in imprint.homepage(tried).collect()] == [("A", "u1")]
    html = spark.createDataFrame([("<p>Amts<b>gericht</b></p><script>x</script> HRB&nbsp;",)], "h string")
    assert html.select(imprint.visible_text(F.col("h"))).first()[0] == "Amts gericht HRB&nbsp;"


def test_links_of_an_address_are_distinct(spark):
    pages = spark.createDataFrame([("http://e.de/", '<a href="/a">a</a><a href="/about">b</a>'), ("http://e.de/", '<a href="/about">b</a>'), ("http://o.de/", None)], "url string, html string")
    assert sorted(tuple(r) for r in imprint.distinct_links(pages).collect()) == [("http://e.de/", "http://e.de/a"), ("http://e.de/", "http://e.de/about")]
    assert [tuple(r) for r in imprint.imprint_links(pages).collect()] == [("http://e.de/", "http://e.de/about")]


def test_files_are_taken_up_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one")

    def go():
        ingest.take_up(ingest.new_texts(spark, str(tmp_path / "in")), lambda df: df.select("file", "text"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()

    go()
    (tmp_path / "in" / "b.txt").write_text("two")
    go()
    go()
    assert sorted(r["file"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a.txt", "b.txt"]


def test_turtle_blank_nodes_and_collections():
    t = files.parse_turtle('@prefix e: <http://e/> . e:a e:p [ e:q "x" ; e:r ( 1 _:b ) ] , [] . [ e:s e:t ] . _:b e:u () .')
    by = {p.rsplit("/", 1)[-1].rsplit("#", 1)[-1] for _, p, *_ in t}
    assert by == {"p", "q", "r", "s", "u", "first", "rest"} and len(t) == 10
    assert ("_:b", "http://e/u", S.RDF + "nil", "iri", None, None) in t
    with pytest.raises(ValueError, match="not Turtle"):
        files.parse_turtle("<http://e/a> <http://e/p> [ <http://e/q> 1 .")


def test_ntriples_escapes_and_errors(spark, tmp_path):
    (tmp_path / "a.nt").write_text('# note\n\n<http://e/s> <http://e/p> "K\\u00f6ln \\U0001F389 \\\\n \\t" . # end\n_:a <http://e/p> _:b .\n')
    rows = {(r["s"], r["o"], r["o_kind"]) for r in files.ntriples(spark, str(tmp_path)).collect()}
    assert rows == {("http://e/s", "Köln 🎉 \\n \t", "literal"), ("_:a", "_:b", "iri")}
    (tmp_path / "b.nt").write_text("<http://e/s> <http://e/p> .\n")
    assert files.ntriples(spark, str(tmp_path), strict=False).count() == 2
    with pytest.raises(Exception, match="not N-Triples"):
        files.ntriples(spark, str(tmp_path)).collect()


def test_whole_texts_are_streamed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a b.txt").write_text("one\ntwo")
    ingest.take_up(ingest.new_texts(spark, str(tmp_path / "in")), lambda df: df.select("text"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["one\ntwo"]
    assert [r["file"] for r in files.texts(spark, str(tmp_path / "in")).collect()] == ["a b.txt"]


def test_best_matches_of_a_large_page_take_few_comparisons(monkeypatch):
    tried = []
    monkeypatch.setattr(matching, "ratio", lambda a, b, of=matching.ratio: tried.append(a) or of(a, b))
    rows = [{**RECORD, "row": i, "Company_name": f"Customer#{i * 40:09d}"} for i in range(2000)]
    other = [{**r, "Company_name": r["Company_name"].lower() if r["row"] % 3 == 0 else r["Company_name"] + " AG"} for r in rows]
    began = time.process_time()
    assert [r[1] for r in matching._assign(rows, other, True)] == list(range(2000))
    assert len(tried) < 60 * len(rows) and time.process_time() - began < 15  # 18 million pairs of letters took a minute


def test_best_containing_match_of_a_large_page():
    rows = [{**RECORD, "row": i, "Company_name": f"Customer#{i * 40:09d}", "Registration_Code": f"HRB {i}"} for i in range(3000)]
    other = [{**r, "Company_name": r["Company_name"].lower() if r["row"] % 3 == 0 else r["Company_name"] + " AG"} for r in rows]
    began = time.process_time()
    assert [r[1] for r in matching._assign(rows, other, False)] == list(range(3000))
    assert time.process_time() - began < 8  # 4.5 million pairs took 20 s


@pytest.mark.parametrize("letters", ["ab", "aAbB \0ßİ "])
def test_best_containing_match_is_that_of_all_pairs(letters):
    import random

    rng = random.Random(4)
    word = lambda: rng.choice([None, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 6)))])
    for _ in range(60):
        rows, other = ([{"row": i, **{n: word() for n in matching.WEIGHTS}} for i in range(rng.randrange(0, 12))] for _ in "tp")
        used, want = set(), []
        for t in rows:
            scores = [(matching._fields(t, p, False), -i) for i, p in enumerate(other) if i not in used]
            score, i = max(scores, default=(0.0, 0))
            want.append(-i if score > 0 else None)
            used |= {-i} if score > 0 else set()
        assert [r[1] for r in matching._assign(rows, other, False)] == want


def test_pages_of_a_batch_are_matched_one_by_one():
    pages = pa.RecordBatch.from_pylist([{"doc": str(d), "truth": [{**RECORD, "row": i} for i in range(3)], "parsed": [{**RECORD, "row": 7}] if d % 2 else None} for d in range(4000)])
    batches = list(matching._matched(iter([pages]), True))
    assert max(b.num_rows for b in batches) <= matching.ROWS_OUT + 3  # one batch of 12,000 rows before
    rows = [r for b in batches for r in b.to_pylist()]
    assert [(r["doc"], r["truth_row"]) for r in rows] == [(str(d), i) for d in range(4000) for i in range(3)]
    assert {r["parsed_row"] for r in rows if int(r["doc"]) % 2 == 0} == {None} and sum(r["parsed_row"] == 7 for r in rows) == 2000


def test_best_match_is_that_of_all_pairs():
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc-. ") for _ in range(rng.randrange(0, 9)))
    for _ in range(40):
        rows = [{"row": i, **{n: rng.choice([word(), None]) for n in matching.WEIGHTS}} for i in range(rng.randrange(1, 9))]
        other = [{"row": i, **{n: rng.choice([word(), None]) for n in matching.WEIGHTS}} for i in range(rng.randrange(0, 9))]
        got = [r[1] for r in matching._assign(rows, other, True)]
        used, want = set(), []
        for t in rows:
            scores = [(matching.similarity(t["Court_name"], p["Court_name"]) + matching.similarity(t["Company_name"], p["Company_name"]), -i) for i, p in enumerate(other) if i not in used]
            score, i = max(scores, default=(0.0, 0))
            want.append(-i if score >= 0.5 else None)
            used |= {-i} if score >= 0.5 else set()
        assert got == want


def test_repeated_texts_of_a_page_are_compared_once(monkeypatch):
    asked = []
    monkeypatch.setattr(matching.Likeness, "most", lambda self, a, of=matching.Likeness.most: asked.append(a) or of(self, a))
    rows = [{**RECORD, "row": i, "Company_name": f"Customer#{i % 20:09d}"} for i in range(12_000)]
    other = [{**r, "Company_name": r["Company_name"] + " AG"} for r in rows]
    assert [r[1] for r in matching._assign(rows, other, True)] == list(range(12_000))
    assert len(asked) == 40  # 24,000, each of all records, before


@pytest.mark.parametrize("letters", ["a", "ab", "abc-. "])
def test_best_match_of_repeated_texts_is_that_of_all_pairs(letters):
    import random

    rng = random.Random(5)
    for _ in range(40):
        words = [None, *("".join(rng.choice(letters) for _ in range(rng.randrange(0, 6))) for _ in range(3))]
        rows, other = ([{"row": i, **{n: rng.choice(words) for n in matching.WEIGHTS}} for i in range(rng.randrange(0, 25))] for _ in "tp")
        used, want = set(), []
        for t in rows:
            scores = [(matching.similarity(t["Court_name"], p["Court_name"]) + matching.similarity(t["Company_name"], p["Company_name"]), -i) for i, p in enumerate(other) if i not in used]
            score, i = max(scores, default=(0.0, 0))
            want.append(-i if score >= 0.5 else None)
            used |= {-i} if score >= 0.5 else set()
        assert [r[1] for r in matching._assign(rows, other, True)] == want


def test_containing_match_of_a_very_large_page_asks_few_records():
    rows = [{**RECORD, "row": i, "Company_name": f"Customer#{i * 40:09d}", "Registration_Code": f"HRB {i}"} for i in range(30_000)]
    other = [{**r, "Company_name": r["Company_name"].lower() if r["row"] % 3 == 0 else r["Company_name"] + " AG"} for r in rows]
    began = time.process_time()
    assert [r[1] for r in matching._assign(rows, other, False)] == list(range(30_000))
    assert time.process_time() - began < 15  # each record searched all texts before


def test_names_of_the_same_letters_have_one_bound(monkeypatch):
    made = []
    monkeypatch.setattr(matching.Likeness, "most", lambda self, a, of=matching.Likeness.most: made.append(of(self, a)) or made[-1])
    rows = [{**RECORD, "row": i, "Company_name": f"Customer#{i * 40:09d}"} for i in range(6000)]
    other = [{**r, "Company_name": r["Company_name"] + " AG"} for r in rows]
    assert [r[1] for r in matching._assign(rows, other, True)] == list(range(6000))
    assert max(map(len, made)) < 1500  # 6,000, a bound of each name, before


def test_best_match_of_texts_of_the_same_letters_is_that_of_all_pairs():
    import random
    from difflib import SequenceMatcher

    rng = random.Random(6)
    alike = lambda a, b: SequenceMatcher(None, matching.squeezed(a), matching.squeezed(b)).ratio()
    for _ in range(40):
        words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(3)]
        words += ["".join(rng.sample(w, len(w))) for w in words for _ in range(4)]
        rows, other = ([{"row": i, **{n: rng.choice(words) for n in matching.WEIGHTS}} for i in range(rng.randrange(0, 25))] for _ in "tp")
        used, want = set(), []
        for t in rows:
            scores = [(alike(t["Court_name"], p["Court_name"]) + alike(t["Company_name"], p["Company_name"]), -i) for i, p in enumerate(other) if i not in used]
            score, i = max(scores, default=(0.0, 0))
            want.append(-i if score >= 0.5 else None)
            used |= {-i} if score >= 0.5 else set()
        assert [r[1] for r in matching._assign(rows, other, True)] == want
    for a, b in (("ab", "xaby"), ("xaby", "ab"), ("", "a"), ("ab" * 50, "ab" * 99), ("ab" * 50, "ab" * 100), ("ab" * 100, "ab" * 50)):
        assert matching.ratio(a, b) == SequenceMatcher(None, a, b).ratio()


def test_containing_match_of_a_large_page_whose_names_lie_in_each_other():
    rows = [{**RECORD, "row": i, "Company_name": "GmbH" if i % 2 else f"Firma {i:09d} GmbH", "Registration_Code": None} for i in range(12_000)]
    began = time.process_time()
    assert [r[1] for r in matching._assign(rows, rows, False)] == list(range(12_000))
    assert time.process_time() - began < 10  # each "GmbH" went through all records before


@pytest.mark.parametrize("held", [1, 10**6])
def test_containing_match_of_frequent_texts_is_that_of_all_pairs(monkeypatch, held):
    import random

    monkeypatch.setattr(matching, "MANY", 8, raising=False)
    monkeypatch.setattr(matching, "HELD", held, raising=False)
    rng = random.Random(7)
    word = lambda k: "".join(rng.choice("ab") for _ in range(rng.randrange(1, k)))
    for often in ((2, 4), (0, 2), (2, 3)):
        few = [*(word(4) for _ in range(3)), None]
        fields = [(lambda: rng.choice(few) if rng.random() < 0.5 else word(12)) if i in often else (lambda: rng.choice(few)) for i in range(5)]
        rows, other = ([{"row": i, **{n: f() for n, f in zip(matching.WEIGHTS, fields)}} for i in range(n)] for n in (60, 350))
        used, want = set(), []
        for t in rows:
            score, i = max((matching._fields(t, p, False), -i) for i, p in enumerate(other) if i not in used)
            want.append(-i if score > 0 else None)
            used |= {-i} if score > 0 else set()
        assert [r[1] for r in matching._assign(rows, other, False)] == want
