from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from registerloom.functions import text as X


def values(spark, expression, inputs):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, c string")
    return [r[0] for r in rows.select(expression.alias("x"), "i").orderBy("i").select("x").collect()]


def test_normalize(spark):
    pairs = {
        "MÃ¼nchen": "Muenchen", "GeÅ¿ellÅ¿chaft": "Gesellschaft", "GeÅ¿ellÅ¿chaft – Köln": "Gessellsschaft – Koeln", "Ã ber": "àber", "A â€“ B": "A - B",
        "Aktiengeſellſchaft": "Aktiengesellschaft", "Juſtizminiſter": "Justizminister", "München": "Muenchen", " a  b\t": "a b", "x~`^¨´y": "xy", "": "",
    }
    assert values(spark, X.normalize_text("c"), [*pairs, None]) == [*pairs.values(), None]


def test_clean_uri(spark):
    assert values(spark, X.clean_uri("c"), [" Köln & Söhne ", "A & B", "A  B", "...", "", None]) == ["Koeln__Soehne", "A__B", "A__B", "", "unknown", "unknown"]


def test_years(spark):
    names = ["856399094_1871_068_11.txt", "x_1799.txt", "a_1920_1945.txt", "none"]
    assert values(spark, X.last_year("c"), names) == [1871, None, 1945, None]
    value, is_year = X.year_value("c")
    inputs = ["1927", " 1927. ", "um 1927", "unbekannt", "?", "", None, "99999", "0", "9998", "123456789012"]
    assert values(spark, value, inputs) == ["1927", "1927", "um 1927", None, None, None, None, "99999", "0", "9998", "123456789012"]
    assert values(spark, is_year, inputs) == [True, True, False, False, False, False, False, False, False, True, False]


def test_dates_and_slugs(spark):
    assert values(spark, X.iso_date("c"), ["1.2.2020", "01.12.2020", "2020-01-01", "1.2", None]) == ["2020-02-01", "2020-12-01", None, None, None]
    assert values(spark, X.version_of("c"), ["codes_03.xlsx", "codes.xlsx"]) == [3, None]
    assert values(spark, X.court_slug("c"), ["Köln (Süd)", "Übersee"]) == ["Koeln_Sued", "Übersee"]
    assert values(spark, X.register_types("c"), ["HRA, Güte-Reg.", None]) == [["HRA", "Guete_Reg"], None]


def test_answers(spark):
    answer = 'Sure:\n```json\n[{"a": 1}, {"b": {"c": 2}}]\n``` ok'
    assert values(spark, X.json_objects("c"), [answer]) == [['{"a": 1}', '{"b": {"c": 2}']]
    assert values(spark, X.strip_code_fence("c"), ['```json\n{"a": 1}\n```', " none "]) == ['{"a": 1}', "none"]
    assert values(spark, X.answer_text("c", "openai"), ['{"choices": [{"message": {"content": "hi"}}]}']) == ["hi"]


def test_imprint(spark):
    texts = ["IMPRESSUM Amtsgericht Essen HRB 1", "Registered Office", "hrb 12", None]
    assert values(spark, X.imprint_score("c"), texts) == [3, 1, 0, 0]
    long = "x" * 600 + "Handelsregister" + "y" * 600
    start, matched, context = values(spark, X.keyword_context("c"), [long])[0]
    assert (start, matched, context) == (600, "Handelsregister", "x" * 500 + "Handelsregister" + "y" * 500)
    assert values(spark, X.keyword_context("c"), ["none", None]) == [None, None]


def test_urls(spark):
    assert values(spark, X.company_key("c"), ["Müller & Söhne GmbH", "A-B AG"]) == ["müller söhne", "a-b"]
    found = values(spark, X.url_variations("c"), ["Alpha Beta GmbH", "Solo AG"])
    assert len(found[0]) == 4 * 8 and "https://www.ab.de" in found[0] and "http://alpha-beta.com" in found[0]
    assert len(found[1]) == 8


def test_labels(spark):
    iris = ["http://e.org/a#My_Name", "http://e.org/court/AG_Essen", "http://e.org/court/AG_Essen/"]
    assert values(spark, X.clean_label("c"), iris) == ["My Name", "AG Essen", "AG Essen"]
    assert values(spark, X.node_color("c"), ["Company", "Thing, Court", "Thing"]) == ["#4CAF50", "#2196F3", "#9E9E9E"]


def test_matches(spark):
    rows = spark.createDataFrame([("Amtsgericht Essen", "essen"), ("", ""), (None, "x"), (" HRB 1", "hrb 1 ")], "a string, b string")
    got = rows.select(X.contains_match("a", "b"), X.equal_match("a", "b"), X.clean_string("a")).collect()
    assert [tuple(r) for r in got] == [(1, 0, "amtsgerichtessen"), (0, 0, ""), (0, 0, ""), (0, 1, "hrb1")]


@settings(max_examples=20, deadline=None)
@given(texts=st.lists(st.text(alphabet="ab \n\t ", max_size=40), min_size=1, max_size=5), size=st.integers(1, 4))
def test_chunks_hold_all_words(spark, texts, size):
    whole = values(spark, X.chunk_words("c", size, 3), texts)
    assert [" ".join(c) for c in whole] == [" ".join(t.split()) for t in texts]


def test_sliding_chunks(spark):
    assert values(spark, X.chunk_words("c", 3, 1, "sliding"), ["a b c d e", "a", ""]) == [["a b c", "c d e"], ["a"], []]


def test_normalize_is_total(spark):
    odd = ["".join(map(chr, range(a, a + 64))) for a in range(0, 0x300, 64)]
    out = values(spark, F.coalesce(X.normalize_text("c"), F.lit("?")), odd)
    assert all("  " not in o for o in out)
