"""Turtle files in parts give what one reader of the whole text gives."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from registerloom.sources import files, turtle

HEAD = '@prefix ex: <http://e.example/> .\nPREFIX o: <http://o.example/>\n@base <http://b.example/> .\n'
PIECES = (
    "ex:a{i} ex:p <r{i}> ; o:q \"x . y\" , 'it''s'@de .\n", "ex:b{i}\n    a ex:C\n.\n", '_:n{k} ex:p """long . text\n# no comment .\nex:z ex:z ex:z .\n\'\'\' {i}""" .\n',
    "ex:c{i} ex:p '''other\n\"\"\" .\n{i}''' .\n", "# a comment . \"\"\" with quotes\n", "ex:d{i} ex:list (1 2.5 -3e0 true) ; ex:e.f [ ex:g _:n{k} ; ex:h ( ) ] .\n",
    "<http://x/{i}#a.b> ex:p \"\\\"esc . \\\\\" . ex:two ex:on {i} .\n", "@prefix o: <http://o{i}.example/> .\n", "\n\n", "[] ex:p _:n{k} .\n", "ex:l{i} ex:p \"tab\\t\" ,\n\n\n  o:x ;\n ex:q .5 . \n",
)


def text(n, seed):
    rng = random.Random(seed)
    return HEAD + "".join(rng.choice(PIECES).format(i=i, k=i % 7).replace("'it''s'", "'its'") for i in range(n))


def alike(rows):
    """Triples with unnamed blank nodes as one: how often each shape occurs."""
    plain = lambda v: re.sub(r"^_:(?:[0-9a-f]{16}\.)?(n\d+)$", r"_:\1", v) if re.match(r"_:(?:[0-9a-f]{16}\.)?n\d+$", v) else re.sub(r"^_:.*", "_:", v)
    return Counter((plain(s), p, plain(o) if kind == "iri" else o, kind, dt, lang) for s, p, o, kind, dt, lang in rows)


@pytest.mark.parametrize("chunk,split", [(40, 700), (1, 300), (300, 1 << 20)])
def test_parts_equal_the_whole(spark, tmp_path, chunk, split):
    source = {f"f{i}.ttl": text(120, i) for i in range(3)} | {"empty.ttl": "", "end.ttl": HEAD + "ex:a ex:b ex:c ."}
    for name, value in source.items():
        (tmp_path / name).write_text(value, encoding="utf-8")
    want = sum((alike(set(files.parse_turtle(v))) for v in source.values()), Counter())
    conf = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = spark.read.text(f"file://{tmp_path}").select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
        assert split > 10_000 or rows.select("path", "block").distinct().count() > 20
        got = alike([tuple(r) for r in turtle.read(spark, f"file://{tmp_path}", chunk).collect()])
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert got.keys() == want.keys()
    unnamed = lambda c: sum(v for k, v in c.items() if "_:" in (k[0], k[2]))
    assert unnamed(got) == unnamed(want)


def test_a_large_file_is_many_tasks(spark, tmp_path):
    (tmp_path / "large.ttl").write_text(HEAD + "".join(f'ex:s{i} ex:p "value {i} . \\"quoted\\"" ;\n  ex:q ex:o{i % 100} .\n' for i in range(60_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(256 << 10))
    try:
        parts = turtle.segments(spark, f"file://{tmp_path}")
        assert parts.filter("glued = 0").count() >= 12 and parts.select("path").distinct().count() == 1
        found = files.turtle(spark, f"file://{tmp_path}")
        assert found.count() == 120_000 and found.filter("o = 'value 59999 . \"quoted\"'").count() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_scan_states():
    assert turtle.scan('a b """x .\n') == (1, -1, -1, []) and turtle.scan('y . """ . z', 1)[:3] == (0, 9, 9) and turtle.scan("no end", 2)[:3] == (2, -1, -1)
    assert turtle.scan("a <b.c> 1.5 , x.y . # .\n") == (0, 19, 19, [])
    with pytest.raises(ValueError):
        files.parse_turtle("a b")
