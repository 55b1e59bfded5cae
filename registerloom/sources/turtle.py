"""Turtle files read in parts: one file is split over many tasks, wherever its lines lie.

Spark's text reader splits files; what it gives is stored as chunks of lines. A chunk may begin inside a long string or
inside a statement. Each chunk is scanned once for every state it may begin in, the states are put together file by file from
a narrow table, and then each chunk's whole statements are a segment, while what lies between the last end of a statement and
the next one's, in the following chunks, is glued to a segment of its own. Prefixes reach segments from the directives before
them in their file.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..plans.storage import stored

#: Characters of a chunk.
CHUNK = 1 << 20
#: Rows of a side that is broadcast after its rows were counted.
BROADCAST_ROWS = 1_000_000
#: What may hide a full stop, the full stops that end statements, and directives.
_SCAN = re.compile(
    r"""(?<![\w:-])@?(?:prefix|PREFIX)\s+(?P<name>[^\s:<>"']*):\s*<(?P<iri>[^<>\s]*)>|(?<![\w:-])@?(?:base|BASE)\s*<(?P<base>[^<>\s]*)>
    |(?P<long>\"\"\"|''')|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|<[^<>"{}|^`\\\s]*>|\#[^\n]*|\\.|(?P<end>\.)(?=\s|\Z)""",
    re.X,
)
#: A text begins outside of strings, or in a long one of either kind, which ends so.
_CLOSE = {1: re.compile(r'(?:[^\\]|\\.)*?"""', re.S), 2: re.compile(r"(?:[^\\]|\\.)*?'''", re.S)}


def scan(text: str, state: int = 0) -> tuple[int, int, int, list[tuple[int, str | None, str]]]:
    """(state at the end, ends of the first and last statement or -1, directives: place, prefix or None for a base, IRI)."""
    at, first, last, found = 0, -1, -1, []
    if state:
        m = _CLOSE[state].match(text)
        if not m:
            return state, -1, -1, []
        at = m.end()
    while m := _SCAN.search(text, at):
        at = m.end()
        if m["long"]:
            kind = 1 if m["long"] == '"""' else 2
            close = _CLOSE[kind].match(text, at)
            if not close:
                return kind, first, last, found
            at = close.end()
        elif m["end"]:
            first, last = (at if first < 0 else first), at
        elif m["iri"] is not None or m["base"] is not None:
            found.append((m.start(), m["name"], m["iri"] if m["base"] is None else m["base"]))
    return 0, first, last, found


def _chunker(most: int):
    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, now, number = [], 0, None, 0

        def chunk() -> pd.DataFrame:
            return pd.DataFrame([(*now, number, "\n".join(held) + "\n")], columns=["path", "block", "chunk", "text"])

        for pdf in batches:
            for path, block, value in zip(pdf["path"], pdf["block"], pdf["value"]):
                if held and ((path, block) != now or size > most):
                    yield chunk()
                    number = number + 1 if (path, block) == now else 0
                    held, size = [], 0
                now = (path, block)
                held.append(value)
                size += len(value) + 1
        if held:
            yield chunk()

    return chunks


def _scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, block, chunk, text in zip(pdf["path"], pdf["block"], pdf["chunk"], pdf["text"]):
            quoted = ['"""' in text or "'''" in text] * 2  # else a long string goes on to the end of the chunk
            ends = [scan(text)[:3], *(scan(text, k)[:3] if q else (k, -1, -1) for k, q in zip((1, 2), quoted))]
            rows.append((path, block, chunk, *(x for e in ends for x in e)))
        yield pd.DataFrame(rows, columns=["path", "block", "chunk", *(f"{n}{k}" for k in range(3) for n in ("state", "first", "last"))])


_SCANNED = "path string, block long, chunk long, " + ", ".join(f"state{k} int, first{k} long, last{k} long" for k in range(3))
_PLACED = "path string, block long, chunk long, n long, first long, last long, owner long"


def _placed(pdf: pd.DataFrame) -> pd.DataFrame:
    """Chunks of one file, in order, with what each begins in: n, first, last, and owner, the chunk whose last statement goes on
    at this one's beginning (-1: none, the file begins)."""
    state, owner, rows = 0, -1, []
    for n, r in enumerate(pdf.sort_values(["block", "chunk"]).to_dict("records")):
        first, last = r[f"first{state}"], r[f"last{state}"]
        rows.append((r["path"], r["block"], r["chunk"], n, first, last, owner))
        state = r[f"state{state}"]
        if last >= 0:
            owner = n
    return pd.DataFrame(rows, columns=["path", "block", "chunk", "n", "first", "last", "owner"])


def segments(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """path, n, glued, text: whole statements of files, in order of n and, where equal, glued; stored."""
    reader = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n")
    lines = reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    chunks = stored(lines.mapInPandas(_chunker(chunk), "path string, block long, chunk long, text string"))
    placed = stored(chunks.mapInPandas(_scanned, _SCANNED).groupBy("path").applyInPandas(_placed, _PLACED))
    placed = F.broadcast(placed) if placed.count() <= BROADCAST_ROWS else placed
    rows = chunks.join(placed, ["path", "block", "chunk"])
    ends = F.col("last") >= 0
    part = lambda a, n: F.substring(F.col("text"), (a + 1).cast("int"), n.cast("int"))
    whole = rows.filter("last > first").select("path", "n", F.lit(0).alias("glued"), part(F.col("first"), F.col("last") - F.col("first")).alias("text"))
    head = rows.select("path", F.col("owner").alias("n"), F.col("n").alias("at"), F.when(ends, part(F.lit(0), F.col("first"))).otherwise(F.col("text")).alias("text"))
    tail = rows.filter(ends).select("path", "n", F.col("n").alias("at"), part(F.col("last"), F.length("text")).alias("text"))
    pieces = head.unionByName(tail).groupBy("path", "n").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("pieces"))
    glued = pieces.select("path", "n", F.lit(1).alias("glued"), F.array_join(F.col("pieces.text"), "").alias("text"))
    return stored(whole.unionByName(glued.filter(F.regexp_like("text", F.lit(r"\S")))))


def _directives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(path, n, glued, *d) for path, n, glued, text in zip(pdf["path"], pdf["n"], pdf["glued"], pdf["text"]) for d in scan(text)[3]]
        yield pd.DataFrame(rows, columns=["path", "n", "glued", "at", "name", "iri"])


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from .files import Turtle

    for pdf in batches:
        for path, n, glued, text, directives in zip(pdf["path"], pdf["n"], pdf["glued"], pdf["text"], pdf["directives"]):
            own = hashlib.md5(path.encode()).hexdigest()[:16]
            prefixes, base = {}, ""
            for d in directives if directives is not None else ():
                if (d["n"], d["glued"]) < (n, glued):
                    if d["name"] is None:
                        base = d["iri"]
                    else:
                        prefixes[d["name"]] = d["iri"]
            # blank nodes of different files are different; those without a name are numbered within their segment
            rows = Turtle(text, prefixes, base, f"{own}-{n}-{glued}-", f"{own}.").document()
            yield pd.DataFrame(rows, columns=S.TRIPLE.names, dtype=object)


def read(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """Triples of Turtle files, each split over tasks as its size asks for. Blank nodes are IRIs that start with _:; a name
    stands for one node within its file. A text that is no Turtle is an error; empty files have no triples."""
    rows = segments(spark, path, chunk)
    found = stored(rows.mapInPandas(_directives, "path string, n long, glued int, at long, name string, iri string"))
    lists = found.groupBy(F.col("path").alias("d_path")).agg(F.array_sort(F.collect_list(F.struct("n", "glued", "at", "name", "iri"))).alias("directives"))
    lists = F.broadcast(lists) if found.count() <= BROADCAST_ROWS else lists
    return rows.join(lists, F.col("path") == F.col("d_path"), "left").drop("d_path").mapInPandas(_parsed, S.TRIPLE).distinct()
