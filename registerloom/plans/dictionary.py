"""Graphs as numbers: an order-keeping dictionary of terms, triples of their numbers, and an inverted index of literals.

Terms are numbered in their order as bytes, so what begins with the same text is an interval of numbers: all literals come
before all IRIs, and a prefix of either selects rows by two bounds that Parquet's statistics can tell. Everything lies in
sorted files: terms by number, triples by property and then by subject or by object, postings by word and literal.
"""

from __future__ import annotations

import json
import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sparql
from .sparql import CONTAINS_ENTITY, CONTAINS_WORD, Expr, Graph, Iri, Literal, Path, Rel, SparqlError, Var, constant, encode
from .storage import fresh, stored

#: Bytes of a row group of the index's files: what a pruned read skips or takes as a whole.
GROUP_BYTES = 16 << 20
#: Rows of a side that is broadcast after its rows were counted.
BROADCAST_ROWS = 1_000_000
#: Sets of properties that are kept on the driver, and values that one part of a query hands on to the scans of the next.
FEW_SETS, HANDED = 10_000, 1_000
#: What words are made of, in lower case.
NOT_WORD = r"[^\p{L}\p{N}]+"
#: The greatest character: a text with a prefix is less than the prefix and this.
LAST = "\U0010ffff"
#: The first character of a regular expression's part that is no plain text.
_META = re.compile(r"[\\.\[\](){}?*+|^$]")


def numbered_terms(terms: DataFrame, name: str = "id") -> DataFrame:
    """Distinct terms (term) with their places, from 0, in order of their bytes.

    Terms are dealt by range and sorted where they are; how many each range has is all that passes the driver."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = terms.repartitionByRange("term").sortWithinPartitions("term").withColumns({"part": F.spark_partition_id(), "place": place})
    dealt = stored(dealt)
    offsets, before = [], 0
    for part, n in sorted(dealt.groupBy("part").count().collect()):
        offsets.append((part, before))
        before += n
    offset = F.broadcast(terms.sparkSession.createDataFrame(offsets or [(0, 0)], "part int, before long"))
    return dealt.join(offset, "part").select((F.col("before") + F.col("place")).alias(name), "term")


def _sorted(rows: DataFrame, path: str, group_bytes: int, *order: str) -> None:
    """Write rows in order: dealt by range, so that no key lies in one task, each file sorted."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("parquet.block.size", group_bytes).option("parquet.page.size", max(1024, group_bytes // 16)).parquet(path)


def build(triples: DataFrame, folder: str, group_bytes: int = GROUP_BYTES) -> TermIndex:
    """Write the index of triples (s, p, o, o_kind, o_dt, o_lang) to a new folder.

    Objects that many triples share meet their numbers in a join that Spark splits where it is skewed; properties are
    broadcast after a count. Repeated triples are one; an empty graph gives an empty index."""
    spark = triples.sparkSession
    named = triples.select(
        F.concat(F.lit("<"), F.col("s")).alias("s_term"), F.concat(F.lit("<"), F.col("p")).alias("p_term"),
        encode(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang")).alias("o_term"),
    ).distinct()
    named = stored(named)
    terms = reduce(DataFrame.unionByName, [named.select(F.col(f"{c}_term").alias("term")) for c in "spo"]).distinct()
    _sorted(numbered_terms(terms), f"{folder}/terms", group_bytes, "id")
    terms = spark.read.schema("id long, term string").parquet(f"{folder}/terms")
    properties = stored(named.select(F.col("p_term").alias("term")).distinct().join(terms, "term"))
    few = properties.count() <= BROADCAST_ROWS
    number = lambda rows, c, t: rows.join(t.select(F.col("term").alias(f"{c}_term"), F.col("id").alias(c)), f"{c}_term").drop(f"{c}_term")
    rows = number(named, "p", F.broadcast(properties) if few else properties)
    rows = stored(number(number(rows, "s", terms), "o", terms).select("s", "p", "o"))
    _sorted(rows, f"{folder}/by_subject", group_bytes, "p", "s", "o")
    _sorted(rows, f"{folder}/by_object", group_bytes, "p", "o", "s")
    per = rows.groupBy("p").agg(F.count("*").alias("n"), F.count_distinct("s").alias("subjects"), F.count_distinct("o").alias("objects"))
    _sorted(per, f"{folder}/properties", group_bytes, "p")
    _sorted(characteristic_sets(rows), f"{folder}/sets", group_bytes, "subjects")
    literals = terms.filter(F.col("term").startswith('"'))
    words = literals.select("id", F.posexplode(F.split(F.lower(sparql.lexical(F.col("term"))), NOT_WORD)).alias("position", "word")).filter("word <> ''")
    _sorted(words.groupBy("word", "id").agg(F.array_sort(F.collect_list("position")).alias("positions")), f"{folder}/postings", group_bytes, "word", "id")
    about = {"literals": literals.count(), "terms": terms.count()}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{folder}/about")
    return TermIndex(spark, folder)


def characteristic_sets(rows: DataFrame) -> DataFrame:
    """Which sets of properties subjects have: properties, subjects (how many have just these) and counts (triples by property).

    A subject is a row of as many numbers as it has properties, however many triples it has of them."""
    per = rows.groupBy("s", "p").agg(F.count("*").alias("n")).groupBy("s").agg(F.array_sort(F.collect_list(F.struct("p", "n"))).alias("has"))
    sets = per.select(F.col("has.p").alias("properties"), F.posexplode(F.col("has.n")).alias("at", "n"))
    sets = sets.groupBy("properties", "at").agg(F.count("*").alias("subjects"), F.sum("n").alias("n"))
    return sets.groupBy("properties").agg(F.max("subjects").alias("subjects"), F.array_sort(F.collect_list(F.struct("at", "n"))).alias("counts")).withColumn("counts", F.col("counts.n"))


class TermIndex:
    """An index that build() has written."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        read = lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/{name}")
        self.spark, self.folder = spark, folder
        self.terms = read("terms", "id long, term string")
        self.by_subject, self.by_object = (read(n, "s long, p long, o long") for n in ("by_subject", "by_object"))
        self.properties = read("properties", "p long, n long, subjects long, objects long")
        self.postings = read("postings", "word string, id long, positions array<int>")
        self.sets = read("sets", "properties array<long>, subjects long, counts array<long>")
        self._few: list | None = None
        self.about = json.loads(spark.read.text(f"{folder}/about").first()[0])
        self._known: dict[str, int | None] = {}

    def ids(self, terms: list[str]) -> dict[str, int | None]:
        """Numbers of a query's constants; None where there is no such term."""
        if new := [t for t in dict.fromkeys(terms) if t not in self._known]:
            found = {r["term"]: r["id"] for r in self.terms.filter(F.col("term").isin(new)).collect()}
            self._known |= {t: found.get(t) for t in new}
        return {t: self._known[t] for t in terms}

    def star(self, properties: list[int]) -> tuple[float, float]:
        """(subjects that have all of some properties, rows that their values make), exact but for how values of one subject
        combine: summed over the sets that hold the properties."""
        if self._few is None:
            few = self.sets.limit(FEW_SETS + 1).collect()  # a bounded number; beyond it, each question is a job
            self._few = few if len(few) <= FEW_SETS else []
            self._many = len(few) > FEW_SETS
        if self._many:
            holds = reduce(Column.__and__, [F.array_contains("properties", p) for p in properties])
            made = reduce(Column.__mul__, [F.element_at("counts", F.array_position("properties", p).cast("int")) / F.col("subjects") for p in properties], F.col("subjects"))
            n, rows = self.sets.filter(holds).agg(F.sum("subjects"), F.sum(made)).first()
            return float(n or 0), float(rows or 0)
        n = rows = 0.0
        for r in self._few:
            has = dict(zip(r["properties"], r["counts"]))
            if all(p in has for p in properties):
                n += r["subjects"]
                rows += r["subjects"] * math.prod(has[p] / r["subjects"] for p in properties)
        return n, rows

    def interval(self, prefix: str) -> tuple[int, int] | None:
        """The first and last number of the terms that begin with a text."""
        low, high = self.terms.filter((F.col("term") >= prefix) & (F.col("term") < prefix + LAST)).agg(F.min("id"), F.max("id")).first()
        return None if low is None else (low, high)

    def beginning(self, prefix: str) -> list[tuple[int, int]]:
        """Intervals of the IRIs and literals whose texts begin with prefix."""
        return [x for mark in '"<' if (x := self.interval(mark + prefix))]

    def named(self, rows: DataFrame, column: str, within: list[tuple[int, int]] | None = None) -> DataFrame:
        """rows with the numbers in column in place of which their terms stand; within: intervals that the numbers lie in."""
        terms = self.terms if within is None else self.terms.filter(_within(F.col("id"), within))
        terms = terms.select(F.col("id").alias("__id"), F.col("term").alias("__term"))
        return rows.join(terms, F.col(f"`{column}`") == F.col("__id")).withColumn(column, F.col("__term")).drop("__id", "__term")

    def matches(self, word: str) -> DataFrame:
        """Literals (id) that hold a word, or a word that begins so if it ends in *, with their hits: times it stands there."""
        begins = word.endswith("*")
        start = word[:-1] if begins else word
        test = (F.col("word") >= start) & (F.col("word") < start + LAST) if begins else F.col("word") == word
        hits = F.size("positions").cast("long")
        found = self.postings.filter(test)
        return found.groupBy("id").agg(F.sum(hits).alias("hits")) if begins else found.select("id", hits.alias("hits"))

    def texts(self, words: str) -> DataFrame:
        """Literals (id) that hold all of some words, with score: the sum over the words of hits, weighed by the logarithm of
        how many literals there are to one that has the word."""
        out = None
        for i, word in enumerate(dict.fromkeys(words.lower().split())):
            found = self.matches(word)
            rarity = math.log(1 + self.about["literals"] / max(found.count(), 1))  # reads only the word's own postings
            found = found.select("id", (F.col("hits") * F.lit(rarity)).alias(f"s{i}"))
            out = found if out is None else out.join(found, "id")
        if out is None:
            return self.terms.filter(F.col("term").startswith('"')).select("id", F.lit(0.0).alias("score"))
        return out.select("id", reduce(Column.__add__, [F.col(c) for c in out.columns if c != "id"]).alias("score"))


def _within(c: Column, intervals: list[tuple[int, int]]) -> Column:
    return reduce(Column.__or__, [c.between(a, z) for a, z in intervals], F.lit(False)) if len(intervals) != 1 else c.between(*intervals[0])


def _runs(values: list[int], most: int = 64) -> list[tuple[int, int]]:
    """Intervals that cover values, cut at the widest gaps: bounds that row groups' statistics can tell."""
    values = sorted(set(values))
    gaps = sorted(sorted(range(1, len(values)), key=lambda i: values[i - 1] - values[i])[: most - 1])
    return [(values[a], values[z - 1]) for a, z in zip([0, *gaps], [*gaps, len(values)])] if values else []


def _plain(e) -> Var | None:
    """The variable of ?x or STR(?x)."""
    return e if isinstance(e, Var) else e.args[0] if isinstance(e, Expr) and e.op == "call:STR" and isinstance(e.args[0], Var) else None


def prefixes(e) -> dict[str, str]:
    """What a filter says about how variables' texts begin: STRSTARTS and REGEX from the start, joined by &&."""
    if isinstance(e, Expr) and e.op == "and":
        return {k: v for a in e.args for k, v in prefixes(a).items()}
    if not (isinstance(e, Expr) and e.op in ("call:STRSTARTS", "call:REGEX") and (v := _plain(e.args[0])) and all(isinstance(a, Literal) for a in e.args[1:])):
        return {}
    text = e.args[1].value
    if e.op == "call:REGEX":
        if not text.startswith("^") or "|" in text or len(e.args) > 2 and "i" in e.args[2].value:
            return {}
        meta = _META.search(text, 1)
        text = text[1 : meta.start() if meta else len(text)]
        if meta and meta[0] in "?*{":  # the character before may be missing
            text = text[:-1]
    return {v.name: text} if text else {}


def _names(x) -> set[str]:
    """Variables anywhere in a part of a query."""
    if isinstance(x, Var):
        return {x.name}
    if isinstance(x, sparql.Query):
        return _names([x.items, x.where, x.group or [], x.having, x.order]) | {n for n, _ in x.items}
    if isinstance(x, Expr):
        return _names(x.args)
    if isinstance(x, tuple) and x and x[0] in ("values", "bind"):
        return set(x[1]) if x[0] == "values" else _names(x[1]) | {x[2]}
    if isinstance(x, (list, tuple)):
        return set().union(*map(_names, x)) if x else set()
    return set()


def _counts_rows(e) -> bool:
    """Whether an expression counts distinct rows, and so needs all variables."""
    return isinstance(e, Expr) and (e.op == "agg:COUNT" and e.distinct and not e.args or any(map(_counts_rows, e.args)))


class IndexedGraph(Graph):
    """A graph whose patterns are read from an index: constants become numbers, prefixes intervals of numbers, patterns are
    joined on numbers, the smallest first, and only the variables that the query goes on to use get their terms back."""

    def __init__(self, triples: DataFrame, index: TermIndex, strict_types: bool = False):
        if "g" in triples.columns:
            raise SparqlError("the index holds the triples of one graph")
        super().__init__(triples, None, strict_types)
        self.index, self.bounds, self.needed = index, [{}], [None]

    def run(self, q: sparql.Query) -> Rel:
        outside = _names([q.items, q.group or [], q.having, q.order])
        everything = not q.items or any(_counts_rows(e) for _, e in q.items) or any(map(_counts_rows, [*q.having, *(e for e, _ in q.order)]))
        self.needed.append(None if everything else outside)
        try:
            return super().run(q)
        finally:
            self.needed.pop()

    def group(self, elements: list) -> Rel:
        self.bounds.append({k: v for e in elements if e[0] == "filter" for k, v in prefixes(e[1]).items()})
        needed = self.needed[-1]
        if needed is not None:
            seen = [_names(e) for e in elements]
            twice = {n for i, a in enumerate(seen) for b in seen[i + 1 :] for n in a & b}
            needed = needed | twice | set().union(*(s for e, s in zip(elements, seen) if e[0] != "triples"), set())
        self.needed.append(needed)
        try:
            return super().group(elements)
        finally:
            self.bounds.pop()
            self.needed.pop()

    def basic(self, patterns: list) -> Rel:
        paths = [p for p in patterns if isinstance(p[1], Path)]
        others = [p for p in patterns if not isinstance(p[1], Path)]
        shared = _names(paths) & _names(others)
        rel = self.numbers(others, shared) if others else None
        for p in paths:
            found = self.scan(p)
            rel = found if rel is None else self.join(rel, found, "inner")
        return rel

    def numbers(self, patterns: list, shared: set[str]) -> Rel:
        """Patterns joined on numbers; of the variables only those that are needed outside, with their terms."""
        constants = [constant(t) for p in patterns for t in p if isinstance(t, (Iri, Literal)) and p[1] != Iri(CONTAINS_WORD)]
        ids = self.index.ids(constants)
        bounds = {n: self.index.beginning(text) for n, text in self.bounds[-1].items() if n in _names(patterns)}
        known = {r["p"]: r for r in self.index.properties.filter(F.col("p").isin([i for i in ids.values() if i is not None])).collect()}
        df, names = self.joined([Part(p, self, ids, bounds, known) for p in patterns], ids)
        needed = self.needed[-1]
        order = dict.fromkeys(t.name for p in patterns for t in p if isinstance(t, Var))
        kept = [n for n in order if needed is None or n in needed or n in shared]
        scores = [c for c in df.columns if c.startswith("_score_")]
        df = df.select(*[F.col(f"`{n}`") for n in kept], *[c for c in df.columns if c.startswith("_score_")])
        for n in kept:
            df = self.index.named(df, n, bounds.get(n))
        return Rel(df, dict.fromkeys(kept, "term") | dict.fromkeys(scores, "number"))

    def joined(self, parts: list[Part], ids: dict) -> tuple[DataFrame, set[str]]:
        """Parts joined unit by unit, a unit being a star of one subject or a single part: first the one that has the fewest
        rows, then always the connected one that leaves the fewest.

        As long as what is joined has few values of a variable, these are handed to the next scans, which then read only what
        can join."""
        units = [Unit(star, self.index, ids) for star in _stars(parts)]
        units.sort(key=lambda u: u.size)
        df, size, distinct, handed, names = None, 1.0, {}, {}, set()
        while units:
            near = [u for u in units if u.names & names] or units
            expect = lambda u: size * u.size / math.prod(max(distinct.get(n, 1.0), u.distinct[n], 1.0) for n in u.names & names)  # noqa: B023, E731
            unit = min(near, key=expect)
            units.remove(unit)
            rest = sorted(unit.parts, key=lambda x: (not x.names & handed.keys(), x.size))
            while rest:
                part = rest.pop(0)
                right, on = part.rows(handed), sorted(names & part.names)
                df = right if df is None else df.join(right, on) if on else df.crossJoin(right)
                values = {n: min(d, len(handed[n])) if n in handed else d for n, d in part.distinct.items()}
                size *= part.size * math.prod(values[n] / max(part.distinct[n], 1.0) for n in values)
                size /= math.prod(max(distinct.get(n, 1.0), values[n], 1.0) for n in on)
                names |= part.names
                for n in part.names:
                    distinct[n] = min(distinct.get(n, math.inf), values[n], max(size, 1.0))
                ahead = {n for x in [*rest, *(y for u in units for y in u.parts)] for n in x.names}
                for n in sorted(part.names & ahead - handed.keys()) if size <= HANDED else ():
                    found = [r[0] for r in df.select(f"`{n}`").distinct().limit(HANDED + 1).collect()]
                    if len(found) <= HANDED:
                        handed[n] = found
        return df, names


class Part:
    """A pattern, with the number of rows that are expected of it and, for each variable, of values."""

    def __init__(self, pattern: tuple, graph: IndexedGraph, ids: dict, bounds: dict, known: dict) -> None:
        s, p, o = self.pattern = pattern
        self.index, self.ids, self.bounds = graph.index, ids, bounds
        self.names = {t.name for t in pattern if isinstance(t, Var)}
        self.words = isinstance(p, Iri) and p.value == CONTAINS_WORD
        if self.words and not (isinstance(s, Var) and isinstance(o, Literal)):
            raise SparqlError("a text is a variable, the words are a literal")
        # texts are the literals of an entity's own statements; literals have the first numbers
        self.entity = isinstance(p, Iri) and p.value == CONTAINS_ENTITY
        self.columns = [(o, "s"), (s, "o")] if self.entity else [(s, "s"), (p, "p"), (o, "o")]
        about = known.get(ids.get(constant(p)) if isinstance(p, Iri) and not (self.entity or self.words) else None)
        everything = float(self.index.about["terms"])
        self.size, self.distinct, self.share = float(about["n"]) if about else 4 * everything, {}, 1.0
        if self.words:
            self.size, self.distinct = 1.0, {s.name: 1.0}
            return
        for term, c in self.columns:
            count = float(about["subjects" if c == "s" else "objects"]) if about and c != "p" else everything
            if isinstance(term, Var):
                self.distinct[term.name] = count
                if term.name in bounds:
                    self.share *= min(1.0, sum(z - a + 1 for a, z in bounds[term.name]) / max(count, 1.0))
            elif c != "p":
                self.share *= 0.0 if ids[constant(term)] is None else 1.0 / max(count, 1.0)
            elif ids[constant(term)] is None:
                self.share = 0.0
        self.size *= self.share
        self.distinct = {n: min(d, max(self.size, 1.0)) for n, d in self.distinct.items()}

    def rows(self, handed: dict[str, list[int]]) -> DataFrame:
        """The pattern's rows of numbers, read from the sorting that its constants, intervals or handed values select in."""
        s, p, o = self.pattern
        if self.words:
            found = self.index.texts(o.value).select(F.col("id").alias(s.name), F.col("score").alias(f"_score_{s.name}"))
            return found.filter(F.col(s.name).isin(handed[s.name])) if s.name in handed else found
        bound = lambda t: not isinstance(t, Var) or t.name in self.bounds or t.name in handed
        first, second = (o, s) if self.entity else (s, o)
        df = self.index.by_object if bound(second) and not bound(first) else self.index.by_subject
        if self.entity:
            df = df.filter(F.col("o") < self.index.about["literals"])
        out: dict[str, str] = {}
        for term, c in self.columns:
            if isinstance(term, Var):
                if term.name in self.bounds:
                    df = df.filter(_within(F.col(c), self.bounds[term.name]))
                if term.name in handed:
                    df = df.filter(_within(F.col(c), _runs(handed[term.name])) & F.col(c).isin(handed[term.name]))
                if term.name in out:
                    df = df.filter(F.col(c) == F.col(out[term.name]))
                out.setdefault(term.name, c)
            else:
                i = self.ids[constant(term)]
                df = df.filter(F.col(c) == i) if i is not None else df.filter(F.lit(False))
        df = df.select(*[F.col(c).alias(n) for n, c in out.items()])
        return df.distinct() if self.entity else df


class Unit:
    """Parts that are joined as one: of a star, rows and subjects are known from the sets that hold its properties."""

    def __init__(self, parts: list[Part], index: TermIndex, ids: dict) -> None:
        self.parts, self.names = parts, set().union(*(p.names for p in parts))
        self.size, self.distinct = parts[0].size, dict(parts[0].distinct)
        if len(parts) > 1:
            subjects, rows = index.star([ids[constant(p.pattern[1])] for p in parts])
            share = math.prod(p.share for p in parts)
            self.size = rows * share
            for p in parts:
                self.distinct |= p.distinct
            self.distinct[parts[0].pattern[0].name] = subjects * min(share, 1.0)
        self.distinct = {n: min(d, max(self.size, 1.0)) for n, d in self.distinct.items()}


def _stars(parts: list[Part]) -> list[list[Part]]:
    """Parts by subject, if that is a variable and their properties are known and different; all others alone."""
    stars: dict[str, list[Part]] = {}
    out = []
    for part in parts:
        s, p, _ = part.pattern
        plain = isinstance(s, Var) and isinstance(p, Iri) and not (part.words or part.entity) and part.ids[constant(p)] is not None
        if plain and all(part.pattern[1] != x.pattern[1] for x in stars.get(s.name, [])):
            stars.setdefault(s.name, []).append(part)
        else:
            out.append([part])
    return out + list(stars.values())


def indexed(triples: DataFrame, group_bytes: int = GROUP_BYTES) -> IndexedGraph:
    """triples with an index of their own, built now in the shared folder."""
    return IndexedGraph(triples, build(triples, fresh(triples.sparkSession, "terms"), group_bytes))
