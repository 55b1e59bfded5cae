"""Scores of extracted records against ground truth: greedy one-to-one matching in order of the truth."""

from __future__ import annotations

import functools
import re
from array import array
from bisect import bisect_left, insort
from collections import Counter, deque
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weight of each field.
WEIGHTS = {"Court_name": 2, "Date_of_article": 1, "Company_name": 2, "Registration_Code": 2, "Registration_year": 2}
EXACT = ("Registration_Code", "Registration_year")
#: Fuzzy matches below this sum of two similarities don't count.
FLOOR = 0.5
#: Kinds of records that are compared at a time at first, those with the highest bounds.
NEAREST = 16
#: Records related to a text that are not gone through one by one, if they are more; such records held at a time on a page.
MANY = 256
HELD = 2_000_000
#: Rows of the result that are handed on together.
ROWS_OUT = 4096
_KINDS = {
    "doc": pa.string(), "truth_row": pa.int64(), "parsed_row": pa.int64(), "score": pa.float64(), "code_mismatch": pa.bool_(), "year_mismatch": pa.bool_(),
}
RESULT = "doc string, truth_row long, parsed_row long, score double, code_mismatch boolean, year_mismatch boolean"


@functools.lru_cache(maxsize=20_000)
def squeezed(value) -> str:
    return re.sub(r"[\s\-.,⸗]", "", str(value).lower()) if isinstance(value, str) else ""


@functools.lru_cache(maxsize=20_000)
def ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio; 1 for two empty texts. The order of arguments matters."""
    if a == b:
        return 1.0
    if len(b) < 200 and (a in b or b in a):  # the shorter text is the one block in common; in longer ones frequent letters don't count
        return 2.0 * min(len(a), len(b)) / (len(a) + len(b))
    return SequenceMatcher(None, a, b).ratio()


def similarity(a, b) -> float:
    return ratio(squeezed(a), squeezed(b))


class Likeness:
    """What ratio(a, b) is at most for one text a and all distinct texts b of a page at once: their common letters, in
    whatever order, over all letters."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = list(dict.fromkeys(texts))
        place = {b: i for i, b in enumerate(self.texts)}
        self.of = np.fromiter((place[b] for b in texts), np.int64, len(texts))
        self.lengths = np.array([len(b) for b in self.texts], np.int64)
        self.kind = np.min_scalar_type(int(self.lengths.max(initial=0)))  # holds every count of letters, in one byte for short texts
        self.counts: dict[str, tuple] = {}  # by letter: which texts have it (all, where many do), how often, least and most
        found: dict[str, tuple[list[int], list[int]]] = {}
        for i, b in enumerate(self.texts):
            for letter in set(b):
                where, times = found.setdefault(letter, ([], []))
                where.append(i)
                times.append(b.count(letter))
        for letter in list(found):
            where, times = (np.array(c, k) for c, k in zip(found.pop(letter), (np.int64, self.kind)))
            if 4 * len(where) > len(self.texts):
                every = np.zeros(len(self.texts), self.kind)
                every[where] = times
                where, times = slice(None), every
            self.counts[letter] = where, times, int(times.min()), int(times.max())
        self.last: tuple[str, np.ndarray] | None = None

    def most(self, a: str) -> np.ndarray:
        """The bounds of a and the text of each record; one bound if all have the same text."""
        if self.last is None or self.last[0] != a:
            common, always = np.zeros(len(self.texts), self.kind), 0
            for letter in set(a):
                if letter in self.counts:
                    n, (where, times, least, most) = a.count(letter), self.counts[letter]
                    if isinstance(where, slice) and n <= least:
                        always += n  # all texts have it as often
                    else:
                        common[where] += times if n >= most else np.minimum(times, self.kind.type(n))
            total = self.lengths + len(a)
            bounds = np.divide(2.0 * common + 2.0 * always, total, out=np.ones(len(total)), where=total > 0)  # two empty texts are the same
            self.last = a, bounds if len(bounds) in (1, len(self.of)) else bounds[self.of]
        return self.last[1]


def contained(a, b) -> int:
    if not isinstance(a, str) or not isinstance(b, str) or not a or not b:
        return 0
    a, b = a.lower(), b.lower()
    return int(a in b or b in a)


def equal(a, b) -> int:
    if not isinstance(a, str) or not isinstance(b, str) or not a or not b:
        return 0
    return int(a.lower().strip() == b.lower().strip())


def _fields(t: dict, p: dict, fuzzy: bool) -> float:
    total = 0.0
    for name, weight in WEIGHTS.items():
        if fuzzy:
            a, b = t["squeezed"][name], p["squeezed"][name]
            total += weight * (float(a == b) if name in EXACT else ratio(a, b))
        else:
            total += weight * (equal(t[name], p[name]) if name in EXACT else contained(t[name], p[name]))
    return total


def _key(r: dict) -> tuple[str, str]:
    return r["squeezed"]["Court_name"], r["squeezed"]["Company_name"]


class _Fuzzy:
    """Records of a page that are left, asked for the one with the greatest sum of similarities of court and company.

    Records with the same two texts are one group, the first of them left stands for it. A group of the asked texts is found
    by them. Else groups are compared in falling order of what the sum is at most, until none can be better. Groups whose texts
    have the same letters are one kind, as these bounds are the same; there are far fewer kinds than distinct texts on a large
    page, and bounds of all are made of arrays. Texts that are asked for again keep their best groups."""

    def __init__(self, truth: list[dict], parsed: list[dict]) -> None:
        self.groups: dict[tuple[str, str], deque[int]] = {}
        for i, p in enumerate(parsed):
            self.groups.setdefault(_key(p), deque()).append(i)
        self.keys, self.rows = list(self.groups), list(self.groups.values())
        self.place = {k: g for g, k in enumerate(self.keys)}
        letters, kinds = functools.cache(lambda text: "".join(sorted(text))), {}
        self.kind = [kinds.setdefault((letters(court), letters(company)), len(kinds)) for court, company in self.keys]
        self.members: list[list[tuple[int, int]]] = [[] for _ in kinds]  # of each kind: first record left and group, in order
        for g, c in enumerate(self.kind):
            self.members[c].append((self.rows[g][0], g))
        self.left, self.first = np.ones(len(kinds), bool), np.array([m[0][0] for m in self.members], np.int64)
        self.court, self.company = Likeness([k[0] for k in kinds]), Likeness([k[1] for k in kinds])
        self.known: dict[tuple[str, str], tuple[list[int], float]] = {}
        self.again = {k for k, n in Counter(map(_key, truth)).items() if n > 1}

    def best(self, t: dict) -> tuple[int | None, float]:
        """The first of the records left with the greatest sum of at least FLOOR, and the sum."""
        k = _key(t)
        g = self.place.get(k)
        if g is not None and self.rows[g]:
            return self.rows[g][0], 2.0
        groups, score = self.known.get(k, ((), 0.0))
        groups = [g for g in groups if self.rows[g]]
        if not groups and self.left.any():
            groups, score = self._search(*k, k in self.again)
            if k in self.again and len(groups) <= NEAREST:
                self.known[k] = groups, score
        return (min(self.rows[g][0] for g in groups), score) if groups else (None, 0.0)

    def _search(self, court: str, company: str, every: bool) -> tuple[list[int], float]:
        """The groups with the greatest sum, every one of them or the one whose record comes first; and the sum."""
        bounds = np.where(self.left, self.court.most(court) + self.company.most(company), -1.0)
        best, score, step = [], FLOOR, NEAREST
        near = bounds.argmax()[None]
        while len(near):
            for c in near.tolist():
                if bounds[c] < score:
                    break
                for row, g in self.members[c]:
                    later = not every and bool(best) and row > self.rows[best[0]][0]
                    if later and bounds[c] <= score:
                        break
                    s = ratio(court, self.keys[g][0]) + ratio(company, self.keys[g][1])
                    if s > score or (s == score and not (best and (every or later))):
                        best, score = [g], s
                    elif s == score and every:
                        best.append(g)
            bounds[near] = -1.0
            may = bounds >= score
            if best and not every:
                may &= (bounds > score) | (self.first < self.rows[best[0]][0])
            near = np.flatnonzero(may)
            if len(near) > step:  # the highest bounds in parts of growing size
                near = near[np.argpartition(bounds[near], len(near) - step)[-step:]]
                step *= 4
            near = near[np.lexsort((self.first[near], -bounds[near]))]
        return best, score

    def take(self, i: int, p: dict) -> None:
        g = self.place[_key(p)]
        c = self.kind[g]
        members = self.members[c]
        del members[bisect_left(members, (i, g))]  # a record is taken when it is the first of its group
        self.rows[g].popleft()
        if self.rows[g]:
            insort(members, (self.rows[g][0], g))
        if members:
            self.first[c] = members[0][0]
        else:
            self.left[c] = False


def _within(text: str, texts: dict, lengths: list[int]) -> list[str]:
    """Which of texts, whose lengths are given, lie in a text: its pieces are looked up, or the texts are if they are fewer."""
    if len(text) * len(lengths) < len(texts):
        return list({b for n in lengths for k in range(len(text) - n + 1) if (b := text[k : k + n]) in texts})
    return [b for b in texts if b in text]


class _Inside:
    """Distinct texts of a page in lower case, asked which of them contain a text or lie in it."""

    def __init__(self, asked: list, texts: list) -> None:
        asked, texts = ([v.lower() if isinstance(v, str) else "" for v in c] for c in (asked, texts))
        self.ids: dict[str, int] = {}
        self.of = np.array([self.ids.setdefault(b, len(self.ids)) for b in texts], np.int64)
        self.place = {b: i for b, i in self.ids.items() if b}
        self.lengths = sorted({len(b) for b in self.place})
        # what contains the texts that will be asked for, from their side: no text is searched for in all others
        self.around: dict[str, array] = {a: array("q") for a in asked if a}
        lengths = sorted({len(a) for a in self.around})
        for b, i in self.place.items():
            for a in _within(b, self.around, lengths):
                self.around[a].append(i)

    def related(self, a) -> list[int]:
        """Ids of texts that contain a or lie in it."""
        a = a.lower() if isinstance(a, str) else ""
        if not a:
            return []
        return list({*self.around[a], *(self.place[b] for b in _within(a, self.place, self.lengths))})


class _Equal:
    """Distinct texts of a page without case and outer white space, asked which of them are a text."""

    def __init__(self, asked: list, texts: list) -> None:
        self.ids: dict[str | None, int] = {}
        self.of = np.array([self.ids.setdefault(v.lower().strip() if isinstance(v, str) and v else None, len(self.ids)) for v in texts], np.int64)

    def related(self, a) -> list[int]:
        i = self.ids.get(a.lower().strip()) if isinstance(a, str) and a else None
        return [] if i is None else [i]


class _Many:
    """Many records whose texts of a field are related to an asked one: the first left of each group."""

    def __init__(self, rows: np.ndarray, group: np.ndarray) -> None:
        self.rows = rows[np.argsort(group[rows], kind="stable")]
        self.groups, at = np.unique(group[self.rows], return_index=True)
        self.first, self.at, self.end = self.rows[at], at.tolist(), [*at[1:].tolist(), len(rows)]
        self.texts: np.ndarray | None = None  # which they are, if that is not one text

    def firsts(self, left: np.ndarray) -> np.ndarray:
        """Of each group; the place behind all records if none is left."""
        for g in np.flatnonzero(~left[self.first]).tolist():
            while self.at[g] < self.end[g] and not left[self.rows[self.at[g]]]:
                self.at[g] += 1
            self.first[g] = self.rows[self.at[g]] if self.at[g] < self.end[g] else len(left) - 1
        return self.first


class _Containing:
    """Records of a page that are left, asked for the one that agrees in most of the fields, by their weights.

    Records with the same texts in fields of few texts are one group, the first of them left stands for it. What agrees in
    one of the other fields is found by that field; where that are many records, by the first left of each group among them.
    So no question goes through all records of a large page."""

    def __init__(self, truth: list[dict], parsed: list[dict]) -> None:
        self.n, self.weights = len(parsed), np.array(list(WEIGHTS.values()))
        self.left = np.ones(self.n + 1, bool)  # the last one stands behind all records
        self.fields = [(n, (_Equal if n in EXACT else _Inside)([t[n] for t in truth], [p[n] for p in parsed])) for n in WEIGHTS]
        # texts of all fields are numbered together
        sizes = [len(f.ids) for _, f in self.fields]
        self.begin = [0, *np.cumsum(sizes).tolist()]
        self.of = np.stack([f.of + k for (_, f), k in zip(self.fields, self.begin)], axis=1)
        self.hit = np.zeros(self.begin[-1], bool)
        group, few = np.zeros(len(parsed), np.int64), []
        self.single: dict[int, tuple] = {}  # by field: records in order of their texts, where each text begins
        for c in np.argsort(sizes, kind="stable").tolist():
            of = self.fields[c][1].of
            more = np.unique(group * sizes[c] + of, return_inverse=True)[1]
            if not self.single and more.max(initial=0) < max(64, 4 * len(parsed) ** 0.5):
                group = more
                few.append(c)
            else:
                order = np.argsort(of, kind="stable")
                self.single[c] = order, np.searchsorted(of[order], np.arange(sizes[c] + 1)).tolist()
        self.group, self.order = group, np.argsort(group, kind="stable")
        at = np.searchsorted(group[self.order], np.arange(group.max(initial=-1) + 2))
        self.first = self.order[at[:-1]]  # of each group; the number of records if none is left
        self.texts, self.few = self.of[self.first][:, few], self.weights[few]
        self.at, self.end = at[:-1].tolist(), at[1:].tolist()
        self.frequent: dict[tuple[int, int], _Many] = {}  # by field and text
        self.many: dict[tuple, _Many] = {}  # by field and asked text, the last ones
        self.held, self.limit = 0, max(MANY, len(self.first))

    def _related(self, c: int, a) -> tuple[list[int], list[np.ndarray], list[_Many]]:
        """Texts of a field that are related to an asked one; records that have them, where they are few and where many."""
        if (c, a) in self.many:
            return [], [], [self.many[c, a]]
        texts = self.fields[c][1].related(a)
        if c not in self.single:
            return texts, [], []
        order, starts = self.single[c]
        rows, frequent = [], []
        for i in texts:
            if starts[i + 1] - starts[i] > self.limit:
                if (c, i) not in self.frequent:
                    self.frequent[c, i] = _Many(order[starts[i] : starts[i + 1]], self.group)
                frequent.append(self.frequent[c, i])
            else:
                rows.append(order[starts[i] : starts[i + 1]])
        if sum(map(len, rows)) <= self.limit:
            return texts, rows, frequent
        mask = np.zeros(len(starts) - 1, bool)
        mask[texts] = True
        found = _Many(np.flatnonzero(mask[self.fields[c][1].of]), self.group)
        found.texts = mask
        while self.many and self.held + len(found.rows) > HELD:
            self.held -= len(self.many.pop(next(iter(self.many))).rows)
        self.held += len(found.rows)
        self.many[c, a] = found
        return [], [], [found]

    def best(self, t: dict) -> tuple[int | None, float]:
        """The first of the records left with the greatest score above 0, and the score."""
        if not self.n:
            return None, 0.0
        found = [self._related(c, t[name]) for c, (name, _) in enumerate(self.fields)]
        hits = [k + i for k, (texts, _, _) in zip(self.begin, found) for i in texts]
        self.hit[hits] = True
        scores = self.hit[self.texts] @ self.few
        scores[self.first == self.n] = 0
        score = int(scores.max())
        best = int(self.first[scores == score].min())
        rows, many = [r for _, few, _ in found for r in few], {c: m for c, (_, _, m) in enumerate(found) if m}
        if many:
            # what agrees in no other field than that of most records is as good as its group; the rest is looked at
            most = max(many, key=lambda c: sum(len(m.rows) for m in many[c]))
            for m in many[most]:
                firsts = m.firsts(self.left)
                more = np.where(firsts < self.n, scores[m.groups] + self.weights[most], 0)
                row, top = int(firsts[more == more.max()].min()), int(more.max())
                if top > score or (top == score and row < best):
                    best, score = row, top
            rows += [m.rows for c in many if c != most for m in many[c]]
        if rows:
            rows = np.concatenate(rows)
            rows = rows[self.left[rows]]
        if len(rows):
            scores = self.hit[self.of[rows]] @ self.weights
            for c in many:
                for m in many[c]:
                    if m.texts is not None:
                        scores += self.weights[c] * m.texts[self.fields[c][1].of[rows]]
            most = int(scores.max())
            row = int(rows[scores == most].min())
            if most > score or (most == score and row < best):
                best, score = row, most
        self.hit[hits] = False
        return (best, float(score)) if score > 0 else (None, 0.0)

    def take(self, i: int, p: dict) -> None:
        self.left[i] = False
        g = self.group[i]
        while self.at[g] < self.end[g] and not self.left[self.order[self.at[g]]]:
            self.at[g] += 1
        self.first[g] = self.order[self.at[g]] if self.at[g] < self.end[g] else self.n


def _assign(truth: list[dict], parsed: list[dict], fuzzy: bool) -> list[tuple]:
    if fuzzy:
        for r in [*truth, *parsed]:
            r["squeezed"] = {n: squeezed(r[n]) for n in WEIGHTS}
    left, out = (_Fuzzy if fuzzy else _Containing)(truth, parsed), []
    for t in truth:
        best, score = left.best(t)
        if best is None or (fuzzy and score < FLOOR):
            # a code that nothing was matched with is a mismatch for one method only
            out.append((t["row"], None, 0.0, not fuzzy and bool(t["Registration_Code"]), False))
            continue
        p = parsed[best]
        left.take(best, p)
        if fuzzy:
            code, year = (t["squeezed"][n] != p["squeezed"][n] for n in EXACT)
        else:
            said = lambda v: v.lower().strip() if isinstance(v, str) and v else "none"
            code, year = (bool(t[n] or p[n]) and said(t[n]) != said(p[n]) for n in EXACT)
        out.append((t["row"], p["row"], _fields(t, p, fuzzy), code, year))
    return out


def _matched(batches: Iterator[pa.RecordBatch], fuzzy: bool) -> Iterator[pa.RecordBatch]:
    """Matches of pages (doc, truth, parsed). One page's records at a time are Python's, however many pages a batch has."""

    def made(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [()] * len(_KINDS)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS.values())], list(_KINDS))

    out: list[tuple] = []
    for batch in batches:
        for k in range(batch.num_rows):
            doc, truth, parsed = (batch.column(c)[k].as_py() for c in ("doc", "truth", "parsed"))
            out += [(doc, *r) for r in _assign(truth, parsed or [], fuzzy)]
            if len(out) >= ROWS_OUT:
                yield made(out)
                out = []
    yield made(out)


def match_records(truth: DataFrame, parsed: DataFrame, method: str = "fuzzy") -> DataFrame:
    """A row for each record of truth: doc, truth_row, parsed_row (null if none fits), score, code and year mismatches.

    truth and parsed hold the five fields, doc (the page they come from) and row (their order on it). For each record of
    truth in order the best record left is taken, so pages are matched apart from each other and each in one pass. method
    'fuzzy' weighs similarities of court and company; 'containment' weighs all fields and needs a score above 0."""
    if method not in ("fuzzy", "containment"):
        raise ValueError("method is fuzzy or containment")

    names = ["row", *WEIGHTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _matched(batches, method == "fuzzy")

    def pages(df: DataFrame, name: str) -> DataFrame:
        """A row for each page with its records in order: many pages then go through Python at a time."""
        return df.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(F.col("row").cast("long").alias("row"), *WEIGHTS))).alias(name))

    both = pages(truth.select("doc", *names), "truth").join(pages(parsed.select("doc", *names), "parsed"), "doc", "left")
    return both.select(F.col("doc").cast("string").alias("doc"), "truth", "parsed").mapInArrow(run, RESULT)


def summary(matches: DataFrame) -> DataFrame:
    """doc, score, ideal, ratio, matched, mismatched, code_mismatches of each page."""
    ideal = F.count("*") * sum(WEIGHTS.values())
    return matches.groupBy("doc").agg(
        F.sum("score").alias("score"), ideal.alias("ideal"), (F.sum("score") / ideal).alias("ratio"), F.count("parsed_row").alias("matched"),
        F.count_if(F.col("code_mismatch") | F.col("year_mismatch")).alias("mismatched"), F.count_if("code_mismatch").alias("code_mismatches"),
    )
