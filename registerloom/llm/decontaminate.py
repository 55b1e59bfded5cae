"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._rows import checked_broadcast, lean, mix, numbered, save, scope, send

#: Least words of a tile, and of a seed.
TILE_WORDS = 3
#: Share of a test item's words under tiles from which a document counts as contaminated.
COVERAGE = 0.6
#: Words of test items in one broadcast block.
BLOCK_WORDS = 2_000_000
_SLICE = 1 << 20
_TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> Iterator[list[str]]:
    """Words of a text in lower case, without punctuation, some at a time; cut at white space."""
    at = 0
    while text and at < len(text):
        to = at + _SLICE
        if to < len(text):
            space = re.compile(r"\s").search(text, to)
            to = space.start() if space else len(text)
        yield _TOKEN.findall(text[at:to].lower())
        at = to


class Items:
    """Test items as numbers: a vocabulary, the different windows of k words by their rolling hashes, and where each stands."""

    def __init__(self, rows: list[tuple], k: int):
        self.k, self.vocabulary, self.ids, self.words = k, {}, [], []
        for item_id, text in rows:
            words = [w for part in tokens(text) for w in part]
            if len(words) >= k:
                self.ids.append(item_id)
                self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64))
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.flat = np.concatenate(self.words) if self.words else np.empty(0, np.int64)
        self.start = np.cumsum(self.lengths) - self.lengths
        n = self.lengths - k + 1
        self.first_window = np.cumsum(n) - n
        item = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(item)) - self.first_window[item] if len(n) else np.empty(0, np.int64)
        at = self.start[item] + place if len(n) else place
        self.base = 0x9E3779B97F4A7C15
        while True:  # until different windows have different hashes
            flat = np.concatenate([self.windows(w) for w in self.words]) if self.words else np.empty(0, np.uint64)
            self.seeds, first, self.of, self.counts = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
            self.sample = at[first]
            if all((self.flat[at + j] == self.flat[self.sample[self.of] + j]).all() for j in range(k)):
                break
            self.base += 2
        order = np.argsort(self.of, kind="stable")
        self.item, self.place = item[order], place[order]
        self.first = np.cumsum(self.counts) - self.counts

    def windows(self, words: np.ndarray) -> np.ndarray:
        """Karp-Rabin hashes of all windows of k words."""
        n = max(0, len(words) - self.k + 1)
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(self.k):
                out = out * np.uint64(self.base) + words[j : j + n].astype(np.uint64)
        return mix(out)

    def meet(self, words: np.ndarray) -> np.ndarray:
        """The number among the items' windows of each window of a text, -1 for those that no item has. Words are compared."""
        n = max(0, len(words) - self.k + 1)
        out = np.full(n, -1, np.int64)
        known = words > 0
        all_known = np.ones(n, bool)
        for j in range(self.k):
            all_known &= known[j : n + j]
        at = np.flatnonzero(all_known)
        if not len(at) or not len(self.seeds):
            return out
        hashes = self.windows(words)[at]
        found = np.minimum(np.searchsorted(self.seeds, hashes), len(self.seeds) - 1)
        same = self.seeds[found] == hashes
        at, found = at[same], found[same]
        same = np.ones(len(at), bool)
        for j in range(self.k):
            same &= self.flat[self.sample[found] + j] == words[at + j]
        out[at[same]] = found[same]
        return out

    def covered(self, doc: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, words of the item under windows that the document has) from the windows of documents.

        A window counts once for a document, however often it stands there."""
        pairs = np.unique(doc * len(self.seeds) + seed)
        doc, seed = pairs // len(self.seeds), pairs % len(self.seeds)
        n = self.counts[seed]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[seed], n)
        doc, item, place = np.repeat(doc, n), self.item[at], self.place[at]
        order = np.lexsort((place, item, doc))
        doc, item, place = doc[order], item[order], place[order]
        last = np.append((doc[1:] != doc[:-1]) | (item[1:] != item[:-1]), True)
        words = np.where(last, self.k, np.minimum(self.k, np.append(place[1:] - place[:-1], 0)))
        cuts = np.append(0, np.flatnonzero(last)[:-1] + 1)
        return doc[cuts], item[cuts], np.add.reduceat(words, cuts)

    def matches(self, i: int, words: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal matches of item i and a document of these words and windows: place in the item, place in it, words.

        A match begins where equal windows follow different words and ends where different words follow them. Begins and
        ends are found each for itself and meet in order along the diagonals, so that a match costs the same at any length."""
        mine, own = self.words[i], self.of[self.first_window[i] : self.first_window[i] + self.lengths[i] - self.k + 1]
        at = np.flatnonzero(seed >= 0)
        edge = np.zeros(1, np.int64)  # no item has the word 0; of a document it is no item's word

        def differing(before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Pairs of equal windows beside different words."""
            width = len(self.vocabulary) + 2
            keys = own * width + before
            order = np.argsort(keys, kind="stable")
            keys, wanted = keys[order], seed[at] * width
            low, high = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted + width)
            same_low, same_high = np.searchsorted(keys, wanted + after), np.searchsorted(keys, wanted + after, side="right")
            n = (same_low - low) + (high - same_high)
            owner = np.repeat(np.arange(len(at)), n)
            j = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + low[owner]
            j += np.where(j >= same_low[owner], (same_high - same_low)[owner], 0)
            p, q = order[j], at[owner]
            along = np.lexsort((p, q - p))
            return p[along], q[along]

        # beyond either end of the item stands a word that no document has
        off = len(self.vocabulary) + 1
        p, q = differing(np.concatenate([[off], mine[: len(own) - 1]]), np.concatenate([edge, words])[at])
        end, _ = differing(np.concatenate([mine[self.k :], [off]]), np.concatenate([words, edge])[at + self.k])
        return p, q, end - p + self.k


def tile(place: np.ndarray, at: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Tiles (place, at, length) from all seed matches of one item and one document, as for tile_matches().

    Seeds that follow each other on a diagonal are one maximal match."""
    order = np.lexsort((place, at - place))
    place, diagonal = place[order], (at - place)[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 1) | (np.diff(diagonal) != 0)]))
    return tile_matches(place[new], (place + diagonal)[new], np.diff(np.append(new, len(place))) + k - 1, k)


def tile_matches(place: np.ndarray, at: np.ndarray, length: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from the maximal matches of one item and one document: tiles (place, at, length).

    The longest match is marked, ties by place in the item and then in the document; what is left unmarked of the others
    goes on as shorter matches, down to k words. It ends where the item has no k unmarked words in a row.
    """
    by_length: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for p, q, n in zip(place.tolist(), at.tolist(), length.tolist()):
        by_length[n].append((p, q))
    base = int(at.min())
    item_free, doc_free, tiles = np.ones(int((place + length).max()), bool), np.ones(int((at + length).max()) - base, bool), []

    def stretches(free: np.ndarray) -> list[tuple[int, int]]:
        """(from, to) of k free words or more."""
        edges = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
        return [(a, z) for a, z in edges.reshape(-1, 2).tolist() if z - a >= k]

    while by_length:
        n = max(by_length)
        for p, q in sorted(by_length.pop(n)):
            free = item_free[p : p + n] & doc_free[q - base : q - base + n]
            if free.all():
                tiles.append((p, q, n))
                item_free[p : p + n] = doc_free[q - base : q - base + n] = False
                if not stretches(item_free):
                    return tiles
                continue
            for a, z in stretches(free):
                by_length[z - a].append((p + a, q + a))
    return tiles


def _matcher(items, coverage: float):
    def met(known: Items, rows: list[tuple]) -> list[tuple]:
        """Matches of some documents, whose words stand one after the other with k unknown words between them."""
        get, gap, parts, starts, at = known.vocabulary.get, np.zeros(known.k, np.int64), [], [], 0
        for _, _, text in rows:
            starts.append(at)
            for part in tokens(text):
                parts.append(np.fromiter((get(w, 0) for w in part), np.int64, len(part)))
                at += len(part)
            parts.append(gap)
            at += known.k
        words = np.concatenate(parts)
        seed = known.meet(words)
        hits = np.flatnonzero(seed >= 0)
        if not len(hits):
            return []
        starts.append(at)
        out = []
        # no tiling covers more words than the windows do; a pair of too few is not looked at
        for d, i, most in zip(*(x.tolist() for x in known.covered(np.searchsorted(starts, hits, side="right") - 1, seed[hits]))):
            least = coverage * len(known.words[i])
            if most < least:
                continue
            own = slice(starts[d], starts[d + 1])
            tiles = tile_matches(*known.matches(i, words[own], seed[own]), known.k)
            covered = sum(n for _, _, n in tiles)
            if covered >= least:
                rid, doc_id, _ = rows[d]
                out.append((rid, doc_id, known.ids[i], covered / len(known.words[i]), covered, len(tiles), max(n for _, _, n in tiles), min(q for _, q, _ in tiles), max(q + n for _, q, n in tiles)))
        return out

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for row in [*zip(*(batch.column(c).to_pylist() for c in ("rid", "doc_id", "text"))), None]:
                if rows and (row is None or size > _SLICE):
                    if out := met(items.value, rows):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ARROW)], _COLUMNS)
                    rows, size = [], 0
                if row and row[2]:
                    rows.append(row)
                    size += len(row[2])

    return match


_COLUMNS = ["rid", "doc_id", "item_id", "coverage", "covered_words", "n_tiles", "longest_tile", "first_word", "end_word"]
_ARROW = [pa.int64()] * 3 + [pa.float64()] + [pa.int64()] * 5
_TYPES = "rid long, doc_id long, item_id long, coverage double, covered_words long, n_tiles long, longest_tile long, first_word long, end_word long"


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = TILE_WORDS, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Pairs of a document and a test item that it holds: doc_id, item_id, coverage, covered_words, n_tiles, longest_tile,
    first_word, end_word (of the tiles in the document), rid.

    Words are runs of letters, digits and underscores, in lower case. Every window of k words of a document meets the
    windows of the test items by its hash. A pair's seeds are tiled greedily, longest first and without overlap in either
    text, in whatever order the parts stand; the pair is returned if tiles cover the share coverage of the item's words.
    Seeds in a row are one match, kept as begin and length, so words repeated on both sides make no table of all seeds.

    Test items are sent to the executors in blocks of about block_words words, one after the other, so a large benchmark
    takes more passes, never more memory. Each document is tiled where it is read; nothing is shuffled.

    Nulls and empty texts, of documents or items, match nothing; so do items of fewer than k words. A null doc_id or
    item_id is returned as null. Repeated items are met once, repeated documents each. An empty table on either side gives
    no rows; other columns are ignored.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").distinct()
    n_words = items.agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0] or 0
    blocks = max(1, -(-n_words // block_words))
    rows = numbered(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "rid")

    def pairs(block: int):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        sent = send(docs.sparkSession, Items([tuple(r) for r in part], k))
        return sent, rows.mapInArrow(lean(_matcher(sent, coverage)), _TYPES)

    if blocks == 1:
        return pairs(0)[1].select(*_COLUMNS[1:], "rid")
    found = []
    for b in range(blocks):  # one block at a time is in memory, here and on the executors
        sent, part = pairs(b)
        found.append(save(part))
        sent.unpersist(blocking=True)
    return reduce(DataFrame.unionByName, found).select(*_COLUMNS[1:], "rid")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated documents; edge cases as for contaminated()."""
    rows = numbered(docs, "__loom_rid")
    with scope():
        bad = save(contaminated(rows, benchmark, **options).select(F.col("rid").alias("__loom_bad")).distinct(), keep=True)
    return rows.join(checked_broadcast(bad), F.col("__loom_rid") == F.col("__loom_bad"), "left_anti").drop("__loom_rid")
