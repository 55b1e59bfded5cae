"""Token ids in files: documents encoded in order of doc_id, in shards that Re-Pair grammars compress.

A file's row is a block of whole documents. Its ids are a sequence of symbols; symbols from BASE on stand for rules of the
block's own, each a pair of symbols. With every rule lies the number of ids that it expands to, so ids i to j of a document are
found by adding lengths, and only the symbols that cover them are expanded.
"""

from __future__ import annotations

import gc
import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain, count, islice, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._rows import checked_broadcast, lean, numbered, send

#: The id that ends each document.
END = 0
#: Bytes of text in a shard on average, and ids in a block (or one document).
SHARD_BYTES, BLOCK_IDS = 8 << 20, 1 << 20
#: Bytes of text to a byte of a table's files, about.
UNPACKED = 2
#: Bytes of text that are encoded at once (or one text).
BATCH_BYTES = 16 << 20
#: A pair that occurs less often in a block is no rule. A pass replaces pairs in falling order of their counts, until they
#: stand at one place of COVER; the last pass is one that shortens the sequence by less than one of ENOUGH.
LEAST, COVER, ENOUGH = 4, 8, 128
#: Pieces of text whose ids an encoder remembers, and characters that are cut into pieces at once.
REMEMBERED, CUT = 500_000, 1 << 20
#: Fixed value: the characters that Unicode calls white space.
SPACE = "\t-\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECE, _EDGE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"), re.compile(f"[^{SPACE}](?=[{SPACE}])")
#: Letters of which alone words are made that the model gets without the tokenizer's own splitting.
_LETTERS = "".join(c for c in map(chr, range(0x100)) if c.isascii() and c.isalpha() or c.isalpha() and ord(c) >= 0xC0)
_STEM = re.compile(f" ?[{_LETTERS}]+(?=$|[\\x21-\\x40\\x5B-\\x60\\x7B-\\x7E])")
#: The same for the other pattern language: a space before white space.
_WIDE = " [\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: Pairs are first counted in a hash table of 2 ** _BINS numbers.
_BINS = 19
_SCHEMA = (
    "shard int, block int, first_doc long, last_doc long, n_ids long, doc_ids array<long>, sizes array<long>, "
    "ends array<long>, left binary, right binary, lengths binary, sequence binary"
)
#: This process's encoder, by the tokenizer's file.
_ENCODER: dict[str, Encoder] = {}


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stretches of flat one after the other, the length of each), by their numbers in starts and sizes."""
    sizes = sizes.take(numbers)
    ends = np.cumsum(sizes)
    return flat.take(np.repeat(starts.take(numbers) - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)), sizes


class Encoder:
    """Ids of texts. Where the tokenizer splits at white space before it merges bytes, texts are cut into pieces that begin
    with white space, and each distinct piece is encoded once and remembered; other tokenizers encode whole texts."""

    def __init__(self, file: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file)
        made = json.loads(file)
        before = made.get("pre_tokenizer") or {}
        # such a tokenizer's pattern never joins a character with white space after it, so it splits where pieces begin
        self.by_piece = not made.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        self.letters = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in _LETTERS + " "} if self.by_piece else {}
        self.known: dict[str, int] = {}
        self.rests: dict[str, tuple[int, ...]] = {}
        self.flat, self.starts, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces not yet known. A word that ends before an ASCII character that is no letter is one pre-token, for the
        model itself; what follows it, and all other pieces, are for the whole tokenizer."""
        cuts = [m.end() if m else 0 for m in map(_STEM.match, pieces)]
        heads, tails = [p[:n] for p, n in zip(pieces, cuts)], [p[n:] for p, n in zip(pieces, cuts)]
        del cuts
        head_of, tail_of = (dict(zip(dict.fromkeys(x), count())) for x in (heads, tails))
        if len(self.rests) > REMEMBERED // 4:
            self.rests = {}
        new = [r for r in tail_of if r and r not in self.rests]
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            self.rests.update((r, tuple(e.ids)) for r, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)))
        self.rests[""] = ()
        tokenize, letters, id_of = self.tokenizer.model.tokenize, self.letters, attrgetter("id")
        space = letters.get(32, "")
        plain = (space + h[1:] if h[0] == " " and h.isascii() else h.translate(letters) for h in head_of if h)
        spelled = [tuple(map(id_of, tokenize(w))) for w in plain]
        if "" in head_of:
            spelled.insert(head_of[""], ())
        spelled += map(self.rests.__getitem__, tail_of)
        sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
        flat = np.fromiter(chain.from_iterable(spelled), np.int32, int(sizes.sum()))
        parts = np.empty(2 * len(pieces), np.int64)
        parts[::2] = np.fromiter(map(head_of.__getitem__, heads), np.int64, len(pieces))
        parts[1::2] = np.fromiter(map(tail_of.__getitem__, tails), np.int64, len(pieces)) + len(head_of)
        del spelled, heads, tails
        ids, sizes = _gather(flat, np.cumsum(sizes) - sizes, sizes, parts)
        sizes = sizes[::2] + sizes[1::2]
        self.starts, self.sizes = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes]), np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, ids])

    def _ids(self, pieces: list[str]) -> np.ndarray:
        """Numbers of pieces, which hold until the next call. As long as there is room, new ones are remembered."""
        kept = len(self.known)
        self.starts, self.sizes = self.starts[:kept], self.sizes[:kept]
        self.flat = self.flat[: int(self.starts[-1] + self.sizes[-1]) if kept else 0]
        numbers = np.array(list(map(self.known.get, pieces, repeat(-1))), np.int64)
        if len(at := np.flatnonzero(numbers < 0)):
            unknown = [pieces[i] for i in at]
            new = dict(zip(fresh := list(dict.fromkeys(unknown)), range(kept, kept + len(fresh))))
            collects = gc.isenabled()
            gc.disable()  # no cycles are made here, and looking for them among so many texts takes long
            try:
                self._learn(fresh)
            finally:
                if collects:
                    gc.enable()
            numbers[at] = list(map(new.__getitem__, unknown))
            self.known.update(islice(new.items(), max(0, REMEMBERED - kept)))
        return numbers

    def _spelled(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of pieces one after the other, how many each has)."""
        return _gather(self.flat, self.starts, self.sizes, numbers)

    def _cut(self, text: str) -> Iterator[np.ndarray]:
        at = 0
        while at < len(text):
            edge = _EDGE.search(text, at + CUT)
            to = edge.end() if edge else len(text)
            yield self._spelled(self._ids(_PIECE.findall(text, at, to)))[0]
            at = to

    def _single(self, text: str) -> np.ndarray:
        """The text's ids and END."""
        if not self.by_piece:
            return np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, END], np.int32)
        return np.concatenate([*self._cut(text), [END]]).astype(np.int32)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, and END. Texts in which no space stands before white space are cut at their spaces all at once."""
        wide = pc.fill_null(pc.match_substring_regex(texts, _WIDE), False).to_numpy(zero_copy_only=False)
        even = ~wide & (pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) > 0) & bool(self.by_piece)
        out = [np.array([END], np.int32)] * len(texts)
        for i in np.flatnonzero(~even):
            if text := texts[i].as_py():
                out[i] = self._single(text)
        if even.any():
            words = pc.split_pattern(texts.filter(pa.array(even)), " ")
            coded = words.values.dictionary_encode()
            begins = words.offsets.to_numpy()[:-1] - words.offsets[0].as_py()
            spelled = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            place = coded.indices.to_numpy().astype(np.int64)
            first = np.unique(place[begins])  # words at the beginning of a text have no space before them
            numbers = self._ids([" " + w for w in spelled] + [spelled[i] for i in first])
            place[begins] = len(spelled) + np.searchsorted(first, place[begins])
            ids, sizes = self._spelled(numbers[place])
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.append(begins[1:], len(place))]
            for i, a, z in zip(np.flatnonzero(even), np.concatenate([[0], ends[:-1]]), ends):
                out[i] = np.append(ids[a:z], np.int32(END))
        return out


def encoder(file: str) -> Encoder:
    if file not in _ENCODER:
        _ENCODER.clear()
        _ENCODER[file] = Encoder(file)
    return _ENCODER[file]


def _frequent(seq: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, the pair at each place, places) of the most frequent pairs of seq, those that stand at one place of COVER, if
    so many occur least times. No pair lies over one of ends."""
    x = seq.view(np.uint32)
    bins = x[:-1] * np.uint32(0x9E3779B1)
    bins += x[1:] * np.uint32(0x85EBCA6B)
    bins >>= np.uint32(32 - _BINS)
    bins = bins.view(np.int32)
    bins[ends[:-1] - 1] = 1 << _BINS  # a bin of their own for places that are none
    counts = np.bincount(bins, minlength=(1 << _BINS) + 1)
    counts[-1] = 0
    full = np.sort(counts[counts >= least])[::-1]
    if not len(full):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    bound = full[min(np.searchsorted(np.cumsum(full), len(seq) // COVER), len(full) - 1)]
    places = np.flatnonzero((counts >= bound)[bins])
    keys, bins = (seq[places].astype(np.int64) << 32) | seq[places + 1], bins[places]
    own = np.empty(len(counts), np.int64)
    own[bins] = keys  # of several pairs in a bin one has it in this pass
    mine = own[bins] == keys
    places, bins = places[mine], bins[mine]
    counts = np.bincount(bins, minlength=len(counts))
    kept = np.flatnonzero(counts >= min(bound, max(least, counts.max())))
    number = np.full(len(counts), -1, np.int32)
    number[kept] = np.arange(len(kept))
    number = number[bins]
    return own[kept], number[number >= 0], places[number >= 0]


def compress(ids: np.ndarray, ends: np.ndarray, base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair of documents that end at ends in ids: (left, right and length of each rule, sequence, ends in the sequence).

    Pass by pass the most frequent pairs become rules, from the left and without overlap, until hardly any pair occurs least
    times. No rule crosses the end of a document."""
    seq, ends, made = ids.astype(np.int32), ends.astype(np.int64), base
    left, right, lengths = [np.empty(0, np.int64)], [np.empty(0, np.int64)], np.ones(base, np.int64)
    while len(seq) > 1:
        pairs, number, places = _frequent(seq, ends, least)
        if not len(pairs):
            break
        new = np.concatenate([[True], np.diff(places) > 1])  # runs of neighbouring places: every second one is taken
        first = np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))
        taken = (np.arange(len(places)) - first) % 2 == 0
        places, number = places[taken], number[taken]
        use = np.bincount(number, minlength=len(pairs)) >= 2
        if not use.any():
            break
        used = use[number]
        places, number, pairs = places[used], (np.cumsum(use) - 1)[number[used]], pairs[use]
        a, b = pairs >> 32, pairs & 0xFFFFFFFF
        left.append(a), right.append(b)
        lengths = np.concatenate([lengths, lengths[a] + lengths[b]])
        seq[places] = made + number
        keep = np.ones(len(seq), bool)
        keep[places + 1] = False
        seq, ends = seq[keep], ends - np.searchsorted(places, ends - 1)
        made += len(pairs)
        if len(places) * ENOUGH < len(seq):
            break
    return np.concatenate(left), np.concatenate(right), lengths[base:], seq.astype(np.int64), ends


def expand(sequence: np.ndarray, left: np.ndarray, right: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for."""
    ruled, plain = np.flatnonzero(sequence >= base), np.flatnonzero(sequence < base)
    used = np.zeros(len(left), bool)
    used[sequence[ruled] - base] = True
    of = np.flatnonzero(used)
    seq = of + base  # each rule in use is expanded once, level by level, then copied to where it stands
    while len(deep := np.flatnonzero(seq >= base)):
        counts = np.ones(len(seq), np.int64)
        counts[deep] = 2
        to = np.cumsum(counts) - counts
        out = np.empty(len(seq) + len(deep), np.int64)
        out[to] = seq
        out[to[deep]], out[to[deep] + 1] = left[seq[deep] - base], right[seq[deep] - base]
        seq = out
    begins = np.zeros(len(left), np.int64)
    begins[of] = np.cumsum(lengths[of]) - lengths[of]
    sizes, starts = np.ones(len(sequence), np.int64), np.empty(len(sequence), np.int64)
    sizes[ruled], starts[ruled] = lengths[sequence[ruled] - base], begins[sequence[ruled] - base]
    starts[plain] = len(seq) + np.arange(len(plain))
    ends = np.cumsum(sizes)
    ids = np.concatenate([seq, sequence[plain]]).astype(np.int32)
    return ids[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _pack(x: np.ndarray) -> bytes:
    return x.astype("<u4").tobytes()


def _unpack(x) -> np.ndarray:
    return np.frombuffer(x.as_buffer() if isinstance(x, pa.Scalar) else x, "<u4").astype(np.int64)


def _block(shard: int, number: int, doc_ids: list, parts: list[np.ndarray], base: int, least: int) -> pa.RecordBatch:
    sizes = np.array([len(p) for p in parts], np.int64)
    left, right, lengths, sequence, ends = compress(np.concatenate(parts), np.cumsum(sizes), base, least)
    known = [d for d in doc_ids if d is not None]
    values = (shard, number, min(known, default=None), max(known, default=None), int(sizes.sum()), doc_ids, sizes.tolist(), ends.tolist(), *map(_pack, (left, right, lengths, sequence)))
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _ARROW.types)], schema=_ARROW)


_LONGS = pa.list_(pa.int64())
_ARROW = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_ids", pa.int64())]
    + [(n, _LONGS) for n in ("doc_ids", "sizes", "ends")] + [(n, pa.binary()) for n in ("left", "right", "lengths", "sequence")]
)


def _writer(file, least: int, block_ids: int):
    def write_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = encoder(file.value), TaskContext.get().partitionId()
        base = own.tokenizer.get_vocab_size(with_added_tokens=True)
        doc_ids, parts, size, number = [], [], 0, 0
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), own.encode(batch.column("text"))):
                if parts and size + len(ids) > block_ids:
                    yield _block(shard, number, doc_ids, parts, base, least)
                    doc_ids, parts, size, number = [], [], 0, number + 1
                doc_ids.append(doc_id)
                parts.append(ids)
                size += len(ids)
        if parts:
            yield _block(shard, number, doc_ids, parts, base, least)

    return write_blocks


def write(docs: DataFrame, path: str, tokenizer: str, least: int = LEAST, block_ids: int = BLOCK_IDS, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode every text of docs (doc_id, text) with the tokenizer in a local file and write the ids to a new folder.

    Documents lie in ascending order of doc_id, nulls first, rows of one doc_id in the order of docs' files. Shards are
    ranges of that order of about shard_bytes; each task writes one, and Spark's committer publishes whole files only, so a
    task that runs twice leaves one shard. A block holds at most block_ids ids, or one document.

    Null and empty texts are their END alone; repeated rows are written each; an empty table writes no blocks. The
    tokenizer's file is read on the driver and sent; its size is fixed. Other columns are ignored.
    """
    with open(tokenizer, encoding="utf-8") as f:
        file = send(docs.sparkSession, f.read())
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "place")
    about = rows.metadataColumn("_metadata")  # sizes of files, for which no text is read
    size = rows.select(about["file_path"], about["file_size"].alias("size")).distinct().agg(F.sum("size")).first()[0] or 0
    order = F.col("doc_id").asc_nulls_first(), F.col("place")
    dealt = rows.repartitionByRange(1 + UNPACKED * size // shard_bytes, *order).sortWithinPartitions(*order)
    dealt.mapInArrow(lean(_writer(file, least, block_ids), 1 << 16, BATCH_BYTES), _SCHEMA).write.parquet(path)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the files in path, with the number of ids before each block in column before."""
    files = spark.read.schema(_SCHEMA).parquet(path)
    # sums in runs of 1024 shards, then over the runs
    sizes = files.select("shard", "block", "n_ids").withColumn("run", F.expr("shard div 1024"))
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = sizes.groupBy("run").agg(F.sum("n_ids").alias("run_ids"))
    runs = runs.select("run", earlier("run_ids", Window.orderBy("run")).alias("before_run"))
    sizes = sizes.withColumn("within", earlier("n_ids", Window.partitionBy("run").orderBy("shard", "block"))).join(runs, "run")
    sizes = sizes.select("shard", "block", (F.col("before_run") + F.col("within")).alias("before"))
    return files.join(checked_broadcast(sizes), ["shard", "block"])


def _decoder(base: int, digest: bool):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c: batch.column(c)[row]  # noqa: B023, E731
                ids = expand(*(_unpack(get(c)) for c in ("sequence", "left", "right", "lengths")), base).astype("<u4")
                sizes = get("sizes").values.to_numpy()
                ends = np.cumsum(sizes)
                starts = ends - sizes
                columns = [get("doc_ids").values, pa.array(get("before").as_py() + starts), pa.array(sizes)]
                if digest:
                    raw = memoryview(ids.tobytes())
                    columns.append(pa.array(np.fromiter((zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(starts, ends)), np.int64, len(ends))))
                else:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return decode


def _base(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True)


def read(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """Every document of the files in path: doc_id, start (ids of all documents before it), n_tokens (with END), ids."""
    return blocks(spark, path).mapInArrow(_decoder(_base(tokenizer), False), "doc_id long, start long, n_tokens long, ids array<int>")


def digests(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """As read(), with ids_crc32, the crc32 of the document's ids as little-endian 32-bit numbers, in place of ids."""
    return blocks(spark, path).mapInArrow(_decoder(_base(tokenizer), True), "doc_id long, start long, n_tokens long, ids_crc32 long")


def span(sequence: np.ndarray, left: np.ndarray, right: np.ndarray, lengths: np.ndarray, base: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of what a sequence expands to: the symbols that cover them are found by their lengths, and only a
    symbol's sides that reach into the span are followed."""
    size = np.where(sequence >= base, lengths[np.maximum(sequence - base, 0)] if len(lengths) else 1, 1)
    ends = np.cumsum(size)
    a, z = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
    skip = start - int(ends[a] - size[a]) if a < len(ends) else 0
    return expand(sequence[a:z], left, right, lengths, base)[skip : skip + max(stop - start, 0)]


def fetch(spark: SparkSession, path: str, tokenizer: str, doc_ids: list[int], start: int, stop: int) -> DataFrame:
    """Ids start to stop of some documents: doc_id, ids. Only blocks whose range of doc_ids holds one of them are read."""
    base, wanted = _base(tokenizer), sorted({int(d) for d in doc_ids})
    near = F.lit(False)
    for d in wanted:
        near = near | ((F.col("first_doc") <= d) & (F.col("last_doc") >= d))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c: batch.column(c)[row]  # noqa: B023, E731
                sequence, left, right, lengths = (_unpack(get(c)) for c in ("sequence", "left", "right", "lengths"))
                ends, sizes = get("ends").values.to_numpy(), get("sizes").values.to_numpy()
                for i, doc_id in enumerate(get("doc_ids").as_py()):
                    if doc_id in wanted:
                        own = sequence[ends[i - 1] if i else 0 : ends[i]]
                        ids = span(own, left, right, lengths, base, max(start, 0), min(stop, int(sizes[i])))
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id]), "ids": pa.array([ids.tolist()], pa.list_(pa.int32()))})

    return spark.read.schema(_SCHEMA).parquet(path).filter(near).mapInArrow(cut, "doc_id long, ids array<int>")
