"""Token counts by offset-mapped attribution: whole documents are encoded once, tokens belong to sections by their spans."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._rows import lean, send

#: A byte-level BPE vocabulary for many languages: lines of a token in base64 and its rank.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A token that crosses into another section counts where it starts, where it ends, or by shares of its bytes.
RULES = ("start", "end", "share")
#: The encoder of the vocabulary that this process used last, by the vocabulary's digest.
_ENCODER: dict[bytes, tuple] = {}


def load(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoder(ranks: dict[bytes, int]):
    """(encode, bytes of each token id)."""
    import tiktoken

    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tiktoken.Encoding("loom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, sizes


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section, from the tokens' end bytes and the sections' end bytes.

    Tokens tile the text, and so do sections; token i lies in sections first[i] to last[i]. A token that crosses a bound is
    counted as crossing in the section where it starts."""
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    first = np.searchsorted(bounds, starts, side="right")
    last = np.searchsorted(bounds, ends - 1, side="right")
    crossing = np.bincount(first[first != last], minlength=len(bounds))
    if rule == "start":
        return np.bincount(first, minlength=len(bounds)).astype(float), crossing
    if rule == "end":
        return np.bincount(last, minlength=len(bounds)).astype(float), crossing
    out = np.bincount(first[first == last], minlength=len(bounds)).astype(float)
    for i in np.flatnonzero(first != last):
        edges = np.concatenate([[starts[i]], bounds[first[i] : last[i]], [ends[i]]])
        out[first[i] : last[i] + 1] += np.diff(edges) / (ends[i] - starts[i])
    return out, crossing


def _sections(text: bytes) -> np.ndarray:
    """End bytes of the sections: lines with their line feeds, the last one up to the end of the text."""
    bounds = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return bounds if len(bounds) and bounds[-1] == len(text) else np.append(bounds, len(text))


def _counter(ranks, rule: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, known = ranks.value
        if key not in _ENCODER:
            _ENCODER.clear()
            _ENCODER[key] = encoder(known)
        encode, sizes = _ENCODER[key]
        for batch in batches:
            ids, held, size = batch.column("doc_id"), [], 0
            for i, text in enumerate(batch.column("text").to_pylist()):
                raw = (text or "").encode()
                bounds = _sections(raw)
                ends = np.cumsum(sizes[np.array(encode(text), np.int64)]) if text else np.empty(0, np.int64)
                n, crossing = attribute(ends, bounds, rule)
                chars = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) if raw else np.zeros(1, np.int64)
                to = chars[np.maximum(bounds - 1, 0)]
                held.append((np.full(len(bounds), i), np.arange(len(bounds)), np.concatenate([[0], to[:-1]]), to, n, crossing))
                size += len(bounds)
                if size > 1 << 16:
                    yield _rows(ids, held)
                    held, size = [], 0
            if held:
                yield _rows(ids, held)

    return count


def _rows(ids: pa.Array, held: list[tuple]) -> pa.RecordBatch:
    at, *columns = (np.concatenate(c) for c in zip(*held))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *(pa.array(c if c.dtype == float else c.astype(np.int64)) for c in columns)], _COLUMNS)


_COLUMNS = ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing"]
_TYPES = "doc_id long, section long, start_char long, end_char long, n_tokens double, n_crossing long"


def count(docs: DataFrame, tokenizer: str = TOKENIZER, rule: str = "start") -> DataFrame:
    """One row for each section of each row of docs: doc_id, section, start_char, end_char, n_tokens, n_crossing.

    A document is encoded whole, once, so tokens that lie over two lines are the ones that a model would see; sections
    (lines, each with its line feed) get them by rule: "start" (where the token's first byte is), "end" (its last byte) or
    "share" (bytes in each section over bytes of the token). Over a document the sections' n_tokens sum to its tokens.
    The vocabulary is read on the driver and sent; its size is fixed by the file.

    Nulls and empty texts have one section of no characters and no tokens; a null doc_id is returned as it is; repeated rows
    are counted each. An empty table gives no rows; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    ranks = load(tokenizer)
    digest = hashlib.blake2b(b"".join(t + b"\n%d\n" % i for t, i in ranks.items())).digest()
    ranks = send(docs.sparkSession, (digest, ranks))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_counter(ranks, rule)), _TYPES)
