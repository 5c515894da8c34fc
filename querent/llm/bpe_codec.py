"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved until the parts are leaves; leaves are encoded by themselves. Joining two neighbours
re-encodes a window around the seam that grows until what lies outside provably stands:

- left: where a match of the split pattern starts depends on nothing before it, and where it ends on at
  most REACH characters past its end, so all matches of the left part that end that far before the seam stand;
- right: matching from a given place depends only on the text after it, so once a match of the window ends
  where a match of the right part starts, all matches of the right part from there on stand.

Inside one long match the same is done with tokens (bpe.Coder.join). Decoding concatenates up the tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm.bpe import PATTERN, Coder, coder
from querent.llm.common import once, text_of

#: Code points of a leaf.
LEAF = 4096
#: Code points after a match's start or end that can decide where it ends: the longest contraction.
REACH = 3


class Part:
    """The encoding of text[lo:hi] by itself: ids, starts of its matches (in the text), and where each match's ids start."""

    __slots__ = ("at", "hi", "ids", "lo", "starts")

    def __init__(self, lo: int, hi: int, ids: np.ndarray, starts: np.ndarray, at: np.ndarray):
        self.lo, self.hi, self.ids, self.starts, self.at = lo, hi, ids, starts, at


def leaves(n: int, size: int = LEAF) -> list[tuple[int, int]]:
    """Bounds of a text's leaves, from halving."""
    if n <= size:
        return [(0, n)]
    half = n // 2
    return leaves(half, size) + [(half + a, half + b) for a, b in leaves(n - half, size)]


def join(text: str, left: Part, right: Part, code: Coder) -> Part:
    """The encoding of two neighbours' text."""
    import regex

    if left.lo == left.hi or right.lo == right.hi:
        return right if left.lo == left.hi else left
    pattern = once("pattern", lambda: regex.compile(PATTERN))
    i = int(np.searchsorted(left.starts, left.hi - REACH, side="right")) - 1
    i = max(i, 0)
    start = int(left.starts[i])
    width = 64
    while True:
        end = min(right.lo + width, right.hi)
        window, places, synced = [], [], None
        for m in pattern.finditer(text, start, end):
            a = m.start()
            if a >= right.lo:
                # A match start of both: nothing after it differs.
                k = int(np.searchsorted(right.starts, a))
                if k < len(right.starts) and right.starts[k] == a:
                    synced = k
                    break
            if end < right.hi and m.end() > end - REACH:
                break  # not decided inside this window
            window.append(m[0])
            places.append(a)
        else:
            if end == right.hi:
                synced = len(right.starts)
        if synced is not None:
            break
        width *= 4
    lists = [code.encode_match(s) for s in window]
    sizes = np.array([len(x) for x in lists], np.int64)
    middle = np.array([x for part in lists for x in part], np.uint32)
    cut = int(left.at[i])
    begin = int(right.at[synced]) if synced < len(right.at) else len(right.ids)
    return Part(
        left.lo, right.hi,
        np.concatenate([left.ids[:cut], middle, right.ids[begin:]]),
        np.concatenate([left.starts[:i], np.array(places, np.int64), right.starts[synced:]]),
        np.concatenate([left.at[:i], cut + np.cumsum(sizes) - sizes, right.at[synced:] + (cut + len(middle) - begin)]),
    )


def reduce_tree(text: str, parts: list[Part], code: Coder) -> Part:
    """Neighbours joined, halves first, up to the whole text."""
    if len(parts) == 1:
        return parts[0]
    mid = next((k for k in range(1, len(parts)) if parts[k].lo == (parts[0].lo + parts[-1].hi) // 2), len(parts) // 2)
    return join(text, reduce_tree(text, parts[:mid], code), reduce_tree(text, parts[mid:], code), code)


def encode_texts(texts: list[str], code: Coder, size: int = LEAF) -> list[np.ndarray]:
    """The ids of each text."""
    bounds = [leaves(len(t), size) for t in texts]
    cut = [t[a:b] for t, own in zip(texts, bounds, strict=True) for a, b in own]
    ids, at, starts, piece_at = code.encode_many(cut)
    lengths = np.array([len(c) for c in cut], np.int64)
    code_at = np.cumsum(lengths) - lengths
    first = np.searchsorted(starts, np.r_[code_at, lengths.sum()])
    out, leaf = [], 0
    for text, own in zip(texts, bounds, strict=True):
        parts = []
        for a, b in own:
            p, q = first[leaf], first[leaf + 1]
            parts.append(Part(a, b, ids[at[leaf] : at[leaf + 1]], starts[p:q] - code_at[leaf] + a, piece_at[p:q] - at[leaf]))
            leaf += 1
        out.append(reduce_tree(text, parts, code).ids)
    return out


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        name = once(("decimal", path), lambda: {i: str(i) for i in code.bytes_of})
        for batch in batches:
            texts, n, ids_sha, text_sha = batch.column("text").to_pylist(), [], [], []
            at = 0
            while at < len(texts):
                to, held = at, 0
                while to < len(texts) and (to == at or held + len(texts[to]) <= 2_000_000):
                    held += len(texts[to])
                    to += 1
                for ids in encode_texts(texts[at:to], code):
                    own = ids.tolist()
                    n.append(len(own))
                    ids_sha.append(hashlib.sha256(",".join(map(name.__getitem__, own)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(code.decode(own)).hexdigest())
                at = to
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        code.forget()

    return run


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in batches:
            found = encode_texts(batch.column("text").to_pylist(), code)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _texts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in batches:
            found = [code.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "data"])

    return run


def _input(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))


def encode(docs: DataFrame, ranks: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids) of every row; null and empty texts have no ids. Rows stay one to one, null and repeated ids too."""
    return _input(docs, id_column, text_column).mapInArrow(_ids(ranks), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, data binary) of (doc_id, ids); null ids decode to no bytes, an unknown id raises."""
    return encoded.select("doc_id", "ids").mapInArrow(_texts(ranks), "doc_id long, data binary")


def digests(docs: DataFrame, ranks: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, encoded and decoded again in one pass."""
    return _input(docs, id_column, text_column).mapInArrow(_digests(ranks), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_ranks() -> str:
    """The public rank file that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op3_byte_bpe_codec(spark, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of all documents."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_ranks())
