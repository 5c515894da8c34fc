"""SimHash near-dedup by anchor-point covering.

Fingerprints are 64-bit majorities over shingle hashes. Two of them link when they differ in at most two
bits. The anchors are the codewords of two binary Golay codes side by side, over bits 0-22 and 23-45: a
perfect code of covering radius 3 in each half, so every fingerprint has one home anchor. If x and y differ
in d1 bits of one half and d2 of the other, then x's home lies within 3 + d1 and 3 + d2 of y. Each
fingerprint is therefore replicated to all anchors within 3 + d1 and 3 + d2 for some d1 + d2 <= 2: about 61
of 2^24, and every pair that must link meets at the home anchor of either side.

Only distinct fingerprints are replicated, so copies cost one row. At an anchor, small groups compare all
members, larger ones grow a spanning forest by breadth-first search, very large ones look up each member's
2080 neighbours; each emits links, never all pairs of a cluster, and no link between clusters is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm.common import connected_components, materialize, once, text_of

#: Fingerprints link at so many differing bits or fewer.
MAX_BITS = 2
#: Hash seed of the shingles.
SEED = 42
#: Groups at an anchor up to this size compare all members; up to the next, they search breadth-first.
SMALL, LARGE = 24, 16_384


def fingerprint(text: str, width: int) -> int:
    """The SimHash of one text, unsigned. No words: zero."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_digest, b" ".join
    if len(words) < width:
        hashes = digest(join(words), SEED)
    else:
        hashes = b"".join([digest(join(s), SEED) for s in zip(*(words[i:] for i in range(width)), strict=False)])
    n = len(hashes) // 8
    # Ones are counted in slices, so a very long text needs no more memory than a slice.
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        part = np.frombuffer(hashes, np.uint8, count=min(65_536, n - at) * 8, offset=at * 8)
        ones += np.unpackbits(part).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t.as_py(), width) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("id"), pa.array(marks.view(np.int64))], ["rid", "id", "fp"])

    return run


# --- anchors ---------------------------------------------------------------------------------------


def _golay() -> dict[str, np.ndarray]:
    """Error patterns of the perfect (23, 12) code by syndrome: start and patterns for shells 0 (the home), 1 and 2."""
    generator, shells = 0b101011100011, {0: [], 1: [], 2: []}  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
    value = np.arange(1 << 23, dtype=np.int32)
    weight = np.bitwise_count(value)
    light = value[weight <= 5]
    weight = weight[weight <= 5]
    syndrome = _remainder(light, generator)
    out = {}
    for shell in shells:
        own = (weight <= 3) if shell == 0 else (weight == 3 + shell)
        order = np.argsort(syndrome[own], kind="stable")
        out[f"e{shell}"] = light[own][order]
        out[f"s{shell}"] = np.searchsorted(syndrome[own][order], np.arange((1 << 11) + 1)).astype(np.int64)
    return out


def _remainder(word: np.ndarray, generator: int) -> np.ndarray:
    rest = word.astype(np.int32).copy()
    for bit in range(22, 10, -1):
        rest ^= ((rest >> bit) & 1) * np.int32(generator << (bit - 11))
    return rest


def _near(word: np.ndarray, shell: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into word, 12-bit anchor) for the anchors in a shell around each 23-bit word."""
    code = once("golay", _golay)
    s = _remainder(word, 0b101011100011)
    start = code[f"s{shell}"][s]
    count = code[f"s{shell}"][s + 1] - start
    index = np.repeat(np.arange(len(word)), count)
    at = np.arange(len(index)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)
    return index, (word[index] ^ code[f"e{shell}"][at]) >> 11


def anchors(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into marks, anchor, whether it is the home anchor) of uint64 fingerprints."""
    halves = [((marks >> np.uint64(shift)) & np.uint64((1 << 23) - 1)).astype(np.int32) for shift in (0, 23)]
    index, anchor, home = [], [], []
    for a in range(MAX_BITS + 1):
        i, first = _near(halves[0], a)
        for b in range(MAX_BITS + 1 - a):
            j, second = _near(halves[1][i], b)
            index.append(i[j])
            anchor.append((first[j].astype(np.int32) << 12) | second.astype(np.int32))
            home.append(np.full(len(j), a + b == 0))
    return np.concatenate(index), np.concatenate(anchor), np.concatenate(home)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            marks = batch.column("fp").slice(at, 4096).to_numpy(zero_copy_only=False)
            i, anchor, home = anchors(marks.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(marks[i]), pa.array(home)], ["anchor", "fp", "home"])


# --- comparing at an anchor ------------------------------------------------------------------------


def _masks() -> np.ndarray:
    one = [1 << i for i in range(64)]
    return np.array(one + [a | b for i, a in enumerate(one) for b in one[:i]], np.uint64)


def _forest(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is within MAX_BITS in a large group of distinct fingerprints."""
    if len(marks) > LARGE:
        marks = np.sort(marks)
        u, v = [], []
        for mask in once("masks", _masks):
            other = marks ^ mask
            at = np.searchsorted(marks, other)
            hit = (at < len(marks)) & (marks[np.minimum(at, len(marks) - 1)] == other) & (other < marks)
            u.append(marks[hit])
            v.append(other[hit])
        return np.concatenate(u), np.concatenate(v)
    rest, u, v = marks, [], []
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            step, front = front[:64], front[64:]
            close = np.bitwise_count(step[:, None] ^ rest[None, :]) <= MAX_BITS
            hit = close.any(axis=0)
            new = rest[hit]
            u.append(new)
            v.append(step[close[:, hit].argmax(axis=0)])
            rest, front = rest[~hit], np.concatenate([front, new])
    return (np.concatenate(u), np.concatenate(v)) if u else (marks[:0], marks[:0])


def links(anchor: np.ndarray, marks: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among the rows of whole anchors, sorted by anchor."""
    starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    sizes = np.diff(np.r_[starts, len(anchor)])
    lively = (sizes > 1) & np.logical_or.reduceat(home, starts)
    u, v = [], []
    small = lively & (sizes <= SMALL)
    for size in np.unique(sizes[small]):
        group = marks[starts[small & (sizes == size)][:, None] + np.arange(size)]
        for i in range(1, size):
            close = np.bitwise_count(group[:, :i] ^ group[:, i : i + 1]) <= MAX_BITS
            row, col = np.nonzero(close)
            u.append(group[row, i])
            v.append(group[row, col])
    for k in np.flatnonzero(lively & (sizes > SMALL)):
        a, b = _forest(marks[starts[k] : starts[k] + sizes[k]])
        u.append(a)
        v.append(b)
    return (np.concatenate(u), np.concatenate(v)) if u else (marks[:0], marks[:0])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; the last anchor of a batch waits for the next batch."""
    held = None

    def found(part: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        u, v = links(*part)
        if len(u):
            pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)]), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column("anchor").to_numpy(), batch.column("fp").to_numpy().view(np.uint64), batch.column("home").to_numpy(zero_copy_only=False)]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if cut:
            yield from found([x[:cut] for x in now])
        held = [x[cut:] for x in now]
    if held is not None:
        yield from found(held)


def fingerprint_links(marks: DataFrame) -> DataFrame:
    """(u, v): links that join all of marks' distinct fp (long) that differ in at most two bits, directly or over others."""
    near = marks.mapInArrow(_replicate, "anchor int, fp long, home boolean")
    dealt = near.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(_compare, "u long, v long")


def simhash_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3) -> DataFrame:
    """One row per row of docs: rid, doc_id, fp (long), fingerprint (hex), component_id.

    Words are runs of anything but space, tab, LF, VT, FF and CR, with A-Z lowered; shingles of width words
    count with repeats. A text of fewer words is one shingle; null and texts without words have fingerprint
    zero and link like any other. component_id is the smallest id reachable over links, null ids left out
    (null only where a component has no other). Repeated rows stay. An empty table gives an empty result.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text"))
    marks = materialize(rows.mapInArrow(_fingerprints(width), "rid long, id long, fp long"), "fingerprints")
    distinct = marks.groupBy("fp").agg(F.min("id").alias("first"))
    distinct = materialize(distinct, "distinct")
    edges = materialize(fingerprint_links(distinct.select("fp")), "links").distinct()
    roots = connected_components(edges)
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    member = materialize(member, "members")
    lowest = member.groupBy("root").agg(F.min("first").alias("component_id"))
    member = member.join(lowest, "root").select("fp", "component_id")
    return marks.join(member, "fp").select("rid", F.col("id").alias("doc_id"), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of documents with its fingerprint and component."""
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")
