"""Best-fit packing of tokenised documents, with swap-based local search.

Lengths are at most one sequence's capacity, so their histogram is bounded whatever the corpus. The driver
packs the histogram: best fit decreasing over groups of equally filled bins, then a local search that
exchanges one item for one, two for one, or moves items between underfull bins whenever the sum of squared
fills grows, until bins run empty. The outcome is a short table of runs (length, first rank, bins, offset);
executors rank the pieces of each length and look their places up in it. No document reaches the driver.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querent.llm.bpe import coder
from querent.llm.common import TEXTS, materialize, text_of, tidy

CAPACITY = 2048
#: The id that ends each document.
END_ID = 0
#: Most steps of the local search for each kind of bin that it starts with, and 100 more kinds.
STEPS = 40
#: Parts into which the ranking of one length is dealt.
SALTS = 512

Pattern = tuple[tuple[int, int], ...]  # (length, how often), longest first


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> Counter[Pattern]:
    """How many bins have each pattern, by best fit decreasing."""
    groups: dict[int, list[list]] = {}  # room left -> [pattern, bins]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = min((r for r in groups if r >= length), default=None)
            if room is None:
                group, room = [(), -(-left // (capacity // length))], capacity
            else:
                group = groups[room].pop()
                if not groups[room]:
                    del groups[room]
            pattern, bins = group
            fits = room // length
            full = min(bins, left // fits)
            if full:
                groups.setdefault(room - fits * length, []).append([(*pattern, (length, fits)), full])
                left -= full * fits
                bins -= full
            if bins and left:
                groups.setdefault(room - left * length, []).append([(*pattern, (length, left)), 1])
                left, bins = 0, bins - 1
            if bins and pattern:
                groups.setdefault(room, []).append([pattern, bins])
    packed: Counter[Pattern] = Counter()
    for same in groups.values():
        for pattern, bins in same:
            packed[pattern] += bins
    return packed


def _fill(pattern: Pattern) -> int:
    return sum(length * k for length, k in pattern)


def _with(pattern: Pattern, out: tuple[int, ...], into: tuple[int, ...]) -> Pattern:
    items = Counter(dict(pattern))
    items.subtract(out)
    items.update(into)
    return tuple(sorted(((a, b) for a, b in items.items() if b > 0), reverse=True))


def least_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> int:
    """Bins that any packing needs: by size in all, and by items too long to share a bin with those of some length or more."""
    length = np.array(sorted(histogram), np.int64)
    count = np.array([histogram[x] for x in length.tolist()], np.int64)
    need = -(-int((length * count).sum()) // capacity)
    half = length > capacity // 2
    for small in {0, *length[~half].tolist()}:
        alone, paired = length > capacity - small, half & (length <= capacity - small)
        rest = ~half & (length >= small)
        room = int((count * (capacity - length))[paired].sum())
        more = -(-max(0, int((length * count)[rest].sum()) - room) // capacity)
        need = max(need, int(count[alone].sum()) + int(count[paired].sum()) + more)
    return need


class _Sums:
    """Lengths of a pattern's items, and of its pairs of items."""

    def __init__(self, pattern: Pattern):
        self.fill = _fill(pattern)
        self.ones = np.array([a for a, _ in reversed(pattern)], np.int64)
        often = np.array([n for _, n in reversed(pattern)], np.int64)
        i, j = np.triu_indices(len(self.ones))
        keep = (i != j) | (often[i] > 1)
        i, j = i[keep], j[keep]
        twos = self.ones[i] + self.ones[j]
        order = np.argsort(twos, kind="stable")
        self.twos = twos[order]
        self.pairs = np.stack([self.ones[i[order]], self.ones[j[order]]], axis=1)
        # What can come back: nothing, one item, two items.
        self.back = np.concatenate([[0], self.ones, self.twos])
        self.kind = np.repeat([0, 1, 2], [1, len(self.ones), len(self.twos)])

    def returned(self, at: int) -> tuple[int, ...]:
        if at == 0:
            return ()
        at -= 1
        return (int(self.ones[at]),) if at < len(self.ones) else tuple(self.pairs[at - len(self.ones)].tolist())


def _best_move(low: _Sums, highs: list[_Sums], capacity: int) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
    """The move out of low that grows the squared fill most: which of highs takes part, what goes there, what comes back.

    One item goes for none, one or two, or two for one. For each item or pair that may come back, the longest that
    then fits is looked up among low's sorted sums: all moves are considered.
    """
    size = [len(h.back) for h in highs]
    back, kind = np.concatenate([h.back for h in highs]), np.concatenate([h.kind for h in highs])
    fill = np.repeat([h.fill for h in highs], size)
    best = (0, 0, 0, False)
    for sums, may, two in ((low.ones, np.ones(len(back), bool), False), (low.twos, kind == 1, True)):
        if not len(sums):
            continue
        at = np.searchsorted(sums, back + capacity - fill, side="right") - 1
        gain = sums[at] - back
        growth = np.where(may & (at >= 0) & (gain > 0), 2 * gain * (fill - low.fill + gain), 0)
        k = int(growth.argmax())
        if growth[k] > best[0]:
            best = (int(growth[k]), k, int(at[k]), two)
    growth, k, at, two = best
    if not growth:
        return None
    first = np.cumsum([0, *size])
    who = int(np.searchsorted(first, k, side="right")) - 1
    out = tuple(low.pairs[at].tolist()) if two else (int(low.ones[at]),)
    return who, out, highs[who].returned(k - int(first[who]))


def local_search(packed: Counter[Pattern], capacity: int = CAPACITY) -> Counter[Pattern]:
    """packed with fewer bins where moves between underfull bins can empty some.

    Equally packed bins move together. Each step grows the sum of squared fills, so the search ends: when no
    packing has fewer bins, when no pair of bins has a move left, or after STEPS steps for each pattern of packed
    and 100 more. Items are never lost.
    """
    packed = Counter(packed)
    histogram: Counter[int] = Counter()
    for pattern, bins in packed.items():
        for length, k in pattern:
            histogram[length] += k * bins
    need, total = least_bins(histogram, capacity), sum(packed.values())
    known = {p: _Sums(p) for p in packed if 0 < _fill(p) < capacity}
    added = list(known)  # patterns in the order in which bins of theirs were added
    seen = dict.fromkeys(known, 0)  # of added, how many the pattern has been tried with as the emptier one
    order = sorted((known[p].fill, p) for p in known)
    steps = STEPS * (len(packed) + 100)
    while total > need and steps:
        steps -= 1
        found = None
        for fill, low in order:
            fresh = dict.fromkeys(added[seen[low] :])
            peers = [p for p in fresh if p in known and known[p].fill >= fill and (p != low or packed[low] > 1)]
            move = _best_move(known[low], [known[p] for p in peers], capacity) if peers else None
            if move:
                who, out, into = move
                found = (low, peers[who], out, into)
                break
            seen[low] = len(added)
        if not found:
            break
        low, high, out, into = found
        bins = packed[low] // 2 if low == high else min(packed[low], packed[high])
        for old, new in ((low, _with(low, out, into)), (high, _with(high, into, out))):
            packed[old] -= bins
            if not packed[old]:
                del packed[old]
                del known[old], order[bisect_left(order, (_fill(old), old))]
            if not new:
                total -= bins
                continue
            packed[new] += bins
            if _fill(new) < capacity:
                if new not in known:
                    known[new] = _Sums(new)
                    seen[new] = 0
                    insort(order, (known[new].fill, new))
                added.append(new)
    return packed


def places(packed: Counter[Pattern]) -> np.ndarray:
    """Rows (length, first rank, how many a bin, first sequence, offset), sorted: where the pieces of each rank of a length go."""
    rows, rank, sequence = [], Counter(), 0
    for pattern in sorted(packed, reverse=True):
        offset = 0
        for length, k in pattern:
            rows.append((length, rank[length], k, sequence, offset))
            rank[length] += k * packed[pattern]
            offset += length * k
        sequence += packed[pattern]
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _tokenise(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            texts = batch.column("text").to_pylist()
            rids, keys = batch.column("rid").to_pylist(), batch.column("id").to_pylist()
            for at, to in _slices(texts):
                ids, bounds = code.encode_added(texts[at:to])
                for k in range(to - at):
                    own = np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(END_ID)).astype("<u4")
                    head = (len(own) - 1) % capacity + 1
                    start = 0
                    for piece, end in enumerate(range(head, len(own) + 1, capacity)):
                        for column, value in zip(out, (rids[at + k], keys[at + k], piece, start, end - start, zlib.crc32(own[start:end])), strict=True):
                            column.append(value)
                        start = end
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["rid", "doc_id", "piece", "start", "length", "ids_crc32"])
        code.forget()

    return run


def _slices(texts: list[str], size: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Bounds of slices of about so many code points."""
    at, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= size:
            yield at, i + 1
            at, n = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _place(table: np.ndarray):
    shift = 1 << 44  # ranks stay below, lengths above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = table[:, 0] * shift + table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            row = table[np.searchsorted(start, length * shift + rank, side="right") - 1]
            turn = rank - row[:, 1]
            per_bin = np.maximum(row[:, 2], 1)
            columns = [batch.column(c) for c in ("rid", "doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(row[:, 3] + turn // per_bin), pa.array(row[:, 4] + turn % per_bin * length)]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of all documents with their places in sequences of at most capacity tokens.

    A document is its ids, added tokens of the tokenizer's file included, and the end id; null and empty
    texts are the end id alone. Only documents longer than capacity are cut, the remainder first. Columns: rid,
    doc_id, piece, start, length, ids_crc32, sequence_id, offset. Repeated rows are packed each for itself, null ids too; an empty table gives none.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text"))
    base = "rid long, doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = materialize(rows.mapInArrow(tidy(_tokenise(tokenizer, capacity), TEXTS), base), "pieces")
    # One row a length, capacity rows at most.
    histogram = {x.length: x.n for x in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = places(local_search(best_fit(histogram, capacity), capacity))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("rid", "piece"), F.lit(SALTS)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("rid", "piece"))
    ranked = salted.withColumn("own", own).join(shift, ["length", "salt"]).withColumn("rank", F.col("shift") + F.col("own") - 1)
    return ranked.select("rid", "doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank")).mapInArrow(
        tidy(_place(table)), base + ", sequence_id long, offset long"
    )


def default_tokenizer() -> str:
    """The public vocabulary that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, default_tokenizer()).drop("rid")
