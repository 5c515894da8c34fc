"""Repeated windows by winnowed anchors: what substring dedup over words and over bytes have in common.

A document is a sequence of 64-bit symbols. Each window of W symbols has one anchor: the K-gram in it with
the least hash, the rightmost of equal ones. The choice depends on the window alone, so equal windows have
equal anchors at equal places, and consecutive windows mostly share theirs: a seed is an anchor with the
span of all windows that chose it. Equal windows are found among the seeds of one anchor hash only:

1. count the seeds of each hash, combined before the shuffle; only hashes that occur again matter;
2. list those seeds with a hash of the whole span. Equal spans of a hash are one string, with the place of
   its first occurrence and their number;
3. hand the strings, with their text, to the caller in collections of whole groups. It finds the windows of
   each that occur earlier in another string, and those that its own later occurrences repeat;
4. carry the latter over to all occurrences of the string.

A group of more than HOT strings is divided by content before step 3: the windows of a string are cut into
ranges by where the anchor lies in them, and the strings of one range are grouped by the symbols that all
its windows must share. Equal windows stay together. Ranges get narrower until groups are small; at the
last one a group is one window.

Steps 2 and 3 read the texts again instead of storing windows. What passes is chosen by a bitmap of hashes
of a fixed BITS, built on the executors in blocks; a fuller bitmap lets more rows through to the exact
comparisons that follow, it never loses one. A document is told by its id and a hash of its text: of rows with
one id and different texts the smaller hash comes first, and rows equal in both are one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm.bpe import mix
from querent.llm.common import materialize, once, release, text_of, tidy, trim

#: Bits of a bitmap (16 MiB), and of one of the blocks that tasks build.
BITS, BLOCK = 1 << 27, 1 << 16
#: Symbols handled at once; a longer document is a slice by itself.
SLICE = 1 << 16
#: Strings of a group beyond which it is divided, and how much narrower the ranges of places get.
HOT, NARROWER = 400, 4
#: Strings of a collection (whole groups, less than 12,000), of a task, and the most tasks.
COLLECTION, TASK, TASKS = 4000, 8000, 20_000


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0xD6E8FEB86659FD93
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))]) for b in (base, pow(base, -1, 1 << 64)))


class Grams:
    """Hashes of any stretch of a symbol array."""

    def __init__(self, symbols: np.ndarray):
        size = 1 << max(17, int(len(symbols)).bit_length())
        up, self.down = once(("gram powers", size), lambda: _powers(size))
        with np.errstate(over="ignore"):
            self.total = np.r_[np.zeros(1, np.uint64), np.cumsum(symbols * up[: len(symbols)])]

    def every(self, k: int) -> np.ndarray:
        """Scattered hashes of all stretches of k symbols."""
        with np.errstate(over="ignore"):
            x = (self.total[k:] - self.total[:-k]) * self.down[: len(self.total) - k]
            x ^= x >> np.uint64(32)
            x *= np.uint64(0x9E3779B97F4A7C15)
        return x

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))


def _sliding_argmin(key: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each width consecutive keys, the rightmost of equal ones; keys count to their upper 40 bits."""
    n = len(key) - width + 1
    low = np.uint64((1 << 24) - 1)
    place = np.arange(len(key), dtype=np.uint64)
    tagged = (key & ~low) | (low - (place & low))
    pad = -len(key) % width
    blocks = np.r_[tagged, np.full(pad, np.iinfo(np.uint64).max, np.uint64)].reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n], ahead[width - 1 : width - 1 + n])
    found = (low - (least & low)).astype(np.int64)
    # The tag holds the place's lower bits; the place is the one not before the window's start.
    start = np.arange(n, dtype=np.int64)
    return start + ((found - start) & int(low))


def seeds(symbols: np.ndarray, bounds: np.ndarray, window: int, k: int):
    """Grams and, of each seed, (document, hash, first window, last window, anchor) in the concatenated symbols of documents within bounds."""
    grams = Grams(symbols)
    n = len(symbols) - window + 1
    nothing = np.empty(0, np.int64)
    if n <= 0:
        return grams, nothing, nothing.astype(np.uint64), nothing, nothing, nothing
    gram = grams.every(k)
    own = _sliding_argmin(gram, window - k + 1)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:n]
    valid = np.arange(n) + window <= bounds[1:][doc]
    new = np.r_[True, (own[1:] != own[:-1]) | (doc[1:] != doc[:-1]) | ~valid[:-1]] & valid
    first = np.flatnonzero(new)
    closing = np.r_[~valid[1:] | new[1:], True] & valid
    last = np.flatnonzero(closing)
    return grams, doc[first], gram[own[first]], first, last, own[first]


class Bitmap:
    """A fixed number of bits over hashes."""

    def __init__(self, data: bytes):
        self.bits = np.frombuffer(data, np.uint8)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes & np.uint64(BITS - 1)
        return (self.bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots to the bytes of the blocks they lie in."""
    bits = np.zeros(BITS // 8, np.uint8)
    for batch in batches:
        slots = batch.column("slot").to_numpy()
        np.bitwise_or.at(bits, slots >> 3, np.left_shift(1, slots & 7).astype(np.uint8))
    size = BLOCK // 8
    blocks = np.flatnonzero(bits.reshape(-1, size).any(axis=1))
    data = [bits[b * size : (b + 1) * size].tobytes() for b in blocks.tolist()]
    yield pa.RecordBatch.from_arrays([pa.array(blocks.astype(np.int32)), pa.array(data, pa.binary())], ["block", "data"])


def bitmap(hashes: DataFrame, at_once: bool = False):
    """A broadcast Bitmap of the one column h (long). BITS bits reach the driver, whatever the input: at_once in one job, else a part after the other, which takes less memory."""
    slots = hashes.select(F.pmod(F.col("h"), F.lit(BITS)).alias("slot"))
    dealt = slots.repartition((F.col("slot") / BLOCK).cast("int"))
    data = bytearray(BITS // 8)
    blocks = dealt.mapInArrow(_blocks, "block int, data binary")
    for row in blocks.collect() if at_once else blocks.toLocalIterator():
        data[row.block * BLOCK // 8 : (row.block + 1) * BLOCK // 8] = row.data
    try:
        return hashes.sparkSession.sparkContext.broadcast(data)
    finally:
        del data
        trim()


Sequences = Callable[[list[str]], Iterator[tuple[int, int, np.ndarray, np.ndarray]]]
"""Slices of texts: (first text, text after the last, symbols, bounds)."""


def spot(*columns: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of columns of longs."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    found = np.full(len(columns[0]), 42, np.uint64)
    with np.errstate(over="ignore"):
        for column in columns:
            found = found + p5 + np.uint64(8)
            found = turn(found ^ (turn(column.astype(np.int64).view(np.uint64) * p2, 31) * p1), 27) * p1 + p4
            found = (found ^ (found >> np.uint64(33))) * p2
            found = (found ^ (found >> np.uint64(29))) * p3
            found ^= found >> np.uint64(32)
    return found


def _emit(slices: Sequences, window: int, k: int, kept, payload, kind: str):
    """Seeds of texts: their hashes, what they are, or the text of those that stand first, whose documents and places are in the bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passing = Bitmap(kept.value) if kept is not None else None
        for batch in batches:
            if kind == "payload":  # documents in which no string stands first needn't be cut into symbols again
                batch = batch.filter(pa.array(passing.holds(spot(pc.fill_null(batch.column("id"), 0).to_numpy(), batch.column("mark").to_numpy()))))
            texts = batch.column("text").to_pylist()
            ids, marks = batch.column("id"), batch.column("mark")
            numbers = (pc.fill_null(ids, 0).to_numpy(), marks.to_numpy())
            for at, _, symbols, bounds in slices(texts):
                grams, doc, name, first, last, anchor = seeds(symbols, bounds, window, k)
                start = first - bounds[doc]
                if passing is not None:
                    own = passing.holds(spot(*(n[doc + at] for n in numbers), start) if kind == "payload" else name)
                    doc, name, first, last, anchor, start = (x[own] for x in (doc, name, first, last, anchor, start))
                columns = {"g": pa.array(name.view(np.int64))}
                if kind != "hash":
                    row = pa.array(doc + at)
                    columns |= {
                        "name": pa.array(grams.of(first, last + window).view(np.int64)), "id": ids.take(row), "mark": marks.take(row),
                        "start": pa.array(start.astype(np.int32)), "windows": pa.array((last - first + 1).astype(np.int32)),
                    }
                if kind == "payload":
                    columns["reach"] = pa.array((anchor - first).astype(np.int32))
                    columns["payload"] = pa.array(payload(symbols, texts, at, doc, bounds, first, last), pa.binary())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return tidy(run)


_SEED = "g long, name long, id long, mark long, start int, windows int"
#: A string: its group and name, its first place, how many places it has, its windows, the symbols before its anchor, its text.
_STRING = "g long, name long, id long, mark long, start int, n long, windows int, reach int, payload binary"


def documents(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, mark, text): what tells a document, and its text."""
    text = text_of(text_column)
    return docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def place(*columns: str) -> F.Column:
    """What orders occurrences: earlier documents first, then earlier starts."""
    return F.struct(*(columns or ("id", "mark", "start")))


Compare = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]]
"""Of whole groups' strings, the documents and starts of their places, groups, windows and reaches: stretches (string, first
window, how many) of all that an earlier string has too, and of all windows there are."""


def stretches(string: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first, how many) of consecutive windows of each string."""
    order = np.lexsort((window, string))
    string, window = string[order], window[order]
    head = np.flatnonzero(np.r_[True, (string[1:] != string[:-1]) | (window[1:] != window[:-1] + 1)])
    if not len(string):
        head = head[:0]
    return string[head], window[head], np.diff(np.r_[head, len(string)])


def merged(string: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches with adjacent ones of a string as one; none overlap."""
    order = np.lexsort((first, string))
    string, first, count = string[order], first[order], count[order]
    head = np.flatnonzero(np.r_[True, (string[1:] != string[:-1]) | (first[1:] != first[:-1] + count[:-1])][: len(string)])
    total = np.r_[0, np.cumsum(count)]
    return string[head], first[head], total[np.r_[head[1:], len(string)]] - total[head]


def _whole(table: pa.Table) -> pa.Table:
    """The strings among sorted rows: whole ones, and pairs of a row with n and one with the text of the same place."""
    n, bare = table.column("n").to_numpy(), table.column("payload").is_null().to_numpy()
    same = np.ones(max(0, len(n) - 1), bool)
    for name in ("g", "name", "id", "mark", "start"):
        column = table.column(name)
        if name == "id":
            valid = column.is_valid().to_numpy()
            same &= valid[1:] == valid[:-1]
            column = pc.fill_null(column, 0)
        column = column.to_numpy()
        same &= column[1:] == column[:-1]
    text = np.r_[False, same & bare[:-1]] & ~bare & (n == 0)
    n = np.where(text, np.r_[0, n[:-1]], n)
    table = table.set_column(table.schema.get_field_index("n"), "n", pa.array(n))
    return table.filter(pa.array(text | (~bare & (n > 0))))


def _compared(compare: Compare):
    """Verdicts on sorted strings: own stretches of first occurrences, and what later occurrences repeat."""
    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = _whole(table)
        if not table.num_rows:
            return
        g, mark, start, n, windows, reach = (table.column(c).to_numpy() for c in ("g", "mark", "start", "n", "windows", "reach"))
        id_, valid = pc.fill_null(table.column("id"), 0).to_numpy(), table.column("id").is_valid().to_numpy()
        order = np.lexsort((mark, id_, valid))
        changed = (mark[order][1:] != mark[order][:-1]) | (id_[order][1:] != id_[order][:-1]) | (valid[order][1:] != valid[order][:-1])
        doc = np.empty(len(order), np.int64)
        doc[order] = np.r_[0, np.cumsum(changed)]
        found, every = compare(table.column("payload").to_pylist(), doc, start.astype(np.int64), g, windows.astype(np.int64), reach.astype(np.int64))
        many = n[every[0]] > 1
        for later, (string, first, count) in enumerate((found, tuple(x[many] for x in every))):
            columns = table.select(["g", "name", "id", "mark", "start"]).take(pa.array(string)).combine_chunks().to_batches()
            for part in columns:
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(np.full(len(first), bool(later)))],
                    ["g", "name", "id", "mark", "start", "shift", "windows", "later"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < 2 * COLLECTION:
                continue
            table = pa.Table.from_batches(held)
            g = table.column("g").to_numpy()
            cut = int(np.searchsorted(g, g[-1]))  # the last group may go on
            if cut:
                yield from done(table.slice(0, cut).combine_chunks())
            held, rows = table.slice(cut).to_batches(), table.num_rows - cut
        if rows:
            yield from done(pa.Table.from_batches(held).combine_chunks())

    return tidy(run), "g long, name long, id long, mark long, start int, shift int, windows int, later boolean"


def _split(window: int, width: int, cut: Callable[[bytes, int, int], bytes]):
    """Strings to their stretches of windows whose anchor lies in one range of width places, grouped by what these must share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out: list[tuple] = []
            for g, name, id_, mark, start, n, windows, reach, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for q in range((reach - windows + 1) // width, reach // width + 1):
                    low, high = max(q * width, reach - windows + 1), min((q + 1) * width - 1, reach)
                    shift = reach - high
                    own = cut(payload, shift, reach - low + window)
                    core = cut(own, high - q * width, high - (q + 1) * width + 1 + window)
                    group = xxhash.xxh64_intdigest(core, (g ^ q) % (1 << 64))
                    out.append((group, xxhash.xxh64_intdigest(own, high), id_, mark, start + shift, n, high - low + 1, high, own, g, name, shift))
            columns = [list(c) for c in zip(*out, strict=True)] or [[] for _ in range(12)]
            columns[:2] = [np.array(c, np.uint64).view(np.int64) for c in columns[:2]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [*(x.split()[0] for x in _STRING.split(", ")), "g0", "name0", "shift"])

    return run, f"{_STRING}, g0 long, name0 long, shift int"


def _routed(hot, wanted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = Bitmap(hot.value)
        for batch in batches:
            yield batch.filter(pa.array(bitmap.holds(batch.column("g").to_numpy().view(np.uint64)) == wanted))

    return run


class _Search:
    """Verdicts on strings, hot groups divided. Tables that were written for it are told in held."""

    def __init__(self, window: int, cut: Callable[[bytes, int, int], bytes], compare: Compare, hot: int):
        self.window, self.cut, self.compare, self.hot, self.held = window, cut, compare, hot, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.held.append(materialize(df, name))
        return self.held[-1]

    def verdicts(self, sizes: DataFrame, strings: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
        """(own stretches, what later occurrences repeat) of strings; sizes: g of every one of them."""
        many, tasks = None, min(TASKS, max(16, sizes.count() // TASK))
        if width > 1:
            counted = self.keep(sizes.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > self.hot).select("g"), "hot")
            many = None if counted.isEmpty() else bitmap(counted.select(F.col("g").alias("h")), at_once=True)
        mild = strings if many is None else strings.mapInArrow(_routed(many, False), _STRING)
        dealt = mild.repartition(tasks, "g").sortWithinPartitions("g", "name", "id", "mark", "start", F.desc("n"))
        run, schema = _compared(self.compare)
        found = self.keep(dealt.mapInArrow(run, schema), "verdicts")
        own = found.where("not later").select("id", "mark", (F.col("start") + F.col("shift")).alias("start"), "windows")
        later = found.where("later").select("g", "name", place().alias("first"), "shift", "windows")
        if many is None:
            return own, later
        width = -(-width // NARROWER)
        run, schema = _split(self.window, width, self.cut)
        hot = strings.mapInArrow(_routed(many, True), _STRING)
        # Texts and counts of the same string meet here.
        hot = hot.groupBy("g", "name", "id", "mark", "start").agg(*(F.max(c).alias(c) for c in ("n", "windows", "reach", "payload")))
        members = self.keep(hot.where("payload is not null and n > 0").mapInArrow(run, schema), "members")
        many.destroy()
        least = F.min(place()).alias("first")
        parts = members.groupBy("g", "name").agg(least, F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("windows", "reach", "payload")))
        parts = self.keep(parts.select("g", "name", "first.*", "n", "windows", "reach", "payload"), "parts")
        part_own, part_later = self.verdicts(parts.select("g"), parts, width)
        told = part_later.select("g", "name", "first", F.col("shift").alias("at"), F.col("windows").alias("w"))
        hit = self.keep(members.drop("payload", "windows").join(told, ["g", "name"]), "hit")
        repeated = hit.where(place() > F.col("first")).select("id", "mark", (F.col("start") + F.col("at")).alias("start"), F.col("w").alias("windows"))
        origin = F.struct("id", "mark", (F.col("start") - F.col("shift")).alias("start")).alias("first")
        up = hit.where("n > 1").select(F.col("g0").alias("g"), F.col("name0").alias("name"), origin, (F.col("shift") + F.col("at")).alias("shift"), F.col("w").alias("windows"))
        return own.unionByName(part_own).unionByName(repeated), later.unionByName(up)


def repeats(rows: DataFrame, slices: Sequences, window: int, k: int, payload, cut, compare: Compare, hot: int = HOT) -> DataFrame:
    """(id, mark, start, stop): stretches of symbols of rows (id, mark, text) covered by a window that starts earlier too.

    payload makes the texts of strings, cut takes symbols a to b of one, compare decides on collections of them.
    """
    counted = rows.select("id", "mark", "text").mapInArrow(_emit(slices, window, k, None, None, "hash"), "g long")
    again = materialize(counted.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select(F.col("g").alias("h")), "again")
    passing = bitmap(again, at_once=True)
    release(again)
    found = materialize(rows.mapInArrow(_emit(slices, window, k, passing, None, "seed"), _SEED), "seeds")
    strings = found.groupBy("g", "name").agg(F.min(place()).alias("first"), F.count("*").alias("n"))
    strings = materialize(strings.select("g", "name", "first.*", "n"), "strings")
    id_ = F.coalesce("id", F.lit(0).cast("long"))
    marks = F.array(F.xxhash64(id_, "mark", F.col("start").cast("long")), F.xxhash64(id_, "mark"))
    first = bitmap(strings.select(F.explode(marks).alias("h")), at_once=True)
    texts = rows.mapInArrow(_emit(slices, window, k, first, payload, "payload"), f"{_SEED}, reach int, payload binary")
    texts = materialize(texts, "texts")
    empty = lambda kind: F.lit(None).cast(kind)
    both = strings.select("g", "name", "id", "mark", "start", "n", empty("int").alias("windows"), empty("int").alias("reach"), empty("binary").alias("payload"))
    both = both.unionByName(texts.withColumn("n", F.lit(0).cast("long")))
    search = _Search(window, cut, compare, hot)
    own, later = search.verdicts(strings.select("g"), both, window - k + 1)
    # Written, so that the join reads plain exchanges and a hot string can be split.
    later = search.keep(later, "later")
    told = later.select("g", "name", "first", "shift", F.col("windows").alias("w"))
    copies = found.join(told, ["g", "name"]).where(place() > F.col("first")).select("id", "mark", (F.col("start") + F.col("shift")).alias("start"), F.col("w").alias("windows"))
    every = own.unionByName(copies).select("id", "mark", "start", (F.col("start") + F.col("windows") + F.lit(window - 1)).alias("stop"))
    runs = materialize(every, "runs")
    for kept in (passing, first):
        kept.destroy()
    release(found, strings, texts, *search.held)
    return runs


def merge(starts: list[int], stops: list[int]) -> list[list[int]]:
    """Overlapping or touching stretches as maximal runs."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, stops, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def with_runs(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with the arrays starts and stops of their stretches (null where there are none)."""
    lists = found.groupBy("id", "mark").agg(F.collect_set(F.struct("start", "stop")).alias("runs"))
    lists = lists.select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), F.col("runs.start").alias("starts"), F.col("runs.stop").alias("stops"))
    return rows.join(lists, rows["id"].eqNullSafe(lists["_id"]) & (rows["mark"] == lists["_mark"]), "left").drop("_id", "_mark")
