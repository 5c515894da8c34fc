"""Suffix-array dedup over bytes: column-wise construction for many strings.

A collection's Burrows-Wheeler transform, the common prefixes of neighbours in the order of its suffixes and
the suffixes' places are columns in external files, built from the strings' last symbols to their first. Each
round puts one symbol of every string before its last suffix: the transform is read in sequence to rank those
symbols, which gives the new suffixes' places, while running minima of the common prefixes give the new ones;
then the columns are copied in sequence with the new suffixes inserted. Both passes hold CHUNK places at a time.

Whole texts can't be one collection: rounds are as many as the longest text's bytes, and each reads all of
the transform. What is built are collections of spans instead: the stretches of bytes whose windows share a
winnowed anchor (see anchored), of less than twice WINDOW bytes. Windows with one anchor are always in the same
collection, so nothing is missed; equal spans go in once, with their number. Spans go in as strings of the windows
that have the anchor at neighbouring places and so share the bytes around it. What the strings of such a group have
in common from the last place on where one of their windows starts is one symbol of that many bytes; a string alone
in its group is one symbol, since its windows all differ and repeat as it does. What has WINDOW bytes in common with
its neighbour repeats, and nothing else is removed.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from querent.llm import anchored
from querent.llm.bpe import mix
from querent.llm.common import once

#: Bytes of a window, and of an anchor.
WINDOW, K = 100, 32
#: Places of a column handled at once.
CHUNK = 1 << 20
#: Places of the anchor in a window that a string of a collection spans.
WIDTH = 18
#: Symbols: bytes, then one for each group of a collection, then the one that stands before a string's first.
BYTES = 256


def _symbols() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64))


def byte_slices(texts: list[str]):
    """Texts as sequences of mixed bytes, in slices."""
    table = once("byte symbols", _symbols)
    at, held, sizes, total = 0, [], [], 0
    for i, text in enumerate(texts):
        held.append(text.encode())
        sizes.append(len(held[-1]))
        total += sizes[-1]
        if total >= anchored.SLICE or i + 1 == len(texts):
            yield at, i + 1, table[np.frombuffer(b"".join(held), np.uint8)], np.r_[0, np.cumsum(np.array(sizes, np.int64))]
            at, held, sizes, total = i + 1, [], [], 0


def _spans(window: int):
    def payload(symbols, texts, at, doc, bounds, first, last) -> list[bytes]:
        out, own, data = [], -1, b""
        for d, a, b in zip(doc.tolist(), (first - bounds[doc]).tolist(), (last - bounds[doc]).tolist(), strict=True):
            if d != own:
                own, data = d, texts[at + d].encode()
            out.append(data[a : b + window])
        return out

    return payload


class Columns:
    """Columns of numbers in external files, read and written in sequence: one file of each is read while the other is written."""

    def __init__(self, folder: str, kinds: dict[str, np.dtype]):
        self.kinds, self.size, self.turn, self.files = kinds, 0, 0, []
        for side in "ab":
            self.files.append({name: open(os.path.join(folder, f"{name}-{side}"), "w+b", buffering=0) for name in kinds})  # noqa: SIM115

    def read(self, *names: str) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(first place, the columns' next CHUNK places)."""
        for name in names:
            self.files[self.turn][name].seek(0)
        for at in range(0, self.size, CHUNK):
            count = min(CHUNK, self.size - at)
            yield at, [np.frombuffer(self.files[self.turn][n].read(count * self.kinds[n].itemsize), self.kinds[n]) for n in names]

    def start(self) -> None:
        """Begin the next round's columns."""
        for file in self.files[1 - self.turn].values():
            file.seek(0)

    def write(self, **parts: np.ndarray) -> None:
        for name, part in parts.items():
            self.files[1 - self.turn][name].write(part.astype(self.kinds[name], copy=False).data)

    def finish(self, size: int) -> None:
        """The columns that were written are the current ones."""
        self.turn, self.size = 1 - self.turn, size

    def close(self) -> None:
        for side in self.files:
            for file in side.values():
                file.close()


def _ranks(columns: Columns, where: np.ndarray, base: np.ndarray, weights: np.ndarray, most: int):
    """Of the last round's suffixes at where, in the transform's order: (new place, index into where, common prefix) and (place, common prefix) of the suffixes after them."""
    kind, end = columns.kinds["lcp"], len(weights)
    seen, carry, last_new = np.zeros(end + 1, np.int64), np.zeros(end + 1, kind), np.zeros(end + 1, bool)
    rank, own, left, after_at, after = [], [], [], [], []
    for at, (bwt, lcp) in columns.read("bwt", "lcp"):
        low, high = np.searchsorted(where, (at, at + len(bwt)))
        new = np.zeros(len(bwt), bool)
        new[where[low:high] - at] = True
        here = np.bincount(bwt, minlength=end + 1)
        first = np.cumsum(here) - here
        present = np.flatnonzero(here[:end])
        heads = first[present]
        # The places of each symbol, in order; where one suffix of a pair is new, so is what the pair has in common.
        order = np.argsort(bwt, kind="stable")[: first[end]]
        fresh = new[order]
        wanted = fresh.copy()
        wanted[1:] |= fresh[:-1]
        wanted[heads] = fresh[heads] | last_new[present]
        leads = np.zeros(len(order), bool)
        leads[heads] = True
        i = np.flatnonzero(wanted)
        spot, head = order[i], leads[i]
        symbol = bwt[spot]
        common = np.zeros(len(i), np.int64)
        body = np.flatnonzero(~head)[::-1]
        if len(body):
            # From the last pair to the first, so that what lies between two ranges is never looked through.
            ranges = np.empty(2 * len(body), np.int64)
            ranges[::2], ranges[1::2] = order[i[body] - 1] + 1, spot[body] + 1
            common[body] = np.minimum.reduceat(np.append(lcp, lcp[:1]), ranges)[::2] + weights[symbol[body]]
        if at:
            so_far, c = np.minimum.accumulate(lcp), symbol[head]
            common[head] = np.where(seen[c] > 0, np.minimum(carry[c], so_far[spot[head]]) + weights[c], 0)
        common = np.minimum(common, most)
        place = base[symbol] + seen[symbol] - first[symbol] + i
        fresh = fresh[i]
        rank.append(place[fresh])
        own.append(low + np.searchsorted(where[low:high], spot[fresh] + at))
        left.append(common[fresh])
        after_at.append(place[~fresh])
        after.append(common[~fresh])
        if at + len(bwt) < columns.size:
            to_come = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.array(most, kind))
            ends = order[heads + here[present] - 1]
            carry = np.minimum(carry, to_come[0])
            carry[present] = to_come[ends + 1]
            last_new[present] = new[ends]
        seen += here
    rank, own, left, after_at, after = (np.concatenate(x) for x in (rank, own, left, after_at, after))
    by, then = np.argsort(rank), np.argsort(after_at)
    return (rank[by], own[by], left[by]), (after_at[then], after[then])


def build(symbols: np.ndarray, sizes: np.ndarray, weights: np.ndarray, most: int, folder: str) -> tuple[Columns, np.ndarray]:
    """Columns bwt, lcp (weights of the common symbols, up to most) and place of all suffixes in order, and where each string begins; ends of strings differ.

    symbols are those of strings of these sizes in a row, all less than len(weights); that number stands before a string's first.
    """
    n, end = len(sizes), len(weights)
    # Each string has one place more than symbols, for its end; text[p] is the symbol before place p.
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = np.full(len(symbols) + n + 1, end, np.uint16)
    text[np.arange(1, len(symbols) + 1) + np.repeat(np.arange(n), sizes)] = symbols
    columns = Columns(folder, {"bwt": np.dtype(np.uint16), "lcp": np.min_scalar_type(most), "place": np.dtype(np.int32)})
    where, what = np.arange(n), begin + sizes
    columns.start()
    columns.write(bwt=text[what], lcp=np.zeros(n), place=what)
    columns.finish(n)
    counts = np.bincount(text[what], minlength=end + 1)
    for _ in range(int(sizes.max(initial=0))):
        (rank, own, left), (after_at, after) = _ranks(columns, where, n + np.cumsum(counts) - counts, weights, most)
        what = what[own] - 1
        symbol = text[what]
        counts += np.bincount(symbol, minlength=end + 1)
        slot = rank - np.arange(len(rank))  # the place, of those there were, that a new suffix stands before
        columns.start()
        for at, old in columns.read("bwt", "lcp", "place"):
            stop = at + len(old[0])
            a, b = np.searchsorted(slot, at), len(rank) if stop == columns.size else np.searchsorted(slot, stop)
            spots = rank[a:b] - (at + a)
            stays = np.ones(stop - at + b - a, bool)
            stays[spots] = False
            parts = {}
            for name, column, put in zip(columns.kinds, old, (symbol[a:b], left[a:b], what[a:b]), strict=True):
                parts[name] = np.empty(len(stays), columns.kinds[name])
                parts[name][stays] = column
                parts[name][spots] = put
            x, y = np.searchsorted(after_at, (at + a, stop + b))
            parts["lcp"][after_at[x:y] - (at + a)] = after[x:y]
            columns.write(**parts)
        columns.finish(columns.size + len(rank))
        where = rank
    return columns, begin


def _folded(strings: list[bytes], groups: np.ndarray, windows: np.ndarray, reaches: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols in a row and their numbers of strings, what a group's have in common as one (a lone string all, others from the last window's start on); and all symbols' weights."""
    lengths = np.array([len(s) for s in strings], np.int64)
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    members = np.diff(np.r_[first, len(groups)])
    back = np.where(members > 1, np.minimum.reduceat(reaches - windows + 1, first), reaches[first])
    ahead = (lengths - reaches)[first]
    for k in np.flatnonzero(members > 1).tolist():
        own = slice(first[k], first[k] + members[k])
        cuts = list(zip(strings[own], reaches[own].tolist(), strict=True))
        back[k] = len(os.path.commonprefix([s[r - int(back[k]) : r][::-1] for s, r in cuts]))
        ahead[k] = len(os.path.commonprefix([s[r:] for s, r in cuts]))
    group = np.repeat(np.arange(len(first)), members)
    cut, size = reaches - back[group], (back + ahead)[group]
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at, over = np.repeat(cut, lengths), np.repeat(cut + size, lengths)
    symbols = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16)
    lead = place == at
    symbols[lead] = BYTES + np.repeat(group, lengths)[lead]
    return symbols[(place <= at) | (place >= over)], lengths - size + 1, np.r_[np.ones(BYTES, np.int64), back + ahead]


def _ordered(strings: list[bytes], groups: np.ndarray, windows: np.ndarray, reaches: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, window, run) of all windows, equal ones have one run; of strings that are one symbol, of their first."""
    runs, found = 0, []
    with tempfile.TemporaryDirectory() as folder:
        symbols, sizes, weights = _folded(strings, groups, windows, reaches)
        columns, begin = build(symbols, sizes, weights, window, folder)
        for _, (lcp, place) in columns.read("lcp", "place"):
            run = runs + np.cumsum(lcp < window)
            runs = int(run[-1])
            string = np.searchsorted(begin, place, side="right") - 1
            offset = place - begin[string]
            # A string that is one symbol has its windows in one place.
            whole = offset < np.where(sizes[string] > 1, windows[string], 1)
            found.append((string[whole], offset[whole], run[whole]))
        columns.close()
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _cut(strings: list[bytes], groups: np.ndarray, windows: np.ndarray, reaches: np.ndarray, window: int, width: int):
    """Strings cut by where the anchor lies in their windows, sorted by what all windows of a part must share: (string, first window, group, windows, reach, text)."""
    low, high = (reaches - windows + 1) // width, reaches // width
    count = high - low + 1
    string = np.repeat(np.arange(len(strings)), count)
    part = np.arange(len(string)) - np.repeat(np.cumsum(count) - count, count) + low[string]
    least, most = np.maximum(part * width, (reaches - windows + 1)[string]), np.minimum((part + 1) * width - 1, reaches[string])
    shift = reaches[string] - most
    texts, shared, known = [], [], {}
    bounds = (string, shift, reaches[string] - least + window, reaches[string] - part * width, reaches[string] - (part + 1) * width + 1 + window, groups[string], part)
    for i, a, b, c, d, g, q in zip(*(x.tolist() for x in bounds), strict=True):
        text = strings[i]
        texts.append(text[a:b])
        shared.append(known.setdefault((g, q, text[c:d]), len(known)))
    shared = np.array(shared, np.int64)
    order = np.argsort(shared, kind="stable")
    return string[order], shift[order], shared[order], (most - least + 1)[order], most[order], [texts[i] for i in order.tolist()]


def compare(window: int, width: int = WIDTH):
    """anchored.Compare by the order of all suffixes."""
    def run(strings: list[bytes], doc: np.ndarray, start: np.ndarray, groups: np.ndarray, windows: np.ndarray, reaches: np.ndarray):
        string, shift, groups, windows, reaches, texts = _cut(strings, groups, windows, reaches, window, width)
        # Groups of one string are one symbol each, so they have a collection for themselves.
        edge = np.r_[True, groups[1:] != groups[:-1], True]
        alone = edge[1:] & edge[:-1]
        later, every = [], []
        for lone, part in ((True, np.flatnonzero(alone)), (False, np.flatnonzero(~alone))):
            if not len(part):
                continue
            own, offset, run = _ordered([texts[i] for i in part.tolist()], groups[part], windows[part], reaches[part], window)
            own = part[own]
            if lone:
                every.append((string[own], shift[own], windows[own]))
                continue
            own, offset = string[own], shift[own] + offset
            order = np.lexsort((start[own] + offset, doc[own], run))
            own, offset, run = own[order], offset[order], run[order]
            again = np.flatnonzero(run[1:] == run[:-1]) + 1
            later.append(anchored.stretches(own[again], offset[again]))
            every.append(anchored.stretches(own, offset))
        none = (np.empty(0, np.int64),) * 3
        return tuple(anchored.merged(*(np.concatenate(x) for x in zip(none, *parts, strict=True))) for parts in (later, every))

    return run


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, gone, spans, shas, kept = [], [], [], [], []
        for text, starts, stops in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "stops")), strict=True):
            data = text.encode()
            runs = anchored.merge(starts or [], stops or [])
            at, parts = 0, []
            for a, b in runs:
                parts.append(data[at:a])
                at = b
            rest = b"".join([*parts, data[at:]])
            n.append(len(data))
            gone.append(len(data) - len(rest))
            spans.append(len(runs))
            shas.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        columns = [pa.array(c, k) for c, k in zip((n, gone, spans, shas, kept), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = K, hot: int = anchored.HOT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_bytes of every row of docs.

    A byte is removed if a string of that many bytes of the input that covers it also starts earlier: in a
    document of smaller id (null first), or earlier in the same one, also where the two overlap. Null texts are
    empty; rows that repeat an id and its text have one result; of an id's different texts the one whose hash is
    smaller counts as earlier; shorter texts stay. Other columns are ignored. An empty table gives none.
    """
    rows = anchored.documents(docs, id_column, text_column)
    found = anchored.repeats(rows, byte_slices, window, k, _spans(window), lambda text, a, b: text[a:b], compare(window), hot)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary"
    return anchored.with_runs(rows, found).mapInArrow(_report, schema)


def op4_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeats of 100 bytes and more removed from all documents."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_bytes")
