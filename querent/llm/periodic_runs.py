"""Periodic runs of words by Karp-Miller-Rosenberg naming.

A run is a stretch of consecutive words with smallest period q, length at least max(24, 3 * q), that no
neighbouring word extends. Within a document every stretch of 2^k words gets a name, level by level, from the
sorted pairs of names of its halves: equal names are equal stretches, nothing is hashed. Only stretches that occur
again in their document need a name, so levels thin out and end.

For each period q the words q apart agree along at least `reach` = max(24, 3 * q) - q words of a run, which holds a
whole cell of a grid of (reach + 1) // 2 words. A cell that equals its copy q words on (two names cover it) is a
candidate. It is extended both ways by descending the levels of names: where names at a level agree, both places
move on by that power of two. A stretch found under several periods keeps the least, which divides the others.

Documents are handled in slices of SLICE words, names never cross documents, and a longer document is a slice by
itself, whole. Rows are independent, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm.common import TEXTS, tidy

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 24, 3
#: Words named at once; a longer document is named by itself.
SLICE = 1 << 18

RUN_FIELDS = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
#: Changes a document's words before runs are sought: (id, words) to words.
Change = Callable[[int | None, list[bytes]], list[bytes]]


def levels(ids: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Names of the stretches of 2^k words from each place; -1 where the stretch occurs once in its document or leaves it.

    ids: the words' numbers, equal for equal words of a document; doc: each word's document; ends: each word's document's end.
    """
    out, names, size = [], ids.astype(np.int64), 1
    live = np.arange(len(ids))
    while len(live):
        if size > 1:
            half = size // 2
            live = live[live + size <= ends[live]]
            live = live[names[live + half] >= 0]
            first, second = names[live], names[live + half]
        else:
            first, second = doc.astype(np.int64), names
        # Names of one document are never another's, so the pair needs no document beyond the first level.
        width = int(second.max()) + 1 if len(second) else 1
        key = first * width + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.empty(0, bool)
        group = np.cumsum(new) - 1
        often = np.bincount(group)[group] > 1 if len(group) else np.empty(0, bool)
        names = np.full(len(ids), -1, np.int64)
        names[live[order[often]]] = group[often]
        live = np.flatnonzero(names >= 0)
        if len(live):
            out.append(names.astype(np.int32))
        size *= 2
    return out


def _forward(names: list[np.ndarray], a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many words from a and b on agree; b lies behind a, ends is where b's document ends."""
    at = np.zeros(len(a), np.int64)
    for k in range(len(names) - 1, -1, -1):
        fits = np.flatnonzero(b + at + (1 << k) <= ends)
        level = names[k]
        left = level[a[fits] + at[fits]]
        same = (left >= 0) & (left == level[b[fits] + at[fits]])
        at[fits[same]] += 1 << k
    return at


def _backward(names: list[np.ndarray], a: np.ndarray, b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many words before a and b agree; starts is where a's document starts."""
    at = np.zeros(len(a), np.int64)
    for k in range(len(names) - 1, -1, -1):
        step = 1 << k
        fits = np.flatnonzero(a - at - step >= starts)
        level = names[k]
        left = level[a[fits] - at[fits] - step]
        same = (left >= 0) & (left == level[b[fits] - at[fits] - step])
        at[fits[same]] += step
    return at


def _grid(bounds: np.ndarray, period: int, cell: int) -> np.ndarray:
    """First words of the cells of documents that are long enough for a run of this period; cells count from the document's start."""
    sizes = np.diff(bounds)
    long = np.flatnonzero(sizes >= max(LEAST, TIMES * period))
    count = (sizes[long] - period) // cell
    base = np.repeat(bounds[long], count)
    return base + (np.arange(len(base)) - np.repeat(np.cumsum(count) - count, count)) * cell


def runs(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs of documents that lie between bounds, sorted by start, then period."""
    sizes = np.diff(bounds)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    names = levels(ids, doc, bounds[1:][doc])
    found: list[np.ndarray] = []
    longest = int(sizes.max(initial=0))
    for period in range(1, longest // TIMES + 1):
        if longest < max(LEAST, TIMES * period):
            break
        reach = max(LEAST, TIMES * period) - period
        cell = (reach + 1) // 2
        k = cell.bit_length() - 1
        if k >= len(names):
            break  # no stretch of 2^k words occurs again
        here = _grid(bounds, period, cell)
        level = names[k]
        left = level[here]
        here = here[(left >= 0) & (left == level[here + period])]
        if len(here):
            rest = here + cell - (1 << k)
            here = here[level[rest] == level[rest + period]]
        if not len(here):
            continue
        owner = doc[here]
        end = here + period + _forward(names, here, here + period, bounds[1:][owner])
        start = here - _backward(names, here, here + period, bounds[owner])
        keep = end - start >= max(LEAST, TIMES * period)
        found.append(np.unique(np.stack([start[keep], end[keep], np.full(int(keep.sum()), period)]), axis=1))
    start, end, period = np.concatenate([np.empty((3, 0), np.int64), *found], axis=1)
    if not len(start):
        return start, end, period
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])]
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def collapsed(n: int, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words stay: all but those that a run contains after its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, start + period, 1)
    np.add.at(steps, end, -1)
    return np.cumsum(steps[:n]) == 0


def _strongest(start: list[int], length: list[int], period: list[int]) -> int:
    """The run with the greatest exact length / period; of equal ones the first of the order."""
    best = 0
    for i in range(1, len(start)):
        if length[i] * period[best] > length[best] * period[i]:
            best = i
    return best


def _report(words: list[bytes], start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple:
    if not len(start):
        return len(words), 0, None, None, None, None, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()
    stay = collapsed(len(words), start, end, period).tolist()
    s, n, p = start.tolist(), (end - start).tolist(), period.tolist()
    best = _strongest(s, n, p)
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in zip(s, n, p, strict=True))
    kept = b" ".join([w for w, k in zip(words, stay, strict=True) if k])
    return len(words), len(s), s[best], n[best], p[best], 1000 * n[best] // p[best], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def find(texts: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, period) arrays of the runs of each list of words."""
    out: list[tuple] = []
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= SLICE):
            size += len(texts[to])
            to += 1
        ids: list[int] = []
        for words in texts[at:to]:
            place = dict.fromkeys(words)
            for i, w in enumerate(place):
                place[w] = i
            ids += map(place.__getitem__, words)
        bounds = np.cumsum([0, *map(len, texts[at:to])])
        start, end, period = runs(np.array(ids, np.int64), bounds)
        cut = np.searchsorted(start, bounds)
        for i in range(to - at):
            own = slice(cut[i], cut[i + 1])
            out.append((start[own] - bounds[i], end[own] - bounds[i], period[own]))
        at = to
    return out


def _rows(change: Change | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = [(t.as_py() or "").encode().split() for t in batch.column("text")]
            if change is not None:
                texts = [change(i, w) for i, w in zip(ids, texts, strict=True)]
            rows = [_report(w, *r) for w, r in zip(texts, find(texts), strict=True)]
            columns = [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 6 + [pa.string()] * 2, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in RUN_FIELDS.split(", ")])

    return run


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", change: Change | None = None) -> DataFrame:
    """RUN_FIELDS of every row: its runs' number and digest, the strongest run, the digest of what stays once runs are collapsed.

    Words are runs of anything but space, tab, LF, VT, FF and CR. Null and empty texts have no words and no runs,
    four nulls and two digests of nothing. Repeated rows and ids stay row by row, null ids stay null; other columns
    are ignored; an empty table gives an empty result. Of runs with equal exponents the first to start counts, then
    the one of the smaller period.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(tidy(_rows(change), TEXTS), RUN_FIELDS)


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        old = batch.column("text").to_pylist()
        texts = [(t or "").encode().split() for t in old]
        new = []
        for text, words, (start, end, period) in zip(old, texts, find(texts), strict=True):
            if len(start):
                stay = collapsed(len(words), start, end, period).tolist()
                text = b" ".join([w for w, k in zip(words, stay, strict=True) if k]).decode()
            new.append(text)
        columns = {c: batch.column(c) for c in batch.schema.names} | {"text": pa.array(new, pa.string())}
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def collapse_runs(docs: DataFrame) -> DataFrame:
    """docs with each run in text cut to its first period; a text that changes has its words joined by single spaces, others stay as they are."""
    return docs.mapInArrow(tidy(_collapse, TEXTS), docs.schema)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's periodic tails: one document in ten, by the CRC of its id, repeats its words from some place on."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % period] for i in range(n - a)]


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every text of documents, of which one in ten has a periodic tail."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return periodic_runs(docs, change=planted).drop("n_words")
