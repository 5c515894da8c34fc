"""Substring dedup over words: seed and extend.

Documents are joined on winnowed anchors of K words. From an anchor, matches are extended both ways, a word at
a time: the members that agree so far are divided by the next word on the left, and likewise on the right, so
all of a group's matches grow together and no pairs are listed. Where a left and a right extension together
reach WINDOW words, all members but the first repeat it. Extensions go as far as the windows that chose the
anchor reach; longer matches continue in the extents of the next anchors, so the union of what matched is the
maximal repeats of WINDOW words or more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from querent.llm import anchored
from querent.llm.common import once

#: Words of a window, and of an anchor.
WINDOW, K = 20, 10
#: Bytes of texts cut into words at once, and of a word beyond which it is hashed by itself.
BYTES, LONG = 1 << 18, 128


def words_of(text: str) -> list[bytes]:
    """Runs of anything but space, tab, LF, VT, FF and CR."""
    return text.encode().split()


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of text: eight bytes after the other, each step reversible, in all words at once."""
    space = once("space", lambda: np.isin(np.arange(256), list(b" \t\n\v\f\r")))
    data = np.frombuffer(b" " + text + bytes(8), np.uint8)  # eight bytes can be read at the last one
    gap = space[data]
    gap[-8:] = True
    turn = np.flatnonzero(gap[1:] != gap[:-1])
    start, size = turn[::2] + 1, turn[1::2] - turn[::2]
    eight = np.ndarray(len(data) - 7, "<u8", data.data, strides=(1,))
    found = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    long = size > LONG
    own = np.flatnonzero(~long)
    for at in range(0, LONG, 8):
        own = own[size[own] > at]
        if not len(own):
            break
        lane, left = eight[start[own] + at], np.minimum(size[own] - at, 8).astype(np.uint64)
        x = found[own] ^ (lane & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - (left << np.uint64(3)))))
        for odd in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x ^= x >> np.uint64(30)
            x *= np.uint64(odd)
        found[own] = x ^ (x >> np.uint64(31))
    if long.any():
        import xxhash

        for i in np.flatnonzero(long).tolist():
            found[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + size[i]].tobytes(), 20)
    return start - 1, found


def word_slices(texts: list[str]):
    """Texts as sequences of word hashes, in slices."""
    at, held, total = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text.encode())
        total += len(held[-1]) + 1
        if total >= BYTES or i + 1 == len(texts):
            start, found = word_hashes(b" ".join(held))
            ends = np.cumsum(np.array([len(x) + 1 for x in held], np.int64))
            yield at, i + 1, found, np.r_[0, np.searchsorted(start, ends)]
            at, held, total = i + 1, [], 0


def _words(window: int):
    def payload(symbols, texts, at, doc, bounds, first, last) -> list[bytes]:
        out, own, words = [], -1, []
        for d, a, b in zip(doc.tolist(), (first - bounds[doc]).tolist(), (last - bounds[doc]).tolist(), strict=True):
            if d != own:
                own, words = d, words_of(texts[at + d])
            out.append(b" ".join(words[a : b + window]))
        return out

    return payload


def _divide(names: np.ndarray, words: np.ndarray, spot: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Names of those that agreed so far (-1: none), divided by the word at each one's spot where there is one."""
    there = there & (names >= 0)
    out = np.full(len(names), -1, np.int64)
    if there.any():
        out[there] = np.unique(names[there] * (int(words.max()) + 1) + words[spot[there]], return_inverse=True)[1]
    return out


def extend(window: int, k: int):
    """anchored.Compare by extension of the anchors' matches."""
    def run(strings: list[bytes], doc, start, groups, windows, reaches):
        # A member alone has no other to agree with; its later occurrences are as long as it is.
        edge = np.r_[True, groups[1:] != groups[:-1], True]
        alone = edge[1:] & edge[:-1]
        lone, part = np.flatnonzero(alone), np.flatnonzero(~alone)
        none = np.empty(0, np.int64)
        whole = (lone, np.zeros(len(lone), np.int64), windows[lone])
        if not len(part):
            return (none, none, none), whole
        known: dict[bytes, int] = {}
        doc, start, groups, reaches = doc[part], start[part], groups[part], reaches[part]
        split = [strings[i].split() for i in part.tolist()]
        words = np.array([known.setdefault(w, len(known)) for s in split for w in s], np.int64)
        sizes = np.array([len(s) for s in split], np.int64)
        anchor = np.cumsum(sizes) - sizes + reaches
        order = np.empty(len(part), np.int64)
        order[np.lexsort((start + reaches, doc))] = np.arange(len(part))
        names = np.unique(groups, return_inverse=True)[1].astype(np.int64)
        for i in range(k):
            names = _divide(names, words, anchor + i, np.ones(len(names), bool))
        left, right = [names], [names]
        for step in range(1, window - k + 1):
            left.append(_divide(left[-1], words, anchor - step, reaches >= step))
            right.append(_divide(right[-1], words, anchor + k + step - 1, reaches + k + step <= sizes))
        later, every = [], []
        for step in range(window - k + 1):
            one, other = left[step], right[window - k - step]
            own = np.flatnonzero((one >= 0) & (other >= 0))
            match = one[own] * len(names) + other[own]
            rank = np.lexsort((order[own], match))
            own, match = own[rank], match[rank]
            every.append(np.stack([own, reaches[own] - step]))
            later.append(every[-1][:, np.flatnonzero(match[1:] == match[:-1]) + 1])
        found, there = (anchored.stretches(*np.concatenate(x, axis=1)) for x in (later, every))
        return (part[found[0]], *found[1:]), tuple(np.concatenate(x) for x in zip((part[there[0]], *there[1:]), whole, strict=True))

    return run


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, gone, shas, texts = [], [], [], []
        for text, starts, stops in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "stops")), strict=True):
            words = words_of(text)
            n.append(len(words))
            runs = anchored.merge(starts or [], stops or [])
            gone.append(sum(b - a for a, b in runs))
            for a, b in reversed(runs):
                del words[a:b]
            kept = b" ".join(words)
            shas.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode())
        columns = [batch.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = K, hot: int = anchored.HOT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text of every row of docs.

    A word is removed if a window of that many words of the input that covers it also starts earlier: in a
    document of smaller id (null first), or earlier in the same one. Null texts have no words; rows that repeat
    an id and its text have one result; of an id's different texts the one whose hash is smaller counts as earlier;
    texts shorter than a window stay. Other columns are ignored. An empty table gives none.
    """
    rows = anchored.documents(docs, id_column, text_column)
    cut = lambda text, a, b: b" ".join(text.split()[a:b])
    found = anchored.repeats(rows, word_slices, window, k, _words(window), cut, extend(window, k), hot)
    return anchored.with_runs(rows, found).mapInArrow(_report, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeats of 20 words and more removed from all documents."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")
