"""Byte-level BPE over many texts at once.

Texts are cut into the matches of the split pattern by array operations over code points, each distinct
short match is encoded once, and the ids are gathered back. Longer matches are encoded one by one, halves
first: neighbours are joined by re-encoding a growing window of tokens around the seam until each token
kept outside is a compatible neighbour of the window, that is, the two of them encode to themselves. A
sequence in which all adjacent tokens are compatible is the encoding of its bytes, so the rest stands.
"""

from __future__ import annotations

import base64
import json
import re
from itertools import chain

import numpy as np

from querent.llm.common import once

#: The split pattern of the rank files' tokenizer, and its contractions after an apostrophe.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ONE_LETTER, TWO_LETTERS = ("s", "t", "m", "d"), ("re", "ve", "ll")

LETTER, NUMBER, WHITE, OTHER = range(4)
#: Matches of more code points than this are encoded one by one.
SHORT = 32
#: Distinct matches kept by a coder before it starts anew.
KEPT = 50_000
#: Code points that are cut at once.
CHUNK = 1 << 20
#: Bytes of a long match's leaf.
LEAF = 512


def _classes() -> np.ndarray:
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        for m in regex.finditer(pattern, every):
            lo, hi = ord(m[0][0]), ord(m[0][-1])
            table[lo : hi + 1] = kind
    return table


def _powers() -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    return tuple(_power_table(x) for x in (base, pow(base, -1, 1 << 64)))


def _power_table(base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(CHUNK, base, np.uint64))])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that scatters them."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def matches(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the pattern's matches in concatenated texts; first marks where a text starts."""
    n = len(codes)
    kind = once("classes", _classes)[codes]
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    ends = np.r_[first[1:], True]  # last code points of texts
    # The last of several white-space characters before something else stands alone, or leads it if a space.
    before = np.flatnonzero((kind == WHITE) & ~ends & np.r_[run[1:], False])
    start[before] = True
    start[before[codes[before] == 32] + 1] = False
    # Contractions: an apostrophe that starts a match, right before the letters.
    at = np.flatnonzero((codes == 39) & start & ~ends)
    at = at[kind[np.minimum(at + 1, n - 1)] == LETTER]
    if len(at):
        c1 = codes[at + 1]
        one = np.isin(c1, [ord(c) for c in ONE_LETTER])
        third = np.minimum(at + 2, n - 1)
        inside = (at + 2 < n) & ~ends[at + 1]
        two = np.zeros(len(at), bool)
        for pair in TWO_LETTERS:
            two |= inside & (c1 == ord(pair[0])) & (codes[third] == ord(pair[1]))
        for own, width in ((one, 2), (two, 3)):
            start[at[own] + 1] = False
            after = at[own] + width
            start[after[after < n]] = True
    return np.flatnonzero(start)


def _alphabet() -> dict[str, int]:
    """Printable stand-ins of the bytes in vocabulary files: Latin-1's visible characters stand for themselves, the rest follow from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token of a rank file, or of a vocabulary file with merges whose ids follow the merges."""
    if path.endswith(".json"):
        model = json.load(open(path, encoding="utf-8"))["model"]
        letters = _alphabet()
        merged = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        ids = [model["vocab"][m.replace(" ", "")] for m in merged]
        if ids != sorted(ids):
            raise ValueError("ids do not follow the merges")
        known = {m.replace(" ", "") for m in merged} | set(letters)
        return {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t in known}
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def load_added(path: str) -> dict[str, int]:
    """Ids of a vocabulary file's added tokens, which stand in texts as they are; rank files have none."""
    if not path.endswith(".json"):
        return {}
    found = json.load(open(path, encoding="utf-8")).get("added_tokens") or []
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in found):
        raise ValueError("added tokens that take in white space or whole words only are not supported")
    return {x["content"]: x["id"] for x in found if x["content"]}


class Coder:
    """Encodes and decodes texts by the ranks of one file, and its added tokens."""

    def __init__(self, path: str):
        import tiktoken

        ranks = load_ranks(path)
        self.piece = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.added = load_added(path)
        self.bytes_of: dict[int, bytes] = {i: t for t, i in ranks.items()} | {i: t.encode() for t, i in self.added.items()}
        self.known: dict[str, list[int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b side by side encode to themselves."""
        found = self.fits.get((a, b))
        if found is None:
            if len(self.fits) > KEPT:
                self.fits.clear()
            found = self.fits[a, b] = self.piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings side by side."""
        if not left or not right or self.compatible(left[-1], right[0]):
            return left + right
        width = 2
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            middle = self.piece(b"".join(self.bytes_of[x] for x in chain(left[i:], right[:j])))
            if (i == 0 or self.compatible(left[i - 1], middle[0])) and (j == len(right) or self.compatible(middle[-1], right[j])):
                return left[:i] + middle + right[j:]
            width *= 2

    def encode_piece(self, data: bytes) -> list[int]:
        """The ids of one match."""
        if len(data) <= LEAF:
            return self.piece(data)
        half = len(data) // 2
        return self.join(self.encode_piece(data[:half]), self.encode_piece(data[half:]))

    def encode_match(self, text: str) -> list[int]:
        """The ids of one match, kept if it is short."""
        if len(text) > SHORT:
            return self.encode_piece(text.encode())
        found = self.known.get(text)
        if found is None:
            if len(self.known) >= KEPT:
                self.known.clear()
            found = self.known[text] = self.piece(text.encode())
        return found

    def encode_added(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's ids start (one more at the end); added tokens are cut out first."""
        if not any(t in text for text in texts for t in self.added):
            return self.encode_many(texts)[:2]
        # Longer ones first: where several start at one place, the longest counts.
        cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        parts = [cut.split(t) for t in texts]  # odd ones are added tokens
        ids, bounds, *_ = self.encode_many([s for own in parts for s in own[::2]])
        out, sizes, at = [], [], 0
        for own in parts:
            size = 0
            for i, s in enumerate(own):
                if i % 2:
                    out.append(np.array([self.added[s]], np.uint32))
                else:
                    out.append(ids[bounds[at] : bounds[at + 1]])
                    at += 1
                size += len(out[-1])
            sizes.append(size)
        return np.concatenate(out), np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts; where each text's ids start (one more at the end); the matches' starts in the concatenated texts; where each match's ids start."""
        parts, at = [], 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK):
                size += len(texts[to])
                to += 1
            parts.append(self._encode_chunk(texts[at:to]))
            at = to
        ids = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.uint32)
        out, shift_ids, shift_codes = [[], [], []], 0, 0
        for p, text_ids, starts, piece_ids, n in parts:
            out[0].append(text_ids[:-1] + shift_ids)
            out[1].append(starts + shift_codes)
            out[2].append(piece_ids + shift_ids)
            shift_ids += len(p)
            shift_codes += n
        bounds = np.concatenate([*out[0], [shift_ids]]) if parts else np.zeros(1, np.int64)
        return ids, bounds.astype(np.int64), *(np.concatenate(x) if parts else np.empty(0, np.int64) for x in out[1:])

    def _encode_chunk(self, texts: list[str]):
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        n = len(codes)
        sizes = np.array([len(t) for t in texts], np.int64)
        text_at = np.cumsum(sizes) - sizes
        if not n:
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), 0
        first = np.zeros(n, bool)
        first[text_at[sizes > 0]] = True
        starts = matches(codes, first)
        ends = np.r_[starts[1:], n]
        width = ends - starts
        with np.errstate(over="ignore"):
            if n <= CHUNK:
                up, down = once("powers", _powers)
                total = np.r_[np.zeros(1, np.uint64), np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * up[:n])]
                name = (total[ends] - total[starts]) * down[starts] + mix(width.astype(np.uint64))
            else:  # one very long text: no names, each match by itself
                name = np.arange(len(starts), dtype=np.uint64)
        name[width > SHORT] = np.arange(len(starts), dtype=np.uint64)[width > SHORT]
        _, index, inverse = np.unique(name, return_index=True, return_inverse=True)
        known, piece, get = self.known, self.piece, self.known.get
        if len(known) > KEPT - len(index):
            known.clear()
        distinct = [joined[a:b] for a, b in zip(starts[index].tolist(), ends[index].tolist(), strict=True)]
        lists = list(map(get, distinct))
        for i, s in enumerate(distinct):
            if lists[i] is None:
                if len(s) > SHORT:
                    lists[i] = self.encode_piece(s.encode())
                else:
                    lists[i] = known[s] = piece(s.encode())
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.uint32, int(counts.sum()))
        begin = np.cumsum(counts) - counts
        own = counts[inverse]
        piece_at = np.cumsum(own) - own
        ids = flat[np.arange(int(own.sum())) + np.repeat(begin[inverse] - piece_at, own)]
        bounds = np.r_[piece_at, len(ids)][np.searchsorted(starts, np.r_[text_at, n])]
        return ids, bounds, starts, piece_at, n

    def forget(self) -> None:
        """Drop what is kept between texts, so that an idle worker holds little memory."""
        self.known.clear()
        self.fits.clear()

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids: halves decoded and concatenated."""
        if len(ids) <= 8192:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def coder(path: str) -> Coder:
    """The process's coder for a file."""
    return once(("coder", path), lambda: Coder(path))
