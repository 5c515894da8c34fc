"""Secret scans over a trigram inverted index.

Each rule's regex is parsed and a Boolean query over trigrams is derived from it: what every match must
contain. Texts are indexed slice by slice (postings of the trigrams that any rule asks for, case folded),
the postings are combined as the query says, and the regex verifies the candidates that remain. A rule from
which no trigram follows scans every text. Slices are indexed inside a task, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from re import _parser as sre

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm.common import TEXTS, once, tidy

#: The rules in listed order: kind, pattern, group whose length counts, least length, whether it is a base rule.
#: In the assign rule the letters of the key match in either case.
RULES = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    ("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    ("hex", r"[0-9a-f]{16,}", 0, 16, True),  # runs of 16 or more are the same with + and a least length
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, False),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36}", 0, 0, False),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0, False),
)
#: What replaces a secret.
MASK = "[SECRET]"
#: Bytes indexed at once, and how many strings a query may spell out.
SLICE, SPELLED = 4_000_000, 64

#: A query is True (anything), a trigram, or ("and" | "or", frozenset of queries).
Query = bool | str | tuple


def _both(kind: str, parts: list[Query]) -> Query:
    neutral = kind == "and"
    own = {p for p in parts if p is not neutral}
    if any(p is (not neutral) for p in own):
        return not neutral
    if not own:
        return neutral
    return next(iter(own)) if len(own) == 1 else (kind, frozenset(own))


def _needs(strings: set[str]) -> Query:
    """One of the strings is contained."""
    return _both("or", [_both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def _derive(items) -> tuple[set[str] | None, Query]:
    """(all strings that match, if few; the query) of a parsed sequence. Letters are folded."""
    spelled: set[str] = {""}
    whole, parts = True, []
    for op, arg in items:
        name = str(op)
        options, query = None, True
        if name == "LITERAL":
            options = {chr(arg).lower()}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            options = {chr(c).lower() for _, c in arg}
        elif name == "SUBPATTERN":
            options, query = _derive(arg[-1])
        elif name == "BRANCH":
            branches = [_derive(b) for b in arg[1]]
            if all(o is not None for o, _ in branches):
                options = set().union(*(o for o, _ in branches))
            else:
                query = _both("or", [q if o is None else _needs(o) for o, q in branches])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, body = arg
            options, query = _derive(body)
            if (low, high) == (0, 1) and options is not None:
                options = options | {""}
            elif low == 0:
                options, query = None, True
            elif (low, high) != (1, 1):
                query, options = (query if options is None else _needs(options)), None
        if options is not None and len(spelled) * len(options) <= SPELLED:
            spelled = {a + b for a in spelled for b in options}
        else:
            parts += [_needs(spelled), query if options is None else _needs(options)]
            spelled, whole = {""}, False
    if whole:
        return spelled, _needs(spelled)
    return None, _both("and", [*parts, _needs(spelled)])


def trigram_query(pattern: str) -> Query:
    """What a text must contain for the pattern to match, over folded trigrams of ASCII letters."""
    found = _derive(sre.parse(pattern))
    return found[1] if found[0] is None else _needs(found[0])


def trigrams(query: Query) -> set[str]:
    """The trigrams a query names."""
    if isinstance(query, bool):
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams(q) for q in query[1]))


class TrigramIndex:
    """Postings of some trigrams over a slice of texts, ASCII letters folded."""

    def __init__(self, texts: list[str], wanted: set[str]):
        self.n = len(texts)
        data = np.frombuffer(b"\xff".join(t.encode() for t in texts).lower(), np.uint8)
        ends = np.flatnonzero(data == 0xFF)  # never inside UTF-8
        wide = data.astype(np.uint32)
        codes = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:] if len(wide) > 2 else np.empty(0, np.uint32)
        self.postings: dict[str, np.ndarray] = {}
        keys = sorted(t for t in wanted if t.isascii())
        table = once(("trigrams", *keys), lambda: self._table(keys))
        at = np.flatnonzero(table[codes])
        found, doc = table[codes[at]], np.searchsorted(ends, at)
        for i, t in enumerate(keys):
            self.postings[t] = np.unique(doc[found == i + 1])

    @staticmethod
    def _table(keys: list[str]) -> np.ndarray:
        table = np.zeros(1 << 24, np.uint8)
        for i, t in enumerate(keys):
            table[int.from_bytes(t.encode(), "big")] = i + 1
        return table

    def candidates(self, query: Query) -> np.ndarray:
        """Places of the texts that a query lets through."""
        if isinstance(query, bool):
            return np.arange(self.n if query else 0)
        if isinstance(query, str):
            return self.postings.get(query, np.arange(self.n))
        sets = sorted((self.candidates(q) for q in query[1]), key=len)
        out = sets[0]
        for s in sets[1:]:
            out = np.intersect1d(out, s, assume_unique=True) if query[0] == "and" else np.union1d(out, s)
        return out


def _compiled() -> list[tuple]:
    return [(kind, re.compile(pattern), group, least, base, trigram_query(pattern)) for kind, pattern, group, least, base in RULES]


def scan(texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(start, place of the rule in RULES, end) of each text's secrets, sorted; places are code points."""
    rules = once(("rules", RULES), _compiled)
    wanted = set().union(*(trigrams(r[5]) for r in rules))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= SLICE):
            size += len(texts[to])
            to += 1
        index = TrigramIndex(texts[at:to], wanted)
        for place, (_, pattern, group, least, _, query) in enumerate(rules):
            for k in index.candidates(query):
                for m in pattern.finditer(texts[at + k]):
                    if m.end(group) - m.start(group) >= least:
                        found[at + k].append((m.start(), place, m.end()))
        at = to
    return [sorted(f) for f in found]


def _shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{RULES[place][0]}:{start}:{end}" for start, place, end in spans)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bases = [i for i, r in enumerate(RULES) if r[4]]
    for batch in batches:
        found = scan([t or "" for t in batch.column("text").to_pylist()])
        columns = [batch.column("doc_id")]
        for i in bases:
            columns.append(pa.array([sum(p == i for _, p, _ in f) for f in found], pa.int64()))
        columns.append(pa.array([hashlib.sha256(_shown([s for s in f if s[1] in bases]).encode()).hexdigest() for f in found], pa.string()))
        columns.append(pa.array([_shown(f) for f in found], pa.string()))
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with every run of overlapping spans replaced by MASK."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at or not out:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        found = scan([t or "" for t in texts])
        new = [masked(t, f) if f else t for t, f in zip(texts, found, strict=True)]
        columns = {c: batch.column(c) for c in batch.schema.names} | {"text": pa.array(new, pa.string())}
        if "n_chars" in columns:
            old = columns["n_chars"].to_pylist()
            columns["n_chars"] = pa.array([len(t) if f else n for t, f, n in zip(new, found, old, strict=True)], pa.int64())
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row; null text has no spans, ids may be null or repeat."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(tidy(_report, TEXTS), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask_secrets(docs: DataFrame) -> DataFrame:
    """docs with the secrets in text masked, and n_chars set anew where a text changed. Null texts stay null."""
    return docs.mapInArrow(tidy(_mask, TEXTS), docs.schema)


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets in every text of documents."""
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
