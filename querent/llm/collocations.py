"""Collocations from word-id suffix arrays, a shard at a time, with counts merged by key.

A shard is some megabytes of text whose words are numbered. Numpy prefix doubling sorts the places of a shard by the
words that follow (none beyond the piece's end), the common prefixes of neighbours follow from the ranks of each
doubling, and every interval of places that share k words is one phrase of k words with its count. Counts of all
shards are merged by (lang, phrase), combined before the shuffle.

A phrase can only be frequent if all shorter phrases in it are. So phrases are counted in passes, and each pass only
sorts what the pass before let through: a fixed-size bitmap of the hashes of its frequent phrases cuts the shards into
stretches. Pairs of words, of which there are most, are first counted by hash alone, whose count is that of all pairs
that share it; those that reach the threshold are counted by key with the phrases of three words. The bitmaps let all
through that they must; what they let through by chance is counted exactly and fails the threshold then. Nothing is
estimated, no phrase is left out.

Ranks in a language come from one global sort in ranges, so no language is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querent.llm.anchored import Bitmap, bitmap
from querent.llm.bpe import mix
from querent.llm.common import materialize, once, release, tidy

#: Least count of a phrase, words of the longest, reported a language, percentage of a phrase's count at which a longer one absorbs it.
LEAST, LONGEST, TOP, ABSORB = 100, 5, 2000, 100
#: Bytes of text of a shard.
SHARD = 6 << 20
#: Lengths counted in a pass behind that of single words, and the length of the parts that must have passed before.
PASSES = (((2, 3), 2), ((4, 5), 3))

COUNTS = "lang string, phrase string, k int, f long"


def _table() -> bytes:
    """Lowers A-Z, makes ends of pieces LF and other white space a space."""
    table = bytearray(range(256))
    for b in range(65, 91):
        table[b] = b + 32
    for b in b".,;:!?\n\x0b\x0c\r":
        table[b] = 10
    table[9] = 32
    return bytes(table)


class Shard:
    """The words of some texts: number of each place's (lang, word), and how many words its stretch still has."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        data = b"\n".join(texts).translate(once("collocation bytes", _table))
        raw = np.frombuffer(data, np.uint8)
        end = raw == 10
        word = ~(end | (raw == 32))
        edge = np.diff(np.r_[False, word, False].astype(np.int8))
        start = np.flatnonzero(edge == 1)
        size = np.flatnonzero(edge == -1) - start
        piece = np.cumsum(end, dtype=np.int32)[start]
        offsets = np.zeros(len(size) + 1, np.int32)
        np.cumsum(size, out=offsets[1:])
        coded = pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(raw[word])]).dictionary_encode()
        names = sorted(set(langs))
        place = {lang: i for i, lang in enumerate(names)}
        first = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        lang = np.array([place[x] for x in langs], np.int64)[np.searchsorted(first, start, "right") - 1]
        n = max(1, len(coded.dictionary))
        kinds, self.ids = np.unique(lang * n + coded.indices.to_numpy(), return_inverse=True)
        self.words = coded.dictionary.take(pa.array(kinds % n)) if len(kinds) else pa.array([], pa.string())
        self.lang = kinds // n
        self.names = names
        self.piece = piece

    def hashes(self) -> np.ndarray:
        """A hash of each (lang, word)."""
        return word_hashes(self.words.to_pylist(), [self.names[i] for i in self.lang.tolist()])

    def stretches(self, passes: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(rest, span) once only places are left that phrases of least words or more can cover, all of whose parts of k words pass.

        passes: whether the k words from each place pass. rest: the words from a place on all of whose parts pass,
        0 where none does; span: the words to the end of the stretch that a place lies in.
        """
        n = len(self.ids)
        here, own = np.arange(n), np.zeros(n, bool)
        own[: len(passes)] = passes
        ends = np.r_[~own[1:] | (self.piece[1:] != self.piece[:-1]), True][:n]
        last = np.flatnonzero(ends)[np.cumsum(ends) - ends]
        rest = np.where(own, last - here + k, 0)
        span = np.maximum.accumulate(np.where(rest >= least, here + rest, 0)) - here
        covered = span > 0
        self.ids = self.ids[covered]
        return np.minimum(rest, span)[covered], span[covered]


def word_hashes(words: list[str], langs: list[str]) -> np.ndarray:
    seeds = {lang: xxhash.xxh32_intdigest(lang.encode()) for lang in set(langs)}
    return np.array([xxhash.xxh3_64_intdigest(w.encode(), seeds[x]) for w, x in zip(words, langs, strict=True)], np.uint64)


def gram_hashes(parts: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases by their words' hashes, of the first, second, .. words."""
    out = parts[0]
    with np.errstate(over="ignore"):
        for p in parts[1:]:
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + p)
    return out


def suffix_array(ids: np.ndarray, rest: np.ndarray, span: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, common): places sorted by the words that follow, to depth at least, and the words each shares with the one before.

    Prefix doubling: the ranks by h words, paired with the ranks h places on, give the ranks by 2h words. The end of
    a place's span comes before any word. common counts within rest.
    """
    n = len(ids)
    rank, h = ids.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    ranks = [rank]
    while h < depth and n:
        inside = np.flatnonzero(span > h)
        ahead = np.zeros(n, np.int64)
        ahead[inside] = rank[inside + h] + 1
        key = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(key, kind="stable")
        own = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, own[1:] != own[:-1]])
        ranks.append(rank)
        h *= 2
    common = np.zeros(n, np.int64)
    a, b, at = order[:-1], order[1:], common[1:]
    least = np.minimum(rest[a], rest[b])
    for level in range(len(ranks) - 1, -1, -1):
        step = 1 << level
        fits = np.flatnonzero(least >= at + step)
        x, y = a[fits] + at[fits], b[fits] + at[fits]
        at[fits[ranks[level][x] == ranks[level][y]]] += step
    return order, common


def intervals(order: np.ndarray, common: np.ndarray, rest: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(a place, how many) of every phrase of k words."""
    start = np.flatnonzero(common < k)
    count = np.diff(np.r_[start, len(order)])
    place = order[start]
    whole = rest[place] >= k
    return place[whole], count[whole]


def _phrases(shard: Shard, place: np.ndarray, k: int) -> pa.Array:
    parts = [shard.words.take(pa.array(shard.ids[place + i])) for i in range(k)]
    return parts[0] if k == 1 else pc.binary_join_element_wise(*parts, " ")


def _passing(shard: Shard, kept: Bitmap, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(rest, span) of shard, left with the stretches of least words or more whose parts of k words all pass."""
    own = shard.hashes()[shard.ids]
    n = max(0, len(own) - k + 1)
    whole = shard.piece[:n] == shard.piece[len(own) - n :]
    return shard.stretches(whole & kept.holds(gram_hashes([own[i : n + i] for i in range(k)])), k, least)


def shard_counts(shard: Shard, ks: tuple[int, ...], kept: Bitmap | None, k: int) -> Iterator[pa.RecordBatch]:
    """COUNTS of the shard's phrases of ks words, of those whose parts of k words all pass."""
    rest, span = (np.ones(len(shard.ids), np.int64),) * 2 if kept is None else _passing(shard, kept, k, ks[0])
    order, common = suffix_array(shard.ids, rest, span, max(ks))
    for k in ks:
        place, count = intervals(order, common, rest, k)
        if len(place):
            lang = pa.array(shard.names).take(pa.array(shard.lang[shard.ids[place]]))
            yield pa.RecordBatch.from_arrays([lang, _phrases(shard, place, k), pa.array(np.full(len(place), k, np.int32)), pa.array(count)], ["lang", "phrase", "k", "f"])


def pair_counts(shard: Shard, ks: tuple[int, ...], kept: Bitmap, k: int) -> Iterator[pa.RecordBatch]:
    """(h, f): hashes and counts of the shard's pairs of words that both pass."""
    rest, span = _passing(shard, kept, 1, 2)
    order, common = suffix_array(shard.ids, rest, span, 2)
    place, count = intervals(order, common, rest, 2)
    if len(place):
        own = shard.hashes()
        h = gram_hashes([own[shard.ids[place]], own[shard.ids[place + 1]]])
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(count)], ["h", "f"])


def _pieces(text: bytes, shard: int) -> Iterator[bytes]:
    """A text cut at ends of pieces into parts of about shard bytes."""
    at = 0
    while len(text) - at > shard:
        cut = max(text.rfind(b"\n", at, at + shard), text.rfind(b".", at, at + shard)) + 1
        if cut <= at:  # one piece of more than a shard stays whole
            ahead = [x for x in (text.find(b"\n", at + shard), text.find(b".", at + shard)) if x >= 0]
            cut = min(ahead) + 1 if ahead else len(text)
        yield text[at:cut]
        at = cut
    yield text[at:]


def _count(counts, ks: tuple[int, ...], kept, k: int, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passing = Bitmap(kept.value) if kept is not None else None
        texts: list[bytes] = []
        langs: list[str] = []
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                for part in _pieces(text, shard):
                    if texts and size + len(part) > shard:
                        yield from counts(Shard(texts, langs), ks, passing, k)
                        texts, langs, size = [], [], 0
                    texts.append(part)
                    langs.append(lang)
                    size += len(part) + 1
        if texts:
            yield from counts(Shard(texts, langs), ks, passing, k)

    return run


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, phrases = batch.column("lang").to_pylist(), [p.split(" ") for p in batch.column("phrase").to_pylist()]
        out = np.empty(len(phrases), np.uint64)
        for k in {len(p) for p in phrases}:
            at = [i for i, p in enumerate(phrases) if len(p) == k]
            out[at] = gram_hashes([word_hashes([phrases[i][j] for i in at], [langs[i] for i in at]) for j in range(k)])
        yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], ["h"])


def phrase_counts(docs: DataFrame, lang_column: str = "lang", text_column: str = "text", least: int = LEAST, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, k, f): phrases of 1 to LONGEST words with f of at least least; (lang, n): all words of a language)."""
    rows = docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"), F.col(text_column).cast("string").alias("text")).where("text is not null")
    count = lambda counts, ks, kept, k, schema: rows.mapInArrow(tidy(_count(counts, ks, kept, k, shard), 500), schema)
    words = materialize(count(shard_counts, (1,), None, 0, COUNTS).groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")), "words")
    totals = materialize(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    out = materialize(words.where(F.col("f") >= least), "phrases1")
    release(words)
    kept = bitmap(out.mapInArrow(_hashes, "h long").distinct())
    pairs = count(pair_counts, (2,), kept, 1, "h long, f long").groupBy("h").agg(F.sum("f").alias("f"))
    passing = bitmap(pairs.where(F.col("f") >= least).select("h"))
    kept.destroy()
    for ks, k in PASSES:
        counted = count(shard_counts, ks, passing, k, COUNTS).groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f"))
        often = materialize(counted.where(F.col("f") >= least), f"phrases{ks[0]}")
        passing.destroy()
        out = out.union(often)
        if ks != PASSES[-1][0]:
            passing = bitmap(often.where(F.col("k") == max(ks)).mapInArrow(_hashes, "h long").distinct())
    return out, totals


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, n, score of phrases of two words or more: the lowest-scoring cut, of equal ones the first."""
    words = F.split("phrase", " ")
    cuts = counts.where("k > 1").join(totals, "lang").select("lang", "phrase", "k", F.col("f").alias("a"), "n", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumns({"head": F.concat_ws(" ", F.slice(words, F.lit(1), F.col("cut"))), "tail": F.concat_ws(" ", F.slice(words, F.col("cut") + 1, F.col("k") - F.col("cut")))})
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    score = F.expr("(cast(1000 as decimal(38,0)) * cast(a as decimal(20,0)) * cast(n as decimal(20,0))) div (cast(l as decimal(20,0)) * cast(r as decimal(20,0)))")
    joined = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn("score", score.cast("long"))
    best = joined.groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "k", "a", "b.l", "b.r", "n", "b.score")


def absorbed(counts: DataFrame, percent: int = ABSORB) -> DataFrame:
    """(lang, phrase, longest): the greatest count of a longer frequent phrase that holds phrase's words in a row."""
    words = F.split("phrase", " ")
    spans = F.expr("flatten(transform(sequence(2, k - 1), n -> transform(sequence(1, k - n + 1), i -> struct(i, n))))")
    inner = counts.where("k > 2").select("lang", "phrase", "f", F.explode(spans).alias("s"))
    inner = inner.select("lang", F.concat_ws(" ", F.slice(words, F.col("s.i"), F.col("s.n"))).alias("phrase"), "f")
    return inner.groupBy("lang", "phrase").agg(F.max("f").alias("longest"))


def ranked(rows: DataFrame, by: str, order: list, top: int) -> DataFrame:
    """rows with rank (long, from 1) in order within by, of which the first top stay. One sort in ranges; only counts a range are added up in a window."""
    ordered = rows.repartitionByRange(F.col(by), *order).sortWithinPartitions(F.col(by), *order)
    ordered = materialize(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    starts = ordered.groupBy(by, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(by, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    found = ordered.withColumn("_part", part).join(starts, [by, "_part"])
    return found.withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before") + 1).where(F.col("rank") <= top).drop("_at", "_part", "_first", "_before")


def collocations(docs: DataFrame, lang_column: str = "lang", text_column: str = "text", least: int = LEAST, top: int = TOP, percent: int = ABSORB, shard: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's top phrases by score, then a, then phrase in byte order.

    A-Z is lowered; texts are cut at . , ; : ! ? LF VT FF CR, pieces into words at spaces and tabs. Null texts are empty, a null language
    is und; repeated rows count each time; other columns are ignored; an empty table gives an empty result. A phrase in a
    longer one with at least percent of its count is left out.
    """
    counts, totals = phrase_counts(docs, lang_column, text_column, least, shard)
    own = scored(counts, totals).join(absorbed(counts, percent), ["lang", "phrase"], "left")
    own = materialize(own.where(F.col("longest").isNull() | (100 * F.col("longest") < percent * F.col("a"))).drop("longest", "k"), "scored")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    return ranked(own, "lang", order, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    """The collocations of each language of documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


ORACLE_OP11 = """
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \\x09]+') AS w FROM t),
g AS (SELECT lang, k, unnest([array_to_string(w[i : i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase FROM w, range(1, 6) r(k)),
c AS (SELECT lang, phrase, k, count(*) AS f FROM g GROUP BY ALL), n AS (SELECT lang, sum(f) AS n FROM c WHERE k = 1 GROUP BY lang),
p AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS words FROM c WHERE f >= 100 AND k > 1),
cut AS (SELECT *, unnest(range(1, k)) AS cut FROM p),
s AS (SELECT cut.lang, cut.phrase, a, cut, x.f AS l, y.f AS r, n, (1000::HUGEINT * a::HUGEINT * n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
      FROM cut JOIN n USING (lang) JOIN c x ON x.lang = cut.lang AND x.phrase = array_to_string(words[1 : cut], ' ') JOIN c y ON y.lang = cut.lang AND y.phrase = array_to_string(words[cut + 1 :], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS best FROM s),
inner_ AS (SELECT lang, a, unnest(flatten([[array_to_string(words[i : i + m - 1], ' ') FOR i IN range(1, k - m + 2)] FOR m IN range(2, k)])) AS phrase FROM p),
gone AS (SELECT lang, phrase, max(a) AS longest FROM inner_ GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN gone ON b.lang = gone.lang AND b.phrase = gone.phrase
      WHERE best = 1 AND (longest IS NULL OR 100 * longest < 100 * a))
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o WHERE rank <= 2000
"""
