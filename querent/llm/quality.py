"""Quality classifier by co-training.

Two views of a document that share no evidence: its text content (byte pairs, character-class triples, kinds of
characters and words) and its page metadata (language, source, length and layout of lines). A logistic model a
view is fitted on labelled rows and calibrated on labelled rows kept apart. Over several rounds each view scores
all unlabelled documents and labels the ones it is surest of for the other view, which then learns from them. In
the end the calibrated views are combined into one score. A view that is never sure teaches nothing.

Only the labelled rows are a sample, of SAMPLE rows in the order of a hash of the id; every unlabelled document
competes in every round, and every document is scored. The surest are found task by task and merged, SHARE a
view, class and round; features are made on the executors, and the driver gets those of the labelled sample and
of the surest.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querent.llm.common import TEXTS, materialize, once, text_of, tidy

#: Labelled rows that fitting sees at most.
SAMPLE = 4000
#: Rounds, documents a view labels for the other in a round and class, and how sure it must be.
ROUNDS, SHARE, SURE = 2, 300, 0.97
#: Labelled ids up to which these are broadcast (some 10 MB); more are joined by a shuffle.
BROADCAST = 500_000
#: Parts in which the surest of a view and class are merged first.
SALTS = 64
#: Share of the sample kept apart for calibration.
APART = 0.25
#: A document is rejected below this probability of being good.
THRESHOLD = 0.3

PAIRS, KINDS = 512, 6
N_CONTENT = PAIRS + KINDS**3 + 2 + KINDS + 5
LAYOUT = 7
#: Labelled rows that a language or source must have to be told apart; the others are one kind.
LEAST = 5
Known = tuple[dict[str, int], dict[str, int]]


def _kinds() -> np.ndarray:
    """Lower case, upper case, digit, white space, punctuation, beyond ASCII, by byte."""
    table = np.full(256, 5, np.uint8)
    for b in range(128):
        c = chr(b)
        table[b] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c.isspace() else 4
    return table


def content_features(text: str) -> np.ndarray:
    """The text view: roots of the shares of hashed byte pairs and of character-class triples, their entropies, kinds of characters and of words."""
    data = np.frombuffer(text.encode(), np.uint8)
    kinds = once("kinds", _kinds)[data].astype(np.int32)
    pairs = np.bincount((data[:-1].astype(np.int32) * 31 + data[1:]) % PAIRS, minlength=PAIRS) if len(data) > 1 else np.zeros(PAIRS)
    triples = np.bincount((kinds[:-2] * KINDS + kinds[1:-1]) * KINDS + kinds[2:], minlength=KINDS**3) if len(data) > 2 else np.zeros(KINDS**3)
    out, entropy = [], []
    for counts in (pairs, triples):
        share = counts / max(1, counts.sum())
        out.append(np.sqrt(share))
        entropy.append(-(share[share > 0] * np.log(share[share > 0])).sum())
    words = text.split()
    n = max(1, len(words))
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    ragged = sum(not w[-1].isalnum() for w in words) / n
    single = sum(len(w) == 1 for w in words) / n
    return np.concatenate([*out, entropy, np.bincount(kinds, minlength=KINDS) / max(1, len(data)), [len(text) / n, len(set(words)) / n, repeats, ragged, single]]).astype(np.float32)


def meta_features(text: str, lang: str | None, source: str | None, known: Known) -> np.ndarray:
    """The metadata view: length and layout of lines, language and source (the last place of each: others and unknown ones)."""
    lines = text.split("\n")
    sizes = np.array([len(x) for x in lines])
    blank = sum(not x.strip() for x in lines) / len(lines)
    layout = [np.log1p(len(text)), np.log1p(len(lines)), np.log1p(sizes.max()), np.log1p(sizes.mean()), np.log1p(sizes.min()), blank, sizes.std() / (1 + sizes.mean())]
    out = np.zeros(LAYOUT + sum(len(k) + 1 for k in known), np.float32)
    out[:LAYOUT] = layout
    at = LAYOUT
    for value, places in zip((lang, source), known, strict=True):
        out[at + places.get(value, len(places))] = 1
        at += len(places) + 1
    return out


def _vectors(rows: list[tuple], known: Known) -> tuple[np.ndarray, np.ndarray]:
    """Features of both views of (text, lang, source)."""
    return np.stack([content_features(t) for t, _, _ in rows]), np.stack([meta_features(*r, known) for r in rows])


def _rows(batch: pa.RecordBatch) -> list[tuple]:
    return list(zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "source")), strict=True))


class Logistic:
    """A logistic model over standardised features, fitted by full-batch Adam from zero or from where it stands."""

    def __init__(self, width: int):
        self.w, self.b = np.zeros(width), 0.0
        self.mean, self.std = np.zeros(width), np.ones(width)

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int, l2: float = 1e-3) -> Logistic:
        if not self.w.any():
            self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = ((x - self.mean) / self.std).clip(-8, 8)
        weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
        m, v = np.zeros(len(self.w) + 1), np.zeros(len(self.w) + 1)
        for step in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w + self.b, -30, 30)))
            d = (p - y) * weight
            g = np.r_[z.T @ d + l2 * self.w, d.sum()]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = 0.03 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            self.w, self.b = self.w - move[:-1], self.b - move[-1]
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.std).clip(-8, 8) @ self.w + self.b, -30, 30)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _calibrate(columns: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias of a plain logistic fit of a few columns, by Newton steps on slightly smoothed labels."""
    x = np.c_[columns, np.ones(len(columns))]
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = _sigmoid(x @ w)
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), x.T @ (p - target) + 1e-3 * w)
    return w


class CoTrained:
    """Two calibrated views, what they know of languages and sources, and their combination."""

    def __init__(self, known: Known, views: list[Logistic], scales: list[np.ndarray], both: np.ndarray):
        self.known, self.views, self.scales, self.both = known, views, scales, both

    def logits(self, *parts: np.ndarray) -> np.ndarray:
        """Calibrated logits, a column a view."""
        return np.c_[tuple(v.logit(x) * s[0] + s[1] for v, x, s in zip(self.views, parts, self.scales, strict=True))]

    def scores(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good: by content, by metadata, by both."""
        logits = self.logits(content, meta)
        return _sigmoid(logits[:, 0]), _sigmoid(logits[:, 1]), _sigmoid(logits @ self.both[:2] + self.both[2])


class Lessons:
    """Both views' training rows: the labelled ones, and what the other view teaches."""

    def __init__(self, known: Known, parts: tuple[np.ndarray, np.ndarray], y: np.ndarray):
        """Rows in hash order; every fourth is kept apart for calibration."""
        self.known, apart = known, np.arange(len(y)) % round(1 / APART) == 0
        self.apart, self.truth = [x[apart] for x in parts], y[apart]
        self.own = [[x[~apart], y[~apart]] for x in parts]
        self.views = [Logistic(x.shape[1]) for x in parts]

    def usable(self) -> bool:
        """Whether both classes are there, apart and to learn from."""
        return len({*self.truth}) == 2 and len({*self.own[0][1]}) == 2

    def model(self, steps: int) -> CoTrained:
        for view, part in zip(self.views, self.own, strict=True):
            view.fit(*part, steps=steps)
        found = CoTrained(self.known, self.views, [np.array([1.0, 0.0])] * 2, np.zeros(3))
        found.scales = [_calibrate(v.logit(x)[:, None], self.truth) for v, x in zip(self.views, self.apart, strict=True)]
        found.both = _calibrate(found.logits(*self.apart), self.truth)
        return found

    def teach(self, learner: int, label: int, x: np.ndarray) -> None:
        self.own[learner][0] = np.concatenate([self.own[learner][0], x])
        self.own[learner][1] = np.concatenate([self.own[learner][1], np.full(len(x), float(label))])


#: (teacher, label) by number.
GROUPS = ((0, 1), (0, 0), (1, 1), (1, 0))


def surest(model: CoTrained, parts: tuple[np.ndarray, np.ndarray], share: int = SHARE, sure: float = SURE, free: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each (teacher, label) the rows it is surest of, at least sure, and how sure it is. free: by learner, which rows it hasn't been taught."""
    p = _sigmoid(model.logits(*parts))
    out = []
    for teacher, label in GROUPS:
        own = p[:, teacher] if label else 1 - p[:, teacher]
        if free is not None:
            own = np.where(free[1 - teacher], own, -1.0)
        best = np.argsort(-own, kind="stable")[:share]
        best = best[own[best] >= sure]
        out.append((best, own[best]))
    return out


def _candidates(model: CoTrained, taught: list[frozenset], share: int):
    """A task's surest documents for each (teacher, label), without those that the learner has been taught."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = [[] for _ in GROUPS]
        for batch in batches:
            rows, keys = _rows(batch), list(zip(batch.column("id").to_pylist(), batch.column("mark").to_pylist(), strict=True))
            for at in range(0, len(rows), 1000):
                parts = _vectors(rows[at : at + 1000], model.known)
                own = keys[at : at + 1000]
                free = tuple(np.array([k not in known for k in own]) for known in taught)
                for group, (chosen, how) in enumerate(surest(model, parts, share, free=free)):
                    learner = 1 - GROUPS[group][0]
                    held[group] += [(-float(p), *own[i], parts[learner][i].tobytes()) for i, p in zip(chosen.tolist(), how, strict=True)]
                    held[group] = sorted(held[group], key=_least_first)[:share]
        rows = [(group, *row) for group, own in enumerate(held) for row in own]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["which", "unsure", "id", "mark", "x"])

    return tidy(run, TEXTS), "which int, unsure double, id long, mark long, x binary"


def _least_first(row: tuple) -> tuple:
    return row[0], row[1] is not None, row[1] or 0, row[2]


def _chosen(docs: DataFrame, model: CoTrained, taught: list[frozenset], share: int) -> list:
    """All documents' surest for each (teacher, label): share rows each at most reach the driver."""
    run, schema = _candidates(model, taught, share)
    found = docs.mapInArrow(run, schema).withColumn("salt", F.pmod("mark", F.lit(SALTS)))
    order = ("unsure", "id", "mark")
    for keys in (("which", "salt"), ("which",)):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        found = found.withColumn("place", place).where(F.col("place") <= share).drop("place")
    return sorted(found.collect(), key=lambda r: (r.which, *_least_first((r.unsure, r.id, r.mark))))


def _score(model: CoTrained | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _rows(batch)
            found = [np.ones(len(rows))] * 3
            if model is not None and rows:
                parts = [model.scores(*_vectors(rows[at : at + 1000], model.known)) for at in range(0, len(rows), 1000)]
                found = [np.concatenate(p) for p in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, found)], ["id", "p_content", "p_meta", "score"])

    return run


def _views(docs: DataFrame, key: str) -> DataFrame:
    have = set(docs.columns)
    return docs.select(
        F.col(key).cast("long").alias("id"), text_of().alias("text"),
        *[(F.col(c).cast("string") if c in have else F.lit(None).cast("string")).alias(c) for c in ("lang", "source")],
    )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, share: int = SHARE) -> CoTrained | None:
    """A model from at most sample labelled documents and all unlabelled ones; None without labels of both classes.

    Null labels count as none; several labels of one document as their mean. Of rows that share a labelled id,
    the one whose text has the smallest hash is learned from. Rows without an id are unlabelled.
    """
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("quality"))
    order = F.xxhash64("doc_id", F.lit(11))
    # At most sample rows of an id and a label, so this side may be broadcast.
    wanted = materialize(marks.orderBy(order, "doc_id").limit(sample).withColumnRenamed("doc_id", "id"), "labelled")
    every = _views(docs, "doc_id").withColumn("mark", F.xxhash64("text"))
    row = F.min(F.struct("mark", "text", "lang", "source", "quality")).alias("r")
    rows = every.join(F.broadcast(wanted), "id").groupBy("id").agg(row).select("id", "r.*").orderBy(F.xxhash64("id", F.lit(11)), "id").collect()
    if not rows:
        return None
    counts = [Counter(r[c] for r in rows if r[c] is not None) for c in ("lang", "source")]
    known = tuple({v: i for i, v in enumerate(sorted(v for v, n in c.items() if n >= LEAST))} for c in counts)
    lessons = Lessons(known, _vectors([(r.text, r.lang, r.source) for r in rows], known), np.array([r.quality for r in rows]))
    if not lessons.usable():
        return None
    model = lessons.model(200)
    # All labelled documents are left out, also those beyond the sample: nothing may teach the opposite of a label.
    labelled = materialize(marks.select(F.col("doc_id").alias("id")), "labelled-ids")
    told = F.broadcast(labelled) if labelled.count() <= BROADCAST else labelled
    others = every.join(told, "id", "left_anti").select("id", "mark", "text", "lang", "source")
    taught: list[frozenset] = [frozenset(), frozenset()]
    for _ in range(rounds):
        chosen = _chosen(others, model, taught, share)
        if not chosen:
            break
        for group, (teacher, label) in enumerate(GROUPS):
            own = [r for r in chosen if r.which == group]
            if own:
                lessons.teach(1 - teacher, label, np.stack([np.frombuffer(r.x, np.float32) for r in own]))
                taught[1 - teacher] |= {(r.id, r.mark) for r in own}
        model = lessons.model(60)
    return model


def score(docs: DataFrame, model: CoTrained | None, key: str = "doc_id") -> DataFrame:
    """(id, p_content, p_meta, score) of every row: probabilities of being good. Without a model all are 1."""
    return _views(docs, key).mapInArrow(tidy(_score(model), TEXTS), "id long, p_content double, p_meta double, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, p_content, p_meta, score and keep of every row of docs.

    Null texts count as empty, missing or null lang and source as unknown; null and repeated ids are scored
    row by row. Without labels of both classes every row is kept with score 1. Other columns are ignored.
    """
    found = score(docs, fit(docs, labels))
    return found.select(F.col("id").alias("doc_id"), "p_content", "p_meta", "score", (F.col("score") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that classify keeps, in docs' columns."""
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            columns = [batch.column("doc_id").cast(pa.int64())]
            columns.append(pa.array([t or "" for t in batch.column("text").to_pylist()], pa.string()))
            columns += [batch.column(c).cast(pa.string()) if c in names else pa.nulls(batch.num_rows, pa.string()) for c in ("lang", "source")]
            part = pa.RecordBatch.from_arrays(columns, ["id", "text", "lang", "source"])
            for found in _score(model)(iter([part])):
                yield batch.filter(pa.array(found.column("score").to_numpy() >= threshold))

    return docs.mapInArrow(tidy(run, TEXTS), docs.schema)


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every document scored by a classifier fitted on labels."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
