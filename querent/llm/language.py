"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent units read a text's bytes, one in each direction; at every byte their states give a probability
for each language, and a document's probabilities are the mean over its letters' bytes. The network is trained in
numpy by backpropagation through time, with the document's language as the label of each of its bytes.

Fitting sees a bounded sample: PER_LANG documents of each of the LANGS most frequent languages, in the order of a
hash, and PIECES stretches of SPAN bytes of each, spread over the whole text. Prediction reads every byte of every
text, in stretches of READ bytes that are batched as columns; the states start anew at each stretch. Rows are
independent, so scoring shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querent.llm.common import once, tidy

#: Bounds of what fitting sees: languages, documents a language, stretches a document, bytes a stretch.
LANGS, PER_LANG, PIECES, SPAN = 256, 240, 4, 64
#: Width of a direction's state; updates, columns of an update, and the step size.
WIDTH, STEPS, COLUMNS, RATE = 8, 260, 256, 0.02
#: Bytes of a stretch in prediction, and about how many values a batch of stretches holds for the languages.
READ, VALUES = 128, 1 << 20
#: Text bytes a worker scores at once.
BYTES = 4 << 20
#: The language of a text without letters.
NONE = "und"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Direction:
    """One gated recurrent unit: weights of bytes (3 * width, 256) and of states (3 * width, width) for update, reset and candidate."""

    def __init__(self, width: int, rng: np.random.Generator):
        self.width = width
        self.w = rng.normal(0, 0.3, (3 * width, 256)).astype(np.float32)
        self.u = rng.normal(0, 1 / np.sqrt(width), (3 * width, width)).astype(np.float32)

    def train_forward(self, x: np.ndarray) -> np.ndarray:
        """States (time, width, columns) after each byte of x (time, columns); keeps what the way back needs."""
        k, (t, n) = self.width, x.shape
        h = np.zeros((k, n), np.float32)
        self.x, self.past, states = x, [], np.empty((t, k, n), np.float32)
        for i in range(t):
            e, g = self.w[:, x[i]], self.u @ h
            gates = sigmoid(e[: 2 * k] + g[: 2 * k])
            z, r, own = gates[:k], gates[k:], g[2 * k :]
            c = np.tanh(e[2 * k :] + r * own)
            self.past.append((h, z, r, own, c))
            h = (1 - z) * c + z * h
            states[i] = h
        return states

    def train_backward(self, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of w and u by backpropagation through time, from those of the states."""
        k, (t, n) = self.width, self.x.shape
        d_u, d_in = np.zeros_like(self.u), np.empty((3 * k, t, n), np.float32)
        d_h = np.zeros((k, n), np.float32)
        for i in range(t - 1, -1, -1):
            h, z, r, own, c = self.past[i]
            d = d_states[i] + d_h
            d_c = d * (1 - z) * (1 - c * c)
            d_z = d * (h - c) * z * (1 - z)
            d_r = d_c * own * r * (1 - r)
            d_in[:k, i], d_in[k : 2 * k, i], d_in[2 * k :, i] = d_z, d_r, d_c
            d_g = np.concatenate([d_z, d_r, d_c * r])
            d_u += d_g @ h.T
            d_h = d * z + self.u.T @ d_g
        flat = self.x.ravel()
        d_w = np.stack([np.bincount(flat, row.ravel(), 256) for row in d_in]).astype(np.float32)
        return d_w, d_u

    def states(self, x: np.ndarray, active: np.ndarray, back: bool) -> np.ndarray:
        """States (width, time, columns) at each byte of x (time, columns); of column order by falling length, active[t] columns have a byte t."""
        k, (t, n) = self.width, x.shape
        # The sigmoid is 0.5 + 0.5 * tanh(x / 2); halving the weights of the gates beforehand saves its inner product.
        half = np.r_[np.full(2 * k, 0.5), np.ones(k)].astype(np.float32)[:, None]
        w, u = self.w * half, self.u * np.r_[np.full(3 * k, 0.5)].astype(np.float32)[:, None]
        out, h, g, e = np.zeros((k, t, n), np.float32), np.zeros((k, n), np.float32), np.empty((3 * k, n), np.float32), np.empty((3 * k, n), np.float32)
        for i in range(t - 1, -1, -1) if back else range(t):
            m = int(active[i])
            if not m:
                continue
            now, a, b = h[:, :m], g[:, :m], e[:, :m]
            np.matmul(u, now, out=a)
            np.take(w, x[i, :m], axis=1, out=b, mode="clip")
            b[: 2 * k] += a[: 2 * k]
            gates = np.tanh(b[: 2 * k], out=b[: 2 * k])
            z, r, c = gates[:k], gates[k:], b[2 * k :]
            r += 1
            r *= a[2 * k :]
            c += r
            np.tanh(c, out=c)
            # h = c + z' * (h - c) with z' = 0.5 + 0.5 * z
            now -= c
            z += 1
            z *= 0.5
            now *= z
            now += c
            out[:, i, :m] = now
        return out


class Network:
    """Both directions and the layer that turns their states into languages."""

    def __init__(self, langs: list[str], width: int = WIDTH, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.width = langs, width
        self.ways = [Direction(width, rng), Direction(width, rng)]
        self.v = rng.normal(0, 0.3, (len(langs), 2 * width)).astype(np.float32)
        self.b = np.zeros((len(langs), 1), np.float32)

    def parts(self) -> list[np.ndarray]:
        return [a for way in self.ways for a in (way.w, way.u)] + [self.v, self.b]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over all bytes of x (time, columns), whose columns have languages y, and the gradients of parts()."""
        k, (t, n) = self.width, x.shape
        ahead = self.ways[0].train_forward(x)
        behind = self.ways[1].train_forward(x[::-1])[::-1]
        both = np.concatenate([ahead, behind], axis=1)  # time, 2 * width, columns
        logits = self.v @ both + self.b
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        column = np.arange(n)
        loss = float(-np.log(p[:, y, column] + 1e-9).mean())
        p[:, y, column] -= 1
        p /= t * n
        d_both = self.v.T @ p
        out = [*self.ways[0].train_backward(d_both[:, :k]), *self.ways[1].train_backward(d_both[::-1, k:])]
        return loss, [*out, np.einsum("tln,tkn->lk", p, both, optimize=True), p.sum(axis=(0, 2))[:, None]]

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, columns: int = COLUMNS, rate: float = RATE, seed: int = 7) -> Network:
        """Adam over batches in which languages are equally frequent; x (rows, SPAN) bytes, y numbers of languages."""
        rng = np.random.default_rng(seed)
        own = [np.flatnonzero(y == i) for i in range(len(self.langs))]
        own = [o for o in own if len(o)]
        mean, square = [np.zeros_like(a) for a in self.parts()], [np.zeros_like(a) for a in self.parts()]
        for step in range(1, steps + 1):
            chosen = np.concatenate([o[rng.integers(0, len(o), -(-columns // len(own)))] for o in own])
            _, slopes = self.gradients(np.ascontiguousarray(x[chosen].T), y[chosen])
            norm = np.sqrt(sum(float((s * s).sum()) for s in slopes))
            now = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
            for a, m, v, s in zip(self.parts(), mean, square, slopes, strict=True):
                s = s * min(1.0, 1.0 / (norm + 1e-9))
                m += 0.1 * (s - m)
                v += 0.01 * (s * s - v)
                a -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        return self

    def byte_probabilities(self, x: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Probabilities (languages, time, columns) of every byte of x (time, columns)."""
        k, (t, n) = self.width, x.shape
        ahead = self.ways[0].states(x, active, False).reshape(k, t * n)
        behind = self.ways[1].states(x, active, True).reshape(k, t * n)
        logits = self.v[:, :k] @ ahead
        logits += self.v[:, k:] @ behind
        logits += self.b
        logits -= logits.max(axis=0)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=0)
        return logits.reshape(-1, t, n)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities (texts, languages): the means over bytes of letters, of all bytes where there is none; 0 for an empty text."""
        n = len(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts) + bytes(READ), np.uint8)
        counts = -(-sizes // READ)
        doc = np.repeat(np.arange(n), counts)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = (np.cumsum(sizes) - sizes)[doc] + piece * READ
        length = np.minimum(READ, sizes[doc] - piece * READ)
        order = np.argsort(-length, kind="stable")
        letter = once("letter bytes", lambda: np.array([b >= 128 or chr(b).isalpha() for b in range(256)]))
        total, weight = np.zeros((n, len(self.langs))), np.zeros(n)
        columns = max(16, VALUES // (READ * max(8, len(self.langs))))
        for at in range(0, len(order), columns):
            own = order[at : at + columns]
            t = int(length[own[0]])
            x = np.ascontiguousarray(data[start[own][None, :] + np.arange(t)[:, None]])
            active = np.searchsorted(-length[own], -np.arange(t), "left")  # columns longer than t
            p = self.byte_probabilities(x, active)
            told = letter[x] & (np.arange(t)[:, None] < length[own])
            p *= told
            for i, row in enumerate(p.sum(axis=1, dtype=np.float64)):
                total[:, i] += np.bincount(doc[own], row, n)
            weight += np.bincount(doc[own], told.sum(axis=0), n)
        return total / np.maximum(weight, 1)[:, None]


def spread(text: bytes, pieces: int, span: int) -> list[bytes]:
    """Stretches of span bytes spread evenly over a text; a shorter text is one stretch, repeated to its length."""
    if len(text) <= span:
        return [((text + b" ") * (span // (len(text) + 1) + 1))[:span]] if text else []
    count = min(pieces, len(text) // span)
    return [text[at : at + span] for at in np.linspace(0, len(text) - span, count).astype(int).tolist()]


def _sample(pieces: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(lang, place, i, part) for lang, place, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "place", "text")), strict=True) for i, part in enumerate(spread(text.encode(), pieces, span))]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["lang", "place", "piece", "part"])

    return tidy(run, 200)


def held_out(column: str = "doc_id") -> F.Column:
    """Whether a document is kept from fitting: by the CRC of its id as text, an id of null not."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", per_lang: int = PER_LANG) -> Network | None:
    """A network fitted on documents that aren't held out and have a language; None where there is none.

    At most LANGS * per_lang * PIECES stretches of SPAN bytes reach the driver.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & ~held_out("id"))
    # Of LANGS rows at most. The rate leaves about twice the wanted rows of a language, so no language is gathered whole.
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS)
    mark = F.xxhash64(F.coalesce("id", F.lit(0).cast("long")), F.lit(13))
    some = rows.join(F.broadcast(counts), "lang").withColumn("mark", mark)
    some = some.where((F.pmod("mark", F.lit(1 << 30)) * F.col("count") < F.lit((2 * per_lang + 60) * (1 << 30))) & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("mark", F.xxhash64("text")))
    some = some.withColumn("place", place).where(F.col("place") <= per_lang).select("lang", "place", "text")
    parts = some.mapInArrow(_sample(PIECES, SPAN), "lang string, place int, piece int, part binary").orderBy("lang", "place", "piece").collect()
    langs = sorted({r.lang for r in parts})
    if not langs:
        return None
    x = np.frombuffer(b"".join(bytes(r.part) for r in parts), np.uint8).reshape(-1, SPAN)
    network = Network(langs)
    return network.fit(x, np.array([langs.index(r.lang) for r in parts])) if len(langs) > 1 else network


def _predict(network: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            told = [any(c.isalpha() for c in t) for t in texts]
            names, scores = [NONE] * len(texts), np.zeros(len(texts))
            at = 0
            while network is not None and at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= BYTES):
                    size += len(texts[to])
                    to += 1
                own = [i for i in range(at, to) if told[i]]
                p = network.pooled([texts[i].encode() for i in own])
                for i, row in zip(own, p, strict=True):
                    best = int(row.argmax())
                    names[i], scores[i] = network.langs[best], min(1.0, float(row[best]))
                at = to
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, network: Network | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs, from its text alone.

    Null texts and texts without a letter are und with score 0, and so are all without a network. Null and repeated
    ids are scored row by row; other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), held_out(id_column).alias("held_out"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(tidy(_predict(network), 1000), "doc_id long, held_out boolean, lang_pred string, score double")


def op13_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every text of documents, learned from those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, fit(docs))
