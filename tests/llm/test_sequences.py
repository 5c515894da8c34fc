"""Collocations, periodic runs and language ID against plain versions and held-out documents."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from querent.llm import collocations, language, periodic_runs

FOLDER = os.path.join(os.environ.get("QUERENT_TESTDATA", "/root/testdata"), "sf0.001")


# --- periodic runs ---------------------------------------------------------------------------------


def plain_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_report(words):
    found = plain_runs(words)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(words), len(found), *four, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()


def periodic_texts():
    r = random.Random(1)
    out = []
    for _ in range(250):
        n, kinds = r.randint(0, 150), r.choice([1, 2, 3, 50])
        words = [f"w{r.randrange(kinds)}" for _ in range(n)]
        if n > 30 and r.random() < 0.7:
            a, p = r.randrange(n - 5), r.randint(1, 12)
            words = [*words[:a], *(words[a + i % p] if a + i % p < n else "x" for i in range(n - a)), *(f"w{r.randrange(kinds)}" for _ in range(r.randint(0, 20)))]
        out.append(r.choice([" ", "\n", " \t\r\x0b\x0c"]).join(words))
    return [*out, "ab " * 23, "ab " * 24, "a b " * 12, "é\x00 é\x00 é\x00 " * 10, "　 " * 30]


def test_periodic_runs(spark):
    rows = [(i % 200, t, "x") for i, t in enumerate(periodic_texts())] + [(None, None, "x"), (None, "", "y"), (7, "a " * 30, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, period string")
    got = Counter(tuple(r) for r in periodic_runs.periodic_runs(docs).collect())
    want = Counter((i, *plain_report([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w])) for i, t, _ in rows)
    assert got == want
    assert sum(r[2] for r in want) > 100
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_periodic_runs_of_long_texts_and_slices(monkeypatch):
    r = random.Random(2)
    period = [f"p{i}" for i in range(5000)]
    words = [f"w{r.randrange(9)}" for _ in range(30_000)] + (period * 5)[: 20_000 + 17] + ["end"] + ["one"] * 5000
    lists = [[w.encode() for w in part] for part in (words, words[:10], [], words[29_990:])]
    whole = [[a.tolist() for a in f] for f in periodic_runs.find(lists)]
    assert (30_000, 50_017, 5000) in zip(*whole[0], strict=True)
    assert (50_018, 55_018, 1) in zip(*whole[0], strict=True)
    monkeypatch.setattr(periodic_runs, "SLICE", 10)
    assert [[a.tolist() for a in f] for f in periodic_runs.find(lists)] == whole


def test_periodic_query(spark):
    """The query against the plain version, over the smallest tables."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    want = []
    for d in docs:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", d.text or "") if w]
        h = zlib.crc32(str(d.doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n < 3000:
            want.append((d.doc_id, *plain_report(words)[1:]))
    small = {r[0] for r in want}
    got = [tuple(r) for r in periodic_runs.op12_periodic_runs(spark, FOLDER).collect()]
    assert len(got) == len(docs)
    assert sorted(r for r in got if r[0] in small) == sorted(want)
    assert sum(r[1] for r in want) > 5


def test_collapse_runs(spark):
    docs = spark.createDataFrame([(1, "x  y", None), (2, "a b " * 20 + "c", 3), (3, None, 4)], "doc_id long, text string, n int")
    got = {r.doc_id: r.text for r in periodic_runs.collapse_runs(docs).collect()}
    assert got == {1: "x  y", 2: "a b c", 3: None}


# --- collocations ----------------------------------------------------------------------------------


def plain_collocations(rows, least, top):
    counts, totals, out = defaultdict(Counter), Counter(), []
    for lang, text in rows:
        lang, text = lang or "und", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, 6):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    for lang, c in counts.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + k] for p, a in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if a >= candidates[p[i : i + k]]}
        rows = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min(((1000 * a * totals[lang]) // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "shard"), [(5, 50, 300), (20, 1000, collocations.SHARD)])
def test_collocations(spark, least, top, shard):
    r = random.Random(3)
    words, ends = ["the", "of", "A", "b", "c", "é", "Ünd", "x", "\x00y", "zz"], [" ", " ", "  ", "\t", ", ", ".", "\n", " "]
    rows = [(r.choice(["en", "de", None]), None if r.random() < 0.05 else "".join(r.choice(words) + r.choice(ends) for _ in range(r.randint(0, 60)))) for _ in range(300)]
    rows += [("one", "same words here again. " * 60)] * 3 + [("one", "")]
    docs = spark.createDataFrame([(*x, 1, "p") for x in rows], "lang string, text string, k int, phrase string").repartition(5)
    got = sorted(tuple(x) for x in collocations.collocations(docs, least=least, top=top, shard=shard).collect())
    assert got == plain_collocations(rows, least, top)


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([("en", "a b c"), (None, None)], "lang string, text string")
    assert collocations.collocations(docs).count() == 0
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_collocation_scores_beyond_64_bits(spark):
    big = 30_000_000_000_000_000
    counts = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big), ("en", "b", 1, big + 7)], "lang string, phrase string, k int, f long")
    totals = spark.createDataFrame([("en", big + 9)], "lang string, n long")
    (got,) = collocations.scored(counts, totals).collect()
    assert got.score == 1000 * big * (big + 9) // (big * (big + 7))


def test_suffix_array():
    r = random.Random(4)
    ids = np.array([r.randrange(3) for _ in range(200)])
    rest = np.arange(200, 0, -1)
    order, common = collocations.suffix_array(ids, rest, rest, 8)
    lists = [ids[i : i + 8].tolist() for i in range(200)]
    assert [lists[i] for i in order] == sorted(lists)
    for x, y, c in zip(order[:-1], order[1:], common[1:], strict=True):
        same = next((i for i, (p, q) in enumerate(zip(lists[x], lists[y], strict=False)) if p != q), min(len(lists[x]), len(lists[y])))
        assert min(c, 8) == same


# --- language --------------------------------------------------------------------------------------


def test_backpropagation():
    rng = np.random.default_rng(1)
    net, x, y = language.Network(["a", "b", "c"], 4), rng.integers(0, 256, (12, 5)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    _, slopes = net.gradients(x, y)
    for part, slope in zip(net.parts(), slopes, strict=True):
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        old, found = part[at], []
        for step in (1e-2, -1e-2):
            part[at] = old + step
            found.append(net.gradients(x, y)[0])
        part[at] = old
        assert (found[0] - found[1]) / 2e-2 == pytest.approx(slope[at], rel=2e-2, abs=1e-4)


def plain_pooled(net, text):
    """Probabilities by a network, byte by byte."""
    total, weight = np.zeros(len(net.langs)), 0
    for at in range(0, len(text), language.READ):
        part = text[at : at + language.READ]
        states = []
        for way, data in zip(net.ways, (part, part[::-1]), strict=True):
            k, h, own = way.width, np.zeros(way.width), []
            for b in data:
                e, g = way.w[:, b], way.u @ h
                z, r = 1 / (1 + np.exp(-(e[:k] + g[:k]))), 1 / (1 + np.exp(-(e[k : 2 * k] + g[k : 2 * k])))
                h = (1 - z) * np.tanh(e[2 * k :] + r * g[2 * k :]) + z * h
                own.append(h)
            states.append(own)
        for b, f, g in zip(part, states[0], states[1][::-1], strict=True):
            if b >= 128 or chr(b).isalpha():
                p = np.exp(net.v @ np.r_[f, g] + net.b[:, 0])
                total, weight = total + p / p.sum(), weight + 1
    return total / max(1, weight)


def test_every_byte_counts():
    net = language.Network(["a", "b", "c"], 8)
    texts = ["", "a", "words of 1 text, " * 60, "é" * 64, "1234", "x" * 127 + "é end"]
    got = net.pooled([t.encode() for t in texts])
    for t, p in zip(texts, got, strict=True):
        assert p == pytest.approx(plain_pooled(net, t.encode()), abs=1e-4)


def test_language_of_held_out_documents(spark):
    folder = FOLDER.replace("sf0.001", "sf0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    got = language.op13_language_id(spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    for lang in set(truth.values()):
        own = [r.lang_pred == lang for r in got if r.held_out and truth[r.doc_id] == lang]
        assert len(own) > 10
        assert sum(own) / len(own) >= 0.95


def test_language_edges(spark):
    rows = [(i, "der die das und nicht " * 3, "de", "z") for i in range(40)] + [(100 + i, "the of and that with " * 3, "en", "z") for i in range(40)]
    rows += [(500, None, "de", "z"), (501, "", "en", "z"), (502, "123 !? €", "en", "z"), (None, "the of and that " * 20_000, None, "z"), (None, "der die das und", "de", "z"), (100, "the of and", "en", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out string")
    net = language.fit(docs)
    assert net.langs == ["de", "en"]
    got = language.identify(docs, net).collect()
    assert len(got) == len(rows)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (500, 501, 502))
    assert {r.lang_pred for r in got if r.doc_id is None} == {"de", "en"}
    assert not any(r.held_out for r in got if r.doc_id is None)
    alone = docs.where("lang = 'de'")
    assert {r.lang_pred for r in language.identify(alone, language.fit(alone)).where("doc_id < 100").collect()} == {"de"}
    assert language.fit(docs.limit(0)) is None
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}
    assert language.identify(docs.limit(0), net).count() == 0
