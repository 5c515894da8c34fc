"""Exact, near and substring dedup against plain versions on small fixtures."""

import hashlib
import os
import random
import re

import numpy as np
import pytest

from querent.llm import exact_dedup, near_copies, simhash, substring_dedup, suffix_dedup

SPACES = re.compile(r"[\x20\x09-\x0D]")
SCHEMA = "doc_id long, text string, rid int, key string, n long, start int"


def frame(spark, rows):
    """Rows (doc_id, text) beside columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], SCHEMA)


def corpus(seed=0, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["été", "語", "😀"]
    passage = " ".join(r.choice(words) for _ in range(45))
    rows = []
    for i in range(n):
        text = " ".join(r.choice(words) for _ in range(r.randint(0, 90)))
        if i % 4 == 1:
            text = f"{text} {passage} {text[:40]}"
        if i % 7 == 3 and rows:
            text = r.choice(rows)[1] or ""
        if i % 11 == 5:
            text = text.replace(" ", " \t\n")
        rows.append((i, text))
    return [*rows, (100, None), (101, ""), (102, "a"), (103, "spam " * 400), (None, passage)]


def plain_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACES.sub("", t or ""), []).append((-len(t or ""), i is not None, i or 0, i))
    out = {}
    for s, group in groups.items():
        keep = min(group)[3]
        for _, _, _, i in group:
            out[i] = (keep, len(group), i == keep, hashlib.sha256(s.encode()).hexdigest())
    return out


@pytest.mark.parametrize("block", [7, 4096])
def test_exact_dedup(spark, block):
    rows = corpus()
    got = exact_dedup.exact_dedup(frame(spark, rows).repartition(5), block=block).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == plain_exact(rows)


def test_exact_dedup_repeated_rows_and_empty_table(spark):
    rows = frame(spark, [(1, "a b"), (1, "a b"), (2, "ab"), (3, "a  b")])
    got = exact_dedup.exact_dedup(rows).collect()
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in got) == [(1, 3, False), (1, 3, False), (2, 3, False), (3, 3, True)]
    kept = exact_dedup.keep_first(frame(spark, [(1, "a b"), (1, "a b"), (2, "c")]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2] and kept.columns == rows.columns
    assert exact_dedup.exact_dedup(rows.limit(0)).count() == 0


def test_keep_first_with_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a b", 77, 7, 8, "n"), (2, "ab", 78, 9, 9, "m"), (3, "c", 79, 1, 2, "o")], "doc_id long, text string, _row int, _root int, pos int, name string")
    for module in (exact_dedup, near_copies):
        got = module.keep_first(rows)
        assert got.columns == rows.columns
        kept = {1, 3} if module is exact_dedup else {1, 2, 3}
        assert sorted(map(tuple, got.collect())) == [tuple(r) for r in rows.collect() if r.doc_id in kept]


def test_exact_dedup_hot_run_spans_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = frame(spark, [(i, "same text here" if i % 3 else f"text {i}") for i in range(600)])
        got = exact_dedup.exact_dedup(rows, block=4).where("group_size > 1").collect()
        assert len(got) == 400 and {r.keep_id for r in got} == {1}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def components(marks):
    root = list(range(len(marks)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(marks))]


def test_anchors_cover_all_pairs_within_two_bits():
    r = np.random.default_rng(3)
    x = r.integers(0, 2**63, 3000, dtype=np.uint64)
    y = x.copy()
    for k in range(len(y)):
        for bit in r.choice(64, r.integers(0, 3), replace=False):
            y[k] ^= np.uint64(1 << int(bit))
    i, anchor, home = simhash.anchors(x)
    homes = dict(zip(i[home], anchor[home]))
    j, other, _ = simhash.anchors(y)
    near = set(zip(j, other))
    assert len(homes) == len(x) and all((k, homes[k]) in near for k in range(len(x)))


@pytest.mark.parametrize(("small", "large"), [(24, 16_384), (1, 16_384), (1, 1)])
def test_links_join_what_is_close(monkeypatch, small, large):
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "LARGE", large)
    r = random.Random(5)
    marks = {r.getrandbits(64) for _ in range(10)}
    for m in list(marks):
        for _ in range(12):
            m ^= 1 << r.randrange(64)
            marks.add(m)
    marks = np.array(sorted(marks), np.uint64)
    u, v = simhash.links(np.zeros(len(marks), np.int32), marks, np.ones(len(marks), bool))
    assert all((int(a) ^ int(b)).bit_count() <= 2 for a, b in zip(u, v))
    place = {int(m): i for i, m in enumerate(marks)}
    want = components([int(m) for m in marks])
    root = list(range(len(marks)))
    for a, b in zip(u, v):
        a, b = root[place[int(a)]], root[place[int(b)]]
        root = [b if x == a else x for x in root]
    assert len(set(root)) == len(set(want))
    assert len(set(zip(root, want))) == len(set(want))


def test_simhash_components(spark):
    rows = corpus(2, 40)
    base = " ".join(f"t{i}" for i in range(900))
    rows += [(200 + i, base.replace(f"t{100 + 40 * i} ", f"u{i} ")) for i in range(8)] + [(300, base.upper()), (301, "One"), (302, "one")]
    got = {r.doc_id: r for r in simhash.simhash_components(frame(spark, rows)).collect()}
    marks = [simhash.fingerprint(t or "", 3) for _, t in rows]
    assert {i: got[i].fingerprint for i, _ in rows} == {i: f"{m:016x}" for (i, _), m in zip(rows, marks)}
    root = components(marks)
    lowest = {}
    for (i, _), c in zip(rows, root):
        if i is not None:
            lowest[c] = min(i, lowest.get(c, i))
    assert all(got[i].component_id == lowest.get(c) for (i, _), c in zip(rows, root))
    assert got[100].fingerprint == "0" * 16 and got[301].component_id == got[302].component_id == 301
    assert simhash.simhash_components(frame(spark, rows).limit(0)).count() == 0


def test_fingerprint_by_hand():
    import xxhash

    words = b"the quick brown fox jumps".split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(3)]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 3)
    assert simhash.fingerprint("The QUICK brown\tfox\n jumps ", 3) == bits
    assert simhash.fingerprint("a b", 3) == xxhash.xxh64_intdigest(b"a b", 42)


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def covered(sequence, width, seen):
    gone = [False] * len(sequence)
    for i in range(len(sequence) - width + 1):
        key = tuple(sequence[i : i + width])
        if key in seen:
            gone[i : i + width] = [True] * width
        seen.add(key)
    return gone


def plain_substrings(rows):
    seen, want = set(), {}
    for i, t in order(rows):
        words = (t or "").encode().split()
        gone = covered(words, 20, seen)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        want[i] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return want


def plain_bytes(rows):
    seen, want = set(), {}
    for i, t in order(rows):
        data = (t or "").encode()
        gone = covered(data, 100, seen)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not before for g, before in zip(gone, [False, *gone]))
        want[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return want


def test_words_are_hashed_in_all_texts_at_once():
    r = random.Random(3)
    parts = ["a", "bb", " ", "\t", "\n", "\v", "\f", "\r", "\0", "\x1c", "\x85", "\xa0", "é", "a\0", "12345678", "123456789"]
    texts = ["".join(r.choice([*parts, "x" * r.randrange(1, 300)]) for _ in range(r.randrange(60))) for _ in range(3000)] + ["", " ", "x "]
    known = {}
    for at, to, found, bounds in substring_dedup.word_slices(texts):
        for i in range(at, to):
            words, own = substring_dedup.words_of(texts[i]), found[bounds[i - at] : bounds[i - at + 1]].tolist()
            assert len(words) == len(own) and all(known.setdefault(w, h) == h for w, h in zip(words, own, strict=True))
    assert len(set(known.values())) == len(known)
    assert list(substring_dedup.word_slices([])) == []


def test_hashing_words_costs_little_more_than_cutting_them():
    import time

    def least(run):
        took = []
        for _ in range(3):
            began = time.process_time()
            run()
            took.append(time.process_time() - began)
        return min(took)

    r = random.Random(4)
    texts = [" ".join(str(r.randrange(10**6)) for _ in range(2000)) for _ in range(300)]
    assert least(lambda: list(substring_dedup.word_slices(texts))) < 3 * least(lambda: [substring_dedup.words_of(t) for t in texts])


@pytest.mark.parametrize("hot", [400, 2])
def test_substring_dedup(spark, hot):
    rows = corpus(7)
    want = plain_substrings(rows)
    got = substring_dedup.remove_repeats(frame(spark, rows).repartition(3), hot=hot).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    assert any(n for _, n, _ in want.values())
    assert substring_dedup.remove_repeats(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("hot", [400, 2])
def test_suffix_dedup(spark, hot):
    rows = corpus(9, 40)
    got = suffix_dedup.remove_repeats(frame(spark, rows), hot=hot).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == plain_bytes(rows)
    assert suffix_dedup.remove_repeats(frame(spark, rows).limit(0)).count() == 0


def near_passages():
    """One passage with a change in every copy: many different spans of one anchor."""
    r = random.Random(3)
    base = [f"w{r.randrange(500)}" for _ in range(70)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(r.randint(0, 3)):
            words[r.randrange(70)] = f"x{r.randrange(9)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("hot", [400, 5, 1])
def test_hot_anchors_are_divided_by_content(spark, hot):
    rows = near_passages()
    got = substring_dedup.remove_repeats(frame(spark, rows), hot=hot).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == plain_substrings(rows)
    got = suffix_dedup.remove_repeats(frame(spark, rows), hot=hot).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == plain_bytes(rows)


@pytest.mark.parametrize(("module", "plain"), [(substring_dedup, plain_substrings), (suffix_dedup, plain_bytes)])
def test_repeated_rows_and_long_texts(spark, monkeypatch, module, plain):
    r = random.Random(8)
    passage = " ".join(f"w{r.randrange(900)}" for _ in range(60))
    long = " ".join(f"v{r.randrange(9000)}" for _ in range(6000))
    rows = [(1, passage), (2, f"{long} {passage} {long[:3000]}"), (3, "a " * 500), (4, passage.upper())]
    monkeypatch.setattr(module.anchored, "SLICE", 1000)
    want = plain(rows)
    twice = frame(spark, rows + rows[:2])
    got = module.remove_repeats(twice).drop("kept_text", "kept_bytes").collect()
    assert len(got) == 6 and {x[0]: tuple(x[1:]) for x in got} == want
    # Of one id's texts, one is the first: the passage stays in it alone.
    two = module.remove_repeats(frame(spark, [(1, passage), (1, "other " + passage)])).collect()
    assert sorted(x.n_removed > 0 for x in two) == [False, True]


@pytest.mark.parametrize("module", [substring_dedup, suffix_dedup])
def test_the_comparison_alone_removes(spark, monkeypatch, module):
    none = np.empty(0, np.int64)
    monkeypatch.setattr(module, "extend" if module is substring_dedup else "compare", lambda *_: lambda *_: ((none,) * 3,) * 2)
    got = module.remove_repeats(frame(spark, corpus(7))).collect()
    assert sum(r.n_removed for r in got) == 0


@pytest.mark.parametrize("chunk", [1 << 20, 5])
def test_collection_order(tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    r = random.Random(1)
    for _ in range(25):
        strings = [bytes(r.choice(b"ab\0") for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 8))]
        columns, begin = suffix_dedup.build(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings]), np.ones(256, np.int64), 5, str(tmp_path))
        bwt, lcp, place = (np.concatenate(parts) for parts in zip(*(parts for _, parts in columns.read("bwt", "lcp", "place"))))
        columns.close()
        own = np.searchsorted(begin, place, side="right") - 1
        got = [strings[s][p:] for s, p in zip(own, place - begin[own])]
        assert got == sorted(s[k:] for s in strings for k in range(len(s) + 1))
        assert [strings[s][p - 1] if p else 256 for s, p in zip(own, place - begin[own])] == bwt.tolist()
        assert lcp[1:].tolist() == [min(5, len(os.path.commonprefix([a, b]))) for a, b in zip(got, got[1:])]


def test_a_symbol_of_more_bytes(tmp_path):
    symbols = np.array([97, 256, 98, 97, 256, 99, 97, 257, 98])
    columns, begin = suffix_dedup.build(symbols, np.array([3] * 3), np.r_[np.ones(256, np.int64), 7, 9], 20, str(tmp_path))
    lcp, place = (np.concatenate(parts) for parts in zip(*(parts for _, parts in columns.read("lcp", "place"))))
    columns.close()
    common = {p: n for p, n in zip(place.tolist(), lcp.tolist())}
    assert common[begin[1]] == 8 and common[begin[1] + 1] == 7 and common[begin[2]] == 1 and common[begin[2] + 1] == 0


def test_columns_lie_in_files(tmp_path):
    columns, _ = suffix_dedup.build(np.frombuffer(b"banana" * 60, np.uint8), np.array([120] * 3), np.ones(256, np.int64), 100, str(tmp_path))
    files = {name: (tmp_path / f"{name}-{'ab'[columns.turn]}").stat().st_size for name in columns.kinds}
    columns.close()
    assert files == {"bwt": 2 * 363, "lcp": 363, "place": 4 * 363}
