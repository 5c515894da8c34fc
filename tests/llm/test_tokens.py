"""BPE encoding and packing against the tokenizer libraries and the contract."""

import hashlib
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from querent.llm import bpe, bpe_codec, packing  # noqa: E402

BITS = ["'", "s", "t", "re", " ", "  ", "\n", "\t", "é", "1", "٣", "!", "..", "'ll", "'ve", "r", "l", " 're", " ", "😀", "a" * 40, "v", "d", "'d", "_", "語", "   " * 9, "the", " tion"]


@pytest.fixture(scope="module")
def known():
    path = bpe_codec.default_ranks()
    ranks = bpe.load_ranks(path)
    return bpe.Coder(path), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(seed, n, most=40):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) for _ in range(r.randint(0, most))) for _ in range(n)]


def test_pattern_is_the_public_one():
    assert bpe.PATTERN == public_tokenizers.PATTERN


def test_vocabulary_file_gives_the_ranks():
    assert bpe.load_ranks(packing.default_tokenizer()) == bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 4096])
def test_tree_equals_the_library(known, size):
    coder, library = known
    some = texts(size, 800)
    got = bpe_codec.encode_texts(some, coder, size)
    assert [g.tolist() for g in got] == [library.encode_ordinary(t) for t in some]
    assert all(coder.decode(g.tolist()) == t.encode() for g, t in zip(got, some))


def test_long_matches(known):
    coder, library = known
    r = random.Random(2)
    for _ in range(40):
        word = "".join(r.choice(["a", "b", "th", "e", "ing", "é"]) for _ in range(r.randint(300, 3000)))
        assert coder.encode_piece(word.encode()) == library.encode_ordinary(word)
    spaces = " " * 20_000 + "x" * 9000
    assert bpe_codec.encode_texts([spaces], coder)[0].tolist() == library.encode_ordinary(spaces)


def test_codec_query(spark, known):
    _, library = known
    rows = [(i, t) for i, t in enumerate(texts(4, 50))] + [(60, None), (61, ""), (None, "x y"), (62, "word " * 9000), (0, "again")]
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, ids string, n_tokens int")
    got = bpe_codec.digests(docs, bpe_codec.default_ranks()).collect()
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    encoded = bpe_codec.encode(docs, bpe_codec.default_ranks())
    back = bpe_codec.decode(encoded, bpe_codec.default_ranks()).collect()
    assert sorted(bytes(r.data) for r in back) == sorted((t or "").encode() for _, t in rows)


def test_local_search_empties_bins():
    best = packing.best_fit({51: 6, 27: 6, 26: 6, 23: 12}, 100)
    assert sum(best.values()) == 11
    better = packing.local_search(best, 100)
    assert sum(better.values()) == 9


@pytest.mark.parametrize("seed", range(4))
def test_packing_keeps_all_items(seed):
    r = random.Random(seed)
    histogram = {}
    for _ in range(500):
        n = r.randint(20, 50)
        histogram[n] = histogram.get(n, 0) + 1
    best = packing.best_fit(histogram, 100)
    better = packing.local_search(best, 100)
    got = {}
    for pattern, bins in better.items():
        assert sum(a * b for a, b in pattern) <= 100
        for a, b in pattern:
            got[a] = got.get(a, 0) + b * bins
    assert got == histogram and sum(better.values()) < sum(best.values())


def packed_items(packed):
    items = Counter()
    for pattern, bins in packed.items():
        for a, k in pattern:
            items[a] += k * bins
    return items


def next_fit(lengths, capacity):
    packed, own = Counter(), Counter()
    for n in lengths:
        if own.total() and sum(a * k for a, k in own.items()) + n > capacity:
            packed[tuple(sorted(own.items(), reverse=True))] += 1
            own = Counter()
        own[n] += 1
    packed[tuple(sorted(own.items(), reverse=True))] += 1
    return packed


def test_local_search_from_next_fit_reaches_the_bound_on_documents():
    path = Path("/root/testdata/sf0.01/documents.parquet")
    if not path.exists():
        pytest.skip("no documents")
    texts = [t or "" for t in pq.read_table(path, columns=["text"])["text"].to_pylist()]
    bounds = bpe.Coder(packing.default_tokenizer()).encode_added(texts)[1]
    lengths = [n for k in range(len(texts)) for own in [int(bounds[k + 1] - bounds[k]) + 1] for n in [*[2048] * ((own - 1) // 2048), (own - 1) % 2048 + 1]]
    random.Random(1).shuffle(lengths)
    poor = next_fit(lengths, 2048)
    better = packing.local_search(poor, 2048)
    assert sum(poor.values()) > 600 > sum(better.values()) == packing.least_bins(Counter(lengths), 2048)
    assert packed_items(better) == Counter(lengths) and max(sum(a * k for a, k in p) for p in better) <= 2048


@pytest.mark.parametrize("seed", range(6))
def test_least_bins_and_search_on_small_histograms(seed):
    draw = random.Random(seed)
    lengths = [draw.randint(1, 20) for _ in range(9)]

    def fewest(left, rooms):
        if not left:
            return len(rooms)
        options = [fewest(left[1:], [*rooms[:i], r - left[0], *rooms[i + 1 :]]) for i, r in enumerate(rooms) if r >= left[0]]
        return min([*options, fewest(left[1:], [*rooms, 20 - left[0]])])

    best = fewest(sorted(lengths, reverse=True)[:7], [])
    own = Counter(sorted(lengths, reverse=True)[:7])
    poor = next_fit(list(own.elements()), 20)
    better = packing.local_search(poor, 20)
    assert packing.least_bins(own, 20) <= best <= sum(better.values()) <= sum(poor.values())
    assert packed_items(better) == own and all(sum(a * k for a, k in p) <= 20 for p in better)
    assert packing.least_bins({1025: 7}, 2048) == 7 and packing.least_bins({}, 2048) == 0


def test_packing_query(spark):
    tokenizers = pytest.importorskip("tokenizers")
    rows = [(i, t) for i, t in enumerate(texts(8, 60, 300))] + [(90, None), (91, ""), (92, "some words here " * 3000), (93, "same"), (93, "same"), (None, "null id")]
    docs = spark.createDataFrame([(i, t, 5, "z") for i, t in rows], "doc_id long, text string, length int, rid string")
    got = packing.pack(docs, packing.default_tokenizer()).toPandas()
    library = tokenizers.Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        start, piece = 0, 0
        end = (len(ids) - 1) % 2048 + 1
        while start < len(ids):
            want.append((i, piece, start, end - start, zlib.crc32(np.array(ids[start:end], "<u4").tobytes())))
            start, end, piece = end, end + 2048, piece + 1
    have = [(None if i != i else int(i), p, s, n, c) for i, p, s, n, c in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(have, key=str) == sorted(want, key=str)
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        ends = (own.offset + own.length).tolist()
        assert own.offset.tolist() == [0, *ends[:-1]] and ends[-1] <= 2048
    assert packing.pack(docs.limit(0), packing.default_tokenizer()).count() == 0


def test_packing_query_with_added_tokens(spark):
    tokenizers = pytest.importorskip("tokenizers")
    end = "<|endoftext|>"
    rows = list(enumerate([f"a {end} b", end, end * 3, f"x{end}", f"{end}  y", f"don't{end}'ll  {end}\n", "<|endoftext|", f"<|endof{end}text|>", "plain text", "", *(f" {end}".join(texts(s, 5)) for s in range(20))]))
    rows.append((50, f"some words {end} " * 2000))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    library = tokenizers.Tokenizer.from_file(packing.default_tokenizer())
    coder = bpe.Coder(packing.default_tokenizer())
    want = {}
    for i, t in rows:
        own = library.encode(t, add_special_tokens=False).ids
        assert coder.encode_added([t])[0].tolist() == own and coder.decode(own) == t.encode()
        start, stop = 0, len(own) % 2048 + 1
        for piece in range(len(own) // 2048 + 1):
            want[i, piece] = (start, stop - start, zlib.crc32(np.array([*own, 0][start:stop], "<u4").tobytes()))
            start, stop = stop, stop + 2048
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in packing.pack(docs, packing.default_tokenizer()).collect()}
    assert got == want
