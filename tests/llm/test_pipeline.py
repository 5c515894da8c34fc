"""The corpus pipeline against a plain version on a small folder of tables."""

import os
import re
import shutil

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from llm.test_near_copies import expected  # noqa: E402
from querent.llm import packing, quality, secret_scan  # noqa: E402

DATA = os.environ.get("QUERENT_TESTDATA", "/root/testdata")


def test_pipeline(spark, tmp_path):
    folder = str(tmp_path / "tables")
    os.makedirs(folder)
    shutil.copy(f"{DATA}/sf0.001/labels.parquet", folder)
    source = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    rows = source.collect()
    base = next(r for r in rows if len(r.text) > 4000)
    extra = [(1000, base.text.replace(" ", "  "), "en", "s", 1), (1001, None, None, None, None), (1002, "", "en", "s", 0), (1003, base.text + " token=abcdefgh0123", "en", "s", 2)]
    docs = source.unionByName(spark.createDataFrame(extra, source.schema))
    docs.write.parquet(f"{folder}/documents.parquet")
    got = pipeline.run(spark, folder).toPandas()

    model = quality.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    scores = {r.id: r.score for r in quality.score(docs, model).collect()}
    kept = [r for r in docs.collect() if scores[r.doc_id] >= quality.THRESHOLD]
    groups = {}
    for r in kept:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), []).append(r)
    kept = [min(g, key=lambda r: (-len(r.text or ""), r.doc_id)) for g in groups.values()]
    # One document of each group of texts whose 5-word shingles have a similarity of 0.8 or more.
    first = set(expected([(r.doc_id, r.text) for r in kept]))
    kept = [r for r in kept if r.doc_id in first]
    texts = {r.doc_id: secret_scan.masked(r.text or "", secret_scan.scan([r.text or ""])[0]) for r in kept}
    from querent.llm.bpe import Coder

    code = Coder(packing.default_tokenizer())
    assert {i: len(code.encode_many([t])[0]) + 1 for i, t in texts.items()} == got.groupby("doc_id").length.sum().to_dict()
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        ends = (own.offset + own.length).tolist()
        assert own.offset.tolist() == [0, *ends[:-1]] and ends[-1] <= 2048


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").limit(30)
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, f"{DATA}/sf0.001").columns == docs.columns


def test_an_empty_table_and_clashing_columns(spark, tmp_path):
    folder = str(tmp_path / "tables")
    os.makedirs(folder)
    shutil.copy(f"{DATA}/sf0.001/labels.parquet", folder)
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    docs.limit(0).write.parquet(f"{folder}/documents.parquet")
    assert pipeline.run(spark, folder).count() == 0
    more = docs.limit(20).selectExpr("*", "1 AS _row", "2 AS root", "3 AS rid", "'x' AS name", "4 AS pos")
    for _, stage in pipeline.STAGES[:-1]:
        got = stage(spark, more, folder)
        assert got.columns == more.columns and {r.rid for r in got.collect()} <= {3}
    assert pipeline.STAGES[-1][1](spark, more, folder).count() >= 20
