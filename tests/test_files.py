"""Splits, sidecars, manifests, logs, scores that never raise, stateless runs and the cache's order."""

import json

import pytest
from pyspark.sql import functions as F

from querent.operators import linking, rewards, slices, temporal
from querent.plans import guard
from querent.sources import records, sqlite


def test_split_discovery(tmp_path):
    deep = tmp_path / "a" / "b"
    (deep / "dev_databases").mkdir(parents=True)
    (deep / "dev.json").write_text("[]")
    found = sqlite.discover_split(str(tmp_path), "dev")
    assert found.questions == str(deep / "dev.json") and found.databases == str(deep / "dev_databases")
    assert found.database("x") == str(deep / "dev_databases" / "x" / "x.sqlite")
    (tmp_path / "dev.json").write_text("[]")
    (tmp_path / "dev_databases").mkdir()
    found = sqlite.discover_split(str(tmp_path), "dev")
    assert found.questions == str(tmp_path / "dev.json") and found.databases == str(tmp_path / "dev_databases")
    with pytest.raises(ValueError, match="unknown split"):
        sqlite.discover_split(str(tmp_path), "test")
    with pytest.raises(FileNotFoundError):
        sqlite.discover_split(str(tmp_path), "train")
    with pytest.raises(FileNotFoundError):
        sqlite.discover_split(str(tmp_path / "none"), "dev")


def test_sidecars_and_manifests(spark, tmp_path):
    path = str(tmp_path / "p.jsonl")
    assert records.read_meta(spark, path) == {}
    records.write_meta(spark, path, {"model": "m", "n": 2})
    assert records.read_meta(spark, path) == {"model": "m", "n": 2}
    source = tmp_path / "q.json"
    source.write_text("[]")
    made = records.write_manifest(spark, str(tmp_path / "manifest"), {"questions": str(source)}, "build", {"train": [1, 2]}, seed=3)
    kept = json.loads(spark.read.text(str(tmp_path / "manifest"), wholetext=True).first().value)
    assert kept == made and kept["train_ids"] == [1, 2] and kept["seed"] == 3
    assert kept["source_questions_sha256"] == records.file_sha256(str(source)) != ""


def test_git_state_ignores_paths(tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    assert records.git_state(str(tmp_path)) == ("", True)
    run("init")
    (tmp_path / "a").write_text("1")
    run("add", "a")
    run("commit", "-m", "m")
    (tmp_path / "log").write_text("1")
    assert records.git_state(str(tmp_path))[1] and not records.git_state(str(tmp_path), (str(tmp_path / "log"),))[1]
    assert not records.git_state(str(tmp_path), (str(tmp_path / "log"), "/elsewhere"))[1]


def test_rollouts_append_from_batches_and_streams(spark, tmp_path):
    records.append_rollouts(spark.range(2), None)
    log, source = str(tmp_path / "log"), str(tmp_path / "in")
    batch = spark.createDataFrame([(1.0, 5, None), (0.0, 6, "x")], "reward double, question_id long, error string")
    records.append_rollouts(batch, log)
    batch.write.json(source)
    query = records.rollout_log(spark.readStream.schema(batch.schema).json(source), log, str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    usable, errors = records.read_rollouts(spark, log)
    assert usable.count() == 2 and errors.first().n_errors == 2


def test_scores_never_raise(spark):
    class Broken:
        def frames(self, executions):
            raise RuntimeError("no workers")

        def execute_many(self, queries):
            raise RuntimeError("no workers")

    rollouts = spark.createDataFrame([(1, "```sql\nSELECT 1\n```", "SELECT 1"), (2, None, "SELECT 1")], "rollout_id int, completion string, gold_sql string")
    got = rewards.compute_scores(rollouts, Broken()).collect()
    assert [(r.rollout_id, r.reward, r.error) for r in got] == [(1, 0.0, "RuntimeError: no workers"), (2, 0.0, "RuntimeError: no workers")]
    got = rewards.compute_scores(rollouts, guard.SqlExecutor(spark, ())).collect()
    assert {r.rollout_id: (r.reward, r.error) for r in got} == {1: (1.0, None), 2: (0.0, None)}


def test_stateless_run(spark):
    spark.range(3).createOrReplaceTempView("outside")
    got = guard.execute_sql(spark, "SELECT count(*) FROM own", {"own": spark.range(4)})
    assert got.status == guard.OK and len(got.rows) == 1
    assert guard.execute_sql(spark, "SELECT * FROM outside", {"own": spark.range(4)}).status != guard.OK
    assert guard.execute_sql(spark, "SELECT 1", {"own": None}).status == guard.ERROR
    assert "own" not in {t.name for t in spark.catalog.listTables()}


def test_the_least_recently_used_result_goes_first(spark, monkeypatch):
    monkeypatch.setattr(guard, "KEPT", 2)
    run = guard.SqlExecutor(spark, ())
    for sql in ("SELECT 1", "SELECT 2", "SELECT 1", "SELECT 3", "SELECT 1"):
        run.execute(sql)
    assert run.stats["calls"] == 5 and run.stats["cache_hits"] == 2 and run.kept() == ["SELECT 3", "SELECT 1"]


def test_schema_selection_modes(spark):
    tables = spark.createDataFrame([("d", "b", None), ("d", "a", None)], "db_id string, table string, ddl string")
    columns = spark.createDataFrame([("d", t, 0, "x", "TEXT", False, False, "", "") for t in "ab"], "db_id string, table string, pos int, name string, type string, notnull boolean, pk boolean, description string, value_description string")
    fks = spark.createDataFrame([], "db_id string, table string, from_column string, to_table string, to_column string")
    asked = spark.createDataFrame([(1, "d", "q", "", "SELECT * FROM B")], "question_id int, db_id string, question string, evidence string, gold_sql string")
    blocks = spark.createDataFrame([("d", "a", "A" * 10), ("d", "b", "B" * 20)], "db_id string, table string, block string")
    full = linking.render_selected(asked, tables, columns, fks, blocks, "full", 15).first()
    assert full.selected_tables == ["a", "b"] and full.schema_text == "A" * 10 + "\n\n" + "B" * 20 and full.exceeded and full.total_tables == 2
    oracle = linking.render_selected(asked, tables, columns, fks, blocks, "oracle", 25).first()
    assert oracle.selected_tables == ["b"] and oracle.chars == 20 and not oracle.exceeded
    linked = linking.render_selected(asked, tables, columns, fks, blocks, "linked", 15).first()
    assert linked.selected_tables == ["a"] and linked.exceeded
    for gold, what in (("", "no gold SQL"), ("SELECT 1", "names no known table")):
        with pytest.raises(Exception, match=what):
            linking.select_schema(asked.withColumn("gold_sql", F.lit(gold)), tables, columns, fks, "oracle").collect()
    with pytest.raises(ValueError):
        linking.select_schema(asked, tables, columns, fks, "none")


def test_joins_by_nearness(spark):
    left = spark.createDataFrame([(i, float(i), i % 2) for i in range(40)], "i int, t double, k int")
    right = spark.createDataFrame([(3.5, 0, 7), (3.5, 0, 8), (20.0, 0, 9), (10.0, 1, 1)], "t double, k int, v int")
    got = {r.i: r.v for r in temporal.as_of_join(left, right, "t", "v", ("k",), 4.0).collect()}
    assert got == {i: (9 if i >= 20 else 8 if i > 3.5 else None) if i % 2 == 0 else (1 if i >= 10 else None) for i in range(40)}
    spans = spark.createDataFrame([(1, 2.0, 9.5), (2, 30.0, 30.0), (3, 38.0, 99.0)], "s int, low double, high double")
    pairs = temporal.range_join(left.select("i", "t"), spans, F.col("t"), F.col("low"), F.col("high"), 3.0).collect()
    assert sorted((r.s, r.i) for r in pairs) == [(1, i) for i in range(2, 10)] + [(3, 38), (3, 39)]


def test_pairs_of_a_range_join_come_in_order_and_take_little_room(spark, tmp_path):
    points = spark.range(20_000).select(F.col("id").alias("i"), (F.pmod(F.xxhash64("id"), F.lit(100_000)) / 1000).alias("t"))
    spans = spark.range(2_000).select(F.col("id").alias("s"), (F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(100_000)) / 1000).alias("low"))
    found = temporal.range_join(points, spans, F.col("t"), F.col("low"), F.col("low") + 0.5, 0.5)
    found.select("i", "s").write.parquet(str(tmp_path / "out"))
    pairs = spark.read.parquet(str(tmp_path / "out"))
    every = points.join(spans, (F.col("low") <= F.col("t")) & (F.col("t") < F.col("low") + 0.5)).select("i", "s")
    assert pairs.count() == every.count() and pairs.exceptAll(every).isEmpty()
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 1.9 * pairs.count()


def test_shown_ids(spark):
    rows = spark.range(25).withColumnRenamed("id", "question_id")
    got = slices.shown_ids(rows).first()
    assert got.ids.endswith("18, 19 (+5 more)") and got.n == 25
    assert slices.shown_ids(rows.limit(0)).first().ids == "" and slices.first_n(rows, 0, "question_id").count() == 0
