"""Ordered logs: order of appends, last record wins, batches once, what a crash leaves."""

import json

import pytest
from pyspark.sql import functions as F

from querent import storage
from querent.sources import log, records


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "question_id long, completion string")


def test_the_later_append_wins(spark, tmp_path):
    path = str(tmp_path / "log")
    for n in range(20):
        records.append_predictions(rows(spark, [(i, f"{n}:{i}") for i in range(3)]).withColumn("index", F.col("question_id")), path)
        got = {r.question_id: r.completion for r in records.read_predictions(spark, path).collect()}
        assert got == {i: f"{n}:{i}" for i in range(3)}


def test_rows_come_back_in_appended_order(spark, tmp_path):
    path = str(tmp_path / "log")
    want = []
    for n in range(4):
        own = [(n * 100 + i, "x" * (i % 7)) for i in range(50)]
        want += [i for i, _ in own]
        log.append(rows(spark, own).repartition(5), path, order=["question_id"])
    got = [r.question_id for r in log.read(spark, path, "question_id long, completion string").orderBy("line").collect()]
    assert got == want


def test_rollouts_keep_their_order(spark, tmp_path):
    path = str(tmp_path / "log")
    for n in range(4):
        records.append_rollouts(spark.createDataFrame([(float(n), n, None)], "reward double, question_id long, error string"), path)
    records.append_rollouts(spark.createDataFrame([("broken",)], "error string"), path)
    usable, errors = records.read_rollouts(spark, path)
    assert [r.question_id for r in usable.orderBy("line").collect()] == [0, 1, 2, 3]
    assert errors.first().n_errors == 1


def test_resume_keeps_the_order_of_questions(spark, tmp_path):
    path = str(tmp_path / "log")
    examples = spark.createDataFrame([(i * 7 % 100, i) for i in range(100)], "question_id long, index long").repartition(7)
    assert [r["index"] for r in records.resume(examples, path).collect()] == list(range(100))
    records.append_predictions(examples.where("index < 30").withColumn("completion", F.lit("a")), path)
    records.append_predictions(examples.where("index = 50").select("question_id", "index", F.lit("timed out").alias("error")), path)
    todo = records.resume(examples, path)
    assert [r["index"] for r in todo.collect()] == [*range(30, 50), *range(51, 100)]
    records.append_predictions(todo.withColumn("completion", F.lit("b")), path)
    order = [r.question_id for r in log.read(spark, path, records.PREDICTION).orderBy("line").collect()]
    assert order == [i * 7 % 100 for i in [*range(30), 50, *range(30, 50), *range(51, 100)]]
    assert records.resume(examples, path).count() == 0


def test_a_key_is_appended_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    assert log.append(rows(spark, [(1, "a")]), path, "k#0") == 0
    assert log.append(rows(spark, [(1, "a")]), path, "k#0") is None
    # A crash between the write and the commit leaves a folder that nothing names.
    with monkeypatch.context() as m:
        m.setattr(storage, "create", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError):
            log.append(rows(spark, [(2, "half")]), path, "k#1")
    read = lambda: [(r.question_id, r.completion) for r in log.read(spark, path, "question_id long, completion string").orderBy("line").collect()]
    assert read() == [(1, "a")]
    assert log.append(rows(spark, [(2, "b")]), path, "k#1") == 1
    assert read() == [(1, "a"), (2, "b")]
    # A commit file that was cut off counts as none, and its number is passed over.
    (tmp_path / "log" / "_log" / "000000000002.json").write_text('{"sequence": 2, "fol')
    assert log.append(rows(spark, [(3, "c")]), path) == 3
    assert read() == [(1, "a"), (2, "b"), (3, "c")]
    # Two commits of one key, of writers that didn't know of each other: the first counts.
    first = json.loads((tmp_path / "log" / "_log" / "000000000001.json").read_text())
    (tmp_path / "log" / "_log" / "000000000009.json").write_text(json.dumps(first | {"sequence": 9}))
    assert read() == [(1, "a"), (2, "b"), (3, "c")]


def test_a_replayed_batch_leaves_no_double_row(spark, tmp_path, monkeypatch):
    path, source, state = str(tmp_path / "log"), str(tmp_path / "in"), str(tmp_path / "state")
    batch = spark.createDataFrame([(1.0, 5, None), (0.0, 6, None)], "reward double, question_id long, error string")
    batch.write.json(source)
    stream = spark.readStream.schema(batch.schema).json(source)

    def run():
        records.rollout_log(stream, path, state).trigger(availableNow=True).start().awaitTermination()

    real, calls = log.append, []

    def crashing(*args, **kwargs):
        real(*args, **kwargs)  # written and committed, but Spark doesn't learn of it
        calls.append(1)
        raise RuntimeError("crash")

    monkeypatch.setattr(log, "append", crashing)
    with pytest.raises(Exception, match="crash"):
        run()
    monkeypatch.setattr(log, "append", real)
    run()
    assert calls and sorted(r.question_id for r in records.read_rollouts(spark, path)[0].collect()) == [5, 6]


def test_an_empty_log(spark, tmp_path):
    path = str(tmp_path / "none")
    assert log.read(spark, path, "a long").count() == 0
    assert records.finished(spark, path).count() == 0
    log.append(rows(spark, []), path)
    assert log.read(spark, path, "question_id long, completion string").count() == 0


def test_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("QUERENT_HARDWARE", "two of them")
    path = str(tmp_path / "runs")
    assert records.read_runs(spark, path) == []
    wrote = records.append_run(spark, {"stage": "sft", "split": "val", "n_samples": 3, "metrics": {"official_ex": 50.0, "note": "x"}, "model": "m"}, path)
    records.append_run(spark, {"stage": "smoke", "split": "val", "n_samples": 1, "metrics": {"n": 1}, "timestamp": "2020-01-01T00:00:00+00:00"}, path)
    early, late = records.read_runs(spark, path)
    assert early["stage"] == "smoke" and late["metrics"] == {"official_ex": 50.0} and late["model"] == "m" and late["note"] == "x"
    assert late["hardware"].endswith("devices two of them") and late["run_id"] == wrote["run_id"] and late["git_sha"] == wrote["git_sha"]
    for bad in ({"stage": "sft", "split": "val", "metrics": {}}, {"stage": "other", "split": "val", "n_samples": 1, "metrics": {}}):
        with pytest.raises(ValueError):
            records.append_run(spark, bad, path)


def test_question_files(spark, tmp_path):
    items = [{"question_id": 5, "db_id": " d ", "question": "q", "SQL": "", "sql": "SELECT 1"}, {"db_id": "d", "question": "two\nlines", "SQL": "SELECT 2", "sql": "no", "evidence": "e", "difficulty": ""}]
    file = tmp_path / "q.json"
    file.write_text(json.dumps(items, indent=2))
    got = records.read_questions(spark, str(file)).orderBy("index").collect()
    assert [(r["index"], r.question_id, r.db_id, r.question, r.evidence, r.gold_sql, r.difficulty) for r in got] == [(0, 5, "d", "q", "", "SELECT 1", None), (1, 1, "d", "two\nlines", "e", "SELECT 2", None)]
    records.write_questions(records.read_questions(spark, str(file)), str(tmp_path / "out"))
    (text,) = [p.read_text() for p in (tmp_path / "out").glob("part-*")]
    assert [x["SQL"] for x in json.loads(text)] == ["SELECT 1", "SELECT 2"]
    assert records.read_questions(spark, str(tmp_path / "out")).count() == 2
    file.write_text("[]")
    assert records.read_questions(spark, str(file)).count() == 0
    records.write_questions(records.read_questions(spark, str(file)), str(tmp_path / "empty"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "empty").glob("part-*"))) == []
    file.write_text('{"a": 1}')
    with pytest.raises(ValueError, match="not a JSON array"):
        records.read_questions(spark, str(file))
