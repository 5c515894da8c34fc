"""Cases in which a result was cut, late or missing."""

import datetime

import oracle

from querent.queries import ORACLES, QUERIES


def test_a_late_row_joins_a_session_that_has_come(spark, tmp_path):
    """The middle of the time is minute 500, so the watermark of the first run is minute 489; events whose id is 50 k + 7 come in the second."""
    start = datetime.datetime(2024, 1, 1)
    rows = [
        (0, 0.0, 1), (1, 499.0, 9), (2, 1000.0, 9),
        (3, 440.0, 2), (57, 465.0, 2),  # the first has come when the second, not yet late, does
        (4, 100.0, 3), (5, 130.0, 3),  # the gap apart: two sessions
        (6, 445.0, 4), (107, 470.0, 4), (8, 499.5, 4), (9, 528.0, 4),
        (10, 446.0, 5), *((100 * k + 7, 470.0 + 20 * k, 5) for k in range(27)),  # still open in the end
    ]
    events = [(i, start + datetime.timedelta(minutes=m), u, "view", 1.0, "{}") for i, m, u in rows]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert oracle.differences(spark, str(tmp_path), QUERIES["stream_sessions"], ORACLES["stream_sessions"]) == ""


def test_a_recursion_goes_beyond_a_million_rows(spark, tmp_path):
    spark.range(260_000).selectExpr("id AS o_orderkey", "12 + id % 4 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    for name in ("region", "nation", "customer", "supplier", "part", "lineitem", "events"):
        spark.range(1).write.parquet(f"{tmp_path}/{name}.parquet")
    assert QUERIES["sql_recursive"](spark, str(tmp_path)).count() == 4 * 260_000  # 12 to 15, 6 or 7, 3, 1


def test_failing_rollouts_cost_runs_of_their_own_rows(spark):
    """4,000 rollouts, 12 of which raise: seven runs of many rows at most, and no long union of parts."""
    from pyspark.sql import functions as F

    from querent.operators import rewards

    many = []

    def scorer(part, executor, config):
        many.append(part.count() > 1500)
        return part.select("rollout_id", F.when(F.col("rollout_id") % 331 == 5, F.raise_error(F.lit("no"))).otherwise(F.lit(1.0)).alias("reward"))

    got = rewards.compute_scores(spark.range(4000).withColumnRenamed("id", "rollout_id"), None, scorer=scorer)
    assert sum(many) <= 7 and len(got.inputFiles()) <= 40
    rows = got.collect()
    assert len(rows) == len({r.rollout_id for r in rows}) == 4000
    assert all((r.error is not None, r.reward) == ((True, 0.0) if r.rollout_id % 331 == 5 else (False, 1.0)) for r in rows)


def test_rollouts_that_raise_together_only_are_scored_apart(spark):
    from pyspark.sql import functions as F

    from querent.operators import rewards

    def scorer(part, executor, config):
        if part.count() > 30:
            raise MemoryError("too many")
        return part.select("rollout_id", F.lit(1.0).alias("reward"))

    rows = rewards.compute_scores(spark.range(100).withColumnRenamed("id", "rollout_id"), None, scorer=scorer).collect()
    assert sorted((r.rollout_id, r.reward, r.error) for r in rows) == [(i, 1.0, None) for i in range(100)]


def test_failing_rollouts_are_one_run(spark, tmp_path, monkeypatch):
    """A quarter of the documents raise, and no batch is dealt or halved for them."""
    from pyspark.sql import functions as F

    from querent.operators import rewards

    def halved(*_):
        raise AssertionError("a batch was halved")

    monkeypatch.setattr(rewards, "_apart", halved)
    ids = spark.range(-2000, 2000).select(F.when(F.col("id") % 4 == 0, F.col("id") * 997 + 5).otherwise(F.col("id")).alias("doc_id"))
    ids.withColumn("n_chars", F.col("doc_id") % 3 + 2).write.parquet(f"{tmp_path}/documents.parquet")
    bad = "doc_id % 997 = 5"  # SQL's remainder: below zero none is 5
    wanted = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("doc_id", f"if({bad}, 0D, double(n_chars % 2))", bad)
    rows = sorted(tuple(r) for r in QUERIES["failing_rollouts"](spark, str(tmp_path)).collect())
    assert rows == sorted(tuple(r) for r in wanted.collect()) and sum(r[2] for r in rows) > 500


def test_a_rollout_at_a_time(spark, tmp_path):
    """Errors, rewards of no number and errors of no UTF-8 are a rollout's own; what ends the task too, by halving."""
    from pyspark.sql import functions as F

    from querent.operators import rewards
    from querent.sources import log

    def reward(rollout):
        i = rollout["rollout_id"]
        if i == 70:
            raise SystemExit("gone")
        if i == 40:
            raise ValueError(chr(0xD800))
        return {10: "?", 20: None}[i] if i in (10, 20) else 1 / (i - 30)

    rollouts = spark.range(60).select(F.col("id").alias("rollout_id"), (F.col("id") % 7).alias("question_id"))
    for n, part in enumerate((rollouts, rollouts.union(spark.sql("SELECT 70L, 0L")))):
        path = str(tmp_path / f"log{n}")
        got = {r.rollout_id: (r.reward, r.error) for r in rewards.compute_scores(part, None, path=path, scorer=rewards.each(reward)).collect()}
        assert set(got) == {*range(60), *[70] * n}
        assert {i for i, (_, error) in got.items() if error} == {10, 30, 40, *[70] * n} and got[30] == (0.0, "ZeroDivisionError: division by zero")
        assert all(r == (0.0 if e or i == 20 else 1 / (i - 30)) for i, (r, e) in got.items())
        logged = log.read(spark, path, "reward double, question_id long, error string").collect()
        assert len(logged) == 60 + n and sorted(r.question_id for r in logged if r.error) == sorted([10 % 7, 30 % 7, 40 % 7, *[0] * n])


def test_names_in_gold_queries_as_by_search(spark):
    """Names of word characters are looked up, others searched for; a search of every name gives the same."""
    import re

    from querent.operators import linking

    names = ["orders", "Order Details", "order", "a$b", "Straße", "x-y", "details", "dup", "DUP"]
    texts = ["SELECT * FROM orders, [Order Details] -- order", "SELECT a$b, 'dup' FROM `strasse` JOIN x-y", "select dup.a from DUP", "SELECT 1", None, "SELECT orders_x FROM my_order, Order"]
    tables = spark.createDataFrame([("d", n) for n in names] + [("e", "orders")], "db_id string, table string")
    gold = spark.createDataFrame([(i, "d", t) for i, t in enumerate(texts)], "question_id int, db_id string, gold_sql string")
    got = sorted((r.question_id, r.table) for r in linking.oracle_tables(gold, tables).collect())
    bare = [re.sub(r"--.*|'[^']*'|[`\[\]]", " ", t or "").lower() for t in texts]
    fold = lambda n: n.lower().replace("ß", "ss")
    assert got == sorted((i, n) for i, t in enumerate(bare) for n in names if re.search(rf"(?<![a-z0-9_$]){re.escape(fold(n))}(?![a-z0-9_$])", t))


def test_a_verdict_looks_at_a_statement_once(spark):
    """The text is cut into statements once, not once for every use of them."""
    from pyspark.sql import functions as F

    from querent.functions import sqltext

    plan = spark.range(1).select(sqltext.validate_read_only(F.concat(F.lit("SELECT "), F.col("id").cast("string"))))._jdf.queryExecution().analyzed().toString()
    assert plan.count("\x01b") <= 4
