"""Verdicts, the guard, records, SQLite files, rendering, splits and streams on small fixtures."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from querent.functions.canonical import with_keys
from querent.operators import evaluation, linking, prompts, rewards, slices, splits, verify
from querent.plans import guard
from querent.sources import records, sqlite
from querent.streaming import rollouts as streaming


@pytest.fixture(scope="module")
def company(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "company.sqlite")
    link = sqlite3.connect(path)
    link.executescript(
        """CREATE TABLE dept (dept_id INTEGER PRIMARY KEY, name TEXT NOT NULL, "head count" INTEGER);
        CREATE TABLE staff (staff_id INTEGER PRIMARY KEY, name TEXT NOT NULL, dept_id INTEGER REFERENCES dept(dept_id), salary REAL, note TEXT);
        INSERT INTO dept VALUES (1, 'Research', 3), (2, 'Sales', 2), (3, 'Empty', 0);
        INSERT INTO staff VALUES (1, 'Ada', 1, 100.0, 'lead'), (2, 'Bob', 1, 90.0, NULL), (3, 'Cy', 1, 90.0, ''), (4, 'Dee', 2, 80.0, NULL), (5, 'Eve', 2, 80.0, 'part-time');"""
    )
    link.execute("CREATE TABLE t (id INTEGER, v TEXT)")
    link.execute("INSERT INTO t VALUES (1, CAST(x'FFFE' AS TEXT))")
    link.commit()
    link.close()
    return path, sqlite.register_database(spark, path)


def test_sqlite_source(spark, company):
    path, names = company
    assert names == ("dept", "staff", "t")
    staff = sqlite.read_table(spark, path, "staff", 3)
    assert [f.dataType.simpleString() for f in staff.schema] == ["bigint", "string", "bigint", "double", "string"]
    assert sorted((r.staff_id, r.note) for r in staff.collect()) == [(1, "lead"), (2, None), (3, ""), (4, None), (5, "part-time")]
    assert spark.table("t").first().v == "��"
    assert sqlite.sample_rows(spark, path, "dept", 2) == [(1, "Research", 3), (2, "Sales", 2)] and sqlite.sample_rows(spark, path, "none") == []
    with pytest.raises(FileNotFoundError):
        sqlite.connect(path + "x")


def test_catalog(spark, company, tmp_path):
    (tmp_path / "Staff.csv").write_bytes("﻿original_column_name,column_description,value_description\nsalary , yearly pay,euros\n".encode())
    tables, columns, fks = sqlite.load_catalog(spark, {"company": company[0]}, {"company": str(tmp_path)})
    assert [r.table for r in tables.orderBy("table").collect()] == ["dept", "staff", "t"]
    assert columns.where("name = 'salary'").first().description == "yearly pay"
    assert [tuple(r) for r in fks.collect()] == [("company", "staff", "dept_id", "dept", "dept_id")]
    ddl = {r.table: r.block for r in prompts.table_blocks(tables.withColumn("ddl", F.lit(None).cast("string")), columns, fks).collect()}
    assert ddl["dept"] == 'CREATE TABLE "dept" (\n  "dept_id" INTEGER PRIMARY KEY,\n  "name" TEXT NOT NULL,\n  "head count" INTEGER\n);'
    assert ddl["staff"].endswith('  "note" TEXT,\n  FOREIGN KEY ("dept_id") REFERENCES "dept"("dept_id")\n);')
    compact = {r.table: r.block for r in prompts.table_blocks(tables, columns, fks, "compact", True).collect()}
    assert "#   salary (REAL) -- yearly pay; euros" in compact["staff"] and compact["staff"].endswith("#   dept_id -> dept.dept_id")
    assert prompts.sample_block("dept", ["a", "b"], [(1, None), ("x\ny", 2)]) == "-- 2 example rows from dept:\n-- a | b\n-- 1 | NULL\n-- x\n-- y | 2"


@pytest.mark.parametrize(
    ("pred", "gold", "official", "strict", "reason"),
    [
        ("SELECT DISTINCT salary FROM staff", "SELECT salary FROM staff", True, False, "row_count"), ("SELECT name, salary FROM staff WHERE 1 = 0", "SELECT name FROM staff WHERE 1 = 0", True, False, "column_count"),
        ("SELECT name FROM staff WHERE 1 = 0", "SELECT name FROM dept WHERE 1 = 0", True, True, None), ("SELECT 0.3D", "SELECT 0.1D + 0.2D", False, True, None), ("SELECT count(*) FROM staff", "SELECT 5.0D", True, True, None),
        ("SELECT name FROM staff WHERE dept_id = 2", "SELECT name FROM staff WHERE dept_id = 1", False, False, "row_count"), ("SELECT 1", "SELECT '1'", False, False, "row_values"),
        ("SELECT CAST(NULL AS INT)", "SELECT 0", False, False, "row_values"), ("SELECT note FROM staff WHERE staff_id = 2", "SELECT note FROM staff WHERE staff_id = 3", False, False, "row_values"),
    ],
)
def test_verdicts(spark, company, pred, gold, official, strict, reason):
    row = verify.compare_frames(spark.sql(pred), spark.sql(gold)).first()
    assert (row.official, row.strict, row.reason) == (official, strict, reason)


def test_canonical_keys(spark):
    def key(expression, which="canon"):
        return with_keys(spark.sql(f"SELECT {expression}")).first()[which][0]

    assert key("1") == key("1.0D") == key("true") and key("2.0000001D") == key("2.0000002D") and key("-0.0D") == key("0")
    assert key("1.0D") != key("1.1D") and key("0") != key("NULL") != key("''") and key("0") != key("'0'") and key("X'30'") != key("'0'")
    assert key("1152921504606846977") != key("CAST(1152921504606846977 AS DOUBLE)")
    assert key("123456.5D") == "f:123456" and key("8.000015D") == "f:8.00001" and key("double('NaN')") == "f:nan"
    assert key("0.3D", "exact") != key("0.1D + 0.2D", "exact") and key("1", "exact") == key("1.0D", "exact") == key("true", "exact")


def test_compare_runs_orders_and_failures(spark, company):
    run = guard.SqlExecutor(spark, company[1], timeout_s=60, max_rows=4)
    up, down = "SELECT dept_id FROM dept ORDER BY dept_id", "SELECT dept_id FROM dept ORDER BY dept_id DESC"
    bad, long = "SELECT nope FROM dept", "SELECT staff_id FROM staff"
    results, rows = run.frames(run.execute_many([up, down, bad, long]))
    pairs = spark.createDataFrame([(0, down, up, up), (1, bad, up, up), (2, up, bad, bad), (3, None, up, up), (4, long, long, long), (5, up, up, up)], "pair_id int, pred_id string, gold_id string, gold_sql string")

    def verdicts(policy):
        return {r.pair_id: (r.official, r.strict, r.reason) for r in verify.compare_runs(pairs, results, rows, policy).collect()}

    loose = verdicts("ignore")
    assert loose == {0: (True, True, None), 1: (False, False, "pred_failed"), 2: (False, False, "gold_failed"), 3: (False, False, "pred_failed"), 4: (True, False, "truncated"), 5: (True, True, None)}
    assert verdicts("gold_order_by")[0] == verdicts("always")[0] == (True, False, "row_order")
    with pytest.raises(ValueError):
        verify.compare_runs(pairs, results, rows, "sometimes")


def test_guard(spark, company):
    run = guard.SqlExecutor(spark, company[1], timeout_s=60)
    cases = {
        "SELECT n FROM (SELECT count(*) AS n FROM staff) WHERE n IN (SELECT 5)": "ok", "WITH a AS (SELECT name FROM staff) SELECT * FROM a": "ok", "DROP TABLE staff": "rejected",
        "SELECT reflect('java.lang.System', 'exit', 0)": "rejected", "SELECT * FROM parquet.`/tmp/x`": "rejected", "SELECT * FROM secret": "rejected", "SELECT 1 WHERE EXISTS (SELECT 1 FROM secret)": "rejected",
        "WITH a AS (SELECT java_method('a', 'b')) SELECT * FROM a": "rejected", "SELECT nope FROM staff": "error", "SELECT 1; SELECT 2": "rejected", "SELECT FROM WHERE": "error",
    }
    assert {q: run.execute(q).status for q in cases} == cases
    again = run.execute("DROP TABLE staff")
    assert again.error == "statement starts with DROP" and run.stats["cache_hits"] == 1 and run.stats["calls"] == len(cases) + 1
    # The plan is judged even if the text isn't.
    assert run.execute("CREATE TABLE x (a INT)", validate=False, use_cache=False).status == "error"


def test_deadline(spark, company):
    spark.range(500_000).createOrReplaceTempView("many")
    run = guard.SqlExecutor(spark, ("many",), timeout_s=3)
    endless = "SELECT count(*) FROM many a, many b WHERE a.id + b.id * 3 % 7 = 3"
    assert run.execute(endless).status == "timeout" and run.execute(endless).status == "timeout"
    assert run.stats["cache_hits"] == 0 and run.execute("SELECT 1").ok


def test_rewards(spark, company):
    rows = [
        (0, "```sql\nSELECT DISTINCT salary FROM staff\n```", "SELECT salary FROM staff"), (1, "```sql\nSELECT name FROM dept\n```", "SELECT name FROM dept"), (2, "prose", "SELECT 1"),
        (3, "```sql\nDELETE FROM staff\n```", "SELECT 1"), (4, "```sql\nSELECT nope FROM staff\n```", "SELECT 1"), (5, "```sql\nSELECT 7\n```", "SELECT count(*) FROM staff"), (6, "```sql\nSELECT name FROM dept WHERE 1 = 0\n```", ""),
    ]
    df = spark.createDataFrame(rows, "rollout_id int, completion string, gold_sql string")
    config = rewards.RewardConfig(format_bonus=0.1, execution_bonus=0.2)
    found = rewards.score(df, guard.SqlExecutor(spark, company[1], timeout_s=60), config).persist()
    got = {r.rollout_id: r for r in found.collect()}
    assert [round(got[i].reward, 3) for i in range(7)] == [1.3, 1.3, 0.0, 0.0, 0.1, 0.3, 0.3]
    assert [got[i].reason for i in range(7)] == ["row_count", None, "no_sql_in_completion", "statement starts with DELETE", "pred_failed", "row_values", "gold_failed"]
    assert got[5].no_from_clause and got[6].empty_result and not got[3].parsed and got[2].pred_status == "rejected"
    stats = rewards.stats(found).first()
    assert stats.n == 7 and stats.hack_rate == round(4 / 7, 4) and stats.official_minus_strict == round(1 / 7, 4) and config.max_reward == 1.3


def test_evaluation(spark, company):
    examples = spark.createDataFrame(
        [(0, "c", "simple", "SELECT count(*) FROM staff"), (1, "c", "simple", "SELECT salary FROM staff"), (2, "c", "moderate", "SELECT name FROM staff WHERE dept_id = 1"), (3, "c", None, "SELECT name FROM dept"), (4, "c", "", "SELECT count(*) FROM dept")],
        "question_id int, db_id string, difficulty string, gold_sql string",
    )
    predictions = spark.createDataFrame(
        [(0, "```sql\nSELECT count(*) FROM staff\n```"), (1, "```sql\nSELECT DISTINCT salary FROM staff\n```"), (2, "```sql\nSELECT name FROM staff WHERE dept_id = 2\n```"), (3, "I don't know.")], "question_id int, completion string"
    )
    run = guard.SqlExecutor(spark, company[1], timeout_s=60)
    ready = evaluation.with_predictions(examples, predictions).persist()
    results, rows = run.frames(run.execute_many([x for r in ready.collect() for x in (r.pred_sql, r.gold_sql)]))
    pairs = ready.select(F.col("question_id").alias("pair_id"), F.nullif("pred_sql", F.lit("")).alias("pred_id"), F.col("gold_sql").alias("gold_id"), "gold_sql")
    outcomes = ready.join(verify.compare_runs(pairs, results, rows).withColumnRenamed("pair_id", "question_id"), "question_id").persist()
    total = evaluation.report(outcomes).first()
    assert (total.n, total.official_ex, total.strict_ex, total.n_missing_predictions, total.n_unparsed, total.n_official_not_strict) == (5, 40.0, 20.0, 1, 1, 1)
    assert evaluation.histogram(outcomes, "reason").first().reason_counts == {"row_count": 2, "pred_failed": 2}
    groups = {r.difficulty: (r.n, r.official_ex) for r in evaluation.by_group(outcomes).collect()}
    assert groups == {"simple": (2, 100.0), "moderate": (1, 0.0), "unknown": (2, 0.0), "all": (5, 40.0)}
    assert evaluation.metrics(outcomes)["official_ex_simple"] == 100.0
    facts = {r.question_id: r for r in evaluation.gold_facts(examples, results, rows).collect()}
    assert facts[1].n_duplicate_rows == 2 and facts[1].n_rows == 5 and facts[0].n_duplicate_rows == 0
    assert {r.change: r.n for r in evaluation.paired(outcomes, outcomes.withColumn("official", F.lit(True))).collect()} == {"both": 2, "gained": 3}


def test_records(spark, tmp_path):
    questions = tmp_path / "q.json"
    questions.write_text(json.dumps([{"db_id": "a", "question": " Q? ", "query": "SELECT 1"}, {"question_id": 7, "db_id": "b", "question": "R", "SQL": "", "sql": " S ", "evidence": "e"}]))
    got = records.read_questions(spark, str(questions)).orderBy("index").collect()
    assert [(r.question_id, r.question, r.gold_sql, r.evidence) for r in got] == [(0, "Q?", "SELECT 1", ""), (7, "R", "S", "e")]
    records.write_questions(records.read_questions(spark, str(questions)), str(tmp_path / "out"))
    assert [r.question_id for r in records.read_questions(spark, str(tmp_path / "out")).orderBy("index").collect()] == [0, 7]
    questions.write_text(json.dumps([{"question": "no database"}]))
    with pytest.raises(Exception, match="db_id is missing"):
        records.read_questions(spark, str(questions)).collect()
    lines = tmp_path / "p.jsonl"
    lines.write_text("\n".join(json.dumps(x) for x in [{"question_id": 1, "completion": "a"}, {"question_id": 2, "sql": "s"}, {"question_id": 1, "completion": "b"}, {"question_id": 3, "error": "x"}]))
    found = records.read_predictions(spark, str(lines))
    assert {r.question_id: r.completion for r in found.collect()} == {1: "b", 2: "s", 3: ""}
    assert records.to_do(spark.range(5).withColumnRenamed("id", "question_id"), records.finished(spark, str(lines))).count() == 2
    log = str(tmp_path / "runs")
    assert records.read_runs(spark, log) == []
    kept = records.append_run(spark, {"stage": "sft", "split": "val", "n_samples": 3, "metrics": {"x": 1}, "git_sha": "own"}, log)
    records.append_run(spark, {"stage": "baseline", "split": "val", "n_samples": 3, "metrics": {}}, log)
    assert kept["git_sha"] == "own" and len(records.read_runs(spark, log)) == 2
    with pytest.raises(ValueError, match="metrics"):
        records.append_run(spark, {"stage": "sft", "split": "val", "n_samples": 3}, log)


def test_prompts_and_training_rows(spark):
    df = spark.createDataFrame([(1, "d", "How many?", "hint", "SELECT  count(*)\nFROM t;", 0, ["t"]), (2, "d", "Why?", "", "SELECT 1", 1, ["t"])], "question_id int, db_id string, question string, evidence string, gold_sql string, index int, selected_tables array<string>")
    rows = {r.question_id: r for r in prompts.sft_records(df, F.lit("S")).collect()}
    user = rows[1].messages[1].content
    assert user == "Database schema:\n\nS\n\nExternal knowledge: hint\n\nQuestion: How many?\n\n" + prompts.INSTRUCTIONS["v1"]
    assert "External" not in rows[2].messages[1].content and rows[1].messages[2].content == "```sql\nSELECT count(*) FROM t\n```"
    assert rows[1].n_prompt_chars == len(prompts.SYSTEM_PROMPT) + len(user)
    with pytest.raises(Exception, match="no gold SQL"):
        prompts.sft_records(df.withColumn("gold_sql", F.lit("")), F.lit("S")).collect()
    row = prompts.rl_rows(df, F.lit("S"), "val", "own", "linked", prompts.PromptConfig(include_evidence=False, instruction_version="v2")).first()
    assert row.extra_info.schema_mode == "linked" and row.reward_model.ground_truth.startswith("SELECT") and "hint" not in row.prompt[1].content
    with pytest.raises(ValueError):
        prompts.PromptConfig(instruction_version="v9")


def test_budget_skips_but_goes_on(spark):
    blocks = spark.createDataFrame([(1, 0, "a", "x" * 60), (1, 1, "b", "y" * 50), (1, 2, "c", "z" * 20), (2, 0, "d", "w" * 200)], "question_id int, rank int, name string, block string")
    got = {r.question_id: r for r in linking.within_budget(blocks, 100).collect()}
    assert got[1].names == ["a", "c"] and got[1].chars == 82 == len(got[1].text) and got[1].exceeded
    assert got[2].names == ["d"] and got[2].exceeded
    assert not linking.within_budget(blocks, 0).where("exceeded").count()


def test_splits_lose_nothing(spark):
    examples = spark.createDataFrame([(i, f"db{i % 10}", "" if i % 17 == 0 else "SELECT 1") for i in range(200)], "question_id int, db_id string, gold_sql string")
    facts = spark.createDataFrame([(i, "error" if i % 19 == 0 else "ok", float(i % 12)) for i in range(200) if i % 23], "question_id int, status string, elapsed_s double")
    plan = splits.plan_splits(examples, facts, val_size=40).toPandas()
    assert len(plan) == 200 and not (set(plan.db_id[plan.part == "val"]) & set(plan.db_id[plan.part == "train"])) and (plan.part == "val").sum() >= 40
    whole = splits.plan_splits(examples, facts, val_size=10_000).toPandas()
    assert (whole.part == "train").any()
    assert (splits.plan_splits(examples, facts, val_size=30, strategy="random", seed=3).toPandas().part == "val").sum() == 30
    with pytest.raises(ValueError):
        splits.plan_splits(examples, facts, val_size=-1)


def test_slices_drop_the_rest(spark):
    log = spark.range(10).select("id", F.lit(1.0).alias("reward"), (F.col("id") > 4).alias("correct"), F.lit(True).alias("official"), F.lit(True).alias("executed"), F.lit(False).alias("no_from_clause"), F.lit(False).alias("empty_result"))
    found = {r.slice: (r.n, r.strict) for r in slices.summarise(slices.in_slices(log, ["id"], 4)).collect()}
    assert found == {1: (2, 0.0), 2: (2, 0.0), 3: (2, 0.5), 4: (2, 1.0)}
    marks = slices.floor_percentiles(spark.range(1, 101), F.col("id"), (0.5, 0.95, 1.0), ("a", "b", "c")).first()
    assert tuple(marks) == (51, 96, 100)


def test_streams(spark, tmp_path):
    row = {"reward": 1.0, "correct": True, "official": True, "split": "train", "question_id": 1}
    (tmp_path / "a.json").write_text("\n".join(json.dumps(x) for x in [row, row | {"correct": False}, {"error": "x"}]))
    usable, errors = records.read_rollouts(spark, str(tmp_path / "a.json"))
    assert usable.count() == 2 and errors.first().n_errors == 1
    found = streaming.keep_latest(streaming.running_stats(streaming.rollout_stream(spark, str(tmp_path))), str(tmp_path / "out"), str(tmp_path / "state")).collect()
    assert [(r.split, r.n, r.strict_acc, r.hack_rate) for r in found] == [("train", 2, 0.5, 0.5)]
