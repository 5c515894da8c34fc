"""Result store, failing rollouts, SQLite filters, selection, ranks, linking and connection against plain versions."""

import random
import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from querent import storage
from querent.functions import sqltext
from querent.operators import linking, rewards, slices, temporal
from querent.plans import guard
from querent.sources import log, sqlite
from querent.streaming import rollouts as streaming

# --- results and scores ----------------------------------------------------------------------------


def test_results_lie_in_the_store(spark):
    spark.range(20).createOrReplaceTempView("numbers")
    run = guard.SqlExecutor(spark, ("numbers",), timeout_s=60, max_rows=5)
    sql = "SELECT id FROM numbers ORDER BY id DESC"
    found = run.execute(sql)
    assert (found.status, found.n_rows, found.truncated) == ("ok", 5, True)
    assert [r[1] for r in found.rows] == [(f"n:{i}",) for i in (19, 18, 17, 16, 15)]
    results, rows = run.frames({sql: found})
    assert results.first().n_rows == 5
    assert [r.exact[0] for r in rows.orderBy("row_idx").collect()] == [f"n:{i}" for i in (19, 18, 17, 16, 15)]
    assert "LocalTableScan" not in rows._jdf.queryExecution().executedPlan().toString()
    run.clear_cache()
    assert not storage.exists(spark, f"{run.store.folder}/{found.digest}")


def test_changed_views_are_run_again(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("changing")
    run = guard.SqlExecutor(spark, ("changing",), timeout_s=60)
    count = lambda: run.execute("SELECT count(*) FROM changing").rows[0][1]
    assert count() == count() == ("n:3",) and run.stats["cache_hits"] == 1
    spark.range(4).createOrReplaceTempView("changing")
    assert count() == ("n:4",) and run.stats["cache_hits"] == 1
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    spark.read.parquet(path).createOrReplaceTempView("changing")
    assert count() == ("n:5",)
    spark.range(6).write.mode("overwrite").parquet(path)
    spark.read.parquet(path).createOrReplaceTempView("changing")
    assert count() == ("n:6",) and run.stats["cache_hits"] == 1


def test_a_failing_rollout_costs_no_other(spark, tmp_path):
    rollouts = spark.range(50).select(F.col("id").alias("rollout_id"), (F.col("id") % 5).alias("question_id"), F.lit("val").alias("split"))
    bad = {3, 17, 18, 49}

    def scorer(part, executor, config):
        ok = ~F.col("rollout_id").isin(*bad)
        return part.select("rollout_id", F.when(ok, F.lit(1.0)).otherwise(F.raise_error(F.concat(F.lit("bad "), F.col("rollout_id").cast("string")))).alias("reward"))

    path = str(tmp_path / "log")
    got = {r.rollout_id: (r.reward, r.error) for r in rewards.compute_scores(rollouts, None, path=path, scorer=scorer).collect()}
    assert set(got) == set(range(50))
    assert {i for i, (reward, error) in got.items() if error} == bad
    assert all(reward == (0.0 if i in bad else 1.0) for i, (reward, _) in got.items())
    assert all(f"bad {i}" in got[i][1] for i in bad)
    logged = log.read(spark, path, "reward double, question_id long, split string, error string").collect()
    assert len(logged) == 50 and sorted(r.question_id for r in logged if r.error) == sorted(i % 5 for i in bad)


def test_a_failure_of_an_empty_batch_is_nobodys(spark):
    calls = []

    def scorer(part, executor, config):
        calls.append(1)
        raise RuntimeError("no cluster")

    got = rewards.compute_scores(spark.range(9).withColumnRenamed("id", "rollout_id"), None, scorer=scorer).collect()
    assert len(calls) == 2 and {(r.reward, r.error) for r in got} == {(0.0, "RuntimeError: no cluster")}


def test_figures_of_no_records(spark):
    none = spark.createDataFrame([], "reward double, correct boolean, official boolean, parsed boolean, executed boolean, no_from_clause boolean, empty_result boolean")
    got = rewards.stats(none).first().asDict()
    assert got.pop("n") == 0 and set(got.values()) == {None}


def test_views_of_a_stateless_run_are_pruned(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.range(100).select("id", *[(F.col("id") * i).alias(f"c{i}") for i in range(9)]).write.parquet(path)
    own = spark.newSession()
    plan = spark.read.parquet(path)._jdf.queryExecution().analyzed()
    from pyspark.sql import DataFrame

    DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, plan), own).createOrReplaceTempView("wide")
    shown = own.sql("SELECT count(*) FROM wide WHERE c3 > 30")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c3:bigint>" in shown and "GreaterThan(c3,30)" in shown
    got = guard.execute_sql(spark, "SELECT count(*) FROM w WHERE c3 > 30", {"w": spark.read.parquet(path)})
    assert got.rows[0][1] == ("n:89",)


# --- SQLite ----------------------------------------------------------------------------------------


@pytest.fixture
def mixed(tmp_path):
    path = str(tmp_path / "m.sqlite")
    with sqlite3.connect(path) as link:
        link.execute('CREATE TABLE t (k INTEGER PRIMARY KEY, i INT, r REAL, s TEXT COLLATE NOCASE, "odd name" TEXT)')
        r = random.Random(5)
        link.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", [
            (k * k, r.choice([None, 1, 2, 3.7, "4"]), r.choice([None, 1, 2.5, -3.0]), r.choice([None, "a", "A", "ab", "é", 7]), r.choice(["x", "y'z"])) for k in range(500)
        ])
    return path


@pytest.mark.parametrize("filters", [
    [("i", "=", 3)], [("i", ">", 1), ("i", "<=", 3)], [("r", ">=", 2)], [("s", "=", "a")], [("s", "starts", "a")], [("s", "in", ["A", "é", "7"])], [("i", "null", None)], [("r", "filled", None), ("s", ">", "a")],
    [("odd name", "=", "y'z")], [("k", "<", 100)], [("i", "in", list(range(600)))],
])
def test_filters_in_the_file(spark, mixed, filters):
    whole = sqlite.read_table(spark, mixed, "t")
    for f in filters:
        whole = whole.where(sqlite._spark_condition(f))
    want = sorted(map(tuple, whole.collect()), key=str)
    assert sorted(map(tuple, sqlite.read_table(spark, mixed, "t", filters=filters).collect()), key=str) == want
    narrow = sqlite.read_table(spark, mixed, "t", columns=["k"], filters=filters)
    assert narrow.columns == ["k"] and sorted(r.k for r in narrow.collect()) == sorted(r[0] for r in want)


def test_rows_read_from_the_file(mixed):
    def read(**options):
        source = sqlite.SqliteSource({"path": mixed, "table": "t", "partitions": "4", **options})
        reader = source.reader(None)
        parts = reader.partitions()
        return [list(reader.read(p)) for p in parts]

    # Ids are squares: ranges of equal width would put half of all rows into the first.
    assert [len(p) for p in read()] == [125] * 4
    few = read(filters='[["k", "<", 10000]]', columns='["k", "i"]')
    assert [len(p) for p in few] == [25] * 4 and all(len(row) == 2 for p in few for row in p)
    assert read(filters='[["k", "<", -1]]') == []


def test_two_scans_of_a_view_keep_their_filters(spark, mixed):
    sqlite.read_table(spark, mixed, "t").createOrReplaceTempView("mixed_view")
    got = spark.sql("SELECT (SELECT count(*) FROM mixed_view WHERE k < 100) AS a, (SELECT count(*) FROM mixed_view WHERE k >= 100) AS b").first()
    assert (got.a, got.b) == (10, 490)


# --- ranks and percentiles -------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["long", "double", "same", "huge", "negative"])
def test_percentiles_by_histograms(spark, kind):
    r = random.Random(6)
    make = {"long": lambda: r.randint(0, 10**6), "double": lambda: r.random() ** 9, "same": lambda: 5, "huge": lambda: 2**62 + r.randint(0, 5), "negative": lambda: r.choice([-1e308, 1e308, 0.0, 5e-324, -2.5])}[kind]
    values = [make() for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in [*values, None, None]], f"v {'long' if isinstance(values[0], int) else 'double'}")
    points = (0.0, 0.01, 0.5, 0.95, 0.99, 1.0)
    found = slices.floor_percentiles(df, F.col("v"), points, tuple("abcdef"))
    want = sorted(values)
    assert tuple(found.first()) == tuple(want[min(len(want) - 1, int(p * len(want)))] for p in points)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_percentiles_of_nothing(spark):
    assert tuple(slices.floor_percentiles(spark.range(0), F.col("id"), (0.5,), ("a",)).first()) == (None,)


def test_ranks_of_whole_keys(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("id"), F.lit(1).alias("same"), F.concat(F.lit("k"), (F.col("id") % 11).cast("string")).alias("text"), (F.col("id") + F.lit(2**53)).alias("wide")).repartition(7)
    for order, key in ((["same", "id"], lambda r: r.id), (["text", F.desc("id")], lambda r: (r.text, -r.id)), (["wide"], lambda r: r.wide), ([F.struct("same", "wide")], lambda r: r.wide)):
        got = slices.global_rank(df, order).collect()
        assert [r["rank"] for r in sorted(got, key=key)] == list(range(3000))
        assert got[0].asDict().keys() == {*df.columns, "rank"}
    assert slices.global_rank(df.limit(0), ["id"]).count() == 0


# --- as-of -----------------------------------------------------------------------------------------


def test_as_of_keeps_rows_without_a_time_or_key(spark):
    left = spark.createDataFrame([(1, None, 0), (2, 5.0, 0), (3, 5.0, None), (4, None, None)], "i int, t double, k int")
    right = spark.createDataFrame([(1.0, 0, 7), (None, 0, 8), (1.0, None, 9)], "t double, k int, v int")
    got = {r.i: r.v for r in temporal.as_of_join(left, right, "t", "v", ("k",)).collect()}
    assert got == {1: None, 2: 7, 3: None, 4: None}


# --- linking ---------------------------------------------------------------------------------------


def words_of(text):
    import re

    return re.findall("[a-z0-9]+", re.sub("(?<=[a-z0-9])(?=[A-Z])", " ", text).replace("_", " ").lower())


def plain_score(question, table, columns):
    phrase = " ".join(words_of(question))
    asked = set(words_of(question)) - set(linking.STOP_WORDS)
    held = lambda name: bool(words_of(name)) and " ".join(words_of(name)) in phrase
    shared = lambda name: len(asked & set(words_of(name)))
    return 12 * held(table) + 4 * shared(table) + sum(5 * held(c) + shared(c) for c in columns)


def schema_of(spark, names):
    tables = spark.createDataFrame([(d, t, None) for d, t in names], "db_id string, table string, ddl string")
    columns = spark.createDataFrame([(d, t, i, c) for (d, t), cs in names.items() for i, c in enumerate(cs)], "db_id string, table string, pos int, name string")
    return tables, columns


def test_scores_by_index_and_automaton(spark, monkeypatch):
    r = random.Random(7)
    monkeypatch.setattr(linking, "PART", 7)  # a database's questions in several parts
    parts = ["order", "Item", "customer", "art", "_id", "name", "Of", "x", "part", "date9", "__"]
    name = lambda: "".join(r.choice(parts) for _ in range(r.randint(1, 3)))
    names = {(d, f"{name()}{i}"): [name() for _ in range(r.randint(0, 4))] for d in "ab" for i in range(12)}
    tables, columns = schema_of(spark, names)
    questions = [(i, r.choice("abz"), " ".join(r.choice(["order", "items", "customer", "the", "part", "date9", "artx", "name", "of", "?"]) for _ in range(r.randint(0, 8)))) for i in range(60)]
    asked = spark.createDataFrame([(i, d, q, None) for i, d, q in questions], "question_id int, db_id string, question string, evidence string")
    got = {(x.question_id, x.table): x.score for x in linking.table_scores(asked, tables, columns).collect()}
    want = {(i, t): plain_score(q, t, cs) for i, d, q in questions for (own, t), cs in names.items() if own == d}
    assert got == want
    # Ranks and padding, against all tables sorted.
    fks = spark.createDataFrame([], "db_id string, table string, from_column string, to_table string, to_column string")
    linked: dict = {}
    for x in linking.linked_tables(asked, tables, columns, fks).collect():
        linked.setdefault(x.question_id, {})[x.table] = x.rank
    for i, d, _ in questions:
        order = sorted((t for own, t in names if own == d), key=lambda t: (-want[i, t], t.lower(), t))
        positive = [t for t in order if want[i, t] > 0]
        expected = (positive + [t for t in order if t not in positive])[: max(3, len(positive))] if order else []
        assert linked.get(i, {}) == {t: order.index(t) for t in expected}


def test_ten_thousand_tables_of_one_database(spark):
    tables = spark.range(10_000).select(F.lit("d").alias("db_id"), F.concat(F.lit("t"), F.col("id").cast("string"), F.lit("_log")).alias("table"), F.lit(None).cast("string").alias("ddl"))
    columns = tables.select("db_id", "table", F.lit(0).alias("pos"), F.lit("value").alias("name"))
    asked = spark.range(2000).select(F.col("id").alias("question_id"), F.lit("d").alias("db_id"), F.concat(F.lit("rows in t"), F.col("id").cast("string"), F.lit("_log today")).alias("question"), F.lit("").alias("evidence"))
    began = time.monotonic()
    # Phrases: the table's own, and those of tables whose name the question's goes on from, such as t1_log in t11_log: none.
    best = linking.positive_scores(asked, tables, columns).groupBy("question_id").agg(F.max("score").alias("best"), F.max_by("table", "score").alias("table")).collect()
    assert len(best) == 2000 and all(r.table == f"t{r.question_id}_log" and r.best == 12 + 8 for r in best)
    assert time.monotonic() - began < 120


def test_connection_by_bit_sets(spark, monkeypatch):
    monkeypatch.setattr(linking, "PART", 5)
    r = random.Random(8)
    names = {d: [f"{d}T{i}" for i in range(9)] for d in "abc"}
    keys = {d: [(r.choice(ts), r.choice(ts)) for _ in range(6)] for d, ts in names.items()}
    tables = spark.createDataFrame([(d, t, None) for d, ts in names.items() for t in ts], "db_id string, table string, ddl string")
    fks = spark.createDataFrame([(d, a, "x", b.upper(), "y") for d, own in keys.items() for a, b in own], "db_id string, table string, from_column string, to_table string, to_column string")
    need, kept = {}, {}
    for i in range(80):
        d = r.choice("abc")
        need[i] = (d, {r.choice([*names[d], "missing"]) for _ in range(r.randint(1, 3))})
        kept[i] = {t for t in names[d] if r.random() < 0.7}

    def plain(i, within):
        d, wanted = need[i]
        if not wanted <= set(names[d]):
            return False
        if len(wanted) < 2:
            return True
        reached = {next(iter(sorted(wanted)))} & within
        while True:
            more = {y for a, b in keys[d] for x, y in ((a, b), (b, a)) if x in reached and y in within} - reached
            if not more:
                return wanted <= reached
            reached |= more

    required = spark.createDataFrame([(i, d, t) for i, (d, ts) in need.items() for t in ts], "question_id int, db_id string, table string")
    retained = spark.createDataFrame([(i, need[i][0], t) for i, ts in kept.items() for t in ts], "question_id int, db_id string, table string")
    got = {x.question_id: x.connected for x in linking.fk_connected(required, tables, fks).collect()}
    assert got == {i: plain(i, set(names[need[i][0]])) for i in need}
    got = {x.question_id: x.connected for x in linking.fk_connected(required, tables, fks, retained).collect()}
    assert got == {i: plain(i, kept[i]) for i in need}
    assert len(set(got.values())) == 2


# --- the scanner -----------------------------------------------------------------------------------


def plain_scan(text):
    """(kind, text, start, end) of spans, character by character."""
    out, i, n = [], 0, len(text)
    while i < n:
        start, c = i, text[i]
        if c in "'\"`":
            kind = "string" if c == "'" else "ident"
            i += 1
            while i < n:
                if text[i] == c:
                    if text[i + 1 : i + 2] == c:
                        i += 2
                        continue
                    i += 1
                    break
                i += 1
        elif c == "[":
            kind = "ident"
            i = text.find("]", i) + 1 or n
        elif text.startswith("--", i):
            kind = "comment"
            i = text.find("\n", i) + 1 or n
        elif text.startswith("/*", i):
            kind = "comment"
            i = text.find("*/", i + 2) + 2
            i = n if i == 1 else i
        else:
            kind = "code"
            while i < n and text[i] not in "'\"`[" and not text.startswith(("--", "/*"), i):
                i += 1
        out.append((kind, text[start:i], start, i))
    return out


def plain_words(text):
    import re

    depth, out = 0, []
    for kind, own, _, _ in plain_scan(text):
        if kind == "code":
            for m in re.finditer(r"[A-Za-z_][A-Za-z_0-9$]*|[()]", own):
                if m[0] == "(":
                    depth += 1
                elif m[0] == ")":
                    depth = max(0, depth - 1)
                else:
                    out.append((m[0].upper(), depth))
    return out


def statements(r):
    parts = ["'a;b'", "'it''s'", '"q"', "`b`", "[c d]", "-- x;\n", "/* ; */", ";", " ", "SELECT", "(", ")", "order", "by", "a-b", "/", "'", "\x01", "\x01a", "é", ";;", "[", "/*"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 15))) for _ in range(400)]


def test_scanner_against_a_plain_one(spark):
    texts = statements(random.Random(9))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, sql string")
    got = df.select("i", sqltext.scan(F.col("sql")).alias("s"), sqltext.code_words(F.col("sql")).alias("w"), sqltext.split_statements(F.col("sql")).alias("p")).collect()
    for r in got:
        spans = plain_scan(texts[r.i])
        assert [tuple(x) for x in r.s] == spans, texts[r.i]
        assert [(x.word, x.depth) for x in r.w] == plain_words(texts[r.i]), texts[r.i]
        pieces, now = [], ""
        for kind, own, _, _ in spans:
            if kind == "code":
                *done, rest = own.split(";")
                for d in done:
                    pieces.append(now + d)
                    now = ""
                now += rest
            else:
                now += own
        filled = [p.strip() for p in [*pieces, now] if "".join(" " if k == "comment" else t for k, t, _, _ in plain_scan(p)).strip()]
        assert list(r.p) == filled, texts[r.i]


def test_long_statements_take_linear_time(spark):
    text = "SELECT " + ", ".join(f"'v{i}' AS \"c{i}\"" for i in range(25_000)) + " FROM t; " + "(" * 1000 + "SELECT 1"
    df = spark.createDataFrame([(text,)], "sql string")
    began = time.monotonic()
    got = df.select(F.size(sqltext.scan(F.col("sql"))).alias("n"), F.element_at(sqltext.scan(F.col("sql")), -1)["end"].alias("end"), F.size(sqltext.code_words(F.col("sql"))).alias("w"), F.size(sqltext.split_statements(F.col("sql"))).alias("p")).first()
    assert time.monotonic() - began < 20
    assert (got.n, got.end, got.p) == (100_001, len(text), 2) and got.w == 25_000 + 4
    began = time.monotonic()
    df.select(F.size(sqltext.scan(F.col("sql")))).collect()
    assert time.monotonic() - began < 5


# --- streams ---------------------------------------------------------------------------------------


def test_first_seen_goes_to_files(spark, tmp_path):
    from datetime import datetime, timedelta

    base, folder = datetime(2024, 1, 1), str(tmp_path / "in")
    for n, ids in enumerate(([1, 2, 2], [2, 3])):
        spark.createDataFrame([(i, base + timedelta(minutes=n)) for i in ids], "id long, ts timestamp").write.mode("append").parquet(folder)
        stream = streaming.first_seen(streaming.event_stream(spark, folder), "id", "ts", "1 hour")
        found = streaming.run_to_files(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.id for r in found.collect()) == [1, 2, 3]
