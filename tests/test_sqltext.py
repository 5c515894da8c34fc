"""SQL text functions against a plain scanner on random strings and on known cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from querent.functions import sqltext

BITS = ["'", "''", '"', "`", "[", "]", "--", "-", "/*", "*/", "/", "*", ";", "(", ")", "\n", " ", "a", "ORDER", " by ", "from", "É", "1x", "$", "select"]


def plain_scan(sql):
    out, i, start = [], 0, 0
    close = {"'": "'", '"': '"', "`": "`", "[": "]"}

    def flush(end):
        if end > start:
            out.append(("code", sql[start:end], start, end))

    while i < len(sql):
        end = None
        if sql[i] in close:
            j, c = i + 1, close[sql[i]]
            while j < len(sql) and not (sql[j] == c and (c == "]" or sql[j : j + 2] != c * 2)):
                j += 2 if sql[j] == c else 1
            end, kind = min(j + 1, len(sql)), "string" if sql[i] == "'" else "ident"
        elif sql.startswith("--", i):
            end, kind = (sql.find("\n", i) + 1) or len(sql), "comment"
        elif sql.startswith("/*", i):
            j = sql.find("*/", i + 2)
            end, kind = len(sql) if j < 0 else j + 2, "comment"
        if end is None:
            i += 1
            continue
        flush(i)
        out.append((kind, sql[i:end], i, end))
        i = start = end
    flush(len(sql))
    return out


def plain_words(sql):
    depth, out = 0, []
    for kind, text, _, _ in plain_scan(sql):
        if kind != "code":
            continue
        for m in re.finditer(r"[A-Za-z_][A-Za-z_0-9$]*|[()]", text):
            if m[0] == "(":
                depth += 1
            elif m[0] == ")":
                depth = max(0, depth - 1)
            else:
                out.append((m[0].upper(), depth, text[m.end() :].lstrip()[:1]))
    return out


def apply(spark, texts, function):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", function(F.col("s")).alias("v")).collect()
    return [r.v for r in sorted(rows, key=lambda r: r.i)]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    return ["".join(r.choice(BITS) for _ in range(r.randint(0, 14))) for _ in range(1500)]


def test_scan_is_lossless_and_equals_the_plain_scanner(spark, texts):
    got = [[tuple(s) for s in v] for v in apply(spark, texts, sqltext.scan)]
    assert got == [plain_scan(t) for t in texts]


def test_code_words(spark, texts):
    assert [[tuple(w) for w in v] for v in apply(spark, texts, sqltext.code_words)] == [plain_words(t) for t in texts]


def test_statements_and_comments(spark, texts):
    def statements(sql):
        parts, now = [], ""
        for kind, text, _, _ in plain_scan(sql):
            for piece in re.split("(;)", text) if kind == "code" else [text]:
                if piece == ";" and kind == "code":
                    parts, now = [*parts, now], ""
                else:
                    now += piece
        bare = lambda s: "".join(" " if k == "comment" else t for k, t, _, _ in plain_scan(s)).strip()
        return [s.strip() for s in [*parts, now] if bare(s.strip())]

    assert apply(spark, texts, sqltext.split_statements) == [statements(t) for t in texts]
    assert apply(spark, texts, sqltext.strip_comments) == ["".join(" " if k == "comment" else t for k, t, _, _ in plain_scan(s)) for s in texts]


@pytest.mark.parametrize(
    ("sql", "reason"),
    [
        ("SELECT 1", None), ("select a from t where b = 'x'", None), ("WITH c AS (SELECT 1 AS x) SELECT x FROM c", None), ("VALUES (1), (2)", None), ("SELECT replace(a, 'b', 'c') FROM t", None),
        ("SELECT `drop table`, [insert into] FROM t", None), ("SELECT 'DROP TABLE t' AS w", None), ("", "empty query"), (" ; -- x", "no executable statement"), ("SELECT 1; DROP TABLE t", "expected 1 statement, found 2"),
        ("PRAGMA x(t)", "statement starts with PRAGMA"), ("(1)", "statement starts with <none>"), ("WITH c AS (SELECT 1) DELETE FROM t", "forbidden keyword DELETE"), ("SELECT replace FROM t", "forbidden keyword REPLACE"),
    ],
)
def test_validation(spark, sql, reason):
    v = apply(spark, [sql], sqltext.validate_read_only)[0]
    assert (v.ok, v.reason) == (reason is None, reason)


def test_statement_is_trimmed(spark):
    assert apply(spark, ["  SELECT 1 ;  ", None], sqltext.validate_read_only)[0].statement == "SELECT 1"


@pytest.mark.parametrize(
    ("text", "sql"),
    [
        ("Here:\n```sql\nSELECT 1\n```\n", "SELECT 1"), ("```sql\nSELECT 1\n```\nno:\n```SQL\nSELECT 2;;\n```", "SELECT 2"), ("<think>\n```sql\nSELECT 9\n```\n</think>\n```sql\nSELECT 1\n```", "SELECT 1"),
        ("```sql\nSELECT 1 FROM t", "SELECT 1 FROM t"), ("The answer is\nSELECT a FROM t;", "SELECT a FROM t"), ("<SQL>SELECT 3</sql> <answer> </answer>", "SELECT 3"), ("I can't.", ""), ("", ""), (None, ""),
        ("SELECT a\nFROM b\nWHERE x IN (\nSELECT y)", "SELECT y)"),
    ],
)
def test_extraction(spark, text, sql):
    assert apply(spark, [text], sqltext.extract_sql) == [sql]


def test_order_by_depth(spark):
    cases = {
        "SELECT a FROM t ORDER BY a": True, "SELECT a FROM (SELECT a FROM t ORDER BY a)": False, "SELECT 'ORDER BY' FROM t": False, "SELECT a FROM t -- ORDER BY a": False,
        "SELECT row_number() OVER (ORDER BY a) FROM t": False, "SELECT a FROM t UNION SELECT b FROM u ORDER\nBY 1": True, "SELECT [order by] FROM t": False,
    }
    assert apply(spark, list(cases), sqltext.has_top_level_order_by) == list(cases.values())


def test_targets_and_names(spark):
    assert apply(spark, ["  SELECT  'a  b'\n FROM t ;; "], sqltext.format_target) == ["```sql\nSELECT 'a b' FROM t\n```"]
    assert apply(spark, ['he"ad'], sqltext.quote_identifier) == ['"he""ad"']
    assert apply(spark, ["SELECT a /* x */ ,\n 'k  l'  FROM [t  u] -- e"], sqltext.normalize_whitespace) == ["SELECT a   , 'k  l' FROM [t u]"]
