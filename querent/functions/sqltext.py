"""SQL text as column expressions: scanning, splitting, extraction from prose, read-only validation.

The scanner is one regular expression whose matches, in order, tile the text: quoted spans, comments and runs of
code. Everything else is arrays of those matches under higher-order functions, so it all stays in the JVM; no Python
runs per row. Places and depths are prefix sums by doubling, and no array grows element by element, so the work is
about linear in the text. Every function takes and returns columns, null text counts as empty, and every text is read
whole.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as in Unicode, and the separators that Python also strips.
_WS = r"[\s\x1c-\x1f]"
_QUOTED = (
    r"'(?:[^']++|'')*+'?"
    r'|"(?:[^"]++|"")*+"?'
    r"|`(?:[^`]++|``)*+`?"
    r"|\[[^\]]*+\]?"
    r"|--[^\n]*+\n?"
    r"|/\*(?:[^*]++|\*(?!/))*+(?:\*/)?"
)
#: Spans; and spans with each semicolon of code by itself.
_SPAN = _QUOTED + r"|(?:[^'\"`\[\-/]++|-(?!-)|/(?!\*))++"
_TOKEN = _QUOTED + r"|;|(?:[^'\"`\[;\-/]++|-(?!-)|/(?!\*))++"
_WORD = r"([A-Za-z_][A-Za-z_0-9$]*|[()])(?=(?U:[\s\x1c-\x1f]*)(?s:(.?)))"

#: What a read-only statement starts with, words it may not hold, and those allowed as functions.
READ_ONLY_LEADING = ("SELECT", "WITH", "VALUES")
FORBIDDEN_WORDS = (
    "ALTER", "ANALYZE", "ATTACH", "BEGIN", "COMMIT", "CREATE", "DELETE", "DETACH", "DROP", "INSERT", "LOAD_EXTENSION",
    "PRAGMA", "REINDEX", "RELEASE", "REPLACE", "ROLLBACK", "SAVEPOINT", "UPDATE", "VACUUM",
)
FUNCTION_FORMS = ("REPLACE",)


def _text(sql: Column) -> Column:
    return F.coalesce(sql, F.lit(""))


def strip(text: Column) -> Column:
    """Text without white space at its ends."""
    return F.regexp_replace(text, rf"(?U)\A{_WS}+|{_WS}+\z", "")


def _let(value: Column, then) -> Column:
    """then(value) with value computed once."""
    return F.transform(F.array(value), then)[0]


def _running(values: Column, combine) -> Column:
    """Of each place of an array what combine makes of all values up to it, by doubling: after round j a place has combined 2^j values."""
    def twice(done: Column, j: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), j)
        return F.transform(done, lambda x, i: F.when(i >= back, combine(x, F.get(done, i - back))).otherwise(x))

    rounds = lambda v: F.sequence(F.lit(0), F.ceil(F.log2(F.size(v) + 1)).cast("int"))
    return _let(values, lambda v: F.aggregate(rounds(v), v, twice))


def tokens(sql: Column) -> Column:
    """array<string>: the spans of the text and the semicolons of its code in order; concatenated they are the text."""
    return F.regexp_extract_all(_text(sql), F.lit(_TOKEN), F.lit(0))


def _kind(token: Column) -> Column:
    head = F.substring(token, 1, 1)
    return (
        F.when(head == "'", "string")
        .when(head.isin('"', "`", "["), "ident")
        .when(token.startswith("--") | token.startswith("/*"), "comment")
        .otherwise("code")
    )


def spans(sql: Column) -> Column:
    """array<string>: the spans of the text in order; what lies between quoted spans and comments is one span of code."""
    return F.regexp_extract_all(_text(sql), F.lit(_SPAN), F.lit(0))


def scan(sql: Column) -> Column:
    """array<struct<kind, text, start, end>>: spans of code, string, ident and comment; lossless, neighbouring code joined."""
    def placed(found: Column) -> Column:
        ends = _running(F.transform(found, F.length), lambda x, y: x + y)
        return _let(ends, lambda e: F.transform(found, lambda t, i: F.struct(_kind(t).alias("kind"), t.alias("text"), (F.get(e, i) - F.length(t)).alias("start"), F.get(e, i).alias("end"))))

    return _let(spans(sql), placed)


def strip_comments(sql: Column) -> Column:
    """The text with each comment replaced by a space."""
    return F.array_join(F.transform(tokens(sql), lambda t: F.when(_kind(t) == "comment", F.lit(" ")).otherwise(t)), "")


def normalize_whitespace(sql: Column) -> Column:
    """Each comment and each run of white space outside strings as one space, span by span, so neighbours stay apart; ends stripped."""
    def one(t: Column) -> Column:
        return F.when(_kind(t) == "comment", F.lit(" ")).when(_kind(t) == "string", t).otherwise(F.regexp_replace(t, rf"(?U){_WS}+", " "))

    return strip(F.array_join(F.transform(tokens(sql), one), ""))


def split_statements(sql: Column) -> Column:
    """array<string>: statements between semicolons of code, stripped; blank and comment-only ones are left out."""
    # Semicolons of code become SOH b and the text's own SOH becomes SOH a, so the split finds the former only.
    marked = F.array_join(F.transform(tokens(sql), lambda t: F.when(t == ";", F.lit("\x01b")).otherwise(F.replace(t, F.lit("\x01"), F.lit("\x01a")))), "")
    pieces = F.transform(F.split(marked, "\x01b", -1), lambda p: strip(F.replace(p, F.lit("\x01a"), F.lit("\x01"))))
    return F.filter(pieces, lambda p: strip(strip_comments(p)) != "")


def code_words(sql: Column) -> Column:
    """array<struct<word, depth, next>>: upper-case words of code spans, their parenthesis depth, and the next character that isn't white space in the span ("" at its end)."""
    def words(t: Column) -> Column:
        return F.arrays_zip(
            F.regexp_extract_all(t, F.lit(_WORD), F.lit(1)).alias("word"), F.regexp_extract_all(t, F.lit(_WORD), F.lit(2)).alias("next")
        )

    def deep(found: Column) -> Column:
        # The depth is the sum of steps, raised by how far it has been below zero: a closing one too many counts for nothing.
        step = lambda w: F.when(w["word"] == "(", 1).when(w["word"] == ")", -1).otherwise(0)
        sums = _running(F.transform(found, step), lambda x, y: x + y)
        return _let(sums, lambda s: _let(_running(s, F.least), lambda low: F.filter(
            F.transform(found, lambda w, i: F.struct(F.upper(w["word"]).alias("word"), (F.get(s, i) - F.least(F.get(low, i), F.lit(0))).alias("depth"), w["next"].alias("next"))),
            lambda w: ~w["word"].isin("(", ")"),
        )))

    # A span of code ends at quotes and comments, but a semicolon is part of it; so is what follows one.
    code = F.filter(spans(sql), lambda t: _kind(t) == "code")
    return _let(F.flatten(F.transform(code, words)), deep)


def leading_keyword(sql: Column) -> Column:
    """The first word of code, or ""."""
    return F.coalesce(F.try_element_at(code_words(sql), F.lit(1))["word"], F.lit(""))


def has_from_clause(sql: Column) -> Column:
    """Whether FROM is a word of code at any depth."""
    return F.exists(code_words(sql), lambda w: w["word"] == "FROM")


def has_top_level_order_by(sql: Column) -> Column:
    """Whether ORDER is followed by a BY outside parentheses."""
    start = F.struct(F.lit("").alias("before"), F.lit(False).alias("found"))
    return F.aggregate(
        code_words(sql), start,
        lambda s, w: F.struct(w["word"].alias("before"), (s["found"] | ((s["before"] == "ORDER") & (w["word"] == "BY") & (w["depth"] == 0))).alias("found")),
    )["found"]


_FENCE = r"```[ \t]*(?:sqlite|sql|)[ \t]*\r?\n?"


def _tidy(sql: Column) -> Column:
    return strip(F.regexp_replace(strip(sql), r";+\z", ""))


def _last_filled(found: Column) -> Column:
    return F.try_element_at(F.filter(found, lambda x: strip(x) != ""), F.lit(-1))


def extract_sql(text: Column) -> Column:
    """The final query in a model's completion, or "".

    What precedes the last </think> is dropped. Then the last filled closed fence counts, else an open fence,
    else the last filled <sql> or <answer> element, else what follows the last line that starts with SELECT
    or WITH.
    """
    body = F.regexp_replace(_text(text), r"(?is)\A.*</think>", "")
    closed = _last_filled(F.regexp_extract_all(body, F.lit(rf"(?is){_FENCE}(.*?)```"), F.lit(1)))
    opened = F.regexp_extract(body, rf"(?is){_FENCE}(.*)\z", 1)
    tagged = _last_filled(F.regexp_extract_all(body, F.lit(r"(?is)<(sql|answer)>(.*?)</\1>"), F.lit(2)))
    bare = F.regexp_extract(body, r"(?ismd)\A.*(^[ \t]*(?:SELECT|WITH)\b.*)\z", 1)
    found = F.coalesce(closed, F.when(strip(opened) != "", opened), tagged, bare, F.lit(""))
    return _tidy(found)


def validate_read_only(sql: Column) -> Column:
    """struct<ok, statement, reason>: whether the text is exactly one read-only statement."""
    bad = lambda w: w["word"].isin(*FORBIDDEN_WORDS) & ~(w["word"].isin(*FUNCTION_FORMS) & (w["next"] == "("))

    # The text, its statements and their words are each made once: the verdict looks at them many times.
    def of_statements(text: Column, statements: Column) -> Column:
        first = F.coalesce(F.try_element_at(statements, F.lit(1)), F.lit(""))
        return _let(code_words(first), lambda words: _let(
            F.struct(F.coalesce(F.try_element_at(words, F.lit(1))["word"], F.lit("")).alias("keyword"), F.try_element_at(F.filter(words, bad), F.lit(1))["word"].alias("bad")),
            lambda told: verdict(text, statements, first, told["keyword"], told["bad"]),
        ))

    def verdict(text: Column, statements: Column, first: Column, keyword: Column, first_bad: Column) -> Column:
        reason = (
            F.when(text == "", "empty query")
            .when(F.size(statements) == 0, "no executable statement")
            .when(F.size(statements) > 1, F.concat(F.lit("expected 1 statement, found "), F.size(statements).cast("string")))
            .when(~keyword.isin(*READ_ONLY_LEADING), F.concat(F.lit("statement starts with "), F.when(keyword == "", "<none>").otherwise(keyword)))
            .when(first_bad.isNotNull(), F.concat(F.lit("forbidden keyword "), first_bad))
        )
        known = (text != "") & (F.size(statements) == 1)
        return F.struct(reason.isNull().alias("ok"), F.when(known, first).otherwise("").alias("statement"), reason.alias("reason"))

    return _let(strip(_text(sql)), lambda text: _let(split_statements(text), lambda statements: of_statements(text, statements)))


def format_target(gold_sql: Column) -> Column:
    """The fenced block of an answer: ends and closing semicolons stripped, all white space as single spaces."""
    bare = F.regexp_replace(strip(_text(gold_sql)), r";+\z", "")
    return F.concat(F.lit("```sql\n"), strip(F.regexp_replace(bare, rf"(?U){_WS}+", " ")), F.lit("\n```"))


def quote_identifier(name: Column, quote: str = '"') -> Column:
    """The name in quotes, quotes inside doubled; pass a backtick for Spark's own."""
    return F.concat(F.lit(quote), F.replace(name, F.lit(quote), F.lit(quote * 2)), F.lit(quote))


def without_values(sql: Column) -> Column:
    """Folded text without strings and comments, quotes of identifiers stripped, spans apart by spaces: where table names are looked for."""
    def one(t: Column) -> Column:
        return F.when(_kind(t).isin("string", "comment"), F.lit(" ")).otherwise(F.regexp_replace(t, r'\A["`\[\]]+|["`\[\]]+\z', ""))

    return F.lower(F.array_join(F.transform(spans(sql), one), " "))
