"""Schema linking: lexical table scores, ranks, foreign-key neighbours and reachability, budgeted rendering.

Questions meet the tables they share something with, not all tables of their database: words through an inverted
index of the schema's words, phrases through an automaton of a database's phrases. Connection by foreign keys is
asked of bit sets. Where a database is needed as a whole, its questions are dealt in parts of at most PART.

Schemas are metadata frames: tables(db_id, table, ddl), columns(db_id, table, pos, name, type, notnull, pk,
description, value_description), fks(db_id, table, from_column, to_table, to_column).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querent.functions.sqltext import without_values

#: Words that don't link.
STOP_WORDS = (
    "a", "all", "an", "and", "are", "as", "at", "be", "by", "do", "does", "each", "every", "for", "from", "give", "how", "in", "is", "it", "list",
    "many", "of", "on", "or", "show", "that", "the", "their", "there", "to", "what", "when", "where", "which", "who", "with", "id",
)
MODES = ("full", "linked", "oracle")
#: Questions of a database that a task takes at once.
PART = 20_000


def fold(text: Column) -> Column:
    """Case folded: lower case, and sharp s as two."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def name_tokens(text: Column) -> Column:
    """array<string>: words of a name; camel case and underscores part them."""
    apart = F.replace(F.regexp_replace(text, r"(?<=[a-z0-9])(?=[A-Z])", " "), F.lit("_"), F.lit(" "))
    return F.regexp_extract_all(fold(apart), F.lit("([a-z0-9]+)"), F.lit(1))


def name_words(text: Column) -> Column:
    """Distinct words without stop words."""
    return F.array_except(name_tokens(text), F.array(*map(F.lit, STOP_WORDS)))


def phrase(text: Column) -> Column:
    return F.array_join(name_tokens(text), " ")


def _by_database(asked: DataFrame, schema: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], shape: str) -> DataFrame:
    """run(questions of a database, at most about PART; its whole schema) for all; databases with many questions are divided by question."""
    sizes = asked.groupBy("db_id").agg(F.ceil(F.count("*") / PART).cast("int").alias("_parts"))
    dealt = asked.join(sizes, "db_id").withColumn("_part", F.pmod(F.xxhash64(F.col("question_id").cast("string")), F.col("_parts")).cast("int"))
    copied = schema.join(sizes, "db_id").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    # Names anew on one side: both may come from one frame, whose columns a cogroup couldn't tell apart.
    right = copied.select(*[F.col(c).alias(c) for c in copied.columns if c != "_parts"]).groupBy("db_id", "_part")
    left = dealt.drop("_parts").groupBy("db_id", "_part")
    return left.cogroup(right).applyInPandas(lambda q, s: run(q, s), shape)


def schema_index(tables: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): (db_id, word or phrase, table, weight): what a table scores for a question that has the word or holds the phrase."""
    named = tables.select("db_id", "table", F.col("table").alias("name"), F.lit(4).alias("word_weight"), F.lit(12).alias("phrase_weight"))
    named = named.unionByName(columns.join(tables.select("db_id", "table"), ["db_id", "table"], "left_semi").select("db_id", "table", "name", F.lit(1).alias("word_weight"), F.lit(5).alias("phrase_weight")))
    words = named.select("db_id", "table", F.explode(name_words(F.col("name"))).alias("word"), "word_weight").groupBy("db_id", "word", "table").agg(F.sum("word_weight").alias("weight"))
    phrases = named.select("db_id", "table", phrase(F.col("name")).alias("phrase"), "phrase_weight").where("phrase <> ''").groupBy("db_id", "phrase", "table").agg(F.sum("phrase_weight").alias("weight"))
    return words, phrases


def _held(asked: pd.DataFrame, phrases: pd.DataFrame) -> pd.DataFrame:
    """(question_id, db_id, phrase): the phrases that each question's text holds anywhere."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for p in phrases["phrase"]:
        automaton.add_word(p, p)
    rows = []
    if len(automaton):
        automaton.make_automaton()
        for question, db_id, text in zip(asked["question_id"], asked["db_id"], asked["q_phrase"], strict=True):
            rows += [(question, db_id, p) for p in {p for _, p in automaton.iter(text)}]
    return pd.DataFrame(rows, columns=["question_id", "db_id", "phrase"])


def positive_scores(questions: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """(question_id, db_id, table, score) of the tables that score above 0: 12 for the table's phrase in the question, 4 a shared word, 5 and 1 for columns."""
    words, phrases = schema_index(tables, columns)
    text = fold(F.concat_ws(" ", F.coalesce("question", F.lit("")), F.coalesce("evidence", F.lit(""))))
    asked = questions.select("question_id", "db_id", phrase(text).alias("q_phrase"), name_words(text).alias("q_words"))
    by_word = asked.select("question_id", "db_id", F.explode("q_words").alias("word")).join(words, ["db_id", "word"]).select("question_id", "db_id", "table", "weight")
    kind = asked.schema["question_id"].dataType.simpleString()
    held = _by_database(asked.select("question_id", "db_id", "q_phrase"), phrases.select("db_id", "phrase").distinct(), _held, f"question_id {kind}, db_id string, phrase string")
    by_phrase = held.join(phrases, ["db_id", "phrase"]).select("question_id", "db_id", "table", "weight")
    return by_word.union(by_phrase).groupBy("question_id", "db_id", "table").agg(F.sum("weight").cast("int").alias("score"))


def table_scores(questions: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """(question_id, db_id, table, score) of every table of a question's database; positive_scores leaves those without a score out."""
    every = questions.select("question_id", "db_id").join(tables.select("db_id", "table"), "db_id")
    found = positive_scores(questions, tables, columns)
    return every.join(found, ["question_id", "db_id", "table"], "left").select("question_id", "db_id", "table", F.coalesce("score", F.lit(0)).alias("score"))


def ranked(scores: DataFrame) -> DataFrame:
    """scores with rank from 0: higher scores first, then folded names."""
    order = Window.partitionBy("question_id", "db_id").orderBy(F.desc("score"), fold(F.col("table")))
    return scores.withColumn("rank", F.row_number().over(order) - 1)


def fk_edges(tables: DataFrame, fks: DataFrame) -> DataFrame:
    """(db_id, table, neighbour): foreign keys in both directions between known tables, names matched without case."""
    known = tables.select("db_id", F.col("table").alias("known"), fold(F.col("table")).alias("folded"))
    resolved = fks.withColumn("folded", fold(F.col("to_table"))).join(known, ["db_id", "folded"]).select("db_id", "table", F.col("known").alias("neighbour"))
    return resolved.union(resolved.select("db_id", F.col("neighbour").alias("table"), F.col("table").alias("neighbour"))).distinct()


def linked_tables(questions: DataFrame, tables: DataFrame, columns: DataFrame, fks: DataFrame, min_tables: int = 3) -> DataFrame:
    """(question_id, db_id, table, rank): tables that score, or else the first few, their neighbours, padded to min_tables.

    rank is a table's place from 0 among all tables of its database, by score, then folded name. Tables without a
    score come in by name, so only the chosen ones and the first names of a database are looked at: a table's rank
    follows from its name's place and from how many scoring tables have an earlier one.
    """
    name_order = Window.partitionBy("db_id").orderBy(fold(F.col("table")), "table")
    placed = tables.select("db_id", "table", (F.row_number().over(name_order) - 1).alias("place"), F.count("*").over(Window.partitionBy("db_id")).alias("total"))
    asked = questions.select("question_id", "db_id")
    scoring = positive_scores(questions, tables, columns)
    none = asked.join(scoring.select("question_id", "db_id").distinct(), ["question_id", "db_id"], "left_anti")
    first = none.join(placed.where(F.col("place") < min_tables), "db_id").select("question_id", "db_id", "table")
    direct = scoring.select("question_id", "db_id", "table").union(first)
    near = direct.join(fk_edges(tables, fks), ["db_id", "table"]).select("question_id", "db_id", F.col("neighbour").alias("table"))
    chosen = direct.union(near).distinct().withColumn("chosen", F.lit(True))
    # Fewer than min_tables are chosen where places are left, so as many names more hold all that can fill them.
    spare = asked.join(placed.where(F.col("place") < 2 * min_tables).select("db_id", "table"), "db_id").select("question_id", "db_id", "table").withColumn("chosen", F.lit(False))
    keys = ["question_id", "db_id", "table"]
    looked = chosen.union(spare).groupBy(*keys).agg(F.max("chosen").alias("chosen")).join(scoring, keys, "left").join(placed, ["db_id", "table"])
    whole = Window.partitionBy("question_id", "db_id")
    scored = F.col("score").isNotNull().cast("int")
    earlier = F.coalesce(F.sum(scored).over(whole.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_score = F.row_number().over(whole.orderBy(F.desc_nulls_last("score"), "place")) - 1
    rank = F.when(F.col("score").isNotNull(), by_score).otherwise(F.sum(scored).over(whole) + F.col("place") - earlier)
    missing = F.greatest(F.least(F.lit(min_tables), F.col("total")) - F.sum(F.col("chosen").cast("int")).over(whole), F.lit(0))
    told = looked.withColumn("rank", rank).withColumn("missing", missing)
    turn = F.row_number().over(Window.partitionBy("question_id", "db_id", "chosen").orderBy("rank"))
    return told.withColumn("turn", turn).where("chosen or turn <= missing").select("question_id", "db_id", "table", F.col("rank").cast("int").alias("rank"))


def oracle_tables(examples: DataFrame, tables: DataFrame) -> DataFrame:
    """(question_id, db_id, table): tables whose names stand in the gold query outside strings and comments."""
    cleaned = examples.select("question_id", "db_id", without_values(F.col("gold_sql")).alias("sql"))
    named = tables.select("db_id", "table", fold(F.col("table")).alias("word"))
    # A name of word characters stands where a run of these equals it: the query's words are looked up. Others are searched for.
    plain = F.col("word").rlike(r"\A[a-z0-9_$]+\z")
    words = cleaned.select("question_id", "db_id", F.explode_outer(F.array_distinct(F.regexp_extract_all("sql", F.lit("([a-z0-9_$]+)"), F.lit(1)))).alias("word"))
    found = words.join(named.where(plain), ["db_id", "word"]).select("question_id", "db_id", "table")
    pattern = F.concat(F.lit(r"(?<![a-z0-9_$])\Q"), F.replace("word", F.lit(r"\E"), F.lit("")), F.lit(r"\E(?![a-z0-9_$])"))
    odd = cleaned.join(named.where(~plain), "db_id").where(F.regexp("sql", pattern)).select("question_id", "db_id", "table")
    return found.union(odd)


def _connected(asked: pd.DataFrame, schema: pd.DataFrame) -> pd.DataFrame:
    """(question_id, connected): bit sets over a database's tables, a bit a table.

    The transitive closure of all keys is made once; where a question retains only some tables, the set reached
    grows within their mask.
    """
    links: dict[str, set] = {}
    for t, u in zip(schema["t"], schema["u"], strict=True):
        links.setdefault(t, set())
        if u is not None:
            links[t].add(u)
            links.setdefault(u, set()).add(t)
    place = {t: i for i, t in enumerate(sorted(links))}
    near = [sum(1 << place[u] for u in links[t]) for t in sorted(links)]

    def grown(start: int, within: int) -> int:
        reached = fresh = start & within
        while fresh:
            step = 0
            while fresh:
                low = fresh & -fresh
                step |= near[low.bit_length() - 1]
                fresh ^= low
            fresh = step & within & ~reached
            reached |= fresh
        return reached

    whole, closure = (1 << len(place)) - 1, [0] * len(place)
    for i in range(len(place)):
        if not closure[i]:
            own = rest = grown(1 << i, whole)
            while rest:
                low = rest & -rest
                closure[low.bit_length() - 1] = own
                rest ^= low
    out = []
    for question, need, retained in zip(asked["question_id"], asked["need"], asked["retained"], strict=True):
        known = all(t in place for t in need)
        fine = known
        if known and len(need) > 1:
            mask = sum(1 << place[t] for t in need)
            if retained is None:
                reached = closure[place[need[0]]]
            else:
                reached = grown(1 << place[need[0]], sum(1 << place[t] for t in set(retained) if t in place))
            fine = mask & ~reached == 0
        out.append((question, fine))
    return pd.DataFrame(out, columns=["question_id", "connected"])


def fk_connected(required: DataFrame, tables: DataFrame, fks: DataFrame, retained: DataFrame | None = None) -> DataFrame:
    """(question_id, connected): whether foreign keys join all required tables over retained ones.

    required and retained: question_id, db_id, table. Unknown or dropped required tables make it false, one
    table or none true. A question's required and retained tables are gathered in its row.
    """
    gather = lambda df, name: df.groupBy("question_id", "db_id").agg(F.sort_array(F.collect_set(fold(F.col("table")))).alias(name))
    asked = gather(required, "need")
    if retained is None:
        asked = asked.withColumn("retained", F.lit(None).cast("array<string>"))
    else:
        asked = asked.join(gather(retained, "retained"), ["question_id", "db_id"], "left").withColumn("retained", F.coalesce("retained", F.array().cast("array<string>")))
    # A row a table, so that tables without keys are known, and a row a key.
    known = tables.select("db_id", fold(F.col("table")).alias("t"))
    edges = fk_edges(tables, fks).select("db_id", fold(F.col("table")).alias("t"), fold(F.col("neighbour")).alias("u"))
    schema = known.select("db_id", "t", F.lit(None).cast("string").alias("u")).union(edges)
    kind = asked.schema["question_id"].dataType.simpleString()
    told = _by_database(asked, schema, _connected, f"question_id {kind}, connected boolean")
    return told.groupBy("question_id").agg(F.min("connected").alias("connected"))


def coverage(required: DataFrame, selected: DataFrame, tables: DataFrame, fks: DataFrame) -> DataFrame:
    """Per question: recall, missing and distracting tables, and whether foreign-key connection was retained (null where it can't be checked)."""
    need = required.groupBy("question_id").agg(F.collect_set(fold(F.col("table"))).alias("need"))
    have = selected.groupBy("question_id").agg(F.collect_set(fold(F.col("table"))).alias("have"))
    full = fk_connected(required, tables, fks).withColumnRenamed("connected", "whole")
    kept = fk_connected(required, tables, fks, selected).withColumnRenamed("connected", "kept")
    joined = need.join(have, "question_id", "left").join(full, "question_id").join(kept, "question_id")
    have_ = F.coalesce("have", F.array().cast("array<string>"))
    hit = F.size(F.array_intersect("need", have_))
    return joined.select(
        "question_id", (hit / F.size("need")).alias("recall"), F.sort_array(F.array_except("need", have_)).alias("missing"),
        F.size(F.array_except(have_, F.col("need"))).alias("n_distractors"), F.when((F.size("need") >= 2) & F.col("whole"), F.col("kept")).alias("fk_retained"),
    )


def within_budget(blocks: DataFrame, most: int, keys: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """Whole blocks kept in rank order while the text, blocks joined by blank lines, fits; later smaller ones may still fit, the first always stays.

    blocks: keys, rank, name, block. Gives keys, names, text, chars, exceeded; most 0 is no budget.

    The text only grows, so once a block is left out, so are all later ones of its length: of each length
    the first few in rank order are all that can stay. With a budget no more than these are gathered, some
    most * ln(most) short blocks a group, and the group's first block if it is longer than the budget.
    """
    own = F.struct("rank", "name", "block")
    if most > 0:
        size = F.length("block")
        fitting = blocks.where(size <= most).withColumn("_size", size)
        place = F.row_number().over(Window.partitionBy(*keys, "_size").orderBy("rank", "name", "block"))
        fitting = fitting.withColumn("_place", place).where((F.col("_size") + 2) * F.col("_place") <= most + 2)
        whole = blocks.groupBy(*keys).agg(F.min(own).alias("own"), F.count("*").alias("n"))
        oversize = F.coalesce(F.length("own.block") > most, F.lit(True))
        blocks = fitting.select(*keys, own.alias("own"), F.lit(0).cast("long").alias("n")).union(whole.select(*keys, F.when(oversize, F.col("own")).alias("own"), "n"))
    else:
        blocks = blocks.select(*keys, own.alias("own"), F.lit(1).cast("long").alias("n"))
    lists = blocks.groupBy(*keys).agg(F.sort_array(F.collect_list("own")).alias("blocks"), F.sum("n").alias("n"))
    start = F.struct(
        F.expr("cast(array() as array<string>)").alias("names"), F.expr("cast(array() as array<string>)").alias("kept"), F.lit(0).alias("chars")
    )

    def step(s: Column, b: Column) -> Column:
        longer = s["chars"] + F.when(F.size(s["kept"]) > 0, 2).otherwise(0) + F.length(b["block"])
        fits = (F.size(s["kept"]) == 0) | F.lit(most <= 0) | (longer <= most)
        taken = F.struct(F.concat(s["names"], F.array(b["name"])).alias("names"), F.concat(s["kept"], F.array(b["block"])).alias("kept"), longer.alias("chars"))
        return F.when(fits, taken).otherwise(s)

    folded = lists.withColumn("f", F.aggregate("blocks", start, step))
    exceeded = (F.size("f.names") < F.col("n")) | (F.lit(most > 0) & (F.col("f.chars") > most))
    return folded.select(*keys, F.col("f.names").alias("names"), F.array_join("f.kept", "\n\n").alias("text"), F.col("f.chars").alias("chars"), exceeded.alias("exceeded"))


def select_schema(examples: DataFrame, tables: DataFrame, columns: DataFrame, fks: DataFrame, mode: str = "full", min_tables: int = 3) -> DataFrame:
    """(question_id, db_id, table, rank) of the tables that a prompt shows: all, those linked to the question, or those of its gold query.

    Ranks of all tables and of the gold query's follow the catalog's order of names. examples: question_id,
    db_id, question, evidence, gold_sql. The oracle mode raises for an example without a gold query, or whose
    query names no table; an unknown mode raises at once.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    if mode == "linked":
        return linked_tables(examples, tables, columns, fks, min_tables)
    names = tables.select("db_id", "table")
    rank = (F.row_number().over(Window.partitionBy("question_id", "db_id").orderBy("table")) - 1).alias("rank")
    if mode == "full":
        return examples.select("question_id", "db_id").join(names, "db_id").select("question_id", "db_id", "table", rank)
    found = oracle_tables(examples, tables).withColumn("_found", F.lit(True))
    every = examples.select("question_id", "db_id", "gold_sql").join(found, ["question_id", "db_id"], "left")
    shown = F.col("question_id").cast("string")
    why = F.when(F.coalesce("gold_sql", F.lit("")) == "", F.concat(F.lit("no gold SQL: question "), shown)).when(
        F.col("_found").isNull(), F.concat(F.lit("gold SQL names no known table: question "), shown)
    )
    checked = every.withColumn("table", F.when(why.isNotNull(), F.raise_error(why)).otherwise(F.col("table")))
    return checked.select("question_id", "db_id", "table", rank)


def schema_texts(selected: DataFrame, blocks: DataFrame, most: int = 0) -> DataFrame:
    """(question_id, names, schema_text, chars, exceeded): each question's table blocks (db_id, table, block) in rank order, whole ones within most characters."""
    own = selected.join(blocks, ["db_id", "table"]).select("question_id", "rank", F.col("table").alias("name"), "block")
    return within_budget(own, most).withColumnRenamed("text", "schema_text")


def render_selected(examples: DataFrame, tables: DataFrame, columns: DataFrame, fks: DataFrame, blocks: DataFrame, mode: str = "full", most: int = 0) -> DataFrame:
    """examples with schema_text, selected_tables, total_tables, chars and exceeded; the full mode shows all blocks and only tells whether they fit."""
    picked = select_schema(examples, tables, columns, fks, mode)
    texts = schema_texts(picked, blocks, 0 if mode == "full" else most)
    exceeded = F.col("exceeded") | (F.lit(most > 0) & (F.col("chars") > most))
    total = tables.groupBy("db_id").agg(F.count("*").alias("total_tables"))
    told = texts.select("question_id", "schema_text", F.col("names").alias("selected_tables"), "chars", exceeded.alias("exceeded"))
    return examples.join(told, "question_id").join(total, "db_id")
