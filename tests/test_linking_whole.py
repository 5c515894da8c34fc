"""Budgeted blocks over whole texts, against a plain loop."""

import os
import random

from querent.operators import linking
from querent.queries import QUERIES

FOLDER = os.path.join(os.environ.get("QUERENT_TESTDATA", "/root/testdata"), "sf0.001")


def plain(rows, most):
    groups, out = {}, {}
    for key, rank, name, block in rows:
        groups.setdefault(key, []).append((rank, name, block))
    for key, own in groups.items():
        names, kept, chars = [], [], 0
        for _, name, block in sorted(own):
            longer = chars + (2 if kept else 0) + len(block)
            if not kept or longer <= most:
                names, kept, chars = [*names, name], [*kept, block], longer
        out[key] = (names, "\n\n".join(kept), chars, len(kept) < len(own) or chars > most)
    return out


def test_budgeted_blocks_take_whole_texts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("text is not null").collect()
    want = plain([((r.source, r.lang), r.doc_id, str(r.doc_id), r.text) for r in docs], 2000)
    got = {(r.source, r.lang): (r.names, r.text, r.chars, r.exceeded) for r in QUERIES["budgeted_blocks"](spark, FOLDER).collect()}
    assert got == want


def test_budget_equals_a_plain_loop(spark):
    r = random.Random(3)
    rows = [(r.choice("abc") if r.random() < 0.9 else None, r.randint(0, 60), f"n{i}", "x" * r.choice([0, 1, 2, 3, 5, 8, 30, 60])) for i in range(400)]
    blocks = spark.createDataFrame(rows, "question_id string, rank int, name string, block string")
    for most in (1, 20, 50):
        got = {x.question_id: (x.names, x.text, x.chars, x.exceeded) for x in linking.within_budget(blocks, most).collect()}
        assert got == plain(rows, most)
