"""Verdicts of the pipeline's stages hold for single rows, also where ids are null or shared."""

import random

import pytest

from duolex.llm import decontaminate, neardup, quality

from .helpers import plain

RND = random.Random(8)
word = lambda: f"q{RND.getrandbits(30)}"
LEAK = [word() for _ in range(30)]
CLEAN = [" ".join(word() for _ in range(60)) for _ in range(4)]


@pytest.mark.parametrize("key", [None, 5])
def test_leaks(spark, key):
    rows = [(key, " ".join(LEAK)), (key, CLEAN[0]), (7, CLEAN[1])]
    items = spark.createDataFrame([(1, " ".join(LEAK))], "item_id long, text string")
    assert sorted(r.text for r in decontaminate.clean(plain(spark, rows), items).collect()) == sorted(CLEAN[:2])


@pytest.mark.parametrize("key", [None, 5])
def test_rules(spark, key):
    rows = [(key, "too short"), (key, CLEAN[0]), (key, CLEAN[0]), (7, CLEAN[1])]
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert sorted(r.text for r in quality.keep_good(plain(spark, rows), none).collect()) == sorted([CLEAN[0], CLEAN[0], CLEAN[1]])


@pytest.mark.parametrize("key", [None, 5])
def test_near_copies(spark, key):
    near = lambda t: " ".join([*t.split()[:-1], "end"])
    rows = [(1, CLEAN[0]), (key, near(CLEAN[0])), (key, CLEAN[1]), (9, CLEAN[2]), (key, near(CLEAN[2]))]
    got = {(r.doc_id, r.text) for r in neardup.deduplicate(plain(spark, rows)).collect()}
    third = (9, CLEAN[2]) if key is None else (5, near(CLEAN[2]))
    assert got == {(1, CLEAN[0]), (key, CLEAN[1]), third}
