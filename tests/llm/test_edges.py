"""Every operator on messy rows and on empty tables: a defined result, and as many rows as promised."""

import pytest
from pyspark.sql import functions as F

from duolex.llm import bpe, ctw, decontaminate, licenses, neardup, pii, quality, sharding, simhash, token_counts, toxicity

from .helpers import TEXTS, messy

N = len(TEXTS)


def labels(spark, column):
    return spark.createDataFrame([(1, 1), (2, 0), (6, 1), (None, 1), (8, None)], f"doc_id long, {column} int")


def items(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs"), (2, None), (3, ""), (None, "nothing of this is there at all")], "item_id long, text string")


def run_all(spark, docs):
    path = bpe.vocabulary()
    return {
        "licenses": licenses.scan(docs),
        "ctw": ctw.score(docs, F.col("doc_id") % 7 != 2),
        "sharding": sharding.shard(docs),
        "pii": pii.pseudonymize(docs, "k", found="kinds"),
        "simhash": simhash.near_duplicates(docs),
        "quality": quality.judge(docs, labels(spark, "quality")),
        "bpe": bpe.encode(docs, path, decoded="decoded"),
        "counts": token_counts.counts(docs, bpe.vocabulary("byte_bpe_50k.json")),
        "toxicity": toxicity.score(docs, labels(spark, "toxic"), F.col("doc_id") % 5 != 0),
    }


def test_rows_in_rows_out(spark):
    for name, df in run_all(spark, messy(spark)).items():
        rows = df.collect()
        assert len(rows) == N, name
        assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in rows) == sorted((d is not None, d or 0) for d, _ in TEXTS), name


def test_empty_tables(spark):
    for name, df in run_all(spark, messy(spark).limit(0)).items():
        assert df.collect() == [], name
    assert decontaminate.links(messy(spark).limit(0), items(spark)).collect() == []
    assert decontaminate.links(messy(spark), items(spark).limit(0)).collect() == []
    assert neardup.deduplicate(messy(spark).limit(0)).collect() == []


def test_no_labels(spark):
    none = labels(spark, "quality").limit(0)
    assert {r.rule for r in quality.judge(messy(spark), none).collect()} == {0}
    scores = toxicity.score(messy(spark), labels(spark, "toxic").limit(0), F.lit(True)).collect()
    assert len(scores) == N and all(0 <= r.score <= 1 for r in scores)
    assert len(toxicity.score(messy(spark), labels(spark, "toxic"), F.lit(False)).collect()) == N


def test_columns_stay(spark):
    docs = messy(spark)
    for df in (neardup.deduplicate(docs), decontaminate.clean(docs, items(spark)), quality.keep_good(docs, labels(spark, "quality")), pii.pseudonymize(docs, "k")):
        assert df.columns == docs.columns
    kept = neardup.deduplicate(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == [1, 3, 6, 7, 8, 9, 10]  # 2 repeats 1; 4 and 5 have no words, like 3
    assert sum(r.doc_id is None for r in kept) == 1
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items(spark)).collect() if r.doc_id) == list(range(3, 11))
    assert {(r.doc_id, r.item_id) for r in decontaminate.links(docs, items(spark)).collect()} == {(1, 1), (2, 1)}


def test_pii_leaves_the_rest(spark):
    got = {r.doc_id: r for r in pii.pseudonymize(messy(spark), "k", found="kinds").collect() if r.doc_id}
    assert got[3].text is None and got[4].text == "" and got[9].text == TEXTS[11][1]
    assert sorted(got[8].kinds) == ["card", "email", "phone"] and "4111111111111111" not in got[8].text


@pytest.mark.parametrize("text", ["", "a"])
def test_single_row(spark, text):
    one = spark.createDataFrame([(5, text)], "doc_id long, text string")
    assert sharding.shard(one).first().slot == 0
    assert simhash.near_duplicates(one).first().component_id == 5
    assert ctw.score(one, F.lit(True)).first().n_tokens == (1 if not text else 2)
