import os
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from duolex.llm import bpe, decontaminate, pii, quality

from .helpers import CLASHING, messy

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages(spark, tmp_path):
    """Each stage works on what the one before kept, in the columns of documents, and its decisions take effect."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for i, (_, stage) in enumerate(pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept.append((before, docs))
    names = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(d.columns == names for _, d in kept[:-1])
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    good = {r.doc_id for r in quality.op7_quality(spark, SF).collect() if r.kept}
    assert ids(kept[0][1]) == good
    texts = {r.doc_id: r.text for r in kept[0][1].collect()}
    stay = ids(kept[1][1])
    first = {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)
    assert stay <= set(first.values()) and len(stay) > 0.8 * len(first)
    leaks = {r.doc_id for r in decontaminate.links(kept[1][1], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert ids(kept[2][1]) == stay - leaks
    new = {r.doc_id: r.text for r in kept[3][1].collect()}
    assert {r.doc_id: r.text for r in pii.restore(kept[3][1], pii.session_key(spark)).collect()} == {r.doc_id: r.text for r in kept[2][1].collect()}
    own = bpe.WordBpe(bpe.vocabulary())
    for r in kept[4][1].collect():
        assert r.ids == own.encode([new[r.doc_id]])[0] and r.n_tokens == len(r.ids) and r.decoded == own.decode(r.ids)


def test_run(spark):
    assert pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("number", range(5))
def test_stage_on_messy_rows(spark, number):
    """Nulls, blanks, repeats, a long text, columns with clashing names: rows go or stay whole; an empty table stays empty."""
    _, stage = pipeline.STAGES[number]
    docs = messy(spark)
    got = stage(spark, docs, SF)
    last = number == 4
    assert set(got.columns) >= set(docs.columns) - {"ids", "decoded"} if last else got.columns == docs.columns
    rows, names = got.collect(), [c for c in docs.columns if c not in ("text", "n_chars", *(("ids", "decoded", "n_tokens") if last else ()))]
    before = Counter((r.doc_id, r.text) for r in docs.collect())
    assert all(r[c] == "z" for r in rows for c in names if c in CLASHING)
    if number in (0, 1, 2):
        assert not Counter((r.doc_id, r.text) for r in rows) - before
    else:
        assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in before.elements())
    left = sorted((r.doc_id is not None, r.doc_id or 0) for r in rows)
    if number == 0:
        assert {r.doc_id for r in rows} == {1, 2}  # enough words, few repeats
    if number == 1:
        assert left == [(False, 0), *[(True, i) for i in (1, 3, 6, 7, 8, 9, 10)]]
    if number == 2:
        assert len(rows) == len(list(before.elements()))
    assert stage(spark, docs.limit(0), SF).collect() == []
