"""The index build: many texts are tokenized at once, and postings are stored by the block."""

import random

import numpy as np
from pyspark.sql import functions as F

from duolex.functions import analyzers
from duolex.plans.index import BLOCK, build_index


def sorted_tokens(of, code, spots, terms):
    words = terms.to_pylist()
    return sorted((int(i), int(s[0]), int(s[1]), int(s[2]), words[c]) for i, c, s in zip(of, code, spots, strict=True))


def test_many_texts_at_once():
    """All characters of words, joints at every place, texts that go one by one: tokens are those of each text alone."""
    r = random.Random(3)
    letters = [*"aZ9_'’.:, \n-", "é", "É", "ß", "é", "́", "ﬁ", "あ", "カ", "鏡", "ー", "٣", "ʼ", "ż", "𝒳", "😀", "desdiv3", "4thbatron", "İ", "x's"]
    texts = [None, "", "a", "'a", "a'", "a.b:c,1,2.3", "4thdesdiv3 CarDiv2", "_a", "́a", "a\n"] + ["".join(r.choices(letters, k=r.randrange(1, 30))) for _ in range(3000)]
    texts += ["".join(r.choices(letters[:12], k=300_000))]
    want = sorted_tokens(*analyzers.columns_of(texts, analyzers.default_tokens))
    assert sorted_tokens(*analyzers.default_columns(texts)) == want
    assert len(analyzers.default_columns([None, ""])[0]) == 0


def test_postings_are_stored_by_the_block(spark, tmp_path):
    """More documents of a term than a block takes, in fewer rows than postings; each with its own places."""
    path, n = str(tmp_path / "ix"), 3 * BLOCK + 5
    side = lambda t: F.struct(F.lit("").alias("speaker_name"), F.lit("").alias("context"), t.alias("text"), F.lit(0).alias("word_count"), F.lit("").alias("notes"), F.lit(None).cast("string").alias("audio_file"))
    text = F.concat(F.expr("repeat('Tama ', cast(id % 4 as int))"), F.lit("the w"), "id")
    q = spark.range(n).withColumn("english", side(text)).withColumn("japanese", side(F.lit(None).cast("string"))).withColumn("source", F.lit("s"))
    index = build_index(q, path=path, partitions=1)
    got = {(x.field, x.term, x.id): (x.tf, [tuple(p) for p in x.positions]) for x in index.postings.collect()}
    want = {}
    for field, analyzer in (("english.text", "default"), ("english.text.conjugations", "english_conjugations")):
        for i in range(n):
            for term, *spot in analyzers.ANALYZERS[analyzer]("Tama " * (i % 4) + f"the w{i}"):
                want.setdefault((field, term, i), []).append(tuple(spot))
    assert got == {k: (len(v), v) for k, v in want.items()}
    assert {(x.field, x.term, x.id): x.tf for x in index.counts.collect()} == {k: len(v) for k, v in want.items()}
    assert {(x.field, x.term): x.df for x in index.stats.collect()} == {(f, t): sum(k[:2] == (f, t) for k in want) for f, t, _ in want}
    assert {x.field: x.n for x in index.sizes.collect()} == {"english.text": n, "english.text.conjugations": n}
    stored = spark.read.parquet(f"{path}/postings").filter("field = 'english.text' and term is not null")
    assert stored.filter("term = 'the'").count() == 4 and stored.count() < len([k for k in want if k[0] == "english.text"])
    assert np.all([r.df <= BLOCK for r in stored.collect()])
