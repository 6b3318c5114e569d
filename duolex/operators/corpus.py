"""From parsed lines to quotes: remapping, pairing, validation, duplicates, weights."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut, partitions


def remap_speakers(lines: DataFrame, names: DataFrame) -> DataFrame:
    """lines (language, speaker, ...) with names (language, name, new_name) applied; unmapped names stay."""
    m = names.select("language", F.col("name").alias("speaker"), "new_name")
    return lines.join(m, ["language", "speaker"], "left").withColumn("speaker", F.coalesce("new_name", "speaker")).drop("new_name").select(*lines.columns)


def reason(en: Column, ja: Column, least: int = 2, most: int = 100, words: Column | None = None) -> Column:
    """Why a pair isn't usable, the first reason that holds; null if none does."""
    n = T.word_count(en) if words is None else words
    return (
        F.when(en.isNull(), "no english")
        .when(ja.isNull(), "no japanese")
        .when(T.trim_unicode(en) == "", "blank english")
        .when(T.trim_unicode(ja) == "", "blank japanese")
        .when(~T.has_kanji_or_hiragana(ja), "not japanese")
        .when(n < least, "too few words")
        .when(n > most, "too many words")
    )


def dialogue_reason(en: Column, ja: Column, voices_en: Column, voices_ja: Column) -> Column:
    """The same for voiced dialogue: stage directions in parentheses, a single word, or no voice in both archives."""
    return (
        F.when(T.blank_to_null(F.coalesce(en, F.lit(""))).isNull() | T.blank_to_null(F.coalesce(ja, F.lit(""))).isNull(), "blank")
        .when(en.rlike(r"^\s*[(（].*[)）]\s*$") | ja.rlike(r"^\s*[(（].*[)）]\s*$"), "in parentheses")
        .when(~T.has_kanji_or_hiragana(ja), "not japanese")
        .when(T.word_count(en) == 1, "one word")
        .when(~F.arrays_overlap(voices_en, voices_ja), "no voice")
    )


def pair(lines: DataFrame, keep: tuple[str, ...] = ("text", "speaker", "context", "notes", "audio_path", "weight")) -> DataFrame:
    """Lines (key, language en/ja, file_ordinal, line_ordinal, ...) to one row a key: structs en and ja of the first line of each language.

    n_en and n_ja say how many there were; one_sided_speaker marks a key with a speaker in one language only.
    """
    order = F.struct("file_ordinal", "line_ordinal")
    row = F.struct(*keep)
    first = lambda lang: F.min_by(F.when(F.col("language") == lang, row), F.when(F.col("language") == lang, order))
    out = lines.groupBy("key").agg(first("en").alias("en"), first("ja").alias("ja"), F.count_if(F.col("language") == "en").alias("n_en"), F.count_if(F.col("language") == "ja").alias("n_ja"), F.count_if(~F.col("language").isin("en", "ja")).alias("n_other"), F.min(order).alias("ord"))
    return out.withColumn("one_sided_speaker", (F.coalesce("en.speaker", F.lit("")) == "") != (F.coalesce("ja.speaker", F.lit("")) == ""))


def checked(pairs: DataFrame, fail_on_duplicates: bool = True) -> DataFrame:
    """pairs, failing on lines of another language, on one-sided speakers and, if asked, on repeated keys within a language."""
    bad = (
        F.when(F.col("n_other") > 0, "a line has neither language")
        .when(F.col("en").isNotNull() & F.col("ja").isNotNull() & F.col("one_sided_speaker"), "a speaker in one language only")
        .when(F.lit(fail_on_duplicates) & ((F.col("n_en") > 1) | (F.col("n_ja") > 1)), "a key twice in a language")
    )
    return pairs.withColumn("_ok", F.assert_true(bad.isNull(), bad)).filter(F.col("_ok").isNull()).drop("_ok")


def validated(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("reason", reason(F.col("en.text"), F.col("ja.text")))


def numbered(pairs: DataFrame, order: str = "ord") -> DataFrame:
    """A running index from 0 in input order, over rows that are valid; counts by range are summed, so no task sees all rows."""
    return running_index(pairs, order)


def running_index(df: DataFrame, order: str, name: str = "index", buckets: int | None = None) -> DataFrame:
    """df with its place, from 0, in the order of a column: rows are range-partitioned, numbered inside, and offset by the rows before.

    The partition of a row is found by range partitioning; only a count for each partition goes through one task. The dealt
    rows are kept once, as a second sampling of the ranges could deal them otherwise.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("_m", F.monotonically_increasing_id()))
    part, at = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    placed = placed.withColumn("_p", part)
    counts = placed.groupBy("_p").count()
    before = counts.withColumn("_b", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    return placed.join(F.broadcast(before), "_p").withColumn(name, F.col("_b") + at).drop("_p", "_m", "_b")


def deduplicated(pairs: DataFrame, en: str = "en_text", ja: str = "ja_text", speaker: str = "speaker", weight: str = "weight", order: str = "ord") -> DataFrame:
    """One row for each pair of texts: one with a speaker before one without, then the heaviest, then the first.

    The winner is found by a partial aggregate, so a text pair that very many rows share isn't gathered in a task.
    """
    rank = F.struct((F.coalesce(speaker, F.lit("")) == "").alias("a"), (-F.col(weight)).alias("b"), F.col(order).alias("c"))
    best = pairs.groupBy(en, ja).agg(F.min_by(F.struct(*pairs.columns), rank).alias("row"))
    return best.select("row.*")


def formatted(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"en_text": T.format_english(F.col("en.text")), "ja_text": T.format_japanese(F.col("ja.text"))})


def weights(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, weight): N / (n * groups), the inverse of a group's share scaled so that equal groups weigh 1."""
    n = rows.groupBy(by).count().withColumnRenamed("count", "n")
    whole = Window.partitionBy()  # a row for each group, not for each row
    return n.withColumn("weight", F.sum("n").over(whole) / (F.col("n") * F.count("*").over(whole)))


def with_weights(rows: DataFrame, by: str) -> DataFrame:
    """rows with the weight of their group; rows without a group are one group."""
    w = weights(rows, by).select(F.col(by).alias("_g"), "weight")
    return rows.join(w, rows[by].eqNullSafe(w["_g"])).drop("_g")


def script_runs(text: Column) -> Column:
    """Number of runs of one script: the count of Japanese words where no trained model is at hand."""
    return F.regexp_count(text, F.lit(r"[一-龠]+|[ぁ-ゔ]+|[ァ-ヴー]+|[\p{L}\p{N}]+"))


def quotes(pairs: DataFrame, source: str, id_: Column, japanese_words: Callable[[Column], Column] = script_runs) -> DataFrame:
    """The fact table from numbered, formatted pairs with alignment_data. japanese_words counts the words of a Japanese text."""
    side = lambda s, text, words: F.struct(F.coalesce(f"{s}.speaker", F.lit("")).alias("speaker_name"), F.coalesce(f"{s}.context", F.lit("")).alias("context"), F.col(text).alias("text"), words.cast("int").alias("word_count"), F.coalesce(f"{s}.notes", F.lit("")).alias("notes"), F.col(f"{s}.audio_path").alias("audio_file"))
    return pairs.select(
        id_.alias("id"),
        F.lit(source).alias("source"),
        side("en", "en_text", T.word_count(F.col("en_text"))).alias("english"),
        side("ja", "ja_text", japanese_words(F.col("ja_text"))).alias("japanese"),
        "alignment_data",
        F.current_timestamp().alias("date_imported"),
    )


def import_corpus(lines: DataFrame, source: str, source_id: int, align=None, japanese_words=None) -> DataFrame:  # noqa: ANN001
    """The whole import, lazy but for the numbering, which keeps its rows once: distinct, pair, check, validate, number, format, deduplicate, align, build.

    align adds alignment_data; japanese_words(pairs) gives a counter of Japanese words, such as one trained on the import's texts.
    """
    from ..functions.ids import pack_index
    from ..functions.spans import ALIGNMENTS

    good = validated(checked(pair(lines.distinct()))).filter("reason is null").drop("reason")
    flat = formatted(numbered(good)).withColumns({"speaker": F.col("en.speaker"), "weight": F.coalesce("en.weight", F.lit(0))})
    one = deduplicated(flat)
    aligned = align(one) if align else one.withColumn("alignment_data", F.array().cast(ALIGNMENTS))
    return quotes(aligned, source, pack_index(F.lit(source_id), F.col("index")), japanese_words(one) if japanese_words else script_runs)


def _depth(weighted: DataFrame, weight: str, target: float) -> float | None:
    """The smallest s, to a twentieth, for which `target` rows may be expected to have a random key over exp(-s); null if none is.

    A key is over exp(-s) with the likelihood 1 - exp(-s * weight), which is summed over the distinct weights of (weight, n).
    """

    def least(grid: list[float]) -> float | None:
        tried = weighted.select(weight, "n", F.explode(F.array(*map(F.lit, grid))).alias("s"))
        sums = tried.groupBy("s").agg(F.sum(-F.expm1(-F.col("s") * F.col(weight)) * F.col("n")).alias("f"))
        return min((r.s for r in sums.filter(F.col("f") >= target).collect()), default=None)

    rough = least([2.0**j for j in range(-60, 10)])
    return rough and least([rough * 2 ** (-i / 16) for i in range(16)])


def ranking_experiment(rows: DataFrame, seeds: int, cuts: tuple[int, ...], id_: str = "id", by: str = "source", weight: str = "weight") -> DataFrame:
    """(by, cut, hits): how often rows of each group are among the first `cut` of a weighted random ranking, over all seeds together.

    Seeds are the numbers from 0 on. All rankings are made in one pass. Every row is hashed for every seed, but only keys over a
    bar, which the weights give so that somewhat more than max(cuts) rows of a seed are expected to pass it, are moved and sorted:
    that number doesn't grow with the rows. A seed is counted if max(cuts) of its keys are over the bar, as then no other row can
    be among them; the others are made again with a lower bar, and at last without one. Groups that never come have no row.
    """
    from ..plans.search import random_key

    base, most = cut(rows.select(id_, by, weight)), max(cuts)
    n, positive = base.count(), (F.col(weight) > 0) & ~F.isnan(weight)
    base = base.repartition(partitions(base, 5_000, n))
    weighted = cut(base.filter(positive).groupBy(weight).agg(F.count("*").alias("n")))
    left, target, parts = list(range(seeds)), most + 10 * most**0.5 + 50, []
    while left:
        s = _depth(weighted, weight, target) if target < n else None
        # MD5's first 13 digits are the uniform number: they are compared as text before a key is made, 16 places below the bar.
        digits = F.lpad(F.lower(F.hex(F.greatest(F.floor(F.exp(F.col(weight) * -s) * float(1 << 52)) - 16, F.lit(0)))), 13, "0") if s else F.lit("")
        dealt = base.withColumns({"_tail": F.coalesce(F.concat(F.lit("|"), F.col(id_).cast("string")), F.lit("")), "_least": F.when(positive, digits).otherwise("")})
        keyed = dealt.withColumn("seed", F.explode(F.array(*map(F.lit, left)) if len(left) < seeds else F.sequence(F.lit(0), F.lit(seeds - 1))))
        over = keyed.filter(F.md5(F.concat(F.col("seed").cast("string"), "_tail").cast("binary")) >= F.col("_least")) if s else keyed
        over = over.select("seed", id_, by, random_key(F.col("seed").cast("string"), F.col(id_), F.col(weight)).alias("_key"))
        top = over.withColumn("_r", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("_key"), id_))).filter(F.col("_r") <= most)
        sure = F.count_if(F.col("_key") > math.exp(-s) * (1 + 1e-9)) if s else F.lit(most)
        counted = cut(top.groupBy("seed", by).agg(sure.alias("_sure"), *[F.count_if(F.col("_r") <= c).alias(str(c)) for c in cuts]))
        full = {r.seed for r in counted.groupBy("seed").agg(F.sum("_sure").alias("_sure")).filter(F.col("_sure") >= most).collect()} if s else set(left)
        parts.append(counted.filter(F.col("seed").isin(sorted(full))) if len(full) < len(left) else counted)
        left, target = [x for x in left if x not in full], 4 * target
    whole = reduce(DataFrame.unionByName, parts).groupBy(by).agg(*[F.sum(str(c)).alias(str(c)) for c in cuts])
    return whole.unpivot(by, [str(c) for c in cuts], "cut", "hits").select(by, F.col("cut").cast("int").alias("cut"), "hits").filter("hits > 0")
