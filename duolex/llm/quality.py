"""Quality rules: decision lists learned by sequential covering, in DataFrame expressions only.

Statistics of whole texts are computed in one projection (no join, no exchange): windows are hashed in the row, sorted with
their positions, and equal neighbours mark repeats, so a long text costs n log n. Labelled statistics are binned at their
quantiles. A rule that rejects is grown one threshold condition at a time, by the largest FOIL gain over counts that one
grouped aggregation gives for all statistics and thresholds; it is pruned to the prefix that does best on held-back rows;
rows that it covers are set aside, and the next rule is learned. The list is emitted as an ordered `CASE WHEN`. The driver sees
the counts by statistic and bin only, never rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, cut, few, fresh, row_tag, table

#: Statistics that conditions may test, as expressions over the columns of `statistics`.
TESTS = {
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "words": "n_words",
}
#: Thresholds for a statistic, conditions in a rule, rules in a list.
BINS, CONDITIONS, RULES = 24, 3, 8
#: A rule must be right on this share of what it covers among held-back rows, and cover this share of the rows to reject.
PRECISION, COVERAGE = 0.8, 0.01


def let(value: Column, use) -> Column:  # noqa: ANN001
    return F.transform(F.array(value), lambda v: use(v))[0]


def repeated_words(words: Column, window: int = 5) -> Column:
    """How many words lie in windows that occur twice or more, the first included.

    Windows are compared by 64-bit hashes; a text of a million words has a collision with a probability of about 3e-8.
    """
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(window))))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, i: F.coalesce(F.least(F.lit(window), F.get(at, i + 1) - x), F.lit(window)))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def again(s: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        marked = F.transform(s, lambda x, i: F.when((same(x, F.get(s, i + 1))) | (same(x, F.when(i > 0, F.get(s, i - 1)))), x["i"]))
        return let(F.array_sort(F.filter(marked, lambda x: x.isNotNull())), covered)

    def count(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.array_sort(pairs), again))

    return F.when(F.size(words) < window, F.lit(0)).otherwise(let(hashes, count)).cast("bigint")


def statistics(docs: DataFrame, *more: str) -> DataFrame:
    """docs (doc_id, text) to doc_id, the columns `more` and counts (bigint) of the whole text, a row for each row; null is the text without words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    gone = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("bigint")
    words = F.filter(F.split(text, SPACES + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"), F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"), repeated_words(w).alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))

    made = docs.select(
        "doc_id",
        *more,
        let(words, of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        gone(r"[#*$%&|<>]+").alias("n_symbols"),
        gone(r"\p{Lu}+").alias("n_upper"),
        gone(r"[0-9]+").alias("n_digits"),
        gone(r"[!?;:\"'()\[\]{}=_~^+/\\-]+").alias("n_marks"),
    )
    return made.select("doc_id", *more, "w.*", "l.*", "n_symbols", "n_upper", "n_digits", "n_marks")


def learn(stats: DataFrame, labels: DataFrame) -> list[list[tuple[str, str, float]]]:
    """The ordered rules that reject, each a list of (test, '>' or '<=', threshold), from stats and labels (doc_id, quality 0/1).

    Rows without a label or with another value teach nothing. No labels, or labels of one class, give the empty list.
    """
    known = labels.filter("quality in (0, 1)").select("doc_id", (F.col("quality") == 0).alias("bad")).distinct()
    rows = stats.join(known, "doc_id").select("bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("held"), *[F.expr(e).cast("double").alias(n) for n, e in TESTS.items()])
    rows = cut(rows)
    at = [i / (BINS + 1) for i in range(1, BINS + 1)]
    got = rows.agg(*[F.percentile_approx(n, [*at, 0.99, 0.995], 10000).alias(n) for n in TESTS], *[F.percentile_approx(F.when(F.col("bad"), F.col(n)), at[::3], 10000).alias(f"{n}_bad") for n in TESTS], F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).first()
    if not got["bad"] or not got["good"]:
        return []
    edges = {n: sorted({float(x) for x in [*(got[n] or []), *(got[f"{n}_bad"] or [])]}) for n in TESTS}
    least = COVERAGE * got["bad"]

    def holds(rule: list[tuple[str, str, float]]) -> Column:
        out = F.lit(True)
        for n, op, t in rule:
            out = out & ((F.col(n) > t) if op == ">" else (F.col(n) <= t))
        return out

    names = list(TESTS)
    bin_of = lambda n: F.size(F.filter(F.array(*map(F.lit, edges[n])), lambda t: F.col(n) > t))
    binned = cut(rows.withColumn("bins", F.array(*[bin_of(n) for n in names])))
    rules: list[list[tuple[str, str, float]]] = []
    while len(rules) < RULES:
        free = ~holds(rules[0]) if rules else F.lit(True)
        for r in rules[1:]:
            free = free & ~holds(r)
        rule: list[tuple[str, str, float]] = []
        now = binned.filter(free & ~F.col("held"))
        while len(rule) < CONDITIONS:
            counts = now.filter(holds(rule)).select("bad", F.posexplode("bins").alias("test", "bin")).groupBy("test", "bin").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
            total_p = sum(c["p"] for c in counts if c["test"] == 0)
            total_n = sum(c["n"] for c in counts if c["test"] == 0)
            if not total_p or not total_n:
                break
            before, best = math.log2(total_p / (total_p + total_n)), (0.0, None)
            for k, name in enumerate(names):
                own = {c["bin"]: (c["p"], c["n"]) for c in counts if c["test"] == k}
                p = n = 0
                for b, t in enumerate(edges[name]):  # bin b and below: value <= t
                    dp, dn = own.get(b, (0, 0))
                    p, n = p + dp, n + dn
                    for op, pp, nn in (("<=", p, n), (">", total_p - p, total_n - n)):
                        if pp >= least and (gain := pp * (math.log2(pp / (pp + nn)) - before)) > best[0] + 1e-9:
                            best = (gain, (name, op, t))
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        held = binned.filter(free & F.col("held")).agg(*[F.count_if(F.col("bad") & holds(rule[: i + 1])).alias(f"p{i}") for i in range(len(rule))], *[F.count_if(~F.col("bad") & holds(rule[: i + 1])).alias(f"n{i}") for i in range(len(rule))]).first()
        worth = [((held[f"p{i}"] - held[f"n{i}"]) / max(held[f"p{i}"] + held[f"n{i}"], 1), -i) for i in range(len(rule))]
        keep = -max(worth)[1]
        p, n = held[f"p{keep}"], held[f"n{keep}"]
        if p + n == 0 or p / (p + n) < PRECISION or p < least / 3:
            break
        rules.append(rule[: keep + 1])
    return rules


def conditional(rules: list[list[tuple[str, str, float]]]) -> Column:
    """The ordered conditional expression: the number of the first rule that holds, from 1, or 0."""
    out = None
    for i, rule in enumerate(rules):
        c = F.lit(True)
        for n, op, t in rule:
            x = F.expr(TESTS[n]).cast("double")
            c = c & ((x > t) if op == ">" else (x <= t))
        out = F.when(c, i + 1) if out is None else out.when(c, i + 1)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, labels: DataFrame, *more: str) -> DataFrame:
    """docs (doc_id, text) with labels (doc_id, quality) to a row for each row: the counts, base_failed, rule and kept.

    base_failed: fewer than 10 words, or over 20 % of the words in repeated five-word windows. rule: the first learned rule
    that holds, 0 if none. kept: neither. Null and blank texts fail. Rows that repeat are judged each; other columns of docs
    but `more` are ignored; without usable labels only the base rejects.
    """
    stats = cut(statistics(docs, *more))
    rules = learn(stats, labels)
    return stats.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).withColumn("rule", conditional(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that `judge` rejects, in the columns of docs. Each row is judged by its own text, whatever its doc_id."""
    tag = fresh(docs, "row_tag")
    marked = docs.withColumn(tag, row_tag("doc_id", "text"))
    bad = few(judge(marked, labels, tag).filter("not kept").select(tag).distinct())  # texts stay where they are unless very many rows go
    return marked.join(bad, tag, "left_anti").select(*docs.columns)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


QUERIES = {"op7_quality": op7_quality}
ORACLES: dict[str, str] = {}
