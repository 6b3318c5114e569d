"""Joins of half-open intervals across rows, as equality joins on bins whose width follows each interval's own length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import overlap
from ..session import cut, partitions

#: Levels of bins: a bin of level n is 2 ** n wide. The last takes whatever is longer, in as many bins as it covers.
LEVELS = 40
#: Levels between two that a side keeps, and rows of both sides for a task.
STEP, EACH = 5, 250_000


def level(start: Column, end: Column) -> Column:
    """The lowest level whose bins are as wide as an interval, so that it lies in two of them at most."""
    return F.least(F.ceil(F.log2(F.greatest(end - start, F.lit(1)).cast("double"))), F.lit(LEVELS)).cast("int")


def kept_levels(rows: DataFrame) -> list[int]:
    """The levels that a side's intervals are dealt by: few, so that the other side is there few times.

    From the level that most rows have or lie below upwards, one in `STEP`, and the highest one used. A bin is then wider than an
    interval at most 2 ** STEP times, or as wide as that of a usual one.
    """
    n = {r["_own"]: r["n"] for r in rows.groupBy("_own").agg(F.count("*").alias("n")).collect() if r["_own"] is not None}  # LEVELS + 1 at most
    if not n:
        return []
    used, most, below = sorted(n), sum(n.values()), 0
    for usual in used:
        below += n[usual]
        if 2 * below >= most:
            break
    out = [usual]
    for x in used:
        if x >= out[-1] + STEP or x == used[-1] > out[-1]:
            out.append(x)
    return out


def _at_least(levels: list[int], own: Column) -> Column:
    """The lowest of the levels that isn't below an interval's own."""
    return F.array_min(F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), lambda x: x >= own))


def _binned(rows: DataFrame, start: str, end: str, levels: Column) -> DataFrame:
    """rows once for each bin of each of the levels that the interval lies in."""
    at = rows.withColumn("_level", F.explode(levels))
    width = F.expr("shiftleft(1L, _level)")
    first, last = (F.floor(x / width).cast("bigint") for x in (F.col(start), F.greatest(F.col(end) - 1, F.col(start))))
    return at.withColumn("_bin", F.explode(F.sequence(first, last)))


def overlapping(left: DataFrame, right: DataFrame, on: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of rows of equal keys whose intervals [start, end) of whole numbers overlap; each pair once.

    left and right have the key columns and, on the right, start and end named with the suffix `_r`; other columns must differ.
    Each side keeps a few levels (`kept_levels`) and deals its intervals by the lowest of them that is as wide. The longer interval of a
    pair stays on that level, the shorter one is dealt by the other side's levels from its own up, so a row is there at most
    twice a kept level of the other side. The join is on key, level and bin: a key that very many rows share is spread over
    its bins, and tasks follow the number of rows. Of a pair's bins the one of the later start counts. Null keys and null ends
    join nothing; an empty interval overlaps those that hold its place within.
    """
    start_r, end_r = f"{start}_r", f"{end}_r"
    l = left.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("_own", level(F.col(start), F.col(end)))  # noqa: E741
    r = right.filter(F.col(start_r).isNotNull() & F.col(end_r).isNotNull()).withColumn("_own", level(F.col(start_r), F.col(end_r)))
    of_l, of_r = kept_levels(l), kept_levels(r)
    if not of_l or not of_r:
        return left.join(right, on).limit(0)
    l, r = l.withColumn("_own", _at_least(of_l, F.col("_own"))), r.withColumn("_own_r", _at_least(of_r, F.col("_own"))).drop("_own")
    every = lambda levels: F.array(*[F.lit(x) for x in levels]).cast("array<int>")
    keys = [*on, "_level", "_bin"]
    n = partitions(left, EACH, left.count() + right.count())
    met = lambda a, b: a.repartition(n, *keys).join(b.repartition(n, *keys), keys)
    # the right one's level is as high or higher: it stays there, the left one goes up to it; then the other way round
    up = met(_binned(l, start, end, F.filter(every(of_r), lambda x: x >= F.col("_own"))), _binned(r, start_r, end_r, F.array("_own_r"))).drop("_own", "_own_r")
    both = up
    if of_l[-1] > of_r[0]:
        low = l.filter(F.col("_own") > of_r[0])  # others are as low as any of the right ones
        both = up.unionByName(met(_binned(low, start, end, F.array("_own")), _binned(r, start_r, end_r, F.filter(every(of_l), lambda x: x > F.col("_own_r")))).drop("_own", "_own_r"))
    later = F.floor(F.greatest(start, start_r) / F.expr("shiftleft(1L, _level)"))
    both = both.filter((later == F.col("_bin")) & overlap(F.col(start), F.col(end), F.col(start_r), F.col(end_r)))
    return both.drop("_level", "_bin")


#: Pairs for each row of both sides, as if all overlapped, from which on the intervals of a key are counted by nodes; heavy keys that are sent to all tasks.
PAIRS, SENT = 100, 100_000


def _nodes(rows: DataFrame, first: Column, after: Column) -> DataFrame:
    """rows once for each node of [first, after): the fewest bins of all levels that cover just the interval, two a level at most."""
    at = rows.withColumns({"_first": first, "_after": after}).filter("_first < _after")
    at = at.withColumn("_level", F.explode(F.sequence(F.lit(0), F.floor(F.log2((F.col("_after") - F.col("_first")).cast("double"))).cast("int"))))
    at = at.withColumns({"_lo": F.expr("-shiftright(-_first, _level)"), "_hi": F.expr("shiftright(_after, _level)")}).filter("_lo < _hi")
    node = F.array(F.when(F.expr("_lo & 1") == 1, F.col("_lo")), F.when(F.expr("_hi & 1") == 1, F.col("_hi") - 1))
    return at.withColumn("_node", F.explode(node)).filter("_node is not null").drop("_first", "_after", "_lo", "_hi")


def _above(rows: DataFrame, place: str, top: int) -> DataFrame:
    """rows once for each level up to the top, with the bin that holds a place."""
    return rows.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumn("_node", F.expr(f"shiftright(`{place}`, _level)"))


def _top(rows: DataFrame, start: str, end: str) -> int:
    longest = rows.agg(F.max(F.col(end) - F.col(start))).first()[0]
    return max(longest or 1, 1).bit_length()


def _counted_by_nodes(left: DataFrame, right: DataFrame, on: list[str], least: str, start: str, end: str) -> DataFrame:
    """on, start_r, end_r, n, least of the distinct right intervals; left ones aren't empty, right ones don't end before they start.

    A left interval overlaps one that it begins in, or else it goes over that one's start. Beginnings are counted by bin and looked up by the
    nodes of the right interval; what goes on after the beginning is counted by its nodes and looked up by the bins of the right start. So
    rows grow with the logarithm of the lengths, and pairs aren't made.
    """
    start_r, end_r = f"{start}_r", f"{end}_r"
    summed = [F.count("*").alias("n"), F.min(least).alias(least)]
    part = lambda rows, kind: rows.withColumn("_kind", F.lit(kind))
    keys = [*on, "_kind", "_level", "_node"]
    l, r = left.select(*on, start, end, least), right.select(*on, start_r, end_r).distinct()  # noqa: E741
    begun = _above(l, start, _top(r, start_r, end_r))
    going = _nodes(l, F.col(start) + 1, F.col(end))
    held = part(begun, 0).unionByName(part(going, 1)).groupBy(*keys).agg(*summed)
    asked = part(_nodes(r, F.col(start_r), F.col(end_r)), 0).unionByName(part(_above(r, start_r, _top(l, start, end)), 1))
    return asked.join(held, keys).groupBy(*on, start_r, end_r).agg(F.sum("n").alias("n"), F.min(least).alias(least))


def overlap_counts(left: DataFrame, right: DataFrame, on: list[str], by: str, least: str, start: str = "start", end: str = "end") -> DataFrame:
    """by, n, least: for each value of a right column the number of its pairs as of `overlapping`, and the least value of a left column in them.

    Keys with few intervals go by pairs. Those whose pairs could be over `PAIRS` a row are counted without making pairs; of these,
    only empty left intervals and right ones that end before they start are paired.
    """
    start_r, end_r = f"{start}_r", f"{end}_r"
    l = left.filter(F.col(start).isNotNull() & F.col(end).isNotNull())  # noqa: E741
    r = right.filter(F.col(start_r).isNotNull() & F.col(end_r).isNotNull())
    both = l.groupBy(*on).agg(F.count("*").cast("double").alias("_l")).join(r.groupBy(*on).agg(F.count("*").cast("double").alias("_r")), on)
    heavy = cut(both.filter(F.col("_l") * F.col("_r") > PAIRS * (F.col("_l") + F.col("_r"))).select(*on))
    n = heavy.count()
    heavy = F.broadcast(heavy) if n <= SENT else heavy
    paired = lambda a, b: overlapping(a, b, on, start, end).groupBy(by).agg(F.count("*").alias("n"), F.min(least).alias(least))
    out = paired(l.join(heavy, on, "left_anti"), r.join(heavy, on, "left_anti"))
    if n:
        l, r = l.join(heavy, on, "left_semi"), r.join(heavy, on, "left_semi")  # noqa: E741
        some, going = l.filter(F.col(start) < F.col(end)), r.filter(F.col(start_r) <= F.col(end_r))
        counted = r.join(_counted_by_nodes(some, going, on, least, start, end), [*on, start_r, end_r]).select(by, "n", least)
        odd = [(l.filter(F.col(start) >= F.col(end)), r), (some, r.filter(F.col(start_r) > F.col(end_r)))]
        for a, b in odd:
            counted = counted.unionByName(paired(a, b)) if not (a.isEmpty() or b.isEmpty()) else counted
        out = out.unionByName(counted)
    return out.groupBy(by).agg(F.sum("n").alias("n"), F.min(least).alias(least))
