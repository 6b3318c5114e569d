"""Half-open spans in texts: merging, mapping through alignments, marking. All inside the row, so nothing is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int>>"
ALIGNMENTS = "array<struct<from_start:int,from_end:int,to_start:int,to_end:int>>"


def span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def between(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def bridgeable(text: Column, start: Column, end: Column) -> Column:
    """The gap [start, end) is empty or holds white space and hyphens only."""
    return between(text, start, end).rlike(r"^(?U)[\s-]*$")


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_end > b_start) & (a_start < b_end)


def merge(spans: Column, text: Column) -> Column:
    """Spans by start; a span inside the last one goes, one that touches it, or leaves only a bridgeable gap, extends it."""
    none = F.array().cast(SPANS)

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(span(last["start"], s["end"])))
        return (
            F.when(F.size(done) == 0, F.array(span(s["start"], s["end"])))
            .when(s["end"] <= last["end"], done)
            .when((s["start"] <= last["end"]) | bridgeable(text, last["end"], s["start"]), grown)
            .otherwise(F.concat(done, F.array(span(s["start"], s["end"]))))
        )

    return F.when(F.size(spans) > 0, F.aggregate(F.array_sort(spans), none, step)).otherwise(none)


def reversed_alignments(alignments: Column) -> Column:
    return F.transform(alignments, lambda a: F.struct(a["to_start"].alias("from_start"), a["to_end"].alias("from_end"), a["from_start"].alias("to_start"), a["from_end"].alias("to_end")))


def mapped(highlights: Column, alignments: Column, target_text: Column, from_side: bool = True) -> Column:
    """Highlights on one side of the alignments as merged spans of the other side's text."""
    a, b = ("from", "to") if from_side else ("to", "from")
    hit = F.filter(alignments, lambda x: F.exists(highlights, lambda h: overlap(h["start"], h["end"], x[f"{a}_start"], x[f"{a}_end"])))
    return merge(F.transform(hit, lambda x: span(x[f"{b}_start"], x[f"{b}_end"])), target_text)


def snapped(start: Column, end: Column, tokens: Column) -> Column:
    """The tokens that a predicted span overlaps."""
    return F.filter(tokens, lambda t: overlap(start, end, t["start"], t["end"]))


def marked(text: Column, spans: Column, before: str = "<mark>", after: str = "</mark>") -> Column:
    """The encoded text with each of the sorted spans between marks; without spans it is encoded all the same."""
    from .text import html_encode

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, s: Column) -> Column:
        piece = F.concat(a["out"], html_encode(between(text, a["at"], s["start"])), F.lit(before), html_encode(between(text, s["start"], s["end"])), F.lit(after))
        return F.struct(piece.alias("out"), s["end"].alias("at"))

    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], html_encode(between(text, a["at"], F.length(text)))))


def marker_spans(text: Column, marker: str) -> Column:
    """Spans between pairs of a marker character, in places of the text without it, merged over bridgeable gaps."""
    parts = F.split(text, F.lit(f"\\Q{marker}\\E"), -1)
    ends = F.transform(parts, lambda _, i: F.aggregate(F.slice(parts, F.lit(1), i + 1), F.lit(0), lambda n, p: n + F.length(p)))
    every = F.transform(ends, lambda e, i: F.when(i % 2 == 1, span(F.element_at(ends, i), e)))
    return merge(F.filter(every, lambda s: s.isNotNull()), F.replace(text, F.lit(marker), F.lit("")))


def simplify_rows(alignments: list[tuple[int, int, int, int]], from_text: str, to_text: str) -> list[tuple[int, int, int, int]]:
    """Fewer alignments that say the same. Forward passes over the sorted set: each one takes in what it can of those after it.

    Two merge if one holds the other, or if they are equal on one side and overlap, touch or are parted by white space only
    on the other. Passes are repeated until nothing merges. Empty spans are dropped at the start.
    """

    def near(a: tuple[int, int], b: tuple[int, int], text: str) -> bool:
        low, high = min(a[1], b[1]), max(a[0], b[0])
        return high <= low or not text[low:high].strip()

    def joined(x, y):  # noqa: ANN001, ANN202
        hull = (min(x[0], y[0]), max(x[1], y[1]), min(x[2], y[2]), max(x[3], y[3]))
        if hull in (x, y):
            return hull
        if x[:2] == y[:2] and near(x[2:], y[2:], to_text) or x[2:] == y[2:] and near(x[:2], y[:2], from_text):
            return hull
        return None

    rows = sorted({tuple(a) for a in alignments if a[0] < a[1] or a[2] < a[3]})
    while True:
        kept: list = []
        rest = rows
        while rest:
            head, *others = rest
            rest = []
            for o in others:
                if (both := joined(head, o)) is not None:
                    head = both
                else:
                    rest.append(o)
            kept.append(head)
        if len(kept) == len(rows):
            return kept
        rows = sorted(kept)


def simplified(alignments: Column, from_text: Column, to_text: Column) -> Column:
    @F.pandas_udf(ALIGNMENTS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        names = ("from_start", "from_end", "to_start", "to_end")
        for a, f, t in batches:
            yield pd.Series([[dict(zip(names, r, strict=True)) for r in simplify_rows([tuple(x[n] for n in names) for x in rows], x_from, x_to)] for rows, x_from, x_to in zip(a, f, t, strict=True)])

    return run(alignments, from_text, to_text)


def _units(text: str) -> list[int]:
    """Code points before each UTF-16 unit, and before the end."""
    out: list[int] = []
    for i, c in enumerate(text):
        out += [i] * (2 if ord(c) > 0xFFFF else 1)
    return [*out, len(text)]


def from_utf16(spans: Column, text: Column) -> Column:
    """Spans counted in UTF-16 units as spans in code points; texts without characters beyond the first plane come back as they are."""

    @F.pandas_udf(SPANS)
    def run(s: pd.Series, t: pd.Series) -> pd.Series:
        def one(spans, text):  # noqa: ANN001, ANN202
            u = _units(text)
            return [{"start": u[x["start"]], "end": u[x["end"]]} for x in spans]

        return pd.Series([one(a, b) for a, b in zip(s, t, strict=True)])

    return F.when(text.rlike(r"[\x{10000}-\x{10FFFF}]"), run(spans, text)).otherwise(spans)
