"""Fill-in-middle transformation by a parallel automaton scan.

An automaton over the bytes of a text counts its units: words of ASCII letters, and every other code point. What a stretch of
bytes does is a function from entry state to (exit state, units begun), and such functions compose associatively. So texts are
cut into blocks anywhere, also within a word or a code point; every block is scanned from all states at once, and a scan of
the functions gives each block its entry state and the units before it. A cut is then found in the one block that has it.

Texts of more than CHUNK bytes are dealt out: their chunks are rows of a balanced exchange, scanned where they land; a text's
few numbers for each chunk (a text has at most 2^31 bytes, so 32,768 chunks) are composed together, and a cut is looked for
in the chunk that was selected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import body, cut, few, fresh, table

#: Bytes of a chunk of a text that is dealt out, of a block of the scan, and of texts that are scanned together.
CHUNK, BLOCK, TOGETHER = 1 << 16, 1 << 8, 1 << 22
#: Byte classes: begins another code point, letter, goes on with a code point, none (padding).
OTHER, LETTER, GOES_ON, NONE = range(4)
#: States: outside and inside a word. Next state, and whether a unit begins, by state and class.
STATES = 2
NEXT = np.array([[0, 1, 0, 0], [0, 1, 1, 1]], np.uint8)
BEGINS = np.array([[1, 1, 0, 0], [1, 0, 0, 0]], np.uint8)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[0x80:0xC0] = GOES_ON
CLASS[[*range(65, 91), *range(97, 123)]] = LETTER


def matrix(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Byte classes of the stretches data[at : at + size], one column each, padded to BLOCK."""
    step = np.arange(BLOCK)[:, None]
    inside = step < size
    return np.where(inside, CLASS[data[np.where(inside, at + step, 0)]], NONE) if len(data) else np.full((BLOCK, len(at)), NONE, np.uint8)


def scan(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each column and entry state: exit state and units begun."""
    state = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], classes.shape[1], 1)
    count = np.zeros(state.shape, np.int64)
    following, begins = NEXT.ravel(), BEGINS.ravel()
    for row in classes:
        key = state * np.uint8(4) + row
        count += begins[key]
        state = following[key]
    return state.T.astype(np.int64), count.T


def compose(exits: np.ndarray, counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Functions of the stretches from the start of each group up to each one, by doubling. first: where each one's group starts."""
    place, d = np.arange(len(exits)), 1
    while d < len(exits) and (later := np.flatnonzero(place - d >= first)).size:
        before = exits[later - d]
        counts_now = counts[later - d] + np.take_along_axis(counts[later], before, 1)
        exits_now = np.take_along_axis(exits[later], before, 1)
        exits, counts = exits.copy(), counts.copy()
        exits[later], counts[later] = exits_now, counts_now
        d *= 2
    return exits, counts


class Texts:
    """Byte stretches, scanned block by block from a given state each."""

    def __init__(self, data: np.ndarray, at: np.ndarray, size: np.ndarray):
        self.data, self.rows = data, len(at)
        blocks = np.maximum(1, -(-size // BLOCK))
        self.last = np.cumsum(blocks) - 1
        self.first = self.last - blocks + 1
        group = np.repeat(self.first, blocks)
        number = np.arange(len(group)) - group
        self.at, self.size = np.repeat(at, blocks) + number * BLOCK, np.minimum(np.repeat(size, blocks) - number * BLOCK, BLOCK)
        exits, counts = scan(matrix(data, self.at, self.size))
        self.exits, self.counts = compose(exits, counts, group)

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        return self.exits[self.last], self.counts[self.last]

    def locate(self, entry: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Bytes before the beginning of unit number `unit` (from 0) of each stretch, or its size where it begins no such unit."""
        row = np.arange(self.rows)
        low, high = self.first.copy(), self.last.copy()
        while (low < high).any():  # the first block up to whose end more than `unit` units have begun
            mid = (low + high) // 2
            enough = self.counts[mid, entry] > unit
            low, high = np.where(enough, low, np.minimum(mid + 1, high)), np.where(enough, mid, high)
        inner = low > self.first
        before = np.where(inner, self.counts[low - 1, entry], 0)
        state = np.where(inner, self.exits[low - 1, entry], entry).astype(np.uint8)
        left, found = unit - before, self.size[low].copy()
        open_ = np.ones(self.rows, bool)
        for t, kind in enumerate(matrix(self.data, self.at[low], self.size[low])):
            key = state * np.uint8(4) + kind
            begins = BEGINS.ravel()[key] > 0
            here = open_ & begins & (left == 0)
            found[here], open_ = t, open_ & ~here
            left, state = left - begins, NEXT.ravel()[key]
        return (low - self.first)[row] * BLOCK + found


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A binary column's bytes, and where each value lies and ends."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), ends[:-1], np.diff(ends)


def together(size: np.ndarray) -> Iterator[slice]:
    """Slices of rows of about TOGETHER bytes, each row counted as a block at least."""
    part = np.cumsum(np.maximum(size, BLOCK)) // TOGETHER
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    yield from (slice(i, j) for i, j in zip(cuts, cuts[1:], strict=False) if j > i)


def points(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Code points that begin in each stretch."""
    if not len(at):
        return np.empty(0, np.int64)
    low, high = int(at.min()), int((at + size).max())
    total = np.concatenate(([0], np.cumsum(CLASS[data[low:high]] != GOES_ON)))
    return total[at + size - low] - total[at - low]


def units(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """After how many of n units prefix and middle end, from two random numbers."""
    a, b = a % (n + 1), b % (n + 1)
    return np.minimum(a, b), np.maximum(a, b)


def arrow_function(f, kind: str):  # noqa: ANN001, ANN201
    from pyspark.sql.pandas.functions import ArrowUDFType, arrow_udf

    return arrow_udf(f, returnType=kind, functionType=ArrowUDFType.SCALAR)


def whole_cuts():  # noqa: ANN201
    """(text, a, b) -> units, bytes and code points before the two cuts."""

    def run(text, a, b):  # noqa: ANN001, ANN202
        data, at, size = raw(text)
        a, b = (np.asarray(x).astype(np.int64) for x in (a, b))
        out = [[] for _ in range(5)]
        for s in together(size):
            t = Texts(data, at[s], size[s])
            n = t.total()[1][:, 0]
            zero = np.zeros(len(n), np.int64)
            where = [np.where(u < n, t.locate(zero, u), size[s]) for u in units(a[s], b[s], n)]
            for o, x in zip(out, [n, *where, *[points(data, at[s], w) for w in where]], strict=True):
                o.append(x)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(o) if o else [], pa.int64()) for o in out], names=CUT)

    return arrow_function(run, ", ".join(f"{c} bigint" for c in CUT))


CUT = ["n", "byte1", "byte2", "point1", "point2"]
SUMMARY = [f"{what}{s}" for what in ("exit", "begun") for s in range(STATES)] + ["points"]


def chunk_summary():  # noqa: ANN201
    """chunk -> exit state and units begun by entry state, and code points."""

    def run(chunk):  # noqa: ANN001, ANN202
        data, at, size = raw(chunk)
        out = []
        for s in together(size):
            exits, begun = Texts(data, at[s], size[s]).total()
            out.append(np.concatenate((exits, begun, points(data, at[s], size[s])[:, None]), 1))
        got = np.concatenate(out) if out else np.empty((0, len(SUMMARY)), np.int64)
        return pa.StructArray.from_arrays([pa.array(got[:, i].copy(), pa.int64()) for i in range(len(SUMMARY))], names=SUMMARY)

    return arrow_function(run, ", ".join(f"{c} bigint" for c in SUMMARY))


def composed(chunks):  # noqa: ANN001, ANN201
    """All chunk summaries of one text -> its units, and by chunk the entry state, units and code points before it."""
    import pandas as pd

    c = chunks.sort_values("chunk")
    exits, begun = c[[f"exit{s}" for s in range(STATES)]].to_numpy(), c[[f"begun{s}" for s in range(STATES)]].to_numpy()
    exits, begun = compose(exits, begun, np.zeros(len(c), np.int64))
    entry, before = np.concatenate(([0], exits[:-1, 0])), np.concatenate(([0], begun[:-1, 0]))
    passed = np.cumsum(c["points"].to_numpy()) - c["points"].to_numpy()
    return pd.DataFrame({"digest": [c["digest"].iloc[0]], "n": [int(begun[-1, 0])], "entry": [entry], "before": [before], "passed": [passed], "all_points": [int(c["points"].sum())]})


#: What is known of a cut before its chunk is looked into: chunk (-1: the end of the text), state on entry, units and points left.
SELECTED = ["chunk", "entry", "unit", "passed"]


def select_chunks():  # noqa: ANN201
    """(a, b, n, entry, before, passed, all_points) -> the two selected chunks."""

    def run(a, b, n, entry, before, passed, all_points):  # noqa: ANN001, ANN202
        a, b, n = (np.asarray(x).astype(np.int64) for x in (a, b, n))
        out = []
        for i, pair in enumerate(zip(*units(a, b, n), strict=True)):
            starts = np.asarray(before[i].values)
            for u in map(int, pair):
                if u >= n[i]:
                    out.append((-1, 0, 0, all_points[i].as_py()))
                else:
                    k = int(np.searchsorted(starts, u, side="right")) - 1
                    out.append((k, int(entry[i].values[k].as_py()), u - int(starts[k]), int(passed[i].values[k].as_py())))
        got = np.array(out, np.int64).reshape(-1, 2 * len(SELECTED))
        return pa.StructArray.from_arrays([pa.array(got[:, i].copy(), pa.int64()) for i in range(got.shape[1])], names=[f"{c}{j}" for j in (1, 2) for c in SELECTED])

    return arrow_function(run, ", ".join(f"{c}{j} bigint" for j in (1, 2) for c in SELECTED))


def locate_in_chunk():  # noqa: ANN201
    """(chunk, entry state, unit) -> bytes and code points of the chunk before the unit's beginning."""

    def run(chunk, entry, unit):  # noqa: ANN001, ANN202
        data, at, size = raw(chunk)
        entry, unit = (np.asarray(x).astype(np.int64) for x in (entry, unit))
        where, passed = [], []
        for s in together(size):
            where.append(Texts(data, at[s], size[s]).locate(entry[s], unit[s]))
            passed.append(points(data, at[s], where[-1]))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (where, passed)], names=["bytes", "points"])

    return arrow_function(run, "bytes bigint, points bigint")


def cut_points(docs: DataFrame, text: Column, a: Column, b: Column, out: str, chunk: int = CHUNK) -> DataFrame:
    """docs with struct `out`: n units of the text (binary), and bytes and code points before the ends of prefix and middle.

    The prefix ends after the smaller of a % (n + 1) and b % (n + 1) units, the middle after the larger. Texts of up to
    `chunk` bytes are scanned where they are; longer ones by chunks that an exchange spreads, equal texts once.
    """
    t, x, y, digest = (fresh(docs, f"__{c}") for c in ("text", "a", "b", "digest"))
    rows = docs.withColumns({t: text, x: a, y: b})
    short = rows.where(F.octet_length(t) <= chunk).withColumn(out, whole_cuts()(t, x, y))
    long = rows.where(F.octet_length(t) > chunk).withColumn(digest, F.sha2(t, 256))
    part = lambda k: F.substring(F.col(t), (k * chunk + 1).cast("int"), F.lit(chunk))
    pieces = long.select(F.col(digest).alias("digest"), F.col(t), F.explode(F.sequence(F.lit(0), F.floor((F.octet_length(t) - 1) / chunk).cast("int"))).alias("chunk"))
    pieces = pieces.select("digest", "chunk", part(F.col("chunk")).alias("part")).hint("rebalance")
    parts = pieces.select("digest", "chunk", chunk_summary()("part").alias("s")).groupBy("digest", "chunk").agg(*[F.max(f"s.{c}").alias(c) for c in SUMMARY])
    whole = parts.groupBy("digest").applyInPandas(composed, "digest string, n bigint, entry array<bigint>, before array<bigint>, passed array<bigint>, all_points bigint")
    asked = long.select(F.col(digest).alias("digest"), F.col(x).alias("a"), F.col(y).alias("b")).distinct()
    chosen = asked.join(whole, "digest").select("digest", "a", "b", "n", select_chunks()("a", "b", "n", "entry", "before", "passed", "all_points").alias("s"))
    chosen = few(chosen.select(F.col("digest").alias(digest), F.col("a").alias(x), F.col("b").alias(y), F.struct("n", "s.*").alias(out)))
    got, locate = long.join(chosen, [digest, x, y]), locate_in_chunk()
    s = lambda name: F.col(f"{out}.{name}")
    for j in (1, 2):  # the unit's beginning within the selected chunk; beyond the last unit the end of the text
        got = got.withColumn(f"{t}{j}", locate(F.when(s(f"chunk{j}") >= 0, part(s(f"chunk{j}"))).otherwise(F.lit(b"")), s(f"entry{j}"), s(f"unit{j}")))
    at = lambda j: F.when(s(f"chunk{j}") >= 0, s(f"chunk{j}") * chunk + F.col(f"{t}{j}.bytes")).otherwise(F.octet_length(t).cast("bigint"))
    seen = lambda j: s(f"passed{j}") + F.col(f"{t}{j}.points")
    got = got.withColumn(out, F.struct(s("n").alias("n"), at(1).alias("byte1"), at(2).alias("byte2"), seen(1).alias("point1"), seen(2).alias("point2")))
    return short.unionByName(got.select(*short.columns)).drop(t, x, y)


def infill(docs: DataFrame, text: str = "text", key: str = "doc_id", salt: str = "1", fim: int = 90, spm: int = 20, marks: tuple[str, str, str] = ("<P>", "<S>", "<M>"), chunk: int = CHUNK) -> DataFrame:
    """docs with columns n_units, form, prefix_chars, middle_chars and output: the text in fill-in-middle order.

    Units are words of ASCII letters and single other code points. Cuts and form come from the hash of salt and key, so a row
    gets the same in every run; a null key counts as empty. `fim` per cent of the texts are transformed, `spm` per cent of
    these as suffix, prefix, middle, the rest as prefix, suffix, middle. Empty and null texts and those that hold a mark stay
    plain, with null lengths. Texts of any length are handled whole; rows that repeat get the same. Other columns stay; those
    that have the name of a new column are replaced.
    """
    new = ["n_units", "form", "prefix_chars", "middle_chars", "output"]
    keep = [c for c in docs.columns if c not in new]
    t, c, h = (fresh(docs, f"__{x}") for x in ("body", "cut", "hash"))
    rows = docs.select(*keep, body(text).alias(t), F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256).alias(h))
    part = lambda i: F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("bigint")
    got = cut_points(rows, F.col(t), part(0), part(1), c, chunk)
    p, s, m = marks
    plain = (F.octet_length(t) == 0) | (part(2) % 100 >= fim)
    for x in marks:
        plain = plain | F.col(t).cast("string").contains(x)
    form = F.when(plain, "plain").when(part(3) % 100 < spm, "spm").otherwise("psm")
    one, two = F.col(f"{c}.byte1").cast("int"), F.col(f"{c}.byte2").cast("int")
    prefix, middle, suffix = (F.substring(F.col(t), a + 1, b - a) for a, b in ((F.lit(0), one), (one, two), (two, F.octet_length(t))))
    b = {x: F.lit(x.encode()) for x in marks}
    got = got.withColumn("form", form)
    output = F.when(F.col("form") == "plain", F.col(t)).when(F.col("form") == "psm", F.concat(b[p], prefix, b[s], suffix, b[m], middle)).otherwise(F.concat(b[s], suffix, b[p], prefix, b[m], middle))
    cut_only = lambda x: F.when(F.col("form") != "plain", x)
    return got.select(
        *keep,
        F.col(f"{c}.n").alias("n_units"),
        "form",
        cut_only(F.col(f"{c}.point1")).alias("prefix_chars"),
        cut_only(F.col(f"{c}.point2") - F.col(f"{c}.point1")).alias("middle_chars"),
        output.cast("string").alias("output"),
    )


def restored(output: Column, form: Column, marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that an output of `infill` was made of. A mark can't begin within what stands before it, so the first one counts."""
    p, s, m = marks
    last = F.instr(output, m)
    end = F.substring(output, last + len(m), F.char_length(output))

    def between(mark: str, after: int, until: Column) -> Column:
        return F.substring(output, F.lit(after + 1), until - after - 1)

    psm = F.concat(between(p, len(p), F.instr(output, s)), end, F.substring(output, F.instr(output, s) + len(s), last - F.instr(output, s) - len(s)))
    spm = F.concat(F.substring(output, F.instr(output, p) + len(p), last - F.instr(output, p) - len(p)), end, between(s, len(s), F.instr(output, p)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = infill(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select(
        "doc_id",
        F.col("n_units").alias("n"),
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


QUERIES = {"op13_infill": op13_infill}
ORACLES = {
    "op13_infill": """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents
), cuts AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
         WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM units
), parts AS (
  SELECT *, array_to_string(u[1:least(x, y)], '') AS pre, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS mid, array_to_string(u[greatest(x, y) + 1:n], '') AS suf FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM parts"""
}
