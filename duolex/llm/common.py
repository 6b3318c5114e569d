"""What the operators of this subpackage share: reading, lineage cuts, packing of sorted keys, worker caches."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, shared_folder, table  # noqa: F401

#: Characters that separate words: space and the controls 9 to 13. `bytes.split()` splits at the same six.
SPACES = r"[\x20\x09-\x0D]"


#: Rows of a side of a join that may be broadcast, once they have been counted.
FEW = 100_000


def few(keys: DataFrame) -> DataFrame:
    """keys, to be broadcast if they are counted and found to be at most FEW; beyond that the join is by exchange."""
    keys = cut(keys)
    return F.broadcast(keys) if keys.count() <= FEW else keys


def parts_of(rows: int, each: int = 100_000) -> int:
    """Partitions for a table of counted rows: a small one makes few files at every exchange, a large one stays spread."""
    return max(1, -(-rows // each))


def slim(kept: DataFrame) -> DataFrame:
    """A table that is kept already, in as many partitions as its rows call for."""
    return kept.coalesce(parts_of(kept.count()))


def cut_lean(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df kept like `cut`, its Python functions fed with batches of `rows` rows, where rows are long or many are made of one."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = conf.get(name)
    conf.set(name, str(rows))
    try:
        return cut(df)
    finally:
        conf.set(name, usual)


def cut_dealt(df: DataFrame, partitions: int, *keys: str) -> DataFrame:
    """df dealt to partitions by the keys and kept like `cut`, in a way that later groupings by the key see.

    Adaptive execution hides the partitioning of what is kept, so it is off for the write.
    """
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df.repartition(partitions, *keys))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def crc_fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo mod; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod).cast("int")


def body(col: Column | str) -> Column:
    """A text as UTF-8 bytes; null is empty."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.cast("binary"), F.lit(b""))


def row_tag(doc_id: Column | str, text: Column | str) -> Column:
    """What tells rows of different ids or texts apart, also where ids are null or repeat: half of a digest of both."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    own = F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("")).cast("binary")
    return F.substring(F.sha2(F.concat(own, F.lit("\n").cast("binary"), body(text)), 256), 1, 32)


def fresh(docs: DataFrame, name: str) -> str:
    """The name, lengthened until docs has no column of that name in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def tidied(run):  # noqa: ANN001, ANN201
    """run, a function over batches, after which its worker gives unused memory back: workers outlive their tasks."""

    def around(batches: Iterator) -> Iterator:
        import ctypes
        import gc

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return around


#: Rows of a sorted table that are worked on at once.
CHUNK = 1 << 19


def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Batches of bigint columns, sorted by the first, as blocks of whole runs of equal first values. A run may exceed CHUNK."""
    held: list[np.ndarray] = []
    size, limit = 0, CHUNK
    for b in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1))
        size += len(held[-1])
        if size >= limit:
            m = np.concatenate(held)
            end = int(np.searchsorted(m[:, 0], m[-1, 0]))
            held, size = [m[end:]], len(m) - end
            limit = max(CHUNK, 2 * size)  # a long run is put together a few times only
            if end:
                yield m[:end]
    if size:
        yield np.concatenate(held)


def kept(name: str, make):
    """make() once in a worker process, whatever copies of this module the tasks unpickle."""
    box = sys.modules.setdefault("_duolex_worker_cache", types.ModuleType("_duolex_worker_cache")).__dict__
    if name not in box:
        box[name] = make()
    return box[name]


def squeeze(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unsqueeze(b: bytes, dtype) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending uint64 keys as compressed differences."""
    return squeeze(np.diff(a, prepend=np.uint64(0)).astype(np.uint64)) if len(a) else b""


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(b, np.uint64), dtype=np.uint64) if b else np.empty(0, np.uint64)
