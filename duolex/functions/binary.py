"""Binary formats as column expressions: audio headers, voice containers, packed alignments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Magic bytes, as hexadecimal text.
MP3_FRAME, ID3, OGG, VORBIS, OPUS, FUZ = "FFFB", "494433", "4F676753", "01766F72626973", "4F70757348656164", "46555A45"
#: Where the first stream header of an Ogg page begins.
OGG_STREAM = 28


def _at(data: Column, start: int, magic: str) -> Column:
    return F.hex(F.substring(data, start + 1, len(magic) // 2)) == magic


def audio_format(data: Column) -> Column:
    """mp3, ogg or opus; null for anything else, empty data included."""
    return F.when(_at(data, 0, MP3_FRAME) | _at(data, 0, ID3), "mp3").when(_at(data, 0, OGG) & _at(data, OGG_STREAM, VORBIS), "ogg").when(_at(data, 0, OGG) & _at(data, OGG_STREAM, OPUS), "opus")


def audio_problem(data: Column) -> Column:
    """Why there is no format: null if there is one."""
    return F.when(F.length(data) == 0, "zero bytes").when(audio_format(data).isNotNull(), F.lit(None)).when(_at(data, 0, OGG), "unsupported stream").otherwise("unsupported format")


def little_endian(data: Column, start: Column | int, size: int) -> Column:
    start = F.lit(start) if isinstance(start, int) else start
    h = F.hex(F.substring(data, start + 1, F.lit(size)))
    return F.conv(F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(size - 1, -1, -1)]), 16, 10).cast("bigint")


def fuz_audio(data: Column) -> Column:
    """The audio part of a version-1 voice container, behind header and lip data; null if it isn't one."""
    ok = _at(data, 0, FUZ) & (little_endian(data, 4, 4) == 1)
    return F.when(ok, F.substring(data, (little_endian(data, 8, 4) + 13).cast("int"), F.length(data)))


def decode_alignments(blob: Column) -> Column:
    """Records of four little-endian 16-bit numbers as array<struct>."""
    n = (F.length(blob) / 8).cast("int")
    number = lambda i, j: little_endian(blob, i * 8 + j * 2, 2).cast("int")
    one = lambda i: F.struct(number(i, 0).alias("from_start"), number(i, 1).alias("from_end"), number(i, 2).alias("to_start"), number(i, 3).alias("to_end"))
    empty = F.array().cast("array<struct<from_start:int,from_end:int,to_start:int,to_end:int>>")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).when(blob.isNotNull(), empty)


def encode_alignments(alignments: Column) -> Column:
    number = lambda x: F.lpad(F.hex(x), 4, "0")
    low_first = lambda h: F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2))
    each = F.transform(alignments, lambda a: F.concat(*[low_first(number(a[k])) for k in ("from_start", "from_end", "to_start", "to_end")]))
    return F.unhex(F.array_join(each, ""))
