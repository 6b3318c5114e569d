"""Explicit schemas of the corpus tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BinaryType()


def record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SPAN = record(start=I, end=I)
TOKEN = record(term=S, pos=I, start=I, end=I)
ALIGNMENT = record(from_start=I, from_end=I, to_start=I, to_end=I)
TRANSLATION = record(speaker_name=S, context=S, text=S, word_count=I, notes=S, audio_file=S)
QUOTE = record(id=L, source=S, english=TRANSLATION, japanese=TRANSLATION, alignment_data=T.ArrayType(ALIGNMENT), date_imported=T.TimestampType())
PARSED_LINE = record(key_int=L, key_str=S, language=S, text=S, audio_path=S, speaker=S, context=S, notes=S, weight=I, file_ordinal=I, line_ordinal=I)
AUDIO_FILE = record(name=S, mode=I, mtime=L, sz=I, data=B)
AUDIO_CACHE = record(original_uri=S, object_name=S)
OBJECT_CACHE = record(bucket=S, object_name=S, size=L)
PREDICTION = record(score=D, start=I, end=I, answer=S)
