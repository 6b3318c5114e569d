"""Bit-packed identifiers: source << 48 with a payload of 48 bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF


def _checked(value: Column, ok: Column, what: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(what)).cast("bigint"))


def _top(source: Column) -> Column:
    return F.shiftleft(source.cast("bigint"), 48)


def pack_pair(source: Column, high: Column, low: Column) -> Column:
    """source << 48 | high << 32 | low, high in 16 bits, low not negative."""
    high, low = high.cast("bigint"), low.cast("bigint")
    return _checked(_top(source).bitwiseOR(F.shiftleft(high, 32)).bitwiseOR(low), high.between(0, MAX16) & (low >= 0), "id part out of range")


def pack_form(source: Column, form: Column, response: Column) -> Column:
    """source << 48 | form << 16 | response, response in 16 bits."""
    form, response = form.cast("bigint"), response.cast("bigint")
    return _checked(_top(source).bitwiseOR(F.shiftleft(form, 16)).bitwiseOR(response), response.between(0, MAX16), "id part out of range")


def pack_index(source: Column, index: Column, reserved: tuple[int, ...] = ()) -> Column:
    """source << 48 | index; sources with a layout of their own are refused."""
    index = index.cast("bigint")
    return _checked(_top(source).bitwiseOR(index), (index >= 0) & ~source.isin(*reserved) if reserved else index >= 0, "id part out of range")


def source_of(id_: Column) -> Column:
    return F.shiftrightunsigned(id_, 48)


def pair_of(id_: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(id_, 32).bitwiseAND(MAX16), id_.bitwiseAND(MAX32)


def form_of(id_: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(id_, 16).bitwiseAND(MAX32), id_.bitwiseAND(MAX16)


def index_of(id_: Column) -> Column:
    return id_.bitwiseAND((1 << 48) - 1)


def form_hex(form: Column) -> Column:
    return F.lpad(F.hex(form), 8, "0")


def load_order_prefix(plugins, spark=None):
    """plugins (name, kind full/medium/light, ord) with the first form id of each: its number within its kind, shifted by kind."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("kind").orderBy("ord")) - 1
    return plugins.withColumn(
        "prefix",
        F.when(F.col("kind") == "light", F.lit(0xFE000000).bitwiseOR(F.shiftleft(n.cast("bigint"), 12)))
        .when(F.col("kind") == "medium", F.lit(0xFD000000).bitwiseOR(F.shiftleft(n.cast("bigint"), 16)))
        .otherwise(F.shiftleft(n.cast("bigint"), 24)),
    )
