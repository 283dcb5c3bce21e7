"""Functions on values of elements: varints, sizes, printable bytes, type names, byte costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import ITEM, ITEM_WITH_SUM, KEYED_TREES, NAMES, REFERENCE, SUM_ITEM, TREES


def varint_length(n: Column) -> Column:
    """Bytes of an unsigned number written seven bits a byte."""
    out = F.lit(10)
    for size in range(9, 0, -1):
        out = F.when(n < F.lit(1 << 7 * size) if size < 9 else n >= 0, size).otherwise(out)
    return out


def zigzag(n: Column) -> Column:
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def varint(n: Column) -> Column:
    """A signed number as zigzag varint bytes."""
    z = zigzag(n)
    parts = [F.shiftrightunsigned(z, 7 * k).bitwiseAND(F.lit(127)) for k in range(10)]
    more = [F.shiftrightunsigned(z, 7 * (k + 1)) != 0 if k < 9 else F.lit(False) for k in range(10)]
    pieces = []
    for k in range(10):
        byte = F.unhex(F.lpad(F.hex(parts[k].bitwiseOR(F.when(more[k], F.lit(128)).otherwise(F.lit(0)))), 2, "0"))
        there = F.lit(True) if k == 0 else F.shiftrightunsigned(z, 7 * k) != 0
        pieces.append(F.when(there, byte).otherwise(F.lit(bytearray())))
    return F.when(n.isNotNull(), F.concat(*pieces))


def hex_to_ascii(value: Column) -> Column:
    """Bytes as text where all of them are letters, digits or a few marks; else in hexadecimal after 0x."""
    text = F.decode(F.when(F.hex(value).rlike("^([2-6][0-9A-F]|7[0-9A-E])*$"), value), "UTF-8")
    return F.when(text.rlike("^[A-Za-z0-9_/.\\[\\]-]*$"), text).otherwise(F.concat(F.lit("0x"), F.lower(F.hex(value))))


def type_name(element_type: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, NAMES)), element_type.cast("int") + 1)


def is_any_item(t: Column) -> Column:
    return t.isin(ITEM, SUM_ITEM, ITEM_WITH_SUM)


def is_non_empty_log(t: Column, log_count: Column, mmr_size: Column) -> Column:
    return t.isin(*TREES) & ~t.isin(*KEYED_TREES) & (F.coalesce(log_count, mmr_size, F.lit(0)) > 0)


def required_item_space(length: Column, flag_length: Column) -> Column:
    """Bytes an item takes: the value and flags with their lengths, a kind byte and an option byte for the flags."""
    return length + varint_length(length) + flag_length + varint_length(flag_length) + 1 + 1


def element_bytes(item: Column, flags: Column) -> Column:
    return required_item_space(F.coalesce(F.octet_length(item), F.lit(0)), F.coalesce(F.octet_length(flags), F.lit(0)))


def added_bytes(key: Column, value_size: Column) -> Column:
    """Storage added by a new entry: key with the tree's prefix of 32 bytes, value and its two hashes, both with lengths, and a link from the parent."""
    k = F.octet_length(key) + 32
    v = value_size + 32 + 32
    return (k + varint_length(k) + v + varint_length(v)).cast("bigint")


def transition(old_size: Column, new_size: Column) -> Column:
    """What a write does to an entry, from its sizes; null: not there."""
    return (
        F.when(old_size.isNull() & new_size.isNull(), "none")
        .when(old_size.isNull(), "insert new")
        .when(new_size.isNull(), "delete")
        .when(new_size > old_size, "update bigger")
        .when(new_size < old_size, "update smaller")
        .otherwise("update same")
    )


def is_reference(t: Column) -> Column:
    return t == REFERENCE
