"""Column functions shared by the operators; all are built from Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR = chr(124)


def differs(a: Column, b: Column) -> Column:
    """Null-safe inequality: two nulls agree, a null and a value differ."""
    return ~a.eqNullSafe(b)


def public_id(salt: Column, identifier: Column) -> Column:
    """16 hex digits that stand for an identifier in what is published; they differ with the salt."""
    return F.substring(F.sha2(F.concat(salt, F.lit(BAR), identifier), 256), 1, 16)


def rfc3339(ts: Column, offset_minutes: int = 0) -> Column:
    """A timestamp in UTC as RFC 3339 text with a fixed offset."""
    sign, m = ("-" if offset_minutes < 0 else "+"), abs(offset_minutes)
    moved = ts + F.expr(f"make_dt_interval(0, 0, {offset_minutes}, 0)")
    return F.concat(F.date_format(moved, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(f"{sign}{m // 60:02d}:{m % 60:02d}"))


def shown(value: Column) -> Column:
    """A value for a report; a dash for null."""
    return F.coalesce(value.cast("string"), F.lit("—"))


def padded_length(n: Column, block: int = 16) -> Column:
    """Length after padding to whole blocks, with at least one byte of padding."""
    return n + block - n % block


_TAGS = {T.StringType: "T", T.BinaryType: "B", T.LongType: "I", T.IntegerType: "I", T.ShortType: "I", T.ByteType: "I", T.BooleanType: "L", T.TimestampType: "S", T.TimestampNTZType: "S", T.DateType: "D", T.DoubleType: "R", T.FloatType: "R"}


def tagged(value: Column, kind: T.DataType | str) -> Column:
    """A value as text that no other value or type shares: type tag, length, content; null has a tag of its own.

    Arrays and structs are the texts of their parts, maps those of their entries in order of the keys' texts.
    """
    kind = T.DataType.fromDDL(kind) if isinstance(kind, str) else kind
    if isinstance(kind, T.ArrayType):
        parts = F.transform(value, lambda x: tagged(x, kind.elementType))
        text = F.concat(F.lit("A"), F.size(value).cast("string"), F.lit("["), F.array_join(parts, ""), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.transform(F.map_entries(value), lambda e: F.concat(tagged(e["key"], kind.keyType), tagged(e["value"], kind.valueType))))
        text = F.concat(F.lit("M"), F.size(value).cast("string"), F.lit("{"), F.array_join(entries, ""), F.lit("}"))
    elif isinstance(kind, T.StructType):
        text = F.concat(F.lit("C("), *[tagged(value[f.name], f.dataType) for f in kind.fields], F.lit(")"))
    else:
        tag = _TAGS.get(type(kind), f"X{kind.simpleString()};")
        plain = F.hex(value) if isinstance(kind, T.BinaryType) else F.unix_micros(value.cast("timestamp")).cast("string") if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else value.cast("string")
        text = F.concat(F.lit(tag), F.octet_length(plain).cast("string"), F.lit(":"), plain)
    return F.when(value.isNull(), F.lit("N;")).otherwise(text)
