"""Payload encoding and decoding as column expressions, and projection of rows to a schema."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideloom.functions.times import col


def decode_json(payload, schema: str | T.StructType) -> Column:
    return F.from_json(col(payload), schema)


def encode_json(*columns) -> Column:
    return F.to_json(F.struct(*columns))


def encode_string(s) -> Column:
    return F.encode(col(s), "UTF-8")


def decode_string(b) -> Column:
    return F.decode(col(b), "UTF-8")


def encode_long(x) -> Column:
    """8 bytes, big-endian two's complement."""
    return F.unhex(F.lpad(F.hex(col(x).cast("bigint")), 16, "0"))


def decode_long(b) -> Column:
    return F.conv(F.hex(col(b)), 16, -10).cast("bigint")


def encode_int(x) -> Column:
    """4 bytes, big-endian two's complement."""
    return F.unhex(F.right(F.lpad(F.hex(col(x).cast("bigint")), 16, "0"), F.lit(8)))


def decode_int(b) -> Column:
    unsigned = F.conv(F.hex(col(b)), 16, 10).cast("bigint")
    return F.when(unsigned >= 2**31, unsigned - 2**32).otherwise(unsigned).cast("int")


def _double_to_bytes(x: pa.Array) -> pa.Array:
    bits = x.fill_null(0.0).to_numpy(zero_copy_only=False).astype(">f8").tobytes()
    valid = x.is_valid().buffers()[1] if x.null_count else None
    return pa.Array.from_buffers(pa.binary(8), len(x), [valid, pa.py_buffer(bits)]).cast(pa.binary())


def _bytes_to_double(b: pa.Array) -> pa.Array:
    fixed = b.fill_null(bytes(8)).cast(pa.binary(8))
    values = np.frombuffer(fixed.buffers()[1], dtype=">f8", count=len(b), offset=8 * fixed.offset).astype("f8")
    return pa.array(values, pa.float64(), mask=b.is_null().to_numpy(zero_copy_only=False))


def encode_double(x) -> Column:
    """8 bytes, big-endian IEEE 754. Spark has no expression for the bits, so whole Arrow columns are turned; NaN and
    null stay apart."""
    return F.arrow_udf(_double_to_bytes, T.BinaryType())(col(x).cast("double"))


def decode_double(b) -> Column:
    return F.arrow_udf(_bytes_to_double, T.DoubleType())(col(b))


def encode_uuid(text) -> Column:
    """16 bytes, most significant first."""
    return F.unhex(F.replace(col(text), F.lit("-"), F.lit("")))


def decode_uuid(b) -> Column:
    return F.regexp_replace(F.lower(F.hex(col(b))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def key_value(key: Column, value: Column) -> Column:
    """An encoded (key, value) message."""
    return F.struct(key.alias("key"), value.alias("value"))


def project_to_schema(df: DataFrame, schema: T.StructType, float_as_text: bool = False) -> DataFrame:
    """Rows as a reader or sink with ``schema`` sees them, at any depth.

    Fields that the row lacks read as null, fields that the schema lacks are dropped. A null struct
    stays null. With ``float_as_text`` a FLOAT becomes DOUBLE over its decimal text.
    """
    have = df.schema
    return df.select(
        *[
            (_fit(F.col(f"`{f.name}`"), have[f.name].dataType, f.dataType, float_as_text)
             if f.name in have.names else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema
        ]
    )


def _fit(value: Column, have: T.DataType, want: T.DataType, float_as_text: bool) -> Column:
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        parts = [
            (_fit(value.getField(f.name), have[f.name].dataType, f.dataType, float_as_text)
             if f.name in have.names else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in want
        ]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(value, lambda x: _fit(x, have.elementType, want.elementType, float_as_text))
    if isinstance(want, T.MapType) and isinstance(have, T.MapType):
        return F.transform_values(value, lambda _, x: _fit(x, have.valueType, want.valueType, float_as_text))
    if float_as_text and isinstance(have, T.FloatType) and isinstance(want, T.DoubleType):
        return value.cast("string").cast("double")
    return value if have == want else value.cast(want)
