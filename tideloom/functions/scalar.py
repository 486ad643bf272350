"""Scalar functions of streaming SQL that Spark lacks or names differently, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideloom.functions.times import col


def truncate(x, digits: int = 0, whole: bool = False) -> Column:
    """Cut towards zero after ``digits`` decimals, or before the decimal point if negative.

    The result is a double, cut on the decimal text of the value. With ``whole``, for integer and decimal columns, it
    keeps the type of the column, exactly.
    """
    if whole:
        return col(x) if digits >= 0 else col(x) - col(x) % F.lit(10**-digits)
    value = col(x).cast("double")
    if digits < 0:
        return value - value % F.lit(float(10**-digits))
    scale = F.lit(10**digits)
    exact = F.abs(value).cast("decimal(38,18)")
    cut = F.signum(value) * (F.floor(exact * scale) / scale).cast("double")
    # beyond 2^53 a double has no decimals
    return F.when(F.abs(value) >= 2**53, value).otherwise(cut.cast("double"))


def similar_to(s, pattern: str) -> Column:
    """SQL ``SIMILAR TO``: a regular expression over the whole text with % and _ as wildcards."""
    return col(s).rlike(f"^(?:{similar_regex(pattern)})$")


def similar_regex(pattern: str) -> str:
    """``%`` and ``_`` become ``.*`` and ``.``; a backslash keeps the next character literal."""
    wild = {"%": ".*", "_": "."}
    return re.sub(
        r"\\(.)|[%_]", lambda m: re.escape(m[1]) if m[1] is not None else wild[m[0]], pattern, flags=re.S
    )


def is_empty(x) -> Column:
    """Null for a null collection, else whether it has no element."""
    return F.when(col(x).isNotNull(), F.size(col(x)) == 0)


def is_not_empty(x) -> Column:
    return ~is_empty(x)


def element(x) -> Column:
    """The only element of a collection; null if it is empty, an error if there are more."""
    one = F.size(col(x)) <= 1
    return F.when(one, F.get(col(x), F.lit(0))).otherwise(F.raise_error(F.lit("collection has more than one element")))


def regex_match(pattern, s) -> Column:
    """Whether the whole text matches; the pattern comes first and may be a column."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.rlike(col(s), F.concat(F.lit("^(?:"), p, F.lit(")$")))


def to_text(x) -> Column:
    """The value as text; null is an error."""
    return F.when(col(x).isNotNull(), col(x).cast("string")).otherwise(F.raise_error(F.lit("null has no text")))


def build_record(*args) -> Column:
    """``build_record('k1', v1, 'k2', v2)`` as a struct. Needs pairs; no arguments give an empty struct."""
    if len(args) % 2:
        raise ValueError("build_record takes name, value pairs")
    names = args[::2]
    if not all(isinstance(n, str) for n in names):
        raise TypeError("field names are text")
    return F.struct(*[v.alias(n) if isinstance(v, Column) else F.lit(v).alias(n) for n, v in zip(names, args[1::2])])


def nested_field(root, dtype: T.DataType, path: str, strict: bool = True) -> Column:
    """Follow a dotted path through structs, maps and lists, resolved against the schema at plan time.

    A list takes a segment of its own that ends in ``[i]``; the name in front of it is not used. An
    unknown struct field is an error. Null on the way gives null. A missing map key or list index is
    an error when the query runs, or null with ``strict=False``.
    """
    value = col(root)
    for segment in path.split("."):
        if isinstance(dtype, T.StructType):
            if segment not in dtype.names:
                raise ValueError(f"no field {segment!r} among {dtype.names}")
            value, dtype = value.getField(segment), dtype[segment].dataType
        elif isinstance(dtype, T.MapType):
            found = F.try_element_at(value, F.lit(segment))
            if strict:
                known = value.isNull() | F.map_contains_key(value, F.lit(segment))
                found = F.when(known, found).otherwise(F.raise_error(F.lit(f"no key {segment}")))
            value, dtype = found, dtype.valueType
        elif isinstance(dtype, T.ArrayType):
            index = re.search(r"\[(\d+)\]$", segment)
            if not index:
                raise ValueError(f"a list needs a segment ending in [i], not {segment!r}")
            i = int(index[1])
            found = F.get(value, F.lit(i))
            if strict:
                inside = value.isNull() | (F.size(value) > i)
                found = F.when(inside, found).otherwise(F.raise_error(F.lit(f"no element {i}")))
            value, dtype = found, dtype.elementType
        else:
            raise ValueError(f"{segment!r} asks for a part of a {dtype.simpleString()}")
    return value


def flatten_rows(x) -> Column:
    """Generator: one row per element, none for an empty list, one null row for a null list."""
    return F.explode(F.when(col(x).isNull(), F.array(F.lit(None))).otherwise(col(x)))


def unix_float(x) -> Column:
    """FLOAT to DOUBLE over the decimal text, so 0.1 stays 0.1."""
    return col(x).cast("string").cast("double")


# The same for SQL text: Catalyst inlines the bodies of SQL functions.
SQL_FUNCTIONS = {
    "TRUNCATE": (
        "x DOUBLE, digits INT",
        "DOUBLE",
        "CASE WHEN digits < 0 THEN x - x % power(10, -digits) WHEN abs(x) >= power(2, 53) THEN x"
        " ELSE CAST(sign(x) * CAST(floor(CAST(abs(x) AS DECIMAL(38, 18)) * CAST(power(10, digits) AS BIGINT))"
        " / CAST(power(10, digits) AS BIGINT) AS DOUBLE) AS DOUBLE) END",
    ),
    "TRUNCATE_WHOLE": (
        "x BIGINT, digits INT",
        "BIGINT",
        "CASE WHEN digits >= 0 THEN x ELSE x - x % CAST(power(10, -digits) AS BIGINT) END",
    ),
    "RegexMatch": ("pattern STRING, s STRING", "BOOLEAN", "s RLIKE concat('^(?:', pattern, ')$')"),
    "SimilarTo": (
        "s STRING, pattern STRING",
        "BOOLEAN",
        # character by character, as in similar_regex
        r"s RLIKE concat('^(?:', array_join(transform(regexp_extract_all(pattern, '(?s)\\\\.|.', 0), c -> CASE"
        r" WHEN c = '%' THEN '.*' WHEN c = '_' THEN '.' WHEN length(c) = 2 THEN concat('\\Q', right(c, 1), '\\E') ELSE c END), ''), ')$')",
    ),
    "convertToString": ("x STRING", "STRING", "CASE WHEN x IS NULL THEN raise_error('null has no text') ELSE x END"),
}


def register_sql(spark: SparkSession) -> None:
    """Create the functions of :data:`SQL_FUNCTIONS` in the session."""
    for name, (params, returns, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")
