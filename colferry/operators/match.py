"""Matching a file's columns to a relation's, and which casts between them are allowed."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column as Expr
from pyspark.sql import functions as F

from colferry.errors import FerryError
from colferry.functions.convert import to_declared, uuid_text
from colferry.types import Column, SqlType, arrow_type, spark_type

NUMBERS = frozenset("int2 int4 int8 float4 float8 numeric".split())
TEXTS = frozenset("text varchar bpchar name json jsonb char1".split())


def host_kind(t: pa.DataType) -> str | None:
    """The declared kind that a file's scalar type stands for."""
    if isinstance(t, pa.BaseExtensionType):
        name = t.extension_name
        return "uuid" if name == "arrow.uuid" else "json" if name == "arrow.json" else host_kind(t.storage_type)
    if pa.types.is_float16(t) or pa.types.is_float32(t):
        return "float4"
    if pa.types.is_float64(t):
        return "float8"
    if pa.types.is_integer(t):
        return {8: "int2", 16: "int2", 32: "int4", 64: "int8"}[t.bit_width]
    if pa.types.is_decimal128(t):
        return "numeric"
    for test, kind in ((pa.types.is_boolean, "bool"), (pa.types.is_date32, "date"), (pa.types.is_time64, "time"), (pa.types.is_time32, "time"), (pa.types.is_string, "text"), (pa.types.is_large_string, "text"), (pa.types.is_binary, "bytea"), (pa.types.is_large_binary, "bytea")):
        if test(t):
            return kind
    if pa.types.is_timestamp(t):
        return "timestamptz" if t.tz else "timestamp"
    return None


def castable(source: str, target: SqlType) -> bool:
    """Whether an explicit cast from a file's kind to a declared type exists."""
    kind = "text" if target.as_text and target.kind not in ("varchar", "bpchar", "name") else target.kind
    if source == kind or source in NUMBERS and kind in NUMBERS:
        return True
    if source == "text":
        return True
    if kind in ("text", "varchar", "bpchar", "name"):
        return True
    pairs = {
        "bool": {"int4"}, "int4": {"bool", "oid"}, "int2": {"oid"}, "int8": {"oid"}, "date": {"timestamp", "timestamptz"},
        "timestamp": {"date", "time", "timestamptz"}, "timestamptz": {"date", "time", "timestamp", "timetz"}, "time": {"timetz"}, "json": {"jsonb", "json"}, "bytea": {"geometry"},
    }
    return kind in pairs.get(source, ())


def same(t: pa.DataType, target: SqlType) -> bool:
    """The file holds exactly what the relation would write."""
    return t == arrow_type(target)


def coercible(t: pa.DataType, target: SqlType) -> bool:
    if same(t, target):
        return True
    if pa.types.is_struct(t):
        return target.kind == "struct" and [f.name for f in t] == [n for n, _ in target.fields] and all(coercible(f.type, x) for f, (_, x) in zip(t, target.fields))
    if pa.types.is_map(t):
        return target.kind == "map" and coercible(t.key_type, target.key) and coercible(t.item_type, target.element)
    if pa.types.is_list(t) or pa.types.is_large_list(t) or pa.types.is_fixed_size_list(t):
        return target.kind == "array" and coercible(t.value_type, target.element)
    if target.kind in ("struct", "map", "array"):
        return False
    source = host_kind(t)
    return source is not None and castable(source, target)


def _cast(c: Expr, t: pa.DataType, target: SqlType) -> Expr:
    """Strict casts (an error where a value does not fit), recursive."""
    if pa.types.is_struct(t):
        return F.when(c.isNotNull(), F.struct(*[_cast(c[f.name], f.type, x).alias(n) for f, (n, x) in zip(t, target.fields)]))
    if pa.types.is_map(t):
        if same(t, target) and _direct(target):
            return c
        return F.map_from_entries(F.transform(F.map_entries(c), lambda e: F.struct(_cast(e["key"], t.key_type, target.key).alias("key"), _cast(e["value"], t.item_type, target.element).alias("value"))))
    if target.kind == "array":
        return c if same(t, target) and _direct(target) else F.transform(c, lambda x: _cast(x, t.value_type, target.element))
    source = host_kind(t)
    if source == "uuid":
        return uuid_text(c)
    if target.kind == "timetz":
        if source == "timestamptz":
            return F.concat(F.date_format(c, "HH:mm:ss.SSSSSS"), F.lit("+00"))
        return F.concat(c.cast("string"), F.lit("+00")) if source == "time" else c.cast("string")
    if source == "bytea" and target.kind not in ("bytea", "geometry"):
        return F.decode(c, "UTF-8")
    if source in ("timestamp", "timestamptz") and target.kind == "time":
        return F.date_format(c, "HH:mm:ss.SSSSSS").cast("time(6)")
    # times with and without zone meet in UTC, whatever the session's zone
    if target.kind == "timestamptz" and source in ("timestamp", "date"):
        return F.concat(c.cast("timestamp_ntz").cast("string"), F.lit("Z")).cast("timestamp")
    if source == "timestamptz" and target.kind in ("timestamp", "date"):
        plain = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.unix_micros(c).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))
        return plain.cast(spark_type(target))
    return c.cast(spark_type(target))


def _direct(t: SqlType) -> bool:
    return all(x.kind not in ("uuid", "timetz") for x in t.walk())


def match(schema: pa.Schema, columns: list[Column], match_by: str) -> list[Expr]:
    """One expression for each column, over a scan's c0, c1, ..."""
    names = [f.name for f in schema]
    if match_by == "position":
        if len(names) != len(columns):
            raise FerryError(f"column count mismatch between table and parquet file. parquet file has {len(names)} columns, but table has {len(columns)} columns")
        where = list(range(len(columns)))
    else:
        for c in columns:
            if c.name not in names:
                raise FerryError(f'column "{c.name}" is not found in parquet file')
        where = [names.index(c.name) for c in columns]
    out = []
    for c, k in zip(columns, where):
        t = schema.field(k).type
        if not coercible(t, c.type):
            raise FerryError(f'type mismatch for column "{c.name}" between table and parquet file.\n\ntable has "{c.type}"\n\nparquet file has "{t}"')
        value = to_declared(_cast(F.col(f"c{k}"), t, c.type), c.type)
        if c.not_null:
            value = F.when(value.isNull(), F.raise_error(F.lit(f'null value in column "{c.name}" violates not-null constraint')).cast(spark_type(c.type))).otherwise(value)
        out.append(value.alias(c.name, metadata={"sql_type": str(c.type)}))
    return out
