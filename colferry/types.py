"""Declared column types: how each one looks in Spark, in Arrow and in Parquet."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import types as T

from colferry.errors import FerryError

#: Field metadata that names a declared type which its Spark type does not show.
TYPE_KEY = "sql_type"
MAX_PRECISION, DEFAULT_SCALE = 38, 9

_ALIASES = {
    "boolean": "bool", "smallint": "int2", "short": "int2", "int": "int4", "integer": "int4", "bigint": "int8", "long": "int8",
    "real": "float4", "float": "float4", "double": "float8", "double precision": "float8", "decimal": "numeric", "string": "text",
    "binary": "bytea", "character varying": "varchar", "character": "bpchar", "char": "bpchar", '"char"': "char1",
    "timestamp with time zone": "timestamptz", "timestamp without time zone": "timestamp", "timestamp_ntz": "timestamp", "time with time zone": "timetz",
    "bit varying": "varbit",
}
_SIMPLE = {
    "bool": T.BooleanType(), "int2": T.ShortType(), "int4": T.IntegerType(), "int8": T.LongType(), "float4": T.FloatType(), "float8": T.DoubleType(),
    "text": T.StringType(), "bytea": T.BinaryType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(),
    "oid": T.LongType(), "uuid": T.StringType(), "json": T.StringType(), "jsonb": T.StringType(), "char1": T.StringType(), "geometry": T.BinaryType(),
    "timetz": T.StringType(),
}
_ARROW = {
    "bool": pa.bool_(), "int2": pa.int16(), "int4": pa.int32(), "int8": pa.int64(), "float4": pa.float32(), "float8": pa.float64(), "text": pa.string(),
    "bytea": pa.binary(), "date": pa.date32(), "timestamp": pa.timestamp("us"), "timestamptz": pa.timestamp("us", "UTC"), "time": pa.time64("us"), "timetz": pa.time64("us"),
    "oid": pa.uint32(), "uuid": pa.uuid(), "json": pa.json_(), "jsonb": pa.json_(), "char1": pa.string(), "geometry": pa.binary(),
}
#: Kinds that Spark's own writer would annotate differently.
ARROW_ONLY = frozenset({"uuid", "json", "jsonb", "oid", "timetz", "geometry"})


@dataclass(frozen=True)
class SqlType:
    """A declared type. Kinds without a Parquet counterpart (enum, varchar, bit, interval, ...) travel as text."""

    kind: str
    args: tuple = ()
    fields: tuple[tuple[str, SqlType], ...] = ()
    element: SqlType | None = None
    key: SqlType | None = None

    def __str__(self) -> str:
        if self.kind == "array":
            return f"{self.element}[]"
        if self.kind == "map":
            return f"map<{self.key},{self.element}>"
        if self.kind == "struct":
            return f"struct<{', '.join(f'{n} {t}' for n, t in self.fields)}>"
        if self.kind == "enum":
            return f"enum({', '.join(map(repr, self.args))})"
        return self.kind + (f"({','.join(map(str, self.args))})" if self.args else "")

    @property
    def as_text(self) -> bool:
        return self.kind not in ("array", "map", "struct", "numeric", "time") and self.kind not in _SIMPLE or self.kind == "numeric" and bool(self.args) and self.args[0] > MAX_PRECISION

    def walk(self) -> Iterator[SqlType]:
        yield self
        for t in (*(t for _, t in self.fields), self.element, self.key):
            if t is not None:
                yield from t.walk()


@dataclass(frozen=True)
class Column:
    name: str
    type: SqlType
    not_null: bool = False
    generated: str | None = None


@dataclass
class Relation:
    """A table as COPY sees it. kind: table, view, materialized view, foreign table, sequence or partitioned table."""

    name: str
    columns: list[Column] = field(default_factory=list)
    kind: str = "table"
    row_policy: str | None = None
    populated: bool = True

    @staticmethod
    def of(name: str, ddl: str, **more) -> Relation:
        """From `a int4 not null, b text, c int4 generated (a + 1)`."""
        columns = []
        for part in split_top(ddl):
            m = re.fullmatch(r'\s*(?:"((?:[^"]|"")+)"|(\w+))\s+(.*?)(\s+not\s+null)?(?:\s+generated\s*\((.*)\))?\s*', part, re.S | re.I)
            if not m:
                raise FerryError(f"cannot read column definition {part.strip()}")
            columns.append(Column((m[1] or "").replace('""', '"') or m[2].lower(), parse_type(m[3]), bool(m[4]), m[5]))
        return Relation(name, columns, **more)

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)


def split_top(text: str, separator: str = ",") -> list[str]:
    """Parts between separators outside brackets and quotes."""
    out, depth, quote, at = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "(<[":
            depth += 1
        elif c in ")>]":
            depth -= 1
        elif c == separator and not depth:
            out.append(text[at:i])
            at = i + 1
    return [x for x in [*out, text[at:]] if x.strip()]


def parse_type(text: str) -> SqlType:
    text = text.strip()
    if text.endswith("[]"):
        return SqlType("array", element=parse_type(text[:-2]))
    if m := re.fullmatch(r"array\s*<(.*)>", text, re.S | re.I):
        return SqlType("array", element=parse_type(m[1]))
    if m := re.fullmatch(r"map\s*<(.*)>", text, re.S | re.I):
        k, v = split_top(m[1])
        return SqlType("map", key=parse_type(k), element=parse_type(v))
    if m := re.fullmatch(r"struct\s*<(.*)>", text, re.S | re.I):
        fields = []
        for part in split_top(m[1]):
            name, kind = re.fullmatch(r'\s*("(?:[^"]|"")+"|\w+)(?:\s*:\s*|\s+)(.*)', part, re.S).groups()
            fields.append((name.strip('"').replace('""', '"'), parse_type(kind)))
        return SqlType("struct", fields=tuple(fields))
    if m := re.fullmatch(r"enum\s*\((.*)\)", text, re.S | re.I):
        return SqlType("enum", tuple(x.strip().strip("'").replace("''", "'") for x in split_top(m[1])))
    m = re.fullmatch(r'("char"|[a-z_][\w ]*?)\s*(?:\(([^)]*)\))?(\s+with(?:out)?\s+time\s+zone)?', text, re.S | re.I)
    if not m:
        raise FerryError(f"cannot read type {text}")
    kind = (m[1] + (m[3] or "")).lower()
    kind = _ALIASES.get(re.sub(r"\s+", " ", kind), kind)
    args = tuple(int(a) if re.fullmatch(r"\s*-?\d+\s*", a) else a.strip() for a in (m[2] or "").split(",") if a.strip())
    return SqlType(kind, args)


def normalize_numeric(precision: int, scale: int) -> tuple[int, int]:
    """Precision and scale as a decimal has them: neither negative, and the scale within the precision."""
    if scale < 0:
        return precision - scale, 0
    return max(precision, scale), scale


def decimal_of(t: SqlType) -> tuple[int, int]:
    if not t.args:
        return MAX_PRECISION, DEFAULT_SCALE
    return normalize_numeric(t.args[0], t.args[1] if len(t.args) > 1 else 0)


def spark_type(t: SqlType) -> T.DataType:
    if t.kind == "array":
        return T.ArrayType(spark_type(t.element))
    if t.kind == "map":
        return T.MapType(spark_type(t.key), spark_type(t.element))
    if t.kind == "struct":
        return T.StructType([T.StructField(n, spark_type(x)) for n, x in t.fields])
    if t.as_text:
        return T.StringType()
    if t.kind == "numeric":
        return T.DecimalType(*decimal_of(t))
    if t.kind == "time":
        return T.TimeType(6)
    return _SIMPLE[t.kind]


def arrow_type(t: SqlType, ids: object = None) -> pa.DataType:
    """The exported type; all fields are nullable, but for map keys."""
    if t.kind == "array":
        return pa.list_(pa.field("element", arrow_type(t.element)))
    if t.kind == "map":
        return pa.map_(arrow_type(t.key), arrow_type(t.element))
    if t.kind == "struct":
        return pa.struct([pa.field(n, arrow_type(x)) for n, x in t.fields])
    if t.as_text:
        return pa.string()
    if t.kind == "numeric":
        return pa.decimal128(*decimal_of(t))
    return _ARROW[t.kind]


def of_spark(f: T.StructField) -> SqlType:
    """The declared type of a Spark field: from its metadata, or what its Spark type says."""
    if f.metadata and TYPE_KEY in f.metadata:
        return parse_type(f.metadata[TYPE_KEY])
    return _of_spark(f.dataType)


def _of_spark(d: T.DataType) -> SqlType:
    if isinstance(d, T.ArrayType):
        return SqlType("array", element=_of_spark(d.elementType))
    if isinstance(d, T.MapType):
        return SqlType("map", key=_of_spark(d.keyType), element=_of_spark(d.valueType))
    if isinstance(d, T.StructType):
        return SqlType("struct", fields=tuple((f.name, of_spark(f)) for f in d))
    if isinstance(d, T.DecimalType):
        return SqlType("numeric", (d.precision, d.scale))
    if isinstance(d, T.ByteType):
        return SqlType("int2")
    if isinstance(d, T.TimeType):
        return SqlType("time")
    names = {T.BooleanType: "bool", T.ShortType: "int2", T.IntegerType: "int4", T.LongType: "int8", T.FloatType: "float4", T.DoubleType: "float8", T.BinaryType: "bytea", T.DateType: "date", T.TimestampNTZType: "timestamp", T.TimestampType: "timestamptz"}
    # what has no counterpart travels as text
    return SqlType(next((n for k, n in names.items() if isinstance(d, k)), "text" if isinstance(d, T.StringType) else "other"))


def spark_field(c: Column) -> T.StructField:
    return T.StructField(c.name, spark_type(c.type), True, {TYPE_KEY: str(c.type)})
