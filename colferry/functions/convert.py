"""Value conversions as column expressions, with the checks that refuse what cannot be written or read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colferry.types import DEFAULT_SCALE, MAX_PRECISION, SqlType, decimal_of, spark_type

DAY = 86_400_000_000
INTEGRAL_DIGITS = MAX_PRECISION - DEFAULT_SCALE


def guard(bad: Column, message: Column | str, value: Column) -> Column:
    """The value, or an error where bad holds."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(text)).otherwise(value)


def days(c: Column) -> Column:
    return F.unix_date(c)


def date_of_days(c: Column) -> Column:
    return F.date_from_unix_date(c)


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a timestamp with zone."""
    return F.unix_micros(c)


def time_micros(text: Column) -> Column:
    """`HH:MM:SS[.ffffff]` as microseconds of the day."""
    part = lambda k: F.regexp_extract(text, r"^(\d+):(\d+)(?::(\d+)(?:\.(\d+))?)?", k)
    number = lambda k: F.coalesce(F.nullif(part(k), F.lit("")).cast("long"), F.lit(0))
    fraction = F.rpad(F.substring(part(4), 1, 6), 6, "0").cast("long")
    return F.when(text.isNotNull(), (number(1) * 3600 + number(2) * 60 + number(3)) * 1_000_000 + fraction)


def timetz_micros(text: Column) -> Column:
    """`HH:MM:SS±HH[:MM[:SS]]` as microseconds of the day in UTC; the offset itself is lost."""
    zone = lambda k: F.coalesce(F.nullif(F.regexp_extract(text, r"([+-])(\d{1,2})(?::?(\d{2}))?(?::(\d{2}))?$", k), F.lit("")).cast("long"), F.lit(0))
    minus = F.regexp_extract(text, r"([+-])\d{1,2}(?::?\d{2})?(?::\d{2})?$", 1) == "-"
    offset = (zone(2) * 3600 + zone(3) * 60 + zone(4)) * F.when(minus, -1).otherwise(1)
    return F.pmod(time_micros(text) - offset * 1_000_000, F.lit(DAY))


def time_text(us: Column, zone: str = "") -> Column:
    """Microseconds of the day as `HH:MM:SS[.ffffff]`."""
    seconds = F.floor(us / 1_000_000)
    rest = us - seconds * 1_000_000
    tail = F.when(rest > 0, F.concat(F.lit("."), F.rtrim(F.lpad(rest.cast("string"), 6, "0"), F.lit("0")))).otherwise(F.lit(""))
    two = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
    return F.concat(two(F.floor(seconds / 3600)), F.lit(":"), two(F.floor(seconds % 3600 / 60)), F.lit(":"), two(seconds % 60), tail, F.lit(zone))


def numeric(c: Column, t: SqlType) -> Column:
    """A decimal of the declared precision and scale; without one, (38, 9), and digits that don't fit are errors."""
    p, s = decimal_of(t)
    text = F.trim(c.cast("string"))
    special = F.lower(text).rlike(r"^[+-]?(nan|inf|infinity)$")
    refuse = "Special numeric values like NaN, Inf, -Inf are not allowed for numeric type during copy to parquet"
    if t.args:
        scale = t.args[1] if len(t.args) > 1 else 0
        value = F.round(c.cast(f"decimal({MAX_PRECISION},{min(MAX_PRECISION - 1, max(s, DEFAULT_SCALE))})"), scale).cast(f"decimal({p},{s})")
        return guard(special, refuse, value)
    plain = F.regexp_replace(text, r"^[+-]?0*", "")
    whole = F.length(F.regexp_extract(plain, r"^(\d*)", 1))
    after = F.length(F.regexp_extract(plain, r"\.(\d*?)0*$", 1))
    too_many = lambda n, where, most: F.concat(F.lit("numeric value contains "), n.cast("string"), F.lit(f" digits {where} decimal point, which exceeds max allowed {'integral' if where == 'before' else 'decimal'} digits {most} during copy to parquet"))
    value = guard(after > DEFAULT_SCALE, too_many(after, "after", DEFAULT_SCALE), c.cast(f"decimal({p},{s})"))
    value = guard(whole > INTEGRAL_DIGITS, too_many(whole, "before", INTEGRAL_DIGITS), value)
    return guard(special, refuse, value)


def oid(c: Column) -> Column:
    return guard((c < 0) | (c > 0xFFFFFFFF), F.concat(F.lit('value "'), c.cast("string"), F.lit('" is out of range for type oid')), c.cast("long"))


def json_text(c: Column) -> Column:
    """The text, if it is JSON."""
    return guard(c.isNotNull() & F.try_parse_json(c).isNull(), F.concat(F.lit("invalid input syntax for type json: "), c), c)


def jsonb_text(c: Column) -> Column:
    """Compact form, keys in order."""
    parsed = F.try_parse_json(c)
    return guard(c.isNotNull() & parsed.isNull(), F.concat(F.lit("invalid input syntax for type json: "), c), F.to_json(parsed))


def uuid_bytes(c: Column) -> Column:
    return guard(c.isNotNull() & ~c.rlike(r"^[0-9a-fA-F]{8}(-?[0-9a-fA-F]{4}){3}-?[0-9a-fA-F]{12}$"), F.concat(F.lit('invalid input syntax for type uuid: "'), c, F.lit('"')), F.unhex(F.translate(c, "-", "")))


def uuid_text(c: Column) -> Column:
    h = F.lower(F.hex(c))
    return F.when(c.isNotNull(), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def from_text(c: Column, t: SqlType) -> Column:
    """What a declared type's input accepts of a text: enum labels, bits, lengths."""
    kind, args = t.kind, t.args
    if kind == "enum":
        return guard(c.isNotNull() & ~c.isin(*args), F.concat(F.lit("invalid input value for enum: "), F.lit('"'), c, F.lit('"')), c)
    if kind in ("bit", "varbit"):
        digit = F.regexp_extract(c, "([^01])", 1)
        out = guard(F.length(digit) > 0, F.concat(F.lit('"'), digit, F.lit('" is not a valid binary digit')), c)
        if kind == "bit":
            n = args[0] if args else 1
            return guard(F.length(c) != n, F.concat(F.lit("bit string length "), F.length(c).cast("string"), F.lit(f" does not match type bit({n})")), out)
        return guard(F.length(c) > args[0], f"bit string too long for type bit varying({args[0]})", out) if args else out
    if kind == "varchar" and args:
        return guard(F.length(F.rtrim(c)) > args[0], f"value too long for type character varying({args[0]})", F.substring(c, 1, args[0]))
    if kind == "bpchar":
        n = args[0] if args else 1
        return guard(F.length(F.rtrim(c)) > n, f"value too long for type character({n})", F.rpad(c, n, " "))
    if kind == "char1":
        return F.substring(c, 1, 1)
    if kind == "name":
        return F.substring(c, 1, 63)
    return c


def _nested(c: Column, t: SqlType, leaf) -> Column:
    if t.kind == "array":
        return F.transform(c, lambda x: _nested(x, t.element, leaf))
    if t.kind == "struct":
        return F.when(c.isNotNull(), F.struct(*[_nested(c[n], x, leaf).alias(n) for n, x in t.fields]))
    if t.kind == "map":
        return F.map_from_entries(F.transform(F.map_entries(c), lambda e: F.struct(_nested(e["key"], t.key, leaf).alias("key"), _nested(e["value"], t.element, leaf).alias("value"))))
    return leaf(c, t)


PLAIN = frozenset("bool int2 int4 int8 float4 float8 text bytea date timestamp timestamptz time geometry".split())


def plain(t: SqlType) -> bool:
    return all(x.kind in PLAIN or x.kind in ("array", "struct", "map") or x.kind == "numeric" and x.args and not x.as_text for x in t.walk())


def _store(c: Column, t: SqlType) -> Column:
    if t.kind == "numeric" and not t.as_text:
        return numeric(c, t)
    if t.kind == "oid":
        return oid(c)
    if t.kind == "json":
        return json_text(c)
    if t.kind == "jsonb":
        return jsonb_text(c)
    if t.kind == "uuid":
        return uuid_bytes(c)
    if t.kind == "timetz":
        return timetz_micros(c)
    if t.kind == "char1":
        return F.substring(c, 1, 1)
    if t.as_text:
        return c.cast("string")
    return c.cast(spark_type(t))


def _load(c: Column, t: SqlType) -> Column:
    if t.kind in ("json", "jsonb"):
        return json_text(c)
    if t.kind == "oid":
        return oid(c)
    if t.as_text or t.kind == "char1":
        return from_text(c, t)
    return c


def to_storage(c: Column, t: SqlType) -> Column:
    """From how Spark holds a declared type to what is written; a type that needs nothing is left alone."""
    return c if plain(t) and not any(x.kind == "numeric" for x in t.walk()) else _nested(c, t, _store)


def to_declared(c: Column, t: SqlType) -> Column:
    """Checks on ingest, after the cast to the declared type's Spark type."""
    return c if plain(t) else _nested(c, t, _load)
