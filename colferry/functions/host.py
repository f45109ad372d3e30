"""Scalar functions of the host database's dialect that Spark lacks or names otherwise, for COPY queries."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from colferry.functions.geo import wkb

_MARK = "colferry_functions"
_SQL = {
    "gen_random_uuid": "() RETURNS STRING RETURN uuid()",
    "point": "(x DOUBLE, y DOUBLE) RETURNS STRING RETURN concat('(', regexp_replace(CAST(x AS STRING), '[.]0$', ''), ',', regexp_replace(CAST(y AS STRING), '[.]0$', ''), ')')",
    "ferry_to_hex": "(b BINARY) RETURNS STRING RETURN lower(hex(b))",
    "ferry_to_base64": "(b BINARY) RETURNS STRING RETURN base64(b)",
    # zero bytes and those beyond ASCII become \\nnn, backslashes are doubled
    "ferry_to_escape": r"""(b BINARY) RETURNS STRING RETURN array_join(transform(sequence(1, greatest(length(b), 1)), i -> CASE WHEN length(b) = 0 THEN '' ELSE
        CASE WHEN hex(substring(b, i, 1)) = '5C' THEN repeat(chr(92), 2)
             WHEN hex(substring(b, i, 1)) = '00' OR hex(substring(b, i, 1)) >= '80' THEN concat(chr(92), lpad(conv(hex(substring(b, i, 1)), 16, 8), 3, '0'))
             ELSE decode(substring(b, i, 1), 'UTF-8') END END), '')""",
}


def register(spark: SparkSession) -> None:
    """Once a session: SQL functions, which stay in the plan, and st_geomfromtext (by Arrow batches)."""
    if spark.conf.get(f"spark.{_MARK}", None):
        return
    for name, body in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")

    @F.pandas_udf("binary")
    def geometry(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else wkb(t))

    spark.udf.register("st_geomfromtext", geometry)
    spark.conf.set(f"spark.{_MARK}", "true")


_CALL = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|\b(encode)\s*\(", re.S | re.I)
_FORMAT = re.compile(r",\s*'(escape|hex|base64)'\s*$", re.I)


def rewrite(text: str) -> str:
    """encode(b, 'escape' | 'hex' | 'base64') by its own function; with another format it is Spark's."""
    at = 0
    while m := _CALL.search(text, at):
        at = m.end()
        if not m[1]:
            continue
        depth, k = 1, at
        while k < len(text) and depth:
            if text[k] == "'":
                k = text.find("'", k + 1)
                if k < 0:
                    return text
            depth += {"(": 1, ")": -1}.get(text[k], 0)
            k += 1
        inner = text[at : k - 1]
        if form := _FORMAT.search(inner):
            text = f"{text[: m.start()]}ferry_to_{form[1].lower()}({inner[: form.start()]}){text[k:]}"
            at = m.start() + len(f"ferry_to_{form[1]}(")
    return text
