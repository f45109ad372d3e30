"""COPY FROM: files, globs, byte streams or a program's output into a declared relation."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from collections.abc import Mapping
from functools import reduce
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colferry.errors import FerryError
from colferry.operators.access import ALLOW_ALL, AccessPolicy
from colferry.operators.match import match
from colferry.options import CopyFromOptions
from colferry.scratch import Scratch
from colferry.sources.scan import file_groups, open_fs, scan
from colferry.sources.uri import parse_uri, resolve
from colferry.types import TYPE_KEY, Relation, spark_type

STREAM_BYTES = 65_536


def copy_from(
    spark: SparkSession, relation: Relation, uri: str, options: Mapping[str, object] | CopyFromOptions | None = None,
    columns: list[str] | None = None, where: str | None = None, policy: AccessPolicy = ALLOW_ALL,
) -> DataFrame:
    """The relation's rows that the files hold, lazily.

    Every file is checked against the relation and cast by its own footer's schema; files of one schema are one scan,
    so that filters and column pruning reach it. Columns not listed are null; generated ones are computed.
    """
    policy.check_target("from", parse_uri(uri))
    return _rows_of(spark, relation, uri, options, columns, where, policy)


def _rows_of(
    spark: SparkSession, relation: Relation, uri: str, options: Mapping[str, object] | CopyFromOptions | None = None,
    columns: list[str] | None = None, where: str | None = None, policy: AccessPolicy = ALLOW_ALL,
) -> DataFrame:
    """What copy_from does once the source is allowed."""
    parsed = options if isinstance(options, CopyFromOptions) else CopyFromOptions.parse(options)
    if relation.row_policy and not policy.superuser:
        raise FerryError("COPY FROM not supported with row-level security", "Use INSERT statements instead.")
    for c in columns or ():
        if relation.column(c) is None:
            raise FerryError(f'column "{c}" of relation "{relation.name}" does not exist')
    generated = [c for c in relation.columns if c.generated]
    if generated and parsed.match_by == "position" and columns is None:
        raise FerryError("COPY FROM parquet with generated columns is not supported", 'Try "match_by \'name\'", or list the columns.')
    taken = [relation.column(c) for c in columns] if columns else [c for c in relation.columns if not c.generated]
    if any(c.generated for c in taken):
        raise FerryError(f'column "{next(c.name for c in taken if c.generated)}" is a generated column', "Generated columns cannot be used in COPY.")
    policy.check_table("from", relation.name, [c.name for c in taken])
    spark.conf.set("spark.sql.timeType.enabled", "true")  # times of day are read lazily, too
    parts = [scan(spark, g).select(*match(g.schema, taken, parsed.match_by)) for g in file_groups(spark, resolve(spark, uri))]
    rows = reduce(DataFrame.unionAll, parts)
    names = {c.name for c in taken}
    missing = [c for c in relation.columns if c.name not in names and not c.generated]
    for c in missing:
        if c.not_null:
            raise FerryError(f'null value in column "{c.name}" of relation "{relation.name}" violates not-null constraint')
    rows = rows.withColumns({c.name: F.lit(None).cast(spark_type(c.type)) for c in missing}) if missing else rows
    rows = rows.withColumns({c.name: F.expr(c.generated).cast(spark_type(c.type)) for c in generated}) if generated else rows
    rows = rows.select(*[F.col(f"`{c.name.replace('`', '``')}`").alias(c.name, metadata={TYPE_KEY: str(c.type)}) for c in relation.columns])
    return rows.where(where) if where else rows


def copy_from_stream(spark: SparkSession, relation: Relation, stream: BinaryIO, options: Mapping[str, object] | None = None, policy: AccessPolicy = ALLOW_ALL, **more) -> DataFrame:
    """From bytes, spooled to the shared folder in chunks of STREAM_BYTES, as the rows are read later."""
    uri = f"{Scratch(spark).root}/in.parquet"
    fs, path = open_fs(parse_uri(uri))
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as spool:
        shutil.copyfileobj(stream, spool, STREAM_BYTES)
    return _rows_of(spark, relation, uri, options, policy=policy, **more)


def copy_from_program(spark: SparkSession, relation: Relation, command: str, options: Mapping[str, object] | None = None, policy: AccessPolicy = ALLOW_ALL, **more) -> DataFrame:
    policy.check_target("from", program=True)
    with tempfile.TemporaryFile() as spool:
        if code := subprocess.run(command, shell=True, stdout=spool, check=False).returncode:
            raise FerryError(f'program "{command}" failed with exit code {code}')
        spool.seek(0)
        return copy_from_stream(spark, relation, spool, options, policy, **more)
