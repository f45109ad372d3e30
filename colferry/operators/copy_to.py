"""COPY TO: a query, a table or a DataFrame to a file, split files, a byte stream or a program."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from collections.abc import Mapping
from typing import BinaryIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colferry.errors import FerryError
from colferry.operators.access import ALLOW_ALL, AccessPolicy
from colferry.operators.sink import write_parquet
from colferry.options import CopyToOptions
from colferry.scratch import Scratch
from colferry.sources.scan import open_fs
from colferry.sources.uri import parse_uri
from colferry.types import Relation

STREAM_BYTES = 65_536
_QUERY_HINT = "Try the COPY (SELECT ...) TO variant."


def select_relation(relation: Relation, rows: DataFrame, columns: list[str] | None, policy: AccessPolicy = ALLOW_ALL) -> DataFrame:
    """Rows of a table for COPY table[(columns)] TO, under its row policy."""
    kind = relation.kind
    if kind in ("view", "foreign table", "sequence", "partitioned table") or kind == "materialized view" and not relation.populated:
        hint = None if kind == "sequence" else _QUERY_HINT
        raise FerryError(f'cannot copy from {"unpopulated " if kind == "materialized view" else ""}{kind} "{relation.name}"', hint)
    for c in columns or ():
        if relation.column(c) is None:
            raise FerryError(f'column "{c}" does not exist')
    names = columns or [c.name for c in relation.columns]
    policy.check_table("to", relation.name, names)
    if relation.row_policy and not policy.superuser:
        rows = rows.where(relation.row_policy)
    return rows.select(*[F.col(f"`{n.replace('`', '``')}`").alias(n, metadata={"sql_type": str(relation.column(n).type)}) for n in names])


def copy_to(df: DataFrame, uri: str, options: Mapping[str, object] | CopyToOptions | None = None, policy: AccessPolicy = ALLOW_ALL) -> int:
    """Writes df; returns the number of rows."""
    target = parse_uri(uri)
    policy.check_target("to", target)
    return write_parquet(df, uri, options if isinstance(options, CopyToOptions) else CopyToOptions.parse(options, uri))


def copy_to_stream(df: DataFrame, stream: BinaryIO, options: Mapping[str, object] | None = None) -> int:
    """The file as bytes, in chunks of STREAM_BYTES; it is written to the shared folder first."""
    parsed = CopyToOptions.parse(options)
    if parsed.file_size_bytes:
        raise FerryError("file_size_bytes is not supported for streams and programs")
    uri = f"{Scratch(df.sparkSession).root}/out.parquet"
    rows = write_parquet(df, uri, parsed)
    fs, path = open_fs(parse_uri(uri))
    with fs.open_input_stream(path) as f:
        shutil.copyfileobj(f, stream, STREAM_BYTES)
    fs.delete_file(path)
    return rows


def copy_to_program(df: DataFrame, command: str, options: Mapping[str, object] | None = None, policy: AccessPolicy = ALLOW_ALL) -> int:
    policy.check_target("to", program=True)
    with tempfile.TemporaryFile() as spool:
        rows = copy_to_stream(df, spool, options)
        spool.seek(0)
        if code := subprocess.run(command, shell=True, stdin=spool, check=False).returncode:
            raise FerryError(f'program "{command}" failed with exit code {code}')
    return rows
