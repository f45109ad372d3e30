"""Queries over rules: error texts, counts, sizes and policies, with the rows they must give."""

from __future__ import annotations

import io
import re
from collections.abc import Callable

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colferry.errors import FerryError
from colferry.functions.footer import inspect
from colferry.operators.access import ROLES, AccessPolicy
from colferry.operators.copy_from import copy_from, copy_from_program
from colferry.operators.copy_to import copy_to, select_relation
from colferry.options import CopyFromOptions, CopyToOptions
from colferry.plans.copy_sql import ENABLED, Session
from colferry.queries import query, relation_of
from colferry.scratch import Scratch
from colferry.sources.scan import open_fs
from colferry.sources.uri import list_files, parse_uri
from colferry.types import Column, Relation, SqlType

LIMITED = AccessPolicy(False, frozenset(ROLES), allow_programs=True)


def values(rows: list[tuple], names: str) -> str:
    """SQL for literal rows."""
    literal = lambda x: "NULL" if x is None else f"CAST({x} AS BIGINT)" if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) v({names})"


def said(action: Callable[[], object], find: str | None = None, drop: str = "") -> str:
    """The first line of an action's error, or what find finds in it, without the run's own folder."""
    try:
        action()
    except FerryError as e:
        text = str(e)
    except Exception as e:  # an error of a task
        text = str(e)
    else:
        return "no error"
    if find:
        m = re.search(find, text)
        return m[0] if m else text[:200]
    return text.split("\n")[0].replace(drop, "") if drop else text.split("\n")[0]


def cases(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "rule string, said string")


OPTION_ERRORS = [
    ("O2 codec", {"compression": "zip"}, "zip is not a valid compression format. Supported compression formats are uncompressed, snappy, gzip, lz4, lz4_raw, brotli, zstd"),
    ("O4 level without", {"compression": "snappy", "compression_level": 3}, 'compression level is not supported for "snappy" compression'),
    ("O4 level range", {"compression": "zstd", "compression_level": 30}, "valid compression range 1..=22 exceeded."),
    ("O5 row group", {"row_group_size": 0}, "row_group_size must be greater than 0"),
    ("O7 row group bytes", {"row_group_size_bytes": 0}, "row_group_size_bytes must be greater than 0"),
    ("O10 version", {"parquet_version": "v3"}, "unrecognized parquet version: v3. v1 or v2 is supported."),
    ("F1 json", {"field_ids": "{"}, "invalid JSON string for field_ids"),
]


@query(values([(r, s) for r, _, s in OPTION_ERRORS] + [("M3 match_by", "unrecognized match_by method: order"), ("O11 freeze", "no error"), ("R4 format", "csv is not a valid format. Only parquet format is supported.")], "rule, said"))
def rules_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(rule, said(lambda o=o: CopyToOptions.parse(o))) for rule, o, _ in OPTION_ERRORS]
    rows.append(("M3 match_by", said(lambda: CopyFromOptions.parse({"match_by": "order"}))))
    rows.append(("O11 freeze", said(lambda: CopyFromOptions.parse({"freeze": "true"}))))
    rows.append(("R4 format", said(lambda: CopyToOptions.parse({"format": "csv"}))))
    return cases(spark, rows)


@query(values([
    ("C8 scheme", "unrecognized uri ftp://h/x.parquet. It supports local paths, https://, s3://, az:// or gs:// schemes."),
    ("F5 duplicate", 'duplicate field id 1 in "field_ids"'),
    ("F6 unknown", "Field 'zz' in the mapping does not exist in the Arrow schema."),
    ("L3 http", "list operation on http(s) object stores is not supported"),
    ("M10 strict", "no error"),
    ("M4 mismatch", 'type mismatch for column "n_nationkey" between table and parquet file.'),
    ("P1 role", "permission denied to COPY from a file"),
    ("P2 grant", "permission denied for table t"),
    ("S11 column", 'column "zz" of relation "t" does not exist'),
    ("S13 not null", 'null value in column "n_name" of relation "t" violates not-null constraint'),
    ("S14 generated", "COPY FROM parquet with generated columns is not supported"),
    ("S16 row policy", "COPY FROM not supported with row-level security"),
    ("S16 row policy by program", "COPY FROM not supported with row-level security"),
    ("S4 count", "column count mismatch between table and parquet file. parquet file has 3 columns, but table has 1 columns"),
    ("S5 no file", "failed to get object store metadata for uri /none.parquet"),
    ("S5 no match", "no files found that match the pattern /none*.parquet"),
    ("S6 not parquet", "is not a parquet file"),
    ("V8 digits", "30 digits before decimal point, which exceeds max allowed integral digits 29"),
    ("W12 directory", "cannot write to /dir: Is a directory"),
    ("W3 view", 'cannot copy from view "t"'),
], "rule, said"))
def rules_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = Scratch(spark).root.removeprefix("file://")
    df = spark.read.parquet(f"{sf_dir}/nation.parquet")
    path, own = f"{root}/n.parquet", relation_of(df)
    copy_to(df, path)
    fs, _ = open_fs(parse_uri(path))
    with fs.open_output_stream(f"{root}/bad.parquet") as f:
        f.write(b"none of it")
    fs.create_dir(f"{root}/dir")
    wrong = Relation("t", [Column("n_nationkey", SqlType("date")), *own.columns[1:]])
    strict = Relation("t", [own.columns[0], Column("n_name", SqlType("text"), not_null=True), own.columns[2]])
    made = Relation("t", [*own.columns, Column("twice", SqlType("int4"), generated="n_nationkey * 2")])
    guarded = Relation("t", own.columns, row_policy="n_nationkey > 3")
    digits = spark.range(1).select(F.lit("1" * 30).alias("a", metadata={"sql_type": "numeric"}))
    copied = lambda relation=own, uri=path, **more: copy_from(spark, relation, uri, **more).count()
    return cases(spark, [
        ("C8 scheme", said(lambda: parse_uri("ftp://h/x.parquet"))),
        ("F5 duplicate", said(lambda: copy_to(df, path, {"field_ids": '{"n_name": 1, "n_nationkey": 1}'}))),
        ("F6 unknown", said(lambda: copy_to(df, path, {"field_ids": '{"zz": 1}'}))),
        ("L3 http", said(lambda: list_files(spark, "https://h/x*.parquet"))),
        ("M10 strict", said(lambda: copied())),
        ("M4 mismatch", said(lambda: copied(wrong))),
        ("P1 role", said(lambda: copied(policy=AccessPolicy(False, frozenset())))),
        ("P2 grant", said(lambda: copied(policy=AccessPolicy(False, frozenset(ROLES), inserts={})))),
        ("S11 column", said(lambda: copied(columns=["zz"]))),
        ("S13 not null", said(lambda: copied(strict, columns=["n_nationkey", "n_regionkey"], options={"match_by": "name"}))),
        ("S14 generated", said(lambda: copied(made))),
        ("S16 row policy", said(lambda: copied(guarded, policy=LIMITED))),
        ("S16 row policy by program", said(lambda: copy_from_program(spark, guarded, f"cat {path}", policy=LIMITED))),
        ("S4 count", said(lambda: copied(Relation("t", own.columns[:1])))),
        ("S5 no file", said(lambda: copied(uri=f"{root}/none.parquet"), drop=root)),
        ("S5 no match", said(lambda: copied(uri=f"{root}/none*.parquet"), drop=root)),
        ("S6 not parquet", said(lambda: copied(uri=f"{root}/bad.parquet"), "is not a parquet file")),
        ("V8 digits", said(lambda: copy_to(digits, f"{root}/d.parquet"), r"30 digits before [a-z ,]*29")),
        ("W12 directory", said(lambda: copy_to(df, f"{root}/dir", {"format": "parquet"}), drop=root)),
        ("W3 view", said(lambda: select_relation(Relation("t", own.columns, "view"), df, None))),
    ])


@query(
    "SELECT * FROM (SELECT 'R6 off' AS rule, CAST(-1 AS BIGINT) AS n UNION ALL SELECT 'R7 nested', count(*) FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'R8 to', count(*) FROM nation "
    "UNION ALL SELECT 'R8 from', count(*) FROM nation WHERE n_nationkey > 5 UNION ALL SELECT 'W14 empty', CAST(0 AS BIGINT) UNION ALL SELECT 'W14 columns', CAST(3 AS BIGINT)) v"
)
def rules_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = Scratch(spark).root
    df = spark.read.parquet(f"{sf_dir}/nation.parquet")
    df.createOrReplaceTempView("rules_nation")
    session = Session(spark)
    rows = [("R8 to", session.sql(f"COPY rules_nation TO '{root}/n.parquet'"))]
    session.declare("rules_in", "n_nationkey int4, n_name text, n_regionkey int4")
    rows.append(("R8 from", session.sql(f"COPY rules_in FROM '{root}/n.parquet' WHERE n_nationkey > 5")))
    spark.catalog.dropTempView("rules_in")
    inner = copy_from(spark, relation_of(df), f"{root}/n.parquet")
    inner.createOrReplaceTempView("rules_inner")
    rows.append(("R7 nested", session.sql(f"COPY (SELECT * FROM rules_inner WHERE n_regionkey = 1) TO '{root}/m.parquet'")))
    spark.conf.set(ENABLED, "off")
    try:
        rows.append(("R6 off", -1 if said(lambda: session.sql(f"COPY rules_nation TO '{root}/x.parquet'")).startswith("COPY is off") else 0))
    finally:
        spark.conf.unset(ENABLED)
    rows.append(("W14 empty", session.sql(f"COPY (SELECT * FROM rules_nation WHERE n_nationkey < 0) TO '{root}/e.parquet'")))
    rows.append(("W14 columns", inspect(spark, "schema", f"{root}/e.parquet").where("name LIKE 'n_%'").count()))
    return spark.createDataFrame(rows, "rule string, n long")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey < 5")
def policy_on_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row policies hold in COPY (query) TO as well."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    rows.createOrReplaceTempView("policy_customer")
    session, uri = Session(spark, LIMITED), f"{Scratch(spark).root}/c.parquet"
    session.relations["policy_customer"] = Relation("policy_customer", relation_of(rows).columns, row_policy="c_nationkey < 5")
    session.sql(f"COPY (SELECT c_custkey, c_name FROM policy_customer) TO '{uri}'")
    return copy_from(spark, relation_of(rows.select("c_custkey", "c_name")), uri)


@query("SELECT c_custkey, '\\x' || lower(hex(encode(c_name))) AS e, '(' || c_custkey || ',' || c_nationkey || ')' AS p, CAST(36 AS INTEGER) AS n FROM customer")
def host_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("host_customer")
    session, uri = Session(spark), f"{Scratch(spark).root}/h.parquet"
    session.sql(f"COPY (SELECT c_custkey, chr(92) || 'x' || encode(CAST(c_name AS BINARY), 'hex') AS e, point(c_custkey, c_nationkey) AS p, length(gen_random_uuid()) AS n FROM host_customer) TO '{uri}'")
    return copy_from(spark, Relation("t", [Column("c_custkey", SqlType("int8")), Column("e", SqlType("text")), Column("p", SqlType("text")), Column("n", SqlType("int4"))]), uri)


@query("SELECT CAST(5 AS BIGINT) AS row_groups, CAST(10 AS BIGINT) AS num_rows")
def row_groups_of_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 rows by two: 5 row groups."""
    uri = f"{Scratch(spark).root}/t.parquet"
    copy_to(spark.range(10).toDF("a"), uri, {"row_group_size": 2})
    return inspect(spark, "file_metadata", uri).select(F.col("num_row_groups").alias("row_groups"), "num_rows")


@query("SELECT 'a' AS kind, CAST(1000000 AS BIGINT) AS num_rows, true AS within")
def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A million numbers in one task at 1 MB: all rows, and files that are closed soon after they reach the size."""
    root = Scratch(spark).root
    copy_to(spark.range(0, 1_000_000, 1, 1).select(F.col("id").cast("int").alias("a")), f"{root}/s.parquet", {"file_size_bytes": "1MB"})
    files = list_files(spark, f"{root}/s.parquet/data_*.parquet")
    sizes = sorted(size for _, size in files)
    within = len(files) > 1 and all(1 << 20 <= s < 2 << 20 for s in sizes[1:]) and sizes[0] < 2 << 20
    fs, _ = open_fs(parse_uri(files[0][0]))
    rows = sum(pq.read_metadata(open_fs(parse_uri(u))[1], filesystem=fs).num_rows for u, _ in files)
    return spark.createDataFrame([("a", rows, within)], "kind string, num_rows long, within boolean")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def stream_copy_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream whose batches are split targets."""
    from colferry.streaming.copy_stream import copy_stream_to, read_stream

    root, df = Scratch(spark).root, spark.read.parquet(f"{sf_dir}/nation.parquet")
    copy_to(df, f"{root}/in/f.parquet")
    copy_stream_to(read_stream(spark, relation_of(df), f"{root}/in"), f"{root}/out", f"{root}/check", {"file_size_bytes": "1MB"}, once=True).awaitTermination()
    return copy_from(spark, relation_of(df), f"{root}/out/**/data_*.parquet")


@query("SELECT region.*, CAST(5 AS BIGINT) AS rows_said FROM region")
def stdout_to_stdin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COPY TO STDOUT, whose bytes COPY FROM STDIN takes."""
    df = spark.read.parquet(f"{sf_dir}/region.parquet")
    df.createOrReplaceTempView("pipe_region")
    session, pipe = Session(spark), io.BytesIO()
    n = session.sql("COPY pipe_region TO STDOUT (format parquet)", stdout=pipe)
    session.declare("pipe_in", "r_regionkey int4, r_name text")
    pipe.seek(0)
    from colferry.plans.copy_sql import parse_copy

    return session.read(parse_copy("COPY pipe_in FROM STDIN (format parquet)"), pipe).withColumn("rows_said", F.lit(n).cast("long"))
