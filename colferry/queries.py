"""Queries over the driver's tables, each through COPY, and the SQL that gives the same rows."""

from __future__ import annotations

import io
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colferry.functions.footer import inspect, inspect_many, register
from colferry.operators.access import ROLES, AccessPolicy
from colferry.operators.copy_from import copy_from, copy_from_program, copy_from_stream
from colferry.operators.copy_to import copy_to, copy_to_program, copy_to_stream, select_relation
from colferry.plans.copy_sql import Session, parse_copy
from colferry.scratch import Scratch
from colferry.sources.uri import list_files
from colferry.streaming.copy_stream import copy_stream_to, read_stream
from colferry.types import Column, Relation, SqlType, of_spark, parse_type

Query = Callable[[SparkSession, str], DataFrame]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for t in names or TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def relation_of(df: DataFrame, name: str = "t") -> Relation:
    return Relation(name, [Column(f.name, of_spark(f)) for f in df.schema])


def there_and_back(spark: SparkSession, df: DataFrame, options: dict | None = None, name: str = "data.parquet") -> DataFrame:
    """Exported to one file and ingested again."""
    uri = f"{Scratch(spark).root}/{name}"
    copy_to(df, uri, options)
    return copy_from(spark, relation_of(df), uri if not (options or {}).get("file_size_bytes") else f"{uri}/*.parquet")


# --- tables: export and ingest ---


def _roundtrip(table: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return there_and_back(spark, spark.read.parquet(f"{sf_dir}/{table}.parquet"))

    return run


for _t in TABLES:
    QUERIES[f"copy_roundtrip_{_t}"], ORACLE[f"copy_roundtrip_{_t}"] = _roundtrip(_t), f"SELECT * FROM {_t}"

# --- delegated SQL, in COPY (query) TO; the same text runs on both sides unless two are given ---

_D = "CAST({} AS DECIMAL(18,2))"
_SUM = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"
DELEGATED: dict[str, str | tuple[str, str]] = {
    "copy_query_project": "SELECT o_orderkey AS k, o_totalprice * 2 AS twice, upper(o_orderpriority) AS p, CAST(o_orderkey AS VARCHAR(20)) AS s, 'x' AS lit FROM orders",
    "copy_query_agg": f"SELECT l_returnflag, l_linestatus, {_SUM.format('l_quantity')} AS sum_qty, {_SUM.format('l_extendedprice')} AS sum_price, count(*) AS n, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "copy_query_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10",
    "copy_query_distinct": "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer",
    "copy_query_count_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps FROM lineitem GROUP BY l_returnflag",
    "copy_query_filter_agg": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) AS n FROM orders GROUP BY o_orderpriority",
    "copy_query_join": f"SELECT n_name, {_SUM.format('o_totalprice')} AS revenue, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "copy_query_left_join": "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "copy_query_full_join": "SELECT s_suppkey, n_nationkey, n_name FROM (SELECT * FROM supplier WHERE s_nationkey > 12) s FULL JOIN nation ON s_nationkey = n_nationkey",
    "copy_query_semi_join": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "copy_query_anti_join": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "copy_query_theta_join": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "copy_query_scalar_subquery": "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)",
    "copy_query_window_rank": "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS BIGINT) AS dr FROM orders",
    "copy_query_window_frame": "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n3, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events",
    "copy_query_union_all": "SELECT c_custkey AS k, c_nationkey AS n FROM customer UNION ALL SELECT s_suppkey, s_nationkey FROM supplier",
    "copy_query_union": "SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier",
    "copy_query_intersect": "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders",
    "copy_query_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000",
    "copy_query_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
    "copy_query_rollup": f"SELECT l_returnflag, l_linestatus, {_SUM.format('l_quantity')} AS q, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "copy_query_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "copy_query_grouping_sets": "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())",
    "copy_query_cte": "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT n, count(*) AS customers FROM big GROUP BY n",
    "copy_query_case": "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS bucket, coalesce(nullif(p_brand, 'Brand#11'), 'none') AS brand FROM part",
    "copy_query_strings": "SELECT c_custkey, upper(c_name) AS u, CAST(length(c_name) AS BIGINT) AS n, substr(c_name, 1, 4) AS head, concat(c_name, '-', c_mktsegment) AS both, replace(c_name, 'Customer', 'C') AS r, trim('  x ') AS t, repeat('ab', 2) AS rep FROM customer",
    "copy_query_math": "SELECT p_partkey, abs(p_size - 25) AS a, p_size % 7 AS m, CAST(floor(p_retailprice) AS BIGINT) AS f, round(p_retailprice, 1) AS r, sqrt(CAST(p_size AS DOUBLE)) AS q FROM part",
    "copy_query_dates": ("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(o_orderdate AS DATE) AS d, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS t FROM orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(o_orderdate AS DATE) AS d, date_trunc('month', o_orderdate) AS t FROM orders"),
    "copy_query_json": ("SELECT event_id, props, get_json_object(props, '$.k') AS k FROM events", "SELECT event_id, props, json_extract_string(props, '$.k') AS k FROM events"),
    "copy_query_generate_series": ("SELECT id AS i, repeat('x', 3) || id AS s, chr(CAST(65 + id % 26 AS INT)) AS c FROM range(1, 1001)", "SELECT range AS i, repeat('x', 3) || range AS s, chr(CAST(65 + range % 26 AS INTEGER)) AS c FROM range(1, 1001)"),
    "copy_query_unnest": ("SELECT vec_id, pos + 1 AS k, x FROM embeddings LATERAL VIEW posexplode(embedding) e AS pos, x", "SELECT vec_id, CAST(unnest(range(1, len(embedding) + 1)) AS INTEGER) AS k, unnest(embedding) AS x FROM embeddings"),
    "copy_query_field_access": ("SELECT o.k AS k, o.a[0] AS first FROM (SELECT named_struct('k', o_orderkey, 'a', array(o_custkey, 1L)) AS o FROM orders)", "SELECT o_orderkey AS k, o_custkey AS first FROM orders"),
    "copy_query_lateral": ("SELECT n_name, x.c FROM nation, LATERAL (SELECT count(*) AS c FROM customer WHERE c_nationkey = n_nationkey) x", "SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS c FROM nation"),
    "copy_query_cross_join": "SELECT r_name, n_name FROM region CROSS JOIN nation",
}


def _used(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b{t}\b", sql)]


def _delegated(sql: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if used := _used(sql):
            tables(spark, sf_dir, *used)
        session, uri = Session(spark), f"{Scratch(spark).root}/q.parquet"
        session.sql(f"COPY ({sql}) TO '{uri}' WITH (format parquet)")
        return copy_from(spark, relation_of(spark.sql(sql)), uri)

    return run


for _k, _v in DELEGATED.items():
    _mine, _theirs = (_v, _v) if isinstance(_v, str) else _v
    QUERIES[_k], ORACLE[_k] = _delegated(_mine), _theirs

# --- ingest: columns, matching, filters, coercion ---


def _ingest(spark: SparkSession, df: DataFrame, ddl: str, **more) -> DataFrame:
    uri = f"{Scratch(spark).root}/in.parquet"
    copy_to(df, uri)
    return copy_from(spark, Relation.of("t", ddl), uri, **more)


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def copy_from_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return _ingest(spark, df, "o_orderkey int8, o_totalprice float8, o_orderstatus text", where="o_totalprice > 100000 AND o_orderstatus = 'F'")


@query("SELECT c_custkey, c_name, CAST(NULL AS INTEGER) AS c_nationkey FROM customer")
def copy_column_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_name", "c_custkey")
    return _ingest(spark, df, "c_custkey int8, c_name text, c_nationkey int4", columns=["c_name", "c_custkey"])


@query("SELECT s_suppkey, s_name FROM supplier")
def match_by_name_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_acctbal", "s_name", "s_suppkey")
    return _ingest(spark, df, "s_suppkey int8, s_name text", options={"match_by": "name"})


@query("SELECT n_nationkey AS a, n_name AS b, n_regionkey AS c FROM nation")
def match_by_position_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingest(spark, spark.read.parquet(f"{sf_dir}/nation.parquet"), "a int4, b text, c int4")


@query("SELECT o_orderkey, o_custkey, o_orderkey + o_custkey AS total FROM orders")
def copy_from_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    return _ingest(spark, df, "o_orderkey int8, o_custkey int8, total int8 generated (o_orderkey + o_custkey)", options={"match_by": "name"})


COERCIONS = {
    "coerce_int_widen": ("SELECT CAST(n_nationkey AS SMALLINT) AS a, n_nationkey AS b, n_regionkey AS c FROM nation", "a int8, b int8, c float8", "SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(n_nationkey AS BIGINT) AS b, CAST(n_regionkey AS DOUBLE) AS c FROM nation"),
    "coerce_double_to_real": ("SELECT p_partkey, p_retailprice AS x FROM part", "p_partkey int8, x float4", "SELECT p_partkey, CAST(p_retailprice AS FLOAT) AS x FROM part"),
    "coerce_date_to_timestamp": ("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders", "o_orderkey int8, d timestamp", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS d FROM orders"),
    "coerce_timestamp_to_date": ("SELECT o_orderkey, o_orderdate AS d FROM orders", "o_orderkey int8, d date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders"),
    "coerce_decimal_to_double": ("SELECT p_partkey, CAST(p_retailprice AS DECIMAL(12,2)) AS x FROM part", "p_partkey int8, x float8", "SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS x FROM part"),
    "coerce_bool_to_int": ("SELECT o_orderkey, o_totalprice > 100000 AS x FROM orders", "o_orderkey int8, x int4", "SELECT o_orderkey, CAST(o_totalprice > 100000 AS INTEGER) AS x FROM orders"),
    "coerce_int_to_text": ("SELECT c_custkey AS x, c_nationkey AS y FROM customer", "x text, y varchar(5)", "SELECT CAST(c_custkey AS VARCHAR) AS x, CAST(c_nationkey AS VARCHAR) AS y FROM customer"),
    "coerce_text_to_int": ("SELECT CAST(c_custkey AS STRING) AS x, c_name AS y FROM customer", "x int8, y text", "SELECT c_custkey AS x, c_name AS y FROM customer"),
    "coerce_bytes_to_text": ("SELECT r_regionkey, CAST(r_name AS BINARY) AS x FROM region", "r_regionkey int4, x text", "SELECT r_regionkey, r_name AS x FROM region"),
    "coerce_timestamp_zones": ("SELECT o_orderkey, o_orderdate AS x FROM orders", "o_orderkey int8, x timestamptz", "SELECT o_orderkey, epoch_us(o_orderdate) AS x FROM orders", lambda df: df.withColumn("x", F.unix_micros("x"))),
    "coerce_nested": ("SELECT n_nationkey AS k, array(CAST(n_nationkey AS SMALLINT), CAST(n_regionkey AS SMALLINT)) AS a FROM nation", "k int8, a int8[]", "SELECT CAST(n_nationkey AS BIGINT) AS k, [CAST(n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT)] AS a FROM nation"),
}


def _coercion(sql: str, ddl: str, shown: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables(spark, sf_dir, *_used(sql))
        return shown(_ingest(spark, spark.sql(sql), ddl))

    return run


for _k, (_sql, _ddl, _theirs, *_shown) in COERCIONS.items():
    QUERIES[_k], ORACLE[_k] = _coercion(_sql, _ddl, *_shown or [lambda df: df]), _theirs


# --- types ---


@query("SELECT o_orderkey, l_linenumber, l_quantity, l_returnflag FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def nested_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag")).alias("lines"))
    whole = spark.read.parquet(f"{sf_dir}/orders.parquet").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "lines")
    return there_and_back(spark, whole).select("o_orderkey", F.explode("lines").alias("l")).select("o_orderkey", "l.*")


@query("SELECT user_id, event_type AS k, count(*) AS n FROM events GROUP BY user_id, event_type")
def map_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = events.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return there_and_back(spark, maps).select("user_id", F.explode("m").alias("k", "n"))


@query("SELECT p_partkey, CAST(p_retailprice AS DECIMAL(9,4)) AS small, CAST(p_retailprice AS DECIMAL(18,4)) AS middle, CAST(p_retailprice AS DECIMAL(38,9)) AS free, CAST(round(CAST(p_retailprice AS DECIMAL(12,2)), -2) AS DECIMAL(7,0)) AS hundreds FROM part")
def numeric_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", *[F.col("p_retailprice").cast("decimal(12,2)").alias(n) for n in ("small", "middle", "free", "hundreds")])
    kinds = {"p_partkey": "int8", "small": "numeric(9,4)", "middle": "numeric(18,4)", "free": "numeric", "hundreds": "numeric(5,-2)"}
    return there_and_back(spark, df.select(*[F.col(n).alias(n, metadata={"sql_type": t}) for n, t in kinds.items()]))


@query("SELECT o_orderkey, o_orderkey AS o, lower(printf('%08x-0000-4000-8000-%012x', o_orderkey, o_custkey)) AS u, '{\"k\":' || o_custkey || '}' AS j, substr(o_orderpriority, 1, 1) AS c, o_orderstatus AS e FROM orders")
def special_types_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        "o_orderkey", "o_orderkey AS o", "lower(printf('%08x-0000-4000-8000-%012x', o_orderkey, o_custkey)) AS u", "concat('{\"k\":', o_custkey, '}') AS j", "o_orderpriority AS c", "o_orderstatus AS e"
    )
    kinds = {"o_orderkey": "int8", "o": "oid", "u": "uuid", "j": "jsonb", "c": '"char"', "e": "enum('F', 'O', 'P')"}
    return there_and_back(spark, df.select(*[F.col(n).alias(n, metadata={"sql_type": t}) for n, t in kinds.items()]))


@query("SELECT event_id, strftime(ts, '%H:%M:%S') AS t, strftime(ts - INTERVAL 3 HOUR, '%H:%M:%S') || '+00' AS z FROM events")
def times_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.timeType.enabled", "true")
    df = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "CAST(date_format(ts, 'HH:mm:ss') AS TIME(6)) AS t", "concat(date_format(ts, 'HH:mm:ss'), '+03') AS z")
    kinds = {"event_id": "int8", "t": "time", "z": "timetz"}
    back = there_and_back(spark, df.select(*[F.col(n).alias(n, metadata={"sql_type": t}) for n, t in kinds.items()]))
    return back.select("event_id", F.col("t").cast("string").alias("t"), "z")


# --- sinks ---


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, l_returnflag FROM lineitem")
def split_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    return there_and_back(spark, df, {"file_size_bytes": "1MB", "compression": "uncompressed"}, "split.parquet")


@query("SELECT c_custkey, c_name FROM customer")
def glob_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, df = Scratch(spark).root, spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    for k in range(3):
        copy_to(df.where(F.col("c_custkey") % 3 == k), f"{root}/part/{k}/x_{k}.parquet")
    return copy_from(spark, relation_of(df), f"{root}/**/x_*.parquet")


@query("SELECT codec, s_suppkey, s_name FROM supplier, (VALUES ('uncompressed'), ('snappy'), ('gzip'), ('lz4'), ('lz4_raw'), ('brotli'), ('zstd')) v(codec)")
def compression_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, out = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name"), None
    for codec in ("uncompressed", "snappy", "gzip", "lz4", "lz4_raw", "brotli", "zstd"):
        rows = there_and_back(spark, df, {"compression": codec}).withColumn("codec", F.lit(codec))
        out = rows if out is None else out.unionAll(rows)
    return out


@query("SELECT a.s_suppkey, a.s_name FROM supplier a")
def stream_pipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, pipe = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name"), io.BytesIO()
    copy_to_stream(df, pipe)
    pipe.seek(0)
    return copy_from_stream(spark, relation_of(df), pipe)


@query("SELECT r_regionkey, r_name FROM region")
def program_pipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, path = spark.read.parquet(f"{sf_dir}/region.parquet"), Scratch(spark).root.removeprefix("file://") + ".bin"
    copy_to_program(df, f"mkdir -p $(dirname {path}) && cat > {path}")
    return copy_from_program(spark, relation_of(df), f"cat {path}")


@query("SELECT n_nationkey, n_name FROM nation")
def sink_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colferry.operators.sink import write_parquet
    from colferry.options import CopyToOptions

    df, uri = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name"), f"{Scratch(spark).root}/x.parquet.zst"
    write_parquet(df, uri, CopyToOptions(compression="zstd", compression_level=3, field_ids="auto"))
    return copy_from(spark, relation_of(df), uri)


@query("SELECT * FROM part")
def parquet_v2_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return there_and_back(spark, spark.read.parquet(f"{sf_dir}/part.parquet"), {"parquet_version": "v2", "compression": "zstd", "compression_level": 5})


@query("SELECT * FROM supplier")
def gzip_level_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return there_and_back(spark, spark.read.parquet(f"{sf_dir}/supplier.parquet"), {"compression": "gzip", "compression_level": 9})


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_nationkey < 5")
def copy_table_row_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    relation = Relation("customer", relation_of(rows).columns, row_policy="c_nationkey < 5")
    return there_and_back(spark, select_relation(relation, rows, ["c_custkey", "c_name", "c_mktsegment"], AccessPolicy(False, frozenset(ROLES))))


@query("SELECT c_name, c_custkey FROM customer WHERE c_custkey > 100")
def copy_sql_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "customer")
    session, uri = Session(spark), f"{Scratch(spark).root}/c.parquet.zst"
    session.sql(f"COPY customer (c_custkey, c_name) TO '{uri}' (row_group_size 500)")
    session.declare("target", "c_name text not null, c_custkey int8")
    return session.read(parse_copy(f"COPY target FROM '{uri}' WITH (match_by 'name') WHERE c_custkey > 100"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def stream_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, df = Scratch(spark).root, spark.read.parquet(f"{sf_dir}/nation.parquet")
    for k in range(3):
        copy_to(df.where(F.col("n_nationkey") % 3 == k), f"{root}/in/f{k}.parquet")
    copy_stream_to(read_stream(spark, relation_of(df), f"{root}/in", 1), f"{root}/out", f"{root}/check", once=True).awaitTermination()
    return copy_from(spark, relation_of(df), f"{root}/out/*.parquet")


# --- footers and listings ---


def _exported(spark: SparkSession, sf_dir: str, table: str, options: dict | None = None, name: str = "f.parquet") -> str:
    uri = f"{Scratch(spark).root}/{name}"
    copy_to(spark.read.parquet(f"{sf_dir}/{table}.parquet"), uri, options)
    return uri


_STATS = {
    "orders": (("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "text"), ("o_totalprice", "double"), ("o_orderdate", "timestamp"), ("o_orderpriority", "text")),
    "customer": (("c_custkey", "int"), ("c_name", "text"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "text")),
    "supplier": (("s_suppkey", "int"), ("s_name", "text"), ("s_nationkey", "int"), ("s_acctbal", "double")),
    "lineitem": (
        ("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"), ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
        ("l_returnflag", "text"), ("l_linestatus", "text"), ("l_shipdate", "timestamp"),
    ),
    "part": (("p_partkey", "int"), ("p_name", "text"), ("p_brand", "text"), ("p_type", "text"), ("p_size", "int"), ("p_retailprice", "double")),
}


def _stats_sql(table: str) -> str:
    text = {"int": "CAST({} AS VARCHAR)", "text": "{}", "double": "regexp_replace(CAST({} AS VARCHAR), '\\.0$', '')", "timestamp": "strftime({}, '%Y-%m-%d %H:%M:%S')"}
    low = {**text, "double": "CASE WHEN {0} = 0 THEN '0' ELSE regexp_replace(CAST({0} AS VARCHAR), '\\.0$', '') END"}  # zero has two signs, footers hold either
    return " UNION ALL ".join(
        f"SELECT {k} AS column_id, {k} AS field_id, {low[t].format(f'min({c})')} AS stats_min, {text[t].format(f'max({c})')} AS stats_max, count(*) - count({c}) AS stats_null_count, CAST(NULL AS BIGINT) AS stats_distinct_count FROM {table}"
        for k, (c, t) in enumerate(_STATS[table])
    )


def _stats(table: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return inspect(spark, "column_stats", _exported(spark, sf_dir, table, {"field_ids": "auto", "row_group_size": 1000}))

    return run


for _t in _STATS:
    QUERIES[f"column_stats_{_t}"], ORACLE[f"column_stats_{_t}"] = _stats(_t), _stats_sql(_t)


@query(
    "SELECT * FROM (VALUES ('arrow_schema', NULL, NULL, 5, NULL, NULL, NULL), ('c_custkey', 'INT64', 'OPTIONAL', NULL, NULL, 0, NULL), ('c_name', 'BYTE_ARRAY', 'OPTIONAL', NULL, 'UTF8', 1, 'STRING'), "
    "('c_nationkey', 'INT32', 'OPTIONAL', NULL, NULL, 2, NULL), ('c_acctbal', 'DOUBLE', 'OPTIONAL', NULL, NULL, 3, NULL), ('c_mktsegment', 'BYTE_ARRAY', 'OPTIONAL', NULL, 'UTF8', 4, 'STRING')) "
    "v(name, type_name, repetition_type, num_children, converted_type, field_id, logical_type)"
)
def schema_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect(spark, "schema", _exported(spark, sf_dir, "customer", {"field_ids": "auto"})).select("name", "type_name", "repetition_type", "num_children", "converted_type", "field_id", "logical_type")


@query(
    "SELECT g AS row_group_id, CAST(least(400, n - g * 400) AS BIGINT) AS row_group_num_rows, CAST(5 AS BIGINT) AS row_group_num_columns, CAST(c AS BIGINT) AS column_id, CAST(least(400, n - g * 400) AS BIGINT) AS num_values, path_in_schema, type_name "
    "FROM (SELECT count(*) AS n FROM customer) t, LATERAL (SELECT unnest(range(CAST(ceil(n / 400.0) AS BIGINT))) AS g) r, (VALUES (0, 'c_custkey', 'INT64'), (1, 'c_name', 'BYTE_ARRAY'), (2, 'c_nationkey', 'INT32'), (3, 'c_acctbal', 'DOUBLE'), (4, 'c_mktsegment', 'BYTE_ARRAY')) v(c, path_in_schema, type_name)"
)
def metadata_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = _exported(spark, sf_dir, "customer", {"row_group_size": 400, "compression": "brotli"})
    return inspect(spark, "metadata", uri).select("row_group_id", "row_group_num_rows", "row_group_num_columns", "column_id", "num_values", "path_in_schema", "type_name")


@query("SELECT count(*) AS num_rows, CAST(ceil(count(*) / 400.0) AS BIGINT) AS num_row_groups FROM customer")
def file_metadata_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect(spark, "file_metadata", _exported(spark, sf_dir, "customer", {"row_group_size": 400, "compression": "brotli"})).select("num_rows", "num_row_groups")


@query("SELECT CAST(g AS BIGINT) AS row_group_id, CAST(least(500, n - g * 500) AS BIGINT) AS num_rows FROM (SELECT count(*) AS n FROM customer) t, LATERAL (SELECT unnest(range(CAST(ceil(n / 500.0) AS BIGINT))) AS g) r")
def row_groups_by_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inspect(spark, "metadata", _exported(spark, sf_dir, "customer", {"row_group_size": 500}))
    return rows.where("column_id = 0").select("row_group_id", F.col("row_group_num_rows").alias("num_rows"))


@query("SELECT * FROM (VALUES ('.parquet', 'SNAPPY'), ('.parquet.snappy', 'SNAPPY'), ('.parquet.gz', 'GZIP'), ('.parquet.lz4', 'LZ4'), ('.parquet.br', 'BROTLI'), ('.parquet.zst', 'ZSTD')) v(extension, compression)")
def codec_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for extension in (".parquet", ".parquet.snappy", ".parquet.gz", ".parquet.lz4", ".parquet.br", ".parquet.zst"):
        rows = inspect(spark, "metadata", _exported(spark, sf_dir, "region", name="r" + extension)).where("column_id = 0").select(F.lit(extension).alias("extension"), "compression")
        out = rows if out is None else out.unionAll(rows)
    return out


@query("SELECT * FROM (VALUES ('k', 7), ('s', 10), ('x', NULL), ('a', 11), ('element', 12)) v(name, field_id)")
def field_ids_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_nationkey AS k", "named_struct('x', n_regionkey, 'a', array(n_name)) AS s")
    uri = f"{Scratch(spark).root}/ids.parquet"
    copy_to(df, uri, {"field_ids": '{"k": 7, "s": {"__root_field_id": 10, "a": {"__root_field_id": 11, "element": 12}}}'})
    return inspect(spark, "schema", uri).where("name NOT IN ('arrow_schema', 'list')").select("name", "field_id")


@query("SELECT count(*) AS num_rows FROM lineitem")
def split_footers_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = f"{Scratch(spark).root}/split.parquet"
    copy_to(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), uri, {"file_size_bytes": "1MB"})
    return inspect_many(spark, "file_metadata", [u for u, _ in list_files(spark, f"{uri}/data_*.parquet")]).agg(F.sum("num_rows").alias("num_rows"))


@query("SELECT 'geo' AS key, '{\"version\": \"1.1.0\", \"primary_column\": \"g\", \"columns\": {\"g\": {\"encoding\": \"WKB\", \"geometry_types\": [\"Point\"]}}}' AS value")
def kv_metadata_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.unhex(F.lit("0101000000000000000000F03F0000000000000040")).alias("g", metadata={"sql_type": "geometry(Point)"}))
    uri = f"{Scratch(spark).root}/g.parquet"
    copy_to(df, uri)
    return inspect(spark, "kv_metadata", uri).select(F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value")).where("key = 'geo'")


@query("SELECT name FROM (VALUES ('a/x_1.parquet'), ('a/b/x_2.parquet')) v(name)")
def list_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, df = Scratch(spark).root, spark.read.parquet(f"{sf_dir}/region.parquet")
    for name in ("a/x_1.parquet", "a/b/x_2.parquet", "a/b/y.parquet"):
        copy_to(df, f"{root}/{name}")
    start = len(root.removeprefix("file://")) + 2
    return inspect(spark, "list", f"{root}/**/x_*.parquet").select(F.expr(f"substring(uri, {start})").alias("name"))


@query("SELECT CAST(k AS INTEGER) AS k, CAST(5 AS BIGINT) AS n FROM range(3) r(k)")
def footers_of_many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, df = Scratch(spark).root, spark.read.parquet(f"{sf_dir}/region.parquet")
    for k in range(3):
        copy_to(df, f"{root}/f_{k}.parquet")
    found = inspect_many(spark, "file_metadata", [u for u, _ in list_files(spark, f"{root}/f_*.parquet")])
    return found.select(F.regexp_extract("uri", r"f_(\d)", 1).cast("int").alias("k"), F.col("num_rows").alias("n"))


@query("SELECT CAST(count(*) AS BIGINT) AS num_rows FROM nation")
def footer_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    return spark.sql(f"SELECT num_rows FROM parquet_file_metadata('{_exported(spark, sf_dir, 'nation')}')")


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "lineitem")
    session, uri = Session(spark), f"{Scratch(spark).root}/flagship.parquet"
    session.sql(f"COPY (SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, count(*) AS n FROM lineitem GROUP BY 1, 2) TO '{uri}'")
    return copy_from(spark, Relation("flagship", [Column("l_returnflag", SqlType("text")), Column("l_linestatus", SqlType("text")), Column("sum_qty", parse_type("double precision")), Column("n", SqlType("int8"))]), uri)
