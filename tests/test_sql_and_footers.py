"""COPY SQL, footers, statistics, streaming and registered queries (R, U, A, L)."""

import io

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from colferry.errors import FerryError
from colferry.functions.footer import COLUMN_STATS, inspect, inspect_many, register, stat_text
from colferry.operators.copy_to import copy_to
from colferry.plans.copy_sql import ENABLED, Session, is_copy_parquet, parse_copy
from colferry.types import Relation


def test_r1_grammar():
    s = parse_copy("COPY public.\"My \"\"T\"(a, \"B\") FROM '/x''y.parquet' WITH (format 'parquet', match_by name) WHERE a > 1 AND b = 'x)';")
    assert (s.direction, s.relation, s.columns, s.target, s.options, s.where) == ("from", 'public.My "T', ["a", "B"], "/x'y.parquet", {"format": "parquet", "match_by": "name"}, "a > 1 AND b = 'x)'")
    s = parse_copy("copy (select ')' as x, f(1) -- )\n from t) to program 'cat > y' (format parquet, row_group_size 5, freeze)")
    assert s.query == "select ')' as x, f(1) -- )\n from t" and s.kind == "program" and s.options == {"format": "parquet", "row_group_size": 5, "freeze": "true"}
    assert parse_copy("COPY T TO STDOUT (format parquet)").kind == "stdout" and parse_copy("COPY T FROM STDIN").relation == "t"
    assert parse_copy("SELECT 1") is None
    for bad in ("COPY", "COPY t", "COPY t TO", "COPY (select 1 TO 'x'", "COPY (select 1) FROM 'x'", "COPY t TO 'x' junk", "COPY t TO STDIN", "COPY t TO 'x' (a 1"):
        with pytest.raises((FerryError, IndexError)):
            parse_copy(bad)


def test_r2_recognition():
    assert is_copy_parquet(parse_copy("COPY t TO '/x.parquet'")) and is_copy_parquet(parse_copy("COPY t TO '/x' (format parquet)"))
    assert not is_copy_parquet(parse_copy("COPY t TO '/x.csv'")) and not is_copy_parquet(parse_copy("COPY t TO '/x.parquet' (format csv)")) and not is_copy_parquet(parse_copy("COPY t TO STDOUT"))


def test_r6_switch(spark, tmp_path):
    spark.conf.set(ENABLED, "off")
    try:
        with pytest.raises(FerryError):
            Session(spark).sql(f"COPY (SELECT 1 AS a) TO '{tmp_path}/x.parquet'")
    finally:
        spark.conf.unset(ENABLED)


def test_r8_counts_and_tables(spark, tmp_path):
    s = Session(spark)
    assert s.sql(f"COPY (SELECT id AS a, id * 2 AS b FROM range(7)) TO '{tmp_path}/x.parquet'") == 7
    s.declare("t1", "a int8, b int8")
    assert s.sql(f"COPY t1 FROM '{tmp_path}/x.parquet' WHERE a > 2") == 4
    assert s.sql(f"COPY t1 FROM '{tmp_path}/x.parquet'") == 7 and spark.table("t1").count() == 11
    assert s.sql(f"COPY t1(b) TO '{tmp_path}/y.parquet'") == 11 and pq.read_schema(f"{tmp_path}/y.parquet").names == ["b"]
    pipe = io.BytesIO()
    assert s.sql("COPY t1 TO STDOUT (format parquet)", stdout=pipe) == 11
    pipe.seek(0)
    assert s.sql("COPY t1 FROM STDIN (format parquet)", stdin=pipe) == 11
    with pytest.raises(FerryError, match='relation "nope" does not exist'):
        s.sql(f"COPY nope FROM '{tmp_path}/x.parquet'")
    spark.range(2).createOrReplaceTempView("a_view")
    with pytest.raises(FerryError):
        s.sql("COPY a_view TO '/tmp/never.csv'")


def test_r8_spark_table(spark, tmp_path):
    spark.sql(f"CREATE TABLE kept (a BIGINT, b STRING) USING parquet LOCATION '{tmp_path}/kept'")
    try:
        s = Session(spark)
        s.sql(f"COPY (SELECT id AS a, 'x' AS b FROM range(3)) TO '{tmp_path}/k.parquet'")
        assert s.sql(f"COPY kept FROM '{tmp_path}/k.parquet'") == 3 and s.sql(f"COPY kept(b) FROM '{tmp_path}/k.parquet' WITH (match_by name)") == 3
        assert sorted(map(str, spark.table("kept").collect())) == sorted(["Row(a=0, b='x')", "Row(a=1, b='x')", "Row(a=2, b='x')"] + ["Row(a=None, b='x')"] * 3)
        assert s.sql(f"COPY kept TO '{tmp_path}/k2.parquet' (compression gzip)") == 6
        spark.sql("CREATE VIEW kept_view AS SELECT * FROM kept")
        with pytest.raises(FerryError, match='cannot copy from view "kept_view"'):
            s.sql(f"COPY kept_view TO '{tmp_path}/v.parquet'")
    finally:
        spark.sql("DROP VIEW IF EXISTS kept_view")
        spark.sql("DROP TABLE kept")


def test_v10_other_types_travel_as_text(spark, tmp_path):
    copy_to(spark.sql("SELECT INTERVAL '1' YEAR AS y, parse_json('{\"a\": 1}') AS v, NULL AS n, CAST(1 AS BYTE) AS b"), f"{tmp_path}/o.parquet")
    assert [str(f.type) for f in pq.read_schema(f"{tmp_path}/o.parquet")] == ["string", "string", "string", "int16"]


def test_r7_nested_copy(spark, tmp_path):
    """A session's COPY runs inside another's query building: there is no global state."""
    s = Session(spark)
    assert s.sql(f"COPY (SELECT * FROM parquet.file_metadata('{_file(spark, tmp_path)}')) TO '{tmp_path}/meta.parquet'") == 1


def _file(spark, tmp_path):
    path = f"{tmp_path}/f.parquet"
    copy_to(spark.range(10).selectExpr("id", "'x' || id AS t", "array(id) AS l"), path, {"field_ids": "auto", "row_group_size": 4})
    return path


def test_u1_schema(spark, tmp_path):
    rows = [tuple(r)[1:] for r in inspect(spark, "schema", _file(spark, tmp_path)).collect()]
    assert rows == [
        ("arrow_schema", None, None, None, 3, None, None, None, None, None),
        ("id", "INT64", None, "OPTIONAL", None, None, None, None, 0, None),
        ("t", "BYTE_ARRAY", None, "OPTIONAL", None, "UTF8", None, None, 1, "STRING"),
        ("l", None, None, "OPTIONAL", 1, "LIST", None, None, 2, "LIST"),
        ("list", None, None, "REPEATED", 1, None, None, None, None, None),
        ("element", "INT64", None, "OPTIONAL", None, None, None, None, 3, None),
    ]


def test_u1_schema_of_other_types(spark, tmp_path):
    table = pa.table({"d": pa.array([1], pa.decimal128(20, 3)), "u": pa.array([b"x" * 16], pa.uuid()), "i": pa.array([1], pa.uint8()), "m": pa.array([[("k", 1)]], pa.map_(pa.string(), pa.int32())), "z": pa.array([1], pa.timestamp("ns")), "c": pa.array([1], pa.time32("ms")), "f": pa.array([1.5], pa.float16())})
    pq.write_table(table, tmp_path / "o.parquet")
    rows = {r["name"]: r for r in inspect(spark, "schema", f"{tmp_path}/o.parquet").collect()}
    assert (rows["d"]["type_name"], rows["d"]["type_length"], rows["d"]["scale"], rows["d"]["precision"]) == ("FIXED_LEN_BYTE_ARRAY", "9", 3, 20)
    assert rows["u"]["logical_type"] == "UUID" and rows["i"]["converted_type"] == "UINT_8" and rows["m"]["logical_type"] == "MAP"
    assert rows["key"]["repetition_type"] == "REQUIRED" and rows["z"]["converted_type"] is None and rows["c"]["converted_type"] == "TIME_MILLIS" and rows["f"]["logical_type"] == "FLOAT16"


def test_u2_u3_u4_metadata(spark, tmp_path):
    path = _file(spark, tmp_path)
    rows = inspect(spark, "metadata", path).collect()
    assert [(r["row_group_id"], r["column_id"], r["row_group_num_rows"]) for r in rows] == [(g, c, n) for g, n in ((0, 4), (1, 4), (2, 2)) for c in range(3)]
    assert rows[0]["stats_min"] == "0" and rows[0]["stats_max"] == "3" and rows[0]["path_in_schema"] == "id" and "," in rows[0]["encodings"] + ","
    meta = inspect(spark, "file_metadata", path).first()
    assert (meta["num_rows"], meta["num_row_groups"], meta["format_version"]) == (10, 3, "1")
    assert inspect(spark, "kv_metadata", path).count() > 0
    for name in ("schema", "metadata", "file_metadata", "kv_metadata", "column_stats", "list"):
        assert inspect(spark, name, None).count() == 0
    with pytest.raises(FerryError, match="failed to get object store metadata"):
        inspect(spark, "schema", f"{tmp_path}/none.parquet")


def test_u5_column_stats_fixture(spark, tmp_path):
    """An all-null row, rows 10 to 89, an all-null row; statistics of typed values as text."""
    spark.conf.set("spark.sql.timeType.enabled", "true")
    kinds = {
        "a": ("int2", "CAST(i AS SMALLINT)", "10", "89"), "b": ("int4", "i", "10", "89"), "c": ("int8", "CAST(i AS BIGINT)", "10", "89"), "d": ("float4", "CAST(concat('12.', i) AS FLOAT)", "12.1", "12.89"),
        "e": ("float8", "CAST(concat('12.', i) AS DOUBLE)", "12.1", "12.89"), "f": ("numeric(5,2)", "CAST(concat('12.', i) AS DECIMAL(5,2))", "12.10", "12.89"), "h": ("numeric(25,2)", "CAST(concat('12.', i) AS DECIMAL(25,2))", "12.10", "12.89"),
        "i": ("numeric(40,2)", "concat('12.', i)", "12.10", "12.89"), "j": ("numeric", "concat('12.', i)", "12.100000000", "12.890000000"), "k": ("text", "concat('hello', i)", "hello10", "hello89"),
        "m": ("date", "make_date(2000 + i, 1, 2)", "2010-01-02", "2089-01-02"), "n": ("timestamp", "make_timestamp_ntz(2000 + i, 1, 2, 0, 0, 0)", "2010-01-02 00:00:00", "2089-01-02 00:00:00"),
        "o": ("timestamptz", "timestamp_seconds(1262401200 + 86400 * (i - 10))", "2010-01-02 03:00:00+00", "2010-03-22 03:00:00+00"), "q": ("timetz", "concat('23:02:', lpad(i % 60, 2, '0'), '+01')", "22:02:00+00", "22:02:59+00"),
        "r": ("oid", "CAST(i AS BIGINT)", "10", "89"), "s": ("bool", "i % 2 = 0", "false", "true"), "u": ("bytea", "unhex(concat('0102', i))", "\\x010210", "\\x010289"), "v": ("int4[]", "array(i, i + 1)", "10", "90"),
        "y": ("json", "concat('{\"key\":', i, '}')", '{"key":10}', '{"key":89}'), "zz": ("uuid", "concat('00000000-0000-0000-0000-0000000000', i)", "00000000-0000-0000-0000-000000000010", "00000000-0000-0000-0000-000000000089"),
    }
    numbers = spark.range(9, 91).select(F.when(F.col("id").between(10, 89), F.col("id").cast("int")).alias("i")).coalesce(1)
    df = numbers.select(*[F.expr(f"CASE WHEN i IS NOT NULL THEN {sql} END").alias(n, metadata={"sql_type": t}) for n, (t, sql, _, _) in kinds.items()])
    copy_to(df, f"{tmp_path}/s.parquet", {"row_group_size": 10, "field_ids": "auto"})
    rows = inspect(spark, "column_stats", f"{tmp_path}/s.parquet").orderBy("column_id").collect()
    assert pq.read_metadata(f"{tmp_path}/s.parquet").num_row_groups == 9
    assert [(n, r["stats_min"], r["stats_max"]) for n, r in zip(kinds, rows)] == [(n, low, high) for n, (_, _, low, high) in kinds.items()]
    assert all(r["stats_null_count"] == 2 and r["stats_distinct_count"] is None for r in rows)


def test_a1_typed_minimum_not_textual():
    assert stat_text(-5, "INT32", "NONE") == "-5" and stat_text(1e20, "DOUBLE", "NONE") == "100000000000000000000" and stat_text(-0.0, "DOUBLE", "NONE") == "-0"
    assert stat_text(1.0, "FLOAT", "NONE") == "1" and stat_text(b"\x5c\x27", "BYTE_ARRAY", "NONE") == "\\x5C27" and stat_text(None, "INT32", "NONE") is None


def test_u_functions_in_sql(spark, tmp_path):
    path = _file(spark, tmp_path)
    s = Session(spark)
    assert s.sql(f"SELECT * FROM parquet.schema('{path}') WHERE name <> 'list' ORDER BY name LIMIT 2").count() == 2
    assert s.sql(f"SELECT count(*) AS n FROM parquet.list('{tmp_path}/**/*.parquet')").first()["n"] == 1
    assert s.sql("SELECT * FROM parquet.schema(NULL)").count() == 0
    register(spark)
    lateral = spark.sql(f"SELECT u.num_rows FROM VALUES ('{path}'), ('{path}') AS f(p), LATERAL parquet_file_metadata(f.p) u")
    assert [r["num_rows"] for r in lateral.collect()] == [10, 10]
    assert inspect_many(spark, "column_stats", [path, path]).count() == 6 and COLUMN_STATS.startswith("column_id")


def test_streaming(spark, tmp_path):
    from colferry.streaming.copy_stream import copy_stream_to, read_stream

    relation = Relation.of("t", "id int8")
    for k in range(3):
        copy_to(spark.range(k, k + 2), f"{tmp_path}/in/f{k}.parquet")
    query = copy_stream_to(read_stream(spark, relation, f"{tmp_path}/in", 1), f"{tmp_path}/out", f"{tmp_path}/check", once=True)
    query.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out/*.parquet").count() == 6


def test_entry_imports_without_the_optional_parts(monkeypatch):
    import importlib
    import sys

    for name in list(sys.modules):
        if name.startswith(("colferry.llm", "corpus_pipeline", "__spark_entry__")):
            monkeypatch.delitem(sys.modules, name)
    for name in ("colferry.llm", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert "copy_roundtrip_lineitem" in names and not any(n.startswith("op") for n in names) and set(entry.oracle_sql()) <= names
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
