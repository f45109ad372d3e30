"""Export and ingest: types, matching, coercion, sinks, streams, access (S, M, W, V, P)."""

import datetime as dt
import io
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from colferry.errors import FerryError
from colferry.functions.footer import inspect
from colferry.functions.geo import wkb
from colferry.operators.access import AccessPolicy
from colferry.operators.copy_from import copy_from, copy_from_program, copy_from_stream
from colferry.operators.copy_to import copy_to, copy_to_program, copy_to_stream, select_relation
from colferry.types import Relation, normalize_numeric, parse_type

NAN, INF = float("nan"), float("inf")
UUID = "a81bc81b-dead-4e5d-abff-90865d1e13b1"


def declared(spark, ddl, rows):
    """Rows given as SQL expressions of text, by the relation's columns."""
    relation = Relation.of("t", ddl)
    spark.conf.set("spark.sql.timeType.enabled", "true")
    body = " UNION ALL ".join("SELECT " + ", ".join(f"{v} AS c{k}" for k, v in enumerate(r)) for r in rows)
    df = spark.sql(body)
    return relation, df.select(*[F.col(f"c{k}").alias(c.name, metadata={"sql_type": str(c.type)}) for k, c in enumerate(relation.columns)])


def back(spark, relation, df, path, options=None, **more):
    assert copy_to(df, path, options) == df.count()
    return copy_from(spark, relation, path, **more)


SCALARS = [
    ("bool", "true", True), ("int2", "3S", 3), ("int4", "4", 4), ("int8", "5L", 5), ("float4", "float(1.5)", 1.5), ("float8", "double('inf')", INF), ("text", "'x'", "x"),
    ("bytea", "X'0102'", bytearray(b"\1\2")), ("oid", "4294967295L", 4294967295), ("uuid", f"'{UUID}'", UUID), ("json", "'{\"k\": 1}'", '{"k": 1}'), ("jsonb", "'{\"b\":1, \"a\":2}'", '{"a":2,"b":1}'),
    ("date", "date'2022-05-01'", dt.date(2022, 5, 1)), ("timestamp", "timestamp_ntz'2022-05-01 15:00:00.123456'", dt.datetime(2022, 5, 1, 15, 0, 0, 123456)), ("time", "time'15:00:00.5'", dt.time(15, 0, 0, 500000)),
    ("timetz", "'15:30:12-03'", "18:30:12+00"), ("numeric(9,4)", "-2.12313", Decimal("-2.1231")), ("numeric(18,4)", "+1.020", Decimal("1.0200")), ("numeric(38,4)", "0.3", Decimal("0.3000")), ("numeric", "'12.5'", Decimal("12.500000000")),
    ("numeric(5,-2)", "12345", Decimal("12300")), ("numeric(5,8)", "0.00012345", Decimal("0.00012345")), ("numeric(39,4)", "'123.4567'", "123.4567"), ("varchar(3)", "'abc'", "abc"), ("bpchar(3)", "'ab'", "ab "), ("\"char\"", "'abc'", "a"),
    ("enum('red','green')", "'red'", "red"), ("bit(3)", "'101'", "101"), ("varbit", "'1'", "1"), ("interval", "'15 years'", "15 years"), ("name", "'n'", "n"),
    ("geometry(Point)", "unhex('0101000000000000000000F03F0000000000000040')", bytearray(wkb("POINT(1 2)"))),
    ("struct<a int4, b text[]>", "named_struct('a', 1, 'b', array('p', null))", (1, ["p", None])), ("map<int4,text>", "map(1, 'one', 2, null)", {1: "one", 2: None}),
]


@pytest.mark.parametrize("kind, sql, value", SCALARS, ids=[s[0] for s in SCALARS])
def test_v_round_trips(spark, tmp_path, kind, sql, value):
    """Each type with null; its array with a null element, a null array and an empty one."""
    relation, df = declared(spark, f"a {kind}, b array<{kind}>", [(sql, f"array({sql}, null)"), ("null", "null"), (sql, f"filter(array({sql}), x -> false)")])
    a = [r["a"] for r in back(spark, relation, df, f"{tmp_path}/x.parquet").collect()]
    b = [r["b"] for r in copy_from(spark, relation, f"{tmp_path}/x.parquet").collect()]
    assert a == [value, None, value] and b == [[value, None], None, []]


def test_v3_timestamptz_is_utc(spark, tmp_path):
    relation, df = declared(spark, "a timestamptz", [("timestamp'2022-05-01 12:00:00-04:00'",), ("null",)])
    assert back(spark, relation, df, f"{tmp_path}/x.parquet").selectExpr("unix_micros(a) AS a").first()["a"] == 1651420800000000
    t = pq.read_schema(f"{tmp_path}/x.parquet").field("a").type
    assert t.unit == "us" and t.tz == "UTC"


def test_v6_v8_numeric_limits(spark, tmp_path):
    for value, text in (("'" + "1" * 30 + "'", "30 digits before decimal point, which exceeds max allowed integral digits 29"), ("'2.1234567891'", "10 digits after decimal point, which exceeds max allowed decimal digits 9"), ("'NaN'", "Special numeric values like NaN, Inf, -Inf are not allowed"), ("'-Infinity'", "Special numeric values")):
        _, df = declared(spark, "a numeric", [(value,)])
        with pytest.raises(Exception, match=text.replace("(", "\\(")):
            copy_to(df, f"{tmp_path}/x.parquet")


def test_v9_normalize():
    assert [normalize_numeric(*x) for x in ((5, -2), (5, 8), (10, 4))] == [(7, 0), (8, 8), (10, 4)]


def test_v11_text_inputs(spark, tmp_path):
    for kind, value, text in (("enum('red')", "blue", 'invalid input value for enum: "blue"'), ("bit(3)", "1a1", '"a" is not a valid binary digit'), ("bit(3)", "11", "bit string length 2 does not match type bit\\(3\\)"), ("varchar(2)", "abc", "value too long for type character varying\\(2\\)")):
        copy_to(spark.createDataFrame([(value,)], "a string"), f"{tmp_path}/x.parquet")
        with pytest.raises(Exception, match=text):
            copy_from(spark, Relation.of("t", f"a {kind}"), f"{tmp_path}/x.parquet").collect()


def test_v13_v18_guards(spark, tmp_path):
    for kind, sql, text in (("json", "'{bad'", "invalid input syntax for type json"), ("oid", "-1L", "out of range for type oid"), ("uuid", "'zz'", "invalid input syntax for type uuid")):
        _, df = declared(spark, f"a {kind}", [(sql,)])
        with pytest.raises(Exception, match=text):
            copy_to(df, f"{tmp_path}/x.parquet")


def test_v15_v16_geometry(spark, tmp_path):
    kinds = ["Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection"]
    wkts = ["POINT(1 1)", "LINESTRING(0 0, 1 1)", "POLYGON((0 0, 1 1, 2 2, 0 0))", "MULTIPOINT((0 0), (1 1))", "MULTILINESTRING((0 0, 1 1), (2 2, 3 3))", "MULTIPOLYGON(((0 0, 1 1, 2 2, 0 0)))", "GEOMETRYCOLLECTION(POINT(1 1), LINESTRING(0 0, 1 1))"]
    relation, df = declared(spark, ", ".join(f"g{k} geometry({n})" for k, n in enumerate(kinds)) + ", plain geometry", [tuple(f"X'{wkb(w).hex()}'" for w in [*wkts, wkts[0]])])
    assert [bytes(x) for x in back(spark, relation, df, f"{tmp_path}/g.parquet").first()] == [wkb(w) for w in [*wkts, wkts[0]]]
    import json

    geo = json.loads(pq.read_metadata(f"{tmp_path}/g.parquet").metadata[b"geo"])
    assert geo["version"] == "1.1.0" and geo["primary_column"] == "g0"
    assert [geo["columns"][f"g{k}"]["geometry_types"] for k in range(7)] == [[n] for n in kinds] and geo["columns"]["plain"]["geometry_types"] == []
    with pytest.raises(FerryError):
        wkb("POINT(1")


def write(path, **columns):
    pq.write_table(pa.table({k: v for k, v in columns.items()}), path)
    return str(path)


COERCED = [
    (pa.array([1], pa.int16()), "int4", 1), (pa.array([1], pa.int16()), "int8", 1), (pa.array([1], pa.int32()), "int8", 1), (pa.array([1.5], pa.float32()), "float8", 1.5), (pa.array([1.5]), "float4", 1.5),
    (pa.array([dt.date(2020, 1, 2)]), "timestamp", dt.datetime(2020, 1, 2)), (pa.array([1], pa.uint16()), "int2", 1), (pa.array([1], pa.uint16()), "int8", 1), (pa.array([1], pa.uint32()), "int4", 1), (pa.array([1], pa.uint64()), "int8", 1),
    (pa.array([1], pa.int8()), "int8", 1), (pa.array([True]), "int4", 1), (pa.array([Decimal("12.50000")], pa.decimal128(8, 5)), "float8", 12.5), (pa.array([b"ab"]), "text", "ab"), (pa.array(["ab"], pa.large_string()), "text", "ab"),
    (pa.array([b"ab"], pa.large_binary()), "bytea", bytearray(b"ab")), (pa.array([dt.datetime(2020, 1, 1, 5)], pa.timestamp("ms")), "timestamp", dt.datetime(2020, 1, 1, 5)), (pa.array([1577854800000000007], pa.timestamp("ns")), "timestamp", dt.datetime(2020, 1, 1, 5)),
    (pa.array([dt.time(1, 2, 3)], pa.time64("us")), "timetz", "01:02:03+00"), (pa.array([1.5], pa.float16()), "float4", 1.5), (pa.array([[1, 2]], pa.list_(pa.uint16())), "int4[]", [1, 2]), (pa.array([[1, 2]], pa.large_list(pa.uint16())), "int8[]", [1, 2]),
    (pa.array([{"a": 1, "b": 2}], pa.struct([("a", pa.uint16()), ("b", pa.uint16())])), "struct<a int4, b int8>", (1, 2)), (pa.array([[("k", 1)]], pa.map_(pa.string(), pa.uint16())), "map<text,int4>", {"k": 1}), (pa.array(["5"]), "int4", 5),
]


@pytest.mark.parametrize("array, kind, value", COERCED, ids=[f"{a.type}-{k}" for a, k, _ in COERCED])
def test_m5_coercions(spark, tmp_path, array, kind, value):
    path = write(tmp_path / "c.parquet", x=array)
    assert copy_from(spark, Relation.of("t", f"x {kind}"), path).first()["x"] == value


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_m5_zones(spark, tmp_path, zone):
    """Timestamps with and without zone meet in UTC, whatever the session's zone."""
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        plain = write(tmp_path / "a.parquet", x=pa.array([1577854800000000], pa.timestamp("us")))
        zoned = write(tmp_path / "b.parquet", x=pa.array([1577854800000000], pa.timestamp("us", "Europe/Paris")))
        assert copy_from(spark, Relation.of("t", "x timestamptz"), plain).selectExpr("unix_micros(x) x").first()["x"] == 1577854800000000
        assert copy_from(spark, Relation.of("t", "x timestamp"), zoned).selectExpr("CAST(x AS STRING) x").first()["x"] == "2020-01-01 05:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


REJECTED = [
    (pa.array([True]), "date"), (pa.array([1]), "jsonb"), (pa.array([1.5]), "date"), (pa.array([{"a": 1}]), "int4"), (pa.array([{"a": 1}]), "struct<a int8, b int8>"), (pa.array([{"b": 1, "a": 2}], pa.struct([("b", pa.int64()), ("a", pa.int64())])), "struct<a int8, b int8>"),
    (pa.array([{"a": True}]), "struct<a date>"), (pa.array([1]), "int4[]"),
]


@pytest.mark.parametrize("array, kind", REJECTED, ids=[f"{a.type}-{k}" for a, k in REJECTED])
def test_m5_m7_rejections(spark, tmp_path, array, kind):
    with pytest.raises(FerryError, match='type mismatch for column "x" between table and parquet file.'):
        copy_from(spark, Relation.of("t", f"x {kind}"), write(tmp_path / "r.parquet", x=array), {"match_by": "name"})


def test_m1_m2_matching(spark, tmp_path):
    path = write(tmp_path / "m.parquet", a=pa.array([1]), b=pa.array(["x"]))
    assert tuple(copy_from(spark, Relation.of("t", "p int8, q text"), path).first()) == (1, "x")
    assert tuple(copy_from(spark, Relation.of("t", "b text, a int8"), path, {"match_by": "name"}).first()) == ("x", 1)
    assert copy_from(spark, Relation.of("t", "b text"), path, {"match_by": "name"}).first()["b"] == "x"
    with pytest.raises(FerryError, match="column count mismatch between table and parquet file. parquet file has 2 columns, but table has 1 columns"):
        copy_from(spark, Relation.of("t", "a int8"), path)
    with pytest.raises(FerryError, match='column "z" is not found in parquet file'):
        copy_from(spark, Relation.of("t", "z int8"), path, {"match_by": "name"})


def test_m10_strict_casts(spark, tmp_path):
    with pytest.raises(Exception, match="CAST_OVERFLOW|OVERFLOW"):
        copy_from(spark, Relation.of("t", "x int2"), write(tmp_path / "o.parquet", x=pa.array([1 << 40]))).collect()
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        copy_from(spark, Relation.of("t", "x int4"), write(tmp_path / "p.parquet", x=pa.array(["a"]))).collect()


def test_s4_s6_globs_of_unlike_files(spark, tmp_path):
    write(tmp_path / "d1.parquet", x=pa.array([1], pa.int16()))
    write(tmp_path / "d2.parquet", x=pa.array([2.0]))
    assert sorted(r["x"] for r in copy_from(spark, Relation.of("t", "x int8"), f"{tmp_path}/d*.parquet").collect()) == [1, 2]
    write(tmp_path / "d3.parquet", x=pa.array([1]), y=pa.array([1]))
    with pytest.raises(FerryError, match="column count mismatch"):
        copy_from(spark, Relation.of("t", "x int8"), f"{tmp_path}/d*.parquet")
    (tmp_path / "e1.parquet").write_text("not parquet")
    with pytest.raises(FerryError, match="is not a parquet file"):
        copy_from(spark, Relation.of("t", "x int8"), f"{tmp_path}/e*.parquet")


def test_s4_many_footers(spark, tmp_path):
    for k in range(40):
        write(tmp_path / f"f{k}.parquet", x=pa.array([k], pa.int16() if k % 2 else pa.int64()))
    assert copy_from(spark, Relation.of("t", "x int8"), f"{tmp_path}/f*.parquet").agg(F.sum("x")).first()[0] == sum(range(40))


def test_s11_to_s16_rules(spark, tmp_path):
    path = write(tmp_path / "r.parquet", a=pa.array([1, 2, None]), b=pa.array([10, 20, 30]))
    relation = Relation.of("t", "a int8, b int8, c text")
    rows = copy_from(spark, relation, path, columns=["a", "b"], where="a > 1")
    assert [tuple(r) for r in rows.collect()] == [(2, 20, None)]
    with pytest.raises(FerryError, match='column "z" of relation "t" does not exist'):
        copy_from(spark, relation, path, columns=["z"])
    with pytest.raises(Exception, match="violates not-null constraint"):
        copy_from(spark, Relation.of("t", "a int8 not null, b int8"), path).collect()
    generated = Relation.of("t", "a int8, b int8, s int8 generated (a + b)")
    assert [r["s"] for r in copy_from(spark, generated, path, {"match_by": "name"}).collect()] == [11, 22, None]
    with pytest.raises(FerryError, match="COPY FROM parquet with generated columns is not supported"):
        copy_from(spark, generated, path)
    with pytest.raises(FerryError, match="COPY FROM not supported with row-level security"):
        copy_from(spark, Relation.of("t", "a int8, b int8", row_policy="a > 1"), path, policy=AccessPolicy(False, frozenset({"file_read"})))


def test_s11_filter_reaches_the_scan(spark, tmp_path):
    path = write(tmp_path / "p.parquet", a=pa.array(range(10)), b=pa.array(range(10)))
    plan = copy_from(spark, Relation.of("t", "a int8, b int8"), path, where="a > 5").select("a")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(a), GreaterThan(a,5)]" in plan and "ReadSchema: struct<a:bigint>" in plan


def test_w3_relation_kinds(spark):
    df = spark.range(3).withColumnRenamed("id", "a")
    for kind in ("view", "foreign table", "sequence", "partitioned table"):
        with pytest.raises(FerryError, match=f'cannot copy from {kind} "t"'):
            select_relation(Relation.of("t", "a int8", kind=kind), df, None)
    with pytest.raises(FerryError, match="cannot copy from unpopulated materialized view"):
        select_relation(Relation.of("t", "a int8", kind="materialized view", populated=False), df, None)
    with pytest.raises(FerryError, match='column "z" does not exist'):
        select_relation(Relation.of("t", "a int8"), df, ["z"])
    policy = AccessPolicy(False)
    assert select_relation(Relation.of("t", "a int8", row_policy="a > 1"), df, None, policy).count() == 1


@pytest.mark.parametrize("codec, shown", [("uncompressed", "UNCOMPRESSED"), ("snappy", "SNAPPY"), ("gzip", "GZIP"), ("lz4", "LZ4"), ("lz4_raw", "LZ4"), ("brotli", "BROTLI"), ("zstd", "ZSTD")])
def test_w6_codecs(spark, tmp_path, codec, shown):
    copy_to(spark.range(5), f"{tmp_path}/x.parquet", {"compression": codec})
    assert inspect(spark, "metadata", f"{tmp_path}/x.parquet").first()["compression"] == shown
    assert copy_from(spark, Relation.of("t", "id int8"), f"{tmp_path}/x.parquet").count() == 5


@pytest.mark.parametrize("codec", ["snappy", "brotli"])
def test_w7_row_groups(spark, tmp_path, codec):
    copy_to(spark.range(10), f"{tmp_path}/x.parquet", {"row_group_size": 2, "compression": codec})
    assert pq.read_metadata(f"{tmp_path}/x.parquet").num_row_groups == 5
    copy_to(spark.range(20_000).selectExpr("id", "repeat(uuid(), 20) AS t"), f"{tmp_path}/y.parquet", {"row_group_size_bytes": 1 << 20, "compression": codec})
    assert pq.read_metadata(f"{tmp_path}/y.parquet").num_row_groups > 5


def test_w8_w9_split(spark, tmp_path):
    df = spark.range(100_000).selectExpr("CAST(id AS INT) AS a", "'hellooooo' || id AS t")
    options = {"file_size_bytes": "1MB", "compression": "uncompressed", "row_group_size": 10_000}
    assert copy_to(df.coalesce(1), f"{tmp_path}/s.parquet", options) == 100_000
    files = sorted((p.name for p in (tmp_path / "s.parquet").iterdir()), key=lambda n: int(n[5:-8]))
    assert len(files) > 1 and files == [f"data_{k}.parquet" for k in range(len(files))]
    assert all((tmp_path / "s.parquet" / f).stat().st_size > 1 << 20 for f in files[:-1])
    relation = Relation.of("t", "a int4, t text")
    assert copy_from(spark, relation, f"{tmp_path}/s.parquet/*.parquet").exceptAll(df).count() == 0
    copy_to(df.limit(10), f"{tmp_path}/s.parquet", options)  # children of the earlier run go
    assert copy_from(spark, relation, f"{tmp_path}/s.parquet/*.parquet").count() == 10


def test_w10_w11_s8_s9_pipes(spark, tmp_path):
    df, pipe = spark.range(4), io.BytesIO()
    relation = Relation.of("t", "id int8")
    assert copy_to_stream(df, pipe) == 4
    pipe.seek(0)
    assert copy_from_stream(spark, relation, pipe).count() == 4
    assert copy_to_program(df, f"cat > {tmp_path}/p") == 4
    assert copy_from_program(spark, relation, f"cat {tmp_path}/p").count() == 4
    with pytest.raises(FerryError, match="failed with exit code 3"):
        copy_to_program(df, "exit 3")
    with pytest.raises(FerryError, match="file_size_bytes is not supported for streams"):
        copy_to_stream(df, io.BytesIO(), {"file_size_bytes": "1MB"})


@pytest.mark.parametrize("codec", ["snappy", "brotli"])
def test_w12_w14_empty_and_overwrite(spark, tmp_path, codec):
    path = f"{tmp_path}/new/dir/e.parquet"
    assert copy_to(spark.range(0).selectExpr("id AS a", "array(id) AS b"), path, {"compression": codec}) == 0
    assert pq.read_schema(path).names == ["a", "b"]
    assert copy_to(spark.range(3).selectExpr("id AS a", "array(id) AS b"), path, {"compression": codec}) == 3
    assert [p.name for p in (tmp_path / "new/dir").iterdir() if not p.name.endswith(".crc")] == ["e.parquet"]


def test_w15_nothing_is_left_after_an_error(spark, tmp_path):
    bad = spark.range(10).selectExpr("CASE WHEN id = 9 THEN raise_error('no') ELSE 'x' END AS a")
    for options in ({}, {"compression": "brotli"}):
        with pytest.raises(Exception, match="no"):
            copy_to(bad, f"{tmp_path}/bad.parquet", options)
    assert list(tmp_path.iterdir()) == []


def test_every_field_is_nullable(spark, tmp_path):
    copy_to(spark.range(1).selectExpr("id", "named_struct('x', id) AS s", "array(id) AS l"), f"{tmp_path}/n.parquet")
    schema = pq.read_schema(f"{tmp_path}/n.parquet")
    assert all(f.nullable for f in schema) and schema.field("s").type.field(0).nullable and schema.field("l").type.value_field.nullable


def test_duplicate_names(spark, tmp_path):
    with pytest.raises(FerryError, match='duplicate attribute "a" is not allowed in parquet schema'):
        copy_to(spark.sql("SELECT 1 AS a, 2 AS a"), f"{tmp_path}/d.parquet")
    assert copy_to(spark.sql("SELECT 1 AS a, 2 AS A"), f"{tmp_path}/d.parquet") == 1
    assert pq.read_schema(f"{tmp_path}/d.parquet").names == ["a", "A"]
    assert tuple(copy_from(spark, Relation.of("t", 'x int4, y int4'), f"{tmp_path}/d.parquet").first()) == (1, 2)


def test_f2_ids_in_the_file(spark, tmp_path):
    copy_to(spark.sql("SELECT 1 AS a, named_struct('x', 1) AS s"), f"{tmp_path}/i.parquet", {"field_ids": "auto"})
    schema = pq.read_schema(f"{tmp_path}/i.parquet")
    assert [schema.field(k).metadata[b"PARQUET:field_id"] for k in (0, 1)] == [b"0", b"1"] and schema.field("s").type.field(0).metadata[b"PARQUET:field_id"] == b"2"
    copy_to(spark.sql("SELECT array(1) AS a"), f"{tmp_path}/j.parquet", {"field_ids": '{"a": {"__root_field_id": 7, "element": 9}}'})
    field = pq.read_schema(f"{tmp_path}/j.parquet").field("a")
    assert field.metadata[b"PARQUET:field_id"] == b"7" and field.type.value_field.metadata[b"PARQUET:field_id"] == b"9"


def test_p1_p2_access(spark, tmp_path):
    nobody = AccessPolicy(False)
    path = f"{tmp_path}/x.parquet"
    copy_to(spark.range(1), path)
    for f, text in ((lambda: copy_to(spark.range(1), path, policy=nobody), "COPY to a file"), (lambda: copy_from(spark, Relation.of("t", "id int8"), path, policy=nobody), "COPY from a file"), (lambda: copy_to(spark.range(1), "s3://b/k.parquet", policy=nobody), "COPY to a remote uri"), (lambda: copy_to_program(spark.range(1), "cat", policy=nobody), "COPY to a program"), (lambda: copy_from_program(spark, Relation.of("t", "id int8"), "cat", policy=nobody), "COPY from a program")):
        with pytest.raises(FerryError, match="permission denied to " + text):
            f()
    assert copy_to(spark.range(1), path, policy=AccessPolicy(False, frozenset({"file_write"}))) == 1
    grants = AccessPolicy(False, frozenset({"file_read"}), selects={"t": frozenset({"a"})}, inserts={})
    with pytest.raises(FerryError, match="permission denied for table t"):
        select_relation(Relation.of("t", "a int8, b int8"), spark.sql("SELECT 1L a, 2L b"), None, grants)
    assert select_relation(Relation.of("t", "a int8, b int8"), spark.sql("SELECT 1L a, 2L b"), ["a"], grants).columns == ["a"]
    with pytest.raises(FerryError, match="permission denied for table t"):
        copy_from(spark, Relation.of("t", "id int8"), path, policy=grants)


def test_types_print_and_parse():
    for text in ("int4[]", "map<text,int4>", "struct<a int4, b text[]>", "numeric(5,-2)", "enum('a', 'b')", "varchar(3)"):
        assert parse_type(str(parse_type(text))) == parse_type(text)
    assert parse_type("timestamp with time zone").kind == "timestamptz" and parse_type("double precision").kind == "float8"


def test_c5_http(spark, tmp_path, monkeypatch):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    stored = {}

    class Handler(BaseHTTPRequestHandler):
        def do_PUT(self):
            stored[self.path] = self.rfile.read(int(self.headers["Content-Length"]))
            self.send_response(201)
            self.end_headers()

        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(stored[self.path])

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("ALLOW_HTTP", "true")
    spark.sparkContext.environment["ALLOW_HTTP"] = "true"
    uri = f"http://127.0.0.1:{server.server_port}/x.parquet"
    assert copy_to(spark.range(6), uri) == 6
    assert copy_from(spark, Relation.of("t", "id int8"), uri).count() == 6
    server.shutdown()


def test_v1_to_v5_numbers(spark):
    from colferry.functions import convert as c

    df = spark.sql("SELECT date'2022-05-01' AS d, timestamp'2022-05-01 12:00:00.5+00:00' AS t, '15:30:12.25-03' AS z, CAST(NULL AS STRING) AS n, '00:10:00+05:30' AS w")
    row = df.select(c.days(F.col("d")), c.date_of_days(c.days(F.col("d"))), c.micros(F.col("t")), c.time_micros(F.col("z")), c.timetz_micros(F.col("z")), c.time_text(c.timetz_micros(F.col("z")), "+00"), c.timetz_micros(F.col("n")), c.time_text(c.timetz_micros(F.col("w")))).first()
    clock = ((15 * 60 + 30) * 60 + 12) * 1_000_000 + 250_000
    assert tuple(row) == (19113, dt.date(2022, 5, 1), 1651406400500000, clock, clock + 3 * 3_600_000_000, "18:30:12.25+00", None, "18:40:00")
