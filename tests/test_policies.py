"""Policies on every path, targets that must not be lost, host functions, stores' credentials."""

import io
import os

import pytest
from pyspark.sql import functions as F

from colferry.errors import FerryError
from colferry.functions.host import rewrite
from colferry.operators.access import ROLES, AccessPolicy
from colferry.operators.copy_from import copy_from, copy_from_program
from colferry.operators.copy_to import copy_to
from colferry.plans.copy_sql import Session
from colferry.sources.scan import azure_arguments, gcs_arguments
from colferry.sources.uri import parse_uri
from colferry.streaming.copy_stream import copy_stream_to, read_stream
from colferry.types import Column, Relation, SqlType


def limited(**more):
    return AccessPolicy(False, frozenset(ROLES), allow_programs=True, **more)


@pytest.fixture
def table(spark):
    spark.sql("SELECT id AS a, id * 2 AS b FROM range(3)").createOrReplaceTempView("pol_t")
    yield "pol_t"
    spark.catalog.dropTempView("pol_t")


def test_s16_p2_streams_and_programs(spark, tmp_path):
    path = f"{tmp_path}/x.parquet"
    copy_to(spark.range(3).select(F.col("id").alias("a")), path)
    relation = Relation("t", [Column("a", SqlType("int8"))], row_policy="a > 1")
    with pytest.raises(FerryError, match="row-level security"):
        copy_from(spark, relation, path, policy=limited())
    with pytest.raises(FerryError, match="row-level security"):
        copy_from_program(spark, relation, f"cat {path}", policy=limited())
    session = Session(spark, limited(inserts={}))
    session.declare("pol_in", "a int8")
    with open(path, "rb") as f, pytest.raises(FerryError, match="permission denied for table pol_in"):
        session.sql("COPY pol_in FROM STDIN (format parquet)", stdin=f)
    with pytest.raises(FerryError, match="permission denied for table pol_in"):
        session.sql(f"COPY pol_in FROM PROGRAM 'cat {path}' (format parquet)")
    session = Session(spark, limited(inserts={"pol_in": None}))
    session.declare("pol_in", "a int8")
    with open(path, "rb") as f:
        assert session.sql("COPY pol_in FROM STDIN (format parquet)", stdin=f) == 3
    spark.catalog.dropTempView("pol_in")


def rows_of(session, sql):
    out = io.BytesIO()
    session.sql(f"COPY ({sql}) TO STDOUT (format parquet)", stdout=out)
    import pyarrow.parquet as pq

    return pq.read_table(out).to_pylist()


def test_p2_p3_queries(spark, table):
    session = Session(spark, limited(selects={table: None}))
    session.declare(table, "a int8, b int8", row_policy="a > 1")
    assert rows_of(session, f"SELECT * FROM {table}") == [{"a": 2, "b": 4}]
    assert rows_of(session, f"SELECT count(*) AS n FROM range(1) WHERE EXISTS (SELECT 1 FROM {table} WHERE a = 0)") == [{"n": 0}]
    assert rows_of(session, f"WITH x AS (SELECT b FROM {table} q) SELECT sum(x.b) AS s FROM x JOIN {table} ON x.b = {table}.b") == [{"s": 4}]
    assert spark.table(table).count() == 3  # the view is back
    assert len(rows_of(Session(spark), f"SELECT * FROM {table}")) == 3
    with pytest.raises(FerryError, match=f"permission denied for table {table}"):
        rows_of(Session(spark, limited(selects={})), f"SELECT 1 AS x FROM {table}")
    narrow = Session(spark, limited(selects={table: frozenset({"a"})}))
    assert len(rows_of(narrow, f"SELECT a FROM {table}")) == 3
    for sql in (f"SELECT b FROM {table}", f"SELECT * FROM {table}", f"SELECT a FROM {table} WHERE b > 1"):
        with pytest.raises(FerryError, match="permission denied"):
            rows_of(narrow, sql)
    assert spark.table(table).columns == ["a", "b"]


@pytest.mark.parametrize("options", [None, {"compression": "brotli"}])
def test_w12_directories_are_refused(spark, tmp_path, options):
    keep = tmp_path / "dir" / "sub"
    keep.mkdir(parents=True)
    (keep / "precious.txt").write_text("x")
    with pytest.raises(FerryError, match="Is a directory"):
        copy_to(spark.range(3).toDF("a"), f"{tmp_path}/dir", {"format": "parquet", **(options or {})})
    assert (keep / "precious.txt").read_text() == "x"
    assert os.listdir(tmp_path) == ["dir"]


@pytest.mark.parametrize("options", [None, {"compression": "brotli"}, {"file_size_bytes": "1MB"}])
def test_w12_a_failed_export_keeps_the_old_file(spark, tmp_path, options):
    path = f"{tmp_path}/x.parquet"
    good = spark.range(3).toDF("a")
    copy_to(good, path, options)
    with pytest.raises(Exception, match="no way"):
        copy_to(good.select(F.when(F.col("a") == 2, F.raise_error(F.lit("no way"))).otherwise(F.col("a")).alias("a")), path, options)
    assert copy_from(spark, Relation.of("t", "a int8"), path if not options or "compression" in options else f"{path}/*.parquet").count() == 3
    copy_to(good.limit(1), path, options)
    assert copy_from(spark, Relation.of("t", "a int8"), path if not options or "compression" in options else f"{path}/*.parquet").count() == 1


def test_host_functions(spark):
    session = Session(spark)
    row = session.query("SELECT gen_random_uuid() AS u, encode(X'095C2700ff41', 'escape') AS e, encode(X'0aff', 'hex') AS h, encode(X'01', 'base64') AS b, point(10, 11.5) AS p, ST_GeomFromText('POINT(1 2)') AS g, encode('a', 'UTF-8') AS s").first()
    assert len(row["u"]) == 36 and row["e"] == "\t\\\\'\\000\\377A" and row["h"] == "0aff" and row["b"] == "AQ==" and row["p"] == "(10,11.5)"
    assert bytes(row["g"]).hex() == "0101000000000000000000f03f0000000000000040" and bytes(row["s"]) == b"a"
    assert session.query("SELECT encode(X'', 'escape') AS e").first()["e"] == ""


def test_rewriting_leaves_literals():
    for text in ("SELECT 'encode(x, ''hex'')'", 'SELECT "encode(x, \'hex\')"', "SELECT 1 -- encode(x, 'hex')", "SELECT encode(x, 'UTF-8')"):
        assert rewrite(text) == text
    assert rewrite("SELECT encode(f(a, ')'), 'hex'), encode(encode(b,'escape'), 'hex')") == "SELECT ferry_to_hex(f(a, ')')), ferry_to_hex(ferry_to_escape(b))"


def test_table_functions_outside_literals(spark, tmp_path):
    path = f"{tmp_path}/x.parquet"
    copy_to(spark.range(3).toDF("a"), path)
    session = Session(spark)
    row = session.query(f"SELECT num_rows, \"parquet.schema('x')\" AS s, 'parquet.schema(''x'')' AS q FROM parquet.file_metadata('{path}') -- parquet.schema('y')").first()
    assert tuple(row) == (3, "parquet.schema('x')", "parquet.schema('x')")


def test_c3_c4_arrow_credentials(monkeypatch):
    for name in ("AZURE_STORAGE_ACCOUNT", "AZURE_STORAGE_KEY", "AZURE_STORAGE_SAS_TOKEN", "AZURE_CLIENT_ID", "AZURE_CLIENT_SECRET", "AZURE_TENANT_ID", "GOOGLE_APPLICATION_CREDENTIALS", "GOOGLE_SERVICE_ACCOUNT_KEY"):
        monkeypatch.delenv(name, raising=False)
    monkeypatch.setenv("AZURE_STORAGE_CONNECTION_STRING", "AccountName=acc;AccountKey=a2V5")
    assert azure_arguments(parse_uri("az://box/x.parquet")) == {"account_name": "acc", "account_key": "a2V5"}
    monkeypatch.delenv("AZURE_STORAGE_CONNECTION_STRING")
    for k, v in (("AZURE_STORAGE_ACCOUNT", "acc"), ("AZURE_CLIENT_ID", "i"), ("AZURE_CLIENT_SECRET", "s"), ("AZURE_TENANT_ID", "t")):
        monkeypatch.setenv(k, v)
    assert azure_arguments(parse_uri("az://box/x.parquet")) == {"account_name": "acc", "client_id": "i", "client_secret": "s", "tenant_id": "t"}
    monkeypatch.setenv("GOOGLE_SERVICE_ACCOUNT_PATH", "/k.json")
    assert gcs_arguments(parse_uri("gs://box/x.parquet")) == {} and os.environ.pop("GOOGLE_APPLICATION_CREDENTIALS") == "/k.json"
    monkeypatch.delenv("GOOGLE_SERVICE_ACCOUNT_PATH")
    monkeypatch.setenv("GOOGLE_SERVICE_ACCOUNT_KEY", '{"k": 1}')
    gcs_arguments(parse_uri("gs://box/x.parquet"))
    with open(os.environ.pop("GOOGLE_APPLICATION_CREDENTIALS")) as f:
        assert f.read() == '{"k": 1}'


def test_streams_may_split(spark, tmp_path):
    copy_to(spark.range(1000).toDF("a"), f"{tmp_path}/in/x.parquet")
    relation = Relation.of("t", "a int8")
    copy_stream_to(read_stream(spark, relation, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check", {"file_size_bytes": "1MB"}, once=True).awaitTermination()
    assert copy_from(spark, relation, f"{tmp_path}/out/**/data_*.parquet").count() == 1000
    assert read_stream(spark, relation, f"{tmp_path}/out").isStreaming


def test_c5_http_by_ranges(spark, tmp_path, monkeypatch):
    """From a server with ranges only parts are read, and no file is left."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from colferry.sources.scan import footer

    path = f"{tmp_path}/x.parquet"
    copy_to(spark.range(300_000).toDF("a"), path)
    with open(path, "rb") as f:
        data = f.read()
    sent = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            first, last = self.headers["Range"].removeprefix("bytes=").split("-")
            part = data[int(first) : int(last) + 1]
            sent.append(len(part))
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {first}-{int(first) + len(part) - 1}/{len(data)}")
            self.end_headers()
            self.wfile.write(part)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("ALLOW_HTTP", "true")
    spark.sparkContext.environment["ALLOW_HTTP"] = "true"
    uri = f"http://127.0.0.1:{server.server_port}/x.parquet"
    assert footer(uri).num_rows == 300_000 and sum(sent) < len(data) / 2
    assert copy_from(spark, Relation.of("t", "a int8"), uri).agg(F.sum("a")).first()[0] == 300_000 * 299_999 // 2
    server.shutdown()
