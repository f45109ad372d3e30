"""A target of one file is written by all tasks: parts of it, joined as they are."""

import os
import subprocess
import sys
from pathlib import Path

import pyarrow.fs as pafs
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from colferry.functions.footer import inspect
from colferry.operators import joined, sink
from colferry.operators.copy_to import copy_to
from colferry.sources.uri import Uri

ROOT = str(Path(__file__).resolve().parents[1])
SCRIPT = """
import glob, json, sys
from pyspark.sql import SparkSession
from colferry.operators import sink
from colferry.operators.copy_to import copy_to

folder, codec = sys.argv[1:]
sink.FILE_ROWS = 1000
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", folder)
         .config("spark.eventLog.rolling.enabled", "false").config("spark.eventLog.compress", "false").getOrCreate())
copy_to(spark.range(0, 40_000, 1, 7).selectExpr("id", "sha2(CAST(id AS STRING), 256) AS s"), f"{folder}/x.parquet", {"row_group_size": 500, "compression": codec})
spark.stop()
most = 0
for line in open(glob.glob(f"{folder}/local-*")[0]):
    e = json.loads(line)
    if e["Event"] == "SparkListenerTaskEnd":
        most = max(most, e["Task Metrics"]["Shuffle Read Metrics"]["Total Records Read"])
print("MOST", most)
"""


@pytest.mark.parametrize("codec", ["snappy", "brotli"])  # Spark's writer and Arrow's
def test_no_task_reads_all_rows(tmp_path, codec):
    env = os.environ | {"PYTHONPATH": os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")]), "PYSPARK_PYTHON": sys.executable}
    for name in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET", "PYSPARK_SUBMIT_ARGS"):
        env.pop(name, None)
    out = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path), codec], env=env, capture_output=True, text=True, timeout=240)
    assert "MOST" in out.stdout, out.stderr[-3000:]
    assert int(out.stdout.rpartition("MOST")[2]) <= 1000
    assert pq.read_table(tmp_path / "x.parquet").column("id").to_pylist().__len__() == 40_000


@pytest.mark.parametrize("codec", ["snappy", "brotli"])
@pytest.mark.parametrize("ordered", [False, True])
def test_row_groups_and_rows_as_by_one_task(spark, tmp_path, monkeypatch, codec, ordered):
    monkeypatch.setattr(sink, "FILE_ROWS", 20)
    monkeypatch.setattr(joined, "DRIVER_BYTES", 0)  # tasks do it
    rows = spark.range(0, 500, 1, 6).where("id % 11 <> 3").selectExpr("1000 - id AS id", "named_struct('x', id, 'l', array('a', CAST(id AS STRING))) AS s", "IF(id % 5 = 0, NULL, id / 4) AS d")
    rows = rows.orderBy("id") if ordered else rows
    assert copy_to(rows, f"{tmp_path}/x.parquet", {"row_group_size": 7, "compression": codec, "field_ids": "auto" if codec == "snappy" else "none"}) == rows.count()
    meta = pq.read_metadata(f"{tmp_path}/x.parquet")
    sizes = [meta.row_group(k).num_rows for k in range(meta.num_row_groups)]
    assert meta.num_rows == sum(sizes) == rows.count() and set(sizes[:-1]) == {7} and 0 < sizes[-1] <= 7
    got, due = pq.read_table(f"{tmp_path}/x.parquet").to_pylist(), [r.asDict(True) for r in rows.collect()]
    assert (got if ordered else sorted(got, key=lambda r: r["id"])) == (due if ordered else sorted(due, key=lambda r: r["id"]))
    assert sorted(os.listdir(tmp_path)) == ["x.parquet"]


def test_page_indexes_lead_to_their_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sink, "FILE_ROWS", 50_000)
    rows = spark.range(0, 300_000, 1, 5).selectExpr("id", "id * 7 AS x")
    copy_to(rows.orderBy("id"), f"{tmp_path}/x.parquet", {"row_group_size": 50_000})
    meta = pq.read_metadata(f"{tmp_path}/x.parquet")
    assert meta.num_row_groups == 6 and all(meta.row_group(g).column(k).has_offset_index and meta.row_group(g).column(k).has_column_index for g in range(6) for k in (0, 1))
    back = spark.read.parquet(f"{tmp_path}/x.parquet")
    for at in (3, 49_999, 50_000, 147_123, 299_999):  # a page or two of three in a group
        assert [tuple(r) for r in back.where(F.col("id") == at).collect()] == [(at, at * 7)]


def test_stores_are_written_from_start_to_end(spark, tmp_path, monkeypatch):
    for k in range(3):
        copy_to(spark.range(10 * k, 10 * k + 10, 1, 1), f"{tmp_path}/{k}.parquet", {"row_group_size": 4})
    local = pafs.LocalFileSystem()
    monkeypatch.setattr(joined, "open_fs", lambda uri: (local, uri.path))
    home = Uri("", "s3", "", str(tmp_path), None)
    joined.join(spark, home, joined.surveys(spark, home, [f"{tmp_path}/{k}.parquet" for k in range(3)]), f"{tmp_path}/whole")
    assert pq.read_table(tmp_path / "whole").column("id").to_pylist() == list(range(30)) and pq.read_metadata(tmp_path / "whole").num_row_groups == 9
    assert [r["id"] for r in spark.read.parquet(f"{tmp_path}/whole").where("id > 27").collect()] == [28, 29]


def test_more_row_groups_than_ordinals(spark, tmp_path):
    copy_to(spark.range(0, 40_000, 1, 4), f"{tmp_path}/x.parquet", {"row_group_size": 1})
    assert pq.read_metadata(f"{tmp_path}/x.parquet").num_row_groups == 40_000
    assert spark.read.parquet(f"{tmp_path}/x.parquet").agg(F.sum("id")).first()[0] == sum(range(40_000))


def test_old_checksums_do_not_outlive_their_file(spark, tmp_path):
    copy_to(spark.range(0, 10, 1, 1), f"{tmp_path}/x.parquet")
    assert ".x.parquet.crc" in os.listdir(tmp_path)
    copy_to(spark.range(0, 100, 1, 3), f"{tmp_path}/x.parquet", {"row_group_size": 30})
    assert spark.read.parquet(f"{tmp_path}/x.parquet").count() == 100 and spark.read.parquet(f"{tmp_path}/x.parquet").agg(F.sum("id")).first()[0] == 4950


@pytest.mark.parametrize("codec", ["snappy", "brotli"])
def test_no_more_bytes_are_put_together_than_a_row_group_has(spark, tmp_path, codec):
    rows = spark.range(0, 600, 1, 24).selectExpr("id", "repeat(uuid(), 300) AS t")  # 6 MB, all tasks' rows are fewer than a row group's
    copy_to(rows, f"{tmp_path}/x.parquet", {"row_group_size_bytes": 1 << 20, "compression": codec})
    meta = pq.read_metadata(f"{tmp_path}/x.parquet")
    assert meta.num_rows == 600 and 5 <= meta.num_row_groups <= 14
    assert sorted(pq.read_table(f"{tmp_path}/x.parquet").column("id").to_pylist()) == list(range(600))
    limit = sink._together(sink.CopyToOptions(row_group_size_bytes=1 << 20), 600, 600 * 10_800)
    assert 90 <= limit <= 100 and sink._together(sink.CopyToOptions(row_group_size=30, row_group_size_bytes=1 << 20), 600, 600 * 10_800) == 90


def test_long_footers_are_decoded_in_parts(spark, tmp_path, monkeypatch):
    copy_to(spark.range(0, 3000, 1, 3).selectExpr("id", "CAST(IF(id % 3 = 0, NULL, id) AS STRING) AS t", "named_struct('x', -id) AS s"), f"{tmp_path}/x.parquet", {"row_group_size": 10, "field_ids": "auto"})
    whole = [tuple(r) for r in inspect(spark, "column_stats", f"{tmp_path}/x.parquet").collect()]
    monkeypatch.setattr(joined, "FOOTER_BYTES", 5000)
    parts = list(joined.footers(f"{tmp_path}/x.parquet"))
    assert len(parts) > 5 and sum(m.num_row_groups for m in parts) == 300
    assert [tuple(r) for r in inspect(spark, "column_stats", f"{tmp_path}/x.parquet").collect()] == whole
    assert [r[2:5] for r in whole] == [("0", "2999", 0), ("1", "998", 1000), ("-2999", "0", 0)]
