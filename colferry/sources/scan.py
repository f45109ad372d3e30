"""Parquet scans by the files' own schemas, which are read from their footers and never inferred by Spark."""

from __future__ import annotations

import atexit
import base64
import io
import os
import shutil
import tempfile
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from colferry.errors import FerryError
from colferry.sources.uri import Uri, parse_uri, store_conf

#: Files whose footers the driver reads itself; more are read by tasks.
DRIVER_FOOTERS = 32


def open_fs(uri: Uri) -> tuple[pafs.FileSystem, str]:
    """An Arrow filesystem and the path in it."""
    if uri.scheme == "file":
        return pafs.LocalFileSystem(), uri.path
    if uri.scheme == "s3":
        conf = store_conf(uri)
        keys = {"access_key": "fs.s3a.access.key", "secret_key": "fs.s3a.secret.key", "session_token": "fs.s3a.session.token", "region": "fs.s3a.endpoint.region", "endpoint_override": "fs.s3a.endpoint"}
        return pafs.S3FileSystem(**{k: conf[v] for k, v in keys.items() if v in conf}), f"{uri.bucket}/{uri.path}"
    if uri.scheme in ("http", "https"):
        return pafs.PyFileSystem(HttpFiles()), uri.text
    if uri.scheme == "azure":
        return pafs.AzureFileSystem(**azure_arguments(uri)), f"{uri.bucket}/{uri.path}"
    if uri.scheme == "gs":
        return pafs.GcsFileSystem(**gcs_arguments(uri)), f"{uri.bucket}/{uri.path}"
    fs, path = pafs.FileSystem.from_uri(uri.hadoop)
    return fs, path


class _HttpFile(io.RawIOBase):
    """A file read by ranges; from a server that has none, by way of a nameless temporary file."""

    def __init__(self, url: str) -> None:
        self.url, self.at, self.spool = url, 0, None
        with urllib.request.urlopen(urllib.request.Request(url, headers={"Range": "bytes=0-0"})) as answer:
            if answer.status == 206:
                self.size = int(answer.headers["Content-Range"].rpartition("/")[2])
                return
            self.spool = tempfile.TemporaryFile()  # gone with its handle, however the process ends
            shutil.copyfileobj(answer, self.spool, 65_536)
            self.size = self.spool.tell()

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, to: int, whence: int = 0) -> int:
        self.at = (0, self.at, self.size)[whence] + to
        return self.at

    def readinto(self, out) -> int:
        n = min(len(out), self.size - self.at)
        if n <= 0:
            return 0
        if self.spool:
            self.spool.seek(self.at)
            data = self.spool.read(n)
        else:
            with urllib.request.urlopen(urllib.request.Request(self.url, headers={"Range": f"bytes={self.at}-{self.at + n - 1}"})) as answer:
                data = answer.read(n)
        out[: len(data)] = data
        self.at += len(data)
        return len(data)

    def close(self) -> None:
        if self.spool:
            self.spool.close()
        super().close()


class HttpFiles(pafs.FileSystemHandler):
    """Single files over HTTP, for reading; paths are URLs."""

    def get_type_name(self) -> str:
        return "http"

    def normalize_path(self, path: str) -> str:
        return path

    def open_input_file(self, path: str) -> pa.NativeFile:
        return pa.PythonFile(io.BufferedReader(_HttpFile(path), 1 << 16), mode="r")

    open_input_stream = open_input_file

    def get_file_info(self, paths: list[str]) -> list[pafs.FileInfo]:
        return [pafs.FileInfo(p, pafs.FileType.File) for p in paths]

    def _refuse(self, *args, **more):
        raise FerryError("http(s) targets are single files, to be read or put as a whole")

    get_file_info_selector = create_dir = delete_dir = delete_dir_contents = delete_root_dir_contents = delete_file = _refuse
    move = copy_file = open_output_stream = open_append_stream = _refuse


def azure_arguments(uri: Uri) -> dict[str, str]:
    """Arrow's arguments for the credentials that store_conf finds for Hadoop."""
    conf = store_conf(uri)
    account = next((k.split(".")[-5] for k in conf if k.endswith(".dfs.core.windows.net")), uri.account or os.environ.get("AZURE_STORAGE_ACCOUNT", ""))
    host = f"{account}.dfs.core.windows.net"
    tenant = conf.get(f"fs.azure.account.oauth2.client.endpoint.{host}", "").removeprefix("https://login.microsoftonline.com/").partition("/")[0]
    found = {
        "account_key": conf.get(f"fs.azure.account.key.{host}"),
        "sas_token": conf.get(f"fs.azure.sas.fixed.token.{host}"),
        "client_id": conf.get(f"fs.azure.account.oauth2.client.id.{host}"),
        "client_secret": conf.get(f"fs.azure.account.oauth2.client.secret.{host}"),
        "tenant_id": tenant or None,
    }
    return {"account_name": account} | {k: v for k, v in found.items() if v}


def gcs_arguments(uri: Uri) -> dict[str, str]:
    """Arrow takes a service account from the file that the environment names; here it is named, and written if need be."""
    conf = store_conf(uri)
    if path := conf.get("fs.gs.auth.service.account.json.keyfile"):
        os.environ.setdefault("GOOGLE_APPLICATION_CREDENTIALS", path)
    elif key := conf.get("fs.gs.auth.service.account.json"):
        if "GOOGLE_APPLICATION_CREDENTIALS" not in os.environ:
            fd, path = tempfile.mkstemp(prefix="colferry-", suffix=".json")  # for this process alone
            with os.fdopen(fd, "w") as f:
                f.write(key)
            atexit.register(lambda: os.path.exists(path) and os.remove(path))
            os.environ["GOOGLE_APPLICATION_CREDENTIALS"] = path
    return {}


def footer(text: str) -> pq.FileMetaData:
    fs, path = open_fs(parse_uri(text))
    try:
        with fs.open_input_file(path) as f:
            return pq.ParquetFile(f).metadata
    except FileNotFoundError:
        raise FerryError(f"failed to get object store metadata for uri {text}") from None
    except pa.ArrowInvalid as e:
        raise FerryError(f"{text} is not a parquet file: {e}") from None


@dataclass
class FileGroup:
    """Files that share a schema."""

    schema: pa.Schema
    paths: list[str]
    brotli: bool


def file_groups(spark: SparkSession, paths: list[str]) -> list[FileGroup]:
    """Files by their footer's schema; many footers are read by tasks, of which each schema comes back once a task."""

    def read(path: str) -> tuple[bytes, bool]:
        m = footer(path)
        brotli = any(m.row_group(g).column(c).compression == "BROTLI" for g in range(min(1, m.num_row_groups)) for c in range(m.num_columns))
        return m.schema.to_arrow_schema().serialize().to_pybytes(), brotli

    found: dict[tuple[bytes, bool], list[str]] = {}
    if len(paths) <= DRIVER_FOOTERS:
        for p in paths:
            found.setdefault(read(p), []).append(p)
    else:

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [read(p) for p in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([base64.b64encode(s).decode() for s, _ in rows]), pa.array([b for _, b in rows])], names=["path", "schema", "brotli"])

        listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), 256))
        for r in listed.mapInArrow(work, "path string, schema string, brotli boolean").groupBy("schema", "brotli").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect():
            found[base64.b64decode(r["schema"]), r["brotli"]] = r["paths"]
    return [FileGroup(pa.ipc.read_schema(pa.py_buffer(s)), p, b) for (s, b), p in found.items()]


def read_type(t: pa.DataType) -> T.DataType:
    """The Spark type by which a file's column is read as it is."""
    if isinstance(t, pa.BaseExtensionType):
        return read_type(t.storage_type)
    if pa.types.is_struct(t):
        return T.StructType([T.StructField(f.name, read_type(f.type)) for f in t])
    if pa.types.is_map(t):
        return T.MapType(read_type(t.key_type), read_type(t.item_type))
    if pa.types.is_list(t) or pa.types.is_large_list(t) or pa.types.is_fixed_size_list(t):
        return T.ArrayType(read_type(t.value_type))
    if pa.types.is_dictionary(t):
        return read_type(t.value_type)
    if pa.types.is_decimal(t):
        return T.DecimalType(t.precision, t.scale)
    if pa.types.is_timestamp(t):
        return T.LongType() if t.unit == "ns" else T.TimestampType() if t.tz else T.TimestampNTZType()
    if pa.types.is_time(t):
        return T.TimeType(6)
    table = {
        pa.bool_(): T.BooleanType(), pa.int8(): T.ByteType(), pa.int16(): T.ShortType(), pa.int32(): T.IntegerType(), pa.int64(): T.LongType(),
        pa.uint8(): T.ShortType(), pa.uint16(): T.IntegerType(), pa.uint32(): T.LongType(), pa.uint64(): T.DecimalType(20, 0),
        pa.float32(): T.FloatType(), pa.float64(): T.DoubleType(), pa.date32(): T.DateType(), pa.string(): T.StringType(), pa.large_string(): T.StringType(),
        pa.binary(): T.BinaryType(), pa.large_binary(): T.BinaryType(), pa.float16(): T.BinaryType(),
    }
    if t in table:
        return table[t]
    if pa.types.is_fixed_size_binary(t):
        return T.BinaryType()
    raise FerryError(f"unsupported type in parquet file: {t}")


def _settle(c: Column, t: pa.DataType) -> Column:
    """What the read type holds raw (nanoseconds, half floats), at the top of a column."""
    if pa.types.is_timestamp(t) and t.unit == "ns":
        stamp = F.timestamp_micros(F.floor(c / 1000).cast("long"))
        return stamp if t.tz else stamp.cast("timestamp_ntz")
    if t == pa.float16():
        bits = F.conv(F.concat(F.substring(F.hex(c), 3, 2), F.substring(F.hex(c), 1, 2)), 16, 10).cast("int")
        sign = F.when(bits >= 32768, -1.0).otherwise(1.0)
        exponent, part = F.floor(bits % 32768 / 1024), bits % 1024
        value = F.when(exponent == 0, part * 2.0**-24).when(exponent == 31, F.when(part == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))).otherwise(F.pow(F.lit(2.0), exponent - 15) * (1 + part / 1024.0))
        return (sign * value).cast("float")
    return c


def scan(spark: SparkSession, group: FileGroup) -> DataFrame:
    """The files' columns, named c0, c1, ... in their order (names in a file need not be unique to Spark)."""
    names = [f.name for f in group.schema]
    kinds = [read_type(f.type) for f in group.schema]
    paths = [parse_uri(p) for p in group.paths]
    alike = len({n.lower() for n in names}) < len(names)  # names that Spark may not tell apart
    if alike or group.brotli or any(p.scheme in ("http", "https") for p in paths):
        schema = T.StructType([T.StructField(f"c{k}", t) for k, t in enumerate(kinds)])
        target = [_arrow_read(f.type) for f in group.schema]

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    fs, path = open_fs(parse_uri(text))
                    with fs.open_input_file(path) as f:
                        for part in pq.ParquetFile(f).iter_batches(batch_size=4096):
                            cols = [_storage(c).cast(t) for c, t in zip(part.columns, target)]
                            yield pa.RecordBatch.from_arrays(cols, names=[f"c{k}" for k in range(len(cols))])

        out = spark.createDataFrame([(p,) for p in group.paths], "path string").repartition(len(group.paths)).mapInArrow(read, schema)
    else:
        for p in paths:
            for k, v in store_conf(p).items():
                spark._jsc.hadoopConfiguration().set(k, v)
        schema = T.StructType([T.StructField(n, t) for n, t in zip(names, kinds)])
        out = spark.read.schema(schema).parquet(*[p.hadoop for p in paths]).toDF(*[f"c{k}" for k in range(len(names))])
    return out.select(*[_settle(F.col(f"c{k}"), f.type).alias(f"c{k}") for k, f in enumerate(group.schema)])


def _storage(c: pa.Array) -> pa.Array:
    return c.storage if isinstance(c, pa.ExtensionArray) else c


def _arrow_read(t: pa.DataType) -> pa.DataType:
    return to_arrow_type(read_type(t))
