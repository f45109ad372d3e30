"""The two Parquet sinks: Spark's own writer, and an Arrow writer in the tasks for what that one cannot express.

Either way tasks write under temporary names next to the target and the driver renames what successful tasks report,
so a retried or lost task leaves nothing behind that counts. All tasks write at once: the files of a split target, or
parts of a target of one file, of up to FILE_ROWS rows (or one row group), which are then joined as they are. Row groups
are as one task would have made them: the ends of tasks' rows, too few for a row group, are put together first.
"""

from __future__ import annotations

import re
import urllib.request
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colferry.errors import FerryError
from colferry.functions.convert import to_storage
from colferry.functions.geo import geo_metadata
from colferry.operators.joined import Part, join, surveys
from colferry.options import CopyToOptions, assign_field_ids, children
from colferry.scratch import Scratch
from colferry.sources.scan import open_fs
from colferry.sources.uri import Uri, parse_uri
from colferry.types import ARROW_ONLY, SqlType, arrow_type, of_spark, spark_type

BATCH_ROWS = 1024
#: Rows that a part of a file has at most, unless its one row group has more.
FILE_ROWS = 122_880
_GZIP = {1: "BEST_SPEED", 2: "TWO", 3: "THREE", 4: "FOUR", 5: "FIVE", 6: "SIX", 7: "SEVEN", 8: "EIGHT", 9: "BEST_COMPRESSION"}


def columns_of(df: DataFrame) -> list[tuple[str, SqlType]]:
    seen: set[str] = set()
    for f in df.schema:
        if f.name in seen:
            raise FerryError(f'duplicate attribute "{f.name}" is not allowed in parquet schema')
        seen.add(f.name)
    return [(f.name, of_spark(f)) for f in df.schema]


def needs_arrow(columns: list[tuple[str, SqlType]], options: CopyToOptions, ids: dict) -> bool:
    inner = any(t.kind in ("array", "map") for path in ids for t in _parents(columns, path))
    return (
        options.compression == "brotli" or options.compression_level == 0 or options.file_size_bytes is not None or options.parquet_version != "v1" or inner
        or any(x.kind in ARROW_ONLY for _, t in columns for x in t.walk())
    )


def _parents(columns: list[tuple[str, SqlType]], path: tuple[str, ...]) -> Iterator[SqlType]:
    known = columns
    for name in path[:-1]:
        t = dict(known)[name]
        yield t
        known = children(t)


def export_schema(columns: list[tuple[str, SqlType]], ids: dict[tuple[str, ...], int]) -> pa.Schema:
    """The Arrow schema of a file, with field ids where given."""

    def made(name: str, t: SqlType, path: tuple[str, ...], nullable: bool = True) -> pa.Field:
        if t.kind == "array":
            kind = pa.list_(made("element", t.element, (*path, "element")))
        elif t.kind == "map":
            kind = pa.map_(made("key", t.key, (*path, "key"), False), made("value", t.element, (*path, "val")))
        elif t.kind == "struct":
            kind = pa.struct([made(n, x, (*path, n)) for n, x in t.fields])
        else:
            kind = arrow_type(t)
        meta = {b"PARQUET:field_id": str(ids[path]).encode()} if path in ids else None
        return pa.field(name, kind, nullable, meta)

    out = pa.schema([made(n, t, (n,)) for n, t in columns])
    geo = geo_metadata(columns)
    return out.with_metadata({"geo": geo}) if geo else out


def _conform(c: pa.Array, t: pa.DataType) -> pa.Array:
    """An array as Spark sends it, as the file's type has it."""
    if isinstance(t, pa.BaseExtensionType):
        return pa.ExtensionArray.from_storage(t, _conform(c, t.storage_type))
    if pa.types.is_struct(t):
        return pa.StructArray.from_arrays([_conform(c.field(k), f.type) for k, f in enumerate(t)], fields=list(t), mask=c.is_null())
    if pa.types.is_list(t):
        return pa.ListArray.from_arrays(_offsets(c), _conform(c.values, t.value_type), type=t)
    if pa.types.is_map(t):
        return pa.MapArray.from_arrays(_offsets(c), _conform(c.keys, t.key_type), _conform(c.items, t.item_type), type=t)
    return c.cast(t)


def _offsets(c: pa.Array) -> pa.Array:
    """Offsets with nulls where a row is null."""
    ends = c.offsets.to_pylist()
    nulls = c.is_null().to_pylist()
    return pa.array([None if n else e for e, n in zip(ends, [*nulls, False])], pa.int32())


def store(df: DataFrame, columns: list[tuple[str, SqlType]]) -> DataFrame:
    """Columns as they are stored, named c0, c1, ..."""
    plain = df.toDF(*[f"c{k}" for k in range(len(columns))])
    fit = lambda c, d, t: c.cast(spark_type(t)) if t.kind == "int2" and d != spark_type(t) else c
    return plain.select(*[to_storage(fit(F.col(f"c{k}"), df.schema[k].dataType, t), t).alias(f"c{k}") for k, (_, t) in enumerate(columns)])


def write_parquet(df: DataFrame, uri: str, options: CopyToOptions | None = None) -> int:
    """Writes df to one file, or to data_0.parquet, data_1.parquet, ... below uri where file_size_bytes is set. Rows written."""
    options = options or CopyToOptions.parse({}, uri)
    columns = columns_of(df)
    ids = assign_field_ids(columns, options.field_ids)
    target = parse_uri(uri)
    if target.scheme in ("http", "https"):
        return _put(df, target, options)
    if needs_arrow(columns, options, ids):
        return _write_arrow(df, columns, target, options, ids)
    return _write_native(df, columns, target, options, ids)


def _put(df: DataFrame, target: Uri, options: CopyToOptions) -> int:
    """Over HTTP: written here first, then sent."""
    if options.file_size_bytes:
        raise FerryError("file_size_bytes is not supported for http(s) targets")
    uri = f"{Scratch(df.sparkSession).root}/out.parquet"
    rows = write_parquet(df, uri, options)
    fs, path = open_fs(parse_uri(uri))
    with fs.open_input_stream(path) as body:
        request = urllib.request.Request(target.text, body, {"Content-Length": str(fs.get_file_info(path).size)}, method="PUT")
        urllib.request.urlopen(request).close()
    fs.delete_file(path)
    return rows


# --- Spark's writer ---


def _write_native(df: DataFrame, columns: list[tuple[str, SqlType]], target: Uri, options: CopyToOptions, ids: dict) -> int:
    spark = df.sparkSession
    stored = store(df, columns)
    # every exported column is nullable; the id, which is never negative, keeps the optimizer from seeing through it
    free = lambda c, f, t: _freed(c, f.dataType, t) if f.nullable else F.when(F.monotonically_increasing_id() >= 0, _freed(c, f.dataType, t))
    named = stored.select(*[free(F.col(f"c{k}"), stored.schema[k], columns[k][1]).alias(n, metadata={"parquet.field.id": ids[(n,)]} if (n,) in ids else {}) for k, (n, _) in enumerate(columns)])
    if ids:
        named = named.to(_with_ids(named.schema, ids))
    fs, out = _hadoop(spark, target)
    if fs.exists(out) and fs.getFileStatus(out).isDirectory():
        raise _is_folder(target)
    mark = f".tmp-{uuid.uuid4().hex}"
    folder = _hadoop_path(spark, f"{out.getParent()}/{mark}")
    home, limit = _beside(target, mark), _part_rows(options)
    wanted = {"spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS", "spark.sql.timeType.enabled": "true", "spark.sql.caseSensitive": "true", "spark.sql.parquet.fieldId.write.enabled": "true", "spark.sql.session.timeZone": "UTC"}

    def written(rows: DataFrame, name: str) -> list[Part]:
        writer = rows.write.option("compression", options.compression).option("parquet.block.size", options.row_group_size_bytes).option("parquet.block.row.count.limit", options.row_group_size).option("parquet.page.size.row.check.max", BATCH_ROWS).option("maxRecordsPerFile", limit)
        if options.compression == "gzip":
            writer = writer.option("zlib.compress.level", _GZIP[options.compression_level])
        if options.compression == "zstd":
            writer = writer.option("parquet.compression.codec.zstd.level", options.compression_level)
        writer.parquet(f"{folder}/{name}")
        found = {tuple(map(int, m.groups())): f.getPath().getName() for f in fs.listStatus(_hadoop_path(spark, f"{folder}/{name}")) if (m := re.match(r"part-(\d+)-.*-c(\d+)\.", f.getPath().getName()))}
        return surveys(spark, home, [f"{open_fs(home)[1]}/{name}/{found[k]}" for k in sorted(found)])

    with conf(spark, wanted):
        try:
            parts = written(named, "a")
            parts = [p for p in parts if p.rows] or parts[:1]
            short = lambda p: p.rows % options.row_group_size != 0 and 2 * p.last_bytes < options.row_group_size_bytes
            parts, rest = _settled(parts, [short(p) for p in parts], _ordered(df))
            if rest:
                again = _together(options, sum(p.rows for p in rest), sum(p.bytes for p in rest))
                parts += written(_regrouped(spark, named.schema, f"{folder}/a", rest, again), "b")
            last = parts[0].path
            if len(parts) > 1:
                join(spark, home, parts, last := f"{open_fs(home)[1]}/whole")
            _forget_sums(target)
            _replace(spark, fs, _hadoop_path(spark, f"{folder}/{last.removeprefix(open_fs(home)[1] + '/')}"), out)
        finally:
            fs.delete(folder, True)
    return sum(p.rows for p in parts)


def _beside(target: Uri, name: str) -> Uri:
    return Uri(target.text, target.scheme, target.bucket, f"{target.path.rpartition('/')[0]}/{name}", target.account)


def _part_rows(options: CopyToOptions) -> int:
    return options.row_group_size * -(-FILE_ROWS // options.row_group_size)


def _together(options: CopyToOptions, rows: int, size: int) -> int:
    """Rows that a task puts together: whole row groups, of no more bytes than a row group may have; of one that bytes end, so many rows."""
    room = max(1, options.row_group_size_bytes * rows // max(1, size))
    return min(_part_rows(options), room // options.row_group_size * options.row_group_size or room)


def _settled(parts: list, short: list[bool], ordered: bool) -> tuple[list, list]:
    """Parts that stay as they are, and those to be put together anew: all whose last row group is short but the last one.

    Where the order counts, all that come after the first of these are among them.
    """
    at = [k for k, s in enumerate(short) if s]
    if not ordered and len(at) == 1:
        return [p for k, p in enumerate(parts) if k != at[0]] + [parts[at[0]]], []
    if not at or at[0] == len(parts) - 1:
        return parts, []
    again = range(at[0], len(parts)) if ordered else at
    return [p for k, p in enumerate(parts) if k not in set(again)], [parts[k] for k in again]


def _regrouped(spark, schema: T.StructType, folder: str, parts: list[Part], limit: int) -> DataFrame:
    """The rows of parts in their order, `limit` to a partition."""
    bases, total, mark = [], 0, f"__{uuid.uuid4().hex}"
    for p in parts:
        bases.append((p.path.rpartition("/")[2], total))
        total += p.rows
    again = spark.read.schema(schema).parquet(*[f"{folder}/{name}" for name, _ in bases])
    at = again.metadataColumn("_metadata")
    known = F.broadcast(spark.createDataFrame(bases, f"{mark}f string, {mark}b long"))
    rows = again.select("*", at.getField("file_name").alias(f"{mark}n"), at.getField("row_index").alias(f"{mark}r")).join(known, F.col(f"{mark}n") == F.col(f"{mark}f"))
    rows = rows.withColumn(f"{mark}i", F.col(f"{mark}b") + F.col(f"{mark}r"))
    spread = rows.repartitionById(-(-total // limit), F.floor(F.col(f"{mark}i") / limit).cast("int"))
    return spread.sortWithinPartitions(f"{mark}i").drop(*[mark + x for x in "fbnri"])


def _forget_sums(target: Uri) -> None:
    """A checksum that Hadoop keeps of the local file that is about to be replaced."""
    if target.scheme == "file":
        folder, _, name = target.path.rpartition("/")
        fs, sums = open_fs(_beside(target, f".{name}.crc"))
        if fs.get_file_info(sums).type == pafs.FileType.File:
            fs.delete_file(sums)


def _is_folder(target: Uri) -> FerryError:
    return FerryError(f"cannot write to {target.text}: Is a directory")


def _replace(spark, fs, new, out) -> None:
    """Puts a file in another's place: at once where the file system can, else with the old one kept until it is done."""
    jvm, options = spark._jvm, spark._jvm.org.apache.hadoop.fs.Options.Rename
    overwrite = spark._sc._gateway.new_array(options, 1)
    overwrite[0] = options.OVERWRITE
    try:
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(out.toUri(), spark._jsc.hadoopConfiguration())
    except Py4JJavaError:  # the file system has no such interface
        context = None
    if context is not None:
        context.rename(new, out, overwrite)
        return
    old = _hadoop_path(spark, f"{out.getParent()}/.tmp-{uuid.uuid4().hex}")
    had = fs.exists(out)
    if had and not fs.rename(out, old):
        raise FerryError(f"cannot replace {out}")
    if not fs.rename(new, out):
        if had:
            fs.rename(old, out)
        raise FerryError(f"cannot write {out}")
    if had:
        fs.delete(old, False)


def _freed(c: Column, d: T.DataType, t: SqlType) -> Column:
    """A column whose inner fields are nullable, too."""
    if isinstance(d, T.StructType) and d != spark_type(t):
        return c.cast(spark_type(t))
    if isinstance(d, T.ArrayType) and not d.containsNull:
        none = F.filter(F.array(F.lit(None).cast(spark_type(t.element))), lambda x: F.lit(False))
        return F.concat(c.cast(spark_type(t)), none)
    return c


def _with_ids(schema: T.StructType, ids: dict, path: tuple[str, ...] = ()) -> T.StructType:
    def made(f: T.StructField) -> T.StructField:
        own = (*path, f.name)
        kind = _with_ids(f.dataType, ids, own) if isinstance(f.dataType, T.StructType) else f.dataType
        return T.StructField(f.name, kind, f.nullable, {"parquet.field.id": ids[own]} if own in ids else {})

    return T.StructType([made(f) for f in schema])


class conf:
    """Session settings for a while."""

    def __init__(self, spark, wanted: dict[str, str]) -> None:
        self.spark, self.wanted = spark, wanted

    def __enter__(self) -> None:
        self.old = {k: self.spark.conf.get(k, None) for k in self.wanted}
        for k, v in self.wanted.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_: object) -> None:
        for k, v in self.old.items():
            self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)


def _hadoop_path(spark, text: str):
    return spark._jvm.org.apache.hadoop.fs.Path(text)


def _hadoop(spark, target: Uri):
    path = _hadoop_path(spark, target.hadoop)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path.getParent())
    return fs, path


# --- the Arrow writer ---

_REPORT = "part int, seq int, path string, rows long, bytes long, short boolean"


def _write_arrow(df: DataFrame, columns: list[tuple[str, SqlType]], target: Uri, options: CopyToOptions, ids: dict) -> int:
    spark = df.sparkSession
    schema = export_schema(columns, ids)
    split = options.file_size_bytes
    folder = target.path if split else target.path.rpartition("/")[0]
    where, path = open_fs(target)
    if not split and where.get_file_info(path).type == pafs.FileType.Directory:
        raise _is_folder(target)
    mark = uuid.uuid4().hex
    head = Uri(target.text, target.scheme, target.bucket, f"{folder}/.tmp-{mark}", target.account)

    wide = any(x.kind == "oid" for _, t in columns for x in t.walk())  # format 1.0 has no unsigned 32-bit numbers

    def open_writer(path: str, fs: pafs.FileSystem) -> tuple[pa.NativeFile, pq.ParquetWriter]:
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        sink = fs.open_output_stream(path)
        codec = {"uncompressed": "none", "lz4_raw": "lz4"}.get(options.compression, options.compression)
        level = options.compression_level if options.compression in ("gzip", "zstd", "brotli") else None
        writer = pq.ParquetWriter(
            sink, schema, compression=codec, compression_level=level, version="1.0" if options.parquet_version == "v1" and not wide else "2.6", data_page_version="2.0" if options.parquet_version == "v2" else "1.0",
            store_schema=True, write_time_adjusted_to_utc=any(t.kind == "timetz" for _, t in columns),
        )
        return sink, writer

    limit = None if split else _part_rows(options)

    def write(batches: Iterator[pa.RecordBatch], part: int | None = None, made: bool = False) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, attempt = context.partitionId() if part is None else part, context.taskAttemptId()
        fs, base = open_fs(head)
        seq, open_file, held, held_rows, held_bytes, rows, size, report = 0, None, [], 0, 0, 0, 0, []

        def flush() -> None:
            nonlocal held, held_rows, held_bytes, open_file, rows, size
            if open_file is None:
                path = f"{base}-{part}-{attempt}-{seq}"
                open_file = (path, *open_writer(path, fs))
                rows = size = 0
            if held:
                open_file[2].write_table(pa.Table.from_batches(held, schema), row_group_size=options.row_group_size)
                rows, size = rows + held_rows, size + held_bytes
                held, held_rows, held_bytes = [], 0, 0

        def close(short: bool = False) -> None:
            nonlocal open_file, seq
            path, sink, writer = open_file
            writer.close()
            sink.close()
            report.append((part, seq, path, rows, size, short))
            open_file, seq = None, seq + 1

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = batch.slice(at, min(BATCH_ROWS, options.row_group_size - held_rows))
                at += take.num_rows
                held.append(take if made else pa.RecordBatch.from_arrays([_conform(pa.concat_arrays([c]), f.type) for c, f in zip(take.columns, schema)], schema=schema))
                held_rows += take.num_rows
                held_bytes += held[-1].nbytes
                if held_rows >= options.row_group_size or held_bytes >= min(options.row_group_size_bytes, split or held_bytes + 1):
                    flush()
                    if split and open_file[1].tell() > split or limit and rows >= limit:
                        close()
        if short := bool(held):
            flush()
        if open_file:
            close(short)
        cols = list(zip(*report)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_()))], names=[c.split()[0] for c in _REPORT.split(", ")])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of parts, put together anew."""
        fs, _ = open_fs(head)

        def read(pieces: list[dict]) -> Iterator[pa.RecordBatch]:
            for p in pieces:
                at = 0
                with fs.open_input_file(p["path"]) as f:
                    for batch in pq.ParquetFile(f).iter_batches(BATCH_ROWS):
                        start, stop = max(0, p["start"] - at), min(batch.num_rows, p["stop"] - at)
                        at += batch.num_rows
                        if start < stop:
                            some = batch.slice(start, stop - start)
                            yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(some.columns, schema)], schema=schema)
                        if at >= p["stop"]:
                            break

        for batch in batches:
            for part, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from write(read(pieces), part, True)

    stored = store(df, columns)
    if split:
        stored = stored.coalesce(max(1, min(1 << 20, _expected_bytes(df) // split)))
    report: list = []
    with conf(spark, {"spark.sql.session.timeZone": "UTC", "spark.sql.timeType.enabled": "true"}):
        try:
            report = sorted(stored.mapInArrow(write, _REPORT).collect())  # one row a file
            if not split and report:
                report, rest = _settled(report, [r["short"] for r in report], _ordered(df))
                if rest:
                    made = _pieces(rest, _together(options, sum(r["rows"] for r in rest), sum(r["bytes"] for r in rest)))
                    spread = spark.createDataFrame(made, "part int, pieces array<struct<path: string, start: long, stop: long>>").repartition(min(len(made), 1024))
                    report += sorted(spread.mapInArrow(rewrite, _REPORT).collect())
            if not report:
                fs, base = open_fs(head)
                sink, writer = open_writer(f"{base}-empty", fs)
                writer.close()
                sink.close()
                report = [(0, 0, f"{base}-empty", 0)]
            paths = [r[2] for r in report]
            if not split and len(paths) > 1:
                join(spark, head, surveys(spark, head, paths), whole := f"{open_fs(head)[1]}-whole")
                paths = [whole]
            _place(paths, target, bool(split))
        finally:
            _sweep(head)
    return sum(r[3] for r in report)


def _pieces(parts: list, limit: int) -> list[tuple[int, list[tuple[str, int, int]]]]:
    """Rows of parts in their order, `limit` together: numbered lists of (path, first row, row after the last)."""
    out: list[list] = []
    room = 0
    for p in parts:
        at = 0
        while at < p["rows"]:
            if not room:
                out.append([])
                room = limit
            n = min(room, p["rows"] - at)
            out[-1].append((p["path"], at, at + n))
            at, room = at + n, room - n
    return list(enumerate(out))


def _ordered(df: DataFrame) -> bool:
    """Whether the rows are in an order that a file has to keep."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return bool(re.match(r"(?:(?:Project|SubqueryAlias|Filter)[^\n]*\n[\s:+-]*)*(?:Sort|GlobalLimit)\b", plan))


def _expected_bytes(df: DataFrame) -> int:
    """The optimizer's guess at the size, which bounds how many tasks write a split target."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _place(paths: list[str], target: Uri, split: bool) -> None:
    fs, base = open_fs(target)
    if not split:
        fs.create_dir(base.rpartition("/")[0], recursive=True)
        _forget_sums(target)
        fs.move(paths[0], base)  # over the old file, if there is one; a directory is refused before
        return
    if fs.get_file_info(base).type == pafs.FileType.File:
        fs.delete_file(base)
    for k, p in enumerate(paths):
        fs.move(p, f"{base}/data_{k}.parquet")
    for info in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):  # children of an earlier run
        number = re.fullmatch(r"data_(\d+)\.parquet", info.base_name)
        if number and int(number[1]) >= len(paths) and info.is_file:
            fs.delete_file(info.path)


def _sweep(head: Uri) -> None:
    """Temporary files that no successful task reported."""
    fs, base = open_fs(head)
    folder, _, name = base.rpartition("/")
    for info in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
        if info.base_name.startswith(name):
            fs.delete_file(info.path)
