"""One Parquet file out of several of the same schema, as they are: pages are moved byte by byte, footers joined.

So tasks can write one file together: each writes parts of its own, and only what says where things are is written
anew, which are the footers' offsets and those of the page indexes. Neither pages nor footers are held in memory as a
whole. On a local or mounted disk tasks copy the parts, each to its own place in the file; in stores, whose files are
written from start to end, the driver passes them on piece by piece.
"""

from __future__ import annotations

import io
import os
import struct
from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession

from colferry.errors import FerryError
from colferry.sources.scan import footer, open_fs
from colferry.sources.uri import Uri, parse_uri

MAGIC = b"PAR1"
PIECE = 4 << 20
#: Bytes of parts that the driver handles itself; more are handled by tasks.
DRIVER_BYTES = 32 << 20
#: Bytes of a footer that are decoded at once; decoded, they take some ten times as many.
FOOTER_BYTES = 8 << 20
_GROUPS, _I16_MAX = 4, 32_767

# --- Thrift's compact protocol, as far as offsets are concerned; all else is copied as it stands ---

Change = Callable[[bytes, int], tuple[bytes | None, int]]


def _varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while (x := b[at]) & 128:
        n |= (x & 127) << shift
        shift, at = shift + 7, at + 1
    return n | x << shift, at + 1


def _signed(b: bytes, at: int) -> tuple[int, int]:
    n, at = _varint(b, at)
    return n >> 1 ^ -(n & 1), at


def _to_varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _to_signed(n: int) -> bytes:
    return _to_varint(n << 1 ^ n >> 63)


def _skip(b: bytes, at: int, kind: int) -> int:
    if kind in (1, 2):  # a boolean is in its field's header
        return at
    if kind in (4, 5, 6):
        while b[at] & 128:
            at += 1
        return at + 1
    if kind == 8:
        n, at = _varint(b, at)
        return at + n
    if kind == 12:
        while head := b[at]:
            at += 1
            if not head >> 4:
                at = _skip(b, at, 4)
            at = _skip(b, at, head & 15)
        return at + 1
    if kind in (9, 10):
        n, inner, at = _list(b, at)
        for _ in range(n):
            at = at + 1 if inner in (1, 2, 3) else _skip(b, at, inner)
        return at
    if kind in (3, 7, 13):
        return at + {3: 1, 7: 8, 13: 16}[kind]
    raise FerryError(f"unexpected type {kind} in a parquet footer")


def _list(b: bytes, at: int) -> tuple[int, int, int]:
    head, at = b[at], at + 1
    n = head >> 4
    if n == 15:
        n, at = _varint(b, at)
    return n, head & 15, at


def _list_head(n: int, inner: int) -> bytes:
    return bytes([n << 4 | inner]) if n < 15 else bytes([0xF0 | inner]) + _to_varint(n)


def _fields(b: bytes, at: int) -> Iterator[tuple[int, int, int]]:
    """(id, type, start of the value); the caller says where the next one starts."""
    known = 0
    while head := b[at]:
        at += 1
        if head >> 4:
            known += head >> 4
        else:
            known, at = _signed(b, at)
        at = yield known, head & 15, at
    yield 0, 0, at + 1


def _field_head(known: int, before: int, kind: int) -> bytes:
    return bytes([known - before << 4 | kind]) if 0 < known - before < 16 else bytes([kind]) + _to_signed(known)


def _edited(b: bytes, at: int, changes: dict[int, Change]) -> tuple[bytes, int]:
    """A struct with some fields changed, or left out where the change gives None."""
    out, before, fields = bytearray(), 0, _fields(b, at)
    known, kind, at = next(fields)
    while known:
        if known in changes:
            value, end = changes[known](b, at)
        else:
            end = _skip(b, at, kind)
            value = b[at:end]
        if value is not None:
            out += _field_head(known, before, kind)
            out += value
            before = known
        known, kind, at = fields.send(end)
    return bytes(out) + b"\0", at


def _each(changes: dict[int, Change]) -> Change:
    """Of every struct in a list."""

    def change(b: bytes, at: int) -> tuple[bytes, int]:
        n, inner, at = _list(b, at)
        out = [_list_head(n, inner)]
        for _ in range(n):
            x, at = _edited(b, at, changes)
            out.append(x)
        return b"".join(out), at

    return change


# --- parts ---


@dataclass
class Part:
    """A file to be joined. bytes, last_bytes: uncompressed, of all row groups and of the last. pages: where its footer starts. index: where its offset indexes start, spare: the room they may need."""

    path: str
    rows: int
    bytes: int
    groups: int
    last_bytes: int
    pages: int
    index: int
    spare: int


_PART = "path string, rows long, bytes long, groups long, last_bytes long, pages long, index long, spare long"


def _footer(f: pa.NativeFile) -> tuple[bytes, int]:
    size = f.size()
    length = struct.unpack("<I", f.read_at(4, size - 8))[0]
    return f.read_at(length, size - 8 - length), size - 8 - length


def _groups_at(b: bytes) -> tuple[int, int]:
    """How many row groups there are, and where the first one starts."""
    fields = _fields(b, 0)
    known, kind, at = next(fields)
    while known:
        if known == _GROUPS:
            n, _, at = _list(b, at)
            return n, at
        known, kind, at = fields.send(_skip(b, at, kind))
    raise FerryError("a parquet footer has no row groups")


def survey(fs: pafs.FileSystem, path: str) -> Part:
    with fs.open_input_file(path) as f:
        b, pages = _footer(f)
    indexes, lengths, rows, size = [], [], [], []

    def noted(to: list[int]) -> Change:
        def change(b: bytes, at: int) -> tuple[bytes, int]:
            n, end = _signed(b, at)
            to.append(n)
            return b[at:end], end

        return change

    n, at = _groups_at(b)
    for _ in range(n):
        _, at = _edited(b, at, {1: _each({4: noted(indexes), 5: noted(lengths)}), 2: noted(size), 3: noted(rows)})
    # a page's place takes 7 bytes at least, and its offset 9 more at most
    return Part(path, sum(rows), sum(size), n, size[-1] if n else 0, pages, min(indexes, default=pages), 3 * sum(lengths))


def _moved(fs: pafs.FileSystem, part: Part, start: int, first: int) -> tuple[bytes, bytes]:
    """Its row groups' descriptions, and its offset indexes, once its bytes from the fourth on start there; first: its first group's number."""
    with fs.open_input_file(part.path) as f:
        b, pages = _footer(f)
        old = f.read_at(pages - part.index, part.index) if part.index < pages else b""
    by, indexes = start - len(MAGIC), bytearray()

    def shift(b: bytes, at: int) -> tuple[bytes, int]:
        n, end = _signed(b, at)
        return _to_signed(n + by if n > 0 else n), end  # 0: not given

    def index(b: bytes, at: int) -> tuple[bytes, int]:
        nonlocal length
        n, end = _signed(b, at)
        new, _ = _edited(old, n - part.index, {1: _each({1: shift})})
        place, length = by + pages + len(indexes), len(new)
        indexes.extend(new)
        return _to_signed(place), end

    def index_length(b: bytes, at: int) -> tuple[bytes, int]:
        return _to_signed(length), _skip(b, at, 5)

    def ordinal(b: bytes, at: int) -> tuple[bytes | None, int]:
        return _to_signed(first + k) if first + k <= _I16_MAX else None, _skip(b, at, 4)  # it has 16 bits, and may be missing

    length, out = 0, bytearray()
    chunk = {2: shift, 3: lambda b, at: _edited(b, at, {9: shift, 10: shift, 11: shift, 14: shift}), 4: index, 5: index_length, 6: shift}
    n, at = _groups_at(b)
    for k in range(n):
        new, at = _edited(b, at, {1: _each(chunk), 5: shift, 7: ordinal})
        out += new
    if len(indexes) > part.spare:
        raise FerryError(f"page indexes of {part.path} need more room than was kept")
    return bytes(out), bytes(indexes)


def surveys(spark: SparkSession, home: Uri, paths: list[str]) -> list[Part]:
    """What is to be known of files, in their order."""
    fs, _ = open_fs(home)
    if sum(i.size for i in fs.get_file_info(paths)) <= DRIVER_BYTES:
        return [survey(fs, p) for p in paths]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(home)
        for batch in batches:
            found = [astuple(survey(fs, p)) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k else pa.string()) for k, c in enumerate(zip(*found))], names=[c.split()[0] for c in _PART.split(", ")])

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), 256))
    by = {r["path"]: Part(*r) for r in listed.mapInArrow(work, _PART).collect()}  # a row a file
    return [by[p] for p in paths]


def _pieces(fs: pafs.FileSystem, path: str, start: int, end: int) -> Iterator[bytes]:
    with fs.open_input_file(path) as f:
        while start < end:
            yield f.read_at(min(PIECE, end - start), start)
            start += PIECE


def join(spark: SparkSession, home: Uri, parts: list[Part], whole: str) -> None:
    """Writes `whole`, next to the parts, out of them; beside each of them two small files are left."""
    fs, _ = open_fs(home)
    local = home.scheme == "file"
    jobs, at, first = [], len(MAGIC), 0
    for p in parts:
        jobs.append((*astuple(p), at, first))
        at, first = at + p.pages - len(MAGIC) + p.spare, first + p.groups

    def place(fs: pafs.FileSystem, part: Part, start: int, first: int) -> None:
        groups, indexes = _moved(fs, part, start, first)
        for name, data in ((".groups", groups), (".index", indexes)):
            with fs.open_output_stream(part.path + name) as f:
                f.write(data)
        if local:
            to = os.open(whole, os.O_WRONLY)
            try:
                for piece in (*_pieces(fs, part.path, len(MAGIC), part.pages), indexes):
                    _write_at(to, piece, start)
                    start += len(piece)
            finally:
                os.close(to)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(home)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                place(fs, Part(*row[:-2]), *row[-2:])
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["path"])

    if local:
        with open(whole, "wb") as f:
            f.write(MAGIC)
            f.truncate(at)
    if sum(p.pages for p in parts) <= DRIVER_BYTES:
        for row in jobs:
            place(fs, Part(*row[:-2]), *row[-2:])
    else:
        listed = spark.createDataFrame(jobs, f"{_PART}, start long, first long").repartition(min(len(jobs), 256))
        listed.mapInArrow(work, "path string").count()

    with open(whole, "r+b") if local else fs.open_output_stream(whole) as out:
        if local:
            out.seek(at)
        else:
            out.write(MAGIC)
            for p in parts:
                for piece in _pieces(fs, p.path, len(MAGIC), p.pages):
                    out.write(piece)
                with fs.open_input_file(p.path + ".index") as f:
                    out.write(f.read().ljust(p.spare, b"\0"))
        length = 0
        for piece in _joined_footer(fs, parts):
            out.write(piece)
            length += len(piece)
        if length > 0x7FFFFFFF:
            raise FerryError("the file has more row groups than a parquet footer can hold; raise row_group_size")
        out.write(struct.pack("<I", length) + MAGIC)


def _write_at(to: int, data: bytes, at: int) -> None:
    left = memoryview(data)
    while left:
        n = os.pwrite(to, left, at)
        left, at = left[n:], at + n


def _joined_footer(fs: pafs.FileSystem, parts: list[Part]) -> Iterator[bytes]:
    with fs.open_input_file(parts[0].path) as f:
        b, _ = _footer(f)
    before, fields = 0, _fields(b, 0)
    known, kind, at = next(fields)
    while known:
        end = _skip(b, at, kind)
        yield _field_head(known, before, kind)
        if known == _GROUPS:
            yield _list_head(sum(p.groups for p in parts), 12)
            for p in parts:
                yield from _pieces(fs, p.path + ".groups", 0, fs.get_file_info(p.path + ".groups").size)
        else:
            yield _to_signed(sum(p.rows for p in parts)) if known == 3 else b[at:end]
        before = known
        known, kind, at = fields.send(end)
    yield b"\0"


def footers(text: str) -> Iterator[pq.FileMetaData]:
    """A file's footer; if it is long, as several, each of which has some of the row groups."""
    fs, path = open_fs(parse_uri(text))
    b = b""
    try:
        with fs.open_input_file(path) as f:
            size = f.size()
            if size > FOOTER_BYTES and f.read_at(4, size - 4) == MAGIC and struct.unpack("<I", f.read_at(4, size - 8))[0] > FOOTER_BYTES:
                b, _ = _footer(f)
    except FileNotFoundError:
        pass
    n, first = _groups_at(b) if b else (0, 0)
    if not n:
        yield footer(text)
        return
    cuts, at = [(0, first)], first
    for k in range(n):
        at = _skip(b, at, 12)
        if at - cuts[-1][1] > FOOTER_BYTES or k == n - 1:
            cuts.append((k + 1, at))
    head, rest = b[: first - len(_list_head(n, 12))], b[at:]
    for (k, start), (next_k, end) in zip(cuts, cuts[1:]):
        part = head + _list_head(next_k - k, 12) + b[start:end] + rest
        yield pq.read_metadata(io.BytesIO(MAGIC + part + struct.pack("<I", len(part)) + MAGIC))
