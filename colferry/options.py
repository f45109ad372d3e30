"""COPY options, their defaults and their checks."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass

from colferry.errors import FerryError
from colferry.types import SqlType

TO_OPTIONS = ("format", "file_size_bytes", "field_ids", "row_group_size", "row_group_size_bytes", "compression", "compression_level", "parquet_version", "freeze")
FROM_OPTIONS = ("format", "match_by", "freeze")
CODECS = ("uncompressed", "snappy", "gzip", "lz4", "lz4_raw", "brotli", "zstd")
#: Codec: default level, least and most level.
LEVELS = {"gzip": (6, 0, 9), "zstd": (1, 1, 22), "brotli": (1, 0, 11)}
EXTENSIONS = {".parquet": "snappy", ".parquet.snappy": "snappy", ".parquet.gz": "gzip", ".parquet.lz4": "lz4_raw", ".parquet.br": "brotli", ".parquet.zst": "zstd"}
ROW_GROUP_SIZE = 122_880
ROW_GROUP_SIZE_BYTES = ROW_GROUP_SIZE * 1024
MIN_FILE_SIZE = 1 << 20
UNSET_LEVEL = -1
ROOT_ID = "__root_field_id"


def codec_of_uri(uri: str) -> str | None:
    return next((c for e, c in sorted(EXTENSIONS.items(), key=lambda x: -len(x[0])) if uri.endswith(e)), None)


def is_parquet_uri(uri: str) -> bool:
    return codec_of_uri(uri) is not None


def parse_size(text: str | int) -> int:
    """Bytes of `123`, `10KB`, `1 mb` or `2GB` (1024-based)."""
    bad = "file_size_bytes option is not valid: "
    m = re.fullmatch(r"(\d*)\s*([a-zA-Z]*)", str(text).strip())
    if not m or not m[1]:
        raise FerryError(f"{bad}{text!r} has no number")
    units = {"": 1, "kb": 1 << 10, "mb": 1 << 20, "gb": 1 << 30}
    if m[2].lower() not in units:
        raise FerryError(f"{bad}unrecognized unit {m[2]!r}, expected KB, MB or GB")
    size = int(m[1]) * units[m[2].lower()]
    if size < MIN_FILE_SIZE:
        raise FerryError(f"{bad}Minimum allowed size is 1MB. Got {size} bytes.")
    return size


@dataclass(frozen=True)
class CopyToOptions:
    compression: str = "snappy"
    compression_level: int | None = None
    row_group_size: int = ROW_GROUP_SIZE
    row_group_size_bytes: int = ROW_GROUP_SIZE_BYTES
    file_size_bytes: int | None = None
    parquet_version: str = "v1"
    field_ids: str | dict = "none"

    @staticmethod
    def parse(options: Mapping[str, object] | None, uri: str = "") -> CopyToOptions:
        o = _known(options, TO_OPTIONS, "to")
        codec = o.get("compression", codec_of_uri(uri) or "snappy")
        if codec == "lz4raw":  # as documentation writes it
            codec = "lz4_raw"
        if codec not in CODECS:
            raise FerryError(f"{codec} is not a valid compression format. Supported compression formats are {', '.join(CODECS)}")
        level = int(o["compression_level"]) if "compression_level" in o else UNSET_LEVEL
        if level != UNSET_LEVEL:
            if codec not in LEVELS:
                raise FerryError(f'compression level is not supported for "{codec}" compression')
            _, least, most = LEVELS[codec]
            if not least <= level <= most:
                raise FerryError(f"valid compression range {least}..={most} exceeded.")
        rows, size = int(o.get("row_group_size", ROW_GROUP_SIZE)), int(o.get("row_group_size_bytes", ROW_GROUP_SIZE_BYTES))
        for name, value in (("row_group_size", rows), ("row_group_size_bytes", size)):
            if value <= 0:
                raise FerryError(f"{name} must be greater than 0")
        version = str(o.get("parquet_version", "v1"))
        if version.lower() not in ("v1", "v2"):
            raise FerryError(f"unrecognized parquet version: {version}. v1 or v2 is supported.")
        return CopyToOptions(
            codec,
            level if level != UNSET_LEVEL else LEVELS[codec][0] if codec in LEVELS else None,
            rows,
            size,
            parse_size(o["file_size_bytes"]) if "file_size_bytes" in o else None,
            version.lower(),
            parse_field_ids(o.get("field_ids", "none")),
        )


@dataclass(frozen=True)
class CopyFromOptions:
    match_by: str = "position"

    @staticmethod
    def parse(options: Mapping[str, object] | None) -> CopyFromOptions:
        o = _known(options, FROM_OPTIONS, "from")
        match = o.get("match_by", "position")
        if match not in ("position", "name"):
            raise FerryError(f"unrecognized match_by method: {match}")
        return CopyFromOptions(str(match))


def _known(options: Mapping[str, object] | None, allowed: tuple[str, ...], direction: str) -> dict[str, object]:
    options = dict(options or {})
    for name in options:
        if name not in allowed:
            raise FerryError(f'{name} is not a valid option for "copy {direction} parquet". Supported options are {", ".join(allowed)}')
    if "format" in options and options["format"] != "parquet":
        raise FerryError(f"{options['format']} is not a valid format. Only parquet format is supported.")
    return options


# --- field ids ---


def parse_field_ids(value: object) -> str | dict:
    if isinstance(value, dict) or value in ("none", "auto"):
        return value
    bad = FerryError("invalid JSON string for field_ids", 'Allowed: none, auto, or JSON such as {"a": 1, "b": {"__root_field_id": 2, "c": 3}}')
    try:
        ids = json.loads(str(value))
    except ValueError:
        raise bad from None

    def sound(x: object) -> bool:
        return isinstance(x, dict) and all((isinstance(v, int) and not isinstance(v, bool)) or (k != ROOT_ID and sound(v)) for k, v in x.items())

    if not sound(ids):
        raise bad
    return ids


def children(t: SqlType) -> list[tuple[str, SqlType]]:
    """Names of a container's children as field ids give them."""
    if t.kind == "struct":
        return list(t.fields)
    if t.kind == "array":
        return [("element", t.element)]
    if t.kind == "map":
        return [("key", t.key), ("val", t.element)]
    return []


def assign_field_ids(columns: list[tuple[str, SqlType]], ids: str | dict) -> dict[tuple[str, ...], int]:
    """Field id by path. auto counts depth first from 0; containers count, list groups don't."""
    out: dict[tuple[str, ...], int] = {}
    if ids == "none":
        return out
    if ids == "auto":

        def count(path: tuple[str, ...], t: SqlType) -> None:
            out[path] = len(out)
            for name, child in children(t):
                count((*path, name), child)

        for name, t in columns:
            count((name,), t)
        return out
    seen: set[int] = set()

    def take(path: tuple[str, ...], value: int) -> None:
        if value in seen:
            raise FerryError(f'duplicate field id {value} in "field_ids"')
        seen.add(value)
        out[path] = value

    def visit(path: tuple[str, ...], known: list[tuple[str, SqlType]], mapping: dict) -> None:
        names = [n for n, _ in known]
        for name in mapping:
            if name != ROOT_ID and name not in names:
                raise FerryError(f"Field '{name}' in the mapping does not exist in the Arrow schema.", f"Available fields: {names}")
        for name, t in known:
            if name not in mapping:
                continue
            value = mapping[name]
            if isinstance(value, int):
                take((*path, name), value)
                continue
            if ROOT_ID in value:
                take((*path, name), value[ROOT_ID])
            visit((*path, name), children(t), value)

    visit((), columns, ids)
    return out
