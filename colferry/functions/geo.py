"""Geometry: WKT to WKB, and the file metadata that names geometry columns."""

from __future__ import annotations

import json
import re
import struct

from colferry.errors import FerryError
from colferry.types import SqlType

_CODES = {"POINT": 1, "LINESTRING": 2, "POLYGON": 3, "MULTIPOINT": 4, "MULTILINESTRING": 5, "MULTIPOLYGON": 6, "GEOMETRYCOLLECTION": 7}
_NAMES = {"point": "Point", "linestring": "LineString", "polygon": "Polygon", "multipoint": "MultiPoint", "multilinestring": "MultiLineString", "multipolygon": "MultiPolygon", "geometrycollection": "GeometryCollection"}


def wkb(wkt: str) -> bytes:
    """Little-endian WKB of a two-dimensional WKT geometry."""
    tokens = re.findall(r"[A-Za-z]+|[-+.\deE]+|[(),]", wkt)
    at = 0

    def take(expected: str | None = None) -> str:
        nonlocal at
        token = tokens[at] if at < len(tokens) else ""
        if expected and token != expected or not token:
            raise FerryError(f"parse error - invalid geometry: {wkt}")
        at += 1
        return token

    def many(item) -> list[bytes]:
        nonlocal at
        if at < len(tokens) and tokens[at].upper() == "EMPTY":
            at += 1
            return []
        take("(")
        out = [item()]
        while tokens[at : at + 1] == [","]:
            take(",")
            out.append(item())
        take(")")
        return out

    point = lambda: struct.pack("<dd", float(take()), float(take()))

    def loose_point() -> bytes:
        if tokens[at : at + 1] == ["("]:
            return many(point)[0]
        return point()

    counted = lambda parts: struct.pack("<I", len(parts)) + b"".join(parts)
    ring = lambda: counted(many(point))
    head = lambda kind: b"\x01" + struct.pack("<I", _CODES[kind])

    def geometry() -> bytes:
        kind = take().upper()
        if kind not in _CODES:
            raise FerryError(f"parse error - invalid geometry: {wkt}")
        if kind == "POINT":
            found = many(point)
            body = found[0] if found else struct.pack("<dd", float("nan"), float("nan"))
        elif kind == "LINESTRING":
            body = counted(many(point))
        elif kind == "POLYGON":
            body = counted(many(ring))
        elif kind == "MULTIPOINT":
            body = counted([head("POINT") + p for p in many(loose_point)])
        elif kind == "MULTILINESTRING":
            body = counted([head("LINESTRING") + r for r in many(ring)])
        elif kind == "MULTIPOLYGON":
            body = counted([head("POLYGON") + counted(p) for p in many(lambda: many(ring))])
        else:
            body = counted(many(geometry))
        return head(kind) + body

    out = geometry()
    if at != len(tokens):
        raise FerryError(f"parse error - invalid geometry: {wkt}")
    return out


def geo_metadata(columns: list[tuple[str, SqlType]]) -> str | None:
    """The `geo` entry: version, the first geometry column, each one's encoding and kinds."""
    geometries = {n: t for n, t in columns if t.kind == "geometry"}
    if not geometries:
        return None
    kinds = {n: [_NAMES.get(str(t.args[0]).lower())] if t.args and str(t.args[0]).lower() in _NAMES else [] for n, t in geometries.items()}
    return json.dumps({"version": "1.1.0", "primary_column": next(iter(geometries)), "columns": {n: {"encoding": "WKB", "geometry_types": kinds[n]} for n in geometries}})
