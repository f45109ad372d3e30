"""Options, field ids, sizes, codecs."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from colferry.errors import FerryError
from colferry.options import CODECS, CopyFromOptions, CopyToOptions, assign_field_ids, codec_of_uri, is_parquet_uri, parse_field_ids, parse_size
from colferry.types import Relation

TABLE = Relation.of("t", "a int4, b text, c struct<id int4, dog struct<id int4, name text>, dogs array<struct<id int4, name text>>>, d array<struct<id int4, dog struct<id int4, name text>, dogs array<struct<id int4, name text>>>>")
COLUMNS = [(c.name, c.type) for c in TABLE.columns]


def fails(text, f, *args):
    with pytest.raises(FerryError) as e:
        f(*args)
    assert text in str(e.value), str(e.value)


def test_o1_unknown_options_and_format():
    fails('nonexist is not a valid option for "copy to parquet". Supported options are format, file_size_bytes', CopyToOptions.parse, {"nonexist": 1})
    fails('nonexist is not a valid option for "copy from parquet". Supported options are format, match_by, freeze', CopyFromOptions.parse, {"nonexist": 1})
    fails("csv is not a valid format. Only parquet format is supported.", CopyToOptions.parse, {"format": "csv"})
    fails("csv is not a valid format. Only parquet format is supported.", CopyFromOptions.parse, {"format": "csv"})


def test_o2_o3_compression():
    assert [codec_of_uri("/x" + e) for e in (".parquet", ".parquet.snappy", ".parquet.gz", ".parquet.lz4", ".parquet.br", ".parquet.zst")] == ["snappy", "snappy", "gzip", "lz4_raw", "brotli", "zstd"]
    assert not is_parquet_uri("/x.csv") and not is_parquet_uri("/x.PARQUET") and is_parquet_uri("s3://b/k.parquet.gz")
    assert CopyToOptions.parse({}, "/x.parquet.gz").compression == "gzip"
    assert CopyToOptions.parse({"compression": "zstd"}, "/x.parquet.gz").compression == "zstd"
    assert CopyToOptions.parse({}, "/x").compression == "snappy"
    assert CopyToOptions.parse({"compression": "lz4raw"}).compression == "lz4_raw"
    fails(f"GZIP is not a valid compression format. Supported compression formats are {', '.join(CODECS)}", CopyToOptions.parse, {"compression": "GZIP"})


def test_o4_o5_levels():
    assert [CopyToOptions.parse({"compression": c}).compression_level for c in ("gzip", "zstd", "brotli", "snappy")] == [6, 1, 1, None]
    assert CopyToOptions.parse({"compression": "gzip", "compression_level": -1}).compression_level == 6
    assert CopyToOptions.parse({"compression": "snappy", "compression_level": -1}).compression_level is None
    for c in ("snappy", "uncompressed", "lz4", "lz4_raw"):
        fails(f'compression level is not supported for "{c}" compression', CopyToOptions.parse, {"compression": c, "compression_level": 2})
    fails("valid compression range 0..=9 exceeded", CopyToOptions.parse, {"compression": "gzip", "compression_level": 10})
    fails("valid compression range 1..=22 exceeded", CopyToOptions.parse, {"compression": "zstd", "compression_level": 23})


def test_o6_o7_row_groups():
    assert CopyToOptions().row_group_size == 122_880 and CopyToOptions().row_group_size_bytes == 125_829_120
    fails("row_group_size must be greater than 0", CopyToOptions.parse, {"row_group_size": 0})
    fails("row_group_size_bytes must be greater than 0", CopyToOptions.parse, {"row_group_size_bytes": -1})


@pytest.mark.parametrize("text, size", [("1MB", 1 << 20), (" 2 mb ", 2 << 20), ("1GB", 1 << 30), ("2048KB", 2 << 20), ("1048576", 1 << 20), (1048576, 1 << 20)])
def test_o8_sizes(text, size):
    assert parse_size(text) == size


def test_o8_bad_sizes():
    fails("file_size_bytes option is not valid: ", parse_size, "MB")
    fails("file_size_bytes option is not valid: ", parse_size, "1TB")
    fails("Minimum allowed size is 1MB. Got 1024 bytes.", parse_size, "1KB")


@given(st.integers(1 << 20, 1 << 40))
def test_o8_any_number(n):
    assert parse_size(str(n)) == n


def test_o10_o11_version_and_freeze():
    assert CopyToOptions.parse({"parquet_version": "V2", "freeze": True}).parquet_version == "v2"
    assert CopyFromOptions.parse({"freeze": "false"}).match_by == "position"
    fails("unrecognized parquet version: v3. v1 or v2 is supported.", CopyToOptions.parse, {"parquet_version": "v3"})


def test_m3_match_by():
    assert CopyFromOptions.parse({"match_by": "name"}).match_by == "name"
    fails("unrecognized match_by method: Name", CopyFromOptions.parse, {"match_by": "Name"})


def test_f1_f2_auto_ids():
    assert assign_field_ids(COLUMNS, "none") == {}
    ids = assign_field_ids(COLUMNS, "auto")
    assert list(ids.values()) == list(range(21))
    assert [p[-1] for p in ids] == ["a", "b", "c", "id", "dog", "id", "name", "dogs", "element", "id", "name", "d", "element", "id", "dog", "id", "name", "dogs", "element", "id", "name"]


def test_f3_f4_explicit_ids():
    ids = assign_field_ids(COLUMNS, parse_field_ids('{"a": 10, "c": {"__root_field_id": 20, "dogs": {"element": {"__root_field_id": 5, "name": 6}}}}'))
    assert ids == {("a",): 10, ("c",): 20, ("c", "dogs", "element"): 5, ("c", "dogs", "element", "name"): 6}
    maps = [(c.name, c.type) for c in Relation.of("m", "m map<int4, text>").columns]
    assert assign_field_ids(maps, {"m": {"__root_field_id": 1, "key": 2, "val": 3}}) == {("m",): 1, ("m", "key"): 2, ("m", "val"): 3}


def test_f5_f6_bad_ids():
    fails("invalid JSON string for field_ids", parse_field_ids, "{bad")
    fails("invalid JSON string for field_ids", parse_field_ids, '{"a": "x"}')
    fails('duplicate field id 14 in "field_ids"', assign_field_ids, COLUMNS, {"a": 14, "b": 14})
    fails("Field 'nope' in the mapping does not exist in the Arrow schema.", assign_field_ids, COLUMNS, {"nope": 1})
    fails("Available fields: ['id', 'dog', 'dogs']", assign_field_ids, COLUMNS, {"c": {"x": 1}})
