"""URIs, globs, stores."""

import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from colferry.errors import FerryError
from colferry.sources.uri import glob_regex, list_files, parse_uri, resolve, store_conf


def test_c1_to_c5_parse(monkeypatch):
    assert parse_uri("/a/b.parquet").hadoop == "file:///a/b.parquet" and parse_uri("file:///a/b c").path == "/a/b c"
    for text in ("s3://b/k/x", "https://s3.amazonaws.com/b/k/x", "https://b.s3.amazonaws.com/k/x"):
        u = parse_uri(text)
        assert (u.scheme, u.bucket, u.path, u.hadoop) == ("s3", "b", "k/x", "s3a://b/k/x")
    monkeypatch.setenv("AZURE_STORAGE_ACCOUNT", "acct")
    for text in ("az://c/k", "azure://c/k", "https://acct.blob.core.windows.net/c/k"):
        assert parse_uri(text).hadoop == "abfss://c@acct.dfs.core.windows.net/k"
    assert parse_uri("gs://b/k").hadoop == "gs://b/k" and parse_uri("https://h.org/x").scheme == "https"
    assert parse_uri("hdfs://n:8020/a/b").hadoop == "hdfs://n:8020/a/b"
    with pytest.raises(FerryError):
        parse_uri("http://h.org/x")
    monkeypatch.setenv("ALLOW_HTTP", "true")
    assert parse_uri("http://h.org/x").remote


def test_c8_unknown_scheme():
    for text in ("ftp://x/y", "relative.parquet"):
        with pytest.raises(FerryError, match="unrecognized uri .* supports local paths, https://, s3://, az:// or gs:// schemes."):
            parse_uri(text)


def test_c2_c3_c4_credentials(tmp_path):
    (tmp_path / "cred").write_text("[default]\naws_access_key_id = A\naws_secret_access_key = B\n[other]\naws_access_key_id = C\n")
    env = {"AWS_SHARED_CREDENTIALS_FILE": str(tmp_path / "cred"), "AWS_CONFIG_FILE": "/none"}
    conf = store_conf(parse_uri("s3://b/k"), env)
    assert conf["fs.s3a.access.key"] == "A" and conf["fs.s3a.secret.key"] == "B"
    assert store_conf(parse_uri("s3://b/k"), env | {"AWS_PROFILE": "other"})["fs.s3a.access.key"] == "C"
    assert store_conf(parse_uri("s3://b/k"), env | {"AWS_ACCESS_KEY_ID": "E"})["fs.s3a.access.key"] == "E"
    az = store_conf(parse_uri("https://x.blob.core.windows.net/c/k"), {"AZURE_STORAGE_CONNECTION_STRING": "AccountName=x;AccountKey=k=="})
    assert az == {"fs.azure.account.key.x.dfs.core.windows.net": "k=="}
    assert store_conf(parse_uri("gs://b/k"), {"GOOGLE_SERVICE_ACCOUNT_PATH": "/k.json"}) == {"fs.gs.auth.service.account.json.keyfile": "/k.json"}


@pytest.mark.parametrize(
    "pattern, path, fits",
    [("/a/*.parquet", "/a/x.parquet", True), ("/a/*.parquet", "/a/b/x.parquet", False), ("/a/**/*.parquet", "/a/x.parquet", True), ("/a/**/*.parquet", "/a/b/c/x.parquet", True), ("/a/**", "/a/b/c", True), ("/a/*", "/a/.hidden", True), ("/A/*", "/a/x", False), ("/a/x_*.p", "/a/x_.p", True)],
)
def test_l1_globs(pattern, path, fits):
    assert bool(glob_regex(pattern).fullmatch(path)) == fits


@given(st.text(st.sampled_from("ab/."), max_size=12))
def test_l1_literal_patterns_fit_themselves(path):
    assert glob_regex(path).fullmatch(path) and not re.search(r"\*", path)


def test_l2_l4_listing(spark, tmp_path):
    for name in ("d/a_1.parquet", "d/e/a_2.parquet", "d/e/b.csv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 7)
    found = list_files(spark, f"{tmp_path}/**/*.parquet")
    assert found == [(f"{tmp_path}/d/a_1.parquet", 7), (f"{tmp_path}/d/e/a_2.parquet", 7)]
    assert list_files(spark, f"{tmp_path}/**/*_2.parquet") == found[1:] and list_files(spark, f"{tmp_path}/*.csv") == []
    assert len(list_files(spark, f"{tmp_path}/**")) == 3 and list_files(spark, f"file://{tmp_path}/d/a_1.parquet") == found[:1]


def test_l3_http_listing(spark):
    with pytest.raises(FerryError, match="list operation on http\\(s\\) object stores is not supported"):
        list_files(spark, "https://h.org/*.parquet")


def test_s3_s5_literal_first(spark, tmp_path):
    literal = tmp_path / "du**mm*y1.parquet"
    literal.write_bytes(b"x")
    (tmp_path / "dummy1.parquet").write_bytes(b"x")
    assert resolve(spark, str(literal)) == [str(literal)]
    assert resolve(spark, f"{tmp_path}/dum*y1.parquet") == [f"{tmp_path}/dummy1.parquet"]
    with pytest.raises(FerryError, match="no files found that match the pattern"):
        resolve(spark, f"{tmp_path}/none*.parquet")
    with pytest.raises(FerryError, match="failed to get object store metadata for uri"):
        resolve(spark, f"{tmp_path}/none.parquet")
