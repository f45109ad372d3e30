"""URIs of files, object stores and pipes; globs and listings."""

from __future__ import annotations

import configparser
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import unquote, urlsplit

from pyspark.sql import SparkSession

from colferry.errors import FerryError


@dataclass(frozen=True)
class Uri:
    """scheme: file, s3, azure, gs, http, https or hadoop (then account is Hadoop's own scheme); path: key or local path."""

    text: str
    scheme: str
    bucket: str
    path: str
    account: str = ""

    @property
    def hadoop(self) -> str:
        """How Hadoop names it."""
        if self.scheme == "file":
            return f"file://{self.path}"
        if self.scheme == "s3":
            return f"s3a://{self.bucket}/{self.path}"
        if self.scheme == "azure":
            return f"abfss://{self.bucket}@{self.account or os.environ.get('AZURE_STORAGE_ACCOUNT', '')}.dfs.core.windows.net/{self.path}"
        if self.scheme == "gs":
            return f"gs://{self.bucket}/{self.path}"
        if self.scheme == "hadoop":
            return f"{self.account}://{self.bucket}/{self.path}"
        return self.text

    @property
    def remote(self) -> bool:
        return self.scheme != "file"

    def shown(self, path: str) -> str:
        """A found path as users write it."""
        if self.scheme == "file":
            return "/" + path.lstrip("/")
        head = self.text.split("://", 1)[0]
        return f"{head}://{self.bucket}/{path.lstrip('/')}"


def parse_uri(text: str) -> Uri:
    if text.startswith("/"):
        return Uri(text, "file", "", text)
    parts = urlsplit(text)
    scheme, host, path = parts.scheme, parts.netloc, parts.path.lstrip("/")
    if scheme == "file":
        return Uri(text, "file", "", unquote(parts.path))
    if scheme in ("s3", "s3a"):
        return Uri(text, "s3", host, path)
    if scheme == "gs":
        return Uri(text, "gs", host, path)
    if scheme in ("az", "azure"):
        return Uri(text, "azure", host, path)
    if scheme in ("hdfs", "viewfs", "abfss", "abfs"):
        return Uri(text, "hadoop", host, path, scheme)
    if scheme in ("http", "https"):
        if m := re.fullmatch(r"(?:(.+)\.)?s3(?:[.-][\w-]+)?\.amazonaws\.com", host):
            bucket, key = (m[1], path) if m[1] else (path.partition("/")[0], path.partition("/")[2])
            return Uri(text, "s3", bucket, key)
        if m := re.fullmatch(r"(.+)\.(?:blob|dfs)\.core\.windows\.net", host):
            bucket, _, key = path.partition("/")
            return Uri(text, "azure", bucket, key, m[1])
        if scheme == "http" and os.environ.get("ALLOW_HTTP", "").lower() not in ("1", "true"):
            raise FerryError("http is not allowed, set ALLOW_HTTP to enable it")
        return Uri(text, scheme, host, path)
    raise FerryError(f"unrecognized uri {text}. It supports local paths, https://, s3://, az:// or gs:// schemes.")


def store_conf(uri: Uri, env: Mapping[str, str] = os.environ) -> dict[str, str]:
    """Hadoop settings for the store's credentials, from the environment, then from configuration files."""
    if uri.scheme == "s3":
        ini = configparser.ConfigParser()
        ini.read([env.get("AWS_SHARED_CREDENTIALS_FILE", str(Path.home() / ".aws/credentials")), env.get("AWS_CONFIG_FILE", str(Path.home() / ".aws/config"))])
        profile = env.get("AWS_PROFILE", "default")
        section = next((ini[s] for s in (profile, f"profile {profile}") if ini.has_section(s)), {})
        found = {
            "fs.s3a.access.key": env.get("AWS_ACCESS_KEY_ID") or section.get("aws_access_key_id"),
            "fs.s3a.secret.key": env.get("AWS_SECRET_ACCESS_KEY") or section.get("aws_secret_access_key"),
            "fs.s3a.session.token": env.get("AWS_SESSION_TOKEN") or section.get("aws_session_token"),
            "fs.s3a.endpoint.region": env.get("AWS_REGION") or section.get("region"),
            "fs.s3a.endpoint": env.get("AWS_ENDPOINT_URL") or section.get("endpoint_url"),
            "fs.s3a.assumed.role.arn": section.get("role_arn"),
            "fs.s3a.connection.ssl.enabled": "false" if env.get("AWS_ALLOW_HTTP", "").lower() in ("1", "true") else None,
        }
    elif uri.scheme == "azure":
        pairs = dict(p.split("=", 1) for p in env.get("AZURE_STORAGE_CONNECTION_STRING", "").split(";") if "=" in p)
        ini = configparser.ConfigParser()
        ini.read(env.get("AZURE_CONFIG_FILE", str(Path.home() / ".azure/config")))
        section = ini["storage"] if ini.has_section("storage") else {}
        account = uri.account or pairs.get("AccountName") or env.get("AZURE_STORAGE_ACCOUNT") or section.get("account", "")
        host = f"{account}.dfs.core.windows.net"
        tenant = env.get("AZURE_TENANT_ID")
        found = {
            f"fs.azure.account.key.{host}": pairs.get("AccountKey") or env.get("AZURE_STORAGE_KEY") or section.get("key"),
            f"fs.azure.sas.fixed.token.{host}": pairs.get("SharedAccessSignature") or env.get("AZURE_STORAGE_SAS_TOKEN") or section.get("sas_token"),
            f"fs.azure.account.oauth2.client.id.{host}": env.get("AZURE_CLIENT_ID"),
            f"fs.azure.account.oauth2.client.secret.{host}": env.get("AZURE_CLIENT_SECRET"),
            f"fs.azure.account.oauth2.client.endpoint.{host}": f"https://login.microsoftonline.com/{tenant}/oauth2/token" if tenant else None,
        }
    elif uri.scheme == "gs":
        found = {"fs.gs.auth.service.account.json.keyfile": env.get("GOOGLE_SERVICE_ACCOUNT_PATH"), "fs.gs.auth.service.account.json": env.get("GOOGLE_SERVICE_ACCOUNT_KEY")}
    else:
        found = {}
    return {k: v for k, v in found.items() if v}


def glob_regex(pattern: str) -> re.Pattern[str]:
    """`*` stays within a path part, `**` takes any directories (also none)."""
    out, i = "", 0
    while i < len(pattern):
        if pattern[i : i + 3] == "**/":
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return re.compile(out)


def _files_below(spark: SparkSession, uri: Uri, prefix: str) -> list[tuple[str, int]]:
    if uri.scheme == "file":
        if os.path.isfile(prefix):
            return [(prefix, os.path.getsize(prefix))]
        return [(os.path.join(d, f), os.path.getsize(os.path.join(d, f))) for d, _, names in os.walk(prefix) for f in names if not f.startswith(".tmp-")]
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(Uri(uri.text, uri.scheme, uri.bucket, prefix, uri.account).hadoop)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found, out = fs.listFiles(hadoop, True), []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toUri().getPath().lstrip("/"), f.getLen()))
    return out


def list_files(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """(uri, size) of the files that fit the pattern, by name."""
    uri = parse_uri(pattern)
    if uri.scheme in ("http", "https"):
        raise FerryError("list operation on http(s) object stores is not supported")
    prefix = uri.path.split("*", 1)[0]
    base = prefix if prefix == uri.path else prefix[: prefix.rfind("/") + 1] or "/"
    fits = glob_regex(uri.path)
    return sorted((uri.shown(p), size) for p, size in _files_below(spark, uri, base) if fits.fullmatch(p))


def resolve(spark: SparkSession, text: str) -> list[str]:
    """The files that COPY FROM reads: the literal name if there is one, else what the pattern finds."""
    uri = parse_uri(text)
    if uri.scheme == "file" and os.path.isfile(uri.path) or uri.scheme in ("http", "https"):
        return [text]
    if uri.scheme != "file" and "*" not in uri.path:
        return [text]
    if "*" not in uri.path:
        if uri.scheme == "file" and os.path.isdir(uri.path) and (inside := [p for p, _ in list_files(spark, text.rstrip("/") + "/*") if not os.path.basename(p).startswith(("_", "."))]):
            return inside
        raise FerryError(f"failed to get object store metadata for uri {text}")
    if not (found := [p for p, _ in list_files(spark, text)]):
        raise FerryError(f"no files found that match the pattern {text}")
    return found
