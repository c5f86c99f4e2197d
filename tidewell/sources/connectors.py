"""Connectors: any SELECT over views or JDBC, the web, and version-control checkouts."""

from __future__ import annotations

import base64
import json
import subprocess
import time
import urllib.parse
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a web answer that are read at most, and requests in a second.
WEB_BYTES, WEB_RATE = 10 << 20, 4.0
WEB_TYPES = ("text/html", "text/plain", "text/markdown", "application/json", "application/xhtml+xml", "application/xml", "text/xml")


def sql_documents(
    spark: SparkSession, sql: str, views: dict[str, DataFrame] | None = None, id_col: str | None = None, content_col: str | None = None, title_col: str | None = None
) -> DataFrame:
    """Rows of a SELECT over `views`; with `content_col`, as documents (id, title, content, metadata) without blank contents.

    Column names are matched whatever their case. A missing id column gives the
    hash of the row.
    """
    df = spark.sql(sql, **(views or {})) if views is None else _with_views(spark, sql, views)
    if content_col is None:
        return df
    by = {c.lower(): c for c in df.columns}
    text = F.col(by[content_col.lower()]).cast("string")
    key = F.col(by[id_col.lower()]).cast("string") if id_col else F.sha2(F.to_json(F.struct(*df.columns)), 256)
    title = F.col(by[title_col.lower()]).cast("string") if title_col else F.lit(None).cast("string")
    used = {c.lower() for c in (id_col, content_col, title_col) if c}
    rest = [c for c in df.columns if c.lower() not in used]
    meta = F.map_from_arrays(F.array(*map(F.lit, rest)), F.array(*(F.col(c).cast("string") for c in rest))) if rest else F.create_map().cast("map<string,string>")
    return df.select(key.alias("id"), title.alias("title"), text.alias("content"), meta.alias("metadata")).where(F.trim("content") != "")


def _with_views(spark: SparkSession, sql: str, views: dict[str, DataFrame]) -> DataFrame:
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


def jdbc_documents(spark: SparkSession, url: str, sql: str, **options) -> DataFrame:
    """Rows of a SELECT that runs in a database; partitioning options pass through."""
    return spark.read.format("jdbc").options(url=url, query=sql, **options).load()


def fetch(url: str, timeout: float = 10.0) -> tuple[str, bytes]:
    """(content type, body) of an http(s) address; other schemes and types are an error, and a longer body too."""
    if urllib.parse.urlsplit(url).scheme not in ("http", "https"):
        raise ValueError(f"only http and https are fetched: {url}")
    with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310
        kind = answer.headers.get_content_type()
        if kind not in WEB_TYPES:
            raise ValueError(f"{kind} isn't read: {url}")
        body = answer.read(WEB_BYTES + 1)
    if len(body) > WEB_BYTES:
        raise ValueError(f"longer than {WEB_BYTES} bytes: {url}")
    return kind, body


def web_pages(spark: SparkSession, urls: list[str], rate: float = WEB_RATE) -> DataFrame:
    """(url, content_type, html) of a few addresses, fetched by the driver at `rate` in a second."""
    rows = []
    for i, url in enumerate(urls):
        if i:
            time.sleep(1 / rate)
        kind, body = fetch(url)
        rows.append((url, kind, body.decode("utf-8", "replace")))
    return spark.createDataFrame(rows, "url string, content_type string, html string")


def clone(url: str, into: str, shallow: bool = True) -> str:
    """Clones a repository into a folder that all executors see, for the directory loader."""
    subprocess.run(["git", "clone", "--quiet", *(["--depth", "1"] if shallow else []), url, into], check=True)
    return into


def bucket_documents(spark: SparkSession, bucket: str, prefix: str = "", scheme: str = "s3a", **how) -> DataFrame:
    """The documents below a prefix of an object store, read by the executors through its file system; credentials are the session's."""
    from tidewell.sources.files import load_directory

    return load_directory(spark, f"{scheme}://{bucket}/{prefix.lstrip('/')}", **how)


class HostedRepository(DataSource):
    """`spark.read.format("hosted_repository")`: the files of a repository on a host with a GitHub-like API, fetched by the executors.

    Options: `repo` (owner/name), `ref`, `base` (the API's address), `token`,
    `extensions` (comma-separated; none takes all), `batch` (files of a
    partition). The driver lists the tree once; a file that can't be decoded as
    UTF-8 is left out.
    """

    @classmethod
    def name(cls) -> str:
        return "hosted_repository"

    def schema(self) -> str:
        return "path string, sha string, content string"

    def reader(self, schema) -> "RepositoryReader":
        return RepositoryReader(dict(self.options))


class RepositoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.base = options.get("base", "https://api.github.com").rstrip("/")
        self.repo, self.ref, self.token = options["repo"], options.get("ref", "HEAD"), options.get("token")
        self.extensions = tuple("." + x.strip().lstrip(".") for x in options.get("extensions", "").split(",") if x.strip())
        self.batch = int(options.get("batch", "50"))

    def _get(self, path: str) -> dict:
        request = urllib.request.Request(f"{self.base}/repos/{self.repo}/{path}", headers={"Accept": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {}))
        with urllib.request.urlopen(request, timeout=30) as answer:  # noqa: S310
            return json.load(answer)

    def partitions(self) -> list[InputPartition]:
        tree = self._get(f"git/trees/{urllib.parse.quote(self.ref, safe='')}?recursive=1")
        if tree.get("truncated"):
            raise ValueError("the host cuts this tree; clone the repository instead")
        files = [(x["path"], x["sha"]) for x in tree["tree"] if x["type"] == "blob" and (not self.extensions or x["path"].endswith(self.extensions))]
        return [InputPartition(files[i : i + self.batch]) for i in range(0, len(files), self.batch)]

    def read(self, partition: InputPartition):
        for path, sha in partition.value:
            try:
                yield path, sha, base64.b64decode(self._get(f"git/blobs/{sha}")["content"]).decode("utf-8")
            except UnicodeDecodeError:
                continue
