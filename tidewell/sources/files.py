"""File sources as DataFrames of documents (id, title, source, content, metadata), and log sinks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.text import slug
from tidewell.sources.html import html_text

_META = "map<string,string>"
_HEADING = re.compile(r"^ {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")
EXTENSIONS = {"txt": "text", "text": "text", "md": "markdown", "csv": "csv", "json": "json", "html": "html", "htm": "html", "docx": "docx", "pdf": "pdf"}


def _meta(**values) -> F.Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]
    return F.create_map(*pairs) if pairs else F.create_map().cast(_META)


def load_text(spark: SparkSession, path: str, most_bytes: int | None = None) -> DataFrame:
    """Whole files; empty ones are left out, longer ones than `most_bytes` too."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("content"))
    rows = rows.where(F.octet_length("content") > 0)
    if most_bytes is not None:
        rows = rows.where(F.octet_length("content") <= most_bytes)
    return rows.select(F.col("source").alias("id"), F.lit(None).cast("string").alias("title"), "source", "content", F.create_map().cast(_META).alias("metadata"))


def markdown_sections(text: str) -> list[dict]:
    """Sections between ATX headings with their heading path; fenced lines aren't headings; empty sections are dropped."""
    out, stack, body, fence = [], [], [], False

    def close() -> None:
        content = "\n".join(body).strip()
        if content:
            out.append({"heading": stack[-1][1] if stack else "", "path": " > ".join(h for _, h in stack), "level": stack[-1][0] if stack else 0, "content": content})
        body.clear()

    for line in text.split("\n"):
        if line.lstrip().startswith("```"):
            fence = not fence
        m = None if fence else _HEADING.match(line)
        if m:
            close()
            level = len(m[1])
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, m[2].strip()))
        else:
            body.append(line)
    close()
    return out


_SECTION = T.ArrayType(T.StructType([T.StructField("heading", T.StringType()), T.StructField("path", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("content", T.StringType())]))


@F.arrow_udf(_SECTION)
def _sections(text: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("heading", pa.string()), ("path", pa.string()), ("level", pa.int32()), ("content", pa.string())]))
    return pa.array([markdown_sections(t or "") for t in text.to_pylist()], kind)


def split_markdown(docs: DataFrame) -> DataFrame:
    """Sections of each document (id, content): id#slug, numbered from the second of one slug on."""
    rows = docs.select(F.col("id").alias("doc"), F.posexplode(_sections("content")).alias("n", "s"))
    s = F.when(slug("s.heading") == "", "section").otherwise(slug("s.heading"))
    from pyspark.sql import Window as W

    k = F.row_number().over(W.partitionBy("doc", "slug").orderBy("n"))
    rows = rows.withColumn("slug", s).withColumn("k", k)
    key = F.concat("doc", F.lit("#"), "slug", F.when(F.col("k") > 1, F.concat(F.lit("-"), F.col("k").cast("string"))).otherwise(""))
    meta = _meta(heading=F.col("s.heading"), section_path=F.col("s.path"), level=F.col("s.level"))
    return rows.select(key.alias("id"), F.col("s.heading").alias("title"), F.col("doc").alias("source"), F.col("s.content").alias("content"), meta.alias("metadata"))


def load_markdown(spark: SparkSession, path: str) -> DataFrame:
    return split_markdown(load_text(spark, path))


def load_csv(spark: SparkSession, path: str, header: bool = True, separator: str = ",", id_col: str | None = None, content_cols: list[str] | None = None) -> DataFrame:
    """One document a row: content columns joined by " | ", all columns as metadata; ids default to path:rowN in the order of the file."""
    rows = spark.read.csv(path, header=header, sep=separator, multiLine=True, inferSchema=False)
    if not header:
        rows = rows.toDF(*(f"col_{i}" for i in range(len(rows.columns))))
    names = rows.columns
    meta = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(f"`{c}`") for c in names)))
    rows = rows.withColumns({"__tw_path": F.col("_metadata.file_path"), "__tw_at": F.monotonically_increasing_id()})
    if id_col:
        key = F.col(f"`{id_col}`")
    else:
        from pyspark.sql import Window as W

        rows = rows.withColumn("__tw_n", F.row_number().over(W.partitionBy("__tw_path").orderBy("__tw_at")))
        key = F.concat("__tw_path", F.lit(":row"), F.col("__tw_n").cast("string"))
    content = F.concat_ws(" | ", *(F.col(f"`{c}`") for c in content_cols or names))
    return rows.select(key.alias("id"), F.lit(None).cast("string").alias("title"), F.col("__tw_path").alias("source"), content.alias("content"), meta.alias("metadata"))


def load_json(spark: SparkSession, path: str, content: str = "content", key: str | None = None) -> DataFrame:
    """Objects, or the elements of an array, with dotted paths to content and id; top-level scalars become metadata."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("source"), F.trim("value").alias("v"))
    one = F.when(F.col("v").startswith("["), F.from_json("v", "array<variant>")).otherwise(F.array(F.try_parse_json("v")))
    rows = raw.select("source", F.posexplode(one).alias("n", "x")).withColumn("j", F.to_json("x"))
    at = lambda p: F.get_json_object("j", "$." + p)
    flat = F.map_filter(F.from_json("j", _META), lambda k, v: v.isNotNull() & ~v.rlike(r"^\s*[\[{]"))
    ids = at(key) if key else F.concat("source", F.lit("#"), F.col("n").cast("string"))
    return rows.select(ids.alias("id"), at("title").alias("title"), "source", at(content).alias("content"), flat.alias("metadata")).where("content is not null")


def load_html(spark: SparkSession, path: str, keep_chrome: bool = False) -> DataFrame:
    rows = load_text(spark, path).withColumn("x", html_text(keep_chrome)("content"))
    return rows.select("id", F.col("x.title").alias("title"), "source", F.col("x.content").alias("content"), "metadata")


def docx_text(data: bytes) -> str:
    """Paragraphs, tabs and breaks of word/document.xml."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(f"{w}p"):
        parts = {f"{w}t": lambda e: e.text or "", f"{w}tab": lambda e: "\t", f"{w}br": lambda e: "\n"}
        out.append("".join(parts[e.tag](e) for e in p.iter() if e.tag in parts))
    return "\n".join(out)


def _binary(spark: SparkSession, path: str, suffix: str, read) -> DataFrame:
    @F.arrow_udf(T.StringType())
    def text(data: pa.Array) -> pa.Array:
        return pa.array([read(d) for d in data.to_pylist()], pa.string())

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").load(path)
    return rows.select(F.col("path").alias("id"), F.lit(None).cast("string").alias("title"), F.col("path").alias("source"), text("content").alias("content"), F.create_map().cast(_META).alias("metadata"))


def load_docx(spark: SparkSession, path: str) -> DataFrame:
    return _binary(spark, path, "docx", docx_text)


def pdf_text(data: bytes) -> str:
    """Text of all pages, where the optional package `pypdf` is installed."""
    from pypdf import PdfReader

    return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages)


def load_pdf(spark: SparkSession, path: str) -> DataFrame:
    return _binary(spark, path, "pdf", pdf_text)


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """The loader for the extension of `path`; an unknown one is an error."""
    kind = EXTENSIONS.get(path.rsplit(".", 1)[-1].lower())
    if kind is None:
        raise ValueError(f"no loader for {path}")
    return globals()[f"load_{kind}"](spark, path, **options)


def load_directory(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("txt", "md", "csv", "json", "html")) -> DataFrame:
    """All files below a folder whose extension is listed, each by its loader; an extension without files is left out."""
    out = None
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[str, list[str]] = {}
    for f in _walk(fs, hadoop):
        ext = f.rsplit(".", 1)[-1].lower()
        if ext in extensions:
            found.setdefault(EXTENSIONS[ext], []).append(f)
    for kind, files in sorted(found.items()):
        for f in [files] if kind in ("text", "markdown", "html", "json") else files:
            part = globals()[f"load_{kind}"](spark, f)
            out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"id string, title string, source string, content string, metadata {_META}")


def _walk(fs, path) -> Iterator[str]:
    files = fs.listFiles(path, True)
    while files.hasNext():
        yield files.next().getPath().toString()


def append_log(rows: DataFrame, path: str) -> None:
    """Query records as JSON lines."""
    rows.write.mode("append").json(path)


def backup(spark: SparkSession, table: str, to: str) -> None:
    """A copy of a table's folder; the target must not exist."""
    spark.read.parquet(table).write.mode("error").parquet(to)


def restore(spark: SparkSession, copy: str, to: str, schema: str | None = None) -> None:
    """A backup written back over a table's folder; with `schema`, brought to it first. The copy must be readable before anything is lost."""
    rows = spark.read.parquet(copy)
    rows = migrated(rows, schema) if schema else rows
    rows.count()
    rows.write.mode("overwrite").parquet(to)


def migrated(rows: DataFrame, schema: str) -> DataFrame:
    """Rows in a newer schema: columns that are missing are null, types are cast, columns that it lacks go."""
    wanted = T.StructType.fromDDL(schema)
    return rows.select(*((F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted))
