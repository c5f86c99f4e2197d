"""Chunking: one document to many chunks. Expressions where Spark has them, Arrow batches where a fold is needed."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import col, sentences

_SCHEMA = "chunk_id string, doc_id long, chunk_index long, content string"
_ARROW = pa.schema([("chunk_id", pa.string()), ("doc_id", pa.int64()), ("chunk_index", pa.int64()), ("content", pa.string())])
SEPARATORS = ("\n\n\n", "\n\n", "\n", ". ", ", ")


def chunk_id(doc: str | Column = "doc_id", index: str | Column = "chunk_index") -> Column:
    return F.concat(col(doc).cast("string"), F.lit("::chunk-"), col(index).cast("string"))


def split_parts(docs: DataFrame, separator: str) -> DataFrame:
    """One row (chunk_id, doc_id, chunk_index, chunk_count, content) for each non-blank part between separators; null texts have none."""
    pattern = re.escape(separator)
    parts = F.filter(F.transform(F.split("text", pattern), lambda x: F.trim(x)), lambda x: x != "")
    rows = docs.select("doc_id", parts.alias("parts")).select("doc_id", F.size("parts").cast("long").alias("chunk_count"), F.posexplode("parts").alias("chunk_index", "content"))
    rows = rows.withColumn("chunk_index", F.col("chunk_index").cast("long"))
    return rows.select(chunk_id().alias("chunk_id"), "doc_id", "chunk_index", "chunk_count", "content")


def by_size(s: str, most: int) -> list[str]:
    """Pieces of at most `most` characters, cut after the first line end in the last 20 of them if there is one."""
    out = []
    while len(s) > most:
        at = s.find("\n", max(0, most - 20), most)
        cut = at + 1 if at >= 0 else most
        out.append(s[:cut].strip())
        s = s[cut:].strip()
    return [*out, s] if s else out


def fixed(text: str, tokens: int = 512, overlap: int = 50, least: int = 50, separator: str = "\n\n") -> list[str]:
    """Parts packed up to 4 * tokens characters; a new chunk begins with the last whole parts that fit into 4 * overlap.

    A part that is too long is cut by size. A chunk of one part shorter than
    `least` is dropped.
    """
    most, keep, sep = 4 * tokens, 4 * overlap, len(separator)
    parts = [p for part in text.split(separator) for p in (by_size(part, most) if len(part.strip()) > most else [part])]
    out: list[str] = []
    now: list[str] = []
    size = 0

    def emit() -> None:
        chunk = separator.join(now).strip()
        if len(chunk) >= least or len(now) > 1:
            out.append(chunk)

    for part in parts:
        n = len(part.strip())
        if now and size + sep + n > most:
            emit()
            tail: list[str] = []
            for p in reversed(now):
                if len(separator.join([p, *tail])) + sep > keep:
                    break
                tail.insert(0, p)
            now = [separator.join(tail)] if any(tail) else []
            size = len(now[0]) if now else 0
        size += n + (sep if now else 0)
        now.append(part)
    if now:
        emit()
    return out


def recursive(text: str, tokens: int = 512, least: int = 50) -> list[tuple[int, str]]:
    """Every piece above 4 * tokens characters is split by the first separator that it holds, else in halves; (index, piece), short ones dropped."""
    most, out, todo = 4 * tokens, [], [text]
    while todo:
        piece = todo.pop()
        if len(piece) <= most:
            out.append(piece)
            continue
        for sep in SEPARATORS:
            parts = [p for p in piece.split(sep) if p]
            if len(parts) > 1:
                break
        else:
            parts = [piece[: len(piece) // 2], piece[len(piece) // 2 :]]
        todo.extend(reversed(parts))
    return [(i, s) for i, p in enumerate(out) if len(s := p.strip()) >= least]


def adaptive_tokens(text: str | Column, per_chunk: int = 6, low: int = 64, high: int = 512) -> Column:
    """Size in tokens of a chunk of about `per_chunk` sentences of the text's mean length, between the bounds."""
    found = sentences(text)
    total = F.aggregate(F.transform(found, lambda s: F.char_length(s).cast("long")), F.lit(0).cast("long"), lambda a, n: a + n)
    mean = F.floor(total / F.greatest(F.size(found), F.lit(1)))
    return F.least(F.greatest(F.floor(mean * per_chunk / 4), F.lit(low)), F.lit(high)).cast("long")


_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]?")


def adaptive(text: str, overlap: int = 50, least: int = 50, separator: str = "\n") -> list[str]:
    """`fixed` with the size of `adaptive_tokens` for this text, and no more overlap than an eighth of it."""
    found = [s for x in _SENTENCE.findall(text) if (s := x.translate(_BLANKS).strip(" "))]
    mean = sum(map(len, found)) // max(1, len(found))
    tokens = min(max(mean * 6 // 4, 64), 512)
    return fixed(text, tokens, min(overlap, tokens // 8), least, separator)


_BLANKS = str.maketrans("\n\t\r", "   ")


def by_sections(text: str, inner: Callable[[str], list], separator: str = "\n---\n") -> list[str]:
    """The chunks that `inner` makes of each section of a document, so that none spans two."""
    return [x[1] if isinstance(x, tuple) else x for part in text.split(separator) if part.strip() for x in inner(part.strip())]


_END = re.compile(r"(?<=[.!?])(?=[ \n\r\t])")


def strict_sentences(text: str) -> list[str]:
    """Sentences that end with . ! ? before white space or the end."""
    return [s for p in _END.split(text) if (s := p.strip())]


def semantic(text: str, embed: Callable[[list[str]], "object"], limit: float = 0.7, least: int = 100, most: int = 2000) -> list[str]:
    """Sentences grouped where neighbours' cosine stays at `limit` or more.

    A group below `least` bytes takes the next one in; above `most` bytes it is
    closed. Sentences are joined by ". ".
    """
    import numpy as np

    found = strict_sentences(text)
    if not found:
        return []
    v = np.asarray(embed(found), float)
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    near = (v[1:] * v[:-1]).sum(axis=1)
    out, group, size = [], [], 0
    for i, s in enumerate(found):
        n = len(s.encode()) + (2 if group else 0)
        if group and (size + n > most or (size >= least and near[i - 1] < limit)):
            out.append(". ".join(group))
            group, size, n = [], 0, len(s.encode())
        group.append(s)
        size += n
    out.append(". ".join(group))
    return out


def chunked(docs: DataFrame, chunker: Callable[[str], list]) -> DataFrame:
    """(chunk_id, doc_id, chunk_index, content) of a chunker that returns contents, or (index, content) pairs; null and empty texts have no chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i, found in enumerate(chunker(text) if text else []):
                    at, content = found if isinstance(found, tuple) else (i, found)
                    rows.append((f"{doc}::chunk-{at}", doc, at, content))
            if rows:
                yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], _ARROW)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SCHEMA)


def parents_of(children: DataFrame, parents: DataFrame) -> DataFrame:
    """(doc_id, child_index, parent_index): the first parent of a child's document that holds the child's first 64 characters, else its first 16.

    Both tables are (doc_id, chunk_index, content). Parents of a document are
    gathered into one row, so each child meets its own document's parents alone.
    """
    own = parents.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))).alias("parents"))
    anchor = F.trim(F.substring("content", 1, 64))
    short = F.trim(F.substring("content", 1, 16))
    hit = lambda a: F.get(F.filter("parents", lambda p: (a != "") & p.content.contains(a)), F.lit(0)).chunk_index
    rows = children.join(own, "doc_id")
    return rows.select("doc_id", F.col("chunk_index").alias("child_index"), F.coalesce(hit(anchor), hit(short)).alias("parent_index"))
