"""Packing documents into fixed-size sequences: first-fit decreasing in random groups.

Within a group a tournament tree holds the room left in each bin, every inner
node the most of its two children; descending to the left child whenever it has
room enough finds the first bin that fits in logarithmic time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewell.llm.token_counts import n_tokens

CAPACITY, GROUP_DOCS, SEED = 2048, 4096, 17


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each length, in the order given; lengths must be sorted from large to small."""
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    out = []
    for need in lengths:
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        out.append(node - leaves)
        room[node] -= need
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
    return out


def pieces(doc_id, length: int, capacity: int) -> Iterator[tuple]:
    """A document as runs of at most `capacity` tokens: (id, start, length)."""
    for start in range(0, length, capacity):
        yield doc_id, start, min(capacity, length - start)


def _pack(capacity: int, id_type: pa.DataType):
    lists = [(n, pa.list_(t)) for n, t in (("doc_ids", id_type), ("starts", pa.int64()), ("lengths", pa.int64()))]
    schema = pa.schema([("group_id", pa.int64()), ("bin", pa.int64()), *lists, ("used", pa.int64())])

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        parts = [p for i, n in zip(rows["id"].to_pylist(), rows["n"].to_pylist(), strict=True) for p in pieces(i, n, capacity)]
        parts.sort(key=lambda p: (-p[2], p[0] is None, *(() if p[0] is None else (p[0],)), p[1]))
        bins: dict[int, list] = {}
        for part, b in zip(parts, first_fit_decreasing([p[2] for p in parts], capacity), strict=True):
            bins.setdefault(b, []).append(part)
        ids, starts, lengths = ([[p[k] for p in x] for x in bins.values()] for k in range(3))
        columns = ([key[0].as_py()] * len(bins), list(bins), ids, starts, lengths, [sum(x) for x in lengths])
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema)

    return pack


def tokens(text: str = "text"):
    """Length of a text in tokens of four bytes, rounded up, an estimate; 0 for a null or empty one."""
    return F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("long")


def pack(docs: DataFrame, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, seed: int = SEED, vocabulary: str | None = None) -> DataFrame:
    """(group_id, bin, doc_ids, starts, lengths, used): sequences of at most `capacity` tokens.

    Tokens are those of the byte-level vocabulary at the path `vocabulary`, so
    that starts and lengths are offsets into a text's own tokens; without a
    vocabulary a token is taken as four bytes, which is an estimate alone.

    Each document goes to a random group of about `group_docs` documents, by the
    hash of its id and the seed; only ids and lengths are moved. A document
    longer than a sequence is cut at multiples of the capacity, so that all of
    it is packed; `starts` says where each piece begins. Equal lengths are
    ordered by id. A null or empty text has no tokens and is in no bin; a null id
    is packed as null; rows that repeat an id are packed as often as they occur.
    Ids are of any type that has an order. An empty table gives no bins.
    """
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(seed))).otherwise(F.xxhash64("doc_id", F.lit(seed)))
    groups = max(1, -(-docs.count() // group_docs))
    n = tokens() if vocabulary is None else n_tokens(docs.sparkSession, "text", vocabulary)
    thin = docs.where(F.octet_length("text") > 0).select(F.pmod(spread, F.lit(groups)).alias("g"), F.col("doc_id").alias("id"), n.alias("n"))
    kind = thin.schema["id"].dataType
    schema = f"group_id long, bin long, doc_ids array<{kind.simpleString()}>, starts array<long>, lengths array<long>, used long"
    return thin.groupBy("g").applyInArrow(_pack(capacity, to_arrow_type(kind)), schema)
