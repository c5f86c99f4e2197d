"""Text functions as Spark columns: words, sentences, sizes, language by script, query analysis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that keyword search ignores, in alphabetical order.
#: The word lists below define what is a term, a filler and an intent: results agree with other engines of this kind only by these very sets.
STOP = sorted(
    "a an and are as at be been being but by can could did do does for from had has have he her him his i if in into is it its just may me might must my not of on or our shall she should so than that the their them then these they this those to too very was we were what which who will with would you your".split()  # noqa: E501
)
#: Words without content for summaries, citations and answer checks, in alphabetical order.
FILLER = sorted(
    "a about after all an and any are as at be before between but by can could did do does down each for from had has have how if in into is it its just more most no not of on only or other out over own same should so some such than that the then this to too up very was were what when where which who whom why will with would".split()  # noqa: E501
)
_QUERY_STOP = sorted(
    "a an are as at be been being by can could did do does during for from had has have in into is may might must need of on shall should the through to was were will with would".split()
)
TEMPORAL = sorted("age century date day decade duration era month period time when where year".split())
CAUSAL = sorted("because cause consequence due effect lead reason result since therefore why".split())
COMPARATIVE = sorted("compare compared contrast difference relative similar unlike versus vs whereas".split())
PROCEDURAL = sorted("algorithm build create how implement make method procedure process step way".split())
EXISTENTIAL = sorted("are can did do does has have is will".split())
SCRIPTS = {
    "ar": "؀-ۿ",
    "el": "Ͱ-Ͽ",
    "he": "֐-׿",
    "hi": "ऀ-ॿ",
    "ja": "぀-ゟ゠-ヿ",
    "ko": "가-힯",
    "ru": "Ѐ-ӿ",
    "th": "฀-๿",
    "zh": "一-鿿",
}
_EDGES = "[.,;:!?\"'()\\[\\]{}]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: str | Column) -> Column:
    """Lower-cased maximal runs of letters and digits."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(r"([\p{L}\p{Nd}]+)"), F.lit(1))


def terms(text: str | Column) -> Column:
    """Words that keyword search indexes, with repetitions."""
    return F.filter(words(text), lambda w: ~w.isin(STOP))


def content_words(text: str | Column, least: int = 3) -> Column:
    """Words of at least `least` bytes that aren't filler, with repetitions."""
    return F.filter(words(text), lambda w: (F.octet_length(w) >= least) & ~w.isin(FILLER))


def slug(text: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def normalize_ws(text: str | Column) -> Column:
    """Each line's white space collapsed to single blanks; empty lines dropped."""
    lines = F.transform(F.split(col(text), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def sentences(text: str | Column) -> Column:
    """Runs up to and with each . ! ? or line end, trimmed, without empty ones."""
    raw = F.regexp_extract_all(col(text), F.lit("([^.!?\n]*[.!?\n]?)"), F.lit(1))
    return F.filter(F.transform(raw, lambda x: F.trim(F.translate(x, "\n\t\r", "   "))), lambda x: x != "")


def first_sentence(text: str | Column) -> Column:
    return F.coalesce(F.get(sentences(text), F.lit(0)), F.lit(""))


def token_estimate(text: str | Column) -> Column:
    """A quarter of the bytes, rounded down."""
    return F.floor(F.octet_length(col(text)) / 4)


def script_counts(text: str | Column) -> dict[str, Column]:
    """Characters by script; letters of any other script count as "en"."""
    t = col(text)
    every = "".join(SCRIPTS.values())
    # Runs are taken out whole: a text without them is read once and isn't copied.
    gone = lambda chars: F.char_length(t) - F.char_length(F.regexp_replace(t, f"[{chars}]+", ""))
    out = {k: gone(v) for k, v in SCRIPTS.items()}
    out["en"] = F.char_length(F.regexp_replace(t, f"[{every}[^\\p{{L}}]]+", ""))
    return out


def script_language(text: str | Column) -> Column:
    """The script with most characters, the alphabetically first of equals; "unknown" without any letter.

    Characters are counted, each script once, only where a text has some of
    these scripts; any other text is "en" from its first letter on.
    """
    counts = script_counts(text)
    best = F.reduce(F.array(*(F.struct(n.alias("n"), F.lit(k).alias("k")) for k, n in sorted(counts.items()))), F.struct(F.lit(0).alias("n"), F.lit("unknown").alias("k")), lambda a, x: F.when(x.n > a.n, x).otherwise(a))
    mixed = col(text).rlike(f"[{''.join(SCRIPTS.values())}]")
    return F.when(mixed, best.k).when(col(text).rlike(r"\p{L}"), "en").otherwise("unknown")


def _any(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(p) for p in parts))


def intent(query: str | Column, whole_words: bool = False) -> Column:
    """temporal, causal, comparative, procedural, existential or factual, by the first list with a hit.

    Keywords match anywhere inside words; with `whole_words` only as words.
    """
    q = F.lower(col(query))
    hit = (lambda ws: F.arrays_overlap(words(q), F.array(*map(F.lit, ws)))) if whole_words else (lambda ws: _any(q, ws))
    starts = reduce(lambda a, b: a | b, (q.startswith(w + " ") for w in EXISTENTIAL)) | q.startswith("is there") | q.startswith("are there")
    return (
        F.when(hit(TEMPORAL), "temporal")
        .when(hit(CAUSAL), "causal")
        .when(hit(COMPARATIVE), "comparative")
        .when(hit(PROCEDURAL), "procedural")
        .when(starts, "existential")
        .when(_any(q, [" vs ", " versus ", " compare ", " and "]), "comparative")
        .otherwise("factual")
    )


def query_entities(query: str | Column) -> Column:
    """Capitalised words of a query, without outer punctuation and stop words, of two bytes or more."""
    parts = F.transform(F.split(F.trim(F.regexp_replace(col(query), r"\s+", " ")), " "), lambda w: F.regexp_replace(w, f"^{_EDGES}+|{_EDGES}+$", ""))
    return F.filter(parts, lambda w: (F.octet_length(w) >= 2) & ~F.lower(w).isin(_QUERY_STOP) & w.rlike("^[A-Z]"))


def year_filter(query: str | Column) -> Column:
    """The first run of exactly four digits after the first " in "; null without one."""
    q = col(query)
    after = F.regexp_extract(q, r"(?is)^.*? in (.*)$", 1)
    return F.nullif(F.regexp_extract(after, r"(?:^|\D)(\d{4})(?:\D|$)", 1), F.lit(""))


def decompose(query: str | Column) -> Column:
    """Parts of a query: its questions if two or more, else both sides of the first conjunction, else the query itself."""
    q = col(query)
    marks = F.char_length(q) - F.char_length(F.translate(q, "?", ""))
    pieces = F.split(q, r"\?")
    last = F.size(pieces) - 1
    asked = F.transform(pieces, lambda p, i: F.when(F.trim(p) == "", F.lit("")).otherwise(F.concat(F.trim(p), F.when(i < last, "?").otherwise(""))))
    asked = F.array_distinct(F.filter(asked, lambda p: p != ""))
    out = F.array(q)
    for sep in reversed([" and ", " or ", "; ", " what about ", " also "]):
        at = F.locate(sep, F.lower(q))
        a, b = F.trim(F.substring(q, F.lit(1), at - 1)), F.trim(F.substring(q, at + len(sep), F.char_length(q)))
        out = F.when((at > 1) & (a != "") & (b != ""), F.array_distinct(F.array(a, b))).otherwise(out)
    return F.when((marks >= 2) & (F.size(asked) > 1), F.slice(asked, 1, 5)).when(marks >= 2, F.array(q)).otherwise(out)


def parse_score(reply: str | Column) -> Column:
    """The first number of a reply, from 0 to 10, as a share of 10; 0 without one."""
    n = F.regexp_extract(col(reply), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.least(F.greatest(F.coalesce(n, F.lit(0.0)) / 10, F.lit(0.0)), F.lit(1.0))
