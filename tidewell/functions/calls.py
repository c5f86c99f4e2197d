"""Wrappers for model callables (prompt to text), prompts built on them, cache keys and trace headers."""

from __future__ import annotations

import json
import re
import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.text import col

Model = Callable[[str], str]


def retrying(model: Model, attempts: int = 3, wait: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Model:
    """Calls again after an exception, waiting twice as long each time."""

    def call(prompt: str) -> str:
        for n in range(attempts):
            try:
                return model(prompt)
            except Exception:
                if n == attempts - 1:
                    raise
                sleep(wait * 2**n)
        raise ValueError("no attempts")

    return call


def falling_back(*models: Model) -> Model:
    """The first model that answers; the last one's exception if none does."""

    def call(prompt: str) -> str:
        for n, model in enumerate(models):
            try:
                return model(prompt)
            except Exception:
                if n == len(models) - 1:
                    raise
        raise ValueError("no models")

    return call


class Breaker:
    """Refuses calls for `rest` seconds after `most` failures in a row."""

    def __init__(self, model: Model, most: int = 5, rest: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.model, self.most, self.rest, self.clock, self.failed, self.until = model, most, rest, clock, 0, 0.0

    def __call__(self, prompt: str) -> str:
        if self.clock() < self.until:
            raise RuntimeError("the circuit is open")
        try:
            out = self.model(prompt)
        except Exception:
            self.failed += 1
            if self.failed >= self.most:
                self.until, self.failed = self.clock() + self.rest, 0
            raise
        self.failed = 0
        return out


class RateLimit:
    """A token bucket before a model: `rate` calls in a second, `burst` at once."""

    def __init__(self, model: Model, rate: float, burst: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.model, self.rate, self.burst, self.clock, self.sleep = model, rate, burst, clock, sleep
        self.held, self.at = float(burst), clock()

    def __call__(self, prompt: str) -> str:
        now = self.clock()
        self.held, self.at = min(self.burst, self.held + (now - self.at) * self.rate), now
        if self.held < 1:
            self.sleep((1 - self.held) / self.rate)
            self.held, self.at = 1.0, self.clock()
        self.held -= 1
        return self.model(prompt)


def lines(reply: str, most: int = 5) -> list[str]:
    """Distinct non-empty lines of a reply without list marks."""
    out = dict.fromkeys(x for line in reply.split("\n") if (x := line.strip().removeprefix("-").strip()))
    return list(out)[:most]


def hypothetical(model: Model, query: str) -> str:
    """A passage that would answer the query, to be embedded in its place."""
    return model(f"Write a short passage that answers this question:\n{query}").strip() or query


def step_back(model: Model, query: str) -> str:
    return model(f"State the more general question behind this one, in one line:\n{query}").strip().split("\n")[0] or query


def rewrite(model: Model, query: str) -> str:
    return model(f"Rewrite this search query so that it is clear and complete, in one line:\n{query}").strip().split("\n")[0] or query


def decompose(model: Model, query: str, most: int = 5) -> list[str]:
    return lines(model(f"List the simpler questions that together answer this one, one on each line:\n{query}"), most) or [query]


def translate(model: Model, text: str, language: str) -> str:
    return model(f"Translate into {language}, without comment:\n{text}").strip().split("\n")[0]


def extracted(reply: str) -> list[dict]:
    """Objects of the first JSON array in a reply; none if it doesn't parse."""
    m = re.search(r"\[.*\]", reply, re.S)
    try:
        return [x for x in json.loads(m[0]) if isinstance(x, dict)] if m else []
    except ValueError:
        return []


def cache_key(*parts: str | Column) -> Column:
    """SHA-256 of the parts' canonical text, for result, embedding and traversal caches."""
    return F.sha2(F.concat_ws("\x1f", *(F.lower(F.trim(col(p))) for p in parts)), 256)


_PARENT = "^([0-9a-f]{2})-([0-9a-f]{32})-([0-9a-f]{16})-([0-9a-f]{2})$"


def traceparent(header: str | Column) -> Column:
    """Struct (trace_id, span_id, sampled) of a trace header; null where it isn't valid or an id is all zeros."""
    h = F.lower(F.trim(col(header)))
    part = lambda i: F.regexp_extract(h, _PARENT, i)
    ok = h.rlike(_PARENT) & (part(1) != "ff") & ~part(2).rlike("^0+$") & ~part(3).rlike("^0+$")
    sampled = F.conv(F.substring(part(4), 2, 1), 16, 2).endswith("1")
    return F.when(ok, F.struct(part(2).alias("trace_id"), part(3).alias("span_id"), sampled.alias("sampled")))


def traces(spans):
    """(trace_id, n_spans, start, end, spans) of a table of spans (trace_id, span_id, parent_id, name, start, end)."""
    return spans.groupBy("trace_id").agg(F.count("*").alias("n_spans"), F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_list(F.struct("start", "span_id", "parent_id", "name", "end"))).alias("spans"))


class Remembering:
    """A callable's results by its argument: the `most` used last, each for `ttl` seconds; for one process."""

    def __init__(self, call, most: int = 1024, ttl: float | None = None, clock=time.monotonic):
        self.call, self.most, self.ttl, self.clock, self.held = call, most, ttl, clock, OrderedDict()
        self.hits = self.misses = 0

    def __call__(self, key):
        now, found = self.clock(), self.held.pop(key, None)
        if found is not None and (self.ttl is None or now - found[0] < self.ttl):
            self.hits += 1
        else:
            self.misses += 1
            found = (now, self.call(key))
        self.held[key] = found
        while len(self.held) > self.most:
            self.held.popitem(last=False)
        return found[1]
