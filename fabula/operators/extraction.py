"""Facts from chunks through a language-model provider.

A provider is any object with ``complete(text, family) -> str`` that answers with JSON:
``{"facts": [...]}``, maybe in a fenced block. An answer must keep to the schema of its
family in every part, and hold nothing else. A call that fails, takes too long or answers
with something else is tried again after a growing pause; if it never succeeds, the
chunk has a row with the error instead of facts.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from datetime import datetime
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame

from fabula.operators.entities import FAMILIES, typed_values
from fabula.operators.ledger import Ledger

FACTS = "chunk_id string, doc_id bigint, family string, type string, entity_name string, summary string, confidence double, quote string, timeline_hint string, value string, error string"
#: The members of each family's values, those that are lists of strings, and the
#: words that say where an event stands.
STRINGS = {
    "character": ("summary", "targetEntityName", "relationshipType", "change"),
    "location": ("summary", "parentName", "locationKind", "atmosphere", "architecture", "era", "socialContext", "lighting"),
    "timeline": ("title", "description", "absoluteDate", "relativeMarker", "relativeOrderHint", "anchorEventTitle", "periodName"),
}
LISTS = {"character": ("candidateNames",), "location": ("candidateNames", "colors", "recurringObjects"), "timeline": ("characterNames", "locationNames", "candidateNames")}
REQUIRED = {"character": "summary", "location": "summary", "timeline": "title"}
ORDER_HINTS = ("before", "after", "same_time", "childhood", "next_day", "year_later", "unknown")
TIMEOUT_S = 60.0
#: Chunks of which a task holds the requests and the facts at once.
CHUNKS_AT_ONCE = 64


class Provider(Protocol):
    def complete(self, text: str, family: str) -> str: ...


class RuleProvider:
    """A deterministic stand-in: each capitalized word pair in a text is a mention of a
    character, and each capitalized word after "in" or "at" one of a location."""

    def complete(self, text: str, family: str) -> str:
        pattern = {"character": r"(?a)\b[A-Z][a-z]+ [A-Z][a-z]+\b", "location": r"(?a)\b(?:in|at) ([A-Z][a-z]+)\b"}.get(family)
        found = dict.fromkeys(re.findall(pattern, text)) if pattern else ()
        return json.dumps({"facts": [{"type": f"{family.upper()}_MENTION", "entityName": n, "value": {"summary": n.lower()}, "confidence": 0.5} for n in found]})


def retry_delay(attempt: int, initial_ms: int = 250, factor: float = 2.0, most_ms: int = 2000) -> int:
    """Milliseconds to wait after the failed attempt of this number, from 1."""
    return min(most_ms, int(initial_ms * factor ** (attempt - 1)))


def with_retry(call: Callable[[], object], attempts: int = 3, sleep: Callable[[float], None] = time.sleep):
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except Exception:
            if attempt == attempts:
                raise
            sleep(retry_delay(attempt) / 1000)
    raise AssertionError


class Hanging(RuntimeError):
    """Too many calls of a task are still open."""


class Clock:
    """Calls with a time limit. Nothing can end a thread from outside, so a call that takes too long
    is left to itself; once ``most`` of them are open, no other one is begun."""

    def __init__(self, seconds: float = TIMEOUT_S, most: int = 16):
        self.seconds, self.most = seconds, most
        self.open: set[Future] = set()

    def __call__(self, call: Callable[[], object]):
        self.open = {f for f in list(self.open) if not f.done()}
        if len(self.open) >= self.most:
            raise Hanging(f"{len(self.open)} calls are open")
        pool = ThreadPoolExecutor(1)
        made = pool.submit(call)
        try:
            return made.result(timeout=self.seconds)
        except TimeoutError:
            self.open.add(made)
            raise
        finally:
            pool.shutdown(wait=False)


def with_timeout(call: Callable[[], object], seconds: float = TIMEOUT_S):
    """The call's result, or TimeoutError once it takes too long."""
    return Clock(seconds)(call)


def unwrap_json(answer: str):
    """The JSON in an answer, with or without a fence around it; None if there is none."""
    m = re.search(r"```(?:json)?\s*(.*?)```", answer, re.S)
    try:
        return json.loads(m[1] if m else answer)
    except ValueError:
        return None


def fact_values(value: Column, family: str) -> Column:
    """The members of facts' values (JSON) that a family's merge reads, by their types."""
    return typed_values(value, STRINGS[family], LISTS[family])


def _text(x: object) -> str:
    if not isinstance(x, str) or not x.strip():
        raise ValueError("not a text")
    return x.strip()


def _members(x: object, required: set[str], optional: set[str]) -> dict:
    if not isinstance(x, dict) or not required <= set(x) <= required | optional:
        raise ValueError(f"members {sorted(x) if isinstance(x, dict) else type(x).__name__}")
    return x


def _fact(x: object, family: str) -> tuple:
    x = _members(x, {"type", "entityName", "value", "confidence"}, {"quote", "timelineHint"})
    if x["type"] not in FAMILIES[family]:
        raise ValueError(f"type {x['type']}")
    value = _members(x["value"], {REQUIRED[family]}, {*STRINGS[family], *LISTS[family]})
    value = {k: [_text(y) for y in (v if isinstance(v, list) else [None])] if k in LISTS[family] else _text(v) for k, v in value.items()}
    if value.get("relativeOrderHint", "unknown") not in ORDER_HINTS:
        raise ValueError("relativeOrderHint")
    if "absoluteDate" in value and ("T" not in value["absoluteDate"] or datetime.fromisoformat(value["absoluteDate"]).tzinfo is None):
        raise ValueError("absoluteDate")
    score = x["confidence"]
    if isinstance(score, bool) or not isinstance(score, int | float) or not 0 <= score <= 1:
        raise ValueError("confidence")
    quote, hint = (_text(x[k]) if k in x else None for k in ("quote", "timelineHint"))
    return x["type"], _text(x["entityName"]), value[REQUIRED[family]], float(score), quote, hint, json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def valid_facts(answer: str, family: str) -> list[tuple]:
    """(type, entity name, summary or title, confidence, quote, timeline hint, value) of every
    fact; ValueError where anything in the answer isn't as its schema says."""
    given = _members(unwrap_json(answer), set(), {"facts"})
    facts = given.get("facts", [])
    if not isinstance(facts, list):
        raise ValueError("facts")
    return [_fact(x, family) for x in facts]


def extract_facts(chunks: DataFrame, provider: Provider, families: tuple[str, ...] = ("character",), attempts: int = 3, timeout_s: float = TIMEOUT_S, ledger: Ledger | None = None, in_flight: int = 1) -> DataFrame:
    """Facts of all chunks (chunk_id, doc_id, text); chunks stay in their partitions. At most ``in_flight``
    calls of a partition are open at once. With a ``ledger`` valid answers are kept as they come, and what
    it has is not asked again."""
    names = [x.split()[0] for x in FACTS.split(", ")]
    kinds = [pa.float64() if n == "confidence" else pa.int64() if n == "doc_id" else pa.string() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clock = Clock(timeout_s, max(16, 2 * in_flight))

        def ask(request: tuple) -> list[tuple]:
            chunk, doc, text, family = request
            known = ledger.get(text, family) if ledger else None

            def call() -> list[tuple]:
                answer = clock(lambda: provider.complete(text, family))
                facts = valid_facts(answer, family)
                if ledger:
                    ledger.put(text, family, answer)
                return facts

            try:
                return [(chunk, doc, family, *f, None) for f in (with_retry(call, attempts) if known is None else valid_facts(known, family))]
            except Exception as e:  # one chunk must not stop the others
                return [(chunk, doc, family, *[None] * 7, f"{type(e).__name__}: {e}"[:300])]

        with ThreadPoolExecutor(in_flight) as pool:
            for batch in (b.slice(at, CHUNKS_AT_ONCE) for b in batches for at in range(0, len(b), CHUNKS_AT_ONCE)):
                rows = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
                requests = [(chunk, doc, text or "", family) for chunk, doc, text in rows for family in families]
                out = [r for made in pool.map(ask, requests) for r in made]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return chunks.select("chunk_id", "doc_id", "text").mapInArrow(run, FACTS)
