"""Adapters for outside models. Each has a deterministic default; a real model is passed in by the caller."""

from __future__ import annotations

import hashlib
import inspect
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import let
from ..functions.text import extractable, prompt_text
from ..operators.merge import last_wins
from ..schemas import EXTRACTED_FACT, EXTRACTION

# Which replies may be tried again, how long to wait, how the budget is shared.
RETRYABLE, LONGEST_BACKOFF, FAIL_FAST, INTERACTIVE_SHARE = (408, 409, 425, 429), 8.0, 20.0, 0.2


def json_object(reply: Column) -> Column:
    """The outermost object in a reply: without fences and talk around it; null if there is none."""
    inner = F.regexp_replace(reply, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    found = F.regexp_extract(inner, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def parse_extraction(replies: DataFrame, reply_col: str = "reply") -> tuple[DataFrame, DataFrame]:
    """(rows with facts, issues): replies that don't hold an object of the schema become issues."""
    parsed = replies.withColumn("facts", F.from_json(json_object(F.col(reply_col)), EXTRACTION)["facts"])
    bad = parsed.where("facts is null").withColumns({"issue_type": F.lit("fact_extraction_error"), "description": F.substring(F.concat(F.lit("no facts in reply: "), F.coalesce(reply_col, F.lit(""))), 1, 500)})
    return parsed.where("facts is not null"), bad.drop("facts")


NUMBER = re.compile(r"(?P<subject>[A-Z][\w.& -]{1,60}?)\s+(?P<predicate>[a-z][\w /-]{2,60}?)\s+(?:was|were|is|of|stood at|reached)\s+(?P<raw>\(?[₹$€£]?\s?[\d,]+(?:\.\d+)?\)?)\s*(?P<unit>%|per ?cent|(?:INR |USD )?(?:crore|cr|million|mn|billion|bn|lakh|thousand))?(?:[^.\n]*?\b(?:in|for)\s+(?P<period>(?:[HQ]\d\s*)?FY\s?\d{2,4}(?:[-/]\d{2,4})?|\d{4}))?", re.I)


def rule_extractor(text: str) -> list[dict]:
    """The default extractor: "<subject> <metric> was <number> <unit> in <period>" sentences; parentheses make a number negative."""
    out = []
    for m in NUMBER.finditer(text or ""):
        raw = m["raw"].strip()
        number = float(re.sub(r"[^\d.]", "", raw) or 0)
        out.append({"subject": m["subject"].strip(), "predicate": m["predicate"].strip(), "raw_value": raw, "raw_unit": m["unit"], "numeric_value": -number if raw.startswith("(") else number, "period_label": m["period"], "scope": None, "status": None, "qualifiers": {}, "supporting_quote": m[0][:400], "confidence": 0.5})
    return out


def extract_facts(units: DataFrame, extractor: Callable[[str], list[dict]] = rule_extractor, attempts: int | None = None) -> DataFrame:
    """Rows of units (with a column text) with an array of facts; texts too short to hold any have an empty one.

    With attempts, an extractor that raises is asked again, with the error if it takes a second argument, up to that many times; then the row has
    no facts and its error (of 500 signs) in a further column. Without, the error ends the query."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in units.schema)

    def tried(prompt: str) -> tuple[list[dict], str | None]:
        error: Exception | None = None
        corrects = len(inspect.signature(extractor).parameters) > 1
        for _ in range(max(attempts or 1, 1)):
            try:
                return (extractor(prompt, str(error)) if error and corrects else extractor(prompt)), None
            except Exception as e:  # any fault of a model outside becomes an issue of its page
                if attempts is None:
                    raise
                error = e
        return [], f"{type(error).__name__}: {error}"[:500]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [tried(t) for t in frame["prompt"]]
            out = frame.assign(facts=[f for f, _ in got]).drop(columns="prompt")
            yield out if attempts is None else out.assign(error=[e for _, e in got])

    prompt = F.when(extractable(F.col("text")), prompt_text(F.col("text"))).otherwise("")
    return units.withColumn("prompt", prompt).mapInPandas(run, f"{fields}, facts array<{EXTRACTED_FACT}>" + (", error string" if attempts is not None else ""))


def hashed_encoder(dim: int = 64) -> Callable[[Column], Column]:
    """The default text encoder: a hashed bag of words of length 1, in native expressions."""

    def encode(text: Column) -> Column:
        slots = F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)))

        def unit(x: Column) -> Column:
            norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
            return let(norm, lambda n: F.transform(x, lambda v: F.when(n > 0, v / n).otherwise(0.0).cast("float")))

        return let(slots, lambda s: let(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.size(s) - F.size(F.array_remove(s, i.cast("long")))).cast("double")), unit))

    return encode


def clean_metadata(**fields: Column) -> Column:
    """A map of the fields as strings, without those that are null."""
    pairs = F.array(*(F.struct(F.lit(name).alias("key"), value.cast("string").alias("value")) for name, value in fields.items()))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def upsert_vectors(stored: DataFrame, rows: DataFrame, encoder: Callable[[Column], Column] | None = None, **fields: Column) -> DataFrame:
    """The vector table (id, text, embedding, metadata) with rows (id, text, and the columns that fields use) added, or in place of those with
    their ids; of rows with one id the greatest text stays."""
    encode = encoder or hashed_encoder()
    metadata = clean_metadata(**fields) if fields else F.create_map().cast("map<string,string>")
    new = rows.select("id", "text", encode(F.col("text")).alias("embedding"), metadata.alias("metadata"))
    return last_wins(stored, new, ["id"], "text")


class TokenBucket:
    """A client-side budget of tokens a minute; requests above the capacity are held to it, and real use corrects the estimate."""

    def __init__(self, per_minute: float, now: Callable[[], float] = time.monotonic):
        self.capacity = self.level = float(per_minute)
        self.rate, self.now, self.at = per_minute / 60.0, now, now()

    def refill(self) -> None:
        t = self.now()
        self.level, self.at = min(self.capacity, self.level + (t - self.at) * self.rate), t

    def wait_for(self, tokens: float) -> float:
        """Takes the tokens if they are there, and returns 0; else the seconds until they will be."""
        self.refill()
        tokens = min(tokens, self.capacity)
        if tokens <= self.level:
            self.level -= tokens
            return 0.0
        return (tokens - self.level) / self.rate

    def true_up(self, estimated: float, used: float) -> None:
        self.refill()
        self.level = min(self.capacity, self.level + estimated - used)


def lanes(per_minute: float) -> dict[str, TokenBucket]:
    return {"interactive": TokenBucket(per_minute * INTERACTIVE_SHARE), "background": TokenBucket(per_minute * (1 - INTERACTIVE_SHARE))}


class Unavailable(Exception):
    """A model that can't answer soon, or ever; the next one is asked."""


def call(models: list[Callable[[str], str]], prompt: str, attempts: int = 4, sleep: Callable[[float], None] = time.sleep) -> str:
    """The first model's answer; each is tried again after short waits, and left for the next if it is unavailable or asks for a long wait.
    An error may carry status and retry_after."""
    last: Exception | None = None
    for model in models:
        for n in range(attempts):
            try:
                return model(prompt)
            except Exception as error:  # judged by its status below, and raised again if it can't be mended
                last = error
                status, wait = getattr(error, "status", None), getattr(error, "retry_after", None) or min(2.0**n, LONGEST_BACKOFF)
                again = status is not None and (status in RETRYABLE or status >= 500)
                if isinstance(error, Unavailable) or not again or wait > FAIL_FAST or n == attempts - 1:
                    break
                sleep(wait)
    raise Unavailable("no model answered") from last


def complete_json(models: list[Callable[[str], str]], prompt: str, parse: Callable[[str], dict], **options) -> dict:
    """The object that parse makes of a model's reply; if it refuses the reply (ValueError), the model is asked once more, and told why."""
    reply = call(models, prompt, **options)
    try:
        return parse(reply)
    except ValueError as error:
        again = f"{prompt}\n\nYour reply was:\n{reply}\n\nIt can't be used ({error}). Reply with the corrected JSON object alone."
        return parse(call(models, again, **options))


class Keys:
    """Keys of one provider, taken in turn; a key that was told to wait is passed over until then."""

    def __init__(self, keys: list[str], now: Callable[[], float] = time.monotonic):
        self.keys, self.next, self.now = list(keys), 0, now
        self.until = dict.fromkeys(keys, 0.0)

    def take(self) -> str:
        for _ in self.keys:
            key = self.keys[self.next % len(self.keys)]
            self.next += 1
            if self.until[key] <= self.now():
                return key
        raise Unavailable("all keys wait")

    def wait(self, key: str, seconds: float) -> None:
        self.until[key] = self.now() + seconds


def read_chart(readers: list[Callable[[bytes, str], dict]], image: bytes, page_text: str | None) -> dict:
    """What the first reader that is available finds on a page's image; it is given the first 1500 signs of the page's own text beside it."""
    context = (page_text or "").strip()[:1500]
    return call([lambda _, reader=reader: reader(image, context) for reader in readers], context)


def cache_key(prompt: str) -> str:
    return hashlib.sha256(prompt.encode()).hexdigest()
