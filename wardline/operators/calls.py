"""Calls of models, a row each: routed, bounded, retried, and never the end of a job.

A provider is a function of prompt and attempt that answers with a text or
raises. Rows are called side by side in a task, at most ``workers`` at once, and
come back in their order; a task holds as many rows as an Arrow batch.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Provider = Callable[[str, int], str]

#: Words of errors that pass, how often a call is tried, and the base of the wait in seconds.
TRANSIENT = ["429", "resource_exhausted", "quota", "rate", "timeout", "connection"]
TRIES, BACKOFF = 3, 2.0
#: Confidence of an entity that comes without one.
CONFIDENCE = 0.8


def offline(prompt: str, attempt: int = 1) -> str:
    """The default provider: lines ``class: text`` as JSON entities; it calls nobody."""
    found = re.findall(r"(?m)^[ \t]*([a-z_]+):[ \t]*(\S.*?)[ \t]*$", prompt)
    return json.dumps([{"entity_class": c, "text": t} for c, t in found])


def provider_for(operation: str | None, routing: dict[str, str]) -> str:
    """The provider an operation is routed to, else the default one."""
    return routing.get(operation or "") or routing.get("default", "offline")


def call_models(requests: DataFrame, providers: dict[str, Provider] | None = None, routing: dict[str, str] | None = None, workers: int = 4, tries: int = TRIES, backoff: float = BACKOFF) -> DataFrame:
    """``requests`` (operation, prompt and others) with provider, answer, error and attempts.

    ``routing`` names the provider of an operation and under ``default`` that
    of all others. Errors that pass are tried again after ``backoff`` to the
    power of the attempt, up to ``tries`` in all; of what fails the answer is
    null and the error says why. A null prompt is not called: no answer, no
    attempts. A route to a provider that isn't there is an error at once.
    """
    known = {"offline": offline} | (providers or {})
    routes = {"default": "offline"} | (routing or {})
    lost = sorted(set(routes.values()) - set(known))
    if lost:
        raise ValueError(f"no such provider: {', '.join(lost)}")

    def one(operation: str | None, prompt: str | None) -> tuple:
        name = provider_for(operation, routes)
        if prompt is None:
            return name, None, None, 0
        for attempt in range(1, tries + 1):
            try:
                return name, known[name](prompt, attempt), None, attempt
            except Exception as e:  # noqa: BLE001 - whatever a provider raises is the row's error
                said = str(e) or type(e).__name__
                if attempt == tries or not any(w in said.lower() for w in TRANSIENT):
                    return name, None, said, attempt
                if backoff:
                    time.sleep(backoff**attempt)
        return name, None, None, 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for b in batches:
                asked = list(zip(b["operation"], b["prompt"].astype(object).where(b["prompt"].notna(), None), strict=True))
                said: list = [None] * len(asked)
                left = iter(range(len(asked)))

                # Each worker takes the next row there is; a future a row would cost more than many a call.
                def work(asked=asked, said=said, left=left):
                    for i in left:
                        said[i] = one(*asked[i])

                for done in [pool.submit(work) for _ in range(min(workers, len(asked)))]:
                    done.result()
                yield b.assign(**dict(zip(["provider", "answer", "error", "attempts"], map(list, zip(*said, strict=True)), strict=True))) if len(b) else b.assign(provider=[], answer=[], error=[], attempts=[])

    new = T.StructType([T.StructField("provider", T.StringType()), T.StructField("answer", T.StringType()), T.StructField("error", T.StringType()), T.StructField("attempts", T.IntegerType())])
    return requests.mapInPandas(run, T.StructType([*requests.schema.fields, *new.fields]))


def read_entities(answer: Column) -> Column:
    """The entities of an answer (entity_class, text, confidence, start, end), null if it is no JSON list; a missing confidence is 0.8, others are held to 0 to 1."""
    shape = "array<struct<entity_class:string,text:string,confidence:string,start:int,end:int>>"
    sure = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.try_cast("double"), F.lit(CONFIDENCE))))
    parsed = F.from_json(F.when(answer.rlike(r"^\s*\["), answer), shape)
    return F.transform(parsed, lambda e: F.struct(e["entity_class"].alias("entity_class"), e["text"].alias("text"), sure(e["confidence"]).alias("confidence"), e["start"].alias("start"), e["end"].alias("end")))


def extract_chunks(chunks: DataFrame, prompt: Callable[[Column, Column], Column] | None = None, **options) -> DataFrame:
    """(doc_id, chunk_no, section_type, error, entities, attempts) of chunks (doc_id, chunk_no, section_type, chunk), as ``text.collect_chunks`` takes them.

    ``prompt`` makes one of the section type and the chunk (the chunk alone by
    default); the other options are those of ``call_models``.
    """
    asked = chunks.select("doc_id", "chunk_no", "section_type", F.lit("extraction").alias("operation"), (prompt or (lambda kind, chunk: chunk))(F.col("section_type"), F.col("chunk")).alias("prompt"))
    told = call_models(asked, **options).withColumn("entities", read_entities(F.col("answer")))
    error = F.coalesce("error", F.when(F.col("answer").isNotNull() & F.col("entities").isNull(), "the answer is no list of entities"), F.when(F.col("prompt").isNull(), "nothing to ask"))
    return told.select("doc_id", "chunk_no", "section_type", error.alias("error"), "entities", "attempts")


def read_summary_answer(answer: Column, output: str) -> Column:
    """struct(said, data) of an answer asked for as natural_language, json or both.

    Broken JSON is kept: as text where both were asked for, else under
    raw_response.
    """
    whole = F.try_parse_json(answer)
    none = F.lit(None).cast("string")
    if output == "natural_language":
        return F.struct(answer.alias("said"), none.alias("data"))
    if output == "json":
        return F.struct(none.alias("said"), F.coalesce(F.to_json(whole), F.to_json(F.struct(answer.alias("raw_response")))).alias("data"))
    part = F.try_variant_get(whole, "$.structured_data", "variant")
    said = F.when(whole.isNull(), answer).otherwise(F.coalesce(F.try_variant_get(whole, "$.natural_language", "string"), F.lit("")))
    return F.struct(said.alias("said"), F.to_json(F.coalesce(part, whole)).alias("data"))


def summarize(texts: DataFrame, instruction: str, output: str = "natural_language", **options) -> DataFrame:
    """``texts`` (a de-identified text each, with other columns) with said, data, error, attempts and provider of its summary."""
    asked = texts.withColumn("operation", F.lit("summary")).withColumn("prompt", F.concat(F.lit(instruction + "\n\n"), F.col("text")))
    told = call_models(asked, **options).withColumn("_read", F.when(F.col("answer").isNotNull(), read_summary_answer(F.col("answer"), output)))
    return told.select(*texts.columns, F.col("_read.said").alias("said"), F.col("_read.data").alias("data"), "error", "attempts", "provider")
