"""Models as providers: requests in, answers and what they used out, in batches; one that needs no model.

A request is a row (request_id, task, content, context): the text to classify, extract from, judge or read, and what stands
around it. An answer is the JSON that the task asks for. What an answer may say is checked by those who use it
(review.answers, extraction.checked), not here.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import grounding
from ledgerloom.functions import text as T
from ledgerloom.operators import extraction

TASKS = ("classify", "extract", "judge", "read_page")
ANSWER = "request_id string, task string, answer string, error string, model string, tokens_in long, tokens_out long, attempts int, duration_ms long"
#: What a model is told when its answer was no JSON of the task, once.
RETRY = "Your last answer could not be read. Answer again with one JSON value of the form that was asked for, and nothing else."
#: Requests of one call at most.
BATCH = 64


class Client(Protocol):
    """A connection to a model: answers a batch of (task, prompt) with (text, tokens in, tokens out) each, in order."""

    model: str

    def ask(self, prompts: list[tuple[str, str]]) -> list[tuple[str, int, int]]: ...


Provider = Callable[[DataFrame], DataFrame]
_providers: dict[str, Provider] = {}


def register(name: str, provider: Provider) -> None:
    """Makes a provider known by name; one registered again takes the place of the first."""
    _providers[name] = provider


def named(name: str) -> Provider:
    if name not in _providers:
        raise ValueError(f"no provider is registered as {name}")
    return _providers[name]


def prompt_of(task: Column, content: Column, context: Column) -> Column:
    """What a model is sent: the task, the text, and what stands around it if that is given."""
    around = F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("\n\nContext:\n"), context)).otherwise("")
    return F.concat(F.lit("Task: "), task, F.lit("\n\nText:\n"), F.coalesce(content, F.lit("")), around)


def of_client(connect: Callable[[], Client], batch: int = BATCH) -> Provider:
    """A provider that asks a client in batches, from the tasks of Spark: each task connects once. An answer without JSON is
    asked for once more with RETRY; if that has none either, or the call fails, the row has an error. All calls' usage counts."""

    def ask(client: Client, rows: list[tuple]) -> list[tuple]:
        began = time.perf_counter()
        state = [[None, None, 0, 0, 0] for _ in rows]  # answer, error, tokens in and out, attempts
        pending = list(range(len(rows)))
        for suffix in ("", f"\n\n{RETRY}"):
            if not pending:
                break
            try:
                replies = client.ask([(rows[i][1], rows[i][2] + suffix) for i in pending])
            except Exception as e:  # a call's failure is that of its rows
                for i in pending:
                    state[i][1], state[i][4] = f"the call failed: {e}"[:300], state[i][4] + 1
                break
            for i, (text, n_in, n_out) in zip(pending, replies, strict=True):
                found = json_value(text)
                state[i] = [found, None if found else "the answer holds no JSON", state[i][2] + n_in, state[i][3] + n_out, state[i][4] + 1]
            pending = [i for i in pending if state[i][0] is None]
        took = int((time.perf_counter() - began) * 1000 / max(1, len(rows)))
        return [(r[0], r[1], s[0], s[1], client.model, s[2], s[3], s[4], took) for r, s in zip(rows, state, strict=True)]

    def provider(requests: DataFrame) -> DataFrame:
        rows = requests.select("request_id", "task", prompt_of(F.col("task"), F.col("content"), F.col("context")).alias("prompt"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client = None
            for frame in batches:
                client = client or connect()
                sent = list(frame.itertuples(index=False, name=None))
                for at in range(0, len(sent), batch):
                    yield pd.DataFrame(ask(client, sent[at : at + batch]), columns=[c.split()[0] for c in ANSWER.split(", ")])

        return rows.mapInPandas(run, ANSWER)

    return provider


def json_value(text: str) -> str | None:
    """The outermost JSON object or array in a model's words, or null."""
    import json

    for first, last in (("{", "}"), ("[", "]")):
        start, end = text.find(first), text.rfind(last)
        if 0 <= start < end:
            try:
                json.loads(text[start : end + 1])
                return text[start : end + 1]
            except ValueError:
                continue
    return None


def offline(requests: DataFrame) -> DataFrame:
    """A provider without a model, in columns alone: title lines classify, the fixed patterns extract (with context, to the end
    of the sentence), nothing is judged without a model, a page reads as its text. Usage is estimated from lengths."""
    text = F.coalesce("content", F.lit(""))
    kind = T.classify(text)
    facts = F.array_sort(F.transform(grounding.extracted(text), lambda f: F.struct(f["quote_start"].alias("at"), f["key"].alias("key"), f["value"].alias("value"), f["quote"].alias("quote"))))
    answer = (
        F.when(F.col("task") == "classify", F.to_json(F.struct(kind["doc_type"].alias("doc_type"), kind["confidence"].alias("confidence"))))
        .when(F.col("task") == "extract", F.to_json(F.transform(facts, lambda f: F.struct(f["key"].alias("key"), f["value"].alias("value"), f["quote"].alias("quote")))))
        .when(F.col("task") == "judge", F.to_json(F.struct(F.lit("insufficient_evidence").alias("verdict"), F.lit(0.0).alias("confidence"))))
        .when(F.col("task") == "read_page", F.to_json(F.struct(text.alias("text"))))
    )
    rows = requests.select("request_id", "task", answer.alias("answer"), T.tokens_estimate(prompt_of(F.col("task"), F.col("content"), F.col("context"))).alias("tokens_in"))
    # every known task has an answer; told by the task, so that who asks for usage alone has no answers made
    error = F.when(~F.coalesce(F.col("task").isin(*TASKS), F.lit(False)), F.lit("unknown task"))
    out = F.when(F.col("answer").isNotNull(), T.tokens_estimate(F.col("answer"))).otherwise(0)
    return rows.select("request_id", "task", "answer", error.alias("error"), F.lit("offline").alias("model"), "tokens_in", out.cast("long").alias("tokens_out"), F.lit(1).alias("attempts"), F.lit(0).cast("long").alias("duration_ms"))


register("offline", offline)


def ask(requests: DataFrame, provider: str = "offline") -> DataFrame:
    """Answers (ANSWER) of the provider of that name to all requests."""
    return named(provider)(requests).select(*[c.split()[0] for c in ANSWER.split(", ")])


def usage_events(answers: DataFrame, run_of: Column) -> DataFrame:
    """What answers used, as events of runs: an event for each run and task with its calls, retries and failures in the reason."""
    stage = F.when(F.col("task") == "read_page", "ingest").when(F.col("task") == "judge", "apply_rules").otherwise(F.col("task"))
    rows = answers.groupBy(run_of.alias("run_id"), stage.alias("stage"), "model").agg(F.count("*").alias("calls"), F.sum(F.col("attempts") - 1).alias("retries"), F.count("error").alias("failures"), *[F.sum(c).alias(c) for c in ("tokens_in", "tokens_out", "duration_ms")])
    reason = F.concat_ws(", ", F.concat("calls", F.lit(" calls")), F.concat("retries", F.lit(" retries")), F.concat("failures", F.lit(" failures")))
    return rows.select("run_id", "stage", F.when(F.col("failures") > 0, "failed").otherwise("ok").alias("decision"), reason.alias("reason"), "model", "tokens_in", "tokens_out", "duration_ms")


def extractor(provider: str = "offline") -> Callable[[DataFrame], DataFrame]:
    """An extractor for extraction.extract() that asks a provider: a block with its context is a request, and each fact of the
    answer a candidate, placed where the block has its quote (nowhere, if it has not)."""

    def take(blocks: DataFrame) -> DataFrame:
        key = F.concat_ws(":", "document_id", "block_index")
        answers = ask(blocks.select(key.alias("request_id"), F.lit("extract").alias("task"), F.col("text").alias("content"), "context"), provider)
        facts = F.from_json("answer", "array<struct<key:string,value:string,quote:string>>")
        said = answers.select("request_id", F.explode(facts).alias("_f")).where("_f.key is not null and _f.value is not null")
        rows = blocks.withColumn("request_id", key).join(said, "request_id")
        start = F.call_function("locate", F.col("_f.quote"), F.col("text")) - 1
        return rows.select(*blocks.columns, "_f.key", "_f.value", "_f.quote", start.alias("quote_start"), (start + F.length("_f.quote")).alias("quote_end"))

    return take


def extract(blocks: DataFrame, provider: str = "offline", most: int = extraction.MOST_REPAIRS) -> tuple[DataFrame, DataFrame]:
    """extraction.extract() through a provider."""
    return extraction.extract(blocks, extractor(provider), most)
