"""Providers: batches, retries, failures and usage; extraction through one."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import extraction, provider

REQUEST = "request_id string, task string, content string, context string"


def requests(spark, *rows):
    return spark.createDataFrame(rows, REQUEST).coalesce(1)


def test_a_client_is_asked_in_batches_and_once_more(spark):
    class Echo:
        """Answers what the content says to answer; some only when asked again."""

        model = "echo-1"

        def ask(self, prompts):
            assert len(prompts) <= 3
            out = []
            for task, prompt in prompts:
                if "explode" in prompt:
                    raise RuntimeError("no line")
                again = retry in prompt
                text = "hm" if "never" in prompt or ("later" in prompt and not again) else 'Sure: {"task": "%s", "wide": %s} done' % (task, json.dumps("Context:" in prompt))
                out.append((text, len(prompt), 2))
            return out

    retry = provider.RETRY
    provider.register("echo", provider.of_client(Echo, batch=3))
    rows = requests(spark, ("1", "judge", "now", ""), ("2", "judge", "later", "around"), ("3", "classify", "never", None), ("4", "extract", None, ""), ("5", "judge", "explode", ""))
    out = {r.request_id: r for r in provider.ask(rows, "echo").collect()}
    assert json.loads(out["1"].answer) == {"task": "judge", "wide": False} and out["1"].attempts == 1
    assert json.loads(out["2"].answer) == {"task": "judge", "wide": True} and out["2"].attempts == 2 and out["2"].tokens_out == 4
    assert out["3"].answer is None and "no JSON" in out["3"].error and out["3"].attempts == 2
    assert "no line" in out["4"].error and "no line" in out["5"].error  # those of one call
    events = {(r.run_id, r.stage): r for r in provider.usage_events(provider.ask(rows, "echo"), F.lit(7)).collect()}
    assert events[7, "apply_rules"].reason == "3 calls, 1 retries, 1 failures" and events[7, "apply_rules"].decision == "failed"
    assert sum(e.tokens_out for e in events.values()) == 10
    assert provider.ask(rows.limit(0), "echo").count() == 0


def test_the_offline_provider(spark):
    rows = requests(spark, ("1", "classify", "Invoice\n\nAmount due: $5.00", ""), ("2", "extract", "Payment is due within 30 calendar days of receipt.", ""), ("3", "read_page", "page", ""), ("4", "judge", "x", ""), ("5", "sing", "x", ""), ("6", "extract", None, None))
    out = {r.request_id: r for r in provider.ask(rows).collect()}
    assert json.loads(out["1"].answer) == {"doc_type": "invoice", "confidence": 0.94}
    assert [f["quote"] for f in json.loads(out["2"].answer)] == ["Payment is due within 30 calendar days of receipt."]
    assert json.loads(out["3"].answer) == {"text": "page"} and json.loads(out["4"].answer)["verdict"] == "insufficient_evidence"
    assert out["5"].error == "unknown task" and json.loads(out["6"].answer) == [] and all(r.tokens_in > 0 for r in out.values())
    with pytest.raises(ValueError, match="no provider"):
        provider.ask(rows, "nobody")


def test_extraction_through_a_provider_is_repaired(spark):
    class Narrow:
        """Quotes less than it should, unless it sees what stands around."""

        model = "narrow"

        def ask(self, prompts):
            wide = ["Context:" in p for _, p in prompts]
            value = json.dumps({"anchor": "receipt", "days": 30})
            return [(json.dumps([{"key": "payment_due_days", "value": value, "quote": "Payment is due within 30 calendar days" + (" of receipt." if w else "")}]) if "Payment" in p else "[]", 1, 1) for (_, p), w in zip(prompts, wide, strict=True)]

    provider.register("narrow", provider.of_client(Narrow))
    blocks = spark.createDataFrame([(1, 0, "policy", "Payment is due within 30 calendar days of receipt."), (2, 0, "policy", "Nothing.")], "document_id long, block_index long, doc_type string, text string")
    facts, attempts = provider.extract(blocks, "narrow")
    assert [(r.document_id, r.attempt, r.ok, r.quote[-8:]) for r in facts.collect()] == [(1, 1, True, "receipt.")]
    assert {r.document_id: r.outcome for r in extraction.outcomes(attempts).collect()} == {1: "repaired", 2: "stored"}


def test_who_asks_for_usage_alone_has_no_answers_made(spark):
    rows = requests(spark, ("1", "classify", "Invoice", ""), ("2", "extract", None, None), ("3", "judge", "x", ""), ("4", "read_page", None, ""), ("5", "sing", "x", ""), ("6", None, "x", ""))
    answers = provider.ask(rows)
    assert {r.request_id: (r.answer is None, r.error) for r in answers.collect()} == {k: (False, None) for k in "1234"} | {k: (True, "unknown task") for k in "56"}
    events = provider.usage_events(answers, F.col("request_id")).select("run_id", "decision", "tokens_in")
    assert {r.run_id: r.decision for r in events.collect()} == {k: "ok" for k in "1234"} | {k: "failed" for k in "56"}
    assert "to_json" not in events._jdf.queryExecution().optimizedPlan().toString()
