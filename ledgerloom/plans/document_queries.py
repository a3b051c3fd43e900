"""Queries from pages to facts: reading order of boxes, sentences around quotes, repair of extractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import grounding, scoping
from ledgerloom.operators import extraction, layout, provider, review
from ledgerloom.plans import frames
from ledgerloom.plans.registry import query
from ledgerloom.plans.text_queries import FACTS, FLAGGED, re2

# A page for each order: its lines are words, blocks or table cells in two columns, some of them images.
_KINDS = ("word", "word", "block", "cell", "image")
_BOXES = f"""SELECT l_orderkey AS page, CASE l_partkey % 5 {" ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS))} END AS kind, l_suppkey % 2 * 300.0 + l_linenumber * 30 AS x0, l_suppkey % 2 * 300.0 + l_linenumber * 30 + l_quantity AS x1,
    l_partkey % 12 * 11 + l_linenumber * 0.25 AS y0, l_partkey % 12 * 11 + l_linenumber * 0.25 + 10 AS y1, 'part ' || CAST(l_partkey AS VARCHAR) AS text, CAST(l_suppkey % 2 AS INTEGER) AS table_no FROM lineitem"""


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    li = frames.table(spark, d, "lineitem")
    left = (F.col("l_suppkey") % 2 * 300.0 + F.col("l_linenumber") * 30).cast("double")
    top = (F.col("l_partkey") % 12 * 11 + F.col("l_linenumber") * 0.25).cast("double")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("l_partkey") % 5 + 1).cast("int"))
    return li.select(F.lit("orders").alias("path"), F.col("l_orderkey").alias("page"), kind.alias("kind"), left.alias("x0"), top.alias("y0"), (left + F.col("l_quantity")).alias("x1"), (top + 10).alias("y1"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("text"), (F.col("l_suppkey") % 2).cast("int").alias("table_no"), F.lit(480_000.0).alias("page_area"))


def _islands(source: str, keys: str, low: str, high: str, gap: str, order: str, name: str) -> str:
    """Gaps and islands by hand: a new one begins beyond the reach of all before."""
    w = f"PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND"
    return f"SELECT *, sum(b) OVER ({w} CURRENT ROW) AS {name} FROM (SELECT *, CASE WHEN {low} > max({high}) OVER ({w} 1 PRECEDING) + {gap} THEN 1 ELSE 0 END AS b FROM ({source}))"


_ORDER = f"""WITH boxes AS ({_BOXES}),
    prose AS (SELECT * EXCLUDE (b, c), CASE WHEN count(*) OVER (PARTITION BY page) < 4 THEN 0 ELSE c END AS col FROM ({_islands("SELECT * FROM boxes WHERE kind IN ('block', 'word')", "page", "x0", "x1", "20", "x0, x1", "c")})),
    worded AS ({_islands("SELECT * FROM prose WHERE kind = 'word'", "page, col", "y0", "y1", "-2", "y0, y1, x0, text", "line")}),
    lines AS (SELECT page, col, line, min(y0) AS y0, max(y1) AS y1, min(x0) AS x0, string_agg(text, ' ' ORDER BY x0, text) AS text FROM worded GROUP BY ALL),
    parts AS ({_islands("SELECT * FROM lines", "page, col", "y0", "y1", "6", "y0, y1, line", "part")}),
    paragraphs AS (SELECT page, col, part, min(y0) AS y0, min(x0) AS x0, string_agg(text, chr(10) ORDER BY line) AS text FROM parts GROUP BY ALL),
    celled AS ({_islands("SELECT * FROM boxes WHERE kind = 'cell'", "page, table_no", "y0", "y1", "-2", "y0, y1, x0, text", "r")}),
    table_lines AS (SELECT page, table_no, r, string_agg(text, ' | ' ORDER BY x0, text) AS text FROM celled GROUP BY ALL),
    tables AS (SELECT page, table_no, string_agg(text, chr(10) ORDER BY r) AS text FROM table_lines GROUP BY ALL),
    every AS (SELECT page, 'block' AS kind, col, y0, x0, text, NULL AS table_no FROM prose WHERE kind = 'block' UNION ALL SELECT page, 'paragraph', col, y0, x0, text, NULL FROM paragraphs UNION ALL SELECT page, 'table', NULL, NULL, NULL, text, table_no FROM tables),
    ordered AS (SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY table_no NULLS FIRST, col NULLS FIRST, round_even(y0, 1) NULLS FIRST, x0 NULLS FIRST, text) - 1 AS INTEGER) AS block_index, kind, CAST(col AS INTEGER) AS text_column, text FROM every)"""


@query(f"{_ORDER} SELECT * FROM ordered")
def io7_reading_order(spark: SparkSession, d: str) -> DataFrame:
    """Every page's blocks as they are read: columns, lines, paragraphs and table rows."""
    return layout.reading_order(_boxes(spark, d)).drop("path")


@query(f"""{_ORDER}, texts AS (SELECT page, string_agg(text, chr(10) || chr(10) ORDER BY block_index) AS text, bool_or(kind = 'table') AS has_table FROM ordered GROUP BY page)
    SELECT b.page, coalesce(any_value(t.text), '') AS text, coalesce(any_value(t.has_table), false) AS has_table, round(least(sum(CASE WHEN kind = 'image' THEN (x1 - x0) * 10 ELSE 0 END) / 480000.0, 1), 9) AS image_share FROM boxes b LEFT JOIN texts t ON t.page = b.page GROUP BY b.page""")
def io2_page_texts(spark: SparkSession, d: str) -> DataFrame:
    """What the page gate reads: each page's text in order, whether it has a table, and how much of it is image."""
    return layout.pages_of(_boxes(spark, d)).select("page", "text", "has_table", F.round("image_share", 9).alias("image_share"))


_CONDITIONS = f"array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(sentence, '{re2(scoping.CONDITION)}', 1), lambda x: lower(trim(x))))), '|')"
_WRAPPED = "'Preamble stands here. Section 4.' || CAST(document_id % 9 AS VARCHAR) || ' Payment is due' || chr(10) || '   within ' || CAST(document_id % 80 AS VARCHAR) || ' days unless ' || chr(10) || chr(10) || 'Disputed in good faith. Later text says if anything else.'"
_QUOTED = "CASE document_id % 3 WHEN 0 THEN 'Payment is due' || chr(10) || '   within ' || CAST(document_id % 80 AS VARCHAR) WHEN 1 THEN 'due within ' || CAST(document_id % 80 AS VARCHAR) || ' days' ELSE 'Later text never' END"


# Sentences of the unwrapped text by hand; the one that holds the unwrapped quote.
@query(f"""SELECT document_id, sentence, nullif(regexp_extract(sentence, '{re2(scoping.CLAUSE)}', 1), '') AS clause, {_CONDITIONS} AS conditions FROM
    (SELECT document_id, coalesce(list_filter(string_split(regexp_replace(line, '([.!?]) +([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: contains(s, regexp_replace(quote, '\\s*\\n\\s*', ' ', 'g')))[1], text) AS sentence
     FROM (SELECT *, regexp_replace(text, '\\s*\\n\\s*', ' ', 'g') AS line, {_QUOTED} AS quote FROM (SELECT document_id, {_WRAPPED} AS text FROM docs)))""", "docs")
def t19_sentence_around(spark: SparkSession, d: str) -> DataFrame:
    """The sentence around quotes that break over lines as the text does, as it does not, or are not in it."""
    k = lambda n: (F.col("document_id") % n).cast("string")
    text = F.concat(F.lit("Preamble stands here. Section 4."), k(9), F.lit(" Payment is due\n   within "), k(80), F.lit(" days unless \n\nDisputed in good faith. Later text says if anything else."))
    quote = F.when(F.col("document_id") % 3 == 0, F.concat(F.lit("Payment is due\n   within "), k(80))).when(F.col("document_id") % 3 == 1, F.concat(F.lit("due within "), k(80), F.lit(" days"))).otherwise("Later text never")
    rows = frames.documents(spark, d).select("document_id", scoping.sentence_around(text, quote).alias("sentence"))
    return rows.select("document_id", "sentence", scoping.clause(F.col("sentence")).alias("clause"), F.array_join(scoping.conditions(F.col("sentence")), "|").alias("conditions"))


# A block of these documents is one sentence, so each candidate's sentence is its block.
@query(f"""SELECT document_id, block_index, key, nullif(regexp_extract(sentence, '{re2(scoping.CLAUSE)}', 1), '') AS clause, {_CONDITIONS} AS conditions, CASE WHEN doc_type IN ('invoice', 'purchase_order') THEN 'operational' ELSE 'contractual' END AS obligation_scope
    FROM (SELECT f.document_id, f.block_index, f.key, f.text AS sentence, b.doc_type FROM ({FACTS}) f JOIN blocks b USING (document_id, block_index) WHERE m <> '' AND NOT {FLAGGED.replace("text", "f.text")})""", "blocks")
def g6_candidate_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate of the blocks that may be extracted from, scoped by its own sentence."""
    blocks = review.quarantined(frames.blocks(spark, d)).where("not flagged").select("document_id", "block_index", "doc_type", "text")
    rows = extraction.scoped(extraction.facts_of(blocks), frames.documents(spark, d))
    return rows.select("document_id", "block_index", "key", "scope.clause", F.array_join("scope.conditions", "|").alias("conditions"), "scope.obligation_scope")


_CUES = f"(regexp_matches(rest, '{re2(grounding.QUALIFIERS)}') OR regexp_matches(rest, '{re2(grounding.ANCHORS)}'))"
# Both passes by hand: the narrow quote is the match, the wide one the rest of the sentence where that has a cue.
_PASSES = f"""WITH c AS (SELECT *, substr(text, instr(text, m) + length(m)) AS rest FROM (SELECT f.*, b.doc_type FROM ({FACTS}) f JOIN blocks b USING (document_id, block_index) WHERE m <> '' AND NOT {FLAGGED.replace("text", "f.text")})),
    w AS (SELECT *, CASE WHEN {_CUES} THEN substr(text, instr(text, m)) ELSE m END AS wide FROM c),
    j AS (SELECT *, kind = 'receipt' AND NOT regexp_matches(m, '(?i)\\breceipt\\b') OR kind = 'money' AND NOT regexp_matches(m, 'USD|\\$') OR {_CUES} AND doc_type NOT IN ('invoice', 'purchase_order') AS bad_first,
        kind = 'receipt' AND NOT regexp_matches(wide, '(?i)\\breceipt\\b') OR kind = 'money' AND NOT regexp_matches(wide, 'USD|\\$') AS bad_wide FROM w),
    n AS (SELECT document_id, count(*) AS n_first, count(*) FILTER (WHERE bad_first) AS n_invalid_first, count(*) FILTER (WHERE bad_wide) AS n_wide FROM j GROUP BY document_id),
    d AS (SELECT DISTINCT document_id FROM blocks WHERE NOT {FLAGGED})"""


@query(f"""SELECT * FROM ({_PASSES} SELECT document_id, CASE WHEN n_invalid_first > 0 THEN 2 ELSE 1 END AS attempts, coalesce(n_first, 0) AS n_first, coalesce(n_invalid_first, 0) AS n_invalid_first, CASE WHEN n_invalid_first > 0 THEN n_wide ELSE 0 END AS n_invalid,
    CASE WHEN coalesce(n_invalid_first, 0) = 0 THEN 'stored' WHEN n_wide > 0 THEN 'abstained' ELSE 'repaired' END AS outcome FROM d LEFT JOIN n USING (document_id))""", "blocks")
def g7_repair_loop(spark: SparkSession, d: str) -> DataFrame:
    """Extraction of every document, again with wider context where a candidate does not hold."""
    return extraction.outcomes(extraction.extract(_open_blocks(spark, d))[1])


@query(f"""SELECT * FROM ({_PASSES} SELECT j.document_id, block_index, key, CASE WHEN n_invalid_first > 0 THEN wide ELSE m END AS quote, CASE WHEN n_invalid_first > 0 THEN 1 ELSE 0 END AS attempt, NOT CASE WHEN n_invalid_first > 0 THEN bad_wide ELSE bad_first END AS ok FROM j JOIN n USING (document_id))""", "blocks")
def g7_repaired_facts(spark: SparkSession, d: str) -> DataFrame:
    """The facts of each document's last attempt: those repaired have other quotes than at first."""
    return extraction.extract(_open_blocks(spark, d))[0].select("document_id", "block_index", "key", "quote", "attempt", "ok")


def _open_blocks(spark: SparkSession, d: str) -> DataFrame:
    return review.quarantined(frames.blocks(spark, d)).where("not flagged").select("document_id", "block_index", "doc_type", "text")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    docs = frames.documents(spark, d)
    asked = docs.select(F.concat(F.lit("d"), F.col("document_id").cast("string")).alias("request_id"), F.lit("classify").alias("task"), F.col("text").alias("content"), F.lit("").alias("context"))
    blocks = _open_blocks(spark, d).select(F.concat(F.lit("b"), F.col("document_id").cast("string"), F.lit(":"), F.col("block_index").cast("string")).alias("request_id"), F.lit("extract").alias("task"), F.col("text").alias("content"), F.lit("").alias("context"))
    return asked.unionByName(blocks)


_ASKED = f"SELECT document_id, 'classify' AS task, text FROM docs UNION ALL SELECT document_id, 'extract', text FROM blocks WHERE NOT {FLAGGED}"


@query(f"""SELECT document_id AS run_id, task AS stage, 'ok' AS decision, CAST(count(*) AS VARCHAR) || ' calls, 0 retries, 0 failures' AS reason, 'offline' AS model, CAST(sum(greatest(1, length('Task: ' || task || chr(10) || chr(10) || 'Text:' || chr(10) || text) // 4)) AS BIGINT) AS tokens_in FROM ({_ASKED}) GROUP BY ALL""", "docs", "blocks")
def u1_provider_usage(spark: SparkSession, d: str) -> DataFrame:
    """What classifying every document and extracting every block used, as events."""
    run = F.regexp_extract("request_id", "^[bd]([0-9]+)", 1).cast("long")
    return provider.usage_events(provider.ask(_requests(spark, d)), run).select("run_id", "stage", "decision", "reason", "model", "tokens_in")


_KIND = "CASE WHEN t LIKE '%amendment no%' OR t LIKE '%amendment to%' THEN ['amendment', '0.95'] WHEN t LIKE '%master services agreement%' THEN ['master_agreement', '0.96'] WHEN t LIKE '%invoice%' THEN ['invoice', '0.94'] WHEN t LIKE '%statement of work%' THEN ['sow', '0.93'] WHEN t LIKE '%purchase order%' THEN ['purchase_order', '0.93'] ELSE ['policy', '0.91'] END"


@query(f"""SELECT 'd' || CAST(document_id AS VARCHAR) AS request_id, '{{"doc_type":"' || k[1] || '","confidence":' || k[2] || '}}' AS answer FROM (SELECT document_id, {_KIND} AS k FROM (SELECT document_id, lower(string_split(text, chr(10))[1]) AS t FROM docs))""", "docs")
def u1_provider_classes(spark: SparkSession, d: str) -> DataFrame:
    """The offline provider's answers to what each document is."""
    return provider.ask(_requests(spark, d).where("task = 'classify'")).select("request_id", "answer")


@query(f"""SELECT document_id, block_index, key, CASE kind WHEN 'money' THEN '{{"amount":"$' || ltrim(n, '$') || '","currency":"USD"}}' WHEN 'receipt' THEN '{{"anchor":"receipt","days":' || n || '}}' ELSE '{{"days":' || n || '}}' END AS value, quote, NOT (kind = 'receipt' AND NOT regexp_matches(quote, '(?i)\\breceipt\\b') OR kind = 'money' AND NOT regexp_matches(quote, 'USD|\\$')) AS ok FROM
    (SELECT *, CASE WHEN {_CUES} THEN substr(text, instr(text, m)) ELSE m END AS quote FROM (SELECT *, substr(text, instr(text, m) + length(m)) AS rest FROM ({FACTS}) WHERE m <> '' AND NOT {FLAGGED}))""", "blocks")
def u1_provider_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts by a provider's answers, checked like any others; this one reads sentences to their end at once."""
    return provider.extract(_open_blocks(spark, d))[0].select("document_id", "block_index", "key", "value", "quote", "ok")
