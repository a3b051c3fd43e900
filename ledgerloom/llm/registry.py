"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontam, divergence, fim, langid, linededup, mixing, packing, quality, quotes, simhash, suffixdedup, tokencount, warc
from ledgerloom.llm.common import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link(_table(spark, sf_dir, "conversations"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"), new_path(spark, "warc"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(_table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text, 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fim.restored(F.col("form"), F.col("output"))).alias("restored_sha256"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_quotation_linking, op3_line_dedup, op4_quality_rules, op5_decontamination, op6_substring_dedup, op7_simhash, op8_warc, op9_mixing, op10_packing, op11_source_divergence, op12_fill_in_middle, op13_token_counts)}

_SPACE = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_MARKS = r"^[ \t]*((?:>[ \t]?)+)"
_UNITS = r"list_distinct(list_filter(list_transform(list_concat([{0}], string_split_regex({0}, '\n[ \t]*\n'), string_split({0}, chr(10))), lambda p: trim(regexp_replace(lower(p), '[\x20\x09-\x0D]+', ' ', 'g'))), lambda p: p <> ''))"
_QUOTES = rf"""WITH RECURSIVE msg AS MATERIALIZED (SELECT row_number() OVER () AS m, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
    cut AS (SELECT m, conv_id, turn, n, list_extract(l, n) AS line, length(regexp_replace(regexp_extract(list_extract(l, n), '{_MARKS}', 1), '[^>]', '', 'g')) AS level
        FROM (SELECT *, unnest(range(1, len(l) + 1)) AS n FROM (SELECT m, conv_id, turn, string_split(text, chr(10)) AS l FROM msg))),
    ln AS (SELECT * FROM (SELECT *, level = 0 AND regexp_matches(line, '{quotes.ATTRIBUTION}') AND coalesce(lead(level) OVER (PARTITION BY m ORDER BY n), 0) > 0 AS introduces FROM cut) WHERE NOT introduces),
    run AS (SELECT *, sum(change) OVER (PARTITION BY m ORDER BY n) AS run FROM (SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY m ORDER BY n) THEN 0 ELSE 1 END AS change FROM ln)),
    span AS (SELECT m, conv_id, turn, run, level, string_agg(CASE WHEN level > 0 THEN regexp_replace(line, '{_MARKS}', '') ELSE line END, chr(10) ORDER BY n) AS text FROM run GROUP BY ALL),
    body AS (SELECT m, conv_id, turn, string_agg(text, chr(10) ORDER BY run) AS body FROM span WHERE level = 0 GROUP BY ALL),
    said AS (SELECT DISTINCT conv_id, turn, unnest({_UNITS.format("body")}) AS h FROM body),
    quo AS (SELECT m, conv_id, turn, run, level, unnest({_UNITS.format("text")}) AS h FROM span WHERE level > 0),
    hit AS (SELECT q.m, q.run, q.level, q.h, max(s.turn) AS found FROM quo q JOIN said s ON s.conv_id = q.conv_id AND s.h = q.h AND s.turn < q.turn GROUP BY ALL),
    vote AS (SELECT m, level, found, count(*) AS n FROM hit GROUP BY ALL),
    reply AS (SELECT m, arg_min(found, ROW(level, -n, -found)) AS reply_to FROM vote GROUP BY m),
    linked AS (SELECT m, count(DISTINCT run) AS n_linked FROM hit GROUP BY m),
    up AS (SELECT conv_id, turn, min(reply_to) AS parent FROM msg JOIN reply USING (m) GROUP BY ALL),
    tree AS (SELECT DISTINCT conv_id, turn, turn AS root, [turn] AS path FROM msg ANTI JOIN up USING (conv_id, turn) WHERE conv_id IS NOT NULL AND turn IS NOT NULL
        UNION ALL SELECT u.conv_id, u.turn, t.root, list_append(t.path, u.turn) FROM tree t JOIN up u ON u.conv_id = t.conv_id AND u.parent = t.turn),
    counted AS (SELECT m, count(*) FILTER (WHERE level > 0) AS n_quotes, max(level) AS max_level FROM span GROUP BY m)
    SELECT conv_id, turn, role, reply_to, thread, row_number() OVER (PARTITION BY conv_id ORDER BY thread NULLS FIRST, path NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, md5(text)) AS position, n_quotes, n_linked, max_level, body AS text FROM
        (SELECT msg.conv_id, msg.turn, role, msg.text, reply_to, coalesce(root, msg.turn) AS thread, path, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, CAST(coalesce(max_level, 0) AS BIGINT) AS max_level, coalesce(body, '') AS body
         FROM msg LEFT JOIN counted USING (m) LEFT JOIN (SELECT m, body FROM body) USING (m) LEFT JOIN reply USING (m) LEFT JOIN linked USING (m) LEFT JOIN tree ON tree.conv_id = msg.conv_id AND tree.turn = msg.turn)"""

ORACLES: dict[str, str] = {
    "op2_quotation_linking": _QUOTES,
    "op3_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, n, list_extract(l, n) AS line,
                   translate(trim(list_extract(l, n), {_SPACE}), '{_UPPER}', '{_LOWER}') AS k
            FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
        frequent AS (SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
        judged AS (SELECT l.*, f.k IS NOT NULL AND l.doc_id <> f.keeper AS gone FROM lines l LEFT JOIN frequent f ON l.k = f.k)
        SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
    "op5_decontamination": """
        WITH d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
        b AS (SELECT item_id AS id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
        sizes AS (SELECT DISTINCT least(5, len(w)) AS s FROM b WHERE len(w) > 0),
        ds AS (SELECT DISTINCT id, x FROM (SELECT id, unnest(list_transform(range(1, len(w) - s + 2), lambda i: array_to_string(w[i:i+s-1], ' '))) AS x FROM d, sizes WHERE len(w) >= s)),
        bs AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i+least(5, len(w))-1], ' '))) AS x FROM b WHERE len(w) > 0),
        n AS (SELECT id, count(*) AS n FROM bs GROUP BY id),
        f AS (SELECT ds.id AS doc_id, bs.id AS item_id, count(*) AS c FROM ds JOIN bs USING (x) GROUP BY ALL)
        SELECT doc_id, item_id, n.n AS n_shingles, c AS n_found, round(c / n.n, 6) AS containment
        FROM f JOIN n ON n.id = f.item_id WHERE c >= ceil(0.8 * n.n - 1e-9)""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        q AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to
        FROM q""",
    "op11_source_divergence": rf"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        kept AS MATERIALIZED (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30),
        n AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
        g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        total AS MATERIALIZED (SELECT g.lang, g.source, coalesce(sum(n.n), 0)::HUGEINT + 5 * any_value(coalesce(v.v, 0)) AS total FROM g LEFT JOIN n USING (lang, source) LEFT JOIN v ON v.lang = g.lang GROUP BY ALL),
        whole AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM n GROUP BY ALL),
        whole_total AS (SELECT lang, sum(n) + 5 * count(*) AS total FROM whole GROUP BY ALL),
        q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 5) // total AS q FROM whole JOIN whole_total USING (lang)),
        p AS MATERIALIZED (SELECT t.lang, t.source, k.term, coalesce(n.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n.n, 0) + 5) // t.total AS p FROM total t JOIN kept k USING (lang) LEFT JOIN n ON n.lang = t.lang AND n.source = t.source AND n.term = k.term),
        apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source),
        term AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.q AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50""",
    "op12_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
        h AS (SELECT *, CAST(len(u) AS BIGINT) AS n, list_transform([0, 1, 2, 3], lambda k: CAST(('0x' || substring(x, 8 * k + 1, 8)) AS BIGINT)) AS h FROM d),
        f AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS lo, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS hi,
              CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
        c AS (SELECT *, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS s FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(text) AS restored_sha256 FROM c""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
