"""Identity as column functions: digests, canonical JSON, name-based ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The OID name space of name-based ids, as hexadecimal (a fixed value).
OID = "6ba7b8129dad11d180b400c04fd430c8"
#: The version of the source rule evaluator that cache keys carry (a fixed value).
EVALUATOR = "1"


def sha256_text(text: Column) -> Column:
    return F.sha2(text, 256)


def canonical_json(value: Column) -> Column:
    """Compact JSON with nulls kept; fields of structs must be declared in order of name."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def canonical_map(entries: Column) -> Column:
    """Canonical JSON of a map: entries in order of key."""
    return canonical_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def stage_input_hash(*parts: Column) -> Column:
    """Digest of the parts as a JSON array of strings."""
    return sha256_text(F.to_json(F.array(*[p.cast("string") for p in parts])))


def name_uuid(name: Column, space: str = OID) -> Column:
    """A version 5 id of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def target_uuid(kind: Column, key: Column) -> Column:
    return name_uuid(F.concat(kind, F.lit(":"), key))


def register_content_hash(value: Column, fingerprints: Column, state: Column) -> Column:
    """Digest of a register row's value, evidence and state; refuses what is not a digest."""
    checked = F.when(F.forall(fingerprints, lambda f: f.rlike("^[0-9a-f]{64}$")), fingerprints).otherwise(F.raise_error(F.lit("evidence must be given by digest")))
    return sha256_text(canonical_json(F.struct(F.array_sort(checked).alias("citation_ids"), state.alias("state"), value.alias("value"))))


def evidence_fingerprint(block: Column, end: Column, start: Column, sha: Column, extractor: Column, key: Column, page: Column, parser: Column, quote: Column, value: Column) -> Column:
    """Digest of where a fact was read and what it says."""
    return sha256_text(canonical_json(F.struct(block.alias("block_index"), end.alias("char_end"), start.alias("char_start"), sha.alias("document_sha256"), extractor.alias("extractor_version"), key.alias("key"), page.alias("page"), parser.alias("parser_version"), sha256_text(quote).alias("quote_sha256"), value.alias("value"))))


def source_rule_cache_key(collection: Column, document_sha: Column, ruleset_hash: Column, evaluator: str = EVALUATOR) -> Column:
    """Digest of what a source verdict depends on; no playbook counts as an empty part."""
    return sha256_text(F.concat(collection.cast("string"), F.lit("|"), document_sha, F.lit("|"), F.coalesce(ruleset_hash, F.lit("")), F.lit("|" + evaluator)))


def watch_key(content: Column) -> Column:
    return F.concat(F.lit("watch:sha256:"), F.sha2(content, 256))


def oversize_key(path: Column, size: Column) -> Column:
    return F.sha2(F.concat(path, F.lit(":"), size.cast("string")), 256)
