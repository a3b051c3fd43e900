"""Text operators as column functions: paragraphs, blocks, quality, references, terms, recovery."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of the page quality gate.
LEAST_ALNUM, LEAST_LETTERS, IMAGE_SHARE, IMAGE_TEXT = 30, 0.35, 0.5, 400

# The kinds of source by declared type and by file extension.
KIND_BY_MIME = {
    "application/pdf": "pdf",
    "application/x-pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "text/plain": "txt",
    "text/markdown": "txt",
}
KIND_BY_EXTENSION = {"pdf": "pdf", "docx": "docx", "txt": "txt", "md": "txt", "text": "txt"}

# Fixed value: words that say nothing about which clause a rule is aimed at.
STOP_WORDS = (
    "the and for any all must not may shall with within than from that this which are was were has have had its "
    "their there then when where while each other more less least most such upon into out per been being also only "
    "very much many some can could would should will does did done required requires require exceed exceeds"
).split()

# What a title line calls a document, with the confidence in that; the first kind that matches wins.
TITLE_MARKERS = [
    ("amendment", ("amendment no", "amendment to", "amendment number"), 0.95),
    ("master_agreement", ("master services agreement", "master agreement"), 0.96),
    ("invoice", ("invoice",), 0.94),
    ("sow", ("statement of work",), 0.93),
    ("purchase_order", ("purchase order",), 0.93),
    ("policy", ("data processing addendum", "addendum", "policy"), 0.91),
]
TITLE_LINES, UNKNOWN_CONFIDENCE = 12, 0.45

#: How an agreement is named: a label, then the identifier (a fixed value).
AGREEMENT_REF = r"(?iU)\b(?:master\s+services\s+agreement|agreement|contract|msa|sow)\s*(?:no\b\.?|nos\b\.?|number\b|#|ref\b\.?|reference\b)\s*[:.]?\s*([A-Za-z0-9][A-Za-z0-9./_-]{2,})"
#: Where a sentence ends: after a stop that is no abbreviation's, before a new one; or a line break (fixed values).
SENTENCE_BREAK = r"(?U)(?<=[.!?])\s+(?=[\"“(A-Z0-9])"
RELATION_SENTENCE_BREAK = r"(?U)(?<=[.!?])(?<!(?i:\bno\.))(?<!(?i:\bnos\.))(?<!(?i:\binc\.))(?<!(?i:\bltd\.))(?<!(?i:\bco\.))(?<!(?i:\bsec\.))\s+(?=[\"“(A-Z])|\n+"


def strip(text: Column) -> Column:
    """White space of any kind goes at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, their own blank lines collapsed, stripped; blank ones go."""
    parts = F.filter(F.split(text, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != "")
    return F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"\n\s*\n+", "\n"), r"^\s+|\s+$", ""))


def blocks_with_offsets(text: Column, separator: str = "\n\n") -> Column:
    """array<struct<text, char_start, char_end>> of the parts between separators, each found from where the last ended."""
    parts = F.filter(F.split(text, separator), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != "")
    none = F.array().cast("array<struct<text:string,char_start:int,char_end:int>>")

    def place(found, part):
        cursor = F.when(F.size(found) > 0, F.element_at(found, -1)["char_end"]).otherwise(F.lit(0))
        start = F.call_function("locate", part, text, cursor + 1) - 1
        return F.concat(found, F.array(F.struct(part.alias("text"), start.alias("char_start"), (start + F.length(part)).alias("char_end"))))

    return F.aggregate(parts, none, place)


def kind_of(filename: Column, mime: Column) -> Column:
    """pdf, docx or txt by declared type, else by extension; null if neither is known."""
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    declared = F.lower(F.trim(F.element_at(F.split(F.coalesce(mime, F.lit("")), ";"), 1)))
    suffix = F.when(F.contains(filename, F.lit(".")), F.lower(F.substring_index(filename, ".", -1)))
    return F.coalesce(F.try_element_at(table(KIND_BY_MIME), declared), F.try_element_at(table(KIND_BY_EXTENSION), suffix))


def quality_reason(text: Column, image_share: Column | float = 0.0, has_table: Column | bool = False) -> Column:
    """Why a page's text can't be trusted, or null."""
    share, table = (x if isinstance(x, Column) else F.lit(x) for x in (image_share, has_table))
    alnum = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    dense = F.length(F.regexp_replace(text, r"(?U)\s", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    garbled = (dense == 0) | F.contains(text, F.lit("\ufffd")) | (letters / F.greatest(dense, F.lit(1)) < LEAST_LETTERS)
    return F.when(alnum < LEAST_ALNUM, "native extraction produced no readable text").when(~table & garbled, "native extraction produced garbled text").when((share >= IMAGE_SHARE) & (alnum < IMAGE_TEXT), "page is mostly image with little extractable text")


def agreement_ref(text: Column) -> Column:
    """The agreement that a text names, in capitals, or null."""
    found = F.regexp_extract(text, AGREEMENT_REF, 1)
    return F.when(found != "", F.regexp_replace(F.upper(found), r"[.,;:]+$", ""))


def sentences(text: Column, pattern: str = RELATION_SENTENCE_BREAK) -> Column:
    return F.filter(F.transform(F.split(text, pattern), strip), lambda s: s != "")


def terms(text: Column) -> Column:
    """The distinct telling words of a text."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z][a-z0-9-]{2,})"), F.lit(1))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in STOP_WORDS]))


def classify(text: Column) -> Column:
    """struct<doc_type, confidence>: the first of the title lines that has a marker decides."""
    lines = F.slice(F.split(F.lower(text), r"\r\n|\n|\r"), 1, TITLE_LINES)

    def of(line):
        out = None
        for kind, words, confidence in TITLE_MARKERS:
            hit = F.contains(line, F.lit(words[0]))
            for w in words[1:]:
                hit = hit | F.contains(line, F.lit(w))
            value = F.struct(F.lit(kind).alias("doc_type"), F.lit(confidence).alias("confidence"))
            out = F.when(hit, value) if out is None else out.when(hit, value)
        return out

    found = F.filter(F.transform(lines, of), lambda x: x.isNotNull())
    return F.coalesce(F.get(found, 0), F.struct(F.lit("unknown").alias("doc_type"), F.lit(UNKNOWN_CONFIDENCE).alias("confidence")))


def tokens_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def slugify(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), " ", "-")


def html_preview(html: Column, width: int) -> Column:
    """Visible text on one line, cut to the width with an ellipsis."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))
    return F.when(F.length(plain) > width, F.concat(F.substring(plain, 1, width - 3), F.lit("..."))).otherwise(plain)


def citation_failure(block: Column, cited: Column, text: Column, quote: Column, start: Column, end: Column) -> Column:
    """Why a citation does not hold, or null; checked in this order."""
    return (
        F.when(block != cited, "cites another block")
        .when(start < 0, "starts before the block")
        .when(end > F.length(text), "ends after the block")
        .when(end <= start, "is empty")
        .when((F.substring(text, start + 1, end - start) != quote) | (F.trim(quote) == ""), "is not what the block says")
    )


def json_body(content: Column) -> Column:
    """The outermost object in a model's answer, or null."""
    start, back = F.instr(content, "{"), F.instr(F.reverse(content), "}")
    end = F.length(content) - back + 1
    return F.when((start > 0) & (back > 0) & (end > start), F.substring(content, start, end - start + 1))


def merge_spans(spans: Column) -> Column:
    """Spans (struct<s, e>) in order of start with overlaps joined."""
    none = F.array().cast("array<struct<s:int,e:int>>")

    def step(done, x):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(done) > 0) & (x["s"] <= F.try_element_at(done, F.lit(-1))["e"]), joined).otherwise(F.concat(done, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e")))))

    return F.aggregate(F.array_sort(spans), none, step)
