"""What a block of text looks like to a model: hidden text made visible, imperatives named."""

from __future__ import annotations

import html
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerloom.functions.grounding import let
from ledgerloom.functions.text import strip

# Characters without a rendering, markup that a page hides, and the named imperatives.
INVISIBLE = "[\\u00AD\\u180E\\u200B-\\u200F\\u202A-\\u202E\\u2060-\\u2064\\u206A-\\u206F\\uFEFF]"
TAG_CHARACTERS = "[\\x{E0000}-\\x{E007F}]"
#: Whatever invisible characters, entities and forms have in it: a text without any of it reads as it stands.
UNFOLDED = r"[^\x03-\x25\x27-\x7F]"
HIDDEN_MARKUP = r"""(?isU)<!--.*?-->|<[^>]*\b(?:alt|title|aria-label|data-[\w-]+)\s*=\s*["'][^"']*["'][^>]*>"""
HIDDEN_MARKDOWN = r"""(?U)!\[[^\]]*\]\([^)]*\)|\[[^\]]*\]\([^)\s]*\s+"[^"]*"\)"""
IMPERATIVES = {
    "override_instructions": r"(?iU)\b(?:ignore|disregard|forget|override)\s+(?:all\s+|any\s+|the\s+)?(?:previous|prior|earlier|above|preceding|system)\s+(?:instruction|instructions|prompt|prompts|rules?|context)\b",
    "role_impersonation": r"(?iU)(?:^|\n)\s*(?:system|assistant|agent|developer)\s*:",
    "approval_demand": r"(?iU)\b(?:approve|accept|sign\s+off\s+on|auto[- ]?approve|commit)\s+(?:this|the|all|every)\b",
    "concealment": r"(?iU)\b(?:do\s+not|don't|never)\s+(?:tell|show|report|mention|flag|escalate)\b",
    "secret_exfiltration": r"(?iU)\b(?:reveal|print|output|repeat|send|leak)\s+(?:the\s+|your\s+)?(?:system\s+prompt|api[\s_-]?key|secret|credential|token|password)\b",
    "tool_invocation": r"(?iU)\b(?:call|invoke|execute|run)\s+(?:the\s+)?(?:tool|function|command|sql|query|shell)\b",
    "instruction_to_agent": r"(?iU)\b(?:you\s+(?:must|should|shall|will)|your\s+task\s+is|new\s+instructions?)\b",
}


@F.pandas_udf(StringType())
def _folded(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", html.unescape(t)), na_action="ignore")


def _unwrapped(text: Column, pattern: str, marks: str) -> Column:
    """The matches of pattern with its marks blanked, the rest as it is."""
    spaced = F.regexp_replace(text, _grouped(pattern), "\u0001$1\u0002")

    def of(parts: Column) -> Column:
        inner = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.regexp_replace(F.substring_index(p, "\u0002", 1), marks, " "), F.element_at(F.split(p, "\u0002", 2), 2)))
        return F.concat(F.element_at(parts, 1), F.array_join(inner, ""))

    return let(F.split(spaced, "\u0001"), of)


def _grouped(pattern: str) -> str:
    return f"(?isU)({pattern[6:]})" if pattern.startswith("(?isU)") else f"({pattern})"


def normalise(text: Column) -> Column:
    """A text as a model reads it: invisible characters out, entities and forms folded, hidden markup unwrapped. Each step
    takes only the texts that have something for it: most go to Python as nulls."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, TAG_CHARACTERS, ""), INVISIBLE, ""), "[\u0001\u0002]", "")
    odd = text.rlike(UNFOLDED)
    folded = F.when(odd, _folded(F.when(odd, clean))).otherwise(text)
    shown = let(folded, lambda t: F.when(F.contains(t, F.lit("<")), _unwrapped(t, HIDDEN_MARKUP, r"[<>!\[\]()\"']")).otherwise(t))
    return let(shown, lambda t: F.when(F.contains(t, F.lit("[")), _unwrapped(t, HIDDEN_MARKDOWN, r"[!\[\]()\"']")).otherwise(t))


def suspicious(text: Column) -> Column:
    """scan(text).suspicious alone, with the text normalised once however the plan moves it, as filters move below what they
    are about and take its parts with them, once for each place."""
    return let(normalise(text), lambda cleaned: F.coalesce(reduce(Column.__or__, [cleaned.rlike(p) for p in IMPERATIVES.values()]), F.lit(False)))


def scan_of(cleaned: Column, text: Column, method: Column | str = "txt") -> Column:
    """struct<suspicious, signals, quotes> given a text and its normalised form."""
    method = method if isinstance(method, Column) else F.lit(method)
    signals = F.array_compact(F.array(*[F.when(cleaned.rlike(p), F.lit(name)) for name, p in IMPERATIVES.items()]))
    quotes = F.filter(F.array(*[strip(F.regexp_extract(cleaned, p, 0)) for p in IMPERATIVES.values()]), lambda q: q != "")
    hidden = F.array_compact(F.array(F.when(text.rlike(INVISIBLE) | text.rlike(TAG_CHARACTERS), F.lit("invisible_characters")), F.when(text.rlike(HIDDEN_MARKUP) | text.rlike(HIDDEN_MARKDOWN), F.lit("hidden_markup")), F.when((F.size(signals) > 0) & (method != "txt"), F.concat(F.lit("read_by_"), method))))
    return F.struct((F.size(signals) > 0).alias("suspicious"), F.concat(signals, hidden).alias("signals"), quotes.alias("quotes"))


def scan(text: Column, method: Column | str = "txt") -> Column:
    return scan_of(normalise(text), text, method)


def describe(signals: Column) -> Column:
    return F.when(F.size(signals) > 0, F.array_join(signals, ", ")).otherwise("no known pattern")
