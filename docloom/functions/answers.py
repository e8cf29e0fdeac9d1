"""Answers of models as column expressions: cleaning, citations, confidence, checks. The lists below are this library's own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What answers begin with that is no part of them.
PREFIXES = ("Answer:", "Response:", "Output:", "Final answer:", "Assistant:")
PREAMBLES = ("Sure, ", "Certainly! ", "Of course! ", "Based on the context, ", "Here is the answer: ")
#: How answers cite: the pattern and the group that names the source.
CITATIONS = (r"\[Source ([0-9]+)\]", r"\(Source: ([^)]+)\)", r"\[([0-9]+)\]", r"(?i)clause ([0-9]+(?:\.[0-9]+)*)", r"(?i)page ([0-9]+)")
#: How answers state confidence.
CONFIDENCE = (r"(?i)confidence: *([0-9]+(?:\.[0-9]+)?)", r"(?i)([0-9]+(?:\.[0-9]+)?)% (?:confident|sure|certain)", r"(?i)certainty: *([0-9]+(?:\.[0-9]+)?)")
#: Beginnings of answers that are none.
REFUSALS = ("i cannot", "i can't", "i am unable", "i'm sorry", "as an ai", "i do not have")
#: What an answer must not hold.
UNSAFE = (("script", r"(?i)<script"), ("protocol", r"(?i)javascript:"), ("handler", r"(?i)on(click|load|error) *="), ("secret", r"(?i)(password|api[_-]?key|secret) *[:=]"), ("card", r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}"))


def without(c: Column, beginnings: tuple[str, ...]) -> Column:
    """Without the first of ``beginnings`` that it begins with, whatever its case."""
    out = c
    for b in reversed(beginnings):
        out = F.when(F.lower(c).startswith(b.lower()), F.ltrim(F.substring(c, len(b) + 1, F.length(c)))).otherwise(out)
    return out


def clean(c: Column) -> Column:
    """Trimmed, single blanks, at most one empty line in a row, without a label in front."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\n{3,}", "\n\n"), r"[ \t]+", " "))
    return without(bare, PREFIXES)


def clean_markdown(c: Column) -> Column:
    """Headings of two levels at most, one kind of bullet, no empty emphasis."""
    out = F.regexp_replace(c, r"#{3,}", "##")
    out = F.regexp_replace(out, r"(?m)^[*+] ", "- ")
    return F.regexp_replace(out, r"\*{3,}", "**")


def citations(c: Column) -> Column:
    """What is cited, each once, by pattern and then by place."""
    return F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in CITATIONS))))


def confidence(c: Column) -> Column:
    """The stated confidence between 0 and 1; percentages are divided; null if there is none."""
    found = F.coalesce(*(F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in CONFIDENCE)).cast("double")
    return F.when(found.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(found > 1, found / 100).otherwise(found))))


def shape(c: Column) -> Column:
    """JSON, HTML, MARKDOWN or TEXT."""
    bare = F.trim(c)
    json = (bare.startswith("{") & bare.endswith("}")) | (bare.startswith("[") & bare.endswith("]"))
    return F.when(json, "JSON").when(bare.rlike(r"(?i)<(p|div|ul|ol|table|h[1-6])[ >]"), "HTML").when(bare.rlike(r"(?m)^(#{1,6} |[-*] |[0-9]+\. )") | bare.contains("**"), "MARKDOWN").otherwise("TEXT")


def refused(c: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.lower(F.trim(c)).startswith(r) for r in REFUSALS))


def valid(c: Column, least: int = 10, most: int = 2000) -> Column:
    """Long enough, not too long, and no refusal."""
    n = F.length(F.trim(c))
    return (n >= least) & (n <= most) & ~refused(c)


def issues(c: Column) -> Column:
    """Names of what an answer holds but must not."""
    return F.array_compact(F.array(*(F.when(c.rlike(p), F.lit(name)) for name, p in UNSAFE)))


def sanitized(c: Column) -> Column:
    """Scripts and protocols removed, then signs of HTML escaped."""
    out = F.regexp_replace(F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>", ""), r"(?i)javascript:", "")
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def truncated(c: Column, most: int, reach: int = 200) -> Column:
    """Cut at ``most`` characters, or at the end of the sentence if that comes within ``reach`` more."""
    tail = F.substring(c, most + 1, reach)
    stop = F.regexp_instr(tail, F.lit(r"[.!?]"))
    return F.when(F.length(c) <= most, c).otherwise(F.substring(c, F.lit(1), F.lit(most) + stop))


def heuristic_confidence(answer: Column, context: Column) -> Column:
    """Words of the answer over a tenth of the context's words, at most 1."""
    n = lambda x: F.size(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != ""))
    return F.round(F.least(n(answer) / F.greatest(F.lit(0.1) * n(context), F.lit(1.0)), F.lit(1.0)), 3)
