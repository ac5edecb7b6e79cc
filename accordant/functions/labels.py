"""Relation labels: cleaning, mapping free text to seven labels, strict check, picking."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from accordant.functions.text import SPACE, strip
from accordant.functions.unicode import safe_pattern
from accordant.names import CANONICAL_LABELS

# Replies that mean "unknown".
UNKNOWN_TOKENS = [
    "unknown", "unk", "n/a", "na", "none", "null", "nil", "idk", "don't know", "dont know",
    "cannot determine", "can’t determine", "cant determine", "unsure", "uncertain",
    "not sure", "not given", "not specified", "ambiguous",
]

# Label patterns in order of precedence, searched in the case-folded text.
LABEL_PATTERNS = [
    ("Overlap", [r"\bnot\s+disjoint\b", r"\bnon[-\s]?disjoint\b"]),
    ("Disjoint", [r"\bnot\s+overlap(ping)?\b"]),
    ("Equivalence", [
        r"\beq(uiv(alent|alence)?)\b", r"\bequal(s)?\b", r"\bsame(\s+set)?\b", r"a\s*=\s*b", "≡", "↔",
    ]),
    ("Contains", [
        "⊃", "⊇", r"\bsuper\s*set\b", r"\bsuperset\s+of\b", r"\bcontain(s|ment)?\b", r"\bincludes?\b",
        r"\b(a|set\s*a)?\s*includes?\s*(b|set\s*b)\b",
    ]),
    ("ContainedBy", [
        "⊂", "⊆", r"\bsub\s*set\b", r"\bsubset\s+of\b", r"\bcontained\s*by\b", r"\bis\s+in\b",
        r"\bbelongs\s+to\b",
    ]),
    ("Disjoint", [
        r"\A(?=[\s\S]*∩)(?=[\s\S]*(∅|= 0))", r"\bdis[-\s]?joint\b", r"\bno\s+(overlap|intersection)\b",
        r"\bmutual(ly)?\s+exclusive\b", r"\bnon[-\s]?overlap(ping)?\b",
    ]),
    ("Overlap", [
        r"\A(?=[\s\S]*∩)(?=[\s\S]*(≠|!= ))", r"\boverlap(ping)?\b", r"\bintersect(s|ion)?\b",
        r"\b(non[-\s]?empty|some)\s+intersection\b", r"\bshare(s)?\s+(elements|items|members)\b",
    ]),
    ("Unknown", ["unknown"]),
]
# Texts without which a pattern cannot match, in the order of the patterns.  White space is squeezed by
# then, so it is at most one blank.
NEEDED_TEXTS = [
    [["disjoint"], ["disjoint"]],
    [["not overlap"]],
    [["equiv"], ["equal"], ["same"], ["="], ["≡"], ["↔"]],
    [["⊃"], ["⊇"], ["superset", "super set"], ["superset of"], ["contain"], ["include"], ["include"]],
    [["⊂"], ["⊆"], ["subset", "sub set"], ["subset of"], ["contained"], ["is in"], ["belongs to"]],
    [["∩"], ["joint"], ["no overlap", "no intersection"], ["exclusive"], ["overlap"]],
    [["∩"], ["overlap"], ["intersect"], ["intersection"], ["share"]],
    [["unknown"]],
]


def _composed(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def _folded(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else t.casefold() for t in texts.to_pylist()], pa.string())


def _both(texts: pa.Array) -> pa.Array:
    composed = _composed(texts)
    return pa.StructArray.from_arrays([composed, _folded(composed)], names=["composed", "folded"])


def composed_and_folded(s: Column) -> Column:
    """A struct ``composed, folded`` of a text; ``folded`` is null where :func:`lower_fold` folds it.

    Only texts that hold a character which needs it go to Python, once for both forms.
    """
    safe = s.rlike(safe_pattern("composition")) & s.rlike(safe_pattern("folding"))
    there = F.arrow_udf(_both, "composed string, folded string")(F.when(~safe, s))
    return F.when(safe, F.struct(s.alias("composed"), F.lit(None).cast("string").alias("folded"))).otherwise(there)


def lower_fold(s: Column) -> Column:
    """Case folding of a text without special cases."""
    return F.replace(F.lower(s), F.lit("ß"), F.lit("ss"))


def nfkc(s: Column) -> Column:
    """Unicode compatibility composition.

    Texts without a character that it can change pass as they are; only others go to Python.  The
    function is deterministic, so filters above it still reach the scan.
    """
    safe = s.rlike(safe_pattern("composition"))
    return F.when(safe, s).otherwise(F.arrow_udf(_composed, "string")(F.when(~safe, s)))


def casefold(s: Column) -> Column:
    """Full Unicode case folding (unlike ``lower``, 'ß' becomes 'ss'); Python only for texts that need it."""
    safe = s.rlike(safe_pattern("folding"))
    return F.when(safe, lower_fold(s)).otherwise(F.arrow_udf(_folded, "string")(F.when(~safe, s)))


def clean_label(s: Column) -> Column:
    """Compose, drop parenthesised parts, squeeze hyphens, underscores and white space."""
    return squeezed(nfkc(s))


def squeezed(s: Column) -> Column:
    """Drop parenthesised parts, squeeze hyphens, underscores and white space."""
    s = F.regexp_replace(s, r"\([^)\n]*+\)", "")
    s = F.regexp_replace(s, r"[-_]+", "-")
    return F.trim(F.regexp_replace(s, rf"(?U){SPACE}+", " "))


def is_unknown_token(folded: Column) -> Column:
    return folded.isin(UNKNOWN_TOKENS)


def match_label(cleaned: Column, folded: Column) -> Column:
    """One of the seven labels from a cleaned text and its case-folded form.

    NULL is 'Unknown', no match is 'Else'.  A pattern is only tried on a text that holds what it
    needs; for most texts that is told by plain text search.
    """

    def found(pattern: str, needed: list[str]) -> Column:
        held = reduce(or_, [folded.contains(t) for t in needed])
        return held if pattern in needed else held & folded.rlike("(?U)" + pattern)

    out = F.when(cleaned.isNull(), F.lit("Unknown")).when(cleaned.isin(CANONICAL_LABELS), cleaned)
    out = out.when(is_unknown_token(folded), F.lit("Unknown"))
    for (label, patterns), needed in zip(LABEL_PATTERNS, NEEDED_TEXTS, strict=True):
        out = out.when(reduce(or_, [found(p, t) for p, t in zip(patterns, needed, strict=True)]), F.lit(label))
    return out.otherwise(F.lit("Else"))


def canonical_label(s: Column) -> Column:
    """Free text to one of the seven labels.

    For whole columns prefer :func:`accordant.operators.relations.with_canonical_labels`, which
    cleans every text once.
    """
    cleaned = clean_label(s)
    return match_label(cleaned, casefold(cleaned))


def strict_label(s: Column) -> Column:
    """Exact labels only: NULL is 'Unknown', anything that is no canonical label is 'Else'."""
    t = strip(s)
    return F.when(s.isNull(), F.lit("Unknown")).when(t.isin(CANONICAL_LABELS), t).otherwise(F.lit("Else"))


def first_nonempty(items: Column) -> Column:
    """First item that is neither NULL nor blank, stripped; NULL if there is none."""
    stripped = F.filter(F.transform(items, strip), lambda x: x.isNotNull() & (x != ""))
    return F.try_element_at(stripped, F.lit(1))


def best_key(scores: Column) -> Column:
    """Key of the largest value of a ``MAP<STRING, DOUBLE>``; the earlier key wins a tie."""
    best = F.aggregate(
        F.map_entries(scores),
        F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("value")),
        lambda acc, e: F.when(
            e["value"].isNotNull() & (acc["value"].isNull() | (e["value"] > acc["value"])),
            F.struct(e["key"].alias("key"), e["value"].alias("value")),
        ).otherwise(acc),
    )
    return best["key"]


# Keys of a label object, in order of preference.
LABEL_KEYS = ["label", "relation", "pred", "class"]


def pick_from_object(m: Column) -> Column:
    """Label of a ``MAP<STRING, STRING>``: a label key, else the best numeric score, else the first key."""
    named = [
        F.when(~F.try_element_at(m, F.lit(k)).rlike(r"\A[\[{]"), F.try_element_at(m, F.lit(k))) for k in LABEL_KEYS
    ]
    numeric = F.map_filter(m, lambda k, v: v.rlike(r"\A-?(\d+\.?\d*|\.\d+)\z"))
    scored = best_key(F.transform_values(numeric, lambda k, v: v.try_cast("double")))
    return F.coalesce(*named, scored, F.try_element_at(F.map_keys(m), F.lit(1)))


def label_text(value: Column) -> Column:
    """Label text of a JSON value that may be a string, a list or an object; NULL if it has none."""
    as_list = F.from_json(value, "array<string>")
    as_object = F.from_json(value, "map<string,string>")
    return (
        F.when(value.startswith("[") & as_list.isNotNull(), first_nonempty(as_list))
        .when(value.startswith("{") & as_object.isNotNull(), pick_from_object(as_object))
        .otherwise(value)
    )


def classified_label(value: Column) -> Column:
    """First entry of a list value, else the value as :func:`label_text` reads it."""
    as_list = F.from_json(value, "array<string>")
    head = F.when(value.startswith("[") & (F.size(as_list) > 0), as_list[0]).otherwise(value)
    return label_text(head)
