"""Text helpers: replies to answer lists, prompt rendering, reply parsing.

Regular expressions start with ``(?U)`` so that ``\\s``, ``\\d`` and ``\\b`` cover all of
Unicode, and with ``(?d)`` where only a line feed may end a line.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
_EDGE_SPACE = rf"(?U)\A{SPACE}+|{SPACE}+\z"
ASCII_ONLY = r"\A[\x00-\x7f]*\z"


def strip(s: Column) -> Column:
    """Drop white space (Unicode included) from both ends."""
    return F.regexp_replace(s, _EDGE_SPACE, "")


def split_items(s: Column) -> Column:
    """Split on '|', strip every item, drop empty ones."""
    items = F.transform(F.split(s, r"\|"), strip)
    return F.filter(items, lambda x: x != "")


def response_to_list(s: Column) -> Column:
    """Reply text to answer list: 'idk' and 'no answer' are special replies."""
    return (
        F.when(s == "idk", F.array(F.lit("idk")))
        .when(s == "no answer", F.array().cast("array<string>"))
        .otherwise(split_items(s))
    )


def response_to_list_es(s: Column) -> Column:
    """Spanish replies: 'no sé' is the empty list."""
    return F.when(s == "no sé", F.array().cast("array<string>")).otherwise(split_items(s))


def label_score(response: Column, truth: Column) -> Column:
    """1 if both labels agree after stripping and lower-casing, else 0."""
    return (strip(F.lower(response)) == strip(F.lower(truth))).cast("int")


def directional_score(relation: Column, direction: Column) -> Column:
    """0.5 for naming the containment relation, 1 if the direction is right as well."""
    named = strip(F.lower(relation)).isin("containment", "contención")
    right = F.coalesce(strip(F.lower(direction)) == "b", F.lit(False))
    return F.when(named & right, F.lit(1.0)).when(named, F.lit(0.5)).otherwise(F.lit(0.0))


# Replacements that turn a predicate name into a file name.
PREDICATE_REPLACEMENTS = [
    ("?", ""),
    ("=", "eq"),
    (">", "gt"),
    ("<", "lt"),
    ("+", "plus"),
    ("∅", "disj"),
    ("|", "or"),
]


def file_safe_predicate(s: Column) -> Column:
    """Predicate name made safe for a file name."""
    for old, new in PREDICATE_REPLACEMENTS:
        s = F.replace(s, F.lit(old), F.lit(new))
    return F.regexp_replace(F.regexp_replace(s, r"(?U)[^\w]+", "_"), r"\A_+|_+\z", "")


def render(template: str, **slots: Column) -> Column:
    """Fill the named ``{slots}`` of a template; filled-in text is never read as a template."""
    parts: list[Column] = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            parts.append(F.coalesce(slots[field].cast("string"), F.lit("None")))
    return F.concat(*parts) if parts else F.lit("")


def render_by_key(templates: dict[str, str], key: Column, **slots: Column) -> Column:
    """Choose the template by ``key`` and fill it; an unknown key gives NULL."""
    out = F.lit(None).cast("string")
    for k, template in templates.items():
        out = F.when(key == k, render(template, **slots)).otherwise(out)
    return out


def token_estimate(question: Column, template: str = "{question}") -> Column:
    """Words of the filled template times 1.5, cut to an integer."""
    pieces = template.split("{question}")
    text = F.lit(pieces[0])
    for piece in pieces[1:]:
        text = F.concat(text, question, F.lit(piece))
    words = F.filter(F.split(text, rf"(?U){SPACE}+"), lambda w: w != "")
    return F.floor(F.size(words) * 1.5).cast("int")


def labelled_line(reply: Column, label: str, fallback: Column) -> Column:
    """Text after ``label:`` at the start of a line, any case; ``fallback`` if there is none."""
    pattern = rf"(?Uimd)^{label}:{SPACE}*(.+)"
    return F.when(reply.rlike(pattern), strip(F.regexp_extract(reply, pattern, 1))).otherwise(fallback)


def starts_with_yes(reply: Column) -> Column:
    return F.lower(strip(reply)).startswith("yes")


def is_yes(reply: Column) -> Column:
    return F.lower(strip(reply)) == "yes"


def numbered_lines(text: Column) -> Column:
    """The texts of lines of the form ``1. text``, in order."""
    pattern = rf"(?Ud)\A(\d+)\.{SPACE}+(.*)"
    lines = F.filter(F.transform(F.split(strip(text), "\n"), strip), lambda s: s.rlike(pattern))
    return F.transform(lines, lambda s: F.regexp_extract(s, pattern, 2))


def release_date(s: Column) -> Column:
    """A yyyy-MM-dd string as a date; NULL if it is none."""
    return F.try_to_timestamp(s, F.lit("yyyy-MM-dd")).cast("date")


def joined_replies(body: Column) -> Column:
    """Concatenate the 'response' fields of newline-delimited JSON; bad lines count as empty."""
    pieces = F.transform(
        F.split(body, "\n"), lambda line: F.coalesce(F.get_json_object(line, "$.response"), F.lit(""))
    )
    return F.array_join(pieces, "")


BINDINGS_SCHEMA = "struct<results:struct<bindings:array<map<string,struct<value:string>>>>>"


def first_binding_values(body: Column) -> Column:
    """The value of the first variable of every binding in a query-result JSON document."""
    bindings = F.from_json(body, BINDINGS_SCHEMA)["results"]["bindings"]
    return F.transform(bindings, lambda b: F.map_values(b)[0]["value"])
