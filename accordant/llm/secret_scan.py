"""Secret scan by patterns and corpus-wide ownership of what they find; SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.llm.common import whole, written


def either_case(words: str) -> str:
    """A pattern for ``words`` with ASCII letters in either case, spelled out as classes."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


NAMES = either_case("password|passwd|secret|token|api_?key")
PATTERNS = {
    "assign": f"""({NAMES})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    # The runs are maximal, so a minimum in the pattern keeps the same matches as one applied later.
    "access": "AKIA[A-Z0-9]{14,}",
    "hex": "[0-9a-f]{16,}",
    "owned": "[A-Za-z0-9_-]{20,}",
}
KINDS = list(PATTERNS)
CHUNK = 256  # matches whose positions are gathered together
MIN_VALUE = 12  # characters of an assigned value
MIN_DISTINCT = 10  # different characters of a further candidate, which also needs a digit and a letter
# What a document can hold for a pattern to match; a plain search spares most texts the pattern.
NEEDS = {"assign": "[:=]", "access": "AKIA", "hex": "[0-9a-f]{8}", "owned": "[0-9]"}


def _sql(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def found(text: str, kind: str) -> Column:
    """``array<struct<s, k, e, v>>``: start, kind number, end (code points) and value, of all matches in order.

    The text is split at the matches; the lengths of pieces and matches add up to the positions.  They
    are gathered in chunks, as an array is copied whenever it grows: so the work grows with the
    number of matches, not with its square.
    """
    pattern, number = PATTERNS[kind], KINDS.index(kind)
    rows = "array<struct<s:int,k:int,e:int,v:string>>"
    value = f"regexp_extract(x.m, {_sql(pattern)}, 2)" if kind == "assign" else "x.m"
    pairs = f"zip_with(split({text}, {_sql(pattern)}, -1), regexp_extract_all({text}, {_sql(pattern)}, 0), (g, m) -> struct(length(g) as g, m))"
    within = f"""
      aggregate(chunk, struct(a.at as at, cast(array() as {rows}) as out),
        (b, x) -> if(x.m is null, b, struct(
          b.at + x.g + length(x.m) as at,
          array_append(b.out, struct(b.at + x.g as s, {number} as k, b.at + x.g + length(x.m) as e, {value} as v)) as out)))"""
    spans = f"""
      aggregate(
        element_at(transform(array({pairs}), p -> transform(sequence(0, (size(p) - 1) div {CHUNK}), c -> slice(p, int(c * {CHUNK} + 1), {CHUNK}))), 1),
        struct(0 as at, cast(array() as array<{rows}>) as out),
        (a, chunk) -> element_at(transform(array({within}), r -> struct(r.at as at, array_append(a.out, r.out) as out)), 1),
        a -> flatten(a.out))"""
    if kind == "assign":
        spans = f"filter({spans}, x -> length(x.v) >= {MIN_VALUE})"
    if kind == "owned":
        spans = f"""filter({spans}, x -> x.v rlike '[0-9]' and x.v rlike '[A-Za-z]'
          and size(array_distinct(split(x.v, ''))) >= {MIN_DISTINCT})"""
    return F.expr(f"if({text} rlike {_sql(NEEDS[kind])}, {spans}, cast(array() as {rows}))")


def _last_begins(kind: str) -> str:
    """Whether the last span of a kind that begins before the end of ``g`` reaches into it, found by halving."""
    middle = "(a.lo + a.hi) div 2"
    count = f"""aggregate(sequence(1, int(log2(size({kind}) + 1)) + 2), struct(0 as lo, size({kind}) as hi),
        (a, i) -> if(a.lo >= a.hi, a, if(element_at({kind}, int({middle}) + 1).s < g.e,
          struct(int({middle}) + 1 as lo, a.hi as hi), struct(a.lo as lo, int({middle}) as hi))), a -> a.lo)"""
    return f"coalesce(try_element_at({kind}, nullif({count}, 0)).e > g.s, false)"


def _joined(spans: str) -> Column:
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(
        f"concat_ws(',', transform(array_sort({spans}), x -> concat_ws(':', element_at(array({kinds}), x.k + 1), x.s, x.e)))"
    )


def scan_secrets(
    docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id",
    max_owners: int = 1, max_repositories: int = 5,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts, ``base`` and ``added`` spans, their joined forms.

    Base spans are the matches of three patterns.  All candidates of the corpus, and further long
    tokens of letters and digits, are counted by the distinct owners and repositories that hold
    them.  A value with at most ``max_owners`` owners and ``max_repositories`` repositories is
    owner-specific and counts as live; a value held more widely is a copied example.  Live further
    tokens are added as spans of kind "owned"; base spans stay whatever their class (n_live says how
    many of them are live, n_copied how many are examples).

    A null text is empty and has no spans; null owners (or repositories) are one owner of their
    own.  Rows that repeat an id are scanned apart.  No other column is read; an empty table gives
    no rows.
    """
    t = whole(text).alias("t")
    named = lambda c, p: F.coalesce(F.concat(F.lit(p), F.col(c).cast("string")), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), t,
        named(owner, "o").alias("owner"), named(repository, "r").alias("repository"),
    )
    for kind in KINDS:
        rows = rows.withColumn(kind, found("t", kind))
    base = F.expr("array_sort(concat(assign, access, hex))")
    # Spans of one kind are in order and apart, so of each kind only the last one that begins before the end matters.
    apart = " and ".join(f"not {_last_begins(kind)}" for kind in KINDS[:3])
    more = F.expr(f"filter(owned, g -> {apart})")
    scanned = written(rows.withColumn("base", base).select("row", "doc_id", "owner", "repository", "base", more.alias("more")), "secrets")
    each = scanned.select("row", "owner", "repository", F.explode(F.concat("base", "more")).alias("x")).select(
        "row", "owner", "repository", "x", F.sha2("x.v", 256).alias("hash")
    )
    # Distinct owners and repositories level by level: every level is summed up before it is shuffled.
    held = (
        each.select("hash", "owner", "repository").distinct()
        .groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))
    )
    live = held.filter((F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)).select("hash")
    own = each.select("row", "x", "hash").join(live, "hash").groupBy("row").agg(F.collect_set("x").alias("live"))
    none = F.expr("cast(array() as array<struct<s:int,k:int,e:int,v:string>>)")
    out = scanned.join(own, "row", "left").withColumn("live", F.coalesce("live", none))
    # The live rows come from these spans, so they need no look-up in them.
    out = out.withColumn("added", F.expr("array_sort(filter(live, x -> x.k = 3))"))
    kinds = [F.expr(f"cast(size(filter(base, x -> x.k = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return out.select(
        "doc_id", *kinds, _joined("base").alias("base_spans"), _joined("concat(base, added)").alias("spans"),
        F.size("added").cast("long").alias("n_owned"), F.expr("cast(size(filter(live, x -> x.k < 3)) as long)").alias("n_live"),
        F.expr("cast(size(base) - size(filter(live, x -> x.k < 3)) as long)").alias("n_copied"), "base", "added",
    )


def spans_sql() -> str:
    """The same in DuckDB's dialect, over a table ``documents``."""
    quoted = {k: "'" + p.replace("'", "''") + "'" for k, p in PATTERNS.items()}

    def spans(kind: str) -> str:
        p, i = quoted[kind], KINDS.index(kind)
        value = f"regexp_extract(m[i], {p}, 2)" if kind == "assign" else "m[i]"
        return f"""
          select rid, k, s, s + length(m) as e, v from (
            select rid, {i} as k, m[i] as m, {value} as v,
              list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as s
            from (select rid, regexp_extract_all(t, {p}) as m, string_split_regex(t, {p}) as g from docs) q,
              lateral (select unnest(range(1, len(m) + 1)) as i) u)"""

    names = "['assign', 'access', 'hex', 'owned']"
    return f"""
with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as t, coalesce('o' || source, '') as owner from documents),
base as (
  select * from ({spans("assign")}) a where length(v) >= {MIN_VALUE} union all {spans("access")} union all {spans("hex")}),
more as (
  select * from ({spans("owned")}) g where regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]')
    and len(list_distinct(string_split(v, ''))) >= {MIN_DISTINCT}
    and not exists (select 1 from base b where b.rid = g.rid and b.s < g.e and g.s < b.e)),
held as (
  select v from (select * from base union all select * from more) c join docs using (rid)
  group by v having count(distinct owner) <= 1 and count(distinct coalesce('r' || doc_id, '')) <= 5),
kept as (select * from base union all select m.* from more m where v in (select v from held)),
line as (
  select rid, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex,
    count(*) filter (k = 3) as n_owned, count(*) filter (k < 3 and v in (select v from held)) as n_live,
    string_agg({names}[k + 1] || ':' || cast(s as bigint) || ':' || cast(e as bigint), ',' order by s, k) filter (k < 3) as b,
    string_agg({names}[k + 1] || ':' || cast(s as bigint) || ':' || cast(e as bigint), ',' order by s, k) as spans
  from kept group by rid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(b, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_owned, 0) as n_owned,
  coalesce(n_live, 0) as n_live, coalesce(n_assign + n_access + n_hex - n_live, 0) as n_copied
from docs left join line using (rid)
"""
