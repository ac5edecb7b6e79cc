"""Per-question analysis: nine relation flags and seven similarities.

Two forms give the same keys, flags, similarities and idk flags:

* :func:`analyse` for answers that arrive as one array per row (answer files), which also carries
  the sets a1..a4, a1_s, a1_p and the question texts;
* :func:`analyse_elements` for answers that arrive as one row per element, of any size, which
  carries the sizes of the sets instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant import names
from accordant.functions import sets
from accordant.functions.numbers import idk_any, idk_only, round4
from accordant.operators.answers import (
    GROUP_KEYS,
    REPEAT_ACTIONS,
    SINGLE_ACTIONS,
    SLOTS,
    answer_slots,
    attach_questions,
    known_actions,
    roles,
    slot_condition,
)
from accordant.session import materialise


def analyse(
    answers: DataFrame, questions: DataFrame | None = None,
    single: list[str] = SINGLE_ACTIONS, repeat: list[str] = REPEAT_ACTIONS,
) -> DataFrame:
    """Analysis table of array-valued answers: one shuffle, then row-local set algebra."""
    return attach_questions(measure(roles(answer_slots(answers, single, repeat), single), single), questions)


def measure(r: DataFrame, single: list[str] = SINGLE_ACTIONS) -> DataFrame:
    """Flags and similarities of rows that carry the role sets a1..a4, c1, c3, m1, m3, m4, s, p."""
    c = F.col
    a34 = sets.union(c("m3"), c("m4"))
    flags = {
        "eq_a1_a2": sets.equal(c("a1"), c("a2")),
        "eq_a1_a34": sets.equal(c("m1"), a34),
        "sub_a3_a1": sets.is_subset(c("c3"), c("c1")),
        "sub_a4_a1": sets.is_subset(c("m4"), c("m1")),
        "disj_a3_a4": sets.disjoint(c("m3"), c("m4")),
        "part_a1_a34": sets.partitions(c("m1"), c("m3"), c("m4")),
        "eq_a1_s": sets.equal(c("a1"), c("s")),
        "eq_a1_p": sets.equal(c("a1"), c("p")),
        "eq_s_p": sets.equal(c("s"), c("p")),
    }
    pairs = {
        "jac_a1_a2": (c("a1"), c("a2")),
        "jac_a1_a34": (c("m1"), a34),
        "jac_a3_a4": (c("m3"), c("m4")),
        "jac_a4_diff": (c("m4"), sets.difference(c("m1"), c("m3"))),
        "jac_a1_s": (c("a1"), c("s")),
        "jac_a1_p": (c("a1"), c("p")),
        "jac_s_p": (c("s"), c("p")),
    }
    repeats = {"eq_a1_s": ["s"], "eq_a1_p": ["p"], "eq_s_p": ["s", "p"],
               "jac_a1_s": ["s"], "jac_a1_p": ["p"], "jac_s_p": ["s", "p"]}

    def guarded(name: str, value: Column) -> Column:
        for need in repeats.get(name, []):
            value = F.when(c(need).isNotNull(), value)
        return value

    once = c("action").isin(single)
    return r.select(
        *GROUP_KEYS,
        *[guarded(n, sets.flag(v)).alias(n) for n, v in flags.items()],
        *[guarded(n, round4(sets.jaccard(a, b))).alias(n) for n, (a, b) in pairs.items()],
        "a1", "a2", "a3", "a4",
        F.when(~once, c("c1")).alias("a1_s"), F.when(~once, c("m1")).alias("a1_p"),
        *[idk_any(c(a)).alias(f"idk_{a}") for a in ("a1", "a2", "a3", "a4")],
        *[idk_only(c(a)).alias(f"idk_only_{a}") for a in ("a1", "a2", "a3", "a4")],
    )


# -- element form ----------------------------------------------------------------------------

_SLOT_BITS = {s: 1 << i for i, s in enumerate([*SLOTS, "star"])}


def slot_mask(conditions: dict[str, Column]) -> Column:
    """Membership bits of one element row: one bit per slot whose condition holds."""
    out = F.lit(0)
    for slot, cond in conditions.items():
        out = out.bitwiseOR(F.when(cond, F.lit(_SLOT_BITS[slot])).otherwise(F.lit(0)))  # a sum would be checked for overflow
    return out


def first_rows(elements: DataFrame) -> DataFrame:
    """Element rows of the answer that counts: the one with the lowest file path per answer key.

    Star answers of a group are one key, whatever their series: the lowest (series, path) counts.
    The paths of a key are counted first, which a hash aggregation does before the shuffle, and the
    lowest ones are written.  So Spark knows their size when it plans the join: few are broadcast, and the
    element rows stay where they are; many are joined by sorting, with large keys split.
    """
    star = F.col("action") == "star"
    key = {"__serie": F.when(~star, F.col("q_serie")), "__task": F.when(~star, F.col("task"))}
    rows = elements.withColumns({
        **{k: F.coalesce(v, F.lit("")) for k, v in key.items()},
        "__rank": F.concat_ws("\u0001", F.coalesce("q_serie", F.lit("")), F.coalesce("file_path", F.lit(""))),
    })
    keys = ["q_id", "action", "dataset", "llm", "__serie", "__task"]
    # The count is asked for because the optimizer drops a mere distinct below a minimum.
    paths = rows.groupBy(*keys, "__rank").agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    least = materialise(paths.groupBy(*keys).agg(F.min("__rank").alias("__rank")), "first-paths")
    return rows.join(least, [*keys, "__rank"], "left_semi").drop("__serie", "__task", "__rank")


def analyse_elements(
    elements: DataFrame, single: list[str] = SINGLE_ACTIONS, repeat: list[str] = REPEAT_ACTIONS
) -> DataFrame:
    """Analysis table of element rows ``q_id, q_serie, action, task, dataset, llm, element``.

    An answer without elements is one row with ``has_element`` false; without that column every
    row is an element.  With a ``file_path`` column, repeated answers keep the lowest path; without
    it, the rows of a key are one answer.  An action in neither list is an error.  See
    :func:`analyse_masks` for the plan.
    """
    if "has_element" not in elements.columns:
        elements = elements.withColumn("has_element", F.lit(True))
    star = F.col("action") == "star"
    conditions = {s: ~star & slot_condition(s) for s in SLOTS}
    conditions["star"] = star
    bit = F.lit(0)
    for i, s in enumerate(names.SERIES):
        bit = F.when(~star & (F.col("q_serie") == s), F.lit(1 << i)).otherwise(bit)
    seen = F.when(star, F.lit(1 << len(names.SERIES))).otherwise(bit)
    known = known_actions(elements, single, repeat)
    rows = (first_rows(known) if "file_path" in known.columns else known).select(
        "q_id",
        F.when(star, "zero-shot").otherwise(F.col("action")).alias("action"),
        "dataset", "llm",
        F.when(F.col("has_element"), F.col("element")).alias("element"),
        F.when(F.col("has_element"), slot_mask(conditions)).otherwise(F.lit(0)).alias("mask"),
        seen.alias("seen"),
    )
    return analyse_masks(rows, single)


def role_bits(single: list[str] = SINGLE_ACTIONS) -> str:
    """Membership bits by role: what ``roles`` does to sets, done to the mask of one element.

    For actions that ask once, c1 and m1 are e1, m3 is c3 and the repeat is the star answer; for
    the others the repeat is c1.
    """
    b = _SLOT_BITS
    once = ", ".join(f"'{a}'" for a in single)
    keep = b["e1"] | b["e2"] | b["c3"] | b["m4"] | b["star"]
    repeat = (b["star"] - 1, b["star"] // b["c1"])
    return (
        f"CASE WHEN action IN ({once}) THEN (mask & {keep}) "
        f"| ((mask & {b['e1']}) * {(b['c1'] | b['m1']) // b['e1']}) | ((mask & {b['c3']}) * {b['m3'] // b['c3']}) "
        f"ELSE (mask & {repeat[0]}) | ((mask & {b['c1']}) * {repeat[1]}) END"
    )


def analyse_masks(rows: DataFrame, single: list[str] = SINGLE_ACTIONS) -> DataFrame:
    """Analysis table of rows ``q_id, action, dataset, llm, element, mask, seen``.

    ``mask`` says which answer sets the element is in, ``seen`` which series (and star) the row
    proves answered.  First aggregate by (group, element), so no answer set is ever held by one
    task, repeats vanish before the shuffle and a huge group is spread by its elements; then add
    up counters per group, again partly before the shuffle.  Every metric is a ratio or a
    comparison of such counters.
    """
    per_element = rows.groupBy(*GROUP_KEYS, "element").agg(
        F.bit_or("mask").alias("mask"), F.bit_or("seen").alias("seen")
    ).select(*GROUP_KEYS, F.expr(role_bits(single)).alias("r"), (F.col("element") == "idk").alias("is_idk"), "seen")
    b = _SLOT_BITS
    e1, e2, c1, c3, m1, m3, m4, s = (b[x] for x in ("e1", "e2", "c1", "c3", "m1", "m3", "m4", "star"))
    counts = {
        "both_a1_a34": f"(r & {m1}) != 0 AND (r & {m3 | m4}) != 0",
        "any_a1_a34": f"(r & {m1 | m3 | m4}) != 0",
        "both_a4_diff": f"(r & {m1 | m3 | m4}) = {m1 | m4}",
        "any_a4_diff": f"(r & {m4}) != 0 OR (r & {m1 | m3}) = {m1}",
        "a3_outside": f"(r & {c1 | c3}) = {c3}",
        "a4_outside": f"(r & {m1 | m4}) = {m4}",
    }
    for n, x, y in (("a1_a2", e1, e2), ("a3_a4", m3, m4), ("a1_s", e1, s), ("a1_p", e1, m1), ("s_p", s, m1)):
        counts[f"both_{n}"] = f"(r & {x | y}) = {x | y}"
        counts[f"any_{n}"] = f"(r & {x | y}) != 0"
    for n, x in {"a1": e1, "a2": e2, "a3": c3, "a4": m4}.items():
        counts[f"size_{n}"] = f"(r & {x}) != 0"
        counts[f"idks_{n}"] = f"is_idk AND (r & {x}) != 0"
    all_series = (1 << len(names.SERIES)) - 1
    star_bit = 1 << len(names.SERIES)
    g = (
        per_element.groupBy(*GROUP_KEYS)
        .agg(*[F.expr(f"count_if({cond})").alias(n) for n, cond in counts.items()], F.bit_or("seen").alias("seen"))
        .filter(F.col("seen").bitwiseAND(all_series) == all_series)
    )
    once = F.col("action").isin(single)

    def when(need: str, value: str) -> str:
        return f"CASE WHEN {need} THEN {value} END" if need else value

    has = {"s": "has_s", "p": "has_p", "": ""}
    sames = {"eq_a1_a2": ("a1_a2", ""), "eq_a1_a34": ("a1_a34", ""), "eq_a1_s": ("a1_s", "s"), "eq_a1_p": ("a1_p", "p"),
             "eq_s_p": ("s_p", "p")}
    flags = {n: when(has[need], f"INT(both_{x} = any_{x})") for n, (x, need) in sames.items()}
    flags |= {
        "sub_a3_a1": "INT(a3_outside = 0)",
        "sub_a4_a1": "INT(a4_outside = 0)",
        "disj_a3_a4": "INT(both_a3_a4 = 0)",
        "part_a1_a34": "INT(both_a1_a34 = any_a1_a34 AND both_a3_a4 = 0)",
    }
    needs = {"jac_a1_s": "s", "jac_a1_p": "p", "jac_s_p": "p"}
    jaccards = {}
    for n in names.JACCARDS:
        x = n.removeprefix("jac_")
        jaccards[n] = when(
            has[needs.get(n, "")],
            f"bround(CASE WHEN any_{x} = 0 THEN 0D ELSE DOUBLE(both_{x}) / DOUBLE(any_{x}) END, 4)",
        )
    sides = ("a1", "a2", "a3", "a4")
    idks = {f"idk_{a}": f"INT(size_{a} = 0 OR idks_{a} > 0)" for a in sides}
    idks |= {f"idk_only_{a}": f"INT(size_{a} = 0 OR (size_{a} = 1 AND idks_{a} = 1))" for a in sides}
    return g.withColumns({
        "has_s": ~once | ((F.col("action") == "zero-shot") & (F.col("seen").bitwiseAND(star_bit) != 0)),
        "has_p": ~once,
    }).selectExpr(
        *GROUP_KEYS,
        *[f"{flags[n]} AS {n}" for n in names.FLAGS],
        *[f"{e} AS {n}" for n, e in jaccards.items()],
        *[f"size_{a}" for a in sides],
        *[f"{e} AS {n}" for n, e in idks.items()],
    )


def to_elements(answers: DataFrame) -> DataFrame:
    """Array-valued answers to element rows; an empty answer keeps one row without element."""
    keys = ["q_id", "q_serie", "action", "task", "dataset", "llm", *[c for c in ("file_path",) if c in answers.columns]]
    return answers.select(*keys, F.posexplode_outer("answer").alias("pos", "element")).select(
        *keys, "element", F.col("pos").isNotNull().alias("has_element")
    )
