"""Answer, label, score and model tables derived from a star-schema data set.

The adapters turn order lines into answer elements and parts into label rows, so every operator
can run, and be checked, on generated tables of any scale.  All are lazy views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from accordant.operators.analysis import slot_mask
from accordant.operators.answers import SLOTS
from accordant.session import parts_for


_SCHEMAS: dict[str, StructType] = {}


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan of a table; its schema is read from the files once per path."""
    path = f"{root}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


# Which order lines put their element into which answer set.
SLOT_RULES = {
    "e1": "l_quantity <= 45",
    "e2": "l_discount >= 0.01D",
    "c1": "l_tax <= 0.07D",
    "c3": "l_returnflag = 'R'",
    "m1": "l_extendedprice <= 85000",
    "m3": "l_returnflag = 'R' AND l_tax <= 0.06D",
    "m4": "l_returnflag <> 'R'",
    "star": "l_linenumber <= 6",
}


# Question of an order line, the number that tells its element, and that element: one question per customer with
# three possible elements, or one per nation with a part as element, so that sets grow with the data.
NARROW = ("o_custkey", "l_partkey % 3", "CASE WHEN key = 0 THEN 'idk' ELSE CAST(key AS STRING) END")
WIDE = ("c_nationkey", "l_partkey", "CASE WHEN key % 50 = 0 THEN 'idk' ELSE CAST(key AS STRING) END")

ACTIONS = ["zero-shot", "fixing", "classification"]
# The actions' places above the rule bits of a line.
_ACTION_BITS = {a: i << (len(SLOTS) + 1) for i, a in enumerate(ACTIONS)}


def _by_action(values: dict[str, int]) -> Column:
    """The value of an order line's action."""
    zero_shot, fixing, other = (F.lit(values[a]) for a in ACTIONS)
    return F.when(F.col("l_linestatus") == "O", zero_shot).when(F.col("l_suppkey") % 2 == 0, fixing).otherwise(other)


def order_lines(spark: SparkSession, root: str, kind: tuple[str, str, str] = NARROW) -> DataFrame:
    """Order lines as question, dataset, model, action and element, with the rule columns (false where unknown).

    Orders meet their customers first, so the lines are shuffled once at most, as three numbers: the
    order, what tells the element, and the rules with the action.
    """
    question, key, element = kind
    rules = slot_mask({slot: F.expr(rule) for slot, rule in SLOT_RULES.items()})
    lines = load(spark, root, "lineitem").select(
        "l_orderkey", F.expr(key).alias("key"), rules.bitwiseOR(_by_action(_ACTION_BITS)).alias("rules")
    )
    orders = load(spark, root, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customers = load(spark, root, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    asked = orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        "o_orderkey", F.col(question).cast("string").alias("q_id"), F.col("c_mktsegment").alias("dataset"),
        F.col("o_orderpriority").alias("llm"),
    )
    action = F.lit(None).cast("string")
    for a, bits in _ACTION_BITS.items():
        action = F.when(F.col("rules") >= bits, a).otherwise(action)
    return lines.join(asked, lines.l_orderkey == asked.o_orderkey).select(
        "q_id", action.alias("action"), "dataset", "llm", F.expr(element).alias("element"),
        *[(F.col("rules").bitwiseAND(slot_mask({slot: F.lit(True)})) != 0).alias(slot) for slot in SLOT_RULES],
    )


def membership() -> dict[str, Column]:
    """When an order line's element is in each answer set; repeats are asked by some actions only."""
    zero_shot = F.col("action") == "zero-shot"
    found = {s: F.col(s) if s in ("e1", "e2", "c3", "m4") else F.col(s) & ~zero_shot for s in SLOTS}
    return found | {"star": F.col("star") & zero_shot}


def element_masks(spark: SparkSession, root: str, kind: tuple[str, str] = NARROW) -> DataFrame:
    """Input of ``analyse_masks``: the series of the answer sets that an element is in count as answered."""
    lines = order_lines(spark, root, kind)
    zero_shot = F.col("action") == "zero-shot"
    conditions = {s: F.col(s) for s in SLOTS}
    conditions["star"] = F.col("star") & zero_shot
    return lines.select(
        "q_id", "action", "dataset", "llm", "element", slot_mask(conditions).alias("mask"),
        F.expr(
            "IF(e1 OR (action <> 'zero-shot' AND (c1 OR m1)), 1, 0) + IF(e2, 2, 0) "
            "+ IF(c3 OR (action <> 'zero-shot' AND m3), 4, 0) + IF(m4, 8, 0) + IF(star AND action = 'zero-shot', 16, 0)"
        ).alias("seen"),
    )


GROUP = ["q_id", "action", "dataset", "llm"]
# The (series, task, action) of every answer set; None: the group's own action.
CELLS = {**{s: (serie, task, None) for s, (serie, task) in SLOTS.items()}, "star": ("Q1", "equal", "star")}


def _cells(present: Callable[[int, str], Column], **more: Callable[[int, str], Column]) -> Column:
    """One struct per answer set that ``present`` accepts, with the columns ``more``."""
    found = [
        F.when(present(i, s), F.struct(
            F.lit(serie).alias("q_serie"), F.lit(task).alias("task"),
            (F.lit(action) if action else F.col("action")).alias("action"), *[c(i, s).alias(n) for n, c in more.items()],
        ))
        for i, (s, (serie, task, action)) in enumerate(CELLS.items())
    ]
    return F.explode(F.array_compact(F.array(*found))).alias("c")


def answer_elements(spark: SparkSession, root: str, kind: tuple[str, str] = NARROW) -> DataFrame:
    """Element rows ``q_id, q_serie, action, task, dataset, llm, element``; empty sets are absent.

    The order lines of a group and element are one number of bits by the time they become rows.
    """
    masks = order_lines(spark, root, kind).select(*GROUP, "element", slot_mask(membership()).alias("mask"))
    masks = masks.groupBy(*GROUP, "element").agg(F.bit_or("mask").alias("mask"))
    rows = masks.select("q_id", "dataset", "llm", "element", _cells(lambda i, s: F.col("mask").bitwiseAND(F.lit(1 << i)) != 0))
    return rows.select("q_id", "c.q_serie", "c.action", "c.task", "dataset", "llm", "element")


def _as_files(rows: DataFrame) -> DataFrame:
    """Answer rows with the columns that a scan of answer files has."""
    return rows.select(
        "q_id", "c.q_serie", "c.action", "c.task", "dataset", "llm", "c.answer", F.lit(None).cast("string").alias("lang"),
    ).withColumn("file_path", F.concat_ws("/", F.lit("/data/answers"), "action", "dataset", "task", "q_serie", "llm"))


def _dealt_parts(spark: SparkSession, root: str, megabytes: int) -> int:
    return parts_for(spark, [f"{root}/{t}.parquet" for t in ("lineitem", "orders", "customer")], megabytes)


def answers(spark: SparkSession, root: str) -> DataFrame:
    """Array-valued answers with a file path; a set has at most the three possible elements.  They lie together by ``q_id``.

    The sets of a question, dataset and model are three bits each of one number, seven sets an action.  The
    lines of an order are such a number before they are shuffled, and the orders of a customer before
    the sets become rows with arrays.  So nothing wider than a number is shuffled; whatever groups the
    answers by ``q_id`` and others needs no shuffle of its own.
    """
    domain = ("1", "2", "idk")
    width = len(SLOTS) * len(domain)
    places = {s: i * len(domain) for i, s in enumerate(SLOTS)}
    places["star"] = places["c1"]  # One of the two is asked of an action.
    element = F.lit(0)
    for k, e in enumerate(domain):
        element = F.when(F.col("element") == e, F.lit(k)).otherwise(element)
    lines = load(spark, root, "lineitem").withColumn("key", F.expr(NARROW[1])).select(
        "l_orderkey", _by_action({a: i * width for i, a in enumerate(ACTIONS)}).alias("at"),
        F.when(F.col("l_linestatus") == "O", "zero-shot").otherwise("").alias("action"), F.expr(NARROW[2]).alias("element"),
        *[F.expr(rule).alias(slot) for slot, rule in SLOT_RULES.items()],
    )
    asked = F.lit(0)
    for s, condition in membership().items():
        asked = asked.bitwiseOR(F.when(condition, F.lit(1 << places[s])).otherwise(F.lit(0)))
    bits = F.call_function("shiftleft", asked.cast("long"), F.col("at") + element)
    per_order = lines.select("l_orderkey", bits.alias("bits")).groupBy("l_orderkey").agg(F.bit_or("bits").alias("bits"))
    orders = load(spark, root, "orders").select("o_orderkey", F.col(NARROW[0]).cast("string").alias("q_id"), F.col("o_orderpriority").alias("llm"))
    customers = load(spark, root, "customer").select(F.col("c_custkey").cast("string").alias("q_id"), F.col("c_mktsegment").alias("dataset"))
    ordered = per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("q_id", "llm", "bits")
    dealt = ordered.repartition(_dealt_parts(spark, root, 8), "q_id").join(customers, "q_id")
    sets = dealt.groupBy("q_id", "dataset", "llm").agg(F.bit_or("bits").alias("bits"))
    subsets = F.array(*[F.array(*[F.lit(e) for k, e in enumerate(domain) if v >> k & 1]).cast("array<string>") for v in range(1 << len(domain))])
    # A table of all sets that can be asked for: their code is short, however many they are.
    cells = F.array(*[
        F.struct(*[F.lit(v).alias(n) for n, v in (
            ("q_serie", serie), ("task", task), ("action", other or action), ("place", i * width + places[s]),
        )])
        for i, action in enumerate(ACTIONS) for s, (serie, task, other) in CELLS.items()
        if s in (("e1", "e2", "c3", "m4", "star") if action == "zero-shot" else SLOTS)
    ])
    found = F.call_function("shiftright", F.col("bits"), F.col("c.place")).bitwiseAND(F.lit((1 << len(domain)) - 1)).cast("int")
    rows = sets.select("q_id", "dataset", "llm", "bits", F.explode(cells).alias("c")).withColumn("found", found).filter("found != 0")
    return _as_files(rows.select("q_id", "dataset", "llm", F.struct(
        "c.q_serie", "c.task", "c.action", F.element_at(subsets, F.col("found") + 1).alias("answer")
    ).alias("c")))


def wide_answers(spark: SparkSession, root: str) -> DataFrame:
    """Array-valued answers of the nations, with the parts ordered as elements: large sets, in no order.

    Lines are dealt by question, dataset and model once, to parts that grow in number with the tables; sets
    and whatever groups the answers by these columns and others then need no shuffle of their own.  A
    group's lines are one list, from which its sets are taken, so that no line is sorted or hashed by its element.
    """
    lines = order_lines(spark, root, WIDE).select(*GROUP, "element", slot_mask(membership()).alias("mask"))
    dealt = lines.repartition(_dealt_parts(spark, root, 32), "q_id", "dataset", "llm")

    def has(mask: Column, i: int) -> Column:
        return mask.bitwiseAND(F.lit(1 << i)) != 0

    known = F.when(F.col("element").isNotNull(), F.struct("element", "mask"))
    groups = dealt.groupBy(*GROUP).agg(F.bit_or("mask").alias("mask"), F.collect_list(known).alias("lines"))

    def members(i: int) -> Column:
        inside = F.filter("lines", lambda x: has(x["mask"], i))
        return F.array_distinct(F.transform(inside, lambda x: x["element"]))

    return _as_files(groups.select("q_id", "dataset", "llm", _cells(
        lambda i, s: has(F.col("mask"), i), answer=lambda i, s: members(i)
    )))


def questions(spark: SparkSession, root: str, where: str = "true") -> DataFrame:
    """Question table of the customers: ``q_index, Q1..Q4, dataset, lang``."""
    c = load(spark, root, "customer").filter(where)
    return c.select(
        F.col("c_custkey").alias("q_index"),
        *[F.concat(F.lit(f"Q{i}: "), F.col("c_name")).alias(f"Q{i}") for i in range(1, 5)],
        F.col("c_mktsegment").alias("dataset"), F.lit("en").alias("lang"),
    )


# Free-text labels and the canonical label each stands for.
PHRASES = [
    ("Equivalence", "Equivalence"), ("Contains", "Contains"), ("Disjoint", "Disjoint"), ("Overlap", "Overlap"),
    ("ContainedBy", "ContainedBy"), ("contains (q1 ⊃ q2)", "Contains"), ("equivalent", "Equivalence"),
    ("not disjoint", "Overlap"), ("overlaps", "Else"), ("unknown", "Unknown"), ("none", "Unknown"), ("", "Else"),
    ("mutually exclusive", "Disjoint"), ("A ∩ B = ∅", "Disjoint"), ("belongs to", "ContainedBy"),
    ("the same set", "Equivalence"), ("Equivalence", "Equivalence"), ("Contains", "Contains"),
    ("Disjoint", "Disjoint"), (None, "Unknown"),
]


def phrase(index: Column) -> Column:
    """Phrase number ``index``, counted modulo their number."""
    texts = F.array(*[F.lit(p) if p is not None else F.lit(None).cast("string") for p, _ in PHRASES])
    return F.element_at(texts, (index % len(PHRASES) + 1).cast("int"))


RELATION_COLUMNS = ["r_12", "r_13", "r_14", "r_34", "r_134"]


def part_relations(spark: SparkSession, root: str) -> DataFrame:
    """One label row per part: model = brand, dataset = type."""
    p = load(spark, root, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("q_id"), F.col("p_type").alias("dataset"), F.col("p_brand").alias("llm"),
        *[phrase(F.col("p_partkey") + 7 * k + F.col("p_size") * k).alias(c) for k, c in enumerate(RELATION_COLUMNS)],
        F.lit("f").alias("file_path"),
    )


def order_relations(spark: SparkSession, root: str, shift: int = 0) -> DataFrame:
    """One label row per (customer, priority) that occurs in the orders."""
    o = load(spark, root, "orders").select("o_custkey", "o_orderpriority").distinct()
    c = load(spark, root, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_custkey").cast("string").alias("q_id"), F.col("c_mktsegment").alias("dataset"),
        F.col("o_orderpriority").alias("llm"),
        *[
            phrase(F.col("o_custkey") + F.length("o_orderpriority") + 3 * k + shift).alias(c)
            for k, c in enumerate(RELATION_COLUMNS)
        ],
        F.lit("f").alias("file_path"),
    )


# Model names of the order tables, in a fixed order.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def models(spark: SparkSession, root: str) -> DataFrame:
    """Model dimension from the orders: one row per priority with an id and a score."""
    o = load(spark, root, "orders")
    rows = o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first"))
    return rows.select(
        F.col("o_orderpriority").alias("llm"), F.substring("o_orderpriority", 1, 1).cast("int").alias("id"),
        (F.col("n") % 97).cast("double").alias("score"), F.date_format("first", "yyyy-MM-dd").alias("release_date"),
        F.when(F.col("o_orderpriority") < "3", "north").alias("company"),
        F.concat((F.col("n") % 71 + 1).cast("string"), F.lit("b")).alias("size"),
    )
