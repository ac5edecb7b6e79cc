"""N-gram Jaccard join by vertical partitioning of the global n-gram order."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.common import Membership, discarded, written
from accordant.llm.components import components
from accordant.llm.hashing import WordHasher, mixed, set_hash
from accordant.session import bucket_count, in_buckets

SHINGLE = 5
SIMILARITY = (4, 5)  # linked from 4/5 on, as whole numbers
SLOTS = 1 << 20  # counters of the n-gram frequencies, whatever the size of the corpus
SLICE = 1 << 16
FRAGMENTS = 8
BLOCK_ENTRIES = 400_000  # prefix entries of a task's block
ROWS = 250  # texts hashed at once
PACK_ENTRIES, SEEN = 250_000, 200_000  # prefix entries dealt at once, and classes a task remembers having dealt
EARLY = 6  # shared n-grams asked of two sets at the beginning of the order
HOT_ENTRIES = 200_000  # entries of one n-gram beyond which it is dealt to several blocks
HOT_PAIRS, SALTS = 256, 32  # pairs of one class beyond which its set goes to several tasks, and to how many


@dataclass(frozen=True)
class Order:
    """The global n-gram order: by counter level (rare first), then by hash; cut into fragments of like mass."""

    counts: np.ndarray

    def levels(self) -> np.ndarray:
        return np.floor(4 * np.log2(self.counts + 1)).astype(np.uint8)

    def fragments(self) -> tuple[np.ndarray, np.ndarray]:
        """Mass below each level and of it, as shares of all n-grams."""
        mass = np.bincount(self.levels(), self.counts.astype(float), 256)
        mass = mass / max(1.0, mass.sum())
        return np.cumsum(mass) - mass, mass


def _slots(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - 20)).astype(np.int64)


def _fragment(s: np.ndarray, level: np.ndarray, below: np.ndarray, mass: np.ndarray) -> np.ndarray:
    inside = (mixed(s) >> np.uint64(11)).astype(float) / float(1 << 53)
    return np.minimum(FRAGMENTS - 1, ((below[level] + inside * mass[level]) * FRAGMENTS).astype(np.int64))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _narrow(counts: np.ndarray) -> bytes:
    """A slice of counters in the fewest bytes each that hold them."""
    top = int(counts.max(initial=0))
    return counts.astype(next(k for k in ("<u1", "<u2", "<u4", "<u8") if top <= np.iinfo(k).max)).tobytes()


def _widened(raw: bytes) -> np.ndarray:
    """The counters of one slice; their width follows from the length."""
    return np.frombuffer(raw, f"<u{len(raw) // SLICE}").astype(np.int64)


def shingle_classes(docs: DataFrame, key: str, text: str, carried: str | None = None) -> tuple[DataFrame, np.ndarray]:
    """One pass: ``(doc_id, n, cls, carried)`` per row (cls: hash of the set, null when empty), and n-gram counters."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("carried", pa.string()), ("slice", pa.int32()), ("counts", pa.binary()),
    ])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts = WordHasher(), np.zeros(SLOTS, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                n, cls, held = [], [], []
                for s in hasher.shingle_sets(part.column(1), SHINGLE):
                    n.append(len(s))
                    cls.append(set_hash(s) if len(s) else None)
                    held.append(s)
                counts += np.bincount(_slots(np.concatenate(held)), minlength=SLOTS)
                none = pa.nulls(part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), part.column(2), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema
                )
        for i in range(SLOTS // SLICE):
            one = counts[i * SLICE:(i + 1) * SLICE]
            if one.any():
                yield pa.RecordBatch.from_pylist(
                    [{"doc_id": None, "n": None, "cls": None, "carried": None, "slice": i, "counts": _narrow(one)}], schema=schema
                )

    more = F.col(carried).cast("string") if carried else F.lit(None).cast("string")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), more.alias("carried"))
    out = written(rows.mapInArrow(scan, "doc_id long, n long, cls long, carried string, slice int, counts binary"), "shingles")

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(SLICE, np.int64)
        for c in t.column("counts"):
            total += _widened(c.as_py())
        return pa.table({"slice": t.column("slice")[:1], "counts": pa.array([_narrow(total)], pa.binary())})

    # Added up in two steps, so that no task reads a counter row of every scan task.
    parts = out.filter("slice is not null").select("slice", "counts", F.pmod(F.spark_partition_id(), F.lit(64)).alias("part"))
    some = parts.groupBy("slice", "part").applyInArrow(add, "slice int, counts binary")
    counts = np.zeros(SLOTS, np.int64)
    for r in some.groupBy("slice").applyInArrow(add, "slice int, counts binary").collect():  # SLOTS numbers in all
        counts[r.slice * SLICE:(r.slice + 1) * SLICE] = _widened(r.counts)
    return out.filter("slice is null").select("doc_id", "n", "cls", "carried"), counts


def prefix_entries(docs: DataFrame, text: str, order: Order) -> DataFrame:
    """Rows ``(block, hot, s, c, n, p)`` of packed arrays: the prefix n-grams of each set and their places, dealt by n-gram.

    Sets of similarity t share an n-gram among the first n - ceil(t n) + 1 of the global order.  Copies
    that a task still remembers are packed once; an n-gram with very many sets is dealt to several blocks.
    """
    p, q = SIMILARITY
    entries = int(order.counts.sum() * (q - p) / q) + 1
    blocks = max(1, -(-entries // BLOCK_ENTRIES))
    broadcast = docs.sparkSession.sparkContext.broadcast(order.counts)
    schema = pa.schema([("block", pa.int64()), ("hot", pa.bool_()), ("s", pa.binary()), ("c", pa.binary()), ("n", pa.binary()), ("p", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held = WordHasher(), Order(broadcast.value)
        levels, usual = held.levels(), int(4 * held.counts.mean())
        parts: list[tuple[np.ndarray, int, int]] = []

        def rows() -> Iterator[pa.RecordBatch]:
            s = np.concatenate([x[0] for x in parts])
            sizes = [len(x[0]) for x in parts]
            c = np.repeat(np.array([x[1] for x in parts], np.int64), sizes)
            n = np.repeat(np.array([x[2] for x in parts], np.int64), sizes)
            place = np.concatenate([np.arange(k, dtype=np.int64) for k in sizes])
            salts = 1 + np.maximum(0, held.counts[_slots(s)] - usual) // HOT_ENTRIES
            salt = mixed(c.view(np.uint64)) % salts.astype(np.uint64)
            block = (mixed(s ^ np.uint64(0x5851F42D4C957F2D)) + salt) % np.uint64(blocks)
            where = block.astype(np.int64) * 2 + (salts > 1)
            by = np.argsort(where, kind="stable")
            cuts = np.flatnonzero(np.r_[True, where[by][1:] != where[by][:-1], True])
            got = []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                at = by[lo:hi]
                w = int(where[at[0]])
                got.append({"block": w // 2, "hot": bool(w % 2), "s": s[at].tobytes(), "c": c[at].tobytes(), "n": n[at].astype(np.int32).tobytes(), "p": place[at].astype(np.int32).tobytes()})
            parts.clear()
            for lo in range(0, len(got), 256):
                yield pa.RecordBatch.from_pylist(got[lo:lo + 256], schema=schema)

        size, seen = 0, set()
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                for s in hasher.shingle_sets(b.slice(lo, ROWS).column(0), SHINGLE):
                    if not len(s):
                        continue
                    c = set_hash(s)
                    if c in seen:
                        continue
                    seen.add(c)
                    take = len(s) - (p * len(s) + q - 1) // q + 1
                    first = s[np.lexsort((s, levels[_slots(s)]))[:take]]
                    parts.append((first, c, len(s)))
                    size += take
                    if size > PACK_ENTRIES:
                        yield from rows()
                        size = 0
                    if len(seen) > SEEN:
                        seen.clear()
        if parts:
            yield from rows()

    packed = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(pack, "block long, hot boolean, s binary, c binary, n binary, p binary")
    wide = max(1, min(blocks, 100_000))
    return packed.repartition(wide, "block")


def shared_needed(nx, ny, least):
    """How many n-grams sets of these sizes must share at early places, and how late those places may be.

    With ``need`` common n-grams, n - need of a set are not, so of its first n - need + l at least l are
    common.  ``l`` is at most ``EARLY``, and as the prefixes of both sets allow.
    """
    p, q = SIMILARITY
    up = (lambda x, y: (x + y - 1) // y) if isinstance(nx, np.ndarray) else (lambda x, y: F.floor((x + y - 1) / y))
    need = up(p * (nx + ny), p + q)
    length = lambda n: n - up(p * n, q) + 1
    early = least(least(length(nx) - nx + need, length(ny) - ny + need), nx * 0 + EARLY)
    return need, early


def close_enough(nx, ny, i, j, least, greatest):
    """Whether sets of sizes ``nx``, ``ny`` with a common n-gram at places ``i``, ``j`` can reach the similarity.

    The n-gram must be at an early place of both, and no more are common than lie before and after.
    """
    p, q = SIMILARITY
    need, early = shared_needed(nx, ny, least)
    room = least(i, j) + 1 + least(nx - i - 1, ny - j - 1)
    return (least(nx, ny) * q >= greatest(nx, ny) * p) & (i < nx - need + early) & (j < ny - need + early) & (room >= need)


def first_in_common(nx, ny, i, j, least, greatest):
    """Whether places ``i``, ``j`` can be those of the first common n-gram of two sets that reach the similarity.

    All other common n-grams come later in both, so ``need`` of them must fit there.
    """
    p, q = SIMILARITY
    need, _ = shared_needed(nx, ny, least)
    return (least(nx, ny) * q >= greatest(nx, ny) * p) & (i <= nx - need) & (j <= ny - need)


def may_meet(group: np.ndarray, n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which entries can be the first common n-gram with any other of their group.

    The smallest set of the group that is large enough asks for the fewest common n-grams, so an entry
    too late for that one is too late for all.  Groups are numbered and hold all their entries.
    """
    p, q = SIMILARITY
    by = np.lexsort((n, group))
    wide = int(n.max(initial=0)) + 1
    keys = group[by] * wide + n[by]
    at = np.searchsorted(keys, group[by] * wide + (p * n[by] + q - 1) // q)
    own = np.arange(len(by))
    at = np.where(at == own, own + 1, at)
    there = at < len(by)
    at = np.minimum(at, max(0, len(by) - 1))
    there &= group[by][at] == group[by]
    other = n[by][at]
    need, _ = shared_needed(n[by], other, np.minimum)
    out = np.zeros(len(by), bool)
    out[by] = there & (p * other <= q * n[by]) & (place[by] <= n[by] - need)
    return out


def shared_entries(packed: DataFrame) -> DataFrame:
    """What n-grams that several sets hold say, as rows ``(kind, a, b, n, p)``, at most two per entry.

    2: a pair of classes (a, b) and how many n-grams it shares, of each set and the one in which the
    n-gram comes first (of copies with edits, the least edited).  0: the entries (a: n-gram, b: class,
    n: size, p: place) that can be a first common n-gram, from which the other pairs come where they matter.
    """

    def block(t: pa.Table) -> pa.Table:
        read = lambda c, k: np.frombuffer(b"".join(t.column(c).to_pylist()), k)
        hot = t.column("hot")[0].as_py()
        s, c, n, place = read("s", np.uint64), read("c", np.int64), read("n", np.int32).astype(np.int64), read("p", np.int32).astype(np.int64)
        by = np.lexsort((c, place, s))
        s, c, n, place = s[by], c[by], n[by], place[by]
        new = np.r_[True, (s[1:] != s[:-1]) | (c[1:] != c[:-1])]  # a set packed by several tasks
        s, c, n, place = s[new], c[new], n[new], place[new]
        cuts = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True])
        size = np.repeat(np.diff(cuts), np.diff(cuts))
        shared = np.flatnonzero((size > 1) | hot)
        met = shared if hot else shared[may_meet(np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))[shared], n[shared], place[shared])]
        head = np.repeat(cuts[:-1], np.diff(cuts))[shared]
        x, y = head[head != shared], shared[head != shared]
        near = close_enough(n[x], n[y], place[x], place[y], np.minimum, np.maximum)
        a, b = c[x[near]], c[y[near]]
        pair, times = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0, return_counts=True)
        return pa.table({
            "kind": np.repeat(np.array([0, 2], np.int32), [len(met), len(pair)]), "a": np.r_[_signed(s[met]), pair[:, 0]],
            "b": np.r_[c[met], pair[:, 1]], "n": np.r_[n[met], times], "p": np.r_[place[met], np.zeros(len(pair), np.int64)],
        })

    return packed.groupBy("block", "hot").applyInArrow(block, "kind int, a long, b long, n long, p long")


def segments(docs: DataFrame, key: str, text: str, wanted: DataFrame, order: Order) -> DataFrame:
    """``(cls, fragment, part, sizes)``: the sets of wanted classes cut by the fragments of the global order.

    ``sizes`` has the sizes of all fragments of the set.

    ``wanted`` has (doc_id, cls), one document per class; a bounded filter spares other texts.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(order.counts)
    schema = pa.schema([("cls", pa.int64()), ("fragment", pa.int32()), ("part", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held = WordHasher(), Order(broadcast.value)
        levels, (below, mass) = held.levels(), held.fragments()
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                cls, fragment, part, sizes = [], [], [], []
                for s in hasher.shingle_sets(b.slice(lo, ROWS).column(0), SHINGLE):
                    if len(s):
                        f = _fragment(s, levels[_slots(s)], below, mass)
                        c, n = set_hash(s), np.bincount(f, minlength=FRAGMENTS)
                        for i in np.flatnonzero(n):
                            cls.append(c)
                            fragment.append(i)
                            part.append(_signed(s[f == i]))
                            sizes.append(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cls, pa.int64()), pa.array(fragment, pa.int32()), pa.array(part, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int64()))], schema=schema
                )

    ids = wanted.select(F.xxhash64("doc_id").alias("h"))
    rows = docs.select(F.xxhash64(F.col(key).cast("long")).alias("h"), F.col(text).cast("string").alias("text"))
    hit = Membership(ids, "h", wanted.count()).mark(rows, "h", "hit").filter("hit").select("text")
    cuts = hit.mapInArrow(cut, "cls long, fragment int, part array<long>, sizes array<long>")
    # Dealt once by class and fragment, so the joins that follow move only the pairs.
    n = bucket_count(docs.sparkSession)
    known = wanted.select("cls", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("fragment"))
    one = cuts.repartition(n, "cls", "fragment").join(known, ["cls", "fragment"], "left_semi")
    one = one.dropDuplicates(["cls", "fragment"])  # a text that passed the filter twice
    return in_buckets(one, "segments", ["cls", "fragment"], n)


def verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, classes: DataFrame, order: Order) -> DataFrame:
    """Pairs ``(a, b)`` that reach the similarity: overlaps counted per fragment, summed per pair.

    A pair's largest fragment is counted first; the others only where the sum can still be enough,
    as each can add no more than the smaller of its two parts.
    """
    ends = written(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes, "cls"), "wanted")
    sets = segments(docs, key, text, ends, order)
    parts = lambda c, name: sets.select(F.col("cls").alias(c), "fragment", F.col("part").alias(name))
    sizes = sets.select("cls", "sizes").dropDuplicates(["cls"])
    sized = pairs.select("a", "b").join(sizes.select(F.col("cls").alias("a"), F.col("sizes").alias("sa")), "a")
    sized = sized.join(sizes.select(F.col("cls").alias("b"), F.col("sizes").alias("sb")), "b")
    p, q = SIMILARITY
    sized = sized.withColumns({
        "least": F.zip_with("sa", "sb", lambda x, y: F.least(x, y)), "both": F.expr("aggregate(zip_with(sa, sb, (x, y) -> x + y), 0L, (x, y) -> x + y)"),
    }).withColumn("fragment", (F.array_position("least", F.array_max("least")) - 1).cast("int"))
    sized = sized.filter(F.expr(f"{p + q} * aggregate(least, 0L, (x, y) -> x + y) >= {p} * both")).drop("sa", "sb")

    often = pairs.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    often = written(often.filter(F.col("n") > HOT_PAIRS).select("cls"), "often")

    copies = written(
        sets.join(often, "cls", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select("cls", "fragment", "part", "salt"),
        "copies",
    )
    for c in ("a", "b"):
        sized = sized.join(often.select(F.col("cls").alias(c), F.lit(True).alias(f"often_{c}")), c, "left")
    flags = {f"often_{c}": F.coalesce(f"often_{c}", F.lit(False)) for c in ("a", "b")}
    sized = written(sized.withColumns(flags), "sized")

    def with_part(some: DataFrame, c: str, name: str) -> DataFrame:
        """Pairs with a set's fragment; the set of a class in very many pairs is copied, and its pairs are dealt over the copies."""
        usual = some.filter(f"not often_{c}").join(parts(c, name), [c, "fragment"])
        salted = some.filter(f"often_{c}").withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.lit(SALTS)).cast("int"))
        own = copies.select(F.col("cls").alias(c), "fragment", F.col("part").alias(name), "salt")
        return usual.unionByName(salted.join(own, [c, "fragment", "salt"]).drop("salt"))

    def counted(some: DataFrame) -> DataFrame:
        two = with_part(with_part(some, "a", "pa"), "b", "pb")
        return two.withColumn("k", F.size(F.array_intersect("pa", "pb")).cast("long")).drop("pa", "pb")

    room = F.expr(f"{p + q} * (k + aggregate(least, 0L, (x, y) -> x + y) - least[fragment]) >= {p} * both")
    lead = written(counted(sized).filter(room), "lead")
    others = lead.select("a", "b", "often_a", "often_b", F.posexplode("least").alias("at", "n"), F.col("fragment").alias("counted_at")).filter("n > 0 and at <> counted_at")
    others = counted(others.select("a", "b", "often_a", "often_b", F.col("at").alias("fragment"))).groupBy("a", "b").agg(F.sum("k").alias("more"))
    total = lead.join(others, ["a", "b"], "left")
    links = written(total.filter(F.expr(f"{p + q} * (k + coalesce(more, 0L)) >= {p} * both")).select("a", "b"), "links")
    discarded(sets, copies, ends, often, sized, lead)
    return links


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", carried: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable by links).

    Two documents link when their sets of five-word shingles (A-Z lower-cased) have a Jaccard
    similarity of 4/5 or more.  Documents with fewer words have their whole sequence as one shingle;
    empty and null texts have none, link with nothing and are their own component.  Equal sets are
    one class, so copies are not compared with each other.  A row with a null id takes part, and its
    component is the smallest id of the others (null when alone); rows that repeat an id are rows of
    their own.  Other columns are not read; an empty table gives no rows.

    With ``carried``, that column comes along as text, and ``part`` numbers the component.

    Candidates share n-grams among the rarest of both sets (prefix filter over a global order by
    counted frequency), at places that leave room for the similarity.  First each class is compared
    with the head of an n-gram with which it shares most, and the links make components.  Then pairs of
    different components meet at the first n-gram that they can have in common, and are compared.
    Components are so exact without all pairs of a group.  Comparing means joining the sets fragment
    by fragment of the global order and summing the overlaps per pair.
    """
    rows, counts = shingle_classes(docs, key, text, carried)
    order = Order(counts)
    classes = written(rows.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")), "classes")
    shared = written(shared_entries(prefix_entries(docs, text, order)), "entries")
    entries = shared.filter("kind = 0").select(F.col("a").alias("s"), F.col("b").alias("cls"), "n", "p")
    pairs = written(shared.filter("kind = 2").groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    # The partner with which a class shares most, of smaller or larger id; ties go to the smaller.
    ways = pairs.select("n", F.explode(F.array(F.struct(F.col("a").alias("of"), F.col("b").alias("with")), F.struct(F.col("b").alias("of"), F.col("a").alias("with")))).alias("w"))
    best = ways.groupBy("w.of").agg(F.max(F.struct("n", F.negative("w.with").alias("with"))).alias("m"))
    with_ = F.negative(F.col("m.with"))
    first = written(best.select(F.least("of", with_).alias("a"), F.greatest("of", with_).alias("b")).distinct(), "first")
    discarded(pairs)
    links = verified(first, docs, key, text, classes, order)
    parts = written(components(links).select(F.col("node").alias("cls"), F.col("component_id").alias("part")), "parts")
    parted = written(entries.join(parts, "cls", "left").withColumn("part", F.coalesce("part", "cls")), "entries-parted")
    discarded(shared)
    # Only n-grams that still hold several components are joined with themselves.
    split = parted.groupBy("s").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi").select("s")
    held = written(parted.join(split, "s"), "entries-split")
    rest = written(_across(held).join(first, ["a", "b"], "left_anti"), "rest")
    discarded(parted, held, first)
    links = links.union(verified(rest, docs, key, text, classes, order))
    parts = written(components(links), "components")
    member = classes.join(parts, F.col("cls") == F.col("node"), "left").select("cls", "doc_id", F.coalesce("component_id", "cls").alias("part"))
    least = member.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    ids = written(member.join(least, "part").select("cls", "component_id", "part"), "member")
    out = rows.join(ids, "cls", "left")
    more = [F.col("carried").alias(carried), "part"] if carried else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *more)


def _across(left: DataFrame) -> DataFrame:
    """Pairs of classes in different components that may have their first common n-gram here."""
    # Of two different components, one at least is not the n-gram's largest: only its sets start a pair.
    held = left.groupBy("s", "part").agg(F.count(F.lit(1)).alias("k"))
    largest = held.groupBy("s").agg(F.max(F.struct("k", "part"))["part"].alias("largest"))
    rows = written(left.join(largest, "s").withColumn("main", F.col("part") == F.col("largest")).drop("largest"), "headed")
    side = lambda some, names: some.select(*[F.col(x).alias(y) for x, y in zip(("s", "cls", "n", "p", "part", "main"), names)])
    x, y = side(rows.filter("not main"), ("s", "a", "na", "i", "pa", "ma")), side(rows, ("t", "b", "nb", "j", "pb", "mb"))
    near = first_in_common(F.col("na"), F.col("nb"), F.col("i"), F.col("j"), F.least, F.greatest)
    once = F.col("mb") | (F.col("a") < F.col("b"))
    met = x.join(y, (F.col("s") == F.col("t")) & (F.col("pa") != F.col("pb")) & once & near)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
