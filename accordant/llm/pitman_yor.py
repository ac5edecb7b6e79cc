"""Language-model scores from a hierarchical Pitman-Yor process, seated by Gibbs sampling in shards."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.common import discarded, fold, written
from accordant.llm.hashing import WordHasher, mixed
from accordant.session import bucket_count, in_buckets

FOLDS = 10
CONTEXTS = 1 << 16  # context restaurants whose totals one task adds up, about; there are as many as distinct preceding words
START, END = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543211)
CHUNK_TOKENS = 1 << 19  # tokens of a run of documents that asks for its probabilities at once
SHARD_TOKENS = 1_000_000  # tokens of a shard of dishes, about
TOKEN_BYTES = 6
HOT_WORDS = 256  # words that are dealt over all shards by context, at most
HOT_SAMPLE = 2_000  # documents from which they are guessed
BURN_IN, SAMPLES = 2, 3
DISCOUNT, STRENGTH = 0.75, 2.0  # of context restaurants
TOP_DISCOUNT, TOP_STRENGTH = 0.6, 20.0  # of the restaurant they share as parent


@dataclass
class Chunk:
    """A run of documents as indices into its distinct (word, context) pairs, sorted by shard, word and context."""

    shard: np.ndarray  # per word
    words: np.ndarray
    runs: np.ndarray  # pairs per word
    contexts: np.ndarray  # per pair
    counts: np.ndarray  # training tokens per pair
    index: np.ndarray  # pair per token


def distinct_pairs(words: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and contexts of the distinct pairs, sorted, and the pair of each row."""
    w, which = np.unique(words, return_inverse=True)
    c, where = np.unique(contexts, return_inverse=True)
    pairs, index = np.unique((which.astype(np.uint64) << np.uint64(32)) | where.astype(np.uint64), return_inverse=True)
    return w[(pairs >> np.uint64(32)).astype(np.int64)], c[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)], index


def pair_keys(words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    return mixed(words ^ (contexts + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25))


def packed(**arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; the bytes of a place in the numbers are put together, which compresses well."""
    raw = pickle.dumps({k: (a.dtype.str, a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()) for k, a in arrays.items()})
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(value: bytes) -> dict[str, np.ndarray]:
    raw = pickle.loads(pa.decompress(value[8:], int.from_bytes(value[:8], "little"), "zstd", asbytes=True))
    arrays = {}
    for k, (kind, data) in raw.items():
        width = np.dtype(kind).itemsize
        arrays[k] = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)
    return arrays


def chunk_of(hashes: np.ndarray, at: np.ndarray, trained: np.ndarray, shards: int, hot: np.ndarray) -> Chunk:
    """``at``: first word of each document (and the end); an end token is added to every document."""
    docs = len(at) - 1
    n = len(hashes) + docs
    ends = at[1:] + np.arange(docs)
    inside = np.ones(n, bool)
    inside[ends] = False
    words = np.full(n, END, np.uint64)
    words[inside] = hashes
    before = np.empty(n, np.uint64)
    before[1:] = words[:-1]
    before[np.r_[0, ends[:-1] + 1]] = START
    seen = np.repeat(trained, np.diff(at) + 1)
    pw, pc, index = distinct_pairs(words, before)
    counts = np.bincount(index, seen, len(pw)).astype(np.int64)
    spread = np.isin(pw, hot)
    key = np.where(spread, pair_keys(pw, pc), mixed(pw))
    shard = (key % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((pc, pw, shard))
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    shard, pw, pc, counts = shard[order], pw[order], pc[order], counts[order]
    first = np.flatnonzero(np.r_[True, (pw[1:] != pw[:-1]) | (shard[1:] != shard[:-1])])
    runs = np.diff(np.r_[first, len(pw)])
    return Chunk(shard[first], pw[first], runs, pc, counts, back[index])


def _chunks(batches: Iterator[pa.RecordBatch], shards: int, hot: np.ndarray) -> Iterator[tuple[int, pa.Array, Chunk, np.ndarray]]:
    """Chunks of a partition in order: id, document ids, chunk, tokens per document.  Columns: part, doc_id, trained, text."""
    hasher, held, tokens, number = WordHasher(), [], 0, 0

    def close() -> tuple[int, pa.Array, Chunk, np.ndarray]:
        sizes = np.concatenate([np.diff(at) for _, _, _, at, _ in held])
        chunk = chunk_of(np.concatenate([h for _, _, h, _, _ in held]), np.r_[0, np.cumsum(sizes)], np.concatenate([t for _, t, _, _, _ in held]), shards, hot)
        return (held[0][4] << 33) + number, pa.concat_arrays([d for d, *_ in held]), chunk, sizes + 1

    for b in batches:
        for lo in range(0, b.num_rows, 500):
            part = b.slice(lo, 500)
            hashes, at = hasher.words(part.column(3))
            held.append((part.column(1), part.column(2).to_numpy(zero_copy_only=False), hashes, at, part.column(0)[0].as_py()))
            tokens += len(hashes)
            if tokens >= CHUNK_TOKENS:
                yield close()
                held, tokens, number = [], 0, number + 1
    if held:
        yield close()


def _narrow(x: np.ndarray) -> tuple[bytes, bytes]:
    """Numbers below 2**32 as low and high halves, which compress well apart."""
    x = x.astype(np.uint32)
    return (x & np.uint32(0xFFFF)).astype(np.uint16).tobytes(), (x >> np.uint32(16)).astype(np.uint16).tobytes()


def _wide(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, np.uint16).astype(np.int64) | (np.frombuffer(high, np.uint16).astype(np.int64) << 16)


class Draws:
    """Random numbers that hang on the key of a dish and the sweep alone, so no dealing of dishes changes them."""

    def __init__(self, keys: np.ndarray, sweep: int):
        self.keys = mixed(keys + np.uint64((sweep + 1) * 0xA0761D6478BD642F % (1 << 64)))

    def binomial(self, of: np.ndarray, first: int, times: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Successes of customers ``first``, ``first`` + 1, ... of the dishes ``of``, one number per customer."""
        hits, most = np.zeros(len(of), np.int64), int(times.max())
        keys, width = self.keys[of][:, None], max(1, (1 << 18) // len(of))
        for lo in range(0, most, width):
            k = np.arange(lo, min(lo + width, most))
            u = (mixed(keys + (k + first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) * 2.0**-53
            hits += ((u < p[:, None]) & (k < times[:, None])).sum(1)
        return hits


def reseat(customers: np.ndarray, rate: np.ndarray, discount: float, rng: np.random.Generator | Draws, slope: np.ndarray | float = 0.0) -> np.ndarray:
    """Tables of each dish after its customers are seated anew, one by one, given the rest of the restaurant.

    ``rate``: weight of a new table, (strength + discount * tables) * parent probability, without the
    tables of the dish itself; ``slope`` is what each of those adds to it.  The first customers are
    seated singly; later ones in runs that grow with the number seated.
    """
    tables = np.minimum(customers, 1).astype(np.float64)
    slope = np.broadcast_to(slope, rate.shape)
    live = np.flatnonzero(customers > 1)
    i = 1
    while len(live):
        step = 1 if i < 48 else max(1, i // 8)
        t = tables[live]
        r = rate[live] + slope[live] * t
        some = np.minimum(step, customers[live] - i)
        p = r / (r + np.maximum(i + (some - 1) / 2 - discount * t, 1e-9))
        some, p = some.astype(np.int64), np.minimum(p, 1.0)
        tables[live] = t + (rng.binomial(live, i, some, p) if isinstance(rng, Draws) else rng.binomial(some, p))
        i += step
        live = live[customers[live] > i]
    return np.minimum(tables, customers)


@dataclass
class Seating:
    """A shard's dishes with training counts, and one seating per kept sample."""

    words: np.ndarray
    word_of: np.ndarray  # per pair
    contexts: np.ndarray  # per pair: index into the shard's contexts
    counts: np.ndarray
    tables: list[np.ndarray]  # per sample and pair
    top: list[np.ndarray]  # per sample and word: tables in the parent restaurant


@dataclass
class Sums:
    """What all shards add up to for one seating, besides the totals per context."""

    tokens: int
    words: int
    customers: int  # of the parent restaurant
    tables: int  # of the parent restaurant
    hot: np.ndarray
    hot_counts: np.ndarray
    hot_customers: np.ndarray
    hot_tables: np.ndarray


class Shard:
    """Dishes of one shard while they are seated; ``fixed``: per word, dishes of one customer that are left out."""

    def __init__(self, words, word_of, contexts, counts, ids, hot, tables=None, top=None, fixed=0):
        self.fixed = fixed
        self.words, self.word_of, self.contexts, self.counts, self.ids = words, word_of, contexts, counts, ids
        self.at = np.minimum(np.searchsorted(hot, words), max(0, len(hot) - 1))
        self.spread = hot[self.at] == words if len(hot) else np.zeros(len(words), bool)
        self.at = self.at[self.spread]
        self.tables = np.minimum(counts, 1) if tables is None else tables
        self.top = np.minimum(self.served(), 1) if top is None else top

    def served(self) -> np.ndarray:
        return np.bincount(self.word_of, self.tables, len(self.words)).astype(np.int64) + self.fixed

    def per_context(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.contexts, v, len(self.ids)).astype(np.int64)

    def part(self, hot: np.ndarray) -> np.ndarray:
        """What this shard adds to the sums."""
        known, served = np.bincount(self.word_of, self.counts, len(self.words)) + self.fixed, self.served()
        by_hot = np.zeros((2, len(hot)), np.int64)
        by_hot[0, self.at], by_hot[1, self.at] = known[self.spread], served[self.spread]
        return np.r_[int(known.sum()), (known[~self.spread] > 0).sum(), served.sum(), self.top[~self.spread].sum(), by_hot.ravel()].astype(np.int64)

    def sweep(self, context_tables: np.ndarray, sums: Sums, number: int) -> None:
        """Seat every dish anew, given the exact totals of all shards after the sweep before."""
        served, top = self.served(), self.top.copy()
        served[self.spread], top[self.spread] = sums.hot_customers[self.at], sums.hot_tables[self.at]
        # The dish's own tables leave its context and the parent before it is seated.
        others, held = served[self.word_of] - self.tables, top[self.word_of]
        left = np.minimum(held, others)
        lowest = (TOP_STRENGTH + TOP_DISCOUNT * (sums.tables - held + left)) / (sums.words + 1)
        parent = (others - TOP_DISCOUNT * left + lowest) / (TOP_STRENGTH + sums.customers - self.tables)
        rate = (STRENGTH + DISCOUNT * (context_tables[self.contexts] - self.tables)) * parent
        draws = Draws(pair_keys(self.words[self.word_of], self.ids[self.contexts]), number)
        self.tables = reseat(self.counts, rate, DISCOUNT, draws, DISCOUNT * parent).astype(np.int64)
        self.top = seat_top(self.words, self.served(), top, sums.tables, sums.words, number)


def seat_top(words: np.ndarray, served: np.ndarray, top: np.ndarray, tables: int, known: int, number: int) -> np.ndarray:
    """Tables of words in the parent restaurant; ``served`` and ``top`` are those of all shards."""
    rate = (TOP_STRENGTH + TOP_DISCOUNT * (tables - top)) / (known + 1)
    return reseat(served, rate, TOP_DISCOUNT, Draws(words, number), TOP_DISCOUNT / (known + 1)).astype(np.int64)


def summed(part: np.ndarray, hot: np.ndarray, before: Sums | None, number: int) -> Sums:
    """Sums from the added parts of all shards; words that are dealt over shards are seated in the parent here."""
    counts, served = part[4:].reshape(2, len(hot))
    if before is None:
        top = np.minimum(served, 1)
    else:
        top = seat_top(hot, served, before.hot_tables, before.tables, before.words, number)
    return Sums(int(part[0]), int(part[1] + (counts > 0).sum()), int(part[2]), int(part[3] + top.sum()), hot, counts, served, top)


def seat(words: np.ndarray, word_of: np.ndarray, contexts: np.ndarray, counts: np.ndarray, shards: int, hot: np.ndarray, seed: int, ids: np.ndarray | None = None) -> Seating:
    """All sweeps over the pairs of a corpus of one shard, where no total needs another task.

    ``contexts`` are indices into ``ids`` (themselves the ids when there are none); ``seed`` is the
    number of the first sweep.
    """
    if shards != 1:
        raise ValueError("several shards are seated in rounds, see score_texts")
    if ids is None:
        ids = np.arange(int(contexts.max(initial=-1)) + 1).astype(np.uint64)
    shard, sums = Shard(words, word_of, contexts, counts, ids, hot), None
    out = Seating(words, word_of, contexts, counts, [], [])
    for sweep in range(seed, seed + BURN_IN + SAMPLES):
        sums = summed(shard.part(hot), hot, sums, sweep - 1)
        shard.sweep(shard.per_context(shard.tables), sums, sweep)
        if sweep - seed >= BURN_IN:
            out.tables.append(shard.tables)
            out.top.append(shard.top)
    return out


@dataclass
class Totals:
    """What all shards add up to, for the contexts of one shard."""

    tokens: int  # N
    words: int  # V
    context_counts: np.ndarray
    context_tables: np.ndarray  # per sample
    customers: np.ndarray  # per sample: of the parent restaurant
    tables: np.ndarray  # per sample: of the parent restaurant
    hot: np.ndarray
    hot_counts: np.ndarray
    hot_customers: np.ndarray  # per sample
    hot_tables: np.ndarray


def totals_of(sums: list[Sums], context_counts: np.ndarray, context_tables: list[np.ndarray]) -> Totals:
    s = sums[-1]
    return Totals(
        s.tokens, s.words, context_counts, np.array(context_tables), *(np.array([getattr(x, f) for x in sums]) for f in ("customers", "tables")),
        s.hot, s.hot_counts, *(np.array([getattr(x, f) for x in sums]) for f in ("hot_customers", "hot_tables")),
    )


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Tokens are the words (A-Z lower-cased) and one end per text; a null text is empty and has the end
    alone.  Documents whose id's CRC-32 leaves a remainder by ten are learned from, all of them.
    ``base_score`` is the unigram score with 0.1 added to each count, ``score`` the log10 probability
    under the Pitman-Yor model, its predictive probabilities averaged over the samples.  A null id
    counts as the empty text in the fold; rows that repeat an id are documents of their own; without
    training documents every token is unknown and the model is uniform.  Other columns are not read;
    an empty table gives no rows.  ``docs`` must be a stable scan (a table, not an unordered shuffle):
    it is read twice, and runs of documents are matched by checked ids.

    There is a context restaurant for every preceding word (by its 64-bit hash); they share one parent
    restaurant over all words.  Runs of documents ask for the probabilities of their distinct (word,
    context) pairs, and hand in their training counts with the question.  Shards of words add the
    counts up, sample the seating, and answer; words so frequent that they would fill a shard are dealt
    by context.  After each sweep the customers and tables of every context are added up over all
    shards, by context, and sent back to the shards that hold the context.
    """
    spark = docs.sparkSession
    trained = fold(F.col(key)) % FOLDS != 0
    rows = docs.select(
        F.spark_partition_id().alias("part"), F.col(key).cast("long").alias("doc_id"), trained.alias("trained"), F.col(text).cast("string").alias("text")
    )
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first()
    shards = max(1, math.ceil((size.bytes / TOKEN_BYTES + size.n) / SHARD_TOKENS))
    hot = frequent_words(rows, size.n, shards)
    homes = max(1, math.ceil(shards * SHARD_TOKENS / (16 * CONTEXTS)))
    request = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("body", pa.binary())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, c, _ in _chunks(batches, shards, hot):
            cuts = np.flatnonzero(np.r_[True, c.shard[1:] != c.shard[:-1], True]) if len(c.shard) else []
            pairs = np.r_[0, np.cumsum(c.runs)]
            got = []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                a, b = pairs[lo], pairs[hi]
                got.append({"shard": int(c.shard[lo]), "chunk": number, "body": _asked(c.words[lo:hi], c.runs[lo:hi], c.contexts[a:b], c.counts[a:b])})
                if len(got) == 64:
                    yield pa.RecordBatch.from_pylist(got, schema=request)
                    got = []
            if got:
                yield pa.RecordBatch.from_pylist(got, schema=request)

    def gather(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        parts = [_heard(x) for x in t.column("body").to_pylist()]
        whole = {k: np.concatenate([p[k] for p in parts]) for k in ("words", "runs", "contexts", "counts")}
        pw, pc, place = distinct_pairs(np.repeat(whole["words"], whole["runs"]), whole["contexts"])
        counts = np.bincount(place, whole["counts"], len(pw)).astype(np.int64)
        words, runs = np.unique(pw, return_counts=True)
        ids, at = np.unique(pc, return_inverse=True)
        order = np.lexsort((ids, ids % np.uint64(homes)))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return pa.table({
            "shard": t.column("shard")[:1],
            "seats": pa.array([packed(words=words, runs=runs, contexts=back[at], counts=counts, ids=ids[order])], pa.binary()),
            "requests": pa.array([packed(chunks=t.column("chunk").to_numpy(), sizes=np.array([len(p["contexts"]) for p in parts]), steps=np.diff(place, prepend=0))], pa.binary()),
        })

    asked = _by_shard(rows.mapInArrow(ask, "shard long, chunk long, body binary").groupBy("shard").applyInArrow(gather, "shard long, seats binary, requests binary"), "requests")
    scored_pairs, sums = _seated(asked.select("shard", "seats"), shards, homes, hot)
    answer = pa.schema([("chunk", pa.int64()), ("shard", pa.int64()), ("scores", pa.binary()), ("known", pa.binary())])

    def reply(left: pa.Table, right: pa.Table) -> pa.Table:
        request, pairs = unpacked(left.column("requests")[0].as_py()), unpacked(right.column("scores")[0].as_py())
        place, at = np.cumsum(request["steps"]), np.r_[0, np.cumsum(request["sizes"])]
        word_of = np.repeat(np.arange(len(pairs["runs"])), pairs["runs"])
        out = []
        for number, lo, hi in zip(request["chunks"], at[:-1], at[1:]):
            word = word_of[place[lo:hi]]
            seen = pairs["known"][word[np.r_[True, word[1:] != word[:-1]]]]
            out.append({"chunk": int(number), "shard": left.column("shard")[0].as_py(), "scores": pairs["logs"][place[lo:hi]].tobytes(), "known": packed(known=seen)})
        return pa.Table.from_pylist(out, schema=answer)

    replies = asked.select("shard", "requests").groupBy("shard").cogroup(scored_pairs.groupBy("shard")).applyInArrow(
        reply, "chunk long, shard long, scores binary, known binary"
    )
    sheet = pa.schema([("chunk", pa.int64()), ("docs", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("sizes", "low", "high", "runs", "runs_high")]])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, c, sizes in _chunks(batches, shards, hot):
            low, high = _narrow(c.index)
            runs, runs_high = _narrow(c.runs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                 *[pa.array([x], pa.binary()) for x in (sizes.astype(np.int64).tobytes(), low, high, runs, runs_high)]], schema=sheet,
            )

    sheets = rows.mapInArrow(keep, "chunk long, docs array<long>, sizes binary, low binary, high binary, runs binary, runs_high binary")
    sheets = in_buckets(sheets, "sheets", ["chunk"], bucket_count(spark))
    n, floor = sums.tokens, sums.tokens + 0.1 * (sums.words + 1)

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()
        if len(row) != 1:
            raise ValueError("documents changed between two reads; give a stable table")
        row = row[0]
        right = right.sort_by("shard")
        logs = np.frombuffer(b"".join(right.column("scores").to_pylist()), np.float32).astype(np.float64)
        known = np.concatenate([np.zeros(0, np.int64), *(unpacked(x)["known"] for x in right.column("known").to_pylist())])
        runs, index = _wide(row["runs"], row["runs_high"]), _wide(row["low"], row["high"])
        sizes = np.frombuffer(row["sizes"], np.int64)
        if len(known) != len(runs) or len(logs) != runs.sum() or sizes.sum() != len(index):
            raise ValueError("documents changed between two reads; give a stable table")
        seen = np.repeat(known, runs)[index]
        first = np.r_[0, np.cumsum(sizes)[:-1]]
        add = lambda v: np.add.reduceat(v, first)  # noqa: E731  every document has its end token
        return pa.table({
            "doc_id": pa.array(row["docs"], pa.int64()), "n_tokens": sizes, "n_known": add((seen > 0).astype(np.int64)),
            "base_score": add(np.log10((seen + 0.1) / floor)), "score": add(logs[index]),
        })

    scored = sheets.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        add_up, "doc_id long, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) % FOLDS == 0).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def _asked(words: np.ndarray, runs: np.ndarray, contexts: np.ndarray, counts: np.ndarray) -> bytes:
    """A request: every context is written once, in order, and the pairs name it by its place."""
    ids, at = np.unique(contexts, return_inverse=True)
    return packed(words=words, runs=runs, ids=ids, at=at.astype(np.uint16 if len(ids) <= 1 << 16 else np.uint32), counts=counts)


def _heard(body: bytes) -> dict[str, np.ndarray]:
    p = unpacked(body)
    return {"words": p["words"], "runs": p["runs"], "contexts": p["ids"][p["at"]], "counts": p["counts"]}


def _by_shard(rows: DataFrame, name: str) -> DataFrame:
    """A table in buckets by shard: what brings a shard's rows together later need not move them."""
    return in_buckets(rows, name, ["shard"], bucket_count(rows.sparkSession))


def frequent_words(rows: DataFrame, n: int, shards: int) -> np.ndarray:
    """Hashes of words that alone would fill a good part of a shard, guessed from a sample.

    They only decide how work is dealt; every count is exact whatever words are chosen.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in batches:
            hashes, at = hasher.words(b.column(0))
            words, times = np.unique(np.r_[hashes, np.full(len(at) - 1, END, np.uint64)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(times.astype(np.int64))], ["word", "n"])

    some = rows.select("text") if n <= HOT_SAMPLE else rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(HOT_SAMPLE / n * (1 << 30))).select("text")
    counts = some.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(HOT_WORDS).collect()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return np.sort(np.array([r.word for r in top if r.n >= 16 and r.n * 8 * shards > total], np.int64).view(np.uint64))


def _seated(asked: DataFrame, shards: int, homes: int, hot: np.ndarray) -> tuple[DataFrame, Sums]:
    """Packed log10 probabilities per pair and training counts per word of each shard (column scores), and the last sums.

    A dish of one customer has one table whatever the sweep, so only the others (busy ones) take part in
    the rounds of sweeps; the totals of their contexts count the rest in.
    """
    last = BURN_IN + SAMPLES
    sampled = range(BURN_IN, last)

    def add(t: pa.Table) -> pa.Table:
        sums = np.sum([np.frombuffer(x, np.int64) for x in t.column("part").to_pylist()], axis=0)
        return pa.table({"part": pa.array([sums.tobytes()], pa.binary())})

    def added(state: DataFrame) -> np.ndarray:
        """Parts of all shards, added up in 64 groups first."""
        got = state.select("part", F.pmod("shard", F.lit(64)).alias("slot")).groupBy("slot").applyInArrow(add, "part binary").collect()
        return np.sum([np.zeros(4 + 2 * len(hot), np.int64), *[np.frombuffer(r.part, np.int64) for r in got]], axis=0)

    def opened(value: bytes) -> tuple[dict, Shard]:
        s = unpacked(value)
        word_of = np.repeat(np.arange(len(s["runs"])), s["runs"])
        return s, Shard(s["words"], word_of, s["contexts"], s["counts"], s["ids"], hot, s.get("tables"), s.get("top"), s.get("fixed", 0))

    def scores(s: dict, seating: Seating, totals: Totals) -> bytes:
        logs, known = _predictive(seating, totals)
        return packed(runs=s["runs"], logs=logs.astype(np.float32), known=known)

    if shards == 1:
        none = np.zeros(0, np.uint64)

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    s, x = opened(row["seats"])
                    seating, sums = seat(x.words, x.word_of, x.contexts, x.counts, 1, none, 0, x.ids), []
                    per = [x.per_context(t) for t in seating.tables]
                    for t, top in zip(seating.tables, seating.top):
                        sums.append(summed(Shard(x.words, x.word_of, x.contexts, x.counts, x.ids, none, t, top).part(none), none, None, 0))
                    out = scores(s, seating, totals_of(sums, x.per_context(x.counts), per))
                    yield pa.RecordBatch.from_pylist([{"shard": row["shard"], "scores": out, "part": x.part(hot).tobytes()}])

        done = written(asked.mapInArrow(alone, "shard long, scores binary, part binary"), "seated")
        return done.select("shard", "scores"), summed(added(done), hot, None, 0)

    def per_home(shard: int, ids: np.ndarray, **values: np.ndarray) -> Iterator[pa.RecordBatch]:
        """What a shard adds to the totals of contexts (``ids``, in the order of homes)."""
        home = (ids % np.uint64(homes)).astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, home[1:] != home[:-1], True]) if len(ids) else []
        for lo in range(0, len(cuts) - 1, 64):
            yield pa.RecordBatch.from_pylist([
                {"home": int(home[i]), "shard": shard, "body": packed(ids=ids[i:j], **{k: v[i:j] for k, v in values.items()})}
                for i, j in zip(cuts[lo:lo + 64], cuts[lo + 1:lo + 65])
            ])

    def total(t: pa.Table) -> pa.Table:
        """Totals of the contexts of a home, sent to the shards for the contexts they want."""
        parts = [unpacked(x) for x in t.column("body").to_pylist()]
        ids, which = np.unique(np.concatenate([p["ids"] for p in parts]), return_inverse=True)
        names = sorted({k for p in parts for k in p} - {"ids", "wants"})
        sums = {k: np.bincount(which, np.concatenate([p.get(k, np.zeros(len(p["ids"]), np.int64)) for p in parts]), len(ids)).astype(np.int64) for k in names}
        at, out = 0, []
        for p, shard, home in zip(parts, t.column("shard").to_pylist(), t.column("home").to_pylist()):
            mine = which[at:at + len(p["ids"])]
            at += len(mine)
            if "wants" in p and p["wants"].any():
                out.append({"shard": shard, "home": home, "body": packed(**{k: v[mine[p["wants"]]] for k, v in sums.items()})})
        return pa.Table.from_pylist(out, schema=pa.schema([("shard", pa.int64()), ("home", pa.int64()), ("body", pa.binary())]))

    def totalled(messages: DataFrame) -> DataFrame:
        return messages.groupBy("home").applyInArrow(total, "shard long, home long, body binary")

    def heard(right: pa.Table, n: int, *names: str) -> list[np.ndarray]:
        parts = [unpacked(v) for v in right.sort_by("home").column("body").to_pylist()]
        size = [len(next(iter(p.values()))) for p in parts]
        got = [np.concatenate([np.zeros(0, np.int64), *(p.get(k, np.zeros(m, np.int64)) for p, m in zip(parts, size))]) for k in names]
        if any(len(x) != n for x in got):
            raise ValueError("totals of contexts are missing")
        return got

    def tell_fixed(final: bool):
        """First and last: dishes of one customer (and, at last, all customers) per context."""

        def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    _, x = opened(row["seats"])
                    values = {"base": x.per_context(x.counts == 1)}
                    if final:
                        values |= {"customers": x.per_context(x.counts), "wants": np.ones(len(x.ids), bool)}
                    else:
                        values["wants"] = x.per_context(x.counts > 1) > 0
                    yield from per_home(row["shard"], x.ids, **values)

        return tell

    def tell_busy(final: bool):
        def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    s, x = opened(row["state"])
                    if final:
                        yield from per_home(row["shard"], x.ids, **{f"tables{k}": x.per_context(s[f"tables{k}"]) for k in sampled})
                    else:
                        yield from per_home(row["shard"], x.ids, tables=x.per_context(x.tables), wants=np.ones(len(x.ids), bool))

        return tell

    def busy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                _, x = opened(row["seats"])
                known, many = np.bincount(x.word_of, x.counts, len(x.words)) > 0, x.counts > 1
                held, at = np.unique(x.contexts[many], return_inverse=True)
                state = packed(
                    words=x.words[known], runs=np.bincount(x.word_of[many], minlength=len(known))[known], contexts=at, counts=x.counts[many],
                    ids=x.ids[held], fixed=np.bincount(x.word_of[x.counts == 1], minlength=len(known))[known],
                )
                yield pa.RecordBatch.from_pylist([{"shard": row["shard"], "state": state}])

    def start(left: pa.Table, right: pa.Table) -> pa.Table:
        s, x = opened(left.column("state")[0].as_py())
        s["base"], = heard(right, len(x.ids), "base")
        return pa.table({"shard": left.column("shard")[:1], "state": pa.array([packed(**s)], pa.binary()), "part": pa.array([x.part(hot).tobytes()], pa.binary())})

    def sweep(number: int, sums: Sums):
        def step(left: pa.Table, right: pa.Table) -> pa.Table:
            s, x = opened(left.column("state")[0].as_py())
            tables, = heard(right, len(x.ids), "tables")
            x.sweep(s["base"] + tables, sums, number)
            s["tables"], s["top"] = x.tables, x.top
            if number in sampled:
                s[f"tables{number}"], s[f"top{number}"] = x.tables, x.top
            return pa.table({"shard": left.column("shard")[:1], "state": pa.array([packed(**s)], pa.binary()), "part": pa.array([x.part(hot).tobytes()], pa.binary())})

        return step

    kept: list[Sums] = []
    message = "home long, shard long, body binary"
    first = totalled(asked.mapInArrow(tell_fixed(False), message))
    both = asked.mapInArrow(busy, "shard long, state binary").groupBy("shard").cogroup(first.groupBy("shard"))
    state = _by_shard(both.applyInArrow(start, "shard long, state binary, part binary"), "seats")
    sums = summed(added(state), hot, None, -1)
    for number in range(last):
        told = totalled(state.select("shard", "state").mapInArrow(tell_busy(False), message))
        both = state.select("shard", "state").groupBy("shard").cogroup(told.groupBy("shard"))
        before, state = state, _by_shard(both.applyInArrow(sweep(number, sums), "shard long, state binary, part binary"), "seats")
        sums = summed(added(state), hot, sums, number)
        del told, both
        discarded(before)
        if number in sampled:
            kept.append(sums)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        seats, x = opened(left.column("seats")[0].as_py())
        mine = pc.equal(right.column("home"), -1)
        s, right = unpacked(right.filter(mine).column("body")[0].as_py()), right.filter(pc.invert(mine))
        customers, base, *busy_tables = heard(right, len(x.ids), "customers", "base", *(f"tables{k}" for k in sampled))
        known, tables, top = np.bincount(x.word_of, x.counts, len(x.words)) > 0, [], []
        for k in sampled:
            tables.append(np.minimum(x.counts, 1))
            tables[-1][x.counts > 1] = s[f"tables{k}"]
            top.append(np.zeros(len(x.words), np.int64))
            top[-1][known] = s[f"top{k}"]
        seating = Seating(x.words, x.word_of, x.contexts, x.counts, tables, top)
        out = scores(seats, seating, totals_of(kept, customers, [base + b for b in busy_tables]))
        return pa.table({"shard": left.column("shard")[:1], "scores": pa.array([out], pa.binary())})

    told = totalled(asked.mapInArrow(tell_fixed(True), message).unionByName(state.select("shard", "state").mapInArrow(tell_busy(True), message)))
    # What a shard holds lies in its bucket; only the last seating and the totals move.
    moved = told.unionByName(state.select("shard", F.lit(-1).cast("long").alias("home"), F.col("state").alias("body")))
    done = _by_shard(asked.select("shard", "seats").groupBy("shard").cogroup(moved.groupBy("shard")).applyInArrow(finish, "shard long, scores binary"), "scored")
    del told, moved
    discarded(state)
    return done, sums


def _predictive(s: Seating, t: Totals) -> tuple[np.ndarray, np.ndarray]:
    """Averaged log10 predictive probability of each pair, and the training count of each word."""
    w = len(s.words)
    known = np.bincount(s.word_of, s.counts, w).astype(np.int64)
    spread = np.isin(s.words, t.hot)
    at = np.searchsorted(t.hot, s.words[spread])
    known[spread] = t.hot_counts[at]
    p = np.zeros(len(s.counts))
    for k in range(SAMPLES):
        customers, top = np.bincount(s.word_of, s.tables[k], w), s.top[k].copy()
        customers[spread], top[spread] = t.hot_customers[k][at], t.hot_tables[k][at]
        parent = (customers - TOP_DISCOUNT * top + (TOP_STRENGTH + TOP_DISCOUNT * t.tables[k]) / (t.words + 1)) / (TOP_STRENGTH + t.customers[k])
        c = s.contexts
        p += (s.counts - DISCOUNT * s.tables[k] + (STRENGTH + DISCOUNT * t.context_tables[k][c]) * parent[s.word_of]) / (STRENGTH + t.context_counts[c])
    return np.log10(np.maximum(p / SAMPLES, 1e-300)), known
