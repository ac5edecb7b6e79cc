"""Toxic passages: maximum-scoring segments of token log-odds, judged by extreme-value statistics."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.common import discarded, whole, written
from accordant.llm.training import labelled_texts

TRAIN_DOCS = 100_000  # labelled documents that the model is fitted on, at most about so many
MODEL_TOKENS = 20_000  # strongest tokens kept, so the model that travels to the tasks is bounded
PRIOR_SHARE = 0.01  # weight of the Dirichlet prior against the tokens counted
MIN_ODDS, MIN_Z, MIN_DOCS = 1.5, 2.0, 3
NEUTRAL = -0.25  # score of a token outside the model; an insult of score 8 so reaches over 32 tokens
SIGNIFICANT = 0.05  # largest expected number of chance segments for a passage to count
PREFIXES = (4, 5)
WORD = re.compile(r"[^\W\d_]+")
RESULT = "struct<score:double,n_tokens:long,passages:array<struct<start:int,end:int,score:double,expected:double>>>"


@dataclass(frozen=True)
class ToxicModel:
    """Token log-odds with the constants of the chance distribution and of the calibration."""

    odds: dict[str, float]
    rate: float  # lambda of exp(-lambda * score)
    scale: float  # K: chance segments per token
    intercept: float
    slope: float


def features(word: str) -> Iterator[str]:
    """A word and its beginnings, which inflected forms share (marked by a closing star)."""
    yield word
    for n in PREFIXES:
        if len(word) > n:
            yield word[:n] + "*"


def segments(scored: list[tuple[int, float]], neutral: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(first, last, score)`` in linear time.

    ``scored`` has the positions and scores of tokens that are not neutral, in order; the gaps
    between them cost ``neutral`` a token.
    """
    # Each entry: left sum (before the segment), right sum (after it), first, last, and the link to the
    # last entry before it with a smaller left sum; what lies between cannot be the one looked for.
    found: list[tuple[float, float, int, int, int]] = []
    total, at = 0.0, None
    for position, score in scored:
        if at is not None:
            total += neutral * (position - at - 1)
        at = position
        if score <= 0:
            total += score
            continue
        left, right, first = total, total + score, position
        total = right
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= left:
                j = found[j][4]
            if j < 0 or found[j][1] >= right:
                break
            left, first = found[j][0], found[j][2]
            del found[j:]
        found.append((left, right, first, position, j))
    return [(first, last, right - left) for left, right, first, last, _ in found]


def _scorer(odds: dict[str, float]) -> Callable[[str], float]:
    memo: dict[str, float] = {}

    def score(word: str) -> float:
        s = memo.get(word)
        if s is None:
            if len(memo) > 200_000:
                memo.clear()
            s = memo[word] = max((odds.get(f, 0.0) for f in features(word)), default=0.0)
        return s

    return score


def scan(text: str, score: Callable[[str], float], rate: float, scale: float) -> tuple[int, float, list[tuple[int, int, float, float]]]:
    """Tokens of a text, its best segment score, and its segments ``(start, end, score, expected)`` in code points."""
    low = text.lower()
    low = low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    words = WORD.findall(low)
    hits = {w: s for w in set(words) if (s := score(w)) > 0}
    if not hits:
        return len(words), 0.0, []
    found = segments([(i, hits[w]) for i, w in enumerate(words) if w in hits], NEUTRAL)
    spans = [m.span() for m in WORD.finditer(low)]
    n = max(1, len(words))
    return len(words), max(s for _, _, s in found), [
        (spans[a][0], spans[b][1], s, scale * n * math.exp(-min(rate * s, 600.0))) for a, b, s in found
    ]


def evidence(passages: list[tuple[int, int, float, float]]) -> float:
    """Significant passages together: how unlikely they are by chance, in natural logarithms (at most 60)."""
    return min(60.0, sum(-math.log(max(e, 1e-300)) for *_, e in passages if e < SIGNIFICANT))


def _token_counts(train: DataFrame) -> DataFrame:
    """Documents of either label per feature, counted per task before they are shuffled.

    The row of the empty feature has the sums over all words; features that toxic documents hardly
    have are left out of the result.
    """
    schema = pa.schema([("feature", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(seen), pa.array([v[1] for v in seen.values()], pa.int64()), pa.array([v[0] for v in seen.values()], pa.int64())],
                schema=schema,
            )
            seen.clear()
            return out

        for b in batches:
            for text, label in zip(b.column("text"), b.column("label").to_pylist()):
                k = int(label >= 0.5)
                words = set(WORD.findall(text.as_py().lower()))
                for f in {f for w in words for f in features(w)}:
                    seen.setdefault(f, [0, 0])[k] += 1
                seen.setdefault("", [0, 0])[k] += len(words)
                if len(seen) > 100_000:
                    yield rows()
        if seen:
            yield rows()

    counted = train.mapInArrow(count, "feature string, toxic long, clean long")
    summed = counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    return written(summed.filter((F.col("feature") == "") | (F.col("toxic") >= MIN_DOCS)), "features")


def _odds(counts: DataFrame) -> tuple[dict[str, float], list[tuple[float, float]]]:
    """Log-odds of the strongest toxic tokens, and ``(score, chance)`` of each token in clean text."""
    total = counts.filter("feature = ''").first()
    t, c = (float(total.toxic), float(total.clean)) if total else (0.0, 0.0)
    if not t or not c:
        return {}, []
    a0 = F.lit(PRIOR_SHARE * (t + c))
    a = a0 * (F.col("toxic") + F.col("clean")) / F.lit(t + c)
    yt, yc = F.col("toxic") + a, F.col("clean") + a
    odds = F.log(yt / (t + a0 - yt)) - F.log(yc / (c + a0 - yc))
    z = odds / F.sqrt(1 / yt + 1 / yc)
    kept = (
        counts.filter("feature <> ''").select("feature", odds.alias("odds"), z.alias("z"), ((F.col("clean") + a) / (c + a0)).alias("p"))
        .filter((F.col("odds") >= MIN_ODDS) & (F.col("z") >= MIN_Z)).orderBy(F.desc("z"), "feature").limit(MODEL_TOKENS).collect()
    )
    return {r.feature: r.odds for r in kept}, [(r.odds, r.p) for r in kept]


def chance_rate(scores: list[tuple[float, float]]) -> float:
    """The positive root of E[exp(rate * score)] = 1 over the scores of tokens in clean text."""
    rest = max(1e-9, 1.0 - sum(p for _, p in scores))

    def excess(x: float) -> float:
        return sum(p * math.exp(min(700.0, x * s)) for s, p in scores) + rest * math.exp(x * NEUTRAL) - 1.0

    lo, hi = 0.0, 1.0
    while excess(hi) < 0 and hi < 50:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    return max(hi, 0.05)


def _logistic(points: list[tuple[float, float, float]]) -> tuple[float, float]:
    """Intercept and slope from ``(x, positives, all)`` by penalised Newton steps."""
    a, b = -2.0, 0.1
    for _ in range(60):
        g0, g1, h00, h01, h11 = -0.01 * a, -0.01 * b, 0.01, 0.0, 0.01
        for x, k, n in points:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x))))
            w = n * p * (1 - p)
            g0, g1, h00, h01, h11 = g0 + k - n * p, g1 + (k - n * p) * x, h00 + w, h01 + w * x, h11 + w * x * x
        d = h00 * h11 - h01 * h01
        a, b = a + max(-2.0, min(2.0, (h11 * g0 - h01 * g1) / d)), b + max(-1.0, min(1.0, (h00 * g1 - h01 * g0) / d))
    return a, b


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicModel:
    """Learn token log-odds, the chance distribution of segment scores and the calibration from labels.

    The labelled sample is bounded (``TRAIN_DOCS``), so are the tokens kept; only sums and histograms
    come to the driver.  Without documents of both labels the model finds nothing and its scores are
    the share of toxic labels (0.05 without any).
    """
    train = labelled_texts(docs, labels, label, TRAIN_DOCS, key, text)
    odds, chances = _odds(_token_counts(train))
    if not odds:
        r = train.agg(F.avg("label").alias("p")).first()
        discarded(train)
        p = min(0.95, max(0.05, r.p if r.p is not None else 0.05))
        return ToxicModel({}, 1.0, 1.0, math.log(p / (1 - p)), 0.0)
    rate = chance_rate(chances)
    schema = pa.schema([("n", pa.int64()), ("best", pa.float64()), ("segments", pa.list_(pa.float64())), ("label", pa.float64())])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(odds)
        for b in batches:
            rows = [scan(t.as_py(), score, rate, 1.0) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64()),
                 pa.array([[p[3] for p in r[2]] for r in rows], pa.list_(pa.float64())), b.column("label")], schema=schema,
            )

    seen = written(train.mapInArrow(scanned, "n long, best double, segments array<double>, label double"), "scanned")
    clean = seen.filter("label < 0.5").agg(
        F.count(F.lit(1)).alias("d"), F.sum(F.greatest(F.col("n"), F.lit(1)) * F.exp(-rate * F.col("best"))).alias("w")
    ).first()
    scale = clean.d / clean.w if clean.d else 1.0  # maximum likelihood of K in exp(-K n exp(-rate s))
    x = F.expr(f"least(60D, aggregate(segments, 0D, (a, e) -> a + if(e * {scale!r}D < {SIGNIFICANT}D, -ln(greatest(e * {scale!r}D, 1e-300D)), 0D)))")
    points = seen.groupBy(F.round(x, 0).alias("x")).agg(F.sum("label").alias("k"), F.count(F.lit(1)).alias("n")).collect()
    discarded(train, seen)
    intercept, slope = _logistic([(r.x, float(r.k), float(r.n)) for r in points])
    return ToxicModel(odds, rate, scale, intercept, max(slope, 0.0))


def toxicity(model: ToxicModel, text: str = "text"):
    """A column ``struct<score, n_tokens, passages>`` of the whole text."""

    def judge(texts: pa.Array) -> pa.Array:
        score = _scorer(model.odds)
        scores, tokens, passages = [], [], []
        for t in texts:
            n, _, found = scan(t.as_py(), score, model.rate, model.scale)
            scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, model.intercept + model.slope * evidence(found))))))
            tokens.append(n)
            passages.append([{"start": a, "end": b, "score": s, "expected": e} for a, b, s, e in found if e < SIGNIFICANT])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
        return pa.StructArray.from_arrays(
            [pa.array(scores, pa.float64()), pa.array(tokens, pa.int64()), pa.array(passages, kind)], ["score", "n_tokens", "passages"]
        )

    return F.arrow_udf(judge, RESULT)(whole(text))


def score_toxicity(docs: DataFrame, model: ToxicModel, into: str, text: str = "text") -> DataFrame:
    """``docs`` with the struct of :func:`toxicity` in column ``into``; no row moves.

    A null or empty text has no passages and gets the lowest score.  Repeated rows and ids are
    scored one by one; only the text column is read.
    """
    return docs.withColumn(into, toxicity(model, text))
