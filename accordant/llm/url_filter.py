"""URL filter: rules first, else gradient-boosted trees on lexical features; SQL functions only."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.llm.common import LOWER, UPPER, written

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
TRAIN_ROWS = 50_000  # labelled URLs that the trees and the suffix statistics are fitted on, at most about so many
FEATURES = [
    "length", "host_length", "path_length", "depth", "labels", "digits", "entropy", "parameters", "query_length",
    "hyphens", "upper", "suffix_odds", "domain_odds",
]


def url_parts(url: Column) -> dict[str, Column]:
    """Host (A-Z lower-cased), path and query of a URL; all empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return {
        "host": F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER),
        "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
        "query": F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1),
    }


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits host (or a parent domain of it) and path, else null."""
    fits = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        h, slash, p = rule.partition("/")
        fits.append(F.when(((host == h) | host.endswith("." + h)) & path.startswith(slash + p), F.lit(rule)))
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


def lexical(df: DataFrame) -> DataFrame:
    """``df`` (url, host, path, query) with the lexical features; a null URL is empty."""
    u = F.coalesce(F.col("url"), F.lit(""))
    n = F.length(u).cast("double")
    share = lambda pattern: F.when(n > 0, F.regexp_count(u, F.lit(pattern)) / n).otherwise(F.lit(0.0))
    df = df.withColumn("u", u)
    # Every distinct character by how much shorter the text is without it.
    entropy = F.expr(
        "aggregate(transform(array_distinct(split(u, '')), c -> (length(u) - length(replace(u, c, ''))) / length(u)), "
        "cast(0 as double), (a, p) -> if(p > 0, a - p * log2(p), a))"
    )
    label = F.regexp_extract("host", r"([^.]*)$", 1)
    return df.select(
        "*", n.alias("length"), F.length("host").cast("double").alias("host_length"), F.length("path").cast("double").alias("path_length"),
        F.regexp_count("path", F.lit("/")).cast("double").alias("depth"), F.size(F.split("host", r"\.")).cast("double").alias("labels"),
        share("[0-9]").alias("digits"), F.when(n > 0, entropy).otherwise(F.lit(0.0)).alias("entropy"),
        F.regexp_count("query", F.lit("[^&]+")).cast("double").alias("parameters"), F.length("query").cast("double").alias("query_length"),
        F.regexp_count(u, F.lit("-")).cast("double").alias("hyphens"), share("[A-Z]").alias("upper"),
        label.alias("suffix"), F.regexp_extract("host", r"([^.]*\.?[^.]*)$", 1).alias("domain"),
    )


def _odds(train: DataFrame, by: list[str], name: str) -> DataFrame:
    """Smoothed log-odds of blocking per value; the training rows bound its size."""
    g = train.groupBy(*[F.col(c).alias(f"{c}_") for c in by]).agg(F.sum("label").alias("b"), F.count(F.lit(1)).alias("n"))
    return g.select(*[f"{c}_" for c in by], F.log((F.col("b") + 1) / (F.col("n") - F.col("b") + 1)).alias(name))


def judge_urls(
    pages: DataFrame, key: str = "page_id", url: str = "url", rules: dict[str, str] | None = None,
    rounds: int = 15, depth: int = 3, seed: int = 7,
) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict ("allow" or "block").

    URLs that a rule fits take its verdict and are the labelled rows; boosted trees trained on them
    judge the rest.  What a suffix or a domain says of blocking is a feature; in training it is counted on
    the other half of the labelled URLs, in judging on all of them.  A null URL, or one without ``://``, has empty host and path, fits no rule and is
    judged by the trees.  Without labelled rows every other URL is allowed; with labels of one kind
    only, it takes that kind.  Rows that repeat an id are judged apart; other columns are not read;
    URLs of any length are read whole; an empty table gives no rows.
    """
    rules = RULES if rules is None else rules
    parts = url_parts(F.col(url))
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), *[c.alias(n) for n, c in parts.items()])
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    ruled = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items()], F.lit(None).cast("string"))
    rows = rows.withColumn("ruled", ruled)
    labelled = rows.filter("ruled is not null").withColumn("label", (F.col("ruled") == "block").cast("double"))
    kinds = {r.label: r.n for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        only = "block" if kinds.get(1.0) else "allow"
        return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(only)).alias("verdict"))
    share = min(1.0, TRAIN_ROWS / sum(kinds.values()))
    chosen = labelled if share == 1.0 else labelled.filter(F.pmod(F.xxhash64("url", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    half = F.pmod(F.xxhash64("url", F.lit(seed + 1)), F.lit(2))
    train = written(lexical(chosen).withColumn("half", half), "urls")
    stats = [(by, f"{by}_odds", written(_odds(train, [by], f"{by}_odds"), by)) for by in ("suffix", "domain")]
    # The trees learn from odds of the other half of the URLs, so none of them sees its own label in a feature.
    apart = [(by, f"{by}_odds", written(_odds(train, [by, "half"], f"{by}_odds"), by)) for by in ("suffix", "domain")]

    def vectors(df: DataFrame, tables: list[tuple[str, str, DataFrame]], other_half: bool = False) -> DataFrame:
        for by, name, table in tables:
            on = F.col(by) == F.col(f"{by}_")
            if other_half:
                on &= F.col("half") == 1 - F.col("half_")
            df = df.join(F.broadcast(table), on, "left").withColumn(name, F.coalesce(name, F.lit(0.0))).drop(f"{by}_", "half_")
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)

    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, maxBins=32, seed=seed, featuresCol="features", labelCol="label")
    model = trees.fit(vectors(train, apart, other_half=True).select("features", "label"))
    known = rows.filter("ruled is not null").select("page_id", "host", "path", "rule", F.col("ruled").alias("verdict"))
    judged = model.transform(vectors(lexical(rows.filter("ruled is null")), stats))
    verdict = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
    return known.unionByName(judged.select("page_id", "host", "path", "rule", verdict.alias("verdict")))
