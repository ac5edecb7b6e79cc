"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query()
def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from accordant.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


@query("""
with t as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
  row_number() over (partition by norm order by doc_id nulls last) = 1 as kept, sha256(norm) as text_sha256
from t window w as (partition by norm)
""")
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from accordant.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def _secrets_sql() -> str:
    from accordant.llm.secret_scan import spans_sql

    return spans_sql()


@query(_secrets_sql())
def op9_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    from accordant.llm.secret_scan import scan_secrets

    out = scan_secrets(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans"), 256).alias("base_sha256"), "spans",
        "n_owned", "n_live", "n_copied",
    )


@query()
def op5_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from accordant.llm.url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


@query()
def op2_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from accordant.llm import toxicity
    from accordant.llm.training import held_out

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score_toxicity(docs, model, "t")
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), F.col("t.score").alias("score"),
        (F.col("t.score") >= 0.5).cast("int").alias("predicted"), F.col("t.n_tokens").alias("n_tokens"),
        F.size("t.passages").alias("n_passages"),
    )


@query()
def op8_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from accordant.llm import quality
    from accordant.llm.training import held_out

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    out = docs.withColumn("score", quality.quality(model))
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query("""
with recursive words as (
  select row_number() over () as rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
  from documents),
shingles as (
  select distinct rid, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end as s
  from words, lateral (select unnest(range(1, greatest(2, len(w) - 3))) as i) u where len(w) > 0),
sizes as (select rid, count(*) as n from shingles group by rid),
pairs as (
  select a.rid as x, b.rid as y, count(*) as k from shingles a join shingles b on a.s = b.s and a.rid <> b.rid group by all),
links as (
  select x, y from pairs join sizes p on x = p.rid join sizes q on y = q.rid where 100 * k >= 80 * (p.n + q.n - k)),
reach as (
  select rid as a, rid as b from words union select r.a, l.y from reach r join links l on r.b = l.x)
select w.doc_id, coalesce(any_value(n), 0) as n_shingles, min(v.doc_id) as component_id
from words w left join sizes s on w.rid = s.rid join reach r on r.a = w.rid join words v on v.rid = r.b
group by w.rid, w.doc_id
""")
def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from accordant.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query("""
with recursive good as (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
fine as (
  select rid, vec_id, v from good where len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(v, lambda x: x <> 0)) > 0),
links as (
  select a.rid as x, b.rid as y from fine a join fine b on a.rid <> b.rid and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.95),
reach as (select rid as a, rid as b from good union select r.a, l.y from reach r join links l on r.b = l.x),
parts as (select a as rid, min(g.vec_id) as component_id from reach join good g on b = g.rid group by a),
degree as (select x as rid, count(*) as n from links group by x)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id is not distinct from component_id as kept
from good left join degree using (rid) join parts using (rid)
""")
def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from accordant.llm.multi_index import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def tokenizer_path() -> str:
    """The tokenizer file of the packing query; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op4_first_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from accordant.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query()
def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from accordant.llm.pitman_yor import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The rounds written out one after the other, over one row per vector, part and position."""
    whole = "case when {0} < 0 then -((-{0} + n - 1) // n) else {0} // n end"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
at{k} as materialized (
  select rid, p, min_by(e, (d, e)) as e, min(d) as d from (
    select x.rid, x.p, b.e, sum((x.v - b.v) * (x.v - b.v)) as d
    from numbers x join book{k} b on x.p = b.p and x.i = b.i group by all)
  group by all)""")
        if k < rounds:
            steps.append(f"""
book{k + 1} as materialized (
  select b.p, b.e, b.i, coalesce(m.v, b.v) as v from book{k} b left join (
    select p, e, i, {whole.format("s")} as v from (
      select x.p, a.e, x.i, sum(x.v) as s, count(*) as n from numbers x join at{k} a on x.rid = a.rid and x.p = a.p group by all)
  ) m on b.p = m.p and b.e = m.e and b.i = m.i)""")
    return f"""
with kept as materialized (
  select row_number() over () as rid, vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
width as (select greatest(1, (max(len(v)) + {parts - 1}) // {parts}) as w from kept),
numbers as materialized (
  select rid, (j - 1) // w as p, (j - 1) % w as i, cast(floor({scale} * coalesce(v[j], 0)) as bigint) as v
  from kept, width, lateral (select unnest(range(1, {parts} * w + 1)) as j) u),
first as (select rid, row_number() over (order by vec_id nulls last, v) - 1 as e from kept qualify e < {entries}),
book0 as materialized (select p, e, i, v from numbers join first using (rid)),{",".join(steps)},
codes as (
  select rid, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from at{rounds} group by rid),
digest as (select sha256(string_agg(cast(v as varchar), ',' order by p, e, i)) as codebooks_sha256 from book{rounds})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from kept join codes using (rid) cross join digest
"""


@query(_codes_sql())
def op11_hilbert_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from accordant.llm.vector_codes import compressed

    return compressed(table(spark, sf_dir, "embeddings"))


def _merkle_sql() -> str:
    """Levels as lists: a tree is a list that is cut into threes until one digest is left."""
    field = "case when {0} is null then '-' else strlen({0}) || ':' || {0} end"
    texts = ["cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)"]
    leaf = " || ".join(field.format(t) for t in texts)
    crc = (
        "xor(list_reduce(list_transform(string_split(coalesce(cast(doc_id as varchar), ''), ''), lambda c: cast(ascii(c) as bigint)), "
        "lambda a, c: list_reduce([xor(a, c), 0, 1, 2, 3, 4, 5, 6, 7], "
        "lambda r, k: xor(r // 2, (r % 2) * 3988292384)), 4294967295), 4294967295)"
    )
    up = "list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], '')))"
    return f"""
with recursive rows as materialized (
  select row_number() over () as rid, doc_id, source, sha256({leaf} || {field.format('text')}) as leaf,
    sha256({leaf} || {field.format("(case when crc % 2 = 0 then replace(text, chr(10), '') else text end)")}) as found
  from (select *, {crc} as crc from documents)),
placed as materialized (
  select *, row_number() over (partition by source order by doc_id nulls last, leaf) - 1 as k from rows),
trees as (
  select source, 0 as level, list(leaf order by k) as nodes from placed group by source
  union all
  select source, level + 1, {up} from trees where len(nodes) > 1),
subroots as materialized (
  select source, nodes[1] as subroot, row_number() over (order by source nulls first) - 1 as k from trees where len(nodes) = 1),
top as (
  select 0 as level, list(subroot order by k) as nodes from subroots
  union all
  select level + 1, {up} from top where len(nodes) > 1),
steps as materialized (
  select source, level, nodes, (select max(level) from trees t where t.source is not distinct from trees.source) as depth
  from trees),
ways as (
  select rid, source, 0 as level, k, found as node, '' as proof from placed
  union all
  select w.rid, w.source, w.level + 1, w.k // 3, sha256(array_to_string([a, w.node, b], '')), w.proof || a || b
  from (
    select w.*, array_to_string(nodes[3 * (k // 3) + 1:k], '') as a, array_to_string(nodes[k + 2:3 * (k // 3) + 3], '') as b
    from ways w join steps s on w.source is not distinct from s.source and w.level = s.level and s.level < s.depth) w),
low as materialized (
  select w.* from ways w join (select source, max(level) as depth from trees group by source) d
  on w.source is not distinct from d.source and w.level = d.depth),
high as (
  select w.rid, 0 as level, s.k, w.node, w.proof, s.subroot from low w join subroots s on w.source is not distinct from s.source
  union all
  select rid, level + 1, k // 3, sha256(array_to_string([a, node, b], '')), proof || a || b, subroot from (
    select h.*, array_to_string(nodes[3 * (k // 3) + 1:k], '') as a, array_to_string(nodes[k + 2:3 * (k // 3) + 3], '') as b
    from high h join top t on h.level = t.level and len(t.nodes) > 1)),
root as (select nodes[1] as root from top where len(nodes) = 1)
select p.doc_id, p.leaf, h.subroot, root, sha256(h.proof) as proof_sha256, h.node as folded_root, h.node = root as verified
from high h join placed p using (rid) cross join root
where h.level = (select max(level) from top)
"""


@query(_merkle_sql())
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from accordant.llm.merkle import manifest

    return manifest(table(spark, sf_dir, "documents"))


@query()
def op13_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from accordant.llm.kd_shards import sharded

    return sharded(table(spark, sf_dir, "documents"), 16)
