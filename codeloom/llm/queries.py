"""The operators' queries with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import chat, hardneg, jaccard, lzprint, mixing, packing, periodic, sharding, tokens, topk, toxicity, urlfilter, warc
from codeloom.llm.common import BATCH_ROWS, stash, table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels)).drop("text").withColumnRenamed("rejected", "toxic")
    return stash(scored, batch_rows=BATCH_ROWS)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(table(spark, sf_dir, "pages"), 0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.fingerprints(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.with_probe(table(spark, sf_dir, "conversations")).drop("formatted", "spans")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokens.default_path(), limit=2048)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokens.default_path(), most=2048)


def url_entries(pages: DataFrame) -> DataFrame:
    """A dated list made from the pages' own hosts: most hosts and domains are listed on a day that their MD5 gives, freed and listed again later."""
    name = urlfilter.host(F.col("url"))
    rules = pages.select(F.explode(urlfilter.suffixes(name)).alias("rule")).where("rule like '%.%'").distinct()
    part = lambda at: F.conv(F.substring(F.md5("rule"), at, 3), 16, 10).cast("long")
    start = part(1) % 365
    free = start + 1 + part(4) % 120
    again = free + 1 + part(7) % 120
    listed = rules.where(part(10) % 3 != 0)
    return listed.select("rule", F.explode(F.array(*[F.struct(d.alias("day"), F.lit(a).alias("action")) for d, a in ((start, "block"), (free, "allow"), (again, "block"))])).alias("e")).select("rule", "e.day", "e.action")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.evaluate(pages.withColumn("fetch_day", F.col("page_id") % 365), url_entries(pages))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), shards=40)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.negatives(rows.select("vec_id", "embedding", label.alias("label")), every=100, scale=256, positives=5, k=5, low=80, high=100)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.repeats(table(spark, sf_dir, "documents"))


_ALL = (op1_mix_sources, op2_toxicity, op3_warc, op4_topk, op5_fingerprints, op6_chat, op7_token_counts, op8_jaccard, op9_packing, op10_url_filter, op11_sharding, op12_hard_negatives, op13_periodic_runs)
QUERIES = {f.__name__: f for f in _ALL}

_HOST_SQL = r"rtrim(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.')"

ORACLE_SQL = {
    "op4_topk": """
        with e as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
                   where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(list_transform(q.v, lambda x: cast(x as double)), list_transform(c.v, lambda x: cast(x as double))) as bigint) as score
              from e q, e c where q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
        select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 20""",
    "op10_url_filter": f"""
        with c as (select page_id, url, page_id % 365 as fetch_day, {_HOST_SQL} as host from pages),
        w as (select *, string_split(host, '.') as parts from c),
        s as (select page_id, url, fetch_day, host, unnest(list_transform(range(1, len(parts) + 1), lambda i: array_to_string(list_slice(parts, i, len(parts)), '.'))) as rule from w where host <> ''),
        m as (select distinct rule, md5(rule) as m from s where contains(rule, '.')),
        n as (select rule, cast('0x' || substr(m, 1, 3) as bigint) % 365 as a, cast('0x' || substr(m, 4, 3) as bigint) % 120 as b, cast('0x' || substr(m, 7, 3) as bigint) % 120 as d
              from m where cast('0x' || substr(m, 10, 3) as bigint) % 3 <> 0),
        i as (select rule, a as since, a + 1 + b as until from n union all select rule, a + 1 + b + 1 + d, null from n),
        h as (select s.page_id, i.rule, i.since from s join i on s.rule = i.rule and s.fetch_day >= i.since and (i.until is null or s.fetch_day < i.until)),
        g as (select page_id, count(*) as n_rules, max({{'n': length(rule), 'rule': rule, 'since': since}}) as best from h group by page_id)
        select c.page_id, c.url, c.fetch_day, c.host, coalesce(g.n_rules, 0) as n_rules, g.best.rule as rule, g.best.since as listed_day, g.n_rules is not null as blocked
        from c left join g on c.page_id = g.page_id""",
    "op12_hard_negatives": """
        with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
                   where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        r as (select *, row_number() over (order by vec_id) as row from e),
        s as (select a.row, a.vec_id as anchor_id, c.vec_id, a.label = c.label as alike,
                cast(list_dot_product(list_transform(a.v, lambda x: cast(x as double)), list_transform(c.v, lambda x: cast(x as double))) as bigint) as score
              from r a, r c where a.vec_id % 100 = 0 and a.row <> c.row),
        p as (select *, row_number() over (partition by row order by score desc, vec_id) as place from s where alike),
        n as (select p.row, p.place, p.anchor_id, p.vec_id as positive_id, p.score as positive_score, s.vec_id as negative_id, s.score as negative_score,
                row_number() over (partition by p.row, p.place order by s.score desc, s.vec_id) as rank
              from p join s on p.row = s.row and p.place <= 5 and not s.alike and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score)
        select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 5""",
}
