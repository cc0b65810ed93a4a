"""Symbol search: postings, BM25, substring and fuzzy tiers, grep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.scalars import words_of

K1, B = 1.2, 0.75


def postings(rows: DataFrame, text: str) -> DataFrame:
    """(id, term, tf, length)."""
    terms = rows.select("id", words_of(F.col(text)).alias("terms")).withColumn("length", F.size("terms"))
    return terms.select("id", "length", F.explode("terms").alias("term")).groupBy("id", "term", "length").agg(F.count("*").alias("tf"))


def bm25(rows: DataFrame, text: str, query: list[str], k: int, prefix: bool = True) -> DataFrame:
    """(id, score): the k best rows by Okapi BM25 of the query's terms, each a prefix if so asked; ties by id."""
    p = postings(rows, text)
    stats = rows.agg(F.count("*").alias("n"), F.avg(F.size(words_of(F.col(text)))).alias("mean"))
    hit = None
    for q in query:
        own = p.where(F.col("term").startswith(q) if prefix else F.col("term") == q).groupBy("id", "length").agg(F.sum("tf").alias("tf")).withColumn("q", F.lit(q))
        hit = own if hit is None else hit.unionByName(own)
    found = hit.groupBy("q").agg(F.count("*").alias("df"))
    joined = hit.join(found, "q").join(F.broadcast(stats))  # one row
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return joined.groupBy("id").agg(F.sum(part).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def like_score(name: Column, query: str) -> Column:
    """1 equal, 0.9 prefix, 0.8 within the name, whatever the case; null otherwise."""
    q, low = query.lower(), F.lower(name)
    return F.when(low == q, 1.0).when(low.startswith(q), 0.9).when(low.contains(q), 0.8)


def like(rows: DataFrame, query: str, k: int) -> DataFrame:
    return rows.select("id", "name", like_score(F.col("name"), query).alias("score")).where("score is not null").orderBy(F.desc("score"), F.length("name"), "id").limit(k)


def fuzzy(rows: DataFrame, query: str) -> DataFrame:
    """(name, distance): distinct names within 1 edit of a query up to 4 long, else 2."""
    most = 1 if len(query) <= 4 else 2
    names = rows.select(F.lower("name").alias("name")).distinct()
    return names.withColumn("distance", F.levenshtein("name", F.lit(query.lower()), most)).where("distance >= 0")


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, content), lines from 1."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "content")).withColumn("line", F.col("line") + 1)


def grep(docs: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    return lines(docs, key, text).where(F.col("content").rlike(pattern))


def segment_search(rows: DataFrame, words: list[str], least: int) -> DataFrame:
    """(name, hits): names whose segments hold at least `least` of the words."""
    seg = rows.select("name", F.explode(F.array_distinct(words_of(F.col("name")))).alias("segment"))
    return seg.where(F.col("segment").isin(*words)).groupBy("name").agg(F.countDistinct("segment").alias("hits")).where(F.col("hits") >= least)
