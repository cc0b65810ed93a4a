"""Text chosen to fill a budget of tokens: better tiers first, whole files by score, their blocks in order, the last block cut inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.plans.prefix import running


def token_estimate(text: Column) -> Column:
    """Four characters a token, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def select_blocks(blocks: DataFrame, budget: int, margin: int = 0) -> DataFrame:
    """(file, block, tier, text, tokens, whole) of blocks(file, block, tier, score, text) that fill `budget` tokens, less `margin` for each file's heading.

    A file is of its best block's tier and score. Files come by tier (lower
    first), score (higher first) and name, their blocks by tier, then number.
    Sums run over files first, then over the blocks of the files that fit at
    least in part, so no task sees all rows. A block that does not fit is cut
    to what is left at a line's end, or at the character where its first line
    is longer; nothing follows it. Null texts are empty and take no tokens;
    null tiers come last, null scores count as 0.
    """
    b = blocks.select("file", "block", F.coalesce(F.col("tier").cast("int"), F.lit(1 << 30)).alias("tier"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), F.coalesce("text", F.lit("")).alias("text"))
    b = b.withColumn("tokens", token_estimate(F.col("text")))
    files = b.groupBy("file").agg(F.min("tier").alias("file_tier"), F.max("score").alias("file_score"), (F.sum("tokens") + margin).alias("all"))
    sums = running(files, {"upto": F.col("all")}, [F.col("file_tier"), -F.col("file_score"), F.col("file")])
    chosen = sums.withColumn("from", F.col("upto") - F.col("all")).where(F.col("from") + margin < budget).select("file", "from")
    inner = b.join(chosen, "file")
    own = running(inner, {"inside": F.col("tokens")}, [F.col("tier"), F.col("block")], ["file"])
    left = F.lit(budget) - F.col("from") - margin - (F.col("inside") - F.col("tokens"))
    fit = own.withColumn("left", left).where("left > 0 or tokens = 0 and left >= 0")
    head = F.substring("text", F.lit(1), (F.col("left") * 4).cast("int"))
    lines = F.substring_index(head, "\n", -1)
    at_line = F.substring(head, F.lit(1), (F.length(head) - F.length(lines)).cast("int"))
    cut_text = F.when(F.instr(head, "\n") > 0, at_line).otherwise(head)
    whole = F.col("tokens") <= F.col("left")
    text = F.when(whole, F.col("text")).otherwise(cut_text)
    return fit.select("file", "block", "tier", text.alias("text"), whole.alias("whole")).select("file", "block", "tier", "text", token_estimate(F.col("text")).alias("tokens"), "whole")
