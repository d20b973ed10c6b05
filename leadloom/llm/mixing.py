"""Problem 9: sources mixed to target shares of the total size.

Method: time-varying curriculum. Each source has a weight schedule over training time t in [0, 1], a straight
line around its target share. Its integral is the source's cumulative token demand; inverting it at the token
offset where a document stands in its source gives the document's training position, and the documents are
range-sorted by position. A small source is passed through several times, up to its cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.session import cut

SLOPE = 0.5
BUCKET_ROWS = 50_000


def demands(lengths: DataFrame, targets: DataFrame, total_tokens: float | None = None, slope: float = SLOPE) -> DataFrame:
    """(source, target_share, max_repeats, available, wanted, bend): one row a named source.

    Shares are taken among the named sources that have tokens; a source without any wants 0. The default
    total is the largest that every source can serve within its repeats, so all shares are met; a larger total
    leaves a source at its cap. bend tilts the schedule: sources with more than the median share lead at the
    start and fade, the others grow, so that the weights add up to the same at every time.
    """
    have = lengths.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    t = targets.filter("source is not null and target_share > 0").join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    one = Window.partitionBy(F.lit(1))  # a row a named source: small by nature
    live = F.col("available") > 0
    t = t.withColumn("share", F.coalesce(F.when(live, F.col("target_share")) / F.sum(F.when(live, F.col("target_share"))).over(one), F.lit(0.0)))
    most = F.min(F.when(F.col("share") > 0, F.col("max_repeats") * F.col("available") / F.nullif(F.col("share"), F.lit(0.0)))).over(one)
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.coalesce(most, F.lit(0.0))
    t = t.withColumn("wanted", F.least(F.col("share") * total, F.col("max_repeats") * F.col("available")))
    t = t.withColumn("lead", F.col("share") > F.percentile_approx(F.when(F.col("share") > 0, F.col("share")), 0.5).over(one))
    a, b = F.sum(F.when(F.col("lead"), F.col("share")).otherwise(0.0)).over(one), F.sum(F.when(F.col("lead"), 0.0).otherwise(F.col("share"))).over(one)
    lower = F.least(F.lit(slope), F.lit(slope) * b / F.nullif(a, F.lit(0.0)))
    t = t.withColumn("bend", F.when((a > 0) & (b > 0), F.when(F.col("lead"), -lower).otherwise(lower * a / F.nullif(b, F.lit(0.0)))).otherwise(0.0))
    return t.select("source", "target_share", F.col("max_repeats").cast("int").alias("max_repeats"), "available", "wanted", "bend")


def position(offset: Column, wanted: Column, bend: Column) -> Column:
    """The time t at which the schedule's integral wanted * (t + bend * (t^2 - t)) reaches the offset."""
    u = F.least(F.lit(1.0), F.greatest(F.lit(0.0), offset / wanted))
    root = F.sqrt((1 - bend) * (1 - bend) + 4 * bend * u)
    return F.when(F.abs(bend) < 1e-9, u).otherwise((root - (1 - bend)) / (2 * bend))


def mix(lengths: DataFrame, targets: DataFrame, total_tokens: float | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(position, doc_id, source, pass_no, n_tokens) in the order of training.

    Every pass goes through a source's documents in another hash order; a document is taken while the source's
    running total stays within its demand. Running totals are two-level sums, over hash buckets of bounded size
    and inside a bucket, so no source is ever gathered in one task. Documents without tokens, and those of
    unnamed or null sources, are never taken.
    """
    d = cut(demands(lengths, targets, total_tokens))
    docs = cut(lengths.filter("n_tokens > 0 and source is not null").join(d.filter("wanted > 0").select("source", "wanted", "bend", "available", "max_repeats"), "source"))
    most = docs.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    buckets = max(1, -(-most // bucket_rows))
    passes = F.least(F.col("max_repeats"), F.ceil(F.col("wanted") / F.col("available")).cast("int"))
    copies = docs.withColumn("pass_no", F.explode(F.sequence(F.lit(1), passes)))
    copies = copies.withColumn("h", F.pmod(F.xxhash64("doc_id", "pass_no"), F.lit(1 << 40))).withColumn("bucket", F.floor(F.col("h") * F.lit(buckets) / F.lit(1 << 40)).cast("int"))
    sums = copies.groupBy("source", "pass_no", "bucket").agg(F.sum("n_tokens").alias("k"))
    before = Window.partitionBy("source", "pass_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "pass_no", "bucket", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "pass_no", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = copies.withColumn("upto", F.sum("n_tokens").over(inside)).join(starts, ["source", "pass_no", "bucket"])
    end = (F.col("pass_no") - 1) * F.col("available") + F.col("start") + F.col("upto")
    taken = run.withColumn("end", end).filter("end <= wanted + 0.5")
    at = position(F.col("end") - F.col("n_tokens") / 2, F.col("wanted"), F.col("bend"))
    chosen = taken.select(F.round(at, 12).alias("position"), "doc_id", "source", "pass_no", "n_tokens")
    return chosen.repartitionByRange("position", "doc_id", "pass_no").sortWithinPartitions("position", "doc_id", "pass_no")


def reached(mixed: DataFrame, lengths: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, available_tokens, chosen_tokens, reached_share, most_repeats) per named source."""
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("chosen_tokens"), F.max("pass_no").alias("most_repeats"))
    have = lengths.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    t = targets.join(have, "source", "left").join(got, "source", "left").fillna(0, ["available_tokens", "chosen_tokens", "most_repeats"])
    whole = F.sum("chosen_tokens").over(Window.partitionBy(F.lit(1)))
    share = F.when(whole > 0, F.round(F.col("chosen_tokens") / whole, 6)).otherwise(0.0)
    return t.select("source", "target_share", "max_repeats", "available_tokens", "chosen_tokens", share.alias("reached_share"), "most_repeats")
