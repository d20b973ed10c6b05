"""Duplicate businesses: pair scores, classes by exact signals, survivors and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.constants import MATCH_THRESHOLD
from leadloom.functions import text, urls

from .graph import connected


def signals(records: DataFrame) -> DataFrame:
    """(id, name, phone, domain, addr): normalised signals of records (id, name, phone, website, address struct), once each."""
    a = "address"
    return records.select(
        "id", text.name_key(F.col("name")).alias("name"), text.phone_key(F.col("phone")).alias("phone"), urls.domain(F.col("website")).alias("domain"),
        F.when(F.col(a).isNotNull(), text.address_key(*[F.col(f"{a}.{c}") for c in ("line1", "locality", "city", "postal_code", "country")])).alias("addr"),
    ).distinct()


def pair_score(l: str, r: str) -> tuple[Column, Column]:
    """(score, reasons) of two signal rows, whose columns have the prefixes l and r.

    A signal counts only where both sides have it: domain .35, phone .30, name .25 by likeness, address .10 by
    likeness; the sum is divided by the weights that counted. Terms are added in this order.
    """
    c = lambda p, n: F.col(f"{p}{n}")
    both = lambda n: c(l, n).isNotNull() & c(r, n).isNotNull()
    same = lambda n: F.coalesce(both(n) & (c(l, n) == c(r, n)), F.lit(False))
    name = F.coalesce(text.similarity(c(l, "name"), c(r, "name")), F.lit(0.0))
    addr = text.similarity(c(l, "addr"), c(r, "addr"))
    num = lambda cond, v: F.when(cond, v).otherwise(0.0)
    score = num(same("domain"), 0.35) + num(same("phone"), 0.3) + 0.25 * name + num(both("addr"), 0.1 * addr)
    weight = num(both("domain"), 0.35) + num(both("phone"), 0.3) + 0.25 + num(both("addr"), 0.1)
    reasons = F.filter(
        F.array(
            F.when(same("domain"), "exact_domain"), F.when(same("phone"), "exact_phone"), F.when(name >= 0.9, "strong_name").when(name >= 0.75, "fuzzy_name"),
            F.when(both("addr") & (addr >= 0.9), "address"),
        ), lambda x: x.isNotNull(),
    )
    return score / weight, reasons


def score_pairs(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(left_id, right_id, score, reasons, duplicate) of given pairs, by equi-joins on the ids; unknown ids drop out."""
    s = signals(records)
    l = s.toDF("left_id", "l_name", "l_phone", "l_domain", "l_addr")
    r = s.toDF("right_id", "r_name", "r_phone", "r_domain", "r_addr")
    j = pairs.select("left_id", "right_id").join(l, "left_id").join(r, "right_id")
    score, reasons = pair_score("l_", "r_")
    j = j.select("left_id", "right_id", score.alias("score"), reasons.alias("reasons"))
    exact = F.array_contains("reasons", "exact_domain") | F.array_contains("reasons", "exact_phone")
    return j.withColumn("duplicate", (F.col("score") >= MATCH_THRESHOLD) | exact)


def exact_classes(records: DataFrame) -> DataFrame:
    """(id, group_id, links): records joined directly or indirectly by an equal phone or domain.

    Every record with a signal is tied to the signal's smallest id, so a phone or domain shared by a third of
    all rows makes one edge a record, never all pairs. links counts the other records with an equal signal,
    each signal for itself. Records without signal are groups of their own.
    """
    s = signals(records)
    keys = s.select("id", F.explode(F.array(F.concat(F.lit("p:"), "phone"), F.concat(F.lit("d:"), "domain"))).alias("k")).filter("k is not null").distinct()
    heads = keys.groupBy("k").agg(F.min("id").alias("head"), F.count("*").alias("n"))
    tied = keys.join(heads, "k")
    groups = connected(tied.select(F.col("head").alias("a"), F.col("id").alias("b")))
    counts = tied.groupBy("id").agg(F.sum(F.col("n") - 1).alias("links"))
    ids = s.select("id").distinct()
    return ids.join(groups.withColumnRenamed("node", "id"), "id", "left").join(counts, "id", "left").select(
        "id", F.coalesce("group_id", "id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links")
    )


def survivors(groups: DataFrame, seen: DataFrame) -> DataFrame:
    """(id, survivor): the earliest seen record of each group; ties go to the smaller id, unknown times come last.

    groups: (id, group_id); seen: (id, at).
    """
    g = groups.join(seen.groupBy("id").agg(F.min("at").alias("at")), "id", "left")
    key = F.struct(F.coalesce(F.unix_micros(F.col("at").cast("timestamp")), F.lit(1 << 62)).alias("t"), "id")
    first = g.groupBy("group_id").agg(F.min(key)["id"].alias("survivor"))
    return g.join(first, "group_id").select("id", "survivor")


def repoint(children: DataFrame, key: str, mapping: DataFrame, unique: list[str] | None = None) -> DataFrame:
    """Children whose key is a merged record now belong to its survivor; with unique, once per survivor and those columns."""
    m = mapping.select(F.col("id").alias(key), F.col("survivor").alias("_survivor"))
    out = children.join(m, key, "left").withColumn(key, F.coalesce("_survivor", F.col(key))).drop("_survivor")
    return out.dropDuplicates([key, *unique]) if unique else out


def attach_or_create(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates (cid, domain, phone) with the known record (id, domain, phone) of an equal domain, else phone; null id is new.

    Of several known records the smallest id counts.
    """
    by = lambda c: known.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min("id").alias(f"by_{c}"))
    j = candidates.join(by("domain"), "domain", "left").join(by("phone"), "phone", "left")
    return j.withColumn("id", F.coalesce("by_domain", "by_phone")).drop("by_domain", "by_phone")
