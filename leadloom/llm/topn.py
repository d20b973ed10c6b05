"""Problem 4: the N best items of every group.

Method: a row_number window ordered by score and identifier under a rank filter. Catalyst turns the filter
into group-limit operators before and after the shuffle, so a partition sends at most N rows of a group,
however large the group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, groups: list[str], order: list[Column], n: int, rank: str = "rank_no") -> DataFrame:
    """The first n rows of every group in the given order, with their rank. Ties must be broken by order."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def current_scores(scores: DataFrame) -> DataFrame:
    """(lead_id, score): sales_opportunity of each lead's latest run; equal times go to the larger score_no.

    A null scored_at counts as earliest. Leads whose latest score is null or NaN are left out. Repeats of a
    row change nothing.
    """
    latest = top_n(
        scores.filter("lead_id is not null").select("lead_id", "scored_at", "score_no", "sales_opportunity"),
        ["lead_id"], [F.desc_nulls_last("scored_at"), F.desc_nulls_last("score_no")], 1,
    )
    return latest.filter(F.col("sales_opportunity").isNotNull() & ~F.isnan("sales_opportunity")).select(
        "lead_id", F.col("sales_opportunity").alias("score")
    )


def top_leads(leads: DataFrame, scores: DataFrame, n: int = 5) -> DataFrame:
    """(city, category, rank_no, lead_id): the n best leads of every city and category, as stored.

    Null or empty cities, categories and lead ids are left out; a lead counts once in a group however
    often its row is repeated.
    """
    members = (
        leads.select("city", "category", "lead_id")
        .filter("city <> '' and category <> '' and lead_id is not null")
        .distinct()
    )
    ranked = top_n(
        members.join(current_scores(scores), "lead_id"), ["city", "category"], [F.desc("score"), F.asc("lead_id")], n
    )
    return ranked.select("city", "category", F.col("rank_no").cast("int"), "lead_id")
