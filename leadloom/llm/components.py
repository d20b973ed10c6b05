"""Problem 2: group identifiers for records linked directly or indirectly.

Method: low-diameter decomposition. On every level each vertex draws an exponentially distributed head
start, clusters grow along the edges from the vertices in the order of their start times, every cluster is
contracted to one super-vertex, and the recursion goes on with the edges between clusters only. The
assignments of the levels are composed at the end. A level removes an expected share exp(-beta) of the
edges, so the number of levels is logarithmic, long chains included. Once few edges are left, one task finishes
them: rounds that each move a handful of rows cost the driver as many stages as those that move the bulk.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.session import cut

BETA = 0.05
GROWTH_ROUNDS = 8
LAST_EDGES = 100_000  # so many edges between clusters, about 1.6 MB, are finished in one task
PART_ROWS = 500_000  # rows of two or three numbers in a partition


def _head_start(node: Column, level: int, beta: float) -> Column:
    """Exponential with rate beta, drawn from a hash of the vertex and the level, so reruns agree."""
    unit = (F.pmod(F.xxhash64(node, F.lit(level)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(unit) / beta


def _partitions(spark: SparkSession, rows: int) -> int:
    """Partitions for so many narrow rows: as many as the session's shuffles have at most, as there are cores at least."""
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(most, max(spark.sparkContext.defaultParallelism, -(-rows // PART_ROWS)))


def _finish(edges: DataFrame) -> DataFrame:
    """(node, name) of every node of (a, b), by union-find in one task; name is the smallest node that it is linked to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        for b in batches:
            for x, y in zip(b.a.tolist(), b.b.tolist()):
                x, y = top(x), top(y)
                up[max(x, y)] = min(x, y)
        yield pd.DataFrame([(x, top(x)) for x in list(up)], columns=["node", "name"])

    return edges.select("a", "b").repartition(1).mapInPandas(run, "node bigint, name bigint")


def _grow(arcs: DataFrame, level: int, beta: float, rounds: int, parts: int) -> DataFrame:
    """(node, centre): the cluster that reaches each vertex first.

    arcs holds both directions, partitioned by src into parts. A vertex's arrival time is the least of dist(u, node) -
    head_start(u); it is relaxed along the arcs, one hop a round, until nothing changes or the rounds are used up. Only
    vertices whose arrival changed in the last round send again, and offers are reduced to the best one before they
    move; arcs and states stay where they are. Any state is a valid clustering (a centre is always connected to its
    members), so ending early costs levels, not truth.
    """
    nodes = arcs.select(F.col("src").alias("node")).distinct()
    state = nodes.select("node", (-_head_start(F.col("node"), level, beta)).alias("at"), F.col("node").alias("centre"), F.lit(True).alias("moved"))
    state = cut(state.repartition(parts, "node"), parts)
    for _ in range(rounds):
        offers = arcs.join(state.filter("moved").select(F.col("node").alias("src"), "at", "centre"), "src").groupBy(F.col("dst").alias("node")).agg(
            F.min(F.struct((F.col("at") + 1).alias("at"), "centre")).alias("offer")
        )
        better = F.col("offer").isNotNull() & (F.col("offer") < F.struct("at", "centre"))
        new = state.join(offers, "node", "left").select(
            "node", F.when(better, F.col("offer.at")).otherwise(F.col("at")).alias("at"), F.when(better, F.col("offer.centre")).otherwise(F.col("centre")).alias("centre"), better.alias("moved")
        )
        state = cut(new, parts)
        if state.filter("moved").isEmpty():
            break
    return state.select("node", "centre")


def connected_groups(
    links: DataFrame, left: str, right: str, beta: float = BETA, rounds: int = GROWTH_ROUNDS, last_edges: int = LAST_EDGES
) -> DataFrame:
    """(node, group_id) for every node that occurs in links; group_id is the smallest node of the group.

    Nulls: a link with a null end links nothing, its other end stays a node of its own. Links of a node with
    itself and repeated links add nothing. An empty table gives an empty result. Extra columns are ignored.
    No group is ever gathered in one task: a cluster is known only as one (node, name) row per member. What is left
    when last_edges edges or fewer join the clusters goes to one task, which that number bounds.
    """
    spark = links.sparkSession
    pairs = links.select(F.col(left).alias("a"), F.col(right).alias("b"))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).filter("id is not null").distinct()
    seed = 0
    while True:  # vertices travel as 64-bit hashes; should two ids ever share one, another seed is taken
        ids = cut(ids.select("id", F.xxhash64("id", F.lit(seed)).alias("node")))
        if ids.groupBy("node").count().filter("count > 1").isEmpty():
            break
        seed += 1
    h = lambda c: F.xxhash64(c, F.lit(seed))
    edges = cut(
        pairs.filter("a is not null and b is not null and a <> b").select(h("a").alias("a"), h("b").alias("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    names: list[DataFrame] = []
    level = 0
    while left_over := edges.count():
        if left_over <= last_edges:
            names.append(cut(_finish(edges), 1))
            break
        parts = _partitions(spark, 2 * left_over)
        arcs = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        arcs = cut(arcs.select(F.col("e.a").alias("src"), F.col("e.b").alias("dst")).repartition(parts, "src"), parts)
        named = _grow(arcs, level, beta, rounds, parts).toDF("node", "name")
        names.append(named)
        na, nb = named.toDF("a", "na"), named.toDF("b", "nb")
        edges = cut(
            edges.join(na, "a").join(nb, "b").filter("na <> nb")
            .select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
            .distinct(), parts
        )
        level += 1

    def compose(so_far: DataFrame, step: DataFrame) -> DataFrame:
        s = step.toDF("top", "next")
        return so_far.join(s, "top", "left").select("id", F.coalesce("next", "top").alias("top"))

    grouped = cut(reduce(compose, names, ids.select("id", F.col("node").alias("top"))))
    least = grouped.groupBy("top").agg(F.min("id").alias("group_id"))
    return grouped.join(least, "top").select(F.col("id").alias("node"), "group_id")


def match_groups(matches: DataFrame, threshold: float = 0.82) -> DataFrame:
    """(record_id, group_id) over rows (left_id, right_id, entity_match_score).

    Ids are compared in lower case without outer blanks. Rows whose score is null, NaN or under the
    threshold name records but link nothing.
    """
    clean = lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    ids = matches.select(clean("left_id").alias("l"), clean("right_id").alias("r"), F.col("entity_match_score").alias("s"))
    linked = F.col("s").isNotNull() & ~F.isnan("s") & (F.col("s") >= threshold)
    # an unlinked pair counts as two lone ends
    rows = ids.select(
        F.explode(
            F.when(linked & F.col("l").isNotNull() & F.col("r").isNotNull(), F.array(F.struct("l", "r")))
            .otherwise(F.array(F.struct("l", F.lit(None).cast("string").alias("r")), F.struct(F.col("r").alias("l"), F.lit(None).cast("string").alias("r"))))
        ).alias("p")
    ).select("p.l", "p.r")
    return connected_groups(rows, "l", "r").select(F.col("node").alias("record_id"), "group_id")
