"""Problem 8: documents packed into containers of fixed token capacity.

Method: mixture-controlled packing. Documents wait in one queue per source; every container credits each source
with its share of the capacity (its quantum), and deficit round robin serves the source with the largest credit:
with its longest document that still fits, or, if it has documents beyond the capacity, with a piece as large as
its credit, until nothing fits. Unused credit and debt go on to the next container. Documents are spread over
shards of bounded size by a hash; since every document is packed, what a shard inherits from those before it is
known from token totals alone, so shards are packed in parallel and the carry is still exact.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadloom.session import cut

SHARD_TOKENS, SHARD_ROWS = 4_000_000, 50_000
#: Pieces of a split document are an eighth of the capacity at least, or a quarter of that to fill a container up.
LEAST_PART = 8

Placed = tuple[int, int, int, int, int]  # container, doc_id, piece, start, length


def pack(items: Iterable[tuple[int, str, int]], capacity: int, shares: dict[str, float], carry: dict[str, float], least_part: int = LEAST_PART) -> list[Placed]:
    """(container, doc_id, piece, start, length) for documents (doc_id, source, length).

    Only a document longer than the capacity is split, into pieces in order, each as long as its source's credit
    (and an eighth of the capacity at least, within the room left), so that no container is filled by one source
    while others wait; room of less than a quarter of that is left to whole documents. Documents of length 0 take a container's place but no room. Containers are numbered
    from 0; the result depends on the set of items only.
    """
    out: list[Placed] = []
    queues: dict[str, list[tuple[int, int]]] = {}
    split: dict[str, list[list[int]]] = {}  # per source: tokens left, document, pieces so far, tokens so far
    for doc, source, n in sorted(items):
        if n > capacity:
            split.setdefault(source, []).append([n, doc, 0, 0])
        else:
            queues.setdefault(source, []).append((n, doc))
    for q in (*queues.values(), *split.values()):
        q.sort()
    waiting = {*queues, *split}
    credit = {s: carry.get(s, 0.0) for s in waiting}
    smallest = max(1, capacity // least_part)
    box = 0
    while waiting:
        free = capacity
        for s in waiting:
            credit[s] += shares.get(s, 0.0) * capacity
        turn = [(-credit[s], s) for s in waiting]
        heapify(turn)
        while turn:
            _, s = heappop(turn)
            if not (s in split and free >= min(smallest / 4, split[s][-1][0])) and not (s in queues and queues[s][0][0] <= free):
                continue  # the room only shrinks, so this source has to wait for the next container
            if s in split and free >= min(smallest / 4, split[s][-1][0]):
                left, doc, piece, start = item = split[s][-1]
                n = min(left, free, max(int(credit[s]), smallest))
                if 2 * (free - n) < smallest:  # no room worth leaving
                    n = min(left, free)
                out.append((box, doc, piece, start, n))
                item[:] = [left - n, doc, piece + 1, start + n]
                if n == left:
                    split[s].pop()
                    if not split[s]:
                        del split[s]
            else:
                q = queues[s]
                n, doc = q.pop(bisect_right(q, (free, 1 << 63)) - 1)
                out.append((box, doc, 0, 0, n))
                if not q:
                    del queues[s]
            credit[s] -= n
            free -= n
            if s in queues or s in split:
                heappush(turn, (-credit[s], s))
            else:
                waiting.discard(s)
        box += 1
    return out


def paired(rows: DataFrame, few: DataFrame) -> DataFrame:
    """Every row once for each row of a small parameter table (capacities)."""
    names = few.columns
    listed = few.agg(F.collect_list(F.struct(*names)).alias("few"))
    values = listed.first()["few"]
    if not values:
        return rows.limit(0).select("*", *[F.lit(None).cast(few.schema[c].dataType).alias(c) for c in names])
    array = F.array(*[F.struct(*[F.lit(v[c]).cast(few.schema[c].dataType).alias(c) for c in names]) for v in values])
    return rows.withColumn("few", F.explode(array)).select("*", *[F.col(f"few.{c}").alias(c) for c in names]).drop("few")


def _shares(rows: DataFrame, targets: dict[str, float] | None) -> DataFrame:
    """(source, share): the targets, or each source's share of all tokens; a null source has the name ''."""
    by_source = rows.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.sum("n_tokens").alias("tokens"))
    if targets is None:
        total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # a narrow row a source
        return by_source.select("source", F.coalesce(F.col("tokens") / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("share"))
    return by_source.select("source", F.coalesce(*[F.when(F.col("source") == s, v) for s, v in targets.items()], F.lit(0.0)).alias("share"))


def pack_documents(lengths: DataFrame, specs: DataFrame, targets: dict[str, float] | None = None, shard_tokens: int = SHARD_TOKENS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(spec_no, container_no, doc_id, piece_no, start_token, n_tokens): a container for every document and capacity.

    lengths: (doc_id, source, n_tokens); specs: (spec_no, capacity_tokens), capacities under 1 are ignored.
    targets are token shares by source; by default every window mirrors the shares of the whole table, the
    only ones that all windows can keep when nothing may be left over. A null source is a source of its own.
    """
    rows = cut(lengths.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "n_tokens"))
    total = rows.agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).first()
    t, n = total["t"] or 0, total["n"]
    shards = max(1, -(-t // shard_tokens), -(-n // shard_rows))
    placed = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    share = _shares(rows, targets)
    # what each shard inherits for its sources: target share of all tokens before it less the source's own before it
    sums = placed.groupBy("shard", "source").agg(F.sum("n_tokens").alias("k"))
    up_to = lambda w: w.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = sums.groupBy("shard").agg(F.sum("k").alias("k")).select("shard", F.coalesce(F.sum("k").over(up_to(Window.partitionBy(F.lit(1)))), F.lit(0)).alias("all"))  # a narrow row a shard
    own = F.coalesce(F.sum("k").over(up_to(Window.partitionBy("source"))), F.lit(0))
    carry = (
        sums.select("shard", "source", own.alias("own")).join(totals, "shard").join(share, "source")
        .select("shard", "source", "share", (F.col("share") * F.col("all") - F.col("own")).alias("carry"))
        .groupBy("shard").agg(F.collect_list(F.struct("source", "share", "carry")).alias("state"))
    )
    caps = specs.filter("capacity_tokens >= 1").select("spec_no", F.col("capacity_tokens").cast("bigint").alias("capacity"))
    work = paired(placed, caps)

    def run(key: tuple, docs: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        cols = ["spec_no", "container_no", "doc_id", "piece_no", "start_token", "n_tokens"]
        if docs.empty or state.empty:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in cols})
        st = state["state"].iloc[0]
        shares = {r["source"]: r["share"] for r in sorted(st, key=lambda r: r["source"])}
        carries = {r["source"]: r["carry"] for r in st}
        capacity = int(docs["capacity"].iloc[0])
        got = pack(zip(docs["doc_id"].tolist(), docs["source"], docs["n_tokens"].tolist()), capacity, shares, carries)
        base = int(key[1]) * 1_000_000_000
        return pd.DataFrame([(int(key[0]), base + b, d, p, s, k) for b, d, p, s, k in got], columns=cols)

    schema = "spec_no int, container_no bigint, doc_id bigint, piece_no int, start_token bigint, n_tokens bigint"
    states = paired(carry, caps.select("spec_no")).select(F.col("spec_no").alias("spec_no"), F.col("shard").alias("shard"), "state")
    return work.groupBy("spec_no", "shard").cogroup(states.groupBy("spec_no", "shard")).applyInPandas(run, schema)


def usage(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_no, containers, tokens, fill): how much of the containers' room is used, by capacity."""
    by_box = packed.groupBy("spec_no", "container_no").agg(F.sum("n_tokens").alias("used"))
    return by_box.join(specs.select("spec_no", "capacity_tokens"), "spec_no").groupBy("spec_no").agg(
        F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.round(F.sum("used") / F.sum("capacity_tokens"), 6).alias("fill")
    )


def mixture(packed: DataFrame, lengths: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """(spec_no, container_no, deviation): how far each container's sources are off the target (total variation, 0 to 1).

    Containers without tokens have none.
    """
    share = _shares(lengths, targets)
    docs = lengths.select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    held = packed.filter("n_tokens > 0").join(docs, "doc_id").groupBy("spec_no", "container_no", "source").agg(F.sum("n_tokens").alias("k"))
    used = packed.groupBy("spec_no", "container_no").agg(F.sum("n_tokens").alias("used"))
    parts = held.join(used, ["spec_no", "container_no"]).join(share, "source")
    return parts.groupBy("spec_no", "container_no").agg(F.round(1 - F.sum(F.least(F.col("k") / F.col("used"), F.col("share"))), 6).alias("deviation"))


def mixture_report(deviations: DataFrame, lengths: DataFrame, specs: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """(spec_no, mean_deviation, least_possible): the containers' mean deviation beside a bound that no packing can beat.

    However documents are combined, one of at most the capacity brings its container no nearer to the target than by
    the smaller of its own length and its source's part of the container.
    """
    share = _shares(lengths, targets)
    caps = specs.filter("capacity_tokens >= 1").select("spec_no", F.col("capacity_tokens").alias("c"))
    rows = paired(lengths.select(F.coalesce("source", F.lit("")).alias("source"), "n_tokens").join(share, "source"), caps)
    near = F.when(F.col("n_tokens") > F.col("c"), F.col("n_tokens")).otherwise(F.least(F.col("n_tokens"), F.col("share") * F.col("c")))
    bound = rows.groupBy("spec_no").agg((1 - F.sum(near) / F.nullif(F.sum("n_tokens"), F.lit(0))).alias("b"))
    return deviations.groupBy("spec_no").agg(F.round(F.avg("deviation"), 6).alias("mean_deviation")).join(bound, "spec_no").select(
        "spec_no", "mean_deviation", F.round(F.greatest("b", F.lit(0.0)), 6).alias("least_possible")
    )
