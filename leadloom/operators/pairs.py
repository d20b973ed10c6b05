"""Duplicate pairs without a shared phone or domain, found over all records without comparing all of them.

A pair scores MATCH_THRESHOLD without an exact signal only if no signal counts against it: not both sides may have
a domain, nor both a phone (either alone brings the score under .6). What is left is names and addresses, where the
threshold needs names at least NAME_FLOOR alike. Such names are found exactly: a name is cut into one segment more
than it may have edits, so one segment at least survives in the other name, near its place (segment index over
names, probed by records without phone, since one side of a pair has none). Where names meet, what their distance leaves
to the addresses is held against a bound on those, so the many like names of one trade end there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.constants import MATCH_THRESHOLD
from leadloom.session import cut, respread

from .resolve import pair_score

# .25 * name + .1 * address >= threshold * .35 with a perfect address
NAME_FLOOR = (MATCH_THRESHOLD * 0.35 - 0.1) / 0.25


def _edits(length: Column, floor: float) -> Column:
    """Edits that names of at most this length may be apart; a hair more, so that rounding loses none."""
    return F.floor((1 - floor) * length + 1e-9).cast("int")


def _segment(length: Column, edits: Column, i: Column) -> tuple[Column, Column]:
    """(start from 0, length) of the i-th of edits + 1 segments; the last ones are the longer by one."""
    base, extra = F.floor(length / (edits + 1)).cast("int"), length % (edits + 1)
    long = F.greatest(F.lit(0), i - (edits + 1 - extra))
    return (i * base + long).cast("int"), (base + F.when(i >= edits + 1 - extra, 1).otherwise(0)).cast("int")


def alike_names(names: DataFrame, floor: float = NAME_FLOOR, probes: DataFrame | None = None, threshold: float | None = None) -> DataFrame:
    """(a, b), a < b: all pairs of different names of (name) whose similarity is floor at least; null and '' match none.

    With probes (name), some of the names, only the pairs that one of them belongs to; they alone are cut into all the
    pieces that could meet a segment, which is the costly side.

    With threshold the pairs of rows instead, (left_id, right_id, score, reasons): names holds (name, kind, id, addr), probes
    (name, kind, id, addr, meets), where meets lists the kinds that a probe is compared with, none of which has a signal in
    common with it. Every pair that meets is held against the threshold where it is made, so pairs of like names at unlike
    addresses, which grow with the square of the table, are neither moved nor kept.
    """
    rows = [] if threshold is None else ["kind", "id", "addr"]
    n = respread(names.select("name", *rows).filter("name <> ''").distinct()).withColumn("len", F.length("name"))
    n = _with_marks(n) if rows else n
    longest = F.floor(F.col("len") / floor + 1e-9)
    index = (
        n.withColumn("edits", F.explode(F.sequence(_edits(F.col("len"), floor), _edits(longest, floor)))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("edits"))))
    )
    start, size = _segment(F.col("len"), F.col("edits"), F.col("i"))
    keys = ["kind", "k", "edits", "i", "seg"] if rows else ["k", "edits", "i", "seg"]
    others = ["id", "addr", *MARKS] if rows else []
    index = index.select(F.col("name").alias("x_name"), *[F.col(c).alias(f"x_{c}") for c in others], F.col("len").alias("k"), F.substring(F.col("name"), start + 1, size).alias("seg"), "edits", "i", *rows[:1])
    if rows:
        few = respread(probes.select("name", "id", "addr", F.explode("meets").alias("kind")).filter("name <> ''").distinct()).withColumn("len", F.length("name"))
        few = _with_marks(few)
    else:
        few = n if probes is None else n.join(probes.select("name").distinct(), "name", "left_semi")
    reach = F.col("len") if probes is None else F.floor(F.col("len") / floor + 1e-9).cast("int")
    probe = (
        few.withColumn("k", F.explode(F.sequence(F.ceil(F.col("len") * floor - 1e-9).cast("int"), reach))).withColumn("edits", _edits(F.greatest("len", "k"), floor))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("edits"))))
    )
    start, size = _segment(F.col("k"), F.col("edits"), F.col("i"))
    shift, rest = F.col("len") - F.col("k"), F.col("edits") - F.col("i")
    low = F.greatest(F.lit(0), start - F.col("i"), start + shift - rest)
    high = F.least(F.col("len") - size, start + F.col("i"), start + shift + rest)
    probe = probe.withColumn("low", low.cast("int")).withColumn("high", high.cast("int")).withColumn("size", size).filter("low <= high")
    probe = probe.withColumn("p", F.explode(F.sequence(F.col("low"), F.col("high"))))
    probe = probe.select(F.col("name").alias("y_name"), *[F.col(c).alias(f"y_{c}") for c in others], F.substring(F.col("name"), F.col("p") + 1, F.col("size")).alias("seg"), "k", "edits", "i", *rows[:1])
    # by number, else adaptive execution, which sees bytes and not comparisons, leaves the join to few tasks
    met = respread(probe, *keys).join(respread(index, *keys).hint("shuffle_hash"), keys)
    if rows:  # the join's own code is kept short enough to be compiled: what the marks leave is compared after it
        met = met.filter(_marks_suffice(threshold)).groupBy("x_id", "y_id").agg(F.collect_set(F.struct("x_name", "y_name", "x_addr", "y_addr")).alias("r")).select("x_id", "y_id", F.inline("r"))
    longer = F.greatest(F.length("x_name"), F.length("y_name"))
    far = F.call_function("levenshtein", F.col("x_name"), F.col("y_name"), _edits(longer, floor))
    met = met.filter("x_name <> y_name").filter(far >= 0)
    if not rows:
        return met.select(F.least("x_name", "y_name").alias("a"), F.greatest("x_name", "y_name").alias("b")).distinct()
    return _scored(met.filter(_addresses_suffice(far, longer, threshold)), threshold).distinct()


MARKS = ["name_len", "addr_len", "name_0", "addr_0", "addr_1"]


def _mark(c: Column, i: int, of: int) -> Column:
    """The i-th of so many words of 64 bits, in which every pair of neighbouring letters of a text sets one bit."""
    bits = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda at: F.pmod(F.hash(F.substring(c, at, F.lit(2))), F.lit(64 * of)))
    one = lambda b: F.when((b >= 64 * i) & (b < 64 * i + 64), F.call_function("shiftleft", F.lit(1).cast("bigint"), b - 64 * i)).otherwise(F.lit(0).cast("bigint"))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda all_, b: all_.bitwiseOR(one(b)))


def _with_marks(rows: DataFrame) -> DataFrame:
    name, addr = F.col("name"), F.col("addr")
    return rows.withColumns({"name_len": F.length(name), "addr_len": F.length(addr), "name_0": _mark(name, 0, 1), "addr_0": _mark(addr, 0, 2), "addr_1": _mark(addr, 1, 2)})


def _marks_suffice(threshold: float) -> Column:
    """May rows x_ and y_ reach the threshold, going by their marks, then by their names and the addresses' marks?

    An edit takes two pairs of letters from a text at most.
    """

    def edits(*words: str) -> Column:
        lost = lambda p, q: reduce(Column.__add__, [F.bit_count(F.col(f"{p}_{w}").bitwiseAND(F.bitwise_not(f"{q}_{w}"))) for w in words])
        return F.greatest(lost("x", "y"), lost("y", "x")) / 2

    both = F.col("x_addr_len").isNotNull() & F.col("y_addr_len").isNotNull()
    addr = F.when(both, 0.1 * edits("addr_0", "addr_1") / F.greatest("x_addr_len", "y_addr_len", F.lit(1))).otherwise(0.0)
    most = F.when(both, 0.35 * (1 - threshold)).otherwise(0.25 * (1 - threshold)) + 1e-9
    longer = F.greatest("x_name_len", "y_name_len")
    return (0.25 * edits("name_0") / longer + addr <= most) & (0.25 * F.levenshtein("x_name", "y_name") / longer + addr <= most)


def _addresses_suffice(far: Column, longer: Column, threshold: float) -> Column:
    """May x_addr and y_addr lift names that are so far apart to the threshold? A bound, a hair wide; it ends a comparison of addresses early."""
    name = 1 - far / longer
    least = (threshold * 0.35 - 0.25 * name) / 0.1
    edits = F.floor((1 - least) * F.greatest(F.length("x_addr"), F.length("y_addr")) + 1e-6).cast("int")
    near = (edits >= 0) & (F.call_function("levenshtein", F.col("x_addr"), F.col("y_addr"), F.greatest(edits, F.lit(0))) >= 0)
    return F.when(F.col("x_addr").isNull() | F.col("y_addr").isNull(), name >= threshold - 1e-6).otherwise(near)


def _scored(met: DataFrame, threshold: float) -> DataFrame:
    """(left_id, right_id, score, reasons) of pairs (x_ and y_ name, id, addr) without a signal in common that reach the threshold."""
    none = [F.lit(None).cast("string").alias(f"{p}_{c}") for p in ("x", "y") for c in ("phone", "domain")]
    score, reasons = pair_score("x_", "y_")
    ends = (F.least("x_id", "y_id").alias("left_id"), F.greatest("x_id", "y_id").alias("right_id"))
    return met.select("x_name", "x_addr", "x_id", "y_name", "y_addr", "y_id", *none).select(*ends, score.alias("score"), reasons.alias("reasons")).filter(F.col("score") >= threshold)


def fuzzy_pairs(signals: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """(left_id, right_id, score, reasons): pairs of representatives that reach the threshold without an exact signal.

    signals: (id, name, phone, domain, addr). Records with equal signals are one representative, the smallest id; copies
    are told by membership(). Pairs with an equal phone or domain are links of resolve.exact_classes, not of this.
    Records with an empty name are compared by nothing. Records meet only if the phones and domains that they have
    allow it, so the four kinds of records are joined kind by kind, each pair once.
    """
    reps = signals.groupBy("name", "phone", "domain", "addr").agg(F.min("id").alias("id")).filter("name <> ''")
    kind = F.when(F.col("phone").isNotNull(), 1).otherwise(0) + F.when(F.col("domain").isNotNull(), 2).otherwise(0)
    kinds = cut(reps.select("name", "addr", "id", kind.alias("kind")))
    # of a pair that may match, one side has no phone; a record with phone and domain meets only those with neither
    meets = F.when(F.col("kind") == 2, F.array(F.lit(1))).otherwise(F.array(*[F.lit(k) for k in range(3)]))
    near = alike_names(kinds.filter("kind <> 3"), probes=kinds.filter("kind in (0, 2)").withColumn("meets", meets), threshold=threshold)
    bare = kinds.filter("kind = 0").withColumn("meets", F.array(F.lit(3)))
    near = near.unionByName(alike_names(kinds.filter("kind in (0, 3)"), probes=bare, threshold=threshold))
    # kinds that have no signal in common, told apart by the join key, so rows that can't match don't meet
    allowed = F.filter(F.array(*[F.lit(k) for k in range(4)]), lambda k: F.col("kind").bitwiseAND(k) == 0)
    x = kinds.select("name", F.col("name").alias("x_name"), F.col("addr").alias("x_addr"), F.col("id").alias("x_id"), F.explode(allowed).alias("kind"))
    y = kinds.select("name", F.col("name").alias("y_name"), F.col("addr").alias("y_addr"), F.col("id").alias("y_id"), "kind")
    return near.unionByName(_scored(x.join(y, ["name", "kind"]).filter("x_id < y_id"), threshold))


def membership(signals: DataFrame) -> DataFrame:
    """(id, representative): every record with the record that stands for its equal signals in fuzzy_pairs."""
    keys = ["name", "phone", "domain", "addr"]
    none = [F.coalesce(c, F.lit("\0")).alias(c) for c in keys]
    s = signals.select("id", *none)
    return s.join(s.groupBy(*keys).agg(F.min("id").alias("representative")), keys).select("id", "representative")


def first_signals(businesses: DataFrame, websites: DataFrame, phones: DataFrame) -> DataFrame:
    """(id, name, phone, website, address) for resolution: each business with its first website and first phone.

    businesses: (id, name, address); websites: (id, seq, website); phones: (id, seq, phone). The first is the least seq;
    null values are passed over; a business without any keeps null.
    """
    first = lambda df, c: df.filter(F.col(c).isNotNull()).groupBy("id").agg(F.min_by(c, F.struct("seq", c)).alias(c))
    return businesses.join(first(phones, "phone"), "id", "left").join(first(websites, "website"), "id", "left").select("id", "name", "phone", "website", "address")


def merge_children(children: dict[str, DataFrame], mapping: DataFrame, key: str = "owner") -> dict[str, DataFrame]:
    """Every child table with its owner replaced by the owner's survivor; the table named websites keeps one row a survivor and domain.

    mapping: (id, survivor). Of a survivor's equal domains its own row stays, else that of the smallest former owner.
    """
    m = mapping.select(F.col("id").alias(key), "survivor")
    out = {}
    for name, df in children.items():
        j = df.join(m, key, "left").withColumn("_was", F.col(key)).withColumn(key, F.coalesce("survivor", F.col(key))).drop("survivor")
        if name == "websites":
            rest = [c for c in j.columns if c not in (key, "domain", "_was")]
            order = F.struct((F.col("_was") != F.col(key)).alias("moved"), F.col("_was").alias("was"), *rest)
            best = j.groupBy(key, "domain").agg(F.min(order).alias("b"))
            j = best.select(key, "domain", *[F.col(f"b.{c}").alias(c) for c in rest])
        out[name] = j.drop("_was").select(df.columns)
    return out


def merge_ids(jobs: DataFrame, mapping: DataFrame, column: str = "ids") -> DataFrame:
    """Arrays of ids with every merged id taken out and its survivor put in, each id once, sorted. A null array stays null."""
    m = mapping.select(F.col("id").alias("_x"), "survivor")
    flat = jobs.withColumn("_row", F.monotonically_increasing_id()) if "job" not in jobs.columns else jobs.withColumn("_row", F.col("job"))
    parts = flat.select("_row", F.explode(column).alias("_x")).join(m, "_x", "left").groupBy("_row").agg(F.sort_array(F.collect_set(F.coalesce("survivor", "_x"))).alias("_new"))
    empty = F.when(F.col(column).isNotNull(), F.array().cast(jobs.schema[column].dataType))
    return flat.join(parts, "_row", "left").withColumn(column, F.coalesce("_new", empty)).select(jobs.columns)
