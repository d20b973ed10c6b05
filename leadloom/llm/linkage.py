"""Problem 7: the same business seen by several providers, without a common key.

Method: candidate pairs from blocks on the rarest name tokens, joined with phone, building, web site or city;
each pair gets prior log-odds from its partial agreements; then loopy belief propagation with one-to-one
factors (a record has at most one partner in each other provider): messages go between pairs through window
sums until they settle, and every pair ends with a marginal match probability. Pairs that have a token and the
city in common, but neither a like name nor another trait, are counted, never made. Accepted pairs are closed
transitively, since a business that moved and changed its number shows both ends only through a third record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.session import cut, respread

from .addresses import KEY, buildings, deletions, entity_texts, folded, one_edit, one_reading, places, read_addresses

# What is no part of a business name, and hosts' leading labels.
NOISE = r"\b(pvt|ltd|limited|llc|llp|inc|gmbh|co|corp|plc|s l|s a|sl|the|and|official|new branch|24h)\b"
HOST = r"^\s*(?:https?://)?(?:www\.|m\.)?([^/:?#\s]+\.[^/:?#\s]+)"
# Prior log-odds of a match and what each piece of evidence adds.
WEIGHTS = {
    "prior": -1.0, "name": 2.0, "other_name": -12.0, "phone": 5.0, "other_phone": -3.0, "building": 4.0,
    "other_building": -3.5, "other_city": -1.0, "web": 1.5, "other_web": -0.5,
}
NAME_ALIKE = 0.8
SHARED_WEB_NAMES = 12
SHARED_PHONE_PLACES = 12
# Blocks of a city and token with more records are joined by like names; either way gives the same result.
CROWD = 64

def name_tokens(c: Column) -> Column:
    """Words of a business name without legal forms, remarks, town suffix and possessive endings."""
    split = F.regexp_replace(F.regexp_replace(c, r"\bGmbH\b", " "), r"(?<=\p{Ll})(?=\p{Lu})|&", " ")
    s = F.regexp_replace(split, r"\([^)]*\)|[®™\"“”]", " ")
    s = F.regexp_replace(s, r"\s-\s[^-]*$", " ")
    s = F.regexp_replace(folded(s), r"['’]+s?\b", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9]+", " "), NOISE, " ")
    return F.array_distinct(F.filter(F.split(F.trim(s), r"\s+"), lambda w: w != ""))


def phone_key(c: Column) -> Column:
    """The last ten digits; null for fewer or for one digit repeated."""
    d = F.regexp_replace(c, r"\D", "")
    return F.when((F.length(d) >= 10) & ~F.substring(d, -10, 10).rlike(r"^(\d)\1{9}$"), F.substring(d, -10, 10))


def token_roots(tokens: DataFrame) -> DataFrame:
    """(t, root): for each distinct token of (t, n) its most frequent spelling within one edit, itself included.

    Found through the deletion neighbourhood; ties go to the smaller spelling; short tokens are their own.
    """
    long = tokens.filter("length(t) > 4").withColumn("v", F.explode(deletions(F.col("t"))))
    a, b = long.select("t", "v"), long.select(F.col("t").alias("u"), "n", "v")
    near = a.join(b, "v").filter((F.col("t") == F.col("u")) | one_edit(F.col("t"), F.col("u")))
    best = near.groupBy("t").agg(F.min(F.struct((-F.col("n")).alias("m"), "u"))["u"].alias("root"))
    return best.unionByName(tokens.filter("length(t) <= 4").select("t", F.col("t").alias("root")))


def prepared(entities: DataFrame, leads: DataFrame) -> DataFrame:
    """One row a record: provider, weighted name tokens, block keys, phone, web host, building and city.

    A token weighs by the rarity of its root spelling, so a misspelt common word isn't taken for a rare name. The
    block keys are the two weightiest tokens and their roots. A web host used under more than
    SHARED_WEB_NAMES different names is a directory and says nothing; so does a phone under more than
    SHARED_PHONE_PLACES different names or in as many buildings, a switchboard or a made-up number.
    """
    once = entities.select("record_no", "provider_id", "name", "phone", "website").filter("record_no is not null").distinct()
    read = cut(one_reading(read_addresses(entity_texts(entities), places(leads))))
    b = buildings(read).select(F.col("id").alias("record_no"), F.concat_ws("|", *KEY).alias("building"), F.col("city").alias("b_city"))
    cities = read.select(F.col("id").alias("record_no"), F.col("city").alias("a_city"))
    base = cut(
        once.select("record_no", "provider_id", name_tokens(F.col("name")).alias("tokens"), phone_key(F.col("phone")).alias("phone"),
                    F.nullif(F.regexp_extract(F.lower("website"), HOST, 1), F.lit("")).alias("web"))
        .join(b, "record_no", "left").join(cities, "record_no", "left")
        .withColumn("city", F.coalesce("b_city", "a_city")).drop("b_city", "a_city")
    )
    words = base.select("record_no", F.explode("tokens").alias("t"))
    counts = words.groupBy("t").agg(F.count("*").alias("n"))
    roots = token_roots(counts).join(counts, "t")
    total = F.lit(float(max(1, base.count())))
    rarity = roots.groupBy("root").agg(F.log(total / F.sum("n") + 1.0).alias("w"))
    known = roots.join(rarity, "root").select("t", "root", "w")
    weighted = words.join(known, "t").groupBy("record_no").agg(F.sort_array(F.collect_list(F.struct("w", "t", "root")), False).alias("ws"))
    webs = base.filter("web is not null").groupBy("web").agg(F.count_distinct(F.array_join("tokens", " ")).alias("names")).filter(F.col("names") > SHARED_WEB_NAMES).select("web", F.lit(True).alias("shared"))
    lines = base.filter("phone is not null").groupBy("phone").agg(F.count_distinct(F.array_join("tokens", " ")).alias("names"), F.count_distinct("building").alias("places"))
    lines = lines.filter((F.col("names") > SHARED_PHONE_PLACES) | (F.col("places") > SHARED_PHONE_PLACES)).select("phone", F.lit(True).alias("switchboard"))
    full = base.drop("tokens").join(weighted, "record_no", "left").join(webs, "web", "left").join(lines, "phone", "left")
    top = F.slice("ws", 1, 2)
    return full.select(
        "record_no", "provider_id", F.when(F.col("switchboard").isNull(), F.col("phone")).alias("phone"), F.when(F.col("shared").isNull(), F.col("web")).alias("web"), "building", "city",
        F.coalesce(F.transform("ws", lambda x: F.struct(x["w"].alias("w"), x["t"].alias("t"))), F.array().cast("array<struct<w:double,t:string>>")).alias("ws"),
        F.coalesce(F.array_distinct(F.concat(F.transform(top, lambda x: x["t"]), F.transform(top, lambda x: x["root"]))), F.array().cast("array<string>")).alias("keys"),
    )


def candidates(records: DataFrame) -> DataFrame:
    """(l, r): pairs of different providers that share a rare name token, in any spelling, and one more trait.

    Phone and building pairs are joined as they are. Pairs with only host or city in common need one side
    without phone or without building (else they conflict in both and can't match), so only such records are
    joined with their block, however many share it. A city's block of a common token grows with the square of the
    table, so there only like names are joined; the rest of the block is counted by unlike_mass.
    """
    r = records.select("record_no", "provider_id", "phone", "building", "web", "city", F.explode("keys").alias("v"))

    def strong(key: str) -> DataFrame:
        k = r.filter(F.col(key).isNotNull()).select("record_no", "provider_id", key, "v")
        a, b = k.toDF("l", "lp", key, "v"), k.toDF("r", "rp", key, "v")
        return a.join(b, [key, "v"]).filter("l < r and lp <> rp").select("l", "r")

    k = r.filter("web is not null").select("record_no", "provider_id", "web", "v", _open().alias("open"))
    a, b = k.filter("open").drop("open").toDF("o", "op", "web", "v"), k.drop("open").toDF("x", "xp", "web", "v")
    weak = a.join(b, ["web", "v"]).filter("op <> xp").select(F.least("o", "x").alias("l"), F.greatest("o", "x").alias("r"))
    return strong("phone").unionByName(strong("building")).unionByName(weak).unionByName(_like_in_city(records)).distinct()


def _open() -> Column:
    return F.col("phone").isNull() | F.col("building").isNull()


def _like(x: Column, y: Column) -> Column:
    """Equal tokens, one edit, two in tokens of one length, or an abbreviation."""
    shorter, longer = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    edits = (shorter >= 4) & ((F.levenshtein(x, y, 1) >= 0) | ((shorter == longer) & (shorter >= 5) & (F.levenshtein(x, y, 2) >= 0)))
    return (x == y) | edits | ((shorter >= 3) & (x.startswith(y) | y.startswith(x)))


def like_tokens(tokens: DataFrame, by: list[str]) -> DataFrame:
    """(*by, t, u): every token of (*by, t) with all tokens of its block that are like it, itself included.

    Tokens one edit apart share a word with at most one letter less, those of one length two edits apart a word with
    two letters less; an abbreviation is a beginning of the other.
    """
    t = cut(respread(tokens.select(*by, "t").distinct()))
    less = lambda i: F.concat(F.substring(F.col("t"), F.lit(1), i - 1), F.substring(F.col("t"), i + 1, F.length("t")))
    one = t.filter("length(t) >= 4").select(*by, "t", F.explode(F.sequence(F.lit(0), F.length("t"))).alias("i")).select(*by, "t", F.when(F.col("i") == 0, F.xxhash64("t")).otherwise(F.xxhash64(less(F.col("i")))).alias("k"))
    two = t.filter("length(t) >= 5").select(*by, "t", F.explode(F.sequence(F.lit(1), F.length("t") - 1)).alias("i")).select(*by, "t", "i", F.explode(F.sequence(F.col("i") + 1, F.length("t"))).alias("j"))
    middle = F.substring(F.col("t"), F.col("i") + 1, F.col("j") - F.col("i") - 1)
    two = two.select(*by, "t", F.xxhash64(F.concat(F.substring(F.col("t"), F.lit(1), F.col("i") - 1), middle, F.substring(F.col("t"), F.col("j") + 1, F.length("t"))), F.length("t")).alias("k"))
    kept = one.unionByName(two)
    near = kept.join(kept.withColumnRenamed("t", "u"), [*by, "k"]).filter("t < u").select(*by, "t", "u")
    starts = t.filter("length(t) > 3").select(*by, F.col("t").alias("u"), F.explode(F.sequence(F.lit(3), F.length("t") - 1)).alias("n")).select(*by, "u", F.substring(F.col("u"), F.lit(1), F.col("n")).alias("t"))
    pairs = near.unionByName(t.join(starts, [*by, "t"]).select(*by, "t", "u")).distinct().filter(_like(F.col("t"), F.col("u")))
    return pairs.unionByName(pairs.select(*by, F.col("u").alias("t"), F.col("t").alias("u"))).unionByName(t.select(*by, "t", F.col("t").alias("u")))


def _like_in_city(records: DataFrame) -> DataFrame:
    """(l, r): pairs of one city that share a key, one side open: small blocks whole, of others all alike by NAME_ALIKE.

    Of alike names no more than 1 - NAME_ALIKE of both weights finds nothing like it. A name's head is its weightiest
    tokens, just enough to outweigh that share of its own weight: so one token at least of either head finds a like one.
    """
    r = records.filter("city is not null and provider_id is not null").select("record_no", "provider_id", "city", F.explode("keys").alias("v"), _open().alias("open"), "ws")
    r = cut(r.join(r.groupBy("city", "v").agg((F.count("*") > CROWD).alias("crowd")), ["city", "v"]))

    def met(a: DataFrame, b: DataFrame, *more: str) -> DataFrame:
        on = ["city", "v", *more]
        a, b = a.select("record_no", "provider_id", *on).toDF("o", "op", *on), b.select("record_no", "provider_id", *on).toDF("x", "xp", *on)
        return a.join(b, on).filter("op <> xp").select(F.least("o", "x").alias("l"), F.greatest("o", "x").alias("r"))

    few, many = r.filter("not crowd"), r.filter("crowd")
    weight = lambda ws: F.aggregate(ws, F.lit(0.0), lambda s, x: s + x["w"])
    heads = F.transform("ws", lambda x, i: F.struct(x["t"].alias("t"), (weight(F.slice("ws", 1, i)) <= (1 - NAME_ALIKE) * weight(F.col("ws")) + 1e-9).alias("head")))
    words = many.select("record_no", "provider_id", "city", "v", "open", F.explode(heads).alias("x")).select("record_no", "provider_id", "city", "v", "open", "x.t", "x.head")
    glued = many.withColumn("u", F.array_join(F.array_sort(F.transform("ws", lambda x: x["t"])), ""))
    spelt, asis = words.filter("open").join(like_tokens(words, ["city", "v"]), ["city", "v", "t"]), words.withColumn("u", F.col("t"))
    by_name = met(spelt.filter("head"), asis, "u").unionByName(met(spelt.filter("not head"), asis.filter("head"), "u")).unionByName(met(glued.filter("open"), glued, "u"))
    return met(few.filter("open"), few).unionByName(by_name)


def name_likeness(a: Column, b: Column) -> Column:
    """Share of the name tokens' weight that finds a like token on the other side (equal, one edit, abbreviation)."""
    def found(p: Column, q: Column) -> Column:
        return F.aggregate(p, F.lit(0.0), lambda s, x: s + F.when(F.exists(q, lambda y: _like(x["t"], y["t"])), x["w"]).otherwise(0.0))

    total = lambda p: F.aggregate(p, F.lit(0.0), lambda s, x: s + x["w"])
    glued = lambda p: F.array_join(F.array_sort(F.transform(p, lambda x: x["t"])), "")
    both = total(a) + total(b)
    return F.when(glued(a) == glued(b), 1.0).when(both > 0, (found(a, b) + found(b, a)) / both).otherwise(0.0)


def scored(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(l, r, lp, rp, theta): the prior log-odds of every candidate pair."""
    f = records.select("record_no", "provider_id", "ws", "phone", "building", "web", "city")
    a, b = f.toDF("l", "lp", "lws", "lph", "lb", "lw", "lc"), f.toDF("r", "rp", "rws", "rph", "rb", "rw", "rc")
    j = pairs.join(a, "l").join(b, "r")
    w = WEIGHTS

    def judge(x: str, y: str, yes: float, no: float) -> Column:
        return F.when(F.col(x).isNull() | F.col(y).isNull(), 0.0).when(F.col(x) == F.col(y), yes).otherwise(no)

    place = F.when(F.col("lb").isNotNull() & F.col("rb").isNotNull(), judge("lb", "rb", w["building"], w["other_building"])).otherwise(judge("lc", "rc", 0.0, w["other_city"]))
    theta = (
        F.lit(w["prior"]) + F.when(name_likeness(F.col("lws"), F.col("rws")) >= NAME_ALIKE, w["name"]).otherwise(w["other_name"])
        + judge("lph", "rph", w["phone"], w["other_phone"]) + place + judge("lw", "rw", w["web"], w["other_web"])
    )
    return cut(j.select("l", "r", "lp", "rp", theta.alias("theta")))  # read several times


def unlike_mass(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(record, provider, above, mass): odds of the pairs of one city that share a key and aren't among pairs, by record.

    above tells the sum over partners with a larger number from that over smaller ones. Such a pair has no like name
    and no equal phone, building or host, so its log-odds follow from which of these each side lacks. The partners are
    counted by city, keys, provider and what they lack: those that share any of a record's keys are those of each set
    of its keys, added and taken off in turn. Of these the pairs made are taken off.
    """
    lacks = sum(F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(("phone", "building", "web")))
    r = cut(records.filter("city is not null and provider_id is not null and size(keys) > 0").select("record_no", "provider_id", "city", F.array_sort("keys").alias("keys"), lacks.alias("lacks")))
    a, b = r.drop("keys").toDF("l", "lp", "city", "ll"), r.drop("keys", "provider_id").toDF("r", "city", "rl")
    made = cut(pairs.select("l", "r", "rp").join(a, "l").join(b, ["r", "city"]).filter("(ll & 3) <> 0 or (rl & 3) <> 0"))
    wanted = pairs.select(F.col("l").alias("record_no"), F.col("rp").alias("provider")).unionByName(pairs.select(F.col("r").alias("record_no"), F.col("lp").alias("provider"))).distinct()
    sets = lambda df: df.withColumn("m", F.explode(F.expr("sequence(1, shiftleft(1, size(keys)) - 1)"))).withColumn(
        "keys", F.array_join(F.expr("filter(keys, (x, i) -> (shiftright(m, i) & 1) = 1)"), " "))
    there = sets(r).select("city", "keys", F.col("provider_id").alias("provider"), "record_no", "lacks", F.lit(0).alias("sign"))
    asked = sets(r.drop("provider_id").join(wanted, "record_no")).select("city", "keys", "provider", "record_no", "lacks", F.when(F.bit_count("m") % 2 == 1, 1).otherwise(-1).alias("sign"))
    block = Window.partitionBy("city", "keys", "provider")
    upto = block.orderBy("record_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ns = range(8)
    one = lambda i: F.count_if((F.col("sign") == 0) & (F.col("lacks") == i))
    counted = there.unionByName(asked).select("*", *[one(i).over(upto).alias(f"b{i}") for i in ns], *[one(i).over(block).alias(f"n{i}") for i in ns]).filter("sign <> 0")
    side = lambda above: counted.select("record_no", "provider", F.lit(above).alias("above"), "lacks", *[(F.col("sign") * ((F.col(f"n{i}") - F.col(f"b{i}")) if above else F.col(f"b{i}"))).alias(f"c{i}") for i in ns])
    off = lambda own, other, p, above, mine, its: made.select(F.col(own).alias("record_no"), F.col(p).alias("provider"), F.lit(above).alias("above"), F.col(mine).alias("lacks"), *[F.when(F.col(its) == i, -1).otherwise(0).cast("bigint").alias(f"c{i}") for i in ns])
    every = side(True).unionByName(side(False)).unionByName(off("l", "r", "rp", True, "ll", "rl")).unionByName(off("r", "l", "lp", False, "rl", "ll"))
    w = WEIGHTS

    def odds(i: int) -> Column:
        both = lambda bit, no: F.when((F.col("lacks").bitwiseAND(bit) == 0) & F.lit(i & bit == 0), w[no]).otherwise(0.0)
        theta = F.lit(w["prior"] + w["other_name"]) + both(1, "other_phone") + both(2, "other_building") + both(4, "other_web")
        return F.when((F.col("lacks").bitwiseAND(3) != 0) | F.lit(i & 3 != 0), F.exp(theta) * F.col(f"c{i}")).otherwise(0.0)

    return every.groupBy("record_no", "provider", "above", "lacks").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in ns]).select(F.col("record_no").alias("record"), "provider", "above", sum((odds(i) for i in ns), F.lit(0.0)).alias("mass"))


#: Pairs below this log-odds can't become a match, since messages only lower it; in the loop they are only told as mass.
HOPELESS = -5.0


def believe(pairs: DataFrame, records: DataFrame | None = None, rounds: int = 1000, tolerance: float = 1e-3, hopeless: float = HOPELESS) -> DataFrame:
    """(l, r, lp, rp, probability): marginals of pairs (l, r, lp, rp, theta) under one-to-one factors.

    A record takes part in one factor for each other provider: at most one of its pairs there is true. The
    factor's message to a pair is -log(1 + sum of the odds of its other pairs). Pairs below hopeless send the same odds
    in every round, those of their own evidence, as one sum a factor, and keep that evidence's probability; pairs
    without a rival need no message; both stay out of the loop. With records, the mass of the pairs that candidates leaves
    to be counted is told as well. An empty table gives an empty result. The loop runs
    until no message moves by tolerance; rounds only guards against an endless one, and reaching it is an error.
    """
    left, right = Window.partitionBy("l", "rp"), Window.partitionBy("r", "lp")
    marginal = lambda x: 1 / (1 + F.exp(-x))
    live, lost = pairs.filter(F.col("theta") >= hopeless), pairs.filter(F.col("theta") < hopeless)
    rest = cut(unlike_mass(pairs, records)) if records is not None else None

    def mass(a: str, b: str, name: str) -> DataFrame:
        told = lost.select(a, b, F.exp("theta").alias("mass"))
        if rest is not None:
            told = told.unionByName(rest.filter(F.col("above") == F.lit(a == "l")).select(F.col("record").alias(a), F.col("provider").alias(b), "mass"))
        return told.groupBy(a, b).agg(F.sum("mass").alias(name))

    known = live.join(mass("l", "rp", "cl"), ["l", "rp"], "left").join(mass("r", "lp", "cr"), ["r", "lp"], "left").select(
        "l", "r", "lp", "rp", "theta", F.coalesce("cl", F.lit(0.0)).alias("cl"), F.coalesce("cr", F.lit(0.0)).alias("cr")
    )
    all_ = cut(known.withColumn("rivals", F.count("*").over(left) + F.count("*").over(right) - 2))
    state = cut(all_.filter("rivals > 0").select("l", "r", "lp", "rp", "theta", "cl", "cr", F.lit(0.0).alias("ml"), F.lit(0.0).alias("mr")))
    odds = lambda m: F.exp(F.least(F.col("theta") + F.col(m), F.lit(40.0)))
    for _ in range(0 if state.isEmpty() else rounds):
        s = state.withColumn("ol", odds("mr")).withColumn("or", odds("ml"))
        others = lambda o, w, c: -F.log1p(F.greatest(F.sum(o).over(w) - F.col(o), F.lit(0.0)) + F.col(c))
        s = s.withColumn("nl", others("ol", left, "cl")).withColumn("nr", others("or", right, "cr"))
        damped = lambda new, old: 0.7 * F.col(new) + 0.3 * F.col(old)
        s = s.select("l", "r", "lp", "rp", "theta", "cl", "cr", damped("nl", "ml").alias("ml"), damped("nr", "mr").alias("mr"),
                     F.greatest(F.abs(F.col("nl") - F.col("ml")), F.abs(F.col("nr") - F.col("mr"))).alias("d"))
        s = cut(s)
        moved = s.agg(F.max("d")).first()[0]
        state = s.drop("d")
        if moved < tolerance:
            break
    else:
        if not state.isEmpty():
            raise RuntimeError(f"beliefs haven't settled within {rounds} rounds: a message still moves by {moved}")
    alone = all_.filter("rivals = 0").select("l", "r", "lp", "rp", marginal(F.col("theta") - F.log1p("cl") - F.log1p("cr")).alias("probability"))
    sure = lost.select("l", "r", "lp", "rp", marginal(F.col("theta")).alias("probability"))
    return alone.unionByName(state.select("l", "r", "lp", "rp", marginal(F.col("theta") + F.col("ml") + F.col("mr")).alias("probability"))).unionByName(sure)


def match_entities(entities: DataFrame, leads: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(left_no, right_no, confidence), the smaller first: records of different providers that are one business.

    A pair found by closure alone gets the least confidence of its group. Where closure would give a record
    two partners in one provider, the group keeps its direct pairs only. Records whose name is null or empty
    match nothing; repeats count once.
    """
    records = cut(prepared(entities, leads))
    marginals = cut(believe(scored(candidates(records), records), records).filter(F.col("probability") >= threshold))
    groups = _closed_groups(marginals)
    direct = marginals.select(F.col("l").alias("left_no"), F.col("r").alias("right_no"), F.col("probability").alias("confidence"))
    provider = marginals.select(F.explode(F.array(F.struct(F.col("l").alias("node"), F.col("lp").alias("p")), F.struct(F.col("r").alias("node"), F.col("rp").alias("p")))).alias("x")).select("x.node", "x.p").distinct()
    m = groups.join(provider, "node")
    sound = m.groupBy("group_id").agg(F.count("*").alias("n"), F.countDistinct("p").alias("ps")).filter("n = ps").select("group_id")
    least = marginals.join(groups, marginals.l == groups.node).groupBy("group_id").agg(F.min("probability").alias("least"))
    m = cut(m.join(sound, "group_id").join(least, "group_id").select("group_id", "node", "least"))
    a, b = m.toDF("group_id", "left_no", "confidence"), m.select("group_id", F.col("node").alias("right_no"))
    closed = a.join(b, "group_id").filter("left_no < right_no").select("left_no", "right_no", "confidence")
    return direct.unionByName(closed).groupBy("left_no", "right_no").agg(F.round(F.max("confidence"), 6).alias("confidence"))


def _closed_groups(pairs: DataFrame) -> DataFrame:
    """(node, group_id): the smallest node of the whole connected group, however long its chains.

    Labels pass to neighbours and to the bearers of one's own label's label until a round changes none.
    """
    arcs = pairs.select(F.explode(F.array(F.struct(F.col("l").alias("u"), F.col("r").alias("v")), F.struct(F.col("r").alias("u"), F.col("l").alias("v")))).alias("x")).select("x.u", "x.v")
    state = cut(arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("g")))
    moved = not state.isEmpty()
    while moved:
        reached = arcs.join(state.toDF("v", "g"), "v").select("u", "g")
        jumped = state.join(state.toDF("g", "gg"), "g").select("u", F.col("gg").alias("g"))
        was = state.select("u", "g", F.col("g").alias("was"))
        both = reached.unionByName(jumped).withColumn("was", F.lit(None).cast(state.schema["g"].dataType)).unionByName(was)
        step = cut(both.groupBy("u").agg(F.min("g").alias("g"), F.min("was").alias("was")))
        moved = not step.filter("g < was").isEmpty()
        state = step.select("u", "g")
    return state.toDF("node", "group_id")
