"""Problem 3: address records of one building, written differently.

Method: every address is read into components (postal.py: optimal assignment of its words to unit, number,
street, street kind, locality, city and postcode, across the record's fields); the distinct street tokens of a
city are indexed by their deletion neighbourhood and merged inside blocks of one postcode or of localities that
are the same or share a postcode; records are the same building where street, kind and locality agree after that
and neither number nor number letter vetoes. A street kind that one side lacks is taken from the street. The
unit veto is a parameter; the statement for this data says that units don't matter, so it is off by default.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.session import cut, spread

from .postal import Gazetteer, fold, phrases, read

GAZETTEER_ROWS = 200_000  # up to so many places the list is broadcast whole; beyond, each bucket of addresses gets its own part
BUCKET_ROWS = 50_000
WELL_ATTESTED, RATIO = 5, 4  # two spellings are different streets if both are this frequent and near in count
PLACES = "kind string, name string, city string, locality string"


def places(leads: DataFrame) -> DataFrame:
    """(kind, name, city, locality): cities, localities and regions as the lead table names them, and each postcode's place.

    A city or locality spelling one edit from another that is 20 times as frequent counts as a misspelling; the
    spellings meet through their deletion neighbourhoods.
    """
    none = F.lit(None).cast("string")
    cols = (("city", "city"), ("locality", "locality"), ("region", "state"), ("region", "country"))
    names = reduce(DataFrame.unionByName, [leads.select(F.lit(k).alias("kind"), F.col(c).alias("name")) for k, c in cols])
    names = cut(names.filter(F.trim("name") != "").groupBy("kind", "name").agg(F.count("*").alias("n")))
    v = names.filter("kind <> 'region'").select("kind", "name", "n", F.explode(deletions(folded(F.col("name")))).alias("v"))
    wrong = (
        v.alias("a").join(v.alias("b"), ["kind", "v"]).filter("a.name <> b.name and b.n >= 20 * a.n").filter(one_edit(folded(F.col("a.name")), folded(F.col("b.name"))))
        .select("kind", F.col("a.name").alias("name")).distinct()
    )
    posts = leads.filter("postal_code is not null and city is not null and locality is not null").groupBy("postal_code", "city", "locality").count()
    best = posts.groupBy("postal_code").agg(F.max(F.struct("count", "city", "locality")).alias("b"))
    code = F.regexp_replace("postal_code", "[^0-9]", "")
    return names.join(wrong, ["kind", "name"], "left_anti").select("kind", "name", none.alias("city"), none.alias("locality")).unionByName(
        best.select(F.lit("post").alias("kind"), code.alias("name"), "b.city", "b.locality")
    )


def _gazetteer(rows: Iterable[tuple[str, str, str | None, str | None]]) -> Gazetteer:
    rows = sorted(rows, key=repr)
    named = lambda k: [r[1] for r in rows if r[0] == k]
    return Gazetteer(named("city"), named("locality"), named("region"), {r[1]: (fold(r[2]), fold(r[3])) for r in rows if r[0] == "post"})


READ = "number string, street string, kind string, locality string, city string, post string, unit string"


def _parts(b: pd.DataFrame, g: Gazetteer) -> pd.DataFrame:
    out = pd.DataFrame([read(*x) for x in zip(b.text, [g] * len(b), b.city_hint, b.locality_hint, b.post_hint)], columns=["number", "street", "kind", "locality", "city", "post", "unit"])
    out.insert(0, "id", b.id.to_numpy())
    return out


def read_addresses(rows: DataFrame, known: DataFrame, broadcast_rows: int = GAZETTEER_ROWS) -> DataFrame:
    """Adds the components to rows (id, text, city_hint, locality_hint, post_hint) and drops the rest.

    known: places. A list of at most broadcast_rows goes out as one broadcast variable. A longer one is split: the
    addresses fall into buckets of about BUCKET_ROWS, and each bucket gets the places that are written like one
    of its phrases, found through deletion neighbourhoods; the components come out the same.
    """
    rows = rows.select("id", "text", "city_hint", "locality_hint", "post_hint")
    if known.limit(broadcast_rows + 1).count() > broadcast_rows:
        return _read_in_buckets(rows, known)
    shared = rows.sparkSession.sparkContext.broadcast(_gazetteer([tuple(r) for r in known.collect()]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _parts(b, shared.value)

    return spread(rows).mapInPandas(run, f"id bigint, {READ}")


def _read_in_buckets(rows: DataFrame, known: DataFrame) -> DataFrame:
    n = max(1, -(-rows.count() // BUCKET_ROWS))
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "text"), F.lit(n)))

    def spoken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen = set()
            for x in zip(b.bucket, b.text, b.city_hint, b.locality_hint, b.post_hint):
                seen.update((x[0], p) for t in x[1:] if t for p in phrases(t))
            yield pd.DataFrame(list(seen), columns=["bucket", "v"])

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, nm, c, l, f) for k, nm, c, l in zip(b.kind, b.name, b.city, b.locality) for f in ([nm] if k == "post" else Gazetteer([], [nm], [], {}).locality_forms if k == "locality" else [fold(nm)])]
            yield pd.DataFrame(out, columns=["kind", "name", "city", "locality", "form"])

    keys = placed.mapInPandas(spoken, "bucket bigint, v string").distinct().select("bucket", F.explode(deletions(F.col("v"))).alias("v"))
    forms = known.mapInPandas(written, f"{PLACES}, form string").select("kind", "name", "city", "locality", F.explode(deletions(F.col("form"))).alias("v"))
    local = forms.join(keys, "v").select("bucket", "kind", "name", "city", "locality").distinct()

    def run(key: tuple, b: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        part = _gazetteer([tuple(None if pd.isna(x) else x for x in r) for r in zip(g.kind, g.name, g.city, g.locality)])
        return _parts(b, part)

    return placed.groupBy("bucket").cogroup(local.groupBy("bucket")).applyInPandas(run, f"id bigint, {READ}")


_ACCENTS = ("àáâãäåāçćčèéêëēěìíîïīñńňòóôõöøōŕřśšùúûüůūýÿžźżđł", "aaaaaaaccceeeeeeiiiiinnnooooooorrssuuuuuuyyzzzdl")


def folded(c: Column) -> Column:
    """Lower case, Latin accents folded; stays in the JVM."""
    return F.replace(F.translate(F.lower(c), *_ACCENTS), F.lit("ß"), F.lit("ss"))


def deletions(c: Column) -> Column:
    """The word and all words with one letter less."""
    cuts = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    return F.array_distinct(F.concat(F.array(c), cuts))


def one_edit(a: Column, b: Column) -> Column:
    """At most one insertion, deletion or substitution, or one swap of letters, apart."""
    letters = lambda x: F.array_sort(F.split(x, ""))
    return (F.levenshtein(a, b, 1) >= 0) | (
        (F.length(a) == F.length(b)) & (F.levenshtein(a, b, 2) >= 0) & (letters(a) == letters(b))
    )


def street_roots(streets: DataFrame) -> DataFrame:
    """(city, street, root, place, kind): the leading spelling of each street spelling of a city.

    streets: (city, street, kind, locality, post, n), one row a spelling, kind and block. Spellings are compared only
    where their deletion neighbourhoods meet and they have a block in common or one has none; blocks are their
    localities, their postcodes and the postcodes of their localities, so localities that share one are neighbours.
    Spellings without a kind in common stay apart. Each follows its most frequent neighbour (ties: smaller spelling)
    up to the top. Two well attested spellings of like frequency stay apart. place is the street's locality if it
    lies in one only, kind its most frequent kind.
    """
    known = streets.filter("city is not null and street is not null and length(street) > 2")
    posts = streets.filter("city is not null and locality is not null and post is not null").groupBy("city", "locality").agg(F.collect_set(F.concat(F.lit("p:"), "post")).alias("near"))
    blocks = (
        known.join(posts, ["city", "locality"], "left")
        .select("city", "street", F.explode(F.concat(F.array(F.concat(F.lit("l:"), "locality"), F.concat(F.lit("p:"), "post")), F.coalesce("near", F.array().cast("array<string>")))).alias("b"))
        .filter("b is not null").groupBy("city", "street").agg(F.collect_set("b").alias("blocks"))
    )
    none = F.array().cast("array<string>")
    s = known.groupBy("city", "street").agg(F.sum("n").alias("n"), F.collect_set("kind").alias("kinds")).join(blocks, ["city", "street"], "left").withColumn("blocks", F.coalesce("blocks", none))
    s = cut(s)
    a, b = [s.select("city", "street", F.explode(deletions(F.col("street"))).alias("v")).toDF("city", x, "v") for x in ("x", "y")]
    met = a.join(b, ["city", "v"]).filter("x <> y").filter(one_edit(F.col("x"), F.col("y"))).select("city", "x", "y").distinct()
    p, q = s.toDF("city", "x", "xn", "xk", "xb"), s.toDF("city", "y", "yn", "yk", "yb")
    common = lambda l, r: (F.size(l) == 0) | (F.size(r) == 0) | F.arrays_overlap(l, r)
    apart = (F.least("xn", "yn") >= WELL_ATTESTED) & (F.least("xn", "yn") * RATIO > F.greatest("xn", "yn"))
    near_ = met.join(p, ["city", "x"]).join(q, ["city", "y"]).filter(common("xb", "yb") & common("xk", "yk") & ~apart)
    ahead = F.struct((-F.col("n")).alias("m"), F.col("street").alias("s"))
    up = near_.groupBy("city", F.col("x").alias("street")).agg(F.min(F.struct((-F.col("yn")).alias("m"), F.col("y").alias("s"))).alias("up"))
    lead = cut(s.join(up, ["city", "street"], "left").select("city", "street", F.when(F.col("up") < ahead, F.col("up.s")).otherwise(F.col("street")).alias("root")))
    moved = True
    while moved:  # every step leads to a spelling further ahead, so this ends; each round doubles the steps taken
        top = lead.toDF("city", "root", "up")
        step = cut(lead.join(top, ["city", "root"]).select("city", "street", "root", "up"))
        moved = not step.filter("root <> up").isEmpty()
        lead = step.select("city", "street", F.col("up").alias("root"))
    of_root = known.join(lead, ["city", "street"])
    where = of_root.filter("locality is not null").groupBy("city", "root").agg(F.min("locality").alias("lo"), F.max("locality").alias("hi"))
    kinds = of_root.filter("kind is not null").groupBy("city", "root", "kind").agg(F.sum("n").alias("n")).groupBy("city", "root").agg(F.min(F.struct((-F.col("n")).alias("m"), "kind"))["kind"].alias("kind"))
    return lead.join(where, ["city", "root"], "left").join(kinds, ["city", "root"], "left").select("city", "street", "root", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("place"), "kind")


def one_reading(parts: DataFrame) -> DataFrame:
    """One row an id: repeats count once; of several readings the one with a number and the largest values stays."""
    names = [x.split(" ")[0] for x in READ.split(", ")]
    return parts.groupBy("id").agg(F.max(F.struct(*names)).alias("p")).select("id", "p.*")


KEY = ["city", "place", "root", "kind", "number"]


def buildings(parts: DataFrame) -> DataFrame:
    """(id, city, place, root, kind, number, unit) for every address with street and number whose city is known.

    A missing city is taken from the street if only one city has that street (in the same locality, where
    known); a missing locality from the street if it lies in one locality only; a missing street kind from the street's
    most frequent one. Addresses without street or number, and those whose city stays unknown, give no row. parts holds
    an id once (one_reading).
    """
    a = parts.filter("street is not null and number is not null").select("id", "number", "street", "kind", "locality", "city", "post", "unit")
    counts = cut(a.groupBy("city", "street", "kind", "locality", "post").agg(F.count("*").alias("n")))
    roots = cut(street_roots(counts))
    # streets without a city: the one city that has the street, by exact or nearest spelling
    lost = counts.filter("city is null").select("street", "locality").distinct()
    known = roots.select("city", "root", "place").distinct()
    lv = lost.select("street", "locality", F.explode(deletions(F.col("street"))).alias("v"))
    kv = known.select("city", "root", "place", F.explode(deletions(F.col("root"))).alias("v"))
    hits = (
        lv.join(kv, "v")
        .filter((F.col("locality").isNull() | F.col("place").isNull() | (F.col("locality") == F.col("place"))) & one_edit(F.col("street"), F.col("root")))
        .withColumn("far", F.when(F.col("street") == F.col("root"), 0).otherwise(1))
        .groupBy("street", "locality").agg(
            F.min(F.struct("far", "city", "root", "place")).alias("lo"), F.max(F.struct((-F.col("far")).alias("far"), "city", "root")).alias("hi")
        )
        .filter("lo.city = hi.city and lo.root = hi.root")
        .select(F.col("street").alias("s"), F.col("locality").alias("l"), "lo.city", "lo.root", "lo.place")
        .join(roots.select("city", "root", F.col("kind").alias("usual")).distinct(), ["city", "root"])
    )
    cols = ["id", "city", "locality", "place", "root", "kind", "usual", "number", "unit"]
    named = a.filter("city is not null").join(roots.withColumnRenamed("kind", "usual"), ["city", "street"]).select(cols)
    guessed = a.filter("city is null").drop("city").join(hits, (F.col("street") == F.col("s")) & F.col("locality").eqNullSafe(F.col("l"))).select(cols)
    every = named.unionByName(guessed)
    return every.select("id", "city", F.coalesce("locality", "place", F.lit("")).alias("place"), "root", F.coalesce("kind", "usual", F.lit("")).alias("kind"), "number", "unit")


def _lead_texts(leads: DataFrame) -> DataFrame:
    return leads.select(F.col("record_no").alias("id"), F.col("address").alias("text"), F.col("city").alias("city_hint"), F.col("locality").alias("locality_hint"), F.col("postal_code").alias("post_hint"))


def _listing_texts(listings: DataFrame) -> DataFrame:
    where = F.nullif(F.regexp_extract("query_text", r"^.* in ([^,]+)", 1), F.lit(""))
    none = F.lit(None).cast("string")
    return listings.select(F.col("record_no").alias("id"), F.col("address_hint").alias("text"), where.alias("city_hint"), none.alias("locality_hint"), none.alias("post_hint"))


def entity_texts(entities: DataFrame) -> DataFrame:
    """All fields of the address struct as one text, since values stand in wrong fields; junk values left out."""
    fields = [F.when(~F.lower(F.trim(F.col(f"address.{c}"))).isin("n/a", "na", "none", "null", "-", "?", "unknown", ""), F.col(f"address.{c}")) for c in ("line1", "locality", "city", "postal_code", "country")]
    none = F.lit(None).cast("string")
    return entities.select(F.col("record_no").alias("id"), F.concat_ws(", ", *fields).alias("text"), none.alias("city_hint"), none.alias("locality_hint"), none.alias("post_hint"))


def record_buildings(listings: DataFrame, leads: DataFrame, entities: DataFrame) -> DataFrame:
    """buildings() of the address records of all three tables; null addresses and repeats give nothing."""
    texts = _lead_texts(leads).unionByName(_listing_texts(listings)).unionByName(entity_texts(entities)).filter("id is not null and text is not null")
    return buildings(cut(one_reading(read_addresses(texts, places(leads)))))


#: A building's key in short: the rows that meet in joins carry 12 bytes instead of its names.
SHORT_KEY = ["b1", "b2"]


def _short(rows: DataFrame) -> DataFrame:
    return rows.select("id", "unit", F.xxhash64(*KEY).alias("b1"), F.hash(*KEY).alias("b2"))


def building_classes(rows: DataFrame) -> DataFrame:
    """(record_no, building_no, links) of buildings(): the smallest record of the same building, and how many others name it.

    One row a record, however many share a building: two partial aggregations, no pairs.
    """
    own = _short(rows).select(F.col("id").alias("record_no"), *SHORT_KEY)
    heads = own.groupBy(*SHORT_KEY).agg(F.min("record_no").alias("building_no"), (F.count("*") - 1).alias("links"))
    return own.join(heads, SHORT_KEY).select("record_no", "building_no", "links")


def same_building(listings: DataFrame, leads: DataFrame, entities: DataFrame, unit_veto: bool = False) -> DataFrame:
    """(left_no, right_no), the smaller first: pairs of records whose addresses mean the same building.

    Null addresses and addresses without street and number are in no pair; a repeated row counts once. With unit_veto,
    records that both name a unit must name the same. The pairs of a building are joined on its key, so a large
    building is split by the skew join; building_classes gives the same result without pairs.
    """
    b = cut(_short(record_buildings(listings, leads, entities)))
    columns = ["id", *SHORT_KEY, *(["unit"] if unit_veto else [])]
    left, right = b.select(columns).withColumnsRenamed({"id": "left_no", "unit": "lu"}), b.select(columns).withColumnsRenamed({"id": "right_no", "unit": "ru"})
    pairs = left.join(right, SHORT_KEY).filter("left_no < right_no")
    if unit_veto:
        pairs = pairs.filter("lu is null or ru is null or lu = ru")
    return pairs.select("left_no", "right_no")
