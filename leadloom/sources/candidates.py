"""Candidate sources: generated, row-import and captured place records, all with one output shape."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import text, urls


def expand_queries(jobs: DataFrame) -> DataFrame:
    """One row for each locality, category and term of a search job.

    jobs: (job_id, city, state, country, localities, categories, aliases map category -> other terms). A job
    without localities is searched as a whole; null and empty parts are left out of the query text.
    """
    places = jobs.withColumn("locality", F.explode_outer("localities")).withColumn("category", F.explode("categories"))
    terms = F.concat(F.array("category"), F.coalesce(F.try_element_at("aliases", F.col("category")), F.array().cast("array<string>")))
    out = places.withColumn("term", F.explode(terms))
    return out.select(
        "job_id", "city", "locality", "category", F.when(F.col("term") != F.col("category"), F.col("term")).alias("alias"),
        text.joined(" ", F.col("term"), F.col("locality"), F.col("city"), F.col("state"), F.col("country")).alias("query_text"),
    )


def seed_hash(seed: Column) -> Column:
    """31-multiplier hash of an ASCII text modulo 2^32."""
    codes = F.transform(F.filter(F.split(seed, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("bigint"))
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, c: (h * 31 + c) % 4294967296)


def generated_candidates(searches: DataFrame) -> DataFrame:
    """Reproducible made-up businesses for searches (city, locality, category, query_text), plus one near duplicate each.

    Null localities count as empty in the seed and as Central in the address.
    """
    base = seed_hash(F.concat_ws("|", "city", F.coalesce("locality", F.lit("")), "category", F.lit("")))
    s = searches.withColumn("base", base).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), 2 + F.col("base") % 3)))
    n = (F.col("base") + F.col("i") * 17) % 10000
    place = F.coalesce("locality", F.lit("Central"))
    s = s.withColumn("n", n).withColumn("slug", F.concat_ws("-", text.slug(F.col("category")), text.slug(F.col("city")), F.col("n").cast("string")))
    rows = s.select(
        F.concat(F.lit("mock:"), "slug").alias("external_id"), F.concat_ws(" ", text.title_case(F.col("category")), text.title_case(place), F.col("n").cast("string")).alias("name"),
        "category", F.concat(F.lit("9"), F.substring((800_000_000 + F.col("n")).cast("string"), 1, 9)).alias("phone"),
        F.when(F.col("n") % 7 != 0, F.concat(F.lit("https://www."), "slug", F.lit(".example.com"))).alias("website"),
        F.concat((100 + F.col("n") % 50).cast("string"), F.lit(" Main Road")).alias("line1"), place.alias("locality"), "city",
        (110000 + F.col("n") % 900).cast("string").alias("postal_code"), F.when(F.col("n") % 23 == 0, "CLOSED").otherwise("OPEN").alias("status"), "query_text", "i",
    )
    twin = rows.filter("i = 0").withColumn("external_id", F.concat("external_id", F.lit(":dup"))).withColumn("name", F.concat("name", F.lit(" Clinic")))
    return rows.unionByName(twin).drop("i")


def imported_candidates(rows: DataFrame, category: str) -> DataFrame:
    """Rows of an import whose query text mentions the category or whose category is it."""
    return rows.filter(F.contains("query_text", F.lit(category)) | (F.col("category") == category))


def csv_candidates(spark: SparkSession, path: str, schema: str, category: str) -> DataFrame:
    """The same over a CSV file with a header; the schema is given, never inferred."""
    return imported_candidates(spark.read.csv(path, schema=schema, header=True), category)


PLACE = (
    "struct<id:string,displayName:struct<text:string>,formattedAddress:string,location:struct<latitude:double,longitude:double>,"
    "nationalPhoneNumber:string,internationalPhoneNumber:string,websiteUri:string,businessStatus:string,types:array<string>>"
)


def place_candidates(captured: DataFrame, column: str = "json") -> DataFrame:
    """Captured place records (one JSON text a row) as candidates; rows without id or name, and broken JSON, are left out."""
    p = captured.select(F.from_json(column, PLACE).alias("p")).select("p.*")
    name = F.trim("displayName.text")
    status = F.create_map(*[F.lit(x) for x in ("CLOSED_PERMANENTLY", "CLOSED", "CLOSED_TEMPORARILY", "TEMPORARILY_CLOSED", "OPERATIONAL", "OPEN")])
    return p.filter((F.col("id") != "") & (name != "")).select(
        F.concat(F.lit("places:"), "id").alias("external_id"), name.alias("name"), F.try_element_at("types", F.lit(1)).alias("subcategory"),
        F.coalesce("nationalPhoneNumber", "internationalPhoneNumber").alias("phone"), F.col("websiteUri").alias("website"), F.col("formattedAddress").alias("line1"),
        F.col("location.latitude").alias("latitude"), F.col("location.longitude").alias("longitude"),
        F.coalesce(F.try_element_at(status, F.col("businessStatus")), F.lit("UNKNOWN")).alias("status"),
    )


def listing_candidates(listings: DataFrame) -> DataFrame:
    """Captured map listings as candidates: (name, href, place_id, address_hint, category_hint, phone, website, query_text).

    The label gives name, category and address where the hints are missing; the place id comes from the link where it
    is missing; a listing whose name has less than two letters is left out; of equal links of a search one row stays.
    """
    label = urls.parse_label(F.col("name"))
    l = listings.filter(F.length(F.trim("name")) >= 2).withColumn("_l", label).withColumn("_id", F.coalesce(F.nullif("place_id", F.lit("")), urls.place_id(F.col("href"))))
    rows = l.select(
        F.concat(F.lit("maps:"), "_id").alias("external_id"), F.col("_l.name").alias("name"), F.coalesce(F.nullif("category_hint", F.lit("")), "_l.category_hint").alias("subcategory"), "phone", "website",
        F.coalesce(F.nullif("address_hint", F.lit("")), "_l.address_hint").alias("line1"), urls.place_url(F.col("href")).alias("source_url"), "query_text",
    )
    best = rows.groupBy("query_text", "source_url").agg(F.min(F.struct("external_id", "name", "subcategory", "phone", "website", "line1")).alias("b"))
    return best.select("b.*", "source_url", "query_text")


SOURCES: dict[str, Callable[..., DataFrame]] = {"mock": generated_candidates, "import": imported_candidates, "places": place_candidates, "maps": listing_candidates}


def source(name: str) -> Callable[..., DataFrame]:
    """The source of a name; unknown names are an error."""
    if name not in SOURCES:
        raise ValueError(f"unknown source: {name}")
    return SOURCES[name]
