"""Queries of the ten problems over the test tables, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.session import cut, table

from . import addresses, categories, components, linkage, mixing, packing, pii, survivor, tokens, topn, toxicity


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_details(table(spark, d, "crawl_page"), table(spark, d, "extracted_contact"))


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted_texts(table(spark, d, "crawl_page"), table(spark, d, "extracted_contact"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return components.match_groups(table(spark, d, "match_result"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_leads(table(spark, d, "lead_row"), table(spark, d, "scoring_result"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.field_survivors(table(spark, d, "contact_row"), table(spark, d, "source_trust"))


def p5_truth(spark: SparkSession, d: str) -> DataFrame:
    return survivor.contact_truth(table(spark, d, "contact_row"), table(spark, d, "source_trust"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return addresses.same_building(table(spark, d, "maps_listing"), table(spark, d, "lead_row"), table(spark, d, "entity_record"))


def p3_buildings(spark: SparkSession, d: str) -> DataFrame:
    return addresses.building_classes(addresses.record_buildings(table(spark, d, "maps_listing"), table(spark, d, "lead_row"), table(spark, d, "entity_record")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return categories.map_categories(table(spark, d, "maps_listing"), table(spark, d, "lead_row"), table(spark, d, "category_ref"))


def p7_scored(spark: SparkSession, d: str) -> DataFrame:
    return linkage.match_entities(table(spark, d, "entity_record"), table(spark, d, "lead_row"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_scored(spark, d).select("left_no", "right_no")


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(tokens.token_lengths(table(spark, d, "documents")), table(spark, d, "container_spec"))


def p8_usage(spark: SparkSession, d: str) -> DataFrame:
    return packing.usage(p8_packed(spark, d), table(spark, d, "container_spec"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    lengths, specs = cut(tokens.token_lengths(table(spark, d, "documents"))), table(spark, d, "container_spec")
    return packing.mixture_report(packing.mixture(packing.pack_documents(lengths, specs), lengths), lengths, specs)


def p9_mixed(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(cut(tokens.token_lengths(table(spark, d, "documents"))), table(spark, d, "mix_target"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    lengths, targets = cut(tokens.token_lengths(table(spark, d, "documents"))), table(spark, d, "mix_target")
    return mixing.reached(mixing.mix(lengths, targets), lengths, targets)


def p10_scored(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.score_documents(table(spark, d, "documents"), table(spark, d, "review_label"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_scored(spark, d).filter("harmful").select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.rates(p10_scored(spark, d))


# Queries that hold the operators' whole results against what SQL can say of them.


def p1_left(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the redacted texts, and how many still hold a plain mail address or a bare identity number."""
    t = p1_redacted(spark, d)
    return t.groupBy("field_name").agg(
        F.countDistinct("row_no").alias("texts"), F.count_if(F.col("text").rlike(r"(?i)[a-z0-9]@[a-z0-9-]+(\.[a-z0-9-]+)*\.(example|test|com|org|net)\b")).alias("mails_left"),
        F.count_if(F.col("text").rlike(r"(^|[^\w\-/#])[A-Z]{2}-[0-9]{2} [0-9]{11}($|[^\w\-/])")).alias("licences_left"),
    )


_PLAIN = r"^([0-9]+[A-Z]?) ([A-Z][a-z]+) (Street|Road|Lane|Avenue|Boulevard|Terrace|Crescent|Square), "


def p3_plain(spark: SparkSession, d: str) -> DataFrame:
    """Of all pairs found, those of leads whose addresses are plainly and equally written in one locality."""
    l = table(spark, d, "lead_row").filter(F.col("address").rlike(_PLAIN) & F.col("city").isNotNull() & F.col("locality").isNotNull())
    k = l.select("record_no", "city", "locality", F.regexp_extract("address", _PLAIN + r"", 0).alias("k")).distinct()
    a, b = k.toDF("left_no", "city", "locality", "k"), k.toDF("right_no", "city", "locality", "k")
    return p3_found(spark, d).join(a, "left_no").join(b, ["right_no", "city", "locality", "k"]).select("left_no", "right_no")


def p6_plain(spark: SparkSession, d: str) -> DataFrame:
    """Of all records mapped, those whose value is an entry's name but for letter case and outer blanks."""
    rows = table(spark, d, "maps_listing").select(F.lit("maps_listing").alias("table_name"), "record_no", F.col("category_hint").alias("v")).unionByName(
        table(spark, d, "lead_row").select(F.lit("lead_row").alias("table_name"), "record_no", F.col("category").alias("v")))
    ref = table(spark, d, "category_ref").select(F.lower("category_name").alias("k"))
    plain = rows.withColumn("k", F.lower(F.trim("v"))).join(ref, "k", "left_semi").select("table_name", "record_no").distinct()
    return p6_found(spark, d).join(plain, ["table_name", "record_no"])


def p7_checked(spark: SparkSession, d: str) -> DataFrame:
    """What no result may hold: pairs inside a provider, pairs out of order, pairs of records that don't exist."""
    e = table(spark, d, "entity_record").select("record_no", "provider_id").distinct()
    p = p7_found(spark, d).join(e.toDF("left_no", "lp"), "left_no", "left").join(e.toDF("right_no", "rp"), "right_no", "left")
    return p.agg(F.count_if(F.col("lp") == F.col("rp")).alias("inside"), F.count_if(F.col("left_no") >= F.col("right_no")).alias("disordered"), F.count_if(F.col("lp").isNull() | F.col("rp").isNull()).alias("unknown"))


def p8_checked(spark: SparkSession, d: str) -> DataFrame:
    """By capacity: documents placed, those split though they fit, containers that hold too much, tokens lost or doubled."""
    lengths, specs = cut(tokens.token_lengths(table(spark, d, "documents"))), table(spark, d, "container_spec")
    packed = cut(packing.pack_documents(lengths, specs))
    docs = packed.groupBy("spec_no", "doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("placed")).join(lengths.select("doc_id", "n_tokens"), "doc_id").join(specs, "spec_no")
    by_doc = docs.groupBy("spec_no").agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= F.col("capacity_tokens"))).alias("split"), F.sum(F.abs(F.col("placed") - F.col("n_tokens"))).alias("tokens_off"))
    boxes = packed.groupBy("spec_no", "container_no").agg(F.sum("n_tokens").alias("used")).join(specs, "spec_no").groupBy("spec_no").agg(F.count_if(F.col("used") > F.col("capacity_tokens")).alias("overfull"))
    return by_doc.join(boxes, "spec_no").select("spec_no", "documents", "split", "tokens_off", "overfull")


def p9_checked(spark: SparkSession, d: str) -> DataFrame:
    """By named source: has it documents, is what was chosen less than one document short of its demand, are repeats within the cap?

    That is what mixing promises. In shares it is exact for large tables only: where a demand is smaller than a single
    document, as on the smallest test tables, shares are far from their targets.
    """
    lengths, targets = cut(tokens.token_lengths(table(spark, d, "documents"))), table(spark, d, "mix_target")
    got = mixing.reached(mixing.mix(lengths, targets), lengths, targets)
    longest = lengths.filter("source is not null").groupBy("source").agg(F.max("n_tokens").alias("longest"))
    j = got.join(mixing.demands(lengths, targets).select("source", "wanted"), "source").join(longest, "source", "left")
    missing = F.col("wanted") - F.col("chosen_tokens")
    return j.select("source", (F.col("available_tokens") > 0).alias("has_documents"), ((missing >= -0.5) & (missing < F.greatest(F.coalesce("longest", F.lit(0)), F.lit(1)))).alias("met"), (F.col("most_repeats") <= F.col("max_repeats")).alias("within_cap"))


def p10_covered(spark: SparkSession, d: str) -> DataFrame:
    """Documents scored by source, and those without text, which score -1."""
    return p10_scored(spark, d).groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("score") == -1).alias("without_text"), F.count_if(F.col("harmful") & (F.col("score") < 0)).alias("wrong"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_redacted": p1_redacted,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_buildings": p3_buildings,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_truth": p5_truth,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_scored": p7_scored,
    "p8_packed": p8_packed,
    "p8_usage": p8_usage,
    "p8_mixture": p8_mixture,
    "p9_mixed": p9_mixed,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_rates": p10_rates,
    "p10_scored": p10_scored,
    "p1_left": p1_left,
    "p3_plain": p3_plain,
    "p6_plain": p6_plain,
    "p7_checked": p7_checked,
    "p8_checked": p8_checked,
    "p9_checked": p9_checked,
    "p10_covered": p10_covered,
}
