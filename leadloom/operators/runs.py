"""Audit runs, their metrics and evidence: pivots, run aggregates, lookups by key, replacement and reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import freshness, urls

ANALYTICS = ("Google Analytics", "Google Tag Manager")


def metric_pivot(metrics: DataFrame, wanted: list[tuple[str, str]], seq: str | None = None) -> DataFrame:
    """One row a site with one column module_name for each wanted (module, name); the first value by seq counts, else the least.

    One partial aggregation over the long rows; a metric that a site lacks is null.
    """
    def pick(m: str, n: str) -> Column:
        hit = (F.col("module") == m) & (F.col("name") == n)
        return (F.min_by(F.when(hit, F.col("value")), F.when(hit, F.col(seq))) if seq else F.min(F.when(hit, F.col("value")))).alias(f"{m.lower()}_{n}")

    return metrics.groupBy("site_id").agg(*[pick(m, n) for m, n in wanted])


def security_fallback(metrics: DataFrame) -> DataFrame:
    """(site_id, security): mean of a site's security metrics in percent, the certificate aside; null without any."""
    ok = (F.col("module") == "SECURITY") & (F.col("name") != "tlsValid")
    return metrics.groupBy("site_id").agg((F.avg(F.when(ok, F.col("value"))) * 100).alias("security"))


def run_summary(modules: DataFrame) -> DataFrame:
    """(site_id, modules_complete, confidence) of module results (site_id, module, score, confidence): scores there are, and mean confidence."""
    return modules.groupBy("site_id").agg(F.count("score").alias("modules_complete"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"))


def contact_confidence(contacts: DataFrame, owner: str) -> DataFrame:
    """(owner, contact_confidence): mean confidence of the primary contacts in percent, else the largest of all; NaN counts as missing."""
    c = F.when(~F.isnan("confidence"), F.col("confidence"))
    primary = F.coalesce(F.col("primary_contact"), F.lit(False))
    return contacts.groupBy(owner).agg((F.coalesce(F.avg(F.when(primary, c)), F.max(c)) * 100).alias("contact_confidence"))


def any_flags(contacts: DataFrame, owner: str) -> DataFrame:
    """(owner, withheld, verified): is any contact marked as not to be used, is any primary one confirmed or likely?"""
    yes = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return contacts.groupBy(owner).agg(
        yes(F.col("contact_value") == "[DO_NOT_CONTACT]").alias("withheld"), yes(F.col("primary_contact") & F.col("verification_status").isin("CONFIRMED", "LIKELY")).alias("verified")
    )


def analytics_flag(technologies: DataFrame) -> DataFrame:
    """(site_id, analytics): is any analytics tool among a site's technologies?"""
    return technologies.groupBy("site_id").agg(F.bool_or(F.col("name").isin(*ANALYTICS)).alias("analytics"))


def crawl_share(sites: DataFrame, coverage: DataFrame, audited: DataFrame) -> DataFrame:
    """(site_id, coverage): the share of pages fetched; without any attempt .6 for audited sites and .2 for others."""
    a = audited.select("site_id", F.lit(True).alias("_a")).distinct()
    j = sites.join(coverage.select("site_id", F.when(F.col("attempted") > 0, F.col("succeeded") / F.col("attempted")).alias("c")), "site_id", "left").join(a, "site_id", "left")
    return j.select("site_id", F.coalesce("c", F.when(F.col("_a"), 0.6).otherwise(0.2)).alias("coverage"))


def audited_only(leads: DataFrame) -> DataFrame:
    """Leads whose audit confidence is known."""
    return leads.filter(F.col("audit_confidence").isNotNull() & ~F.isnan("audit_confidence"))


def first_two(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(key, first, second): the values of a key's first two rows in the given order, which must be total."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    top = rows.withColumn("_n", n).filter("_n <= 2")
    return top.groupBy(key).agg(F.max(F.when(F.col("_n") == 1, F.col(value))).alias("first"), F.max(F.when(F.col("_n") == 2, F.col(value))).alias("second"))


def newest(rows: DataFrame, at: str, tie: str, n: int = 50) -> DataFrame:
    """The n newest rows, as a list page shows them; ties go to the smaller tie column, unknown times come last."""
    return rows.orderBy(F.desc_nulls_last(at), tie).limit(n)


def sample_per_key(rows: DataFrame, key: str, order: list[str], n: int = 50) -> DataFrame:
    """The first n rows of every key; the rank filter prunes before and after the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def with_primary_site(businesses: DataFrame, sites: DataFrame) -> DataFrame:
    """Businesses (id, primary_site) with the website (url) of that number, else their first one flagged as primary.

    sites: (site_no, id, url, is_primary). Businesses without either keep null.
    """
    by_no = sites.select(F.col("site_no").alias("primary_site"), F.col("url").alias("_a")).dropDuplicates(["primary_site"])
    flagged = sites.filter("is_primary").groupBy("id").agg(F.min_by("url", "site_no").alias("_b"))
    return businesses.join(by_no, "primary_site", "left").join(flagged, "id", "left").withColumn("url", F.coalesce("_a", "_b")).drop("_a", "_b")


def with_site_domain(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """Pages (site_id, url) with the domain of their site (site_id, website), else that of their own URL."""
    s = sites.groupBy("site_id").agg(F.min(urls.domain(F.col("website"))).alias("_d"))
    return pages.join(s, "site_id", "left").withColumn("domain", F.coalesce("_d", urls.domain(F.col("url")))).drop("_d")


def evidence_ids(rules: DataFrame, evidence: DataFrame) -> DataFrame:
    """Rules (subject, rule, keys array) with the ids of the evidence (subject, field, id) for each of their keys, in the keys' order.

    Keys without evidence add nothing; a rule without any evidence gets an empty array.
    """
    by_key = evidence.groupBy("subject", "field").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    maps = by_key.groupBy("subject").agg(F.map_from_entries(F.collect_list(F.struct("field", "ids"))).alias("_m"))
    none = F.array().cast(f"array<{evidence.schema['id'].dataType.simpleString()}>")
    found = F.flatten(F.transform("keys", lambda k: F.coalesce(F.try_element_at("_m", k), none)))
    return rules.join(maps, "subject", "left").withColumn("evidence", F.when(F.col("_m").isNull(), none).otherwise(found)).drop("_m")


def replace_by_key(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """All rows of incoming, and those of existing whose key incoming doesn't have."""
    return existing.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def reuse_fresh(sites: DataFrame, detected: DataFrame, computed: DataFrame, now: Column, kind: str = "technology") -> DataFrame:
    """Rows of each site: what was detected (site_id, name, at) where its latest detection is fresh, else what is computed now.

    computed: (site_id, name). The result has (site_id, name, reused); only the fresh sites' latest rows are reused.
    """
    last = detected.groupBy("site_id").agg(F.max("at").alias("_last"))
    fresh = last.filter(freshness.is_fresh(F.col("_last"), now, kind))
    old = detected.join(fresh, "site_id").filter(F.col("at") == F.col("_last")).join(sites.select("site_id").distinct(), "site_id", "left_semi")
    new = computed.join(sites.select("site_id").distinct(), "site_id", "left_semi").join(fresh, "site_id", "left_anti")
    return old.select("site_id", "name", F.lit(True).alias("reused")).distinct().unionByName(new.select("site_id", "name", F.lit(False).alias("reused")).distinct())


def timing_report(timings: DataFrame) -> DataFrame:
    """(site_id, performanceScore, lcpMs, tbtMs, fcpMs) of browser timings (site_id, nav_ms, load_ms, dcl_ms, fcp_ms); missing ones fall back on the navigation."""
    lcp, whole = F.coalesce("load_ms", "nav_ms"), lambda c: F.floor(c + 0.5)
    return timings.select(
        "site_id", F.greatest(F.lit(20.0), F.least(F.lit(100.0), whole(100 - lcp / 80))).alias("performanceScore"), whole(lcp).cast("double").alias("lcpMs"),
        F.greatest(F.lit(0.0), whole(F.coalesce("dcl_ms", "nav_ms") * 0.05)).alias("tbtMs"), whole(F.coalesce("fcp_ms", whole(F.col("nav_ms") * 0.6))).cast("double").alias("fcpMs"),
    )


LIGHTHOUSE = (
    "struct<lighthouseResult:struct<categories:struct<performance:struct<score:double>,accessibility:struct<score:double>,`best-practices`:struct<score:double>,seo:struct<score:double>>,"
    "audits:struct<`largest-contentful-paint`:struct<numericValue:double>,`cumulative-layout-shift`:struct<numericValue:double>,`total-blocking-time`:struct<numericValue:double>,`first-contentful-paint`:struct<numericValue:double>>>>"
)


def api_report(captured: DataFrame, column: str = "json") -> DataFrame:
    """(site_id, performanceScore, ..., fcpMs) of captured measurement records; a missing category scores 0, a missing timing is null, broken JSON both."""
    r = captured.select("site_id", F.from_json(column, LIGHTHOUSE)["lighthouseResult"].alias("r"))
    score = lambda k: F.floor(F.coalesce(F.col("r.categories")[k]["score"], F.lit(0.0)) * 100 + 0.5).cast("double")
    timing = lambda k: F.col("r.audits")[k]["numericValue"]
    return r.select(
        "site_id", score("performance").alias("performanceScore"), score("accessibility").alias("lighthouseAccessibility"), score("best-practices").alias("bestPractices"), score("seo").alias("lighthouseSeo"),
        timing("largest-contentful-paint").alias("lcpMs"), timing("cumulative-layout-shift").alias("cls"), timing("total-blocking-time").alias("tbtMs"), timing("first-contentful-paint").alias("fcpMs"),
    )
