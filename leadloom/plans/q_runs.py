"""Queries of audit runs: metric lookups, run aggregates, evidence, replacement and reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.operators import audit, runs
from leadloom.session import table

from . import duck as D
from .q_audit import _CLOCK, _METRICS, _pages, metric_rows_of
from .q_leads import CUR, _contacts, _current
from .registry import query

WANTED = [("SEO", "technicalSEOScore"), ("CONVERSION", "conversionReadinessScore"), ("SECURITY", "https"), ("TECHNICAL", "statusCode"), ("MOBILE_UX", "mobileUxScore"), ("ACCESSIBILITY", "unlabeledInputs")]


@query(f"{_METRICS} SELECT site_id, " + ", ".join(f"round(min(value) FILTER (module = '{m}' AND name = '{n}'), 6) AS \"{m.lower()}_{n}\"" for m, n in WANTED) + " FROM metric GROUP BY site_id")
def metric_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Six metrics looked up by module and name."""
    p = runs.metric_pivot(metric_rows_of(_pages(spark, d)), WANTED)
    return p.select("site_id", *[F.round(c, 6).alias(c) for c in p.columns if c != "site_id"])


@query(f"{_METRICS} SELECT site_id, round(avg(value) FILTER (module = 'SECURITY' AND name <> 'tlsValid') * 100, 6) AS security FROM metric GROUP BY site_id")
def security_fallback(spark: SparkSession, d: str) -> DataFrame:
    return runs.security_fallback(metric_rows_of(_pages(spark, d))).withColumn("security", F.round("security", 6))


_FIGURES = ("website_health", "market_readiness", "conversion_readiness", "business_vitality")
_MODULES = " UNION ALL ".join(f"SELECT score_no AS site_id, CASE WHEN NOT isnan({c}) THEN {c} END AS score, {0.5 + i / 10}::DOUBLE AS confidence FROM r" for i, c in enumerate(_FIGURES))


@query(f"WITH r AS (SELECT DISTINCT score_no, {', '.join(_FIGURES)} FROM scoring_result), m AS ({_MODULES}) SELECT site_id, count(score) AS modules_complete, round(avg(confidence), 6) AS confidence FROM m GROUP BY 1")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Complete modules and mean confidence of every run; four recorded figures stand for its modules."""
    r = table(spark, d, "scoring_result").select("score_no", *_FIGURES).distinct()
    parts = F.array(*[F.struct(F.lit(c).alias("module"), F.when(~F.isnan(c), F.col(c)).alias("score"), F.lit(0.5 + i / 10).alias("confidence")) for i, c in enumerate(_FIGURES)])
    m = r.select(F.col("score_no").alias("site_id"), F.explode(parts).alias("x")).select("site_id", "x.*")
    return runs.run_summary(m).withColumn("confidence", F.round("confidence", 6))


@query(
    """WITH c AS (SELECT DISTINCT row_no, lead_id, primary_contact, CASE WHEN NOT isnan(confidence) THEN confidence END AS k FROM contact_row)
    SELECT lead_id, round(coalesce(avg(k) FILTER (primary_contact), max(k)) * 100, 6) AS contact_confidence FROM c GROUP BY 1"""
)
def contact_confidence(spark: SparkSession, d: str) -> DataFrame:
    return runs.contact_confidence(_contacts(spark, d), "lead_id").withColumn("contact_confidence", F.round("contact_confidence", 6))


@query("SELECT lead_id, coalesce(bool_or(contact_value = '[DO_NOT_CONTACT]'), false) AS withheld, coalesce(bool_or(primary_contact AND verification_status IN ('CONFIRMED', 'LIKELY')), false) AS verified FROM contact_row GROUP BY 1")
def contact_flags(spark: SparkSession, d: str) -> DataFrame:
    return runs.any_flags(_contacts(spark, d), "lead_id")


@query(
    """WITH p AS (SELECT DISTINCT page_no, site_domain, status_code FROM crawl_page WHERE site_domain IS NOT NULL), c AS (SELECT site_domain, count(*) AS a, count(*) FILTER (status_code BETWEEN 200 AND 399) AS s FROM p GROUP BY 1),
    k AS (SELECT DISTINCT regexp_replace(record_no::VARCHAR, '$', '.none') AS site_id FROM lead_row UNION SELECT site_domain FROM c) SELECT site_id, round(coalesce(s / a::DOUBLE, CASE WHEN site_id LIKE '%0.none' THEN 0.6 ELSE 0.2 END), 6) AS coverage FROM k LEFT JOIN c ON c.site_domain = site_id"""
)
def crawl_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of fetched pages of captured sites, and of made-up ones that were never crawled, every tenth of them audited."""
    p = table(spark, d, "crawl_page").filter("site_domain is not null").select("page_no", F.col("site_domain").alias("site_id"), F.col("status_code").alias("status")).distinct()
    never = table(spark, d, "lead_row").select(F.concat(F.col("record_no").cast("string"), F.lit(".none")).alias("site_id")).distinct()
    cover = audit.crawl_coverage(p)
    out = runs.crawl_share(never.unionByName(cover.select("site_id")), cover, never.filter(F.col("site_id").endswith("0.none")))
    return out.withColumn("coverage", F.round("coverage", 6))


@query(f"WITH {CUR} SELECT record_no, audit_confidence FROM cur WHERE audit_confidence IS NOT NULL")
def audited_leads(spark: SparkSession, d: str) -> DataFrame:
    return runs.audited_only(_current(spark, d)).select("record_no", "audit_confidence")


@query(
    """WITH r AS (SELECT DISTINCT lead_id, score_no, priority FROM scoring_result WHERE lead_id IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY priority, score_no) AS k FROM r)
    SELECT lead_id, max(score_no) FILTER (k = 1) AS first, max(score_no) FILTER (k = 2) AS second FROM n WHERE k <= 2 GROUP BY 1"""
)
def first_two_runs(spark: SparkSession, d: str) -> DataFrame:
    """Each lead's first and second run by priority, ties in their own order."""
    r = table(spark, d, "scoring_result").filter("lead_id is not null").select("lead_id", "score_no", "priority").distinct()
    return runs.first_two(r, "lead_id", "score_no", [F.asc_nulls_last("priority"), F.asc("score_no")])


@query("SELECT row_no, lead_id, exported_at FROM (SELECT DISTINCT row_no, lead_id, exported_at FROM contact_row) ORDER BY exported_at DESC NULLS LAST, row_no LIMIT 50")
def latest_exports(spark: SparkSession, d: str) -> DataFrame:
    """The fifty newest exported rows (the length of the list page)."""
    return runs.newest(table(spark, d, "contact_row").select("row_no", "lead_id", "exported_at").distinct(), "exported_at", "row_no")


@query(
    """WITH c AS (SELECT DISTINCT contact_no, page_no, extracted_at FROM extracted_contact), s AS (SELECT DISTINCT page_no, site_domain FROM crawl_page WHERE site_domain IS NOT NULL), j AS (SELECT site_domain, contact_no, extracted_at FROM c JOIN s USING (page_no)),
    r AS (SELECT *, row_number() OVER (PARTITION BY site_domain ORDER BY extracted_at NULLS LAST, contact_no) AS k FROM j) SELECT site_domain, contact_no FROM r WHERE k <= 50"""
)
def evidence_sample(spark: SparkSession, d: str) -> DataFrame:
    """Fifty pieces of evidence a site, the earliest first."""
    c = table(spark, d, "extracted_contact").select("contact_no", "page_no", "extracted_at").distinct()
    s = table(spark, d, "crawl_page").filter("site_domain is not null").select("page_no", "site_domain").distinct()
    return runs.sample_per_key(c.join(s, "page_no"), "site_domain", [F.asc_nulls_last("extracted_at"), F.asc("contact_no")]).select("site_domain", "contact_no")


@query("SELECT contact_no, contact_type, contact_value, CASE WHEN NOT isnan(confidence) THEN confidence END AS confidence FROM (SELECT DISTINCT contact_no, contact_type, contact_value, confidence FROM extracted_contact)")
def contacts_sorted(spark: SparkSession, d: str) -> DataFrame:
    """All extracted contacts, the surest first."""
    c = table(spark, d, "extracted_contact").select("contact_no", "contact_type", "contact_value", F.when(~F.isnan("confidence"), F.col("confidence")).alias("confidence")).distinct()
    return c.orderBy(F.desc_nulls_last("confidence"), "contact_no")


@query(
    """WITH l AS (SELECT DISTINCT record_no, lead_id, website FROM lead_row), b AS (SELECT lead_id AS id, max(record_no) AS primary_site FROM l GROUP BY 1), s AS (SELECT record_no AS site_no, lead_id AS id, website AS url, record_no % 2 = 0 AS is_primary FROM l WHERE website IS NOT NULL),
    f AS (SELECT id, arg_min(url, site_no) AS url FROM s WHERE is_primary GROUP BY 1) SELECT b.id, coalesce(s.url, f.url) AS url FROM b LEFT JOIN s ON s.site_no = b.primary_site LEFT JOIN f ON f.id = b.id"""
)
def primary_sites(spark: SparkSession, d: str) -> DataFrame:
    """Each lead's primary website: that of its last record, else the first one of even number."""
    l = table(spark, d, "lead_row").select("record_no", "lead_id", "website").distinct()
    b = l.groupBy(F.col("lead_id").alias("id")).agg(F.max("record_no").alias("primary_site"))
    s = l.filter("website is not null").select(F.col("record_no").alias("site_no"), F.col("lead_id").alias("id"), F.col("website").alias("url"), (F.col("record_no") % 2 == 0).alias("is_primary"))
    return runs.with_primary_site(b, s).select("id", "url")


@query(
    f"""WITH p AS (SELECT DISTINCT page_no, crawl_run_id AS site_id, url, final_url FROM crawl_page), s AS (SELECT crawl_run_id AS site_id, min({D.domain('final_url')}) AS dd FROM crawl_page GROUP BY 1)
    SELECT page_no, coalesce(dd, {D.domain('url')}) AS domain FROM p LEFT JOIN s USING (site_id)"""
)
def page_domains(spark: SparkSession, d: str) -> DataFrame:
    """The domain of every page's crawl run, taken from where its pages ended up."""
    c = table(spark, d, "crawl_page")
    p = c.select("page_no", F.col("crawl_run_id").alias("site_id"), "url").distinct()
    return runs.with_site_domain(p, c.select(F.col("crawl_run_id").alias("site_id"), F.col("final_url").alias("website"))).select("page_no", "domain")


@query(
    """WITH e AS (SELECT DISTINCT page_no AS subject, contact_type AS field, contact_no AS id FROM extracted_contact), r AS (SELECT DISTINCT page_no AS subject FROM crawl_page),
    x AS (SELECT subject, list(id ORDER BY CASE field WHEN 'PHONE' THEN 1 ELSE 2 END, id) AS ids FROM e WHERE field IN ('PHONE', 'EMAIL') GROUP BY 1) SELECT subject, coalesce(array_to_string(ids, ','), '') AS evidence FROM r LEFT JOIN x USING (subject)"""
)
def rule_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The evidence of every page for a rule about phones, then mail addresses."""
    e = table(spark, d, "extracted_contact").select(F.col("page_no").alias("subject"), F.col("contact_type").alias("field"), F.col("contact_no").alias("id")).distinct()
    r = table(spark, d, "crawl_page").select(F.col("page_no").alias("subject"), F.array(F.lit("PHONE"), F.lit("EMAIL")).alias("keys")).distinct()
    return runs.evidence_ids(r, e).select("subject", F.array_join(F.transform("evidence", lambda x: x.cast("string")), ",").alias("evidence"))


@query("WITH c AS (SELECT DISTINCT row_no, lead_id, source FROM contact_row WHERE lead_id IS NOT NULL), n AS (SELECT DISTINCT lead_id FROM scoring_result WHERE priority = 'HOT') SELECT row_no, lead_id FROM c WHERE lead_id NOT IN (SELECT lead_id FROM n WHERE lead_id IS NOT NULL) UNION ALL SELECT row_no, lead_id FROM c JOIN n USING (lead_id) WHERE row_no % 2 = 0")
def replaced_rows(spark: SparkSession, d: str) -> DataFrame:
    """Contacts after those of leads with a hot run were replaced by their even rows."""
    c = table(spark, d, "contact_row").filter("lead_id is not null").select("row_no", "lead_id", "source").distinct().select("row_no", "lead_id")
    hot = table(spark, d, "scoring_result").filter("priority = 'HOT'").select("lead_id").distinct()
    # a lead all of whose rows are replaced by none loses them, so the keys come along even where no row does
    fresh = c.join(hot, "lead_id", "left_semi").filter("row_no % 2 = 0")
    keys = hot.select(F.lit(None).cast("bigint").alias("row_no"), "lead_id")
    return runs.replace_by_key(c, fresh.unionByName(keys), "lead_id").filter("row_no is not null")


@query(
    f"""WITH p AS (SELECT DISTINCT site_domain AS site_id, fetch_method AS name, fetched_at AS seen FROM crawl_page WHERE site_domain IS NOT NULL AND fetch_method IS NOT NULL), s AS (SELECT DISTINCT site_domain AS site_id FROM crawl_page WHERE site_domain IS NOT NULL),
    l AS (SELECT site_id, max(seen) AS last FROM p GROUP BY 1 HAVING (epoch_us(TIMESTAMP '{_CLOCK}') - epoch_us(max(seen))) / 86400000000.0 <= 30)
    SELECT DISTINCT p.site_id, name, true AS reused FROM p JOIN l USING (site_id) WHERE seen = last UNION ALL SELECT site_id, 'NEW', false FROM s WHERE site_id NOT IN (SELECT site_id FROM l)"""
)
def reused_detections(spark: SparkSession, d: str) -> DataFrame:
    """What was detected at the latest fetch where that is fresh, else a new detection."""
    c = table(spark, d, "crawl_page").filter("site_domain is not null").withColumn("site_id", F.col("site_domain"))
    sites = c.select("site_id").distinct()
    old = c.filter("fetch_method is not null").select("site_id", F.col("fetch_method").alias("name"), F.col("fetched_at").alias("at")).distinct()
    return runs.reuse_fresh(sites, old, sites.withColumn("name", F.lit("NEW")), F.lit(_CLOCK).cast("timestamp"))


@query(
    """WITH t AS (SELECT DISTINCT page_no AS site_id, 400 + page_no % 9000 AS nav, CASE WHEN page_no % 3 <> 0 THEN 300.0::DOUBLE + page_no % 7000 END AS load, CASE WHEN page_no % 4 <> 0 THEN 200.0::DOUBLE + page_no % 3000 END AS dcl, CASE WHEN page_no % 5 <> 0 THEN 100.0::DOUBLE + page_no % 2000 END AS fcp FROM crawl_page)
    SELECT site_id, greatest(20.0::DOUBLE, least(100.0, floor(100 - coalesce(load, nav) / 80.0::DOUBLE + 0.5))) AS "performanceScore", coalesce(load, nav)::DOUBLE AS "lcpMs", greatest(0.0::DOUBLE, floor(coalesce(dcl, nav) * 0.05::DOUBLE + 0.5)) AS "tbtMs", coalesce(fcp, floor(nav * 0.6::DOUBLE + 0.5))::DOUBLE AS "fcpMs" FROM t"""
)
def timing_reports(spark: SparkSession, d: str) -> DataFrame:
    """Scores of made-up browser timings, some missing."""
    n = F.col("page_no")
    t = table(spark, d, "crawl_page").select("page_no").distinct().select(
        n.alias("site_id"), (400 + n % 9000).cast("double").alias("nav_ms"), F.when(n % 3 != 0, (300 + n % 7000).cast("double")).alias("load_ms"),
        F.when(n % 4 != 0, (200 + n % 3000).cast("double")).alias("dcl_ms"), F.when(n % 5 != 0, (100 + n % 2000).cast("double")).alias("fcp_ms"),
    )
    return runs.timing_report(t)


@query(
    """WITH t AS (SELECT DISTINCT page_no AS k FROM crawl_page) SELECT k AS site_id, CASE WHEN k % 5 = 0 THEN 0.0 ELSE (k % 101)::DOUBLE END AS "performanceScore", (k % 97)::DOUBLE AS "lighthouseAccessibility", 0.0::DOUBLE AS "bestPractices", (k % 11 * 9)::DOUBLE AS "lighthouseSeo",
    (k % 5000)::DOUBLE AS "lcpMs", CASE WHEN k % 2 = 0 THEN 0.25::DOUBLE END AS cls, NULL::DOUBLE AS "tbtMs", (k % 3000)::DOUBLE AS "fcpMs" FROM t"""
)
def api_reports(spark: SparkSession, d: str) -> DataFrame:
    """Captured measurement records composed from page numbers and read back."""
    k = F.col("page_no")
    score = lambda c, name: F.named_struct(F.lit("score"), c).alias(name)
    value = lambda c, name: F.named_struct(F.lit("numericValue"), c).alias(name)
    json = F.to_json(F.struct(F.struct(
        F.struct(score(F.when(k % 5 != 0, (k % 101) / 100), "performance"), score((k % 97) / 100, "accessibility"), score((k % 11 * 9) / 100, "seo")).alias("categories"),
        F.struct(value((k % 5000).cast("double"), "largest-contentful-paint"), value(F.when(k % 2 == 0, 0.25), "cumulative-layout-shift"), value((k % 3000).cast("double"), "first-contentful-paint")).alias("audits"),
    ).alias("lighthouseResult")))
    return runs.api_report(table(spark, d, "crawl_page").select("page_no").distinct().select(k.alias("site_id"), json.alias("json")))
