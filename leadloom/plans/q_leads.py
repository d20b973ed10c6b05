"""Queries over leads: dashboard, lists, latest runs, details, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.operators import leads
from leadloom.session import table

from .registry import query

_COLS = "record_no, lead_id, business_name, category, city, locality, address, website, data_quality_grade, discovery_source, last_verified"
CUR = f"""s0 AS (SELECT DISTINCT score_no, lead_id, scored_at, sales_opportunity, website_health, contact_confidence, audit_confidence, priority FROM scoring_result),
  s AS (SELECT lead_id, CASE WHEN NOT isnan(sales_opportunity) THEN sales_opportunity END AS sales_opportunity, CASE WHEN NOT isnan(website_health) THEN website_health END AS website_health, CASE WHEN NOT isnan(contact_confidence) THEN contact_confidence END AS contact_confidence,
    CASE WHEN NOT isnan(audit_confidence) THEN audit_confidence END AS audit_confidence, priority AS run_priority FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY scored_at DESC NULLS LAST, score_no DESC) AS n FROM s0) WHERE n = 1),
  cur AS (SELECT l.*, s.* EXCLUDE (lead_id) FROM (SELECT DISTINCT {_COLS} FROM lead_row) l LEFT JOIN s ON s.lead_id = l.lead_id)"""


def _current(spark: SparkSession, d: str) -> DataFrame:
    return leads.current(table(spark, d, "lead_row").selectExpr(*_COLS.split(", ")).distinct(), table(spark, d, "scoring_result"))


def _contacts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "contact_row").select("row_no", "lead_id", "contact_type", "contact_value", "confidence", "primary_contact", "verification_status", "source", "verified_at").distinct()


@query(
    f"""WITH {CUR}, a AS (SELECT count(*) AS businesses, count(website) AS with_website, count(*) FILTER (run_priority = 'HOT') AS hot, count(*) FILTER (run_priority = 'WARM') AS warm, round(avg(website_health), 6) AS mean_health, round(avg(sales_opportunity), 6) AS mean_opportunity FROM cur)
    SELECT a.*, (SELECT count(*) FILTER (primary_contact AND verification_status IN ('CONFIRMED', 'LIKELY')) FROM (SELECT DISTINCT row_no, primary_contact, verification_status FROM contact_row)) AS verified_contacts FROM a"""
)
def dashboard_stats(spark: SparkSession, d: str) -> DataFrame:
    return leads.dashboard(_current(spark, d), _contacts(spark, d))


_LIST = "regexp_matches(city, '(?i)a') AND sales_opportunity >= 20 AND (coalesce(regexp_matches(business_name, '(?i)an'), false) OR coalesce(regexp_matches(category, '(?i)an'), false))"


def _listed(spark: SparkSession, d: str) -> DataFrame:
    return leads.lead_filter(_current(spark, d), city="a", search="an", floors={"sales_opportunity": 20})


@query(f"WITH {CUR} SELECT record_no, business_name, sales_opportunity, website_health FROM cur WHERE {_LIST} ORDER BY sales_opportunity DESC NULLS LAST, record_no LIMIT 25 OFFSET 25")
def lead_list_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of a filtered list (a page is what the operator returns)."""
    return leads.lead_page(_listed(spark, d), page=2).select("record_no", "business_name", "sales_opportunity", "website_health")


@query(f"WITH {CUR} SELECT count(*) AS total, ceil(count(*) / 25.0)::BIGINT AS pages FROM cur WHERE {_LIST}")
def lead_list_count(spark: SparkSession, d: str) -> DataFrame:
    return leads.page_counts(_listed(spark, d))


@query("SELECT lead_id, score_no, scored_at, CASE WHEN NOT isnan(sales_opportunity) THEN sales_opportunity END AS sales_opportunity FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY scored_at DESC NULLS LAST, score_no DESC) AS n FROM (SELECT DISTINCT lead_id, score_no, scored_at, sales_opportunity FROM scoring_result)) WHERE n = 1")
def latest_run(spark: SparkSession, d: str) -> DataFrame:
    return leads.latest_runs(table(spark, d, "scoring_result").select("lead_id", "score_no", "scored_at", "sales_opportunity")).drop("n")


@query("SELECT lead_id, n, score_no FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY scored_at DESC NULLS LAST, score_no DESC) AS n FROM (SELECT DISTINCT lead_id, score_no, scored_at FROM scoring_result)) WHERE n <= 5")
def last_k_runs(spark: SparkSession, d: str) -> DataFrame:
    return leads.latest_runs(table(spark, d, "scoring_result").select("lead_id", "score_no", "scored_at"), 5).select("lead_id", "n", "score_no")


_DISPLAY = """c0 AS (SELECT DISTINCT row_no, lead_id, contact_type, contact_value, primary_contact, CASE WHEN NOT isnan(confidence) AND confidence BETWEEN 0 AND 1 THEN confidence END AS conf FROM contact_row),
  c1 AS (SELECT *, row_number() OVER (PARTITION BY lead_id, contact_type ORDER BY coalesce(primary_contact, false) DESC, conf DESC NULLS LAST, row_no) AS k FROM c0),
  disp AS (SELECT lead_id, max(contact_value) FILTER (contact_type = 'PHONE' AND k = 1) AS phone, max(contact_value) FILTER (contact_type = 'EMAIL' AND k = 1) AS email, max(contact_value) FILTER (contact_type = 'WHATSAPP' AND k = 1) AS whatsapp, count(DISTINCT row_no) AS contacts FROM c1 GROUP BY lead_id)"""


@query(f"WITH {_DISPLAY} SELECT * FROM disp")
def display_contacts(spark: SparkSession, d: str) -> DataFrame:
    return leads.display_contacts(_contacts(spark, d))


_SAFE = lambda x, n: f"CASE WHEN regexp_matches({x}, '^[=+\\-@]') THEN '''' || ({x}) ELSE ({x}) END AS {n}"
_OUT = lambda c: f"CASE WHEN record_no % 50 = 0 AND {c} IS NOT NULL THEN '[DO_NOT_CONTACT]' ELSE {c} END"
_EXPORT = f"""{CUR}, {_DISPLAY}, x AS (SELECT record_no, cur.lead_id, run_priority AS priority, {_SAFE('business_name', 'business_name')}, {_SAFE('category', 'category')}, {_SAFE('city', 'city')},
  {_SAFE("nullif(concat_ws(', ', nullif(address, ''), nullif(locality, ''), nullif(city, '')), '')", 'address_line')}, {_SAFE('website', 'website')}, {_SAFE(_OUT('phone'), 'phone')}, {_SAFE(_OUT('email'), 'email')}, {_SAFE('whatsapp', 'whatsapp')},
  sales_opportunity, website_health, audit_confidence, coalesce(contacts, 0) AS contacts FROM cur LEFT JOIN disp ON disp.lead_id = cur.lead_id)"""


def _export(spark: SparkSession, d: str) -> DataFrame:
    return leads.export_rows(_current(spark, d), _contacts(spark, d), F.col("record_no") % 50 == 0)


@query(f"WITH {_EXPORT} SELECT * FROM x")
def export_leads(spark: SparkSession, d: str) -> DataFrame:
    """The lead sheet; every fiftieth record stands for one that must not be contacted."""
    return _export(spark, d)


_BAND = lambda c, n: f"CASE WHEN {c} >= 80 THEN 'good' WHEN {c} >= 60 THEN 'fair' WHEN {c} >= 40 THEN 'weak' WHEN {c} IS NOT NULL THEN 'poor' END AS {n}"


@query(
    f"""WITH {_EXPORT} SELECT record_no, CASE WHEN priority = 'HOT' THEN 'hot' END AS priority_style, CASE WHEN website IS NULL OR website = '' THEN 'missing' END AS website_style, CASE WHEN phone IS NULL AND email IS NULL AND whatsapp IS NULL THEN 'missing' END AS contact_style,
    CASE WHEN coalesce(audit_confidence, 100) < 50 THEN 'low' END AS confidence_style, {_BAND('sales_opportunity', 'opportunity_style')}, {_BAND('website_health', 'health_style')} FROM x"""
)
def export_styles(spark: SparkSession, d: str) -> DataFrame:
    return leads.export_styles(_export(spark, d))


@query(
    "SELECT row_no, lead_id, contact_type, CASE WHEN contact_value <> '[DO_NOT_CONTACT]' AND regexp_matches(contact_value, '^[=+\\-@]') THEN '''' || contact_value ELSE contact_value END AS value, upper(trim(source)) AS source, coalesce(primary_contact, false) AS is_primary "
    "FROM (SELECT DISTINCT row_no, lead_id, contact_type, contact_value, source, primary_contact FROM contact_row)"
)
def export_contacts(spark: SparkSession, d: str) -> DataFrame:
    from leadloom.functions import text

    c = _contacts(spark, d).select("row_no", "lead_id", "contact_type", "contact_value", "source", "primary_contact").distinct()
    return c.select("row_no", "lead_id", "contact_type", text.safe_cell(F.col("contact_value")).alias("value"), F.upper(F.trim("source")).alias("source"), F.coalesce("primary_contact", F.lit(False)).alias("is_primary"))


@query(
    """WITH l AS (SELECT DISTINCT lead_id FROM lead_row), c AS (SELECT lead_id, count(DISTINCT row_no) AS contacts, string_agg(DISTINCT contact_type, '; ' ORDER BY contact_type) AS kinds FROM contact_row GROUP BY 1),
    s AS (SELECT lead_id, count(DISTINCT score_no) AS runs, max(scored_at) AS last_run FROM scoring_result GROUP BY 1), m AS (SELECT lead_id, string_agg(DISTINCT x, '; ' ORDER BY x) AS flags FROM (SELECT lead_id, unnest(modifiers) AS x FROM scoring_result) GROUP BY 1)
    SELECT l.lead_id, coalesce(contacts, 0) AS contacts, kinds, coalesce(runs, 0) AS runs, last_run, flags FROM l LEFT JOIN c USING (lead_id) LEFT JOIN s USING (lead_id) LEFT JOIN m USING (lead_id)"""
)
def lead_detail(spark: SparkSession, d: str) -> DataFrame:
    """Every lead with what its detail page gathers: contacts, kinds, runs, flags."""
    ids = table(spark, d, "lead_row").select("lead_id").distinct()
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), "; ")
    c = table(spark, d, "contact_row").groupBy("lead_id").agg(F.countDistinct("row_no").alias("contacts"), joined("contact_type").alias("kinds"))
    s = table(spark, d, "scoring_result").groupBy("lead_id").agg(F.countDistinct("score_no").alias("runs"), F.max("scored_at").alias("last_run"))
    m = table(spark, d, "scoring_result").select("lead_id", F.explode("modifiers").alias("x")).groupBy("lead_id").agg(joined("x").alias("flags"))
    j = ids.join(c, "lead_id", "left").join(s, "lead_id", "left").join(m, "lead_id", "left")
    return j.select("lead_id", F.coalesce("contacts", F.lit(0)).alias("contacts"), "kinds", F.coalesce("runs", F.lit(0)).alias("runs"), "last_run", "flags")


@query(
    """WITH l AS (SELECT DISTINCT record_no, city, lead_id FROM lead_row), s AS (SELECT DISTINCT lead_id FROM scoring_result WHERE sales_opportunity IS NOT NULL AND NOT isnan(sales_opportunity))
    SELECT city, count(*) AS total, count(s.lead_id) AS scored, least(100.0, floor(count(s.lead_id) / count(*)::DOUBLE * 1000 + 0.5) / 10) AS percent FROM l LEFT JOIN s USING (lead_id) GROUP BY city"""
)
def job_progress(spark: SparkSession, d: str) -> DataFrame:
    """Share of scored leads of every city, one decimal."""
    l = table(spark, d, "lead_row").select("record_no", "city", "lead_id").distinct()
    s = table(spark, d, "scoring_result").filter(F.col("sales_opportunity").isNotNull() & ~F.isnan("sales_opportunity")).select("lead_id").distinct().withColumn("yes", F.lit(1))
    a = l.join(s, "lead_id", "left").groupBy("city").agg(F.count("*").alias("total"), F.count("yes").alias("scored"))
    return a.withColumn("percent", F.least(F.lit(100.0), F.floor(F.col("scored") / F.col("total") * 1000 + 0.5) / 10))


@query("SELECT lead_id, string_agg(DISTINCT lower(trim(source)), ',' ORDER BY lower(trim(source))) AS sources, count(DISTINCT contact_type) AS kinds FROM contact_row WHERE trim(source) <> '' GROUP BY lead_id")
def source_sets(spark: SparkSession, d: str) -> DataFrame:
    """The set of sources that name each lead."""
    c = table(spark, d, "contact_row").filter(F.trim("source") != "")
    return c.groupBy("lead_id").agg(F.array_join(F.sort_array(F.collect_set(F.lower(F.trim("source")))), ",").alias("sources"), F.countDistinct("contact_type").alias("kinds"))


@query(
    """WITH l AS (SELECT DISTINCT record_no, country, state, city, operational_status FROM lead_row) SELECT country, state, city, count(*) AS leads, count(*) FILTER (operational_status = 'OPEN') AS open_leads, (grouping(country) * 4 + grouping(state) * 2 + grouping(city))::BIGINT AS level
    FROM l GROUP BY ROLLUP (country, state, city)"""
)
def region_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Leads by country, state and city with all subtotals (extension)."""
    l = table(spark, d, "lead_row").select("record_no", "country", "state", "city", "operational_status").distinct()
    return l.rollup("country", "state", "city").agg(F.count("*").alias("leads"), F.count_if(F.col("operational_status") == "OPEN").alias("open_leads"), F.grouping_id().alias("level"))


@query(
    """SELECT n_name AS city, c_mktsegment AS category, count(*) AS businesses, round(avg(c_acctbal), 6) AS mean_balance, sum(orders) AS orders FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
    LEFT JOIN (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1) o ON o_custkey = c_custkey GROUP BY 1, 2"""
)
def business_adapter(spark: SparkSession, d: str) -> DataFrame:
    """Customers read as businesses, with their orders; nation and region are small and broadcast by size."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(o, "c_custkey", "left")
    return j.groupBy(F.col("n_name").alias("city"), F.col("c_mktsegment").alias("category")).agg(F.count("*").alias("businesses"), F.round(F.avg("c_acctbal"), 6).alias("mean_balance"), F.sum("orders").alias("orders"))


@query(f"WITH {CUR}, q AS (SELECT lead_id, list(DISTINCT discovery_source) AS jobs FROM lead_row WHERE discovery_source IS NOT NULL GROUP BY 1) SELECT record_no, cur.lead_id, sales_opportunity FROM cur JOIN q ON q.lead_id = cur.lead_id WHERE list_contains(jobs, 'csv_import') AND run_priority = 'WARM' AND sales_opportunity >= 50")
def export_filter(spark: SparkSession, d: str) -> DataFrame:
    """Warm leads of one discovery source (standing for a job) from an opportunity of 50, with only the allowed columns."""
    jobs = table(spark, d, "lead_row").groupBy("lead_id").agg(F.collect_set("discovery_source").alias("jobs"))
    rows = leads.export_filter(_current(spark, d).join(jobs, "lead_id"), job="csv_import", priority="WARM", floor=50)
    return leads.allowed_columns(rows, ["record_no", "lead_id", "sales_opportunity"])


@query(f"WITH {CUR} SELECT record_no, business_name FROM cur ORDER BY business_name NULLS FIRST, record_no LIMIT 25")
def lead_list_by_name(spark: SparkSession, d: str) -> DataFrame:
    """The first page by name, missing names first."""
    return leads.lead_page(_current(spark, d), sort="name").select("record_no", "business_name")


@query(f"WITH {CUR} SELECT record_no, website_health FROM cur ORDER BY website_health DESC NULLS LAST, record_no LIMIT 25")
def lead_list_by_health(spark: SparkSession, d: str) -> DataFrame:
    return leads.lead_page(_current(spark, d), sort="health").select("record_no", "website_health")
