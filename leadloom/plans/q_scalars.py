"""Queries of the scalar functions, each over whole columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import freshness, text, urls
from leadloom.session import table

from . import duck as D
from .registry import query

NOW = "2025-02-24 00:00:00"


@query(f"SELECT record_no, {D.name_key('name')} AS name_key, {D.token_key('name')} AS token_key FROM {D.once('entity_record', 'record_no', 'name')}")
def normalize_names(spark: SparkSession, d: str) -> DataFrame:
    """Names without accents, punctuation and legal words. Exact for Latin letters."""
    e = table(spark, d, "entity_record").select("record_no", "name").distinct()
    return e.select("record_no", text.name_key(F.col("name")).alias("name_key"), text.token_key(F.col("name")).alias("token_key"))


@query(f"SELECT row_no, {D.email_key('contact_value')} AS email FROM {D.once('contact_row', 'row_no', 'contact_type', 'contact_value')} WHERE contact_type = 'EMAIL'")
def normalize_emails(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "contact_row").filter("contact_type = 'EMAIL'").select("row_no", "contact_value").distinct()
    return c.select("row_no", text.email_key(F.col("contact_value")).alias("email"))


@query(f"SELECT record_no, {D.phone_key('phone')} AS phone FROM {D.once('entity_record', 'record_no', 'phone')}")
def normalize_phones(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entity_record").select("record_no", "phone").distinct()
    return e.select("record_no", text.phone_key(F.col("phone")).alias("phone"))


@query(
    f"SELECT record_no, {D.url_key('website')} AS url, {D.domain('website')} AS domain, {D.path_priority('website')} AS priority "
    f"FROM {D.once('maps_listing', 'record_no', 'website')} WHERE website IS NOT NULL"
)
def normalize_urls(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "maps_listing").filter("website is not null").select("record_no", "website").distinct()
    w = F.col("website")
    return m.select("record_no", urls.url_key(w).alias("url"), urls.domain(w).alias("domain"), urls.path_priority(w).alias("priority"))


@query(f"SELECT domain, count(*) AS listings FROM (SELECT {D.domain('website')} AS domain FROM {D.once('maps_listing', 'record_no', 'website')}) WHERE domain IS NOT NULL GROUP BY domain")
def domains(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "maps_listing").select("record_no", "website").distinct()
    return m.select(urls.domain(F.col("website")).alias("domain")).filter("domain is not null").groupBy("domain").agg(F.count("*").alias("listings"))


_A = ("address.line1", "address.locality", "address.city", "address.postal_code", "address.country")


@query(f"SELECT record_no, {D.address_key(*_A)} AS address_key FROM {D.once('entity_record', 'record_no', 'address')} WHERE address IS NOT NULL")
def address_keys(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entity_record").filter("address is not null").select("record_no", "address").distinct()
    return e.select("record_no", text.address_key(*[F.col(c) for c in _A]).alias("address_key"))


@query(
    "SELECT row_no, CASE WHEN regexp_matches(contact_value, '^[=+\\-@]') THEN '''' || contact_value ELSE contact_value END AS cell "
    "FROM (SELECT DISTINCT row_no, contact_value FROM contact_row)"
)
def sanitize_cells(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "contact_row").select("row_no", "contact_value").distinct()
    return c.select("row_no", text.safe_cell(F.col("contact_value")).alias("cell"))


_NK = [D.name_key("a.name"), D.name_key("b.name")]


@query(
    f"""WITH e AS (SELECT DISTINCT lower(id) AS id, name FROM entity_record),
    p AS (SELECT DISTINCT lower(trim(left_id)) AS l, lower(trim(right_id)) AS r FROM match_result WHERE left_id IS NOT NULL AND right_id IS NOT NULL)
    SELECT l, r, {D.name_key('a.name')} AS name_l, {D.name_key('b.name')} AS name_r, levenshtein({_NK[0]}, {_NK[1]}) AS edits, round({D.similarity(*_NK)}, 9) AS likeness
    FROM p JOIN e a ON p.l = a.id JOIN e b ON p.r = b.id"""
)
def name_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Edit distance and ratio of the names of every recorded pair; names are ASCII after normalisation."""
    e = table(spark, d, "entity_record").select(F.lower("id").alias("id"), text.name_key(F.col("name")).alias("name")).distinct()
    m = table(spark, d, "match_result").filter("left_id is not null and right_id is not null")
    p = m.select(F.lower(F.trim("left_id")).alias("l"), F.lower(F.trim("right_id")).alias("r")).distinct()
    j = p.join(e.toDF("l", "name_l"), "l").join(e.toDF("r", "name_r"), "r")
    a, b = F.col("name_l"), F.col("name_r")
    return j.select("l", "r", "name_l", "name_r", F.levenshtein(a, b).alias("edits"), F.round(text.similarity(a, b), 9).alias("likeness"))


_F = ("crawl", "performance", "technology", "contacts")


@query(
    "SELECT record_no, " + f"round({D.age_days('last_verified', f'TIMESTAMP {D.q(NOW)}')}, 6) AS age, "
    + ", ".join(f"coalesce({D.age_days('last_verified', f'TIMESTAMP {D.q(NOW)}')} <= {n}, false) AS fresh_{k}" for k, n in (("crawl", 7), ("technology", 30)))
    + ", " + ", ".join(f"round({D.freshness_score('last_verified', f'TIMESTAMP {D.q(NOW)}', k)}, 6) AS score_{k}" for k in _F)
    + " FROM (SELECT DISTINCT record_no, last_verified FROM lead_row)"
)
def freshness_scores(spark: SparkSession, d: str) -> DataFrame:
    leads = table(spark, d, "lead_row").select("record_no", "last_verified").distinct()
    now, last = F.lit(NOW).cast("timestamp"), F.col("last_verified")
    return leads.select(
        "record_no", F.round(freshness.age_days(last, now), 6).alias("age"),
        *[freshness.is_fresh(last, now, k).alias(f"fresh_{k}") for k in ("crawl", "technology")],
        *[F.round(freshness.freshness_score(last, now, k), 6).alias(f"score_{k}") for k in _F],
    )


@query(
    f"SELECT record_no, {D.clamp('v')} AS clamped FROM (SELECT DISTINCT score_no AS record_no, sales_opportunity * 1.37 - 20 AS v FROM scoring_result) WHERE v IS NOT NULL"
)
def clamped_scores(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "scoring_result").select(F.col("score_no").alias("record_no"), (F.col("sales_opportunity") * 1.37 - 20).alias("v")).distinct()
    return s.filter("v is not null").select("record_no", text.clamp_score(F.col("v")).alias("clamped"))


@query(
    f"SELECT page_no, {D.hash_score('url', 'perf', 45, 92)} AS performance, {D.hash_score('url', 'lcp', 1200, 4500)} AS lcp_ms, round({D.hash_score('url', 'cls', 1, 25)} / 100.0, 2)::DOUBLE AS cls, "
    f"sha256(coalesce(html_snippet, '')) AS digest FROM {D.once('crawl_page', 'page_no', 'url', 'html_snippet')}"
)
def perf_mock(spark: SparkSession, d: str) -> DataFrame:
    """Reproducible stand-in measurements by URL, and the content digest."""
    p = table(spark, d, "crawl_page").select("page_no", "url", "html_snippet").distinct()
    u = F.col("url")
    return p.select(
        "page_no", text.hash_score(u, "perf", 45, 92).alias("performance"), text.hash_score(u, "lcp", 1200, 4500).alias("lcp_ms"),
        F.round(text.hash_score(u, "cls", 1, 25) / 100.0, 2).alias("cls"), F.sha2(F.coalesce("html_snippet", F.lit("")), 256).alias("digest"),
    )


@query(
    f"SELECT record_no, host, {D.is_aggregator('host')} AS aggregator, (contains(host, 'google.') OR contains(host, 'gstatic.com') OR contains(host, 'googleusercontent.com') OR host = 'g.page' OR ends_with(host, '.google')) AS search_engine "
    f"FROM (SELECT record_no, {D.host('website')} AS host FROM {D.once('entity_record', 'record_no', 'website')} WHERE website IS NOT NULL)"
)
def aggregator_hosts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entity_record").filter("website is not null").select("record_no", "website").distinct()
    h = e.select("record_no", urls.host(F.col("website")).alias("host"))
    return h.select("record_no", "host", urls.is_aggregator(F.col("host")).alias("aggregator"), urls.is_search_engine(F.col("host")).alias("search_engine"))


_IP = "(l_partkey % 256)::VARCHAR || '.' || (l_suppkey % 256)::VARCHAR || '.' || (l_orderkey % 256)::VARCHAR || '.' || l_linenumber::VARCHAR"


@query(
    f"""SELECT l_orderkey, l_linenumber, ip, (a IN (10, 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 100 AND b BETWEEN 64 AND 127)) AS is_private
    FROM (SELECT *, split_part(ip, '.', 1)::INTEGER AS a, split_part(ip, '.', 2)::INTEGER AS b FROM (SELECT l_orderkey, l_linenumber, {_IP} AS ip FROM lineitem))"""
)
def private_hosts(spark: SparkSession, d: str) -> DataFrame:
    """The address predicate over addresses built from the order lines."""
    li = table(spark, d, "lineitem")
    ip = F.concat_ws(".", *[(F.col(c) % 256).cast("string") for c in ("l_partkey", "l_suppkey", "l_orderkey")], F.col("l_linenumber").cast("string"))
    return li.select("l_orderkey", "l_linenumber", ip.alias("ip")).withColumn("is_private", urls.is_private_ip(F.col("ip")))


@query(
    "SELECT record_no, CASE WHEN regexp_extract(href, '(?i)!1s(0x[a-f0-9]+:0x[a-f0-9]+)', 1) <> '' THEN regexp_extract(href, '(?i)!1s(0x[a-f0-9]+:0x[a-f0-9]+)', 1) "
    "WHEN regexp_extract(href, '(?i)!16s([^!]+)', 1) <> '' THEN url_decode(regexp_extract(href, '(?i)!16s([^!]+)', 1)) "
    "WHEN regexp_extract(href, '(ChIJ[a-zA-Z0-9_-]+)', 1) <> '' THEN regexp_extract(href, '(ChIJ[a-zA-Z0-9_-]+)', 1) ELSE split_part(href, '?', 1) END AS place "
    "FROM (SELECT DISTINCT record_no, href FROM maps_listing) WHERE href IS NOT NULL"
)
def place_ids(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "maps_listing").filter("href is not null").select("record_no", "href").distinct()
    return m.select("record_no", urls.place_id(F.col("href")).alias("place"))


_LABEL = "concat_ws(' · ', name, '4.5 stars', CASE WHEN trim(category_hint) <> '' THEN replace(category_hint, '·', ' ') END, address_hint)"


@query(
    f"""WITH l AS (SELECT record_no, list_filter(list_transform(string_split({_LABEL}, '·'), lambda x: trim(x)), lambda x: x <> '') AS parts
      FROM {D.once('maps_listing', 'record_no', 'name', 'category_hint', 'address_hint')} WHERE name IS NOT NULL),
    r AS (SELECT record_no, parts, list_filter(parts[2:], lambda x: NOT regexp_matches(x, '(?i)stars?|\\(\\d+\\)')) AS rest FROM l)
    SELECT record_no, parts[1] AS name, list_filter(rest, lambda x: NOT (regexp_matches(x, '^\\d') OR contains(x, ',')))[1] AS category_hint,
      list_filter(rest, lambda x: regexp_matches(x, '^\\d') OR contains(x, ','))[-1] AS address_hint FROM r"""
)
def listing_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels composed from the listings and parsed again."""
    m = table(spark, d, "maps_listing").filter("name is not null").select("record_no", "name", "category_hint", "address_hint").distinct()
    label = F.concat_ws(" · ", "name", F.lit("4.5 stars"), F.when(F.trim("category_hint") != "", F.replace("category_hint", F.lit("·"), F.lit(" "))), "address_hint")
    return m.select("record_no", urls.parse_label(label).alias("p")).select("record_no", "p.name", "p.category_hint", "p.address_hint")


@query(
    "SELECT user_id, event_id, CASE WHEN user_id % 4 <= 1 THEN 5000 WHEN user_id % 4 = 2 THEN 30000 END AS delay_ms FROM events"
)
def retry_delays(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("user_id", "event_id", text.retry_delay_ms(F.col("user_id") % 4).alias("delay_ms"))


@query(
    "SELECT record_no, regexp_replace(regexp_replace(lower(business_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, "
    "concat_ws(', ', nullif(address, ''), nullif(locality, ''), nullif(city, '')) AS shown, upper(regexp_replace(postal_code, '\\s+', '', 'g')) AS post "
    "FROM (SELECT DISTINCT record_no, business_name, address, locality, city, postal_code FROM lead_row)"
)
def display_texts(spark: SparkSession, d: str) -> DataFrame:
    leads = table(spark, d, "lead_row").select("record_no", "business_name", "address", "locality", "city", "postal_code").distinct()
    return leads.select(
        "record_no", text.slug(F.col("business_name")).alias("slug"), text.joined(", ", F.col("address"), F.col("locality"), F.col("city")).alias("shown"),
        text.postal_key(F.col("postal_code")).alias("post"),
    )
