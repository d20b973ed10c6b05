"""Queries of the sources: search expansion, generated and imported candidates, pages and link lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom import constants as K
from leadloom.sources import candidates, pages
from leadloom.session import respread, table

from . import duck as D
from .registry import query


def duck_fill(template: str) -> str:
    return " || ".join(t if field else D.q(t) for field, t in pages.pieces(template))


# businesses for the page source: leads with a web site
BUSINESSES = f"""(SELECT record_no AS business_id, business_name AS name, coalesce(city, '') AS city, coalesce(primary_phone, '') AS phone, coalesce(primary_email, '') AS email,
  'https://' || {D.domain('website')} AS site FROM (SELECT DISTINCT record_no, business_name, city, primary_phone, primary_email, website FROM lead_row) WHERE {D.domain('website')} IS NOT NULL)"""
PAGES = f"""pg AS (SELECT business_id, site, unnest([{{'seq': 1, 'url': site || '/', 'html': {duck_fill(pages.HOME)}}}, {{'seq': 2, 'url': site || '/contact', 'html': {duck_fill(pages.CONTACT)}}}]) AS p,
  business_id % 2 = 0 AS hsts, business_id % 3 = 1 AS cookie, business_id % 5 = 1 AS server FROM (
  SELECT *, regexp_replace(phone, '[^0-9]', '', 'g') AS digits, CASE WHEN business_id % 3 = 0 THEN '' ELSE '<meta name="viewport" content="width=device-width, initial-scale=1">' END AS viewport,
    CASE WHEN business_id % 5 = 0 THEN '' ELSE '<meta name="description" content="A small shop"><meta property="og:title" content="shop">' END AS meta,
    CASE WHEN business_id % 7 = 0 THEN '' ELSE ' lang="en"' END AS lang, [{', '.join(D.q(t) for t in pages.TECH)}][business_id % 4 + 1] AS tech FROM {BUSINESSES}))"""
PAGE_ROWS = f"WITH {PAGES}, page AS (SELECT business_id, site, p.seq AS seq, p.url AS url, p.html AS html, hsts, cookie, server FROM pg)"


def businesses(spark: SparkSession, d: str) -> DataFrame:
    from leadloom.functions import urls

    leads = table(spark, d, "lead_row").select("record_no", "business_name", "city", "primary_phone", "primary_email", "website").distinct()
    site = urls.domain(F.col("website"))
    return leads.filter(site.isNotNull()).select(
        F.col("record_no").alias("business_id"), F.col("business_name").alias("name"), "city", F.col("primary_phone").alias("phone"), F.col("primary_email").alias("email"), F.concat(F.lit("https://"), site).alias("site")
    )


def made_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.fixture_pages(respread(businesses(spark, d)))


@query(f"{PAGE_ROWS} SELECT business_id, seq, url, sha256(html) AS digest, length(html) AS size FROM page")
def fixture_pages(spark: SparkSession, d: str) -> DataFrame:
    return made_pages(spark, d).select("business_id", F.col("seq").cast("int").alias("seq"), "url", F.sha2("html", 256).alias("digest"), F.length("html").alias("size"))


_SEARCHES = "(SELECT DISTINCT city, locality, category FROM lead_row WHERE city IS NOT NULL AND trim(category) <> '')"
_SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
_TITLE = "array_to_string(list_transform(list_filter(string_split(regexp_replace({0}, '[\\s_-]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


@query(
    f"""WITH s AS (SELECT *, concat_ws('|', city, coalesce(locality, ''), category, '') AS seed FROM {_SEARCHES}),
    h AS (SELECT *, list_reduce(list_prepend(0::HUGEINT, list_transform(range(1, length(seed) + 1), lambda i: ascii(seed[i])::HUGEINT)), lambda a, c: (a * 31 + c) % 4294967296) AS base FROM s),
    r AS (SELECT *, unnest(range(0, 3 + (base % 3)::BIGINT)) AS i FROM h), n AS (SELECT *, ((base + i * 17) % 10000)::BIGINT AS n, coalesce(locality, 'Central') AS place FROM r),
    c AS (SELECT 'mock:' || {_SLUG.format('category')} || '-' || {_SLUG.format('city')} || '-' || n AS external_id, {_TITLE.format('category')} || ' ' || {_TITLE.format('place')} || ' ' || n AS name,
      category, '9' || substr((800000000 + n)::VARCHAR, 1, 9) AS phone, CASE WHEN n % 7 <> 0 THEN 'https://www.' || {_SLUG.format('category')} || '-' || {_SLUG.format('city')} || '-' || n || '.example.com' END AS website,
      (100 + n % 50)::VARCHAR || ' Main Road' AS line1, place AS locality, city, (110000 + n % 900)::VARCHAR AS postal_code, CASE WHEN n % 23 = 0 THEN 'CLOSED' ELSE 'OPEN' END AS status, category || ' ' || city AS query_text, i FROM n)
    SELECT * EXCLUDE (i) FROM c UNION ALL SELECT external_id || ':dup', name || ' Clinic', * EXCLUDE (i, external_id, name) FROM c WHERE i = 0"""
)
def mock_source(spark: SparkSession, d: str) -> DataFrame:
    """Generated candidates for every city, locality and category of the leads, as typed."""
    s = table(spark, d, "lead_row").select("city", "locality", "category").filter("city is not null and trim(category) <> ''").distinct()
    return candidates.generated_candidates(s.withColumn("query_text", F.concat("category", F.lit(" "), "city")))


@query(
    """WITH j AS (SELECT city, state, country, unnest(locs) AS locality FROM (SELECT city, any_value(state) AS state, any_value(country) AS country, list(DISTINCT locality) FILTER (locality IS NOT NULL) AS locs FROM lead_row WHERE city IS NOT NULL GROUP BY city)),
    t AS (SELECT category_name AS category, unnest([category_name, vertical]) AS term FROM category_ref)
    SELECT city AS job_id, city, locality, category, CASE WHEN term <> category THEN term END AS alias, concat_ws(' ', nullif(term, ''), nullif(locality, ''), nullif(city, ''), nullif(state, ''), nullif(country, '')) AS query_text FROM j, t"""
)
def query_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Every locality, category and term of one search job a city; the vertical serves as the other term."""
    jobs = table(spark, d, "lead_row").filter("city is not null").groupBy("city").agg(F.max("state").alias("state"), F.max("country").alias("country"), F.collect_set("locality").alias("localities"))
    ref = table(spark, d, "category_ref")
    terms = ref.agg(F.collect_list("category_name").alias("categories"), F.map_from_entries(F.collect_list(F.struct("category_name", F.array("vertical")))).alias("aliases"))
    return candidates.expand_queries(jobs.withColumn("job_id", F.col("city")).join(F.broadcast(terms)))


@query("SELECT DISTINCT record_no, name, category_hint AS category, query_text FROM maps_listing WHERE contains(query_text, 'dental clinic') OR category_hint = 'dental clinic'")
def csv_source_filter(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "maps_listing").select("record_no", "name", F.col("category_hint").alias("category"), "query_text").distinct()
    return candidates.imported_candidates(m, "dental clinic")


@query(
    """SELECT 'places:' || place_id AS external_id, trim(name) AS name, nullif(category_hint, '') AS subcategory, phone, website, address_hint AS line1, CASE record_no % 4 WHEN 0 THEN 'CLOSED' WHEN 1 THEN 'TEMPORARILY_CLOSED' WHEN 2 THEN 'OPEN' ELSE 'UNKNOWN' END AS status
    FROM (SELECT DISTINCT record_no, place_id, name, category_hint, phone, website, address_hint FROM maps_listing) WHERE place_id <> '' AND trim(name) <> ''"""
)
def places_source(spark: SparkSession, d: str) -> DataFrame:
    """Listings written as place records in JSON and read by the captured-record source."""
    m = table(spark, d, "maps_listing").select("record_no", "place_id", "name", "category_hint", "phone", "website", "address_hint").distinct()
    status = F.element_at(F.array(*[F.lit(x) for x in ("CLOSED_PERMANENTLY", "CLOSED_TEMPORARILY", "OPERATIONAL", "OTHER")]), (F.col("record_no") % 4 + 1).cast("int"))
    json = F.to_json(F.struct(
        F.col("place_id").alias("id"), F.struct(F.col("name").alias("text")).alias("displayName"), F.col("address_hint").alias("formattedAddress"), F.col("phone").alias("nationalPhoneNumber"),
        F.col("website").alias("websiteUri"), status.alias("businessStatus"), F.array(F.nullif("category_hint", F.lit(""))).alias("types"),
    ))
    return candidates.place_candidates(m.select(json.alias("json"))).drop("latitude", "longitude")


_URL = D.sub(D.url_key("url"), "/$", "", "")


@query(
    f"""WITH u AS (SELECT {_URL} AS url, min(page_no) AS seq FROM crawl_page GROUP BY 1), k AS (SELECT {D.domain('url')} AS domain, url, {D.path_priority('url')} AS priority, seq FROM u WHERE url IS NOT NULL),
    r AS (SELECT domain, url, priority, row_number() OVER (PARTITION BY domain ORDER BY priority, seq, url) AS place FROM k) SELECT * FROM r WHERE place <= {K.MAX_PAGES}"""
)
def crawl_frontier(spark: SparkSession, d: str) -> DataFrame:
    return pages.crawl_frontier(table(spark, d, "crawl_page").select("url", F.col("page_no").alias("seq")))


@query(
    f"""{PAGE_ROWS}, h AS (SELECT business_id * 10 + seq AS page_id, site, url, unnest(regexp_extract_all(html, {D.q(r'''(?i)<a\s[^>]*?href=["']([^"']*)["']''')}, 1)) AS href FROM page),
    l AS (SELECT page_id, url, CASE WHEN regexp_matches(regexp_replace(href, '#.*$', ''), '^https?://') THEN regexp_replace(href, '#.*$', '') ELSE site || regexp_replace(href, '#.*$', '') END AS link FROM h WHERE NOT regexp_matches(href, '^(mailto:|tel:|javascript:)|^$'))
    SELECT DISTINCT page_id, link FROM l WHERE {D.domain('link')} = {D.domain('url')}"""
)
def link_discovery(spark: SparkSession, d: str) -> DataFrame:
    p = made_pages(spark, d)
    return pages.discovered_links(p.select((F.col("business_id") * 10 + F.col("seq")).alias("page_id"), "url", "html"))


_ROBOTS = "'User-agent: *' || chr(10) || CASE WHEN page_no % 3 = 0 THEN 'Disallow: /' ELSE 'Disallow: /tmp' END || chr(10) || CASE WHEN page_no % 2 = 0 THEN 'Sitemap: https://' || site_domain || '/map.xml' ELSE '' END"


@query(f"SELECT page_no AS id, page_no % 3 <> 0 AS allowed, CASE WHEN page_no % 2 = 0 THEN 'https://' || site_domain || '/map.xml' END AS sitemap FROM {D.once('crawl_page', 'page_no', 'site_domain')} WHERE site_domain IS NOT NULL")
def robots_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules read back from robots files composed for every page's site."""
    p = table(spark, d, "crawl_page").select("page_no", "site_domain").distinct().filter("site_domain is not null")
    body = F.concat(
        F.lit("User-agent: *\n"), F.when(F.col("page_no") % 3 == 0, "Disallow: /").otherwise("Disallow: /tmp"), F.lit("\n"),
        F.when(F.col("page_no") % 2 == 0, F.concat(F.lit("Sitemap: https://"), "site_domain", F.lit("/map.xml"))).otherwise(""),
    )
    return pages.robots_rules(p.select(F.col("page_no").alias("id"), body.alias("body")))


@query(
    f"WITH s AS (SELECT site_domain AS id, url, row_number() OVER (PARTITION BY site_domain ORDER BY page_no) AS place FROM {D.once('crawl_page', 'page_no', 'site_domain', 'url')} WHERE site_domain IS NOT NULL) SELECT id, place, url AS loc FROM s WHERE place <= 20"
)
def sitemap_locations(spark: SparkSession, d: str) -> DataFrame:
    """Locations read back from one composed sitemap a site; a site's first 20 are what a crawl takes from one."""
    p = table(spark, d, "crawl_page").select("page_no", "site_domain", "url").distinct().filter("site_domain is not null")
    body = p.groupBy(F.col("site_domain").alias("id")).agg(F.sort_array(F.collect_list(F.struct("page_no", "url"))).alias("u"))
    body = body.select("id", F.array_join(F.transform("u", lambda x: F.concat(F.lit("<url><loc> "), x["url"], F.lit(" </loc></url>"))), "\n").alias("body"))
    return pages.sitemap_locations(body)




_LINKED = f"""m AS (SELECT DISTINCT record_no, name, href, place_id, address_hint, category_hint, phone, website, query_text FROM maps_listing),
  sig AS (SELECT record_no, CASE WHEN phone IS NULL THEN [] WHEN record_no % 3 = 0 THEN ['tel:', 'tel:' || phone || '?x=1'] ELSE [] END AS tels, CASE WHEN phone IS NULL THEN [] ELSE ['Open now', 'Phone: ' || phone] END AS labels, phone, website,
    CASE WHEN website IS NULL THEN NULL WHEN record_no % 2 = 0 THEN ['https://www.facebook.com/x', 'https://www.google.com/url?q=' || url_encode(website) || '&sa=U'] ELSE ['https://maps.google.com/y', website] END AS links FROM m)"""
_UNWRAP = "CASE WHEN regexp_matches(x, '^https?://(www\\.)?google\\.com/url\\?') THEN url_decode(regexp_extract(x, '[?&]q=([^&#]+)', 1)) ELSE x END"
_OWN = f"list_filter(list_transform(coalesce(links, []), lambda x: {_UNWRAP}), lambda y: starts_with(y, 'http') AND NOT {D.is_aggregator(D.host('y'))} AND NOT regexp_matches({D.host('y')}, 'google\\.|gstatic\\.com|googleusercontent\\.com|^g\\.page$|\\.google$'))"


@query(
    f"""WITH {_LINKED} SELECT record_no, CASE WHEN record_no % 3 = 0 THEN trim(regexp_extract(tels[2], '^tel:([^?#]+)', 1)) ELSE nullif(trim(regexp_replace(regexp_extract(labels[2], '(?i)(?:phone|call|mobile)[:\\s]+([+\\d][\\d\\s().-]{{7,}})', 1), '\\s+', ' ', 'g')), '') END AS phone,
    {_OWN}[1] AS website FROM sig"""
)
def place_details(spark: SparkSession, d: str) -> DataFrame:
    """Phone and website of every listing, from tel links, labels and wrapped links composed of its own values."""
    from leadloom.functions import urls

    m = table(spark, d, "maps_listing").select("record_no", "phone", "website").distinct()
    k, none = F.col("record_no"), F.array().cast("array<string>")
    tels = F.when(F.col("phone").isNotNull() & (k % 3 == 0), F.array(F.lit("tel:"), F.concat(F.lit("tel:"), "phone", F.lit("?x=1")))).otherwise(none)
    labels = F.when(F.col("phone").isNotNull(), F.array(F.lit("Open now"), F.concat(F.lit("Phone: "), "phone"))).otherwise(none)
    wrapped = F.array(F.lit("https://www.facebook.com/x"), F.concat(F.lit("https://www.google.com/url?q="), F.url_encode("website"), F.lit("&sa=U")))
    links = F.when(F.col("website").isNotNull(), F.when(k % 2 == 0, wrapped).otherwise(F.array(F.lit("https://maps.google.com/y"), "website")))
    return m.select("record_no", urls.place_details(tels, labels, none, links).alias("p")).select("record_no", "p.phone", "p.website")


_ID = "coalesce(nullif(place_id, ''), CASE WHEN regexp_extract(href, '(ChIJ[a-zA-Z0-9_-]+)', 1) <> '' THEN regexp_extract(href, '(ChIJ[a-zA-Z0-9_-]+)', 1) ELSE split_part(href, '?', 1) END)"


@query(
    f"""WITH m AS (SELECT DISTINCT name, href, place_id, address_hint, category_hint, phone, website, query_text FROM maps_listing WHERE length(trim(name)) >= 2),
    r AS (SELECT 'maps:' || {_ID} AS external_id, trim(name) AS name, nullif(category_hint, '') AS subcategory, phone, website, nullif(address_hint, '') AS line1, CASE WHEN starts_with(href, 'http') THEN href WHEN starts_with(href, '/') THEN 'https://www.google.com' || href ELSE 'https://www.google.com/' || href END AS source_url, query_text FROM m),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_text, source_url ORDER BY external_id NULLS FIRST, name NULLS FIRST, subcategory NULLS FIRST, phone NULLS FIRST, website NULLS FIRST, line1 NULLS FIRST) AS k FROM r) SELECT * EXCLUDE (k) FROM n WHERE k = 1"""
)
def listing_candidates(spark: SparkSession, d: str) -> DataFrame:
    """All captured listings as candidates."""
    m = table(spark, d, "maps_listing").select("name", "href", "place_id", "address_hint", "category_hint", "phone", "website", "query_text").distinct()
    return candidates.listing_candidates(m)


@query("SELECT DISTINCT query_text, 'https://www.google.com/maps/search/' || url_encode(query_text) AS url FROM maps_listing WHERE query_text IS NOT NULL")
def search_urls(spark: SparkSession, d: str) -> DataFrame:
    from leadloom.functions import urls

    return table(spark, d, "maps_listing").filter("query_text is not null").select("query_text", urls.search_url(F.col("query_text")).alias("url")).distinct()


_HOSTS = "CASE record_no % 6 WHEN 0 THEN 'http://localhost/a' WHEN 1 THEN 'http://10.' || (record_no % 200) || '.0.1/' WHEN 2 THEN 'http://169.254.169.254/latest' WHEN 3 THEN website WHEN 4 THEN 'https://172.' || (record_no % 40) || '.1.1' ELSE 'shop.localhost' END"


@query(
    f"""WITH l AS (SELECT DISTINCT record_no, {_HOSTS} AS u FROM (SELECT DISTINCT record_no, website FROM lead_row)) SELECT record_no, coalesce(CASE record_no % 6 WHEN 3 THEN {D.url_key('u')} IS NOT NULL WHEN 4 THEN record_no % 40 NOT BETWEEN 16 AND 31 ELSE false END, false) AS safe FROM l"""
)
def safe_urls(spark: SparkSession, d: str) -> DataFrame:
    """Which of the leads' websites and of made-up inner addresses may be fetched."""
    from leadloom.functions import urls

    l = table(spark, d, "lead_row").select("record_no", "website").distinct().withColumn("u", F.expr(
        "CASE record_no % 6 WHEN 0 THEN 'http://localhost/a' WHEN 1 THEN concat('http://10.', record_no % 200, '.0.1/') WHEN 2 THEN 'http://169.254.169.254/latest' WHEN 3 THEN website WHEN 4 THEN concat('https://172.', record_no % 40, '.1.1') ELSE 'shop.localhost' END"))
    return l.select("record_no", urls.is_safe_url(F.col("u")).alias("safe"))


@query(
    f"""WITH s AS (SELECT DISTINCT {D.url_key('url')} AS st FROM (SELECT 'https://' || site_domain AS url FROM crawl_page WHERE site_domain IS NOT NULL)), o AS (SELECT st, {D.domain('st')} AS domain, regexp_extract(st, '^(https?://[^/?#]+)', 1) AS origin FROM s WHERE st IS NOT NULL),
    sm AS (SELECT site_domain AS id, url AS loc, row_number() OVER (PARTITION BY site_domain ORDER BY page_no) AS place FROM (SELECT DISTINCT page_no, site_domain, url FROM crawl_page WHERE site_domain IS NOT NULL)),
    e AS (SELECT st AS url, 0 AS seq FROM o UNION ALL SELECT origin || p, i FROM o, (VALUES {', '.join(f"({i + 1}, {D.q(p)})" for i, p in enumerate(K.PRIORITY_PATHS))}) AS v(i, p)
      UNION ALL SELECT loc, place + 100 FROM sm JOIN o ON o.domain = sm.id WHERE place <= 20 AND {D.domain('loc')} = o.domain UNION ALL SELECT final_url, 1000 FROM crawl_page JOIN (SELECT DISTINCT domain FROM o) q ON q.domain = {D.domain('final_url')}),
    u AS (SELECT {_URL} AS url, min(seq) AS seq FROM e GROUP BY 1), k AS (SELECT {D.domain('url')} AS domain, url, {D.path_priority('url')} AS priority, seq FROM u WHERE url IS NOT NULL),
    r AS (SELECT domain, url, priority, row_number() OVER (PARTITION BY domain ORDER BY priority, seq, url) AS place FROM k) SELECT * FROM r WHERE place <= {K.MAX_PAGES}"""
)
def crawl_plan(spark: SparkSession, d: str) -> DataFrame:
    """Start page, priority paths, sitemap locations and known links of every captured site, the first to fetch."""
    c = table(spark, d, "crawl_page").filter("site_domain is not null").select("page_no", "site_domain", "url").distinct()
    sites = c.select(F.concat(F.lit("https://"), "site_domain").alias("url")).distinct()
    body = c.groupBy(F.col("site_domain").alias("id")).agg(F.sort_array(F.collect_list(F.struct("page_no", "url"))).alias("u"))
    body = body.select("id", F.array_join(F.transform("u", lambda x: F.concat(F.lit("<url><loc> "), x["url"], F.lit(" </loc></url>"))), "\n").alias("body"))
    links = table(spark, d, "crawl_page").filter("final_url is not null").select(F.col("final_url").alias("url"))
    return pages.crawl_plan(sites, pages.sitemap_locations(body), links)
