"""Queries of entity resolution and website verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom import constants as K
from leadloom.functions import text, urls
from leadloom.operators import graph, pairs, resolve, verify
from leadloom.session import table

from . import duck as D
from .registry import query

_ADDR = D.address_key("address.line1", "address.locality", "address.city", "address.postal_code", "address.country")
SIGNALS = f"""s AS (SELECT DISTINCT lower(id) AS id, {D.name_key('name')} AS name, {D.phone_key('phone')} AS phone, {D.domain('website')} AS domain, CASE WHEN address IS NOT NULL THEN {_ADDR} END AS addr FROM entity_record)"""
PAIRS = "p AS (SELECT DISTINCT lower(trim(left_id)) AS left_id, lower(trim(right_id)) AS right_id FROM match_result WHERE left_id IS NOT NULL AND right_id IS NOT NULL)"


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entity_record").select(F.lower("id").alias("id"), "name", "phone", "website", "address")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "match_result").filter("left_id is not null and right_id is not null")
    return m.select(F.lower(F.trim("left_id")).alias("left_id"), F.lower(F.trim("right_id")).alias("right_id")).distinct()


@query(
    f"""WITH {SIGNALS}, {PAIRS}, j AS (SELECT left_id, right_id, a.domain = b.domain AS dom, a.phone = b.phone AS ph, {D.similarity('a.name', 'b.name')} AS nm, {D.similarity('a.addr', 'b.addr')} AS ad,
      a.domain IS NOT NULL AND b.domain IS NOT NULL AS hd, a.phone IS NOT NULL AND b.phone IS NOT NULL AS hp, a.addr IS NOT NULL AND b.addr IS NOT NULL AS ha FROM p JOIN s a ON a.id = left_id JOIN s b ON b.id = right_id),
    t AS (SELECT left_id, right_id, dom, ph, ((CASE WHEN dom THEN 0.35::DOUBLE ELSE 0 END) + (CASE WHEN ph THEN 0.3::DOUBLE ELSE 0 END) + 0.25::DOUBLE * nm + (CASE WHEN ha THEN 0.1::DOUBLE * ad ELSE 0 END))
      / ((CASE WHEN hd THEN 0.35::DOUBLE ELSE 0 END) + (CASE WHEN hp THEN 0.3::DOUBLE ELSE 0 END) + 0.25::DOUBLE + (CASE WHEN ha THEN 0.1::DOUBLE ELSE 0 END)) AS score, nm, ha AND ad >= 0.9 AS adr FROM j)
    SELECT left_id, right_id, round(score, 9) AS score, concat_ws(',', CASE WHEN dom THEN 'exact_domain' END, CASE WHEN ph THEN 'exact_phone' END, CASE WHEN nm >= 0.9 THEN 'strong_name' WHEN nm >= 0.75 THEN 'fuzzy_name' END, CASE WHEN adr THEN 'address' END) AS reasons,
      score >= {K.MATCH_THRESHOLD} OR coalesce(dom, false) OR coalesce(ph, false) AS duplicate FROM t"""
)
def pair_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score, reasons and verdict of every recorded pair."""
    r = resolve.score_pairs(_pairs(spark, d), _records(spark, d))
    return r.select("left_id", "right_id", F.round("score", 9).alias("score"), F.array_join("reasons", ",").alias("reasons"), "duplicate")


@query(
    f"""WITH RECURSIVE {SIGNALS}, k AS (SELECT DISTINCT id, 'p:' || phone AS k FROM s WHERE phone IS NOT NULL UNION SELECT DISTINCT id, 'd:' || domain FROM s WHERE domain IS NOT NULL),
    h AS (SELECT k, min(id) AS head, count(*) AS n FROM k GROUP BY k), e AS (SELECT DISTINCT head AS a, id AS b FROM k JOIN h USING (k)), two AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    reach(n, m) AS (SELECT id, id FROM s UNION SELECT reach.n, two.b FROM reach JOIN two ON reach.m = two.a), g AS (SELECT n AS id, min(m) AS group_id FROM reach GROUP BY n),
    c AS (SELECT id, sum(n - 1) AS links FROM k JOIN h USING (k) GROUP BY id) SELECT id, group_id, coalesce(links, 0)::BIGINT AS links FROM g LEFT JOIN c USING (id)"""
)
def duplicate_classes(spark: SparkSession, d: str) -> DataFrame:
    """Records grouped by equal phone or domain, direct or indirect, each with its number of links."""
    return resolve.exact_classes(_records(spark, d))


@query(
    f"""WITH RECURSIVE {PAIRS}, e AS (SELECT left_id AS a, right_id AS b FROM p WHERE left_id <> right_id UNION SELECT right_id, left_id FROM p WHERE left_id <> right_id),
    reach(n, m) AS (SELECT a, a FROM e UNION SELECT reach.n, e.b FROM reach JOIN e ON reach.m = e.a), g AS (SELECT n AS id, min(m) AS group_id FROM reach GROUP BY n),
    t AS (SELECT lower(id) AS id, min(observed_at) AS seen_at FROM entity_record GROUP BY 1), r AS (SELECT g.id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY seen_at NULLS LAST, g.id) AS n FROM g LEFT JOIN t USING (id))
    SELECT r.id, f.id AS survivor FROM r JOIN r f ON f.group_id = r.group_id AND f.n = 1"""
)
def merge_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The earliest observed record of every group of recorded pairs."""
    g = graph.connected(_pairs(spark, d), "left_id", "right_id").withColumnRenamed("node", "id")
    seen = table(spark, d, "entity_record").select(F.lower("id").alias("id"), F.col("observed_at").alias("at"))
    return resolve.survivors(g, seen)


_MAP = """m AS (SELECT lower(id) AS id, first_value(lower(id)) OVER (PARTITION BY lower(name) ORDER BY observed_at, lower(id)) AS survivor FROM (SELECT DISTINCT id, name, observed_at FROM entity_record))"""


@query(
    f"""WITH {_MAP}, c AS (SELECT DISTINCT lower(id) AS owner, {D.domain('website')} AS domain FROM entity_record WHERE website IS NOT NULL)
    SELECT DISTINCT coalesce(survivor, owner) AS owner, domain FROM c LEFT JOIN m ON m.id = c.owner"""
)
def merged_websites(spark: SparkSession, d: str) -> DataFrame:
    """Websites of merged records moved to the survivor, one row per survivor and domain; records of one name are merged here."""
    e = table(spark, d, "entity_record").select(F.lower("id").alias("id"), F.lower("name").alias("group_id"), F.col("observed_at").alias("at")).distinct()
    mapping = resolve.survivors(e.select("id", "group_id"), e.select("id", "at"))
    sites = table(spark, d, "entity_record").filter("website is not null").select(F.lower("id").alias("owner"), urls.domain(F.col("website")).alias("domain")).distinct()
    return resolve.repoint(sites, "owner", mapping, ["domain"])


@query(
    f"""WITH k AS (SELECT DISTINCT record_no AS id, {D.domain('website')} AS domain, {D.phone_key('phone')} AS phone FROM entity_record),
    c AS (SELECT DISTINCT record_no AS cid, {D.domain('website')} AS domain, {D.phone_key('phone')} AS phone FROM maps_listing)
    SELECT cid, coalesce(a.id, b.id) AS id FROM c LEFT JOIN (SELECT domain, min(id) AS id FROM k WHERE domain IS NOT NULL GROUP BY 1) a USING (domain) LEFT JOIN (SELECT phone, min(id) AS id FROM k WHERE phone IS NOT NULL GROUP BY 1) b ON b.phone = c.phone"""
)
def listing_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Listings attached to the known record of an equal domain, else phone."""
    sig = lambda t, n: table(spark, d, t).select(F.col("record_no").alias(n), urls.domain(F.col("website")).alias("domain"), text.phone_key(F.col("phone")).alias("phone")).distinct()
    return resolve.attach_or_create(sig("maps_listing", "cid"), sig("entity_record", "id")).select("cid", "id")


_W = f"list_filter(string_split({D.token_key('business_name')}, ' '), lambda w: length(w) > 2)"


@query(
    f"""WITH p AS (SELECT site_domain, arg_min(title, page_no) AS title, min(page_no) AS k FROM (SELECT DISTINCT page_no, site_domain, coalesce(title, '') AS title FROM crawl_page WHERE extracted_text IS NOT NULL) GROUP BY 1),
    x AS (SELECT p.*, extracted_text AS page_text FROM p JOIN (SELECT DISTINCT page_no, extracted_text FROM crawl_page) c ON c.page_no = p.k),
    l AS (SELECT DISTINCT record_no, business_name, website, primary_phone, city FROM lead_row WHERE website IS NOT NULL),
    j AS (SELECT l.*, {D.domain('website')} AS dom, {_W} AS words, lower(coalesce(title, '') || ' ' || coalesce(page_text, '')) AS hay, regexp_replace(primary_phone, '[^0-9]', '', 'g') AS dg FROM l LEFT JOIN x ON x.site_domain = {D.domain('website')}),
    f AS (SELECT *, ends_with(dom, '.example.com') OR (length(array_to_string(words, '')) >= 4 AND contains(regexp_replace(dom, '[^a-z0-9]', '', 'g'), array_to_string(words, ''))) OR len(list_filter(words, lambda w: length(w) >= 4 AND contains(regexp_replace(dom, '[^a-z0-9]', '', 'g'), w))) > 0 AS aff,
      CASE WHEN len(words) > 0 THEN len(list_filter(words, lambda w: contains(hay, w))) / len(words)::DOUBLE ELSE 0 END AS ratio, coalesce(right(dg, 8) <> '' AND contains(regexp_replace(hay, '[^0-9]', '', 'g'), right(dg, 8)), false) AS ph, coalesce(city <> '' AND contains(hay, lower(city)), false) AS ct FROM j),
    s AS (SELECT record_no, CASE WHEN dom IS NULL THEN 0 ELSE least(1.0, (CASE WHEN aff THEN 0.25::DOUBLE ELSE 0 END) + 0.4::DOUBLE * ratio + (CASE WHEN ph THEN 0.25::DOUBLE ELSE 0 END) + (CASE WHEN ct THEN 0.1::DOUBLE ELSE 0 END)) END AS c, * FROM f)
    SELECT record_no, round(c, 9) AS confidence, CASE WHEN c >= 0.85 THEN 'VERIFIED' WHEN c >= 0.65 THEN 'LIKELY' WHEN c >= 0.35 THEN 'UNCERTAIN' ELSE 'INVALID' END AS status,
      CASE WHEN dom IS NULL THEN 'invalid_url' ELSE concat_ws(',', CASE WHEN aff THEN 'domain_name_affinity' END, CASE WHEN ratio >= 0.5 THEN 'name_on_page' END, CASE WHEN ph THEN 'phone_on_page' END, CASE WHEN ct THEN 'city_on_page' END) END AS reasons FROM s"""
)
def verify_website(spark: SparkSession, d: str) -> DataFrame:
    """Leads' websites judged by the first captured page of their domain."""
    pages = table(spark, d, "crawl_page").filter("extracted_text is not null").select("page_no", "site_domain", F.coalesce("title", F.lit("")).alias("title"), F.col("extracted_text").alias("page_text")).distinct()
    first = pages.groupBy("site_domain").agg(F.min("page_no").alias("k"))
    home = first.join(pages.select("page_no", "title", "page_text"), F.col("k") == F.col("page_no")).select(F.col("site_domain").alias("dom"), "title", "page_text")
    leads = table(spark, d, "lead_row").filter("website is not null").select("record_no", F.col("business_name").alias("name"), "website", F.col("primary_phone").alias("phone"), "city").distinct()
    rows = leads.withColumn("dom", urls.domain(F.col("website"))).join(home, "dom", "left")
    v = verify.verify_websites(rows)
    return v.select("record_no", F.round("confidence", 9).alias("confidence"), "status", F.array_join("reasons", ",").alias("reasons"))


_T = D.squeeze(D.sub(D.sub("h", "(?is)<script.*?</script>", " "), "<[^>]+>", " "))


@query(
    f"""SELECT page_no, coalesce(status_code BETWEEN 200 AND 399, false) AS reachable, coalesce(status_code BETWEEN 200 AND 399, false) AND ((n < 80 AND length(h) > 200) OR ({D.has('h', K.SHELL_MARKS)} AND n < 400) OR ({D.has('h', K.SCRIPT_MARKS)} AND n < 300)) AS shell,
      CASE WHEN trim(regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1)) <> '' THEN trim(regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1)) END AS title
    FROM (SELECT *, length({_T}) AS n FROM (SELECT DISTINCT page_no, status_code, coalesce(html_snippet, '') AS h FROM crawl_page))"""
)
def js_shell(spark: SparkSession, d: str) -> DataFrame:
    """Reachability, script shells and titles of all captured pages."""
    p = table(spark, d, "crawl_page").select("page_no", "status_code", F.coalesce("html_snippet", F.lit("")).alias("h")).distinct()
    h, s = F.col("h"), F.col("status_code")
    return p.select("page_no", verify.reachable(s).alias("reachable"), verify.needs_browser(h, s).alias("shell"), F.nullif(text.page_title(h), F.lit("")).alias("title"))


_PAIR = f"""a.domain = b.domain AS dom, a.phone = b.phone AS ph, {D.similarity('a.name', 'b.name')} AS nm, {D.similarity('a.addr', 'b.addr')} AS ad,
      a.domain IS NOT NULL AND b.domain IS NOT NULL AS hd, a.phone IS NOT NULL AND b.phone IS NOT NULL AS hp, a.addr IS NOT NULL AND b.addr IS NOT NULL AS ha"""
_SCORE = """((CASE WHEN dom THEN 0.35::DOUBLE ELSE 0 END) + (CASE WHEN ph THEN 0.3::DOUBLE ELSE 0 END) + 0.25::DOUBLE * nm + (CASE WHEN ha THEN 0.1::DOUBLE * ad ELSE 0 END))
      / ((CASE WHEN hd THEN 0.35::DOUBLE ELSE 0 END) + (CASE WHEN hp THEN 0.3::DOUBLE ELSE 0 END) + 0.25::DOUBLE + (CASE WHEN ha THEN 0.1::DOUBLE ELSE 0 END))"""
# every pair of distinct signals is compared here, which the operator never does
FUZZY = f"""WITH {SIGNALS}, rep AS (SELECT name, phone, domain, addr, min(id) AS id FROM s WHERE name <> '' GROUP BY ALL),
    c AS (SELECT a.id AS left_id, b.id AS right_id, {_PAIR} FROM rep a JOIN rep b ON a.id < b.id AND coalesce(a.domain <> b.domain, true) AND coalesce(a.phone <> b.phone, true) AND NOT coalesce(a.domain = b.domain, false) AND NOT coalesce(a.phone = b.phone, false)),
    fz AS (SELECT left_id, right_id, {_SCORE} AS score FROM c WHERE {_SCORE} >= {K.MATCH_THRESHOLD})"""


def _fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return pairs.fuzzy_pairs(resolve.signals(_records(spark, d)))


@query(f"{FUZZY} SELECT left_id, right_id, round(score, 9) AS score FROM fz")
def duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of distinct records that score the threshold without an equal phone or domain, best first."""
    return _fuzzy(spark, d).select("left_id", "right_id", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "left_id", "right_id")


@query(f"WITH {SIGNALS} SELECT id, min(id) OVER (PARTITION BY name, phone, domain, addr) AS representative FROM s")
def duplicate_members(spark: SparkSession, d: str) -> DataFrame:
    """The record that stands for each record's equal signals in duplicate_pairs."""
    return pairs.membership(resolve.signals(_records(spark, d)))


@query(
    """WITH b AS (SELECT DISTINCT lead_id AS id, business_name AS name FROM lead_row), p AS (SELECT lead_id AS id, arg_min(contact_value, (row_no, contact_value)) AS phone FROM contact_row WHERE contact_type = 'PHONE' AND contact_value IS NOT NULL GROUP BY 1),
    w AS (SELECT lead_id AS id, arg_min(website, (record_no, website)) AS website FROM lead_row WHERE website IS NOT NULL GROUP BY 1) SELECT id, name, phone, website FROM b LEFT JOIN p USING (id) LEFT JOIN w USING (id)"""
)
def resolution_input(spark: SparkSession, d: str) -> DataFrame:
    """Leads with their first website and first phone."""
    l, c = table(spark, d, "lead_row"), table(spark, d, "contact_row")
    b = l.select(F.col("lead_id").alias("id"), F.col("business_name").alias("name"), F.lit(None).cast("string").alias("address")).distinct()
    sites = l.select(F.col("lead_id").alias("id"), F.col("record_no").alias("seq"), "website")
    phones = c.filter("contact_type = 'PHONE'").select(F.col("lead_id").alias("id"), F.col("row_no").alias("seq"), F.col("contact_value").alias("phone"))
    return pairs.first_signals(b, sites, phones).drop("address")


_LEADMAP = "lm AS (SELECT DISTINCT lead_id AS id, min(lead_id) OVER (PARTITION BY lower(business_name), coalesce(city, '')) AS survivor FROM lead_row)"


def _lead_map(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lead_row").select("lead_id", F.lower("business_name").alias("name"), F.coalesce("city", F.lit("")).alias("city")).distinct()
    least = l.groupBy("name", "city").agg(F.min("lead_id").alias("survivor"))
    return l.join(least, ["name", "city"]).groupBy(F.col("lead_id").alias("id")).agg(F.min("survivor").alias("survivor"))


@query(
    f"""WITH {_LEADMAP}, m AS (SELECT id, min(survivor) AS survivor FROM lm GROUP BY 1), c AS (SELECT DISTINCT 'contacts' AS kind, lead_id AS owner, row_no::VARCHAR AS item FROM contact_row UNION ALL SELECT DISTINCT 'scores', lead_id, score_no::VARCHAR FROM scoring_result
      UNION ALL SELECT DISTINCT 'sources', lead_id, record_no::VARCHAR FROM lead_row UNION ALL SELECT DISTINCT 'aliases', lead_id, business_name FROM lead_row), w AS (SELECT DISTINCT lead_id AS owner, {D.domain('website')} AS domain FROM lead_row WHERE website IS NOT NULL)
    SELECT kind, coalesce(survivor, owner) AS owner, item FROM c LEFT JOIN m ON m.id = c.owner UNION ALL SELECT DISTINCT 'websites', coalesce(survivor, owner), domain FROM w LEFT JOIN m ON m.id = w.owner"""
)
def merged_children(spark: SparkSession, d: str) -> DataFrame:
    """Contacts, scores, sources, aliases and websites of merged leads at their survivors; leads of one name and city are merged here."""
    l = table(spark, d, "lead_row")
    child = lambda t, c: table(spark, d, t).select(F.col("lead_id").alias("owner"), F.col(c).cast("string").alias("item")).distinct()
    parts = {"contacts": child("contact_row", "row_no"), "scores": child("scoring_result", "score_no"), "sources": child("lead_row", "record_no"), "aliases": child("lead_row", "business_name"),
             "websites": l.filter("website is not null").select(F.col("lead_id").alias("owner"), urls.domain(F.col("website")).alias("domain")).distinct()}
    merged = pairs.merge_children(parts, _lead_map(spark, d))
    rows = [df.select(F.lit(k).alias("kind"), "owner", F.col("domain" if k == "websites" else "item").alias("item")) for k, df in merged.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query(f"WITH {_LEADMAP}, m AS (SELECT id, min(survivor) AS survivor FROM lm GROUP BY 1), x AS (SELECT DISTINCT city AS job, coalesce(survivor, lead_id) AS id FROM lead_row LEFT JOIN m ON m.id = lead_id WHERE city IS NOT NULL) SELECT job, string_agg(id, ',' ORDER BY id) AS ids FROM x GROUP BY 1")
def merged_job_ids(spark: SparkSession, d: str) -> DataFrame:
    """Each city's list of leads with merged leads replaced by their survivors."""
    jobs = table(spark, d, "lead_row").filter("city is not null").groupBy(F.col("city").alias("job")).agg(F.collect_set("lead_id").alias("ids"))
    return pairs.merge_ids(jobs, _lead_map(spark, d)).select("job", F.array_join("ids", ",").alias("ids"))
