"""Queries of contact extraction, primaries and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom import constants as K
from leadloom.operators import contacts
from leadloom.session import table

from . import duck as D
from .q_sources import PAGE_ROWS, made_pages
from .registry import query

_LOCAL, _DOM = "split_part(value, '@', 1)", "split_part(value, '@', 2)"
NOISE = f"(length({_LOCAL}) > 64 OR {D.has(_LOCAL, K.NOISE_LOCAL)} OR {D.has(_DOM, K.NOISE_DOMAIN)})"


@query(
    f"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, {D.q(K.EMAIL_IN_TEXT)})) AS raw FROM {D.once('documents', 'doc_id', 'text')}),
    p AS (SELECT doc_id, unnest(regexp_extract_all(text, {D.q(K.PHONE_IN_TEXT)})) AS raw FROM {D.once('documents', 'doc_id', 'text')}),
    v AS (SELECT doc_id, 'EMAIL' AS kind, {D.email_key('raw')} AS value FROM m UNION SELECT doc_id, 'PHONE', {D.phone_key('raw')} FROM p)
    SELECT doc_id, kind, value FROM v WHERE value IS NOT NULL AND NOT (kind = 'EMAIL' AND {NOISE})"""
)
def contacts_text(spark: SparkSession, d: str) -> DataFrame:
    """Mail addresses and phone numbers in the running text of all documents."""
    from leadloom.functions import text

    docs = table(spark, d, "documents").select("doc_id", "text").distinct()
    hits = F.concat(
        F.transform(F.regexp_extract_all("text", F.lit(f"({K.EMAIL_IN_TEXT})"), F.lit(1)), lambda m: F.struct(F.lit("EMAIL").alias("kind"), m.alias("raw"))),
        F.transform(F.regexp_extract_all("text", F.lit(f"({K.PHONE_IN_TEXT})"), F.lit(1)), lambda m: F.struct(F.lit("PHONE").alias("kind"), m.alias("raw"))),
    )
    rows = docs.select("doc_id", F.explode(hits).alias("h")).select("doc_id", "h.kind", F.when(F.col("h.kind") == "EMAIL", text.email_key(F.col("h.raw"))).otherwise(text.phone_key(F.col("h.raw"))).alias("value"))
    return rows.filter(F.col("value").isNotNull() & ~((F.col("kind") == "EMAIL") & contacts.is_noise_email(F.col("value")))).distinct()


_H = lambda scheme: D.q(r"""(?i)<a\s[^>]*?href=["'](""" + scheme + r"""[^"']*)["']""")
_CONTACT = f"regexp_matches({D.path('url')}, '{K.CONTACT_PATH}')"
_BODY = D.visible_text("regexp_extract(html, '(?is)<body[^>]*>(.*)$', 1)")
_EXTRACT = f"""pp AS (SELECT business_id * 10 + seq AS page_id, url, html, {_CONTACT} AS cp, regexp_extract(html, '(?is)<footer.*$', 0) AS foot, {_BODY} AS body FROM page),
  raw AS (
    SELECT page_id, url, cp, 'EMAIL' AS kind, 'MAILTO' AS method, unnest(regexp_extract_all(html, {_H('mailto:')}, 1)) AS raw, 1 AS seq, foot FROM pp
    UNION ALL SELECT page_id, url, cp, 'PHONE', 'TEL', unnest(regexp_extract_all(html, {_H('tel:')}, 1)), 2, foot FROM pp
    UNION ALL SELECT page_id, url, cp, 'WHATSAPP', 'WHATSAPP_LINK', unnest(list_filter(regexp_extract_all(html, {_H('')}, 1), lambda h: regexp_matches(h, 'wa\\.me|api\\.whatsapp\\.com|whatsapp'))), 3, foot FROM pp
    UNION ALL SELECT page_id, url, cp, 'CONTACT_FORM', 'CONTACT_FORM', regexp_extract(url, '^https?://[^/]+') || lower(unnest(regexp_extract_all(html, '(?is)<form[^>]*?action="([^"]*)"', 1))), 4, foot FROM pp
    UNION ALL SELECT page_id, url, true, 'EMAIL', 'SCHEMA_ORG', json_extract_string(regexp_extract(html, '(?is)<script type="application/ld\\+json">(.*?)</script>', 1), '$.email'), 5, foot FROM pp WHERE contains(html, 'ld+json')
    UNION ALL SELECT page_id, url, true, 'PHONE', 'SCHEMA_ORG', json_extract_string(regexp_extract(html, '(?is)<script type="application/ld\\+json">(.*?)</script>', 1), '$.telephone'), 6, foot FROM pp WHERE contains(html, 'ld+json')
    UNION ALL SELECT page_id, url, cp, 'EMAIL', 'TEXT', unnest(regexp_extract_all(body, {D.q(K.EMAIL_IN_TEXT)})), 7, foot FROM pp
    UNION ALL SELECT page_id, url, cp, 'PHONE', 'TEXT', unnest(regexp_extract_all(body, {D.q(K.PHONE_IN_TEXT)})), 8, foot FROM pp),
  val AS (SELECT *, CASE kind WHEN 'EMAIL' THEN {D.email_key('raw')} WHEN 'CONTACT_FORM' THEN raw WHEN 'WHATSAPP' THEN {D.phone_key("CASE WHEN regexp_matches(raw, '(?i)(wa\\.me/|phone=)\\+?\\d+') THEN regexp_extract(raw, '(?i)(?:wa\\.me/|phone=)(\\+?\\d+)', 1) ELSE raw END")} ELSE {D.phone_key('raw')} END AS value FROM raw),
  sc AS (SELECT *, CASE kind
      WHEN 'EMAIL' THEN least(1.0, (CASE WHEN method = 'MAILTO' THEN 0.25::DOUBLE ELSE 0 END) + (CASE WHEN method = 'SCHEMA_ORG' THEN 0.2::DOUBLE ELSE 0 END) + (CASE WHEN cp THEN 0.2::DOUBLE ELSE 0 END) + (CASE WHEN ends_with({_DOM}, {D.domain('url')}) THEN 0.2::DOUBLE ELSE 0 END)
        + (CASE WHEN method = 'MAILTO' AND contains(foot, raw) THEN 0.1::DOUBLE ELSE 0 END) + 0.1::DOUBLE + (CASE WHEN {D.has('value', K.BUSINESS_WORDS)} THEN 0.05::DOUBLE ELSE 0 END))
      WHEN 'PHONE' THEN least(1.0, (CASE WHEN method = 'TEL' THEN 0.25::DOUBLE ELSE 0 END) + (CASE WHEN cp THEN 0.2::DOUBLE ELSE 0 END) + (CASE WHEN method = 'SCHEMA_ORG' THEN 0.2::DOUBLE ELSE 0 END) + (CASE WHEN length(value) >= 11 THEN 0.2::DOUBLE ELSE 0 END))
      WHEN 'WHATSAPP' THEN CASE WHEN cp THEN 0.9 ELSE 0.75 END ELSE CASE WHEN cp THEN 0.8 ELSE 0.6 END END AS confidence FROM val WHERE value IS NOT NULL AND NOT (kind = 'EMAIL' AND {NOISE})),
  best AS (SELECT *, row_number() OVER (PARTITION BY page_id, kind, value ORDER BY confidence DESC, seq) AS n FROM sc)"""
EXTRACTED = f"{PAGE_ROWS}, {_EXTRACT}"
_CAPTURED = "WITH page AS (SELECT DISTINCT page_no AS business_id, 0 AS seq, coalesce(final_url, url) AS url, html_snippet AS html FROM crawl_page WHERE html_snippet IS NOT NULL)"
_STATUS = "CASE WHEN kind IN ('WHATSAPP', 'CONTACT_FORM') THEN 'LIKELY' WHEN confidence >= 0.85 THEN 'CONFIRMED' WHEN confidence >= 0.7 THEN 'LIKELY' ELSE 'UNVERIFIED' END"


@query(f"{EXTRACTED} SELECT page_id, url, kind, value, method, round(confidence, 9) AS confidence, {_STATUS} AS status FROM best WHERE n = 1")
def contacts_pages(spark: SparkSession, d: str) -> DataFrame:
    """Contacts of all made pages by every method, the best per page, kind and value."""
    p = made_pages(spark, d).select((F.col("business_id") * 10 + F.col("seq")).alias("page_id"), "url", "html")
    return contacts.extract_contacts(p).withColumn("confidence", F.round("confidence", 9))


@query(
    f"""{EXTRACTED}, one AS (SELECT page_id // 10 AS business_id, kind, value, confidence, {_STATUS} AS status, page_id FROM best WHERE n = 1), r AS (SELECT *, row_number() OVER (PARTITION BY business_id, kind ORDER BY confidence DESC, value, page_id) AS k FROM one
      WHERE kind IN ('PHONE', 'EMAIL', 'WHATSAPP') AND confidence >= {K.PRIMARY_FLOOR}) SELECT business_id, kind, value, round(confidence, 9) AS confidence FROM r WHERE k = 1"""
)
def contact_primaries(spark: SparkSession, d: str) -> DataFrame:
    """The best phone, mail and chat contact of every business."""
    p = made_pages(spark, d).select((F.col("business_id") * 10 + F.col("seq")).alias("page_id"), "url", "html")
    c = contacts.extract_contacts(p).withColumn("business_id", F.floor(F.col("page_id") / 10)).withColumn("seq", F.struct("value", "page_id"))
    return contacts.primary_contacts(c, "business_id", "seq").select("business_id", "kind", "value", F.round("confidence", 9).alias("confidence"))


@query(
    f"""WITH c AS (SELECT DISTINCT contact_no, page_no, contact_type, contact_value, confidence FROM extracted_contact), r AS (SELECT *, row_number() OVER (PARTITION BY contact_type, contact_value ORDER BY CASE WHEN isnan(confidence) THEN NULL ELSE confidence END DESC NULLS LAST, contact_no, page_no) AS k FROM c)
    SELECT contact_type, contact_value, contact_no, confidence FROM r WHERE k = 1"""
)
def contact_best(spark: SparkSession, d: str) -> DataFrame:
    """Every extracted contact once, from its row of the highest confidence."""
    c = table(spark, d, "extracted_contact").select("contact_no", "page_no", "contact_type", "contact_value", "confidence").distinct()
    c = c.withColumn("score", F.when(~F.isnan("confidence"), F.col("confidence"))).withColumn("seq", F.struct("contact_no", "page_no"))
    return contacts.best_rows(c, ["contact_type", "contact_value"], "score", "seq").select("contact_type", "contact_value", "contact_no", "confidence")


@query(
    """WITH a AS (SELECT DISTINCT lead_id, contact_type, lower(contact_value) AS v, row_no, verified_at FROM contact_row), r AS (SELECT *, row_number() OVER (PARTITION BY lead_id, contact_type, v ORDER BY verified_at DESC NULLS LAST, row_no % 2 DESC, row_no) AS k FROM a)
    SELECT lead_id, contact_type, v, row_no FROM r WHERE k = 1"""
)
def contact_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Odd rows written over even rows: the latest verified row per lead, type and value stays."""
    c = table(spark, d, "contact_row").select("lead_id", "contact_type", F.lower("contact_value").alias("v"), "row_no", "verified_at").distinct()
    keys = ["lead_id", "contact_type", "v"]
    half = lambda n: contacts.best_rows(c.filter(F.col("row_no") % 2 == n), keys, "verified_at", "row_no")
    return contacts.upsert(half(0), half(1), keys, "verified_at").select(*keys, "row_no")


@query(f"{_CAPTURED}, {_EXTRACT} SELECT page_id, url, kind, value, method, round(confidence, 9) AS confidence, {_STATUS} AS status FROM best WHERE n = 1")
def captured_contacts(spark: SparkSession, d: str) -> DataFrame:
    """Contacts in the source of all captured pages."""
    c = table(spark, d, "crawl_page").filter("html_snippet is not null")
    p = c.select((F.col("page_no") * 10).alias("page_id"), F.coalesce("final_url", "url").alias("url"), F.col("html_snippet").alias("html")).distinct()
    return contacts.extract_contacts(p).withColumn("confidence", F.round("confidence", 9))
