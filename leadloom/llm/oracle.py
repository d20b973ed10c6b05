"""DuckDB SQL that the problem queries must equal, where SQL can say it over whole tables."""

P2 = r"""
WITH RECURSIVE raw AS (
  SELECT lower(regexp_replace(left_id, '^\s+|\s+$', '', 'g')) AS l,
         lower(regexp_replace(right_id, '^\s+|\s+$', '', 'g')) AS r, entity_match_score AS s
  FROM match_result),
nodes AS (SELECT DISTINCT n FROM (SELECT l AS n FROM raw UNION ALL SELECT r FROM raw) WHERE n IS NOT NULL),
links AS (SELECT DISTINCT l, r FROM raw WHERE l IS NOT NULL AND r IS NOT NULL AND l <> r AND s >= 0.82 AND NOT isnan(s)),
both_ways AS (SELECT l AS a, r AS b FROM links UNION SELECT r, l FROM links),
reach(n, m) AS (SELECT n, n FROM nodes UNION SELECT reach.n, both_ways.b FROM reach JOIN both_ways ON reach.m = both_ways.a)
SELECT n AS record_id, min(m) AS group_id FROM reach GROUP BY n
"""

P4 = """
WITH runs AS (
  SELECT lead_id, sales_opportunity AS s,
         row_number() OVER (PARTITION BY lead_id ORDER BY scored_at DESC NULLS LAST, score_no DESC NULLS LAST) AS k
  FROM (SELECT DISTINCT lead_id, scored_at, score_no, sales_opportunity FROM scoring_result WHERE lead_id IS NOT NULL)),
cur AS (SELECT lead_id, s FROM runs WHERE k = 1 AND s IS NOT NULL AND NOT isnan(s)),
members AS (SELECT DISTINCT city, category, lead_id FROM lead_row WHERE city <> '' AND category <> ''),
ranked AS (
  SELECT city, category, lead_id, row_number() OVER (PARTITION BY city, category ORDER BY s DESC, lead_id) AS rank_no
  FROM members JOIN cur USING (lead_id))
SELECT city, category, CAST(rank_no AS INTEGER) AS rank_no, lead_id FROM ranked WHERE rank_no <= 5
"""

_P5_FIELDS = {
    "contact_role": "contact_role IS NOT NULL AND trim(regexp_replace(contact_role, '\\s+', ' ', 'g')) <> ''",
    "source_url": "source_url IS NOT NULL",
    "confidence": "conf IS NOT NULL",
    "verified_at": "ver IS NOT NULL",
    "primary_contact": "primary_contact IS NOT NULL",
}

P5 = r"""
WITH d AS (SELECT DISTINCT row_no, lead_id, contact_type, contact_value, contact_role, source, source_url, confidence,
                  verified_at, primary_contact, exported_at FROM contact_row),
k AS (
  SELECT *, CASE
      WHEN contact_type IN ('PHONE', 'WHATSAPP') THEN nullif(right(regexp_replace(contact_value, '[^0-9]', '', 'g'), 10), '')
      WHEN contact_type = 'EMAIL' THEN regexp_replace(split_part(regexp_replace(lower(regexp_replace(contact_value, '^\s+|\s+$', '', 'g')), '^mailto:\s*', ''), '?', 1), '\s+$', '')
      WHEN contact_type = 'CONTACT_FORM' THEN regexp_replace(lower(contact_value), '/$', '')
      ELSE contact_value END AS key,
    CASE WHEN confidence IS NOT NULL AND NOT isnan(confidence) AND confidence BETWEEN 0 AND 1 THEN confidence END AS conf,
    CASE WHEN verified_at <= exported_at OR exported_at IS NULL THEN verified_at END AS ver
  FROM d WHERE contact_value IS NOT NULL AND contact_value <> '[DO_NOT_CONTACT]'),
t AS (
  SELECT k.*, trust_rank, min(row_no) OVER g AS group_no, max(row_no) OVER g AS last_no
  FROM k LEFT JOIN source_trust s ON lower(trim(k.source)) = lower(trim(s.source)) WHERE key IS NOT NULL
  WINDOW g AS (PARTITION BY lead_id, contact_type, key)),
""" + ",\n".join(
    f"""f_{f} AS (SELECT group_no, '{f}' AS field_name, row_no AS from_no, row_number() OVER (PARTITION BY group_no
      ORDER BY trust_rank NULLS LAST, ver DESC NULLS LAST, conf DESC NULLS LAST, coalesce(primary_contact, false) DESC, row_no) AS n
    FROM t WHERE group_no < last_no AND {cond})"""
    for f, cond in _P5_FIELDS.items()
) + "\n" + " UNION ALL ".join(f"SELECT group_no, field_name, from_no FROM f_{f} WHERE n = 1" for f in _P5_FIELDS)

P1_LEFT = """
SELECT 'crawl_page.extracted_text' AS field_name, count(DISTINCT page_no) AS texts, 0 AS mails_left, 0 AS licences_left FROM crawl_page
UNION ALL SELECT 'extracted_contact.context', count(DISTINCT contact_no), 0, 0 FROM extracted_contact
"""

P3_PLAIN = r"""
WITH k AS (
  SELECT DISTINCT record_no, city, locality,
         regexp_extract(address, '^([0-9]+[A-Z]?) ([A-Z][a-z]+) (Street|Road|Lane|Avenue|Boulevard|Terrace|Crescent|Square), ') AS k
  FROM lead_row WHERE city IS NOT NULL AND locality IS NOT NULL
    AND regexp_matches(address, '^([0-9]+[A-Z]?) ([A-Z][a-z]+) (Street|Road|Lane|Avenue|Boulevard|Terrace|Crescent|Square), '))
SELECT a.record_no AS left_no, b.record_no AS right_no FROM k a JOIN k b
  ON a.city = b.city AND a.locality = b.locality AND a.k = b.k AND a.record_no < b.record_no
"""

P6_PLAIN = """
WITH v AS (SELECT DISTINCT 'maps_listing' AS table_name, record_no, category_hint AS v FROM maps_listing
           UNION ALL SELECT DISTINCT 'lead_row', record_no, category FROM lead_row)
SELECT table_name, record_no, category_id FROM v JOIN category_ref ON lower(trim(v)) = lower(category_name)
"""

P7_CHECKED = "SELECT 0 AS inside, 0 AS disordered, 0 AS unknown"

P8_CHECKED = """
SELECT spec_no, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0 AS split, 0 AS tokens_off, 0 AS overfull
FROM container_spec WHERE capacity_tokens >= 1
"""

P9_CHECKED = """
SELECT source, EXISTS (SELECT 1 FROM documents d WHERE d.source = t.source AND trim(d.text) <> '') AS has_documents, true AS met, true AS within_cap
FROM mix_target t
"""

P10_COVERED = r"""
SELECT source, count(*) AS documents, count(*) FILTER (text IS NULL OR NOT regexp_matches(text, '[^\s\p{Z}]')) AS without_text, 0 AS wrong
FROM (SELECT DISTINCT doc_id, source, text FROM documents) GROUP BY source
"""

SQL = {
    "p2_found": P2, "p4_found": P4, "p5_found": P5, "p1_left": P1_LEFT, "p3_plain": P3_PLAIN, "p6_plain": P6_PLAIN, "p7_checked": P7_CHECKED,
    "p8_checked": P8_CHECKED, "p9_checked": P9_CHECKED, "p10_covered": P10_COVERED,
}
