"""Queries of the export workbook: its sheets over all leads, with metrics of the made pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.operators import audit, export, leads
from leadloom.session import saved, table

from . import duck as D
from .q_audit import _F_SQL, _FP, _METRICS, _pages, findings_of, metric_rows_of
from .q_leads import _DISPLAY, _SAFE, _contacts
from .registry import query

_KEEP = "record_no, lead_id, business_name, category, subcategory, city, locality, state, postal_code, country, address, website, operational_status, data_quality_grade, discovery_source, discovered_at, last_verified"
_RUN = ("sales_opportunity", "website_health", "market_readiness", "conversion_readiness", "business_vitality", "contact_confidence", "audit_confidence")
_PRESENT = lambda k, m, n: f"coalesce(max(value) FILTER (module = '{m}' AND name = '{n}') {'> 0' if k == 'h1_present' else '= 1'}, false) AS {k}"
_LIBS = "nullif(string_agg(DISTINCT name, ', ' ORDER BY name) FILTER (category = 'library'), '') AS libraries"
_ISSUE = lambda s: f"coalesce(string_agg(DISTINCT code, '; ' ORDER BY code) FILTER (severity = '{s}'), '') AS {s.lower()}_issues"
WIDE = f"""{_METRICS}, {_DISPLAY}, tech AS (SELECT DISTINCT site_id, name, category FROM al, {_FP} WHERE regexp_matches(html, rx)), fnd AS ({_F_SQL}),
  mp AS (SELECT site_id, {', '.join(f"max(value) FILTER (module = '{m}' AND name = '{n}') AS {k}" for k, (m, n) in export.FIGURES.items())}, {', '.join(_PRESENT(k, m, n) for k, (m, n) in export.FLAGS.items())} FROM metric GROUP BY 1),
  tp AS (SELECT site_id, {', '.join(f"CASE WHEN bool_or(name = {D.q(n)}) THEN 'detected' ELSE 'not detected' END AS {k}" for k, n in export.TOOLS.items())}, {', '.join(f"min(name) FILTER (category = '{c}') AS {k}" for k, c in export.KINDS.items())}, {_LIBS} FROM tech GROUP BY 1),
  fi AS (SELECT site_id, {_ISSUE('CRITICAL')}, {_ISSUE('MAJOR')}, {_ISSUE('MINOR')} FROM fnd GROUP BY 1),
  lr AS (SELECT DISTINCT {_KEEP}, record_no % 50 = 0 AS do_not_contact FROM lead_row),
  sr AS (SELECT lead_id, priority, {', '.join(f'CASE WHEN NOT isnan({c}) THEN {c} END AS {c}' for c in _RUN)} FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY scored_at DESC NULLS LAST, score_no DESC) AS n FROM (SELECT DISTINCT score_no, lead_id, scored_at, priority, {', '.join(_RUN)} FROM scoring_result)) WHERE n = 1),
  w AS (SELECT lr.*, sr.* EXCLUDE (lead_id), disp.* EXCLUDE (lead_id), mp.* EXCLUDE (site_id), tp.* EXCLUDE (site_id), fi.* EXCLUDE (site_id) FROM lr LEFT JOIN sr ON sr.lead_id = lr.lead_id LEFT JOIN disp ON disp.lead_id = lr.lead_id LEFT JOIN mp ON mp.site_id = record_no LEFT JOIN tp ON tp.site_id = record_no LEFT JOIN fi ON fi.site_id = record_no)"""
_TEXT = {c: c for c in ("lead_id", "priority", "data_quality_grade", "business_name", "category", "subcategory", "city", "locality", "state", "postal_code", "country", "website", "operational_status", "discovery_source", "whatsapp", "cms", "framework", "libraries", "cdn", "critical_issues", "major_issues", "minor_issues")}
_TEXT |= {"address_line": "nullif(concat_ws(', ', nullif(address, ''), nullif(locality, ''), nullif(city, '')), '')"} | {c: f"CASE WHEN do_not_contact AND {c} IS NOT NULL THEN '[DO_NOT_CONTACT]' ELSE {c} END" for c in ("phone", "email")}
_KNOWN = {c: f"round({c}, 6)" for c in export.FIGURES} | {c: c for c in (*_RUN, "last_verified", "discovered_at", "do_not_contact")} | {c: f"coalesce({c}, false)" for c in export.FLAGS} | {c: f"coalesce({c}, 'not detected')" for c in export.TOOLS}


def _sql(columns: dict[str, str | None]) -> str:
    def cell(h: str, c: str | None) -> str:
        return f"'' AS \"{h}\"" if c is None else _SAFE(_TEXT[c], f'"{h}"') if c in _TEXT else f'{_KNOWN.get(c, "NULL::VARCHAR")} AS "{h}"'

    return f"{WIDE} SELECT {', '.join(cell(h, c) for h, c in columns.items())} FROM w"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    pages = saved(_pages(spark, d))
    base = table(spark, d, "lead_row").selectExpr(*_KEEP.split(", ")).distinct()
    runs = leads.latest_runs(table(spark, d, "scoring_result").select("score_no", "lead_id", "scored_at", "priority", *_RUN))
    cur = base.join(runs.select("lead_id", F.col("priority").alias("run_priority"), *_RUN), "lead_id", "left")
    return export.lead_rows(cur, _contacts(spark, d), metric_rows_of(pages), audit.technologies(pages), findings_of(pages), F.col("record_no") % 50 == 0)


def _best() -> list:
    return [F.desc_nulls_last("sales_opportunity"), F.asc("record_no")]


@query(_sql(export.EXECUTIVE))
def sheet_executive(spark: SparkSession, d: str) -> DataFrame:
    """The first sheet; every fiftieth record stands for one that must not be contacted."""
    return export.sheet(_rows(spark, d), export.EXECUTIVE, _best())


@query(_sql(export.PROFILES))
def sheet_profiles(spark: SparkSession, d: str) -> DataFrame:
    return export.sheet(_rows(spark, d), export.PROFILES, _best())


@query(_sql(export.AUDITS))
def sheet_audits(spark: SparkSession, d: str) -> DataFrame:
    out = export.sheet(_rows(spark, d), export.AUDITS, _best())
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in out.dtypes])


@query(_sql(export.CRM))
def sheet_crm(spark: SparkSession, d: str) -> DataFrame:
    return export.sheet(_rows(spark, d), export.CRM, _best())


_C = {"lead_id": "c.lead_id", "business_name": "n.business_name", "contact_value": "CASE WHEN o.lead_id IS NOT NULL AND contact_value IS NOT NULL THEN '[DO_NOT_CONTACT]' ELSE contact_value END"}
_CONTACT_KEEP = ("row_no", "lead_id", "contact_type", "contact_value", "context", "contact_role", "source", "source_url", "confidence", "verification_status", "verified_at", "primary_contact")


def _contact_cell(h: str, c: str) -> str:
    if c in ("confidence", "verified_at", "lead_id"):
        return f'{_C.get(c, c)} AS "{h}"'
    return f'coalesce(primary_contact, false) AS "{h}"' if c == "primary_contact" else _SAFE(_C.get(c, c), f'"{h}"')


@query(
    f"""WITH c AS (SELECT DISTINCT {', '.join(_CONTACT_KEEP)} FROM contact_row), n AS (SELECT lead_id, min(business_name) AS business_name FROM lead_row GROUP BY 1), o AS (SELECT DISTINCT lead_id FROM lead_row WHERE record_no % 50 = 0)
    SELECT {', '.join(_contact_cell(h, c) for h, c in export.CONTACTS.items())} FROM c LEFT JOIN n ON n.lead_id = c.lead_id LEFT JOIN o ON o.lead_id = c.lead_id"""
)
def sheet_contacts(spark: SparkSession, d: str) -> DataFrame:
    """The contact sheet; values of leads that must not be contacted are withheld."""
    l = table(spark, d, "lead_row")
    rows = export.contact_rows(table(spark, d, "contact_row").select(*_CONTACT_KEEP).distinct(), l.select("lead_id", "business_name"), l.filter("record_no % 50 = 0").select("lead_id"))
    return export.sheet(rows, export.CONTACTS, [F.asc("lead_id"), F.desc_nulls_last("confidence"), F.asc("row_no")])


@query("""SELECT unnest(['Export timestamp', 'Scoring algorithm version', 'Leads', 'Not detected', 'Lab vs field performance']) AS item, unnest(['2024-12-31 00:00:00', 'v1', count(*)::VARCHAR, 'The signal was not seen on the captured pages.', 'Performance figures are laboratory measurements.']) AS value FROM (SELECT DISTINCT record_no FROM lead_row)""")
def sheet_methodology(spark: SparkSession, d: str) -> DataFrame:
    return export.methodology(table(spark, d, "lead_row").select("record_no").distinct(), "v1", F.lit("2024-12-31 00:00:00"))


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS row_count, CASE WHEN count(*) > 0 THEN 'COMPLETED' ELSE 'FAILED' END AS status FROM (SELECT DISTINCT {k} FROM {t})" for n, k, t in (("leads", "record_no", "lead_row"), ("contacts", "row_no", "contact_row"))))
def export_runs(spark: SparkSession, d: str) -> DataFrame:
    """Row counts and status of two exports."""
    parts = [leads.run_metadata(n, table(spark, d, t).select(k).distinct()) for n, k, t in (("leads", "record_no", "lead_row"), ("contacts", "row_no", "contact_row"))]
    return reduce(DataFrame.unionByName, parts)
