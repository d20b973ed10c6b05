"""The export workbook: one wide row a lead record, and six sheets projected from it in column order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import text

from .leads import display_contacts, withheld
from .runs import metric_pivot

# The sheets' columns in order; what a column is called in the wide row.
EXECUTIVE = {
    "Lead ID": "lead_id", "Priority": "priority", "Data Quality Grade": "data_quality_grade", "Business Name": "business_name", "Category": "category", "City": "city", "Locality": "locality",
    "Website": "website", "Primary Phone": "phone", "WhatsApp": "whatsapp", "Primary Email": "email", "Website Health": "website_health", "Market Readiness": "market_readiness",
    "Conversion Readiness": "conversion_readiness", "Business Vitality": "business_vitality", "Contact Confidence": "contact_confidence", "Sales Opportunity": "sales_opportunity",
    "Primary Problem": "primary_problem", "Evidence Summary": "evidence_summary", "Business Impact": "business_impact", "Recommended Service": "recommended_service", "Secondary Service": "secondary_service",
    "Why Contact": "why_contact", "Opening Pitch": "opening_pitch", "Audit Confidence": "audit_confidence", "Last Verified": "last_verified",
}
PROFILES = {
    "Lead ID": "lead_id", "Business Name": "business_name", "Category": "category", "Subcategory": "subcategory", "Address": "address_line", "Locality": "locality", "City": "city", "State": "state",
    "Postal Code": "postal_code", "Country": "country", "Website": "website", "Website Verification": "website_verification", "Operational Status": "operational_status", "Social Profiles": "social_profiles",
    "Discovery Source": "discovery_source", "Source IDs": "source_ids", "Discovered At": "discovered_at", "Last Verified": "last_verified",
}
AUDITS = {
    "Lead ID": "lead_id", "Domain": "domain", "Website Status": "website_verification", "Status Code": "status_code", "HTTPS": "https", "TLS Valid": "tls_valid", "Performance": "performance",
    "Accessibility": "accessibility", "Best Practices": "best_practices", "SEO": "seo", "LCP": "lcp", "INP": "inp", "CLS": "cls", "FCP": "fcp", "TTFB": "ttfb", "Mobile UX": "mobile_ux", "Technical SEO": "seo",
    "Security": "security", "Conversion": "conversion", "Title Present": "title_present", "Description Present": "description_present", "H1 Present": "h1_present", "Canonical": "canonical", "Robots": "robots",
    "Sitemap": "sitemap", "Structured Data": "structured_data", "Broken Links": "broken_links", "Contact Form": "contact_form", "WhatsApp CTA": "whatsapp_cta", "Phone CTA": "phone_cta", "Booking CTA": "booking_cta",
    "Analytics": "analytics", "GTM": "gtm", "Meta Pixel": "meta_pixel", "Clarity": "clarity", "CMS": "cms", "Framework": "framework", "Libraries": "libraries", "CDN": "cdn", "Critical Issues": "critical_issues",
    "Major Issues": "major_issues", "Minor Issues": "minor_issues", "Website Health": "website_health", "Audit Confidence": "audit_confidence", "Audit Date": "audit_date",
}
CONTACTS = {
    "Lead ID": "lead_id", "Business Name": "business_name", "Contact Type": "contact_type", "Contact Value": "contact_value", "Context": "context", "Role": "contact_role", "Source": "source",
    "Source URL": "source_url", "Confidence": "confidence", "Verification Status": "verification_status", "Verified At": "verified_at", "Primary Contact": "primary_contact",
}
CRM = {
    "Lead ID": "lead_id", "Business Name": "business_name", "Priority": "priority", "Sales Opportunity": "sales_opportunity", "Recommended Service": "recommended_service",
    **{n: None for n in ("Assignee", "Status", "Contact Method", "First Contact", "Last Contact", "Next Follow-Up", "Response", "Interested", "Objection", "Proposal Sent", "Proposal Value", "Outcome", "Revenue")},
    "Do Not Contact": "do_not_contact", "Opt-Out Date": "opt_out_date", "Notes": None,
}
# metrics that are figures, and those that are yes or no: a missing one is no
FIGURES = {
    "status_code": ("TECHNICAL", "statusCode"), "seo": ("SEO", "technicalSEOScore"), "conversion": ("CONVERSION", "conversionReadinessScore"), "broken_links": ("TECHNICAL", "brokenLinks"),
    "performance": ("PERFORMANCE", "performanceScore"), "accessibility": ("ACCESSIBILITY", "accessibilityScore"), "mobile_ux": ("MOBILE_UX", "mobileUxScore"),
}
FLAGS = {
    "https": ("SECURITY", "https"), "tls_valid": ("SECURITY", "tlsValid"), "title_present": ("SEO", "titlePresent"), "description_present": ("SEO", "descriptionPresent"), "h1_present": ("SEO", "h1Present"),
    "canonical": ("SEO", "canonical"), "robots": ("SEO", "robots"), "sitemap": ("SEO", "sitemap"), "structured_data": ("SEO", "structuredData"), "contact_form": ("CONVERSION", "contactForm"),
    "whatsapp_cta": ("CONVERSION", "whatsappCta"), "phone_cta": ("CONVERSION", "phoneCta"), "booking_cta": ("CONVERSION", "bookingCta"),
}
TOOLS = {"analytics": "Google Analytics", "gtm": "Google Tag Manager", "meta_pixel": "Meta Pixel", "clarity": "Microsoft Clarity"}
KINDS = {"cms": "cms", "framework": "framework", "cdn": "cdn"}


def _metric_columns(metrics: DataFrame) -> DataFrame:
    wide = metric_pivot(metrics, [*FIGURES.values(), *FLAGS.values()])
    col = lambda m, n: F.col(f"`{m.lower()}_{n}`")
    yes = lambda k, c: F.coalesce(c > 0 if k == "h1_present" else c == 1, F.lit(False))
    return wide.select("site_id", *[col(*v).alias(k) for k, v in FIGURES.items()], *[yes(k, col(*v)).alias(k) for k, v in FLAGS.items()])


def _tool_columns(technologies: DataFrame) -> DataFrame:
    has = lambda n: F.when(F.bool_or(F.col("name") == n), "detected").otherwise("not detected")
    of = lambda k: F.when(F.col("category") == k, F.col("name"))
    return technologies.groupBy("site_id").agg(
        *[has(n).alias(k) for k, n in TOOLS.items()], *[F.min(of(c)).alias(k) for k, c in KINDS.items()],
        F.nullif(F.array_join(F.sort_array(F.collect_set(of("library"))), ", "), F.lit("")).alias("libraries"),
    )


def _issue_columns(findings: DataFrame) -> DataFrame:
    of = lambda s: F.array_join(F.sort_array(F.collect_set(F.when(F.col("severity") == s, F.col("code")))), "; ").alias(f"{s.lower()}_issues")
    return findings.groupBy("site_id").agg(of("CRITICAL"), of("MAJOR"), of("MINOR"))


def lead_rows(leads: DataFrame, contacts: DataFrame, metrics: DataFrame, technologies: DataFrame, findings: DataFrame, opted_out: Column | None = None) -> DataFrame:
    """One wide row a lead record, safe for a spreadsheet: profile, latest figures, contacts, metrics, tools and issues.

    leads carries the latest figures (leads.current) and priority as run_priority; metrics, technologies and findings have
    the record's number as site_id. Where opted_out holds, phone and mail are withheld, the chat number is not. What
    nothing supplies is null; a yes-or-no metric that is missing is no, a tool not seen "not detected".
    """
    flag = F.coalesce(opted_out, F.lit(False)) if opted_out is not None else F.lit(False)
    j = leads.withColumn("do_not_contact", flag).join(display_contacts(contacts), "lead_id", "left")
    for side in (_metric_columns(metrics), _tool_columns(technologies), _issue_columns(findings)):
        j = j.join(side.withColumnRenamed("site_id", "record_no"), "record_no", "left")
    j = j.withColumns({
        "priority": F.col("run_priority"), "address_line": F.nullif(text.joined(", ", F.col("address"), F.col("locality"), F.col("city")), F.lit("")),
        "phone": withheld(F.col("do_not_contact"), F.col("phone")), "email": withheld(F.col("do_not_contact"), F.col("email")),
        **{k: F.coalesce(k, F.lit(False)) for k in FLAGS}, **{k: F.coalesce(k, F.lit("not detected")) for k in TOOLS},
    })
    wanted = {c for s in (EXECUTIVE, PROFILES, AUDITS, CRM) for c in s.values() if c}
    have = dict(j.dtypes)
    cells = [text.safe_cell(F.col(c)).alias(c) if have.get(c) == "string" else F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in sorted(wanted)]
    return j.select("record_no", *cells)


def sheet(rows: DataFrame, columns: dict[str, str | None], order: list[Column] | None = None) -> DataFrame:
    """The columns of a sheet by their headings; a heading without column is empty text. Sorted, if an order is given."""
    out = rows.orderBy(*order) if order else rows
    return out.select(*[(F.lit("") if c is None else F.col(c)).alias(h) for h, c in columns.items()])


def contact_rows(contacts: DataFrame, names: DataFrame, opted_out: DataFrame | None = None) -> DataFrame:
    """The contact sheet's rows: contacts with their lead's name (lead_id, business_name), values of opted-out leads (lead_id) withheld."""
    j = contacts.drop("business_name").join(names.groupBy("lead_id").agg(F.min("business_name").alias("business_name")), "lead_id", "left")
    if opted_out is not None:
        j = j.join(opted_out.select("lead_id", F.lit(True).alias("_out")).distinct(), "lead_id", "left")
        j = j.withColumn("contact_value", withheld(F.coalesce("_out", F.lit(False)), F.col("contact_value"))).drop("_out")
    safe = {c: text.safe_cell(F.col(c)) for c, t in j.dtypes if t == "string" and c != "lead_id"}
    # the mark itself is no formula
    return j.withColumns(safe).withColumn("primary_contact", F.coalesce("primary_contact", F.lit(False)))


def methodology(rows: DataFrame, algorithm: str, exported_at: Column) -> DataFrame:
    """(item, value): what the export is and how many leads it holds."""
    n = rows.agg(F.count("*").cast("string").alias("n"))
    line = lambda item, value: F.struct(F.lit(item).alias("item"), value.alias("value"))
    lines = F.array(
        line("Export timestamp", exported_at.cast("string")), line("Scoring algorithm version", F.lit(algorithm)), line("Leads", F.col("n")),
        line("Not detected", F.lit("The signal was not seen on the captured pages.")), line("Lab vs field performance", F.lit("Performance figures are laboratory measurements.")),
    )
    return n.select(F.explode(lines).alias("x")).select("x.item", "x.value")


def workbook(rows: DataFrame, contacts: DataFrame, algorithm: str, exported_at: Column) -> dict[str, DataFrame]:
    """The six sheets by name, leads with the best opportunity first; leads.write_sheets writes them."""
    best = [F.desc_nulls_last("sales_opportunity"), F.asc("record_no")]
    return {
        "01 Executive Leads": sheet(rows, EXECUTIVE, best), "02 Business Profiles": sheet(rows, PROFILES, best), "03 Website Audits": sheet(rows, AUDITS, best),
        "04 Contacts": sheet(contacts, CONTACTS, [F.asc("lead_id"), F.desc_nulls_last("confidence"), F.asc("row_no")]), "05 Outreach CRM": sheet(rows, CRM, best), "06 Methodology": methodology(rows, algorithm, exported_at),
    }
