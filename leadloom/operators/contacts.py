"""Contacts in captured pages: extraction by method, confidence, best rows, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom import constants as K
from leadloom.functions import text, urls

_HREF = r"""(?i)<a\s[^>]*?href=["']({}[^"']*)["']"""


def is_noise_email(c: Column) -> Column:
    """Trackers' and placeholders' addresses."""
    local, domain = F.substring_index(c, "@", 1), F.substring_index(c, "@", -1)
    return (F.length(local) > 64) | local.rlike(K.NOISE_LOCAL) | domain.rlike(K.NOISE_DOMAIN)


def email_confidence(method: Column, contact_page: Column, email: Column, domain: Column, footer: Column) -> Column:
    """Terms in fixed order, capped at 1: method, contact page, own domain, footer, syntax, business word."""
    add = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0.0)
    own = F.substring_index(email, "@", -1).endswith(domain) & (domain != "")
    s = add(method == "MAILTO", 0.25) + add(method == "SCHEMA_ORG", 0.2) + add(contact_page, 0.2) + add(own, 0.2) + add(footer, 0.1) + 0.1 + add(email.rlike(K.BUSINESS_WORDS), 0.05)
    return F.least(F.lit(1.0), s)


def phone_confidence(method: Column, contact_page: Column, phone: Column) -> Column:
    add = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0.0)
    s = add(method == "TEL", 0.25) + add(contact_page, 0.2) + add(method == "SCHEMA_ORG", 0.2) + add(phone.startswith("+") & (F.length(phone) >= 11), 0.2)
    return F.least(F.lit(1.0), s)


def status_of(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "CONFIRMED").when(confidence >= 0.7, "LIKELY").otherwise("UNVERIFIED")


def extract_contacts(pages: DataFrame) -> DataFrame:
    """(page_id, url, kind, value, method, confidence, status): contacts of pages (page_id, url, html), best per kind and value.

    Methods: mail and phone links, chat links, contact forms, structured data (top-level objects and arrays;
    broken JSON is ignored), and free text without scripts. One pass over the pages: each method gives an
    array, and the arrays are exploded together. Ties in confidence go to the method first in this list.
    The footer test is textual: everything after the first <footer. Null html gives no row.
    """
    p = pages.filter("html is not null").select("page_id", "url", "html")
    contact = urls.path(F.col("url")).rlike(K.CONTACT_PATH)
    foot = F.when(F.locate("<footer", F.col("html")) > 0, F.regexp_extract("html", r"(?is)<footer.*$", 0)).otherwise("")
    body = text.visible_text(F.regexp_extract("html", r"(?is)<body[^>]*>(.*)$", 1))
    all_ = lambda c, rx, g=1: F.regexp_extract_all(c, F.lit(rx), F.lit(g))
    item = lambda kind, method, raw, seq, extra=None: F.struct(
        F.lit(kind).alias("kind"), F.lit(method).alias("method"), raw.alias("raw"), F.lit(seq).alias("seq"), (extra if extra is not None else F.lit(False)).alias("footer"))
    forms = F.filter(all_(F.col("html"), r"(?is)(<form.*?</form>)"), lambda f: F.lower(F.regexp_extract(f, r"""(?is)<form[^>]*?action=["']([^"']*)["']""", 1)).contains("contact") | F.lower(f).rlike("email|message|phone"))
    ld = F.transform(all_(F.col("html"), r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), lambda j: F.when(F.trim(j).startswith("["), j).otherwise(F.concat(F.lit("["), j, F.lit("]"))))
    nodes = F.flatten(F.transform(ld, lambda j: F.coalesce(F.from_json(j, "array<struct<email:string,telephone:string>>"), F.array().cast("array<struct<email:string,telephone:string>>"))))
    found = F.flatten(F.array(
        F.transform(all_(F.col("html"), _HREF.format("mailto:")), lambda h: item("EMAIL", "MAILTO", h, 1, F.col("foot").contains(h))),
        F.transform(all_(F.col("html"), _HREF.format("tel:")), lambda h: item("PHONE", "TEL", h, 2)),
        F.transform(F.filter(all_(F.col("html"), _HREF.format("")), lambda h: h.rlike(r"wa\.me|api\.whatsapp\.com|whatsapp")), lambda h: item(
            "WHATSAPP", "WHATSAPP_LINK", F.when(h.rlike(r"(?i)(wa\.me/|phone=)\+?\d+"), F.regexp_extract(h, r"(?i)(?:wa\.me/|phone=)(\+?\d+)", 1)).otherwise(h), 3)),
        F.transform(forms, lambda f: item("CONTACT_FORM", "CONTACT_FORM", urls.resolve(F.lower(F.regexp_extract(f, r"""(?is)<form[^>]*?action=["']([^"']*)["']""", 1)), F.col("url")), 4)),
        F.transform(F.filter(nodes, lambda n: n["email"].isNotNull()), lambda n: item("EMAIL", "SCHEMA_ORG", n["email"], 5)),
        F.transform(F.filter(nodes, lambda n: n["telephone"].isNotNull()), lambda n: item("PHONE", "SCHEMA_ORG", n["telephone"], 6)),
        F.transform(all_(F.col("body"), "(" + K.EMAIL_IN_TEXT + ")"), lambda m: item("EMAIL", "TEXT", m, 7)),
        F.transform(all_(F.col("body"), "(" + K.PHONE_IN_TEXT + ")"), lambda m: item("PHONE", "TEXT", m, 8)),
    ))
    rows = p.withColumn("foot", foot).withColumn("body", body).withColumn("contact", contact).select("page_id", "url", "contact", F.explode(found).alias("c"))
    rows = rows.select("page_id", "url", "c.*", (F.col("contact") | (F.col("c.method") == "SCHEMA_ORG")).alias("on_contact"))
    value = F.when(F.col("kind") == "EMAIL", text.email_key(F.col("raw"))).when(F.col("kind") == "CONTACT_FORM", F.col("raw")).otherwise(text.phone_key(F.col("raw")))
    # the explode of a single value keeps the filters from being pushed into, and multiplying, the normalisers' code
    rows = rows.withColumn("value", F.explode(F.array(value))).filter(F.col("value").isNotNull() & ~((F.col("kind") == "EMAIL") & is_noise_email(F.col("value"))))
    conf = (
        F.when(F.col("kind") == "EMAIL", email_confidence(F.col("method"), F.col("on_contact"), F.col("value"), urls.domain(F.col("url")), F.col("footer")))
        .when(F.col("kind") == "PHONE", phone_confidence(F.col("method"), F.col("on_contact"), F.col("value")))
        .when(F.col("kind") == "WHATSAPP", F.when(F.col("on_contact"), 0.9).otherwise(0.75)).otherwise(F.when(F.col("on_contact"), 0.8).otherwise(0.6))
    )
    status = F.when(F.col("kind").isin("WHATSAPP", "CONTACT_FORM"), "LIKELY").otherwise(status_of(F.col("confidence")))
    rows = rows.withColumn("confidence", conf).withColumn("status", status)
    return best_rows(rows, ["page_id", "kind", "value"], "confidence", "seq").select("page_id", "url", "kind", "value", "method", "confidence", "status")


def best_rows(rows: DataFrame, keys: list[str], score: str, seq: str) -> DataFrame:
    """The row of the highest score for every key; ties go to the smallest seq."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(score), F.asc(seq))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def primary_contacts(contacts: DataFrame, owner: str, seq: str, floor: float = K.PRIMARY_FLOOR) -> DataFrame:
    """The best phone, mail and chat contact of every owner, from the floor up and not rejected."""
    ok = contacts.filter(F.col("kind").isin("PHONE", "EMAIL", "WHATSAPP") & ~F.isnan("confidence") & (F.col("confidence") >= floor) & (F.coalesce("status", F.lit("")) != "REJECTED"))
    return best_rows(ok, [owner, "kind"], "confidence", seq)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Existing and incoming rows, the latest per key; of equal times the incoming row counts. Full refresh, no merge needed."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(at), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")
