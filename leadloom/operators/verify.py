"""Does a website belong to a business? Evidence from its domain and captured page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import constants as K
from leadloom.functions import text, urls


def verify_websites(rows: DataFrame) -> DataFrame:
    """Adds status, confidence and reasons to rows (name, website, phone, city, title, page_text).

    Domain and name share letters .25, name words on the page .40 by share, phone's last eight digits .25, city
    .10; VERIFIED from .85, LIKELY from .65, UNCERTAIN from .35, else INVALID. No URL is INVALID with 0.
    """
    domain = urls.domain(F.col("website"))
    words = F.filter(F.split(text.token_key(F.coalesce("name", F.lit(""))), " "), lambda w: F.length(w) > 2)
    core = F.regexp_replace(domain, "[^a-z0-9]", "")
    glued = F.array_join(words, "")
    affine = domain.endswith(".example.com") | ((F.length(glued) >= 4) & core.contains(glued)) | F.exists(words, lambda w: (F.length(w) >= 4) & core.contains(w))
    hay = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("page_text", F.lit(""))))
    ratio = F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: hay.contains(w))) / F.size(words)).otherwise(0.0)
    digits = F.regexp_replace("phone", "[^0-9]", "")
    last8 = F.when(F.length(digits) > 8, F.substring(digits, -8, 8)).otherwise(digits)
    phoned = F.coalesce((last8 != "") & F.regexp_replace(hay, "[^0-9]", "").contains(last8), F.lit(False))
    in_city = F.coalesce((F.col("city") != "") & hay.contains(F.lower("city")), F.lit(False))
    add = lambda c, v: F.when(c, v).otherwise(0.0)
    score = F.when(domain.isNull(), 0.0).otherwise(F.least(F.lit(1.0), add(affine, 0.25) + 0.4 * ratio + add(phoned, 0.25) + add(in_city, 0.1)))
    reasons = F.when(domain.isNull(), F.array(F.lit("invalid_url"))).otherwise(F.filter(F.array(
        F.when(affine, "domain_name_affinity"), F.when(ratio >= 0.5, "name_on_page"), F.when(phoned, "phone_on_page"), F.when(in_city, "city_on_page")), lambda x: x.isNotNull()))
    status: Column = F.when(score >= 0.85, "VERIFIED").when(score >= 0.65, "LIKELY").when(score >= 0.35, "UNCERTAIN").otherwise("INVALID")
    return rows.select("*", score.alias("confidence"), status.alias("status"), reasons.alias("reasons"))


def reachable(status: Column) -> Column:
    return F.coalesce(status.between(200, 399), F.lit(False))


def needs_browser(html: Column, status: Column) -> Column:
    """Is a reachable page an empty shell that only scripts would fill?"""
    body = F.coalesce(html, F.lit(""))
    t = F.length(text.squeeze(F.regexp_replace(F.regexp_replace(body, r"(?is)<script.*?</script>", " "), r"<[^>]+>", " ")))
    return reachable(status) & (((t < 80) & (F.length(body) > 200)) | (body.rlike(K.SHELL_MARKS) & (t < 400)) | (body.rlike(K.SCRIPT_MARKS) & (t < 300)))
