"""Text normalisers as Column expressions; null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom import constants as K


def fold_accents(c: Column) -> Column:
    """Latin accents folded by table; equals full compatibility decomposition on Latin text in lower case."""
    return F.translate(c, K.ACCENTED, K.FOLDED)


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def name_key(c: Column) -> Column:
    """A business name in lower case: no accents, punctuation or legal words."""
    s = F.regexp_replace(fold_accents(F.lower(c)), r"[^a-z0-9\s]", " ")
    return squeeze(F.regexp_replace(s, rf"\b({'|'.join(K.LEGAL_WORDS)})\b", " "))


def token_key(c: Column) -> Column:
    """Lower case, everything but letters and digits turned into single blanks."""
    return squeeze(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "))


def email_key(c: Column) -> Column:
    """The bare address in lower case, or null if there is none: scheme, parameters and further recipients cut."""
    s = F.regexp_extract(F.regexp_replace(F.trim(c), r"(?i)^mailto:", ""), r"^[^?#,;\s]*", 0)
    s = F.lower(F.trim(F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)))
    asset = s.rlike("(" + "|".join(x.replace(".", r"\.") for x in K.ASSET_SUFFIXES) + ")$")
    return F.when(s.rlike(K.EMAIL_SHAPE) & ~asset, s)


def phone_key(c: Column, country: str = K.DEFAULT_COUNTRY) -> Column:
    """+ and 8 to 15 digits, or null; ten digits get the default country code."""
    raw = F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^tel:", ""), r"[^0-9+]", "")
    raw = F.regexp_replace(raw, r"^00", "+")
    digits = F.regexp_replace(raw, r"[^0-9]", "")
    ok = F.length(digits).between(8, 15)
    national = ~raw.startswith("+") & (F.length(digits) == 10)
    return F.when(ok, F.when(national, F.concat(F.lit(f"+{country}"), digits)).otherwise(F.concat(F.lit("+"), digits)))


def postal_key(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"\s+", ""))


def address_key(line1: Column, locality: Column, city: Column, postal: Column, country: Column) -> Column:
    """The non-empty parts, each normalised as a name, joined by bars; '' if there are none."""
    parts = F.filter(F.array(line1, locality, city, postal_key(postal), country), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(F.transform(parts, name_key), "|")


def safe_cell(c: Column) -> Column:
    """A quote before text that a spreadsheet would take for a formula."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def clamp_score(c: Column) -> Column:
    """0 to 100 with one decimal, halves up; NaN becomes 0."""
    v = F.when(F.isnan(c), 0.0).otherwise(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.floor(v * 10 + 0.5) / 10)))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty texts are 1, one empty text 0."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(1 - F.levenshtein(a, b) / longer)


def visible_text(html: Column) -> Column:
    """Text of a page without scripts, styles and tags."""
    s = html
    for tag in ("script", "style", "noscript", "template"):
        s = F.regexp_replace(s, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return squeeze(F.regexp_replace(F.regexp_replace(s, r"<[^>]+>", " "), r"(?i)&nbsp;", " "))


def page_title(html: Column) -> Column:
    """The trimmed first title; '' if there is none."""
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def hash_score(url: Column, salt: str, low: int, high: int) -> Column:
    """A number from low to high fixed by the url: first two bytes of a salted digest, scaled."""
    n = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), url), 256), 1, 4), 16, 10).cast("double")
    return F.floor(low + n / 65535.0 * (high - low) + 0.5)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-|-$", "")


def title_case(c: Column) -> Column:
    """Words split at blanks, underscores and hyphens, each with a capital."""
    return F.initcap(F.trim(F.regexp_replace(c, r"[\s_-]+", " ")))


def joined(sep: str, *parts: Column) -> Column:
    """The parts that are neither null nor empty, joined."""
    return F.concat_ws(sep, *[F.nullif(p, F.lit("")) for p in parts])


def plain_number(c: Column) -> Column:
    """A number as text without a needless .0."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def retry_delay_ms(attempts: Column) -> Column:
    """Wait before the next attempt; null when there is none."""
    return F.when(attempts <= 1, K.RETRY_MS[0]).when(attempts == 2, K.RETRY_MS[1])


def short_error(c: Column, most: int = 4_000) -> Column:
    return F.substring(c, 1, most)
