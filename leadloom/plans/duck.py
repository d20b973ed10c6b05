"""The text and URL functions in DuckDB's dialect, for the SQL that queries are compared with."""

from __future__ import annotations

from leadloom import constants as K


def q(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str, flags: str = "g") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, {q(flags)})"


def ext(x: str, pattern: str, group: int = 1) -> str:
    return f"coalesce(regexp_extract({x}, {q(pattern)}, {group}), CASE WHEN {x} IS NOT NULL THEN '' END)"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def squeeze(x: str) -> str:
    return f"trim({sub(x, r'\s+', ' ')})"


def name_key(x: str) -> str:
    s = sub(f"translate(lower({x}), {q(K.ACCENTED)}, {q(K.FOLDED)})", r"[^a-z0-9\s]", " ")
    words = "|".join(K.LEGAL_WORDS)
    return squeeze(sub(s, rf"\b({words})\b", " "))


def token_key(x: str) -> str:
    return squeeze(sub(f"lower({x})", r"[^a-z0-9\s]", " "))


def email_key(x: str) -> str:
    s = ext(sub(f"trim({x})", "(?i)^mailto:", "", ""), r"^[^?#,;\s]*", 0)
    s = f"lower(trim(url_decode({s})))"
    asset = "(" + "|".join(a.replace(".", r"\.") for a in K.ASSET_SUFFIXES) + ")$"
    return f"CASE WHEN {has(s, K.EMAIL_SHAPE)} AND NOT {has(s, asset)} THEN {s} END"


def phone_key(x: str) -> str:
    raw = sub(sub(sub(f"trim({x})", "(?i)^tel:", "", ""), "[^0-9+]", ""), "^00", "+", "")
    d = sub(raw, "[^0-9]", "")
    return f"CASE WHEN length({d}) BETWEEN 8 AND 15 THEN CASE WHEN NOT starts_with({raw}, '+') AND length({d}) = 10 THEN '+{K.DEFAULT_COUNTRY}' || {d} ELSE '+' || {d} END END"


def address_key(l1: str, loc: str, city: str, post: str, country: str) -> str:
    parts = [l1, loc, city, f"upper({sub(post, r'\s+', '')})", country]
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {p} <> '' THEN {name_key(p)} END" for p in parts) + ")"


def with_scheme(x: str) -> str:
    return f"(CASE WHEN {has(f'trim({x})', '(?i)^https?://')} THEN trim({x}) ELSE 'https://' || trim({x}) END)"


def host(x: str) -> str:
    return f"lower({ext(with_scheme(x), r'^[a-zA-Z]+://(?:[^/?#@]*@)?([^/?#:]+)')})"


def url_key(x: str) -> str:
    u = with_scheme(x)
    scheme = f"lower({ext(u, '^([a-zA-Z]+)://')})"
    port = ext(u, r"^[a-zA-Z]+://[^/?#]*:([0-9]+)(?:[/?#]|$)")
    rest = ext(u, r"^[a-zA-Z]+://[^/?#]*([^#]*)")
    rest = f"(CASE WHEN {rest} = '/' THEN '' WHEN starts_with({rest}, '?') THEN '/' || {rest} ELSE {rest} END)"
    default = f"(({scheme} = 'http' AND {port} = '80') OR ({scheme} = 'https' AND {port} = '443') OR {port} = '')"
    good = has(host(x), r"""^[^\s<>^|%"]+$""")
    return f"CASE WHEN {good} THEN {scheme} || '://' || {host(x)} || (CASE WHEN {default} THEN '' ELSE ':' || {port} END) || {rest} END"


def domain(x: str) -> str:
    good = has(host(x), r"""^[^\s<>^|%"]+$""")
    return f"CASE WHEN {good} THEN {sub(host(x), r'^www\.', '', '')} END"


def path(x: str) -> str:
    p = f"lower({ext(with_scheme(x), r'^[a-zA-Z]+://[^/?#]*([^?#]*)')})"
    return f"(CASE WHEN {p} = '' THEN '/' ELSE {p} END)"


def path_priority(x: str) -> str:
    p = sub(path(x), "/$", "", "")
    p = f"(CASE WHEN {p} = '' THEN '/' ELSE {p} END)"
    whens = " ".join(f"WHEN {p} = {q(v)} OR ends_with({p}, {q(v)}) THEN {i}" for i, v in enumerate(K.PRIORITY_PATHS))
    return f"CASE {whens} ELSE 100 END"


def is_aggregator(h: str) -> str:
    return has(sub(f"lower({h})", r"^www\.", "", ""), r"(^|\.)(" + "|".join(x.replace(".", r"\.") for x in K.AGGREGATOR_HOSTS) + ")$")


def similarity(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))::DOUBLE END"


def visible_text(x: str) -> str:
    for tag in ("script", "style", "noscript", "template"):
        x = sub(x, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return squeeze(sub(sub(x, "<[^>]+>", " "), "(?i)&nbsp;", " "))


def hash_score(url: str, salt: str, low: int, high: int) -> str:
    n = f"('0x' || substr(sha256({q(salt + ':')} || {url}), 1, 4))::INTEGER"
    return f"floor({low} + {n} / 65535.0::DOUBLE * {high - low} + 0.5)::BIGINT"


def age_days(last: str, now: str) -> str:
    return f"((epoch_us({now}) - epoch_us({last})) / 86400000000.0::DOUBLE)"


def freshness_score(last: str, now: str, kind: str) -> str:
    a, n = age_days(last, now), f"{K.FRESH_DAYS[kind]}.0::DOUBLE"
    return (
        f"CASE WHEN {last} IS NULL THEN 0.2 WHEN {a} <= 0 THEN 1.0 WHEN {a} >= {n} * 2 THEN 0.0 WHEN {a} <= {n} THEN 1 - {a} / {n} * 0.3::DOUBLE"
        f" ELSE greatest(0.0, 0.7::DOUBLE - ({a} - {n}) / {n} * 0.7::DOUBLE) END"
    )


def clamp(x: str) -> str:
    return f"greatest(0.0, least(100.0, floor(CASE WHEN isnan({x}) THEN 0.0 ELSE {x} END * 10 + 0.5) / 10))"


def once(table: str, *cols: str) -> str:
    """The distinct rows of some columns, since tables hold repeats."""
    return f"(SELECT DISTINCT {', '.join(cols)} FROM {table})"
