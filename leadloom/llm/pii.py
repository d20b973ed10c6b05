"""Problem 1: personal details inside running text, found and replaced by typed placeholders.

Method: offset-preserving deobfuscation. A character transducer normalises homoglyphs, full-width forms, invisible
characters, odd blanks and dashes; a second one, over its output, turns spelled digits into digits and at/dot
disguises into "@" and ".". Both carry the source offsets of what they write. Detectors run over the normalised
text, and every span found is mapped back to the source characters, so what is reported and replaced is exactly
what stands in the text. Whole texts are read; the work is one pass in Arrow batches, and each detector looks only
around its anchors ("@", figures beside street words, a card's bar), so its cost follows those, not the text.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.session import spread

# Letters of other scripts that look like Latin ones, dashes, invisible characters.
LOOKALIKE = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅοαινρτυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwABEKMHOPCTYXIJSoaivptukABEZHIKMNOPTYX"))
DASHES = "‐‑‒–—−"
INVISIBLE = set("​‌‍⁠﻿­")
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
FILE_ENDINGS = {"png", "jpg", "jpeg", "gif", "svg", "webp", "css", "js", "ico", "pdf", "woff", "mp4"}


def transduce(text: str) -> tuple[str, list[int] | None]:
    """The normalised text and, for each of its characters, the source offset; None if nothing moved."""
    if text.isascii():
        return text, None
    out: list[str] = []
    at: list[int] = []
    for i, ch in enumerate(text):
        if ch < "\x80":
            out.append(ch)
            at.append(i)
        elif ch in INVISIBLE:
            continue
        elif ch in DASHES:
            out.append("-" if ch in "‐‑‒−" else "–")
            at.append(i)
        elif ch in LOOKALIKE:
            out.append(LOOKALIKE[ch])
            at.append(i)
        elif ch.isspace():
            out.append("\n" if ch in "  " else " ")
            at.append(i)
        else:
            form = unicodedata.normalize("NFKC", ch)
            out.append(form if len(form) == 1 else ch)
            at.append(i)
    return "".join(out), at


_word = r"[\w%+\-]+"
_dot = r"(?:\s?[\(\[\{]\s?(?:dot|punkt|punto|point|\.)\s?[\)\]\}]\s?|\s(?:dot|punkt|punto|point)\s|\.)"
DOT = regex.compile(_dot, regex.I)
AT = regex.compile(r"\s?[\(\[\{]\s?(?:at|@|arroba)\s?[\)\]\}]\s?|\s(?P<bare>at|arroba)\s|\s@\s?|@\s", regex.I)
LOCAL_END = regex.compile(rf"(?<![\w.+%\-@]){_word}(?:{_dot}{_word})*$", regex.I)
HOST_START = regex.compile(rf"[A-Za-z0-9\-]+(?:{_dot}[A-Za-z0-9\-]+)*?{_dot}[A-Za-z]{{2,24}}(?![\w@\-])(?!{_dot}[A-Za-z0-9])", regex.I)
#: a bare "at" before a plainly dotted host is read as "@" only where a mail is spoken of
MAIL_SPOKEN = regex.compile(r"(?:mail|write|mailto|schreiben|escrib\w+|[ée]cri\w+)\b(?:\s(?:to|me|us|an|a|à)\b)?[\s:]*$", regex.I)
HOST = regex.compile(r"[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,24}(?![\w@])")
LOCAL = regex.compile(r"[\w%+\-]+(?:\.[\w%+\-]+)*$")
_digit = rf"(?:(?:double|triple)[ \-])?(?:{'|'.join(DIGIT_WORDS)})"
DIGIT_TOKEN = regex.compile(rf"(?:(?P<times>double|triple)[ \-])?(?P<word>{'|'.join(DIGIT_WORDS)})\b|(?P<figures>[0-9]{{1,4}})", regex.I)
#: a run of spoken digits, figures among them, that starts and ends with any of them
SPOKEN = regex.compile(rf"(?<![\w.])(?:(?:{_digit}\b|[0-9]{{1,4}}(?![\w]))[ ,\-]*){{3,16}}(?<=\w)", regex.I)
DIGIT_WORD = regex.compile(rf"\b(?:{'|'.join(DIGIT_WORDS)})\b", regex.I)


def undisguise(s: str) -> tuple[str, list[int], list[int]] | None:
    """The text with disguised mail addresses and spoken numbers written out, and where each character starts and ends in s.

    None where nothing is disguised. A number counts as spoken if three of its digits at least are words and it has
    9 to 14 digits.
    """
    swaps: dict[int, tuple[int, str]] = {}
    low = s.lower()
    if "at" in low or "@" in s or "arroba" in low:
        for m in AT.finditer(s):
            a, b = m.span()
            host = HOST_START.match(s, b)
            local = LOCAL_END.search(s[max(0, a - 80): a]) if host else None
            if not host or not local:
                continue
            if m["bare"] and "." in host[0] and not regex.search(r"dot|punkt|punto|point|\.\s?[\)\]\}]", host[0], regex.I) and not MAIL_SPOKEN.search(s[max(0, a - 110): a - len(local[0])]):
                continue
            swaps[a] = (b, "@")
            first = a - len(local[0])
            for start, end in ((first, a), (b, host.end())):
                for d in DOT.finditer(s, start, end):
                    if d[0] != ".":
                        swaps[d.start()] = (d.end(), ".")
    if len(DIGIT_WORD.findall(s)) >= 3:
        for m in SPOKEN.finditer(s):
            parts = list(DIGIT_TOKEN.finditer(s, m.start(), m.end()))
            written = [DIGIT_WORDS[p["word"].lower()] * {"double": 2, "triple": 3}.get((p["times"] or "").lower(), 1) if p["word"] else p["figures"] for p in parts]
            if sum(bool(p["word"]) for p in parts) >= 3 and 9 <= sum(map(len, written)) <= 14:
                for k, p in enumerate(parts):
                    end = parts[k + 1].start() if k + 1 < len(parts) else p.end()
                    swaps[p.start()] = (end, written[k])
    if not swaps:
        return None
    out: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    i = 0
    while i < len(s):
        b, text = swaps.get(i, (i + 1, s[i]))
        out.append(text)
        starts += [i] * len(text)
        ends += [b] * len(text)
        i = b
    return "".join(out), starts, ends


_d = r"[0-9OolI]"
_gap = r"[ .\-]"
PHONE = regex.compile(
    rf"(?<![\w#/+.\-])(?<!\d )(?:(?:\+|00)[0-9]{{1,3}}{_gap}?\(?0?\)?{_gap}?|\(0\)|0)?"
    rf"(?:\({_d}{{3}}\) ?{_d}{{3}}{_gap}?{_d}{{4}}|{_d}{{3}}{_gap}{_d}{{3}}{_gap}{_d}{{4}}|{_d}{{5}}{_gap}{_d}{{5}}|{_d}{{10}})(?![\w]|[\-./]\d)"
)
PHONE_FREE = regex.compile(r"(?<![\w#/.\-])\+[0-9]{1,3}(?:[ .\-]?\(?[0-9]{1,5}\)?){2,5}(?![\w]|[\-./]\d)")
SPOKEN_OUT = regex.compile(r"[0-9]{9,14}")

_id = (
    r"[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}|[0-9]{4}[- ][0-9]{4}[- ][0-9]{4}|[A-Za-z]{2}[- ]?[0-9]{2}[- ]?[0-9]{11}"
    r"|[A-Za-z]{5}[0-9]{4}[A-Za-z]|[A-Za-z]{1,2}[0-9]{6,8}[A-Za-z]?|[0-9]{7,8}[A-Za-z]|[0-9]{9,13}"
)
_label = (
    r"ssn|social[- ]security(?: (?:no\.?|number))?|citizen(?: (?:no\.?|number|id))?|pan(?: of [\w]+| card| no\.?)?|licen[cs]e(?: (?:no\.?|number))?"
    r"|passport(?: (?:no\.?|number))?|id[- ](?:no\.?|number|card)|identity (?:card|no\.?|number)|national id|aadhaar|lost papers|papers|personal(?:ausweis| id)|steuer-?id|tax(?:payer)? id|dni|nie|nif|ausweis(?:nummer)?|num[ée]ro de s[ée]cu(?:rit[ée] sociale)?"
)
ID_LABELLED = regex.compile(rf"(?<![\w])(?:{_label})[\s:#(№]*(?:no\.?\s*|number\s*|is\s*)?(?P<v>{_id})(?![\w])(?!-\d)", regex.I)
ID_BARE = regex.compile(r"(?<![\w\-/#])(?P<v>[A-Z]{5}[0-9]{4}[A-Z]|[A-Z]{2}-[0-9]{2} [0-9]{11}|[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w\-/])")
NO_PERSON = regex.compile(r"(?:company|order|invoice|batch|sku|ref|item|coupon|vat|serial|part|article|ticket)\b[^.!?\n]{0,24}$", regex.I)

_kind = r"(?:street|str|st|road|rd|lane|ln|la|avenue|ave|avn|av|boulevard|boul|blvd|terrace|terr|ter|crescent|cres|cr|square|sq)"
_kind_c = r"(?:Place|Pl|Drive|Dr|Court|Ct|Way|Close)"
_kind_end = rf"(?:(?i:street|road|lane|avenue|boulevard|terrace|crescent|square|{_kind}\.?)|{_kind_c})"
_name = r"\p{L}[\p{L}'’\-]+"
_no = r"[0-9]{1,4}(?: ?[A-Za-z](?![\w]))?"
_lead = rf"(?:(?:flat|apt\.?|apartment|unit|suite|shop|office)\s+(?:no\.?\s*)?#?\s?[\w\-]{{1,5}},?\s+)?(?:house\s+(?:no\.?|number)?\s*|no\.?\s*|#)?"
ADDRESS = regex.compile(
    rf"(?<![\w#\-/.,:]|\d )(?i:{_lead}){_no},?\s(?:(?i:rue|calle|avenida|via|chemin|all[ée]e)\s(?:(?i:de|de la|du|des|del)\s)?{_name}"
    rf"|(?!(?i:{_kind})\b){_name}(?:\s(?!(?i:{_kind})\b)\p{{Lu}}[\p{{L}}'’\-]+)?\s(?:(?i:{_kind})|{_kind_c})\b(?!\s(?:bike|marker|light))|\p{{L}}+(?i:stra(?:ß|ss)e|str\.|weg|gasse|platz)\b)"
    rf"|(?<![\w])(?i:{_lead})(?:(?i:calle|rue|avenida|via)\s(?:(?i:de|de la|du|des|del)\s)?{_name},?\s{_no}|\p{{L}}{{2,}}(?i:stra(?:ß|ss)e|str\.|weg|gasse|platz)\s{_no}"
    rf"|(?!(?i:{_kind}|no|flat|house|at|the|in|on|is|to)\b){_name}[ ]{_kind_end},?[ ]{_no}(?![\w%:.,]?\d))"
)

STREET_WORD = regex.compile(rf"\b(?:{_kind}|rue|calle|avenida|via|chemin|all[ée]e|place|pl|drive|dr|court|ct|way|close)\b|(?:stra(?:ß|ss)e|str\.|weg|gasse|platz)\b|str\.", regex.I)
#: no address is longer on either side of its street word
REACH = 90


def addresses_in(s: str) -> Iterator[regex.Match]:
    """ADDRESS wherever a street word has a figure near it."""
    last = 0
    windows: list[list[int]] = []
    for m in STREET_WORD.finditer(s):
        a, b = max(0, m.start() - REACH), min(len(s), m.end() + REACH)
        while 0 < a and s[a - 1].isalnum():  # no window cuts a word
            a -= 1
        while b < len(s) and s[b].isalnum():
            b += 1
        if windows and a <= windows[-1][1]:
            windows[-1][1] = b
        else:
            windows.append([a, b])
    for a, b in windows:
        if any(c.isdigit() for c in s[a:b]):
            for m in ADDRESS.finditer(s, max(a, last), b):
                last = m.end()
                yield m


_init = r"\p{L}\."
_given = rf"(?:\p{{L}}[\p{{L}}'’]+(?:-\p{{L}}[\p{{L}}'’]+)?|{_init})"
_family = r"(?:\p{L}['’])?\p{L}[\p{L}]+(?:-(?:\p{L}['’])?\p{L}[\p{L}]+)*"
PERSON = rf"(?:{_family},\s{_given}(?:\s{_init})?|{_given}(?:\s{_init})?\s{_family})"
_before = (
    r"\b(?:dr|prof|mr|mrs|ms|miss|herr|frau|sr|sra|mme|mlle|m)\.?\s|\bsigned:\s|\bmy name is\s|\bmanager is\s|\bapplicant\s|\bansprechpartner(?:in)?:\s|\bhablar con\s"
    r"|\breach\s|\breview by\s|\bthanks to\s|\bbooked by\s|\bissued to\s|\bclaimed from\s|\bon file for\s|\brechnung an\s|\bowner\s|\bkeys at\s|\bask for\s|\bcontact person:\s|\bi am\s|\bregards,\s"
)
NAME_CUED = regex.compile(rf"(?i:{_before})(?P<v>{PERSON})(?P<and>\s(?:and|und|et|y|&)\s(?P<w>{PERSON}))?")
NAME_BEFORE_BAR = regex.compile(rf"(?P<v>{PERSON})$")
MAIL_AFTER_BAR = regex.compile(r"\s[\w.+%\-]+@")
# Common given names of several languages; before a capitalised word they need no other cue.
GIVEN = (
    "Aaron Adam Adrian Ahmed Aisha Alan Albert Alejandro Alex Alexander Ali Alice Amanda Amelia Amina Ana Anders Andrea Andreas Andrew Anita Anna Anne "
    "Anthony Antonio Arjun Arthur Barbara Beatrice Ben Benjamin Bernard Brian Bruno Carla Carlos Carmen Carol Caroline Catherine Charles Charlotte "
    "Chloe Christian Christine Christopher Claire Clara Claudia Daniel David Deborah Diana Diego Dmitri Dorothy Edward Elena Elif Elizabeth Ella Emil Emily "
    "Emma Eric Erik Eva Fatima Felix Fernando Florian Francesca Francisco Francois Frank Gabriel George Giulia Grace Greta Hana Hannah Hans Hassan "
    "Heather Heinz Helen Henry Ibrahim Ines Ingrid Irina Isabel Ivan Jack Jakub James Jan Jana Jane Jason Javier Jean Jennifer Jessica Joao Johanna "
    "Johannes John Jonas Jorge Jose Joseph Juan Julia Julie Karen Karim Karl Katarzyna Kevin Klaus Kofi Laura Leila Lena Linda Lisa Louis Louise Lucas Lucia "
    "Luis Lukas Manuel Marco Margaret Maria Marie Mario Mark Markus Marta Martin Mary Mateo Matthew Meera Mehmet Michael Michelle Miguel Milan Mohammed Nadia "
    "Nicolas Nicole Nikos Noah Nora Olga Olivia Omar Oscar Pablo Patricia Patrick Paul Paula Pedro Peter Pierre Priya Rachel Rafael Ravi Rebecca Richard Robert "
    "Rosa Sandra Sara Sarah Sebastian Sergio Simon Sofia Sophie Stefan Susan Tariq Thomas Tomas Ursula Victoria William Yusuf Zoe"
).split()
NAME_PLAIN = regex.compile(
    r"(?<![\w'’&\-@./]|& )(?P<v>\L<given>(?:-\p{Lu}\p{Ll}+)?(?:\s\p{Lu}\.)?\s(?:(?:de|la|del|da|di|van|von|der|den|bin|al)\s){0,2}(?:\p{Lu}['’])?\p{Lu}\p{Ll}+(?:-(?:\p{Lu}['’])?\p{Lu}\p{Ll}+)*)(?![\w'’&\-]*\p{L})(?!\s(?:&|\p{Lu}\p{Ll}+\s(?:Ltd|Inc|GmbH|LLC)))",
    given=GIVEN,
)
FAMILY_NOT = regex.compile(rf"(?i)\b(?:{_kind}|place|drive|court|way|close|park|bridge|island|station|airport|university|college|museum|hill|bank|market|quay|green|range|hotel|beach|january|february|march|april|may|june|july|august|september|october|november|december)$")
NAME_SIGN = regex.compile(rf"(?:[–—]|(?<!\w)-)\s(?P<v>{PERSON})(?=,\s(?i:owner|manager|founder|director|inhaber|propri[ée]taire|propietari[oa])\b)")
#: cues that also stand before other things, with what must follow the name
NEEDS_AFTER = {
    "reach": r"\son\s|\sat\s|\sunder\s", "ask for": r"\sat the desk", "keys at": r"['’]s\s", "owner": r"\scan be|,|\sis\b|\.|$",
    "applicant": r"\sholds|\s\(|,|\.", "i am": r",|\.|\sand\b", "m": r"", "dr": r"", "thanks to": r"\sand\s|\sfor\b|,|\.|!|\s|$",
}
NOT_NAMES = regex.compile(
    r"(?i)^(?:the|our|an?(?!\.)|one|two|for|and|at|in|on|of|all|any|your|this|that|his|her|my|we|you|monday|tuesday|wednesday|thursday|friday|saturday|sunday|swedish|order|room|kitchen|old|north|south|west|east|upper|lower|fort|mill|lime|canal|harbour|saint|guests?|everyone|reception|customer|sales|team|id|includes?)\b"
)
BUSINESS = regex.compile(r"(?i)\b(?:clinic|dental|bakery|shop|store|restaurant|pharmacy|optician|kitchens?|studio|salon|parlour|agency|firm|school|centre|center|service|services|surgery|doctor|veterinarian|hospital|garage|repair|sons|broker|agent|office|massage|special|llc|ltd|gmbh|inc|teacher|lessons)\b")
#: trades that are family names too: they only count where no title or phrase says that a person is meant
TRADE = regex.compile(r"(?i)\b(?:carpenter|practitioner|joinery|repairs|physiotherapist|contractor|gelateria|chemist|supermarket|plumber|florist|locksmith|barber|dentist|electrician|accountant|jeweller|bookshop|hotel|bar)\b")


def _possessive(text: str, s: int, e: int) -> int:
    """The end of a name without its possessive ending."""
    return e - 2 if text[s:e].endswith(("'s", "’s")) else e


def detect(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, type) of the source text, in order and without overlap."""
    first, at = transduce(text)
    second = undisguise(first)
    s = second[0] if second else first
    taken: list[tuple[int, int]] = []
    found: list[tuple[int, int, str]] = []

    def free(a: int, b: int) -> bool:
        k = bisect_left(taken, (a, a))
        return (k == len(taken) or taken[k][0] >= b) and (k == 0 or taken[k - 1][1] <= a)

    def take(a: int, b: int, kind: str) -> None:
        insort(taken, (a, b))
        found.append((a, b, kind))

    i = s.find("@")
    while i >= 0:
        host = HOST.match(s, i + 1)
        local = LOCAL.search(s, max(0, i - 80), i) if host else None
        if host and local and (local.start() == 0 or s[local.start() - 1] not in "@") and host[0].rsplit(".", 1)[1].lower() not in FILE_ENDINGS and free(local.start(), host.end()):
            take(local.start(), host.end(), "EMAIL")
        i = s.find("@", i + 1)
    for pattern in (ID_LABELLED, ID_BARE):
        for m in pattern.finditer(s):
            a, b = m.span("v")
            if free(a, b) and not (pattern is ID_BARE and NO_PERSON.search(s[max(0, a - 40): a])) and any(c.isdigit() for c in m["v"]):
                take(a, b, "ID_NUMBER")
    for pattern in (PHONE, PHONE_FREE):
        for m in pattern.finditer(s):
            digits = sum(c.isdigit() for c in m[0])
            if digits >= 8 and free(*m.span()) and not NO_PERSON.search(s[max(0, m.start() - 28): m.start()]):
                take(m.start(), m.end(), "PHONE")
    if second:
        for m in SPOKEN_OUT.finditer(s):
            if second[2][m.start()] - second[1][m.start()] > 1 and free(*m.span()) and not NO_PERSON.search(s[max(0, m.start() - 28): m.start()]):
                take(m.start(), m.end(), "PHONE")
    for m in addresses_in(s):
        if free(*m.span()):
            take(m.start(), m.end(), "ADDRESS")

    def name(a: int, b: int, cued: bool = True) -> None:
        b = _possessive(s, a, b)
        v = s[a:b]
        if free(a, b) and not NOT_NAMES.search(v) and not BUSINESS.search(v) and (cued or not TRADE.search(v)) and "\n" not in v:
            take(a, b, "NAME")

    for m in NAME_CUED.finditer(s):
        cue = regex.sub(r"[.:,\s]+$", "", s[m.start(): m.start("v")].lower().strip())
        after = NEEDS_AFTER.get(cue)
        a, b = m.span("v")
        b2 = _possessive(s, a, b)
        if after and not regex.match(after, s[b2:], regex.I):
            continue
        name(a, b)
        if m["w"]:
            name(*m.span("w"))
    bar = s.find(" | ")
    while bar >= 0:
        if MAIL_AFTER_BAR.match(s, bar + 2) and (m := NAME_BEFORE_BAR.search(s, max(0, bar - 80), bar)):
            name(*m.span("v"), cued=False)
        bar = s.find(" | ", bar + 1)
    for m in NAME_SIGN.finditer(s):
        name(*m.span("v"), cued=False)
    for m in NAME_PLAIN.finditer(s):
        a, b = m.span("v")
        after = regex.match(r"\s[\p{L}]+", s[b:])
        if not FAMILY_NOT.search(m["v"]) and not (after and (BUSINESS.search(after[0]) or TRADE.search(after[0]))):
            name(a, b, cued=False)
    found.sort()
    if second:
        found = [(second[1][a], second[2][b - 1], t) for a, b, t in found]
    return found if at is None else [(at[a], at[b - 1] + 1, t) for a, b, t in found]


def redact(text: str) -> str:
    """The text with every detail replaced by a placeholder of its type, such as [EMAIL]; the rest unchanged."""
    out, last = [], 0
    for a, b, t in detect(text):
        out += [text[last:a], f"[{t}]"]
        last = b
    return "".join(out) + text[last:]


def _fields(pages: DataFrame, contacts: DataFrame) -> DataFrame:
    return pages.select(F.lit("crawl_page.extracted_text").alias("field_name"), F.col("page_no").alias("row_no"), F.col("extracted_text").alias("text")).unionByName(
        contacts.select(F.lit("extracted_contact.context").alias("field_name"), F.col("contact_no").alias("row_no"), F.col("context").alias("text"))
    )


def _found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(f, n, k, t[x:y]) for f, n, t in zip(b.field_name, b.row_no, b.text) for x, y, k in detect(t)]
        yield pd.DataFrame(rows, columns=["field_name", "row_no", "pii_type", "pii_text"])


def _redacted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(text=[None if t is None else redact(t) for t in b.text])


def personal_details(pages: DataFrame, contacts: DataFrame) -> DataFrame:
    """(field_name, row_no, pii_type, pii_text), one row for each distinct detail of a row.

    Null and empty texts give no row; repeated rows count once.
    """
    rows = _fields(pages, contacts).filter("text is not null and text <> '' and row_no is not null")
    return spread(rows).mapInPandas(_found, "field_name string, row_no bigint, pii_type string, pii_text string").distinct()


def redacted_texts(pages: DataFrame, contacts: DataFrame) -> DataFrame:
    """(field_name, row_no, text): every text, placeholders instead of details; null stays null, repeats give one row."""
    return spread(_fields(pages, contacts)).mapInPandas(_redacted, "field_name string, row_no bigint, text string").distinct()
