"""Reading one-line postal addresses: which part is unit, number, street, locality, city and postcode.

Pure Python over one string, used inside Arrow batches. The parts of an address may stand in any order and
in any field, so every part found is taken out of the text and what is left over is the street.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

# Street kinds with their written forms, unit words, landmark words, compass abbreviations.
KINDS = {
    "street": "street str st", "road": "road rd", "lane": "lane ln la", "avenue": "avenue ave av avn",
    "boulevard": "boulevard blvd boul bd", "terrace": "terrace ter terr tce", "crescent": "crescent cres cr crs",
    "square": "square sq sqr", "place": "place pl", "drive": "drive dr", "court": "court ct", "way": "way wy",
}
KIND_OF = {w: k for k, ws in KINDS.items() for w in ws.split()}
UNIT = r"flat|shop|suite|ste|unit|office|apt|apartment|room|rm|floor|fl|level|door"
LANDMARK = r"near|nr|next to|opp|opposite|above|below|behind|beside|besides|adjacent to|in front of|off"
SHORT = {"n": "north", "s": "south", "e": "east", "w": "west", "st": "saint", "up": "upper", "lr": "lower", "upr": "upper", "hbr": "harbour", "mkt": "market"}
JUNK = {"", "n/a", "na", "none", "null", "-", "--", "---", "?", "tbd", "unknown", "address", "see website"}

_unit_before = re.compile(rf"\b(?:{UNIT})\b\.?\s*(?:no\b\.?\s*)?#?\s*(?:[a-z]-?)?\d+(?:st|nd|rd|th)?[a-z]?\b|\b(?:{UNIT})\b\.?\s*#?\s*[a-z]\b(?=\s*,)")
_unit_after = re.compile(rf"\b(?:[a-z]-?)?\d+(?:st|nd|rd|th)?[a-z]?\s*(?:floor|flr)\b")
_landmark = re.compile(rf"(?:^|(?<=[,;]))\s*(?:{LANDMARK})\b\.?[^,;]*")
_paren = re.compile(r"\([^)]*\)?")
_post = re.compile(r"(?<![\d#])(\d{3})[ -]?(\d{3})(?![\da-z])")
_number = re.compile(r"(?:\bhouse\s+no\b\.?|\bno\b\.?|\bnr\b\.?|\bh\.?\s*no\b\.?|#|\bplot\b)?\s*(?<![\w-])(\d{1,5})(?:\s?-?([a-z])(?![\w']))?(?![\w])")


@lru_cache(maxsize=200_000)
def fold(text: str) -> str:
    """Lower case without accents; compatibility forms resolved."""
    s = unicodedata.normalize("NFKD", text)
    return "".join(c for c in s if not unicodedata.combining(c)).lower().replace("ß", "ss").replace(" ", " ")


def near(a: str, b: str) -> bool:
    """One insertion, deletion, substitution or swap of neighbours apart, or equal."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if abs(la - lb) > 1:
        return False
    i = 0
    while i < min(la, lb) and a[i] == b[i]:
        i += 1
    if la == lb:
        return a[i + 1:] == b[i + 1:] or (a[i:i + 2] == b[i:i + 2][::-1] and a[i + 2:] == b[i + 2:])
    return a[i + 1:] == b[i:] if la > lb else a[i:] == b[i + 1:]


def _cuts(word: str) -> set[str]:
    return {word, *(word[:i] + word[i + 1:] for i in range(len(word)))}


def _index(words: Iterable[str]) -> dict[str, list[str]]:
    """The words by each of their deletion forms."""
    out: dict[str, list[str]] = {}
    for w in words:
        for c in _cuts(w):
            out.setdefault(c, []).append(w)
    return out


def _alike(index: dict[str, list[str]], word: str) -> list[str]:
    return sorted({w for c in _cuts(word) for w in index.get(c, ()) if near(word, w)})


class Gazetteer:
    """Known cities, localities, regions (states, countries) and localities by postcode."""

    def __init__(self, cities: list[str], localities: list[str], regions: list[str], by_post: dict[str, tuple[str, str]]):
        self.cities = {fold(c): fold(c) for c in cities if c}
        self.localities = {fold(c): fold(c) for c in localities if c}
        self.regions = {fold(c) for c in regions if c}
        self.by_post = by_post
        self._near: dict[str, str] = {}
        self._city_cuts, self._locality_cuts = _index(self.cities), _index(self.localities)
        forms: dict[str, set[str]] = {}
        for loc in self.localities:
            ws = loc.split()
            if len(ws) == 2:  # "n quay", "n.quay", "northquay"
                for short, full in SHORT.items():
                    if ws[0] == full:
                        forms.setdefault(f"{short} {ws[1]}", set()).add(loc)
                        forms.setdefault(f"{short}{ws[1]}", set()).add(loc)
                forms.setdefault("".join(ws), set()).add(loc)
            elif len(ws) == 1:  # "s fields" for southfields
                for short, full in SHORT.items():
                    if loc.startswith(full) and len(loc) > len(full) + 2:
                        rest = loc[len(full):]
                        forms.setdefault(f"{short} {rest}", set()).add(loc)
                        forms.setdefault(f"{short}{rest}", set()).add(loc)
                        forms.setdefault(f"{full} {rest}", set()).add(loc)
        self.locality_forms = {f: next(iter(s)) for f, s in forms.items() if len(s) == 1} | self.localities

    def city_near(self, word: str) -> str | None:
        """The one city within one edit of word, for words of five letters or more."""
        if len(word) < 5:
            return None
        if word not in self._near:
            if len(self._near) > 100_000:
                self._near.clear()
            hits = _alike(self._city_cuts, word)
            self._near[word] = hits[0] if len(hits) == 1 else ""
        return self._near[word] or None

    def locality_near(self, phrase: str) -> str | None:
        if len(phrase) < 6:
            return None
        key = "\n" + phrase
        if key not in self._near:
            if len(self._near) > 100_000:
                self._near.clear()
            hits = _alike(self._locality_cuts, phrase)
            self._near[key] = hits[0] if len(hits) == 1 else ""
        return self._near[key] or None


_word = re.compile(r"[a-z][a-z'’]*")
Named = tuple[str | None, str | None, str | None, str | None]
NEAR, BARE, SKIP = 0.6, 1.0, 1.5


def assign(words: list[str], gaz: Gazetteer) -> Named:
    """(street, kind, locality, city): the cheapest assignment of the words to components, each used once.

    A street with its kind, a known city, locality or region costs nothing, a name one edit away 0.6, a street
    without kind 1, an unused word 1.5. Spans don't cross commas. An assignment without cost is optimal as
    soon as it is found; only where the plain scan finds none are all of them searched, by a dynamic program
    over word position and set of used components.
    """
    street = kind = loc = city = None
    i, n, free = 0, len(words), True
    while i < n:
        w = words[i]
        if w == ",":
            i += 1
            continue
        nxt = words[i + 1] if i + 1 < n else ","
        if loc is None and nxt != "," and (hit := gaz.locality_forms.get(w + " " + nxt)):
            loc, i = hit, i + 2
        elif loc is None and (hit := gaz.locality_forms.get(w)):
            loc, i = hit, i + 1
        elif street is None and nxt in KIND_OF and w not in KIND_OF:
            street, kind, i = w, KIND_OF[nxt], i + 2
        elif city is None and w in gaz.cities:
            city, i = w, i + 1
        elif w in gaz.regions or w + " " + nxt in gaz.regions:
            i += 1 if w in gaz.regions else 2
        else:
            free = False
            break
    if free:
        return street, kind, loc, city
    best: list[dict[int, tuple[float, Named]]] = [{} for _ in range(n + 1)]
    best[0][0] = (0.0, (None, None, None, None))
    for i in range(n):
        if words[i] == ",":
            options: list[tuple[int, int, float, tuple[int, str, str | None]]] = []
            step = 0.0
        else:
            step = SKIP
            options = []
            for size in (1, 2, 3):
                span = words[i: i + size]
                if len(span) < size or "," in span:
                    break
                text = " ".join(span)
                if text in gaz.regions:
                    options.append((size, 0, 0.0, (9, "", None)))
                if text in gaz.cities:
                    options.append((size, 4, 0.0, (3, text, None)))
                elif size == 1 and (c := gaz.city_near(text)):
                    options.append((size, 4, NEAR, (3, c, None)))
                if hit := gaz.locality_forms.get(text):
                    options.append((size, 2, 0.0, (2, hit, None)))
                elif size <= 2 and (hit := gaz.locality_near(text)):
                    options.append((size, 2, NEAR, (2, hit, None)))
                if size > 1 and span[-1] in KIND_OF and span[0] not in KIND_OF:
                    options.append((size, 1, 0.1 * (size - 2), (0, " ".join(span[:-1]), KIND_OF[span[-1]])))
                elif size == 1 and len(text) > 3 and text not in KIND_OF:
                    options.append((size, 1, BARE, (0, text, None)))
        for mask, (cost, named) in best[i].items():
            if mask not in best[i + 1] or best[i + 1][mask][0] > cost + step:
                best[i + 1][mask] = (cost + step, named)
            for size, bit, more, (slot, value, also) in options:
                if mask & bit:
                    continue
                to, total = mask | bit, cost + more
                if to not in best[i + size] or best[i + size][to][0] > total:
                    if slot == 0:
                        new = (value, also, named[2], named[3])
                    elif slot == 2:
                        new = (named[0], named[1], value, named[3])
                    elif slot == 3:
                        new = (named[0], named[1], named[2], value)
                    else:
                        new = named
                    best[i + size][to] = (total, new)
    return min(best[n].values(), key=lambda x: (x[0], repr(x[1])))[1]


Parts = tuple[str | None, str | None, str | None, str | None, str | None, str | None, str | None]
_unit_name = re.compile(r"\d+[a-z]?|[a-z]\b")


def phrases(text: str) -> set[str]:
    """What read() may look up of a text: its runs of one to three words, and its figures."""
    s = fold(text)
    out = {m[1] + m[2] for m in _post.finditer(s)} | {re.sub(r"\D", "", s), s.strip()}
    for words in (_word.findall(s), re.findall(r"[a-z']+", s)):
        out.update(" ".join(words[i: i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    return out - {""}


def read(text: str | None, gaz: Gazetteer, city: str | None = None, locality: str | None = None, post: str | None = None) -> Parts:
    """(number, street, kind, locality, city, postcode, unit); None for what the text and the hints don't say.

    The street comes as its name alone, in lower case without accents; kind is its normalised type.
    """
    none = (None,) * 7
    if text is None:
        return none
    s = fold(text)
    if s.strip() in JUNK:
        return none
    s = _paren.sub(" ", s).replace(";", ",").replace("|", ",").replace("\n", ",")
    s = _landmark.sub(" ", s)
    code = None
    if m := _post.search(s):
        code = m[1] + m[2]
        s = s[: m.start()] + " , " + s[m.end():]
    unit = None
    if (m := _unit_before.search(s)) and (u := _unit_name.findall(m[0])):
        unit = u[-1]
    s = _unit_after.sub(" , ", _unit_before.sub(" , ", s))
    number = None
    if m := _number.search(s):
        number = str(int(m[1])) + (m[2] or "")
        s = s[: m.start()] + " , " + s[m.end():]
    words: list[str] = []
    for seg in s.split(","):
        if ws := _word.findall(seg):
            words += ws
            words.append(",")
    street, kind, found_loc, found_city = assign(words, gaz)
    if locality:
        f = fold(locality)
        bits = [b.strip() for b in f.split(",")]
        for b in bits:
            t = " ".join(re.findall(r"[a-z']+", b))
            if found_loc is None and (hit := gaz.locality_forms.get(t) or gaz.locality_near(t)):
                found_loc = hit
            elif found_city is None and (t in gaz.cities or gaz.city_near(t)):
                found_city = t if t in gaz.cities else gaz.city_near(t)
    if post and code is None:
        d = re.sub(r"\D", "", post)
        code = d or None
    if found_city is None and city:
        t = fold(city).strip()
        found_city = t if t in gaz.cities else gaz.city_near(t) or t or None
    if code in gaz.by_post:
        c, l = gaz.by_post[code]
        found_city = found_city or c
        if found_loc is None and c == found_city:
            found_loc = l
    return number, street, kind, found_loc, found_city, code, unit
