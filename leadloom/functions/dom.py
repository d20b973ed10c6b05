"""Signals that need a parsed page: ancestors of links, labels around fields. The one place where HTML is parsed."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SIGNALS = "footer_mail int, mail int, fields int, wrapped_fields int, headings int, depth int"


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.n = dict.fromkeys(("footer_mail", "mail", "fields", "wrapped_fields", "headings", "depth"), 0)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if tag == "a" and (a.get("href") or "").startswith("mailto:"):
            self.n["mail"] += 1
            self.n["footer_mail"] += "footer" in self.open
        if tag in ("input", "select", "textarea") and a.get("type") != "hidden":
            self.n["fields"] += 1
            self.n["wrapped_fields"] += "label" in self.open
        if tag == "h1":
            self.n["headings"] += 1
        if tag not in VOID:
            self.open.append(tag)
            self.n["depth"] = max(self.n["depth"], len(self.open))

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            while self.open.pop() != tag:
                pass


def page_signals(html: str | None) -> dict[str, int]:
    """Counts over one page; a null or empty page has none."""
    r = _Reader()
    if html:
        r.feed(html)
        r.close()
    return r.n


def dom_signals(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, signals) of pages (key, html), in Arrow batches."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([page_signals(h) for h in b["html"]], columns=["footer_mail", "mail", "fields", "wrapped_fields", "headings", "depth"])
            out.insert(0, key, b[key].to_numpy())
            yield out

    return pages.select(key, "html").mapInPandas(run, f"{key} {kind}, {SIGNALS}")
