"""HTML filings: text, links, inline XBRL facts and contexts, with the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SKIPPED = {"script", "style", "nav", "footer", "noscript", "head"}
_BLOCKS = {"p", "div", "section", "article", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "br", "hr", "blockquote"}


class _Markdown(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip = 0
        self.cells: list[str] | None = None
        self.rows = 0
        self.links: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SKIPPED:
            self.skip += 1
        elif self.skip:
            return
        elif re.fullmatch("h[1-6]", tag):
            self.parts.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.parts.append("\n- ")
        elif tag == "tr":
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append("")
        elif tag in _BLOCKS:
            self.parts.append("\n" if tag == "br" else "\n\n")
            if tag == "table":
                self.rows = 0
        if tag == "a" and (href := dict(attrs).get("href")):
            self.links.append(href)

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif self.skip:
            return
        elif tag == "tr" and self.cells is not None:
            if any(c.strip() for c in self.cells):
                self.parts.append("\n| " + " | ".join(" ".join(c.split()) for c in self.cells) + " |")
                if not self.rows:
                    self.parts.append("\n|" + "---|" * len(self.cells))
                self.rows += 1
            self.cells = None
        elif tag in _BLOCKS:
            self.parts.append("\n\n")

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if self.cells is not None:
            if self.cells:
                self.cells[-1] += data
        else:
            self.parts.append(re.sub(r"\s+", " ", data))


def html_to_markdown(html: str) -> tuple[str, list[str]]:
    """Markdown text and link targets; scripts, styles, navigation and comments are dropped, ix: tags unwrapped."""
    p = _Markdown()
    p.feed(html)
    p.close()
    text = re.sub(r"[ \t]+\n", "\n", "".join(p.parts))
    text = re.sub(r"\n[ \t]+(?=\S)", "\n", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip(), p.links


def clean_pages(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, markdown, links) of every page; null pages give an empty text."""
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [html_to_markdown(h or "") for h in pdf[html]]
            yield pd.DataFrame({key: pdf[key], "markdown": [d[0] for d in done], "links": [d[1] for d in done]})

    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, markdown string, links array<string>")


def xbrl_number(raw, scale, sign) -> F.Column:
    """Number of an inline fact: separators and currency signs off, brackets or sign negative, scaled; a dash is null."""
    digits = F.regexp_replace(raw, r"[,$€£\s()]", "")
    value = digits.try_cast("double") * F.pow(F.lit(10.0), F.coalesce(scale, F.lit(0)))
    return F.when(raw.startswith("(") | (F.coalesce(sign, F.lit("")) == "-"), -value).otherwise(value)


class _Facts(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.facts: list[dict] = []
        self.contexts: dict[str, dict] = {}
        self.context: dict | None = None
        self.field = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        name = tag.split(":")[-1]
        if tag in ("ix:nonfraction", "ix:fraction"):
            self.open.append({"tag": a.get("name"), "context_ref": a.get("contextref"), "unit": a.get("unitref"), "scale": a.get("scale"), "sign": a.get("sign"), "decimals": a.get("decimals"), "raw": ""})
        elif name == "context":
            self.context = {"start_date": None, "end_date": None, "instant": None, "dimensions": []}
            self.contexts[a.get("id", "")] = self.context
        elif self.context is not None and name in ("startdate", "enddate", "instant"):
            self.field = {"startdate": "start_date", "enddate": "end_date", "instant": "instant"}[name]
        elif self.context is not None and name == "explicitmember":
            self.context["dimensions"].append(a.get("dimension", "") + "=")
            self.field = "dimensions"

    def handle_endtag(self, tag: str) -> None:
        if tag in ("ix:nonfraction", "ix:fraction") and self.open:
            self.facts.append(self.open.pop())
        elif tag.split(":")[-1] == "context":
            self.context = None
        self.field = ""

    def handle_data(self, data: str) -> None:
        for f in self.open:
            f["raw"] += data
        if self.context is not None and self.field == "dimensions":
            self.context["dimensions"][-1] += data.strip()
        elif self.context is not None and self.field:
            self.context[self.field] = data.strip()


def xbrl_facts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Numeric inline facts with their contexts: value, unit, dates, duration and dimensions."""
    kind = dict(pages.dtypes)[key]
    columns = ["tag", "context_ref", "unit", "scale", "sign", "decimals", "raw", "start_date", "end_date", "instant", "dimensions"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, h in zip(pdf[key], pdf[html], strict=True):
                p = _Facts()
                p.feed(h or "")
                for f in p.facts:
                    c = p.contexts.get(f["context_ref"] or "", {})
                    rows.append((k, *[f.get(x, c.get(x)) for x in columns[:7]], c.get("start_date"), c.get("end_date"), c.get("instant"), c.get("dimensions", [])))
            yield pd.DataFrame(rows, columns=[key, *columns])

    schema = f"{key} {kind}, " + ", ".join(f"{c} string" for c in columns[:-1]) + ", dimensions array<string>"
    f = pages.select(key, html).mapInPandas(run, schema)
    dates = [F.col(c).try_cast("date").alias(c) for c in ("start_date", "end_date", "instant")]
    f = f.select(key, "tag", "context_ref", "unit", "decimals", xbrl_number(F.trim("raw"), F.col("scale").try_cast("int"), F.col("sign")).alias("value"), *dates, "dimensions")
    return f.withColumn("duration_days", F.when(F.col("instant").isNotNull(), 1).otherwise(F.datediff("end_date", "start_date") + 1))
