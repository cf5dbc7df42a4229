"""Journal articles in JATS-like XML to rows: metadata, sections, figures, tables (tree walking in Arrow batches)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = (
    "pmc_id string, article_type string, title string, abstract string, body_preview string, "
    "sections array<struct<title:string,text:string>>, "
    "figures array<struct<fig_id:string,label:string,caption:string,hrefs:array<string>>>, "
    "tables array<struct<table_id:string,label:string,caption:string,content:string>>"
)
PREVIEW = 3000


def tag(element) -> str:
    name = element.tag if isinstance(element.tag, str) else ""
    return name.rpartition("}")[2]


def squeezed_text(element) -> str:
    """Inner text with whitespace collapsed at every level."""
    if element is None:
        return ""
    parts = [element.text or ""]
    for child in element:
        parts += [squeezed_text(child), child.tail or ""]
    return re.sub(r"\s+", " ", "".join(parts)).strip()


def _all(root, name: str) -> list:
    return [e for e in root.iter() if tag(e) == name]


def _first(root, name: str):
    return next((e for e in root.iter() if tag(e) == name), None)


def pipe_table(wrap) -> str:
    rows = [" | ".join(squeezed_text(c) for c in row if tag(c) in ("th", "td")) for row in _all(wrap, "tr")]
    return "\n".join(r for r in rows if r)


def _flowing(element) -> str:
    """Headings and paragraphs of a section; figures become a placeholder with their label."""
    out = []
    for child in element:
        name = tag(child)
        if name == "fig":
            out.append(f"[{squeezed_text(_first(child, 'label')) or 'Figure'}]")
        elif name == "table-wrap":
            out.append(f"[{squeezed_text(_first(child, 'label')) or 'Table'}]")
        elif name == "sec":
            out.append(_flowing(child))
        elif name != "fig-group":
            out.append(squeezed_text(child))
    return "\n".join(x for x in out if x)


def parse_article(xml: str | bytes | None, pmc_id: str | None = None) -> dict | None:
    """One article as a dict of ``SCHEMA``; null if the XML doesn't parse.  Of equal keys the last one stays."""
    if not xml:
        return None
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return None
    article = root if tag(root) == "article" else _first(root, "article")
    figures, tables = {}, {}
    for fig in _all(root, "fig"):
        label = squeezed_text(_first(fig, "label"))
        key = fig.get("id") or label.replace(" ", "_")
        if key:
            links = [next((v for k, v in g.attrib.items() if k.rpartition("}")[2] == "href"), "") for g in _all(fig, "graphic")]
            figures[key] = {"fig_id": key, "label": label, "caption": squeezed_text(_first(fig, "caption")), "hrefs": [x for x in links if x]}
    for i, wrap in enumerate(_all(root, "table-wrap")):
        label = squeezed_text(_first(wrap, "label"))
        key = wrap.get("id") or label or f"table_{i + 1}"
        tables[key] = {"table_id": key, "label": label, "caption": squeezed_text(_first(wrap, "caption")), "content": pipe_table(wrap)}
    abstract, body = squeezed_text(_first(root, "abstract")), _first(root, "body")
    sections = [{"title": "ABSTRACT", "text": abstract}] if abstract else []
    for i, sec in enumerate([s for s in body if tag(s) == "sec"] if body is not None else []):
        heading = next((squeezed_text(c) for c in sec if tag(c) == "title"), "") or f"Section {i + 1}"
        text = _flowing(sec)
        if text.strip():
            sections.append({"title": f"BODY: {heading}", "text": text})
    return {
        "pmc_id": pmc_id, "article_type": (article.get("article-type") if article is not None else None) or "", "title": squeezed_text(_first(root, "article-title")),
        "abstract": abstract, "body_preview": squeezed_text(body)[:PREVIEW], "sections": sections, "figures": list(figures.values()), "tables": list(tables.values()),
    }


def articles(files: DataFrame, pmc_id: str = "pmc_id", xml: str = "xml") -> DataFrame:
    """``SCHEMA`` rows of a table of documents; documents that don't parse give no row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parsed = [parse_article(x, i) for i, x in zip(frame[pmc_id], frame[xml])]
            yield pd.DataFrame([p for p in parsed if p], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.select(pmc_id, xml).mapInPandas(run, SCHEMA)
