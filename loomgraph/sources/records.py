"""Parsers of one document's text: graph records of each format, as plain rows.

A record is (src, dst, relation, label, node_type, weight): a node where the
relation is null, else an edge.  These are the helpers of the data sources
(:mod:`datasources`), which read files outside the JVM; texts that are already
columns are parsed by the expressions of :mod:`formats`, and tests hold the two
against each other.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

from loomgraph.sources.formats import LIGHT_MARKERS, TYPES
from loomgraph.sources.scopes import FileScan

Record = tuple[str | None, str | None, str | None, str | None, int | None, float | None]


def _node(external_id: str, label: str | None, kind: int) -> Record:
    return external_id, None, None, label, kind, None


def _edge(src: str, dst: str, relation: str, weight: float = 1.0) -> Record:
    return src, dst, relation, None, None, weight


def bibtex(path: str, text: str) -> Iterator[Record]:
    for entry in re.findall(r"@\w+\s*\{.*?\n\}", text, re.S):

        def value(name: str, entry: str = entry) -> str:
            for form in (r"\{((?:[^{}]|\{[^{}]*\})*)\}", r'"([^"]*)"', r"(\d+)"):
                if (m := re.search(rf"\b{name}\s*=\s*{form}", entry, re.I | re.S)) and m[1]:
                    return re.sub(r"[{}\s]+", " ", m[1]).strip(" ")
            return ""

        key = re.match(r"@\w+\s*\{\s*([^,\s]+)", entry)
        me = f"bib::{key[1] if key else ''}"
        yield _node(me, value("title"), 0)
        for name in re.split(r"\s+and\s+", value("author")):
            if name:
                yield _node(f"author::{name.lower()}", name, 9)
                yield _edge(me, f"author::{name.lower()}", "authored_by")
        if venue := value("journal") or value("booktitle"):
            yield _node(f"venue::{venue.lower()}", venue, 9)
            yield _edge(me, f"venue::{venue.lower()}", "published_in")


def crossref(path: str, text: str) -> Iterator[Record]:
    """One work, or a work a line."""
    try:
        work = json.loads(text).get("message") or {}
    except (ValueError, AttributeError):
        lines = text.splitlines()
        for line in lines if len(lines) > 1 else []:
            yield from crossref(path, line)
        return
    me = f"doi::{str(work.get('DOI') or '').lower()}"
    yield _node(me, next(iter(work.get("title") or []), None), 0)
    for a in work.get("author") or []:
        yield _edge(me, "author::" + " ".join(x for x in (a.get("given"), a.get("family")) if x).lower(), "authored_by")
    for c in work.get("container-title") or []:
        yield _edge(me, f"venue::{c.lower()}", "published_in")
    for r in work.get("reference") or []:
        if r.get("DOI"):
            yield _edge(me, f"doi::{r['DOI'].lower()}", "cites")


def _texts(xml: str, tag: str) -> list[str]:
    return [re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", x)).strip() for x in re.findall(rf"<{tag}\b[^>]*>(.*?)</{tag}>", xml, re.I | re.S)]


def _attributes(xml: str, tag: str, name: str) -> list[str]:
    return re.findall(rf'<{tag}\b[^>]*\b{name}\s*=\s*"([^"]*)"', xml, re.I | re.S)


def _first(values: list[str]) -> str:
    return values[0] if values else ""


def _dois(xml: str, tag: str) -> list[str]:
    return re.findall(rf'<{tag}[^>]*pub-id-type="doi"[^>]*>(.*?)</{tag}>', xml, re.I | re.S)


#: XML dialects: the record's element, its name, its title's element, and its lists by relation.
DIALECTS: dict[str, tuple[str, Callable[[str], str], str, dict[str, Callable[[str], list[str]]]]] = {
    "jats": ("article", lambda x: f"doi::{_first(_dois(x, 'article-id')).lower()}", "article-title",
             {"authored_by": lambda x: _texts(x, "surname"), "published_in": lambda x: _texts(x, "journal-title"), "cites": lambda x: _dois(x, "pub-id")}),
    "patent": ("us-patent-grant", lambda x: f"patent::{_first(_texts(x, 'doc-number'))}", "invention-title",
               {"cites": lambda x: _texts(x, "doc-number")[1:], "assigned_to": lambda x: _texts(x, "orgname"), "classified_as": lambda x: _texts(x, "main-classification")}),
    "rfc": ("rfc", lambda x: f"rfc::{_first(_attributes(x, 'rfc', 'number'))}", "title",
            {"authored_by": lambda x: _attributes(x, "author", "fullname"), "references": lambda x: _attributes(x, "reference", "anchor"),
             "obsoletes": lambda x: re.split(r",\s*", _first(_attributes(x, "rfc", "obsoletes"))), "updates": lambda x: re.split(r",\s*", _first(_attributes(x, "rfc", "updates")))}),
}


def _xml(dialect: str) -> Callable[[str, str], Iterator[Record]]:
    def parse(path: str, text: str) -> Iterator[Record]:
        tag, identify, title, relations = DIALECTS[dialect]
        for x in re.findall(rf"<{tag}\b.*?</{tag}>", text, re.I | re.S):
            me = identify(x)
            yield _node(me, next(iter(_texts(x, title)), None), 0)
            for relation, values in relations.items():
                for v in values(x):
                    if v:
                        yield _edge(me, v, relation)

    return parse


def light(path: str, text: str) -> Iterator[Record]:
    for marker, value in re.findall(r"\[\s*(\w+)\s*:([^\]]+)\]", text):
        if relation := LIGHT_MARKERS.get(marker.lower()):
            yield _edge(f"light::{path}", value.strip(), relation)


def descriptor(path: str, text: str) -> Iterator[Record]:
    try:
        d = json.loads(text)
    except ValueError:
        return
    for n in d.get("nodes") or []:
        yield _node(n["id"], n.get("label") or n["id"], TYPES.get((n.get("type") or "").lower(), 100))
    for e in d.get("edges") or []:
        yield _edge(e["source"], e["target"], e.get("relation") or "relates_to", 1.0 if e.get("weight") is None else float(e["weight"]))


def code(path: str, text: str) -> Iterator[Record]:
    scan = FileScan(path, text).run()
    for n in scan.nodes.values():
        yield _node(n["id"], n["label"], n["type"])
    for (src, dst, relation), (weight, _) in scan.edges.items():
        yield _edge(src, dst, relation, weight)


PARSERS: dict[str, Callable[[str, str], Iterator[Record]]] = {
    "bibtex": bibtex, "crossref": crossref, **{name: _xml(name) for name in DIALECTS}, "light": light, "descriptor": descriptor, "code": code,
}

#: Names of files of each format.
PATTERNS = {"bibtex": r"\.bib$", "crossref": r"\.json$", "jats": r"\.(xml|nxml)$", "patent": r"\.xml$", "rfc": r"\.xml$", "light": r"\.(md|markdown)$", "descriptor": r"\.json$", "code": r"\.\w+$"}
