"""Table functions over pages: lists of papers, result tables, TEI affiliations."""

from __future__ import annotations

import html.parser
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = {"br", "img", "hr", "meta", "link", "input", "wbr"}


class _Tree(html.parser.HTMLParser):
    """A plain tree: nodes [tag, attributes, children], texts as strings."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: list = ["", {}, []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = [tag, {k: v or "" for k, v in attrs}, []]
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        self.open[-1][2].append(data)


def tree(page: str) -> list:
    parser = _Tree()
    parser.feed(page or "")
    parser.close()
    return parser.root


def walk(node: list) -> Iterator[list]:
    for child in node[2]:
        if not isinstance(child, str):
            yield child
            yield from walk(child)


def text(node: list) -> str:
    parts = [c if isinstance(c, str) else text(c) for c in node[2]]
    return re.sub(r"\s+", " ", "".join(parts)).strip()


def has_class(node: list, name: str) -> bool:
    return name in node[1].get("class", "").split()


def names(line: str) -> list[str]:
    return [n.strip() for n in re.split(r",|;|\band\b", line) if n.strip()]


def proceedings(page: str) -> list[dict]:
    """Blocks of class `paper` with a title, authors and links to a page and a PDF."""
    found = []
    for block in (n for n in walk(tree(page)) if has_class(n, "paper")):
        of = lambda c: next((text(n) for n in walk(block) if has_class(n, c)), "")  # noqa: E731, B023
        hrefs = [n[1]["href"] for n in walk(block) if n[0] == "a" and n[1].get("href")]
        url, pdf = next((h for h in hrefs if h.endswith(".html")), None), next((h for h in hrefs if h.endswith(".pdf")), None)
        if of("title") and url:
            found.append({"paper_id": url.rsplit("/", 1)[-1].removesuffix(".html"), "title": of("title"), "authors": names(of("authors")), "track": None, "doi": None, "official_url": url, "pdf_url": pdf})
    return found


def anthology(page: str, volume: str) -> list[dict]:
    """Links to papers /volume.N/ of an anthology; 0 is front matter; the first link of an id counts."""
    found: dict[str, dict] = {}
    for n in walk(tree(page)):
        if n[0] == "a" and (m := re.search(rf"/({re.escape(volume)}\.(\d+))/?$", n[1].get("href", ""))) and m[2] != "0" and text(n) and m[1] not in found:
            found[m[1]] = {"paper_id": m[1], "title": text(n), "authors": [], "track": None, "doi": f"10.18653/v1/{m[1]}", "official_url": n[1]["href"], "pdf_url": None}
    return list(found.values())


def track_list(page: str) -> list[dict]:
    """List entries with a track, a titled link and authors; id and PDF follow from the link."""
    found = []
    for item in (n for n in walk(tree(page)) if n[0] == "li" and n[1].get("data-track")):
        link = next((n for n in walk(item) if n[0] == "a" and n[1].get("href")), None)
        people = next((text(n) for n in walk(item) if has_class(n, "paper-authors")), "")
        if link and text(link):
            url = link[1]["href"]
            found.append({"paper_id": url.rsplit("/", 1)[-1].split("-Abstract", 1)[0], "title": text(link), "authors": names(people), "track": item[1]["data-track"], "doi": None, "official_url": url, "pdf_url": url.replace("/hash/", "/file/").replace("-Abstract-", "-Paper-").replace(".html", ".pdf")})
    return found


def cycle_tables(page: str) -> list[dict]:
    """Tables of accepted papers, the first of February, the others of August: a cell of title, a cell of
    authors as `name (affiliation);`."""
    found = []
    for k, table in enumerate(n for n in walk(tree(page)) if n[0] == "table"):
        for row in (n for n in walk(table) if n[0] == "tr"):
            cells = [n for n in walk(row) if n[0] == "td"]
            if len(cells) < 2 or not text(cells[0]):
                continue
            whole = " ".join([text(c) for c in cells] + [n[1].get("href", "") for n in walk(row) if n[0] == "a"])
            doi = re.search(r"10\.\d{4,}/[^\s\"<>]+", whole)
            people = [p.strip() for p in re.split(r";", text(cells[1])) if p.strip()]
            found.append({"paper_id": (doi[0] if doi else re.sub(r"\W+", "-", text(cells[0]).lower()).strip("-")), "title": text(cells[0]), "authors": [re.sub(r"\s*\(.*\)\s*$", "", p) for p in people], "track": "february" if k == 0 else "august", "doi": doi[0].lower() if doi else None, "official_url": None, "pdf_url": None})
    return found


def official_affiliations(page: str) -> list[tuple[str, list[str]]]:
    """(doi, affiliations in brackets) of the tables of `cycle_tables`."""
    found = []
    for row in (n for n in walk(tree(page)) if n[0] == "tr"):
        cells = [n for n in walk(row) if n[0] == "td"]
        doi = re.search(r"10\.\d{4,}/[^\s\"<>]+", " ".join([text(c) for c in cells] + [n[1].get("href", "") for n in walk(row) if n[0] == "a"]))
        if len(cells) >= 2 and doi:
            found.append((doi[0].lower(), re.findall(r"\(([^()]+)\)", text(cells[1]))))
    return found


def ranked_table(page: str, cells: int = 6) -> list[list[str]]:
    """Rows of exactly so many cells."""
    rows = [[text(c) for c in walk(r) if c[0] == "td"] for r in walk(tree(page)) if r[0] == "tr"]
    return [r for r in rows if len(r) == cells]


def tei_affiliations(document: str) -> list[tuple[str, str | None]]:
    """(organisation names joined, country code) of a TEI document; the last of equal ones counts."""
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    found: dict[tuple[str, str | None], None] = {}
    for a in (e for e in ET.fromstring(document).iter() if local(e) == "affiliation"):
        orgs = list(dict.fromkeys(t for e in a.iter() if local(e) == "orgName" and (t := " ".join("".join(e.itertext()).split()))))
        code = next((e.get("key").upper() for e in a.iter() if local(e) == "country" and e.get("key")), None)
        if orgs:
            found.pop(("; ".join(orgs), code), None)
            found["; ".join(orgs), code] = None
    return list(found)


PAPER_ROW = "paper_id string, title string, authors array<string>, track string, doi string, official_url string, pdf_url string"


def papers_of_pages(pages: DataFrame, kind: str, html_column: str = "html", volume: str = "") -> DataFrame:
    """Papers (page columns, then paper columns) of pages of a kind: proceedings, anthology, track_list or
    cycle_tables. Null pages give none."""
    parse = {"proceedings": proceedings, "anthology": lambda p: anthology(p, volume), "track_list": track_list, "cycle_tables": cycle_tables}[kind]
    kept = [c for c in pages.columns if c != html_column]
    fields = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in kept)

    def each(frames):
        for frame in frames:
            rows = [{**{c: getattr(r, c) for c in kept}, **paper} for r in frame.itertuples(index=False) for paper in parse(getattr(r, html_column) or "")]
            yield pd.DataFrame(rows, columns=[*kept, "paper_id", "title", "authors", "track", "doi", "official_url", "pdf_url"])

    return pages.mapInPandas(each, ", ".join(filter(None, [fields, PAPER_ROW])))


def systems_of_pages(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """Rows (rank, system, country, cores, rmax, power) of ranked tables, thousands commas dropped."""
    cells = F.pandas_udf(lambda pages: pages.map(lambda p: ranked_table(p or "")), "array<array<string>>")
    from corvelo.functions.text import number

    r = pages.select(F.explode(cells(html_column)).alias("c"))
    return r.select(number(F.col("c")[0]).cast("int").alias("rank"), F.col("c")[1].alias("system"), F.col("c")[2].alias("country"), number(F.col("c")[3]).cast("bigint").alias("cores"), number(F.col("c")[4]).alias("rmax"), number(F.col("c")[5]).alias("power"))


def affiliations_of_tei(documents: DataFrame, column: str = "xml") -> DataFrame:
    """Affiliations (other columns, institution_name, country_code) of TEI documents; null and malformed ones
    give none."""

    def one(document: str | None) -> list[dict]:
        try:
            return [{"institution_name": n, "country_code": c} for n, c in tei_affiliations(document)] if document else []
        except ET.ParseError:
            return []

    parse = F.pandas_udf(lambda documents: documents.map(one), "array<struct<institution_name:string,country_code:string>>")
    return documents.select(*[c for c in documents.columns if c != column], F.explode(parse(column)).alias("a")).select("*", "a.*").drop("a")


def zip_chart(lines: list[str], axis: str) -> list[tuple[str, float]]:
    """Labels with values of a chart's text: numbers before the axis line, labels after it; raises where their
    numbers differ."""
    at = lines.index(axis)
    values = [float(v.replace(",", "")) for v in lines[:at] if re.fullmatch(r"[\d.,]+", v)]
    labels = [v for v in lines[at + 1 :] if v]
    if len(labels) != len(values):
        raise ValueError("labels and values differ in number")
    return list(zip(labels, values))


def issue_articles(page: str, doi_prefix: str) -> list[dict]:
    """Articles of a journal issue: entries of class obj_article_summary in the main section, with title,
    authors, and a DOI made of a prefix and the article's number."""
    found = []
    for block in (n for n in walk(tree(page)) if has_class(n, "obj_article_summary")):
        link = next((n for k in walk(block) if has_class(k, "title") for n in [*walk(k), k] if n[0] == "a" and n[1].get("href")), None)
        if link and (m := re.search(r"/view/(\d+)", link[1]["href"])):
            people = next((text(n) for n in walk(block) if has_class(n, "authors")), "")
            found.append({"paper_id": m[1], "title": text(link), "authors": names(people), "track": "main", "doi": f"{doi_prefix}.{m[1]}", "official_url": link[1]["href"], "pdf_url": None})
    return found
