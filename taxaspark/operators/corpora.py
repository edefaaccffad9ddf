"""Literature, gene reports, web pages and occurrence points, as jobs over stored tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxaspark.functions import exprs
from taxaspark.operators import catalog

#: The first year of interest, works and points returned.
FIRST_YEAR, WORKS, POINTS = 1995, 50, 200
AUTHORS = "array<struct<given:string,family:string>>"


def mention(name: str, level: str = "species") -> str:
    """Pattern of a binomial, or of its genus, as whole words."""
    parts = [re.escape(p) for p in re.split(r"[_\s]+", name.strip()) if p]
    return r"(?i)\b" + (parts[0] if level == "genus" else r"\s+".join(parts[:2])) + r"\b" if parts else r"$^"


def mentions(df: DataFrame, name: str, level: str = "species", columns: tuple[str, ...] = ("title", "abstract")) -> DataFrame:
    """Works whose title or abstract names the species (or genus)."""
    pattern = mention(name, level)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).cast("string").rlike(pattern), F.lit(False))
    return df.filter(hit)


def publication_year(*dates: Column) -> Column:
    """First usable year of nested date parts (array of arrays)."""
    return F.coalesce(*[F.get(F.get(d, F.lit(0)), F.lit(0)).try_cast("int") for d in dates])


def works_filter(df: DataFrame, first_year: int = FIRST_YEAR, limit: int = WORKS, relevance: str = "relevance") -> DataFrame:
    """Journal articles with an abstract since a year, the most relevant first."""
    return df.filter((F.col("year") >= first_year) & (F.col("type") == "journal-article") & exprs.not_blank(F.col("abstract"))).orderBy(F.desc(relevance), "DOI").limit(limit)


def normalize_works(df: DataFrame) -> DataFrame:
    """(doi, url, title, authors, journal, year, volume, issue, page) with defaults for what is missing."""
    title = exprs.sentence_case(exprs.decode_entities(F.get("title", F.lit(0))))
    name = lambda a: exprs.author_case(F.concat_ws(" ", a["given"], a["family"]))
    return df.select(
        F.col("DOI").alias("doi"), exprs.doi_url(F.col("DOI")).alias("url"), F.coalesce(title, F.lit("Untitled")).alias("title"),
        F.coalesce(F.transform("author", name), F.array().cast("array<string>")).alias("authors"),
        F.coalesce(F.get("container-title", F.lit(0)), F.lit("Unknown Journal")).alias("journal"), publication_year(F.col("published.date-parts")).alias("year"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("volume", "issue", "page")],
    )


def works_by_year(df: DataFrame, fields: tuple[str, ...] = ("doi", "title")) -> DataFrame:
    """(year, n, works): latest first, works without a year last as "Unknown Year"."""
    label = F.coalesce(F.col("year").cast("string"), F.lit("Unknown Year"))
    grouped = df.groupBy(label.alias("year")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(*fields))).alias("works"))
    return grouped.orderBy(F.desc_nulls_last(F.col("year").try_cast("int")))


GENES = "struct<report:array<struct<gene_type:string,count:string>>,gene_counts:array<struct<gene_type:string,count:string>>>"


def gene_counts(df: DataFrame, column: str = "json", key: str = "species") -> DataFrame:
    """(key, gene_type, count, label, category) from reports; of a repeated type the last entry
    counts, a missing type is "unknown", a count that isn't a number 0."""
    parsed = F.from_json(column, GENES)
    entries = df.select(key, F.posexplode(F.coalesce(parsed["gene_counts"], parsed["report"])).alias("pos", "e"))
    kind = F.coalesce("e.gene_type", F.lit("unknown"))
    last = entries.groupBy(key, kind.alias("gene_type")).agg(F.max_by(F.coalesce(F.col("e.count").try_cast("long"), F.lit(0)), "pos").alias("count"))
    return last.withColumns({"label": exprs.gene_type_label(F.col("gene_type")), "category": exprs.gene_category(F.col("gene_type"))})


def gene_categories(counts: DataFrame, key: str = "species") -> DataFrame:
    return counts.groupBy(key, "category").agg(F.sum("count").alias("n_genes"))


def occurrence_points(df: DataFrame, limit: int = POINTS) -> DataFrame:
    """Up to ``limit`` located records of each species, by id; the limit is a map's. Records marked
    by hasGeospatialIssue, where there is such a column, are left out."""
    if "hasGeospatialIssue" in df.columns:
        df = df.filter(~F.coalesce("hasGeospatialIssue", F.lit(False)))
    rank = F.row_number().over(W.partitionBy("species").orderBy("img_id"))
    return catalog.valid_coords(df).withColumn("rank", rank).filter(F.col("rank") <= limit)


class _Sections(HTMLParser):
    """Splits a page at its headings; tables are parts of their own."""

    SKIPPED = ("script", "style", "nav", "footer", "head", "noscript")
    SKIPPED_CLASSES = ("mw-editsection", "taxobox-edit-taxonomy", "stub", "metadata", "noprint", "ad")
    SKIPPED_IDS = ("catlinks",)
    #: Of boxes of links only those with this heading are a part, with their rows' second cells.
    BOX, BOX_HEADING = "navbox", re.compile(r"(?i)taxon identifiers?")
    #: Elements that part words.
    APART = ("p", "li", "tr", "td", "th", "div", "h3", "h4", "table")
    VOID = ("br", "hr", "img", "input", "link", "meta", "wbr", "area", "base", "col", "embed", "source", "track", "param")

    def __init__(self, heading: str, root: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.heading, self.root, self.found = heading, root, []
        self.title, self.text, self.html, self.in_heading = "", [], [], False
        self.kind, self.skip = "section", root is not None
        self.open: list[_Open] = []
        self.box, self.cells, self.cell = 0, [], 0
        self.part = 0

    def close_part(self) -> None:
        """Ends a part; its elements that are still open are closed in its html, not in the next one's."""
        self.html += [f"</{e.tag}>" for e in reversed(self.open) if e.part == self.part]
        text = " ".join("".join(self.text).split())
        if text or (self.kind == "section" and self.title):
            self.found.append((self.kind, self.title.strip(), text, "".join(self.html)))
        self.text, self.html = [], []
        self.part += 1

    def close_box(self) -> None:
        """A box of identifiers: the second cell of each row, repeats dropped."""
        plain = [(n, " ".join("".join(parts).split())) for n, parts in self.cells]
        if any(self.BOX_HEADING.search(t) for _, t in plain):
            second = dict.fromkeys(t for n, t in plain if n == 2 and t)
            self.found.append(("identifiers", "", " · ".join(second), "<p>".join(f"<span>{escape(t, False)}</span>" for t in second)))

    def handle_starttag(self, tag, attrs):
        seen = not self.skip and not self.box
        if tag in self.VOID:
            if seen:
                self.text.append(" ")
                self.html.append(self.get_starttag_text())
            return
        found = dict(attrs)
        names = (found.get("class") or "").split()
        hidden = tag in self.SKIPPED or any(c in self.SKIPPED_CLASSES for c in names) or found.get("id") in self.SKIPPED_IDS
        boxed = self.BOX in names and not self.skip
        entry = _Open(tag, int(hidden), boxed)
        self.open.append(entry)
        self.skip += hidden
        if self.root in names and self.root is not None:
            self.root = None  # the first one's content is the page
            entry.shown, self.skip = 1, self.skip - 1
            return
        if boxed and not self.box:
            self.cells, self.cell = [], 0
        self.box += boxed
        if self.box:
            if tag == "tr":
                self.cell = 0
            elif tag in ("td", "th", "caption"):
                self.cell += tag != "caption"
                self.cells.append((self.cell, []))
            return
        if self.skip:
            self.text += " " * (tag in self.APART)
            return
        if tag == self.heading:
            self.close_part()
            self.title, self.in_heading = "", True
            return
        if tag == "table" and self.kind == "section":
            self.close_part()
            self.kind, entry.table = "infobox" if "infobox" in names else "table", True
        elif tag in self.APART:
            self.text.append(" ")
        if not self.in_heading:
            entry.part = self.part
            self.html.append(self.get_starttag_text())

    def handle_endtag(self, tag):
        if not any(e.tag == tag for e in self.open):
            return
        while self.open:
            e = self.open.pop()
            self.skip += e.shown - e.hidden
            self.box -= e.boxed
            if e.boxed and not self.box:
                self.close_box()
            elif e.tag == self.heading and not self.box:
                self.in_heading = False
            self.text += " " * (e.tag in self.APART and not self.in_heading and not self.box)
            if e.part == self.part:
                self.html.append(f"</{e.tag}>")
            if e.table:
                self.close_part()
                self.kind = "section"
            if e.tag == tag:
                break

    def handle_data(self, data):
        if self.skip:
            return
        if self.box:
            if self.cells:
                self.cells[-1][1].append(data)
        elif self.in_heading:
            self.title += data
        else:
            self.text.append(data)
            self.html.append(escape(data, False))


@dataclass
class _Open:
    """An open element: whether it hides what it holds or shows what was hidden, is a box, is a table
    that is a part, and the part whose html its start tag is in."""

    tag: str
    hidden: int
    boxed: bool
    shown: int = 0
    table: bool = False
    part: int = -1


def split_page(html: str | None, heading: str = "h2", root: str | None = None) -> list[tuple[str, str, str, str]]:
    """(type, title, text, html) of a page's parts in order; parts that repeat stay. With ``root`` only
    of what the first element of that class holds, nothing if there is none."""
    parser = _Sections(heading, root)
    parser.feed(html or "")
    parser.close()
    parser.close_part()
    return parser.found


def page_sections(df: DataFrame, heading: str = "h2", key: str = "page_id", html: str = "html", root: str | None = None) -> DataFrame:
    """(key, pos, type, title, text, html): a row for each part of each page; see :func:`split_page`.
    The part before the first heading has no title; null and empty pages have no parts."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, pos, *part) for i, page in zip(pdf[key], pdf[html], strict=True) for pos, part in enumerate(split_page(page, heading, root))]
            yield pd.DataFrame(rows, columns=[key, "pos", "type", "title", "text", "html"])

    return df.select(key, html).mapInPandas(run, f"{key} {kind}, pos int, type string, title string, text string, html string")
