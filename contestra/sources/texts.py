"""Sources in text formats: delimited files, JSON registries, feeds, article bodies, fields and addresses in pages."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.scalars import normalize_name

# Least block length and number of links that make a block navigation; elements without article text.
LEAST_BLOCK, LINKS_OF_NAVIGATION = 12, 4
SKIPPED = frozenset({"nav", "aside", "script", "style", "footer", "header", "form"})
BLOCKS = frozenset({"p", "h1", "h2", "h3", "h4", "li", "blockquote", "td"})
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"


def delimited(spark: SparkSession, path: str, sep: str = ";", required: tuple[str, ...] = ()) -> DataFrame:
    """Text columns of delimited files with a header (S01, S02): quoted cells may hold separators, doubled quotes and
    line breaks. Missing cells are empty, rows of only empty cells go, absent required columns raise ValueError.

    Quoted line breaks keep a file in one task; large inputs come as many files.
    """
    df = spark.read.csv(path, sep=sep, header=True, quote='"', escape='"', multiLine=True, mode="PERMISSIVE").fillna("")
    if absent := [c for c in required if c not in df.columns]:
        raise ValueError(f"columns missing: {', '.join(absent)}")
    return df.where(F.trim(F.concat_ws("", *[F.col(f"`{c}`") for c in df.columns])) != "")


def unique_dimension(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(df with its key in lower case, keys that occur more than once)."""
    rows = df.withColumn(key, F.lower(F.trim(F.col(key))))
    return rows, rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """(slug, alias) of a JSON array of {slug, name, aliases}; the name is an alias too."""
    df = spark.read.json(path, schema="slug string, name string, aliases array<string>", multiLine=True)
    names = F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("name"))
    return df.select("slug", F.explode(names).alias("a")).select("slug", normalize_name(F.col("a")).alias("alias")).where("alias <> ''").distinct()


def newer_rows(base: DataFrame, extra: DataFrame, date: str) -> DataFrame:
    """base and those rows of extra that are later than everything in base (S18); columns that one lacks are null."""
    last = base.agg(F.max(date).alias("__last"))
    late = extra.join(F.broadcast(last), F.col("__last").isNull() | (F.col(date) > F.col("__last"))).drop("__last")
    return base.unionByName(late, allowMissingColumns=True)


def feed_items(bodies: DataFrame, body: str, hosts: tuple[str, ...]) -> DataFrame:
    """(title, url, summary, published) of RSS and Atom bodies, one row a url, links on the given hosts only.

    Bodies that aren't XML, and null ones, give nothing. Of equal urls the smallest (title, summary, published) stays.
    """

    def items(text: str | None):
        try:
            root = ET.fromstring(text or "")
        except ET.ParseError:
            return
        for node in root.iter():
            if node.tag.split("}")[-1] not in ("item", "entry"):
                continue
            got = {}
            for c in node:
                tag = c.tag.split("}")[-1]
                got.setdefault(tag, " ".join((c.get("href") if tag == "link" and c.get("href") else "".join(c.itertext())).split()))
            url = got.get("link", "")
            try:
                host = (urlsplit(url).hostname or "").removeprefix("www.")
            except ValueError:
                continue
            if host in hosts:
                yield got.get("title", ""), url, got.get("description") or got.get("summary") or "", got.get("pubDate") or got.get("published") or got.get("updated") or ""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([i for t in p[body] for i in items(t)], columns=["title", "url", "summary", "published"])

    rows = bodies.select(body).mapInPandas(batches, "title string, url string, summary string, published string")
    return rows.groupBy("url").agg(F.min(F.struct("title", "summary", "published")).alias("i")).select("i.title", "url", "i.summary", "i.published")


class _Article(HTMLParser):
    def __init__(self):
        super().__init__()
        self.depth, self.links, self.text, self.blocks = 0, 0, [], []

    def flush(self):
        block = " ".join("".join(self.text).split())
        if len(block) >= LEAST_BLOCK and self.links < LINKS_OF_NAVIGATION and block not in self.blocks:
            self.blocks.append(block)
        self.links, self.text = 0, []

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.depth += 1
        elif not self.depth:
            if tag in BLOCKS:
                self.flush()
            self.links += tag == "a"

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.depth = max(0, self.depth - 1)
        elif tag in BLOCKS and not self.depth:
            self.flush()

    def handle_data(self, data):
        if not self.depth:
            self.text.append(data)


@F.pandas_udf(StringType())
def article_text(html: pd.Series) -> pd.Series:
    """Blocks of an article, each once, without navigation; null stays null."""

    def one(h):
        if h is None:
            return None
        p = _Article()
        p.feed(h)
        p.close()
        p.flush()
        return "\n".join(p.blocks)

    return html.map(one)


def versus_pairs(df: DataFrame, key: str, title: str) -> DataFrame:
    """(key, a, b) from titles like 'A vs. B'; each unordered pair once per key, titles with other than two sides go."""
    sides = F.transform(F.split(F.coalesce(title, F.lit("")), r"(?i)\s+(?:vs?\.?|versus)\s+"), lambda s: F.trim(s))
    rows = df.select(key, sides.alias("s")).where((F.size("s") == 2) & (F.element_at("s", 1) != "") & (F.element_at("s", 2) != ""))
    pair = F.array_sort(F.array(normalize_name(F.element_at("s", 1)), normalize_name(F.element_at("s", 2))))
    return rows.groupBy(key, pair.alias("__p")).agg(F.min("s").alias("s")).where("__p[0] <> __p[1]").select(key, F.col("s")[0].alias("a"), F.col("s")[1].alias("b"))


def infobox_field(wikitext: Column, field: str) -> Column:
    """The trimmed value of `| field = value` in a wikitext infobox, or null."""
    return F.nullif(F.trim(F.regexp_extract(wikitext, rf"(?im)^\s*\|\s*{field}\s*=[ \t]*([^\n|]*)", 1)), F.lit(""))


def public_emails(html: Column) -> Column:
    """Sorted distinct addresses in lower case; null: none."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(html, F.lit(""))), F.lit(EMAIL), F.lit(0))))
