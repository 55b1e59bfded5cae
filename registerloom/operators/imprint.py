"""Companies' imprint pages: addresses, ranking of pages, context for the extractor, outcomes."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def candidates(companies: DataFrame) -> DataFrame:
    """company, pos, url: addresses to try, in order."""
    return companies.select("company", F.posexplode(X.url_variations("company")).alias("pos", "url"))


def homepage(tried: DataFrame) -> DataFrame:
    """company, url: the first address that answered with a status from 200 to 399 (company, pos, url, status)."""
    return tried.filter("status between 200 and 399").groupBy("company").agg(F.min_by("url", "pos").alias("url"))


def visible_text(html):
    """Text of a page without scripts, styles and tags."""
    html = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", " "), f"{X.WS}+", " "))


def links(pages: DataFrame) -> DataFrame:
    """page url and the sorted distinct absolute links of it, as an array (url, html)."""
    @F.pandas_udf("array<string>")
    def absolute(base: pd.Series, hrefs: pd.Series) -> pd.Series:
        return pd.Series([sorted({urljoin(b, h) for h in hs}) if hs is not None else [] for b, hs in zip(base, hrefs)])

    hrefs = F.regexp_extract_all("html", F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))
    return pages.select("url", absolute("url", hrefs).alias("links"))


def distinct_links(pages: DataFrame) -> DataFrame:
    """url, link: each link of an address once, however many of the pages have that address."""
    return links(pages).select("url", F.explode("links").alias("link")).distinct()


def imprint_links(pages: DataFrame) -> DataFrame:
    """url, link of links that look like an imprint's."""
    return distinct_links(pages).filter(X.is_imprint_url("link"))


def ranked(pages: DataFrame) -> DataFrame:
    """company, url, pos, score, rank: pages by falling score of their text (company, pos, url, text); ties keep their order."""
    w = Window.partitionBy("company").orderBy(F.desc("score"), "pos")
    return pages.withColumn("score", X.imprint_score("text")).withColumn("rank", F.row_number().over(w)).drop("text")


def results(companies: DataFrame, extracted: DataFrame) -> DataFrame:
    """Every company with its record, or with status and message where there is none (company, record or null, found_pages)."""
    rows = companies.join(extracted, "company", "left")
    status = F.when(F.coalesce("found_pages", F.lit(0)) == 0, "Not Found").when(F.col("record").isNull(), "Failed")
    message = F.when(status == "Not Found", "Imprint info could not be extracted.").when(status == "Failed", "Error occurred during processing.")
    return rows.select("company", "record", status.alias("status"), message.alias("message"))
