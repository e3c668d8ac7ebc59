"""Queries on archived pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry.operators import html
from merchantry.sources.tables import table


def html_title(spark: SparkSession, sf: str) -> DataFrame:
    page = F.col("html")
    return table(spark, sf, "pages").select("page_id", html.element(page, "title").alias("title"), html.element(page, "h1").alias("heading"))


def html_links(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "pages").select("page_id", F.posexplode(html.attribute(F.col("html"), "a", "href")).alias("place", "href"))
    return links.select("page_id", "place", "href")


def html_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", html.text(F.col("html")).alias("text"))


def item_pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = html.item_record(table(spark, sf, "pages"), "page_id", "html")
    return rows.select("page_id", "error", "record.title", F.size("record.item_imgs").alias("n_images"), "record.price", "record.in_stock")


def html_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Elements of the given pages: items of navigation lists, blocks of a class, and the article's markup."""
    page = F.col("html")
    items, article = F.transform(html.within(page, ("nav", ""), ("li", "")), html.bare), F.get(html.blocks(page, "article"), F.lit(0))
    return table(spark, sf, "pages").select(
        "page_id",
        F.array_join(items, "|").alias("items"),
        F.array_join(F.transform(html.blocks(page, "div", "ad"), html.bare), "|").alias("ads"),
        F.char_length(article).alias("article_chars"),
        F.size(html.blocks(page, "div")).alias("n_divs"),
    )


def html_nested(spark: SparkSession, sf: str) -> DataFrame:
    """The given pages, each wrapped in boxes within boxes: the outer box holds the page, the inner one its number."""
    number = F.col("page_id").cast("string")
    wrapped = F.concat(F.lit('<div class="outer box"><div class="box">'), number, F.lit("</div>"), "html", F.lit("<div>end</div></div>"))
    boxes = table(spark, sf, "pages").select("page_id", "html", html.blocks(wrapped, "div", "box").alias("b"))
    return boxes.select("page_id", F.size("b").alias("n_boxes"), F.get("b", F.lit(1)).alias("second"), F.md5(F.get("b", F.lit(0)).cast("binary")).alias("digest"))


QUERIES = {f.__name__: f for f in (html_title, html_links, html_text, item_pages, html_blocks, html_nested)}

_UNESCAPE = "replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"
SQL = {
    "html_title": f"""
        SELECT page_id, nullif(trim({_UNESCAPE.format(r"regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1), '<[^>]*>', '', 'g')")}), '') AS title,
               nullif(trim({_UNESCAPE.format(r"regexp_replace(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1), '<[^>]*>', '', 'g')")}), '') AS heading FROM pages""",
    "html_links": f"""
        SELECT page_id, CAST(i - 1 AS INTEGER) AS place, {_UNESCAPE.format("l[i]")} AS href FROM (
          SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
            SELECT page_id, regexp_extract_all(html, '(?i)<a\\b[^>]*?\\shref=["'']([^"'']*)["'']', 1) AS l FROM pages) x) y""",
    "html_text": f"""
        SELECT page_id, trim(regexp_replace({_UNESCAPE.format(r"regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'), '<[^>]*>', ' ', 'g')")},
               '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text FROM pages""",
    "html_blocks": rf"""
        SELECT page_id, array_to_string(list_transform(regexp_extract_all(array_to_string(regexp_extract_all(html, '(?is)<nav\b[^>]*>(.*?)</nav\s*>', 1), ''),
                 '(?is)<li\b[^>]*>(.*?)</li\s*>', 1), lambda s: trim({_UNESCAPE.format("regexp_replace(s, '<[^>]*>', '', 'g')")})), '|') AS items,
               array_to_string(list_transform(regexp_extract_all(html, '(?is)<div class="ad">(.*?)</div\s*>', 1),
                 lambda s: trim({_UNESCAPE.format("regexp_replace(s, '<[^>]*>', '', 'g')")})), '|') AS ads,
               CASE WHEN regexp_matches(html, '(?is)<article\b') THEN CAST(length(regexp_extract(html, '(?is)<article\b[^>]*>(.*?)(</article\s*>|\z)', 1)) AS INTEGER) END AS article_chars,
               CAST(len(regexp_extract_all(html, '(?i)<div\b')) AS INTEGER) AS n_divs FROM pages""",
    "html_nested": """
        SELECT page_id, 2 AS n_boxes, CAST(page_id AS VARCHAR) AS second,
               md5('<div class="box">' || page_id || '</div>' || html || '<div>end</div>') AS digest FROM pages""",
}
