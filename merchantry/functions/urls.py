"""Addresses of shops and items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def query_value(url: Column, name: str) -> Column:
    """An unescaped parameter of the query, or null."""
    return F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(name)))


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def shop_number(url: Column) -> Column:
    """Digits of http://shop<digits>.<domain>, or null."""
    return F.nullif(F.regexp_extract(url, r"^https?://shop(\d+)\.", 1), F.lit(""))


def mobile(url: Column, domain: str) -> Column:
    """The mobile address: `m.` goes before the domain, once."""
    found = rf"(?<![\w.]m\.)(?<!/m\.)\b{domain.replace('.', chr(92) + '.')}"
    return F.regexp_replace(url, found, f"m.{domain}")


def detail(base: str, mall_base: str, kind: Column, item: Column) -> Column:
    """The page of an item, by the kind of shop."""
    return F.concat(F.when(kind.isin("mall", "tmall.com"), mall_base).otherwise(base), item.cast("string"))


def is_mall(asked: Column, answered: Column) -> Column:
    """Whether a page was answered from another host than was asked."""
    return F.coalesce(host(asked) != host(answered), F.lit(False))
