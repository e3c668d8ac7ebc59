"""Records from archived pages (H01-H06, F19), by regular expressions in the JVM.

Pages need not be well-formed: what is not found is null, and an error kind says why a page gives no record.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantry.functions.numbers import lenient_float, lenient_int
from merchantry.functions.text import cut_bytes, location
from merchantry.functions.urls import query_value, shop_number

ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def without_code(html: Column) -> Column:
    """Comments, style and script blocks cut out."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")


def unescaped(c: Column) -> Column:
    for entity, char in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def element(html: Column, tag: str) -> Column:
    """The text of the first element of a tag, or null."""
    found = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
    return F.nullif(F.trim(unescaped(F.regexp_replace(found, "<[^>]*>", ""))), F.lit(""))


def attribute(html: Column, tag: str, name: str) -> Column:
    """All values of an attribute of a tag, in order."""
    return F.transform(F.regexp_extract_all(html, F.lit(rf"(?i)<{tag}\b[^>]*?\s{name}=[\"']([^\"']*)[\"']"), F.lit(1)), unescaped)


def text(html: Column) -> Column:
    """The page's text, white space run together."""
    bare = F.regexp_replace(without_code(html), "<[^>]*>", " ")
    return F.trim(F.regexp_replace(unescaped(bare), r"[\x20\x09-\x0D]+", " "))


def by_class(html: Column, name: str) -> Column:
    """The text of the first element whose class list holds name, up to its first closing tag, or null."""
    found = F.regexp_extract(html, rf"(?is)<(\w+)\b[^>]*\bclass=[\"'][^\"']*\b{name}\b[^\"']*[\"'][^>]*>(.*?)</\1\s*>", 2)
    return F.nullif(F.trim(unescaped(F.regexp_replace(found, "<[^>]*>", ""))), F.lit(""))


def number_in(c: Column) -> Column:
    """The first decimal number in a text, or 0."""
    return lenient_float(F.regexp_extract(F.regexp_replace(c, ",", ""), r"(\d+(?:\.\d+)?)", 1))


def item_record(pages: DataFrame, key: str, html: str, missing_mark: str = "not found", group_mark: str = "group sale") -> DataFrame:
    """key, error and record of item pages (H01, H02, H04). error: missing (no such item), group (sold elsewhere), title
    (no title), or null with a record."""
    page = F.col(html)
    title = element(page, "title")
    error = (
        F.when(page.isNull() | F.contains(F.lower(page), F.lit(missing_mark)), "missing")
        .when(F.contains(F.lower(page), F.lit(group_mark)), "group")
        .when(title.isNull(), "title")
    )
    price, promotion = number_in(by_class(page, "price")), number_in(by_class(page, "promo"))
    record = F.struct(
        title.alias("title"),
        lenient_int(F.regexp_extract(page, r"[?&]cid=(\d+)", 1)).alias("cid"),
        attribute(page, "img", "src").alias("item_imgs"),
        price.alias("price"),
        F.when(promotion > 0, promotion).otherwise(price).alias("promotion_price"),
        lenient_int(number_in(by_class(page, "sales"))).alias("monthly_sales"),
        lenient_int(number_in(by_class(page, "reviews"))).alias("reviews"),
        by_class(page, "nick").alias("nick"),
        (~F.coalesce(F.contains(F.lower(page), F.lit("out of stock")), F.lit(False))).alias("in_stock"),
    )
    return pages.select(key, error.alias("error"), F.when(error.isNull(), record).alias("record"))


def property_list(html: Column, tag: str = "li") -> Column:
    """`name: value` items of a detail page as a map; of equal names the last wins."""
    items = F.transform(F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), F.lit(1)), lambda s: F.regexp_replace(s, "<[^>]*>", ""))
    pairs = F.filter(F.transform(items, lambda s: F.split(unescaped(s), "[:：]", 2)), lambda p: F.size(p) == 2)
    entries = F.transform(pairs, lambda p: F.struct(F.trim(p[0]).alias("k"), F.trim(p[1]).alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["k"] == e["k"]))
    return F.map_from_entries(last)


def signed_rate(c: Column) -> Column:
    """A rating relative to others, negative where the text says lower."""
    value = number_in(c)
    return F.when(F.regexp_like(c, F.lit("(?i)lower|less|低")), -value).otherwise(value)


def shop_links(html: Column) -> Column:
    """Distinct links to shops, in order."""
    return F.array_distinct(F.filter(attribute(html, "a", "href"), lambda u: F.regexp_like(u, F.lit(r"^https?://(shop\d+|[\w-]+)\.[\w.-]+/?$"))))


#: Marks of the archived page layouts.
IMAGE_SIZE = r"_\d+x\d+\.jpg|_b\.jpg"
HIDDEN_TITLE, DETAIL_TITLE, CONTACT = "商品屏蔽", "宝贝详情", "联系卖家"


#: Tags whose closing tag may be left out, as the next one of the kind, or its parent's end, ends them.
IMPLIED = ("p", "li", "td", "th", "tr", "dd", "dt", "option")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value being worked out once a row and not at each place that a lambda function names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _worked_out(first: dict[str, Column], *steps: Callable[[Column], dict[str, Column]]) -> Column:
    """A struct of what the last step names, each step seeing all that was named before. A value is worked out once a row, however often
    later steps name it: a plain expression would be worked out at each of these places, and what it rests on at each of theirs."""

    def go(named: dict[str, Column], rest: tuple) -> Column:
        value = F.struct(*(c.alias(n) for n, c in named.items()))
        if not rest:
            return value
        return _bound(value, lambda v: go(({n: v[n] for n in named} if len(rest) > 1 else {}) | rest[0](v), rest[1:]))

    return go(first, steps)


def _start(tag: str, name: str) -> str:
    return rf"<{tag}\b[^>]*\bclass=[\"'][^\"'>]*(?<![\w-]){name}(?![\w-])[^>]*>" if name else rf"<{tag}\b[^>]*>"


def leaves(html: Column, tag: str, name: str = "") -> Column:
    """The inner markup of the elements that hold no element of their tag: cells, lines, words in bold type."""
    return F.regexp_extract_all(html, F.lit(rf"(?is){_start(tag, name)}((?:(?!<{tag}\b).)*?)</{tag}\s*>"), F.lit(1))


def _balanced(html: Column, tag: str, name: str, outermost: bool) -> Column:
    """The page is cut at the tag's opening and closing tags; the depth after each is a prefix sum. An element ends where the
    depth first falls below its own, at the end of the page if it never does."""
    # The < stands before the choice: elsewhere the choice would be tried at every character.
    mark, opens = rf"(?is)<(?:{tag}\b[^>]*|/{tag}\s*)>", rf"(?is)^{_start(tag, name)}$"
    events = F.regexp_extract_all(html, F.lit(mark), F.lit(0))
    cut_up = F.struct(events.alias("events"), F.split(html, mark, -1).alias("parts"), F.transform(events, lambda e: F.when(F.startswith(e, F.lit("</")), -1).otherwise(1)).alias("steps"))

    def with_depths(c: Column) -> Column:
        depths = F.transform(c["steps"], lambda _, i: F.aggregate(F.slice(c["steps"], F.lit(1), i + 1), F.lit(0), lambda x, y: x + y))
        return F.struct(c["events"].alias("events"), c["parts"].alias("parts"), c["steps"].alias("steps"), depths.alias("depths"))

    def spans(c: Column) -> Column:
        n = F.size(c["events"])
        places = F.filter(F.transform(c["events"], lambda e, i: F.when((F.get(c["steps"], i) == 1) & F.regexp_like(e, F.lit(opens)), i)), lambda i: i.isNotNull())
        later = lambda i: F.slice(c["depths"], i + 2, n)
        ends = F.transform(places, lambda i: F.struct(i.alias("a"), F.coalesce(F.nullif(F.array_position(F.transform(later(i), lambda d: d < F.get(c["depths"], i)), True), F.lit(0)) + i, n).cast("int").alias("b")))
        return F.struct(c["events"].alias("events"), c["parts"].alias("parts"), ends.alias("ends"))

    def inner(c: Column) -> Column:
        chosen = F.filter(c["ends"], lambda x: ~F.exists(c["ends"], lambda y: (y["a"] < x["a"]) & (x["b"] < y["b"]))) if outermost else c["ends"]

        def markup(x: Column) -> Column:
            between = F.zip_with(F.slice(c["events"], x["a"] + 2, x["b"] - x["a"] - 1), F.slice(c["parts"], x["a"] + 3, x["b"] - x["a"] - 1), lambda e, p: F.concat(e, p))
            return F.concat(F.get(c["parts"], x["a"] + 1), F.array_join(between, ""))

        return F.transform(chosen, markup)

    return _bound(cut_up, lambda c: _bound(with_depths(c), lambda d: _bound(spans(d), inner)))


def blocks(html: Column, tag: str, name: str = "", outermost: bool = False) -> Column:
    """The inner markup of all elements of a tag (of a class, where one is named), in order of their beginning. An element
    may hold others of its tag. outermost: elements within another one of these are left out, so that what is looked for
    inside is found once. Where closing tags that may be left out are left out, an element is what stands between an
    opening tag and the next closing one, without another opening tag in it."""
    if tag == "p":
        return leaves(html, tag, name)
    whole = _balanced(html, tag, name, outermost)
    if tag not in IMPLIED:
        return whole
    count = lambda mark: F.regexp_count(html, F.lit(rf"(?i){mark}"))
    return F.when(count(rf"<{tag}\b") == count(rf"</{tag}\s*>"), whole).otherwise(leaves(html, tag, name))


def within(html: Column, *path: tuple[str, str]) -> Column:
    """The inner markup of the elements (tag, class; "" for any) at the end of a path of descendants, in order."""
    tag, name = path[0]
    found = blocks(html, tag, name, outermost=len(path) > 1)
    if len(path) == 1:
        return found
    return F.flatten(F.transform(found, lambda b: within(b, *path[1:])))


def bare(markup: Column) -> Column:
    return F.trim(unescaped(F.regexp_replace(markup, "<[^>]*>", "")))


def _first(c: Column) -> Column:
    return F.get(c, F.lit(0))


def _found(c: Column, pattern: str) -> Column:
    """The first group of a pattern, or null."""
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def _sized(url: Column) -> Column:
    return F.regexp_replace(url, IMAGE_SIZE, "")


def mobile_item(page: Column) -> Column:
    """error and the fields of a mobile item page (H01). Of the paragraphs of detail blocks the first holds the picture, if
    there is one, then come a promotion price, if the next is not the price itself, the price, and two and three places on
    the sales and the place. error: missing (hidden or no such item), title, cattag (another layout), group (sold
    elsewhere), count (a sales line without a number); then the fields mean nothing."""
    none = F.array().cast("array<string>")
    amount = lambda v, i: F.regexp_extract(F.coalesce(F.get(v["lines"], i), F.lit("")), r"(\d+\.\d+)", 1).try_cast("double")

    def blocks_of(v: Column) -> dict[str, Column]:
        page = v["page"]
        rating = _first(F.flatten(F.transform(blocks(page, "table", "rate_desc"), lambda t: leaves(t, "td", "link_btn"))))
        more = F.flatten(F.transform(blocks(page, "table", "mt"), lambda t: attribute(t, "img", "src")))
        title = F.coalesce(element(page, "title"), F.lit(""))
        return {"title": title, "box": leaves(page, "p", "box"), "details": blocks(page, "div", "detail", outermost=True), "more": more, "rating": rating}

    def paragraphs_of(v: Column) -> dict[str, Column]:
        links = F.flatten(F.transform(v["box"], lambda b: attribute(b, "a", "href")))
        paragraphs = F.flatten(F.transform(v["details"], lambda d: F.regexp_extract_all(d, F.lit(r"(?is)<p\b[^>]*>(.*?)</p\s*>"), F.lit(1))))
        return {"category": F.try_element_at(links, F.lit(-1)), "paragraphs": paragraphs}

    def lines_of(v: Column) -> dict[str, Column]:
        pictures = F.flatten(F.transform(v["paragraphs"], lambda p: F.regexp_extract_all(p, F.lit(r"(?i)<img\b[^>]*>"), F.lit(0))))
        return {"lines": F.transform(v["paragraphs"], bare), "pictures": pictures}

    def images_of(v: Column) -> dict[str, Column]:
        lead = F.when(~F.contains(_first(v["pictures"]), F.lit(f'alt="{CONTACT}"')), attribute(_first(v["pictures"]), "img", "src"))
        return {"images": _bound(lead, lambda x: F.when(x.isNull(), none).otherwise(F.transform(F.concat(x, v["more"]), _sized)))}

    def judged(v: Column) -> dict[str, Column]:
        judge = F.coalesce(F.get(v["lines"], (F.size(v["images"]) > 0).cast("int")), F.lit(""))
        priced = F.contains(judge, F.lit("格："))
        return {"priced": priced, "second_hand": ~priced & F.contains(judge, F.lit("价：")), "at": F.when(F.size(v["images"]) <= 0, 0).when(priced, 1).otherwise(2)}

    def read(v: Column) -> dict[str, Column]:
        sales = F.coalesce(F.get(v["lines"], v["at"] + 2), F.lit(""))
        number = F.when(v["second_hand"], bare(v["rating"])).otherwise(bare(_first(leaves(v["rating"], "span"))))
        return {"sales": sales, "sold": _found(sales, r"(\d+)"), "place": F.coalesce(F.get(v["lines"], v["at"] + 3), F.lit("")), "number": number}

    def record(v: Column) -> dict[str, Column]:
        category, title = v["category"], v["title"]
        error = (
            F.when(F.contains(title, F.lit(HIDDEN_TITLE)) | (title == DETAIL_TITLE), "missing")
            .when(F.octet_length(title) < 18, "title")
            .when(F.size(v["box"]) <= 0, "cattag")
            .when(category.isNotNull() & ~F.contains(category, F.lit("cat")), "group")
            .when(v["sold"].isNull() & F.contains(v["sales"], F.lit("量")), "count")
        )
        buttons = F.filter(v["pictures"], lambda p: F.contains(p, F.lit("nick=")))
        return {
            "error": error,
            "title": cut_bytes_end(title, 18),
            "cid": F.regexp_extract(category, r"(\d+)$", 1).try_cast("long"),
            "item_imgs": v["images"],
            "in_stock": F.size(F.coalesce(F.regexp_extract_all(F.get(v["details"], F.lit(1)), F.lit(r"(?i)<table\b"), F.lit(0)), none)) != 1,
            "promotion_price": F.when(~v["priced"], amount(v, F.lit(1))),
            "price": amount(v, v["at"]),
            "monthly_sales": v["sold"].try_cast("long"),
            "location": _bound(v["place"], lambda p: F.when(F.contains(p, F.lit("地")), _bound(F.get(F.split(p, "："), F.lit(1)), location))),
            "reviews": F.coalesce(F.regexp_extract(v["number"], r"(\d+)", 1).try_cast("long"), F.lit(0)),
            "nick": query_value(_first(attribute(_first(buttons), "img", "src")), "nick"),
        }

    return _worked_out({"page": page}, blocks_of, paragraphs_of, lines_of, images_of, judged, read, record)


def cut_bytes_end(c: Column, n: int) -> Column:
    """The text without its last n bytes."""
    data = F.encode(c, "UTF-8")
    return F.try_validate_utf8(F.substring(data, F.lit(1), F.octet_length(data) - n).cast("string"))


def detail_page(page: Column) -> Column:
    """error, reviews and properties of a detail page (H02): a row of the goods-property table is a name and a value."""

    def parts(v: Column) -> dict[str, Column]:
        red = _first(F.flatten(F.transform(leaves(v["page"], "p"), lambda p: F.filter(F.transform(leaves(p, "strong"), bare), lambda s: s != ""))))
        rows = F.flatten(F.transform(blocks(v["page"], "table", "goods-property"), lambda t: leaves(t, "tr")))
        cells = F.filter(F.transform(rows, lambda r: F.transform(leaves(r, "td"), lambda d: F.regexp_replace(bare(d), r"\r?\n", " "))), lambda c: F.size(c) > 1)
        return {"red": red, "cells": cells}

    def record(v: Column) -> dict[str, Column]:
        return {"error": F.when(v["red"].isNull(), "reviews"), "reviews": _found(v["red"], r"(\d+)").try_cast("long"), "props": _last_wins(v["cells"])}

    return _worked_out({"page": page}, parts, record)


def _last_wins(pairs: Column) -> Column:
    """A map of arrays of name and value; of equal names the last wins."""
    entries = F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).alias("k"), F.get(p, F.lit(1)).alias("v")))
    last = lambda all_: F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda x: x["k"] == e["k"]))
    return F.map_from_entries(_bound(entries, last))


def _listed(page: Column) -> Column:
    listed = F.regexp_extract(page, r"(?is)<div\b[^>]*\bclass=[\"'][^\"'>]*(?<![\w-])attributes(?![\w-])[^>]*>(.*?)</ul\s*>", 1)
    items = F.transform(leaves(listed, "li"), bare)
    return _last_wins(F.filter(F.transform(items, lambda s: F.split(s, ":")), lambda p: F.size(p) > 1))


def _desktop(page: Column, cid: Column, nick: Column, price: Column, source: str, online: Column, kind: str, tail: int) -> Column:
    """Fields that both desktop layouts have. tail: characters at the end of the title that name the site."""
    lead = F.regexp_extract(page, r"(?i)(<img\b[^>]*\bid=[\"']J_ImgBooth[\"'][^>]*>)", 1)
    thumbs = F.regexp_extract(page, r"(?is)<ul\b[^>]*\bid=[\"']J_UlThumb[\"'][^>]*>(.*?)</ul\s*>", 1)
    title = element(page, "title")
    error = F.when(cid.isNull(), "category").when(nick.isNull(), "nick").when(price.isNull(), "price").when(lead == "", "image")
    return F.struct(
        error.alias("error"),
        F.substring(title, F.lit(1), F.char_length(title) - tail).alias("title"),
        cid.try_cast("long").alias("cid"),
        nick.alias("nick"),
        price.try_cast("double").alias("price"),
        F.transform(F.concat(attribute(lead, "img", source), attribute(thumbs, "img", source)), _sized).alias("item_imgs"),
        online.alias("in_stock"),
        F.lit(kind).alias("shop_type"),
        _listed(page).alias("props"),
    )


def mall_item(page: Column) -> Column:
    """error and the fields of the desktop layout of malls."""
    online = F.coalesce(_found(page, r"isOnline':(true|false)") == "true", F.lit(True))
    nick = F.try_url_decode(_found(page, r"sellerNickName\" : '([^'\n]+)'"))
    return _desktop(page, _found(page, r"categoryId':'(\d+)"), nick, _found(page, r"reservePrice' : '(\d+\.\d+)"), "src", online, "tmall.com", 12)


def market_item(page: Column) -> Column:
    """error and the fields of the desktop layout of single sellers."""
    cid = F.coalesce(_found(page, r" cid:'(\d+)"), _found(page, r"data-catid =\"(\d+)"))
    price = _found(_first(F.transform(leaves(page, "em", "tb-rmb-num"), bare)), r"(\d+\.\d+)")
    gone = F.exists(F.transform(F.split(page, r"(?i)tb-out-of-date"), lambda s: s), lambda s: F.regexp_like(s, F.lit(r"(?is)^[^<]*>.*?<p\b[^>]*tb-hint[^>]*>\s*<strong")))
    return _desktop(page, cid, _found(page, r"sellerNick:\"([^\"\n]+)\""), price, "data-src", ~gone, "taobao.com", 4)


def merged_item(front: Column, detail: Column, item: Column, shop: Column, kind: Column, page: Column) -> Column:
    """decision and the record of an item from its two pages (H04). decision: drop (the front page failed softly or the
    detail page failed), missing, off (out of stock) or keep. The shop comes from the front page's link where it is not
    known or was stored as the item."""
    decision = F.when(front["error"] == "missing", "missing").when(front["error"].isNotNull() | detail["error"].isNotNull(), "drop").when(~front["in_stock"], "off").otherwise("keep")
    known = F.coalesce(shop, F.lit("")) == ""
    sid = F.when(known | (shop == item), shop_number(shop_link(page))).otherwise(shop)
    return F.struct(
        decision.alias("decision"),
        item.try_cast("long").alias("num_iid"),
        lenient_int(sid).alias("sid"),
        kind.alias("shop_type"),
        front["title"].alias("title"),
        front["price"].alias("price"),
        F.coalesce(front["promotion_price"], front["price"]).alias("promotion_price"),
        detail["reviews"].alias("reviews"),
        detail["props"].alias("props"),
    )


def shop_link(page: Column) -> Column:
    """The shop's address on a mobile item page: the first link in bold type."""
    strong = F.flatten(F.transform(leaves(page, "p"), lambda p: F.transform(leaves(p, "strong"), lambda s: _first(attribute(s, "a", "href")))))
    return _first(F.filter(strong, lambda u: u.isNotNull()))


def shop_nick(page: Column) -> Column:
    """The seller's name in the address of the contact picture."""
    return query_value(_first(F.filter(attribute(page, "img", "src"), lambda u: F.contains(u, F.lit("nick=")))), "nick")


def listed_items(page: Column) -> Column:
    """Numbers of the items that a page of a shop lists, and the next page where there is one."""
    links = F.transform(leaves(page, "td", "pic"), lambda t: _found(_first(attribute(t, "a", "href")), r"(\d+)"))
    pager = _first(blocks(page, "div", "pager"))
    first = F.regexp_extract(pager, r"(?is)(<a\b[^>]*>.*?</a\s*>)", 1)
    return F.struct(F.filter(links, lambda u: u.isNotNull()).alias("items"), F.when(bare(first) == "下页", _first(attribute(first, "a", "href"))).alias("next"))


def shop_page(page: Column, link: Column) -> Column:
    """The record of a shop's mobile page (H05); its error is gone where the page names no shop."""
    title = _first(F.transform(leaves(page, "p", "box"), bare))
    contact = _first(F.filter(F.regexp_extract_all(page, F.lit(r"(?is)<a\b[^>]*>\s*<img\b[^>]*alt=[\"']ww[\"'][^>]*>"), F.lit(0)), lambda s: s != ""))
    picture = _first(F.transform(leaves(page, "td", "pic"), lambda t: _first(attribute(t, "img", "src"))))
    rate = _found(page, r"好评率：([0-9.]+)")
    return F.struct(
        F.when(F.coalesce(title, F.lit("")) == "", "gone").alias("error"),
        F.trim(cut_bytes(title, 8, 1 << 20)).alias("title"),
        query_value(_first(attribute(contact, "img", "src")), "nick").alias("nick"),
        query_value(_first(attribute(contact, "a", "href")), "shopId").try_cast("long").alias("sid"),
        F.regexp_replace(picture, r"_\d+x\d+.jpg$|_b.jpg$", "").alias("pic_path"),
        lenient_float(rate).alias("praise_rate"),
        F.regexp_replace(link, r"\.m\.t", ".t").alias("shop_link"),
    )


def seller_id(page: Column) -> Column:
    """The seller's number on a shop's page, or null."""
    return F.coalesce(_found(page, r"(?:userId|userid|sellerid|sellerId)=(\d+)"), _found(page, r"userId:\"(\d+)\""))


def rating_page(page: Column) -> Column:
    """company, main products, place and the three signed rates of a rating page (H05). A rate is below zero where its
    class is not `percent over`; ---- is zero; other than three rates are none."""
    company = F.try_element_at(F.transform(F.flatten(F.transform(leaves(page, "li", "company"), lambda c: leaves(c, "div", "fleft2"))), bare), F.lit(-1))
    items = F.flatten(F.transform(leaves(page, "li", "J_RateInfoTrigger"), lambda c: F.array(c)))

    def rate(item: Column) -> Column:
        marks = leaves(item, "em")
        over = F.regexp_like(F.get(marks, F.lit(1)), F.lit(r"class=[\"']percent over[\"']"))
        size = F.coalesce(F.regexp_extract(bare(F.get(marks, F.lit(1))), r"^([0-9.]+)", 1).try_cast("double"), F.lit(0.0))
        return F.struct(lenient_float(bare(_first(marks))).alias("score"), F.when(over | (size == 0), size).otherwise(-size).alias("rate"))

    rates = F.transform(items, rate)
    return F.struct(
        company.alias("company"),
        F.when(company.isNull(), "taobao.com").otherwise("tmall.com").alias("shop_type"),
        F.trim(_found(page, r"当前主营：([^<\n]+)")).alias("main_products"),
        _found(page, r"所在地区：[\s\p{C}]+(\p{L}+)").alias("location"),
        F.when(F.size(rates) == 3, rates).alias("rates"),
    )


def service_numbers(body: Column, schema: str) -> Column:
    """JSON of the service feed: numbers in quotation marks are numbers."""
    return F.from_json(F.regexp_replace(body, r'"([0-9.]+)"', "$1"), schema)
