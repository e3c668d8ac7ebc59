"""Page layouts: pages are written from catalogue rows and read back, so the SQL twin knows what each must give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry.functions import codecs
from merchantry.operators import html
from merchantry.session import spread
from merchantry.sources.tables import table

_NAME = "upper(p_name)"


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    rows = spread(table(spark, sf, "part"))
    return rows.select("*", F.upper("p_name").alias("name"), F.format_string("%.2f", "p_retailprice").alias("price"), (F.col("p_size") % 5).alias("kind"))


def _page(*parts: object) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _mobile(rows: DataFrame) -> Column:
    """kind 0: hidden, 1: another layout, 2: without a promotion, 3: second hand and off, 4: with a promotion."""
    kind = F.col("kind")
    key, price = F.col("p_partkey").cast("string"), F.col("price")
    first = F.when(kind == 2, _page("<p>价格：", price, "</p>")).otherwise(_page("<p>", F.when(kind == 3, "二手价：").otherwise("促销："), "1.50</p><p>价格：", price, "</p>"))
    rate = F.when(kind == 3, "<td class='link_btn'><a href='r'>评论 7 条</a></td>").otherwise("<td class='link_btn'><a href='r'>评论<span>(12)</span></a></td>")
    body = _page(
        "<title>", F.when(kind == 0, "商品屏蔽").otherwise(F.col("name")), "淘宝网触屏版", "</title><body><div class='bd'>",
        F.when(kind == 1, "<p>none</p>").otherwise(_page("<p class=\"box\"><a href='/'>home</a> <a href='/cat?c=", key, "'>c</a></p>")),
        "<div class='box'><div class='detail'><p><img src='http://i/", key, ".jpg_70x70.jpg' alt='x'/></p>", first, "<p>运费：0</p><p>销量：", F.col("p_size").cast("string"), "件</p>",
    )
    rest = _page(
        "<p>所在地：", F.when(kind == 2, "北京").otherwise("浙江杭州"), "</p><p><a href='w'><img src='/ww?nick=shop%20", key, "&amp;x=1' alt='ww'></a></p></div>",
        "<div class='detail'>", F.when(kind == 3, "<table><tr><td>off</td></tr></table>").otherwise("<b>on</b>"), "</div>",
        "<table class='mt'><tr><td><a href='b'><img src='http://i/more_b.jpg'></a></td></tr></table><table class='rate_desc'><tbody><tr>", rate,
        "</tr></tbody></table></div></div><p><strong><a href='http://shop", (F.col("p_partkey") + 7).cast("string"), ".m.example.com'>shop</a></strong></p></body>",
    )
    return F.concat(body, rest)


def mobile_pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = _parts(spark, sf)
    read = rows.select("p_partkey", html.mobile_item(_mobile(rows)).alias("r")).select("p_partkey", "r.*")
    shown = [F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("title", "cid", "in_stock", "promotion_price", "price", "monthly_sales", "reviews", "nick")]
    images = F.when(F.col("error").isNull(), F.array_join("item_imgs", " ")).alias("images")
    place = F.when(F.col("error").isNull(), F.concat_ws("/", "location.state", "location.city")).alias("place")
    return read.select("p_partkey", "error", *shown, images, place)


def _details(rows: DataFrame) -> Column:
    table_ = _page("<table class='goods-property'><tbody><tr><td>品牌</td><td> ", F.col("p_brand"), "\n x</td></tr><tr><td>size</td><td>", F.col("p_size").cast("string"), "</td></tr><tr><td>size</td><td>last</td></tr></tbody></table>")
    red = F.when(F.col("kind") == 4, "<p>none</p>").otherwise("<p><a class='red'><strong>共 31 条</strong></a></p>")
    return _page("<body><div class='bd'><div class='box'>", red, "</div><div id='itemProp' class='box'><div class='detail'>", table_, "</div></div></div></body>")


def detail_pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = _parts(spark, sf)
    read = rows.select("p_partkey", html.detail_page(_details(rows)).alias("r"))
    return read.select("p_partkey", "r.error", "r.reviews", F.try_element_at("r.props", F.lit("品牌")).alias("brand"), F.try_element_at("r.props", F.lit("size")).alias("size"))


def merged_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Both pages of an item; every second item was stored with its own number as the shop's."""
    rows = _parts(spark, sf)
    key = F.col("p_partkey").cast("string")
    pages = rows.select("p_partkey", html.mobile_item(_mobile(rows)).alias("front"), html.detail_page(_details(rows)).alias("detail"), _mobile(rows).alias("page"), F.when(F.col("p_partkey") % 2 == 0, key).otherwise("5").alias("shop"))
    merged = pages.select(html.merged_item(F.col("front"), F.col("detail"), key, F.col("shop"), F.lit("taobao.com"), F.col("page")).alias("m"))
    return merged.select("m.num_iid", "m.decision", "m.sid", F.when(F.col("m.decision").isin("keep", "off"), F.col("m.promotion_price")).alias("promotion_price"))


def _attributes() -> Column:
    return _page("<div class='attributes'><div><ul id='J_AttrUL'><li>品牌:", F.col("p_brand"), "</li><li>none</li><li> size:", F.col("p_size").cast("string"), "</li></ul></div></div>")


def mall_pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = _parts(spark, sf)
    key = F.col("p_partkey").cast("string")
    page = _page(
        "<title>", F.col("name"), "-tmall.com天猫</title><script>var c = {'categoryId':'", key, "', \"sellerNickName\" : 'a%20", key, "', 'reservePrice' : '", F.col("price"), "', 'isOnline':", F.when(F.col("kind") == 1, "false").otherwise("true"),
        F.when(F.col("kind") == 2, "}</script>").otherwise("}</script><img id='J_ImgBooth' src='http://i/1.jpg_430x430.jpg'>"), "<ul id='J_UlThumb'><li><a><img src='http://i/2.jpg_b.jpg'></a></li></ul>", _attributes(),
    )
    return _desktop_rows(rows.select("p_partkey", html.mall_item(page).alias("r")))


def market_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages in GBK, which are decoded first."""
    rows = _parts(spark, sf)
    key = F.col("p_partkey").cast("string")
    page = _page(
        "<title>", F.col("name"), "-淘宝网</title><script>x = { cid:'", key, "', sellerNick:\"a ", key, "\"}</script><div class='tb-wrap-newshop'><ul><li><strong><em class='tb-rmb-num'>", F.when(F.col("kind") == 3, "none").otherwise(F.col("price")), "</em></strong></li></ul></div>",
        "<img id='J_ImgBooth' data-src='http://i/1.jpg_430x430.jpg'><ul id='J_UlThumb'><li><div><a><img data-src='http://i/2.jpg_b.jpg'></a></div></li></ul>", _attributes(),
        F.when(F.col("kind") == 1, "<div class='tb-out-of-date'><div><p class='tb-hint'><strong>off</strong></p></div></div>").otherwise(""),
    )
    raw = rows.select("p_partkey", codecs.encoder("gbk")(page).alias("raw"))
    decoded = raw.select("p_partkey", codecs.decoder("gbk")("raw").alias("page"))
    return _desktop_rows(decoded.select("p_partkey", html.market_item(F.col("page")).alias("r")))


def _desktop_rows(rows: DataFrame) -> DataFrame:
    brand = F.try_element_at("r.props", F.lit("品牌")).alias("brand")
    fields = ("error", "title", "cid", "nick", "price", "in_stock", "shop_type")
    return rows.select("p_partkey", *(f"r.{c}" for c in fields), F.array_join("r.item_imgs", " ").alias("images"), brand, F.size("r.props").alias("n_props"))


def shop_pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier")
    key = F.col("s_suppkey").cast("string")
    gone = F.col("s_suppkey") % 7 == 0
    page = _page(
        "<body>", F.when(gone, "").otherwise(_page("<p class='box'>店铺: ", F.col("s_name"), "</p>")), "<table><tr><td class='pic'><img src='http://i/", key, ".jpg_b.jpg'></td><td valign=top>好评率：98.5%</td></tr></table>",
        "<a href='http://w/x?shopId=", key, "&amp;a=1'><img alt='ww' src='http://w/y?nick=n%20", key, "'></a> sellerId=", key, "9 ",
    )
    rate = lambda i, over: _page("<li class='J_RateInfoTrigger'><div class='item-scrib'><em class='count'>4.", F.lit(str(i)), "</em><em><strong class='percent ", F.when(over, "over").otherwise("lower"), "'>", F.when(F.col("s_suppkey") % 3 == 0, "----").otherwise("12.5%"), "</strong></em></div></li>")
    rated = _page(
        "<ul><li class='company'><div class='fleft2'> Co ", key, " </div></li></ul><ul><li>当前主营：", F.col("s_name"), "</li><li>所在地区：  浙江 </li></ul><ul id='dsr'>",
        rate(1, F.lit(True)), rate(2, F.col("s_suppkey") % 2 == 0), F.when(F.col("s_suppkey") % 5 == 0, "").otherwise(rate(3, F.lit(False))), "</ul>",
    )
    service = _page('{"refund": {"value": "', key, '.5"}, "name": "x"}')
    read = rows.select("s_suppkey", html.shop_page(page, _page("http://shop", key, ".m.taobao.com")).alias("p"), html.seller_id(page).alias("seller"), html.rating_page(rated).alias("r"), html.service_numbers(service, "refund struct<value: double>, name string").alias("s"))
    rates = F.array_join(F.transform("r.rates", lambda x: F.concat_ws(":", F.format_string("%.1f", x["score"]), F.format_string("%.1f", x["rate"]))), " ")
    return read.select("s_suppkey", "p.error", "p.title", "p.nick", "p.sid", "p.pic_path", "p.praise_rate", "p.shop_link", "seller", "r.company", "r.shop_type", "r.main_products", "r.location", rates.alias("rates"), F.col("s.refund.value").alias("refund"))


def shop_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of a shop, each with the items of one supplier and part size; the last has no next page."""
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    cell = F.concat(F.lit("<td class='pic'><a href='/i"), F.col("l_partkey").cast("string"), F.lit(".htm'><img src='x'></a></td>"))
    pages = lines.groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_list(cell)), "").alias("cells"))
    last = F.col("l_suppkey") % 4 == 0
    key = F.col("l_suppkey").cast("string")
    pager = F.when(last, "<div class='pager'><a href='p1'>上页</a></div>").otherwise(_page("<div class='pager'><a href='/s?p=", key, "'>下页</a><a href='z'>末页</a></div>"))
    page = _page("<p><strong><a href='http://shop", key, ".m.x.com'>in</a></strong></p><img src='/w?nick=q%2B", key, "'><table><tr>", F.col("cells"), "</tr></table>", pager)
    read = pages.select("l_suppkey", html.listed_items(page).alias("r"), html.shop_link(page).alias("link"), html.shop_nick(page).alias("nick"))
    items = F.aggregate("r.items", F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    return read.select("l_suppkey", "link", "nick", F.size("r.items").cast("long").alias("n_items"), items.alias("sum_items"), "r.next")


QUERIES = {f.__name__: f for f in (mobile_pages, detail_pages, merged_pages, mall_pages, market_pages, shop_pages, shop_lists)}

_OK = "CASE WHEN k > 1 THEN {} END"
_PRICE = "round(p_retailprice, 2)"
_DESKTOP = "'http://i/1.jpg http://i/2.jpg'"
SQL = {
    "mobile_pages": f"""
        SELECT p_partkey, CASE k WHEN 0 THEN 'missing' WHEN 1 THEN 'cattag' END AS error, {_OK.format(_NAME)} AS title, {_OK.format("p_partkey")} AS cid,
               {_OK.format("k <> 3")} AS in_stock, CASE WHEN k > 2 THEN 1.5e0 END AS promotion_price, {_OK.format(_PRICE)} AS price,
               {_OK.format("CAST(p_size AS BIGINT)")} AS monthly_sales, CAST({_OK.format("CASE k WHEN 3 THEN 7 ELSE 12 END")} AS BIGINT) AS reviews,
               {_OK.format("'shop ' || p_partkey")} AS nick, {_OK.format("'http://i/' || p_partkey || '.jpg http://i/more'")} AS images,
               {_OK.format("CASE k WHEN 2 THEN '北京/北京' ELSE '浙江/杭州' END")} AS place FROM (SELECT *, p_size % 5 AS k FROM part) p""",
    "detail_pages": """
        SELECT p_partkey, CASE WHEN p_size % 5 = 4 THEN 'reviews' END AS error, CAST(CASE WHEN p_size % 5 <> 4 THEN 31 END AS BIGINT) AS reviews,
               p_brand || '  x' AS brand, 'last' AS size FROM part""",
    "merged_pages": f"""
        SELECT p_partkey AS num_iid, CASE k WHEN 0 THEN 'missing' WHEN 1 THEN 'drop' WHEN 4 THEN 'drop' WHEN 3 THEN 'off' ELSE 'keep' END AS decision,
               CASE WHEN p_partkey % 2 = 0 OR p_partkey = 5 THEN p_partkey + 7 ELSE 5 END AS sid,
               CASE k WHEN 2 THEN {_PRICE} WHEN 3 THEN 1.5e0 END AS promotion_price FROM (SELECT *, p_size % 5 AS k FROM part) p""",
    "mall_pages": f"""
        SELECT p_partkey, CASE p_size % 5 WHEN 2 THEN 'image' END AS error, {_NAME} AS title, p_partkey AS cid, 'a ' || p_partkey AS nick, {_PRICE} AS price,
               p_size % 5 <> 1 AS in_stock, 'tmall.com' AS shop_type, CASE p_size % 5 WHEN 2 THEN 'http://i/2.jpg' ELSE {_DESKTOP} END AS images,
               p_brand AS brand, 2 AS n_props FROM part""",
    "market_pages": f"""
        SELECT p_partkey, CASE p_size % 5 WHEN 3 THEN 'price' END AS error, {_NAME} AS title, p_partkey AS cid, 'a ' || p_partkey AS nick,
               CASE WHEN p_size % 5 <> 3 THEN {_PRICE} END AS price, p_size % 5 <> 1 AS in_stock, 'taobao.com' AS shop_type, {_DESKTOP} AS images,
               p_brand AS brand, 2 AS n_props FROM part""",
    "shop_pages": """
        SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'gone' END AS error, CASE WHEN s_suppkey % 7 <> 0 THEN s_name END AS title, 'n ' || s_suppkey AS nick,
               s_suppkey AS sid, 'http://i/' || s_suppkey || '.jpg' AS pic_path, 98.5e0 AS praise_rate, 'http://shop' || s_suppkey || '.taobao.com' AS shop_link,
               s_suppkey || '9' AS seller, 'Co ' || s_suppkey AS company, 'tmall.com' AS shop_type, s_name AS main_products, '浙江' AS location,
               CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN '4.1:0.0 4.2:0.0 4.3:0.0'
                    ELSE '4.1:12.5 4.2:' || CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE '-' END || '12.5 4.3:-12.5' END AS rates,
               s_suppkey + 0.5e0 AS refund FROM supplier""",
    "shop_lists": """
        SELECT l_suppkey, 'http://shop' || l_suppkey || '.m.x.com' AS link, 'q+' || l_suppkey AS nick, count(DISTINCT l_partkey) AS n_items,
               CAST(sum(DISTINCT l_partkey) AS BIGINT) AS sum_items, CASE WHEN l_suppkey % 4 <> 0 THEN '/s?p=' || l_suppkey END AS next FROM lineitem GROUP BY l_suppkey""",
}
