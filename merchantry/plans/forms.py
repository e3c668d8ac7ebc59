"""Queries of the smaller functions, write rules and file formats, each with its SQL twin."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry.functions import codecs, numbers, props, times, urls
from merchantry.functions import text as tx
from merchantry.operators import dictionary, html, lookups, merge, predicates, vectors, words
from merchantry.session import new_folder
from merchantry.sources import files
from merchantry.sources.tables import table
from merchantry.streaming import incremental

_NOW = dt.datetime(2024, 1, 1)


def _now() -> object:
    return F.lit(_NOW).cast("timestamp_ntz")


def text_forms(spark: SparkSession, sf: str) -> DataFrame:
    """F03, F04, F06, F12, F13, F15."""
    name, brand = F.col("p_name"), F.col("p_brand")
    han = F.concat(F.lit("手机"), name, F.lit("北京x大学"))
    segments = F.array(F.lit("手"), F.lit("机"), brand, F.lit("好"), F.split(name, " ")[0], F.lit("!"))
    return table(spark, sf, "part").select(
        "p_partkey", tx.ascii_lower(brand).alias("lowered"), tx.reversed_text(name).alias("backwards"), F.array_join(tx.han_runs(han), "|").alias("han"),
        tx.cut_bytes(han, 4, 6).alias("bytes"), tx.display(segments).alias("shown"),
    )


def formatted_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """F20, F30, F38, F40."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    mixed = F.when(size % 3 == 0, F.concat(size.cast("string"), F.lit("x"))).otherwise(size.cast("string"))
    return table(spark, sf, "part").select(
        "p_partkey", tx.formatted("%d:%.6f", size, price).alias("line"), numbers.lenient_int(mixed).alias("whole"), numbers.lenient_float(mixed).alias("number"),
        F.round(numbers.term_weight(size) * 1e6, 9).alias("weight"), numbers.dictionary_frequency(size * 10, size % 4 == 0, size % 5 == 0).cast("int").alias("freq"),
    )


def times_of_day(spark: SparkSession, sf: str) -> DataFrame:
    """A week before, the epoch as default, marks read back, and posts since a time."""
    events = table(spark, sf, "events")
    ts = F.col("ts")
    known = F.coalesce(F.when(F.col("event_type") != "click", ts), F.lit(times.EPOCH).cast("timestamp_ntz"))
    back = times.from_hour_mark(times.hour_mark(ts))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    late = events.where(predicates.since(ts, dt.datetime(2024, 1, 10)))
    return late.select("event_id", shown(times.days_before(ts, 7)).alias("week_before"), shown(known).alias("known"), shown(back).alias("read_back"))


def shop_urls(spark: SparkSession, sf: str) -> DataFrame:
    """F22-F24, H09."""
    key = F.col("s_suppkey").cast("string")
    url = F.concat(F.lit("http://shop"), key, F.lit(".example.com/a?b=1"))
    other = F.when(F.col("s_suppkey") % 2 == 0, url).otherwise("http://mall.example.com/")
    kind = F.when(F.col("s_suppkey") % 3 == 0, "tmall.com").otherwise("taobao.com")
    return table(spark, sf, "supplier").select(
        "s_suppkey", urls.shop_number(url).alias("number"), urls.mobile(url, "example.com").alias("mobile"), urls.mobile(urls.mobile(url, "example.com"), "example.com").alias("twice"),
        urls.detail("http://i/", "http://m/", kind, F.col("s_suppkey")).alias("detail"), urls.is_mall(url, other).alias("mall"),
    )


def byte_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Texts through a character set and through compression, and back."""
    rows = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("北京"), "p_name").alias("t"))
    rows = rows.select("p_partkey", codecs.encoder("gbk")("t").alias("gbk"), codecs.compressed("t").alias("z"))
    return rows.select("p_partkey", F.length("gbk").alias("n_bytes"), codecs.decoder("gbk")("gbk").alias("decoded"), codecs.decompressed("z").alias("restored"))


def places(spark: SparkSession, sf: str) -> DataFrame:
    """H08, J15."""
    states = F.array(*(F.lit(s) for s in ("浙江", "黑龙江", "北京", "内蒙古", "某地方")))
    state = F.get(states, F.col("p_size") % 5)
    place = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), state, F.lit(" "))).otherwise(F.concat(state, F.lit("城市")))
    found = tx.location(place)
    return table(spark, sf, "part").select("p_partkey", found["state"].alias("state"), found["city"].alias("city"))


def brand_choice(spark: SparkSession, sf: str) -> DataFrame:
    """T11, A16."""
    brands = F.array(F.lit("三星"), F.concat(F.lower("p_brand"), F.lit("x")), F.when(F.col("p_size") % 2 == 0, "olay beauty care/欧莱雅").otherwise("中文/名"))
    letters = F.transform(brands, lambda b: F.regexp_replace(b, "[#0-9]", ""))
    return table(spark, sf, "part").select("p_partkey", tx.choose_brand(letters).alias("brand"))


def standard_items(spark: SparkSession, sf: str) -> DataFrame:
    """P02, P03, P05."""
    key = F.col("p_partkey").cast("string")
    image = lambda n: F.struct(F.concat(F.lit(f"http://i/{n}/"), key).alias("url"))
    data = F.struct(
        F.col("p_name").alias("title"), F.col("p_brand").alias("nick"), F.col("p_size").cast("long").alias("cid"), F.col("p_size").cast("string").alias("price"),
        F.concat(F.lit("1:2:brand:"), "p_brand", F.lit(";bad;3:4:size:"), F.col("p_size").cast("string")).alias("props_name"), F.array(image(1), image(2)).alias("item_imgs"),
    )
    raw = table(spark, sf, "part").select(F.col("p_partkey").alias("num_iid"), data.alias("api_data"))
    items = props.standard_item(raw)
    return items.select("num_iid", "title", "nick", "cid", F.col("price").cast("double").alias("price"), F.try_element_at("props", F.lit("brand")).alias("brand"), F.try_element_at("props", F.lit("size")).alias("size"), F.array_join("item_imgs", " ").alias("images"), "in_stock", "score")


def upload_forms(spark: SparkSession, sf: str) -> DataFrame:
    """P04, K12."""
    key = F.col("p_partkey").cast("string")
    items = table(spark, sf, "part").select("p_partkey", "p_name", "p_size", F.when(F.col("p_size") > 3, F.array(F.concat(F.lit("a"), key), F.concat(F.lit("b"), key))).alias("images"))
    return props.upload_params(items, "p_partkey", ["p_name", "p_size"], "images")


def record_views(spark: SparkSession, sf: str) -> DataFrame:
    """Records as JSON responses, and request bodies as records."""
    views = files.as_response(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand"))
    body = files.posted(F.col("value"), "p_partkey long, p_name string, absent string")
    return views.select("value", body["p_partkey"].alias("p_partkey"), body["p_name"].alias("p_name"), body["absent"].alias("absent"))


def element_tests(spark: SparkSession, sf: str) -> DataFrame:
    """P13, P16, P24, P26."""
    size = F.col("p_size")
    gifts = F.when(size % 4 == 0, None).otherwise(F.filter(F.array(F.lit("tea"), F.lit("cup")), lambda g: (size % 4 == 3) | (g == "cup") & (size % 4 == 2)))
    rows = table(spark, sf, "part").withColumn("gifts", gifts).withColumn("code", F.concat(F.lit("e"), (size % 3).cast("string")))
    return rows.select(
        "p_partkey", predicates.has_element(F.col("gifts")).alias("some"), predicates.holds(F.col("gifts"), "cup").alias("cup"), predicates.gone(F.col("code"), ["e1"]).alias("gone"),
        predicates.display_state(size % 3 == 0, size % 2 == 0).alias("state"),
    )


def tsv_files(spark: SparkSession, sf: str) -> DataFrame:
    """Rows written as tab-separated text, read from the third line on and as a list of lines."""
    folder = new_folder(spark, "tsv")
    files.write_tsv(table(spark, sf, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").coalesce(1), folder)  # 25 rows
    rows = files.tsv(spark, folder, ["key", "name"], start=2).select("key", "name", F.lit("tsv").alias("reader"))
    listed = files.lines(spark, folder).select(F.substring_index("value", "\t", 1).alias("key"), F.substring_index("value", "\t", -1).alias("name"), F.lit("list").alias("reader"))
    return rows.union(listed)


def json_files(spark: SparkSession, sf: str) -> DataFrame:
    """Captured pages of a paged feed, and JSON in a script's envelope, in GB2312."""
    folder = new_folder(spark, "feed")
    nations = table(spark, sf, "nation")
    pages = nations.groupBy("n_regionkey").agg(F.to_json(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("value"))
    pages.select("value").union(spark.createDataFrame([("[]",)], "value string")).repartition(6).write.text(folder)  # 6 rows
    rows = files.captured_pages(spark, folder, "struct<n_nationkey: long, n_name: string>")
    names = F.concat(F.lit('jsonp1({"name": "'), "n_name", F.lit('", "town": "北京"});'))
    raw = nations.select(codecs.encoder("gb2312")(names).alias("raw")).select(codecs.decoder("gb2312")("raw").alias("body"))
    inner = raw.select(files.enveloped(F.col("body"), "name string, town string").alias("r"))
    return rows.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).union(inner.select(F.lit(-1).cast("long"), F.concat("r.name", "r.town")))


def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    """K11."""
    rows = table(spark, sf, "region").select("r_regionkey", F.concat("r_name", F.lit(" & <b>")).alias("name")).coalesce(1)  # five rows
    return files.html_report(rows, ["r_regionkey"], "regions").select(F.md5(F.col("value").cast("binary")).alias("digest"))


def all_updated(spark: SparkSession, sf: str) -> DataFrame:
    """K05."""
    return merge.set_all(table(spark, sf, "part").select("p_partkey", "p_size"), {"p_size": F.col("p_size") + 1, "seen": F.lit(True)})


def replaced_structs(spark: SparkSession, sf: str) -> DataFrame:
    """Attributes of suppliers with a low balance replaced whole."""
    rows = table(spark, sf, "supplier").select("s_suppkey", F.struct(F.lit("old").alias("kind"), F.col("s_acctbal").alias("rate")).alias("info"), F.lit(None).cast("timestamp_ntz").alias("updated"), "s_acctbal")
    new = rows.where("s_acctbal < 0").select("s_suppkey", F.struct(F.lit("new").alias("kind"), F.lit(None).cast("double").alias("rate")).alias("info"))
    out = merge.replaced_structs(rows, new, "s_suppkey", ["info"], {"updated": _now()})
    return out.select("s_suppkey", "info.kind", "info.rate", F.date_format("updated", "yyyy-MM-dd").alias("updated"))


def refreshed_shops(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers fetched anew, but for their names; curated kinds stay and those that are gone leave."""
    kind = F.when(F.col("s_nationkey") < 5, "global").otherwise("taobao.com")
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_name", kind.alias("kind"), F.col("s_acctbal").alias("rate"))
    fetched = rows.where("rate < 5000").select("s_suppkey", (F.col("rate") < 0).alias("gone"), F.lit("x").alias("s_name"), F.lit("tmall.com").alias("kind"), (F.col("rate") + 1).alias("rate"))
    return merge.refreshed_shops(rows, fetched, "s_suppkey", ["s_name"], "kind", "global").withColumn("rate", F.round("rate", 2))


def children_added(spark: SparkSession, sf: str) -> DataFrame:
    """K23."""
    none = spark.createDataFrame([], "p_partkey long, p_name string, created_time timestamp_ntz, updated_time timestamp_ntz")
    new = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("p_name"))
    out = merge.with_children(none, new, ["p_name"], _now())
    return out.select("p_partkey", "p_name", F.date_format("created_time", "yyyy-MM-dd").alias("created"), F.date_format("updated_time", "yyyy-MM-dd").alias("updated"))


def recrawled_items(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of parts parsed again; the failed table and the shops after it."""
    parts = table(spark, sf, "part")
    error = F.when(F.col("p_size") % 3 == 0, "cattag")
    record = F.when(error.isNull(), F.struct(F.col("p_name").alias("title")))
    parsed = parts.select("p_partkey", (F.col("p_partkey") % 7).alias("shop"), error.alias("error"), record.alias("record"))
    failed = parts.where("p_size < 10").select("p_partkey")
    shops = spark.createDataFrame([(0, "finished", None), (1, "finished", None)], "shop long, status string, created_time timestamp_ntz")
    records, left, shops = merge.recrawled(parsed, failed, shops, "p_partkey", "shop", _now())
    tried = incremental.retried(failed, parsed.select("p_partkey", F.col("error").isNotNull().alias("soft")), "p_partkey")
    rows = lambda name, df, key, value: df.select(F.lit(name).alias("part"), F.col(key).cast("long").alias("key"), value.alias("value"))
    found = rows("record", records, "p_partkey", F.col("title")).union(rows("failed", left, "p_partkey", F.lit(None).cast("string")))
    return found.union(rows("shop", shops, "shop", F.col("status"))).union(rows("retry", tried, "p_partkey", F.lit(None).cast("string")))


def unparsed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A poll of pages that have no record yet, which are then parsed."""
    pages = table(spark, sf, "pages")
    done = table(spark, sf, "labels").select(F.col("doc_id").alias("page_id")).distinct()
    waiting = merge.delete(pages, done, "page_id")
    return waiting.select("page_id", html.element(F.col("html"), "title").alias("title"))


def likes_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of orders of customers of nations, counted by nation; small sides are one row a key."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    orders = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.sum("n").alias("n"))
    customers = table(spark, sf, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(F.sum("n").alias("likes"))
    return table(spark, sf, "nation").join(customers, F.col("n_nationkey") == F.col("c_nationkey")).select("n_name", "likes")


def delegate_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of parts by brand and size whose delegate was ever sold, with mean prices."""
    parts = table(spark, sf, "part")
    groups = parts.groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("delegate"), F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("mean"))
    sold = table(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("delegate")).distinct()
    kept = groups.join(sold, "delegate", "left_semi")
    return kept.select("delegate", "p_brand", "p_size", "n", F.round(numbers.running_mean(F.col("mean"), F.col("n"), F.lit(1000.0)), 6).alias("next_mean"))


def vector_merge(spark: SparkSession, sf: str) -> DataFrame:
    """A vector of three terms merged into one of four, the three largest kept."""
    size = F.col("p_size").cast("double")
    old = F.create_map(F.lit("a"), size, F.lit("b"), F.lit(9.0), F.lit("c"), F.lit(1.0), F.lit("e"), F.lit(0.5))
    new = F.create_map(F.lit("a"), F.lit(6.0), F.lit("c"), size * 2, F.lit("d"), F.lit(30.0))
    top = F.map_entries(numbers.merged_vector(old, new, F.lit(2), 3))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(top, lambda e: F.concat(e["key"], F.lit(":"), F.format_string("%.4f", e["value"]))), " ").alias("top"))


def best_matches(spark: SparkSession, sf: str) -> DataFrame:
    """The most similar vector of each label for every hundredth vector; of equal ones the first wins."""
    rows = table(spark, sf, "embeddings")
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"), "label")
    pairs = rows.join(queries, "label").where("vec_id <> query")
    score = F.round(numbers.dense_cosine(F.col("embedding"), F.col("q")), 6)
    best = pairs.select("query", "vec_id", score.alias("cosine")).groupBy("query").agg(F.max_by(F.struct("vec_id", "cosine"), F.struct("cosine", -F.col("vec_id"))).alias("b"))
    return best.select("query", "b.vec_id", "b.cosine")


def _dictionary(spark: SparkSession, sf: str) -> DataFrame:
    tokens = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    return tokens.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def item_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of parts, a word banned, brands as terms."""
    parts = table(spark, sf, "part")
    segments = parts.select("p_partkey", F.explode(F.split(F.concat_ws(" ", "p_name", "p_name", F.lit("x")), " ")).alias("segment"))
    banned = _dictionary(spark, sf).where("word < 'c'").select("word")
    brands = parts.where("p_size % 2 = 0").select("p_partkey", F.explode(F.array("p_brand", F.split("p_name", " ")[0])).alias("term"))
    found = vectors.item_vectors(segments, _dictionary(spark, sf), banned, brands, "p_partkey")
    return found.select("p_partkey", "term", F.round(F.col("weight") * 1e6, 6).alias("weight"))


def dictionaries(spark: SparkSession, sf: str) -> DataFrame:
    """What is loaded as brands, as blacklist and for segmenting."""
    base = table(spark, sf, "part").select(F.concat_ws("/", "p_name", "p_brand").alias("name"), (F.col("p_size") * 3).cast("long").alias("freq"), (F.col("p_size") % 7 == 0).alias("valid"), F.when(F.col("p_size") % 3 > 0, F.col("p_size") % 3 == 1).alias("deleted"))
    brands = base.withColumn("deleted", F.coalesce("deleted", F.lit(False)))
    listed = base.select(F.col("name").alias("word"), "freq", F.col("valid").alias("blacklisted"), "deleted", (F.col("freq") % 5 == 0).alias("manual"))
    rows = lambda name, df: df.select(F.lit(name).alias("list"), "word", F.col("freq").cast("long").alias("freq"))
    banned = dictionary.banned_words(listed).withColumn("freq", F.lit(0))
    return rows("brands", dictionary.brand_words(brands)).union(rows("banned", banned)).union(rows("segments", dictionary.segment_dictionary(listed, brands)))


def first_brands(spark: SparkSession, sf: str) -> DataFrame:
    """T08."""
    segments = table(spark, sf, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("place", "segment"))
    brands = _dictionary(spark, sf).where("word > 'm'").select("word")
    return dictionary.first_brand(segments, brands, "p_partkey")


def han_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of Han characters, of long ones both ends, and how often each end stands."""
    title = F.concat(F.lit("甲乙丙丁戊己庚辛"), "p_name", F.lit("手机"), F.when(F.col("p_size") % 2 == 0, "壳膜").otherwise("x"))
    rows = table(spark, sf, "part").select(F.explode(words.han_edges(title, 3)).alias("run"))
    return rows.groupBy("run").agg(F.count(F.lit(1)).alias("n"))


def mining_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Two gates, of which one is open."""
    parts = table(spark, sf, "part")
    return spark.createDataFrame([("low", words.enough(parts, 100)), ("high", words.enough(parts, 1_000_000_000))], "gate string, open boolean")


def option_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Which order priorities each order status holds."""
    orders = table(spark, sf, "orders")
    held = orders.where("o_orderstatus = 'P'").select("o_orderpriority")
    return lookups.flags(orders.select("o_orderpriority").distinct(), held, "o_orderpriority", "held")


QUERIES = {
    f.__name__: f
    for f in (
        text_forms, formatted_numbers, times_of_day, shop_urls, byte_forms, places, brand_choice, standard_items, upload_forms, record_views, element_tests,
        tsv_files, json_files, report_lines, all_updated, replaced_structs, refreshed_shops, children_added, recrawled_items, unparsed_pages, likes_chain,
        delegate_groups, vector_merge, best_matches, item_vectors, dictionaries, first_brands, han_edges, mining_gate, option_marks,
    )
}

_WORDS = "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part"
_FREQ = f"SELECT word, count(*) AS freq FROM ({_WORDS}) w GROUP BY word"
SQL = {
    "text_forms": r"""
        SELECT p_partkey, lower(p_brand) AS lowered, reverse(p_name) AS backwards, '手机|北京|大学' AS han, '机' || p_name[:3] AS bytes,
               '手机 ' || p_brand || ' 好 ' || string_split(p_name, ' ')[1] || ' !' AS shown FROM part""",
    "formatted_numbers": """
        SELECT p_partkey, printf('%d:%.6f', p_size, p_retailprice) AS line, CAST(CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size END AS BIGINT) AS whole,
               CASE WHEN p_size % 3 = 0 THEN 0.0e0 ELSE p_size END AS number, round(p_size / 1e8 * ln(5e6 / (p_size + 1)) * 1e6, 9) AS weight,
               CASE WHEN p_size % 4 = 0 AND p_size * 10 < 200 THEN 200000 WHEN p_size % 5 = 0 AND p_size * 10 < 100 THEN 100 ELSE p_size * 10 END AS freq FROM part""",
    "times_of_day": """
        SELECT event_id, strftime(ts - INTERVAL 7 DAYS, '%Y-%m-%d %H:%M') AS week_before,
               CASE WHEN event_type = 'click' THEN '1970-01-01 00:00' ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS known,
               strftime(date_trunc('day', ts) + to_hours(CAST(hour(ts) % 12 AS INTEGER)), '%Y-%m-%d %H:00') AS read_back
        FROM events WHERE ts >= TIMESTAMP '2024-01-10'""",
    "shop_urls": """
        SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS number, 'http://shop' || s_suppkey || '.m.example.com/a?b=1' AS mobile,
               'http://shop' || s_suppkey || '.m.example.com/a?b=1' AS twice, CASE WHEN s_suppkey % 3 = 0 THEN 'http://m/' ELSE 'http://i/' END || s_suppkey AS detail,
               s_suppkey % 2 = 1 AS mall FROM supplier""",
    "byte_forms": "SELECT p_partkey, CAST(4 + length(p_name) AS INTEGER) AS n_bytes, '北京' || p_name AS decoded, '北京' || p_name AS restored FROM part",
    "places": """
        SELECT p_partkey, CASE k WHEN 4 THEN CASE WHEN even THEN '某地方' END ELSE s END AS state,
               CASE WHEN even THEN s WHEN k = 4 THEN NULL ELSE '城市' END AS city
        FROM (SELECT p_partkey, p_size % 5 AS k, p_size % 2 = 0 AS even, ['浙江', '黑龙江', '北京', '内蒙古', '某地方'][p_size % 5 + 1] AS s FROM part) p""",
    "brand_choice": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Olay Beauty Care' ELSE 'Brandx' END AS brand FROM part",
    "standard_items": """
        SELECT p_partkey AS num_iid, p_name AS title, p_brand AS nick, CAST(p_size AS BIGINT) AS cid, CAST(p_size AS DOUBLE) AS price, p_brand AS brand,
               CAST(p_size AS VARCHAR) AS size, 'http://i/1/' || p_partkey || ' http://i/2/' || p_partkey AS images, TRUE AS in_stock, CAST(0 AS BIGINT) AS score FROM part""",
    "upload_forms": """
        SELECT p_partkey, 'p_name' AS name, p_name AS value FROM part UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS VARCHAR) FROM part
        UNION ALL SELECT p_partkey, 'image_url', c || p_partkey FROM part, (VALUES ('a'), ('b')) AS v(c) WHERE p_size > 3""",
    "record_views": """
        SELECT '{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '","p_brand":"' || p_brand || '"}' AS value, p_partkey, p_name,
               CAST(NULL AS VARCHAR) AS absent FROM part""",
    "element_tests": """
        SELECT p_partkey, p_size % 4 IN (2, 3) AS some, p_size % 4 IN (2, 3) AS cup, p_size % 3 = 1 AS gone,
               CASE WHEN p_size % 3 = 0 THEN 'error' WHEN p_size % 2 = 0 THEN 'warning' ELSE 'success' END AS state FROM part""",
    "tsv_files": """
        SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, 'list' AS reader FROM nation UNION ALL
        SELECT CAST(n_nationkey AS VARCHAR), n_name, 'tsv' FROM (SELECT * FROM nation ORDER BY n_nationkey OFFSET 2) n""",
    "json_files": "SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name FROM nation UNION ALL SELECT -1, n_name || '北京' FROM nation",
    "report_lines": """
        SELECT md5(v) AS digest FROM (SELECT '<table><caption>regions</caption>' AS v UNION ALL SELECT '</table>' UNION ALL
          SELECT '<tr class="' || CASE WHEN (row_number() OVER (ORDER BY r_regionkey) - 1) % 2 = 0 THEN 'even' ELSE 'odd' END || '"><td>' || r_regionkey
                 || '</td><td>' || r_name || ' &amp; &lt;b&gt;</td></tr>' FROM region) x""",
    "all_updated": "SELECT p_partkey, p_size + 1 AS p_size, TRUE AS seen FROM part",
    "replaced_structs": """
        SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'new' ELSE 'old' END AS kind, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS rate,
               CASE WHEN s_acctbal < 0 THEN '2024-01-01' END AS updated FROM supplier""",
    "refreshed_shops": """
        SELECT s_suppkey, s_name, CASE WHEN s_nationkey < 5 THEN 'global' WHEN s_acctbal < 5000 THEN 'tmall.com' ELSE 'taobao.com' END AS kind,
               round(CASE WHEN s_acctbal < 5000 THEN s_acctbal + 1 ELSE s_acctbal END, 2) AS rate FROM supplier WHERE s_acctbal >= 0""",
    "children_added": "SELECT p_partkey, p_name, '2024-01-01' AS created, '2024-01-01' AS updated FROM part",
    "recrawled_items": """
        SELECT 'record' AS part, p_partkey AS key, p_name AS value FROM part WHERE p_size % 3 <> 0 UNION ALL
        SELECT 'failed', p_partkey, NULL FROM part WHERE p_size % 3 = 0 UNION ALL SELECT 'retry', p_partkey, NULL FROM part WHERE p_size % 3 = 0 UNION ALL
        SELECT 'shop', k, 'finished' FROM (VALUES (0), (1)) AS v(k) UNION ALL
        SELECT DISTINCT 'shop', p_partkey % 7, 'queued' FROM part WHERE p_size % 3 <> 0 AND p_partkey % 7 > 1""",
    "unparsed_pages": r"""
        SELECT page_id, nullif(trim(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1), '<[^>]*>', '', 'g'),
               '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')), '') AS title
        FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""",
    "likes_chain": """
        SELECT n_name, count(*) AS likes FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    "delegate_groups": """
        WITH g AS (SELECT p_brand, p_size, min(p_partkey) AS delegate, count(*) AS n, avg(p_retailprice) AS mean FROM part GROUP BY ALL)
        SELECT delegate, p_brand, p_size, n, round((mean * n + 1000) / (n + 1), 6) AS next_mean FROM g
        WHERE delegate IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)""",
    "vector_merge": """
        WITH v AS (SELECT p_partkey, unnest([{'k': 'a', 'v': (p_size * 2e0 + 6) / 3}, {'k': 'b', 'v': 9e0}, {'k': 'c', 'v': (2e0 + p_size * 2e0) / 3},
                   {'k': 'd', 'v': 10e0}, {'k': 'e', 'v': 0.5e0}]) AS e FROM part),
        r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY e.v DESC, e.k) AS place FROM v)
        SELECT p_partkey, string_agg(e.k || ':' || printf('%.4f', e.v), ' ' ORDER BY place) AS top FROM r WHERE place <= 3 GROUP BY p_partkey""",
    "best_matches": """
        WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        p AS (SELECT q.vec_id AS query, e.vec_id, round(list_cosine_similarity(e.v, q.v), 6) AS cosine FROM e JOIN e q ON e.label = q.label
              AND q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id)
        SELECT query, vec_id, cosine FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) = 1""",
    "item_vectors": f"""
        WITH f AS ({_FREQ}), s AS (SELECT p_partkey, word, 2 * count(*) AS n FROM ({_WORDS}) w GROUP BY ALL),
        v AS (SELECT p_partkey, word AS term, n * (freq / 1e8 * ln(5e6 / (freq + 1))) AS w FROM s JOIN f USING (word)
              WHERE length(word) > 1 AND freq >= 10 AND word >= 'c'),
        b AS (SELECT p_partkey, p_brand AS term FROM part WHERE p_size % 2 = 0 UNION
              SELECT p_partkey, string_split(p_name, ' ')[1] FROM part WHERE p_size % 2 = 0)
        SELECT p_partkey, term, round(CASE WHEN b.term IS NOT NULL THEN 0.00005e0 ELSE w END * 1e6, 6) AS weight FROM v FULL JOIN b USING (p_partkey, term)""",
    "dictionaries": """
        WITH d AS (SELECT p_name || '/' || p_brand AS name, CAST(p_size * 3 AS BIGINT) AS freq, p_size % 7 = 0 AS valid, p_size % 3 = 1 AS deleted FROM part),
        s AS (SELECT name AS word, CASE WHEN freq % 5 = 0 AND freq < 200 THEN 200000 ELSE freq END AS freq FROM d WHERE NOT deleted AND (freq % 5 = 0 OR freq > 50)
              UNION ALL SELECT unnest(string_split(name, '/')), CASE WHEN valid AND freq < 100 THEN 100 ELSE freq END FROM d WHERE NOT deleted AND (valid OR freq > 50))
        SELECT 'brands' AS list, name AS word, CASE WHEN valid THEN 9999 ELSE freq END AS freq FROM d WHERE valid OR (NOT deleted AND freq > 50)
        UNION ALL SELECT 'banned', name, 0 FROM d WHERE valid AND NOT deleted AND freq > 50
        UNION ALL SELECT 'segments', word, max(freq) FROM s GROUP BY word""",
    "first_brands": f"""
        WITH s AS (SELECT p_partkey, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i, string_split(p_name, ' ') AS t FROM part),
        b AS (SELECT p_partkey, arg_min(t[i], i) AS w FROM s WHERE t[i] IN (SELECT word FROM ({_WORDS}) x WHERE word > 'm') GROUP BY p_partkey)
        SELECT p_partkey, upper(w[1]) || w[2:] AS brand FROM b""",
    "han_edges": """
        SELECT run, count(*) AS n FROM (SELECT unnest(['甲乙丙丁', '戊己庚辛', CASE WHEN p_size % 2 = 0 THEN '手机壳膜' ELSE '手机' END]) AS run FROM part) x GROUP BY run""",
    "mining_gate": "SELECT 'low' AS gate, count(*) > 100 AS open FROM part UNION ALL SELECT 'high', count(*) > 1000000000 FROM part",
    "option_marks": """
        SELECT DISTINCT o_orderpriority, o_orderpriority IN (SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'P') AS held FROM orders""",
}
