"""Hand-derived cases."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from merchantry.functions import codecs, numbers, props, times, urls
from merchantry.functions import text as tx
from merchantry.operators import html, predicates, score


def value(spark, column, **columns):
    names = list(columns)
    rows = spark.createDataFrame([tuple(columns.values())], names) if names else spark.range(1)
    return rows.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("function", "given", "expected"),
    [
        (tx.strip_marks, "a，b!c★d", "a b!c d"),
        (tx.tokenise, "我在中国China北京12389 America", ["我", "在", "中", "国", "China", "北", "京", "12389", "America"]),
        (tx.clean, "DIY皇冠-x", "diyx"),
        (tx.han_runs, "ab北京c上海", ["北京", "上海"]),
        (tx.token_stream, "Ab-c，北 x_1!", ["ab-c", "北", "x_1"]),
        (tx.joined_tokens, "北 京 ab cd 上", "北京ab cd上"),
        (urls.shop_number, "http://shop123.example.com/", "123"),
        (lambda c: urls.query_value(c, "nick"), "http://a.example.com/?nick=%E5%8C%97&x=1", "北"),
        (lambda c: urls.mobile(c, "example.com"), "http://shop1.example.com/x", "http://shop1.m.example.com/x"),
        (numbers.lenient_int, "x1", 0),
        (lambda c: props.props_map(c), "1:2:color:red;bad;3:4:size:L", {"color": "red", "size": "L"}),
        (lambda c: props.props_map(c), "1:2:a:x;1:3:a:y", {"a": "y"}),
        (lambda c: F.octet_length(c), "北京", 6),
        (lambda c: tx.cut_bytes(c, 1, 3), "北京", "北"),
    ],
)
def test_text(spark, function, given, expected):
    assert value(spark, function(F.col("s")), s=given) == expected


def test_capitals_depend_on_the_class(spark):
    assert value(spark, tx.capitalise(F.col("s"), "A-z"), s="foo_bar baz") == "Foo_bar Baz"
    assert value(spark, tx.capitalise(F.col("s")), s="foo_bar baz") == "Foo_Bar Baz"


def test_choose_brand(spark):
    assert value(spark, tx.choose_brand(F.array(F.lit("olay/欧莱雅"), F.lit("三星")))) == "Olay"
    assert value(spark, tx.choose_brand(F.array(F.lit("三星"), F.lit("苹果")))) == "三星"
    assert value(spark, tx.choose_brand(F.array().cast("array<string>"))) == ""


def test_display(spark):
    assert value(spark, tx.display(F.array(*map(F.lit, ["new", "北京", "iphone", "手机"])))) == "new 北京 iphone 手机"


def test_location(spark):
    assert tuple(value(spark, tx.location(F.lit("北京")))) == ("北京", "北京")
    assert tuple(value(spark, tx.location(F.lit("黑龙江哈尔滨")))) == ("黑龙江", "哈尔滨")
    assert value(spark, tx.location(F.lit("无此地名"))) is None


def test_numbers(spark):
    assert value(spark, numbers.price_difference(F.lit(10), F.lit(7))) == pytest.approx(0.3)
    assert value(spark, numbers.price_difference(F.lit(0), F.lit(0))) == 0
    assert value(spark, score.shop_score(F.lit(7), F.lit(2))) == pytest.approx(math.log(71))
    assert value(spark, score.item_score(F.lit(0), F.lit(False), F.lit(0.0))) == 1
    assert value(spark, score.shop_priority(F.lit(4000), F.lit(20), F.lit(20))) == 6
    assert value(spark, score.shop_priority(F.lit(0), F.lit(0), F.lit(0))) == 10
    assert value(spark, numbers.merged_probability(F.lit(10), F.lit(0.1), F.lit(5), F.lit(50))) == pytest.approx(0.1)
    assert value(spark, numbers.running_mean(F.lit(10.0), F.lit(1), F.lit(16.0))) == 13
    assert value(spark, numbers.running_mean(F.lit(10.0), F.lit(1), F.lit(16.0), literal=True)) == 12
    assert [value(spark, numbers.category_code(*map(F.lit, a))) for a in ((1,), (1, 2), (1, 2, 3))] == [11, 121, 1321]
    assert value(spark, numbers.dictionary_frequency(F.lit(50), F.lit(True), F.lit(True))) == 200000


def test_vectors(spark):
    m = lambda **x: F.create_map(*(F.lit(v) for kv in x.items() for v in kv))
    assert value(spark, numbers.cosine(m(a=1.0, b=1.0), m(a=1.0))) == pytest.approx(1 / math.sqrt(2))
    assert value(spark, numbers.cosine(m(a=0.0), m(a=1.0))) is None
    assert value(spark, numbers.merged_vector(m(a=2.0, b=3.0), m(a=4.0), F.lit(1), 2)) == {"a": 3.0, "b": 3.0}
    assert value(spark, numbers.top_terms(m(a=1.0, b=2.0, c=2.0), 2)) == {"b": 2.0, "c": 2.0}


def test_times(spark):
    assert value(spark, times.hour_mark(F.lit(dt.datetime(2024, 1, 1, 15)))) == "2024010103"
    assert value(spark, times.from_hour_mark(F.lit("2024010103"))) == dt.datetime(2024, 1, 1, 3)
    old = lambda h: predicates.older_than(F.lit(dt.datetime(2024, 1, 1)) - F.expr(f"INTERVAL {h} HOURS"), F.lit(dt.datetime(2024, 1, 1)), 720)
    assert (value(spark, old(721)), value(spark, old(720))) == (True, False)


def test_codecs(spark):
    rows = spark.createDataFrame([("北京".encode("gbk"), "北京"), (None, None)], "b binary, s string")
    decode = codecs.decoder("gbk")
    assert [r.v for r in rows.select(decode("b").alias("v")).collect()] == ["北京", None]
    assert [r.v for r in rows.select(codecs.decompressed(codecs.compressed("s")).alias("v")).collect()] == ["北京", None]


def test_missing_values(spark):
    rows = spark.createDataFrame([(True,), (False,), (None,)], "f boolean")
    assert [r.v for r in rows.select(predicates.not_true(F.col("f")).alias("v")).collect()] == [False, True, True]


def test_item_pages(spark):
    pages = [
        (1, '<title>A &amp; B</title><img src="x.jpg"><b class="price">1,200.50</b><i class="promo">99</i>'),
        (2, "item not found"),
        (3, "<p>no title</p>"),
        (4, None),
    ]
    rows = html.item_record(spark.createDataFrame(pages, "id long, html string"), "id", "html").orderBy("id").collect()
    assert [r.error for r in rows] == [None, "missing", "title", "missing"]
    assert rows[0].record.title == "A & B" and rows[0].record.price == 1200.5 and rows[0].record.promotion_price == 99
    assert value(spark, html.property_list(F.lit("<li>size: L</li><li>none</li><li>size：M</li>"))) == {"size": "M"}
