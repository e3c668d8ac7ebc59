"""Text functions as column expressions.

Han text is told from alphabetic text by the size of a character in UTF-8: up to two bytes (below U+0800) is alphabetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ALNUM = r"[\p{L}\p{N}&&[\x{0}-\x{7FF}]]"
#: Names of provinces and municipalities, in two or three characters.
STATES = (
    "北京", "天津", "上海", "重庆", "河北", "山西", "辽宁", "吉林", "黑龙江", "江苏", "浙江", "安徽", "福建", "江西",
    "山东", "河南", "湖北", "湖南", "广东", "海南", "四川", "贵州", "云南", "陕西", "甘肃", "青海", "台湾", "内蒙古",
    "广西", "西藏", "宁夏", "新疆", "香港", "澳门", "海外",
)


def strip_marks(c: Column) -> Column:
    """Punctuation, symbols, separators and marks as spaces, but for those that names use."""
    return F.regexp_replace(c, r"[\p{P}\p{S}\p{Z}\p{M}&&[^@\-`'!_ +&＆.‘]]", " ")


def tokenise(c: Column) -> Column:
    """Alphanumeric runs and single other characters, spaces dropped."""
    return F.regexp_extract_all(c, F.lit(rf"({_ALNUM}+|[^ ])"), F.lit(1))


def token_stream(c: Column) -> Column:
    """Lower-case tokens for word mining: alphanumeric runs that may go on with - _ +, and single other characters;
    punctuation and symbols are dropped (F16)."""
    return F.regexp_extract_all(F.lower(c), F.lit(rf"({_ALNUM}[[\p{{L}}\p{{N}}_+\-]&&[\x{{0}}-\x{{7FF}}]]*|[^\s\p{{P}}\p{{S}}])"), F.lit(1))


def joined_tokens(c: Column) -> Column:
    """Tokens joined by spaces, as words are written: no space beside Han characters."""
    return F.regexp_replace(c, r"(?<=[^\x{0}-\x{7FF}]) | (?=[^\x{0}-\x{7FF}])", "")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def capitalise(c: Column, word: str = "A-Za-z") -> Column:
    """Each run of the class `word` begins with a capital; the rest stays as it is, unlike initcap."""
    parts = F.regexp_extract_all(c, F.lit(rf"([{word}]+|[^{word}]+)"), F.lit(1))
    up = lambda p: F.when(F.regexp_like(p, F.lit("^[a-z]")), F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))).otherwise(p)
    return F.array_join(F.transform(parts, up), "")


def clean(c: Column) -> Column:
    """Lower case without punctuation and filler words; fillers go before lower-casing, so DIY stays."""
    return F.lower(F.regexp_replace(c, r"[\p{P}`]|皇冠|diy", ""))


def display(segments: Column) -> Column:
    """Segments as a line: spaces around alphanumeric ones, none between Han; a lone mark loses its spaces."""
    words = F.filter(F.transform(segments, lambda s: F.trim(s)), lambda s: s != "")
    plain = lambda s: F.regexp_like(s, F.lit(r"^[a-zA-Z0-9 \p{P}\p{S}]+$"))
    spaced = F.array_join(
        F.transform(words, lambda s: F.when(plain(s), F.concat(F.lit("\0"), s, F.lit("\0"))).otherwise(F.regexp_replace(F.regexp_replace(s, "^(?=[a-zA-Z0-9])", "\0"), "(?<=[a-zA-Z0-9])$", "\0"))),
        "",
    )
    line = F.trim(F.regexp_replace(spaced, "\0+", " "))
    return F.regexp_replace(line, r" ([\p{P}\p{S}]) ", "$1")


def han_runs(c: Column) -> Column:
    """Maximal runs of Han characters."""
    return F.filter(F.split(c, r"\P{IsHan}+"), lambda s: s != "")


def reversed_text(c: Column) -> Column:
    return F.reverse(c)


def cut_bytes(c: Column, start: int, length: int) -> Column:
    """Bytes start..start+length-1 (from 1) of the UTF-8 text; broken characters at the ends are replaced."""
    return F.try_validate_utf8(F.substring(F.encode(c, "UTF-8"), start, length).cast("string"))


def location(c: Column) -> Column:
    """State and city of a place: two or three characters are both; longer ones begin with a known state; else null."""
    c = F.trim(c)
    whole = F.struct(c.alias("state"), c.alias("city"))
    lead = lambda n: F.struct(F.substring(c, 1, n).alias("state"), F.substring(c, n + 1, 1 << 30).alias("city"))
    return (
        F.when(F.char_length(c).isin(2, 3), whole)
        .when((F.char_length(c) > 3) & F.substring(c, 1, 2).isin(*STATES), lead(2))
        .when((F.char_length(c) > 3) & F.substring(c, 1, 3).isin(*STATES), lead(3))
    )


def formatted(template: str, *columns: Column) -> Column:
    return F.format_string(template, *columns)


def choose_brand(brands: Column) -> Column:
    """The longest Latin name, whole or between slashes; else the first name; capitals as in names."""
    latin = lambda b: F.regexp_like(b, F.lit(r"^[a-zA-Z\p{P} ]+$"))
    names = F.flatten(F.transform(brands, lambda b: F.when(latin(b), F.array(b)).otherwise(F.filter(F.split(b, "/"), latin))))
    # Of names of one length the first wins: the sort is by length down, then place.
    placed = F.array_sort(F.transform(names, lambda n, i: F.struct((-F.octet_length(n)).alias("o"), i.alias("i"), n.alias("n"))))
    return capitalise(F.coalesce(F.get(placed, F.lit(0))["n"], F.get(brands, F.lit(0)), F.lit("")))
