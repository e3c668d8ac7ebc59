"""Which words make the dictionaries (T04-T06, T08, T11, T13, F38); operators.phrases finds them in titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.functions.numbers import dictionary_frequency
from merchantry.functions.text import capitalise


def segment_dictionary(words: DataFrame, brands: DataFrame) -> DataFrame:
    """word, freq that titles are segmented by (T13, F38): words over 50 or entered by hand, and the parts between slashes
    of brands, valid or over 50; the greatest frequency of a word stays. words: word, freq, manual, deleted; brands: name,
    freq, valid, deleted."""
    kept = words.where(~F.coalesce("deleted", F.lit(False)) & (F.col("manual") | (F.col("freq") > 50)))
    kept = kept.select("word", dictionary_frequency(F.col("freq"), F.col("manual"), F.lit(False)).alias("freq"))
    parts = brands.where(~F.coalesce("deleted", F.lit(False)) & (F.col("valid") | (F.col("freq") > 50)))
    parts = parts.select(F.explode(F.split("name", "/")).alias("word"), dictionary_frequency(F.col("freq"), F.lit(False), F.col("valid")).alias("freq"))
    return kept.unionByName(parts.where("word <> ''")).groupBy("word").agg(F.max("freq").cast("long").alias("freq"))


def first_brand(segments: DataFrame, brands: DataFrame, key: str) -> DataFrame:
    """key and brand: the first segment that is exactly a brand, written as names are; keys without one are left out.
    segments: key, place, segment; brands: word."""
    hit = segments.join(brands.select(F.col("word").alias("segment")).distinct(), "segment", "left_semi")
    first = hit.groupBy(key).agg(F.min_by("segment", "place").alias("segment"))
    return first.select(key, F.replace(capitalise(F.col("segment"), r"A-z"), F.lit("——"), F.lit("-")).alias("brand"))


def brand_words(brands: DataFrame) -> DataFrame:
    """word, freq of the brand dictionary (T04): valid brands, and others over 50 that are not deleted; valid ones count
    9999."""
    chosen = brands.where(F.col("valid") | (~F.col("deleted") & (F.col("freq") > 50))).where("freq > 30 or valid")
    return chosen.select(F.col("name").alias("word"), F.when(F.col("valid"), 9999).otherwise(F.col("freq")).alias("freq"))


def banned_words(words: DataFrame) -> DataFrame:
    """The blacklist (T05): blacklisted, not deleted or never marked so, over 50."""
    return words.where(F.col("blacklisted") & ~F.col("deleted").eqNullSafe(F.lit(True)) & (F.col("freq") > 50)).select("word")
