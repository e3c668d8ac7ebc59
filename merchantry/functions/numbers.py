"""Arithmetic of the scoring and grouping jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words and documents of the corpus that term weights assume.
CORPUS_WORDS, CORPUS_DOCUMENTS = 1e8, 5e6


def term_weight(freq: Column) -> Column:
    return freq / F.lit(CORPUS_WORDS) * F.log(F.lit(CORPUS_DOCUMENTS) / (freq + 1))


def price_difference(a: Column, b: Column) -> Column:
    """1 - min / max; 0 where both are 0."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(F.greatest(a, b) == 0, 0.0).otherwise(1 - F.try_divide(F.least(a, b), F.greatest(a, b)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two sparse vectors (maps of doubles); null where one is empty or zero, so that it never wins."""
    dot = F.aggregate(
        F.map_entries(a), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0))
    )
    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x * x))
    return F.try_divide(dot, F.nullif(norm(a) * norm(b), F.lit(0.0)))


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of equal length."""
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(total(a, b), F.nullif(F.sqrt(total(a, a)) * F.sqrt(total(b, b)), F.lit(0.0)))


def dictionary_frequency(freq: Column, manual: Column, valid_brand: Column) -> Column:
    """Frequencies that the segmenter uses: manual words under 200 count 200000, valid brands under 100 count 100."""
    return F.when(manual & (freq < 200), 200000).when(valid_brand & (freq < 100), 100).otherwise(freq)


def running_mean(mean: Column, count: Column, value: Column, literal: bool = False) -> Column:
    """The mean after one more value. literal: weight the old mean by the new count, as one source of the rule did."""
    return (mean * (count + 1) + value) / (count + 2) if literal else (mean * count + value) / (count + 1)


def merged_probability(old_freq: Column, old_prob: Column, freq: Column, total: Column) -> Column:
    """(f0 + f) / (f0 / p0 + total)."""
    return (old_freq + freq) / (F.try_divide(old_freq, old_prob) + total)


def category_code(m: Column, k: Column | None = None, i: Column | None = None) -> Column:
    """Ids of a three-level tree: 10 + m, 100 + 10 k + m, 1000 + 100 i + 10 k + m."""
    if k is None:
        return 10 + m
    return 100 + 10 * k + m if i is None else 1000 + 100 * i + 10 * k + m


def lenient_int(c: Column) -> Column:
    """A whole number, or 0 for anything that is not one."""
    return F.coalesce(c.try_cast("long"), F.lit(0))


def lenient_float(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def top_terms(vector: Column, k: int) -> Column:
    """The k largest entries of a map; ties by key."""
    ordered = F.array_sort(F.transform(F.map_entries(vector), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    return F.map_from_entries(F.transform(F.slice(ordered, 1, k), lambda e: F.struct(e["k"], -e["v"])))


def merged_vector(old: Column, new: Column, count: Column, k: int = 20) -> Column:
    """Running mean of a vector over the keys of the new one, others as they were; the k largest stay."""
    zero = F.lit(0.0)
    mean = F.map_zip_with(old, new, lambda _, a, b: F.when(b.isNull(), a).otherwise((F.coalesce(a, zero) * count + b) / (count + 1)))
    return top_terms(mean, k)
