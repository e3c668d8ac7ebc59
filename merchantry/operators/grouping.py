"""Leader clustering of items within categories.

Items of a category come in order; each joins the most similar group among those within the price limit, if it is similar
enough, or else leads a new group. Every item, copies too, moves its group's mean price and count. The order matters, so a
category is one sequence: it is taken in batches, and the groups so far (lead, mean price, count, vector) are a checkpointed
table that each batch continues, so batches bound memory and do not change the result. The same table goes in and out of
a run: a later run continues the groups of earlier ones whose lead item is still there.
"""

from __future__ import annotations

from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.session import cut, ship_package

#: Rows of items have no mean; rows of groups, item being the lead, have one. parts: batches of the category.
_OUT = "category string, item long, group_lead long, mean double, n long, terms array<string>, weights array<double>, parts long"
_COLUMNS = [c.split()[0] for c in _OUT.split(", ")]


def prefix_terms(own: dict, norm: float, threshold: float) -> list[str]:
    """Terms of a vector, in a common order, until the others' norm is too small for the threshold: of two vectors that
    are similar enough, the prefixes share a term."""
    rest, least, out = norm * norm, (threshold * norm) ** 2 * (1 - 1e-9), []
    for t in sorted(own, key=lambda t: (crc32(t.encode()), t)):
        if rest < least:
            break
        out.append(t)
        rest -= own[t] * own[t]
    return out


def _leaders(threshold: float, price_limit: float) -> object:
    def run(state: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        leads, means, counts, index, out = [], [], [], {}, []
        by_prefix = threshold > 0  # else vectors without a common term match too

        def add(item: int, own: dict, mean: float, n: int) -> None:
            norm = sum(w * w for w in own.values()) ** 0.5
            for t in prefix_terms(own, norm, threshold) if by_prefix else ():
                index.setdefault(t, []).append(len(leads))
            leads.append((item, own, norm))
            means.append(mean)
            counts.append(n)

        for item, terms, weights, mean, n in state.sort_values("item")[["item", "terms", "weights", "mean", "n"]].itertuples(index=False):
            add(item, dict(zip(terms, weights, strict=True)), mean, n)
        for item, terms, weights, price in rows.sort_values("item")[["item", "terms", "weights", "price"]].itertuples(index=False):
            own = dict(zip(terms, weights, strict=True))
            norm = sum(w * w for w in own.values()) ** 0.5
            best, chosen = threshold, -1
            for g in sorted({g for t in prefix_terms(own, norm, threshold) for g in index.get(t, ())}) if by_prefix else range(len(leads)):
                high = max(means[g], price)
                if (1 - min(means[g], price) / high if high > 0 else 0) > price_limit:
                    continue
                _, other, other_norm = leads[g]
                if norm and other_norm:
                    cos = sum(w * other.get(t, 0.0) for t, w in own.items()) / (norm * other_norm)
                    if cos >= best and (cos > best or chosen < 0):
                        best, chosen = cos, g
            if chosen < 0:
                add(item, own, price, 1)
                chosen = len(leads) - 1
            else:
                means[chosen] = (means[chosen] * counts[chosen] + price) / (counts[chosen] + 1)
                counts[chosen] += 1
            out.append((item, leads[chosen][0], None, None, None, None))
        of = (rows if len(rows) else state).iloc[0]
        out += [(item, item, m, n, list(own), list(own.values())) for (item, own, _), m, n in zip(leads, means, counts, strict=True)]
        return pd.DataFrame([(of["category"], *r, of["parts"]) for r in out], columns=_COLUMNS).astype({"n": "Int64"})

    return run


def continued(items: DataFrame, groups: DataFrame | None = None, delegates: DataFrame | None = None, threshold: float = 0.995, price_limit: float = 0.3, batch: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(category, item, group_lead) of items, and the groups after them (category, item, mean, n, terms, weights), item
    being the lead. items: category, item (the order, distinct), price, terms, weights (sorted by term). groups: those of
    earlier runs; of these, only groups whose lead is among delegates (item) take part, where delegates are given. Items
    without a category are left out.
    """
    ship_package(items.sparkSession)
    rows = cut(items.select("category", "item", F.col("price").cast("double").alias("price"), "terms", "weights"))
    # Batches by ranges of the order, so that no task sorts a whole category.
    sizes = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min("item").alias("lo"), F.max("item").alias("hi"))
    parts = F.greatest(F.ceil(F.col("n") / F.lit(batch)), F.lit(1))
    sizes = cut(sizes.withColumn("parts", parts.cast("long")))
    dealt = rows.join(sizes, "category").withColumn("part", F.floor((F.col("item") - F.col("lo")) * F.col("parts") / (F.col("hi") - F.col("lo") + 1)))
    dealt = dealt.select("category", "item", "terms", "weights", "price", "parts", "part")
    empty = items.sparkSession.createDataFrame([], _OUT)
    known = empty if groups is None else groups
    if delegates is not None:
        known = known.join(delegates.select("item").distinct(), "item", "left_semi")
    filled = known.select("category", "item", F.col("item").alias("group_lead"), "mean", "n", "terms", "weights")
    state = filled.join(sizes.select("category", "parts"), "category").select(_COLUMNS)
    after = [filled.join(sizes, "category", "left_anti").drop("group_lead")]
    grouped = empty.select("category", "item", "group_lead")
    for k in range(sizes.agg(F.max("parts")).first()[0] or 0):
        now = dealt.where(F.col("part") == k)
        out = cut(state.groupBy("category").cogroup(now.groupBy("category")).applyInPandas(_leaders(threshold, price_limit), _OUT))
        grouped = grouped.unionByName(out.where("mean is null").select("category", "item", "group_lead"))
        groups_now = out.where("mean is not null")
        after.append(groups_now.where(F.col("parts") <= k + 1).drop("group_lead", "parts"))
        state = groups_now.where(F.col("parts") > k + 1)
    out = after[0]
    for done in after[1:]:
        out = out.unionByName(done)
    return grouped, out


def leader_groups(items: DataFrame, threshold: float = 0.995, price_limit: float = 0.3, batch: int = 10_000) -> DataFrame:
    """category, item, group_lead of a first run; see continued()."""
    return continued(items, threshold=threshold, price_limit=price_limit, batch=batch)[0]
