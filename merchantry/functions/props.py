"""Properties and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prop_quads(text: Column) -> Column:
    """The parts `pid:vid:pname:vname` of a property string as arrays of four; other parts are skipped."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: F.split(p, ":", -1)), lambda q: F.size(q) == 4)


def props_map(text: Column) -> Column:
    """pname -> vname, trimmed; of equal names the last wins, whatever the session's policy for map keys."""
    entries = F.transform(prop_quads(text), lambda q: F.struct(F.trim(q[2]).alias("k"), F.trim(q[3]).alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["k"] == e["k"]))
    return F.map_from_entries(last)


def prop(props: Column, *names: str) -> Column:
    """The first of the named properties that is there."""
    return F.coalesce(*(F.try_element_at(props, F.lit(n)) for n in names))


def prop_counts(rows: DataFrame, text: str, category: str) -> DataFrame:
    """kind, key, category and count: by property, by value, and by property and category, in one pass. Rows are spread
    once and counted by grouping sets, not read three times."""
    quads = rows.select(F.col(category).cast("string").alias("category"), F.explode(prop_quads(F.col(text))).alias("q"))
    keyed = quads.select(
        "category",
        F.explode(
            F.array(
                F.struct(F.lit("prop").alias("kind"), F.col("q")[0].alias("key"), F.lit(False).alias("by")),
                F.struct(F.lit("value").alias("kind"), F.col("q")[1].alias("key"), F.lit(False).alias("by")),
                F.struct(F.lit("prop_category").alias("kind"), F.col("q")[0].alias("key"), F.lit(True).alias("by")),
            )
        ).alias("k"),
    )
    keyed = keyed.select("k.kind", "k.key", F.when(F.col("k.by"), F.col("category")).alias("category"))
    return keyed.groupBy("kind", "key", "category").agg(F.count(F.lit(1)).alias("n"))


def image_urls(images: Column) -> Column:
    """An array of structs with url as an array of urls."""
    return F.transform(images, lambda x: x["url"])


def upload_params(item: DataFrame, key: str, scalars: list[str], images: str) -> DataFrame:
    """Each item as rows (key, name, value) of a form; image urls repeat the name image_url."""
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in scalars))
    more = F.transform(F.coalesce(F.col(images), F.array().cast("array<string>")), lambda u: F.struct(F.lit("image_url").alias("name"), u.alias("value")))
    return item.select(key, F.explode(F.concat(pairs, more)).alias("p")).select(key, "p.name", "p.value")


def standard_item(raw: DataFrame) -> DataFrame:
    """Raw records as standard ones: nested fields flattened, properties parsed, in stock."""
    return raw.select(
        "num_iid",
        "api_data.title",
        "api_data.nick",
        "api_data.cid",
        F.col("api_data.price").try_cast("float").alias("price"),
        props_map(F.col("api_data.props_name")).alias("props"),
        image_urls(F.col("api_data.item_imgs")).alias("item_imgs"),
        F.lit(True).alias("in_stock"),
        F.lit(0).cast("long").alias("score"),
    )
