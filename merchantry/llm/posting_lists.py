"""Approximate nearest neighbours by balanced posting lists (13).

Vectors are dealt to lists, a query looks at a few lists, and within these its distances are exact.

- Fit. The lists' centroids are those of a bounded sample (at most `sample_rows` vectors and SAMPLE_BYTES), which is cut in
  two halves of equal size along its 2-means direction again and again: all lists get the same share of the sample.
- Graph. Centroids (at most `max_lists`) are kept in memory, each linked with its nearest ones and, for the graph to be
  connected, with the next in the order of cutting. A point walks the graph from a few entries: all centroids that are
  near enough and not yet opened are opened together, for a batch of points at once.
- Boundary vectors. A vector goes to its nearest list and also to others whose centroid is at most `closure` times as far,
  up to `replicas` lists.
- Pruning. A query takes the lists whose centroid is at most `ratio` times as far as its nearest one. The ratio is not
  given but measured: on queries of the sample, the least one that finds `recall` of their true neighbours in the sample.
  Where vectors hardly differ in distance (near uniform ones) it comes out wide, and many lists are looked at. A query
  also goes on to further lists until they hold k + 1 vectors, all lists if need be, so it never finds too few.

Every vector is indexed. Of identical vectors only the k + 1 smallest ids can be among anyone's k nearest, so the others
leave before lists are made; identical queries are searched once. Lists are cut into blocks of at most `block_rows`
vectors, queries of a list likewise, so that a list of any size is many rows of a join. Screening is by matrix products;
what may be among the k + 1 nearest of a block is measured again by differences, in double precision.

Defined results: null vectors, zero vectors, those with a null, NaN or infinite component, those of another length than
the most common one (ties: the shorter) and rows with a null id take no part; of rows with one id the least vector is
taken; equal distances are in order of id; with fewer than k other vectors all are returned; one vector, or none, gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchantry.session import cut, ship_package

SAMPLE_BYTES, BLOCK_BYTES = 64 << 20, 4 << 20
LINKS, ENTRIES, POINTS = 24, 16, 256


class Index(NamedTuple):
    """Centroids, in units of scale, the neighbours of each in the graph, and the ratios for vectors and for queries."""

    scale: float
    centroids: np.ndarray
    links: np.ndarray
    closure: float
    ratio: float


def balanced_lists(points: np.ndarray, lists: int, seed: int = 13) -> list[np.ndarray]:
    """Rows of points in `lists` parts of equal size (but for one), cut in two along the direction between two means."""
    rng, out, open_ = np.random.default_rng(seed), [], [(np.arange(len(points)), lists)]
    while open_:
        rows, n = open_.pop()
        if n == 1 or len(rows) < 2:
            out.append(rows)
            continue
        own, half = points[rows], min(max(len(rows) * (n // 2) // n, 1), len(rows) - 1)
        means = own[rng.choice(len(rows), 2, replace=False)]
        for _ in range(6):
            order = np.argsort(own @ (means[1] - means[0]), kind="stable")
            means = np.stack([own[order[:half]].mean(0), own[order[half:]].mean(0)])
        open_ += [(rows[order[half:]], n - n // 2), (rows[order[:half]], n // 2)]
    return out


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def linked(centroids: np.ndarray) -> np.ndarray:
    """A row of neighbours for each centroid: its nearest ones, and the ones before and after it."""
    n = len(centroids)
    near = np.concatenate([np.argsort(_squares(centroids[i : i + 512], centroids), 1)[:, 1 : LINKS + 1] for i in range(0, n, 512)])
    own = np.arange(n)
    return np.concatenate([near, ((own + 1) % n)[:, None], ((own - 1) % n)[:, None]], 1)


def walk(index: Index, points: np.ndarray, ratio: float, least: int) -> np.ndarray:
    """Distances of points to centroids, infinite for those that the walk did not meet. It meets what the graph leads to
    by centroids at most ratio times as far as the nearest, or among the `least` nearest."""
    n = len(index.centroids)
    points = np.clip(points / index.scale, -1e100, 1e100)  # squares of any finite vector stay finite
    out = np.full((len(points), n), np.inf)
    opened = np.zeros(out.shape, bool)
    entries = np.unique(np.arange(min(ENTRIES, n)) * n // min(ENTRIES, n))
    out[:, entries] = np.sqrt(_squares(points, index.centroids[entries]))
    while True:
        bound = np.maximum(out.min(1) * ratio, np.partition(out, min(least, n) - 1, 1)[:, min(least, n) - 1])
        row, node = np.nonzero((out <= bound[:, None]) & ~opened & np.isfinite(out))
        if not len(row):
            return out
        opened[row, node] = True
        fresh = np.zeros(out.shape, bool)
        fresh[np.repeat(row, index.links.shape[1]), index.links[node].ravel()] = True
        row, node = np.nonzero(fresh & np.isinf(out))
        for i in range(0, len(row), 1 << 16):
            r, c = row[i : i + (1 << 16)], node[i : i + (1 << 16)]
            out[r, c] = np.sqrt(((points[r] - index.centroids[c]) ** 2).sum(1))


def lists_of_vectors(index: Index, points: np.ndarray, replicas: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, list and place (0: the nearest) of each list that a point goes to."""
    far = walk(index, points, index.closure, replicas + 4)
    near = np.argsort(far, 1, kind="stable")[:, :replicas]
    took = np.take_along_axis(far, near, 1)
    row, place = np.nonzero(np.isfinite(took) & (took <= took[:, :1] * index.closure))
    return row, near[row, place], place


def lists_of_queries(index: Index, points: np.ndarray, held: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and list of each list that a query looks at. held: vectors that have the list as their nearest."""
    far = walk(index, points, index.ratio, 32)
    order = np.argsort(far, 1, kind="stable")
    took = np.take_along_axis(far, order, 1)
    before = np.cumsum(held[order], 1) - held[order]
    chosen = np.isfinite(took) & ((took <= took[:, :1] * index.ratio) | (before < k + 1))
    short = (held[order] * chosen).sum(1) < k + 1
    chosen[short] = True
    row, place = np.nonzero(chosen)
    return row, order[row, place]


def fit(sample: np.ndarray, lists: int, replicas: int, closure: float, recall: float, k: int) -> Index:
    """An index of `lists` lists, its ratio measured on the sample."""
    scale = float(np.abs(sample).max())
    sample = np.unique(sample / scale, axis=0)  # copies would be centroids of their own
    parts = balanced_lists(sample, min(lists, len(sample)))
    centroids = np.stack([sample[p].mean(0) for p in parts])
    index = Index(1.0, centroids, linked(centroids), closure, np.inf)
    queries = sample[np.linspace(0, len(sample) - 1, min(256, len(sample))).astype(int)]
    near = [np.argsort(((sample - q) ** 2).sum(1), kind="stable")[1 : k + 1] for q in queries]
    asked, of = np.unique(np.concatenate(near), return_inverse=True) if near else (np.zeros(0, np.int64), None)
    member = np.full((len(asked), replicas), -1)
    for i in range(0, len(asked), POINTS):
        row, to, place = lists_of_vectors(index, sample[asked[i : i + POINTS]], replicas)
        member[i + row, place] = to
    needs, at = [], 0
    for q, own in zip(queries, near, strict=True):
        far = np.append(np.sqrt(((centroids - q) ** 2).sum(1)), np.inf)  # place -1: no list
        if len(own) and far.min() > 0:
            needs.append(far[member[of[at : at + len(own)]]].min(1) / far.min())
        at += len(own)
    ratio = float(np.quantile(np.concatenate(needs), recall)) if needs else 1.0
    return index._replace(scale=scale, ratio=max(ratio, 1.0) * (1 + 1e-9))


def nearest(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, id and distance of the k nearest vectors of each query, ties by id."""
    with np.errstate(over="ignore", invalid="ignore"):
        norms = (vectors * vectors).sum(1)
        rough = (queries * queries).sum(1)[:, None] + norms - 2 * queries @ vectors.T
        if np.isfinite(rough).all():
            slack = 1e-9 * ((queries * queries).sum(1) + norms.max())
            bound = np.partition(rough, k - 1, 1)[:, k - 1] if len(vectors) > k else np.full(len(queries), np.inf)
            row, col = np.nonzero(rough <= (bound + slack)[:, None])
        else:
            row, col = (x.ravel() for x in np.indices(rough.shape))
        exact = np.concatenate([np.sqrt(((queries[row[i : i + 65536]] - vectors[col[i : i + 65536]]) ** 2).sum(1)) for i in range(0, len(row), 65536)])
    order = np.lexsort((ids[col], exact, row))
    row, col, exact = row[order], col[order], exact[order]
    place = np.arange(len(row)) - np.searchsorted(row, row, "left")
    kept = place < k
    return row[kept], ids[col[kept]], exact[kept]


def _matrix(values: pa.Array) -> np.ndarray:
    """A list column, all of one length, as rows of doubles."""
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(values), -1)


def _posted(index: object, replicas: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, POINTS):
                part = batch.slice(i, POINTS)
                row, of, place = lists_of_vectors(index.value, _matrix(part.column(1)), replicas)
                columns = [pa.array(of, pa.int32()), pa.array(place == 0), *(c.take(pa.array(row)) for c in part.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=["list", "first", *part.schema.names])

    return run


def _asked(index: object, held: object, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, POINTS):
                part = batch.slice(i, POINTS)
                row, of = lists_of_queries(index.value, _matrix(part.column(1)), held.value, k)
                columns = [pa.array(of, pa.int32()), *(c.take(pa.array(row)) for c in part.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=["list", *part.schema.names])

    return run


def _measured(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked, block = batch.column(0)[i].values, batch.column(1)[i].values
                row, ids, score = nearest(_matrix(block.field("v")), block.field("id").to_numpy(), _matrix(asked.field("v")), k)
                query = asked.field("id").to_numpy()[row]
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids), pa.array(score)], names=["query", "vec_id", "score"])

    return run


def _blocks(rows: DataFrame, block_rows: int, name: str) -> DataFrame:
    """list and an array of at most about block_rows (id, v) a row."""
    parts = cut(rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("parts")))
    dealt = rows.join(F.broadcast(parts), "list")  # one row a list, of which there are at most max_lists
    block = F.pmod(F.xxhash64("id"), F.col("parts")).alias("block")
    return dealt.groupBy("list", block).agg(F.collect_list(F.struct("id", "v")).alias(name)).drop("block")


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v of the vectors that take part."""
    v, finite = F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    rows = rows.where(F.forall(v, finite) & F.exists(v, lambda x: x != 0))
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (width.n if width else 0))
    # Where no id stands twice, which 8 bytes a row tell, vectors are not moved.
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    return rows


def search(vectors: DataFrame, is_query: Column, k: int = 10, recall: float = 0.97, list_rows: int = 128, max_lists: int = 4096, replicas: int = 4, closure: float = 1.05, sample_rows: int = 32_768, block_rows: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of the k nearest other vectors found for each row of
    vectors for which is_query, a condition on its column `id`, holds."""
    spark = vectors.sparkSession
    ship_package(spark)
    known = cut(usable(vectors, id_col, vector_col).withColumn("same", F.xxhash64("v")))
    alike = ["same", "v"]  # equal hashes of different vectors do no harm
    copy = F.row_number().over(Window.partitionBy(*alike).orderBy("id"))  # Spark cuts off copies before it shuffles, too
    candidates = cut(known.withColumn("copy", copy).where(F.col("copy") <= k + 1).select("id", "v"))
    queries = known.where(is_query)
    total, width = candidates.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    out = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], out)
    most = max(min(sample_rows, SAMPLE_BYTES // (8 * width)), 1)
    share = min(1.0, 0.95 * most / total)
    chosen = candidates.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = _matrix(chosen.select("v").toArrow().column(0).combine_chunks())  # share keeps it below `most` rows
    lists = max(1, min(-(-total // list_rows), max_lists, len(sample), SAMPLE_BYTES // (8 * width)))
    index = spark.sparkContext.broadcast(fit(sample, lists, replicas, closure, recall, k))
    kind = candidates.schema["v"].dataType.simpleString()
    posted = cut(candidates.mapInArrow(_posted(index, replicas), f"list int, first boolean, id long, v {kind}"))
    held = np.zeros(len(index.value.centroids), np.int64)
    for r in posted.where("first").groupBy("list").count().collect():  # one row a list
        held[r["list"]] = r["count"]
    leads = queries.groupBy(*alike).agg(F.min("id").alias("lead"))
    asked = leads.select(F.col("lead").alias("id"), "v").mapInArrow(_asked(index, spark.sparkContext.broadcast(held), k), f"list int, id long, v {kind}")
    size = max(min(block_rows, BLOCK_BYTES // (8 * width)), 1)
    pairs = _blocks(cut(asked), size, "asked").join(_blocks(posted.drop("first"), size, "posted"), "list").select("asked", "posted")
    found = pairs.mapInArrow(_measured(k + 1), "query long, vec_id long, score double")
    # A vector of several lists is found several times, with one rank.
    order = Window.partitionBy("query").orderBy("score", "vec_id")
    found = found.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= k + 1)
    found = found.dropDuplicates(["query", "vec_id"])
    of = queries.join(leads, alike).select(F.col("id").alias("query_id"), F.col("lead").alias("query"))
    of = of.join(found, "query").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return of.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
