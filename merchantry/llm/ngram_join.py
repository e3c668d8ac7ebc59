"""N-gram Jaccard join by prefix trees (4).

Two documents link when 100 |A & B| >= 75 |A | B| for their sets of distinct 5-word shingles. The result is each
document's component under links. No link is lost; each step only drops what cannot link:

1. Documents with the same set are one node, named by the smallest id among them.
2. A set of n shingles that links lacks at most n - ceil(0.75 n) of them in its partner. So of the m shingles whose
   hash is in the lowest three eighths it shares at least m - n + ceil(0.75 n). Nodes that share fewer of these with all
   other nodes together go; where that bound is not positive they stay. Shingles are looked at in chunks first: from a
   chunk, a shingle goes out once, so a very common one is as many rows as there are chunks.
3. For the rest, whole sets are counted: a node less than 75% of whose shingles stand in another remaining set goes.
   The common order is rarest first. Linked sets share a shingle within the first n - ceil(0.75 n) + 1 of each. Nodes
   that share one of these prefix shingles, directly or by way of others, form a bundle; links cross no bundle.
4. In a bundle, sets are ordered by frequency and stored in a radix trie. A set is probed by walking the trie with the
   overlap counted so far, which all sets below share. A subtree is pruned when the remaining lengths cannot reach the
   overlap needed, or when all its sets are already in the probing set's component. Links found join components. The walk
   goes level by level, all open nodes of a level at once.
5. A bundle over `block_items` (shingles, and SET_WEIGHT for each set) is cut into blocks. First each of its sets is
   compared with the bundle's hub (one set); those that link with it are one component, and blocks of only such sets need
   not meet each other. Blocks hold sets of one level of sizes, levels being as wide as linked sizes may differ, and meet
   those of their own and the neighbouring levels. Each pair of blocks is a task. Memory is bounded by two blocks (a set
   longer than a block is a block).

Defined results: null and blank texts have no shingles, link with nothing and are their own component; one to four words
are one shingle; rows that repeat an id are one vertex, each with its own row in the result; rows with a null id get the
component of the documents that have the same set, or null where none has an id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from merchantry.llm import vectors
from merchantry.llm.components import components
from merchantry.session import cut, ship_package

BLOCK_ITEMS = 150_000
#: What a set counts for in a block beside its shingles.
SET_WEIGHT = 64
SAMPLED = 0.375
#: Lists of ids up to this length are broadcast; longer ones are joined by shuffles.
BROADCAST_IDS = 500_000
#: The same for the shingles of hubs.
BROADCAST_ITEMS = 4_000_000
#: Sampled shingles that one Python task looks at together, and the bits of them that are compared in the first filter.
#: Two shingles that agree in these bits keep a node at most, and none is lost.
CHUNK_ITEMS = 200_000
ITEM_BITS = 48


def needed(n, num: int = 75, den: int = 100):
    """Least overlap of a set of n with any set that it links with: ceil(n num / den)."""
    return -((-n * num) // den)


def _keys(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in vectors.pieces(batch.column(1)):
                sets = vectors.shingle_sets(vectors.words(piece, lower=True), k)
                sums = [int(vectors.mix(s.view(np.uint64)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                xors = [int(np.bitwise_xor.reduce(s)) if len(s) else 0 for s in sets]
                columns = [pa.array(c, pa.int64()) for c in ([len(s) for s in sets], sums, xors)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, piece.n), *columns], names=["doc_id", "n", "k1", "k2"])

    return run


def _low(k: int):
    """The sampled shingles of each text, with the first key of its set."""
    limit = np.int64(-(1 << 63) + int(SAMPLED * (1 << 64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in vectors.pieces(batch.column(1)):
                sets = vectors.shingle_sets(vectors.words(piece, lower=True), k)
                sums = [int(vectors.mix(s.view(np.uint64)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                low = [s[: np.searchsorted(s, limit)] for s in sets]
                columns = [pa.array(c, pa.int64()) for c in ([len(s) for s in sets], sums)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, piece.n), *columns, vectors.lists(low)], names=["doc_id", "n", "k1", "low"])

    return run


def _with_ids(rows: DataFrame, ids: DataFrame, on: list[str], how: str) -> DataFrame:
    """A semi or anti join with a list of ids, which is broadcast only if it is short."""
    ids = cut(ids)
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, how)


def _marks(num: int, den: int):
    """Rows (item, node, w) of a first filter. The sampled shingles of some `CHUNK_ITEMS` are looked at together: one that
    a single node has is (item, node, 1); of one that more have, only (item, null, 2) leaves, and their number stays with
    each node as what it met. A node's own row has in w, times 4, what it met less what it is due."""

    def rows(nodes: np.ndarray, sizes: np.ndarray, lows: list[np.ndarray]) -> pa.RecordBatch:
        count = np.array([len(s) for s in lows], np.int64)
        items = np.concatenate(lows) & ((1 << ITEM_BITS) - 1)
        owner = np.repeat(np.arange(len(lows)), count)
        _, place, often = np.unique(items, return_inverse=True, return_counts=True)
        alone = often[place] == 1
        met = np.bincount(owner[~alone], minlength=len(lows))
        due = count - (sizes - needed(sizes, num, den))
        several = np.unique(items[~alone])
        at = vectors.mix(nodes.view(np.uint64)).view(np.int64) & ((1 << ITEM_BITS) - 1)
        named = np.concatenate([nodes[owner[alone]], np.zeros(len(several), np.int64), nodes])
        absent = np.zeros(len(named), bool)
        absent[alone.sum() : alone.sum() + len(several)] = True
        w = np.concatenate([np.ones(alone.sum(), np.int64), np.full(len(several), 2), 4 * (met - due)]).astype(np.int32)
        columns = [pa.array(np.concatenate([items[alone], several, at])), pa.array(named, mask=absent), pa.array(w)]
        return pa.RecordBatch.from_arrays(columns, names=["item", "node", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, sizes, lows, held = [], [], [], 0
        for batch in batches:
            ids, n = (batch.column(c).to_numpy() for c in (0, 1))
            low = batch.column(2)
            ends, flat = low.offsets.to_numpy(), low.values.to_numpy()
            for i in range(batch.num_rows):
                nodes.append(ids[i])
                sizes.append(n[i])
                lows.append(flat[ends[i] : ends[i + 1]])
                held += len(lows[-1])
                if held >= CHUNK_ITEMS:
                    yield rows(np.array(nodes), np.array(sizes), lows)
                    nodes, sizes, lows, held = [], [], [], 0
        if nodes:
            yield rows(np.array(nodes), np.array(sizes), lows)

    return run


def _whole(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in vectors.pieces(batch.column(1)):
                sets = vectors.shingle_sets(vectors.words(piece, lower=True), k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, piece.n), vectors.lists(sets)], names=["node", "items"])

    return run


class Trie:
    """A radix trie over sorted integer sequences, built from their lexicographic order.

    Nodes are numbered by level, so that the children of a node are neighbours; all properties are arrays over nodes.
    Node i covers sequences lo..hi-1, of which the first `ended` end with it; its edge is `edge` elements from `at`.
    """

    def __init__(self, sequences: list[np.ndarray]) -> None:
        common = np.zeros(len(sequences), np.int64)
        for i, (a, b) in enumerate(zip(sequences, sequences[1:], strict=False), 1):
            m = min(len(a), len(b))
            other = np.flatnonzero(a[:m] != b[:m])
            common[i] = other[0] if len(other) else m
        size = np.array([len(s) for s in sequences])
        edges, rows, level, filled = [], [], [(0, len(sequences), 0)], 0
        while level:
            below = []
            for lo, hi, depth in level:
                end = int(size[lo]) if hi - lo == 1 else int(min(size[lo], common[lo + 1 : hi].min()))
                edges.append(sequences[lo][depth:end])
                begin = lo
                while begin < hi and size[begin] == end:
                    begin += 1
                cuts = [begin, *(begin + 1 + np.flatnonzero(common[begin + 1 : hi] == end)).tolist(), hi] if begin < hi else []
                last = int(sequences[lo][end - 1]) if end else -1
                rows.append((lo, hi, end, begin - lo, filled, end - depth, last, size[lo:hi].min(), size[lo:hi].max(), len(below), max(len(cuts) - 1, 0)))
                filled += end - depth
                below += [(x, y, end) for x, y in zip(cuts, cuts[1:], strict=False)]
            # children are counted from the start of their level; the level follows the nodes so far
            first = len(rows)
            for i in range(first - len(level), first):
                rows[i] = (*rows[i][:9], rows[i][9] + first, rows[i][10])
            level = below
        self.labels = np.concatenate(edges)
        table = np.array(rows, np.int64).T
        self.lo, self.hi, self.depth, self.ended, self.at, self.edge, self.last, self.least, self.most, self.child, self.children = table


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers of the given ranges, one range after another."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(counts.sum())


def link_components(sets: list[np.ndarray], num: int = 75, den: int = 100, start: np.ndarray | None = None, stored: np.ndarray | None = None) -> np.ndarray:
    """The component label of each set under links among them. start has labels that are known already. stored marks the
    sets that go into the trie, the others probe it; without it all sets do both."""
    label = np.arange(len(sets)) if start is None else start.copy()
    filled = [i for i, s in enumerate(sets) if len(s)]
    if len(filled) < 2:
        return label
    values, counts = np.unique(np.concatenate([sets[i] for i in filled]), return_counts=True)
    place = np.empty(len(values), np.int64)
    place[np.argsort(-counts, kind="stable")] = np.arange(len(values))
    ranked = {i: np.sort(place[np.searchsorted(values, sets[i])]) for i in filled}
    order = sorted((i for i in filled if stored is None or stored[i]), key=lambda i: ranked[i].astype(">i8").tobytes())
    probes = order if stored is None else [i for i in filled if not stored[i]]
    if not order or not probes:
        return label
    trie, order, marks = Trie([ranked[i] for i in order]), np.array(order), np.zeros(len(values), np.int64)
    other = np.zeros(len(order) + 1, np.int64)
    for probe in probes:
        own, n = ranked[probe], len(ranked[probe])
        marks[own] = 1
        nodes, overlap, changed = np.zeros(1, np.int64), np.zeros(1, np.int64), True
        while len(nodes):
            if changed:
                np.cumsum(label[order] != label[probe], out=other[1:])
                changed = False
            # subtrees of sets in the probe's component, or of lengths that cannot link, are pruned
            open_ = (other[trie.hi[nodes]] > other[trie.lo[nodes]]) & (trie.most[nodes] * den >= n * num) & (trie.least[nodes] * num <= n * den)
            nodes, overlap = nodes[open_], overlap[open_]
            if not len(nodes):
                break
            edge = trie.edge[nodes]
            seen = np.concatenate([[0], np.cumsum(marks[trie.labels[ranges(trie.at[nodes], edge)]])])
            ends = np.cumsum(edge)
            overlap = overlap + seen[ends] - seen[ends - edge]
            # and those where the lengths that remain cannot reach the overlap needed
            possible = overlap + np.minimum(n - np.searchsorted(own, trie.last[nodes], "right"), trie.most[nodes] - trie.depth[nodes])
            open_ = possible * (num + den) >= num * (n + trie.least[nodes])
            nodes, overlap = nodes[open_], overlap[open_]
            linked = nodes[(trie.ended[nodes] > 0) & (den * overlap >= num * (n + trie.depth[nodes] - overlap))]
            if len(linked):
                met = np.unique(label[order[ranges(trie.lo[linked], trie.ended[linked])]])
                met = met[met != label[probe]]
                if len(met):
                    label[np.isin(label, met)] = label[probe]
                    changed = True
            count = trie.children[nodes]
            nodes, overlap = ranges(trie.child[nodes], count), np.repeat(overlap, count)
        marks[own] = 0
    return label


def _task(num: int, den: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, hub = rows["node"].to_numpy(), rows["at_hub"].to_numpy(bool)
        start = np.arange(len(nodes))
        known = np.flatnonzero(hub)
        if len(known):
            start[known] = known[0]
        x, y = int(rows["x"].iloc[0]), int(rows["y"].iloc[0])
        stored = None if x == y else rows["code"].to_numpy() == y
        label = link_components([np.asarray(s, np.int64) for s in rows["items"]], num, den, start, stored)
        least = pd.Series(nodes).groupby(label).transform("min").to_numpy()
        moved = least != nodes
        return pd.DataFrame({"a": nodes[moved], "b": least[moved]})

    return run


def _linked_to_hub(num: int, den: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            got = []
            for own, hub in zip(rows["items"], rows["hub"], strict=True):
                same = len(np.intersect1d(np.asarray(own), np.asarray(hub), assume_unique=True))
                got.append(den * same >= num * (len(own) + len(hub) - same))
            yield rows.drop(columns="hub").assign(at_hub=got)

    return run


def _bundle_links(sets: DataFrame, num: int, den: int, block_items: int) -> DataFrame:
    """Links (a, b) that span each bundle's components. sets: node, bundle, items."""
    weight = F.sum(F.size("items") + SET_WEIGHT)
    sized = cut(sets.groupBy("bundle").agg(weight.alias("weight"), F.min("node").alias("hub_node")))
    large = sized.where(F.col("weight") > block_items).select("bundle", "hub_node")
    n_large = large.count()  # at most all items / block_items
    short = n_large <= BROADCAST_IDS
    small = sets.join(F.broadcast(large) if short else large, "bundle", "left_anti")
    zero = [F.lit(0).cast("long").alias(c) for c in ("code", "x", "y")]
    small = small.select("bundle", "node", "items", F.lit(False).alias("at_hub"), *zero)
    links = small.groupBy("bundle").applyInPandas(_task(num, den), "a long, b long")
    if not n_large:
        return links
    mine = sets.join(F.broadcast(large) if short else large, "bundle")
    hubs = cut(mine.where("node = hub_node").select(F.col("bundle").alias("hb"), F.col("items").alias("hub")))
    held = hubs.agg(F.sum(F.size("hub"))).first()[0]
    met = mine.join(F.broadcast(hubs) if held <= BROADCAST_ITEMS else hubs, F.col("bundle") == F.col("hb"))
    met = met.select("bundle", "node", "items", "hub_node", "hub")
    mine = cut(met.mapInPandas(_linked_to_hub(num, den), "bundle long, node long, items array<long>, hub_node long, at_hub boolean"))
    spans = mine.where("at_hub and node <> hub_node").select(F.col("node").alias("a"), F.col("hub_node").alias("b"))
    # Sets of sizes a <= b link only if b <= a den / num: in levels of that width, a set meets its own and the next two.
    width = float(np.log(den / num * 1.0001))
    mine = mine.withColumn("level", F.floor(F.log(F.size("items").cast("double")) / width).cast("int"))
    kinds = mine.groupBy("bundle", "level", "at_hub").agg(F.ceil(weight / F.lit(block_items)).cast("int").alias("blocks"))
    kinds = cut(kinds)
    fit = F.broadcast(kinds) if kinds.count() <= BROADCAST_IDS else kinds
    code = lambda level, hub, block: F.shiftleft(level.cast("long"), 33) + F.shiftleft(hub.cast("long"), 32) + block
    dealt = mine.join(fit, ["bundle", "level", "at_hub"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.select("bundle", "node", "items", "at_hub", "level", code(F.col("level"), F.col("at_hub"), F.col("block")).alias("code"))
    dealt = dealt.withColumn("near", F.explode(F.array(*(F.col("level") + d for d in (-1, 0, 1)))))
    other = fit.select(F.col("bundle").alias("ob"), F.col("level").alias("ol"), F.col("at_hub").alias("oh"), F.col("blocks").alias("on"))
    # Sets that linked with the hub are one component: their blocks need not meet each other.
    spread = dealt.join(other, (F.col("bundle") == F.col("ob")) & (F.col("near") == F.col("ol")) & ~(F.col("at_hub") & F.col("oh")))
    spread = spread.withColumn("ob", F.explode(F.sequence(F.lit(0), F.col("on") - 1))).withColumn("with", code(F.col("ol"), F.col("oh"), F.col("ob")))
    spread = spread.select("bundle", "node", "items", "at_hub", "code", F.least("code", "with").alias("x"), F.greatest("code", "with").alias("y"))
    crossed = spread.groupBy("bundle", "x", "y").applyInPandas(_task(num, den), "a long, b long")
    return links.union(spans).union(crossed)


def near_duplicates(docs: DataFrame, similarity: tuple[int, int] = (75, 100), words: int = 5, block_items: int = BLOCK_ITEMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    num, den = similarity
    ship_package(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    slim = cut(texts.mapInArrow(_keys(words), "doc_id long, n long, k1 long, k2 long"))
    key, least = ["n", "k1", "k2"], F.ceil(F.col("n") * num / F.lit(den))
    nodes = cut(slim.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("node")).where("node is not null"))
    # 2. One node for each set; low shingles that two nodes share. Low shingles are taken from the texts anew: kept, they
    # would be a quarter of the input. They are shuffled once, and a shingle reaches its task once from each chunk.
    copies = slim.join(nodes, key).where("doc_id <> node").select("doc_id", "k1").distinct()
    low = texts.where("doc_id is not null").mapInArrow(_low(words), "doc_id long, n long, k1 long, low array<long>").where("n > 0")
    firsts = _with_ids(low, copies, ["doc_id", "k1"], "left_anti").select("doc_id", "n", "low")
    marks = firsts.mapInArrow(_marks(num, den), "item long, node long, w int")
    cover = F.sum(F.col("w").bitwiseAND(3)).over(Window.partitionBy("item"))
    met = marks.withColumn("total", cover).where("node is not null")
    gain = F.when(F.col("w") == 1, (F.col("total") > 1).cast("int")).otherwise(F.shiftright("w", 2))
    alive = met.groupBy("node").agg(F.sum(gain).alias("rest")).where("rest >= 0").select(F.col("node").alias("doc_id"))
    # 3. Whole sets of the nodes that are left.
    chosen = _with_ids(texts, alive, ["doc_id"], "left_semi")
    if not slim.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null").isEmpty():
        chosen = chosen.dropDuplicates(["doc_id", "text"])  # repeated rows would count as sets of their own
    sets = cut(chosen.mapInArrow(_whole(words), "node long, items array<long>").withColumn("n", F.size("items"))).where("n > 0")
    entries = sets.select("node", "n", F.explode("items").alias("item"))
    shared = entries.groupBy("item").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # Of n shingles, n - c are in no other set and come first; the prefix has n - ceil(0.75 n) + 1 - (n - c) shared ones.
    ordered = entries.join(shared, "item").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("s"))
    take = (F.size("s") - least + 1).cast("int")
    prefix = ordered.where(take > 0).select("node", F.explode(F.slice("s", F.lit(1), take)).alias("s"))
    prefix = cut(prefix.select("node", F.col("s.item").alias("item")))
    leads = prefix.groupBy("item").agg(F.min("node").alias("lead"), F.max("node").alias("top")).where("lead < top")
    ties = prefix.join(leads, "item").where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    bundles = components(ties).withColumnRenamed("component", "bundle")
    links = _bundle_links(cut(sets.join(bundles, "node").select("node", "bundle", "items")), num, den, block_items)
    found = components(links)
    named = nodes.join(found, "node", "left").select(*key, F.coalesce("component", "node").alias("component_id"))
    # The many copies of one set meet a single row of named: Spark splits such a partition of the join.
    out = slim.join(named, key, "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The rows of docs that stay: the smallest id of each component, once; documents without shingles and rows with a
    null id stay."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    gone = found.where("n_shingles > 0 and doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    of = dict(zip(docs.columns, names, strict=True))
    kept = docs.toDF(*names).join(gone, F.col(of[id_col]) == F.col("gone"), "left_anti")
    blank = ~F.coalesce(F.regexp_like(F.col(of[text_col]).cast("string"), F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    alone = kept.where(F.col(of[id_col]).isNull() | blank)
    out = kept.where(F.col(of[id_col]).isNotNull() & ~blank).dropDuplicates([of[id_col]]).unionByName(alone)
    return out.toDF(*docs.columns)
