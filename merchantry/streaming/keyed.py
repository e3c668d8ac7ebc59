"""Jobs that keep a state for each key in Spark's state store: evolving groups and a queue with timers.

Both are stateful processors of transformWithStateInPandas. A stream that is stopped and started again on its checkpoint goes
on with the states of its keys; a micro-batch that is repeated after a failure starts from the states before it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from merchantry.operators.grouping import prefix_terms
from merchantry.session import ship_package

_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """A stream started within keeps its states in RocksDB, which states of many columns need."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


class LeaderGroups(StatefulProcessor):
    """The groups of a category: by lead its mean price, count and vector, and by term the leads that have the term in
    their prefix. Rows of a micro-batch only read the groups that share a prefix term with them."""

    def __init__(self, threshold: float, price_limit: float) -> None:
        self.threshold, self.price_limit = threshold, price_limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.groups = handle.getMapState("groups", "lead long", "mean double, n long, terms array<string>, weights array<double>")
        self.index = handle.getMapState("index", "term string", "leads array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        groups: dict[int, list | None] = {}
        index: dict[str, list[int]] = {}
        changed: set[int] = set()
        grown: set[str] = set()

        def leads(term: str) -> list[int]:
            if term not in index:
                index[term] = [int(x) for x in self.index.getValue((term,))[0]] if self.index.containsKey((term,)) else []
            return index[term]

        def group(lead: int) -> list | None:
            """mean, n, vector and its norm; None if the lead has gone."""
            if lead not in groups:
                found = self.groups.getValue((lead,)) if self.groups.containsKey((lead,)) else None
                own = None if found is None else dict(zip(found[2], found[3], strict=True))
                groups[lead] = None if found is None else [found[0], found[1], own, sum(w * w for w in own.values()) ** 0.5]
            return groups[lead]

        out = []
        batch = pd.concat(list(rows)).sort_values("item", kind="stable")
        for item, price, terms, weights in batch[["item", "price", "terms", "weights"]].itertuples(index=False):
            if terms is None:
                if group(item) is not None:
                    groups[item] = None
                    changed.add(item)
                continue
            own = dict(zip(terms, weights, strict=True))
            norm = sum(w * w for w in own.values()) ** 0.5
            prefix = prefix_terms(own, norm, self.threshold)
            best, chosen = self.threshold, None
            for lead in sorted({g for t in prefix for g in leads(t)}):
                found = group(lead)
                if found is None or not norm:
                    continue
                high = max(found[0], price)
                if (1 - min(found[0], price) / high if high > 0 else 0) > self.price_limit:
                    continue
                cos = sum(w * found[2].get(t, 0.0) for t, w in own.items()) / (norm * found[3])
                if cos >= best and (cos > best or chosen is None):
                    best, chosen = cos, lead
            if chosen is None:
                chosen = item
                groups[item] = [price, 1, own, norm]
                for t in prefix:
                    leads(t).append(item)
                    grown.add(t)
            else:
                groups[chosen][:2] = [(groups[chosen][0] * groups[chosen][1] + price) / (groups[chosen][1] + 1), groups[chosen][1] + 1]
            changed.add(chosen)
            out.append((key[0], item, chosen))
        for lead in changed:
            if groups[lead] is None:
                self.groups.removeKey((lead,))
            else:
                mean, n, own, _ = groups[lead]
                self.groups.updateValue((lead,), (float(mean), int(n), list(own), [float(w) for w in own.values()]))
        for term in grown:
            self.index.updateValue((term,), (index[term],))
        yield pd.DataFrame(out, columns=["category", "item", "group_lead"]).astype({"item": "int64", "group_lead": "int64"})

    def close(self) -> None:
        pass


def leader_group_stream(items: DataFrame, out: str, checkpoint: str, threshold: float = 0.995, price_limit: float = 0.3) -> DataFrame:
    """Takes all available micro-batches of a stream of items (category, item, price, terms, weights, sorted by term) and
    returns category, item and group_lead of all items so far. Items of a micro-batch come in order of item, micro-batches
    in order of arrival. A row without terms says that its item has gone: the group that it leads takes no part any
    more. Items without a category are left out. threshold is over 0."""
    spark = items.sparkSession
    ship_package(spark)
    rows = items.where("category is not null").select("category", "item", F.col("price").cast("double").alias("price"), "terms", "weights")
    grouped = rows.groupBy("category").transformWithStateInPandas(LeaderGroups(threshold, price_limit), "category string, item long, group_lead long", "Append", "None")
    with state_store(spark):
        query = grouped.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.parquet(out)


class Requeue(StatefulProcessor):
    """A row of a queue: its state and the time it was last touched. A timer rings where the state has lasted too long."""

    def __init__(self, stale_hours: float) -> None:
        self.stale = stale_hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", "state string, since timestamp, cycle double")

    def _limit(self, state: str, cycle: float | None) -> float | None:
        return self.stale if state == "crawling" else cycle if state == "finished" else None

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values("time", kind="stable")
        state, time, cycle = batch[["state", "time", "cycle"]].iloc[-1]
        if self.row.exists() and pd.Timestamp(self.row.get()[1]).tz_localize(None) > pd.Timestamp(time).tz_localize(None):
            return
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        cycle = None if pd.isna(cycle) else float(cycle)
        self.row.update((state, pd.Timestamp(time).to_pydatetime(), cycle))
        limit = self._limit(state, cycle)
        if limit is not None:
            # Longer than the limit: a millisecond more.
            self.handle.registerTimer(int(pd.Timestamp(time).timestamp() * 1000 + limit * 3_600_000) + 1)
        yield pd.DataFrame({"key": [key[0]], "state": [state], "time": [pd.Timestamp(time)]})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = dt.datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, dt.timezone.utc).replace(tzinfo=None)
        self.row.update(("queued", now, None if not self.row.exists() else self.row.get()[2]))
        yield pd.DataFrame({"key": [key[0]], "state": ["queued"], "time": [pd.Timestamp(now)]})

    def close(self) -> None:
        pass


def requeue_stream(changes: DataFrame, out: str, checkpoint: str, late: str = "0 seconds", stale_hours: float = 72.0) -> DataFrame:
    """Takes all available micro-batches of a stream of queue rows (key, state, time, cycle in hours) and returns every change
    of state (key, state, time), those by timers too: crawling for more than stale_hours and finished for more than the
    row's cycle become queued. The clock is the time of the rows less `late`."""
    spark = changes.sparkSession
    ship_package(spark)
    rows = changes.select("key", "state", "time", F.col("cycle").cast("double").alias("cycle")).withWatermark("time", late)
    kind = rows.schema["key"].dataType.simpleString()
    moved = rows.groupBy("key").transformWithStateInPandas(Requeue(stale_hours), f"key {kind}, state string, time timestamp", "Append", "EventTime")
    with state_store(spark):
        query = moved.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.parquet(out)
