"""Jobs with keyed state against plain Python, over micro-batches and restarts."""

import datetime as dt
import math
import random
import time

from merchantry.operators import grouping
from merchantry.plans import mining
from merchantry.streaming import incremental, keyed

ITEMS = "category string, item long, price double, terms array<string>, weights array<double>"


def brute_groups(rows, threshold=0.995, price_limit=0.3):
    """rows in order of arrival -> {item: lead}; a row without terms takes the group of its item out."""
    groups, out = {}, {}
    for category, item, price, terms, weights in rows:
        if category is None:
            continue
        if terms is None:
            groups.pop((category, item), None)
            continue
        own = dict(zip(terms, weights, strict=True))
        norm = math.sqrt(sum(w * w for w in own.values()))
        best, chosen = threshold, None
        for (c, lead), (mean, _, other) in sorted(groups.items()):
            far = 0 if max(mean, price) <= 0 else 1 - min(mean, price) / max(mean, price)
            size = math.sqrt(sum(w * w for w in other.values()))
            if c != category or far > price_limit or not norm or not size:
                continue
            cos = sum(w * other.get(t, 0) for t, w in own.items()) / (norm * size)
            if cos >= best and (cos > best or chosen is None):
                best, chosen = cos, lead
        if chosen is None:
            groups[category, item] = [price, 1, own]
            chosen = item
        else:
            g = groups[category, chosen]
            g[:2] = [(g[0] * g[1] + price) / (g[1] + 1), g[1] + 1]
        out[item] = chosen
    return out


def test_groups_go_on_over_batches_and_a_restart(spark, tmp_path):
    rng = random.Random(9)
    kinds = [sorted(rng.sample("abcdefgh", 4)) for _ in range(6)]
    weights = [[rng.randint(1, 9) / 2 for _ in k] for k in kinds]
    rows = []
    for i in range(90):
        k = rng.randrange(6)
        rows.append((rng.choice(["c", "c", "d", None]), i, 10.0 + rng.random() * 8, kinds[k], [w * rng.choice([1, 1.02]) for w in weights[k]]))
    rows.append(("c", 90, 11.0, [], []))
    for at, (c, lead, *_) in ((40, rows[3]), (70, rows[5])):
        rows.insert(at, (c, lead, None, None, None))
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def land(part):
        spark.createDataFrame(part, ITEMS).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)  # files are read in order of their times

    def taken():
        source = incremental.files(spark, folder, spark.createDataFrame([], ITEMS).schema, per_batch=1)
        return keyed.leader_group_stream(source, out, checkpoint)

    for a, b in ((0, 25), (25, 40), (40, 41)):
        land(rows[a:b])
    first = {r.item: r.group_lead for r in taken().collect()}
    for a, b in ((41, 70), (70, 71), (71, len(rows))):
        land(rows[a:b])
    got = {r.item: r.group_lead for r in taken().collect()}
    assert got == brute_groups(rows) and first.items() <= got.items()
    assert 8 < len(set(got.values())) < len(got)


def test_queue_rows_are_requeued_by_timers(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    at = lambda hours: start + dt.timedelta(hours=hours)
    schema = "key long, state string, time timestamp, cycle double"
    batches = [
        [(1, "crawling", at(0), None), (2, "finished", at(0), 100.0), (3, "queued", at(0), 10.0), (4, "crawling", at(0), 5.0)],
        [(4, "finished", at(1), 5.0), (5, "crawling", at(72), None)],
        [(6, "queued", at(73), None)],
        [(6, "queued", at(101), None)],
        [(6, "queued", at(500), None)],
    ]
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
        if k == 2:  # a restart between the two limits
            keyed.requeue_stream(incremental.files(spark, folder, spark.createDataFrame([], schema).schema, 1), out, checkpoint)
    done = keyed.requeue_stream(incremental.files(spark, folder, spark.createDataFrame([], schema).schema, 1), out, checkpoint)
    queued = {r.key: r.time for r in done.where("state = 'queued'").collect() if r.key not in (3, 6)}
    limits = {1: 72, 2: 100, 4: 6, 5: 144}
    assert queued == {k: at(h) + dt.timedelta(milliseconds=1) for k, h in limits.items()}


def test_groups_of_parts_equal_those_of_batches(spark, sf):
    got = sorted(map(tuple, mining.leader_groups(spark, sf).collect()))
    items = mining.part_items(spark, sf)
    assert got == sorted(map(tuple, grouping.leader_groups(items, batch=50).collect()))
    assert {i: g for _, i, g in got} == brute_groups(sorted(map(tuple, items.collect()), key=lambda r: r[1]))
