import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.llm.packing import best_fit_decreasing, lower_bound, pack, packing_report


def test_best_fit_and_bound():
    rng = random.Random(4)
    for _ in range(60):
        c = rng.randint(5, 200)
        n = np.array([rng.randint(1, c) for _ in range(rng.randint(1, 120))])
        at, free = best_fit_decreasing(n, c)
        assert (np.bincount(at, weights=n, minlength=len(free)) + free == c).all() and (free >= 0).all()
        assert lower_bound(n, c) <= len(free)
    assert lower_bound(np.array([6, 6, 6]), 10) == 3 and lower_bound(np.array([4, 4, 4]), 10) == 2


def test_every_token_once(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([0, 1, 3, 40, 41, 100, 101, 250, 999])) for k in range(600)]
    items = spark.createDataFrame(rows, "row_id bigint, n_tokens bigint").withColumn("part", F.lit(0)).withColumn("container", F.lit("clash"))
    assigned, certificates = pack(items, 100, ["row_id", "part"], partition_items=100)
    got = assigned.collect()
    by_item, by_bin = {}, {}
    for r in got:
        by_item.setdefault(r["row_id"], []).append((r["first_token"], r["n_tokens"]))
        by_bin[r["container"]] = by_bin.get(r["container"], 0) + r["n_tokens"]
    assert max(by_bin.values()) <= 100
    for k, n in rows:
        pieces = sorted(by_item.get(k, []))
        assert sum(m for _, m in pieces) == n and all(a + m == b for (a, m), (b, _) in zip(pieces, pieces[1:]))
        assert len(pieces) == -(-n // 100)
    total = sum(n for _, n in rows)
    assert len(by_bin) <= 1.01 * -(-total // 100) + 1
    assert certificates.where("n_containers < lower_bound").count() == 0
    assert packing_report(assigned, 100).first()["n_tokens"] == total


def test_partitions_exchange(spark):
    """Items that no partition packs well on its own meet in later rounds, and the bound over all counts holds."""
    rng = random.Random(8)
    items = spark.createDataFrame([(k, rng.choice([26, 34, 41, 49, 55])) for k in range(900)], "row_id bigint, n_tokens bigint")
    assigned, certificates = pack(items, 100, ["row_id"], partition_items=60)
    rounds = {r["round"] for r in certificates.collect()}
    assert len(rounds) > 1
    once, _ = pack(items, 100, ["row_id"], partition_items=60, rounds=1)
    report, before = packing_report(assigned, 100).first(), packing_report(once, 100).first()
    assert report["lower_bound"] == before["lower_bound"] <= report["n_containers"] <= before["n_containers"]
    assert report["lower_bound"] >= -(-report["n_tokens"] // 100)
    lengths = np.array([r["n_tokens"] for r in items.collect()])
    assert report["lower_bound"] == lower_bound(lengths, 100)


def test_empty_and_errors(spark):
    none = spark.createDataFrame([], "row_id bigint, n_tokens bigint")
    assigned, certificates = pack(none, 10, ["row_id"])
    assert assigned.count() == 0 and packing_report(assigned, 10).first()["n_containers"] == 0
    with pytest.raises(ValueError):
        pack(none, 0, ["row_id"])
