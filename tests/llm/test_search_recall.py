"""Recall of both neighbour queries on a project table against brute force, for every id divisible by 50."""

import os

import numpy as np
import pytest
from codelode.llm import neighbours, queries

DATA = os.environ.get("CODELODE_DATA", "/root/testdata/sf0.01")


@pytest.mark.skipif(not os.path.exists(f"{DATA}/embed_cache.parquet"), reason="no data")
def test_recall_on_the_embedding_cache(spark):
    rows = neighbours.usable(spark.read.parquet(f"{DATA}/embed_cache.parquet")).collect()
    unit, ids = {}, {}
    for dim in {r.dim for r in rows}:
        mine = [r for r in rows if r.dim == dim]
        ids[dim], unit[dim] = np.array([r.vec_id for r in mine]), neighbours._unit([bytes(r.vec) for r in mine])
    at = {int(v): (dim, k) for dim, x in ids.items() for k, v in enumerate(x)}
    found = [(r.vec_id, r.neighbour) for r in neighbours.neighbours(spark.read.parquet(f"{DATA}/embed_cache.parquet")).where("vec_id % 50 = 0").collect()]
    searched = [(r.query_id, r.id) for r in queries.p4_search(spark, DATA).collect()]
    for pairs in (found, searched):
        got: dict[int, list[int]] = {}
        for a, b in pairs:
            assert a != b
            got.setdefault(a, []).append(b)
        hits = total = 0
        for v, (dim, k) in at.items():
            if v % 50 == 0:
                s = unit[dim] @ unit[dim][k]
                s[k] = -2
                floor = np.sort(s)[-5] - 1e-5
                hits += sum(s[at[b][1]] >= floor for b in got.get(v, []))
                total += 5
        assert hits >= 0.97 * total, (hits, total)
