"""NN-descent on its own, without the trees that begin it, and the size of those."""

import pickle

import numpy as np
from codelode.common import Scratch
from codelode.llm import neighbours
from pyspark.sql import functions as F

NODES = "id long, dim int, vec binary"


def _clustered(n, dim, centres, seed):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    return [(c[k % centres] + 0.5 * rng.normal(size=dim)).astype("<f2").tobytes() for k in range(n)]


def test_rounds_converge_from_random_lists(spark):
    n = 4000
    blobs = _clustered(n, 24, 180, 3)
    rng = np.random.default_rng(4)
    nodes = spark.createDataFrame([(k, 24, bytearray(b)) for k, b in enumerate(blobs)], NODES)
    start = [(k, 24, k % 40, [int(x) for x in rng.choice(n, neighbours.LIST, replace=False) if x != k], [], []) for k in range(n)]
    lists = neighbours._descend(nodes, spark.createDataFrame(start, "id long, dim int, home long, near array<long>, sims array<float>, newest array<long>").withColumn("newest", F.col("near")).withColumn("sims", F.transform("near", lambda _: F.lit(-2.0).cast("float"))), n, Scratch(spark))
    m = neighbours._unit(blobs)
    s = m @ m.T
    np.fill_diagonal(s, -2)
    truth = np.argsort(-s, axis=1)[:, :5]
    hits = sum(len(set(r.near[:5]) & set(map(int, truth[r.id]))) for r in lists.collect())
    assert hits >= 0.95 * 5 * n


def test_trees_do_not_grow_with_the_data():
    sample = neighbours._unit(_clustered(2000, 24, 50, 5))
    small, large = (neighbours.Forest(sample, 4, depth, 1) for depth in (8, 24))
    assert large.extra > small.extra and len(pickle.dumps(large)) < 2.5 * len(pickle.dumps(small))
    leaves = large.leaves(sample)
    assert len(np.unique(leaves[:, 0])) > 500  # still split where the sample ends


def test_a_node_that_all_lists_name(spark):
    """A hub: it keeps a bounded reverse list, and all lists keep the hub."""
    rng = np.random.default_rng(9)
    hub = rng.normal(size=16)
    blobs = [hub.astype("<f2").tobytes()] + [(hub + 2.0 * np.eye(16)[k % 16] * (1 if k % 2 else -1) + 0.4 * rng.normal(size=16)).astype("<f2").tobytes() for k in range(400)]
    df = spark.createDataFrame([(k, 16, bytearray(b)) for k, b in enumerate(blobs)], "vec_id long, dim int, vec binary")
    graph = neighbours.graph_of(df)
    assert graph.links.agg(F.max(F.size("around"))).first()[0] <= 2 * neighbours.LIST
    m = neighbours._unit(blobs)
    s = m @ m.T
    np.fill_diagonal(s, -2)
    truth = np.argsort(-s, axis=1)[:, :5]
    got = {}
    for r in neighbours.neighbours(df).collect():
        got.setdefault(r.vec_id, set()).add(r.neighbour)
    assert sum(len(got[k] & set(map(int, truth[k]))) for k in range(401)) >= 0.99 * 5 * 401
