"""Most similar vectors for every vector (problem 4): NN-descent by iterative Spark joins, and greedy graph search.

Vectors are validated, taken once per id, and exact copies are folded into one node, so that a group of copies of any
size costs one node. The first graph comes from a few random-projection trees fitted on a bounded sample: every node meets
the others of its leaf in blocks of bounded size (overfull leaves are salted). Rounds of NN-descent follow. In each, every
node's list and the lists that name it are joined with those of its neighbours; a block of nodes (a leaf of the first
tree) gets each vector that its nodes' neighbours of neighbours need once, and compares in one matrix product. Only
neighbourhoods that changed are joined again, and the rounds go on until lists no longer change. Copies get their own
copies first and share their node's neighbours. New vectors are answered by greedy search over the graph, entered in the
leaves of the trees.

Defined results: unusable blobs (wrong length, not finite, all zero) and null ids or dims take no part; of several blobs
of one id the greatest usable holds; ties go to the smaller id; tables with fewer than k others give what there is.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import Scratch

#: Neighbours asked for, and length of the lists that NN-descent keeps (forward ones, and reverse ones joined at most).
K, LIST = 5, 10
#: Trees of the first graph, nodes of a leaf that the fit aims at and that one block may hold.
TREES, LEAF, BLOCK = 4, 700, 2000
#: Vectors, and bytes of them, that the trees are fitted on at most; a fitted leaf keeps so many of them, and beyond the
#: fitted levels leaves are split by so many planes at most that all leaves of a tree share.
SAMPLE, SAMPLE_BYTES, FITTED, PLANES = 20_000, 16 << 20, 16, 30
#: The rounds end when so small a share of the k nearest got better by more than float noise.
SETTLED, NOISE = 0.001, 1e-5
#: Similarities that a matrix product gives at once.
CELLS = 1 << 20
#: Reverse links and queries that one window or block holds at most about.
PART = 100_000


def usable(cache: DataFrame) -> DataFrame:
    """(vec_id, dim, vec): one blob of little-endian float16 per usable vector."""
    rows = cache.where("vec_id IS NOT NULL AND dim > 0 AND vec IS NOT NULL").where(F.octet_length("vec") == F.col("dim") * 2).select("vec_id", "dim", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for blob in b.column(2).to_pylist():
                v = np.frombuffer(blob, dtype="<f2")
                good.append(bool(np.isfinite(v).all() and v.any()))
            yield b.filter(pa.array(good, type=pa.bool_()))

    return rows.mapInArrow(run, "vec_id bigint, dim int, vec binary").groupBy("vec_id").agg(F.max(F.struct("vec", "dim")).alias("v")).select("vec_id", F.col("v.dim").alias("dim"), F.col("v.vec").alias("vec"))


def _unit(blobs: list[bytes]) -> np.ndarray:
    m = np.frombuffer(b"".join(blobs), dtype="<f2").reshape(len(blobs), -1).astype(np.float32)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _column_unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors of a binary column whose blobs are equally long, read where they lie."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks)
    start, end = a.offset, a.offset + len(a)
    offsets = np.frombuffer(a.buffers()[1], dtype=np.int32)
    m = np.frombuffer(a.buffers()[2], dtype="<f2")[offsets[start] // 2 : offsets[end] // 2].reshape(len(a), -1).astype(np.float32)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, type=pa.int32()), pa.array(values, type=kind))


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False) if column.num_chunks else np.zeros(0)


class Forest:
    """Random-projection trees: internal nodes split the sample in halves by the plane between two of its points.

    Their size is bounded by the sample's. Leaves that must be split further than the sample reaches are split by random
    planes through the leaf's centre, which all leaves of a tree share.
    """

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int):
        rng = np.random.default_rng(seed)
        self.extra = min(PLANES, max(0, depth - max(0, int(np.log2(max(1, len(sample)) / FITTED)))))
        self.trees = [self._grow(sample, np.arange(len(sample)), depth - self.extra, rng) for _ in range(trees)]
        self.planes = rng.normal(size=(trees, self.extra, sample.shape[1])).astype(np.float32)

    def _grow(self, x: np.ndarray, at: np.ndarray, depth: int, rng: np.random.Generator):
        if depth <= 0 or len(at) < FITTED:
            return x[at].mean(axis=0)
        a, b = x[rng.choice(at, 2, replace=False)]
        normal = a - b
        if not normal.any():
            normal = rng.normal(size=x.shape[1]).astype(np.float32)
        d = x[at] @ normal
        middle = float(np.median(d))
        if not (d > middle).any():
            return x[at].mean(axis=0)
        return normal, middle, self._grow(x, at[d > middle], depth - 1, rng), self._grow(x, at[d <= middle], depth - 1, rng)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf numbers, one column per tree."""
        out = np.zeros((len(x), len(self.trees)), dtype=np.int64)
        for t, tree in enumerate(self.trees):
            stack = [(tree, np.arange(len(x)), 1)]
            while stack:
                node, at, code = stack.pop()
                if not len(at):
                    continue
                if isinstance(node, np.ndarray):
                    bits = ((x[at] - node) @ self.planes[t].T > 0) @ (1 << np.arange(self.extra, dtype=np.int64))
                    out[at, t] = (code << self.extra) + bits
                    continue
                above = x[at] @ node[0] > node[1]
                stack += [(node[2], at[above], code * 2 + 1), (node[3], at[~above], code * 2)]
        return out


def _forests(nodes: DataFrame, trees: int = TREES) -> Broadcast:
    """{dim: trees} fitted on a hash-chosen sample of bounded size; lengths too rare to be in it have no trees."""
    total, size = nodes.agg(F.count(F.lit(1)), F.sum(F.octet_length("vec"))).first()
    share = min(1.0, SAMPLE / max(1, total), SAMPLE_BYTES / max(1, size or 0))
    picked: dict[int, list[tuple[int, bytes]]] = {}
    for r in nodes.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("id", "dim", "vec").collect():
        picked.setdefault(r["dim"], []).append((r["id"], bytes(r["vec"])))
    forests = {}
    for dim, rows in picked.items():
        sample = _unit([blob for _, blob in sorted(rows)])
        forests[dim] = Forest(sample, trees, max(0, int(np.ceil(np.log2(max(1.0, len(sample) / share / LEAF))))), 11 + dim)
    return nodes.sparkSession.sparkContext.broadcast(forests)


def _with_leaves(rows: DataFrame, forests: Broadcast, trees: int = TREES) -> DataFrame:
    """(id, dim, vec) with ``leaves``, the number of the leaf in each tree (0 for lengths without trees)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim, blobs = b.column(1).to_numpy(), b.column(2)
            leaf = np.zeros((b.num_rows, trees), dtype=np.int64)
            for d in np.unique(dim):
                if int(d) in forests.value:
                    at = np.flatnonzero(dim == d)
                    leaf[at] = forests.value[int(d)].leaves(_column_unit(blobs.take(pa.array(at))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), blobs, pa.array(list(leaf), type=pa.list_(pa.int64()))], names=["id", "dim", "vec", "leaves"])

    return rows.select("id", "dim", "vec").mapInArrow(run, "id bigint, dim int, vec binary, leaves array<bigint>")


def _crowded(placed: DataFrame, most: int) -> DataFrame:
    """(dim, tree, leaf, parts) of the leaves that more than ``most`` rows of (dim, leaves) share."""
    counts = placed.select("dim", F.posexplode("leaves").alias("tree", "leaf")).groupBy("dim", "tree", "leaf").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > most).select("dim", "tree", "leaf", F.ceil(F.col("n") / most).cast("int").alias("parts"))


def _part(key: str) -> Column:
    """A row's part of its leaf: leaves that are not crowded have one."""
    return F.pmod(F.xxhash64(key, "tree"), F.coalesce("parts", F.lit(1))).cast("int")


def _in_leaf(block: pa.Table) -> pa.Table:
    """(id, near, sims): the most similar others of every node of a block."""
    ids, n = block["id"].to_numpy(), block.num_rows
    k = min(LIST, n - 1)
    near, sims = np.zeros((n, k), np.int64), np.zeros((n, k), np.float32)
    if k:
        unit = _column_unit(block["vec"])
        for rows in np.array_split(np.arange(n), -(-n * n // CELLS)):
            s = unit[rows] @ unit.T
            s[np.arange(len(rows)), rows] = -2
            best = np.argpartition(s, n - k, axis=1)[:, n - k :]
            near[rows], sims[rows] = ids[best], np.take_along_axis(s, best, 1)
    starts = np.arange(n + 1) * k
    return pa.table({"id": block["id"], "near": _lists(near.ravel(), starts, pa.int64()), "sims": _lists(sims.ravel(), starts, pa.float32())})


def _first_lists(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, dim, home, near, sims, newest): the lists that the trees give; ``home`` is the node's block in the first tree."""
    crowded = scratch.write(_crowded(nodes, BLOCK), "crowded")
    placed = nodes.select("id", "dim", F.posexplode("leaves").alias("tree", "leaf"), "vec").join(crowded, ["dim", "tree", "leaf"], "left").withColumn("part", _part("id"))
    blocks = placed.select("dim", "tree", "leaf", "part", "id", "vec").groupBy("dim", "tree", "leaf", "part").applyInArrow(_in_leaf, "id bigint, near array<bigint>, sims array<float>")
    ranked = F.array_sort(F.flatten(F.collect_list(F.arrays_zip(F.transform("sims", lambda s: -s).alias("sims"), "near"))))
    met = blocks.groupBy("id").agg(ranked.alias("met")).select("id", F.col("met.near").alias("all"), F.col("met.sims").alias("by"))
    met = met.withColumn("near", F.slice(F.array_distinct("all"), 1, LIST))
    met = met.select("id", "near", F.transform("near", lambda x: -F.get("by", (F.array_position("all", x) - 1).cast("int"))).alias("sims"))
    homes = nodes.select("id", "dim", F.lit(0).alias("tree"), F.element_at("leaves", 1).alias("leaf")).join(crowded, ["dim", "tree", "leaf"], "left")
    homes = homes.select("id", "dim", F.xxhash64("leaf", _part("id")).alias("home"))
    return scratch.write(homes.join(met, "id").select("id", "dim", "home", "near", "sims", F.col("near").alias("newest")), "lists0")


def _reverse(lists: DataFrame, total: int) -> DataFrame:
    """(id, back, lately): the nodes that name a node, those that rank it first before others, ``LIST`` at most.

    A node that a third of all lists name keeps its link with each of them on their side; they are ranked in parts of
    bounded size first, so that no task sorts them all.
    """
    links = lists.select(F.col("id").alias("a"), "newest", F.posexplode("near").alias("pos", "id"))
    links = links.select("id", "a", "pos", F.array_contains("newest", F.col("id")).alias("new"))
    parts = max(1, -(-total // PART))
    order = ("pos", F.xxhash64("a"))
    first = links.withColumn("r", F.row_number().over(Window.partitionBy("id", F.pmod(F.xxhash64("a", F.lit(1)), F.lit(parts))).orderBy(*order))).where(F.col("r") <= LIST)
    best = first.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where(F.col("r") <= LIST) if parts > 1 else first
    return best.groupBy("id").agg(F.collect_list("a").alias("back"), F.collect_list(F.when(F.col("new"), F.col("a"))).alias("lately"))


def _known(lists: DataFrame, total: int) -> DataFrame:
    """(id, dim, home, around, newest): a node's neighbours in both directions, and those of them that are new."""
    none = F.array().cast("array<bigint>")
    both = lists.join(_reverse(lists, total), "id", "left")
    return both.select("id", "dim", "home", F.array_union("near", F.coalesce("back", none)).alias("around"), F.array_union("newest", F.coalesce("lately", none)).alias("newest"))


def _improve(lists: pa.Table, found: pa.Table) -> pa.Table:
    """A block's lists after comparing its nodes with all the vectors that came for it."""
    n = lists.num_rows
    if not n or found.num_rows < 2:
        nothing = _lists(np.zeros(0, np.int64), np.zeros(n + 1), pa.int64())
        return lists.select(["id", "dim", "home", "near", "sims"]).append_column("newest", nothing).append_column("updates", pa.array(np.zeros(n, np.int64)))
    others, unit = found["id"].to_numpy(), _column_unit(found["vec"])
    order = np.argsort(others, kind="stable")
    others, unit = others[order], unit[order]
    mine = np.searchsorted(others, lists["id"].to_numpy())
    sizes = lists["near"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row, node, sim = [np.repeat(np.arange(n), sizes)], [_flat(lists["near"]).astype(np.int64)], [_flat(lists["sims"]).astype(np.float32)]
    firsts = np.cumsum(sizes) - sizes
    floor, kth = (np.where(sizes >= k, sim[0][np.minimum(firsts + k - 1, len(sim[0]) - 1)] if len(sim[0]) else -2, -2).astype(np.float32) for k in (LIST, K))
    k = min(LIST, len(others) - 1)
    for rows in np.array_split(np.arange(n), -(-n * len(others) // CELLS)):
        s = unit[mine[rows]] @ unit.T
        s[np.arange(len(rows)), mine[rows]] = -2
        i, j = np.nonzero(s > floor[rows, None])
        if len(i) > 4 * k * len(rows):  # lists that are far from settled
            j = np.argpartition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k :].ravel()
            i = np.repeat(np.arange(len(rows)), k)
        row.append(rows[i])
        node.append(others[j])
        sim.append(s[i, j])
    old = sizes.sum()
    row, node, sim = np.concatenate(row), np.concatenate(node), np.concatenate(sim)
    new = np.arange(len(row)) >= old
    by = np.lexsort((new, node, row))  # of a node that is in the list already the old place stays
    row, node, sim, new = row[by], node[by], sim[by], new[by]
    once = np.concatenate(([True], (row[1:] != row[:-1]) | (node[1:] != node[:-1])))
    row, node, sim, new = row[once], node[once], sim[once], new[once]
    by = np.lexsort((node, -sim, row))
    row, node, sim, new = row[by], node[by], sim[by], new[by]
    place = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row]
    updates = np.bincount(row[new & (place < K) & (sim > kth[row] + NOISE)], minlength=n)
    row, node, sim, new = (x[place < LIST] for x in (row, node, sim, new))
    starts = np.searchsorted(row, np.arange(n + 1))
    return pa.table({
        "id": lists["id"], "dim": lists["dim"], "home": lists["home"], "near": _lists(node, starts, pa.int64()), "sims": _lists(sim, starts, pa.float32()),
        "newest": _lists(node[new], np.searchsorted(row[new], np.arange(n + 1)), pa.int64()), "updates": pa.array(updates.astype(np.int64)),
    })


LISTS = "id bigint, dim int, home bigint, near array<bigint>, sims array<float>, newest array<bigint>, updates bigint"


def _descend(nodes: DataFrame, lists: DataFrame, total: int, scratch: Scratch) -> DataFrame:
    """Rounds of NN-descent until the lists settle; a round adds similarity to some list, so they do."""
    n = 0
    while True:
        n += 1
        known = scratch.write(_known(lists, total), f"known{n}")
        # Over a new link all of a neighbour's neighbours come, over an old one its new neighbours.
        asked = known.select("dim", "home", "newest", F.explode("around").alias("h"))
        asked = asked.groupBy("dim", "home", "h").agg(F.bool_or(F.array_contains("newest", F.col("h"))).alias("new"))
        theirs = known.select(F.col("id").alias("h"), F.col("around").alias("theirs"), F.col("newest").alias("lately"))
        news = asked.join(theirs, "h").select("dim", "home", F.explode(F.when(F.col("new"), F.array_union("theirs", F.array("h"))).otherwise(F.col("lately"))).alias("id"))
        # A block's own vectors come along, so that nothing else of its nodes has to be joined.
        found = news.unionByName(lists.select("dim", "home", "id")).distinct().join(nodes.select("id", "vec"), "id").select("dim", "home", "id", "vec")
        better = lists.groupBy("dim", "home").cogroup(found.groupBy("dim", "home")).applyInArrow(_improve, LISTS)
        after = scratch.write(better, f"lists{n}")
        updates = after.agg(F.sum("updates")).first()[0] or 0
        scratch.drop(f"lists{n - 1}")
        scratch.drop(f"known{n}")
        lists = after
        if updates <= SETTLED * total * K:
            return lists


class Graph(NamedTuple):
    vectors: DataFrame
    """(vec_id, id, copies): usable vectors with their node."""
    nodes: DataFrame
    """(id, dim, vec, leaves): one node per distinct vector."""
    edges: DataFrame
    """(a, b, s, r): the neighbour lists, by rank."""
    links: DataFrame
    """(id, around): neighbours in both directions."""
    forests: Broadcast


def graph_of(cache: DataFrame) -> Graph:
    scratch = Scratch(cache.sparkSession)
    vectors = scratch.write(usable(cache), "usable")
    groups = vectors.groupBy("dim", "vec").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    plain = scratch.write(groups, "groups")
    members = scratch.write(vectors.join(plain, ["dim", "vec"]).select("vec_id", "id", "copies"), "members")
    scratch.drop("usable")
    forests = _forests(plain)
    nodes = scratch.write(_with_leaves(plain, forests), "nodes")
    scratch.drop("groups")
    total = nodes.count()
    lists = _descend(nodes, _first_lists(nodes, scratch), total, scratch)
    edges = lists.select(F.col("id").alias("a"), F.posexplode(F.arrays_zip("near", "sims")).alias("pos", "e"))
    edges = edges.select("a", F.col("e.near").alias("b"), F.col("e.sims").alias("s"), (F.col("pos") + 1).alias("r"))
    return Graph(members, nodes, edges, _known(lists, total).select("id", "around"), forests)


def _first_copies(vectors: DataFrame, k: int) -> DataFrame:
    """(id, neighbour): the first k + 1 copies of a node, all that can be anybody's neighbour; found in salted parts."""
    part = Window.partitionBy("id", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    first = vectors.withColumn("p", F.row_number().over(part)).where(F.col("p") <= k + 1)
    return first.withColumn("p", F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))).where(F.col("p") <= k + 1).select("id", F.col("vec_id").alias("neighbour"))


def neighbours(cache: DataFrame, k: int = K) -> DataFrame:
    """(vec_id, neighbour, similarity, rank): the k most similar other vectors of every usable vector."""
    graph = graph_of(cache)
    vectors, first = graph.vectors, _first_copies(graph.vectors, k)
    own = vectors.where("copies > 1").join(first, "id").select("vec_id", "neighbour", F.lit(1.0).cast("float").alias("similarity"))
    near = graph.edges.where(F.col("r") <= k).join(first, F.col("b") == F.col("id")).select(F.col("a").alias("id"), "neighbour", F.col("s").alias("similarity"))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))).where(F.col("r") <= k)
    other = vectors.where(F.col("copies") <= k).join(near, "id").select("vec_id", "neighbour", "similarity")
    found = own.unionByName(other).where("vec_id != neighbour")
    order = Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """(vec_id_a, vec_id_b), a < b: pairs of which at least one names the other."""
    return found.select(F.least("vec_id", "neighbour").alias("vec_id_a"), F.greatest("vec_id", "neighbour").alias("vec_id_b")).distinct()


def _entries(queries: DataFrame, graph: Graph, beam: int) -> DataFrame:
    """(query_id, id, similarity): the best of one block of each leaf that a query falls into.

    Nodes of a crowded leaf, and queries of a leaf that very many fall into, are spread over blocks of bounded size: a
    query enters by one block of nodes, and the nodes come once for each block of queries.
    """
    asked = _with_leaves(queries.select(F.col("query_id").alias("id"), "dim", "vec"), graph.forests)
    asks = asked.select("dim", F.posexplode("leaves").alias("tree", "leaf"), "id", "vec")
    crowded = _crowded(graph.nodes, BLOCK)
    shares = asks.groupBy("dim", "tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("shares"))
    q = asks.join(crowded, ["dim", "tree", "leaf"], "left").withColumn("part", _part("id")).join(shares, ["dim", "tree", "leaf"]).withColumn("share", F.pmod(F.xxhash64("id", F.lit(3)), "shares").cast("int"))
    held = graph.nodes.select("dim", F.posexplode("leaves").alias("tree", "leaf"), "id", "vec").join(crowded, ["dim", "tree", "leaf"], "left").withColumn("part", _part("id"))
    held = held.join(shares, ["dim", "tree", "leaf"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    key = ["dim", "tree", "leaf", "part", "share"]

    def meet(some: pa.Table, block: pa.Table) -> pa.Table:
        n, m = some.num_rows, block.num_rows
        k = min(beam, m)
        near, sims = np.zeros((n, k), np.int64), np.zeros((n, k), np.float32)
        if n and m:
            ids, asking, unit = block["id"].to_numpy(), _column_unit(some["vec"]), _column_unit(block["vec"])
            for rows in np.array_split(np.arange(n), -(-n * m // CELLS)):
                s = asking[rows] @ unit.T
                best = np.argpartition(s, m - k, axis=1)[:, m - k :]
                near[rows], sims[rows] = ids[best], np.take_along_axis(s, best, 1)
        return pa.table({"query_id": pa.array(np.repeat(some["id"].to_numpy(), k), pa.int64()), "id": pa.array(near.ravel()), "similarity": pa.array(sims.ravel())})

    return q.select(*key, "id", "vec").groupBy(*key).cogroup(held.select(*key, "id", "vec").groupBy(*key)).applyInArrow(meet, SCORED)


SCORED = "query_id bigint, id bigint, similarity float"


def search(queries: DataFrame, graph: Graph, k: int = K, beam: int = 24, copies: bool = False) -> DataFrame:
    """(query_id, id, similarity, rank): greedy search over the graph for (query_id, dim, vec).

    Every round expands the unexpanded nodes of each query's beam along both directions of the graph and keeps the best
    ``beam``; queries whose beam holds no unexpanded node are done. They start at the best nodes of their leaves in the
    trees that the graph was made with: lists of near vectors alone don't lead from one cluster to another. With
    ``copies``, answers are vectors: every copy counts, and the query itself does not.
    """
    beam = max(beam, k + 1)
    scratch = Scratch(queries.sparkSession)
    links = scratch.write(graph.links, "links")
    q = scratch.write(queries.select("query_id", "dim", F.col("vec").alias("qvec")), "queries")

    def similar(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                dim = b.column(1).to_numpy()
                s = np.zeros(len(dim), dtype=np.float32)
                for d in np.unique(dim):
                    at = np.flatnonzero(dim == d)
                    qs, vs = (_column_unit(b.column(c).take(pa.array(at))) for c in (3, 4))
                    s[at] = (qs * vs).sum(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s)], names=["query_id", "id", "similarity"])

        return rows.join(q, "query_id").join(graph.nodes.select("id", F.col("vec").alias("nvec")), "id").select("query_id", "dim", "id", "qvec", "nvec").mapInArrow(run, SCORED)

    def kept(rows: DataFrame) -> DataFrame:
        once = rows.groupBy("query_id", "id").agg(F.max("similarity").alias("similarity"), F.max("done").alias("done"))
        return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))).where(F.col("rank") <= beam)

    state = scratch.write(kept(_entries(queries, graph, beam).withColumn("done", F.lit(False))), "beam0")
    n = 0  # a node that left a beam never returns to it, so the rounds end
    while not (open_ := state.where("NOT done")).isEmpty():
        n += 1
        reached = open_.select("query_id", "id").join(links, "id").select("query_id", F.explode("around").alias("id")).distinct().join(state.select("query_id", "id"), ["query_id", "id"], "left_anti")
        expanded = state.withColumn("done", F.lit(True)).drop("rank")
        state = scratch.write(kept(expanded.unionByName(similar(reached).withColumn("done", F.lit(False)))), f"beam{n}")
        scratch.drop(f"beam{n - 1}")
    if not copies:
        return state.where(F.col("rank") <= k).select("query_id", "id", "similarity", "rank")
    # One of the nearest k + 1 nodes may be the query alone.
    near = state.where(F.col("rank") <= k + 1).join(_first_copies(graph.vectors, k), "id").where("neighbour != query_id").select("query_id", F.col("neighbour").alias("id"), "similarity")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))).where(F.col("rank") <= k)
