"""Differences between consecutive full snapshots by invertible Bloom lookup tables (problem 5).

Each snapshot is reduced to a set of (key hash, value hash) elements of a few bytes. They are spread over hash buckets by
one shuffle, and within a bucket all else happens in place: every snapshot fills a small table of cells (count, xor of
keys, xor of values, xor of checks), tables of consecutive snapshots are subtracted cell by cell, the difference is peeled
and its digest verified. Buckets that do not peel are built again from the source with four times the cells and other
hash functions; what does not peel after ``ROUNDS`` of these is compared element by element. Only the recovered elements
are joined back to the rows. Keys are 64-bit hashes of names: two names of one hash would share their changes.

Defined results: rows whose snapshot number, project or path is null cannot be named and take no part; repeated rows
count once; of rival rows in one snapshot the last delivered holds (ties: the greater hash); a file without a hash
keeps the hash of the snapshot before, and without one it has an unknown hash of its own; empty tables give no rows.
"""

from __future__ import annotations

import struct

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import durable, maybe_broadcast

#: Elements per bucket and snapshot that the sizing aims at, cells per bucket in the first round, and rounds at most.
BUCKET_ELEMENTS = 4096
FIRST_CELLS = 3 * 640
ROUNDS = 6


def canonical_path(path: Column) -> Column:
    """One spelling per path: forward slashes, no doubled ones, no leading ``./``."""
    return F.regexp_replace(F.regexp_replace(F.translate(F.trim(path), "\\", "/"), "/+", "/"), r"^(\./)+", "")


def canonical_digest(digest: Column) -> Column:
    """Bare lower-case hex; the empty string counts as no digest."""
    bare = F.regexp_replace(F.lower(F.trim(digest)), "^sha-?256[:=]", "")
    return F.when(bare != "", bare)


def _bucketed(elements: DataFrame, buckets: int) -> DataFrame:
    """(bucket, snap, kh, vh, e): distinct elements, all of a bucket in one partition; repeated rows are combined first."""
    hashed = elements.withColumn("e", F.xxhash64("kh", "vh"))
    return hashed.withColumn("bucket", F.pmod(F.xxhash64("e"), F.lit(buckets)).cast("int")).select("bucket", "snap", "kh", "vh", "e").distinct()


def _cells(placed: DataFrame, cells: int, salt: int) -> DataFrame:
    """(snap, bucket, cell, n, kx, vx, cx) of elements that lie together by bucket."""
    third = cells // 3
    spots = F.array(*[(F.pmod(F.xxhash64("e", F.lit(3 * salt + j).cast("bigint")), F.lit(third)) + j * third).cast("int") for j in range(3)])
    spread = placed.select("snap", "bucket", F.explode(spots).alias("cell"), "kh", "vh", F.xxhash64("e").alias("c"))
    return spread.groupBy("bucket", "snap", "cell").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("kh").alias("kx"), F.bit_xor("vh").alias("vx"), F.bit_xor("c").alias("cx"))


def _subtract(cells: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """Cells of the later snapshot minus those of the earlier one; ``pair`` is the later snapshot's number."""
    sides = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(b).alias("pair"), F.lit(g).alias("sign")) for a, b in pairs for s, g in ((a, -1), (b, 1))])
    signed = cells.withColumn("side", F.explode(F.filter(sides, lambda x: x["s"] == F.col("snap"))))
    return (
        signed.groupBy(F.col("side.pair").alias("pair"), "bucket", "cell")
        .agg(F.sum(F.col("n") * F.col("side.sign")).alias("n"), *[F.bit_xor(x).alias(x) for x in ("kx", "vx", "cx")])
        .where("n != 0 OR kx != 0 OR vx != 0 OR cx != 0")
    )


def _xxhash64(*values: int) -> int:
    """Spark's xxhash64 of longs: each is hashed with the hash of those before it as seed."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v - (1 << 64) if v >= 1 << 63 else v), seed)
    return seed


def peel(cells: list[tuple[int, int, int, int, int]], third: int, salt: int = 0) -> list[tuple[int, int, int]] | None:
    """The (key, value, sign) elements of one subtracted table of (cell, n, kx, vx, cx); None if it doesn't peel."""
    at = {c[0]: list(c[1:]) for c in cells}
    digest = 0
    for cell, _, _, _, cx in cells:
        if cell < third:
            digest ^= cx
    todo, found, proof = list(at), [], 0
    while todo:
        cell = at.get(todo.pop())
        if not cell or cell[0] not in (1, -1):
            continue
        n, kh, vh, cx = cell
        e = _xxhash64(kh, vh)
        if _xxhash64(e) != cx & 0xFFFFFFFFFFFFFFFF:
            continue
        found.append((kh, vh, n))
        proof ^= cx
        for j in range(3):
            h = _xxhash64(e, 3 * salt + j)
            spot = (h - (1 << 64) if h >= 1 << 63 else h) % third + j * third
            other = at.setdefault(spot, [0, 0, 0, 0])
            other[0] -= n
            other[1] ^= kh
            other[2] ^= vh
            other[3] ^= cx
            if other == [0, 0, 0, 0]:
                del at[spot]
            else:
                todo.append(spot)
    return None if at or proof != digest else found


def _peel_groups(third: int, salt: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        got = peel(list(pdf[["cell", "n", "kx", "vx", "cx"]].itertuples(index=False, name=None)), third, salt)
        rows = [(key[0], key[1], False, 0, 0, 0)] if got is None else [(key[0], key[1], True, *x) for x in got]
        return pd.DataFrame(rows, columns=["pair", "bucket", "ok", "kh", "vh", "sign"])

    return run


def _compared(placed: DataFrame, open_: DataFrame) -> DataFrame:
    """(pair, kh, vh, sign) of the buckets that don't peel, element by element."""
    sides = placed.join(open_, "bucket").where("snap = pair OR snap = pair - 1")
    met = sides.groupBy("pair", "kh", "vh").agg(F.sum(F.when(F.col("snap") == F.col("pair"), 1).otherwise(-1)).cast("int").alias("sign"))
    return met.where("sign != 0")


def set_differences(elements: DataFrame, pairs: list[tuple[int, int]], rows: int, bucket_elements: int = BUCKET_ELEMENTS, first_cells: int = FIRST_CELLS, rounds: int = ROUNDS) -> DataFrame:
    """(pair, kh, vh, sign) of the elements that only the later (+1) or only the earlier (-1) snapshot of a pair has.

    ``elements`` are (snap int, kh long, vh long), repeated or not, about ``rows`` in all. The result is stored in the
    shared folder.
    """
    snaps = len({x for p in pairs for x in p})
    buckets, cells, done = max(1, -(-rows // (max(1, snaps) * bucket_elements))), first_cells, None
    todo = _bucketed(elements, buckets)
    only: DataFrame | None = None  # the (pair, bucket)s still open, after the first round
    for salt in range(rounds):
        third = cells // 3
        difference = _subtract(_cells(todo.repartition("bucket"), cells, salt), pairs)
        if only is not None:  # a bucket may be back for one pair of its snapshot's only
            difference = difference.join(only, ["pair", "bucket"], "left_semi")
        peeled = durable(
            difference.groupBy("pair", "bucket")
            .applyInPandas(_peel_groups(third, salt), "pair int, bucket int, ok boolean, kh long, vh long, sign int")
        )
        good = peeled.where("ok").select("pair", "kh", "vh", "sign")
        done = good if done is None else done.unionByName(good)
        failed = peeled.where("NOT ok").select("pair", "bucket").distinct()
        missing = {r["pair"]: r["n"] for r in failed.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not missing:
            return done
        # Only the failed buckets of the failed pairs come again.
        cells *= 4
        pairs = [p for p in pairs if p[1] in missing]
        again = maybe_broadcast(failed.select("bucket").distinct(), sum(missing.values()), 16)
        todo, only = _bucketed(elements, buckets).join(again, "bucket", "left_semi"), failed
    return done.unionByName(durable(_compared(todo, only)))


def file_elements(snaps: DataFrame, numbers: list[int]) -> DataFrame:
    """(snap, kh, vh): one element for each file of each snapshot, with the hash that holds there.

    A key's rows are combined to one row with the last of every snapshot, before and after one shuffle.
    """
    digest = canonical_digest(F.col("content_hash"))
    rows = snaps.where("snap_no IS NOT NULL AND project IS NOT NULL AND path IS NOT NULL").select(
        F.col("snap_no").cast("int").alias("snap"),
        F.xxhash64("project", canonical_path(F.col("path"))).alias("kh"),
        F.struct(F.coalesce(F.unix_micros(F.col("delivered_at").cast("timestamp")), F.lit(-(1 << 62))).alias("at"), digest.isNotNull().alias("known"), F.xxhash64(digest).alias("vh")).alias("r"),
    )
    per = rows.groupBy("kh").agg(*[F.max(F.when(F.col("snap") == n, F.col("r"))).alias(f"s{n}") for n in numbers])
    held, sides = F.lit(None).cast("bigint"), []
    for n in numbers:
        held = F.coalesce(F.when(F.col(f"s{n}.known"), F.col(f"s{n}.vh")), held)
        sides.append(F.when(F.col(f"s{n}").isNotNull(), F.struct(F.lit(n).alias("snap"), F.coalesce(held, F.lit(0)).alias("vh"))))
    return per.select("kh", F.explode(F.filter(F.array(*sides), lambda x: x.isNotNull())).alias("x")).select("x.snap", "kh", "x.vh")


def chunk_elements(snaps: DataFrame) -> DataFrame:
    """(snap, kh, vh): the chunk hashes of each file of each snapshot, repeated as their rows are."""
    digest = canonical_digest(F.col("chunk_hash"))
    rows = snaps.where("snap_no IS NOT NULL AND project IS NOT NULL AND file IS NOT NULL").where(digest.isNotNull())
    return rows.select(F.col("snap_no").cast("int").alias("snap"), F.xxhash64("project", canonical_path(F.col("file"))).alias("kh"), F.xxhash64(digest).alias("vh"))


def _numbers(snaps: DataFrame) -> list[int]:
    return sorted(int(r[0]) for r in snaps.where("snap_no IS NOT NULL").select("snap_no").distinct().collect())


def _pairs(numbers: list[int]) -> list[tuple[int, int]]:
    return [(a, b) for a, b in zip(numbers, numbers[1:]) if b == a + 1]


def _empty(snaps: DataFrame) -> DataFrame:
    return snaps.sparkSession.createDataFrame([], "snap_no int, grain string, project string, path string, chunk_hash string, change string")


def file_changes(snaps: DataFrame, **sizing: int) -> DataFrame:
    """Files added, removed or changed between consecutive snapshots of a ``file_snaps`` table."""
    numbers = _numbers(snaps)
    pairs = _pairs(numbers)
    if not pairs:
        return _empty(snaps)
    diff = durable(
        set_differences(file_elements(snaps, numbers), pairs, snaps.count(), **sizing)
        .groupBy("pair", "kh")
        .agg(F.max("sign").alias("hi"), F.min("sign").alias("lo"))
        .select("pair", "kh", F.when(F.col("lo") == 1, "added").when(F.col("hi") == -1, "removed").otherwise("changed").alias("change"))
    )
    names = snaps.where("project IS NOT NULL AND path IS NOT NULL").select("project", canonical_path(F.col("path")).alias("path"))
    names = names.withColumn("kh", F.xxhash64("project", "path"))
    found = names.join(maybe_broadcast(diff, diff.count(), 120), "kh")
    return found.select(F.col("pair").alias("snap_no"), F.lit("file").alias("grain"), "project", "path", F.lit("").alias("chunk_hash"), "change").distinct()


def chunk_changes(snaps: DataFrame, **sizing: int) -> DataFrame:
    """Chunk hashes that entered or left a file between consecutive snapshots of a ``chunk_snaps`` table."""
    pairs = _pairs(_numbers(snaps))
    if not pairs:
        return _empty(snaps)
    diff = set_differences(chunk_elements(snaps), pairs, snaps.count(), **sizing)
    rows = snaps.where("project IS NOT NULL AND file IS NOT NULL").select(
        F.col("project"), canonical_path(F.col("file")).alias("path"), canonical_digest(F.col("chunk_hash")).alias("chunk_hash")
    )
    rows = rows.where("chunk_hash IS NOT NULL").withColumns({"kh": F.xxhash64("project", "path"), "vh": F.xxhash64("chunk_hash")})
    return (
        rows.join(maybe_broadcast(diff, diff.count(), 120), ["kh", "vh"])
        .select(
            F.col("pair").alias("snap_no"), F.lit("chunk").alias("grain"), "project", "path", "chunk_hash",
            F.when(F.col("sign") == 1, "added").otherwise("removed").alias("change"),
        )
        .distinct()
    )


def snapshot_changes(file_snaps: DataFrame, chunk_snaps: DataFrame, **sizing: int) -> DataFrame:
    """Both grains: (snap_no, grain, project, path, chunk_hash, change)."""
    return file_changes(file_snaps, **sizing).unionByName(chunk_changes(chunk_snaps, **sizing))
