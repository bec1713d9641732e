"""Snapshot differences against a plain model, with dirty rows, enlarged buckets and edge tables."""

import datetime
import random

from codelode.operators import snapshots as s

T0 = datetime.datetime(2025, 3, 3)
FILE = "snap_no int, project string, path string, content_hash string, size bigint, mtime_ns bigint, status string, delivered_at timestamp, change string"
CHUNK = "snap_no int, project string, file string, chunk_index int, chunk_hash string, delivered_at timestamp, pair int"


def _hash(n: int) -> str:
    return f"{n:064x}"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_file_changes_match_a_plain_model(spark):
    rng = random.Random(1)
    state = {f"src/f{n}.py": n for n in range(300)}
    rows, expected, before = [], set(), None
    for snap in (1, 2, 3):
        if snap > 1:
            for path in rng.sample(sorted(state), 40):
                if rng.random() < 0.5:
                    state[path] += 1000 * snap
                else:
                    del state[path]
            for n in range(20):
                state[f"new/{snap}_{n}.go"] = n
            for p in before.keys() - state.keys():
                expected.add((snap, "file", "p", p, "", "removed"))
            for p in state.keys() - before.keys():
                expected.add((snap, "file", "p", p, "", "added"))
            for p in state.keys() & before.keys():
                if state[p] != before[p]:
                    expected.add((snap, "file", "p", p, "", "changed"))
        for k, (path, n) in enumerate(sorted(state.items())):
            spelled = ["./" + path, path.replace("/", "\\"), path.replace("/", "//")][k % 3] if k % 5 == 0 else path
            digest = ["sha256:" + _hash(n), _hash(n).upper(), _hash(n)][k % 3]
            rows += [(snap, "p", spelled, digest, 1, 1, "ok", T0 + datetime.timedelta(days=7 * snap), "x")] * (2 if k % 7 == 0 else 1)
            if k % 11 == 0:  # an earlier rival row does not hold
                rows.append((snap, "p", path, _hash(99999), 1, 1, "ok", T0, "x"))
        before = dict(state)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, FILE)
    assert _rows(s.file_changes(df)) == sorted(expected)
    # What doesn't peel in the rounds allowed is compared.
    assert _rows(s.file_changes(df, bucket_elements=100, first_cells=6, rounds=1)) == sorted(expected)
    assert _rows(s.file_changes(df, bucket_elements=100, first_cells=6, rounds=2)) == sorted(expected)
    # Tables far too small for the differences are enlarged until they peel.
    assert _rows(s.file_changes(df, bucket_elements=100, first_cells=6)) == sorted(expected)


def test_missing_hash_keeps_the_one_before(spark):
    at = lambda n: T0 + datetime.timedelta(days=n)
    rows = [(1, "p", "a", _hash(1), 1, 1, "ok", at(1), ""), (2, "p", "a", None, 1, 1, "unreadable", at(8), ""), (3, "p", "a", _hash(2), 1, 1, "ok", at(15), ""), (2, "p", "b", None, 1, 1, "unreadable", at(8), "")]
    rows += [(None, "p", "c", _hash(1), 1, 1, "ok", at(1), ""), (2, None, "c", _hash(1), 1, 1, "ok", at(1), ""), (2, "p", None, _hash(1), 1, 1, "ok", at(1), ""), (2, "p", "d", _hash(5), 1, 1, "ok", None, "")]
    got = _rows(s.file_changes(spark.createDataFrame(rows, FILE)))
    assert got == [(2, "file", "p", "b", "", "added"), (2, "file", "p", "d", "", "added"), (3, "file", "p", "a", "", "changed"), (3, "file", "p", "b", "", "removed"), (3, "file", "p", "d", "", "removed")]


def test_chunk_changes_are_sets_of_hashes(spark):
    rows = [(1, "p", "a", 0, _hash(1), T0, 9), (1, "p", "a", 1, _hash(2), T0, 9), (2, "p", "./a", 0, "SHA256:" + _hash(2), T0, 9), (2, "p", "a", 1, _hash(3).upper(), T0, 9), (2, "p", "a", 2, _hash(3), T0, 9), (2, "p", "a", 3, None, T0, 9)]
    got = _rows(s.chunk_changes(spark.createDataFrame(rows, CHUNK)))
    assert got == [(2, "chunk", "p", "a", _hash(1), "removed"), (2, "chunk", "p", "a", _hash(3), "added")]


def test_beyond_the_broadcast_limit_the_result_is_the_same(spark, monkeypatch):
    rows = [(snap, "p", f"f{k % 50}", 0, _hash(k + (snap == 2 and k % 9 == 0) * 1000), T0, 9) for snap in (1, 2) for k in range(400)]
    df = spark.createDataFrame(rows, CHUNK)
    within = _rows(s.chunk_changes(df))
    monkeypatch.setattr("codelode.common.BROADCAST_LIMIT", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        beyond = s.chunk_changes(df)
        assert _rows(beyond) == within and len(within) == 90
        assert "Broadcast" not in beyond._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty_and_single_snapshots_give_nothing(spark):
    assert s.snapshot_changes(spark.createDataFrame([], FILE), spark.createDataFrame([], CHUNK)).count() == 0
    one = spark.createDataFrame([(1, "p", "a", _hash(1), 1, 1, "ok", T0, "")], FILE)
    assert s.file_changes(one).count() == 0


def test_peel_rejects_what_does_not_decode():
    assert s.peel([], 4) == []
    assert s.peel([(0, 2, 5, 6, 7)], 4) is None
