"""Whole encounters through one kernel, against plain Python and the plans that it replaces."""

import hashlib
import random
import statistics

import pyarrow as pa
from pyspark.sql import functions as F

from charlspark.operators import kernels, scoring, simulate
from charlspark.plans import registry
from charlspark.sources.staging import slim_rows

DIR = "/root/testdata/sf0.001"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
RULES = ([([1], [2])], [(1.0, [1]), (2.0, [6]), (5.0, [8])])


def score(mask):
    kept = mask & ~2 if mask & 1 else mask
    return (kept & 1) + 2 * (kept & 6).bit_count() + 5 * (kept >> 3 & 1)


def cohort(seed):
    """Prefixes with their cuts and masks; encounters with repeated prefixes, one of many rows, some without rows, some rows of no encounter."""
    rng = random.Random(seed)
    known = {f"P{i:02d}": (sorted(rng.randrange(1 << 52) for _ in range(i % 4 if i else 12)), [rng.randrange(16) for _ in range(13)]) for i in range(12)}
    known = {p: (c, m[: len(c) + 1]) for p, (c, m) in known.items()}
    rows = [(e, rng.choice([*known])) for e in range(60) for _ in range(200 if e == 7 else rng.randrange(5))]
    return known, rows, [e for e in range(62) if e % 9 != 4]


def brute(known, rows, listed, n):
    want = {}
    for e in listed:
        draws = []
        for k in range(1, n + 1):
            mask = 0
            for p in {p for x, p in rows if x == e}:
                cuts, masks = known[p]
                mask |= masks[sum(c <= int(hashlib.md5(f"42|s3|{e}|{p}|{k}".encode()).hexdigest()[:13], 16) for c in cuts)]
            draws.append(score(mask))
        want[e] = (sum(draws) / n, float(statistics.median(draws)))
    return want


def test_encounters_over_many_batches(monkeypatch):
    known, rows, listed = cohort(1)
    want = brute(known, rows, listed, 6)
    every = sorted([(e, None, True) for e in listed] + [(e, p, False) for e, p in rows], key=lambda r: r[0])  # rows of an encounter in any order
    of = lambda p: known[p] if p else ([], [0])
    table = pa.table({
        "enc_id": pa.array([r[0] for r in every], pa.int64()), "pref": pa.array([r[1] for r in every]), "listed": [r[2] for r in every],
        "who": [f"{e}|{p}|" if of(p)[0] else None for e, p, _ in every], "fixed": pa.array([0 if of(p)[0] else of(p)[1][0] for _, p, _ in every], pa.int64()),
        "open_s3": pa.array([of(p)[0] + of(p)[1] if of(p)[0] else None for _, p, _ in every], pa.list_(pa.int64())),
    })
    out = pa.schema([("enc_id", pa.int64()), ("s3", pa.float64())])
    for step, size in ((1, 1), (7, 3), (50, 20), (10**6, 10**6)):
        monkeypatch.setattr(kernels, "STEP", step)
        for use, i in (("mean", 0), ("median", 1)):
            run = kernels.estimator({}, [("s3", "42|s3|", 6, use, ["fixed"])], RULES, None, out)
            got = [r for b in run(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
            assert [r["enc_id"] for r in got] == listed and {r["enc_id"]: r["s3"] for r in got} == {e: w[i] for e, w in want.items()}


def test_visited_with_and_without_broadcast(spark):
    known, rows, listed = cohort(2)
    want = brute(known, rows, listed, 6)
    groups = scoring.Groups(("a", "b", "c", "d"), (1.0, 2.0, 2.0, 5.0), ((), (0,), (), ()))
    outcomes = spark.createDataFrame([(p, [(x,) for x in m], [f"{c:013x}" for c in cuts]) for p, (cuts, m) in known.items()], "pref string, masks array<struct<mask: long>>, bars array<string>")
    profile = simulate.shared(outcomes, groups, "s3").withColumn("bare", F.lit(0).cast("long"))
    people = spark.createDataFrame([(e,) for e in listed] + [(None,)], "enc_id long")
    dx = spark.createDataFrame([*rows, (None, "P01")], "enc_id long, pref string")
    for small in (True, False):
        for use, i in (("mean", 0), ("median", 1)):
            got = simulate.visited(people, dx.repartition(5), profile, small, groups, 3, [("s3", 6, use)])
            assert dict(map(tuple, got.collect())) == {e: w[i] for e, w in want.items()} | {None: 0.0}


def test_estimates_take_one_exchange_by_encounter(spark):
    job = registry.Job(spark, DIR)
    text = job.together._jdf.queryExecution().executedPlan().toString()
    assert text.count("lineitem.parquet") == 1 and text.count("hashpartitioning(enc_id") == 1
    assert "ObjectHashAggregate" not in text and "SortMergeJoin" not in text


def test_slim_rows_leave_the_session_as_it_was(spark):
    before = spark.conf.get(BATCH_BYTES, None)
    with slim_rows(spark):
        assert spark.conf.get(BATCH_BYTES) == str(2**31 - 1)
    assert spark.conf.get(BATCH_BYTES, None) == before


def test_few_cuts_are_counted_and_many_searched():
    rng = random.Random(4)
    for most in (0, 1, 8, 9, 40):
        cuts = [sorted(rng.randrange(1 << 52) for _ in range(rng.randrange(most + 1))) for _ in range(30)] + [[1 << 52] * most]
        starts, sizes, values = kernels.flat(pa.array(cuts, pa.list_(pa.int64())))
        hashes = kernels.heads(pa.array([f"t{i}|" for i in range(31)]), 12)
        got = kernels.places(hashes, starts, sizes, values.to_numpy())
        assert got.tolist() == [[sum(c <= h for c in own) for h, own in zip(row, cuts)] for row in hashes.tolist()]
