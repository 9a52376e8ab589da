"""Draws by the hash at which they go beyond a donor, and draws of what is open."""

import random

from pyspark.sql import functions as F

from charlspark.operators import simulate
from charlspark.operators.scoring import Groups

SPAN = 1 << 52


def test_bar_is_the_first_hash_that_goes_beyond(spark):
    rng = random.Random(5)
    rows = [(rng.choice([rng.random(), rng.randrange(1, 1000) * 13.0, 1e-9]), rng.choice([rng.random() * 3, rng.randrange(1, 2000) * 13.0, 1e9])) for _ in range(300)] + [(0.0, 0.0), (0.0, 2.0), (3.0, 2.0)]
    for r in spark.createDataFrame(rows, "upto double, total double").withColumn("bar", simulate.bar(F.col("upto"), F.col("total"))).collect():
        beyond = lambda h: h / SPAN * r.total >= r.upto  # noqa: B023, E731
        if r.bar == "g":
            assert not beyond(SPAN - 1)
        else:
            h = int(r.bar, 16)
            assert len(r.bar) == 13 and beyond(h) and (h == 0 or not beyond(h - 1))


def test_draws_of_open_prefixes_agree_with_all_draws(spark):
    """Prefixes of one donor, of donors with equal masks and of seven with five outcomes; one without donors. Only the third needs draws."""
    groups = Groups(("a", "b", "c"), (1.0, 2.0, 6.0), ((1,), (), ()))
    weights = [("A11", "A111", 3.0, 1), ("B11", "B111", 2.0, 4), ("B11", "B112", 5.0, 4), *[("C11", f"C11{i}", float(i + 1), m) for i, m in enumerate((0, 1, 1, 2, 4, 4, 0))]]
    w = spark.createDataFrame(weights, "pref string, code string, weight double, mask long")
    prefs = spark.createDataFrame([(1, "A11", 1), (1, "B11", 4), (2, "C11", 7), (2, "A11", 1), (3, "C11", 7), (4, "D11", 2)], "enc_id long, pref string, mask long")
    own = simulate.outcomes(simulate.pools(w), groups).cache()
    assert {r.pref: ([m.mask for m in r.masks], len(r.bars)) for r in own.collect()} == {"A11": ([1], 0), "B11": ([4], 0), "C11": ([0, 1, 2, 4, 0], 4)}
    got = simulate.cohort_masks(prefs, own, groups, "s3", 70).cache()
    arrays = {e: [r.mask for r in got.filter(F.col("enc_id") == e).orderBy("draw").collect()] for e in (1, 2, 3, 4)}
    assert arrays[1] == [5] and arrays[4] == [2] and len(set(arrays[3])) == 4
    bare = prefs.withColumnRenamed("mask", "bare")
    drawn = simulate.draws(bare, w, "s3", 70).withColumn("mask", F.coalesce("mask", "bare"))
    masks = simulate.draw_masks(drawn)
    for enc in (2, 3):
        assert arrays[enc] == [r.mask for r in masks.filter(F.col("enc_id") == enc).orderBy("draw").collect()]
    everyone = prefs.select("enc_id").distinct()
    for score in (simulate.mean_score, simulate.median_score):
        few, many = ({tuple(r) for r in score(everyone, simulate.draw_scores(m, groups), 70, "x").collect()} for m in (got, masks))
        assert few == many
    rates = lambda m: {tuple(r) for r in simulate.group_rate(m, groups, 70).collect()}
    assert rates(got) == rates(masks)
