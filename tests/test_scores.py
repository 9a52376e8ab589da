"""Definitions on small cohorts: literal scores, invariants, corner cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from charlspark.functions.codes import age_band, german_number, normalized, redotted, undotted
from charlspark.operators import estimates, lookups, matching, meta, scoring, simulate
from charlspark.plans.fixtures import CODES
from charlspark.sources import charlson, cohort, frequency

# The cohort whose scores are known.
COHORT = [
    (1, "E11.4|N18.4|I10.0"), (2, "E11.9|E11.4"), (3, "K70.4|K74.6"), (4, "C34.1|C78.0"), (5, "I10.0|E78.0"),
    (6, "I21.0|I50.0|J44.0|E11.4|N18.4|I63.3|G81.1"), (7, "E11|N18|I10|E78"),
]


class World:
    def __init__(self, spark, rows=COHORT):
        self.wide = spark.createDataFrame(rows, "enc_id long, diagnosen string")
        self.dx = cohort.to_long(self.wide)
        groups = charlson.built_in(spark, "reduced")
        self.patterns, self.deps, self.weights = charlson.patterns(groups), charlson.dependencies(groups), charlson.weights(groups)
        self.groups = scoring.Groups.of(self.weights, self.deps)
        table = [(c, c.replace(".", ""), c[:3], 13.0 * (i + 1)) for i, c in enumerate(CODES)]
        self.freq = frequency.custom(spark.createDataFrame(table, "code string, code_nodot string, code3 string, freq_total double"))
        self.probs = lookups.subcode_probs(self.freq)
        self.child_groups = matching.code_groups(self.freq.select(F.col("code_nodot").alias("code")), self.patterns)
        self.status = lookups.prefix_group_status(self.probs, self.child_groups)
        self.q = lookups.prefix_group_prob(self.probs, self.child_groups, ["code3"])
        self.prefs = cohort.prefixes(self.dx)

    def gold(self):
        masks = self.groups.masks(matching.code_groups(self.dx, self.patterns))
        return [r.cci for r in scoring.score(self.wide, self.dx, masks, self.groups).orderBy("enc_id").collect()]

    def s3(self, m, weights=simulate.s3_weights):
        pool = simulate.donors(self.prefs, self.probs)
        masks = self.groups.masks(matching.code_groups(pool.select("code"), self.patterns))
        drawn = simulate.draws(self.prefs, weights(pool).join(masks, "code", "left"), "s3", m)
        return simulate.draw_scores(simulate.draw_masks(drawn), self.groups)


@pytest.fixture(scope="module")
def world(spark):
    return World(spark)


def test_codes(spark):
    df = spark.createDataFrame([(" e11,40. ", "E114", 0.5), ("E11..4", "e11.4", 95.0), ("k70-3", "B24", 4.9), (None, None, None)], "a string, b string, age double")
    rows = df.select(normalized(F.col("a")).alias("n"), undotted(F.col("a")).alias("u"), redotted(F.col("b")).alias("r"), age_band(F.col("age")).alias("g")).collect()
    assert [tuple(r) for r in rows] == [("E11.40", "E1140", "E11.4", "unter 1"), ("E11.4", "E114", "E11.4", "95 u. älter"), ("K703", "K703", "B24", "1 - 5"), (None, None, None, None)]
    numbers = spark.createDataFrame([("1.234,5",), ("-",), ("x",), (" 7 ",)], "t string").select(german_number(F.col("t")).alias("v")).collect()
    assert [r.v for r in numbers] == [1234.5, None, None, 7.0]


def test_map(spark, world, tmp_path):
    assert world.patterns.count() == 206 and world.weights.count() == 17 and world.deps.count() == 3
    path = tmp_path / "map.json"
    path.write_text(json.dumps({"cci_icd_quan_orig": {"a": {"name": "A", "weight": 2, "codes": [{"condition": "any", "codes": ["A11", "A1.1"]}, {"condition": "main", "codes": ["B22"]}]}}}))
    got = charlson.from_json(spark, str(path))
    assert [tuple(r) for r in charlson.patterns(got).collect()] == [("A11", "a", 2.0)] and charlson.dependencies(got).count() == 0


def test_gold(spark, world):
    assert world.gold() == [4, 2, 3, 6, 0, 10, 4]
    extra = World(spark, [(1, "e11.40||E11.90"), (2, None), (3, ""), (4, "AB|NA"), (5, "Z49.1"), (6, " k74,6 ")])
    assert extra.gold() == [2, 0, 0, 0, 2, 1]
    relational = scoring.active(scoring.triggered(world.dx, matching.code_groups(world.dx, world.patterns)), world.deps, world.weights)
    sums = {r.enc_id: r.s for r in relational.groupBy("enc_id").agg(F.sum("w").alias("s")).collect()}
    assert [int(sums.get(i, 0)) for i in range(1, 8)] == world.gold()


def test_prefix_match_is_the_direct_condition(spark, world):
    codes = world.dx.select("code").distinct()
    direct = codes.crossJoin(world.patterns).filter(F.expr("startswith(code, pat) OR startswith(pat, code)")).select("code", "gk").distinct()
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, matching.code_groups(codes, world.patterns).collect()))


def test_interval_and_expected(world):
    s1 = estimates.interval(world.wide, world.prefs, world.status, world.groups).orderBy("enc_id").collect()
    assert [(r.cci_min, r.cci_max, r.cci_mid, r.interval_width) for r in s1] == [(2, 5, 3.5, 3), (0, 3, 1.5, 3), (1, 4, 2.5, 3), (6, 6, 6, 0), (0, 0, 0, 0), (8, 11, 9.5, 3), (2, 5, 3.5, 3)]
    p = estimates.group_prob(estimates.with_q(world.prefs, world.q))
    s2 = estimates.expected(world.wide, p, world.groups).orderBy("enc_id").collect()
    assert np.allclose([r.e_cci for r in s2], [3.183673469, 1.183673469, 1.510204082, 6, 0, 9.183673469, 3.183673469], atol=1e-8)
    assert all(0 <= a.e_cci <= b.cci_max + 1e-9 for a, b in zip(s2, s1))
    assert world.status.groupBy("status").count().orderBy("status").collect()[0]["count"] == 45


def test_probabilities_sum_to_one(world):
    assert all(abs(r.s - 1) < 1e-12 for r in world.probs.groupBy("code3").agg(F.sum("prob").alias("s")).collect())


def test_simulation(spark, world):
    m = 400
    means = simulate.mean_score(world.wide, world.s3(m), m, "x").orderBy("enc_id").collect()
    limit, sd = [3.428571429, 1.428571429, 1.510204082, 6, 0, 9.428571429, 3.428571429], [0.4949, 0.4949, 0.8718, 0, 0, 0.4949, 0.4949]
    assert all(abs(r.x - a) <= 5 * s / m**0.5 + 1e-12 for r, a, s in zip(means, limit, sd))
    again = simulate.mean_score(world.wide, World(spark, COHORT[::-1]).s3(m), m, "x").orderBy("enc_id").collect()
    assert means == again
    medians = simulate.median_score(world.wide, world.s3(501, lambda p: simulate.s4_weights(p, 10).drop("alpha")), 501, "x").orderBy("enc_id").collect()
    assert [r.x for r in medians] == [3, 1, 1, 6, 0, 9, 3]
    with pytest.raises(ValueError):
        world.s3(0)


def test_unknown_prefix_keeps_the_asymmetry(spark):
    w = World(spark, [(1, "C34.1")])
    assert estimates.interval(w.wide, w.prefs, w.status, w.groups).first().cci_max == 0
    assert simulate.mean_score(w.wide, w.s3(3), 3, "x").first().x == 2


def test_meta(spark):
    rng = np.random.default_rng(0)
    gold = rng.poisson(2, 300).astype(float)
    rows = [(float(g), float(g - 1), float(g + 1), float(g + rng.normal(0, 1)), float(g + rng.normal(0, 0.9)), float(g + rng.normal(0, 0.4)), float(g + rng.normal(0, 0.7))) for g in gold]
    names = "cci_gold double, s1_min double, s1_max double, s1_mid double, s2_ecci double, s3_mi double, s4_bayes double"
    w = meta.weights(spark.createDataFrame(rows, names))
    assert abs(sum(w.values()) - 1) < 1e-9 and min(w.values()) >= 0 and max(w, key=w.get) == "S3_mi"
    same = spark.createDataFrame([(float(g),) * 7 for g in gold], names)
    out = meta.predict(same, meta.weights(same)).collect()
    assert meta.weights(same)["S1_mid"] == 1 and all(abs(r.meta - r.cci_gold) < 1e-8 for r in out)
    with pytest.raises(ValueError, match="s4_bayes"):
        meta.gram(same.drop("s4_bayes"))
    with pytest.raises(ValueError, match="freq_total"):
        frequency.custom(spark.createDataFrame([("a",)], "code string"))
