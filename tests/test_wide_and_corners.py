"""Maps beyond one word of a mask, corner cases of the definitions, and the mechanisms behind draws, medians, rates and the fit."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from charlspark.operators import estimates, lookups, matching, meta, scoring, simulate
from charlspark.plans import registry
from charlspark.sources import charlson, cohort, frequency
from charlspark.sources.staging import bucketed

DIR = "/root/testdata/sf0.001"


def map_rows(n):
    """n groups, each of two patterns (some a prefix of another group's), in chains of three; one names a parent that is not there."""
    rows = []
    for i in range(n):
        up = [f"g{i + 1:03d}"] if i % 3 != 2 and i + 1 < n else ["ghost"] if i == 2 else []
        codes = [f"{'ABCDEFGH'[i % 8]}{i // 8:02d}", f"{'ABCDEFGH'[(i + 1) % 8]}{i // 8:02d}.{i % 10}"]
        rows.append({"gk": f"g{i:03d}", "name": None, "weight": [1.0, 2.0, 3.0, 6.0, 0.5][i % 5], "codes": [{"condition": "any", "codes": codes}, {"condition": "main", "codes": ["Z99"]}], "depends_on": up})
    return rows


class Brute:
    def __init__(self, rows):
        self.weight = {r["gk"]: r["weight"] for r in rows}
        self.parents = {r["gk"]: [p for p in r["depends_on"] if p in self.weight] for r in rows}
        self.pats = {r["gk"]: [c.replace(".", "") for c in r["codes"][0]["codes"]] for r in rows}

    def groups(self, code):
        return {g for g, pats in self.pats.items() if any(p.startswith(code) or code.startswith(p) for p in pats)}

    def active(self, groups):
        return {g for g in groups if not set(self.parents[g]) & groups}

    def score(self, groups):
        return sum(self.weight[g] for g in self.active(groups))


@pytest.fixture(scope="module", params=[5, 63, 64, 200])
def wide(spark, request):
    rows = map_rows(request.param)
    table = spark.createDataFrame(pa.Table.from_pylist(rows, charlson.ROWS))
    rng = random.Random(request.param)
    codes = sorted({f"{c}{i:02d}{d}" for c in "ABCDEFGH" for i in range(-(-request.param // 8) + 1) for d in ("", "0", "3", "7", "35")})
    dx = [(e, rng.choice(codes)) for e in range(60) for _ in range(rng.randint(0, 7))]
    return rows, table, dx, codes


def test_masks_of_any_number_of_groups(spark, wide):
    rows, table, dx, codes = wide
    brute = Brute(rows)
    groups, patterns = scoring.Groups.of_map(table), charlson.patterns(table)
    assert len(groups.columns()) == -(-len(rows) // 63) and groups == scoring.Groups.of(charlson.weights(table), charlson.dependencies(table))
    frame = spark.createDataFrame(dx, "enc_id long, code string")
    everyone = spark.createDataFrame([(e,) for e in range(60)], "enc_id long")
    of = {e: set().union(*[brute.groups(c) for i, c in dx if i == e]) for e in range(60)}
    masked = matching.with_masks(frame, patterns, groups, "code", charlson.lengths(table))
    want = {e: int(brute.score(g)) for e, g in of.items()}
    assert {r.enc_id: r.cci for r in scoring.score_masked(everyone, masked, groups).collect()} == want
    by_join = scoring.score(everyone, frame, groups.masks(matching.code_groups(frame, patterns)), groups)
    assert {r.enc_id: r.cci for r in by_join.collect()} == want
    got = {r.enc_id: set(r.a) for r in masked.groupBy("enc_id").agg(*groups.ored()).select("enc_id", groups.active(groups.mask()).alias("a")).collect()}
    assert got == {e: brute.active(of[e]) for e in got}
    relational = scoring.active(scoring.triggered(frame, matching.code_groups(frame, patterns)), charlson.dependencies(table), charlson.weights(table)).groupBy("enc_id").agg(F.sum("w").alias("s"))
    assert {r.enc_id: int(r.s) for r in relational.collect()} == {e: s for e, s in want.items() if of[e]}


def test_estimates_of_any_number_of_groups(spark, wide):
    rows, table, dx, codes = wide
    brute, groups, patterns = Brute(rows), scoring.Groups.of_map(table), charlson.patterns(table)
    full = [c for c in codes if len(c) > 3]
    freq = frequency.custom(spark.createDataFrame([(c, c, c[:3], float(len(c) * 3 + ord(c[-1]) % 7)) for c in full], "code string, code_nodot string, code3 string, freq_total double"))
    probs = lookups.subcode_probs(freq)
    child = matching.groups_of(freq.select(F.col("code_nodot").alias("code")), patterns, groups, "code", charlson.lengths(table))
    frame = spark.createDataFrame(dx, "enc_id long, code string")
    everyone = spark.createDataFrame([(e,) for e in range(60)], "enc_id long")
    prefs = cohort.prefixes(frame)
    prob = {(r.code3, r.code_nodot): r.prob for r in probs.collect()}
    children = {}
    for p, c in prob:
        children.setdefault(p, []).append(c)
    mine = {e: sorted({c[:3] for i, c in dx if i == e} & set(children)) for e in range(60)}
    s1 = {r.enc_id: (r.cci_min, r.cci_max) for r in estimates.interval(everyone, prefs, lookups.prefix_group_status(probs, child), groups).collect()}
    s2 = {r.enc_id: r.e_cci for r in estimates.expected(everyone, estimates.group_prob(estimates.with_q(prefs, lookups.prefix_group_prob(probs, child, ["code3"]))), groups).collect()}
    for e, own in mine.items():
        sure = set().union(*[set.intersection(*[brute.groups(c) for c in children[p]]) for p in own])
        some = set().union(*[brute.groups(c) for p in own for c in children[p]])
        assert s1[e] == (brute.score(sure), sum(brute.weight[g] for g in some))
        q = {g: 1 - np.prod([1 - min(sum(prob[p, c] for c in children[p] if g in brute.groups(c)), 1 - 1e-12) for p in own]) for g in some}
        assert abs(s2[e] - sum(q[g] * brute.weight[g] * np.prod([1 - q.get(u, 0.0) for u in brute.parents[g]]) for g in q)) < 1e-9
    weights = matching.with_masks(simulate.s3_weights(simulate.observed(probs)), patterns, groups, "code", charlson.lengths(table))
    for n in (7, 200):  # lanes of 8 and of 16 bits
        drawn = simulate.draws(prefs.filter(F.col("pref").isin([*children])), weights, "s3", n)
        rows_ = drawn.collect()
        seen = {}
        for r in rows_:
            seen.setdefault((r.enc_id, r.draw), set()).update(brute.groups(r.code))
        rate = {}
        for (e, _), g in seen.items():
            for x in brute.active(g):
                rate[e, x] = rate.get((e, x), 0) + 1
        masks = simulate.draw_masks(drawn)
        assert {(r.enc_id, r.gk): r.p_counted for r in simulate.group_rate(masks, groups, n).collect()} == {k: v / n for k, v in rate.items()}
        middle = {r.enc_id: r.x for r in simulate.median_score(everyone, simulate.draw_scores(masks, groups), n, "x").collect()}
        assert middle == {e: float(np.median([int(brute.score(seen[e, d])) for d in range(1, n + 1)])) if (e, 1) in seen else 0.0 for e in range(60)}


def test_suppression_is_against_the_whole_set(spark):
    """A parent that is suppressed itself still suppresses; so do parents in another word."""
    names = tuple(f"g{i:03d}" for i in range(130))
    parents = tuple((i + 64,) if i < 60 else (i + 1,) if i == 64 else () for i in range(130))
    groups = scoring.Groups(names, tuple(1.0 for _ in names), parents)
    members = [[0, 64], [0, 64, 65], [64, 65], [0], [65], []]
    table = spark.createDataFrame([(k, *groups.literal(m)) for k, m in enumerate(members)], "k long, mask long, mask1 long, mask2 long")
    got = [r.s for r in table.select("k", groups.score(groups.mask()).alias("s")).orderBy("k").collect()]
    assert got == [1, 1, 1, 1, 1, 0] and [r.s for r in groups.score_of(table, "s").orderBy("k").collect()] == got


def test_merge_pass_is_the_direct_condition(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("AB1") for _ in range(rng.randint(1, 5)))
    codes, pats = {word() for _ in range(80)}, [(word(), rng.choice("xyz"), 1.0) for _ in range(60)] + [("", "x", 1.0)]
    got = matching.pattern_hits(spark.createDataFrame([(c,) for c in codes], "code string").repartition(4), spark.createDataFrame(pats, "pat string, gk string, w double").distinct())
    want = {(c, p, g, 1.0) for c in codes for p, g, _ in pats if p and (c.startswith(p) or p.startswith(c))}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    none = matching.pattern_hits(spark.createDataFrame([], "code string"), spark.createDataFrame(pats, "pat string, gk string, w double"))
    assert none.count() == 0


def test_empty_map(spark):
    """Every score is 0, whatever the codes."""
    table = spark.createDataFrame(pa.Table.from_pylist([], charlson.ROWS))
    groups, patterns = scoring.Groups.of_map(table), charlson.patterns(table)
    dx = spark.createDataFrame([(1, "E114"), (2, "N18")], "enc_id long, code string")
    masked = matching.with_masks(dx, patterns, groups, "code", charlson.lengths(table))
    assert [r.cci for r in scoring.score_masked(dx.select("enc_id"), masked, groups).collect()] == [0, 0]
    assert [r.a for r in masked.select(groups.active(groups.mask()).alias("a")).collect()] == [[], []]
    none = spark.createDataFrame([], "enc_id long, gk string, p_active double")
    assert [r.e_cci for r in estimates.expected(dx.select("enc_id"), none, groups).collect()] == [0.0, 0.0]


@pytest.fixture(scope="module")
def small(spark):
    table = charlson.built_in(spark, "reduced")
    rows = [("E114", 13.0), ("E119", 26.0), ("N184", 0.0), ("N189", 0.0), ("I210", 5.0), ("I214", None), ("C780", 2.0)]
    freq = spark.createDataFrame([(c, c, c[:3], f, 0.0 if c[:3] == "E11" else f) for c, f in rows], "code string, code_nodot string, code3 string, freq_total double, `15-18` double")
    probs = lookups.subcode_probs(frequency.custom(freq))
    return table, frequency.custom(freq), probs


def test_prefix_without_frequency(spark, small):
    """It is no donor and has no probability, but its children's groups count for the interval; draws fall back to the prefix."""
    table, _, probs = small
    groups, patterns, lengths = scoring.Groups.of_map(table), charlson.patterns(table), charlson.lengths(table)
    prefs = spark.createDataFrame([(1, "N18"), (2, "E11")], "enc_id long, pref string")
    child = matching.groups_of(probs.select(F.col("code_nodot").alias("code")), patterns, groups, "code", lengths)
    assert {r.gk for r in lookups.prefix_group_status(probs, child).filter("code3 = 'N18'").collect()} == {"kidney"}
    assert lookups.prefix_group_prob(probs, child, ["code3"]).filter("code3 = 'N18'").count() == 0
    drawn = simulate.draws(prefs, simulate.s3_weights(simulate.observed(probs)), "s3", 5)
    assert {r.code for r in drawn.filter("enc_id = 1").collect()} == {"N18"} and {r.code for r in drawn.filter("enc_id = 2").collect()} <= {"E114", "E119"}
    assert {(r.pref, r.code, r.bare) for r in simulate.donors(prefs, probs).collect()} == {("N18", "N18", True), ("E11", "E114", False), ("E11", "E119", False)}


def test_age_bands_fall_back(spark, small):
    """An unusable age or a band that the table lacks: all ages; a band that is there but empty: no probability."""
    table, freq, probs = small
    groups, patterns, lengths = scoring.Groups.of_map(table), charlson.patterns(table), charlson.lengths(table)
    child = matching.groups_of(freq.select(F.col("code_nodot").alias("code")), patterns, groups, "code", lengths)
    q, aged = lookups.prefix_group_prob(probs, child, ["code3"]), lookups.prefix_group_prob(lookups.subcode_probs_by_age(frequency.by_age(freq)), child, ["code3", "age_bin"])
    people = spark.createDataFrame([(1, None), (2, float("nan")), (3, 40.0), (4, 16.0), (5, 16.0)], "enc_id long, age double")
    prefs = spark.createDataFrame([(1, "E11"), (2, "E11"), (3, "E11"), (4, "E11"), (5, "I21")], "enc_id long, pref string")
    got = estimates.expected(people, estimates.group_prob(estimates.with_q_by_age(prefs, people, q, aged, ["15-18"])), groups)
    e = {r.enc_id: round(r.e_cci, 6) for r in got.collect()}
    # one third complicated (2), two thirds simple (1), each less where the other is active
    assert e[1] == e[2] == e[3] == round(1 / 3 * 2 + 2 / 3 * (1 - 1 / 3), 6) and e[4] == 0 and abs(e[5] - 1) < 1e-6


def test_draws_do_not_depend_on_partitions_and_large_alpha_approaches_frequencies(spark, small):
    _, _, probs = small
    prefs = spark.createDataFrame([(i, p) for i in range(200) for p in ("E11", "I21", "X99")], "enc_id long, pref string")
    own = simulate.observed(probs)
    s3 = {tuple(r) for r in simulate.draws(prefs.repartition(7), simulate.s3_weights(own), "s3", 9).collect()}
    assert s3 == {tuple(r) for r in simulate.draws(prefs.coalesce(1), simulate.s3_weights(own), "s3", 9).collect()}
    assert s3 == {tuple(r) for r in simulate.draws(prefs, simulate.s4_weights(own, 1e12).drop("alpha"), "s3", 9).collect()}
    assert s3 != {tuple(r) for r in simulate.draws(prefs, simulate.s4_weights(own, 1).drop("alpha"), "s3", 9).collect()}
    share = sum(c == "E114" for _, p, _, c in s3 if p == "E11") / (200 * 9)
    assert abs(share - 1 / 3) < 0.05


def test_binary_search(spark):
    upto = [[0.5, 1.0, 4.0, 4.0, 9.0], [2.0], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]]
    rows = [(k, u / 64, x) for k, x in enumerate(upto) for u in range(64)]
    got = simulate.place(spark.createDataFrame(rows, "k int, u double, upto array<double>"), 8).collect()
    assert all(r.place == next((i for i, x in enumerate(r.upto) if r.u * r.upto[-1] < x), len(r.upto) - 1) for r in got)


def enumerated(g, t):
    best, value = np.zeros(len(t)), 0.0
    for k in range(1, len(t) + 1):
        for own in itertools.combinations(range(len(t)), k):
            a = g[np.ix_(own, own)]
            if np.linalg.matrix_rank(a) == k:
                w = np.linalg.solve(a, t[list(own)])
                if (w >= 0).all() and w @ a @ w - 2 * w @ t[list(own)] < value - 1e-9 * abs(value):
                    value, best = w @ a @ w - 2 * w @ t[list(own)], np.zeros(len(t))
                    best[list(own)] = w
    return best / best.sum() if best.sum() else best


def test_active_sets():
    rng = np.random.default_rng(0)
    for trial in range(200):
        z = rng.normal(size=(40, 4)) + rng.normal(size=(40, 1)) * (trial % 3)
        y = z @ rng.normal(size=4) + rng.normal(size=40)
        assert np.allclose(meta.solve(z.T @ z, z.T @ y), enumerated(z.T @ z, z.T @ y), atol=1e-6)
    for trial in range(20):
        z = rng.normal(size=(100, 12)) + rng.normal(size=(100, 1))
        y = z @ np.maximum(rng.normal(size=12), 0) + rng.normal(size=100)
        g, t = z.T @ z, z.T @ y
        w = meta.solve(g, t)
        scale = (w @ t) / (w @ g @ w)
        slope = t - g @ (w * scale)
        assert (w >= 0).all() and abs(w.sum() - 1) < 1e-9 and np.abs(slope[w > 0]).max() < 1e-6 * np.abs(t).max() and slope[w == 0].max(initial=0) < 1e-6 * np.abs(t).max()
    same = np.outer(np.ones(5), np.ones(5)) * 7.0
    assert meta.solve(same, same[0]).tolist() == [1, 0, 0, 0, 0]
    z = rng.normal(size=(50, 3))
    z = np.column_stack([z, z[:, 0] + z[:, 1], 2 * z[:, 2]])
    y = z[:, 3] + z[:, 2]
    w = meta.solve(z.T @ z, z.T @ y)
    scale = (w @ (z.T @ y)) / (w @ z.T @ z @ w)
    assert np.allclose(z @ w * scale, y, atol=1e-6)
    assert meta.solve(np.zeros((3, 3)), np.zeros(3)).tolist() == [0, 0, 0] and meta.solve(np.eye(2), np.array([-1.0, -2.0])).tolist() == [0, 0]


def test_fit_leaves_out_incomplete_rows(spark):
    names = "cci_gold double, s1_min double, s1_max double, s1_mid double, s2_ecci double, s3_mi double, s4_bayes double"
    rng = np.random.default_rng(2)
    rows = [tuple(float(x) for x in rng.poisson(3, 7)) for _ in range(40)]
    odd = [(1.0, 0.0, 2.0, None, 1.0, 1.0, 1.0), (1.0, 0.0, 2.0, 1.0, float("nan"), 1.0, 1.0), (None, 0.0, 2.0, 1.0, 1.0, 1.0, 1.0)]
    whole, both = spark.createDataFrame(rows, names), spark.createDataFrame(rows + odd, names)
    assert meta.weights(whole) == meta.weights(both)
    assert sorted(map(tuple, meta.cv_risk(whole).collect())) == sorted(map(tuple, meta.cv_risk(both).collect()))
    risk = dict(map(tuple, meta.cv_risk(both).collect()))
    assert all(abs(risk[n] - np.mean([(r[i] - r[0]) ** 2 for r in rows])) < 1e-9 for i, n in ((3, "S1_mid"), (4, "S2_ecci"), (5, "S3_mi"), (6, "S4_bayes")))
    out, seen = meta.observed(both)
    assert meta.fitted(seen) == meta.weights(both) and out.count() == 43 and seen["n"] == 40
    assert sum(r.meta is None or np.isnan(r.meta) for r in meta.predict(out, meta.fitted(seen)).collect()) == 2
    assert dict(map(tuple, meta.cv_risk(whole.limit(0)).collect())) == dict.fromkeys(meta.LEARNERS.values())


def test_frequencies_from_text(spark, tmp_path):
    good = ['E11.4;m;"1.234";-', "E11.4;w;6;7", " e11.9 ;m;2,5;x", "Total;m;9;9", "I10.0;m;/;."]
    bad = ["E11.4;m;5", "E11.9;w;5;6;7", ";m;1;2"]
    path = tmp_path / "rows"
    path.mkdir()
    (path / "a.txt").write_text("\n".join(good[:3] + bad[:2]) + "\n", encoding="utf-8")
    (path / "b.txt").write_text("\n".join(bad[2:] + good[3:]), encoding="utf-8")
    table, rejected = frequency.from_text(spark, str(path), ["code", "sex_raw", "total", "15-18"])
    assert {(r.code, r.code_nodot, r.code3, r.freq_total, r["15-18"]) for r in table.collect()} == {("E11.4", "E114", "E11", 1240.0, 7.0), ("E11.9", "E119", "E11", 2.5, 0.0), ("I10.0", "I100", "I10", 0.0, 0.0)}
    assert sorted(r.rejected for r in rejected.collect()) == sorted(bad)


def test_buckets_need_no_exchange(spark):
    table = bucketed(spark.range(100).select((F.col("id") % 10).alias("k"), "id"), "k", 4)
    grouped = table.groupBy("k").agg(F.sum("id").alias("s"))
    assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString() and grouped.count() == 10
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("staged_")]


def test_plans(spark):
    job = registry.Job(spark, DIR)
    gold = job.gold._jdf.queryExecution().executedPlan().toString()
    assert gold.count("lineitem.parquet") == 1
    text = job.side_by_side._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in text and "orders.parquet" not in text and "hashpartitioning(enc_id" not in text and "InMemoryTableScan" not in text
    assert job.drawn("s3").count() == job.prefs.count() * registry.M
