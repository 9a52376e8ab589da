"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from charlspark.functions.codes import AGE_LABELS, age_band, normalized, redotted, undotted
from charlspark.operators import estimates, lookups, matching, meta, scoring, simulate
from charlspark.plans import fixtures, oracle
from charlspark.sources import charlson, cohort, frequency
from charlspark.sources.staging import MOST, for_all, shared_path, slim_rows, staged

M, N_DRAWS, ALPHA_0, SEED = 20, 25, 10, 42


class Job:
    """The tables of one cohort, built on first use; all are lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir
        self.made: dict[str, object] = {}

    def once(self, name: str, make: Callable):
        if name not in self.made:
            self.made[name] = make()
        return self.made[name]

    @property
    def map(self) -> DataFrame:
        return self.once("map", lambda: fixtures.charlson_map(self.spark))

    @property
    def patterns(self) -> DataFrame:
        """In one partition, like all that is as small as a map, so that no step exchanges it."""
        return charlson.patterns(self.map.coalesce(1))

    @property
    def deps(self) -> DataFrame:
        return charlson.dependencies(self.map.coalesce(1))

    @property
    def weights(self) -> DataFrame:
        return charlson.weights(self.map.coalesce(1))

    @property
    def groups(self) -> scoring.Groups:
        return self.once("groups", lambda: scoring.Groups.of_map(self.map))

    def masked(self, rows: DataFrame, code: str) -> DataFrame:
        """rows with the masks of their codes."""
        return matching.with_masks(rows, self.patterns, self.groups, code, self.lengths)

    @property
    def lengths(self) -> tuple[int, ...]:
        return self.once("lengths", lambda: charlson.lengths(self.map))

    @property
    def parts(self) -> int:
        """Partitions by encounter; a number that is named is kept, as draws make many rows of few."""
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    @property
    def encounters(self) -> DataFrame:
        return fixtures.encounters(self.spark, self.dir)

    @property
    def dx(self) -> DataFrame:
        return self.once("dx", lambda: fixtures.dx(self.spark, self.dir))

    @property
    def prefs(self) -> DataFrame:
        """By encounter: whatever groups by enc_id after this needs no exchange."""
        return cohort.prefixes(self.dx.repartition(self.parts, "enc_id"))

    @property
    def code_groups(self) -> DataFrame:
        return matching.code_groups(self.dx, self.patterns)

    @property
    def triggered(self) -> DataFrame:
        return scoring.triggered(self.dx, self.code_groups)

    @property
    def active(self) -> DataFrame:
        return scoring.active(self.triggered, self.deps, self.weights)

    @property
    def gold(self) -> DataFrame:
        return scoring.score_masked(self.encounters, self.masked(self.dx, "code"), self.groups)

    @property
    def freq(self) -> DataFrame:
        """The frequencies, written once: a row for each code of a code system, so one partition, which no lookup exchanges."""
        return self.once("freq", lambda: staged(fixtures.freq(self.spark, self.dir)).coalesce(1))

    @property
    def probs(self) -> DataFrame:
        return lookups.subcode_probs(self.freq)

    @property
    def aged(self) -> DataFrame:
        return lookups.subcode_probs_by_age(frequency.by_age(self.freq))

    @property
    def child_groups(self) -> DataFrame:
        return matching.groups_of(self.freq.select(F.col("code_nodot").alias("code")), self.patterns, self.groups, "code", self.lengths)

    @property
    def status(self) -> DataFrame:
        return self.once("status", lambda: for_all(lookups.prefix_group_status(self.probs, self.child_groups)))

    @property
    def q(self) -> DataFrame:
        return self.once("q", lambda: for_all(lookups.prefix_group_prob(self.probs, self.child_groups, ["code3"])))

    @property
    def interval(self) -> DataFrame:
        return estimates.interval(self.encounters, self.prefs, self.status, self.groups)

    @property
    def group_prob(self) -> DataFrame:
        return estimates.group_prob(estimates.with_q(self.prefs, self.q))

    @property
    def expected(self) -> DataFrame:
        return estimates.expected(self.encounters, self.group_prob, self.groups)

    @property
    def expected_by_age(self) -> DataFrame:
        q_aged = lookups.prefix_group_prob(self.aged, self.child_groups, ["code3", "age_bin"])
        bands = [c for c in self.freq.columns if c not in ("code", "code_nodot", "code3", "freq_total")]
        keyed = estimates.with_q_by_age(self.prefs, self.encounters, self.q, q_aged, bands)
        return estimates.expected(self.encounters, estimates.group_prob(keyed), self.groups)

    @property
    def donors(self) -> DataFrame:
        """Donors of the prefixes that occur."""
        return simulate.donors(self.prefs, self.probs)

    def pool(self, stage: str) -> DataFrame:
        """The donors of each prefix of the frequencies as one row, with their masks; a small table that all draws meet."""

        def make() -> DataFrame:
            own = simulate.observed(self.probs)
            w = simulate.s3_weights(own) if stage == "s3" else simulate.s4_weights(own, ALPHA_0).drop("alpha")
            return staged(simulate.pools(self.masked(w, "code")))

        return self.once(f"pool_{stage}", make)

    def drawn(self, stage: str) -> DataFrame:
        return simulate.drawn(self.prefs, self.pool(stage), stage, M if stage == "s3" else N_DRAWS, SEED)

    def outcomes(self, stage: str) -> DataFrame:
        return self.once(f"outcomes_{stage}", lambda: staged(simulate.outcomes(self.pool(stage), self.groups).coalesce(1)))

    def draw_masks(self, stage: str) -> DataFrame:
        """Outcomes carry their masks into the draws; a prefix without donors has the mask of the bare prefix."""
        return simulate.cohort_masks(self.masked(self.prefs, "pref"), self.outcomes(stage), self.groups, stage, M if stage == "s3" else N_DRAWS, SEED)

    def visited(self, rows: DataFrame, profile: DataFrame, stages: list[tuple[str, int, str]], **what) -> DataFrame:
        """rows: enc_id, pref and what else visited takes; the masks of bare prefixes are added here."""
        g, shorter = self.groups, tuple(k for k in self.lengths if k < 3)
        if shorter:
            rows = matching.with_masks(rows, self.patterns, g, "pref", shorter)
        bare = matching.head_masks(self.patterns, g, self.lengths).withColumnsRenamed(dict(zip(g.columns(), g.columns("bare"))))
        known = staged(profile.join(bare.coalesce(1), "pref", "full").coalesce(1))
        return simulate.visited(self.encounters, rows, known, known.count() <= MOST, g, self.parts, stages, seed=SEED, **what)

    def stage(self, stage: str, n: int, use: str, name: str) -> DataFrame:
        rows = self.dx.select("enc_id", F.substring("code", 1, 3).alias("pref"))
        out = self.visited(rows, simulate.shared(self.outcomes(stage), self.groups, stage), [(stage, n, use)])
        with slim_rows(self.spark):
            return staged(out.withColumnRenamed(stage, name))

    @property
    def s3(self) -> DataFrame:
        return self.stage("s3", M, "mean", "s3_mi")

    @property
    def s4(self) -> DataFrame:
        return self.stage("s4", N_DRAWS, "median", "s4_bayes")

    @property
    def profile(self) -> DataFrame:
        """All that the estimates take from a prefix, as one row."""
        g = self.groups
        tables = [estimates.status_masks(self.status, g), estimates.chances(self.q, g), *[simulate.shared(self.outcomes(s), g, s) for s in ("s3", "s4")]]
        tables = [t.withColumnRenamed("code3", "pref").coalesce(1) for t in tables]
        return reduce(lambda a, b: a.join(b, "pref", "full"), tables)

    @property
    def together(self) -> DataFrame:
        """One row for each encounter with gold and all estimates, from one pass over the diagnoses."""
        g = self.groups
        rows = self.masked(self.dx, "code").withColumnsRenamed(dict(zip(g.columns(), g.columns("gold")))).withColumn("pref", F.substring("code", 1, 3)).drop("code")
        own = self.visited(rows, self.profile, [("s3", M, "mean"), ("s4", N_DRAWS, "median")], kinds=("gold", "sure", "any"), chances=True).filter("enc_id IS NOT NULL")
        exact = estimates.bounds(g.score_of(own, "cci", "gold"), g).withColumn("cci_gold", F.coalesce("cci", F.lit(0.0)).cast("int"))
        named = {"cci_min": "s1_min", "cci_max": "s1_max", "cci_mid": "s1_mid", "expected": "s2_ecci", "s3": "s3_mi", "s4": "s4_bayes"}
        return exact.select("enc_id", "cci_gold", *[F.col(c).alias(n) for c, n in named.items()])

    @property
    def side_by_side(self) -> DataFrame:
        """These estimates from where they were written."""
        return self.estimates[0]

    @property
    def estimates(self) -> tuple[DataFrame, Row]:
        """These estimates, written once, and the sums of the fit, gathered on the way."""

        def make() -> tuple[DataFrame, Row]:
            together = self.together
            with slim_rows(self.spark):
                return meta.observed(together)

        return self.once("estimates", make)

    @property
    def learners(self) -> DataFrame:
        return self.estimates[0]

    @property
    def sums(self) -> Row:
        return self.estimates[1]


def r6(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to six digits, as sums are added in another order elsewhere."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def quan_patterns(j: Job) -> DataFrame:
    hits = matching.pattern_hits(j.dx.select("code").distinct(), j.patterns)
    per = j.dx.join(hits, "code").groupBy("pat", "gk").count()
    return j.patterns.join(per, ["pat", "gk"], "left").select("pat", "gk", "w", F.coalesce("count", F.lit(0)).alias("n_dx"))


def quan_deps(j: Job) -> DataFrame:
    t = j.triggered
    both = t.withColumnRenamed("gk", "child").join(j.deps, "child").join(t.select(F.col("enc_id").alias("enc_id"), F.col("gk").alias("parent")), ["enc_id", "parent"])
    per = both.groupBy("child", "parent").count()
    return j.deps.join(per, ["child", "parent"], "left").select("child", "parent", F.coalesce("count", F.lit(0)).alias("n_enc"))


def quan_weights(j: Job) -> DataFrame:
    per = j.triggered.groupBy("gk").count()
    return j.weights.join(per, "gk", "left").select("gk", "w", F.coalesce("count", F.lit(0)).alias("n_enc"))


def dx_normalized(j: Job) -> DataFrame:
    raw = fixtures.dx_raw(j.spark, j.dir).select("raw").distinct()
    return raw.select("raw", normalized(F.col("raw")).alias("code"), undotted(F.col("raw")).alias("code_nodot"))


def dx_anonymized(j: Job) -> DataFrame:
    return j.prefs.groupBy("enc_id").agg(F.array_join(F.array_sort(F.collect_set("pref")), "|").alias("diagnosen"))


def dx_redotted(j: Job) -> DataFrame:
    return fixtures.dx_raw(j.spark, j.dir).select("raw").distinct().select("raw", redotted(F.col("raw")).alias("code"))


def age_bins(j: Job) -> DataFrame:
    return j.encounters.select("enc_id", "age", age_band(F.col("age")).alias("age_bin"))


def code_list_match(j: Job) -> DataFrame:
    listed = j.patterns.filter(F.col("gk").isin("hf", "kidney")).select("pat").distinct()
    return matching.encounters_with(j.dx, listed)


def freq_from_text(j: Job) -> DataFrame:
    """The counts written as text, with a broken copy of each row of one sex among them (its total left out), and read again: parsed rows, and
    rejected ones with null for all but their text."""
    bands = [b for b in AGE_LABELS if b != fixtures.MISSING_BAND]
    raw, path = staged(fixtures.freq_raw(j.spark, j.dir)), shared_path(j.spark)
    columns = ["code", "sex_raw", "total", *bands]
    line = lambda names: F.concat_ws(";", *[F.col(f"`{c}`") for c in names]).alias("value")
    broken = raw.filter("sex_raw = 'm'").select(line([c for c in columns if c != "total"]))
    raw.select(line(columns)).unionByName(broken).write.text(path)
    table, rejected = frequency.from_text(j.spark, path, columns)
    none = F.lit(None).cast("string")
    parsed = freq_bandless(table).select("code", "code_nodot", "freq_total", "f15_18", none.alias("rejected"))
    return parsed.unionByName(rejected.select(none.alias("code"), none.alias("code_nodot"), F.lit(None).cast("double").alias("freq_total"), F.lit(None).cast("double").alias("f15_18"), "rejected"))


def quan_patterns_file(j: Job) -> DataFrame:
    """The map written as a JSON file and read from it: diagnoses of each pattern."""
    path = shared_path(j.spark)
    j.spark.createDataFrame([(charlson.built_in_text("reduced"),)], "value string").coalesce(1).write.text(path, lineSep=" ")
    j.made["map"] = charlson.from_json(j.spark, path)
    return quan_patterns(j)


def freq_by_age(j: Job) -> DataFrame:
    return frequency.by_age(j.freq)


def freq_bandless(df: DataFrame) -> DataFrame:
    return df.select("code", "code_nodot", "code3", "freq_total", F.col("`15-18`").alias("f15_18"), F.col("`40 - 45`").alias("f40_45"))


def s4_params(j: Job) -> DataFrame:
    return r6(simulate.s4_weights(j.donors, ALPHA_0), "alpha")


def cohort_estimates(j: Job) -> DataFrame:
    out = meta.predict(j.learners, meta.fitted(j.sums))
    return r6(out.withColumn("meta", F.round("meta", 3)), "s2_ecci")


def meta_gram(j: Job) -> DataFrame:
    row = j.sums.asDict()
    out = j.spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} {'long' if c == 'n' else 'double'}" for c in row))
    return r6(out, *[c for c in row if c != "n"])


def meta_predictions(j: Job) -> DataFrame:
    return meta.predict(j.learners, meta.fitted(j.sums)).select("enc_id", F.round("meta", 3).alias("meta"))


JOBS: dict[str, Callable[[Job], DataFrame]] = {
    "cohort_wide": lambda j: fixtures.wide(j.spark, j.dir),
    "quan_patterns": quan_patterns,
    "quan_deps": quan_deps,
    "quan_weights": quan_weights,
    "freq_from_raw": lambda j: freq_bandless(frequency.from_raw(fixtures.freq_raw(j.spark, j.dir))),
    "freq_from_text": freq_from_text,
    "quan_patterns_file": quan_patterns_file,
    "freq_custom": lambda j: freq_bandless(j.freq),
    "freq_by_age": freq_by_age,
    "dx_long": lambda j: cohort.to_long(fixtures.wide(j.spark, j.dir)),
    "dx_normalized": dx_normalized,
    "dx_anonymized": dx_anonymized,
    "dx_redotted": dx_redotted,
    "age_bins": age_bins,
    "code_list_match": code_list_match,
    "code_groups": lambda j: j.code_groups,
    "gold_triggered": lambda j: j.triggered,
    "gold_active": lambda j: j.active,
    "gold_score": lambda j: j.gold,
    "subcode_probs": lambda j: r6(j.probs, "prob"),
    "subcode_probs_by_age": lambda j: r6(j.aged, "prob"),
    "child_groups": lambda j: j.child_groups,
    "prefix_group_status": lambda j: j.status,
    "prefix_group_prob": lambda j: r6(j.q, "q"),
    "s1_group_status": lambda j: estimates.group_status(j.prefs, j.status),
    "s1_interval": lambda j: j.interval,
    "s2_group_prob": lambda j: r6(j.group_prob, "p_active"),
    "s2_expected": lambda j: r6(j.expected, "e_cci"),
    "s2_expected_by_age": lambda j: r6(j.expected_by_age, "e_cci"),
    "s3_donors": lambda j: j.donors.select("pref", "code", "freq", "total"),
    "s3_draws": lambda j: j.drawn("s3").select("enc_id", "pref", "draw", "code"),
    "s3_mi": lambda j: j.s3,
    "s3_group_rate": lambda j: simulate.group_rate(j.draw_masks("s3"), j.groups, M),
    "s4_params": s4_params,
    "s4_draws": lambda j: j.drawn("s4").select("enc_id", "pref", "draw", "code"),
    "s4_median": lambda j: j.s4,
    "s4_group_rate": lambda j: simulate.group_rate(j.draw_masks("s4"), j.groups, N_DRAWS),
    "meta_gram": meta_gram,
    "meta_weights": lambda j: meta.named(j.learners, meta.fitted(j.sums), "weight").withColumn("weight", F.round("weight", 4)),
    "meta_cv_risk": lambda j: r6(meta.named(j.learners, meta.risks(j.sums), "cv_risk"), "cv_risk"),
    "meta_predictions": meta_predictions,
    "cohort_estimates": cohort_estimates,
}


def run(job: Callable[[Job], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    return job(Job(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(run, job) for name, job in JOBS.items()}


def oracle_sql() -> dict[str, str]:
    return oracle.sql()


__all__ = ["JOBS", "Job", "oracle_sql", "queries"]
