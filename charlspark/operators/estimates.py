"""Estimates from prefixes alone: interval (S1) and expected score (S2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charlspark.functions.codes import AGE_LABELS, age_band
from charlspark.operators.scoring import Groups

NEARLY_ONE = 1 - 1e-12
ANY_AGE = "*"


def group_status(prefs: DataFrame, status: DataFrame) -> DataFrame:
    """enc_id, gk, status; certain wins."""
    hit = prefs.join(status, prefs["pref"] == status["code3"])
    return hit.groupBy("enc_id", "gk").agg(F.min("status").alias("status"))


def status_masks(status: DataFrame, groups: Groups) -> DataFrame:
    """code3 and two masks of its groups, sure and any."""
    bits = groups.bits(F.col("gk"))
    sure = [F.when(F.col("status") == "certain", b).otherwise(F.lit(0).cast("long")) for b in bits]
    return status.groupBy("code3").agg(*groups.ored("sure", sure), *groups.ored("any", bits))


def bounds(masked: DataFrame, groups: Groups) -> DataFrame:
    """masked (a row for each encounter with the masks sure and any) with the bounds in their place."""
    out = groups.score_of(masked, "lo", "sure").withColumn("hi", groups.total(groups.mask("any"))).drop(*groups.columns("any"))
    low, high = F.coalesce("lo", F.lit(0.0)), F.coalesce("hi", F.lit(0.0))
    return out.withColumns({"cci_min": low, "cci_max": high, "cci_mid": (low + high) / 2, "interval_width": high - low}).drop("lo", "hi")


def interval(encounters: DataFrame, prefs: DataFrame, status: DataFrame, groups: Groups) -> DataFrame:
    """enc_id, cci_min (certain groups, suppressed among themselves), cci_max (all groups), cci_mid, interval_width.

    The status table becomes two masks for each prefix, so a single aggregation by enc_id suffices."""
    masks = status_masks(status, groups)
    own = prefs.join(masks, prefs["pref"] == masks["code3"], "left").groupBy("enc_id").agg(*groups.ored("sure"), *groups.ored("any"))
    return bounds(encounters.select("enc_id").join(own, "enc_id", "left"), groups)


def group_prob(keyed: DataFrame) -> DataFrame:
    """enc_id, gk, q -> enc_id, gk, p_active: the probability that any prefix brings the group, before suppression."""
    none = F.exp(F.sum(F.log1p(-F.least(F.col("q"), F.lit(NEARLY_ONE)))))
    return keyed.groupBy("enc_id", "gk").agg(F.greatest(1 - none, F.lit(0.0)).alias("p_active"))


def expected(encounters: DataFrame, probs: DataFrame, groups: Groups) -> DataFrame:
    """enc_id, e_cci: the sum of p times the weight times the chance that no parent is active, for any number of groups.

    Each group's row also serves its children, as a factor: children meet their parents in an aggregation by encounter and
    group, which is partitioned like probs if that is by enc_id, and not in a join of the table with itself."""
    if not groups.names:
        return encounters.select("enc_id", F.lit(0.0).alias("e_cci"))
    child = {up: [i for i, ups in enumerate(groups.parents) if up in ups] for up in range(len(groups.names))}
    roles = F.array(*[F.array(F.lit(i), *map(F.lit, child[i])) for i in range(len(groups.names))])
    at = (F.array_position(F.array(*map(F.lit, groups.names)), F.col("gk")) - 1).cast("int")
    rows = probs.select("enc_id", "p_active", at.alias("own")).filter("own >= 0")
    rows = rows.select("enc_id", "own", "p_active", F.explode(F.get(roles, F.col("own"))).alias("for"))
    mine = F.col("own") == F.col("for")
    pairs = rows.groupBy("enc_id", "for").agg(F.max(F.when(mine, F.col("p_active"))).alias("p"), F.coalesce(F.product(F.when(~mine, 1 - F.col("p_active"))), F.lit(1.0)).alias("free"))
    weight = F.get(F.array(*map(F.lit, groups.weights)), F.col("for"))
    own = pairs.groupBy("enc_id").agg(F.sum(F.col("p") * weight * F.col("free")).alias("e"))
    return encounters.select("enc_id").join(own, "enc_id", "left").select("enc_id", F.coalesce("e", F.lit(0.0)).alias("e_cci"))


def chances(q: DataFrame, groups: Groups) -> DataFrame:
    """code3 and chances: its groups (g, their positions) and the logarithms (t) of the chance that it does not bring them, as kernels.likely takes them."""
    at = (F.array_position(F.array(*map(F.lit, groups.names)).cast("array<string>"), F.col("gk")) - 1).cast("int")
    log = F.log1p(-F.least(F.col("q"), F.lit(NEARLY_ONE)))
    return q.select("code3", at.alias("g"), log.alias("t")).filter("g >= 0").groupBy("code3").agg(F.collect_list(F.struct("g", "t")).alias("chances"))


def with_q(prefs: DataFrame, q: DataFrame) -> DataFrame:
    """enc_id, gk, q of each prefix."""
    return prefs.join(q, prefs["pref"] == q["code3"]).select("enc_id", "gk", "q")


def with_q_by_age(prefs: DataFrame, encounters: DataFrame, q: DataFrame, q_aged: DataFrame, bands: list[str]) -> DataFrame:
    """As with_q, by the encounter's age band; all ages where the age is unusable or its band is not in bands."""
    band = age_band(F.col("age").cast("double"))
    banded = encounters.select("enc_id", F.when(band.isin([b for b in AGE_LABELS if b in bands]), band).otherwise(ANY_AGE).alias("bin"))
    tables = q_aged.select("code3", F.col("age_bin").alias("bin"), "gk", "q").unionByName(q.select("code3", F.lit(ANY_AGE).alias("bin"), "gk", "q"))
    hit = prefs.withColumnRenamed("pref", "code3").join(banded, "enc_id").join(tables, ["code3", "bin"])
    return hit.select("enc_id", "gk", "q")
