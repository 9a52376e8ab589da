"""What a prefix says about groups, from reference frequencies and a map."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def subcode_probs(freq: DataFrame) -> DataFrame:
    """code3, code_nodot, freq_total, prob within the prefix (0 where the prefix has none), n_children."""
    w = Window.partitionBy("code3")
    total = F.sum("freq_total").over(w)
    prob = F.when(total > 0, F.col("freq_total") / total).otherwise(F.when(F.col("freq_total").isNotNull(), 0.0))
    return freq.select("code3", "code_nodot", "freq_total", prob.alias("prob"), F.count("*").over(w).alias("n_children"))


def subcode_probs_by_age(aged: DataFrame) -> DataFrame:
    """code3, code_nodot, age_bin, prob within prefix and band; all 0 where the band has none."""
    total = F.sum("freq").over(Window.partitionBy("code3", "age_bin"))
    return aged.select("code3", "code_nodot", "age_bin", F.when(total > 0, F.col("freq") / total).otherwise(0.0).alias("prob"))


def prefix_group_status(probs: DataFrame, child_groups: DataFrame) -> DataFrame:
    """code3, gk, status: certain if every child is in the group, possible if some are."""
    hit = probs.join(child_groups.withColumnRenamed("code", "code_nodot"), "code_nodot")
    per = hit.groupBy("code3", "gk").agg(F.countDistinct("code_nodot").alias("n"), F.max("n_children").alias("of"))
    return per.select("code3", "gk", F.when(F.col("n") == F.col("of"), "certain").otherwise("possible").alias("status"))


def prefix_group_prob(probs: DataFrame, child_groups: DataFrame, keys: list[str]) -> DataFrame:
    """keys, gk, q: the probability that a child in the group stands behind the prefix; q > 0 only."""
    hit = probs.join(child_groups.withColumnRenamed("code", "code_nodot"), "code_nodot")
    return hit.groupBy(*keys, "gk").agg(F.sum("prob").alias("q")).filter("q > 0")
