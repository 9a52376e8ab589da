"""Scores of random completions: multiple imputation (S3) and its Bayesian variant (S4).

A draw is a hash of (seed, stage, encounter, prefix, draw), so it depends on nothing else: not on partitions, order,
retries or other encounters. The draw axis is data, not a loop. A fresh Dirichlet vector that serves one categorical
draw makes that draw categorical with the mean probabilities, so S4 differs from S3 in its weights alone.

Weights are unnormalised, so that running sums are exact for whole frequencies. A prefix's donors are one row, in which each draw finds
its donor by binary search: draws neither meet donors they do not pick, nor does a draw need a join of its own. Where a draw goes beyond a
donor is kept as the hash at which it does (bar, as hex digits; cut, as a number). Hashing, search, unions and scores of all draws of an
encounter are one kernel (kernels.py); draws become rows only where rows of draws are asked for. Estimates take one exchange of the diagnoses by
encounter, after which the kernel gets whole encounters (visited).

A prefix with one donor needs no hash. For scores, neither does one whose donors all have the same groups (outcomes): such prefixes
add to what all draws of an encounter have in common (cohort_masks). An encounter then has n draws where some prefix is open, else
one that stands for all; scores and rates are shares of the draws that an encounter has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from charlspark.operators import kernels
from charlspark.operators.scoring import WORD, Groups
from charlspark.sources.staging import staged


def observed(probs: DataFrame) -> DataFrame:
    """pref, code, freq, total, bare: the children with prob > 0 of each prefix."""
    own = probs.filter("prob > 0").select(F.col("code3").alias("pref"), F.col("code_nodot").alias("code"), F.col("freq_total").alias("freq"))
    return own.withColumn("total", F.sum("freq").over(Window.partitionBy("pref"))).withColumn("bare", F.lit(False))


def donors(prefs: DataFrame, probs: DataFrame) -> DataFrame:
    """As observed, for each prefix that occurs; the bare prefix where it has no such children."""
    out = prefs.select("pref").distinct().join(observed(probs), "pref", "left")
    one = F.lit(1.0)
    return out.select("pref", F.coalesce("code", "pref").alias("code"), F.coalesce("freq", one).alias("freq"), F.coalesce("total", one).alias("total"), F.col("bare").isNull().alias("bare"))


def s3_weights(pool: DataFrame) -> DataFrame:
    """pref, code, weight: as frequent as observed."""
    return pool.select("pref", "code", F.col("freq").alias("weight"))


def s4_weights(pool: DataFrame, alpha_0: float) -> DataFrame:
    """pref, code, weight, alpha: alpha is alpha_0 * prob + 0.5, and 1 for a bare prefix; weight is alpha times the total."""
    weight = F.when(F.col("bare"), 1.0).otherwise(F.lit(float(alpha_0)) * F.col("freq") + F.lit(0.5) * F.col("total"))
    return pool.select("pref", "code", weight.alias("weight"), F.when(F.col("bare"), 1.0).otherwise(weight / F.col("total")).alias("alpha"))


#: Hashes are whole numbers below it: their first 13 hex digits.
SPAN = float(1 << 52)


def head(stage: str, seed: int) -> Column:
    """What the hashed text of a draw begins with; its number follows."""
    bar = F.lit("|")
    return F.concat(F.lit(f"{seed}|{stage}|"), F.col("enc_id").cast("string"), bar, F.col("pref"), bar)


def cuts(bars: Column) -> Column:
    """Bars as numbers; hashes stay below the number of "g". For the pool's few rows, not for draws."""
    return F.transform(bars, lambda b: F.when(b == "g", F.lit(int(SPAN))).otherwise(F.conv(b, 16, 10).cast("long")))


def bar(upto: Column, total: Column) -> Column:
    """The smallest hash h with h / SPAN * total >= upto, in doubles, as hex digits; "g", which is beyond all hashes, if there is none.

    The product grows with h, and the quotient is off by less than 3 from where it passes upto."""
    near = F.ceil(F.least(F.greatest(F.nanvl(F.coalesce(F.try_divide(upto, total), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(2.0)) * SPAN).cast("long")
    tried = F.transform(F.sequence(F.lit(-8), F.lit(8)), lambda i: F.greatest(near + i, F.lit(0)))
    first = F.get(F.filter(tried, lambda h: h.cast("double") / SPAN * total >= upto), 0)
    return F.when(first < int(SPAN), F.lpad(F.lower(F.hex(first)), 13, "0")).otherwise(F.lit("g"))


def pools(weights: DataFrame) -> DataFrame:
    """weights as one row for each prefix: pref, donors (code, upto, the running sum of the weights by code, and the other columns, in that
    order), bars (of each donor but the last, the hash at which draws go beyond it)."""
    upto = F.sum("weight").over(Window.partitionBy("pref").orderBy("code").rowsBetween(Window.unboundedPreceding, 0))
    rest = [c for c in weights.columns if c not in ("pref", "weight", "code")]
    rows = weights.withColumn("upto", upto).groupBy("pref").agg(F.array_sort(F.collect_list(F.struct("code", "upto", *rest))).alias("donors"))
    total = F.get("donors", F.size("donors") - 1)["upto"]
    return rows.select("pref", "donors", F.transform(F.slice("donors", F.lit(1), F.size("donors") - 1), lambda x: bar(x["upto"], total)).alias("bars"))


def place(df: DataFrame, most: int) -> DataFrame:
    """df with place: the first of upto beyond u times its last, or the last; upto has most elements at most. A binary search, a step
    to a projection."""
    steps = 0
    while (1 << steps) <= most:
        steps += 1
    df = df.withColumn("at", F.col("u") * F.get("upto", F.size("upto") - 1)).withColumn("place", F.lit(0))
    for k in reversed(range(steps)):
        beyond = F.col("place") + (1 << k)
        df = df.withColumn("place", F.when((beyond <= F.size("upto")) & (F.get("upto", beyond - 1) <= F.col("at")), beyond).otherwise(F.col("place")))
    return df.withColumn("place", F.least("place", F.size("upto") - 1)).drop("at")


def draws(prefs: DataFrame, weights: DataFrame, stage: str, n: int, seed: int = 42) -> DataFrame:
    """The columns of prefs, draw and the columns of weights of the donor picked: each encounter, prefix and draw gets one;
    a prefix without donors gets itself, with null for the other columns."""
    return drawn(prefs, staged(pools(weights)), stage, n, seed)


def drawn(prefs: DataFrame, pool: DataFrame, stage: str, n: int, seed: int = 42) -> DataFrame:
    """As draws, from the rows of pools, of which the left join meets one for each prefix."""
    rest = [f for f in pool.schema["donors"].dataType.elementType.names if f not in ("code", "upto")]
    own = pool.select(F.col("pref").alias("of"), F.transform("donors", lambda x: F.struct(x["code"].alias("code"), *[x[c].alias(c) for c in rest])).alias("donors"), cuts(F.col("bars")).alias("cuts"))
    met = prefs.join(own, F.col("pref") == F.col("of"), "left").drop("of")
    pick = F.arrow_udf(kernels.picker(least_one(n)), "array<int>")
    met = met.withColumn("places", pick(F.when(F.size("cuts") > 0, head(stage, seed)), F.col("cuts")))
    met = met.select(*prefs.columns, "donors", F.posexplode(F.coalesce("places", F.array_repeat(F.lit(0), n))).alias("draw", "place"))
    one = F.get("donors", F.col("place"))
    return met.select(*prefs.columns, (F.col("draw") + 1).alias("draw"), F.coalesce(one["code"], F.col("pref")).alias("code"), *[one[c].alias(c) for c in rest])


def outcomes(pool: DataFrame, groups: Groups) -> DataFrame:
    """pref, masks, bars: the rows of pools by what their donors bring. Neighbours with the same mask become one, so a prefix has one
    outcome if all its donors have the same groups."""
    words, by = groups.columns(), Window.partitionBy("pref").orderBy("i")
    each = pool.select("pref", "bars", F.posexplode("donors").alias("i", "d"))
    each = each.select("pref", "i", F.get("bars", "i").alias("bar"), *[F.coalesce(F.col("d")[c], F.lit(0).cast("long")).alias(c) for c in words])
    same = F.struct(*words).eqNullSafe(F.lead(F.struct(*words)).over(by))
    rows = each.withColumn("same", same).filter("NOT same").groupBy("pref").agg(F.array_sort(F.collect_list(F.struct("i", "bar", *words))).alias("d"))
    masks = F.transform("d", lambda x: F.struct(*[x[c].alias(c) for c in words]))
    return rows.select("pref", masks.alias("masks"), F.slice(F.transform("d", lambda x: x["bar"]), F.lit(1), F.size("d") - 1).alias("bars"))


def met(prefs: DataFrame, own: DataFrame, groups: Groups, stage: str, seed: int = 42, bare: str = "mask") -> DataFrame:
    """prefs (enc_id, pref and the words of the bare prefix's mask, named bare) with, of its outcomes, the words that all draws have, named
    by the stage, and open_<stage>: begin, cuts and masks where draws differ, else null. A prefix without donors has its own mask."""
    own = own.select(F.col("pref").alias("of"), F.col("masks").alias("__masks"), cuts(F.col("bars")).alias("__cuts"))
    rows = prefs.join(own, prefs["pref"] == F.col("of"), "left")
    is_open, one = F.coalesce(F.size("__cuts") > 0, F.lit(False)), F.get("__masks", F.lit(0))
    fixed = {s: F.when(is_open, F.lit(0).cast("long")).otherwise(F.coalesce(one[c], b, F.lit(0).cast("long"))) for s, c, b in zip(groups.columns(stage), groups.columns(), groups.mask(bare))}
    differ = F.when(is_open, F.struct(head(stage, seed).alias("begin"), F.col("__cuts").alias("cuts"), F.col("__masks").alias("masks")))
    return rows.withColumns(fixed | {f"open_{stage}": differ}).drop("of", "__masks", "__cuts")


def opened(prefs: DataFrame, own: DataFrame, groups: Groups, stage: str, seed: int = 42) -> DataFrame:
    """A row for each encounter: the words that all its draws have, named by the stage, and open, its open prefixes. prefs as in met."""
    return met(prefs, own, groups, stage, seed).groupBy("enc_id").agg(*groups.ored(stage), F.collect_list(f"open_{stage}").alias("open"))


def cohort_masks(prefs: DataFrame, own: DataFrame, groups: Groups, stage: str, n: int, seed: int = 42) -> DataFrame:
    """As draw_masks, from outcomes: n rows of an encounter with an open prefix and one of any other."""
    words = groups.columns()
    unite = F.arrow_udf(kernels.uniter(least_one(n), words), f"array<struct<{', '.join(f'{c}:bigint' for c in words)}>>")
    rows = opened(prefs, own, groups, stage, seed)
    rows = rows.select("enc_id", F.posexplode(unite("open", *groups.columns(stage))).alias("draw", "x"))
    return rows.select("enc_id", (F.col("draw") + 1).alias("draw"), *[F.col("x")[c].alias(c) for c in words])


def shared(own: DataFrame, groups: Groups, stage: str) -> DataFrame:
    """From outcomes a row for each prefix: pref, the words that all its draws have, named by the stage, and open_<stage>: where draws differ, its
    cuts followed by the masks of its outcomes (a word of all, then the next), else null."""
    is_open, zero = F.size("bars") > 0, F.lit(0).cast("long")
    fixed = [F.when(is_open, zero).otherwise(F.coalesce(F.get("masks", F.lit(0))[c], zero)).alias(s) for s, c in zip(groups.columns(stage), groups.columns())]
    masks = [F.col("masks").getField(c) for c in groups.columns()]
    return own.select("pref", *fixed, F.when(is_open, F.concat(cuts(F.col("bars")), *masks)).alias(f"open_{stage}"))


def visited(encounters: DataFrame, rows: DataFrame, profile: DataFrame, small: bool, groups: Groups, parts: int, stages: Sequence[tuple[str, int, str]], kinds: Sequence[str] = (), chances: bool = False, seed: int = 42) -> DataFrame:
    """enc_id and an estimate named by each stage (name, number of draws, "mean" or "median"), for every encounter; with kinds also the words of the unions of
    these masks, with chances also expected, the expected score.

    rows: enc_id, pref, masks of kinds and, if there are any, mask, what patterns shorter than prefixes bring; profile: what is known of a prefix, as made by shared, bare, what
    other patterns bring to the bare prefix, other masks of kinds and chances; small if all tasks can hold it. Encounters and rows meet in one exchange; sorted, they pass through one kernel, so nothing is
    collected, joined or aggregated by encounter. Rows of no encounter are left out; rows may repeat. For slim_rows."""
    own = [c for k in kinds for c in groups.columns(k)]
    held = rows.filter("enc_id IS NOT NULL").withColumn("listed", F.lit(False))
    both = encounters.select("enc_id", F.lit(True).alias("listed")).unionByName(held, allowMissingColumns=True)
    by = lambda df: df.repartition(parts, "enc_id")
    known = (F.broadcast(profile) if small else profile).withColumnRenamed("pref", "of")
    meet = lambda df: df.join(known, df["pref"] == F.col("of"), "left").drop("of")
    met = meet(by(both)) if small else by(meet(both))
    zero = F.lit(0).cast("long")
    bare = [F.coalesce(b, zero).bitwiseOR(F.coalesce(m, zero)) if m in rows.columns else F.col(b) for b, m in zip(groups.columns("bare"), groups.columns())]
    fixed = {s: F.coalesce(s, b) for stage, _, _ in stages for s, b in zip(groups.columns(stage), bare)}
    is_open = F.coalesce(*[F.col(f"open_{stage}") for stage, _, _ in stages]).isNotNull()
    who = F.when(is_open, F.concat(F.col("enc_id").cast("string"), F.lit("|"), F.col("pref"), F.lit("|")))
    met = met.withColumns(fixed | {"who": who}).select("enc_id", "pref", "listed", "who", *own, *fixed, *[f"open_{s}" for s, _, _ in stages], *(["chances"] if chances else []))
    names = [met.schema["enc_id"]] + [StructField(c, LongType()) for c in own] + [StructField(c, DoubleType()) for c in [s for s, _, _ in stages] + (["expected"] if chances else [])]
    todo = [(s, f"{seed}|{s}|", least_one(n), use, groups.columns(s)) for s, n, use in stages]
    run = kernels.estimator({k: groups.columns(k) for k in kinds}, todo, (groups.suppressed(), groups.weighed()), (groups.weights, groups.parents) if chances else None, to_arrow_schema(StructType(names)))
    return met.sortWithinPartitions("enc_id").mapInArrow(run, StructType(names))


def least_one(n: int) -> int:
    if n < 1:
        raise ValueError("at least one draw is needed")
    return n


def draw_masks(drawn: DataFrame) -> DataFrame:
    """enc_id, draw, mask (0 where no code of the draw has a group). drawn carries the mask of each donor."""
    words = [c for c in drawn.columns if c.startswith("mask")]
    return drawn.groupBy("enc_id", "draw").agg(*[F.bit_or(F.coalesce(c, F.lit(0).cast("long"))).alias(c) for c in words])


def draw_scores(masks: DataFrame, groups: Groups) -> DataFrame:
    return groups.score_of(masks, "cci").select("enc_id", "draw", F.col("cci").cast("int").alias("cci"))


def mean_score(encounters: DataFrame, scores: DataFrame, n: int, name: str) -> DataFrame:
    own = scores.groupBy("enc_id").agg((F.sum("cci") / F.count("cci")).alias("m"))
    return encounters.select("enc_id").join(own, "enc_id", "left").select("enc_id", F.coalesce("m", F.lit(0.0)).alias(name))


def median_score(encounters: DataFrame, scores: DataFrame, n: int, name: str) -> DataFrame:
    """The exact median; with an even number the mean of the middle two. Every encounter with a prefix has all n draws, or one that stands for them.

    Counted, not sorted: draws become a histogram of the few scores that occur, and the middle ones are the first at which
    its running count reaches half."""
    histogram = scores.groupBy("enc_id", "cci").agg(F.count("*").alias("times"))
    upto = F.sum("times").over(Window.partitionBy("enc_id").orderBy("cci").rowsBetween(Window.unboundedPreceding, 0))
    all_of = F.sum("times").over(Window.partitionBy("enc_id"))
    middle = lambda twice: F.min(F.when(2 * F.col("upto") >= F.col("of") + twice, F.col("cci")))
    own = histogram.withColumns({"upto": upto, "of": all_of}).groupBy("enc_id").agg(((middle(0) + middle(1)) / 2).alias("m"))
    return encounters.select("enc_id").join(own, "enc_id", "left").select("enc_id", F.coalesce("m", F.lit(0.0)).alias(name))


def group_rate(masks: DataFrame, groups: Groups, n: int) -> DataFrame:
    """enc_id, gk, p_counted: the share of an encounter's draws (n at most) in which the group counts, after suppression.

    Every lane of a few bits of a long counts one group, so draws are added up word by word; groups are named once for each
    encounter and not for each draw."""
    lane = next(b for b in (8, 16, 32) if n < 1 << (b - 1))
    ones = sum(1 << k for k in range(0, 64, lane))
    counted = masks.withColumns(dict(zip(groups.columns(), groups.counted(groups.mask()))))
    name = lambda w, i: f"lanes{w}_{i}"
    words = range(len(groups.columns()))
    sums = [F.sum(F.shiftrightunsigned(groups.mask()[w], i).bitwiseAND(F.lit(ones).cast("long"))).alias(name(w, i)) for w in words for i in range(lane)]
    added = counted.groupBy("enc_id").agg(*sums, F.count("*").alias("of"))

    def count(g: int) -> Column:
        w, bit = divmod(g, WORD)
        return F.shiftrightunsigned(name(w, bit % lane), bit - bit % lane).bitwiseAND(F.lit((1 << lane) - 1).cast("long"))

    each = F.array(*[F.struct(F.lit(g).alias("gk"), count(i).alias("times")) for i, g in enumerate(groups.names)])
    some = added.select("enc_id", "of", F.explode(F.filter(each, lambda x: x["times"] > 0)).alias("x"))
    return some.select("enc_id", "x.gk", (F.col("x.times") / F.col("of")).alias("p_counted"))
