"""Beliefs over hypotheses, channels that inform them, and tasks that need them, as long tables; any number of spaces side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import clip


def normalise(log_mass: DataFrame, space: str = "space") -> DataFrame:
    """(space, h, p) from (space, h, log_mass): log-sum-exp per space by grouped maxima and sums. Null and NaN masses are impossible hypotheses; a space without a possible one abstains."""
    good = log_mass.filter(F.col("log_mass").isNotNull() & ~F.isnan("log_mass") & (F.col("log_mass") > float("-inf")))
    top = good.groupBy(space).agg(F.max("log_mass").alias("_m"))
    e = good.join(top, space).withColumn("_e", F.exp(F.col("log_mass") - F.col("_m")))
    return e.join(e.groupBy(space).agg(F.sum("_e").alias("_s")), space).select(space, "h", (F.col("_e") / F.col("_s")).alias("p"))


def predict(belief: DataFrame, channels: DataFrame) -> DataFrame:
    """(space, channel, y, p): outcome chances of each channel (space, channel, h, y, likelihood) under the belief (space, h, p)."""
    return channels.join(belief, ["space", "h"]).groupBy("space", "channel", "y").agg(F.sum(F.col("p") * F.col("likelihood")).alias("p"))


def posteriors(belief: DataFrame, channels: DataFrame) -> DataFrame:
    """(space, channel, y, h, p): the belief after every outcome that can occur."""
    joint = channels.join(belief, ["space", "h"]).withColumn("j", F.col("p") * F.col("likelihood")).drop("p")
    total = joint.groupBy("space", "channel", "y").agg(F.sum("j").alias("t")).filter("t > 0")
    return joint.join(total, ["space", "channel", "y"]).select("space", "channel", "y", "h", (F.col("j") / F.col("t")).alias("p"))


def observe(belief: DataFrame, channels: DataFrame, observed: DataFrame, used: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(belief, used) after outcomes (evidence_id, space, channel, y): each evidence id counts once ever, the rest of a space multiply; used (evidence_id) grows. An outcome of likelihood 0 under all hypotheses of a space leaves it out: it abstains."""
    new = observed.dropDuplicates(["evidence_id"]).join(used, "evidence_id", "left_anti")
    gain = new.join(channels, ["space", "channel", "y"]).groupBy("space", "h").agg(F.sum(F.when(F.col("likelihood") > 0, F.log("likelihood")).otherwise(F.lit(float("-inf")))).alias("g"))
    moved = belief.join(gain, ["space", "h"], "left").select("space", "h", (F.log(F.nullif("p", F.lit(0.0))) + F.coalesce("g", F.lit(0.0))).alias("log_mass"))
    return normalise(moved), used.unionByName(new.select("evidence_id"))


def risk(belief: DataFrame, tasks: DataFrame, keys: list[str], loss: str = "log") -> DataFrame:
    """(keys, task, risk) of tasks (space, task, h, q, y, readout, w): the weighted Bayes risk of predicting y of each query q from the belief (keys with space, h, p): `log` bits of entropy, `brier` or `error`."""
    mix = tasks.withColumnRenamed("y", "_answer").join(belief, ["space", "h"]).groupBy(*keys, "task", "q", "_answer").agg(F.sum(F.col("p") * F.col("readout")).alias("m"), F.max("w").alias("w"))
    per = mix.groupBy(*keys, "task", "q").agg(F.max("w").alias("w"), F.sum(F.when(F.col("m") > 0, -F.col("m") * F.log2("m")).otherwise(F.lit(0.0))).alias("log"), (1 - F.sum(F.col("m") * F.col("m"))).alias("brier"), (1 - F.max("m")).alias("error"))
    return per.groupBy(*keys, "task").agg(F.sum(F.col("w") * F.col(loss)).alias("risk"))


def value_of_channels(belief: DataFrame, channels: DataFrame, tasks: DataFrame, loss: str = "log") -> DataFrame:
    """(space, channel, task, risk_before, risk_after, gain): the expected drop of risk by one observation of each channel."""
    before = risk(belief, tasks, ["space"], loss).withColumnRenamed("risk", "risk_before")
    chance = predict(belief, channels).filter("p > 0").withColumnRenamed("p", "chance")
    after = risk(posteriors(belief, channels), tasks, ["space", "channel", "y"], loss).join(chance, ["space", "channel", "y"])
    mean = after.groupBy("space", "channel", "task").agg(F.sum(F.col("chance") * F.col("risk")).alias("risk_after"))
    return mean.join(before, ["space", "task"]).select("space", "channel", "task", "risk_before", "risk_after", (F.col("risk_before") - F.col("risk_after")).alias("gain"))


def prediction_distances(predictions: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, hellinger, fisher, js) of the asked pairs (a, b) of predictors with rows (id, q, y, p, w): squared Hellinger, squared Fisher and Jensen-Shannon distances, weighted over queries. Missing outcomes count as 0."""
    x = predictions.select(F.col("id").alias("a"), "q", "y", F.col("p").alias("pa"), "w")
    z = predictions.select(F.col("id").alias("b"), "q", "y", F.col("p").alias("pb"), F.col("w").alias("wb"))
    left = pairs.join(x, "a")
    right = pairs.join(z, "b")
    both = left.join(right, ["a", "b", "q", "y"], "full_outer").select("a", "b", "q", F.coalesce("pa", F.lit(0.0)).alias("pa"), F.coalesce("pb", F.lit(0.0)).alias("pb"), F.coalesce("w", "wb").alias("w"))
    half = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))
    m = (F.col("pa") + F.col("pb")) / 2
    per = both.groupBy("a", "b", "q").agg(F.max("w").alias("w"), F.sum(F.sqrt(F.col("pa") * F.col("pb"))).alias("c"), F.sum((half(F.col("pa"), m) + half(F.col("pb"), m)) / 2).alias("js"))
    c = clip(F.col("c"), 0.0, 1.0)
    return per.groupBy("a", "b").agg(F.sum(F.col("w") * (1 - c)).alias("hellinger"), F.sum(F.col("w") * F.pow(2 * F.acos(c), F.lit(2.0))).alias("fisher"), F.sum(F.col("w") * F.col("js")).alias("js"))
