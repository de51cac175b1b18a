"""State learned from executions: a log of (query_id, plan_id, seq, latency, is_error, day)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def execution_log(events: DataFrame) -> DataFrame:
    """The events table read as an execution log."""
    return events.select(F.col("user_id").alias("query_id"), F.col("event_type").alias("plan_id"), F.col("event_id").alias("seq"), F.col("value").alias("latency"), (F.col("event_type") == "error").alias("is_error"), F.to_date("ts").alias("day"))


def best_plans(log: DataFrame) -> DataFrame:
    """The fastest run of each (query, plan); the first one wins ties."""
    best = F.struct("latency", "seq")
    return log.where("not is_error and latency is not null").groupBy("query_id", "plan_id").agg(F.min(best).alias("b")).select("query_id", "plan_id", "b.latency", "b.seq")


def adaptive_timeouts(log: DataFrame, low: float = 1.0, high: float = 60.0) -> DataFrame:
    """Twice the last success of each query, within bounds."""
    return log.where("not is_error").groupBy("query_id").agg(F.max_by("latency", "seq").alias("last")).select("query_id", F.greatest(F.lit(low), F.least(2 * F.col("last"), F.lit(high))).alias("timeout"))


def ring_buffer(log: DataFrame, slots: int = 512) -> DataFrame:
    """What a ring of so many slots holds at last: for each slot the latest row."""
    return log.groupBy((F.col("seq") % slots).alias("slot")).agg(F.max("seq").alias("seq"), F.max_by("latency", "seq").alias("latency"))


def moving_average(log: DataFrame, decay: float = 0.9) -> DataFrame:
    """Exponential moving average of daily mean latencies: days are few, and are folded in order."""
    daily = log.where("not is_error").groupBy("day").agg(F.avg("latency").alias("m"))
    days = daily.agg(F.sort_array(F.collect_list(F.struct("day", "m"))).alias("days"))
    zero = F.lit(None).cast("double")
    return days.select(F.round(F.aggregate("days", zero, lambda acc, x: F.when(acc.isNull(), x["m"]).otherwise(decay * acc + (1 - decay) * x["m"])), 6).alias("ema"))


def latency_metrics(log: DataFrame, timeout: float = 60.0) -> DataFrame:
    """Failures count as the timeout."""
    t = log.select("is_error", F.when(F.col("is_error"), F.lit(timeout)).otherwise(F.col("latency")).alias("t"))
    return t.agg(F.count("*").alias("n"), F.round(F.avg("t"), 6).alias("mean_t"), *[F.round(F.percentile("t", F.lit(p / 100)), 6).alias(f"p{p}") for p in (50, 90, 99)], F.round(F.max("t"), 6).alias("max_t"), F.round(F.avg(F.col("is_error").cast("double")), 6).alias("error_rate"))


def z_scores(log: DataFrame) -> DataFrame:
    """Latencies standardised over all rows (population deviation): the two statistics are one row, joined to all."""
    stats = log.agg(F.avg("latency").alias("mean"), F.stddev_pop("latency").alias("std"))
    return log.crossJoin(F.broadcast(stats)).select("seq", F.round((F.col("latency") - F.col("mean")) / F.col("std"), 6).alias("z"))


def replay_priorities(log: DataFrame, alpha: float = 0.6, beta: float = 0.4) -> DataFrame:
    """Probability and normalised importance weight of each row, priority being its latency."""
    rows = log.where("latency > 0").select("seq", F.pow("latency", F.lit(alpha)).alias("a"))
    stats = rows.agg(F.sum("a").alias("total"), F.count("*").alias("n"), F.min("a").alias("least"))
    joined = rows.crossJoin(F.broadcast(stats))
    return joined.select("seq", F.round(F.col("a") / F.col("total"), 9).alias("prob"), F.round(F.pow(F.col("a") / F.col("least"), F.lit(-beta)), 6).alias("weight"))


def tail_risk(log: DataFrame, alpha: float = 0.9) -> DataFrame:
    """Mean of the worst max(1, floor((1 - alpha) n)) latencies of each query."""
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("latency"), "seq"))
    total = F.count("*").over(Window.partitionBy("query_id"))
    ranked = log.where("latency is not null").select("query_id", "latency", n.alias("n"), F.greatest(F.lit(1), F.floor((1 - alpha) * total)).alias("keep"))
    return ranked.where("n <= keep").groupBy("query_id").agg(F.round(F.avg("latency"), 6).alias("cvar"))


def ingested(log: DataFrame, timeout: float = 60.0) -> DataFrame:
    """What the learner reads of each run: log(1 + latency), the timeout for a failed run; the cost only of a run that succeeded."""
    failed = F.coalesce("is_error", F.lit(False))
    return log.select("seq", F.round(F.log1p(F.when(failed, F.lit(timeout)).otherwise(F.col("latency"))), 6).alias("log_latency"), F.when(~failed, F.round(F.log1p("latency"), 6)).alias("masked_cost"), (~failed).alias("valid"))


def timeouts_by_best(log: DataFrame, cap: float = 60.0) -> DataFrame:
    """Twice the fastest success of each query, at most the cap; the cap for a query that never succeeded."""
    return log.groupBy("query_id").agg(F.min(F.when(~F.col("is_error"), F.col("latency"))).alias("best")).select("query_id", F.least(F.coalesce(2 * F.col("best"), F.lit(cap)), F.lit(cap)).alias("timeout"))


def timeout_rewards(log: DataFrame, default: float = -20.0, below: float = 5.0) -> DataFrame:
    """What a run that times out is worth: the best reward (-log of 1 + latency) of its query less `below`, or a default."""
    return log.groupBy("query_id").agg(F.max(F.when(~F.col("is_error"), -F.log1p("latency"))).alias("best")).select("query_id", F.round(F.coalesce(F.col("best") - below, F.lit(default)), 6).alias("reward"))


def reward_memo(log: DataFrame) -> DataFrame:
    """The first positive cost of each (query, plan): later runs are answered from it."""
    cost = F.struct("seq", "latency")
    return log.where("not is_error and latency > 0").groupBy("query_id", "plan_id").agg(F.min(cost).alias("b")).select("query_id", "plan_id", F.col("b.latency").alias("cost"))


def _days(log: DataFrame, *stats) -> DataFrame:
    """One row with the statistics of each day with any success, in order: days are few."""
    daily = log.where("not is_error and latency is not null").groupBy("day").agg(*stats)
    return daily.agg(F.sort_array(F.collect_list(F.struct("day", *[c for c in daily.columns if c != "day"]))).alias("days"))


def moving_statistics(log: DataFrame, momentum: float = 0.1, least: float = 1e-8) -> DataFrame:
    """Moving mean and (unbiased) deviation over daily batches: the first sets them, failed runs are masked, a day without success changes nothing."""
    std = F.greatest(F.coalesce(F.stddev_samp("latency"), F.lit(0.0)), F.lit(least))
    days = _days(log, F.avg("latency").alias("m"), std.alias("d"))
    zero = F.struct(F.lit(None).cast("double").alias("m"), F.lit(None).cast("double").alias("d"))
    move = lambda acc, x, c: F.when(acc[c].isNull(), x[c]).otherwise((1 - momentum) * acc[c] + momentum * x[c]).alias(c)
    out = days.select(F.aggregate("days", zero, lambda acc, x: F.struct(move(acc, x, "m"), move(acc, x, "d"))).alias("s"))
    return out.select(F.round("s.m", 6).alias("mean"), F.round("s.d", 6).alias("std"))


def rescaled_head(log: DataFrame, beta: float = 0.1, least: float = 1e-4) -> DataFrame:
    """Moving mean and variance of targets over daily batches from (0, 1), and what a linear head (1, 0) becomes so that its outputs stay the same in the old scale."""
    days = _days(log, F.avg("latency").alias("m"), F.coalesce(F.var_pop("latency"), F.lit(0.0)).alias("v"))
    zero = F.struct(F.lit(0.0).alias("m"), F.lit(1.0).alias("v"), F.lit(1.0).alias("w"), F.lit(0.0).alias("b"))
    sigma = lambda v: F.greatest(F.sqrt(v), F.lit(least))

    def step(acc, x):
        m, v = (1 - beta) * acc["m"] + beta * x["m"], (1 - beta) * acc["v"] + beta * x["v"]
        old, new = sigma(acc["v"]), sigma(v)
        return F.struct(m.alias("m"), v.alias("v"), (acc["w"] * old / new).alias("w"), ((old * acc["b"] + acc["m"] - m) / new).alias("b"))

    out = days.select(F.aggregate("days", zero, step).alias("s"))
    return out.select(*[F.round(f"s.{c}", 6).alias(n) for c, n in (("m", "mean"), ("v", "variance"), ("w", "weight"), ("b", "bias"))])


def blend_weight(log: DataFrame, decay: float = 0.9, least: float = 1e-6) -> DataFrame:
    """Moving variances of cost (here log latency) and of latency over daily batches, and cost variance by latency variance, the weight of the former."""
    days = _days(log, F.coalesce(F.var_pop(F.log1p("latency")), F.lit(0.0)).alias("c"), F.coalesce(F.var_pop("latency"), F.lit(least)).alias("l"))
    zero = F.struct(F.lit(None).cast("double").alias("c"), F.lit(None).cast("double").alias("l"))
    move = lambda acc, x, k: F.when(acc[k].isNull(), x[k]).otherwise(decay * acc[k] + (1 - decay) * x[k]).alias(k)
    out = days.select(F.aggregate("days", zero, lambda acc, x: F.struct(move(acc, x, "c"), move(acc, x, "l"))).alias("s"))
    return out.select(F.round("s.c", 6).alias("cost_var"), F.round("s.l", 6).alias("latency_var"), F.round(F.col("s.c") / F.greatest("s.l", F.lit(least)), 9).alias("weight"))


def calibration(samples: DataFrame, levels: int = 10) -> DataFrame:
    """(level, share): of rows (actual, draws array<double>), the share whose actual value lies at or below that quantile of their draws."""
    p = samples.select((F.size(F.filter("draws", lambda d: d <= F.col("actual"))) / F.size("draws")).alias("p"))
    return p.select("p", F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("i")).groupBy("i").agg(F.round(F.avg((F.col("p") <= F.col("i") / levels).cast("double")), 6).alias("share")).select((F.col("i") / levels).alias("level"), "share")


def sharpness(samples: DataFrame) -> DataFrame:
    """Mean (unbiased) variance of the draws of a row, of rows with two draws or more."""
    mean = F.aggregate("draws", F.lit(0.0), lambda a, d: a + d) / F.size("draws")
    rows = samples.where(F.size("draws") > 1).withColumn("mean", mean)
    var = F.aggregate("draws", F.lit(0.0), lambda a, d: a + (d - F.col("mean")) * (d - F.col("mean"))) / (F.size("draws") - 1)
    return rows.agg(F.round(F.avg(var), 6).alias("sharpness"))


def joint_likelihood(rows: DataFrame, size: int = 10, sigma: float = 1.0) -> DataFrame:
    """(nll): joint negative log-likelihood of rows (seq, z, actual, predicted), in chunks of `size` consecutive seq, as the mean over index samples z, per chunk, averaged."""
    log = -0.5 * F.pow((F.col("actual") - F.col("predicted")) / sigma, F.lit(2.0)) - F.log(F.lit(sigma)) - 0.5 * F.log(F.lit(2 * 3.141592653589793))
    sums = rows.groupBy(F.floor(F.col("seq") / size).alias("chunk"), "z").agg(F.sum(log).alias("s"))
    top = sums.groupBy("chunk").agg(F.max("s").alias("top"))
    each = sums.join(top, "chunk").groupBy("chunk", "top").agg(F.avg(F.exp(F.col("s") - F.col("top"))).alias("mean"))
    return each.agg(F.round(F.avg(-(F.col("top") + F.log("mean"))), 6).alias("nll"))


def best_epochs(history: DataFrame, smaller_is_better: bool = True) -> DataFrame:
    """(metric, epoch, value): the best value of each metric of (metric, epoch, value); the later epoch wins ties."""
    value = -F.col("value") if smaller_is_better else F.col("value")
    return history.groupBy("metric").agg(F.max(F.struct(value.alias("v"), "epoch", "value")).alias("b")).select("metric", "b.epoch", "b.value")


def relative_errors(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Mean absolute percentage error (rows with an actual value other than 0), mean squared error, and it over valid rows only."""
    off = F.col(actual) - F.col(predicted)
    return rows.agg(F.round(F.avg(F.when(F.col(actual) != 0, F.abs(off / F.col(actual)))) * 100, 6).alias("mape"), F.round(F.avg(off * off), 6).alias("mse"), F.round(F.avg(F.when(F.col("valid"), off * off)), 6).alias("masked_mse"))


def executed_cost(rows: Column) -> Column:
    """Of the rows of the first scan and of each join: -sum of log(1 + x) over all but the last."""
    return F.aggregate(F.slice(rows, F.lit(1), F.greatest(F.size(rows) - 1, F.lit(0))), F.lit(0.0), lambda a, x: a - F.log1p(x.cast("double")))


def latency_reward(seconds: Column, done: Column) -> Column:
    """Minus the seconds of a complete plan; 0 for a part."""
    return F.when(done, -seconds).otherwise(F.lit(0.0))


def penalised(values: Column, mean: Column, risk: float = 1.0) -> Column:
    """A cost with its spread: mean + risk * population variance of the draws."""
    return mean + risk * F.aggregate(values, F.lit(0.0), lambda a, d: a + (d - mean) * (d - mean)) / F.size(values)
