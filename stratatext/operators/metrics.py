"""Request logs: latency, usage, jobs, traces, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V
from ..session import stored
from .scan import range_bounds, range_of


def exact_percentiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float], ranges: int = 64) -> DataFrame:
    """Linear-interpolated percentiles per group, one column per share.

    Values are first counted per (group, value), so nothing but distinct values
    moves; ranks come from a two-step prefix sum over value ranges.  A group with
    a third of all rows is therefore spread like any other, unlike with an
    aggregate that gathers the group's values in one place.
    """
    bounds = range_bounds(df, value, ranges)
    counts = stored(
        df.groupBy(*group, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c")).withColumn("r", range_of(F.col("v"), bounds)),
        "value-counts",
    )
    per_range = counts.groupBy(*group, "r").agg(F.sum("c").alias("rc"))
    ahead = Window.partitionBy(*group).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(*group, "r", F.coalesce(F.sum("rc").over(ahead), F.lit(0)).alias("ro"))
    sizes = per_range.groupBy(*group).agg(F.sum("rc").alias("n"))
    inner = Window.partitionBy(*group, "r").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("lo", F.coalesce(F.sum("c").over(inner), F.lit(0))).join(offsets, [*group, "r"]).withColumn("lo", F.col("lo") + F.col("ro"))
    if group:
        placed = placed.join(sizes, group)
    else:
        placed = placed.withColumn("n", sizes.scalar())
    picks = []
    for name, share in shares.items():
        at = (F.col("n") - 1) * F.lit(share)
        low = F.floor(at)
        high = F.least(low + 1, F.col("n") - 1)
        has = lambda k: (F.col("lo") <= k) & (k < F.col("lo") + F.col("c"))
        picks += [
            F.max(F.when(has(low), F.col("v"))).alias(f"__{name}_l"),
            F.max(F.when(has(high), F.col("v"))).alias(f"__{name}_h"),
            F.max(at - low).alias(f"__{name}_f"),
        ]
    out = placed.groupBy(*group).agg(*picks)
    return out.select(
        *group,
        *[(F.col(f"__{n}_l") + F.col(f"__{n}_f") * (F.col(f"__{n}_h") - F.col(f"__{n}_l"))).alias(n) for n in shares],
    )


PERCENTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def in_window(requests: DataFrame, window_seconds: float, as_of: Column) -> DataFrame:
    """Rows of the trailing window that ends at ``as_of`` (epoch seconds)."""
    return requests.filter(F.col("timestamp") >= as_of - F.lit(window_seconds))


def latency_stats(requests: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, error rate and latency per group; a status under 400 is a success."""
    by = by or []
    basic = requests.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status_code") < 400).alias("success_count"),
        F.round(F.avg("duration_ms"), 2).alias("mean"), F.round(F.min("duration_ms"), 2).alias("min"), F.round(F.max("duration_ms"), 2).alias("max"),
    ).withColumn("error_count", F.col("total") - F.col("success_count")).withColumn("error_rate", F.round(F.col("error_count") / F.col("total"), 4))
    pct = exact_percentiles(requests, by, "duration_ms", PERCENTILES)
    pct = pct.select(*by, *[F.round(p, 2).alias(p) for p in PERCENTILES])
    if by:
        return basic.join(pct, by)
    for p in PERCENTILES:
        basic = basic.withColumn(p, pct.select(p).scalar())
    return basic


def usage_rate(requests: DataFrame, window_seconds: float, uptime_seconds: float | None = None) -> DataFrame:
    minutes = min(uptime_seconds or window_seconds, window_seconds) / 60.0
    return requests.agg(F.count(F.lit(1)).alias("requests"), F.round(F.count(F.lit(1)) / minutes, 2).alias("requests_per_minute"))


def top_endpoints(requests: DataFrame, top: int = 10) -> DataFrame:
    return requests.groupBy("endpoint").agg(F.count(F.lit(1)).alias("requests")).orderBy(F.desc("requests"), "endpoint").limit(top)


def status_distribution(requests: DataFrame) -> DataFrame:
    return requests.groupBy("status_code").agg(F.count(F.lit(1)).alias("requests"))


def hourly_counts(requests: DataFrame, window_seconds: int, cutoff: Column) -> DataFrame:
    """Requests per hour since the cut-off; every hour of the window has a row."""
    hours = int(window_seconds // 3600)
    dim = requests.sparkSession.range(hours).select(F.col("id").cast("int").alias("hour"))
    per = requests.groupBy(F.floor((F.col("timestamp") - cutoff) / 3600).cast("int").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return dim.join(per, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("requests"))


def job_stats(jobs: DataFrame) -> DataFrame:
    """Generation jobs ``(content_type, success, duration_ms, file_count, asset_count)`` in one row."""
    return jobs.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("success").alias("success_count"), F.count_if(~F.col("success")).alias("failure_count"),
        F.round(F.count_if("success") / F.count(F.lit(1)), 4).alias("success_rate"), F.round(F.avg("duration_ms"), 2).alias("avg_duration_ms"),
        F.sum("file_count").alias("files"), F.sum("asset_count").alias("assets"),
    )


def type_distribution(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("content_type").agg(F.count(F.lit(1)).alias("jobs"))


def latest_state(log: DataFrame, key: str, order: list[str], newest: int | None = None) -> DataFrame:
    """Last row per key of an append log, newest keys first when limited.

    ``max_by`` combines before the shuffle, so a hot key sends one row per task.
    """
    rest = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s")).select(key, "s.*")
    return last.orderBy(*[F.desc(o) for o in order]).limit(newest) if newest else last


def trace_rollup(steps: DataFrame) -> DataFrame:
    """(trace_id, elapsed_seconds, step_count) of a step log ``(trace_id, timestamp)``."""
    return steps.groupBy("trace_id").agg(
        F.round(F.max("timestamp") - F.min("timestamp"), 2).alias("elapsed_seconds"), F.count(F.lit(1)).alias("step_count")
    )


def hangul_chars(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, "[\\x{AC00}-\\x{D7A3}]", ""))


def tokens_by_share(text: Column) -> Column:
    """Two characters per token when over 30 % Hangul, else four."""
    n = F.length(text)
    return F.when(hangul_chars(text) > 0.3 * n, F.floor(n / 2)).otherwise(F.floor(n / 4)).cast("long")


def tokens_by_mix(text: Column) -> Column:
    """1.5 Hangul characters or four others per token."""
    k = hangul_chars(text)
    return F.floor(k / 1.5 + (F.length(text) - k) / 4).cast("long")


def cost_by_model(usage: DataFrame, prices: list = V.PRICES, default: str = V.DEFAULT_PRICED_MODEL) -> DataFrame:
    """USD and KRW per model for ``(model, input_tokens, output_tokens)``; unknown models cost the default."""
    table = {m: (i, o) for m, i, o in prices}
    cost_in, cost_out = F.lit(table[default][0]), F.lit(table[default][1])
    for model, (i, o) in table.items():
        cost_in = F.when(F.col("model") == model, F.lit(i)).otherwise(cost_in)
        cost_out = F.when(F.col("model") == model, F.lit(o)).otherwise(cost_out)
    per = usage.groupBy("model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    usd = F.col("input_tokens") / 1000 * cost_in + F.col("output_tokens") / 1000 * cost_out
    return per.withColumn("usd", usd).withColumn("krw", F.floor(F.round(F.col("usd") * V.KRW_PER_USD, 6)).cast("long")).withColumn("usd", F.round("usd", 4))
