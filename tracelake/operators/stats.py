"""Robust and classical statistics by group; percentiles are exact and linear."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sigma_bands(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """n, mean, mean_abs, std (population), rms, p68, p95, p997 of the absolute value, max_abs; nulls are left out."""
    x = F.col(col)
    return df.where(x.isNotNull()).groupBy(*by).agg(
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.avg(F.abs(x)).alias("mean_abs"),
        F.stddev_pop(x).alias("std"),
        F.sqrt(F.avg(x * x)).alias("rms"),
        F.percentile(F.abs(x), F.lit(0.6827)).alias("p68"),
        F.percentile(F.abs(x), F.lit(0.9545)).alias("p95"),
        F.percentile(F.abs(x), F.lit(0.9973)).alias("p997"),
        F.max(F.abs(x)).alias("max_abs"),
    )


def metric_bands(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """sigma_bands of several columns, one row for each."""
    long = df.unpivot(by, cols, "metric", "value")
    return sigma_bands(long, "value", [*by, "metric"])


def robust(df: DataFrame, col: str, by: str) -> DataFrame:
    """median, mad, 1.4826 mad, rms within the 5 to 95 % band, and the share (%) beyond three robust sigmas."""
    w = Window.partitionBy(by)
    rows = df.where(F.col(col).isNotNull()).withColumn("__m", F.median(col).over(w))
    rows = rows.withColumn("__d", F.abs(F.col(col) - F.col("__m")))
    rows = rows.withColumns({"__mad": F.median("__d").over(w), "__p5": F.percentile(col, F.lit(0.05)).over(w), "__p95": F.percentile(col, F.lit(0.95)).over(w)})
    inside = F.col(col).between(F.col("__p5"), F.col("__p95"))
    return rows.groupBy(by).agg(
        F.first("__m").alias("median"),
        F.first("__mad").alias("mad"),
        (1.4826 * F.first("__mad")).alias("robust_sigma"),
        F.sqrt(F.avg(F.when(inside, F.col(col) * F.col(col)))).alias("trimmed_rms"),
        (100.0 * F.avg((F.col("__d") > 3 * 1.4826 * F.col("__mad")).cast("int"))).alias("beyond_pct"),
    )


def shape(df: DataFrame, col: str, by: str) -> DataFrame:
    """Population skewness and excess kurtosis."""
    return df.groupBy(by).agg(F.count(col).alias("n"), F.skewness(col).alias("skew"), F.kurtosis(col).alias("kurtosis"))


def autocorrelation(df: DataFrame, col: str, lags: int, by: str, t: str) -> DataFrame:
    """Autocorrelation at lags 0 to lags about the group's mean."""
    w = Window.partitionBy(by)
    rows = df.withColumn("__c", F.col(col) - F.avg(col).over(w))
    order = Window.partitionBy(by).orderBy(t)
    rows = rows.withColumns({f"__l{k}": F.col("__c") * F.lead("__c", k).over(order) for k in range(lags + 1)})
    sums = rows.groupBy(by).agg(*[F.sum(f"__l{k}").alias(f"l{k}") for k in range(lags + 1)])
    long = sums.select(by, F.col("l0").alias("__v"), F.posexplode(F.array(*[F.col(f"l{k}") for k in range(lags + 1)])).alias("lag", "__s"))
    return long.select(by, "lag", F.try_divide(F.coalesce("__s", F.lit(0.0)), "__v").alias("acf"))


def circular(df: DataFrame, col: str, by: str) -> DataFrame:
    """Circular mean and standard deviation in degrees, resultant length, and Rayleigh's p."""
    sums = df.where(F.col(col).isNotNull()).groupBy(by).agg(F.count(col).alias("n"), F.avg(F.cos(F.radians(col))).alias("c"), F.avg(F.sin(F.radians(col))).alias("s"))
    r = F.sqrt(F.col("c") ** 2 + F.col("s") ** 2)
    return sums.select(by, "n", F.pmod(F.degrees(F.atan2("s", "c")), F.lit(360.0)).alias("mean_deg"), F.degrees(F.sqrt(-2.0 * F.log(F.greatest(r, F.lit(1e-12))))).alias("std_deg"), r.alias("r"), F.exp(-F.col("n") * r * r).alias("rayleigh_p"))


def ellipse(df: DataFrame, e: str, n: str, by: str) -> DataFrame:
    """Axes, orientation and 95 % area of the covariance ellipse."""
    m = df.groupBy(by).agg(F.var_samp(e).alias("a"), F.var_samp(n).alias("c"), F.covar_samp(e, n).alias("b"))
    half, root = (F.col("a") + F.col("c")) / 2, F.sqrt(((F.col("a") - F.col("c")) / 2) ** 2 + F.col("b") ** 2)
    major, minor = F.sqrt(half + root), F.sqrt(F.greatest(half - root, F.lit(0.0)))
    return m.select(by, major.alias("major"), minor.alias("minor"), F.degrees(F.atan2(2 * F.col("b"), F.col("a") - F.col("c")) / 2).alias("angle_deg"), (5.991464547107979 * 3.141592653589793 * major * minor).alias("area95"))


def line_fit(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """Slope, intercept and correlation; null below three points or without spread."""
    ok = (F.count(F.lit(1)) >= 3) & (F.stddev_pop(x) > 1e-9)
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(by).agg(F.when(ok, F.regr_slope(y, x)).alias("slope"), F.when(ok, F.regr_intercept(y, x)).alias("intercept"), F.when(ok & (F.stddev_pop(y) > 1e-9), F.corr(x, y)).alias("r"))


def lagged_correlation(df: DataFrame, a: str, b: str, max_lag: int, by: str, t: str) -> DataFrame:
    """The lag in rows, up to max_lag either way, with the largest correlation of a(i) and b(i + lag)."""
    w = Window.partitionBy(by).orderBy(t)
    lags = range(-max_lag, max_lag + 1)
    rows = df.withColumns({f"__b{k + max_lag}": (F.lead(b, k) if k >= 0 else F.lag(b, -k)).over(w) for k in lags})
    sums = rows.groupBy(by).agg(*[F.corr(a, f"__b{k + max_lag}").alias(f"c{k + max_lag}") for k in lags])
    long = sums.select(by, F.posexplode(F.array(*[F.col(f"c{k + max_lag}") for k in lags])).alias("lag", "r")).withColumn("lag", F.col("lag") - max_lag)
    best = Window.partitionBy(by).orderBy(F.desc_nulls_last("r"), "lag")
    return long.withColumn("__k", F.row_number().over(best)).where("__k = 1").drop("__k")


def empirical_cdf(df: DataFrame, col: str, by: str) -> DataFrame:
    """Value and share of values up to it, by rank."""
    w = Window.partitionBy(by).orderBy(col)
    return df.where(F.col(col).isNotNull()).select(by, col, (F.row_number().over(w) / F.count(F.lit(1)).over(Window.partitionBy(by))).alias("cdf"))


def histogram(df: DataFrame, col: str, bins: int, by: str) -> DataFrame:
    """Counts in equal-width bins between a group's least and largest value; the largest is in the last bin.

    The groups' ends are an aggregate (a row a group) joined back, which adaptive
    execution broadcasts where it is small enough; no group is in one task.
    """
    known = df.where(F.col(col).isNotNull())
    ends = known.groupBy(F.col(by).alias("__by")).agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    rows = known.join(ends, F.col(by).eqNullSafe(F.col("__by")))
    place = F.when(F.col("__hi") > F.col("__lo"), F.least(F.floor((F.col(col) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * bins), F.lit(bins - 1))).otherwise(0)
    return rows.select(by, place.cast("int").alias("bin")).groupBy(by, "bin").agg(F.count(F.lit(1)).alias("n"))


def _buckets(values: DataFrame, col: str, buckets: int) -> Column:
    """A bucket for each value, by ends that part the table's values about evenly: equal values share one, larger values have later ones."""
    ends = sorted(set(values.approxQuantile(col, [k / buckets for k in range(1, buckets)], 0.25 / buckets)))
    return sum((F.when(F.col(col) > float(x), 1).otherwise(0) for x in ends), F.lit(0))


def quantiles(df: DataFrame, col: str, probs: dict[str, float], by: list[str], buckets: int = 64) -> DataFrame:
    """by and a column for each entry: exact quantiles (linear between neighbours) of each group's values, n with them.

    Rows are first counted by value, which Spark combines before the shuffle, so
    that a frequent value is one row. Ranks are running counts within a bucket of values plus what earlier
    buckets hold (buckets rows a group): a group of any size is dealt over its buckets, and no task holds
    all values of one. Missing values don't count; groups without any have no row. Null keys are a group.
    """
    counts = df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))).groupBy(*by, F.col(col).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    dealt = counts.withColumn("__b", _buckets(counts, "__v", buckets))
    sums = dealt.groupBy(*by, "__b").agg(F.sum("__n").alias("__s"))
    w = Window.partitionBy(*by)
    sums = sums.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col("__b").alias("__kb"), F.coalesce(F.sum("__s").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__s").over(w).alias("n"))
    same = F.col("__b") == F.col("__kb")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    ranked = dealt.join(sums, same).withColumn("__last", F.col("__before") + F.sum("__n").over(Window.partitionBy(*by, "__b").orderBy("__v")) - 1)
    first = F.col("__last") - F.col("__n") + 1
    out = []
    for name, p in probs.items():
        at = p * (F.col("n") - 1)
        lo, hi = (F.max(F.when((first <= k) & (k <= F.col("__last")), F.col("__v"))) for k in (F.floor(at), F.ceil(at)))
        share = F.max(at - F.floor(at))
        out.append((lo + (hi - lo) * share).alias(name))
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), *out)


def ranks(df: DataFrame, col: str, ties: list[str], by: list[str], buckets: int = 64) -> DataFrame:
    """df with rank (from 1, ties in order of the ties columns), up_to (rows with at most the value) and n (rows) within each group.

    Groups are dealt over buckets of values as in quantiles(). Equal values are in one task: a value that most rows have makes it a large one. Missing values have no rank and are left out.
    """
    known = df.where(F.col(col).isNotNull())
    dealt = known.withColumn("__b", _buckets(known, col, buckets))
    w = Window.partitionBy(*by)
    sums = dealt.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__s"))
    sums = sums.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col("__b").alias("__kb"), F.coalesce(F.sum("__s").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__s").over(w).alias("n"))
    same = F.col("__b") == F.col("__kb")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    inner = Window.partitionBy(*by, "__b")
    # The default frame of an ordered count ends with the row's peers.
    out = {"rank": F.col("__before") + F.row_number().over(inner.orderBy(col, *ties)), "up_to": F.col("__before") + F.count(F.lit(1)).over(inner.orderBy(col))}
    return dealt.join(sums, same).withColumns(out).drop("__b", "__kb", "__before", *[f"__k{i}" for i in range(len(by))])


def upper_median(col: str) -> Column:
    """The element at n // 2 of the sorted values: not a mean of two. The buffer holds counts of distinct values, combined before the shuffle."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {col} DESC)")


def first_mode(df: DataFrame, col: str, by: str, t: str) -> DataFrame:
    """by, mode: the most frequent value of each group, of equally frequent ones the one that comes first by t."""
    counts = df.where(F.col(col).isNotNull()).groupBy(by, col).agg(F.count(F.lit(1)).alias("__n"), F.min(t).alias("__first"))
    return counts.groupBy(by).agg(F.min_by(col, F.struct(-F.col("__n"), "__first")).alias("mode"))


def steady_avg(col: str) -> Column:
    """The mean, the same for the same values in any order: their sum is one of decimals of 18 places. Groups with a value of 1e9 or more, or not a number, have the usual one."""
    x = F.col(col).cast("double")
    exact = F.when(F.abs(x) < 1e9, x).cast("decimal(38,18)")
    return F.when(F.count(exact) == F.count(x), F.sum(exact).cast("double") / F.count(x)).otherwise(F.avg(x))


def error_model(samples: DataFrame, by: list[str], col: str, least: int = 5) -> DataFrame:
    """Sigma of each bin with enough samples: max(1.4826 * MAD by upper medians, RMS, 1e-6)."""
    med = samples.groupBy(*by).agg(upper_median(col).alias("__m"), F.count(F.lit(1)).alias("n"))
    dev = samples.join(med, by).withColumn("__d", F.abs(F.col(col) - F.col("__m")))
    out = dev.groupBy(*by, "n").agg((1.4826 * upper_median("__d")).alias("__mad"), F.sqrt(F.avg(F.col(col) ** 2)).alias("__rms"))
    return out.where(F.col("n") >= least).select(*by, "n", F.greatest("__mad", "__rms", F.lit(1e-6)).alias("sigma_m"))


def min_max_scores(df: DataFrame, scores: dict[str, tuple[str, bool]]) -> DataFrame:
    """df with a column for each entry name: (column, whether higher is better).

    0 best to 1 worst over all rows; missing is 1, and 0.5 if all are equal. One
    row of least and largest values is broadcast.
    """
    ends = df.agg(*[f(c).alias(f"__{n}_{k}") for n, (c, _) in scores.items() for k, f in (("lo", F.min), ("hi", F.max))])
    out = {}
    for name, (col, higher) in scores.items():
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        s = (hi - F.col(col)) / (hi - lo) if higher else (F.col(col) - lo) / (hi - lo)
        out[name] = F.when(F.col(col).isNull(), 1.0).when(hi == lo, 0.5).otherwise(s)
    return df.join(F.broadcast(ends), how="cross").withColumns(out).drop(*ends.columns)


def places(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with the row's place (from 1) in the order of all rows, which must be a total one.

    Ranges of the order are dealt to partitions; the numbers of rows in earlier
    ones, a row for each partition, are added to the place within.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__earlier"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__within", within).join(F.broadcast(counts), "__part").withColumn(name, (F.col("__within") + F.col("__earlier")).cast("long")).drop("__part", "__within", "__earlier")


def erfinv(x: Column) -> Column:
    """Winitzki's approximation."""
    ln = F.log(1.0 - x * x)
    a = 2.0 / (3.141592653589793 * 0.147) + ln / 2.0
    return F.signum(x) * F.sqrt(F.sqrt(a * a - ln / 0.147) - a)


def normal_scores(df: DataFrame, col: str, by: str) -> DataFrame:
    """Sorted values with the normal quantile of (rank - 0.5) / n."""
    w = Window.partitionBy(by).orderBy(col)
    p = (F.row_number().over(w) - 0.5) / F.count(F.lit(1)).over(Window.partitionBy(by))
    return df.where(F.col(col).isNotNull()).withColumn("z", 1.4142135623730951 * erfinv(2.0 * p - 1.0))


def weighted_median(df: DataFrame, col: str, weight: Column, by: str = "session_id") -> DataFrame:
    """by, value: the first value, in rising order, up to which half of all weight lies; the upper median where no weight is positive."""
    rows = df.where(F.col(col).isNotNull()).select(by, F.col(col).alias("value"), weight.alias("__w"))
    w = Window.partitionBy(by)
    rows = rows.withColumns({"__all": F.sum("__w").over(w), "__so_far": F.sum("__w").over(w.orderBy("value"))})
    half = F.min(F.when((F.col("__all") > 0) & (F.col("__so_far") >= F.col("__all") / 2), F.col("value")))
    return rows.groupBy(by).agg(F.coalesce(half, upper_median("value")).alias("value"))


def winner(a: Column, b: Column, names: tuple[str, str]) -> Column:
    """Which of two errors is smaller, 'tie', or 'n/a' if one is missing."""
    return F.when(a.isNull() | b.isNull(), "n/a").when(a < b, names[0]).when(b < a, names[1]).otherwise("tie")


def ellipse_points(df: DataFrame, x: str, y: str, k: float, by: str = "session_id", points: int = 80) -> DataFrame:
    """by, i, x, y: the k-sigma ellipse of each group's points; groups below three have none."""
    g = df.groupBy(by).agg(F.count(F.col(x) + F.col(y)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_samp(x).alias("a"), F.covar_samp(x, y).alias("b"), F.var_samp(y).alias("c")).where("n >= 3")
    half, root = (F.col("a") + F.col("c")) / 2, F.sqrt(((F.col("a") - F.col("c")) / 2) ** 2 + F.col("b") ** 2)
    g = g.withColumns({"big": F.sqrt(F.greatest(half + root, F.lit(0.0))), "small": F.sqrt(F.greatest(half - root, F.lit(0.0))), "turn": F.atan2(2 * F.col("b"), F.col("a") - F.col("c")) / 2})
    g = g.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("at", F.col("i") * (2 * 3.141592653589793 / (points - 1)))
    u, v = k * F.col("big") * F.cos("at"), k * F.col("small") * F.sin("at")
    return g.select(by, "i", (F.col("mx") + u * F.cos("turn") - v * F.sin("turn")).alias("x"), (F.col("my") + u * F.sin("turn") + v * F.cos("turn")).alias("y"))
