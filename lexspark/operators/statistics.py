"""Contingency and Poisson residuals, dispersion, goodness of fit, power law, Ward clustering.

Everything but the chi-square tail and the clustering of a few dozen codes is a grouped aggregate joined back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.operators.views import fixed


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def contingency(counts: DataFrame) -> DataFrame:
    """counts (grp, code, n, cases) with expected and the residual (n - E) / sqrt(E); 0 where a code is never or always there."""
    sums = counts.groupBy("code").agg(F.sum("n").alias("sn"), F.sum("cases").alias("sc"))
    e = _ratio(F.col("cases") * F.col("sn").cast("double"), F.col("sc"))
    joined = counts.join(sums, "code")
    open_ = (F.col("sn") > 0) & (F.col("sn") < F.col("sc"))
    return joined.withColumn("expected", e).withColumn("resid", F.when(open_, _ratio(F.col("n") - F.col("expected"), F.sqrt("expected"))).otherwise(0.0)).select("grp", "code", "n", "cases", "expected", "resid")


def chi_square(counts: DataFrame) -> DataFrame:
    """(code, chi2): against equal shares in all groups."""
    sums = counts.groupBy("code").agg(F.sum("n").alias("sn"), F.sum("cases").alias("sc"))
    j = counts.join(sums, "code").withColumn("p", _ratio(F.col("sn").cast("double"), F.col("sc"))).withColumn("e", F.col("cases") * F.col("p"))
    return j.groupBy("code").agg(F.sum(_ratio(F.pow(F.col("n") - F.col("e"), F.lit(2)), F.col("e") * (1 - F.col("p")))).alias("chi2"))


def poisson(counts: DataFrame) -> DataFrame:
    """(grp, code, n, resid): (n - mean) / sqrt(mean) by code over the rows given; 0 for a mean of 0."""
    means = counts.groupBy("code").agg(F.avg(F.col("n").cast("double")).alias("mean"))
    return counts.join(means, "code").select("grp", "code", "n", _ratio(F.col("n") - F.col("mean"), F.sqrt("mean")).alias("resid"))


def dispersion(counts: DataFrame) -> DataFrame:
    """(code, groups, zeros, zero_share, mean, variance, phi, over): the diagnostics of a Poisson fit."""
    n = F.col("n").cast("double")
    agg = counts.groupBy("code").agg(F.count("*").alias("groups"), F.count_if(F.col("n") == 0).alias("zeros"), F.avg(n).alias("mean"), F.var_samp(n).alias("variance"))
    phi = F.try_divide(F.col("variance"), F.col("mean"))
    return agg.select("code", "groups", "zeros", (F.col("zeros") / F.col("groups")).alias("zero_share"), "mean", "variance", phi.alias("phi"), F.coalesce(phi > 1.5, F.lit(False)).alias("over"))


def z_scores(counts: DataFrame) -> DataFrame:
    """(grp, code, n, z): the residual scaled by the dispersion."""
    n = F.col("n").cast("double")
    agg = counts.groupBy("code").agg(F.avg(n).alias("mean"), F.stddev_samp(n).alias("sd"))
    return counts.join(agg, "code").select("grp", "code", "n", _ratio(F.col("n") - F.col("mean"), F.col("sd")).alias("z"))


def outliers(z: DataFrame, limit: float = 2.0) -> DataFrame:
    """(grp, n_outliers, max_abs_z) by group."""
    return z.groupBy("grp").agg(F.count_if(F.abs("z") > limit).alias("n_outliers"), F.max(F.abs("z")).alias("max_abs_z"))


def power_law(counts: DataFrame) -> DataFrame:
    """(slope, intercept, r2) of log10 variance on log10 mean over codes."""
    d = dispersion(counts).filter("mean > 0 AND variance > 0").select(F.log10("variance").alias("y"), F.log10("mean").alias("x"))
    return d.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))


def chi_square_tail(x: float, k: int) -> float:
    """P(chi-square with k degrees of freedom > x), by the incomplete gamma function's series or continued fraction."""
    if k <= 0 or x <= 0:
        return 1.0
    a, x = k / 2, x / 2
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


@F.pandas_udf(T.DoubleType())
def _tail(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else chi_square_tail(a, int(b)) for a, b in zip(x, k, strict=True)])


def goodness_of_fit(counts: DataFrame) -> DataFrame:
    """(code, x2, p_value, fits): Pearson statistic of the Poisson fit."""
    agg = poisson(counts).groupBy("code").agg(F.sum(F.pow("resid", F.lit(2))).alias("x2"), (F.count("*") - 1).alias("df"))
    return agg.withColumn("p_value", _tail("x2", "df")).select("code", "x2", "p_value", (F.col("p_value") > 0.05).alias("fits"))


def chi_square_stars(counts: DataFrame) -> DataFrame:
    """(code, chi2, p_value, shown): the statistic with its test against equal shares; shown with a star below 5 %, two below 1 %."""
    df = counts.groupBy("code").agg((F.count_distinct("grp") - 1).alias("df"))
    tested = chi_square(counts).join(df, "code").withColumn("p_value", _tail("chi2", "df"))
    stars = F.when(F.col("p_value") < 0.01, "**").when(F.col("p_value") < 0.05, "*").otherwise("")
    return tested.select("code", "chi2", "p_value", F.concat(fixed(F.col("chi2"), 3), stars).alias("shown"))


def poisson_aic(counts: DataFrame) -> DataFrame:
    """(code, aic) of the intercept-only Poisson fit."""

    @F.pandas_udf(T.DoubleType())
    def log_factorial(n: pd.Series) -> pd.Series:
        return n.map(lambda v: math.lgamma(v + 1))

    means = counts.groupBy("code").agg(F.avg(F.col("n").cast("double")).alias("mean"))
    # Groups with one count are one row from here on: few distinct counts reach Python.
    weighted = counts.groupBy("code", "n").agg(F.count("*").alias("w")).join(means, "code")
    ll = F.when(F.col("mean") > 0, F.col("n") * F.ln("mean") - F.col("mean") - log_factorial(F.col("n").cast("double"))).otherwise(0.0)
    return weighted.groupBy("code").agg((2 - 2 * F.sum(F.col("w") * ll)).alias("aic"))


def dispersion_bucket(c: Column) -> Column:
    return F.when(c < 10, "<10").when(c < 50, "10-50").when(c < 100, "50-100").otherwise(">=100")


def bubbles(counts: DataFrame, most: float = 10.0) -> DataFrame:
    """(grp, code, share, resid): positive shares with residuals clamped to ±most."""
    c = contingency(counts).withColumn("share", _ratio(100.0 * F.col("n"), F.col("cases")))
    return c.filter("share > 0").select("grp", "code", "share", F.greatest(F.lit(-most), F.least(F.lit(most), "resid")).alias("resid"))


def shares_by_row(counts: DataFrame) -> DataFrame:
    """(code, grp, share): each group's part of a code's sum; codes without any go."""
    sums = counts.groupBy("code").agg(F.sum("n").alias("sn")).filter("sn > 0")
    return counts.join(sums, "code").select("code", "grp", (F.col("n") / F.col("sn")).alias("share"))


def squared_distances(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Codes, and the squares of the distances between their shares.

    Each task sums the squares over its groups, so that the driver gets one number for each pair of codes, however many groups
    there are; codes come from one rule file, some dozens.
    """
    shares = shares_by_row(counts)
    codes = [r["code"] for r in shares.select("code").distinct().orderBy("code").collect()]
    k, place = len(codes), {c: i for i, c in enumerate(codes)}
    if not k:
        return codes, np.zeros((0, 0))

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            for of_code, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = np.zeros(k)
                row[[place[c] for c in of_code]] = values
                total += (row[:, None] - row[None, :]) ** 2
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    by_group = shares.groupBy("grp").agg(F.collect_list("code").alias("codes"), F.collect_list("share").alias("shares")).select("codes", "shares")
    sums = by_group.mapInArrow(squares, "i int, row array<double>").groupBy("i").agg(F.array(*[F.sum(F.col("row")[j]) for j in range(k)]).alias("row"))
    return codes, np.array([r["row"] for r in sorted(sums.collect(), key=lambda r: r["i"])]) if k else np.zeros((0, 0))


def ward_merges(squares: np.ndarray) -> list[tuple[int, int, float, int]]:
    """(left, right, distance, size) of Ward's merges by chains of nearest neighbours; merged clusters are numbered from k on.

    From any cluster the chain goes to its nearest neighbour until two are each other's nearest: these merge, whatever else is
    open, since Ward's distance never falls by a merge.  Each merge costs k steps, all of them the square of k.
    """
    k = len(squares)
    d, size, alive, chain, pairs = squares.astype(float).copy(), np.ones(k), np.ones(k, bool), [], []
    np.fill_diagonal(d, np.inf)
    while len(pairs) < k - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            row = np.where(alive, d[a], np.inf)
            row[a] = np.inf
            b = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]  # of equally near ones the one that the chain came from
                break
            chain.append(b)
        chain = chain[:-2]
        a, b = min(a, b), max(a, b)
        pairs.append((a, b, float(d[a, b])))
        n = size[a] + size[b]
        new = ((size[a] + size) * d[a] + (size[b] + size) * d[b] - size * d[a, b]) / (n + size)
        d[a] = d[:, a] = new
        d[a, a] = np.inf
        size[a], alive[b] = n, False
    # Chains find merges out of order: by distance, each side is the cluster that its code is in by then.
    root, members, out = list(range(k)), {i: 1 for i in range(k)}, []
    name = list(range(k))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b, h in sorted(pairs, key=lambda p: p[2]):
        x, y = top(a), top(b)
        left, right = sorted((name[x], name[y]))
        members[k + len(out)] = n = members[left] + members[right]
        root[y], name[x] = x, k + len(out)
        out.append((left, right, math.sqrt(max(0.0, h)), n))
    return out


def ward_order(counts: DataFrame) -> pd.DataFrame:
    """Ward's merges of codes by their shares: (step, left, right, distance, size)."""
    codes, squares = squared_distances(counts)
    names = list(codes)
    out = []
    for left, right, distance, size in ward_merges(squares):
        out.append((len(out) + 1, names[left], names[right], distance, size))
        names.append(f"{names[left]}|{names[right]}")
    return pd.DataFrame(out, columns=["step", "left", "right", "distance", "size"])


def ward_clusters(counts: DataFrame, share: float = 0.7) -> pd.DataFrame:
    """(code, place, cluster): codes in the order of the dendrogram's leaves, and the clusters that a cut below share * largest distance leaves.

    Clusters are numbered from 1 in the order of leaves; the left branch of a merge is the older cluster.
    """
    codes, squares = squared_distances(counts)
    merges = ward_merges(squares)
    k, cut = len(codes), share * max((m[2] for m in merges), default=0.0)
    leaves: dict[int, list[int]] = {i: [i] for i in range(k)}
    group = list(range(k))
    for i, (left, right, distance, _) in enumerate(merges):
        leaves[k + i] = leaves.pop(left) + leaves.pop(right)
        if distance < cut:
            for leaf in leaves[k + i]:
                group[leaf] = k + i
    order = leaves.get(2 * k - 2, list(range(k)))
    number = {g: i for i, g in enumerate(dict.fromkeys(group[leaf] for leaf in order), 1)}
    return pd.DataFrame([(codes[leaf], i, number[group[leaf]]) for i, leaf in enumerate(order, 1)], columns=["code", "place", "cluster"])
