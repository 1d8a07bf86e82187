"""Quantiles, number forms, legend breaks and Ward's clusters against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.operators import aggregates, classify, statistics, views
from lexspark.operators.quantiles import quantiles

SHARES = {"least": 0.0, "q1": 0.25, "middle": 0.5, "q3": 0.75, "q9": 0.9, "most": 1.0}


def groups():
    rng = np.random.default_rng(1)
    return {
        "normal": rng.normal(size=1001) * 1e5, "repeated": np.repeat([1.0, 2.0, -3.0, 0.0], 50), "one": np.array([5.0]), None: rng.uniform(size=300), "infinite": np.array([-np.inf, -np.inf, 1, 2, np.inf]),
        "wide": np.concatenate([rng.lognormal(0, 200, 500), -rng.lognormal(0, 200, 500), [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308]]), "close": 1 + np.arange(5000) * 2.0**-52,
    }


def test_quantiles_by_group(spark):
    data = groups()
    rows = [(g, float(v)) for g, x in data.items() for v in x] + [("one", None), ("one", math.nan), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r.g: r for r in quantiles(df, "v", SHARES, ["g"]).collect()}
    assert set(got) == set(data)
    for g, x in data.items():
        with np.errstate(all="ignore"):
            want = np.quantile(x, list(SHARES.values()))
        for name, w in zip(SHARES, want, strict=True):
            assert math.isnan(w) or got[g][name] == w or got[g][name] == pytest.approx(w, rel=1e-12), (g, name)
    assert quantiles(df.limit(0), "v", SHARES, ["g"]).count() == 0
    with pytest.raises(ValueError):
        quantiles(df, "v", {"q": 1.5})


def test_quantiles_keep_no_buffer_of_values(spark):
    """No percentile or collected list in the plan, and a million distinct values give the exact result."""
    n = 1_000_003
    df = spark.range(0, n, 1, 4).select((F.pmod(F.col("id") * 7919, F.lit(n)) / 7.0).alias("v"))
    out = quantiles(df, "v", {"q1": 0.25, "q3": 0.75})
    plan = out._jdf.queryExecution().toString().lower()
    assert "percentile" not in plan and "collect_" not in plan
    r = out.first()
    assert (r.q1, r.q3) == (pytest.approx((n - 1) * 0.25 / 7), pytest.approx((n - 1) * 0.75 / 7))


def test_describe_and_levels_without_values(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert tuple(aggregates.describe(none, "v").first()) == (0, *[None] * 7)
    assert classify.relative_strictness(none, "v").count() == 0
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0), ("d", 4.0), ("e", None)], "g string, v double")
    assert {r.g: r.relative for r in classify.relative_strictness(rows, "v").collect()} == {"a": "緩やか", "b": "標準", "c": "厳格", "d": "非常に厳格", "e": "緩やか"}
    stats = {r.g: r.median for r in aggregates.score_stats(rows.withColumn("g", F.lit(None).cast("string")), "v", ["g"]).collect()}
    assert stats == {None: 2.5}


def test_number_forms_round_the_binary_value(spark):
    rng = random.Random(1)
    values = [2.675, 1.005, 0.125, 0.375, -2.675, -0.125, 0.5, 2.5, 1e15 + 0.125, 123456789012.345, 1e22, -0.001, 0.0, 0.00125, 0.285]
    values += [rng.randrange(100_000) / 1000 for _ in range(2000)] + [rng.randrange(10**6) / 8 for _ in range(500)] + [rng.randrange(10**13) + 0.005 for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    x = F.col("x")
    for r in df.select("x", views.fixed(x).alias("two"), views.fixed(x, 0).alias("none"), views.percent_text(x).alias("share")).collect():
        assert (r.two, r.none, r.share) == (f"{r.x:.2f}", f"{r.x:.0f}", f"{r.x:.2%}")
    odd = spark.createDataFrame([(math.nan,), (None,)], "x double").select(views.fixed(x), views.percent_text(x)).collect()
    assert [tuple(r) for r in odd] == [("NA", "NA"), (None, None)]


def all_labellings(low, high, count):
    """The best of all labellings with up to three skipped labels, up to 13 numbers, and steps of any power of ten that fits."""
    best, w = None, high - low
    for j, (i, q), k, z in itertools.product(range(1, 4), enumerate(views.STEPS), range(2, 14), range(-5, 6)):
        step = j * q * 10.0**z
        span = step * (k - 1)
        if not w / 20 < span < 20 * w:
            continue
        for start in range(math.floor(high / step) * j - (k - 1) * j, math.ceil(low / step) * j + 1):
            first = start * (step / j)
            last = first + span
            zero = start % j == 0 and first <= 0 <= last
            given, asked = (k - 1) / span, (count - 1) / (max(last, high) - min(first, low))
            score = 0.25 * (1 - i / 5 - j + zero) + 0.2 * (1 - 0.5 * ((high - last) ** 2 + (low - first) ** 2) / (0.1 * w) ** 2) + 0.5 * (2 - max(given / asked, asked / given)) + 0.05
            if best is None or score > best[0] + 1e-12:
                best = score, [first + n * step for n in range(k)]
    return best[1]


def test_breaks_like_all_labellings(spark):
    rng = random.Random(4)
    for _ in range(25):
        high = math.exp(rng.uniform(-1, 6))
        low = rng.choice([0.05, -high * rng.random()])
        assert views.nice_breaks(low, high) == pytest.approx(all_labellings(low, high, 5), abs=1e-9 * high)
    assert views.nice_breaks(3.0, 3.0) == [3.0] * 5 and views.nice_breaks(10, 0.05) == views.nice_breaks(0.05, 10)
    rows = spark.createDataFrame([("a", 0.01), ("a", 18.3), ("b", 47.1), ("c", None), ("d", 0.02)], "g string, x double")
    got = {r.g: (r.shown, r.lower, r.upper) for r in views.computed_breaks(rows, "x", ["g"]).collect()}
    assert got["a"] == ([5.0, 10.0, 15.0], 0.05, 19.0) and got["b"] == ([10.0, 20.0, 30.0, 40.0], 0.05, 48.0) and got["c"][0] is None and got["d"][0] == []


def brute_ward(points):
    clusters, out, n = {i: [i] for i in range(len(points))}, [], len(points)
    inside = lambda x: ((points[x] - points[x].mean(0)) ** 2).sum()
    while len(clusters) > 1:
        h, a, b = min((math.sqrt(max(0, 2 * (inside(clusters[a] + clusters[b]) - inside(clusters[a]) - inside(clusters[b])))), a, b) for a, b in itertools.combinations(sorted(clusters), 2))
        out.append((a, b, h, len(clusters[a]) + len(clusters[b])))
        clusters[n] = clusters.pop(a) + clusters.pop(b)
        n += 1
    return out


@pytest.mark.parametrize("k", [0, 1, 2, 3, 8, 15])
def test_ward_by_chains_like_brute_force(k):
    for seed in range(8):
        points = np.random.default_rng(seed).normal(size=(k, 4))
        got, want = statistics.ward_merges(((points[:, None] - points[None]) ** 2).sum(-1)), brute_ward(points)
        assert [(a, b, n) for a, b, _, n in got] == [(a, b, n) for a, b, _, n in want]
        assert [h for _, _, h, _ in got] == pytest.approx([h for _, _, h, _ in want])


def test_ward_clusters_are_cut_below_a_share_of_the_largest_distance(spark):
    rng = np.random.default_rng(7)
    centres = rng.dirichlet(np.ones(40), 3)
    counts = [(f"g{g}", f"*C{c:02d}", int(1e5 * centres[c % 3][g] * rng.uniform(0.98, 1.02)), 10) for c in range(12) for g in range(40)] + [("g0", "*NONE", 0, 10)]
    df = spark.createDataFrame(counts, "grp string, code string, n bigint, cases bigint").repartition(5)
    out = statistics.ward_clusters(df)
    by = {}
    for r in out.itertuples():
        by.setdefault(r.cluster, set()).add(r.code)
    assert sorted(map(sorted, by.values())) == sorted([f"*C{c:02d}" for c in range(s, 12, 3)] for s in range(3))
    assert list(out.place) == list(range(1, 13)) and list(out.cluster) == sorted(out.cluster)
    assert len(statistics.ward_clusters(df.limit(0))) == 0
    shares = {}
    for g, c, n, _ in counts:
        shares.setdefault(c, {})[g] = n
    points = np.array([[v[f"g{g}"] / sum(v.values()) for g in range(40)] for c, v in sorted(shares.items()) if sum(v.values())])
    codes, squares = statistics.squared_distances(df)
    assert codes == sorted(c for c in shares if c != "*NONE") and np.allclose(squares, ((points[:, None] - points[None]) ** 2).sum(-1), atol=1e-15)
