"""Running values by stretches against the same over whole keys; sweeps and selection against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsewright.operators import bins, cuts, scan


@pytest.fixture(scope="module")
def times(spark):
    rng = random.Random(3)
    rows = [(p, k, round(rng.uniform(49990, 50300), 1 if p == "B" else 6)) for p, n in (("A", 700), ("B", 60), ("C", 1)) for k in range(n)]
    return spark.createDataFrame(rows, "psr string, id long, mjd double").repartition(4).cache()


@pytest.mark.parametrize("days", [1.0, 7.0, 1000.0])
def test_sessions_do_not_depend_on_the_stretches(times, days):
    w = Window.partitionBy("psr").orderBy("mjd")
    gap = F.col("mjd") - F.lag("mjd").over(w)
    want = times.withColumn("new", F.when(gap.isNull() | (gap > 0.9), 1).otherwise(0)).withColumn("grp", F.sum("new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    got = scan.sessions(times, ["psr"], 0.9, days)
    assert got.columns == ["psr", "id", "mjd", "grp"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.select(*got.columns).collect())
    wide = times.withColumn("width", F.when(F.col("psr") == "A", 0.9).otherwise(5.0))
    other = {r.id: r.grp for r in scan.sessions(wide, ["psr"], F.col("width"), days).filter("psr = 'A'").collect()}
    assert other == {r.id: r.grp for r in got.filter("psr = 'A'").collect()}


def test_numbers_do_not_depend_on_the_stretches(times):
    want = times.withColumn("n", F.row_number().over(Window.partitionBy("psr").orderBy("mjd", "id")) + 4)
    got = scan.numbered(times.withColumn("n", F.lit(0)), ["psr"], ["mjd", "id"], scan.of_days(width=3.0), "n", start=5)
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())
    with_null = times.union(times.limit(1).withColumn("mjd", F.lit(None).cast("double")))
    first = scan.numbered(with_null, ["psr"], ["mjd", "id"], scan.of_days(), "n").filter("mjd is null").first()
    assert first.n == 1


def test_one_source_with_all_rows_is_many_tasks(spark):
    t = spark.range(4000).select(F.lit("P").alias("psr"), F.col("id").alias("toa_id"), (F.col("id") / 4.0).alias("mjd"))
    plan = scan.sessions(t, ["psr"], 0.1)._jdf.queryExecution().executedPlan().toString()
    by_source = [line for line in plan.splitlines() if "hashpartitioning(psr#" in line and f"{scan.PART}#" not in line]
    assert all("scan_" not in line or "hashpartitioning" in line for line in by_source) and f", {scan.PART}#" in plan
    assert scan.sessions(t, ["psr"], 0.1).agg(F.max("grp")).first()[0] == 4000


@pytest.mark.parametrize("days", [2.0, 500.0])
def test_stretches_of_spans_do_not_depend_on_the_cut(times, days):
    spans = times.select("psr", F.col("mjd").alias("low"), (F.col("mjd") + F.when(F.col("id") % 9 == 0, 12.0).otherwise(0.0)).alias("high")).distinct()
    w = Window.partitionBy("psr").orderBy("low", "high")
    reach = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    want = spans.withColumn("new", F.when(F.col("low") - reach > 0.5, 1).otherwise(0)).withColumn("part", F.sum("new").over(w))
    got = scan.stretched(spans, ["psr"], 0.5, days)
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.select(*got.columns).collect())
    assert got.filter("psr = 'A'").agg(F.max("part")).first()[0] > 3


@pytest.mark.parametrize("days", [0.5, 20.0])
def test_nearest_marks_do_not_depend_on_the_stretches(spark, times, monkeypatch, days):
    monkeypatch.setattr(scan, "DAYS", days)
    rng = random.Random(4)
    own = [(p, k, a, a + rng.choice([0.0, 3.0, 8.0])) for p in "AB" for k, a in enumerate(rng.uniform(49900, 50400) for _ in range(25))]
    b = spark.createDataFrame(own, "psr string, ord long, low double, high double")
    got = {(r.psr, r.mjd): (r.ord, r.inside) for r in bins.nearest_bins(times.select("psr", "mjd").distinct(), b).collect()}
    for r in times.select("psr", "mjd").distinct().collect():
        near = sorted((abs((lo + hi) / 2 - r.mjd), k, lo < r.mjd < hi) for p, k, lo, hi in own if p == r.psr)
        assert got.get((r.psr, r.mjd)) == (near[0][1:] if near else None)


def test_sweep_finds_every_touching_band(spark):
    rng = random.Random(5)
    rows = [("P", rng.randrange(3), "L", k, lo, lo + rng.choice([0, 0, 1, 5])) for k, lo in enumerate(rng.randrange(200) for _ in range(150))]
    schema = "psr string, day long, fe string, toa_id long, lo double, hi double"
    a, b = (spark.createDataFrame([(*r[:4], float(r[4]), float(r[5])) for r in rows if r[3] % 2 == k], schema) for k in (0, 1))
    got = {r.toa_id for r in cuts.touching(a, b, ["psr", "day", "fe"]).collect()}
    want = {x[3] for x in rows if x[3] % 2 == 0 and any(y[3] % 2 and x[1] == y[1] and x[5] >= y[4] and y[5] >= x[4] for y in rows)}
    assert got == want and 10 < len(want) < 75
    plan = cuts.touching(a, b, ["psr", "day", "fe"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_a_large_group_is_swept_in_a_sort(spark):
    n = 100_000
    t = spark.range(n).select(F.lit("P").alias("psr"), F.lit(1).alias("day"), F.lit("L").alias("fe"), F.col("id").alias("toa_id"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    assert cuts.touching(t.filter("toa_id % 2 = 0"), t.filter("toa_id % 2 = 1"), ["psr", "day", "fe"]).count() == n // 2


@pytest.mark.parametrize(("stretches", "few"), [(64, 5), (1024, 4096)])
def test_quantiles_are_exact(spark, stretches, few):
    rng = np.random.default_rng(6)
    groups = {"even": rng.normal(size=300), "ties": rng.integers(0, 3, 200).astype(float), "one": np.array([4.5]), "same": np.full(50, -2.0), "skewed": 10.0 ** -rng.integers(0, 40, 120).astype(float), "wide": np.array([-1.7e308, 1.7e308, 0.0, 1.0])}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("even", None), ("even", float("nan")), ("none", None)]
    shares = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {r.k: (r.n, r.q) for r in scan.quantiles(spark.createDataFrame(rows, "k string, v double").repartition(3), ["k"], "v", shares, stretches, few).collect()}
    want = spark.createDataFrame([r for r in rows if r[1] is not None and r[1] == r[1]], "k string, v double").groupBy("k").agg(F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, shares))).alias("q"))
    assert got == {r.k: (r.n, r.q) for r in want.collect()}


def test_names_that_hold_an_entry(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("ab_é") for _ in range(n))
    names = sorted({(p, word(rng.randrange(0, 14))) for p in "PQ" for _ in range(120)})
    entries = sorted({(p, word(rng.randrange(0, 7))) for p in "PQR" for _ in range(60)} | {("P", ""), ("Q", "nowhere")})
    got = cuts.containing(spark.createDataFrame(names, "psr string, name string"), spark.createDataFrame(entries, "psr string, pattern string"))
    rows = [tuple(r) for r in got.collect()]
    want = {(p, e, n) for p, e in entries for q, n in names if p == q and e in n}
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_many_entries_meet_many_names_by_keys(spark):
    """Each of 20,000 entries of one source names one of its 100,000 files: nested, that would be two milliards of comparisons."""
    psr = F.format_string("P%d", F.col("id") % 1)
    names = spark.range(100_000).select(psr.alias("psr"), F.format_string("file_%06d.x.nb.tim", "id").alias("name"))
    entries = spark.range(0, 100_000, 5).select(psr.alias("psr"), F.format_string("_%06d.", "id").alias("pattern"))
    got = cuts.containing(names, entries)
    assert got.count() == 20_000
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_settled_frames_are_read_by_column(spark):
    from pulsewright.operators.settle import settled

    df = settled(spark.range(10).selectExpr("id", "cast(id as string) as text"))
    plan = df.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "parquet" in plan.lower() and "text" not in plan and sorted(r.id for r in df.collect()) == list(range(10))
