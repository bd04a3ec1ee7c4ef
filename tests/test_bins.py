import numpy as np
from pyspark.sql import functions as F

from pulsewright.operators import bins, ftests
from pulsewright.plans.queries_cuts import cut_toas
from pulsewright.sources.binding import toas, toas_by_file

SF = "/root/testdata/sf0.001"


def test_strict_and_closed_edges(spark):
    b = spark.createDataFrame([("P", 1, 10.0, 20.0), ("P", 2, 20.0, 20.0), ("P", 3, 15.0, 18.0), ("P", 4, 30.0, 25.0), ("P", 5, 90.0, 91.0)], "psr string, ord long, low double, high double")
    t = spark.createDataFrame([("P", k, m) for k, m in enumerate([10.0, 12.0, 16.0, 20.0, 40.0])], "psr string, toa_id long, mjd double")
    assert sorted((r.toa_id, r.ord) for r in bins.members(t, b).collect()) == [(1, 1), (2, 1), (2, 3)]
    assert sorted((r.toa_id, r.ord) for r in bins.members(t, b, strict=False).collect()) == [(0, 1), (1, 1), (2, 1), (2, 3), (3, 1), (3, 2)]
    found = {(r.kind, r.id) for r in bins.check(t, b).collect()}
    assert {("improper", 2), ("improper", 4), ("overlapping", 1), ("empty", 2), ("empty", 4), ("empty", 5), ("in no bin", 0), ("in no bin", 3), ("in no bin", 4), ("in several bins", 2)} == found


def test_greedy_over_partitions_is_one_pass_over_all(spark):
    from pulsewright.functions.kernels import greedy_bins

    t = toas(spark, SF).cache()
    got = {}
    for r in bins.greedy(t, 6.5, 0.05).orderBy("psr", "ord").collect():
        got.setdefault(r.psr, []).append([r.low, r.high])
    times = {}
    for r in t.select("psr", "mjd").distinct().collect():
        times.setdefault(r.psr, []).append(r.mjd)
    assert got == {p: greedy_bins(np.sort(m), 6.5, 0.05).tolist() for p, m in times.items()}


def test_setup_leaves_every_survivor_in_one_bin(spark):
    start = cut_toas(spark, SF).cache()
    marked, good = bins.setup(start, most_us=3.0)
    marked = marked.cache()
    assert bins.check(marked.filter("cut is null"), good).count() == 0
    assert marked.count() == start.count()
    assert marked.filter("cut is not null and cut <> 'dmx'").count() == start.filter("cut is not null").count()


def test_wideband_frequencies_in_single_precision(spark):
    found = spark.createDataFrame([("P", 1, 1400.0, 717.572, 1.62, 20.9), ("P", 1, 1300.0, 10.0, 1.1, None)], "psr string, ord long, freq_mhz double, bw_mhz double, fratio double, pp_dm double")
    low = np.float32(717.572 / (1.62 - 1))
    r = bins.frequencies(found, wideband=True).first()
    assert r.low_freq == float(min(low, np.float32(1300))) and r.high_freq == float(np.float32(np.float32(717.572) + low))


def refit(x, y, w):
    s = np.sqrt(w)
    beta, _, rank, _ = np.linalg.lstsq(x * s[:, None], y * s, rcond=None)
    return float((((y - x @ beta) * s) ** 2).sum()), len(y) - rank, beta


def test_leave_one_out_is_a_refit_without_the_file(spark):
    rng = np.random.default_rng(4)
    rows = []
    for p in "AB":
        for f in range(8):
            for _ in range(rng.integers(2, 9)):
                t, only = rng.normal(), float(f == 3)
                rows.append((p, f"f{f}", float(2 + t + rng.normal() + 8 * (f == 5)), float(rng.uniform(0.5, 2)), 1.0, float(t), only))
    d = spark.createDataFrame(rows, "psr string, name string, y double, w double, a double, b double, c double")
    got = {(r.psr, r.name): r for r in ftests.leave_one_out(ftests.factors(d, ["psr", "name"], ["a", "b", "c"]), 4).collect()}
    for p in "AB":
        own = [r for r in rows if r[0] == p]
        full = refit(np.array([r[4:] for r in own]), np.array([r[2] for r in own]), np.array([r[3] for r in own]))
        for f in range(8):
            left = [r for r in own if r[1] != f"f{f}"]
            chi2, dof, _ = refit(np.array([r[4:] for r in left]), np.array([r[2] for r in left]), np.array([r[3] for r in left]))
            r = got[p, f"f{f}"]
            assert abs(r.chi2 - chi2) < 1e-8 * max(1, chi2) and r.dof == dof and r.n_removed == len(own) - len(left)
            assert r.drop == (r.ftest is not None and r.ftest < 1e-6) and (full[0] > chi2 or not r.drop)


def test_leave_one_out_with_a_column_for_each_bin(spark):
    rng = np.random.default_rng(9)
    rows = []
    for p in "AB":
        for f in range(9):
            for _ in range(rng.integers(2, 7)):
                ord_ = int(rng.integers(0, 4)) if f != 4 else 7  # file 4 alone has bin 7
                t, u = rng.normal(), rng.uniform(0.5, 2)
                rows.append((p, ord_, f"f{f}", float(2 + t + ord_ * u + rng.normal()), float(rng.uniform(0.5, 2)), float(u), 1.0, float(t)))
    d = spark.createDataFrame(rows, "psr string, ord int, name string, y double, w double, u double, a double, b double")
    per_file = ftests.factors(d, ["psr", "ord", "name"], ["u", "a", "b"])
    got = {(r.psr, r.name): r for r in ftests.leave_one_out(per_file, 4, unit="ord").collect()}
    for p in "AB":
        for f in range(9):
            left = [r for r in rows if r[0] == p and r[2] != f"f{f}"]
            known = sorted({r[1] for r in left})
            x = np.array([[r[6], r[7], *(r[5] * (r[1] == o) for o in known)] for r in left])
            chi2, dof, _ = refit(x, np.array([r[3] for r in left]), np.array([r[4] for r in left]))
            r = got[p, f"f{f}"]
            assert abs(r.chi2 - chi2) < 1e-7 * max(1, chi2) and r.dof == dof
            assert r.n_removed == sum(q[0] == p and q[2] == f"f{f}" for q in rows)


def test_fits_keep_the_digits_that_products_lose(spark, monkeypatch):
    """Columns close to dependent, far from zero: in sums of products nothing would be left of what tells them apart."""
    from fractions import Fraction

    rng = np.random.default_rng(6)
    rows = []
    for f in range(30):
        for _ in range(7):
            t = float(rng.integers(0, 1 << 20)) / (1 << 20)
            x = (1.0, 1e4 + t, 1e4 + t + float(rng.integers(0, 4)) / (1 << 11))
            rows.append(("P", f"f{f}", 30.0 + 2 * t + float(rng.normal()), 1.0, *x))
    d = spark.createDataFrame(rows, "psr string, name string, y double, w double, a double, b double, c double")

    def exact(own):
        """Normal equations in fractions."""
        x, y = [[Fraction(v) for v in r[4:]] for r in own], [Fraction(r[2]) for r in own]
        m = [[sum(r[i] * r[j] for r in x) for j in range(3)] + [sum(r[i] * v for r, v in zip(x, y, strict=True))] for i in range(3)]
        for i in range(3):
            m[i] = [v / m[i][i] for v in m[i]]
            for k in range(3):
                if k != i:
                    m[k] = [a - m[k][i] * b for a, b in zip(m[k], m[i], strict=True)]
        return float(sum((v - sum(r[i] * m[i][3] for i in range(3))) ** 2 for r, v in zip(x, y, strict=True)))

    x, y = np.array([r[4:] for r in rows]), np.array([r[2] for r in rows])
    size = np.linalg.norm(x, axis=0)
    beta = np.linalg.pinv(x.T @ x / np.outer(size, size), rcond=1e-12, hermitian=True) @ (x.T @ y / size)
    assert abs((y @ y - beta @ (x.T @ y / size)) / exact(rows) - 1) > 1e-4  # what products would give
    per_file = ftests.factors(d.repartition(5), ["psr", "name"], ["a", "b", "c"])
    whole = ftests.fit(ftests.merge(per_file, ["psr"], 4), 4).first()
    assert abs(whole.chi2 / exact(rows) - 1) < 1e-9 and whole.dof == 207
    monkeypatch.setattr(ftests, "BLOCK", 4)  # many blocks
    for r in ftests.leave_one_out(per_file, 4).collect():
        assert abs(r.chi2 / exact([x for x in rows if x[1] != r.name]) - 1) < 1e-9 and r.dof == 200 and r.n_removed == 7


def test_triangles_of_blocks_of_any_size():
    from pulsewright.functions import kernels

    rng = np.random.default_rng(7)
    sizes = [1, 0, 3, 4, 5000, 2, 1025, 17]
    x = rng.normal(size=(sum(sizes), 3))
    got = kernels.triangles(x, np.array(sizes))
    ends = np.cumsum(sizes)
    for r, a, b in zip(got, ends - sizes, ends, strict=True):
        assert np.allclose(r.T @ r, x[a:b].T @ x[a:b]) and np.allclose(r, np.triu(r))


def test_expansion_by_stretches_is_one_pass_over_each_source(spark):
    from pulsewright.functions.kernels import expand_bins, greedy_bins

    rng = np.random.default_rng(5)
    own = [("P", float(50000 + 40 * k + rng.uniform(0, 20)), k) for k in range(12)]
    b = spark.createDataFrame([("P", k, m, m + 3.0) for _, m, k in own] + [("Q", 1, 50000.0, 50001.0)], "psr string, ord long, low double, high double")
    times = [("P", "ao", k, float(m)) for k, m in enumerate(rng.uniform(49990, 50490, 300))] + [("R", "gbt", k, 50000.0 + k) for k in range(20)]
    t = spark.createDataFrame(times, "psr string, obs string, toa_id long, mjd double")
    got = sorted((r.psr, r.low, r.high) for r in bins.expand(t, b, 6.5, 0.05, add_new=True).collect())
    start = np.array([[m, m + 3.0] for _, m, _ in own])
    free = np.array([m for p, _, _, m in times if p == "P" and not ((start[:, 0] < m) & (m < start[:, 1])).any()])
    grown, left = expand_bins(start, free, 6.5, 0.05)
    want = [("P", *x) for x in [*grown.tolist(), *greedy_bins(np.sort(left), 6.5, 0.05).tolist()]] + [("Q", 50000.0, 50001.0)]
    want += [("R", *x) for x in greedy_bins(50000.0 + np.arange(20.0), 6.5, 0.05).tolist()]
    assert got == sorted(tuple(x) for x in want)


def test_f_test_of_a_model_that_leaves_nothing(spark):
    df = spark.createDataFrame([(3.0, 100.0, 0.0, 99.0), (0.0, 100.0, 0.0, 99.0), (3.0, 100.0, 2.0, 100.0)], "a double, n double, b double, m double")
    assert [r.p for r in df.select(ftests.f_test(F.col("a"), F.col("n"), F.col("b"), F.col("m")).alias("p")).collect()] == [0.0, None, None]


def test_f_test_gives_nothing_when_not_better(spark):
    df = spark.createDataFrame([(10.0, 9.0, 5.0, 8.0), (5.0, 9.0, 10.0, 8.0), (10.0, 8.0, 5.0, 8.0)], "a double, n double, b double, m double")
    got = [r.p for r in df.select(ftests.f_test(F.col("a"), F.col("n"), F.col("b"), F.col("m")).alias("p")).collect()]
    assert 0 < got[0] < 0.1 and got[1:] == [None, None]


def test_repair_rebuilds_only_what_is_wrong(spark):
    t = spark.createDataFrame([("P", k, m) for k, m in enumerate([1.0, 2.0, 3.0, 9.0, 10.0, 20.0, 26.0, 40.0, 47.0, 60.0])] + [("Q", 1, 5.0)], "psr string, toa_id long, mjd double")
    b = spark.createDataFrame(
        [("P", 1, 0.5, 3.5), ("P", 2, 1.5, 10.5), ("P", 3, 19.0, 24.0), ("P", 4, 23.0, 27.0), ("P", 5, 30.0, 35.0), ("P", 6, 39.0, 41.0), ("P", 7, 39.5, 40.5), ("P", 8, 50.0, 45.0), ("P", 9, 59.0, 61.0), ("Q", 1, 0.0, 10.0)],
        "psr string, ord long, low double, high double",
    )
    widths = spark.createDataFrame([("P", 6.5), ("Q", 0.5)], "psr string, width double")
    got = [(r.psr, r.ord, round(r.low, 4), round(r.high, 4)) for r in bins.repair(t, b, widths).orderBy("psr", "ord").collect()]
    # 1 and 2 share times: greedy ones inside their stretch. 3 and 4 don't: edges in the middle. 5 is empty, 8 improper, 6 and 7 hold one another
    assert got == [("P", 1, 0.95, 3.05), ("P", 2, 8.95, 10.05), ("P", 3, 19.0, 23.0), ("P", 4, 23.0, 27.0), ("P", 5, 39.95, 40.05), ("P", 6, 59.0, 61.0), ("Q", 1, 0.0, 10.0)]
    whole = bins.repair(t, b, widths, cover=True)
    assert bins.check(t, whole).count() == 0 and whole.filter("low < 47 and 47 < high").count() == 1 and whole.filter("psr = 'Q'").first().high == 10.0
    kept = bins.repair(t.filter("toa_id < 3"), b.filter("ord = 1 and psr = 'P'"), widths)
    assert [(r.low, r.high) for r in kept.collect()] == [(0.5, 3.5)]
    assert bins.repair(t, b.limit(0), widths).count() == 0 and bins.check(t, bins.repair(t, b.limit(0), widths, cover=True)).count() == 0


def test_repair_of_many_tangled_bins(spark):
    rng = np.random.default_rng(8)
    own = [(p, k, float(a), float(a + rng.uniform(-1, 9))) for p in "ABC" for k, a in enumerate(rng.uniform(0, 400, 60))]
    b = spark.createDataFrame(own, "psr string, ord long, low double, high double")
    t = spark.createDataFrame([(p, k, float(m)) for p in "ABC" for k, m in enumerate(rng.uniform(0, 400, 300))], "psr string, toa_id long, mjd double")
    widths = spark.createDataFrame([("A", 6.5), ("B", 0.5), ("C", 30.0)], "psr string, width double")
    for cover in (False, True):
        fixed = bins.repair(t, b, widths, cover=cover).cache()
        left = bins.check(t, fixed).groupBy("kind").count().collect()
        assert [r.kind for r in left] == ([] if cover else ["in no bin"])
        before, after = (bins.members(t, x).select("psr", "toa_id").distinct().count() for x in (b.filter("low < high"), fixed))
        assert after == 900 if cover else before == after
    sound = [r for r in own if r[2] < r[3] and not any(r is not o and r[0] == o[0] and r[2] < o[3] and o[2] < r[3] for o in own)]
    kept = {(r.psr, r.low, r.high) for r in bins.repair(t, b, widths).collect()}
    times = [(r.psr, r.mjd) for r in t.collect()]
    assert sound and all(((p, lo, hi) in kept) == any(p == q and lo < m < hi for q, m in times) for p, _, lo, hi in sound)


def test_windows_of_a_configuration_take_effect(spark):
    rows = [("P", k, 50000.0 + k, 400.0 + 300 * (k % 2), "gbt", None, 1.0, 1.0) for k in range(40)]
    t = spark.createDataFrame(rows, "psr string, toa_id long, mjd double, freq_mhz double, obs string, cut string, err_us double, sun_angle_rad double")
    configs = spark.createDataFrame([("P", [[50011.5, 50016.5, 2.0], []])], "psr string, custom_dmx array<array<double>>")
    plain, own = (bins.setup(t, events=e, most_us=1e9)[1] for e in (None, bins.windows_of(configs)))
    near = lambda df: sorted((round(r.low, 1), round(r.high, 1)) for r in df.collect())
    assert (50014.0, 50020.0) in [(round(a + 0.05), round(b)) for a, b in near(plain)] or len(near(plain)) == 6
    narrow = [(a, b) for a, b in near(own) if 50006 < a and b < 50022]
    assert narrow and all(b - a < 2.2 for a, b in narrow if 50007.5 < a)
    assert bins.check(bins.setup(t, events=bins.windows_of(configs), most_us=1e9)[0].filter("cut is null"), own).count() == 0


def _binned(rng):
    """Rows (psr, ord, name, y, w, u, one, t, inv) of files in one bin, but for two; inv is u, which the bins' columns make up."""
    rows = []
    for p in "AB":
        for f in range(14):
            for _ in range(rng.integers(1, 6)):
                ord_ = int(rng.integers(0, 3)) if f in (3, 8) else f % 3 if f != 4 else 7
                t, u = rng.normal(), rng.uniform(0.5, 2)
                rows.append((p, ord_, f, float(2 + t + ord_ * u + rng.normal()), float(rng.uniform(0.5, 2)), float(u), 1.0, float(t), float(u)))
    return rows


def test_a_column_that_the_bins_make_up_counts_for_nothing(spark):
    """What rounding leaves of it was fitted as if it were content: one degree of freedom less, and a chi-squared by chance."""
    rows = _binned(np.random.default_rng(3))
    d = spark.createDataFrame(rows, "psr string, ord long, name long, y double, w double, u double, one double, t double, inv double")
    columns = ["u", "one", "t", "inv"]
    of_rows = {(r.psr, r.name): r for r in ftests.leave_one_out_of_rows(d, columns, unit="ord").collect()}
    of_files = {(r.psr, r.name): r for r in ftests.leave_one_out(ftests.factors(d, ["psr", "ord", "name"], columns), 5, unit="ord").collect()}
    assert len(of_rows) == len(of_files) == 28
    for (p, f), r in of_rows.items():
        left = [q for q in rows if q[0] == p and q[2] != f]
        known = sorted({q[1] for q in left})
        x = np.array([[*q[6:8], *(q[5] * (q[1] == o) for o in known)] for q in left])
        chi2, dof, _ = refit(x, np.array([q[3] for q in left]), np.array([q[4] for q in left]))
        for got in (r, of_files[p, f]):
            assert abs(got.chi2 - chi2) < 1e-8 * max(1, chi2) and got.dof == dof and got.n_removed == sum(q[0] == p and q[2] == f for q in rows)


def test_others_of_groups_of_any_size_and_bins_without_content():
    from pulsewright.functions import kernels

    rng, sizes = np.random.default_rng(5), np.array([1, 2, 3, 7, 8, 1, 30, 2, 5])
    r = np.triu(rng.normal(size=(sizes.sum(), 4, 4)))
    rest, whole = kernels.others(r, sizes)
    square = lambda f: np.einsum("kij,kil->kjl", f, f)
    for part, left, total in zip(*(np.split(x, np.cumsum(sizes)[:-1]) for x in (r, rest)), whole, strict=True):
        assert np.allclose(total.T @ total, square(part).sum(0)) and np.allclose(square(left), square(part).sum(0) - square(part))
    flat = np.triu(rng.normal(size=(2, 3, 3)))
    flat[0, :, 0] = 0.0
    left, n = kernels.projected(flat, np.array([5, 5]))
    assert n.tolist() == [5, 4] and np.allclose(left[0].T @ left[0], flat[0, :, 1:].T @ flat[0, :, 1:]) and np.allclose(left[1], flat[1, 1:, 1:])


def test_cuts_by_bins_do_not_move_rows_by_their_numbers(spark):
    """Each row looks into the few bins of its time; it was joined with all pairs of rows and bins by its number."""
    t = spark.createDataFrame([("P", k, m, 1000.0 + 300 * (k % 2), None) for k, m in enumerate((1.0, 1.5, 3.9, 4.0, 9.0, 50.0))] + [("P", 6, 1.2, 1000.0, "old"), ("Q", 7, 1.2, 1000.0, None)], "psr string, toa_id long, mjd double, freq_mhz double, cut string")
    b = spark.createDataFrame([("P", 1, 0.5, 2.0), ("P", 2, 1.4, 4.0), ("P", 3, 8.0, 10.0), ("P", 4, 49.0, 40.0)], "psr string, ord long, low double, high double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = bins.ratio_cut(t, b)
        rows = {r.toa_id: r.cut for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == {0: None, 1: None, 2: None, 3: "dmx", 4: "dmx", 5: "dmx", 6: "old", 7: "dmx"}
    assert not [line for line in plan.splitlines() if "hashpartitioning" in line and "toa_id" in line]
    held = {(r.psr, r.toa_id): sorted(r.held) for r in bins.holding(t, b, bucket=0.5).collect()}
    assert held == {("P", 0): [1], ("P", 1): [1, 2], ("P", 2): [2], ("P", 3): [], ("P", 4): [3], ("P", 5): [], ("P", 6): [1], ("Q", 7): []}


def test_rows_numbered_by_files_have_the_numbers_of_their_source(spark):
    rows = ["psr", "toa_id", "name", "mjd", "freq_mhz", "err_us", "snr", "pout"]
    a, b = toas(spark, SF), toas_by_file(spark, SF).withColumn("name", F.concat(F.lit("file_"), F.col("name").cast("string")))
    assert a.select(*rows).exceptAll(b.select(*rows)).count() == 0 and a.count() == b.count()
