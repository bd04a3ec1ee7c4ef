"""Jobs and operators on small fixtures with stated results."""

import re

import pytest
from pyspark.sql import functions as F

from pulsewright import registry
from pulsewright.operators import audit, bins, cuts, ftests, noise, params, stats
from pulsewright.plans import jobs
from pulsewright.sources import text

TOA = "psr string, toa_id long, name string, chan int, subint int, mjd double, f string, fe string, be string, obs string, pta string, snr double, pout double"
IGNORE = (
    "psr string, mode string, ignore struct<orphaned_rec:array<string>,bad_group:array<struct<flag:string,value:string>>,mjd_start:double,mjd_end:double,snr_cut:double,poor_febe:array<string>,prob_outlier:double,"
    "bad_range:array<struct<lo:double,hi:double,be:string>>,orb_phase_range:array<double>,bad_file:array<struct<pattern:string,reason:string>>,bad_toa:array<struct<name:string,chan:int,subint:int,reason:string>>,bad_toa_averaged:array<string>>"
)


def toas(spark, *rows):
    base = {"psr": "P", "name": "n", "chan": 1, "subint": 0, "mjd": 55000.0, "f": "L_X", "fe": "L", "be": "X", "obs": "ao", "pta": "N", "snr": 20.0, "pout": None}
    return spark.createDataFrame([tuple((base | {"toa_id": k} | r)[c.split()[0]] for c in TOA.split(", ")) for k, r in enumerate(rows)], TOA)


def config(spark, psr="P", mode="NB", **rules):
    names = ["orphaned_rec", "bad_group", "mjd_start", "mjd_end", "snr_cut", "poor_febe", "prob_outlier", "bad_range", "orb_phase_range", "bad_file", "bad_toa", "bad_toa_averaged"]
    return spark.createDataFrame([(psr, mode, tuple(rules.get(n) for n in names))], IGNORE)


def reasons(df):
    return [r.cut for r in df.orderBy("psr", "toa_id").collect()]


def test_each_rule_of_a_configuration_and_their_order(spark):
    t = toas(
        spark, {}, {"f": "S_X"}, {"obs": "gbt"}, {"mjd": 49999.0}, {"mjd": 60001.0}, {"snr": 7.9}, {"snr": None}, {"f": "U_X"}, {"pout": 0.2}, {"name": "bad_one"}, {"mjd": 56000.0}, {"mjd": 56000.0, "be": "Y"}, {"mjd": 55002.25},
        {"name": "m", "chan": 3}, {"name": "m", "chan": 3}, {"name": "avg"}, {"name": "avg"}, {"f": "S_X", "snr": 1.0}, {"name": "bad_one", "snr": 1.0}, {"name": "m", "chan": 4}, {"name": "seen", "snr": 1.0},
    )
    c = config(
        spark, orphaned_rec=["S_X"], bad_group=[("obs", "gbt")], mjd_start=50000.0, mjd_end=60000.0, snr_cut=8.0, poor_febe=["U_X"], prob_outlier=0.1, bad_range=[(55999.0, 56001.0, "X")], orb_phase_range=[0.2, 0.3],
        bad_file=[("bad_", "why"), ("e", None), ("nowhere", None)], bad_toa=[("m", 3, 0, "why"), ("seen", 1, 0, None), ("none", 1, 0, None)], bad_toa_averaged=["avg"],
    )
    orbits = spark.createDataFrame([("P", 9.0, 55000.0)], "psr string, pb double, epoch double")
    got = reasons(jobs.ignored(t, c, orbits))
    assert got == [
        None, "orphaned", "badgroup", "mjdstart", "mjdend", "snr", None, "poorfebe", "outlier10", "badfile", "badrange", None, "eclipsing", "badtoa", None, "badtoa-averaged", None, "orphaned", "snr", None, "snr",
    ]


def test_wideband_entries_and_sources_without_rules(spark):
    t = toas(spark, {"name": "w", "chan": None, "subint": 2}, {"name": "w", "chan": None, "subint": 2}, {"psr": "Q", "snr": 0.0}, {"psr": "R", "snr": 0.0, "pout": 1.0})
    c = config(spark, mode="WB", bad_toa=[("w", None, 2, None)]).union(config(spark, psr="Q"))
    assert reasons(jobs.ignored(t, c)) == ["badtoa", None, None, None]
    assert reasons(jobs.ignored(t.withColumn("cut", F.lit("old")), c)) == ["old"] * 4
    assert jobs.ignored(t.limit(0), c).count() == 0


def test_configured_curation_by_stages(spark):
    t = toas(spark, {"be": "X"}, {"be": "Y"}, {"name": "bad", "chan": 3}, {"name": "bad", "chan": 3}, {"psr": "Q", "name": "w", "snr": 1.0}, {"psr": "Q", "name": "w"}, {"psr": "Q", "name": "w", "mjd": 55001.5})
    t = t.withColumns({"freq_mhz": F.lit(1400.0), "bw_mhz": F.lit(10.0), "pp_dm": F.when(F.col("toa_id") != 5, 10.0)})
    c = config(spark, bad_file=[("bad", "why")], bad_toa=[("bad", 3, 0, "why")]).union(config(spark, psr="Q", mode="WB", snr_cut=8.0, bad_toa_averaged=["w"], orb_phase_range=[0.4, 0.6], orphaned_rec=["S_X"]))
    orbits = spark.createDataFrame([("Q", 55000.0, None, 1 / (3 * 86400.0))], "psr string, epoch double, pb double, fb0 double")
    got, changes = jobs.curate_configured(t, c, "X", "Y", orbits)
    assert reasons(got) == [None, "simul", "badtoa", "badfile", "snr", "no_ppdm", "eclipsing"]
    assert {tuple(r) for r in changes.collect()} == {("P", "L_X", "add"), ("Q", "L_X", "add"), ("Q", "S_X", "remove")}
    plan = jobs.ignored(t, c, orbits)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") <= 14


def test_files_include_files(spark):
    rows = [("/d/a.tim", 0, "INCLUDE b.tim"), ("/d/b.tim", 0, "x 1 2 3 4"), ("/d/b.tim", 1, "INCLUDE c.tim"), ("/d/b.tim", 2, "INCLUDE gone.tim"), ("/d/c.tim", 0, "y 1 2 3 4"), ("/e/c.tim", 0, "z 1 2 3 4")]
    lines = spark.createDataFrame(rows, "path string, line_no int, value string")
    assert {(r.path, r.source, r.value[0]) for r in text.follow_includes(lines).collect()} == {("/d/a.tim", "/d/b.tim", "x"), ("/d/a.tim", "/d/c.tim", "y"), ("/e/c.tim", "/e/c.tim", "z")}
    assert text.follow_includes(lines, deepest=2).count() == 3
    for bad, deepest in ((lines, 1), (spark.createDataFrame([("/a", 0, "INCLUDE b"), ("/b", 0, "INCLUDE a")], lines.schema), 8), (spark.createDataFrame([("/r", 0, "INCLUDE a"), ("/a", 0, "INCLUDE b"), ("/b", 0, "INCLUDE a")], lines.schema), 4)):
        with pytest.raises(ValueError):
            text.follow_includes(bad, deepest)


def test_event_windows_get_bins_of_their_own_width(spark):
    t = spark.createDataFrame([("P", m) for m in (100.0, 100.75, 101.5, 200.0, 200.75)] + [("Q", 100.0), ("Q", 100.75)], "psr string, mjd double")
    b = spark.createDataFrame([("P", 1, 99.0, 102.0), ("P", 2, 199.0, 202.0), ("Q", 1, 99.0, 102.0)], "psr string, ord long, low double, high double")
    events = spark.createDataFrame([("P", 101.0, 110.0, 1.0)], "psr string, from_mjd double, to_mjd double, width double")
    got = [(r.psr, r.ord, round(r.low, 6), round(r.high, 6)) for r in bins.rebin_events(t, b, events).orderBy("psr", "ord").collect()]
    assert got == [("P", 1, 100.0, 100.75), ("P", 2, 101.5, 101.5), ("P", 3, 199.0, 202.0), ("Q", 1, 99.0, 102.0)]


def test_frequency_ratio_rows_and_their_complement(spark):
    t = spark.createDataFrame([("P", 1, 1.0, 100.0), ("P", 2, 2.0, 120.0), ("P", 3, 11.0, 100.0), ("P", 4, 50.0, 100.0)], "psr string, toa_id long, mjd double, freq_mhz double")
    b = spark.createDataFrame([("P", 1, 0.0, 5.0), ("P", 2, 10.0, 15.0)], "psr string, ord long, low double, high double")
    ids = lambda **k: sorted(r.toa_id for r in bins.ratio_rows(t, b, **k).collect())
    assert ids() == [1, 2] and ids(invert=True) == [3, 4] and ids(ratio=1.3) == [] and ids(ratio=1.3, invert=True) == [1, 2, 3, 4]


def test_epochs_far_from_the_data(spark):
    s = spark.createDataFrame([(p, 55000.0) for p in "ABC"], "psr string, centre double")
    p = spark.createDataFrame([("A", "PEPOCH", 55001.5), ("A", "T0", 55010.5), ("A", "PB", 10.0), ("B", "PEPOCH", 55001.0), ("B", "TASC", 55002.5), ("B", "FB0", 1 / 86400.0), ("C", "TASC", 1.0)], "psr string, name string, value double")
    assert {(r.psr, r["name"]) for r in params.far_epochs(s, p).collect()} == {("A", "PEPOCH"), ("B", "TASC")}


def test_largest_change_takes_the_last_of_equal_ones(spark):
    rows = [("P", 1, "A", 1.0, 2.0, 1.0), ("P", 2, "B", 3.0, 2.0, 1.0), ("P", 3, "C", None, 2.0, 1.0), ("P", 4, "D", 9.0, 2.0, 0.0), ("Q", 1, "A", None, 1.0, 1.0)]
    got = params.largest_change(spark.createDataFrame(rows, "psr string, ord int, name string, initial double, value double, uncertainty double"))
    assert {tuple(r) for r in got.collect()} == {("P", "B", 1.0, 2, 1), ("Q", None, None, 0, 1)}


def test_fit_status(spark):
    rows = [("a", 5.0, 5.0, None), ("b", 5.0, 5.005, False), ("c", 5.0, 6.0, False), ("d", 6.0, 5.0, None), ("e", 6.0, 5.0, True)]
    got = params.fit_status(spark.createDataFrame(rows, "psr string, before double, after double, converged boolean")).orderBy("psr").collect()
    assert [(r.status, r.fully_fitted) for r in got] == [("probably converged", True), ("probably converged", True), ("increased", True), ("may not have converged", False), ("converged", False)]


def test_recommendations_name_one_frequency_term_each_way(spark):
    rows = [("P", "FD1", "FD", "remove", 0.5, 1), ("P", "FD2", "FD", "remove", 0.4, 2), ("P", "FD4", "FD", "add", 0.001, 3), ("P", "PX", "other", "remove", 0.9, 4), ("P", "F2", "other", "add", 0.001, 5), ("P", "FB1+", "FB", "remove", 0.5, 6), ("P", "FB3", "FB", "add", 0.0, 7)]
    got = ftests.recommend(spark.createDataFrame(rows, "psr string, label string, family string, action string, ft double, ord int"))
    assert {(r.action, r.label) for r in got.collect()} == {("remove", "FD2"), ("add", "FD4"), ("remove", "FB1+")}
    lines = ftests.report_lines(spark.createDataFrame([("P", "a", None, None, None), ("P", "b", 1.0, 3, None), ("P", "c", 1.0, 3, 0.001), ("P", "d", 1.0, 3, 0.5)], "psr string, label string, chi2 double, dof int, ft double"))
    assert [r.mark for r in lines.orderBy("label").collect()] == ["NaN", "xxx", "***", "--"] and "NaN" in lines.filter("label = 'a'").first().line


def test_uncertainties_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = np.c_[np.ones(40), rng.normal(size=(40, 2))]
    w, y = rng.uniform(0.5, 2, 40), rng.normal(size=40)
    rows = spark.createDataFrame([("P", *map(float, a), float(b), float(c)) for a, b, c in zip(x, w, y, strict=True)], "psr string, a double, b double, c double, w double, y double")
    g = ftests.factors(rows, ["psr"], ["a", "b", "c"])
    assert np.allclose(ftests.fit(g, 4).first().sigma, np.sqrt(np.diag(np.linalg.inv(x.T @ (w[:, None] * x)))))
    beta = np.linalg.solve(x.T @ (w[:, None] * x), x.T @ (w * y))
    got = [r.post for r in ftests.post_fit(rows, ftests.fit(g, 4), ["a", "b", "c"]).select("post", "y").collect()]
    assert np.allclose(sorted(got), sorted(y - x @ beta))


def test_places_of_the_chain_and_newest_models(spark):
    rows = [("/a/P_nb/", "P", "NB"), ("/a", "P", "WB"), ("/a/P_nb", "P", "wb")]
    d = spark.createDataFrame(rows, "root string, psr string, mode string").select("root", text.chain_folder(F.col("root"), F.col("psr"), F.col("mode")).alias("x"), text.of_chain_folder(F.col("root")).alias("of"))
    assert [r.x for r in d.collect()] == ["/a/P_nb/", "/a/P_wb/", "/a/P_nb/P_wb/"] and tuple(d.first().of) == ("P", "nb") and tuple(d.filter("root = '/a'").first().of) == (None, None)
    files = spark.createDataFrame([("P_X_20200101.nb.par",), ("P_X_20210101.nb.par",), ("P_X_20210101.wb.par",), ("notes.txt",)], "file string")
    assert {tuple(r) for r in text.latest_files(files).collect()} == {("P", "nb", "P_X_20210101.nb.par", "P_X_20200101.nb.par", 2), ("P", "wb", "P_X_20210101.wb.par", None, 1)}


def test_draws_depend_on_the_seed_and_the_row_alone(spark):
    n = spark.createDataFrame([("P", f"x{k}") for k in range(400)], "psr string, name string")
    none = spark.createDataFrame([], "psr string, name string, value double")
    draw = lambda df, seed: {r["name"]: r.start for r in noise.start_values(df, none, F.lit(2.0), F.lit(4.0), seed).collect()}
    one = draw(n, 1)
    assert one == draw(n.repartition(7), 1) and one != draw(n, 2) and all(2 <= v < 4 for v in one.values()) and 2.9 < sum(one.values()) / 400 < 3.1


def test_start_values_of_repeated_names_are_dealt_out(spark):
    n = spark.range(6000).selectExpr("'P' as psr", "if(id < 5990, 'x', concat('y', id)) as name", "cast(id as double) as value")
    best = n.filter("name = 'x'").limit(400).selectExpr("psr", "name", "value % 2 as value").union(spark.createDataFrame([("P", "y5999", 7.0), ("P", "y5998", None)], "psr string, name string, value double"))
    got = noise.start_values(n, best, F.lit(2.0), F.lit(4.0), 1)
    plain = n.join(best.withColumnRenamed("value", "best"), ["psr", "name"], "left").groupBy("name", "best").count()
    want = {(r["name"], r.best): r["count"] for r in plain.collect()}
    have = {(r["name"], r.start if r.from_chain else None): r["count"] for r in got.groupBy("name", "start", "from_chain").count().collect()}
    assert have == want and sum(want.values()) == 5990 * 400 + 10
    parts = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(parts) >= 3 and max(parts) < 1_500_000


def test_listed_receivers_and_entries(spark):
    t = spark.createDataFrame([("P", "A", f"n{k}") for k in range(5)] + [("P", "B", "n0")], "psr string, f string, name string")
    listed = spark.createDataFrame([("P", "A"), ("P", "C")], "psr string, f string")
    assert {tuple(r) for r in stats.listed_receivers(t, listed).collect()} == {("P", "B", "add"), ("P", "A", "remove"), ("P", "C", "remove")}
    with pytest.raises(ValueError):
        audit.append_entry(t, "OOPS", "n", "me", "2020-01-01", tags=["INIT"])
    assert [r.x for r in spark.createDataFrame([("Rcvr_800_GUPPI",), ("L-wide_PUPPI",), ("S",)], "f string").select(cuts.receiver_of("f").alias("x")).collect()] == ["Rcvr_800", "L-wide", "S"]


def test_burn_in_of_chains_with_gaps_and_repeats(spark):
    import random

    chains = {"a": random.Random(3).sample(range(100000), 400), "b": list(range(7)), "c": [5], "d": [1, 2, 3, 3, 3, 9]}
    df = spark.createDataFrame([(c, s, [float(s)]) for c, ss in chains.items() for s in ss] + [("e", None, [0.0])], "chain string, sample long, vals array<double>")
    for burn, parts in ((0.25, 1024), (0.25, 3), (0.5, 1), (0.0, 16), (1.0, 16)):
        got = {}
        for r in noise.after_burn(df, burn, parts).collect():
            got.setdefault(r.chain, []).append(r.sample)
        want = {c: [s for s in sorted(ss) if s >= sorted(ss)[int(len(ss) * burn)]] for c, ss in chains.items() if int(len(ss) * burn) < len(ss)}
        assert {c: sorted(v) for c, v in got.items()} == want


def test_candidates_of_each_binary_model(spark):
    """Rows as the surveyed tests state them: what is fitted is removed, what isn't is added, pairs together only."""
    models = spark.createDataFrame([("a", "DD"), ("b", "BT"), ("c", "DDK"), ("d", "ELL1"), ("e", "ELL1"), ("f", "ELL1H"), ("g", "XYZ"), ("h", None)], "psr string, model string")
    rows = [("a", "M2", False), ("a", "SINI", False), ("a", "PBDOT", True), ("b", "M2", False), ("b", "OMDOT", False), ("d", "PB", False), ("e", "FB0", False), ("e", "EPS1DOT", False), ("e", "EPS2DOT", False), ("f", "H3", False), ("f", "H4", False), ("c", "FD1", False), ("c", "FD2", True)]
    got = {}
    for r in ftests.candidates(models, spark.createDataFrame(rows, "psr string, name string, frozen boolean"), fd=2).collect():
        got.setdefault(r.psr, set()).add((r.action, r.label))
    fd = {("add", "FD1"), ("add", "FD2")}
    assert got == {
        "a": {("remove", "M2+SINI"), ("add", "PBDOT"), ("add", "A1DOT"), ("add", "OMDOT"), ("add", "EDOT")} | fd,
        "b": {("remove", "OMDOT"), ("add", "PBDOT"), ("add", "A1DOT"), ("add", "EDOT")} | fd,
        "c": {("add", "M2+SINI"), ("add", "PBDOT"), ("add", "A1DOT"), ("add", "OMDOT"), ("add", "EDOT"), ("remove", "FD1"), ("remove", "FD2")},
        "d": {("add", "M2+SINI"), ("add", "PBDOT"), ("add", "A1DOT"), ("add", "EPS1DOT+EPS2DOT")} | fd,
        "e": {("add", "A1DOT"), ("remove", "EPS1DOT+EPS2DOT")} | fd,
        "f": {("remove", "H4"), ("remove", "H3+H4"), ("add", "PBDOT"), ("add", "A1DOT"), ("add", "EPS1DOT+EPS2DOT")} | fd,
        "g": fd, "h": fd,
    }


def test_cut_counts_are_one_aggregate(spark):
    t = toas(spark, {}, {"f": "S_X"}, {"obs": None}).withColumn("cut", F.when(F.col("toa_id") == 1, "snr"))
    c = stats.cut_counts(t)
    assert "Generate" not in c._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in c.collect()} == {("P", "f", "L_X", 2, 0), ("P", "f", "S_X", 1, 1), ("P", "obs", "ao", 2, 1), ("P", "obs", "good", 1, 0), ("P", "cut", "good", 3, 2), ("P", "cut", "snr", 3, 1)}


def test_timing_checks_read_observations_and_model_once(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # joins as on large tables
    try:
        df = registry.QUERIES["job_timing_checks"](spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert not any("lineitem" in f for f in df.inputFiles())  # made once before, not by every check
    by_name = re.findall(r"hashpartitioning\(psr#\d+, name#\d+", plan)
    assert len(by_name) == 2  # the two models that are compared; rules look into a source's row


def test_rules_see_repeated_and_odd_parameters(spark):
    rows = [("A", "ELONG", False), ("A", "ELAT", True), ("A", "ELAT", True), ("A", "PX", None), ("A", None, True), ("B", "RAJ", False), ("B", "M2", False), ("B", "T0", True), ("B", "T0", False)]
    p = spark.createDataFrame(rows, "psr string, name string, frozen boolean")
    s = spark.createDataFrame([("A",), ("A",), ("C",)], "psr string")
    said = lambda df: sorted(tuple(r) for r in df.collect())
    assert said(params.required(p, s, ["PX", "ELAT"])) == [("A", "ELAT", "not fitted"), ("A", "ELAT", "not fitted"), ("A", "PX", "missing"), ("C", "ELAT", "missing"), ("C", "PX", "missing")]
    assert [r for r in said(params.astrometry_check(p, s)) if r[1] == "FRAME"] == [("C", "FRAME", "no frame")]
    m = spark.createDataFrame([("B", "T2"), ("B", "T2"), ("B", "DD"), ("B", None)], "psr string, model string")
    lost = ["A1", "ECC", "OM", "PB"]  # of both models
    want = [("B", n, "missing") for n in [*lost, *lost, "KIN", "KOM"]] + [("B", "T0", "not fitted")] * 2 + [("B", "M2+SINI", "one of a pair")]
    assert said(params.binary_check(p, m)) == sorted(want)
