import pytest
from pyspark.sql import functions as F

from pulsewright.operators import cuts, params, stats

SCHEMA = "psr string, toa_id long, name string, chan int, subint int, mjd double, freq_mhz double, bw_mhz double, fe string, be string, snr double, pout double, resid_us double, err_us double, dm_resid double, cut string"


def frame(spark, *rows):
    base = {"psr": "P", "name": "f", "chan": 1, "subint": 0, "mjd": 50000.5, "freq_mhz": 1400.0, "bw_mhz": 10.0, "fe": "L", "be": "NEW", "snr": 20.0, "pout": None, "resid_us": 0.0, "err_us": 1.0, "dm_resid": 0.0, "cut": None}
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple((base | {"toa_id": k} | r)[n] for n in names) for k, r in enumerate(rows)], SCHEMA)


def reasons(df):
    return [r.cut for r in df.orderBy("toa_id").collect()]


def test_thresholds_are_strict_and_missing_values_stay(spark):
    t = frame(spark, {"snr": 8.0}, {"snr": 7.99}, {"snr": None}, {"mjd": 100.0}, {"mjd": 99.0}, {"pout": 0.1}, {"pout": 0.2}, {"snr": 1.0, "mjd": 1.0})
    got = cuts.apply_rules(t.drop("cut"), [cuts.mjd_reason(F.lit(100.0), F.lit(60000.0)), cuts.snr_reason(8.0), cuts.outlier_reason(0.1)])
    assert reasons(got) == [None, "snr", None, None, "mjdstart", None, "outlier10", "mjdstart"]


def test_first_reason_stays(spark):
    t = frame(spark, {"snr": 1.0, "cut": "old"}, {"snr": 1.0})
    once = cuts.apply_rules(t, [cuts.snr_reason(8.0)])
    assert reasons(once) == ["old", "snr"] and reasons(cuts.apply_rules(once, [cuts.snr_reason(50.0)])) == ["old", "snr"]


def test_touching_bands_overlap_and_cut_losers_mark_nothing(spark):
    t = frame(spark, {"be": "NEW", "freq_mhz": 1400.0}, {"be": "OLD", "freq_mhz": 1410.0}, {"be": "OLD", "freq_mhz": 1410.1}, {"be": "OLD", "mjd": 50001.5}, {"be": "NEW", "fe": "S"}, {"be": "OLD", "fe": "S", "cut": "snr"}, {"be": "OLD", "bw_mhz": None, "freq_mhz": 1405.0})
    got = cuts.simultaneous(t, "NEW", "OLD").orderBy("toa_id").collect()
    assert [r.simul for r in got] == ["1", "2", None, None, None, None, "2"]
    assert [r.cut for r in got] == [None, "simul", None, None, None, "snr", "simul"]


def test_file_outliers_round_half_to_even(spark):
    rows = [{"name": "a", "cut": "outlier10"}] * 2 + [{"name": "a"}] * 23 + [{"name": "b", "cut": "outlier10"}] * 3 + [{"name": "b"}] * 22 + [{"name": "c", "cut": "outlier10"}] + [{"name": "c"}] * 2
    got = cuts.file_outliers(frame(spark, *rows)).groupBy("name").agg(F.count_if(F.col("cut") == "maxout").alias("n"))
    assert {r["name"]: r.n for r in got.collect()} == {"a": 0, "b": 22, "c": 2}


def test_bad_entries(spark):
    t = frame(spark, {"name": "x1", "chan": 1}, {"name": "x1", "chan": 1}, {"name": "x2", "chan": 2, "cut": "snr"})
    e = spark.createDataFrame([("P", "x1", 1, 0), ("P", "x2", 2, 0), ("P", "zz", 1, 0)], "psr string, name string, chan int, subint int")
    assert {(r["name"], r.toa_id, r.status) for r in cuts.bad_toas(t, e).collect()} == {("x1", 0, "badtoa"), ("x2", 2, "already cut"), ("zz", None, "unmatched")}
    files = spark.createDataFrame([("P", "x"), ("P", "x1"), ("P", "x2"), ("P", "nope")], "psr string, pattern string")
    assert {(r.pattern, r.files, r["name"], r.status) for r in cuts.bad_files(t, files).collect()} == {("x", 2, None, "not one file"), ("x1", 1, "x1", "cut"), ("x2", 1, "x2", "redundant"), ("nope", 0, None, "not one file")}


def test_large_residuals(spark):
    t = frame(spark, {"resid_us": 5.0}, {"resid_us": 5.0, "err_us": 4.0}, {"err_us": 9.0}, {"dm_resid": 3.0}, {"dm_resid": 3.0, "be": "GASP"})
    flags = lambda **k: [r.x for r in t.select("toa_id", cuts.large_residuals(**k).alias("x")).orderBy("toa_id").collect()]
    assert flags(us=4.0, n_sigma=3.0, max_sigma=8.0) == [True, False, True, False, False]
    assert flags(dm=2.0) == [False, False, False, True, False]
    with pytest.raises(ValueError):
        cuts.large_residuals()


def test_sessions_split_only_above_the_gap(spark):
    t = spark.createDataFrame([("P", m) for m in (0.0, 0.125, 0.25, 0.5)], "psr string, mjd double")
    assert [(r.grp, r.n) for r in stats.group_dates(t, ["psr"], 0.125).orderBy("grp").collect()] == [(1, 3), (2, 1)]


def test_jumps(spark):
    r = spark.createDataFrame([("P", "A"), ("P", "B"), ("P", "C"), ("Q", "A")], "psr string, fe string")
    j = spark.createDataFrame([("P", "A")], "psr string, fe string")
    assert [(x.psr, x.mask_value) for x in params.missing_jumps(r, j).collect()] == [("P", "B")]
    assert {(x.psr, x.mask_value) for x in params.missing_jumps(r, j, all_need=True).collect()} == {("P", "B"), ("P", "C"), ("Q", "A")}


def test_large_residuals_hold_both_kinds_to_the_same_rules(spark):
    rows = [(0, 5.0, 1.0, 0.0, 0.001, "GUPPI"), (1, 5.0, 2.0, 0.0, 0.001, "GUPPI"), (2, 0.0, 9.0, 0.0, 0.001, "GUPPI"), (3, 0.0, 1.0, 0.5, 0.1, "GUPPI"), (4, 0.0, 1.0, 0.5, 0.2, "GUPPI"), (5, 0.0, 1.0, 0.0, 9.0, "GUPPI"), (6, 0.0, 1.0, 0.5, 0.1, "GASP"), (7, 0.0, 1.0, None, None, "GUPPI")]
    t = spark.createDataFrame(rows, "id int, resid_us double, err_us double, dm_resid double, dm_err double, be string")
    got = lambda **k: [r.id for r in t.filter(cuts.large_residuals(**k)).orderBy("id").collect()]
    assert got(us=4.0) == [0, 1] and got(us=4.0, n_sigma=3.0) == [0] and got(us=4.0, n_sigma=3.0, max_sigma=8.0) == [0, 2]
    assert got(dm=0.4) == [3, 4] and got(dm=0.4, n_sigma=3.0) == [3] and got(dm=0.4, n_sigma=3.0, max_sigma=8.0) == [3, 5]
    assert got(us=4.0, dm=0.4, asp_dms=True) == [0, 1, 3, 4, 6]
