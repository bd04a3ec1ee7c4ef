"""Counts and statistics by source, receiver and backend. All are plain aggregates with map-side combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsewright.operators import cuts, scan
from pulsewright.operators.settle import settled


def cut_counts(toas: DataFrame) -> DataFrame:
    """(psr, dim, value, total, cut): rows by receiver-backend, site and cut label ('good' if none); the cut dimension's total is all rows."""
    t = toas.select("psr", "f", "obs", "cut", F.coalesce("cut", F.lit("good")).alias("label"))
    by = t.groupingSets([["psr", "f"], ["psr", "obs"], ["psr", "label"]], "psr", "f", "obs", "label").agg(F.count(F.lit(1)).alias("n"), F.count("cut").alias("n_cut"), F.grouping_id().alias("sets"))
    dim = F.when(F.col("sets") == 3, "f").when(F.col("sets") == 5, "obs").otherwise("cut")  # a bit for each column that is summed over
    value = F.coalesce(F.when(F.col("sets") == 3, F.col("f")).when(F.col("sets") == 5, F.col("obs")).otherwise(F.col("label")), F.lit("good"))
    n = by.select("psr", dim.alias("dim"), value.alias("value"), "n", "n_cut")
    every = F.sum("n").over(Window.partitionBy("psr", "dim"))
    return n.select("psr", "dim", "value", F.when(F.col("dim") == "cut", every).otherwise(F.col("n")).alias("total"), F.when(F.col("dim") == "cut", F.col("n")).otherwise(F.col("n_cut")).alias("cut"))


def cut_alerts(counts: DataFrame, most: float = 75.0, least_left: float = 5.0) -> DataFrame:
    """Receiver-backends and sites with too large a share cut, and receiver-backends with too few of all rows left."""
    every = F.max(F.when(F.col("dim") == "cut", F.col("total"))).over(Window.partitionBy("psr"))
    c = counts.withColumn("every", every).filter("dim <> 'cut'").withColumn("pct", F.lit(100.0) * F.col("cut") / F.col("total")).withColumn("left_pct", F.lit(100.0) * (F.col("total") - F.col("cut")) / F.col("every"))
    alert = F.when(F.col("pct") > most, "mostly cut").when((F.col("dim") == "f") & (F.col("left_pct") < least_left), "few left")
    return c.select("psr", "dim", "value", "total", "cut", alert.alias("alert")).filter("alert is not null")


def weighted(values: str, errors: str) -> tuple[Column, Column]:
    """(Σw x, Σw) with w = err**-2."""
    w = 1 / (F.col(errors) * F.col(errors))
    return F.sum(w * F.col(values)), F.sum(w)


def residual_stats(toas: DataFrame, value: str = "resid_us", error: str = "err_us", digits: int = 6) -> DataFrame:
    """(psr, f, n, rms, wrms) by receiver-backend and for all of a source (f = 'All'); moments about each group's own mean."""
    w = 1 / (F.col(error) * F.col(error))
    t = toas.filter(F.col(value).isNotNull()).select("psr", "f", F.col(value).alias("y"), w.alias("w"))
    mid = t.groupBy("psr").agg(F.avg("y").alias("mid"))  # any number near the values does; it leaves both moments
    x = t.join(mid, "psr").select("psr", "f", (F.col("y") - F.col("mid")).alias("x"), "w")
    both = x.rollup("psr", "f").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("x").alias("rms"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("x")).alias("swx"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("swxx"), F.grouping_id().alias("g")).filter("g < 3")
    mean = F.col("swx") / F.col("sw")
    return both.select("psr", F.when(F.col("g") == 1, "All").otherwise(F.col("f")).alias("f"), "n", F.round("rms", digits).alias("rms"), F.round(F.sqrt(F.greatest(F.lit(0.0), F.col("swxx") / F.col("sw") - mean * mean)), digits).alias("wrms"))


def weighted_mean(df: DataFrame, keys: list[str], value: str, error: str, digits: int = 6) -> DataFrame:
    s, w = weighted(value, error)
    return df.filter(F.col(value).isNotNull() & (F.col(error) != 0)).groupBy(*keys).agg(F.round(s / w, digits).alias("mean"), F.round(1 / F.sqrt(w), digits).alias("mean_err"))


def orphaned_receivers(toas: DataFrame, most_files: int = 3) -> DataFrame:
    """Receiver-backends with few files."""
    return toas.groupBy("psr", "f").agg(F.count_distinct("name").alias("files")).filter(F.col("files") <= most_files)


def listed_receivers(toas: DataFrame, listed: DataFrame, most_files: int = 3) -> DataFrame:
    """(psr, f, change): receiver-backends with few files that a list (psr, f) lacks ('add'), and listed ones that aren't ('remove')."""
    have, want = orphaned_receivers(toas, most_files).select("psr", "f"), listed.select("psr", "f").distinct()
    return have.join(want, ["psr", "f"], "left_anti").withColumn("change", F.lit("add")).union(want.join(have, ["psr", "f"], "left_anti").withColumn("change", F.lit("remove")))


def unlisted(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """Files (psr, name) that no pattern (psr, pattern) is a part of."""
    met = cuts.containing(files.select("psr", "name").distinct(), patterns.select("psr", "pattern").distinct())
    return files.join(met.select("psr", "name"), ["psr", "name"], "left_anti")


def reduced_entries(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Bad rows that are still to be listed once whole files (psr, name) are."""
    return entries.join(files.select("psr", "name"), ["psr", "name"], "left_anti")


def bad_file_suggestions(toas: DataFrame, entries: DataFrame, share: float = 0.9) -> DataFrame:
    """Files of whose rows at least a share is listed as bad."""
    bad = toas.join(entries, ["psr", "name", "chan", "subint"], "left_semi").groupBy("psr", "name").agg(F.count(F.lit(1)).alias("bad"))
    every = toas.groupBy("psr", "name").agg(F.count(F.lit(1)).alias("n"))
    return every.join(bad, ["psr", "name"]).filter(F.col("bad") / F.col("n") >= share).select("psr", "name", "bad", "n")


def flux_context(toas: DataFrame) -> DataFrame:
    """Median and outer percentiles of the good rows' flux by receiver."""
    good = settled(toas.filter("cut is null").select("psr", "fe", "flux"))
    q = scan.quantiles(good.filter("fe is not null"), ["psr", "fe"], "flux", [0.05, 0.5, 0.95]).select("psr", "fe", "q")
    n = good.groupBy("psr", "fe").agg(F.count(F.lit(1)).alias("n")).join(q, ["psr", "fe"], "left")
    return n.select("psr", "fe", "n", *[F.round(F.col("q")[k], 9).alias(c) for k, c in enumerate(("flux_05", "flux_50", "flux_95"))])


def bad_toa_context(toas: DataFrame, bad: DataFrame, snr_cut: float, most_us: float = 50.0) -> DataFrame:
    """Each bad row (psr, toa_id) beside the good rows of its receiver, and what may be wrong with it: extreme flux, barely over the cut, large error."""
    b = toas.join(bad.select("psr", "toa_id").distinct(), ["psr", "toa_id"], "left_semi").join(flux_context(toas), ["psr", "fe"], "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    return b.select(
        "psr", "toa_id", "fe", "flux", "flux_05", "flux_50", "flux_95", F.coalesce("n", F.lit(0)).alias("n_good"), no((F.col("flux") < F.col("flux_05")) | (F.col("flux") > F.col("flux_95"))).alias("extreme_flux"),
        no(F.col("snr") - snr_cut < 1).alias("near_cut"), no(F.col("err_us") > most_us).alias("large_error"),
    )


def flag_values(toas: DataFrame, columns: list[str], leave_out: tuple[str, ...] = ("unknown",)) -> DataFrame:
    """(psr, vals): all values of one or more flags, sorted, but for missing and unknown ones."""
    x = toas.select("psr", F.explode(F.array(*columns)).alias("v")).filter(F.col("v").isNotNull() & ~F.col("v").isin(*leave_out))
    return x.groupBy("psr").agg(F.sort_array(F.collect_set("v")).alias("vals"))


def febe_pairs(toas: DataFrame, own: str, febe: str = "f", other: str = "sys") -> DataFrame:
    """(psr, pta, pair, n): receiver-backends, from the flag ``febe`` for the timing array ``own`` and ``other`` for the rest."""
    return toas.groupBy("psr", "pta", F.when(F.col("pta") == own, F.col(febe)).otherwise(F.col(other)).alias("pair")).agg(F.count(F.lit(1)).alias("n"))


def release_check(toas: DataFrame, column: str = "ver", old: tuple[str, ...] = ()) -> DataFrame:
    """(psr, versions, mixed, first, is_old): how many releases a source's rows come from, and whether the first is an old one."""
    g = toas.groupBy("psr").agg(F.count_distinct(column).alias("versions"), F.min(column).alias("first"))
    return g.select("psr", "versions", (F.col("versions") > 1).alias("mixed"), "first", F.col("first").isin(*old).alias("is_old"))


#: The older and the newer backend, and the year of the change.
TRANSITIONS = [("ASP", "PUPPI", 2012.1), ("GASP", "GUPPI", 2010.1)]


def transitions(toas: DataFrame, pairs: list[tuple[str, str, float]] = TRANSITIONS) -> DataFrame:
    """(psr, old, new, year) of the changes of backend of which a source has both sides."""
    have = toas.groupBy("psr").agg(*[F.bool_or((F.col("be") == a)).alias(f"a{k}") for k, (a, _, _) in enumerate(pairs)], *[F.bool_or(F.col("be") == b).alias(f"b{k}") for k, (_, b, _) in enumerate(pairs)])
    marks = [F.when(F.col(f"a{k}") & F.col(f"b{k}"), F.struct(F.lit(a).alias("old"), F.lit(b).alias("new"), F.lit(y).alias("year"))) for k, (a, b, y) in enumerate(pairs)]
    return have.select("psr", F.inline(F.filter(F.array(*marks), lambda m: m.isNotNull())))


def least_bins(toas: DataFrame, spins: DataFrame) -> DataFrame:
    """(psr, nbin, one_bin): the fewest profile bins of a row, and the seconds that one takes at the spin (psr, f0)."""
    return toas.groupBy("psr").agg(F.min("nbin").alias("nbin")).join(spins, "psr", "left").select("psr", "nbin", (1 / F.col("f0") / F.col("nbin")).alias("one_bin"))


def serials(toas: DataFrame, by_time: bool = True) -> DataFrame:
    """(psr, toa_id, serial, first_of_file): rows numbered from 1 by time or in load order, and whether a row is its file's first."""
    rows = toas.select("psr", "toa_id", "name", *(["mjd"] if by_time else []))
    out = scan.numbered(rows, ["psr"], [*(["mjd"] if by_time else []), "toa_id"], scan.of_days() if by_time else scan.of_numbers("toa_id"), "serial")
    return out.select("psr", "toa_id", "serial", (F.col("toa_id") == F.min("toa_id").over(Window.partitionBy("psr", "name"))).alias("first_of_file"))


def report_totals(report: DataFrame) -> DataFrame:
    """One row: the sums of an excision report over all sources, the outliers' share, and how many sources have many."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "cut", "outlier10", "epochdrop")]
    g = report.agg(F.count(F.lit(1)).alias("sources"), *sums, F.count_if("many").alias("sources_with_many"))
    return g.withColumn("outlier_share", F.col("outlier10") / F.nullif(F.col("total"), F.lit(0)))


def averaged_and_single(toas: DataFrame, single: Column, gap: float, ecorr: float | DataFrame = 0.0, digits: int = 6) -> DataFrame:
    """Session means of all rows but ``single`` ones, which have no correlated noise and come one by one, in the same columns."""
    one = toas.filter(single).select("psr", "f", F.lit(None).cast("long").alias("grp"), F.lit(1).cast("long").alias("n"), *[(F.round(c, digits) + F.lit(0.0)).alias(c) for c in ("mjd", "freq_mhz", "resid_us", "err_us")], F.col("toa_id").alias("first_toa"))
    return epoch_average(toas.filter(~single), gap, ecorr, digits).unionByName(one)


def span(toas: DataFrame) -> DataFrame:
    """(psr, first, last, centre, years, short): time span, its middle rounded half to even, and spans under two years."""
    s = toas.groupBy("psr").agg(F.min("mjd").alias("first"), F.max("mjd").alias("last"))
    years = (F.col("last") - F.col("first")) / F.lit(365.25)
    return s.select("psr", "first", "last", F.bround((F.col("first") + F.col("last")) / 2).alias("centre"), F.round(years, 9).alias("years"), (years < 2.0).alias("short"))


def residual_histogram(toas: DataFrame, value: str = "resid_us", bins: int = 50) -> DataFrame:
    """Counts in equal bins over each backend's own range; the last bin is closed."""
    w = Window.partitionBy("psr", "f")
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    x = toas.select("psr", "f", F.col(value).alias("x"), lo.alias("lo"), hi.alias("hi"))
    k = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    return x.select("psr", "f", k.cast("int").alias("bin")).groupBy("psr", "f", "bin").agg(F.count(F.lit(1)).alias("n"))


def excision_report(toas: DataFrame) -> DataFrame:
    """Rows of each source: all, cut as outliers, by dropped epochs, cut at all; their shares and whether outliers exceed two percent."""
    n = toas.groupBy("psr").agg(F.count(F.lit(1)).alias("total"), F.count("cut").alias("cut"), F.count_if(F.col("cut") == "outlier10").alias("outlier10"), F.count_if(F.col("cut") == "epochdrop").alias("epochdrop"))
    return n.withColumn("outlier_share", F.col("outlier10") / F.col("total")).withColumn("many", F.col("outlier_share") > 0.02)


def removed_files(toas: DataFrame, digits: int = 9) -> DataFrame:
    """(psr, name, f, day, n, esum) of each file: its first row's receiver-backend and day, its rows and summed error."""
    first = F.min(F.struct("toa_id", "f", "mjd"))
    g = toas.groupBy("psr", "name").agg(first.alias("first"), F.count(F.lit(1)).alias("n"), F.sum(1 / (F.col("err_us") * F.col("err_us"))).alias("s"))
    return g.select("psr", "name", "first.f", F.floor("first.mjd").cast("long").alias("day"), "n", F.round(1 / F.sqrt("s"), digits).alias("esum"))


def jump_attribution(toas: DataFrame, bad: Column, flags: tuple[str, ...] = ("fe", "be", "f"), of_pta: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Tallies of the bad rows' flag values: 'possible' if good rows have the value too, else 'likely'; percent of the group's tallies.

    ``of_pta`` gives timing arrays flag lists of their own, each a part of ``flags``; all others use every flag.
    """
    barred = {n: [p for p, names in (of_pta or {}).items() if n not in names] for n in flags}
    one = lambda n: F.when(~F.coalesce(F.col("pta").isin(*barred[n]), F.lit(False)), F.struct(F.lit(n).alias("flag"), F.col(n).alias("value")))
    pairs = F.explode(F.filter(F.array(*map(one, flags)), lambda p: p.isNotNull())).alias("p")
    t = toas.withColumn("bad", bad).select("pta", "bad", pairs).groupBy("pta", "p.flag", "p.value").agg(F.count_if("bad").alias("n"), F.count_if(~F.col("bad")).alias("good"))
    pct = F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy("pta"))
    return t.filter("n > 0").select("pta", "flag", "value", "n", F.when(F.col("good") > 0, "possible").otherwise("likely").alias("kind"), F.round(pct, 6).alias("pct"))


def sessions(times: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Rows numbered by group: a new group where the gap to the time before exceeds ``width``."""
    return scan.sessions(times, keys, width)


def group_dates(times: DataFrame, keys: list[str], width: float = 0.1, digits: int = 9) -> DataFrame:
    """(keys, grp, n, mean_mjd) of each session."""
    return sessions(times, keys, width).groupBy(*keys, "grp").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("mjd"), digits).alias("mean_mjd"))


def epoch_average(toas: DataFrame, gap: float, ecorr: float | DataFrame = 0.0, digits: int = 6, noise: tuple[str, ...] = (), member_ids: bool = False, error: str = "err_us") -> DataFrame:
    """Weighted means of each (psr, f) session, its error with the correlated part, and how many rows it has.

    ``ecorr`` is one number, or a frame (psr, f, ecorr): the noise that a session's rows share, by the mask of the model's
    parameters; a backend without one has none. Rows that share noise keep their weights among each other, so it adds to
    the mean's error alone. ``error`` names the errors that weigh, such as scaled ones. ``noise`` names columns of noise
    components, averaged alike; ``member_ids`` adds the rows' ids, of which a session is few.
    """
    s = sessions(toas, ["psr", "f"], gap)
    shared = F.lit(float(ecorr)) if isinstance(ecorr, (int, float)) else F.coalesce("ecorr", F.lit(0.0))
    w = 1 / (F.col(error) * F.col(error))
    sw = F.sum(w)
    mean = lambda c: F.round(F.sum(w * F.col(c)) / sw, digits) + F.lit(0.0)  # noqa: E731  no minus zero
    out = s.groupBy("psr", "f", "grp").agg(
        F.count(F.lit(1)).alias("n"), *[mean(c).alias(c) for c in ("mjd", "freq_mhz", "resid_us")], (1 / sw).alias("own"), F.min("toa_id").alias("first_toa"), *[mean(c).alias(c) for c in noise],
        *([F.sort_array(F.collect_list("toa_id")).alias("members")] if member_ids else []),
    )
    if isinstance(ecorr, DataFrame):
        out = out.join(ecorr.select("psr", "f", "ecorr"), ["psr", "f"], "left")
    err = F.round(F.sqrt(F.col("own") + shared * shared), digits).alias("err_us")
    return out.select("psr", "f", "grp", "n", "mjd", "freq_mhz", "resid_us", err, "first_toa", *noise, *(["members"] if member_ids else []))
