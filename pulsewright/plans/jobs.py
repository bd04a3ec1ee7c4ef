"""Whole jobs: the operators in the order in which a release is made, over all sources at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsewright.functions import scalar
from pulsewright.operators import audit, bins, cuts, ftests, noise, params, stats
from pulsewright.operators.settle import settled
from pulsewright.sources import text
from pulsewright.sources.configs import excised_reasons
from pulsewright.sources.configs import rules as config_rules


def curate(toas: DataFrame, reasons: list[Column], keep: str | None = None, lose: str | None = None, bad_entries: DataFrame | None = None) -> DataFrame:
    """Observations with ``cut``: simultaneous ones first, then the rules in order, then listed single rows."""
    t = toas if "cut" in toas.columns else toas.withColumn("cut", F.lit(None).cast("string"))
    if keep and lose:
        t = cuts.simultaneous(t, keep, lose)
    t = cuts.apply_rules(t, reasons)
    if bad_entries is not None:
        hit = cuts.bad_toas(t, bad_entries).filter("status = 'badtoa'").select("psr", "toa_id")
        t = cuts.apply_rules(cuts.listed(t, hit, ["psr", "toa_id"], "listed"), [cuts.reason(F.col("listed"), "badtoa")]).drop("listed")
    return t


#: The order of reasons in one pass over a configuration, and in a curation by stages: first keys, then dispersion measures, then what was listed by hand.
AT_ONCE = ["orphaned", "badgroup", "mjd", "snr", "poorfebe", "outlier", "badfile", "badrange", "eclipsing", "badtoa", "badtoa-averaged"]
IN_STAGES = ["orphaned", "badgroup", "mjd", "snr", "poorfebe", "outlier", "badrange", "eclipsing", "no_ppdm", "badtoa", "badtoa-averaged", "badfile"]


def _of_files(toas: DataFrame, configs: DataFrame) -> DataFrame:
    """(psr, name, bad_file, entries, averaged) of every file that a configuration names: as a whole, by single rows, by its first row."""
    names = toas.select("psr", "name").distinct().withColumn("cut", F.lit(None).cast("string"))
    whole = cuts.bad_files(names, config_rules(configs, "bad_file").select("psr", "pattern")).filter("files = 1")
    single = config_rules(configs, "bad_toa").select("psr", "name", F.struct("chan", "subint").alias("entry"))
    first = configs.select("psr", F.explode("ignore.bad_toa_averaged").alias("name"))
    none = F.lit(None).cast(single.schema["entry"].dataType)
    parts = [
        whole.select("psr", "name", none.alias("entry"), F.lit(True).alias("bad_file"), F.lit(False).alias("averaged")), single.select("psr", "name", "entry", F.lit(False).alias("bad_file"), F.lit(False).alias("averaged")),
        first.select("psr", "name", none.alias("entry"), F.lit(False).alias("bad_file"), F.lit(True).alias("averaged")),
    ]
    return reduce(DataFrame.union, parts).groupBy("psr", "name").agg(F.bool_or("bad_file").alias("_bad_file"), F.collect_set("entry").alias("_entries"), F.bool_or("averaged").alias("_averaged"))


def _phase(orbits: DataFrame) -> Column:
    """Orbital phase of a row beside ``orbits`` (psr, pb or fb0, epoch, pbdot): by the period and its derivative, or by the frequency."""
    of = lambda c: F.col(f"_{c}") if c in orbits.columns else F.lit(None).cast("double")
    by_period = scalar.orbital_phase(F.col("mjd"), of("epoch"), of("pb"), F.coalesce(of("pbdot"), F.lit(0.0)))
    return F.coalesce(by_period, scalar.orbital_phase_fb(F.col("mjd"), of("epoch"), of("fb0")))


def ignored(toas: DataFrame, configs: DataFrame, orbits: DataFrame | None = None, order: list[str] = AT_ONCE) -> DataFrame:
    """Observations with ``cut`` by what each source's configuration (psr, mode, ignore) leaves out; the first reason stays.

    In this order, unless ``order`` says otherwise: orphaned, badgroup, mjdstart, mjdend, snr, poorfebe, outlierNN, badfile,
    badrange, eclipsing, badtoa, badtoa-averaged; no_ppdm is for wideband sources and only where ``order`` has it. A source
    has one configuration; without one nothing of it is cut, and a rule without a value cuts nothing. ``orbits`` (psr,
    epoch, and pb with pbdot or fb0) is needed for eclipses. Narrowband entries of single rows name file, channel and
    subint, wideband ones file and subint; the first row that an entry names is meant. Flags of groups are columns.

    Each source's rules ride beside its rows, and what is said of a file comes with the file, the numbers of the rows that
    its entries mean among it. These are looked for in the files alone that have entries, so no row is sorted.
    """
    configs = settled(configs)
    names = ["orphaned_rec", "bad_group", "mjd_start", "mjd_end", "snr_cut", "poor_febe", "prob_outlier", "bad_range", "orb_phase_range"]
    one = settled(configs.select("psr", (F.lower("mode") == "wb").alias("_wideband"), *[F.col(f"ignore.{n}").alias(f"_{n}") for n in names]))
    before = [F.col("cut")] if "cut" in toas.columns else []
    said = settled(_of_files(toas, configs))
    wide, yes = F.coalesce("_wideband", F.lit(False)), lambda c: F.coalesce(c, F.lit(False))
    flags = [c for c in ("f", "fe", "be", "obs", "pta") if c in toas.columns]
    value = F.create_map(*[x for c in flags for x in (F.lit(c), F.col(c).cast("string"))])
    group = F.exists("_bad_group", lambda g: value[g["flag"]] == g["value"])
    inside = F.exists("_bad_range", lambda r: (r["lo"] < F.col("mjd")) & (F.col("mjd") < r["hi"]) & (r["be"].isNull() | (r["be"] == F.col("be"))))
    outlier = F.concat(F.lit("outlier"), (F.col("_prob_outlier") * 100).cast("int").cast("string"))
    named = F.exists("_entries", lambda e: (e["subint"] == F.col("subint")) & (wide | (e["chan"] == F.col("chan"))))
    rows = toas.select("psr", "name", "chan", "subint", "toa_id").join(said.filter(F.col("_averaged") | (F.size("_entries") > 0)), ["psr", "name"]).join(one.select("psr", "_wideband"), "psr", "left")
    alike = rows.groupBy("psr", "name", "subint", F.when(~wide, F.col("chan")).alias("_of_chan")).agg(F.min("toa_id").alias("_first"), F.bool_or(yes(named)).alias("_named"))
    firsts = alike.groupBy("psr", "name").agg(F.collect_set(F.when(F.col("_named"), F.col("_first"))).alias("_firsts"), F.min("_first").alias("_first_of_all"))
    said = settled(said.join(firsts, ["psr", "name"], "left").select("psr", "name", "_bad_file", "_averaged", "_firsts", "_first_of_all"))
    t = toas.join(one, "psr", "left").join(said, ["psr", "name"], "left")
    reasons = {
        "orphaned": cuts.reason(F.array_contains("_orphaned_rec", F.col("f")), "orphaned"), "badgroup": cuts.reason(group, "badgroup"), "mjd": cuts.mjd_reason(F.col("_mjd_start"), F.col("_mjd_end")), "snr": cuts.snr_reason(F.col("_snr_cut")),
        "poorfebe": cuts.reason(F.array_contains("_poor_febe", F.col("f")), "poorfebe"), "outlier": cuts.reason(F.coalesce("pout", F.lit(0.0)) > F.col("_prob_outlier"), outlier),
        "badfile": cuts.reason(yes(F.col("_bad_file")), "badfile"), "badrange": cuts.reason(inside, "badrange"), "badtoa": cuts.reason(F.array_contains("_firsts", F.col("toa_id")), "badtoa"),
        "badtoa-averaged": cuts.reason(yes(F.col("_averaged")) & (F.col("toa_id") == F.col("_first_of_all")), "badtoa-averaged"),
    }
    if "no_ppdm" in order:
        reasons["no_ppdm"] = cuts.reason(wide & F.col("pp_dm").isNull(), "no_ppdm")
    if orbits is not None:
        t = t.join(orbits.select("psr", *[F.col(c).alias(f"_{c}") for c in orbits.columns if c != "psr"]), "psr", "left")
        phase, of = _phase(orbits), lambda k: F.get("_orb_phase_range", F.lit(k))
        reasons["eclipsing"] = cuts.reason((phase > of(0)) & (phase < of(1)), "eclipsing")
    found = cuts.first_reason(*before, *[reasons[r] for r in order if r in reasons])
    return t.select(*[c for c in toas.columns if c != "cut"], found.alias("cut"))


def curate_configured(toas: DataFrame, configs: DataFrame, keep: str, lose: str, orbits: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(observations with ``cut``, changes to the lists of orphaned receivers), from raw rows and configurations.

    Simultaneous rows of the backend ``lose`` go first, then what configurations say by keys, then wideband rows without a
    dispersion measure of their own, then what they list by hand. ``changes`` (psr, f, change) are receiver-backends with
    few files that a configuration doesn't list as orphaned, and listed ones that have more.
    """
    t = cuts.simultaneous(toas if "cut" in toas.columns else toas.withColumn("cut", F.lit(None).cast("string")), keep, lose)
    listed = configs.select("psr", F.explode("ignore.orphaned_rec").alias("f"))
    return ignored(settled(t), configs, orbits, IN_STAGES), stats.listed_receivers(toas, listed)


def outlier_cuts(toas: DataFrame, prob: float = 0.1, percent: float = 8.0, narrowband: bool = True, **setup) -> tuple[DataFrame, DataFrame]:
    """(toas, bins) after outlier cuts, binning, cuts of files with many outliers, and binning again."""
    t = cuts.apply_rules(toas, [cuts.outlier_reason(prob)])
    if not narrowband:
        return bins.setup(t, **setup)
    # binning makes no outlier cuts, so files with many are known before it
    t, _ = bins.setup(t.withColumn("many_outliers", cuts.many_outliers(percent)), **setup)
    return bins.setup(cuts.apply_rules(t, [cuts.reason(F.col("many_outliers"), "maxout")]).drop("many_outliers"), **setup)


def excision_tests(toas: DataFrame, columns: dict[str, Column], prob: float = 0.1, threshold: float = 1e-6, **setup) -> tuple[DataFrame, DataFrame]:
    """(toas, the files' tests): outlier cuts, then the fit without each file of what is left.

    ``columns`` are the design's. A DM for each bin is fitted beside them, with and without the file; a bin that the
    file alone has rows in goes with it.
    """
    t, b = outlier_cuts(toas, prob, **setup)
    live = bins.members(t.filter("cut is null"), b)
    weight, of_dm = 1 / (F.col("err_us") * F.col("err_us")), 1e6 / (F.col("freq_mhz") * F.col("freq_mhz"))
    design = live.select("psr", "ord", "name", F.col("resid_us").alias("y"), weight.alias("w"), of_dm.alias("u"), *[c.alias(n) for n, c in columns.items()])
    return t, ftests.leave_one_out_of_rows(design, ["u", *columns], threshold, unit="ord")


def outlier_excision(toas: DataFrame, columns: dict[str, Column], prob: float = 0.1, threshold: float = 1e-6, **setup) -> tuple[DataFrame, DataFrame]:
    """(toas with epochdrop cuts, the files' tests) of ``excision_tests``."""
    t, tests = excision_tests(toas, columns, prob, threshold, **setup)
    gone = settled(tests.filter("drop").select("psr", "name"))  # few beside the tests, and known to be
    marked = cuts.listed(t, gone, ["psr", "name"], "dropped")
    return cuts.apply_rules(marked, [cuts.reason(F.col("dropped"), "epochdrop")]).drop("dropped"), tests


def noise_to_params(chains: DataFrame, names: DataFrame, mode: str = "nb", n: int = 50, burn: float = 0.25, digits: int = 6, keep_red: DataFrame | None = None) -> DataFrame:
    """(psr, kind, number, mask_value, value) from the best samples; ``names`` (chain, pos, psr, name) says what each place is.

    Rows of white noise are numbered by kind; those of red, dispersion, chromatic and solar noise have neither number nor
    mask. ``keep_red`` (psr, keep) says where there is evidence for red noise.
    """
    best = noise.top_mean(chains, n, burn).join(names, ["chain", "pos"])
    known = noise.parse_names(best.select("psr", "name", F.col("pos").alias("ord")), mode)
    v = F.col("mean")
    value = F.when(F.col("kind").isin("EQUAD", "ECORR"), scalar.log10_to_us(v)).when(F.col("kind") == "DMEQUAD", F.pow(F.lit(10.0), v)).otherwise(v)
    white = known.join(best.select("psr", "name", "mean"), ["psr", "name"]).select("psr", "kind", "number", "mask_value", F.round(value, digits).alias("value"))
    signals = noise.signal_rows(best.select("psr", "name", F.col("mean").alias("value")), keep_red)
    return white.unionByName(signals.select("psr", "kind", F.lit(None).cast("long").alias("number"), F.lit(None).cast("string").alias("mask_value"), F.round("value", digits).alias("value")))


def timing_summary(toas: DataFrame) -> DataFrame:
    """(psr, item, label, value): residual statistics, span and cut shares as one long table."""
    toas = settled(toas.select("psr", "f", "obs", "mjd", "resid_us", "err_us", "cut"))  # read three times
    s = settled(stats.residual_stats(toas.filter("cut is null")))
    rms = s.select("psr", F.lit("rms").alias("item"), F.col("f").alias("label"), F.col("rms").alias("value"))
    wrms = s.select("psr", F.lit("wrms").alias("item"), F.col("f").alias("label"), F.col("wrms").alias("value"))
    years = stats.span(toas).select("psr", F.lit("years").alias("item"), F.lit("All").alias("label"), F.col("years").alias("value"))
    c = stats.cut_counts(toas).filter("dim = 'f'")
    shares = c.select("psr", F.lit("cut_pct").alias("item"), F.col("value").alias("label"), F.round(F.lit(100.0) * F.col("cut") / F.col("total"), 6).alias("value"))
    return rms.union(wrms).union(years).union(shares)


def _said(df: DataFrame, item: str, label: Column | str, value: Column | str) -> DataFrame:
    """Rows of a long report (psr, item, label, value), all text."""
    as_text = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    return df.select("psr", F.lit(item).alias("item"), as_text(label).alias("label"), as_text(value).alias("value"))


def model_checks(receivers: DataFrame, jumped: DataFrame, settings: DataFrame, expected: DataFrame, noise_: DataFrame, matches: DataFrame, frozen: DataFrame, wideband: DataFrame | None = None) -> DataFrame:
    """(psr, item, label, value): jumps against receivers, settings against those expected, noise parameters out of range, frozen ones that aren't zero.

    ``receivers`` and ``jumped`` are (psr, fe); with ``wideband``, the receivers (psr, fe) that have jumps of dispersion
    measures, all of them need one. ``noise_`` and ``matches`` are as ``params.noise_sanity`` takes them, ``frozen`` what
    ``params.frozen_nonzero`` gives.
    """
    jumps = _said(params.jump_check(receivers, jumped), "jump", F.coalesce("fe", F.lit("all")), "violation")
    if wideband is not None:
        jumps = jumps.union(_said(params.jump_check(receivers, wideband, all_need=True), "dm jump", F.coalesce("fe", F.lit("all")), "violation"))
    settings_ = _said(params.settings_check(settings, expected), "setting", "key", F.coalesce("value", F.lit("none")))
    sanity = _said(params.noise_sanity(noise_, matches), "noise", F.concat_ws(" ", "kind", "mask_key", "mask_value"), "alert")
    return jumps.union(settings_).union(sanity).union(_said(frozen, "frozen", "name", F.lit("not zero")))


def timing_checks(model: DataFrame, models: DataFrame, old: DataFrame, spans: DataFrame, tests: DataFrame, sigma: float = 3.0, further: DataFrame | None = None) -> DataFrame:
    """(psr, item, label, value) of what a model's report warns of, beside ``timing_summary``: all sources in one long table.

    ``model`` and ``old`` are parameters (psr, name, value, uncertainty, frozen), ``models`` (psr, model) the binary models,
    ``tests`` F-tests as ``ftests.recommend`` takes them, ``further`` the rows of ``model_checks``. Items: spin, astrometry,
    binary, epoch, moved, remove, add, and further ones.
    """
    spin = params.spin_check(model).withColumn("bad", F.array_compact(F.array(F.when(~F.col("f0_fitted"), "F0"), F.when(~F.col("f1_fitted"), "F1"), F.when(F.col("further") > 0, "further"))))
    parts = [
        _said(spin.select("psr", F.explode("bad").alias("what")).withColumn("said", F.when(F.col("what") == "further", "more derivatives").otherwise("not fitted")), "spin", "what", "said"),
        _said(params.astrometry_check(model, model), "astrometry", "name", "problem"), _said(params.binary_check(model, models), "binary", "name", "problem"),
        _said(params.far_epochs(spans, model), "epoch", "name", "centre"), _said(params.compare(model, old, sigma).filter("moved"), "moved", "name", "side"),
    ]
    out = reduce(DataFrame.union, [*parts, *([] if further is None else [further])])
    return out.union(ftests.recommend(tests).select("psr", F.col("action").alias("item"), "label", F.lit("by F-test")))


def excision_reports(toas: DataFrame, configs: DataFrame) -> DataFrame:
    """(psr, item, label, n): cut counts of every source and of all (psr null), and why entries of configurations are left out."""
    each = stats.excision_report(toas)
    count = lambda df, psr: df.select(psr.alias("psr"), F.lit("rows").alias("item"), F.inline(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("long").alias("n")) for c in ("total", "cut", "outlier10", "epochdrop")])))
    none = F.lit(None).cast("string")
    why = excised_reasons(configs).select(none.alias("psr"), F.col("kind").alias("item"), F.col("reason").alias("label"), "n")
    return count(each, F.col("psr")).union(count(stats.report_totals(each), none)).union(why)


def nbwb_compare(a: DataFrame, b: DataFrame, own_bins: DataFrame, toas: DataFrame, sigma: float = 3.0) -> DataFrame:
    """Files in the nearest bins of times at which two series differ by more than ``sigma`` errors."""
    d = params.series_difference(a, b).filter((F.col("side") == "both") & (F.abs("diff") > sigma * F.col("err")))
    near = bins.nearest_bins(d.select("psr", "mjd").distinct(), own_bins).filter("inside").select("psr", "ord").distinct()
    return bins.members(toas, own_bins.join(near, ["psr", "ord"], "left_semi")).select("psr", "ord", "name").distinct()


def reflag_and_combine(parts: list[tuple[DataFrame, dict]]) -> DataFrame:
    """Observations of several groups with flags of one standard, in one table."""
    done = [df.withColumn("flags", scalar.standard_flags(F.col("flags"), **how)) for df, how in parts]
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def release_state(configs: DataFrame, logs: DataFrame, tags: list[str], toas: DataFrame, old_versions: tuple[str, ...], runs: DataFrame, used: DataFrame, files: tuple[DataFrame, DataFrame] | None = None, models: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(kind, id, problem) of what isn't ready, beside ``release_audit``: checks open, entries with unknown tags, no READY_FOR,
    observations of mixed or old releases (``ver``), noise runs that aren't the newest; with ``files``, the lists (config, file)
    of configurations and of the release, configurations whose lists differ; with ``models``, all model files (file) and those
    in use (source, mode, file), sources whose model isn't the latest by date."""
    row = lambda df, kind, id_, problem: df.select(F.lit(kind).alias("kind"), F.col(id_).alias("id"), problem.alias("problem"))
    log, release = audit.changelog(logs, tags), stats.release_check(toas, "ver", old_versions)
    parts = [
        row(audit.cleared(configs).filter("not cleared"), "config", "config", F.lit("not cleared")), row(log.filter("invalid > 0"), "log", "config", F.lit("unknown tags")), row(log.filter("ready_day is null"), "log", "config", F.lit("not ready")),
        row(release.filter("mixed"), "release", "psr", F.lit("mixed")), row(release.filter("is_old"), "release", "psr", F.lit("old")), row(audit.newest(runs, used).filter("stale"), "noise", "source", F.lit("stale")),
    ]
    if files is not None:
        parts.append(row(audit.changed_configs(audit.file_differences(*files)), "files", "config", F.lit("lists differ")))
    if models is not None:
        late = text.latest_files(models[0]).join(models[1], ["source", "mode"]).filter("file <> latest").withColumn("id", F.concat_ws(".", "source", "mode"))
        parts.append(row(late, "model", "id", F.lit("not the latest")))
    return reduce(DataFrame.union, parts)


def release_audit(configs: DataFrame, results: DataFrame, expected: DataFrame, found: DataFrame) -> DataFrame:
    """(kind, id, problem) of results unused or shared, unpaired sources and products missing or multiple."""
    used = audit.result_use(configs, results).filter("state <> 'ok'").select(F.lit("result").alias("kind"), F.col("result").cast("string").alias("id"), F.col("state").alias("problem"))
    alone = audit.pairing(configs).filter("not paired").select(F.lit("source").alias("kind"), F.col("source").alias("id"), F.lit("one mode only").alias("problem"))
    made = audit.product_counts(expected, found, "product").select(F.lit("product").alias("kind"), F.col("product").alias("id"), F.col("state").alias("problem"))
    return used.union(alone).union(made)
