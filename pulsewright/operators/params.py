"""Model parameters as rows: comparing, checking, and joining them to observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsewright.functions.scalar import year_of
from pulsewright.operators import scan
from pulsewright.operators.settle import settled


def series_difference(a: DataFrame, b: DataFrame, digits: int = 6) -> DataFrame:
    """Two series (psr, mjd, val, err) by time: difference, error in quadrature, and which side has the time."""
    y = b.select("psr", "mjd", F.col("val").alias("val2"), F.col("err").alias("err2"), F.lit(True).alias("b"))
    both = a.withColumn("a", F.lit(True)).join(y, ["psr", "mjd"], "full")
    side = F.when(F.col("b").isNull(), "first only").when(F.col("a").isNull(), "second only").otherwise("both")
    return both.select("psr", "mjd", F.round(F.col("val") - F.col("val2"), digits).alias("diff"), F.round(F.sqrt(F.col("err") * F.col("err") + F.col("err2") * F.col("err2")), digits).alias("err"), side.alias("side"))


def difference_scatter(differences: DataFrame, digits: int = 6) -> DataFrame:
    """(psr, n, scatter): the population deviation of a source's differences at times that both series have."""
    return differences.filter("side = 'both'").groupBy("psr").agg(F.count("diff").alias("n"), F.round(F.stddev_pop("diff"), digits).alias("scatter"))


def compare(new: DataFrame, old: DataFrame, sigma: float = 3.0, skip: Column | None = None) -> DataFrame:
    """Parameters of two models: values, difference in units of the old error, which side lacks one, whether it moved much."""
    y = old.select("psr", "name", F.col("value").alias("old_value"), F.col("uncertainty").alias("old_uncertainty"), F.lit(True).alias("b"))
    x = new.select("psr", "name", "value", "uncertainty", F.lit(True).alias("a"))
    both = x.join(y, ["psr", "name"], "full")
    if skip is not None:
        both = both.filter(~skip)
    both = both.filter(~((F.coalesce("value", F.lit(0.0)) == 0) & (F.coalesce("old_value", F.lit(0.0)) == 0)))
    moved = F.abs(F.col("value") - F.col("old_value")) / F.nullif(F.col("old_uncertainty"), F.lit(0.0))
    side = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "missing").otherwise("both")
    return both.select("psr", "name", "value", "old_value", moved.alias("sigmas"), F.coalesce(moved > sigma, F.lit(False)).alias("moved"), side.alias("side"))


def noise_ratio(chain: DataFrame, par: DataFrame, lo: float = 0.9, hi: float = 1.1) -> DataFrame:
    """Noise values of a chain and of a model: the ratio and those out of range or on one side only."""
    y = par.select("psr", "name", F.col("value").alias("par_value"))
    both = chain.select("psr", "name", "value").join(y, ["psr", "name"], "full")
    ratio = F.col("value") / F.nullif(F.col("par_value"), F.lit(0.0))
    state = F.when(F.col("par_value").isNull(), "not in model").when(F.col("value").isNull(), "not in chain").when((ratio < lo) | (ratio > hi), "differs")
    return both.select("psr", "name", ratio.alias("ratio"), state.alias("state")).filter("state is not null")


def mask_matches(toas: DataFrame, masks: DataFrame, flags: tuple[str, ...] = ("f", "fe", "be")) -> DataFrame:
    """(psr, mask_key, mask_value, n, median_err): observations that each mask parameter selects."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f"-{n}").alias("mask_key"), F.col(n).alias("mask_value")) for n in flags])).alias("p")
    t = toas.select("psr", "err_us", pairs).select("psr", "p.*", "err_us")
    keys = ["psr", "mask_key", "mask_value"]
    few = settled(masks.select(*keys).distinct())  # so that Spark knows how few they are and leaves the observations in place
    met = settled(t.join(few, keys, "left_semi"))
    middle = scan.quantiles(met, keys, "err_us", [0.5]).select(*keys, F.col("q")[0].alias("median_err"))
    return met.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(middle, keys, "left")


def noise_sanity(noise: DataFrame, matches: DataFrame) -> DataFrame:
    """Noise parameters out of their usual range: EFAC outside (0.8, 1.2), EQUAD and ECORR large against the median error or in microseconds."""
    n = noise.join(matches, ["psr", "mask_key", "mask_value"])
    ratio = F.col("value") / F.col("median_err")
    is_fac, is_add = F.col("kind").isin("EFAC", "DMEFAC"), F.col("kind").isin("EQUAD", "ECORR")
    alert = F.when(is_fac & ((F.col("value") < 0.8) | (F.col("value") > 1.2)), "factor out of range").when(is_add & (F.col("value") > 9.5), "at prior edge").when(is_add & (F.col("value") > 3.0), "over 3 us").when((is_add | (F.col("kind") == "DMEQUAD")) & (ratio > 0.75), "large against error")
    return n.select("psr", "kind", "mask_key", "mask_value", "value", alert.alias("alert")).filter("alert is not null")


def jump_check(receivers: DataFrame, jumped: DataFrame, all_need: bool = False) -> DataFrame:
    """Receivers (psr, fe) against jumps (psr, fe): which lack one, which jump has no receiver, and whether the count is right.

    All but one receiver need a jump; with ``all_need`` every one (jumps of dispersion measures).
    """
    r, j = receivers.distinct(), jumped.distinct()
    free = r.join(j, ["psr", "fe"], "left_anti")
    unknown = j.join(r, ["psr", "fe"], "left_anti").select("psr", "fe", F.lit("unknown receiver").alias("violation"))
    n = free.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("psr")))
    more = n.filter("n >= 1" if all_need else "n > 1").select("psr", "fe", F.lit("no jump").alias("violation"))
    out = unknown.union(more)
    if not all_need:
        every = r.select("psr").distinct().join(free.select("psr").distinct(), "psr", "left_anti").select("psr", F.lit(None).cast("string").alias("fe"), F.lit("all jumped").alias("violation"))
        out = out.union(every)
    return out


def missing_jumps(receivers: DataFrame, jumped: DataFrame, all_need: bool = False) -> DataFrame:
    """Jump rows to add (psr, name, mask_key, mask_value): all free receivers but the last by name, or all; none for a single receiver."""
    free = receivers.distinct().join(jumped.distinct(), ["psr", "fe"], "left_anti")
    if not all_need:
        many = receivers.distinct().withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("psr"))).filter("n > 1").select("psr").distinct()
        free = free.join(many, "psr", "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("psr").orderBy(F.desc("fe")))).filter("k > 1").drop("k")
    return free.select("psr", F.lit("DMJUMP" if all_need else "JUMP").alias("name"), F.lit("-fe").alias("mask_key"), F.col("fe").alias("mask_value"))


def frozen_nonzero(params: DataFrame, ignore: list[str], prefixes: list[str]) -> DataFrame:
    out = params.filter(F.col("frozen") & (F.col("value") != 0) & ~F.col("name").isin(*ignore))
    for p in prefixes:
        out = out.filter(~F.col("name").startswith(p))
    return out


def name_ok(name: Column) -> Column:
    return name.rlike(r"^(J[0-9]{4}[+-][0-9]{4}|B[0-9]{4}[+-][0-9]{2})$")


def spin_check(params: DataFrame) -> DataFrame:
    """Per source: are F0 and F1 there and fitted, and how many further derivatives?"""
    fit = lambda n: F.coalesce(F.bool_or((F.col("name") == n) & ~F.col("frozen")), F.lit(False))
    return params.groupBy("psr").agg(fit("F0").alias("f0_fitted"), fit("F1").alias("f1_fitted"), F.count_if(F.col("name").rlike(r"^F([2-9]|\d\d+)$")).alias("further"))


def _held(params: DataFrame, names: list[str]) -> DataFrame:
    """(psr, held): each source's parameters of these few names as one list of (name, frozen), so that rules look into a row and join nothing by name."""
    return params.filter(F.col("name").isin(*names)).groupBy("psr").agg(F.collect_list(F.struct("name", "frozen")).alias("held"))


def _with_held(sources: DataFrame, params: DataFrame, names: list[str]) -> DataFrame:
    """``sources`` (psr once each) with ``held``, empty where a source has none of the names."""
    none = F.array().cast("array<struct<name:string,frozen:boolean>>")
    return sources.join(_held(params, names), "psr", "left").withColumn("held", F.coalesce("held", none))


def _has(n: Column) -> Column:
    return F.exists("held", lambda p: p["name"] == n)


def _problem(name: Column, problem: Column) -> Column:
    return F.struct(name.alias("name"), problem.alias("problem"))


def _lacking(names: Column) -> Column:
    """What is said of required names: once of a missing one, of each row of another; null of what is fitted."""
    rows = lambda n: F.filter("held", lambda p: p["name"] == n)
    said = lambda n: F.transform(rows(n), lambda p: _problem(n, F.when(p["frozen"].isNull(), "missing").when(p["frozen"], "not fitted")))
    return F.flatten(F.transform(names, lambda n: F.when(_has(n), said(n)).otherwise(F.array(_problem(n, F.lit("missing"))))))


def _problems(sources: DataFrame, *said: Column) -> DataFrame:
    """(psr, name, problem) of arrays of problems, without those that are null."""
    return sources.select("psr", F.inline(F.filter(F.concat(*said), lambda x: x["problem"].isNotNull())))


def required(params: DataFrame, sources: DataFrame, names: list[str]) -> DataFrame:
    """(psr, name, problem) of required parameters that are missing or not fitted."""
    return _problems(_with_held(sources.select("psr").distinct(), params, names), _lacking(F.array(*map(F.lit, names))))


#: The ecliptic set of astrometric parameters, and what an equatorial one has.
ECLIPTIC, EQUATORIAL = ["ELONG", "ELAT", "PMELONG", "PMELAT", "PX"], ["RAJ", "DECJ", "PMRA", "PMDEC"]


def astrometry_check(params: DataFrame, sources: DataFrame) -> DataFrame:
    """(psr, name, problem): ecliptic parameters missing or not fitted, and sources (name FRAME) in equatorial or no coordinates."""
    s = _with_held(sources.select("psr").distinct(), params, [*ECLIPTIC, *EQUATORIAL])
    has = lambda *names: F.exists("held", lambda p: p["name"].isin(*names))
    frame = F.when(has(*EQUATORIAL), "equatorial").when(~has("ELONG", "ELAT"), "no frame")
    return _problems(s, _lacking(F.array(*map(F.lit, ECLIPTIC))), F.array(_problem(F.lit("FRAME"), frame)))


#: For each binary model its required parameters, those fitted if present, and pairs that come together.
BINARY_RULES = {
    "ELL1": (["A1", "TASC", "EPS1", "EPS2"], ["PB", "FB0", "PBDOT", "M2", "SINI", "XDOT", "A1DOT", "EPS1DOT", "EPS2DOT"], [("M2", "SINI"), ("EPS1DOT", "EPS2DOT")]),
    "ELL1 by FB0": (["A1", "TASC", "EPS1", "EPS2", "FB0"], ["XDOT", "A1DOT", "EPS1DOT", "EPS2DOT"], [("EPS1DOT", "EPS2DOT")]),
    "ELL1H": (["A1", "PB", "TASC", "EPS1", "EPS2", "H3"], ["PBDOT", "XDOT", "A1DOT", "H4", "EPS1DOT", "EPS2DOT"], [("EPS1DOT", "EPS2DOT")]),
    "DD": (["A1", "ECC", "T0", "PB", "OM"], ["PBDOT", "XDOT", "A1DOT", "OMDOT", "EDOT", "M2", "SINI"], [("M2", "SINI")]),
    "DDK": (["A1", "ECC", "T0", "PB", "OM", "M2", "K96", "KOM", "KIN"], ["PBDOT", "XDOT", "A1DOT", "OMDOT", "EDOT", "SINI"], []),
    "T2": (["A1", "ECC", "T0", "PB", "OM", "M2", "KOM", "KIN"], [], []),
}


def binary_check(params: DataFrame, models: DataFrame) -> DataFrame:
    """(psr, name, problem) of binary models: unknown, parameters missing, present but frozen, half pairs, PB against FB0.

    An ELL1 model has one of PB and FB0; by FB0 alone its PBDOT, M2 and SINI aren't looked at.
    """
    text = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
    pair = lambda pairs: F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs]).cast("array<struct<a:string,b:string>>")
    rules = F.create_map(*[x for m, (r, o, p) in BINARY_RULES.items() for x in (F.lit(m), F.struct(text(r).alias("need"), text(o).alias("option"), pair(p).alias("pair")))])
    names = sorted({"PB", "FB0"}.union(*[[*r, *o, *sum(p, ())] for r, o, p in BINARY_RULES.values()]))
    model, by_fb = F.col("model"), _has(F.lit("FB0")) & ~_has(F.lit("PB"))
    sources = models.filter(model.isin(*BINARY_RULES)).groupBy("psr").agg(F.collect_set("model").alias("models"))
    known = _with_held(sources, params, names).select("psr", "held", F.explode("models").alias("model"))
    known = known.withColumn("model", F.when((model == "ELL1") & by_fb, "ELL1 by FB0").otherwise(model)).withColumn("rule", rules[model])
    frozen = F.filter("held", lambda p: p["frozen"] & F.array_contains("rule.option", p["name"]))
    half = lambda x: F.when(_has(x["a"]) != _has(x["b"]), "one of a pair")
    not_one = model.isin("ELL1", "ELL1 by FB0") & (_has(F.lit("PB")) == _has(F.lit("FB0")))
    out = _problems(
        known, _lacking(F.col("rule.need")), F.transform(frozen, lambda p: _problem(p["name"], F.lit("not fitted"))),
        F.transform("rule.pair", lambda x: _problem(F.concat_ws("+", x["a"], x["b"]), half(x))), F.array(_problem(F.lit("PB/FB0"), F.when(not_one, "not one of both"))),
    )
    return out.union(models.filter(~model.isin(*BINARY_RULES)).select("psr", model.alias("name"), F.lit("unknown model").alias("problem")))


def settings_check(settings: DataFrame, expected: DataFrame) -> DataFrame:
    """(psr, key, value, expected) where a setting is not as expected."""
    return settings.join(expected, "key").filter(~F.col("value").eqNullSafe(F.col("expected"))).select("psr", "key", "value", "expected")


def corrected_settings(settings: DataFrame, expected: DataFrame, switches: list[str]) -> DataFrame:
    """``settings`` with the expected value for switches that have another one or none; the other keys are only ever reported."""
    s = settings.join(expected, "key", "left")
    return s.withColumn("value", F.when(F.col("key").isin(*switches) & F.col("expected").isNotNull(), F.col("expected")).otherwise(F.col("value"))).drop("expected")


def fit_status(fits: DataFrame, least: float = 0.01) -> DataFrame:
    """(psr, decrease, status, fully_fitted) of fits (psr, before, after, converged): how the fit went by its chi-squared, and whether the input was fitted.

    ``converged`` is the fitter's own word, null where it has none.
    """
    d = F.col("before") - F.col("after")
    by_chi2 = F.when(F.abs(d) < least, "probably converged").when(d < 0, "increased").otherwise("may not have converged")
    return fits.select("psr", d.alias("decrease"), F.when(F.coalesce("converged", F.lit(False)), "converged").otherwise(by_chi2).alias("status"), (d <= least).alias("fully_fitted"))


def largest_change(fitted: DataFrame, warn: float = 0.1) -> DataFrame:
    """(psr, name, sigmas, warned, unset) of fitted parameters (psr, ord, name, initial, value, uncertainty).

    The largest change in errors, the last by ``ord`` on ties; how many changes exceed ``warn``; how many have no initial value.
    """
    x = fitted.withColumn("s", F.abs((F.col("initial") - F.col("value")) / F.nullif(F.col("uncertainty"), F.lit(0.0))))
    best = F.max_by("name", F.when(F.col("s").isNotNull(), F.struct("s", "ord")))
    return x.groupBy("psr").agg(best.alias("name"), F.max("s").alias("sigmas"), F.count_if(F.col("s") > warn).alias("warned"), F.count_if(F.col("initial").isNull()).alias("unset"))


def far_epochs(spans: DataFrame, params: DataFrame) -> DataFrame:
    """(psr, name, value, centre) of reference epochs too far from the middle of the data (psr, centre).

    PEPOCH by over a day; TASC and T0 by over a day and an orbit, whose period is PB or, without it, 1 / FB0 seconds.
    """
    pick = lambda n: F.max(F.when(F.col("name") == n, F.col("value")))
    names = ["PEPOCH", "TASC", "T0"]
    p = params.filter(F.col("name").isin("PB", "FB0", *names)).groupBy("psr").agg(F.coalesce(pick("PB"), 1 / F.nullif(pick("FB0"), F.lit(0.0)) / 86400.0).alias("period"), *[pick(n).alias(n) for n in names])
    x = p.join(spans.select("psr", "centre"), "psr").select("psr", "centre", "period", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])))
    most = F.when(F.col("name") == "PEPOCH", F.lit(1.0)).otherwise(1.0 + F.col("period"))
    return x.filter(F.abs(F.col("value") - F.col("centre")) > most).select("psr", "name", "value", "centre")


def apply_free(params: DataFrame, free: DataFrame, free_dmx: bool = True) -> DataFrame:
    """``frozen`` as the list of free parameters (psr, name) says; bin parameters follow one switch, the mean DM stays frozen."""
    f = free.select("psr", "name").distinct().withColumn("is_free", F.lit(True))
    is_free = F.coalesce("is_free", F.lit(False)) | (F.lit(free_dmx) & F.col("name").startswith("DMX_"))
    return params.join(f, ["psr", "name"], "left").withColumn("frozen", ~is_free | (F.col("name") == "DM")).drop("is_free")


def dmx_params(params: DataFrame) -> DataFrame:
    """(psr, idx, val, err, r1, r2) of bin parameters; a missing error is zero."""
    p = params.select("psr", F.regexp_extract("name", r"^(DMX|DMXR1|DMXR2)_(\d+)$", 1).alias("kind"), F.regexp_extract("name", r"_(\d+)$", 1).alias("idx"), "value", "uncertainty").filter("kind <> ''")
    pick = lambda k, c="value": F.max(F.when(F.col("kind") == k, F.col(c)))
    return p.groupBy("psr", F.col("idx").cast("int").alias("idx")).agg(pick("DMX").alias("val"), F.coalesce(pick("DMX", "uncertainty"), F.lit(0.0)).alias("err"), pick("DMXR1").alias("r1"), pick("DMXR2").alias("r2"))


def dmx_series(dmx: DataFrame, less_mean: bool = False, digits: int = 6) -> DataFrame:
    """(psr, idx, epoch, year, val, err, r1, r2) of bin parameters in time, less each source's mean if asked."""
    val = F.col("val") - F.avg("val").over(Window.partitionBy("psr")) if less_mean else F.col("val")
    epoch = (F.col("r1") + F.col("r2")) / 2
    return dmx.select("psr", "idx", epoch.alias("epoch"), year_of(epoch).alias("year"), F.round(val, digits).alias("val"), F.coalesce("err", F.lit(0.0)).alias("err"), "r1", "r2")


def replace_dmx(params: DataFrame, new: DataFrame) -> DataFrame:
    """``params`` without its bin parameters, with those of ``new`` (psr, idx, val, err, r1, r2)."""
    rest = params.filter(~F.col("name").rlike(r"^DMX"))
    one = lambda n, v, e: F.struct(F.format_string(f"{n}_%04d", F.col("idx").cast("int")).alias("name"), v.alias("value"), e.alias("uncertainty"), F.lit(n != "DMX").alias("frozen"))
    zero = F.lit(None).cast("double")
    made = new.select("psr", F.inline(F.array(one("DMX", F.col("val"), F.col("err")), one("DMXR1", F.col("r1"), zero), one("DMXR2", F.col("r2"), zero))))
    return rest.select("psr", "name", "value", "uncertainty", "frozen").unionByName(made)


def convert_equads(params: DataFrame) -> DataFrame:
    """EQUAD over EFAC of the same mask."""
    e = params.filter("name = 'EFAC'").select("psr", "mask_key", "mask_value", F.col("value").alias("efac"))
    return params.filter("name = 'EQUAD'").join(e, ["psr", "mask_key", "mask_value"], "left").withColumn("value", F.col("value") / F.coalesce(F.nullif(F.col("efac"), F.lit(0.0)), F.lit(1.0))).drop("efac")


def scaled_errors(toas: DataFrame, noise: DataFrame, tempo2: bool = True) -> DataFrame:
    """``err_scaled``: errors with the factors and additions that noise rows (psr, f, efac, equad) give."""
    t = toas.join(noise, ["psr", "f"], "left")
    fac, add = F.coalesce("efac", F.lit(1.0)), F.coalesce("equad", F.lit(0.0))
    err = F.col("err_us")
    scaled = fac * F.sqrt(err * err + add * add) if tempo2 else F.sqrt(fac * err * fac * err + add * add)
    return t.withColumn("err_scaled", scaled).drop("efac", "equad")


def remove_components(params: DataFrame, prefixes: list[str]) -> DataFrame:
    """Parameters without those of some components, as before a new fit."""
    out = params
    for p in prefixes:
        out = out.filter(~F.col("name").startswith(p))
    return out


def remove_noise(params: DataFrame, components: list[str]) -> DataFrame:
    """Parameters (with ``component``) without those of the noise components named; a parameter of no component stays."""
    return params.filter(~F.coalesce(F.col("component").isin(*components), F.lit(False)))
