"""Registered queries: counts, residual statistics, sessions and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsewright.functions import scalar
from pulsewright.operators import params, stats
from pulsewright.plans.queries_cuts import CUT, cut_toas
from pulsewright.plans.registration import query
from pulsewright.sources.binding import SESSIONS, TOAS, sessions, toas


def _wrms(value, error, where="true"):
    return f"""with {TOAS}, m as (select psr, f, {value} as v, 1.0::double / ({error} * {error}) as w from toas where {where}), a as (select psr, f, v - avg(v) over (partition by psr) as x, w from m)
    select psr, case when grouping(f) = 1 then 'All' else f end as f, count(*) as n, round(stddev_pop(x), 6) as rms,
      round(sqrt(greatest(0.0, sum(w * x * x) / sum(w) - pow(sum(w * x) / sum(w), 2))), 6) as wrms from a group by grouping sets ((psr), (psr, f))"""


@query(_wrms("resid_us", "err_us"))
def residual_rms(spark, sf_dir):
    return stats.residual_stats(toas(spark, sf_dir))


@query(_wrms("pp_dm", "pp_dme", "pp_dm is not null"))
def dm_residual_rms(spark, sf_dir):
    return stats.residual_stats(toas(spark, sf_dir), "pp_dm", "pp_dme")


@query(f"with {TOAS} select psr, round(sum(pp_dm / (pp_dme * pp_dme)) / sum(1.0::double / (pp_dme * pp_dme)), 6) as mean, round(1.0::double / sqrt(sum(1.0::double / (pp_dme * pp_dme))), 6) as mean_err from toas where pp_dm is not null group by psr")
def weighted_mean_dm(spark, sf_dir):
    return stats.weighted_mean(toas(spark, sf_dir), ["psr"], "pp_dm", "pp_dme")


@query(f"with {TOAS} select psr, f, count(distinct name) as files from toas group by all having count(distinct name) <= 3")
def orphaned_receivers(spark, sf_dir):
    return stats.orphaned_receivers(toas(spark, sf_dir))


@query(f"with {TOAS}, e as (select distinct psr, name, chan, subint from toas where snr < 20), n as (select psr, name, count(*) as n from toas group by all), b as (select t.psr, t.name, count(*) as bad from toas t semi join e using (psr, name, chan, subint) group by all) "
       "select psr, name, bad, n from n join b using (psr, name) where bad::double / n >= 0.9")
def bad_file_suggestions(spark, sf_dir):
    t = toas(spark, sf_dir)
    return stats.bad_file_suggestions(t, t.filter("snr < 20").select("psr", "name", "chan", "subint").distinct())


@query(f"with {CUT} select psr, fe, count(*) as n, round(quantile_cont(flux, 0.05), 9) as flux_05, round(quantile_cont(flux, 0.5), 9) as flux_50, round(quantile_cont(flux, 0.95), 9) as flux_95 from cut_toas where cut is null group by all")
def bad_toa_context(spark, sf_dir):
    return stats.flux_context(cut_toas(spark, sf_dir))


@query(f"with {TOAS}, s as (select psr, min(mjd) as first, max(mjd) as last from toas group by psr) select psr, first, last, round_even((first + last) / 2, 0) as centre, round((last - first) / 365.25::double, 9) as years, (last - first) / 365.25::double < 2 as short from s")
def time_span(spark, sf_dir):
    return stats.span(toas(spark, sf_dir))


@query(f"with {TOAS}, x as (select psr, f, resid_us as x, min(resid_us) over w as lo, max(resid_us) over w as hi from toas window w as (partition by psr, f)) "
       "select psr, f, (case when hi > lo then least(floor((x - lo) / ((hi - lo) / 50.0::double)), 49) else 0 end)::int as bin, count(*) as n from x group by all")
def residual_histogram(spark, sf_dir):
    return stats.residual_histogram(toas(spark, sf_dir))


@query(f"with {TOAS}, c as (select psr, case when pout > 0.95 then 'outlier10' when snr < 3 then 'epochdrop' when snr < 8 then 'snr' end as cut from toas), n as (select psr, count(*) as total, count(cut) as cut, count(*) filter (cut = 'outlier10') as outlier10, count(*) filter (cut = 'epochdrop') as epochdrop from c group by psr) "
       "select *, outlier10::double / total as outlier_share, outlier10::double / total > 0.02 as many from n")
def excision_report(spark, sf_dir):
    c = F.when(F.col("pout") > 0.95, "outlier10").when(F.col("snr") < 3, "epochdrop").when(F.col("snr") < 8, "snr")
    return stats.excision_report(toas(spark, sf_dir).withColumn("cut", c))


@query(f"with {TOAS} select psr, name, arg_min(f, toa_id) as f, floor(arg_min(mjd, toa_id))::bigint as day, count(*) as n, round(1.0::double / sqrt(sum(1.0::double / (err_us * err_us))), 9) as esum from toas group by psr, name")
def removed_files(spark, sf_dir):
    return stats.removed_files(toas(spark, sf_dir))


@query(f"with {TOAS}, t as (select pta, abs(resid_us) > 4.5 as bad, unnest([{{'flag': 'fe', 'value': fe}}, {{'flag': 'be', 'value': be}}, {{'flag': 'f', 'value': f}}]) as p from toas), g as (select pta, p.flag as flag, p.value as value, count(*) filter (bad) as n, count(*) filter (not bad) as good from t group by all) "
       "select pta, flag, value, n, case when good > 0 then 'possible' else 'likely' end as kind, round(100.0::double * n / sum(n) over (partition by pta), 6) as pct from g where n > 0")
def jump_attribution(spark, sf_dir):
    return stats.jump_attribution(toas(spark, sf_dir), F.abs("resid_us") > 4.5)


GROUPS = "g as (select *, sum(new) over (partition by {k} order by mjd range unbounded preceding)::bigint as grp from (select *, case when mjd - lag(mjd) over (partition by {k} order by mjd) <= {w} then 0 else 1 end as new from {t}))"


@query(f"with {SESSIONS}, {GROUPS.format(k='psr', w='0.1::double', t='sessions')} select psr, grp, count(*) as n, round(avg(mjd), 6) as mean_mjd from g group by all")
def group_dates(spark, sf_dir):
    return stats.group_dates(sessions(spark, sf_dir), ["psr"], digits=6)


@query(f"with {TOAS}, {GROUPS.format(k='psr, f', w='1.5::double', t='toas')} select psr, f, grp, count(*) as n, round(sum(mjd / (err_us * err_us)) / sum(1.0::double / (err_us * err_us)), 6) as mjd, round(sum(freq_mhz / (err_us * err_us)) / sum(1.0::double / (err_us * err_us)), 6) as freq_mhz, "
       "round(sum(resid_us / (err_us * err_us)) / sum(1.0::double / (err_us * err_us)), 6) as resid_us, round(sqrt(1.0::double / sum(1.0::double / (err_us * err_us)) + 0.25::double), 6) as err_us, min(toa_id) as first_toa from g group by all")
def epoch_average(spark, sf_dir):
    return stats.epoch_average(toas(spark, sf_dir), 1.5, 0.5)


@query(f"with {TOAS}, {GROUPS.format(k='psr, f', w='1.5::double', t='toas')}, e as (select *, case f when 'A_F' then 1.2::double when 'R_F' then 0.9::double else 1.0::double end * sqrt(err_us * err_us + 0.04::double) as s from g) select psr, f, grp, count(*) as n, round(sum(mjd / (s * s)) / sum(1.0::double / (s * s)), 6) as mjd, round(sum(freq_mhz / (s * s)) / sum(1.0::double / (s * s)), 6) as freq_mhz, "
       "round(sum(resid_us / (s * s)) / sum(1.0::double / (s * s)), 6) as resid_us, round(sqrt(1.0::double / sum(1.0::double / (s * s)) + pow(case f when 'A_F' then 0.5::double when 'R_F' then 2.0::double else 0.0::double end, 2)), 6) as err_us, min(toa_id) as first_toa from e group by psr, f, grp")
def epoch_average_by_backend(spark, sf_dir):
    """Scaled errors weigh, and each backend has its own correlated noise or none."""
    t = toas(spark, sf_dir)
    masks = t.select("psr", "f").distinct()
    of = lambda a, r, other: F.when(F.col("f") == "A_F", a).when(F.col("f") == "R_F", r).otherwise(other)
    scaled = params.scaled_errors(t, masks.withColumns({"efac": of(1.2, 0.9, 1.0), "equad": F.lit(0.2)}))
    shared = masks.withColumn("ecorr", of(0.5, 2.0, F.lit(None))).filter("ecorr is not null")
    return stats.epoch_average(scaled, 1.5, shared, error="err_scaled")


@query(f"with {TOAS} select psr, toa_id, row_number() over (partition by psr order by mjd, toa_id) as serial, toa_id = min(toa_id) over (partition by psr, name) as first_of_file from toas")
def serial_numbers(spark, sf_dir):
    return stats.serials(toas(spark, sf_dir))


@query(f"with {TOAS} select psr, toa_id, (mjd - 51544.0::double) / 365.25::double + 2000.0::double as year from toas")
def mjd_to_year(spark, sf_dir):
    return toas(spark, sf_dir).select("psr", "toa_id", scalar.year_of(F.col("mjd")).alias("year"))


@query(f"with {TOAS} select psr, toa_id, resid_us - coalesce(case when subint <> 2 then resid_us / 4.0::double end, 0.0::double) - coalesce(case when chan <> 3 then resid_us / 8.0::double end, 0.0::double) as white from toas")
def whiten_residuals(spark, sf_dir):
    noise = F.map_filter(
        F.create_map(F.lit("pl_red_noise"), F.when(F.col("subint") != 2, F.col("resid_us") / 4.0), F.lit("pl_DM_noise"), F.when(F.col("chan") != 3, F.col("resid_us") / 8.0)),
        lambda _, v: v.isNotNull(),
    )
    return toas(spark, sf_dir).withColumn("noise_resids", noise).select("psr", "toa_id", scalar.whiten(F.col("resid_us"), F.col("noise_resids")).alias("white"))


@query(f"with {TOAS} select psr, toa_id, resid_us / err_us as significance, resid_us - 0.5::double as shifted from toas")
def residual_significance(spark, sf_dir):
    return toas(spark, sf_dir).select("psr", "toa_id", (F.col("resid_us") / F.col("err_us")).alias("significance"), (F.col("resid_us") - 0.5).alias("shifted"))


@query(f"with {TOAS} select psr, list_sort(list(distinct fe) filter (fe <> 'N')) as receivers from toas group by psr")
def distinct_receivers(spark, sf_dir):
    return stats.flag_values(toas(spark, sf_dir), ["fe"], ("N",)).withColumnRenamed("vals", "receivers")


@query(f"with {TOAS} select psr, count(distinct pta) as versions, count(distinct pta) > 1 as mixed, min(pta) as first, min(pta) = '1' as is_old from toas group by psr")
def release_versions(spark, sf_dir):
    return stats.release_check(toas(spark, sf_dir), "pta", ("1",))


@query(f"with {TOAS} select psr, 'O' as old, 'F' as new, 2010.1::double as year from toas group by psr having bool_or(be = 'O') and bool_or(be = 'F')")
def backend_transition(spark, sf_dir):
    return stats.transitions(toas(spark, sf_dir), [("O", "F", 2010.1), ("O", "none", 2012.1)])


@query(f"with {TOAS} select psr, min(chan * 256) as nbin, 1.0::double / (200.0::double + (psr[4:])::int) / min(chan * 256) as one_bin from toas group by psr")
def least_nbin(spark, sf_dir):
    t = toas(spark, sf_dir).withColumn("nbin", F.col("chan") * 256)
    spins = t.select("psr").distinct().withColumn("f0", F.lit(200.0) + F.substring("psr", 4, 9).cast("int"))
    return stats.least_bins(t, spins)


@query(f"with {TOAS}, others as (select * from toas where pta <> '1'), {GROUPS.format(k='psr, f', w='1.5::double', t='others')} select psr, f, grp, count(*) as n, round(sum(mjd / (err_us * err_us)) / sum(1.0::double / (err_us * err_us)), 6) as mjd, round(sum(freq_mhz / (err_us * err_us)) / sum(1.0::double / (err_us * err_us)), 6) as freq_mhz, "
       "round(sum(resid_us / (err_us * err_us)) / sum(1.0::double / (err_us * err_us)), 6) as resid_us, round(sqrt(1.0::double / sum(1.0::double / (err_us * err_us)) + 0.25::double), 6) as err_us, min(toa_id) as first_toa from g group by all "
       "union all select psr, f, null, 1, round(mjd, 6), round(freq_mhz, 6), round(resid_us, 6), round(err_us, 6), toa_id from toas where pta = '1'")
def averaged_and_single(spark, sf_dir):
    return stats.averaged_and_single(toas(spark, sf_dir), F.col("pta") == "1", 1.5, 0.5)


@query(f"with {TOAS}, a as (select distinct psr, floor(mjd)::bigint as day from toas where be = 'F'), b as (select distinct psr, floor(mjd)::bigint as day from toas where be = 'O') select psr, day, 'both' as kind from (from a intersect from b) union all select psr, day, 'first' from (from a except from b) union all select psr, day, 'second' from (from b except from a)")
def day_set_algebra(spark, sf_dir):
    t = toas(spark, sf_dir).select("psr", F.floor("mjd").cast("long").alias("day"), "be")
    a, b = (t.filter(F.col("be") == x).select("psr", "day") for x in "FO")
    kind = lambda d, k: d.withColumn("kind", F.lit(k))
    return kind(a.intersect(b), "both").union(kind(a.subtract(b), "first")).union(kind(b.subtract(a), "second"))


@query(f"with {TOAS} select psr, toa_id, coalesce(f, obs, 'unknown') as f, coalesce(nullif(fe, 'N'), pta) as fe, 'unknown' as proc, case when be = 'F' then 'first' else 'P' || pta end as pta from toas")
def reflag(spark, sf_dir):
    flags = F.create_map(F.lit("f"), F.col("f"), F.lit("sys"), F.col("obs"), F.lit("r"), F.col("pta"), F.lit("fe"), F.expr("nullif(fe, 'N')"), F.lit("pta"), F.when(F.col("be") == "F", "first"))
    t = toas(spark, sf_dir).withColumn("flags", F.map_filter(flags, lambda _, v: v.isNotNull()))
    new = scalar.standard_flags(F.col("flags"), f_alt="sys", fe_alt="r", pta=F.concat(F.lit("P"), F.col("pta")))
    return t.withColumn("new", new).select("psr", "toa_id", *[F.col("new")[c].alias(c) for c in ("f", "fe", "proc", "pta")])


@query(f"with {TOAS} select psr, pta, case when pta = '1' then f else obs end as pair, count(*) as n from toas group by all")
def febe_pairs(spark, sf_dir):
    return stats.febe_pairs(toas(spark, sf_dir), "1", other="obs")


@query(f"with {TOAS}, h as (select psr, f from toas group by all having count(distinct name) <= 3), w as (select distinct psr, 'A_F' as f from toas) select psr, f, 'add' as change from (from h except from w) union all select psr, f, 'remove' from (from w except from h)")
def orphaned_receiver_changes(spark, sf_dir):
    t = toas(spark, sf_dir)
    return stats.listed_receivers(t, t.select("psr", F.lit("A_F").alias("f")))


BAD_FILES = f"{TOAS}, e as (select distinct psr, name, chan, subint from toas where snr < 20), n as (select psr, name, count(*) as n from toas group by all), b as (select t.psr, t.name, count(*) as bad from toas t semi join e using (psr, name, chan, subint) group by all), s as (select psr, name, bad, n from n join b using (psr, name) where bad::double / n >= 0.9)"


def _bad_files(t):
    entries = t.filter("snr < 20").select("psr", "name", "chan", "subint").distinct()
    return entries, stats.bad_file_suggestions(t, entries)


@query(f"with {BAD_FILES} select psr, name, bad, n from s where not contains(name, '_1') and not contains(name, '23')")
def bad_files_not_listed(spark, sf_dir):
    t = toas(spark, sf_dir)
    patterns = t.select("psr").distinct().select("psr", F.explode(F.array(F.lit("_1"), F.lit("23"))).alias("pattern"))
    return stats.unlisted(_bad_files(t)[1], patterns)


@query(f"with {BAD_FILES} select psr, name, chan, subint from e anti join s using (psr, name)")
def bad_toas_reduced(spark, sf_dir):
    return stats.reduced_entries(*_bad_files(toas(spark, sf_dir))).select("psr", "name", "chan", "subint")


@query(f"with {CUT}, q as (select psr, fe, count(*) as n, round(quantile_cont(flux, 0.05), 9) as flux_05, round(quantile_cont(flux, 0.5), 9) as flux_50, round(quantile_cont(flux, 0.95), 9) as flux_95 from cut_toas where cut is null group by all) "
       "select psr, toa_id, fe, flux, flux_05, flux_50, flux_95, coalesce(n, 0) as n_good, coalesce(flux < flux_05 or flux > flux_95, false) as extreme_flux, snr - 8 < 1 as near_cut, err_us > 1.2 as large_error from cut_toas left join q using (psr, fe) where cut_toas.cut = 'snr'")
def bad_toa_flags(spark, sf_dir):
    t = cut_toas(spark, sf_dir)
    return stats.bad_toa_context(t, t.filter("cut = 'snr'").select("psr", "toa_id"), 8.0, 1.2)


@query(f"with {TOAS}, {GROUPS.format(k='psr, f', w='1.5::double', t='toas')} select psr, f, grp, round(sum(resid_us * 0.31830988618::double / (err_us * err_us)) / sum(1.0::double / (err_us * err_us)), 6) as red, list_sort(list(toa_id)) as members from g group by all")
def epoch_average_members(spark, sf_dir):
    t = toas(spark, sf_dir).withColumn("red", F.col("resid_us") * F.lit(0.31830988618))
    return stats.epoch_average(t, 1.5, noise=("red",), member_ids=True).select("psr", "f", "grp", "red", "members")


@query(f"with {TOAS}, t as (select pta, abs(resid_us) > 4.5 as bad, unnest([{{'flag': 'fe', 'value': fe}}, {{'flag': 'be', 'value': be}}, {{'flag': 'f', 'value': f}}]) as p from toas), g as (select pta, p.flag as flag, p.value as value, count(*) filter (bad) as n, count(*) filter (not bad) as good from t where not (pta = '1' and p.flag <> 'fe') and not (pta = '2' and p.flag = 'fe') group by all) "
       "select pta, flag, value, n, case when good > 0 then 'possible' else 'likely' end as kind, round(100.0::double * n / sum(n) over (partition by pta), 6) as pct from g where n > 0")
def jump_attribution_by_pta(spark, sf_dir):
    return stats.jump_attribution(toas(spark, sf_dir), F.abs("resid_us") > 4.5, of_pta={"1": ("fe",), "2": ("be", "f")})


@query(f"with {TOAS}, c as (select psr, case when pout > 0.95 then 'outlier10' when snr < 3 then 'epochdrop' when snr < 8 then 'snr' end as cut from toas), n as (select psr, count(*) as total, count(cut) as cut, count(*) filter (cut = 'outlier10') as outlier10, count(*) filter (cut = 'epochdrop') as epochdrop from c group by psr) "
       "select count(*) as sources, sum(total)::bigint as total, sum(cut)::bigint as cut, sum(outlier10)::bigint as outlier10, sum(epochdrop)::bigint as epochdrop, count(*) filter (outlier10::double / total > 0.02) as sources_with_many, sum(outlier10)::double / sum(total)::double as outlier_share from n")
def excision_totals(spark, sf_dir):
    c = F.when(F.col("pout") > 0.95, "outlier10").when(F.col("snr") < 3, "epochdrop").when(F.col("snr") < 8, "snr")
    return stats.report_totals(stats.excision_report(toas(spark, sf_dir).withColumn("cut", c)))


@query(f"with {TOAS}, x as (select psr, toa_id, log10(freq_mhz / 1000.0::double) as a, ln(freq_mhz / 1000.0::double) as b from toas) select psr, toa_id, round(0.3::double * a - 0.1::double * a * a, 9) as fd10, round(0.3::double * b - 0.1::double * b * b, 9) as fdln from x")
def fd_delay(spark, sf_dir):
    c = F.array(F.lit(0.3), F.lit(-0.1))
    return toas(spark, sf_dir).select("psr", "toa_id", *[F.round(scalar.fd_delay(F.col("freq_mhz"), c, base), 9).alias(n) for base, n in (("log10", "fd10"), ("ln", "fdln"))])
