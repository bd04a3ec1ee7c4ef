"""Registered queries: dispersion-measure bins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsewright.functions import scalar
from pulsewright.operators import bins, stats
from pulsewright.operators.settle import settled
from pulsewright.plans.queries_cuts import CUT, cut_toas
from pulsewright.plans.registration import query
from pulsewright.sources.binding import TOAS, toas

#: Bins for the joins: sevenths of days apart by source, some of them overlapping, improper or empty.
BINS = """bins as (select psr, k::bigint as ord, 48600.0::double + k * 7.0::double + (psr[4:])::int * 0.25::double as low,
  48600.0::double + k * 7.0::double + (psr[4:])::int * 0.25::double + case when k % 11 = 0 then 9.5::double when k % 29 = 0 then -1.0::double when k % 17 = 0 then 0.001::double else 6.5::double end as high
  from (select distinct psr from toas), range(400) t(k))"""


def _bins(spark, sf_dir, of=None):
    psr = (of if of is not None else toas(spark, sf_dir)).select("psr").distinct()
    k = F.col("ord")
    low = F.lit(48600.0) + k * F.lit(7.0) + F.substring("psr", 4, 9).cast("int") * F.lit(0.25)
    high = low + F.when(k % 11 == 0, 9.5).when(k % 29 == 0, -1.0).when(k % 17 == 0, 0.001).otherwise(6.5)
    return settled(psr).withColumn("ord", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(399).cast("long")))).select("psr", "ord", low.alias("low"), high.alias("high"))


#: Overlapping bins from the observations: weeks of each receiver-backend, padded.
OWN = "own as (select psr, row_number() over (partition by psr order by f, week)::bigint as ord, low, high from (select psr, f, floor(mjd / 7) as week, min(mjd) - 0.05::double as low, max(mjd) + 0.05::double as high from toas group by all))"


def _own(t):
    weeks = t.groupBy("psr", "f", F.floor(F.col("mjd") / 7).alias("week")).agg((F.min("mjd") - F.lit(0.05)).alias("low"), (F.max("mjd") + F.lit(0.05)).alias("high"))
    return weeks.select("psr", F.row_number().over(Window.partitionBy("psr").orderBy("f", "week")).cast("long").alias("ord"), "low", "high")


MET = f"{TOAS}, {BINS}, met as (select t.*, ord, low, high from toas t join bins b on t.psr = b.psr and low < mjd and mjd < high)"


@query(f"with {MET} select psr, toa_id, ord from met")
def bin_members(spark, sf_dir):
    return bins.members(toas(spark, sf_dir), _bins(spark, sf_dir)).select("psr", "toa_id", "ord")


@query(f"with {TOAS}, {BINS} select t.psr, toa_id, ord from toas t join bins b on t.psr = b.psr and low <= mjd and mjd <= high")
def bin_members_closed(spark, sf_dir):
    return bins.members(toas(spark, sf_dir), _bins(spark, sf_dir), strict=False).select("psr", "toa_id", "ord")


@query(f"with {TOAS}, {OWN} select psr, ord from own b where exists (select 1 from own o where o.psr = b.psr and ((b.low < o.low and o.low < b.high) or (b.low < o.high and o.high < b.high)))")
def bin_overlaps(spark, sf_dir):
    return bins.overlapping(_own(toas(spark, sf_dir)))


@query(f"with {MET}, n as (select psr, toa_id, count(*) as n from met group by all) select psr, 'improper' as kind, ord as id from bins where low >= high "
       "union all select psr, 'overlapping', ord from bins b where exists (select 1 from bins o where o.psr = b.psr and ((b.low < o.low and o.low < b.high) or (b.low < o.high and o.high < b.high))) "
       "union all select psr, 'empty', ord from bins anti join met using (psr, ord) union all select psr, 'in no bin', toa_id from toas anti join n using (psr, toa_id) union all select psr, 'in several bins', toa_id from n where n > 1")
def bin_check(spark, sf_dir):
    return bins.check(toas(spark, sf_dir), _bins(spark, sf_dir))


@query(f"with {MET} select psr, ord, min(freq_mhz) as low_freq, max(freq_mhz) as high_freq from met group by all")
def bin_frequencies(spark, sf_dir):
    return bins.frequencies(bins.members(toas(spark, sf_dir), _bins(spark, sf_dir)))


@query(f"with {MET}, w as (select *, (bw_mhz / (fratio - 1))::float as lo from met) select psr, ord, min(case when pp_dm is not null then least(freq_mhz, lo::double) else freq_mhz end) as low_freq, max(case when pp_dm is not null then greatest(freq_mhz, (bw_mhz::float + lo)::double) else freq_mhz end) as high_freq from w group by all")
def bin_frequencies_wideband(spark, sf_dir):
    return bins.frequencies(bins.members(toas(spark, sf_dir), _bins(spark, sf_dir)), wideband=True)


@query(f"with {MET} select psr, ord, min(freq_mhz) as low_freq, max(freq_mhz) as high_freq from met group by all having max(freq_mhz) / min(freq_mhz) >= 1.1::double")
def bin_ratio_passing(spark, sf_dir):
    return bins.passing(bins.members(toas(spark, sf_dir), _bins(spark, sf_dir)))


@query(f"with {CUT}, {BINS}, met as (select t.*, ord from cut_toas t join bins b on t.psr = b.psr and low < mjd and mjd < high where cut is null), p as (select psr, ord from met group by all having max(freq_mhz) / min(freq_mhz) >= 1.1::double), c as (select distinct m.psr, m.toa_id from met m join p using (psr, ord)) "
       "select t.psr, t.toa_id, coalesce(t.cut, case when c.toa_id is null then 'dmx' end) as cut from cut_toas t left join c using (psr, toa_id)")
def bin_ratio_cut(spark, sf_dir):
    t = cut_toas(spark, sf_dir).select("psr", "toa_id", "mjd", "freq_mhz", "cut")
    return bins.ratio_cut(t, _bins(spark, sf_dir, t)).select("psr", "toa_id", "cut")


@query(f"with {MET} select psr, ord, round(sum(mjd / (err_us * err_us)) / sum(1.0::double / (err_us * err_us)), 5) as epoch, count(*) as n from met group by all")
def bin_epochs(spark, sf_dir):
    return bins.epochs(bins.members(toas(spark, sf_dir), _bins(spark, sf_dir)), digits=5)


@query(f"with {MET}, g as (select psr, ord, min(freq_mhz) as f1, max(freq_mhz) as f2 from met group by all) select psr, row_number() over (partition by psr order by ord) as idx, 0.0::double as val, 0.0::double as err, low as r1, high as r2, coalesce(f1, 'inf'::double) as f1, coalesce(f2, 0.0::double) as f2 from bins left join g using (psr, ord)")
def bin_table(spark, sf_dir):
    t = toas(spark, sf_dir)
    return bins.table(t, _bins(spark, sf_dir)).drop("epoch")


E, W, P = "1e-11::double", "6.5::double", "0.05::double"
GREEDY = f"""with recursive {TOAS}, d as (select distinct psr, mjd from toas), b as (
  select psr, low, (select max(mjd) from d where d.psr = s.psr and d.mjd <= s.low + {W} + {P} + {E}) + {P} + {E} as high from (select psr, min(mjd) - {P} - {E} as low from d group by psr) s
  union all
  select psr, low, (select max(mjd) from d where d.psr = s.psr and d.mjd <= s.low + {W} + {P} + {E}) + {P} + {E} as high from (select b.psr, (select min(mjd) from d where d.psr = b.psr and d.mjd > b.high) - {P} - {E} as low from b) s where low is not null)
"""


@query(GREEDY + "select psr, row_number() over (partition by psr order by low) as ord, low, high from b")
def greedy_bins(spark, sf_dir):
    return bins.greedy(toas(spark, sf_dir), 6.5, 0.05)


EPOCHS = f"""with recursive {TOAS}, d as (select distinct psr, mjd from toas), b as (select psr, min(mjd) as m from d group by psr
  union all select psr, m from (select b.psr, (select min(mjd) from d where d.psr = b.psr and d.mjd > b.m + 6.5::double) as m from b) where m is not null)
select psr, count(*) as epochs from b group by psr"""


@query(EPOCHS)
def greedy_epoch_count(spark, sf_dir):
    return bins.epoch_counts(toas(spark, sf_dir))


@query()
def expand_bins(spark, sf_dir):
    t = settled(toas(spark, sf_dir).select("psr", "obs", "toa_id", "mjd"))
    return bins.expand(t, bins.numbered(_bins(spark, sf_dir, t).filter("low < high")), 15.0, 0.05, add_new=True)


WIND = "5.0::double * 4.8481e-6::double * (pi() - sun_angle_rad) / abs(sin(pi() - sun_angle_rad))"


@query(f"with {MET}, w as (select psr, ord, min(freq_mhz) as f, min({WIND}) as a, max({WIND}) as b from met group by all) select psr, ord from w where b / (2.41e-4::double * f * f) * 1e6 - a / (2.41e-4::double * f * f) * 1e6 > 3.0")
def solar_wind_bins(spark, sf_dir):
    return bins.solar_bins(toas(spark, sf_dir), _bins(spark, sf_dir), most_us=3.0)


@query()
def solar_wind_rebin(spark, sf_dir):
    t = toas(spark, sf_dir)
    own = bins.numbered(_bins(spark, sf_dir, t).filter("low < high"))
    return bins.rebin(t, own, bins.solar_bins(t, own, most_us=3.0), 0.5, 0.05)


@query(f"with {TOAS}, {OWN} select psr, ord from own where psr in ('PSR4', 'PSR9') and ((50000 < low and low < 50060) or (50000 < high and high < 50060))")
def event_bins(spark, sf_dir):
    events = spark.createDataFrame([(p, 50000.0, 50060.0) for p in ("PSR4", "PSR9")], "psr string, from_mjd double, to_mjd double")
    return bins.event_bins(_own(toas(spark, sf_dir)), events)


@query(f"with {TOAS}, {BINS}, p as (select distinct psr, mjd from toas), x as (select p.psr, p.mjd, ord, low, high, row_number() over (partition by p.psr, p.mjd order by abs((low + high) / 2 - p.mjd), ord) as k from p join bins b on p.psr = b.psr) select psr, mjd, ord, low < mjd and mjd < high as inside from x where k = 1")
def nearest_bin(spark, sf_dir):
    return bins.nearest_bins(toas(spark, sf_dir).select("psr", "mjd").distinct(), _bins(spark, sf_dir))


NEAR = f"""with {TOAS}, s as (select psr, f, mjd, sum(new) over (partition by psr, f order by mjd range unbounded preceding) as grp from (select *, case when mjd - lag(mjd) over (partition by psr, f order by mjd) <= 0.1::double then 0 else 1 end as new from toas)),
 m as (select psr, f, grp, round(avg(mjd), 6) as m from s group by all), c as (select a.psr, a.m as a, b.m as b, abs(a.m - b.m) as d from m a join m b on a.psr = b.psr and a.f = 'A_F' and b.f = 'R_F' and abs(a.m - b.m) < 15),
 k as (select *, row_number() over (partition by psr, a order by d, b) as ka, row_number() over (partition by psr, b order by d, a) as kb from c)"""


@query(NEAR + " select psr, a, b from k where ka = 1 and kb = 1")
def mutual_nearest_sessions(spark, sf_dir):
    t = toas(spark, sf_dir)
    low, high = (stats.group_dates(t.filter(F.col("f") == f), ["psr"], 0.1, 6) for f in ("A_F", "R_F"))
    return bins.mutual_pairs(low, high)


@query()
def early_era_bins(spark, sf_dir):
    t = toas(spark, sf_dir).withColumn("be", F.when(F.col("mjd") > 50500, "N").otherwise(F.col("be")))
    return bins.early_bins(t, "F", "N", "A_F", "R_F")


@query(f"with {TOAS}, n as (select psr, mjd, avg(resid_us) as val, avg(err_us) as err from toas where be = 'F' group by all), w as (select psr, mjd, avg(resid_us) as val, avg(err_us) as err from toas where be = 'O' group by all) "
       "select coalesce(n.psr, w.psr) as psr, coalesce(n.mjd, w.mjd) as mjd, round(n.val - w.val, 6) as diff, round(sqrt(n.err * n.err + w.err * w.err), 6) as err, case when w.psr is null then 'first only' when n.psr is null then 'second only' else 'both' end as side from n full join w on n.psr = w.psr and n.mjd = w.mjd")
def series_difference(spark, sf_dir):
    from pulsewright.operators import params

    t = toas(spark, sf_dir)
    a, b = (t.filter(F.col("be") == x).groupBy("psr", "mjd").agg(F.avg("resid_us").alias("val"), F.avg("err_us").alias("err")) for x in "FO")
    return params.series_difference(a, b)


@query(f"with {MET}, f as (select psr, ord, name, count(*) as n from met group by all) select psr, ord, name, sum(n) over (partition by psr, ord)::bigint - n as \"left\" from f")
def bin_after_drop(spark, sf_dir):
    return bins.after_drop(bins.members(toas(spark, sf_dir), _bins(spark, sf_dir)))


OLD = "o as (select psr, ord, low + case when psr = 'PSR3' then 1.0 else 1e-6 end as low, high from own where not (psr = 'PSR5' and ord = 7))"


@query(f"with {TOAS}, {OWN}, {OLD}, j as (select coalesce(b.psr, o.psr) as psr, coalesce(abs(b.low - o.low) <= 1e-5 + 1e-10 * abs(o.low) and abs(b.high - o.high) <= 1e-5 + 1e-10 * abs(o.high), false) as ok from own b full join o on b.psr = o.psr and b.ord = o.ord) select psr, bool_and(ok) as same from j group by psr")
def same_bins(spark, sf_dir):
    b = _own(toas(spark, sf_dir))
    return bins.same_bins(b, _old(b))


def _old(b):
    return b.filter("not (psr = 'PSR5' and ord = 7)").withColumn("low", F.col("low") + F.when(F.col("psr") == "PSR3", 1.0).otherwise(1e-6))


@query(f"with {TOAS}, {OWN}, {OLD} select psr, ord, low, high from own where psr in ('PSR3', 'PSR5') union all select psr, ord, low, high from o where psr not in ('PSR3', 'PSR5')")
def bins_kept_or_new(spark, sf_dir):
    b = _own(toas(spark, sf_dir))
    return bins.kept_or_new(b, _old(b))


#: The columns that the bin setup reads.
SET_UP = ["psr", "toa_id", "mjd", "obs", "freq_mhz", "sun_angle_rad", "cut"]


@query()
def dmx_setup_bins(spark, sf_dir):
    return bins.setup(cut_toas(spark, sf_dir).select(*SET_UP), most_us=3.0)[1]


@query()
def dmx_setup_cuts(spark, sf_dir):
    return bins.setup(cut_toas(spark, sf_dir).select(*SET_UP), most_us=3.0)[0].select("psr", "toa_id", "cut")


#: Bins of the whole setup but for the early era and the solar wind, said by two recursions: greedy ones, and those of windows
#: (a bin that meets a window is made anew, of the window's width). Edges that overlap move to the middle between the times.
WIDE = "case when (psr[4:])::int % 2 = 0 then 0.5::double else 2.5::double end"
REDUCED = f"""with recursive {CUT}, live as materialized (select * from cut_toas where cut is null), d as materialized (select distinct psr, mjd from live),
b as (
  select psr, low, (select max(mjd) from d where d.psr = s.psr and d.mjd <= s.low + {W} + {P} + {E}) + {P} + {E} as high from (select psr, min(mjd) - {P} - {E} as low from d group by psr) s
  union all
  select psr, low, (select max(mjd) from d where d.psr = s.psr and d.mjd <= s.low + {W} + {P} + {E}) + {P} + {E} as high from (select b.psr, (select min(mjd) from d where d.psr = b.psr and d.mjd > b.high) - {P} - {E} as low from b) s where low is not null),
hit as materialized (select psr, low, high, {WIDE} as width from b where (50000 < low and low < 50060) or (50000 < high and high < 50060)),
loose as materialized (select distinct d.psr, d.mjd, width from d join hit on d.psr = hit.psr and low < mjd and mjd < high),
n as (
  select psr, width, low, (select max(mjd) from loose l where l.psr = s.psr and l.mjd <= s.low + s.width + {E}) + {E} as high from (select psr, width, min(mjd) - {E} as low from loose group by all) s
  union all
  select psr, width, low, (select max(mjd) from loose l where l.psr = s.psr and l.mjd <= s.low + s.width + {E}) + {E} as high from (select n.psr, n.width, (select min(mjd) from loose l where l.psr = n.psr and l.mjd > n.high) - {E} as low from n) s where low is not null),
every as (select psr, low, high from b anti join hit using (psr, low, high) union all select psr, low, high from n),
span as (select e.psr, e.low, e.high, min(mjd) as first, max(mjd) as last from every e join d on d.psr = e.psr and low < mjd and mjd < high group by all),
beside as (select *, lead(low) over w as next_low, lead(first) over w as next_first, lag(high) over w as last_high, lag(last) over w as last_last from span window w as (partition by psr order by first, last, low)),
sound as (select psr, case when last_high > low then greatest(low, (last_last + first) / 2.0::double) else low end as low, case when high > next_low then least(high, (last + next_first) / 2.0::double) else high end as high from beside),
good as (select s.psr, s.low, s.high from sound s join live l on l.psr = s.psr and low < mjd and mjd < high group by all having max(freq_mhz) / min(freq_mhz) >= 1.1::double)"""


def _reduced(spark, sf_dir):
    """The setup with windows as configurations state them, and without the solar wind's splits."""
    t = settled(cut_toas(spark, sf_dir).select(*SET_UP))
    windows = F.array(F.array(F.lit(50000.0), F.lit(50060.0), F.when(F.substring("psr", 4, 9).cast("int") % 2 == 0, 0.5).otherwise(2.5)))
    configs = t.select("psr").distinct().withColumn("custom_dmx", windows)
    return bins.setup(t, events=bins.windows_of(configs), most_us=1e9)


@query(REDUCED + " select psr, row_number() over (partition by psr order by low, high) as ord, low, high from good")
def dmx_setup_windows(spark, sf_dir):
    return _reduced(spark, sf_dir)[1]


@query(REDUCED + ", c as (select distinct l.psr, l.toa_id from live l join good g on l.psr = g.psr and low < mjd and mjd < high) select t.psr, t.toa_id, coalesce(t.cut, case when c.toa_id is null then 'dmx' end) as cut from cut_toas t left join c using (psr, toa_id)")
def dmx_setup_window_cuts(spark, sf_dir):
    return _reduced(spark, sf_dir)[0].select("psr", "toa_id", "cut")


@query()
def bins_repaired(spark, sf_dir):
    """Overlapping, improper and empty bins of the whole table made sound, with bins for the times that had none."""
    t = settled(toas(spark, sf_dir).select("psr", "toa_id", "mjd"))
    return bins.repair(t, _bins(spark, sf_dir, t), t.select("psr").distinct().withColumn("width", F.lit(6.5)), cover=True)


@query(f"with {TOAS} select psr, toa_id, round({WIND}, 12) as wind from toas")
def solar_wind_dm(spark, sf_dir):
    return toas(spark, sf_dir).select("psr", "toa_id", F.round(scalar.solar_wind_dm(F.col("sun_angle_rad")), 12).alias("wind"))


@query(f"with {MET}, g as (select psr, ord, min(freq_mhz) as f1, max(freq_mhz) as f2, round(sum(mjd / (err_us * err_us)) / sum(1.0::double / (err_us * err_us)), 5) as epoch, list_sort(list(toa_id)) as members from met group by all) select psr, 4 + row_number() over (partition by psr order by ord) as idx, ord / 8.0::double as val, case when ord % 3 = 0 then 0.0::double else ord / 64.0::double end as err, epoch, low as r1, high as r2, coalesce(f1, 'inf'::double) as f1, coalesce(f2, 0) as f2, coalesce(members, []::bigint[]) as members from bins left join g using (psr, ord)")
def bin_table_members(spark, sf_dir):
    t, b = toas(spark, sf_dir), _bins(spark, sf_dir)
    values = b.select("psr", "ord", (F.col("ord") / 8.0).alias("val"), F.when(F.col("ord") % 3 != 0, F.col("ord") / 64.0).alias("err"))
    return bins.table(t, b, values, start=5, digits=5, member_ids=True)


@query(f"with {MET}, p as (select psr, ord from met group by all having max(freq_mhz) / min(freq_mhz) >= 1.1::double), c as (select distinct psr, toa_id from met semi join p using (psr, ord)) select psr, toa_id from toas anti join c using (psr, toa_id)")
def bin_ratio_rows_inverted(spark, sf_dir):
    return bins.ratio_rows(toas(spark, sf_dir), _bins(spark, sf_dir), invert=True).select("psr", "toa_id")


@query()
def event_rebin(spark, sf_dir):
    t = toas(spark, sf_dir)
    events = t.select("psr").distinct().select("psr", F.lit(50000.0).alias("from_mjd"), F.lit(50060.0).alias("to_mjd"), F.when(F.substring("psr", 4, 9).cast("int") % 2 == 0, 0.5).otherwise(2.5).alias("width"))
    return bins.rebin_events(t, bins.greedy(t, 6.5, 0.05), events)


@query(f"with {TOAS}, n as (select psr, mjd, avg(resid_us) as v from toas where be = 'F' group by all), w as (select psr, mjd, avg(resid_us) as v from toas where be = 'O' group by all), d as (select psr, round(n.v - w.v, 6) as d from n join w using (psr, mjd)) select psr, count(*) as n, round(stddev_pop(d), 6) as scatter from d group by psr")
def series_scatter(spark, sf_dir):
    from pulsewright.operators import params

    a, b = (toas(spark, sf_dir).filter(F.col("be") == x).groupBy("psr", "mjd").agg(F.avg("resid_us").alias("val"), F.avg("err_us").alias("err")) for x in "FO")
    return params.difference_scatter(params.series_difference(a, b))
