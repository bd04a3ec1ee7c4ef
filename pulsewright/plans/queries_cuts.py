"""Registered queries: cut rules and simultaneous observations, over the bound observation table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsewright.operators import cuts, stats
from pulsewright.plans.registration import query
from pulsewright.sources.binding import TOAS, rows, toas

#: The flagship's cuts: signal-to-noise, dates, a bad range; and what the same means in SQL.
START, END, SNR, LO, HI = 48700.0, 52400.0, 8.0, 50000.0, 50050.0
CUT_SQL = f"case when mjd < {START} then 'mjdstart' when mjd > {END} then 'mjdend' when snr < {SNR} then 'snr' when pout > 0.9 then 'outlier90' when {LO} < mjd and mjd < {HI} and be = 'F' then 'badrange' end"
CUT = f"{TOAS}, cut_toas as (select *, {CUT_SQL} as cut from toas)"


def cut_toas(spark, sf_dir):
    """Observations with the flagship's cut reasons, in order."""
    t = toas(spark, sf_dir)
    inside = (F.col("mjd") > LO) & (F.col("mjd") < HI) & (F.col("be") == "F")
    return cuts.apply_rules(t, [cuts.mjd_reason(F.lit(START), F.lit(END)), cuts.snr_reason(SNR), cuts.outlier_reason(0.9), cuts.reason(inside, "badrange")])


COUNTS = """select psr, dim, value, case when dim = 'cut' then sum(n) over (partition by psr, dim)::bigint else n end as total,
  case when dim = 'cut' then n else n_cut end as cut from (
  select psr, 'f' as dim, f as value, count(*) as n, count(cut) as n_cut from cut_toas group by all
  union all select psr, 'obs', obs, count(*), count(cut) from cut_toas group by all
  union all select psr, 'cut', coalesce(cut, 'good'), count(*), count(cut) from cut_toas group by all)"""


@query(f"with {CUT} {COUNTS}")
def curate_cut_counts(spark, sf_dir):
    return stats.cut_counts(cut_toas(spark, sf_dir))


@query(f"with {CUT} select psr, toa_id, cut from cut_toas")
def cut_first_reason(spark, sf_dir):
    return cut_toas(spark, sf_dir).select("psr", "toa_id", "cut")


@query(f"with {CUT} select psr, toa_id, name, mjd from cut_toas where cut is null")
def cut_survivors(spark, sf_dir):
    return cuts.survivors(cut_toas(spark, sf_dir)).select("psr", "toa_id", "name", "mjd")


@query(f"with {CUT} select psr, cut as reason, count(*) as n from cut_toas where cut is not null group by all")
def cut_reason_counts(spark, sf_dir):
    return cut_toas(spark, sf_dir).filter("cut is not null").groupBy("psr", F.col("cut").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {CUT}, counts as ({COUNTS}), x as (select *, max(case when dim = 'cut' then total end) over (partition by psr) as every from counts) "
       "select psr, dim, value, total, cut, alert from (select *, case when 100.0::double * cut / total > 75 then 'mostly cut' "
       "when dim = 'f' and 100.0::double * (total - cut) / every < 5 then 'few left' end as alert from x where dim <> 'cut') where alert is not null")
def cut_alerts(spark, sf_dir):
    return stats.cut_alerts(stats.cut_counts(cut_toas(spark, sf_dir)))


FEBE = [(f"PSR{k}", f) for k in range(0, 50, 3) for f in ("A_F", "R_O")]
FEBE_SQL = "(psr in (" + ", ".join(f"'{p}'" for p in dict(FEBE)) + ") and f in ('A_F', 'R_O'))"


@query(f"with {TOAS} select psr, toa_id from toas where {FEBE_SQL}")
def cut_orphaned(spark, sf_dir):
    rules = rows(spark, "psr string, f string", FEBE)
    return cuts.listed(toas(spark, sf_dir), rules, ["psr", "f"], "orphaned").filter("orphaned").select("psr", "toa_id")


@query(f"with {TOAS} select psr, toa_id from toas where psr in ('PSR1', 'PSR7') and (fe = 'R' or pta = '3' or obs = 'P')")
def cut_bad_groups(spark, sf_dir):
    rules = rows(spark, "psr string, flag string, value string", [(p, *r) for p in ("PSR1", "PSR7") for r in (("fe", "R"), ("pta", "3"), ("obs", "P"))])
    return cuts.bad_groups(toas(spark, sf_dir), rules).select("psr", "toa_id")


@query(f"with {TOAS} select psr, toa_id from toas where mjd < 48900 or mjd > 52000")
def cut_mjd_start_end(spark, sf_dir):
    return toas(spark, sf_dir).filter(cuts.mjd_reason(F.lit(48900.0), F.lit(52000.0)).isNotNull()).select("psr", "toa_id")


@query(f"with {TOAS} select psr, toa_id, snr from toas where snr < 8")
def cut_snr(spark, sf_dir):
    return toas(spark, sf_dir).filter(cuts.snr_reason(8.0).isNotNull()).select("psr", "toa_id", "snr")


@query(f"with {TOAS} select psr, toa_id, case when coalesce(pout, 0) > 0.1 then 'outlier10' end as cut from toas")
def cut_outliers(spark, sf_dir):
    return toas(spark, sf_dir).select("psr", "toa_id", cuts.outlier_reason(0.1).alias("cut"))


@query(f"with {TOAS}, r as (select psr, 49000.0 + k * 500 as lo, 49000.0 + k * 500 + 60 as hi, case when k % 2 = 0 then 'O' end as range_be from (select distinct psr from toas), range(5) t(k)) "
       "select psr, toa_id from toas t where exists (select 1 from r where r.psr = t.psr and lo < mjd and mjd < hi and (range_be is null or range_be = be))")
def cut_bad_ranges(spark, sf_dir):
    ranges = rows(spark, "psr string, lo double, hi double, range_be string", [(f"PSR{p}", 49000.0 + k * 500, 49060.0 + k * 500, None if k % 2 else "O") for p in range(50) for k in range(5)])
    return cuts.bad_ranges(toas(spark, sf_dir), ranges).filter("in_bad_range").select("psr", "toa_id")


@query(f"with {TOAS}, x as (select *, 4.0::double + (psr[4:])::int as pb from toas), y as (select *, (mjd - 50000.0) / pb as turns from x) "
       "select psr, toa_id from y where turns - floor(turns) > 0.4 and turns - floor(turns) < 0.5")
def cut_orbital_phase(spark, sf_dir):
    from pulsewright.functions import scalar

    t = toas(spark, sf_dir)
    pb = F.lit(4.0) + F.substring("psr", 4, 9).cast("int")
    phase = scalar.orbital_phase(F.col("mjd"), F.lit(50000.0), pb)
    return t.withColumn("phase", phase).filter("phase > 0.4 and phase < 0.5").select("psr", "toa_id")


FILES = ["file_1001", "file_77", "file_123", "file_5", "file_999999999"]


@query(f"with {CUT}, e as (select 'PSR' || k::varchar as psr, p as pattern from range(50) t(k), (select unnest({FILES}) as p)), "
       "n as (select psr, name, count(*) as n, count(cut) as n_cut from cut_toas group by all), "
       "m as (select e.psr, e.pattern, count(n.name) as files, min(n.name) as name, sum(n.n) as n_toas, sum(n.n_cut) as n_cut from e left join n on e.psr = n.psr and contains(n.name, e.pattern) group by e.psr, e.pattern) "
       "select psr, pattern, files, case when files = 1 then name end as name, case when files <> 1 then 'not one file' when n_toas = n_cut then 'redundant' else 'cut' end as status from m")
def cut_bad_files(spark, sf_dir):
    entries = rows(spark, "psr string, pattern string", [(f"PSR{k}", p) for k in range(50) for p in FILES])
    return cuts.bad_files(cut_toas(spark, sf_dir), entries)


ENTRY = "e as (select distinct psr, name, 1 as chan, subint from toas where toa_id % 97 = 0 union select 'PSR3', 'nosuchfile', 1, 0)"


def _entries(t):
    extra = t.sparkSession.createDataFrame([("PSR3", "nosuchfile", 1, 0)], "psr string, name string, chan int, subint int")
    return t.filter("toa_id % 97 = 0").select("psr", "name", F.lit(1).alias("chan"), "subint").union(extra).distinct()


@query(f"with {CUT}, {ENTRY}, m as (select c.psr, c.name, c.chan, c.subint, c.toa_id, c.cut, row_number() over (partition by c.psr, c.name, c.chan, c.subint order by c.toa_id) as k from cut_toas c join e using (psr, name, chan, subint)) "
       "select e.psr, e.name, e.chan, e.subint, m.toa_id, case when m.toa_id is null then 'unmatched' when m.cut is not null then 'already cut' else 'badtoa' end as status from e left join (select * from m where k = 1) m using (psr, name, chan, subint)")
def cut_bad_toas(spark, sf_dir):
    t = cut_toas(spark, sf_dir)
    return cuts.bad_toas(t, _entries(t))


@query(f"with {CUT}, e as (select distinct psr, name from toas where toa_id % 101 = 0), m as (select c.psr, c.name, min(c.toa_id) as toa_id from cut_toas c join e using (psr, name) group by all) "
       "select m.psr, m.name, m.toa_id, case when c.cut is not null then 'already cut' else 'badtoa' end as status from m join cut_toas c using (psr, toa_id)")
def cut_bad_toas_averaged(spark, sf_dir):
    t = cut_toas(spark, sf_dir)
    return cuts.bad_toas(t, t.filter("toa_id % 101 = 0").select("psr", "name").distinct(), keys=("name",))


@query(f"with {CUT} select psr, toa_id, coalesce(cut, case when pp_dm is null then 'no_ppdm' end) as cut from cut_toas")
def cut_no_ppdm(spark, sf_dir):
    return cuts.no_ppdm(cut_toas(spark, sf_dir)).select("psr", "toa_id", "cut")


@query(f"with {CUT}, x as (select *, count(*) over w as n, count(*) filter (cut like '%outlier%') over w as bad from cut_toas window w as (partition by psr, name)) "
       "select psr, toa_id, coalesce(cut, case when bad > round_even(n * 8.0::double / 100.0::double, 0) then 'maxout' end) as cut from x")
def cut_file_outliers(spark, sf_dir):
    return cuts.file_outliers(cut_toas(spark, sf_dir)).select("psr", "toa_id", "cut")


@query(f"with {TOAS} select psr, toa_id, case when snr < 8 then 'snr' when mjd > 52000 then 'mjdend' when pp_dm is null then 'no_ppdm' when subint = 3 then 'badtoa' end as cut, "
       "case when snr < 8 or mjd > 52000 then 'initial' when pp_dm is null then 'ppdm' when subint = 3 then 'manual' end as cut_stage from toas")
def cut_stages(spark, sf_dir):
    plan = [
        ("initial", [cuts.snr_reason(8.0), cuts.reason(F.col("mjd") > 52000.0, "mjdend")]),
        ("ppdm", [cuts.reason(F.col("pp_dm").isNull(), "no_ppdm")]),
        ("manual", [cuts.reason(F.col("subint") == 3, "badtoa")]),
    ]
    return cuts.stages(toas(spark, sf_dir), plan).select("psr", "toa_id", "cut", "cut_stage")


@query(f"with {TOAS}, s as (select psr, case when snr < 8 or mjd > 52000 then 0 when pp_dm is null then 1 when subint = 3 then 2 end as k from toas), st(k, stage) as (values (0, 'initial'), (1, 'ppdm'), (2, 'manual')), n as (select p.psr, st.k, stage, p.total, (select count(*) from s where s.psr = p.psr and s.k = st.k) as removed from (select psr, count(*) as total from s group by psr) p, st) "
       "select psr, stage, (total - coalesce(sum(removed) over (partition by psr order by k rows between unbounded preceding and 1 preceding), 0))::bigint as before, removed from n")
def cut_stage_counts(spark, sf_dir):
    plan = [
        ("initial", [cuts.snr_reason(8.0), cuts.reason(F.col("mjd") > 52000.0, "mjdend")]),
        ("ppdm", [cuts.reason(F.col("pp_dm").isNull(), "no_ppdm")]),
        ("manual", [cuts.reason(F.col("subint") == 3, "badtoa")]),
    ]
    return cuts.stage_counts(cuts.stages(toas(spark, sf_dir), plan), ["initial", "ppdm", "manual"])


@query(f"with {CUT}, m as (select p.pattern, n.psr, n.name, count(*) over (partition by n.psr, p.pattern) as k from (select distinct psr, name from toas) n join (select unnest({FILES}) as pattern) p on contains(n.name, p.pattern)) "
       "select t.psr, t.toa_id, coalesce(t.cut, case when m.name is not null then 'badfile' end) as cut from cut_toas t left join (select distinct psr, name from m where k = 1) m using (psr, name)")
def cut_bad_file_rows(spark, sf_dir):
    t = cut_toas(spark, sf_dir)
    entries = t.select("psr").distinct().select("psr", F.explode(F.array(*map(F.lit, FILES))).alias("pattern"))
    return cuts.cut_bad_files(t, entries).select("psr", "toa_id", "cut")


@query(f"with {TOAS} select psr, name, chan, subint from toas where (abs(resid_us) > 3 and abs(resid_us / err_us) > 3) or err_us > 1.2")
def cut_large_residuals(spark, sf_dir):
    return toas(spark, sf_dir).filter(cuts.large_residuals(us=3.0, n_sigma=3.0, max_sigma=1.2)).select("psr", "name", "chan", "subint")


@query(f"with {TOAS}, d as (select *, pp_dm - 20.05::double as dm_resid, pp_dme as dm_err from toas) select psr, toa_id from d where (abs(resid_us) > 4 and abs(resid_us / err_us) > 4) or err_us > 1.25 or (((abs(dm_resid) > 0.03 and abs(dm_resid / dm_err) > 4) or dm_err > 1.25) and fe <> 'A')")
def cut_large_dm_residuals(spark, sf_dir):
    be = F.when(F.col("fe") == "A", "GASP").otherwise("GUPPI")
    t = toas(spark, sf_dir).withColumns({"dm_resid": F.col("pp_dm") - F.lit(20.05), "dm_err": F.col("pp_dme"), "be": be})
    return t.filter(cuts.large_residuals(us=4.0, n_sigma=4.0, max_sigma=1.25, dm=0.03)).select("psr", "toa_id")


@query(f"with {CUT}, p as (select a.psr, a.toa_id as one, b.toa_id as two from cut_toas a join cut_toas b on a.psr = b.psr and floor(a.mjd) = floor(b.mjd) and a.fe = b.fe and a.be = 'F' and b.be = 'O' and b.cut is null "
       "and a.freq_mhz + a.bw_mhz / 2 >= b.freq_mhz - b.bw_mhz / 2 and b.freq_mhz + b.bw_mhz / 2 >= a.freq_mhz - a.bw_mhz / 2), "
       "m as (select psr, one as toa_id, '1' as simul from p union select psr, two, '2' from p) "
       "select psr, toa_id, simul, coalesce(cut, case when simul = '2' then 'simul' end) as cut from cut_toas left join m using (psr, toa_id)")
def simultaneous_overlap(spark, sf_dir):
    return cuts.simultaneous(cut_toas(spark, sf_dir).select("psr", "toa_id", "mjd", "fe", "be", "freq_mhz", "bw_mhz", "cut"), "F", "O").select("psr", "toa_id", "simul", "cut")


@query(f"with {TOAS} select distinct psr, regexp_replace(f, '_(F|O)', '') as receiver from toas")
def receiver_of_backend(spark, sf_dir):
    return toas(spark, sf_dir).select("psr", cuts.receiver_of("f", ("F", "O")).alias("receiver")).distinct()


@query(f"with {TOAS} select psr, bool_or(obs = 'P' and mjd > 51000 and mjd < 51500) as bad_lo from toas group by psr")
def bad_lo_window(spark, sf_dir):
    return cuts.bad_oscillator(toas(spark, sf_dir), "P", 51000.0, 51500.0)


@query(f"with {CUT} select psr, mjd, freq_mhz, resid_us, err_us, coalesce(cut, 'good') as cut from cut_toas where cut is null or cut in ('snr', 'outlier90')")
def residual_series(spark, sf_dir):
    return cuts.residual_series(cut_toas(spark, sf_dir), ["good", "snr", "outlier90"])


@query(f"with {CUT} select distinct psr, name from cut_toas where cut = 'outlier90'")
def files_with_cut(spark, sf_dir):
    return cuts.files_with(cut_toas(spark, sf_dir), "outlier90")


@query(f"with {CUT}, d as (select psr, name from cut_toas group by psr, name having count(*) = 1) select t.psr, t.toa_id, coalesce(t.cut, case when d.name is not null then 'epochdrop' end) as cut from cut_toas t left join d using (psr, name)")
def cut_epochdrop(spark, sf_dir):
    t = cut_toas(spark, sf_dir)
    dropped = t.groupBy("psr", "name").count().filter("count = 1")
    marked = cuts.listed(t, dropped, ["psr", "name"], "dropped")
    return cuts.apply_rules(marked, [cuts.reason(F.col("dropped"), "epochdrop")]).select("psr", "toa_id", "cut")
