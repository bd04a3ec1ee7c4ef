"""Registered queries: whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsewright.operators import cuts, params, stats
from pulsewright.operators.settle import settled
from pulsewright.plans import jobs, queries_text  # noqa: F401  registers what some jobs name
from pulsewright.plans.queries_bins import BINS, _bins
from pulsewright.plans.queries_cuts import CUT, CUT_SQL, END, FILES, HI, LO, SNR, START, cut_toas
from pulsewright.plans.queries_noise import TESTS, _tests
from pulsewright.plans.queries_params import CFG, LOG, NAMED, _configs, _file_lists, _jumps, _log, _models, _named_params, _noise_rows, _settings
from pulsewright.plans.registration import ORACLES, QUERIES, query
from pulsewright.sources.binding import CHAINS, TOAS, chains, params_sql, read, toas, toas_by_file
from pulsewright.sources.binding import params as model_params


@query(f"with {TOAS}, d as materialized (select psr, toa_id, fe, be, floor(mjd)::bigint as day, freq_mhz - bw_mhz / 2 as lo, freq_mhz + bw_mhz / 2 as hi from toas), two as (select distinct b.psr, b.toa_id from d b join d a on a.psr = b.psr and a.day = b.day and a.fe = b.fe where a.be = 'F' and b.be = 'O' and a.hi >= b.lo and b.hi >= a.lo) "
       f"select t.psr, t.toa_id, case when two.toa_id is not null then 'simul' else {CUT_SQL} end as cut from toas t left join two using (psr, toa_id)")
def job_curate(spark, sf_dir):
    inside = (F.col("mjd") > LO) & (F.col("mjd") < HI) & (F.col("be") == "F")
    rules = [cuts.mjd_reason(F.lit(START), F.lit(END)), cuts.snr_reason(SNR), cuts.outlier_reason(0.9), cuts.reason(inside, "badrange")]
    t = toas(spark, sf_dir).select("psr", "toa_id", "mjd", "fe", "be", "freq_mhz", "bw_mhz", "snr", "pout")
    return jobs.curate(t, rules, "F", "O").select("psr", "toa_id", "cut")


DESIGN = {"t": "(mjd - 50500) / 1000", "one": "1.0", "inv": "1e6 / (freq_mhz * freq_mhz)"}


def _excision(spark, sf_dir, of, ids):
    columns = {n: F.expr(e).cast("double") for n, e in DESIGN.items()}
    t = toas_by_file(spark, sf_dir, ids).select("psr", "toa_id", "name", "mjd", "obs", "freq_mhz", "sun_angle_rad", "pout", "resid_us", "err_us", F.lit(None).cast("string").alias("cut"))
    return of(t, columns, prob=0.95, threshold=1e-3, most_us=3.0)


@query()
def job_outlier_excision_tests(spark, sf_dir):
    tests = _excision(spark, sf_dir, jobs.excision_tests, ids=False)[1]
    return tests.withColumn("name", F.concat(F.lit("file_"), F.col("name").cast("string")))


@query()
def job_outlier_excision_cuts(spark, sf_dir):
    return _excision(spark, sf_dir, jobs.outlier_excision, ids=True)[0].select("psr", "toa_id", "cut")


@query(f"with {CHAINS}, k as (select *, row_number() over (partition by chain order by sample) - 1 as k, count(*) over (partition by chain) as n from chains), t as (select *, row_number() over (partition by chain order by vals[len(vals)] desc, sample desc) as r from k where k >= floor(n * 0.25::double)), "
       "x as (select chain, pos, round(avg(vals[pos + 1]), 9) as m from t, range(64) p(pos) where r <= 10 group by all) "
       "select chain as psr, (['EFAC', 'EQUAD', 'ECORR'])[1 + (pos % 3)::int] as kind, 1 + pos // 3 as number, 'r' || pos::varchar as mask_value, round(case when pos % 3 = 0 then m else pow(10.0::double, m) * 1e6::double end, 2) as value from x")
def job_noise_to_params(spark, sf_dir):
    c = chains(spark, sf_dir)
    ending = F.element_at(F.array(F.lit("efac"), F.lit("log10_t2equad"), F.lit("log10_ecorr")), F.col("pos") % 3 + 1)
    names = c.select("chain").distinct().select("chain", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("pos")).select("chain", "pos", F.col("chain").alias("psr"), F.concat_ws("_", "chain", F.concat(F.lit("r"), F.col("pos").cast("string")), ending).alias("name"))
    return jobs.noise_to_params(c, names, n=10, digits=2)


SUMMARY = f"""with {CUT}, live as (select * from cut_toas where cut is null), m as (select psr, f, resid_us as v, 1.0::double / (err_us * err_us) as w from live), a as (select psr, f, v - avg(v) over (partition by psr) as x, w from m),
 s as (select psr, case when grouping(f) = 1 then 'All' else f end as f, round(stddev_pop(x), 6) as rms, round(sqrt(greatest(0.0, sum(w * x * x) / sum(w) - pow(sum(w * x) / sum(w), 2))), 6) as wrms from a group by grouping sets ((psr), (psr, f)))
 select psr, 'rms' as item, f as label, rms as value from s union all select psr, 'wrms', f, wrms from s union all select psr, 'years', 'All', round((max(mjd) - min(mjd)) / 365.25::double, 9) from toas group by psr
 union all select psr, 'cut_pct', f, round(100.0::double * count(cut) / count(*), 6) from cut_toas group by psr, f"""


@query(SUMMARY)
def job_timing_summary(spark, sf_dir):
    return jobs.timing_summary(cut_toas(spark, sf_dir))


@query(f"with {TOAS}, {BINS}, n as (select psr, mjd, avg(resid_us) as val, avg(err_us) as err from toas where be = 'F' group by all), w as (select psr, mjd, avg(resid_us) as val, avg(err_us) as err from toas where be = 'O' group by all), d as (select psr, mjd from n join w using (psr, mjd) where abs(round(n.val - w.val, 6)) > 3.0 * round(sqrt(n.err * n.err + w.err * w.err), 6)), "
       "x as (select d.psr, d.mjd, ord, low, high, row_number() over (partition by d.psr, d.mjd order by abs((low + high) / 2 - d.mjd), ord) as k from d join bins b on d.psr = b.psr), g as (select distinct psr, ord, low, high from x where k = 1 and low < mjd and mjd < high) select distinct t.psr, g.ord, t.name from toas t join g on t.psr = g.psr and g.low < t.mjd and t.mjd < g.high")
def job_series_compare(spark, sf_dir):
    t = toas(spark, sf_dir)
    a, b = (t.filter(F.col("be") == x).groupBy("psr", "mjd").agg(F.avg("resid_us").alias("val"), F.avg("err_us").alias("err")) for x in "FO")
    return jobs.nbwb_compare(a, b, _bins(spark, sf_dir), t)


@query(f"with {CFG}, u as (select r.n_nationkey as result, count(distinct c.config) as n from nation r left join c on c.result = r.n_nationkey group by all), s as (select split_part(config, '.', 1) as source, count(distinct split_part(config, '.', 2)) as n from c group by all), f as (select config, count(*) as n from c group by config) "
       "select 'result' as kind, result::varchar as id, case when n = 0 then 'unused' else 'shared' end as problem from u where n <> 1 union all select 'source', source, 'one mode only' from s where n < 2 union all select 'product', config, 'multiple' from f where n > 1 union all select 'product', 'absent.yaml', 'missing'")
def job_release_audit(spark, sf_dir):
    c = _configs(spark, sf_dir)
    found = c.select(F.col("config").alias("product"))
    expected = found.distinct().union(spark.createDataFrame([("absent.yaml",)], "product string"))
    return jobs.release_audit(c.select("config", "result"), read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("result")), expected, found)


@query(f"with {params_sql('p')} select psr, name, value from p where not (starts_with(name, 'PROMO') or starts_with(name, 'SMALL'))")
def remove_noise_components(spark, sf_dir):
    p = model_params(spark, sf_dir).withColumn("component", F.regexp_extract("name", "^[A-Z]+", 0))
    return params.remove_noise(p, ["PROMO", "SMALL"]).select("psr", "name", "value")


@query(f"with {CUT} select psr, cut, name, chan, subint from cut_toas where cut in ('badrange', 'outlier90')")
def auto_excised_lookup(spark, sf_dir):
    return cuts.excised(cut_toas(spark, sf_dir), ["badrange", "outlier90"])


@query(f"with {CUT}, a as (select 'file_' || o_orderkey::varchar as name, '/data/' || o_orderstatus || '/file_' || o_orderkey::varchar as path from orders where o_orderpriority <> '1-URGENT') select psr, cut, name, chan, subint, path from cut_toas left join a using (name) where cut in ('badrange', 'outlier90')")
def auto_excised_archives(spark, sf_dir):
    o = read(spark, sf_dir, "orders").filter("o_orderpriority <> '1-URGENT'")
    paths = o.select(F.concat(F.lit("/data/"), "o_orderstatus", F.lit("/file_"), F.col("o_orderkey").cast("string")).alias("path"))
    return cuts.excised(cut_toas(spark, sf_dir), ["badrange", "outlier90"], paths)


#: The columns that configurations ask for.
CURATED = ["psr", "toa_id", "name", "mjd", "f", "fe", "be", "obs", "pta", "freq_mhz", "bw_mhz", "snr", "pout", "chan", "subint", "pp_dm"]
K = "(psr[4:])::int"
SET = f"""{TOAS}, g as (select *, {K} as k, 4.0::double + {K} as pb from toas), ph as (select *, (mjd - 50000.0) / pb - floor((mjd - 50000.0) / pb) as phase from g),
 fm as (select p.pattern, n.psr, n.name, count(*) over (partition by n.psr, p.pattern) as c from (select distinct psr, name from toas) n join (select unnest({FILES}) as pattern) p on contains(n.name, p.pattern)), bf as (select distinct psr, name from fm where c = 1),
 one as (select psr, min(toa_id) as toa_id from toas where (psr, name, chan, subint) in (select (psr, name, chan, subint) from toas where toa_id in (97, 98, 40) and {K} % 2 = 0) and {K} % 2 = 0 group by psr, name, chan, subint),
 two as (select psr, min(toa_id) as toa_id from toas where (psr, name, subint) in (select (psr, name, subint) from toas where toa_id in (97, 98, 40)) and {K} % 2 = 1 group by psr, name, subint),
 av as (select psr, min(toa_id) as toa_id from toas where (psr, name) in (select (psr, name) from toas where toa_id in (50, 51)) group by psr, name)"""


def _ignore(t):
    """Configurations of all sources: each rule for some of them, the numbers and lists by the source's own number."""
    k = F.substring("psr", 4, 9).cast("int")
    texts = F.array().cast("array<string>")
    group = F.array(*[F.struct(F.lit(a).alias("flag"), F.lit(b).alias("value")) for a, b in (("pta", "3"), ("obs", "P"))])
    span = F.struct((k + 50000.0).alias("lo"), (k + 50050.0).alias("hi"), F.when(k % 2 == 0, "F").alias("be"))
    of = F.struct("name", F.col("chan").cast("int").alias("chan"), "subint", F.lit("x").alias("reason"))
    listed = t.filter("toa_id in (97, 98, 40, 50, 51)").groupBy("psr").agg(F.collect_list(F.when(~F.col("toa_id").isin(50, 51), of)).alias("bad_toa"), F.collect_set(F.when(F.col("toa_id").isin(50, 51), F.col("name"))).alias("averaged"))
    ignore = F.struct(
        F.when(k % 3 == 0, F.array(F.lit("A_F"))).otherwise(texts).alias("orphaned_rec"), F.when(k % 5 == 0, group).alias("bad_group"), F.when(k % 2 == 0, k + 48700.0).alias("mjd_start"), (F.lit(52400.0) - k).alias("mjd_end"), (k % 5 + 5.0).alias("snr_cut"),
        F.when(k % 4 == 1, F.array(F.lit("N_O"))).alias("poor_febe"), F.when(k % 7 != 3, F.lit(0.9)).alias("prob_outlier"), F.array(span).alias("bad_range"), F.when(k % 7 == 0, F.array(F.lit(0.4), F.lit(0.5))).alias("orb_phase_range"),
        F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit("x").alias("reason")) for p in FILES]).alias("bad_file"), "bad_toa", F.col("averaged").alias("bad_toa_averaged"),
    )
    return t.select("psr").distinct().join(listed, "psr", "left").select("psr", F.when(k % 2 == 0, "NB").otherwise("WB").alias("mode"), ignore.alias("ignore"))


@query(f"""with {SET} select ph.psr, ph.toa_id, case when f = 'A_F' and k % 3 = 0 then 'orphaned' when k % 5 = 0 and (pta = '3' or obs = 'P') then 'badgroup' when k % 2 = 0 and mjd < 48700.0 + k then 'mjdstart' when mjd > 52400.0 - k then 'mjdend' when snr < 5 + k % 5 then 'snr'
 when k % 4 = 1 and f = 'N_O' then 'poorfebe' when k % 7 <> 3 and pout > 0.9 then 'outlier90' when bf.name is not null then 'badfile' when 50000.0 + k < mjd and mjd < 50050.0 + k and (k % 2 = 1 or be = 'F') then 'badrange' when k % 7 = 0 and phase > 0.4 and phase < 0.5 then 'eclipsing'
 when one.toa_id is not null or two.toa_id is not null then 'badtoa' when av.toa_id is not null then 'badtoa-averaged' end as cut
 from ph left join bf on ph.psr = bf.psr and ph.name = bf.name left join one on ph.psr = one.psr and ph.toa_id = one.toa_id left join two on ph.psr = two.psr and ph.toa_id = two.toa_id left join av on ph.psr = av.psr and ph.toa_id = av.toa_id""")
def job_curate_configured(spark, sf_dir):
    t = settled(toas(spark, sf_dir).select(*CURATED))
    orbits = t.select("psr").distinct().select("psr", (F.lit(4.0) + F.substring("psr", 4, 9).cast("int")).alias("pb"), F.lit(50000.0).alias("epoch"))
    return jobs.ignored(t, _ignore(t), orbits).select("psr", "toa_id", "cut")


STAGED = f"""{SET}, d as materialized (select psr, toa_id, fe, be, floor(mjd)::bigint as day, freq_mhz - bw_mhz / 2 as lo, freq_mhz + bw_mhz / 2 as hi from toas),
 seen as (select distinct b.psr, b.toa_id from d b join d a on a.psr = b.psr and a.day = b.day and a.fe = b.fe where a.be = 'F' and b.be = 'O' and a.hi >= b.lo and b.hi >= a.lo),
 bent as (select *, case when k % 2 = 0 then (mjd - 50000.0) * 86400.0::double * (1.0::double / (86400.0::double * pb)) else (mjd - 50000.0) / pb - 0.5::double * 1e-6::double * ((mjd - 50000.0) / pb) * ((mjd - 50000.0) / pb) end as turns from g)"""


@query(f"""with {STAGED} select b.psr, b.toa_id, case when seen.toa_id is not null then 'simul' when f = 'A_F' and k % 3 = 0 then 'orphaned' when k % 5 = 0 and (pta = '3' or obs = 'P') then 'badgroup' when k % 2 = 0 and mjd < 48700.0 + k then 'mjdstart' when mjd > 52400.0 - k then 'mjdend' when snr < 5 + k % 5 then 'snr'
 when k % 4 = 1 and f = 'N_O' then 'poorfebe' when k % 7 <> 3 and pout > 0.9 then 'outlier90' when 50000.0 + k < mjd and mjd < 50050.0 + k and (k % 2 = 1 or be = 'F') then 'badrange' when k % 7 = 0 and turns - floor(turns) > 0.4 and turns - floor(turns) < 0.5 then 'eclipsing' when k % 2 = 1 and pp_dm is null then 'no_ppdm'
 when one.toa_id is not null or two.toa_id is not null then 'badtoa' when av.toa_id is not null then 'badtoa-averaged' when bf.name is not null then 'badfile' end as cut
 from bent b left join seen on b.psr = seen.psr and b.toa_id = seen.toa_id left join bf on b.psr = bf.psr and b.name = bf.name left join one on b.psr = one.psr and b.toa_id = one.toa_id left join two on b.psr = two.psr and b.toa_id = two.toa_id left join av on b.psr = av.psr and b.toa_id = av.toa_id""")
def job_curate_by_stages(spark, sf_dir):
    """From raw rows and configurations to cuts; orbits by frequency, or by a period with its derivative."""
    return _staged(spark, sf_dir)[0].select("psr", "toa_id", "cut")


@query(f"with {TOAS}, h as (select psr, f from toas group by all having count(distinct name) <= 12), w as (select distinct psr, 'A_F' as f from toas where {K} % 3 = 0) select psr, f, 'add' as change from h anti join w using (psr, f) union all select psr, f, 'remove' from w anti join h using (psr, f)")
def job_curate_orphan_changes(spark, sf_dir):
    t = settled(toas(spark, sf_dir))
    return stats.listed_receivers(t, _ignore(t).select("psr", F.explode("ignore.orphaned_rec").alias("f")), 12)


def _staged(spark, sf_dir):
    t = settled(toas(spark, sf_dir).select(*CURATED))
    k = F.substring("psr", 4, 9).cast("int")
    days, by_turns = F.lit(4.0) + k, k % 2 == 0
    orbits = t.select("psr").distinct().select("psr", F.lit(50000.0).alias("epoch"), F.when(~by_turns, days).alias("pb"), F.lit(1e-6).alias("pbdot"), F.when(by_turns, F.lit(1.0) / (F.lit(86400.0) * days)).alias("fb0"))
    return jobs.curate_configured(t, _ignore(t), "F", "O", orbits)


@query(f"with {SET}, c as (select psr, case when pout > 0.95 then 'outlier10' when snr < 3 then 'epochdrop' when snr < 8 then 'snr' end as cut from toas), n as (select psr, count(*) as total, count(cut) as cut, count(*) filter (cut = 'outlier10') as outlier10, count(*) filter (cut = 'epochdrop') as epochdrop from c group by psr union all select null, count(*), count(cut), count(*) filter (cut = 'outlier10'), count(*) filter (cut = 'epochdrop') from c) "
       f"select psr, 'rows' as item, unnest(['total', 'cut', 'outlier10', 'epochdrop']) as label, unnest([total, cut, outlier10, epochdrop]) as n from n union all select null, 'bad-toa', 'x', count(*) from toas where toa_id in (97, 98, 40) union all select null, 'bad-file', 'x', count(distinct psr) * {len(FILES)} from toas")
def job_excision_reports(spark, sf_dir):
    t = toas(spark, sf_dir)
    c = F.when(F.col("pout") > 0.95, "outlier10").when(F.col("snr") < 3, "epochdrop").when(F.col("snr") < 8, "snr")
    return jobs.excision_reports(t.withColumn("cut", c), _ignore(t))


@query(f"with {TOAS} select psr, toa_id, case when be = 'F' then f else obs end as f, fe, case when be = 'F' then 'first' else 'P' || pta end as pta, case when be = 'O' then snr end as snr from toas")
def job_reflag_and_combine(spark, sf_dir):
    """Two timing arrays: one with flags of the standard, one whose receiver-backend is called sys and which has no array's name."""
    t = toas(spark, sf_dir)
    mine = t.filter("be = 'F'").select("psr", "toa_id", F.create_map(F.lit("f"), F.col("f"), F.lit("fe"), F.col("fe"), F.lit("pta"), F.lit("first")).alias("flags"))
    theirs = t.filter("be = 'O'").select("psr", "toa_id", "snr", F.create_map(F.lit("sys"), F.col("obs"), F.lit("r"), F.col("fe"), F.lit("name"), F.concat(F.lit("P"), "pta")).alias("flags"))
    both = jobs.reflag_and_combine([(mine, {}), (theirs, {"pta": F.element_at("flags", "name")})])
    return both.select("psr", "toa_id", *[F.col("flags")[c].alias(c) for c in ("f", "fe", "pta")], "snr")


@query(f"with {TOAS}, u as (select 'S' || (o_custkey % 40)::varchar as source, max('run_' || lpad((o_orderkey % 900)::varchar, 3, '0')) as newest from orders group by all), {LOG}, lg as (select config, count(*) filter (entry like '% OOPS: %') as bad, count(*) filter (entry like '% READY\\_FOR: %' escape '\\') as ready from l group by config), r as (select psr, count(distinct pta) as v, min(pta) as first from toas group by psr) "
       "select 'config' as kind, 'S' || c_custkey::varchar as id, 'not cleared' as problem from customer where c_custkey % 3 = 0 union all select 'log', config, 'unknown tags' from lg where bad > 0 union all select 'log', config, 'not ready' from lg where ready = 0 union all select 'release', psr, 'mixed' from r where v > 1 union all select 'release', psr, 'old' from r where first = '1' union all select 'noise', source, 'stale' from u where newest <> 'run_899' "
       f"union all select 'files', config, 'lists differ' from ({ORACLES['config_vs_release_files']}) group by config union all select 'model', source || '.' || mode, 'not the latest' from ({ORACLES['latest_par_by_date']}) where source like '%3' and previous is not null")
def job_release_state(spark, sf_dir):
    check = F.create_map(F.lit("toa_outliers"), F.when(F.col("c_custkey") % 3 == 0, "todo"), F.lit("cleared"), F.lit("yes"))
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("config"), check.alias("check"))
    source = F.concat(F.lit("S"), (F.col("o_custkey") % 40).cast("string"))
    runs = read(spark, sf_dir, "orders").select(source.alias("source"), F.concat(F.lit("/noise/"), source, F.lit("/run_"), F.lpad((F.col("o_orderkey") % 900).cast("string"), 3, "0"), F.lit("/chain.txt")).alias("path"))
    used = runs.select("source").distinct().withColumn("used", F.lit("run_899"))
    models = QUERIES["latest_par_by_date"](spark, sf_dir)  # sources whose number ends in 3 still use the one before the latest
    in_use = models.select("source", "mode", F.when(F.col("source").endswith("3"), F.coalesce("previous", "latest")).otherwise(F.col("latest")).alias("file"))
    named_ = models.select(F.explode(F.array_compact(F.array("latest", "previous"))).alias("file"))
    lists = _file_lists(spark, sf_dir)
    return jobs.release_state(c, _log(spark, sf_dir), ["INIT", "READY_FOR", "NOISE", "CURATE"], toas(spark, sf_dir).withColumn("ver", F.col("pta")), ("1",), runs.select("path"), used, lists, (named_, in_use))


SPANS = "sp as (select 'S' || o_custkey::varchar as psr, round_even((40587 + date_diff('day', date '1970-01-01', min(o_orderdate)::date) + 40587 + date_diff('day', date '1970-01-01', max(o_orderdate)::date)) / 2.0::double, 0) as centre from orders group by all)"
CHECKED = f"with {NAMED}, {SPANS}, {TESTS}, v as (select *, 50000.0::double + length(name) as value from np), h as (select psr, max(value) filter (name = 'PB') as pb, max(value) filter (name = 'FB0') as fb from v group by psr), e as (select v.psr, name, centre, abs(value - centre) as d, coalesce(pb, 1.0::double / fb / 86400.0::double) as period from v join h using (psr) join sp using (psr) where name in ('TASC', 'T0')) "


@query(CHECKED + f"""select psr, 'spin' as item, unnest(list_filter([case when not f0_fitted then 'F0' end, case when not f1_fitted then 'F1' end, case when further > 0 then 'further' end], lambda x: x is not null)) as label, unnest(list_filter([case when not f0_fitted then 'not fitted' end, case when not f1_fitted then 'not fitted' end, case when further > 0 then 'more derivatives' end], lambda x: x is not null)) as value from ({ORACLES['spin_check']})
 union all select psr, 'astrometry', name, problem from ({ORACLES['astrometry_check']}) where not (name = 'FRAME' and problem = 'equatorial') union all select psr, 'astrometry', 'FRAME', 'no frame' from np group by psr having bool_or(name = 'F2') and not bool_or(name in ('ELONG', 'ELAT'))
 union all select psr, 'binary', name, problem from ({ORACLES['binary_check']}) union all select psr, 'epoch', name, centre::varchar from e where d > 1 + period
 union all select psr, 'moved', name, 'both' from v where length(name) > 3
 union all select psr, action, label, 'by F-test' from ({ORACLES['ftest_recommendations']})
 union all select psr, 'jump', coalesce(fe, 'all'), violation from ({ORACLES['jump_check']}) union all select psr, 'dm jump', coalesce(fe, 'all'), violation from ({ORACLES['dm_jump_check']}) union all select psr, 'setting', key, coalesce(value, 'none') from ({ORACLES['settings_check']})
 union all select psr, 'noise', kind || ' ' || mask_key || ' ' || mask_value, alert from ({ORACLES['noise_parameter_sanity']}) union all select psr, 'frozen', name, 'not zero' from ({ORACLES['frozen_nonzero']})""")
def job_timing_checks(spark, sf_dir):
    """Values are 50000 and the length of the name; the old model's are 50000 with errors of one, so long names have moved."""
    p = settled(_named_params(spark, sf_dir, True))  # like the observations below, read by several checks
    model = p.withColumns({"value": F.lit(50000.0) + F.length("name"), "uncertainty": F.lit(1.0)})
    day = (F.lit(40587) + F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date"))).cast("double")
    spans = stats.span(read(spark, sf_dir, "orders").select(F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("psr"), day.alias("mjd")))
    t = settled(toas(spark, sf_dir).select("psr", "f", "fe", "be", "err_us"))
    receivers, jumped = _jumps(t)
    further = jobs.model_checks(receivers, jumped, *_settings(spark, sf_dir), *_noise_rows(t), QUERIES["frozen_nonzero"](spark, sf_dir), wideband=jumped)
    return jobs.timing_checks(model, _models(p), model.withColumn("value", F.lit(50000.0)), spans, _tests(spark, sf_dir), further=further)
