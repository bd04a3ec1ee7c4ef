"""Registered queries: chains to noise parameters, fits and nested-model tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsewright.functions import scalar
from pulsewright.operators import ftests, noise, params
from pulsewright.plans.queries_params import NAMED, named
from pulsewright.plans.registration import query
from pulsewright.sources.binding import CHAINS, TOAS, chains, read, toas

BURNT = f"{CHAINS}, k as (select *, row_number() over (partition by chain order by sample) - 1 as k, count(*) over (partition by chain) as n from chains), b as (select * from k where k >= floor(n * 0.25::double))"


@query(f"with {BURNT} select chain, sample from b")
def chain_burn_in(spark, sf_dir):
    return noise.after_burn(chains(spark, sf_dir)).select("chain", "sample")


@query(f"with {BURNT}, t as (select *, row_number() over (partition by chain order by vals[len(vals)] desc, sample desc) as r from b), x as (select chain, vals, unnest(range(len(vals))) as pos from t where r <= 10) select chain, pos::int as pos, round(avg(vals[pos + 1]), 9) as mean from x group by all")
def chain_top_likelihood_mean(spark, sf_dir):
    return noise.top_mean(chains(spark, sf_dir), n=10)


@query(f"with {CHAINS}, t as (select *, row_number() over (partition by chain order by vals[1] desc, sample desc) as r from chains) select chain, sample, vals[1] as lnpost from t where r = 1")
def chain_map_row(spark, sf_dir):
    return noise.map_row(chains(spark, sf_dir))


POSITIONS = "x as (select chain, unnest(range(len(vals))) as pos, vals from chains), v as (select chain, pos::int as pos, vals[pos + 1] as x from x)"


@query(f"with {CHAINS}, {POSITIONS} select chain, pos, round(quantile_cont(x, 0.5), 9) as median from v group by all")
def chain_medians(spark, sf_dir):
    return noise.medians(chains(spark, sf_dir))


@query(f"with {CHAINS}, {POSITIONS}, e as (select *, min(x) over w as lo, max(x) over w as hi from v window w as (partition by chain, pos)) select chain, pos, (case when hi > lo then least(floor((x - lo) / ((hi - lo) / 20.0::double)), 19) else 0 end)::int as bin, count(*) as n from e group by all")
def chain_histograms(spark, sf_dir):
    return noise.histograms(chains(spark, sf_dir))


@query(f"with {CHAINS}, {POSITIONS}, e as (select *, min(x) over w as lo, max(x) over w as hi from v window w as (partition by chain, pos)) select chain, pos, (case when hi > lo then least(floor((x - lo) / ((hi - lo) / 80.0::double)), 79) else 0 end)::int as bin, count(*) as n from e group by all")
def empirical_distributions_1d(spark, sf_dir):
    return noise.histograms(chains(spark, sf_dir), bins=80)


@query(f"with {CHAINS}, q as (select chain, vals, unnest(range(len(vals) - 1))::int as i from chains), p as (select chain, i, i + 1 as j, vals[i + 1] as x, vals[i + 2] as y from q), e as (select *, min(x) over w as lx, max(x) over w as hx, min(y) over w as ly, max(y) over w as hy from p window w as (partition by chain, i, j)) "
       "select chain, i, j, least(floor((x - lx) / nullif((hx - lx) / 80.0::double, 0)), 79)::int as bi, least(floor((y - ly) / nullif((hy - ly) / 80.0::double, 0)), 79)::int as bj, count(*) as n from e group by all")
def empirical_distributions_2d(spark, sf_dir):
    return noise.pair_histograms(chains(spark, sf_dir))


EDGES = [0.05, 0.1, 0.2]


@query(f"with {CHAINS}, x as (select chain, vals[1] as x from chains), g as (select chain, count(*) as n, {', '.join(f'count(*) filter (x < -1.0::double + (0.8::double + {e}::double)) as n{k}' for k, e in enumerate(EDGES))} from x group by chain), r as (select chain, [{', '.join(f'case when n{k} > 0 then (1.0::double / 2.0::double) / (n{k}::double / n / (0.8::double + {e}::double)) end' for k, e in enumerate(EDGES))}] as r from g), s as (select chain, list_sum(r) / nullif(len(list_filter(r, lambda v: v is not null)), 0) as bf from r) select chain, round(bf, 9) as bf, bf is null or bf >= 2 as keep from s")
def red_noise_evidence(spark, sf_dir):
    return noise.red_noise_evidence(chains(spark, sf_dir), 0, -1.0, 1.0, [0.8 + e for e in EDGES], least=2.0)


NOISE = "np2 as (select 'S' || (p_partkey % 40)::varchar as psr, p_partkey as ord, 'S' || (p_partkey % 40)::varchar || '_' || replace(p_brand, '#', '') || '_' || (['efac', 'log10_t2equad', 'log10_ecorr', 'dmefac', 'log10_dmequad', 'red_noise_gamma'])[1 + (p_partkey % 6)::int] as name, p_size::double / -10.0::double as value from part)"


def _noise(spark, sf_dir):
    psr = F.concat(F.lit("S"), (F.col("p_partkey") % 40).cast("string"))
    kind = F.element_at(F.array(*map(F.lit, ("efac", "log10_t2equad", "log10_ecorr", "dmefac", "log10_dmequad", "red_noise_gamma"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "part").select(psr.alias("psr"), F.col("p_partkey").alias("ord"), F.concat_ws("_", psr, F.translate("p_brand", "#", ""), kind).alias("name"), (F.col("p_size") / F.lit(-10.0)).alias("value"))


@query(f"with {NOISE}, x as (select psr, ord, name, split_part(name, '_', 2) as mask_value, case when name like '%_dmefac' or name like '%_dmequad' then null when name like '%_efac' then 'EFAC' when name like '%_log10_t2equad' then 'EQUAD' when name like '%_log10_ecorr' then 'ECORR' end as kind from np2) select psr, name, mask_value, kind, row_number() over (partition by psr, kind order by ord) as number from x where kind is not null")
def noise_names_narrowband(spark, sf_dir):
    return noise.parse_names(_noise(spark, sf_dir)).select("psr", "name", "mask_value", "kind", "number")


@query(f"with {NOISE}, x as (select psr, ord, name, split_part(name, '_', 2) as mask_value, case when name like '%_dmefac' then 'DMEFAC' when name like '%_log10_dmequad' then 'DMEQUAD' when name like '%_efac' then 'EFAC' when name like '%_log10_t2equad' then 'EQUAD' end as kind from np2) select psr, name, mask_value, kind, row_number() over (partition by psr, kind order by ord) as number from x where kind is not null")
def noise_names_wideband(spark, sf_dir):
    return noise.parse_names(_noise(spark, sf_dir), mode="wb").select("psr", "name", "mask_value", "kind", "number")


@query(f"with {NOISE} select psr, case when bool_or(name like '%t2equad') then 't2' else 'none' end as convention from np2 group by psr")
def equad_convention(spark, sf_dir):
    return noise.equad_convention(_noise(spark, sf_dir))


@query(f"with {NOISE} select psr, name, round(pow(10.0::double, value) * 1e6::double, 6) as us, round(86400.0::double * 365.24::double * 1e6::double / (2.0::double * pi() * sqrt(3.0::double)) * pow(10.0::double, value), 0) as amplitude, -value as index from np2")
def noise_unit_conversions(spark, sf_dir):
    v = F.col("value")
    return _noise(spark, sf_dir).select("psr", "name", F.round(scalar.log10_to_us(v), 6).alias("us"), F.round(scalar.red_noise_amplitude(v), 0).alias("amplitude"), (-v).alias("index"))


@query(f"with {NOISE}, l as (select psr, ord, unnest(['all', case when name like '%red_noise%' then 'red' end, nullif(regexp_extract(name, '^[^_]+_(.+)_(?:efac|log10_\\w*equad|log10_ecorr)$', 1), '')]) as grp from np2) select psr, grp, list_sort(list(ord)) as idx from l where grp is not null group by all")
def sampling_groups(spark, sf_dir):
    return noise.sampling_groups(_noise(spark, sf_dir))


@query(f"with {NOISE}, best as (select psr, name, value from np2 where ord % 3 = 0) select n.psr, n.name, coalesce(b.value, -10.0::double + ('0x' || substr(md5('7/' || n.psr || '/' || n.name), 1, 8))::bigint::double / 4294967296.0::double * 10.0::double) as start, b.value is not null as from_chain from np2 n left join best b using (psr, name)")
def start_values(spark, sf_dir):
    n = _noise(spark, sf_dir)
    return noise.start_values(n, n.filter("ord % 3 = 0"), F.lit(-10.0), F.lit(0.0), seed=7)


TESTS = "t as (select 'S' || (o_custkey % 60)::varchar as psr, (['M2+SINI', 'PX', 'FD' || (1 + o_orderkey % 4)::varchar, 'F2', 'PBDOT'])[1 + (o_orderkey % 5)::int] as label, case when o_orderkey % 5 = 2 then 'FD' else 'other' end as family, case when o_orderkey % 2 = 0 then 'add' else 'remove' end as action, o_totalprice as chi2, 100 + o_orderkey % 50 as dof, case when o_orderkey % 11 <> 0 then (o_orderkey % 997)::double / 99700.0::double end as ft, o_orderkey as ord from orders)"


def _tests(spark, sf_dir):
    k = F.col("o_orderkey")
    label = F.element_at(F.array(F.lit("M2+SINI"), F.lit("PX"), F.concat(F.lit("FD"), (k % 4 + 1).cast("string")), F.lit("F2"), F.lit("PBDOT")), (k % 5 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select(F.concat(F.lit("S"), (F.col("o_custkey") % 60).cast("string")).alias("psr"), label.alias("label"), F.when(k % 5 == 2, "FD").otherwise("other").alias("family"), F.when(k % 2 == 0, "add").otherwise("remove").alias("action"), F.col("o_totalprice").alias("chi2"), (k % 50 + 100).alias("dof"), F.when(k % 11 != 0, (k % 997) / F.lit(99700.0)).alias("ft"), k.alias("ord"))


@query(f"with {TESTS} select psr, label, case when ft is null then 'xxx' when ft < 0.0027 then '***' else '--' end as mark, count(*) as n from t group by all")
def ftest_report_marks(spark, sf_dir):
    return ftests.report_lines(_tests(spark, sf_dir)).groupBy("psr", "label", "mark").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {TESTS}, said as (select * from t where (action = 'remove' and ft > 0.0027 and label <> 'PX') or (action = 'add' and ft <= 0.0027 and ft > 0 and label <> 'F2')) select psr, action, label from said where family <> 'FD' union all select psr, action, arg_min(label, {{'ft': ft, 'ord': ord}}) from said where family = 'FD' group by psr, action")
def ftest_recommendations(spark, sf_dir):
    return ftests.recommend(_tests(spark, sf_dir))


#: Stated apart from the library's table: what is tried for each model, by name.
CANDS = """cand(family, label) as (values ('DD', 'M2+SINI'), ('DD', 'PBDOT'), ('DD', 'A1DOT'), ('DD', 'OMDOT'), ('DD', 'EDOT'), ('DDK', 'M2+SINI'), ('DDK', 'PBDOT'), ('DDK', 'A1DOT'), ('DDK', 'OMDOT'), ('DDK', 'EDOT'),
 ('ELL1', 'M2+SINI'), ('ELL1', 'PBDOT'), ('ELL1', 'A1DOT'), ('ELL1', 'EPS1DOT+EPS2DOT'), ('FB', 'A1DOT'), ('FB', 'EPS1DOT+EPS2DOT'), ('ELL1H', 'PBDOT'), ('ELL1H', 'A1DOT'), ('ELL1H', 'H4'), ('ELL1H', 'EPS1DOT+EPS2DOT'), ('ELL1H', 'H3+H4')),
 fam as (select md.psr, case when model = 'ELL1' and coalesce(bool_or(name = 'FB0'), false) and not coalesce(bool_or(name = 'PB'), false) then 'FB' else model end as family from md left join np using (psr) group by md.psr, model)"""


@query(f"with {NAMED}, {CANDS}, e as (select md.psr, label, unnest(string_split(label, '+')) as name from fam md join cand using (family)), s as (select e.psr, e.label, bool_and(coalesce(not np.frozen, false)) as a, bool_or(coalesce(not np.frozen, false)) as o from e left join np on e.psr = np.psr and e.name = np.name group by all), "
       "fd as (select md.psr, coalesce(max(try_cast(right(np.name, 1) as int)) filter (np.name like 'FD%'), 0) as n from md left join np using (psr) group by md.psr) "
       "select psr, case when a then 'remove' else 'add' end as action, label from s where a or not o union all select psr, 'add', 'FD' || k::varchar from fd, range(1, 6) r(k) where k > n union all select psr, 'remove', 'FD' || k::varchar from fd, range(1, 6) r(k) where k <= n")
def ftest_candidates(spark, sf_dir):
    p, models = named(spark, sf_dir)
    return ftests.candidates(models, p)


DESIGN = ["one", "t", "inv", "chan_c"]


def _design(spark, sf_dir):
    t = toas(spark, sf_dir)
    return t.select("psr", "name", F.col("resid_us").alias("y"), (1 / (F.col("err_us") * F.col("err_us"))).alias("w"), F.lit(1.0).alias("one"), ((F.col("mjd") - 50500.0) / 1000.0).alias("t"), (1e6 / (F.col("freq_mhz") * F.col("freq_mhz"))).alias("inv"), (F.col("chan") - 4.0).alias("chan_c"))


def _factors(spark, sf_dir):
    return ftests.merge(ftests.factors(_design(spark, sf_dir), ["psr", "name"], DESIGN), ["psr"], 5)


GRAMS = f"{TOAS}, d as (select psr, resid_us as y, 1.0::double / (err_us * err_us) as w, (mjd - 50500.0) / 1000.0 as t from toas)"


@query(f"with {GRAMS}, s as (select psr, sum(w) as sw, sum(w * t) as st, sum(w * t * t) as stt, sum(w * y) as sy, sum(w * t * y) as sty, sum(w * y * y) as syy, count(*) as n from d group by psr), b as (select *, (sw * sty - st * sy) / (sw * stt - st * st) as slope, (stt * sy - st * sty) / (sw * stt - st * st) as base from s) "
       "select psr, round(syy - base * sy - slope * sty, 3) as chi2, n - 2 as dof, round(slope, 5) as slope from b")
def weighted_linear_fit(spark, sf_dir):
    return ftests.fit(_factors(spark, sf_dir), 5, [0, 1]).select("psr", F.round("chi2", 3).alias("chi2"), "dof", F.round(F.col("beta")[1], 5).alias("slope"))


@query()
def leave_one_file_out(spark, sf_dir):
    return ftests.leave_one_out(ftests.factors(_design(spark, sf_dir), ["psr", "name"], DESIGN), 5)


FILES = f"{GRAMS[:-len(' from toas)')]}, name from toas), s as (select psr, sum(w) as sw, sum(w * t) as st, sum(w * t * t) as stt, sum(w * y) as sy, sum(w * t * y) as sty, sum(w * y * y) as syy, count(*) as n from d group by psr), f as (select psr, name, sum(w) as fw, sum(w * t) as ft, sum(w * t * t) as ftt, sum(w * y) as fy, sum(w * t * y) as fty, sum(w * y * y) as fyy, count(*) as fn from d group by all)"


@query(f"with {FILES}, l as (select psr, name, fn, sw - fw as sw, st - ft as st, stt - ftt as stt, sy - fy as sy, sty - fty as sty, syy - fyy as syy, n - fn as n from f join s using (psr)), b as (select *, (sw * sty - st * sy) / (sw * stt - st * st) as slope, (stt * sy - st * sty) / (sw * stt - st * st) as base from l) "
       "select psr, name, fn as n_removed, round(syy - base * sy - slope * sty, 3) as chi2, n - 2 as dof from b")
def leave_one_file_out_line(spark, sf_dir):
    one = ftests.leave_one_out(ftests.factors(_design(spark, sf_dir), ["psr", "name"], ["one", "t"]), 3)
    return one.select("psr", "name", "n_removed", F.round("chi2", 3).alias("chi2"), "dof")


@query(f"with {GRAMS}, s as (select psr, sum(w) as sw, sum(w * t) as st, sum(w * t * t) as stt, sum(w * y) as sy, sum(w * t * y) as sty, sum(w * y * y) as syy, count(*) as n from d group by psr) "
       "select psr, 'offset' as label, round(syy - sy * sy / sw, 3) as chi2, n - 1 as dof from s union all select psr, 'slope', round(syy - sty * sty / stt, 3), n - 1 from s")
def nested_model_lines(spark, sf_dir):
    """What a line leaves without its slope and without its offset."""
    models = {"line": [0, 1], "offset": [0], "slope": [1]}
    return ftests.nested(_factors(spark, sf_dir), 5, models, "line").select("psr", "label", F.round("chi2", 3).alias("chi2"), "dof")


@query()
def nested_model_tests(spark, sf_dir):
    return ftests.nested(_factors(spark, sf_dir), 5, {"full": [0, 1, 2, 3], "no slope": [0, 2, 3], "no DM": [0, 1, 3], "offset": [0]}, "full")


@query()
def f_test_p_values(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    a = F.col("o_totalprice") / F.lit(1000.0)
    n1 = (k % 5 + 1).cast("double")
    return o.select(k, ftests.f_test(a, F.lit(100.0), a - k % 7, F.lit(100.0) - n1).alias("p"))


@query()
def reduced_chi2(spark, sf_dir):
    c = toas(spark, sf_dir).groupBy("psr").agg(F.sum(F.pow(F.col("resid_us") / F.col("err_us"), 2)).alias("chi2"), F.count(F.lit(1)).alias("dof"))
    return ftests.reduced_chi2(c)


@query(f"with {TOAS}, a as (select psr, (psr[4:])::int % 4 as k, count(*)::double as after from toas group by psr), c as (select *, after + (case k when 0 then 0.0 when 1 then 0.5 when 2 then -0.5 else 0.25 end)::double as before from a) select psr, before - after as decrease, case when k = 3 then 'converged' when abs(before - after) < 0.01 then 'probably converged' when before < after then 'increased' else 'may not have converged' end as status, before - after <= 0.01 as fully_fitted from c")
def fit_status(spark, sf_dir):
    k = F.substring("psr", 4, 9).cast("int") % 4
    c = toas(spark, sf_dir).groupBy("psr").agg(F.count(F.lit(1)).cast("double").alias("after"))
    return params.fit_status(c.withColumn("before", F.col("after") + F.when(k == 0, 0.0).when(k == 1, 0.5).when(k == 2, -0.5).otherwise(0.25)).withColumn("converged", F.when(k == 3, True)))


SIGNAL_NAMES = ["dm_gp_log10_A", "dm_gp_gamma", "chrom_gp_log10_A", "chrom_gp_idx", "n_earth", "red_noise_log10_A", "red_noise_gamma", "x_log10_ecorr", "sw_gp_log10_A", "sw_gp_gamma", "exp_a"]
SIGNALS = "sg as (select 'S' || (p_partkey // 8)::varchar as psr, p_partkey as ord, 'S' || (p_partkey // 8)::varchar || '_' || (" + str(SIGNAL_NAMES) + ")[1 + (p_partkey * 5 % 11)::int] as name, p_size::double / -10.0::double as value from part)"


def _signals(spark, sf_dir):
    """Eight parts in a row are a source, each one of eleven parameters."""
    psr = F.concat(F.lit("S"), F.expr("p_partkey div 8").cast("string"))
    name = F.element_at(F.array(*map(F.lit, SIGNAL_NAMES)), (F.col("p_partkey") * 5 % 11 + 1).cast("int"))
    return read(spark, sf_dir, "part").select(psr.alias("psr"), F.col("p_partkey").alias("ord"), F.concat_ws("_", psr, name).alias("name"), (F.col("p_size") / F.lit(-10.0)).alias("value"))


@query(f"with {SIGNALS}, h as (select *, bool_or(name like '%\\_n\\_earth' escape '\\') over (partition by psr) as sw, bool_or(contains(name, 'chrom')) over (partition by psr) as ch, contains(name, 'dm_gp') as d, contains(name, 'chrom_gp') as g, contains(name, 'chrom') as c, contains(name, 'n_earth') as s from sg), "
       "l as (select psr, ord, unnest(['all', case when contains(name, 'red_noise') then 'red' end, case when d then 'dm' end, case when name like '%ecorr' then 'x' end, case when sw and (d or s) then 'dm, wind' end, case when sw and ch and (g or s) then 'chrom, wind' end, case when sw and ch and (d or c or s) then 'dm, chrom, wind' end, case when ch and (d or c) then 'dm, chrom' end]) as grp from h) select psr, grp, list_sort(list(ord)) as idx from l where grp is not null group by all")
def sampling_groups_chromatic(spark, sf_dir):
    return noise.sampling_groups(_signals(spark, sf_dir))


@query(f"with {SIGNALS}, v as (select psr, max(value) filter (name = psr || '_n_earth') as n, max(value) filter (name = psr || '_dm_gp_log10_A') as da, max(value) filter (name = psr || '_dm_gp_gamma') as dg, max(value) filter (name = psr || '_chrom_gp_log10_A') as ca, max(value) filter (name = psr || '_red_noise_log10_A') as ra, max(value) filter (name = psr || '_red_noise_gamma') as rg, max(value) filter (name = psr || '_sw_gp_log10_A') as wa, max(value) filter (name = psr || '_sw_gp_gamma') as wg from sg group by psr), "
       "a as (select *, 86400.0::double * 365.24::double * 1e6::double / (2.0::double * pi() * sqrt(3.0::double)) as s from v), r as (select psr, 'NE_SW' as kind, n as value, n is not null as there from a union all select psr, 'RNAMP', s * pow(10.0::double, ra), ra is not null and (psr[2:])::int % 2 = 0 from a union all select psr, 'RNIDX', -rg, ra is not null and (psr[2:])::int % 2 = 0 from a "
       "union all select psr, 'TNDMAMP', s * pow(10.0::double, da), da is not null from a union all select psr, 'TNDMGAM', -dg, da is not null from a union all select psr, 'TNDMC', 100, da is not null from a union all select psr, 'TNCMAMP', s * pow(10.0::double, ca), ca is not null from a union all select psr, 'TNCMGAM', null, ca is not null from a union all select psr, 'TNCMC', 100, ca is not null from a union all select psr, 'TNSWAMP', s * pow(10.0::double, wa), wa is not null from a union all select psr, 'TNSWGAM', -wg, wa is not null from a union all select psr, 'TNSWC', 10, wa is not null from a) select psr, kind, round(value, 1) as value from r where there")
def noise_signal_rows(spark, sf_dir):
    s = _signals(spark, sf_dir)
    keep = s.select("psr").distinct().withColumn("keep", F.substring("psr", 2, 9).cast("int") % 2 == 0)
    return noise.signal_rows(s, keep).withColumn("value", F.round("value", 1))


PLACES = ["dm_gp_a", "chrom_gp_a", "red_noise_a", "ecorr_a", "efac_a", "chrom_gp_idx_a", "dm_s1yr_a", "exp_a"]
PAIRS = "nm as (select c.chain, p.pos::int as pos, (" + str(PLACES) + ")[1 + (p.pos % 8)::int] as name from (select distinct chain from chains) c, range(24) p(pos)), fam as (select chain, pos, unnest(list_filter(['dm_gp', 'chrom_gp', 'red_noise', 'ecorr', 'chrom_s1yr', 'dm_s1yr', 'exp'], lambda f: contains(name, f))) as fam from nm where not contains(name, 'chrom_gp_idx')), pr as (select distinct a.chain, a.pos as i, b.pos as j from fam a join fam b on a.chain = b.chain and ((a.fam = b.fam and a.pos < b.pos) or (a.fam = 'ecorr' and b.fam = 'dm_gp') or (a.fam = 'dm_gp' and b.fam = 'chrom_gp')))"


def _pairs(spark, sf_dir):
    c = chains(spark, sf_dir)
    pos = c.select("chain").distinct().select("chain", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("pos"))
    return c, noise.family_pairs(pos.withColumn("name", F.element_at(F.array(*map(F.lit, PLACES)), F.col("pos") % 8 + 1)))


@query(f"with {CHAINS}, {PAIRS} select * from pr")
def empirical_family_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)[1]


@query(f"with {CHAINS}, {PAIRS}, p as (select chain, i, j, vals[i + 1] as x, vals[j + 1] as y from pr join chains using (chain)), e as (select *, min(x) over w as lx, max(x) over w as hx, min(y) over w as ly, max(y) over w as hy from p window w as (partition by chain, i, j)) "
       "select chain, i, j, least(floor((x - lx) / nullif((hx - lx) / 80.0::double, 0)), 79)::int as bi, least(floor((y - ly) / nullif((hy - ly) / 80.0::double, 0)), 79)::int as bj, count(*) as n from e group by all")
def empirical_distributions_families(spark, sf_dir):
    return noise.joint_histograms(*_pairs(spark, sf_dir))


@query(f"with {CHAINS}, h as (select *, case when sample % 2 = 0 then 'now' else 'past' end as run from chains where chain <> 'c3'), v as (select chain, run, unnest(range(len(vals)))::int as pos, unnest(vals) as x from h), e as (select *, min(x) over w as lo, max(x) over w as hi from v window w as (partition by chain, run, pos)) select chain, run, pos, (case when hi > lo then least(floor((x - lo) / ((hi - lo) / 20.0::double)), 19) else 0 end)::int as bin, count(*) as n from e group by all")
def chain_run_histograms(spark, sf_dir):
    """Even samples are the run of now, odd ones the past run; chain c3 has another parameter list in the past."""
    c = chains(spark, sf_dir)
    names = c.select("chain").distinct().withColumn("names", F.array(F.lit("a"), F.lit("b")))
    past = names.withColumn("names", F.when(F.col("chain") == "c3", F.array(F.lit("a"))).otherwise(F.col("names")))
    return noise.run_histograms(c.filter("sample % 2 = 0"), c.filter("sample % 2 = 1"), names, past)


@query(f"with {TESTS} select psr, label, case when o % 13 = 0 then printf('%-12s %12s %5d %s', label, 'NaN', dof, 'NaN') else printf('%-12s %12.4f %5d %s', label, chi2, dof, case when ft is null then 'xxx' when ft < 0.0027 then '***' else '--' end) end as line from (select *, ord as o from t)")
def ftest_report_lines(spark, sf_dir):
    t = _tests(spark, sf_dir).withColumn("chi2", F.when(F.col("ord") % 13 != 0, F.col("chi2")))
    return ftests.report_lines(t).select("psr", "label", "line")


@query(f"with {NAMED}, fb as (select psr, count(distinct name)::int as n from np where regexp_full_match(name, 'FB[0-9]+') group by psr) select psr, 'add' as action, 'F2' as label from md union all select psr, 'remove', 'PX' from md where model <> 'DDK' union all select psr, 'remove', 'FB' || k::varchar || '+' from fb join md using (psr), range(1, 6) r(k) where model = 'ELL1' and k < n union all select psr, 'add', 'FB' || k::varchar from fb join md using (psr), range(1, 6) r(k) where model = 'ELL1' and k >= n")
def ftest_other_candidates(spark, sf_dir):
    p, models = named(spark, sf_dir)
    return ftests.other_candidates(models, p)


@query(f"with {GRAMS}, s as (select psr, sum(w) as sw, sum(w * t) as st, sum(w * t * t) as stt from d group by psr) select psr, round(sqrt(stt / (sw * stt - st * st)), 6) as base, round(sqrt(sw / (sw * stt - st * st)), 6) as slope from s")
def fit_uncertainties(spark, sf_dir):
    u = ftests.fit(_factors(spark, sf_dir), 5, [0, 1])
    return u.select("psr", F.round(F.col("sigma")[0], 6).alias("base"), F.round(F.col("sigma")[1], 6).alias("slope"))


@query(f"with {TOAS}, d as (select psr, toa_id, resid_us as y, 1.0::double / (err_us * err_us) as w, (mjd - 50500.0) / 1000.0 as t from toas), s as (select psr, sum(w) as sw, sum(w * t) as st, sum(w * t * t) as stt, sum(w * y) as sy, sum(w * t * y) as sty from d group by psr), b as (select psr, (sw * sty - st * sy) / (sw * stt - st * st) as slope, (stt * sy - st * sty) / (sw * stt - st * st) as base from s) select psr, toa_id, round(y - base - slope * t, 4) as post from d join b using (psr)")
def post_fit_residuals(spark, sf_dir):
    rows = toas(spark, sf_dir).select("psr", "toa_id", "name", F.col("resid_us").alias("y"), (1 / (F.col("err_us") * F.col("err_us"))).alias("w"), F.lit(1.0).alias("one"), ((F.col("mjd") - 50500.0) / 1000.0).alias("t"))
    fits = ftests.fit(ftests.merge(ftests.factors(rows, ["psr", "name"], ["one", "t"]), ["psr"], 3), 3)
    return ftests.post_fit(rows, fits, ["one", "t"]).select("psr", "toa_id", F.round("post", 4).alias("post"))


@query("with x as (select o_orderkey, 90.0::double + o_totalprice / 1000.0::double as a, 90.0::double + o_totalprice / 1000.0::double - o_orderkey % 7 as b from orders) select o_orderkey, case when a > b then round(pow(b / a, 49.0::double), 6) end as p from x")
def f_test_of_two_terms(spark, sf_dir):
    """Two terms against 98 degrees of freedom, where the tail has a closed form; nothing where the fit isn't better."""
    a = F.lit(90.0) + F.col("o_totalprice") / F.lit(1000.0)
    p = ftests.f_test(a, F.lit(100.0), a - F.col("o_orderkey") % 7, F.lit(98.0))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(p, 6).alias("p"))


@query("select l_orderkey, l_linenumber, l_partkey, round(exp(-l_quantity / 2) * (1 + l_quantity / 2 + l_quantity * l_quantity / 8), 9) as p from lineitem")
def chi2_tail_of_six(spark, sf_dir):
    """Six degrees of freedom, where the tail is a short sum."""
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(ftests.chi2_tail(F.col("l_quantity"), F.lit(6.0)), 9).alias("p"))
