"""Registered queries: comparing and checking parameters, jumps, files and configurations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsewright.operators import params as P
from pulsewright.operators.settle import settled
from pulsewright.plans.registration import query
from pulsewright.sources.binding import TOAS, params, params_sql, read, toas

TWO = f"{params_sql('a')}, {params_sql('b', 3)}"


@query(f"with {TWO} select coalesce(a.psr, b.psr) as psr, coalesce(a.name, b.name) as name, a.value, b.value as old_value, abs(a.value - b.value) / nullif(b.uncertainty, 0) as sigmas, coalesce(abs(a.value - b.value) / nullif(b.uncertainty, 0) > 3, false) as moved, case when b.psr is null then 'new' when a.psr is null then 'missing' else 'both' end as side from a full join b on a.psr = b.psr and a.name = b.name")
def compare_models(spark, sf_dir):
    return P.compare(params(spark, sf_dir), params(spark, sf_dir, 3))


@query(f"with {TWO}, j as (select coalesce(a.psr, b.psr) as psr, coalesce(a.name, b.name) as name, a.value / nullif(b.value, 0) as ratio, case when b.psr is null then 'not in model' when a.psr is null then 'not in chain' when a.value / b.value < 0.999 or a.value / b.value > 1.001 then 'differs' end as state from a full join b on a.psr = b.psr and a.name = b.name) select * from j where state is not null")
def noise_chain_vs_model(spark, sf_dir):
    return P.noise_ratio(params(spark, sf_dir), params(spark, sf_dir, 3), 0.999, 1.001)


MASKS = [(f"PSR{k}", f"-{flag}", v) for k in range(0, 50, 2) for flag, v in (("f", "A_F"), ("fe", "R"), ("be", "O"), ("be", "none"))]
MATCH = f"{TOAS}, k as (select 'PSR' || (x * 2)::varchar as psr, m.* from range(25) r(x), (values ('-f', 'A_F'), ('-fe', 'R'), ('-be', 'O')) m(mask_key, mask_value)), mm as (select k.psr, mask_key, mask_value, count(*) as n, quantile_cont(err_us, 0.5) as median_err from k join toas t on k.psr = t.psr and case mask_key when '-f' then f when '-fe' then fe else be end = mask_value group by all)"


@query(f"with {MATCH} select * from mm")
def mask_parameter_matches(spark, sf_dir):
    return P.mask_matches(toas(spark, sf_dir), spark.createDataFrame(MASKS, "psr string, mask_key string, mask_value string"))


@query(f"with {MATCH}, n as (select mm.*, x.kind, x.value from mm, (values ('EFAC', 1.3), ('EFAC', 1.0), ('EQUAD', 0.7), ('EQUAD', 10.0), ('ECORR', 4.0), ('DMEFAC', 0.5)) x(kind, value)) select * from (select psr, kind, mask_key, mask_value, value::double as value, case when kind in ('EFAC', 'DMEFAC') and (value < 0.8 or value > 1.2) then 'factor out of range' when kind in ('EQUAD', 'ECORR') and value > 9.5 then 'at prior edge' when kind in ('EQUAD', 'ECORR') and value > 3 then 'over 3 us' when kind in ('EQUAD', 'ECORR', 'DMEQUAD') and value::double / median_err > 0.75 then 'large against error' end as alert from n) where alert is not null")
def noise_parameter_sanity(spark, sf_dir):
    return P.noise_sanity(*_noise_rows(toas(spark, sf_dir)))


def _noise_rows(t):
    masks = t.sparkSession.createDataFrame(MASKS, "psr string, mask_key string, mask_value string")
    kinds = [("EFAC", 1.3), ("EFAC", 1.0), ("EQUAD", 0.7), ("EQUAD", 10.0), ("ECORR", 4.0), ("DMEFAC", 0.5)]
    noise = masks.select("*", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value")) for k, v in kinds])))
    return noise, P.mask_matches(t, masks)


JUMPS = f"{TOAS}, r as (select distinct psr, fe from toas), j as (select psr, fe from r where (psr[4:])::int % 3 = 0 or fe = 'A' union select psr, 'X' from r where psr in ('PSR1', 'PSR2')), free as (select * from r except select * from j)"


def _jumps(t):
    r = settled(t.select("psr", "fe").distinct())  # checks read receivers several times
    j = r.filter((F.substring("psr", 4, 9).cast("int") % 3 == 0) | (F.col("fe") == "A")).union(r.filter(F.col("psr").isin("PSR1", "PSR2")).select("psr", F.lit("X").alias("fe"))).distinct()
    return r, j


@query(f"with {JUMPS} select psr, fe, 'unknown receiver' as violation from (select * from j except select * from r) union all select psr, fe, 'no jump' from free where psr in (select psr from free group by psr having count(*) > 1) union all select psr, null, 'all jumped' from (select distinct psr from r where psr not in (select psr from free))")
def jump_check(spark, sf_dir):
    return P.jump_check(*_jumps(toas(spark, sf_dir)))


@query(f"with {JUMPS} select psr, fe, 'unknown receiver' as violation from (select * from j except select * from r) union all select psr, fe, 'no jump' from free")
def dm_jump_check(spark, sf_dir):
    return P.jump_check(*_jumps(toas(spark, sf_dir)), all_need=True)


@query(f"with {JUMPS}, k as (select *, row_number() over (partition by psr order by fe desc) as k from free where psr in (select psr from r group by psr having count(*) > 1)) select psr, 'JUMP' as name, '-fe' as mask_key, fe as mask_value from k where k > 1")
def missing_jumps(spark, sf_dir):
    return P.missing_jumps(*_jumps(toas(spark, sf_dir)))


@query(f"with {params_sql('p')} select psr, name, value from p where frozen and value <> 0 and name not in ('PROMO_1', 'PROMO_2') and not starts_with(name, 'SMALL')")
def frozen_nonzero(spark, sf_dir):
    return P.frozen_nonzero(params(spark, sf_dir), ["PROMO_1", "PROMO_2"], ["SMALL"]).select("psr", "name", "value")


NAME = "case when c_custkey % 3 = 0 then 'J' || lpad((c_custkey % 2400)::varchar, 4, '0') || '+' || lpad((c_nationkey * 100)::varchar, 4, '0') when c_custkey % 3 = 1 then 'B' || lpad((c_custkey % 2400)::varchar, 4, '0') || '-' || lpad(c_nationkey::varchar, 2, '0') else c_mktsegment end"


@query(f"select c_custkey, {NAME} as psr, regexp_full_match({NAME}, '(J[0-9]{{4}}[+-][0-9]{{4}}|B[0-9]{{4}}[+-][0-9]{{2}})') as ok from customer")
def source_name_check(spark, sf_dir):
    k = F.lpad((F.col("c_custkey") % 2400).cast("string"), 4, "0")
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("J"), k, F.lit("+"), F.lpad((F.col("c_nationkey") * 100).cast("string"), 4, "0"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("B"), k, F.lit("-"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"))).otherwise(F.col("c_mktsegment"))
    return read(spark, sf_dir, "customer").select("c_custkey", name.alias("psr")).withColumn("ok", P.name_ok(F.col("psr")))


#: Parameters with names of timing models, by customer: a name for each of a few residues.
NAMES = ["F0", "F1", "F2", "A1", "TASC", "EPS1", "EPS2", "PB", "M2", "SINI", "FB0", "ECC", "T0", "OM", "PX", "ELONG", "ELAT", "FD1", "FD2", "H3"]
MODELS = ["ELL1", "DD", "ELL1H", "DDK", "XYZ"]
NAMED = "np as (select 'S' || o_custkey::varchar as psr, " + str(NAMES) + "[1 + (o_orderkey % 20)::int] as name, bool_and(o_orderstatus = 'F') as frozen from orders group by all), md as (select distinct psr, " + str(MODELS) + "[1 + ((psr[2:])::int % 5)::int] as model from np)"


def named(spark, sf_dir, whole=False):
    p = _named_params(spark, sf_dir, whole)
    return p, _models(p)


def _named_params(spark, sf_dir, whole=False):
    """With ``whole``, sources meet whole, which serves the distinct names and whatever is asked of a source after them."""
    o = read(spark, sf_dir, "orders")
    x = o.select(F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("psr"), F.element_at(F.array(*map(F.lit, NAMES)), (F.col("o_orderkey") % 20 + 1).cast("int")).alias("name"), (F.col("o_orderstatus") == "F").alias("x"))
    return (x.repartition("psr") if whole else x).groupBy("psr", "name").agg(F.bool_and("x").alias("frozen"))


def _models(p):
    return p.select("psr").distinct().select("psr", F.element_at(F.array(*map(F.lit, MODELS)), (F.substring("psr", 2, 9).cast("int") % 5 + 1).cast("int")).alias("model"))


@query(f"with {NAMED} select psr, coalesce(bool_or(name = 'F0' and not frozen), false) as f0_fitted, coalesce(bool_or(name = 'F1' and not frozen), false) as f1_fitted, count(*) filter (name = 'F2') as further from np group by psr")
def spin_check(spark, sf_dir):
    return P.spin_check(named(spark, sf_dir, True)[0])


@query(f"with {NAMED}, w as (select distinct psr, n as name from np, (values ('ELONG'), ('ELAT'), ('PMELONG'), ('PMELAT'), ('PX')) v(n)) select * from (select w.psr, w.name, case when np.frozen is null then 'missing' when np.frozen then 'not fitted' end as problem from w left join np using (psr, name)) where problem is not null "
       "union all select psr, 'FRAME', case when bool_or(name = 'F2') then 'equatorial' else 'no frame' end from np group by psr having bool_or(name = 'F2') or not bool_or(name in ('ELONG', 'ELAT'))")
def astrometry_check(spark, sf_dir):
    """A source with F2 gets a RAJ beside it, which makes it equatorial."""
    p, _ = named(spark, sf_dir, True)
    return P.astrometry_check(p.union(p.filter("name = 'F2'").withColumn("name", F.lit("RAJ"))), p)


RULES = "need(model, name) as (values " + ", ".join(f"('{m}', '{n}')" for m, (r, _, _) in P.BINARY_RULES.items() for n in r) + "), opt(model, name) as (values " + ", ".join(f"('{m}', '{n}')" for m, (_, o, _) in P.BINARY_RULES.items() for n in o) + "), pr(model, a, b) as (values " + ", ".join(f"('{m}', '{a}', '{b}')" for m, (*_, p) in P.BINARY_RULES.items() for a, b in p) + ")"


@query(f"with {NAMED}, {RULES}, h as (select psr, bool_or(name = 'PB') as pb, bool_or(name = 'FB0') as fb from np group by psr), kn as (select md.psr, case when model = 'ELL1' and fb and not pb then 'ELL1 by FB0' else model end as model, pb, fb from md join h using (psr) where model <> 'XYZ') select * from (select kn.psr, need.name, case when np.frozen is null then 'missing' when np.frozen then 'not fitted' end as problem from kn join need using (model) left join np on np.psr = kn.psr and np.name = need.name "
       "union all select kn.psr, opt.name, case when np.frozen then 'not fitted' end from kn join opt using (model) join np on np.psr = kn.psr and np.name = opt.name) where problem is not null "
       "union all select psr, a || '+' || b, 'one of a pair' from (select kn.psr, a, b, count(*) as n from kn join pr using (model) join np on np.psr = kn.psr and np.name in (a, b) group by all) where n = 1 "
       "union all select psr, 'PB/FB0', 'not one of both' from kn where model like 'ELL1%' and model <> 'ELL1H' and pb = fb union all select psr, model, 'unknown model' from md where model = 'XYZ'")
def binary_check(spark, sf_dir):
    return P.binary_check(*named(spark, sf_dir, True))


@query("with s as (select 'S' || c_custkey::varchar as psr, k, case k when 'EPHEM' then case when c_nationkey < 20 then 'DE440' else 'DE421' end when 'CLOCK' then c_mktsegment when 'PLANETS' then case when c_custkey % 2 = 0 then 'Y' end end as value from customer, (values ('EPHEM'), ('CLOCK'), ('PLANETS')) v(k)), e(k, expected) as (values ('EPHEM', 'DE440'), ('CLOCK', 'BUILDING'), ('PLANETS', 'Y')) select psr, k as key, value, expected from s join e using (k) where value is distinct from expected")
def settings_check(spark, sf_dir):
    return P.settings_check(*_settings(spark, sf_dir))


def _settings(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumn("key", F.explode(F.array(*map(F.lit, ("EPHEM", "CLOCK", "PLANETS")))))
    value = F.when(F.col("key") == "EPHEM", F.when(F.col("c_nationkey") < 20, "DE440").otherwise("DE421")).when(F.col("key") == "CLOCK", F.col("c_mktsegment")).otherwise(F.when(F.col("c_custkey") % 2 == 0, "Y"))
    expected = spark.createDataFrame([("EPHEM", "DE440"), ("CLOCK", "BUILDING"), ("PLANETS", "Y")], "key string, expected string")
    return c.select(F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("psr"), "key", value.alias("value")), expected


@query(f"with {params_sql('p')} select psr, name, not (contains(name, '7')) or name = 'DM' as frozen from p")
def apply_free_parameters(spark, sf_dir):
    p = params(spark, sf_dir)
    return P.apply_free(p, p.filter(F.col("name").contains("7")).select("psr", "name")).select("psr", "name", "frozen")


DMX = "select 'PSR' || (p_partkey % 50)::varchar as psr, (p_partkey // 50)::int as idx, p_retailprice as val, case when p_size % 4 = 0 then 0.0::double else p_size::double end as err, p_retailprice - 3.0::double as r1, p_retailprice + 3.0::double as r2 from part"


def _dmx(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("PSR"), (F.col("p_partkey") % 50).cast("string")).alias("psr"), F.floor(F.col("p_partkey") / 50).cast("int").alias("idx"), F.col("p_retailprice").alias("val"), F.when(F.col("p_size") % 4 != 0, F.col("p_size").cast("double")).alias("err"), (F.col("p_retailprice") - 3.0).alias("r1"), (F.col("p_retailprice") + 3.0).alias("r2"))


@query(DMX)
def model_dmx_params(spark, sf_dir):
    base = params(spark, sf_dir).limit(0).select("psr", "name", "value", "uncertainty", "frozen")
    return P.dmx_params(P.replace_dmx(base, _dmx(spark, sf_dir)))


@query(f"with d as ({DMX}) select psr, idx, (r1 + r2) / 2 as epoch, ((r1 + r2) / 2 - 51544.0::double) / 365.25::double + 2000.0::double as year, round(val - avg(val) over (partition by psr), 6) as val, err, r1, r2 from d")
def dmx_time_series(spark, sf_dir):
    return P.dmx_series(_dmx(spark, sf_dir), less_mean=True)


@query(f"with d as ({DMX}), m as (select psr, sum(val / (err * err)) / sum(1.0::double / (err * err)) as m, 1.0::double / sqrt(sum(1.0::double / (err * err))) as e from d where err <> 0 group by psr) select psr, round(m, 6) as mean, round(e, 6) as mean_err, abs(m / e) > 1 as adjust from m")
def mean_dmx(spark, sf_dir):
    from pulsewright.operators import stats

    d = _dmx(spark, sf_dir).filter("err is not null")
    return stats.weighted_mean(d, ["psr"], "val", "err").withColumn("adjust", F.abs(F.col("mean") / F.col("mean_err")) > 1)


@query(f"with {TOAS} select psr, toa_id, round(1.1::double * sqrt(err_us * err_us + 0.25::double), 9) as t2, round(sqrt(1.1::double * err_us * 1.1::double * err_us + 0.25::double), 9) as tn from toas")
def scaled_errors(spark, sf_dir):
    t = toas(spark, sf_dir)
    noise = t.select("psr", "f").distinct().withColumn("efac", F.lit(1.1)).withColumn("equad", F.lit(0.5))
    one = P.scaled_errors(t, noise).select("psr", "toa_id", F.round("err_scaled", 9).alias("t2"))
    return one.join(P.scaled_errors(t, noise, tempo2=False).select("psr", "toa_id", F.round("err_scaled", 9).alias("tn")), ["psr", "toa_id"])


@query("with e as (select 'PSR' || (p_partkey % 50)::varchar as psr, '-f' as mask_key, 'b' || (p_partkey // 50)::varchar as mask_value, p_retailprice as equad, 1.0::double + p_size as efac from part) select psr, mask_key, mask_value, equad / efac as value from e")
def convert_equads(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("PSR"), (F.col("p_partkey") % 50).cast("string")).alias("psr"), F.lit("-f").alias("mask_key"), F.concat(F.lit("b"), F.floor(F.col("p_partkey") / 50).cast("string")).alias("mask_value"), F.explode(F.array(F.struct(F.lit("EQUAD").alias("name"), F.col("p_retailprice").alias("value")), F.struct(F.lit("EFAC").alias("name"), (F.lit(1.0) + F.col("p_size")).alias("value")))).alias("x"))
    return P.convert_equads(p.select("psr", "mask_key", "mask_value", "x.name", "x.value")).select("psr", "mask_key", "mask_value", "value")


@query(f"with {TOAS}, e as (select psr, (psr[4:])::int as k, round_even((min(mjd) + max(mjd)) / 2, 0) as centre from toas group by psr), p as (select psr, centre, 50000.0::double + k * 20 as value, case when k % 2 = 0 then 0.5::double + k else 1.0::double / (1.0::double / ((0.5::double + k) * 86400.0::double)) / 86400.0::double end as pb from e) "
       "select psr, 'PEPOCH' as name, value, centre from p where abs(value - centre) > 1 union all select psr, 'T0', value, centre from p where abs(value - centre) > 1 + pb")
def reference_epochs(spark, sf_dir):
    from pulsewright.operators import stats

    s = stats.span(toas(spark, sf_dir))
    k = F.substring("psr", 4, 9).cast("int")
    row = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    period = F.lit(0.5) + k
    made = F.array(row("PEPOCH", F.lit(50000.0) + k * 20), row("T0", F.lit(50000.0) + k * 20), F.when(k % 2 == 0, row("PB", period)).otherwise(row("FB0", 1 / (period * 86400.0))))
    return P.far_epochs(s, s.select("psr", F.inline(made)))


@query(f"with {TWO}, y as (select a.psr, a.name, a.value, a.uncertainty, split_part(a.name, '_', -1)::int as ord, b.value as initial from a left join b using (psr, name)), x as (select *, abs((initial - value) / nullif(uncertainty, 0)) as s from y) "
       "select psr, arg_max(name, struct_pack(v := s, o := ord)) filter (s is not null) as name, max(s) as sigmas, count(*) filter (s > 0.1) as warned, count(*) filter (initial is null) as unset from x group by psr")
def largest_change(spark, sf_dir):
    """Values that the other model lacks are unset."""
    b = params(spark, sf_dir, 3).select("psr", "name", F.col("value").alias("initial"))
    fitted = params(spark, sf_dir).join(b, ["psr", "name"], "left").withColumn("ord", F.regexp_extract("name", r"_(\d+)$", 1).cast("int"))
    return P.largest_change(fitted)


CFG = "c as (select 'S' || (c_custkey % 60)::varchar || case when c_custkey % 2 = 0 then '.nb.yaml' else '.wb.yaml' end as config, c_nationkey as result, c_mktsegment as tag, c_custkey from customer)"


def _configs(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("S"), (F.col("c_custkey") % 60).cast("string"), F.when(F.col("c_custkey") % 2 == 0, ".nb.yaml").otherwise(".wb.yaml")).alias("config"), F.col("c_nationkey").alias("result"), F.col("c_mktsegment").alias("tag"), "c_custkey")


@query(f"with {CFG} select r.n_nationkey as result, count(distinct c.config) as configs, case when count(c.config) = 0 then 'unused' when count(distinct c.config) > 1 then 'shared' else 'ok' end as state from nation r left join c on c.result = r.n_nationkey group by all")
def config_result_files(spark, sf_dir):
    from pulsewright.operators import audit

    return audit.result_use(_configs(spark, sf_dir).select("config", "result"), read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("result")))


MODES = "s as (select distinct 'S' || (c_custkey // 3)::varchar as source, case when c_nationkey % 2 = 0 then 'nb' else 'wb' end as mode from customer)"


@query(f"with {MODES} select source, bool_or(mode = 'nb') and bool_or(mode = 'wb') as paired, min(mode) as mode from s group by source")
def config_pairing(spark, sf_dir):
    from pulsewright.operators import audit

    mode = F.when(F.col("c_nationkey") % 2 == 0, ".nb.yaml").otherwise(".wb.yaml")
    return audit.pairing(read(spark, sf_dir, "customer").select(F.concat(F.lit("S"), F.expr("c_custkey div 3").cast("string"), mode).alias("config")))


@query(f"with {CFG} select config, count(*) as n, case when count(*) = 0 then 'missing' when count(*) > 1 then 'multiple' else 'ok' end as state from c group by config having count(*) <> 1")
def release_products(spark, sf_dir):
    from pulsewright.operators import audit

    c = _configs(spark, sf_dir)
    return audit.product_counts(c.select("config").distinct(), c.select("config"), "config")


LOG = "l as (select 'S' || (c_custkey % 60)::varchar as config, strftime(date '2020-01-01' + (c_custkey % 700)::int, '%Y-%m-%d') || ' user' || c_nationkey::varchar || ' ' || case when c_custkey % 5 = 0 then 'READY_FOR' when c_custkey % 5 = 1 then 'NOISE' when c_custkey % 5 = 2 then 'OOPS' else 'CURATE' end || ': v' || (c_custkey % 9)::varchar as entry from customer)"


@query(f"with {LOG}, p as (select config, entry[1:10] as day, regexp_extract(entry, '^\\S+ (\\S+) ', 1) as who, regexp_extract(entry, ' ([A-Z_]+): ', 1) as tag, regexp_extract(entry, ': (.*)$', 1) as note from l) select config, count(*) as entries, count(*) filter (tag not in ('INIT', 'READY_FOR', 'NOISE', 'CURATE')) as invalid, max(day) filter (tag = 'READY_FOR') as ready_day from p group by config")
def changelog_summary(spark, sf_dir):
    from pulsewright.operators import audit

    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 700).cast("int")), "yyyy-MM-dd")
    tag = F.when(F.col("c_custkey") % 5 == 0, "READY_FOR").when(F.col("c_custkey") % 5 == 1, "NOISE").when(F.col("c_custkey") % 5 == 2, "OOPS").otherwise("CURATE")
    entry = F.concat(day, F.lit(" user"), F.col("c_nationkey").cast("string"), F.lit(" "), tag, F.lit(": v"), (F.col("c_custkey") % 9).cast("string"))
    log = read(spark, sf_dir, "customer").select(F.concat(F.lit("S"), (F.col("c_custkey") % 60).cast("string")).alias("config"), entry.alias("entry"))
    return audit.changelog(log, ["INIT", "READY_FOR", "NOISE", "CURATE"])


@query("select 'S' || c_custkey::varchar as config, case when c_custkey % 3 = 0 then 1 else 0 end + case when c_nationkey % 4 = 0 then 1 else 0 end as open, c_custkey % 3 <> 0 and c_nationkey % 4 <> 0 as cleared from customer")
def cleared_status(spark, sf_dir):
    from pulsewright.operators import audit

    check = F.create_map(F.lit("toa_outliers"), F.when(F.col("c_custkey") % 3 == 0, "todo"), F.lit("other"), F.when(F.col("c_nationkey") % 4 == 0, "todo").otherwise(""), F.lit("cleared"), F.lit("yes"))
    return audit.cleared(read(spark, sf_dir, "customer").select(F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("config"), check.alias("check")))


@query("with k as (select c_custkey, unnest(['snr-cut', case when c_custkey % 2 = 0 then 'mjd-start' else 'mjdstart' end, case when c_custkey % 5 = 0 then 'bad-toa' end]) as k from customer) select c_custkey, list_sort(list(k) filter (k not in ('snr-cut', 'mjd-start', 'bad-toa'))) is not null as has_invalid, 3 - count(k) filter (k in ('snr-cut', 'mjd-start', 'bad-toa')) as missing from k group by c_custkey")
def rule_key_audit(spark, sf_dir):
    from pulsewright.operators import audit

    keys = F.filter(F.array(F.lit("snr-cut"), F.when(F.col("c_custkey") % 2 == 0, "mjd-start").otherwise("mjdstart"), F.when(F.col("c_custkey") % 5 == 0, "bad-toa")), lambda k: k.isNotNull())
    c = read(spark, sf_dir, "customer").select("c_custkey", keys.alias("keys"))
    out = audit.rule_keys(c, ["snr-cut", "mjd-start", "bad-toa"])
    return out.select("c_custkey", (F.size("invalid") > 0).alias("has_invalid"), F.size("missing").cast("long").alias("missing"))


@query(f"with {CFG}, f as (select config, 'r' || result::varchar as file from c), g as (select config, 'r' || ((result + case when c_custkey % 10 = 0 then 1 else 0 end) % 25)::varchar as file from c) select config, file, side from (select config, file, 'config only' as side from (from f except from g) union all select config, file, 'release only' from (from g except from f))")
def config_vs_release_files(spark, sf_dir):
    from pulsewright.operators import audit

    return audit.file_differences(*_file_lists(spark, sf_dir))


def _file_lists(spark, sf_dir):
    c = _configs(spark, sf_dir)
    name = lambda x: F.concat(F.lit("r"), x.cast("string"))
    g = c.select("config", name((F.col("result") + F.when(F.col("c_custkey") % 10 == 0, 1).otherwise(0)) % 25).alias("file"))
    return c.select("config", name(F.col("result")).alias("file")), g


@query("select 'S' || (o_custkey % 40)::varchar as source, max('run_' || lpad((o_orderkey % 900)::varchar, 3, '0')) as newest, max('run_' || lpad((o_orderkey % 900)::varchar, 3, '0')) <> 'run_899' as stale from orders group by all")
def newest_run(spark, sf_dir):
    from pulsewright.operators import audit

    o = read(spark, sf_dir, "orders").select(F.concat(F.lit("/noise/S"), (F.col("o_custkey") % 40).cast("string"), F.lit("/run_"), F.lpad((F.col("o_orderkey") % 900).cast("string"), 3, "0"), F.lit("/chain.txt")).alias("path"))
    used = o.select(F.regexp_extract("path", "/noise/([^/]+)/", 1).alias("source")).distinct().withColumn("used", F.lit("run_899"))
    return audit.newest(o, used).select("source", "newest", "stale")


@query("select 'S' || c_custkey::varchar || '.nb' as config, case when c_custkey % 2 = 0 then 'unset' else c_mktsegment end as tag, list_concat(['a'], case when c_custkey % 2 = 0 then ['set'] else []::varchar[] end) as changelog from customer")
def set_config_field(spark, sf_dir):
    from pulsewright.operators import audit

    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("S"), F.col("c_custkey").cast("string"), F.lit(".nb")).alias("config"), F.col("c_mktsegment").alias("tag"), F.array(F.lit("a")).alias("changelog"), "c_custkey")
    return audit.set_field(c, "tag", F.lit("unset"), F.col("c_custkey") % 2 == 0, "set").drop("c_custkey")


@query("with s as (select 'S' || c_custkey::varchar as psr, k, case k when 'EPHEM' then case when c_nationkey < 20 then 'DE440' else 'DE421' end when 'CLOCK' then c_mktsegment when 'PLANETS' then case when c_custkey % 2 = 0 then 'Y' end end as value from customer, (values ('EPHEM'), ('CLOCK'), ('PLANETS')) v(k)) select psr, k as key, case when k = 'PLANETS' then 'Y' else value end as value from s")
def settings_corrected(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumn("key", F.explode(F.array(*map(F.lit, ("EPHEM", "CLOCK", "PLANETS")))))
    value = F.when(F.col("key") == "EPHEM", F.when(F.col("c_nationkey") < 20, "DE440").otherwise("DE421")).when(F.col("key") == "CLOCK", F.col("c_mktsegment")).otherwise(F.when(F.col("c_custkey") % 2 == 0, "Y"))
    expected = spark.createDataFrame([("EPHEM", "DE440"), ("PLANETS", "Y")], "key string, expected string")
    return P.corrected_settings(c.select(F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("psr"), "key", value.alias("value")), expected, ["PLANETS"]).select("psr", "key", "value")


def _log(spark, sf_dir):
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 700).cast("int")), "yyyy-MM-dd")
    tag = F.when(F.col("c_custkey") % 5 == 0, "READY_FOR").when(F.col("c_custkey") % 5 == 1, "NOISE").when(F.col("c_custkey") % 5 == 2, "OOPS").otherwise("CURATE")
    entry = F.concat(day, F.lit(" user"), F.col("c_nationkey").cast("string"), F.lit(" "), tag, F.lit(": v"), (F.col("c_custkey") % 9).cast("string"))
    return read(spark, sf_dir, "customer").select(F.concat(F.lit("S"), (F.col("c_custkey") % 60).cast("string")).alias("config"), entry.alias("entry"))


@query(f"with {LOG}, m as (select config, max(struct_pack(d := entry[1:10], e := entry)) as m from l where entry like '% READY\\_FOR: %' escape '\\' group by config) select config, m.d as day, regexp_extract(m.e, ' READY_FOR: (.*)$', 1) as version from m")
def changelog_ready(spark, sf_dir):
    from pulsewright.operators import audit

    return audit.ready_versions(_log(spark, sf_dir))


@query(f"with {LOG} select config, list_sort(list(entry)) || case when config <> 'S7' then ['2021-01-01 me NOISE: run'] else []::varchar[] end as changelog from l group by config")
def changelog_append(spark, sf_dir):
    from pulsewright.operators import audit

    c = _log(spark, sf_dir).groupBy("config").agg(F.sort_array(F.collect_list("entry")).alias("changelog"))
    return audit.append_entry(c, "NOISE", "run", "me", "2021-01-01", F.col("config") != "S7", ["INIT", "NOISE"])


MADE = "k as (select c_custkey, 'S' || c_custkey::varchar as source, case when c_custkey % 2 = 0 then 'nb' else 'wb' end as mode, case when c_custkey % 7 <> 0 then 'p' || c_nationkey::varchar end as timing_model, case when c_custkey % 3 = 0 then 'p' || (c_nationkey + 1)::varchar end as compare_model from customer), q as (select *, source || '.' || case when c_custkey % 11 = 0 then 'xb' else mode end || '.yaml' as config from k)"


@query(f"with {MADE}, f as (select 'p' || n_nationkey::varchar as file from nation where n_regionkey <> 2) select config, 'name' as problem from q where c_custkey % 11 = 0 union all select config, 'no model' from q where timing_model is null union all select config, 'model missing' from q where timing_model is not null and timing_model not in (from f) union all select config, 'comparison missing' from q where compare_model is not null and compare_model not in (from f)")
def config_result_problems(spark, sf_dir):
    from pulsewright.operators import audit

    k, n = F.col("c_custkey"), F.col("c_nationkey")
    c = read(spark, sf_dir, "customer").select(
        k, F.concat(F.lit("S"), k.cast("string")).alias("source"), F.when(k % 2 == 0, "nb").otherwise("wb").alias("mode"), F.when(k % 7 != 0, F.concat(F.lit("p"), n.cast("string"))).alias("timing_model"), F.when(k % 3 == 0, F.concat(F.lit("p"), (n + 1).cast("string"))).alias("compare_model")
    )
    c = c.withColumn("config", F.concat("source", F.lit("."), F.when(k % 11 == 0, "xb").otherwise(F.col("mode")), F.lit(".yaml")))
    files = read(spark, sf_dir, "nation").filter("n_regionkey <> 2").select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("file"))
    return audit.result_problems(c, files)


@query(f"with {CFG}, f as (select config, 'r' || result::varchar || case when c_custkey % 4 = 0 then '.wb.tim' else '.tim' end as file from c), g as (select config, 'r' || ((result + case when c_custkey % 10 = 0 then 1 else 0 end) % 25)::varchar || case when c_custkey % 4 = 0 then '.wb.tim' else '.tim' end as file from c), d as (select config, 1 as a, 0 as b from (from (from f where not contains(file, 'wb')) except from (from g where not contains(file, 'wb'))) union all select config, 0, 1 from (from (from g where not contains(file, 'wb')) except from (from f where not contains(file, 'wb')))) select config, sum(a)::bigint as only_config, sum(b)::bigint as only_release from d group by config")
def config_changed_files(spark, sf_dir):
    from pulsewright.operators import audit

    c = _configs(spark, sf_dir)
    name = lambda x: F.concat(F.lit("r"), x.cast("string"), F.when(F.col("c_custkey") % 4 == 0, ".wb.tim").otherwise(".tim"))
    g = c.select("config", name((F.col("result") + F.when(F.col("c_custkey") % 10 == 0, 1).otherwise(0)) % 25).alias("file"))
    own = c.select("config", name(F.col("result")).alias("file"))
    return audit.changed_configs(audit.file_differences(audit.of_mode(own, "nb"), audit.of_mode(g, "nb")))


@query("select 'S' || c_custkey::varchar as psr, case when c_custkey % 2 = 0 then ['mjdstart'] else []::varchar[] end as invalid, case when c_custkey % 2 = 0 then ['mjd-start'] else []::varchar[] end as missing, case when c_nationkey % 3 = 0 then ['snr-cut'] else []::varchar[] end as empty, (c_nationkey % 3)::int as bad_toa, 1 as bad_file from customer")
def rule_key_problems(spark, sf_dir):
    from pulsewright.operators import audit

    k, n = F.col("c_custkey"), F.col("c_nationkey")
    keys = F.array(F.lit("snr-cut"), F.when(k % 2 == 0, "mjdstart").otherwise("mjd-start"))
    toa, file = F.struct(F.lit("f").alias("name"), F.lit(1).alias("chan")), F.struct(F.lit("x").alias("pattern"))
    ignore = F.struct(keys.alias("keys"), F.when(n % 3 == 0, F.array(F.lit("snr-cut"))).otherwise(F.array().cast("array<string>")).alias("null_keys"), F.array_repeat(toa, (n % 3).cast("int")).alias("bad_toa"), F.array(file).alias("bad_file"))
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("S"), k.cast("string")).alias("psr"), ignore.alias("ignore"))
    return audit.key_problems(c, ["snr-cut", "mjd-start"]).select("psr", "invalid", "missing", "empty", *[F.col("entries")[x].alias(x) for x in ("bad_toa", "bad_file")])
