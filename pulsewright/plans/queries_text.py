"""Registered queries: observations and parameters written as lines of text and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsewright.operators.settle import settled
from pulsewright.plans.queries_cuts import CUT, cut_toas
from pulsewright.plans.registration import query
from pulsewright.sources import text
from pulsewright.sources.binding import TOAS, params, params_sql, read, toas


def _flagged(spark, sf_dir, t=None):
    t = toas(spark, sf_dir) if t is None else t
    flags = F.create_map(F.lit("be"), F.col("be"), F.lit("chan"), F.col("chan").cast("string"), F.lit("fe"), F.col("fe"), F.lit("subint"), F.col("subint").cast("string"))
    return t.withColumn("flags", flags)


def _lines(df, line, path="psr", number="toa_id"):
    return df.select(F.col(path).alias("path"), F.col(number).alias("line_no"), line.alias("value"))


@query(f"with {TOAS} select psr, toa_id, name, freq_mhz, obs, fe, be, chan::varchar as chan, subint::varchar as subint from toas")
def tim_round_trip(spark, sf_dir):
    t = _flagged(spark, sf_dir).withColumn("cut", F.lit(None).cast("string"))
    got = text.parse_tim(settled(_lines(t, text.tim_line())))
    return got.select(F.col("path").alias("psr"), F.col("line_no").alias("toa_id"), "name", "freq_mhz", "obs", *[F.col("flags")[c].alias(c) for c in ("fe", "be", "chan", "subint")])


MJD_TXT = "(floor(mjd)::bigint)::varchar || '.' || lpad(((chan * 7919 + subint * 104729 + toa_id * 1299709) % 1000000000)::varchar, 9, '0') || lpad((toa_id % 1000000)::varchar, 6, '0')"


@query(f"with {TOAS} select psr, toa_id, {MJD_TXT} as mjd_txt from toas")
def tim_decimal_round_trip(spark, sf_dir):
    """Times of 15 decimals come back digit for digit; no double holds them. The header isn't a row."""
    digits = F.lpad(((F.col("chan") * 7919 + F.col("subint") * 104729 + F.col("toa_id") * 1299709) % 1000000000).cast("string"), 9, "0")
    decimal = F.concat(F.floor("mjd").cast("string"), F.lit("."), digits, F.lpad((F.col("toa_id") % 1000000).cast("string"), 6, "0"))
    t = _flagged(spark, sf_dir).withColumns({"cut": F.lit(None).cast("string"), "mjd_txt": decimal.cast("decimal(20,15)")})
    lines = text.tim_lines(t).select(F.col("psr").alias("path"), F.col("toa_id").alias("line_no"), "value")
    return text.parse_tim(lines).select(F.col("path").alias("psr"), F.col("line_no").alias("toa_id"), F.col("mjd_txt").cast("string").alias("mjd_txt"))


@query("select p_partkey, 'PSR' || (p_partkey % 50)::varchar || '_FIT_' || strftime(date '2020-01-01' + (p_partkey % 700)::int, '%Y%m%d') || '.' || case when p_size % 2 = 0 then 'nb' else 'wb' end || '.par' as file from part")
def output_names(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("p_partkey") % 700).cast("int"))
    source = F.concat(F.lit("PSR"), (F.col("p_partkey") % 50).cast("string"))
    return p.select("p_partkey", text.output_name(source, F.when(F.col("p_size") % 2 == 0, "NB").otherwise("WB"), day, "FIT", "par").alias("file"))


@query("select 'PSR' || (p_partkey % 50)::varchar as psr, p_partkey as ord, p_type as name, case when p_size % 3 = 0 then '-f' end as mask_key, case when p_size % 3 = 0 then p_brand end as mask_value, p_retailprice as value, p_size % 2 = 0 as fit, case when p_size % 2 = 0 then p_size / 8.0::double end as uncertainty from (select p_partkey, replace(p_type, ' ', '_') as p_type, p_brand, p_retailprice, p_size from part)")
def par_write_round_trip(spark, sf_dir):
    masked, fit = F.col("p_size") % 3 == 0, F.col("p_size") % 2 == 0
    p = read(spark, sf_dir, "part").select(
        F.concat(F.lit("PSR"), (F.col("p_partkey") % 50).cast("string")).alias("psr"), F.col("p_partkey").alias("ord"), F.translate("p_type", " ", "_").alias("name"), F.when(masked, "-f").alias("mask_key"),
        F.when(masked, F.col("p_brand")).alias("mask_value"), F.col("p_retailprice").alias("value"), fit.alias("fit"), F.when(fit, F.col("p_size") / F.lit(8.0)).alias("uncertainty"),
    )
    got = text.parse_par(_lines(p, text.par_line(fortran=True), number="ord"))
    return got.select(F.col("path").alias("psr"), F.col("line_no").alias("ord"), "name", "mask_key", "mask_value", "value", "fit", "uncertainty")


@query(f"with {TOAS} select psr, row_number() over (partition by psr order by name, toa_id) - 1 as toa_id, name from toas")
def tim_renumber(spark, sf_dir):
    t = toas(spark, sf_dir).withColumn("path", F.col("name")).withColumn("line_no", F.col("toa_id")).drop("toa_id")
    return text.renumber(t).select("psr", "toa_id", "name")


@query(f"with {CUT} select psr as path, count(cut) as restored from cut_toas group by psr")
def tim_uncomment(spark, sf_dir):
    t = _flagged(spark, sf_dir, cut_toas(spark, sf_dir))
    return text.uncomment(_lines(t, text.tim_line()))[1]


@query(f"with {CUT} select psr, count(*) filter (cut is null) as n from cut_toas group by psr")
def tim_commented_rows_skipped(spark, sf_dir):
    t = _flagged(spark, sf_dir, cut_toas(spark, sf_dir))
    return text.parse_tim(_lines(t, text.tim_line())).groupBy(F.col("path").alias("psr")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {CUT} select psr, toa_id, coalesce(cut, 'none') as cut from cut_toas")
def tim_cut_flags_kept(spark, sf_dir):
    t = _flagged(spark, sf_dir, cut_toas(spark, sf_dir))
    got = text.parse_tim(settled(_lines(t, text.tim_line(cut_as_comment=False))))
    return got.select(F.col("path").alias("psr"), F.col("line_no").alias("toa_id"), F.coalesce(F.try_element_at("flags", F.lit("cut")), F.lit("none")).alias("cut"))


@query(f"with {TOAS} select psr as path, toa_id as line_no, case when obs = 'O' then name || ' ao x' else name || ' ' || obs || ' x' end as value from toas union all select distinct psr, -1, 'MODE 1' from toas")
def tim_other_dialect(spark, sf_dir):
    t = toas(spark, sf_dir)
    line = F.concat_ws(" ", "name", F.when(F.col("obs") == "O", "arecibo").otherwise(F.col("obs")), F.lit("x"))
    return text.convert_tim(_lines(t, line))


PAR = f"{params_sql('p')}"


@query(f"with {PAR} select psr, name, value, not frozen as fit, case when frozen then null else uncertainty end as uncertainty from p")
def par_round_trip(spark, sf_dir):
    p = params(spark, sf_dir)
    line = F.when(F.col("frozen"), F.format_string("%s %.6f", "name", "value")).otherwise(F.concat(F.col("name"), F.lit(" "), F.regexp_replace(F.format_string("%.10e", "value"), "e", "D"), F.lit(" 1 "), F.regexp_replace(F.format_string("%.10e", "uncertainty"), "e", "D")))
    return text.parse_par(_lines(p, line, number="name")).select(F.col("path").alias("psr"), "name", F.round("value", 6).alias("value"), "fit", F.round("uncertainty", 6).alias("uncertainty"))


@query("select 'PSR' || (p_partkey % 50)::varchar as psr, p_name, '-f' as mask_key, p_brand as mask_value, p_size::double as value from part")
def par_mask_rows(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("psr", F.concat(F.lit("PSR"), (F.col("p_partkey") % 50).cast("string")))
    line = F.concat_ws(" ", F.translate("p_name", " ", "_"), F.lit("-f"), "p_brand", F.col("p_size").cast("string"), F.lit("1"), F.lit("0.5"))
    got = text.parse_par(_lines(p, line, number="p_partkey"))
    return got.select(F.col("path").alias("psr"), F.translate("name", "_", " ").alias("p_name"), "mask_key", "mask_value", "value")


@query("select 'PSR' || (p_partkey % 50)::varchar as psr, p_partkey as ord, case p_type when 'ECONOMY' then 'XDOT' when 'PROMO' then 'T2EFAC' else p_type end as name, case when p_type = 'STANDARD' then p_size::varchar else p_size::varchar || '.5' end as value_txt from part where p_type <> 'SMALL'")
def par_other_dialect(spark, sf_dir):
    kind = F.when(F.col("p_type") == "ECONOMY", "A1DOT").when(F.col("p_type") == "PROMO", "EFAC").when(F.col("p_type") == "STANDARD", "NHARMS").when(F.col("p_type") == "SMALL", "CHI2").otherwise(F.col("p_type"))
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("PSR"), (F.col("p_partkey") % 50).cast("string")).alias("psr"), F.col("p_partkey").alias("ord"), kind.alias("name"), F.concat(F.col("p_size").cast("string"), F.lit(".5")).alias("value_txt"))
    out = text.convert_par(p)
    return out.select("psr", "ord", F.when(F.col("name") == "NHARMS", "STANDARD").otherwise(F.col("name")).alias("name"), "value_txt")


@query("select 'PSR' || (p_partkey % 50)::varchar as psr, p_partkey as idx, k.k::int as ord, case k.k when 0 then printf('DMX%s_%04d  %.10f', 'R1', p_partkey, p_retailprice) else printf('DMX%s_%04d  %.10f', 'R2', p_partkey, p_retailprice + 6.5::double) end as line from part, range(2) k(k)")
def dmx_block_lines(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("PSR"), (F.col("p_partkey") % 50).cast("string")).alias("psr"), F.col("p_partkey").alias("idx"), F.lit(0.0).alias("val"), F.lit(0.0).alias("err"), F.col("p_retailprice").alias("r1"), (F.col("p_retailprice") + F.lit(6.5)).alias("r2"))
    return text.dmx_lines(p, range_only=True)


@query(f"with {TOAS} select psr, mjd, resid_us as val, err_us as err, freq_mhz as r1, flux as r2 from toas")
def series_file_rows(spark, sf_dir):
    t = toas(spark, sf_dir)
    got = text.parse_series(_lines(t, F.concat_ws("  ", *[F.col(c).cast("string") for c in ("mjd", "resid_us", "err_us", "freq_mhz", "flux", "snr")])))
    return got.select(F.col("path").alias("psr"), "mjd", "val", "err", "r1", "r2")


@query("select 'c' || label::varchar as chain, vec_id as sample, embedding[1]::double as first, len(embedding) as n from embeddings")
def chain_file_rows(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    line = F.concat_ws("\t", F.transform("embedding", lambda x: x.cast("double").cast("string")))
    got = text.parse_chain(e.select(F.concat(F.lit("/runs/c"), F.col("label").cast("string"), F.lit("/chain_1.txt")).alias("path"), F.col("vec_id").alias("line_no"), line.alias("value")))
    return got.select("chain", "sample", F.col("vals")[0].alias("first"), F.size("vals").cast("long").alias("n"))


FILE = "'S' || (o_custkey % 40)::varchar || '.' || replace(o_orderpriority, ' ', '') || '.' || o_orderstatus || '.15y.x.' || case when o_orderkey % 3 = 0 then 'wb' else 'nb' end || '.tim'"


def _files(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select(F.concat_ws(".", F.concat(F.lit("S"), (F.col("o_custkey") % 40).cast("string")), F.translate("o_orderpriority", " ", ""), "o_orderstatus", F.lit("15y"), F.lit("x"), F.when(F.col("o_orderkey") % 3 == 0, "wb").otherwise("nb"), F.lit("tim")).alias("name"))


@query(f"select name, split_part(name, '.', 1) as source, split_part(name, '.', 2) as receiver, split_part(name, '.', 3) as backend, split_part(name, '.', 4) as release, split_part(name, '.', 6) as mode from (select {FILE} as name from orders)")
def tim_inventory(spark, sf_dir):
    return text.inventory(_files(spark, sf_dir))


@query(f"with f as (select distinct {FILE} as name from orders), i as (select name, split_part(name, '.', 1) as source, split_part(name, '.', 2) as receiver, split_part(name, '.', 6) as mode from f), g as (select source, mode, list_sort(list(name)) as files, count(distinct receiver) as n from i group by all) "
       "select source, mode, files, list_concat(case source when 'S1' then ['F0', 'F1', 'PX'] when 'S2' then []::varchar[] else ['F0', 'F1'] end, case when mode = 'wb' then list_transform(range(1, n + 1), lambda k: 'DMJUMP' || k::varchar) else []::varchar[] end) as free, case when mode = 'wb' then 25.0::double else 8.0::double end as snr_cut, case when source = 'S3' then ['bad_a'] else []::varchar[] end as bad_files from g")
def initial_configs(spark, sf_dir):
    inv = text.inventory(_files(spark, sf_dir).distinct())
    own = F.when(F.col("source") == "S1", F.lit("PX")).otherwise(F.lit("DMX_0002"))
    free = inv.filter("source <> 'S2'").select(F.col("source").alias("psr"), F.explode(F.array(F.lit("F1"), F.lit("DMX_0001"), F.lit("F0"), own)).alias("name")).distinct()
    return text.initial_configs(inv, free, spark.createDataFrame([("S3", "bad_a")], "psr string, pattern string"))


@query(f"with {TOAS}, g as (select name, min(f) as receiver, floor(min(mjd))::bigint as mjd, count(*) as n_removed, min(err_us) as ftest, max(err_us) as esum from toas group by name) select name, receiver, mjd, n_removed, ftest, esum from g")
def epochdrop_rows(spark, sf_dir):
    g = toas(spark, sf_dir).groupBy("name").agg(F.min("f").alias("receiver"), F.floor(F.min("mjd")).cast("long").alias("mjd"), F.count(F.lit(1)).alias("n_removed"), F.min("err_us").alias("ftest"), F.max("err_us").alias("esum"))
    lines = g.select(F.lit("all").alias("path"), F.lit(0).alias("line_no"), F.concat_ws(" ", *[F.col(c).cast("string") for c in g.columns]).alias("value"))
    return text.parse_epochdrop(lines).drop("path")


@query("with f as (select distinct 'S' || (o_custkey % 40)::varchar as source, case when o_orderstatus = 'F' then 'wb' else 'nb' end as mode, strftime(o_orderdate, '%Y%m%d') as d from orders), r as (select *, source || '_FIT_' || d || '.' || mode || '.par' as file, row_number() over (partition by source, mode order by d desc) as k from f) select source, mode, max(file) filter (k = 1) as latest, max(file) filter (k = 2) as previous, count(*) as files from r group by all")
def latest_par_by_date(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    file = F.concat(F.lit("S"), (F.col("o_custkey") % 40).cast("string"), F.lit("_FIT_"), F.date_format("o_orderdate", "yyyyMMdd"), F.when(F.col("o_orderstatus") == "F", ".wb").otherwise(".nb"), F.lit(".par"))
    return text.latest_files(o.select(file.alias("file")))


@query(f"with {TOAS} select '/d/' || psr || '/top.tim' as path, name, obs, toa_id as line_no from toas")
def tim_includes(spark, sf_dir):
    """Each source's top file includes one of each receiver, which includes one of each backend."""
    t = settled(_flagged(spark, sf_dir).select("psr", "toa_id", "name", "freq_mhz", "mjd", "err_us", "obs", "fe", "f", "flags", F.lit(None).cast("string").alias("cut")))
    folder = lambda name: F.concat(F.lit("/d/"), "psr", F.lit("/"), name, F.lit(".tim"))
    head = lambda path, to: t.select(folder(path).alias("path"), F.lit(-1).cast("long").alias("line_no"), F.concat(F.lit("INCLUDE "), to, F.lit(".tim")).alias("value")).distinct()
    own = t.select(folder(F.col("f")).alias("path"), F.col("toa_id").alias("line_no"), text.tim_line().alias("value"))
    lines = settled(head(F.lit("top"), F.col("fe")).union(head(F.col("fe"), F.col("f"))).union(own))
    return text.parse_tim(text.follow_includes(lines)).select("path", "name", "obs", "line_no")


@query("with o as (select o_orderkey, '/runs/x' || case when o_orderkey % 2 = 0 then '/S' || (o_custkey % 40)::varchar || '_nb/' else '/' end as root, 'S' || (o_custkey % 40)::varchar as source from orders) select o_orderkey, '/runs/x/' || source || '_nb/' as folder, source as psr, 'nb' as mode from o")
def chain_folders(spark, sf_dir):
    k, source = F.col("o_orderkey"), F.concat(F.lit("S"), (F.col("o_custkey") % 40).cast("string"))
    root = F.concat(F.lit("/runs/x/"), F.when(k % 2 == 0, F.concat(source, F.lit("_nb/"))).otherwise(""))
    o = read(spark, sf_dir, "orders").select(k, text.chain_folder(root, source, F.lit("NB")).alias("folder"))
    return o.select("o_orderkey", "folder", text.of_chain_folder(F.concat("folder", F.lit("chain_1.txt"))).alias("x")).select("o_orderkey", "folder", "x.*")


@query("select 'c' || (p_partkey % 50)::varchar as chain, (p_partkey // 50)::int as pos, p_brand as name from part")
def chain_parameter_names(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return text.parse_names(p.select(F.concat(F.lit("/runs/c"), (F.col("p_partkey") % 50).cast("string"), F.lit("/pars.txt")).alias("path"), F.floor(F.col("p_partkey") / 50).alias("line_no"), F.concat(F.lit(" "), "p_brand").alias("value")))
