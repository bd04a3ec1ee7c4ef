"""Observation tables bound to the star-schema test tables, as DataFrames and as the same text in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsewright.operators import scan


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each observation: a line item seen as an arrival time in the file of its order."""
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    number = F.row_number().over(Window.partitionBy("psr").orderBy("l_orderkey", *ORDER)).cast("long")
    return _observed(both.withColumn("psr", _source("l_orderkey")), number, F.concat(F.lit("file_"), F.col("l_orderkey").cast("string")))


#: What numbers the line items of an order.
ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _source(order: str) -> Column:
    return F.concat(F.lit("PSR"), (F.col(order) % 50).cast("string"))


def toas_by_file(spark: SparkSession, sf_dir: str, ids: bool = True) -> DataFrame:
    """``toas`` with the order's number as ``name``, so that rows stay where the join by orders put them: windows over files move nothing.

    A row's number is its place in its order and the rows of the source's orders before; without ``ids`` it is null.
    """
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    number = F.lit(None).cast("long")
    if ids:
        both = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("of_lines")).join(orders.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("of_orders")), "o_orderkey")
        rows = both.select("o_orderkey", _source("o_orderkey").alias("psr"), (F.col("of_lines") * F.col("of_orders")).alias("rows"))
        orders = orders.join(scan.ahead(rows, ["psr"], "o_orderkey", "rows").select("o_orderkey", "ahead"), "o_orderkey")
        number = (F.col("ahead") + F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER))).cast("long")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return _observed(both.withColumn("psr", _source("l_orderkey")), number, F.col("l_orderkey"))


def _observed(both: DataFrame, number: Column, name: Column) -> DataFrame:
    return both.select(
        "psr",
        number.alias("toa_id"),
        name.alias("name"),
        (F.lit(40587) + F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")) + (F.col("l_partkey") % 100) / F.lit(10000.0)).alias("mjd"),
        (F.lit(400.0) + F.col("l_partkey") % 1400).alias("freq_mhz"),
        (F.lit(0.5) + F.lit(10.0) * F.col("l_tax")).alias("err_us"),
        F.col("o_orderstatus").alias("obs"),
        F.substring("o_orderpriority", 1, 1).alias("pta"),
        F.col("l_returnflag").alias("fe"),
        F.col("l_linestatus").alias("be"),
        F.concat_ws("_", "l_returnflag", "l_linestatus").alias("f"),
        F.col("l_linenumber").alias("chan"),
        (F.col("l_partkey") % 4).cast("int").alias("subint"),
        F.col("l_quantity").alias("snr"),
        F.col("l_quantity").alias("bw_mhz"),
        (F.lit(1.0) + F.col("l_linenumber") / F.lit(10.0)).alias("fratio"),
        (F.col("l_extendedprice") / F.lit(10000.0)).alias("flux"),
        (F.lit(100.0) * (F.col("l_discount") - F.lit(0.05))).alias("resid_us"),
        ((F.col("l_suppkey") % 100) / F.lit(100.0)).alias("pout"),
        (F.lit(0.2) + (F.col("l_partkey") % 290) / F.lit(100.0)).alias("sun_angle_rad"),
        F.when(F.col("l_suppkey") % 7 != 0, F.lit(20.0) + F.col("l_discount")).alias("pp_dm"),
        F.when(F.col("l_suppkey") % 7 != 0, F.lit(0.001) + F.col("l_tax")).alias("pp_dme"),
    )


TOAS = """toas as (
  select psr, row_number() over (partition by psr order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
           l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as toa_id,
         'file_' || l_orderkey::varchar as name,
         40587 + date_diff('day', date '1970-01-01', o_orderdate::date) + (l_partkey % 100)::double / 10000.0::double as mjd,
         400.0::double + (l_partkey % 1400)::double as freq_mhz, 0.5::double + 10.0::double * l_tax as err_us, o_orderstatus as obs,
         substr(o_orderpriority, 1, 1) as pta, l_returnflag as fe, l_linestatus as be, l_returnflag || '_' || l_linestatus as f,
         l_linenumber as chan, (l_partkey % 4)::int as subint, l_quantity as snr, l_quantity as bw_mhz,
         1.0::double + l_linenumber::double / 10.0::double as fratio, l_extendedprice / 10000.0::double as flux,
         100.0::double * (l_discount - 0.05::double) as resid_us, (l_suppkey % 100)::double / 100.0::double as pout,
         0.2::double + (l_partkey % 290)::double / 100.0::double as sun_angle_rad,
         case when l_suppkey % 7 <> 0 then 20.0::double + l_discount end as pp_dm,
         case when l_suppkey % 7 <> 0 then 0.001::double + l_tax end as pp_dme
  from (select *, 'PSR' || (l_orderkey % 50)::varchar as psr from lineitem) l join orders on l_orderkey = o_orderkey
)"""


def rows(spark: SparkSession, schema: str, values: list[tuple]) -> DataFrame:
    """A small rule table."""
    return spark.createDataFrame(values, schema)


def params(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """Model parameters: psr, name, value, uncertainty, frozen. ``shift`` moves values and drops every thirteenth row."""
    part = read(spark, sf_dir, "part")
    out = part.select(
        F.concat(F.lit("PSR"), (F.col("p_partkey") % 50).cast("string")).alias("psr"),
        F.concat_ws("_", "p_type", F.col("p_partkey").cast("string")).alias("name"),
        (F.col("p_retailprice") + F.lit(float(shift)) * (F.col("p_partkey") % 5)).alias("value"),
        (F.col("p_size") / F.lit(10.0)).alias("uncertainty"),
        (F.col("p_size") % 2 == 0).alias("frozen"),
        "p_partkey",
    )
    return out.filter(f"p_partkey % 13 <> {shift % 13}").drop("p_partkey") if shift else out.drop("p_partkey")


def params_sql(name: str, shift: int = 0) -> str:
    where = f"where p_partkey % 13 <> {shift % 13}" if shift else ""
    return f"""{name} as (select 'PSR' || (p_partkey % 50)::varchar as psr, p_type || '_' || p_partkey::varchar as name,
      p_retailprice + {float(shift)}::double * (p_partkey % 5) as value, p_size::double / 10.0::double as uncertainty, p_size % 2 = 0 as frozen from part {where})"""


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampler chains: chain, sample, vals, and the likelihood in the last place of vals."""
    return read(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("chain"),
        F.col("vec_id").alias("sample"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vals"),
    )


CHAINS = "chains as (select 'c' || label::varchar as chain, vec_id as sample, embedding::double[] as vals from embeddings)"


#: Microseconds since 1970 of a timestamp without a zone, whatever the session's.
MICROS = "datediff(ts, date'1970-01-01') * 86400000000L + (hour(ts) * 3600L + minute(ts) * 60L) * 1000000L + cast(extract(SECOND FROM ts) * 1000000 as bigint)"


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as dense observation times of a user."""
    e = read(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("psr"), "event_id", (F.lit(60310.0) + F.expr(f"({MICROS})") % 864000000000 / F.lit(86400000000.0)).alias("mjd"), F.col("event_type").alias("f"), F.col("value").alias("resid_us"))


SESSIONS = """sessions as (select 'U' || user_id::varchar as psr, event_id,
  60310.0::double + (epoch_us(ts) % 864000000000)::double / 86400000000.0::double as mjd, event_type as f, value as resid_us from events)"""
