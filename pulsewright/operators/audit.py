"""Configurations against files, versions and logs: what is missing, shared, stale or not cleared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def result_use(configs: DataFrame, results: DataFrame) -> DataFrame:
    """(result, configs, state) of every result file: unused, shared by several configurations, or ok."""
    n = configs.groupBy("result").agg(F.count_distinct("config").alias("configs"))
    out = results.join(n, "result", "left").withColumn("configs", F.coalesce("configs", F.lit(0)))
    return out.withColumn("state", F.when(F.col("configs") == 0, "unused").when(F.col("configs") > 1, "shared").otherwise("ok"))


def pairing(configs: DataFrame) -> DataFrame:
    """(source, paired, mode): does a source have both modes? ``mode`` is the first there is."""
    t = F.split("config", r"\.")
    s = configs.select(t[0].alias("source"), t[1].alias("mode")).distinct()
    return s.groupBy("source").agg((F.bool_or(F.col("mode") == "nb") & F.bool_or(F.col("mode") == "wb")).alias("paired"), F.min("mode").alias("mode"))


def product_counts(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Expected products that are missing or there more than once."""
    n = found.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    out = expected.join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("state", F.when(F.col("n") == 0, "missing").when(F.col("n") > 1, "multiple").otherwise("ok")).filter("n <> 1")


def changelog(log: DataFrame, tags: list[str]) -> DataFrame:
    """(config, entries, invalid, ready_day) of logs with entries 'date user TAG: note'."""
    p = log.select("config", F.substring("entry", 1, 10).alias("day"), F.regexp_extract("entry", " ([A-Z_]+): ", 1).alias("tag"))
    return p.groupBy("config").agg(F.count(F.lit(1)).alias("entries"), F.count_if(~F.col("tag").isin(*tags)).alias("invalid"), F.max(F.when(F.col("tag") == "READY_FOR", F.col("day"))).alias("ready_day"))


def ready_versions(log: DataFrame) -> DataFrame:
    """(config, day, version) of each log's last READY_FOR entry: by day, then by the entry's text."""
    p = log.filter(F.col("entry").rlike(" READY_FOR: ")).select("config", "entry", F.substring("entry", 1, 10).alias("day"), F.regexp_extract("entry", " READY_FOR: (.*)$", 1).alias("version"))
    return p.groupBy("config").agg(F.max(F.struct("day", "entry", "version")).alias("m")).select("config", "m.day", "m.version")


def append_entry(configs: DataFrame, tag: str, note: str, user: str, day: str, where: Column | None = None, tags: list[str] | None = None) -> DataFrame:
    """``changelog`` with one more entry 'day user TAG: note', for the configurations that match."""
    if tags is not None and tag not in tags:
        raise ValueError(f"no such tag: {tag}")
    more = F.concat(F.coalesce("changelog", F.array().cast("array<string>")), F.array(F.lit(f"{day} {user} {tag}: {note}")))
    return configs.withColumn("changelog", more if where is None else F.when(where, more).otherwise(F.col("changelog")))


def result_problems(configs: DataFrame, files: DataFrame) -> DataFrame:
    """(config, problem) of configurations (config, source, mode, timing_model, compare_model): file name not source.mode.yaml, model or comparison model not among ``files`` (file)."""
    f = files.select("file").distinct()
    lost = lambda c, p: configs.filter(F.col(c).isNotNull()).join(f.withColumnRenamed("file", c), c, "left_anti").select("config", F.lit(p).alias("problem"))
    named = configs.filter(~F.col("config").eqNullSafe(F.concat("source", F.lit("."), F.lower("mode"), F.lit(".yaml")))).select("config", F.lit("name").alias("problem"))
    unset = configs.filter("timing_model is null").select("config", F.lit("no model").alias("problem"))
    return named.union(unset).union(lost("timing_model", "model missing")).union(lost("compare_model", "comparison missing"))


def of_mode(files: DataFrame, mode: str) -> DataFrame:
    """Files (file) of one mode: wideband ones have wb in their name, narrowband ones don't."""
    return files.filter(F.col("file").contains("wb") if mode == "wb" else ~F.col("file").contains("wb"))


def changed_configs(differences: DataFrame) -> DataFrame:
    """(config, only_config, only_release): configurations of which a file is on one side only, and how many."""
    n = lambda s: F.count_if(F.col("side") == s)
    return differences.groupBy("config").agg(n("config only").alias("only_config"), n("release only").alias("only_release"))


def key_problems(configs: DataFrame, valid: list[str]) -> DataFrame:
    """(psr, invalid, missing, empty, entries) of configurations with an ``ignore`` struct: keys that aren't known, aren't there, or have no value, and how many entries the lists have."""
    v = F.array(*map(F.lit, valid))
    lists = [c for c in ("bad_toa", "bad_file", "bad_range", "bad_group") if c in configs.schema["ignore"].dataType.fieldNames()]
    entries = F.create_map(*[x for c in lists for x in (F.lit(c), F.coalesce(F.size(f"ignore.{c}"), F.lit(0)))])
    return configs.select("psr", F.array_except("ignore.keys", v).alias("invalid"), F.array_except(v, F.col("ignore.keys")).alias("missing"), F.col("ignore.null_keys").alias("empty"), entries.alias("entries"))


def cleared(configs: DataFrame, own: str = "cleared") -> DataFrame:
    """(config, open, cleared): how many check fields besides the switch itself still say something."""
    left = F.map_filter("check", lambda k, v: (k != own) & v.isNotNull() & (v != ""))
    return configs.select("config", F.size(left).alias("open"), (F.size(left) == 0).alias("cleared"))


def rule_keys(configs: DataFrame, valid: list[str]) -> DataFrame:
    """Keys of each configuration that aren't valid, and valid ones that it lacks."""
    v = F.array(*map(F.lit, valid))
    return configs.withColumn("invalid", F.array_except("keys", v)).withColumn("missing", F.array_except(v, F.col("keys")))


def file_differences(configs: DataFrame, release: DataFrame) -> DataFrame:
    """(config, file, side) of files that only one list has."""
    c, r = configs.select("config", "file").distinct(), release.select("config", "file").distinct()
    one = lambda a, b, s: a.join(b, ["config", "file"], "left_anti").withColumn("side", F.lit(s))
    return one(c, r, "config only").union(one(r, c, "release only"))


def newest(paths: DataFrame, used: DataFrame) -> DataFrame:
    """(source, newest, used, stale): the last run folder of each source against the one in use."""
    runs = paths.select(F.regexp_extract("path", r"/([^/]+)/([^/]+)/[^/]+$", 1).alias("source"), F.regexp_extract("path", r"/([^/]+)/([^/]+)/[^/]+$", 2).alias("run"))
    return runs.groupBy("source").agg(F.max("run").alias("newest")).join(used, "source").withColumn("stale", F.col("newest") != F.col("used"))


def set_field(configs: DataFrame, field: str, value: Column, where: Column, note: str) -> DataFrame:
    """A field's new value in the configurations that match, each with a note in its log."""
    if field not in configs.columns:
        raise ValueError(f"no such field: {field}")
    logged = configs.withColumn("changelog", F.when(where, F.concat("changelog", F.array(F.lit(note)))).otherwise(F.col("changelog")))
    return logged.withColumn(field, F.when(where, value).otherwise(F.col(field)))
