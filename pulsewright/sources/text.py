"""Arrival-time and parameter files, read and written as text: every format is a few column expressions over lines.

``lines`` frames are (path, line_no, value); line numbers are the files' own, however the files are split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsewright.operators import scan
from pulsewright.operators.settle import settled

SPACE = r"\s+"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value) of every line of every file under a path or glob, numbered from 0.

    Files are split as Spark splits them, so a file of any size is read by as many tasks as it has blocks. A line's number
    is its place in its block and how many lines the file's earlier blocks have, which a count for each block tells.
    """
    here = F.monotonically_increasing_id()  # goes up by one from line to line of a block
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), here.alias("place"), "value")
    blocks = raw.groupBy("path", "block").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = blocks.select("path", "block", (ahead - F.col("first")).alias("shift"))
    return raw.join(shifts, ["path", "block"]).select("path", (F.col("place") + F.col("shift")).alias("line_no"), "value")


def _flags(first: int) -> Column:
    """Map of the -key value pairs in tokens ``t`` from ``first`` on; the last one of a repeated key counts."""
    tail = F.slice("t", first + 1, F.greatest(F.lit(0), F.floor((F.size("t") - first) / 2).cast("int") * 2))
    keys = F.transform(F.filter(tail, lambda _, k: k % 2 == 0), lambda x: F.regexp_replace(x, "^-", ""))
    values = F.filter(tail, lambda _, k: k % 2 == 1)
    plain = F.map_from_arrays(keys, values)
    places = F.filter(F.sequence(F.lit(1), F.size(keys)), lambda k: ~F.array_contains(F.slice(keys, k + 1, F.size(keys)), F.element_at(keys, k)))
    last = F.map_from_arrays(F.transform(places, lambda k: F.element_at(keys, k)), F.transform(places, lambda k: F.element_at(values, k)))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.when(F.size(tail) == 0, none).when(F.size(F.array_distinct(keys)) == F.size(keys), plain).otherwise(last)


def parse_tim(lines: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One row for each arrival time: name, freq_mhz, mjd as text and double, err_us, obs, flags. Header and comment lines are none."""
    body = lines.withColumn("value", F.trim("value")).filter("value <> ''").filter(~F.col("value").rlike(r"^(FORMAT|MODE|INCLUDE|TIME|C |#|C$)"))
    t = F.split("value", SPACE)
    number = lambda k: F.expr(f"try_cast(get(t, {k}) as double)")
    out = body.withColumn("t", t).filter(F.size("t") >= 5)
    return out.select(
        "path", "line_no", *(extra or []), F.get("t", F.lit(0)).alias("name"), number(1).alias("freq_mhz"), F.expr("try_cast(get(t, 2) as decimal(20,15))").alias("mjd_txt"),
        number(2).alias("mjd"), number(3).alias("err_us"), F.get("t", F.lit(4)).alias("obs"), _flags(5).alias("flags"),
    )


def included(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("value").rlike(r"^\s*INCLUDE\s")).select("path", "line_no", F.split(F.trim("value"), SPACE)[1].alias("file"))


def follow_includes(lines: DataFrame, deepest: int = 8) -> DataFrame:
    """Lines of the files that no other file includes, with those of the files they include, at any depth up to ``deepest``.

    ``path`` becomes that of the file at the top, ``source`` is the line's own. A file is found by its name in the folder
    of the one that includes it; what isn't there adds nothing. Deeper chains, or files that include each other, are an error.
    """
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    links = settled(included(lines).select("path", F.concat(folder, "file").alias("source")).distinct())
    roots = lines.select("path").distinct().join(links.select(F.col("source").alias("path")).distinct(), "path", "left_anti")
    step = settled(roots.select("path", F.col("path").alias("source")))
    reach = step
    for _ in range(deepest + 1):
        step = settled(step.join(links.select(F.col("path").alias("source"), F.col("source").alias("next")), "source").select("path", F.col("next").alias("source")).distinct())
        if step.isEmpty():
            break
        reach = reach.union(step)
    else:
        raise ValueError(f"files include others more than {deepest} deep")
    if not lines.select(F.col("path").alias("source")).distinct().join(reach, "source", "left_anti").isEmpty():
        raise ValueError("files include each other")
    own = lines.withColumnRenamed("path", "source").filter(~F.col("value").rlike(r"^\s*INCLUDE\s"))
    return own.join(reach.distinct(), "source").select("path", "source", "line_no", "value")


def renumber(toas: DataFrame) -> DataFrame:
    """``toa_id`` from 0 in load order within each source: by file, then line."""
    return scan.numbered(toas, ["psr"], ["path", "line_no"], F.struct("path", scan.of_numbers("line_no").alias("block")), "toa_id", start=0)


def uncomment(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines with commented arrival times restored, and how many there were by file."""
    is_toa = F.col("value").rlike(r"^C\s+\S+\s+[0-9.]+\s+[0-9]+\.[0-9]+\s")
    fixed = lines.withColumn("value", F.when(is_toa, F.regexp_replace("value", r"^C\s+", "")).otherwise(F.col("value")))
    return fixed, lines.groupBy("path").agg(F.count_if(is_toa).alias("restored"))


def tim_line(cut_as_comment: bool = True, exact: bool = False) -> Column:
    """An arrival time as text, from name, freq_mhz, mjd, err_us, obs, flags and cut.

    ``exact`` writes mjd_txt, the time as it was read, digit for digit; a double holds fewer digits.
    """
    flags = F.array_join(F.transform(F.array_sort(F.map_entries("flags")), lambda e: F.concat(F.lit("-"), e["key"], F.lit(" "), e["value"])), " ")
    mjd = F.coalesce(F.col("mjd_txt").cast("string"), F.format_string("%.15f", "mjd")) if exact else F.format_string("%.15f", "mjd")
    line = F.concat_ws(" ", "name", F.format_string("%.6f", "freq_mhz"), mjd, F.format_string("%.3f", "err_us"), "obs", F.when(flags != "", flags))
    if cut_as_comment:
        return F.when(F.col("cut").isNotNull(), F.concat(F.lit("C "), line, F.lit(" -cut "), F.col("cut"))).otherwise(line)
    return F.concat_ws(" ", line, F.when(F.col("cut").isNotNull(), F.concat(F.lit("-cut "), F.col("cut"))))


def tim_lines(toas: DataFrame, cut_as_comment: bool = True) -> DataFrame:
    """(psr, toa_id, value) of each source's file: its format in line -1, then the rows in order. A null ``toa_id`` isn't allowed."""
    rows = toas.select("psr", F.col("toa_id").cast("long").alias("toa_id"), tim_line(cut_as_comment, "mjd_txt" in toas.columns).alias("value"))
    return rows.union(toas.select("psr").distinct().select("psr", F.lit(-1).cast("long"), F.lit("FORMAT 1")))


def write_tim(toas: DataFrame, path: str, cut_as_comment: bool = True) -> None:
    """One folder for each source; lines in order within it, the format first."""
    out = tim_lines(toas, cut_as_comment).repartition("psr").sortWithinPartitions("psr", "toa_id")
    out.select("psr", "value").write.partitionBy("psr").mode("overwrite").text(path)


def output_name(source: Column, mode: Column, day: Column, what: str, ending: str, added: str = "") -> Column:
    """``{source}_{what}_{yyyymmdd}{added}.{mode}.{ending}``, as results are named; mode in small letters."""
    return F.concat(source, F.lit(f"_{what}_"), F.date_format(day, "yyyyMMdd"), F.lit(f"{added}."), F.lower(mode), F.lit(f".{ending}"))


def par_line(fortran: bool = False) -> Column:
    """A parameter as text, from name, mask_key, mask_value, value, fit and uncertainty (the last two may be null)."""
    number = lambda c: F.regexp_replace(F.format_string("%.15e", c), "e", "D") if fortran else F.format_string("%.15e", c)
    fitted = F.coalesce(F.col("fit"), F.lit(False))
    mask = F.when(F.col("mask_key").isNotNull(), F.concat_ws(" ", "mask_key", "mask_value"))
    return F.concat_ws(" ", "name", mask, number("value"), F.when(fitted | F.col("uncertainty").isNotNull(), F.when(fitted, "1").otherwise("0")), F.when(F.col("uncertainty").isNotNull(), number("uncertainty")))


def write_par(params: DataFrame, path: str, fortran: bool = False) -> None:
    """One folder for each source, its parameters (psr, ord, name, mask_key, mask_value, value, fit, uncertainty) in order."""
    out = params.select("psr", "ord", par_line(fortran).alias("value")).repartition("psr").sortWithinPartitions("psr", "ord")
    out.select("psr", "value").write.partitionBy("psr").mode("overwrite").text(path)


def parse_par(lines: DataFrame) -> DataFrame:
    """One row for each parameter: name, mask key and value, value as text and number, fit flag, uncertainty."""
    body = lines.withColumn("value", F.trim("value")).filter(~F.col("value").rlike(r"^(#|C |$)"))
    t = body.withColumn("t", F.split("value", SPACE))
    masked = F.coalesce(F.try_element_at("t", F.lit(2)).rlike(r"^-[A-Za-z]"), F.lit(False))
    at = lambda k: F.when(masked, F.try_element_at("t", F.lit(k + 2))).otherwise(F.try_element_at("t", F.lit(k)))
    u = t.select("path", "line_no", F.col("t")[0].alias("name"), F.when(masked, F.col("t")[1]).alias("mask_key"), F.when(masked, F.try_element_at("t", F.lit(3))).alias("mask_value"), at(2).alias("value_txt"), at(3).alias("a"), at(4).alias("b"))
    number = lambda c: F.expr(f"try_cast(replace(replace({c}, 'D', 'E'), 'd', 'e') as double)")
    two = F.col("b").isNotNull()
    fit = F.when(two | F.col("a").isin("0", "1"), F.col("a") == "1").otherwise(False)
    return u.select("path", "line_no", "name", "mask_key", "mask_value", "value_txt", number("value_txt").alias("value"), F.coalesce(fit, F.lit(False)).alias("fit"), F.when(two, number("b")).when(~F.col("a").isin("0", "1"), number("a")).alias("uncertainty"))


def created_at(lines: DataFrame) -> DataFrame:
    got = lines.select("path", F.regexp_extract("value", r"^# Created: (\S+)", 1).alias("created")).filter("created <> ''")
    return got.groupBy("path").agg(F.max("created").alias("created"))


def dmx_lines(bins: DataFrame, range_only: bool = False, fit_flag: bool = True, fortran: bool = False) -> DataFrame:
    """(psr, idx, ord, line) of a bin's parameters in fixed format; ``fortran`` writes D exponents."""
    e = lambda c: F.regexp_replace(F.format_string("%.8e", c), "e", "D") if fortran else F.format_string("%.8e", c)
    one = F.format_string("DMX_%04d  %18s %3d %20s", F.col("idx").cast("int"), e("val"), F.lit(1 if fit_flag else 0), e("err"))
    edge = lambda n, c: F.format_string(f"DMX{n}_%04d  %.10f", F.col("idx").cast("int"), F.col(c))
    rows = [edge("R1", "r1"), edge("R2", "r2")] if range_only else [one, edge("R1", "r1"), edge("R2", "r2")]
    return bins.select("psr", "idx", F.posexplode(F.array(*rows)).alias("ord", "line"))


#: How parameters are called in the other dialects.
PAR_RENAMES = {"A1DOT": "XDOT", "STIGMA": "VARSIGMA", "EFAC": "T2EFAC", "EQUAD": "T2EQUAD"}
PAR_DROPPED = ("CHI2", "SWM", "CHI2R", "TRES", "DMRES")


def convert_par(params: DataFrame, tempo2: bool = True) -> DataFrame:
    """Parameter rows in another dialect: renamed, some dropped, harmonics as whole numbers, ECL replaced."""
    names = F.create_map(*[F.lit(x) for kv in PAR_RENAMES.items() for x in kv])
    out = params.filter(~F.col("name").isin(*PAR_DROPPED))
    value = F.when(F.col("name") == "NHARMS", F.expr("cast(cast(try_cast(value_txt as double) as int) as string)")).when(F.col("name") == "ECL", F.lit("IERS2003")).otherwise(F.col("value_txt"))
    name = F.coalesce(names[F.col("name")], F.col("name"))
    if tempo2:
        name = F.when(F.col("name") == "T2CMETHOD", F.lit("#T2CMETHOD")).otherwise(name)
    return out.withColumn("value_txt", value).withColumn("name", name)


def convert_tim(lines: DataFrame) -> DataFrame:
    """Lines in another dialect: a MODE line on top, the site token changed."""
    changed = lines.withColumn("value", F.regexp_replace("value", r"(^|\s)arecibo(\s|$)", "$1ao$2"))
    top = lines.select("path").distinct().select("path", F.lit(-1).alias("line_no"), F.lit("MODE 1").alias("value"))
    return top.unionByName(changed.select("path", "line_no", "value"))


def parse_series(lines: DataFrame) -> DataFrame:
    """The first five numbers of each line: mjd, val, err, r1, r2."""
    t = lines.filter(~F.trim("value").rlike("^(#|$)")).withColumn("t", F.split(F.trim("value"), SPACE)).filter("size(t) >= 5")
    return t.select("path", *[F.expr(f"try_cast(t[{k}] as double)").alias(n) for k, n in enumerate(("mjd", "val", "err", "r1", "r2"))])


def parse_chain(lines: DataFrame) -> DataFrame:
    """(chain, sample, vals) with the chain's name taken from its folder."""
    vals = F.transform(F.split(F.trim("value"), SPACE), lambda x: x.try_cast("double"))
    return lines.filter("trim(value) <> ''").select(F.regexp_extract("path", r"([^/]+)/[^/]*$", 1).alias("chain"), F.col("line_no").cast("long").alias("sample"), vals.alias("vals"))


def parse_names(lines: DataFrame) -> DataFrame:
    """(chain, pos, name) of files with one parameter name a line, in the order of the samples' places."""
    return lines.filter("trim(value) <> ''").select(F.regexp_extract("path", r"([^/]+)/[^/]*$", 1).alias("chain"), F.col("line_no").cast("int").alias("pos"), F.trim("value").alias("name"))


def chain_folder(root: Column, source: Column, mode: Column) -> Column:
    """Where a source's chain lies: the root itself if it ends in source_mode, else that folder in it; with a slash at the end."""
    last = F.concat_ws("_", source, F.lower(mode))
    bare = F.regexp_replace(root, "/+$", "")
    return F.when(F.regexp_extract(bare, r"([^/]*)$", 1) == last, F.concat(bare, F.lit("/"))).otherwise(F.concat(bare, F.lit("/"), last, F.lit("/")))


def of_chain_folder(path: Column) -> Column:
    """(psr, mode) that a path into a chain's folder names; nulls if none."""
    part = lambda k: F.nullif(F.regexp_extract(path, r"(?:^|/)([^/]+)_(nb|wb)/", k), F.lit(""))
    return F.struct(part(1).alias("psr"), part(2).alias("mode"))


def latest_files(names: DataFrame) -> DataFrame:
    """(source, mode, latest, previous, files) of model files (file) named source_what_yyyymmdd.mode.par: the last by date, and the one before."""
    pattern = r"^([^_/]+)_.*?(\d{8})[^.]*\.(nb|wb)\.par$"
    part = lambda k: F.regexp_extract("file", pattern, k)
    p = names.filter(F.col("file").rlike(pattern)).select("file", part(1).alias("source"), part(2).alias("date"), part(3).alias("mode")).distinct()
    g = p.groupBy("source", "mode").agg(F.count(F.lit(1)).alias("files"), F.max(F.struct("date", "file")).alias("top"))
    below = p.join(g.select("source", "mode", F.col("top.file").alias("top_file")), ["source", "mode"]).filter("file <> top_file").groupBy("source", "mode").agg(F.max(F.struct("date", "file")).alias("next"))
    return g.join(below, ["source", "mode"], "left").select("source", "mode", F.col("top.file").alias("latest"), F.col("next.file").alias("previous"), "files")


def inventory(names: DataFrame) -> DataFrame:
    """source.receiver.backend.release.x.mode.tim to columns."""
    t = F.split("name", r"\.")
    return names.select("name", *[F.try_element_at(t, F.lit(k)).alias(c) for k, c in ((1, "source"), (2, "receiver"), (3, "backend"), (4, "release"))], F.try_element_at(t, F.lit(-2)).alias("mode"))


def initial_configs(files: DataFrame, params: DataFrame, bad_files: DataFrame) -> DataFrame:
    """A row for each source and mode: its files, free parameters without bins, the mode's cut, its bad files."""
    f = files.groupBy("source", "mode").agg(F.sort_array(F.collect_list("name")).alias("files"), F.sort_array(F.collect_set("receiver")).alias("receivers"))
    p = params.filter(~F.col("name").startswith("DMX")).groupBy(F.col("psr").alias("source")).agg(F.sort_array(F.collect_set("name")).alias("free"))
    b = bad_files.groupBy(F.col("psr").alias("source")).agg(F.sort_array(F.collect_set("pattern")).alias("bad_files"))
    out = f.join(p, "source", "left").join(b, "source", "left")
    jumps = F.transform(F.sequence(F.lit(1), F.size("receivers")), lambda k: F.concat(F.lit("DMJUMP"), k.cast("string")))
    free = F.when(F.col("mode") == "wb", F.concat(F.coalesce("free", F.array()), jumps)).otherwise(F.coalesce("free", F.array()))
    return out.select("source", "mode", "files", free.alias("free"), F.when(F.col("mode") == "wb", 25.0).otherwise(8.0).alias("snr_cut"), F.coalesce("bad_files", F.array().cast("array<string>")).alias("bad_files"))


def parse_epochdrop(lines: DataFrame) -> DataFrame:
    t = lines.filter(~F.trim("value").rlike("^(#|$)")).withColumn("t", F.split(F.trim("value"), SPACE)).filter("size(t) >= 6")
    return t.select("path", F.col("t")[0].alias("name"), F.col("t")[1].alias("receiver"), F.expr("try_cast(t[2] as bigint)").alias("mjd"), F.expr("try_cast(t[3] as bigint)").alias("n_removed"), F.expr("try_cast(t[4] as double)").alias("ftest"), F.expr("try_cast(t[5] as double)").alias("esum"))
