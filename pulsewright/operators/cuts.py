"""Cut rules: which observations are left out, and why. The first rule that applies names the reason.

Every function takes and returns DataFrames keyed by psr. Rule tables are small and joined on their keys; whether a side
is broadcast is left to Spark, which knows its size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsewright.operators.settle import settled


def first_reason(*reasons: Column) -> Column:
    """The first of several nullable reasons."""
    return F.coalesce(*reasons)


def reason(when: Column, name: str | Column) -> Column:
    return F.when(when, F.lit(name) if isinstance(name, str) else name)


def listed(toas: DataFrame, rules: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """``toas`` with boolean column ``mark``: is the row's key in the rule table?"""
    return toas.join(rules.select(*keys).distinct().withColumn(mark, F.lit(True)), keys, "left").withColumn(mark, F.coalesce(mark, F.lit(False)))


def snr_reason(cut: Column | float) -> Column:
    """Below the cut; a row without a signal-to-noise ratio is kept."""
    return reason(F.col("snr") < cut, "snr")


def mjd_reason(start: Column | None, end: Column | None) -> Column:
    return first_reason(reason(F.col("mjd") < start, "mjdstart"), reason(F.col("mjd") > end, "mjdend"))


def outlier_reason(prob: float, pout: str = "pout") -> Column:
    return reason(F.coalesce(F.col(pout), F.lit(0.0)) > prob, f"outlier{int(prob * 100)}")


def bad_ranges(toas: DataFrame, ranges: DataFrame) -> DataFrame:
    """``toas`` with ``in_bad_range``: strictly inside a range (psr, lo, hi, range_be) whose backend is theirs or null."""
    r = ranges.withColumnRenamed("psr", "range_psr")
    hit = (F.col("psr") == F.col("range_psr")) & (F.col("lo") < F.col("mjd")) & (F.col("mjd") < F.col("hi")) & (F.col("range_be").isNull() | (F.col("range_be") == F.col("be")))
    inside = toas.join(r, hit, "left_semi").select("psr", "toa_id").withColumn("in_bad_range", F.lit(True))
    return toas.join(inside, ["psr", "toa_id"], "left").withColumn("in_bad_range", F.coalesce("in_bad_range", F.lit(False)))


def bad_groups(toas: DataFrame, rules: DataFrame, flags: tuple[str, ...] = ("fe", "be", "obs", "pta")) -> DataFrame:
    """Rows with a (flag, value) pair that the rules (psr, flag, value) list."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("flag"), F.col(n).cast("string").alias("value")) for n in flags]))
    hit = toas.select("psr", "toa_id", pairs.alias("p")).select("psr", "toa_id", "p.flag", "p.value").join(rules, ["psr", "flag", "value"], "left_semi")
    return toas.join(hit.select("psr", "toa_id").distinct(), ["psr", "toa_id"], "left_semi")


#: Characters of the pieces by which names and parts of names meet.
PIECE = 4


def containing(names: DataFrame, entries: DataFrame, piece: int = PIECE) -> DataFrame:
    """(psr, pattern, name): the names (psr, name) that each entry (psr, pattern) is a part of; both are distinct.

    Names are listed by their pieces of a few characters, and an entry looks only in the list of that piece of its own
    which fewest names have: so entries and names meet by keys, and no entry is held against all names of its source.
    Entries shorter than a piece, which most names would hold, are looked for in all names of their source.
    """
    pieces = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - F.lit(piece - 1)), lambda at: F.substr(F.col(c), at, F.lit(piece))))).alias("piece")
    wanted = settled(entries.filter(F.length("pattern") >= piece).select("psr", "pattern", pieces("pattern")))
    # only pieces that some entry has are listed at all
    listed = names.filter(F.length("name") >= piece).select("psr", "name", pieces("name")).join(wanted.select("psr", "piece").distinct(), ["psr", "piece"], "left_semi")
    length = listed.groupBy("psr", "piece").agg(F.count(F.lit(1)).alias("n"))
    asked = wanted.join(length, ["psr", "piece"], "left")
    rarest = asked.groupBy("psr", "pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("least"))
    found = listed.join(rarest.select("psr", "pattern", "least.piece"), ["psr", "piece"])
    short = names.join(entries.filter(F.length("pattern") < piece).select("psr", "pattern"), "psr")
    part = F.col("name").contains(F.col("pattern"))
    return found.filter(part).select("psr", "pattern", "name").union(short.filter(part).select("psr", "pattern", "name"))


def bad_files(toas: DataFrame, entries: DataFrame) -> DataFrame:
    """For each entry (psr, pattern): how many distinct files contain it, and the file where it is one; else nothing is cut."""
    names = toas.select("psr", "name", "cut").groupBy("psr", "name").agg(F.count(F.lit(1)).alias("n"), F.count("cut").alias("n_cut"))
    met = containing(names.select("psr", "name"), entries.select("psr", "pattern").distinct())
    per = met.groupBy("psr", "pattern").agg(F.count("name").alias("files"), F.min("name").alias("name"))
    one = per.filter("files = 1").join(names, ["psr", "name"]).select("psr", "pattern", "n", "n_cut")
    full = entries.join(per, ["psr", "pattern"], "left").join(one, ["psr", "pattern"], "left").withColumn("files", F.coalesce("files", F.lit(0)))
    is_one = F.col("files") == 1
    return full.select("psr", "pattern", "files", F.when(is_one, F.col("name")).alias("name"), F.when(~is_one, "not one file").when(F.col("n") == F.col("n_cut"), "redundant").otherwise("cut").alias("status"))


def cut_bad_files(toas: DataFrame, entries: DataFrame) -> DataFrame:
    """``cut`` with badfile for the uncut rows of files that an entry names and no other file shares."""
    hit = bad_files(toas, entries).filter("files = 1").select("psr", "name")
    return apply_rules(listed(toas, hit, ["psr", "name"], "is_bad_file"), [reason(F.col("is_bad_file"), "badfile")]).drop("is_bad_file")


def cut_bad_toas(toas: DataFrame, entries: DataFrame, keys: tuple[str, ...] = ("name", "chan", "subint"), as_reason: str = "badtoa") -> DataFrame:
    """``cut`` for the first row that each entry matches, where it isn't cut already."""
    hit = bad_toas(toas, entries, keys).filter("status = 'badtoa'").select("psr", "toa_id")
    return apply_rules(listed(toas, hit, ["psr", "toa_id"], "is_bad_toa"), [reason(F.col("is_bad_toa"), as_reason)]).drop("is_bad_toa")


def bad_toas(toas: DataFrame, entries: DataFrame, keys: tuple[str, ...] = ("name", "chan", "subint")) -> DataFrame:
    """For each entry (psr, *keys) the first matching row by toa_id, or null; whether it is cut already."""
    on = ["psr", *keys]
    w = Window.partitionBy(*on).orderBy("toa_id")
    first = toas.select(*on, "toa_id", "cut").join(entries.select(*on).distinct(), on, "left_semi").withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")
    out = entries.select(*on).distinct().join(first, on, "left")
    return out.select(*on, "toa_id", F.when(F.col("toa_id").isNull(), "unmatched").when(F.col("cut").isNotNull(), "already cut").otherwise("badtoa").alias("status"))


def many_outliers(threshold: float = 8.0) -> Column:
    """Are more rows of the row's file outlier cuts than the rounded share allows?"""
    w = Window.partitionBy("psr", "name")
    return F.count_if(F.col("cut").contains("outlier")).over(w) > F.bround(F.count(F.lit(1)).over(w) * F.lit(threshold) / F.lit(100.0))


def file_outliers(toas: DataFrame, threshold: float = 8.0) -> DataFrame:
    """``cut`` with maxout for the uncut rows of files where more rows are outlier cuts than the rounded share allows."""
    return toas.withColumn("cut", first_reason(F.col("cut"), reason(many_outliers(threshold), "maxout")))


def no_ppdm(toas: DataFrame) -> DataFrame:
    """Wideband rows without a dispersion measure of their own."""
    return toas.withColumn("cut", first_reason(F.col("cut"), reason(F.col("pp_dm").isNull(), "no_ppdm")))


def survivors(toas: DataFrame) -> DataFrame:
    return toas.filter(F.col("cut").isNull())


def apply_rules(toas: DataFrame, reasons: list[Column]) -> DataFrame:
    """One pass over the rows: the reasons in order, none replacing an earlier one."""
    before = [F.col("cut")] if "cut" in toas.columns else []
    return toas.withColumn("cut", first_reason(*before, *reasons))


def stages(toas: DataFrame, plan: list[tuple[str, list[Column]]]) -> DataFrame:
    """Reasons stage by stage; ``cut_stage`` names the stage that cut a row."""
    found = [(name, first_reason(*r)) for name, r in plan]
    stage = reduce(lambda acc, x: acc.when(x[1].isNotNull(), x[0]), found[1:], F.when(found[0][1].isNotNull(), found[0][0]))
    return toas.withColumn("cut", first_reason(*[r for _, r in found])).withColumn("cut_stage", stage)


def stage_counts(toas: DataFrame, order: list[str]) -> DataFrame:
    """(psr, stage, before, removed) of every source and stage: rows there were before the stage, and those it removed."""
    n = toas.groupBy("psr", "cut_stage").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("psr").agg(F.sum("n").alias("total"))
    steps = total.select("psr", "total", F.posexplode(F.array(*map(F.lit, order))).alias("k", "stage"))
    met = steps.join(n.withColumnRenamed("cut_stage", "stage"), ["psr", "stage"], "left").withColumn("removed", F.coalesce("n", F.lit(0)))
    earlier = F.coalesce(F.sum("removed").over(Window.partitionBy("psr").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return met.select("psr", "stage", (F.col("total") - earlier).alias("before"), "removed")


#: Backends in the names of receiver-backends.
BACKENDS = ("GUPPI", "GASP", "PUPPI", "ASP", "YUPPI")


def receiver_of(febe: Column | str, backends: tuple[str, ...] = BACKENDS) -> Column:
    """The receiver in the name of a receiver-backend."""
    return F.regexp_replace(febe, "_(" + "|".join(backends) + ")", "")


def bad_oscillator(toas: DataFrame, site: str = "arecibo", start: float = 57984.0, end: float = 58447.0) -> DataFrame:
    """(psr, bad_lo): has the source a row of the site while its local oscillator was off?"""
    return toas.groupBy("psr").agg(F.coalesce(F.bool_or((F.col("obs") == site) & (F.col("mjd") > start) & (F.col("mjd") < end)), F.lit(False)).alias("bad_lo"))


def residual_series(toas: DataFrame, labels: list[str] | None = None, columns: tuple[str, ...] = ("mjd", "freq_mhz", "resid_us", "err_us")) -> DataFrame:
    """(psr, columns, cut) with 'good' for rows that aren't cut; only some labels if asked."""
    out = toas.select("psr", *columns, F.coalesce("cut", F.lit("good")).alias("cut"))
    return out if labels is None else out.filter(F.col("cut").isin(*labels))


def files_with(toas: DataFrame, reason_: str) -> DataFrame:
    """(psr, name) of files with a row that was cut for this reason."""
    return toas.filter(F.col("cut") == reason_).select("psr", "name").distinct()


def excised(toas: DataFrame, reasons: list[str], archives: DataFrame | None = None) -> DataFrame:
    """(psr, cut, name, chan, subint) of rows cut for one of some reasons; with ``archives`` also the ``path`` of each archive of that file name, null if none."""
    out = toas.filter(F.col("cut").isin(*reasons)).select("psr", "cut", "name", "chan", "subint")
    return out if archives is None else out.join(archives.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "path"), "name", "left")


def _off(value: str, error: str, most: float | None, n_sigma: float | None, max_sigma: float | None) -> Column:
    """Far off and, if asked, by enough errors; or known too badly. Nothing is off without a threshold."""
    if most is None:
        return F.lit(False)
    far = [F.abs(value) > most, *([F.abs(F.col(value) / F.col(error)) > n_sigma] if n_sigma is not None else [])]
    vague = [F.col(error) > max_sigma] if max_sigma is not None else []
    return reduce(Column.__or__, [reduce(Column.__and__, far), *vague])


def large_residuals(us: float | None = None, n_sigma: float | None = None, max_sigma: float | None = None, dm: float | None = None, asp_dms: bool = False) -> Column:
    """Rows whose residual is off by over ``us``, or whose DM residual (dm_resid, dm_err) is by over ``dm``.

    ``n_sigma`` and ``max_sigma`` hold for both kinds. DMs of ASP backends don't count unless asked for.
    """
    if us is None and dm is None:
        raise ValueError("give a threshold for residuals or for DM")
    of_dm = _off("dm_resid", "dm_err", dm, n_sigma, max_sigma)
    if dm is not None and not asp_dms:
        of_dm &= ~F.col("be").endswith("ASP")
    return _off("resid_us", "err_us", us, n_sigma, max_sigma) | of_dm


def touching(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """The ``rows`` (keys, toa_id, lo, hi) whose band touches one of the ``others`` in the same keys.

    A sweep over the edges: of the others that begin by the time a band ends, does any reach to where it begins? Running
    greatest ends answer that with one sort, however many bands there are. Bands without edges touch none.
    """
    line = others.select(*keys, F.col("lo").alias("at"), F.col("hi").alias("reach"), F.lit(False).alias("asks")).unionByName(
        rows.select(*keys, F.col("hi").alias("at"), "lo", "toa_id", F.lit(True).alias("asks")), allowMissingColumns=True
    )
    so_far = F.max("reach").over(Window.partitionBy(*keys).orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0))
    return line.filter("at is not null").withColumn("so_far", so_far).filter("asks and so_far >= lo").select(*keys, "toa_id")


def simultaneous(toas: DataFrame, keep: str, lose: str) -> DataFrame:
    """``simul`` 1 for kept and 2 for lost rows seen by both backends on one day with one receiver in touching bands.

    Lost rows that are cut already cause no mark on either side. No pair is looked at.
    """
    half = F.coalesce(F.col("bw_mhz"), F.lit(0.0)) / 2
    keys = ["psr", "day", "fe"]
    toas = settled(toas)  # read five times
    t = toas.select("psr", F.floor("mjd").alias("day"), "fe", "toa_id", "be", "cut", (F.col("freq_mhz") - half).alias("lo"), (F.col("freq_mhz") + half).alias("hi")).filter("day is not null and fe is not null")
    a, b = t.filter(F.col("be") == keep), t.filter((F.col("be") == lose) & F.col("cut").isNull())
    mark = lambda x, y, as_: touching(x, y, keys).select("psr", "toa_id", F.lit(as_).alias("simul"))
    marked = toas.join(mark(a, b, "1").union(mark(b, a, "2")), ["psr", "toa_id"], "left")
    return marked.withColumn("cut", first_reason(F.col("cut"), reason(F.col("simul") == "2", "simul")))
