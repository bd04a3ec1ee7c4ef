"""Dispersion-measure time bins: making, filling, checking and repairing them, all sources in one job.

Bins are rows (psr, ord, low, high). A time lies in a bin strictly between its edges, or on them if not strict. Range
joins meet on (psr, bucket of time), so neither side is copied to the other; only the sequential steps run in numpy, on
the distinct times of one session or the unassigned times of one source.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsewright.functions import kernels, scalar
from pulsewright.operators import scan
from pulsewright.operators.cuts import first_reason, reason
from pulsewright.operators.settle import settled

BUCKET = 16.0


def inside(strict: bool = True) -> Column:
    return (F.col("low") < F.col("mjd")) & (F.col("mjd") < F.col("high")) if strict else (F.col("low") <= F.col("mjd")) & (F.col("mjd") <= F.col("high"))


def members(times: DataFrame, bins: DataFrame, strict: bool = True, bucket: float = BUCKET) -> DataFrame:
    """Rows of ``times`` (psr, mjd, ...) beside each bin that holds them."""
    b = bins.filter("low <= high").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("low") / bucket), F.floor(F.col("high") / bucket))))
    t = times.withColumn("bucket", F.floor(F.col("mjd") / bucket))
    return t.join(b, ["psr", "bucket"]).filter(inside(strict)).drop("bucket")


#: Days of the short buckets in which each row is held against all bins of its bucket at once.
SHORT = 2.0


def holding(times: DataFrame, bins: DataFrame, strict: bool = True, bucket: float = SHORT) -> DataFrame:
    """``times`` (psr, mjd, ...), each row once, with ``held``: the numbers of the bins that hold it.

    A bucket's few bins are one row of a small table, so no row of ``times`` is moved where that is broadcast.
    """
    b = bins.filter("low <= high").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("low") / bucket), F.floor(F.col("high") / bucket))))
    near = b.groupBy("psr", "bucket").agg(F.collect_list(F.struct("ord", "low", "high")).alias("near"))
    low, high, mjd = (lambda x: x["low"]), (lambda x: x["high"]), F.col("mjd")
    holds = (lambda x: (low(x) < mjd) & (mjd < high(x))) if strict else (lambda x: (low(x) <= mjd) & (mjd <= high(x)))
    held = F.coalesce(F.transform(F.filter("near", holds), lambda x: x["ord"]), F.array().cast("array<long>"))
    return times.withColumn("bucket", F.floor(F.col("mjd") / bucket)).join(near, ["psr", "bucket"], "left").select(*times.columns, held.alias("held"))


def overlapping(bins: DataFrame) -> DataFrame:
    """Bins that have an edge of another bin strictly inside."""
    edges = bins.select("psr", F.explode(F.array("low", "high")).alias("mjd"))
    return members(edges, bins).select("psr", "ord").distinct()


def check(times: DataFrame, bins: DataFrame, strict: bool = True) -> DataFrame:
    """(psr, kind, id) of everything that is wrong: bins improper, overlapping or empty; rows in no bin or in several.

    The rows are read once; what the five kinds need of them is written down.
    """
    b = settled(bins.select("psr", "ord", "low", "high"))
    t = settled(holding(times.select("psr", "toa_id", "mjd"), b, strict).select("psr", "toa_id", "held"))
    kind = lambda df, k, c: df.select("psr", F.lit(k).alias("kind"), F.col(c).cast("long").alias("id"))
    return (
        kind(b.filter("low >= high"), "improper", "ord")
        .union(kind(overlapping(b), "overlapping", "ord"))
        .union(kind(b.join(t.select("psr", F.explode("held").alias("ord")).distinct(), ["psr", "ord"], "left_anti"), "empty", "ord"))
        .union(kind(t.filter("size(held) = 0"), "in no bin", "toa_id"))
        .union(kind(t.filter("size(held) > 1"), "in several bins", "toa_id"))
    )


def frequencies(found: DataFrame, wideband: bool = False) -> DataFrame:
    """(psr, ord, low_freq, high_freq) of the bins' members; wideband rows reach over their band, in single precision."""
    lo, hi = F.col("freq_mhz"), F.col("freq_mhz")
    if wideband:
        low = (F.col("bw_mhz") / (F.col("fratio") - 1)).cast("float")
        top = (F.col("bw_mhz").cast("float") + low).cast("float")
        is_wide = F.col("pp_dm").isNotNull()
        lo, hi = F.when(is_wide, F.least(lo, low.cast("double"))).otherwise(lo), F.when(is_wide, F.greatest(hi, top.cast("double"))).otherwise(hi)
    return found.groupBy("psr", "ord").agg(F.min(lo).alias("low_freq"), F.max(hi).alias("high_freq"))


def passing(found: DataFrame, ratio: float = 1.1, wideband: bool = False) -> DataFrame:
    """Bins whose highest frequency is at least ``ratio`` times the lowest."""
    return frequencies(found, wideband).filter(F.col("high_freq") / F.col("low_freq") >= ratio)


def ratio_rows(toas: DataFrame, bins: DataFrame, ratio: float = 1.1, strict: bool = True, wideband: bool = False, invert: bool = False) -> DataFrame:
    """Rows that a passing bin covers, or with ``invert`` those that none does."""
    found = members(toas, bins, strict)
    good = found.join(passing(found, ratio, wideband).select("psr", "ord"), ["psr", "ord"], "left_semi").select("psr", "toa_id").distinct()
    return toas.join(good, ["psr", "toa_id"], "left_anti" if invert else "left_semi")


def ratio_cut(toas: DataFrame, bins: DataFrame, ratio: float = 1.1) -> DataFrame:
    """``cut`` with dmx for uncut rows that no passing bin covers."""
    toas = settled(toas)  # read twice
    return _without_bin(toas, _passing(toas.filter("cut is null"), bins, ratio))


def _passing(live: DataFrame, bins: DataFrame, ratio: float) -> DataFrame:
    """The bins that pass by the frequencies of the uncut rows in them."""
    found = members(live.select("psr", "mjd", "freq_mhz"), bins)
    return settled(bins.join(passing(found, ratio).select("psr", "ord"), ["psr", "ord"], "left_semi"))


def _without_bin(toas: DataFrame, bins: DataFrame) -> DataFrame:
    """``cut`` with dmx for uncut rows that none of ``bins`` holds."""
    return holding(toas, bins).withColumn("cut", first_reason(F.col("cut"), reason(F.size("held") == 0, "dmx"))).drop("held")


def epochs(found: DataFrame, weighted: bool = True, digits: int = 9) -> DataFrame:
    w = 1 / (F.col("err_us") * F.col("err_us")) if weighted else F.lit(1.0)
    return found.groupBy("psr", "ord").agg(F.round(F.sum(w * F.col("mjd")) / F.sum(w), digits).alias("epoch"), F.count(F.lit(1)).alias("n"))


def table(toas: DataFrame, bins: DataFrame, values: DataFrame | None = None, start: int = 1, digits: int = 9, member_ids: bool = False) -> DataFrame:
    """Bin parameters: index by the bins' order, value and error (zero if none given), epoch, edges and frequencies.

    ``member_ids`` adds the ids of the rows in each bin.
    """
    found = members(toas, bins)
    out = bins.join(epochs(found, digits=digits), ["psr", "ord"], "left").join(frequencies(found), ["psr", "ord"], "left")
    if values is not None:
        out = out.join(values.select("psr", "ord", "val", "err"), ["psr", "ord"], "left")
    else:
        out = out.withColumn("val", F.lit(0.0)).withColumn("err", F.lit(0.0))
    idx = F.row_number().over(Window.partitionBy("psr").orderBy("ord")) + F.lit(start - 1)
    ids = []
    if member_ids:
        out = out.join(found.groupBy("psr", "ord").agg(F.sort_array(F.collect_list("toa_id")).alias("members")), ["psr", "ord"], "left")
        ids = [F.coalesce("members", F.array().cast("array<long>")).alias("members")]
    return out.select("psr", idx.cast("long").alias("idx"), F.coalesce("val", F.lit(0.0)).alias("val"), F.coalesce("err", F.lit(0.0)).alias("err"), "epoch", F.col("low").alias("r1"), F.col("high").alias("r2"), F.coalesce("low_freq", F.lit(float("inf"))).alias("f1"), F.coalesce("high_freq", F.lit(0.0)).alias("f2"), *ids)


def _each_session(times: DataFrame, keys: tuple[str, ...], gap: float | Column, of, schema: str) -> DataFrame:
    """``of(keys, sorted times)`` of every super-session of the keys' distinct times, in one pass over sorted partitions.

    No bin can reach over a ``gap`` that wide; sessions are never split. ``of`` returns what follows the keys in ``schema``.
    """

    def run(batches):
        kept: list[pd.DataFrame] = []
        for pdf in batches:
            kept.append(pdf)
            rows = pd.concat(kept, ignore_index=True)
            new = np.flatnonzero((rows[by].to_numpy()[1:] != rows[by].to_numpy()[:-1]).any(axis=1)) + 1
            if len(new):
                kept = [rows.iloc[new[-1] :]]
                yield done(rows.iloc[: new[-1]], [0, *new[:-1].tolist(), int(new[-1])])
            else:
                kept = [rows]
        rows = pd.concat(kept, ignore_index=True) if kept else pd.DataFrame()
        if len(rows):
            yield done(rows, [0, len(rows)])

    def done(rows: pd.DataFrame, bounds: list[int]) -> pd.DataFrame:
        own, mjd = list(zip(*(rows[k].tolist() for k in keys), strict=True)), rows["mjd"].to_numpy()
        return pd.DataFrame([(*own[a], *r) for a, b in zip(bounds[:-1], bounds[1:], strict=True) for r in of(own[a], mjd[a:b])], columns=names)

    names, by = [c.split()[0] for c in schema.split(",")], [*keys, "session"]
    ready = scan.sessions(times.select(*keys, "mjd").distinct(), list(keys), gap, name="session").repartition(*by).sortWithinPartitions(*by, "mjd")
    return ready.select(*by, "mjd").mapInPandas(run, schema)


def greedy_by(times: DataFrame, keys: dict[str, str], width: float | None, pad: float = 0.0, strict: bool = True) -> DataFrame:
    """(keys, low, high) of greedy bins over the times of each key; ``keys`` are names and types.

    Without a ``width`` the key of that name is the width of its bins.
    """
    at = list(keys).index("width") if width is None else 0
    of = lambda own, mjds: kernels.greedy_bins(mjds, own[at] if width is None else width, pad, strict).tolist()
    wide = (F.col("width") if width is None else F.lit(float(width))) + pad + 2 * kernels.EDGE
    return _each_session(times, tuple(keys), wide, of, ", ".join([*(f"{k} {t}" for k, t in keys.items()), "low double, high double"]))


def greedy(times: DataFrame, width: float, pad: float = 0.0, strict: bool = True) -> DataFrame:
    """(psr, ord, low, high) of greedy bins over all times of each source."""
    return numbered(greedy_by(times, {"psr": "string"}, width, pad, strict))


def numbered(bins: DataFrame) -> DataFrame:
    return bins.select("psr", F.row_number().over(Window.partitionBy("psr").orderBy("low", "high")).cast("long").alias("ord"), "low", "high")


def epoch_counts(times: DataFrame, width: float = 6.5) -> DataFrame:
    """(psr, epochs): the greedy count of epochs; sessions that no epoch reaches over are counted apart."""
    of = lambda _, mjds: [(kernels.epoch_count(mjds, width),)]
    return _each_session(times, ("psr",), width, of, "psr string, n long").groupBy("psr").agg(F.sum("n").alias("epochs"))


def _parted(times: DataFrame, bins: DataFrame, gap: float) -> tuple[DataFrame, DataFrame]:
    """Both with ``part``: stretches of times and bins so far apart that nothing in one can reach the other."""
    both = times.select("psr", F.col("mjd").alias("low"), F.col("mjd").alias("high")).union(bins.select("psr", "low", "high")).distinct()
    parts = settled(scan.stretched(both, ["psr"], gap))
    of_time = times.join(parts.filter("low = high").select("psr", F.col("low").alias("mjd"), "part"), ["psr", "mjd"])
    return of_time, bins.join(parts, ["psr", "low", "high"])


def expand(toas: DataFrame, bins: DataFrame | None, width: float, pad: float = 0.0, add_new: bool = False) -> DataFrame:
    """Bins widened for rows outside all of them, in the order of site, then row; then new greedy bins if asked.

    Without bins (None) the new ones are greedy from the start. Else each stretch of times and bins that lies farther
    from all others than a bin can be widened is a group of its own, so no source meets in one task.
    """
    if bins is None:
        return greedy(toas, width, pad) if add_new else numbered(toas.sparkSession.createDataFrame([], "psr string, low double, high double"))
    toas, bins = settled(toas.select("psr", "obs", "toa_id", "mjd")), settled(bins)
    covered = members(toas.select("psr", "mjd").distinct(), bins).select("psr", "mjd").distinct()
    free = settled(toas.join(settled(covered), ["psr", "mjd"], "left_anti"))

    def run(times: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        psr = (times if len(times) else old)["psr"].iloc[0]
        order = times.sort_values(["obs", "toa_id"])["mjd"].to_numpy()
        if len(old):
            b, left = kernels.expand_bins(old[["low", "high"]].to_numpy(float), order, width, pad)
        else:
            b, left = np.zeros((0, 2)), order
        if add_new and len(left):
            b = np.concatenate([b, kernels.greedy_bins(np.sort(left), width, pad)])
        return pd.DataFrame({"psr": psr, "low": b[:, 0], "high": b[:, 1]})

    free, old = _parted(free, bins, width + 2 * pad + 4 * kernels.EDGE)
    old = old.select(*[F.col(c).alias(c) for c in ("psr", "part", "low", "high")])
    return numbered(free.groupBy("psr", "part").cogroup(old.groupBy("psr", "part")).applyInPandas(run, "psr string, low double, high double"))


def rebin(times: DataFrame, bins: DataFrame, bad: DataFrame, width: float, pad: float) -> DataFrame:
    """Bins without the ``bad`` ones (psr, ord), whose times get greedy bins of their own."""
    loose = members(times, bins.join(bad, ["psr", "ord"], "left_semi"))
    kept = bins.join(bad, ["psr", "ord"], "left_anti").select("psr", "low", "high")
    return numbered(kept.union(greedy(loose, width, pad).select("psr", "low", "high")))


def solar_bins(toas: DataFrame, bins: DataFrame, most_us: float = 0.1, n0: float = 5.0) -> DataFrame:
    """Bins in which the solar wind's delay at the lowest frequency spans more than ``most_us``."""
    found = members(toas, bins).withColumn("wind", scalar.solar_wind_dm(F.col("sun_angle_rad"), n0))
    g = found.groupBy("psr", "ord").agg(F.min("freq_mhz").alias("low_freq"), F.min("wind").alias("least"), F.max("wind").alias("most"))
    scale = F.lit(2.41e-4) * F.col("low_freq") * F.col("low_freq")
    return g.filter(F.col("most") / scale * 1e6 - F.col("least") / scale * 1e6 > most_us).select("psr", "ord")


def event_bins(bins: DataFrame, events: DataFrame) -> DataFrame:
    """Bins with an edge strictly inside an event window (psr, from_mjd, to_mjd)."""
    edge = lambda c: (F.col("from_mjd") < F.col(c)) & (F.col(c) < F.col("to_mjd"))
    return bins.join(events, "psr").filter(edge("low") | edge("high")).select("psr", "ord").distinct()


def rebin_events(toas: DataFrame, bins: DataFrame, events: DataFrame, pad: float = 0.0) -> DataFrame:
    """Bins with those at event windows (psr, from_mjd, to_mjd, width) made anew, of each window's own width.

    A bin that meets several windows takes the least width. All widths are one pass.
    """
    hit = lambda c: (F.col("from_mjd") < F.col(c)) & (F.col(c) < F.col("to_mjd"))
    bad = settled(bins.join(events, "psr").filter(hit("low") | hit("high")).groupBy("psr", "ord").agg(F.min("width").alias("width")))
    loose = members(toas.select("psr", "mjd"), bins.join(bad, ["psr", "ord"]))
    kept = bins.join(bad, ["psr", "ord"], "left_anti").select("psr", "low", "high")
    return numbered(kept.union(greedy_by(loose, {"psr": "string", "width": "double"}, None, pad).select("psr", "low", "high")))


def windows_of(configs: DataFrame) -> DataFrame:
    """(psr, from_mjd, to_mjd, width): the windows that configurations give bins of their own width (``custom_dmx``)."""
    w = configs.select("psr", F.explode("custom_dmx").alias("w")).filter("size(w) >= 3")
    return w.select("psr", *[F.col("w")[k].cast("double").alias(n) for k, n in enumerate(("from_mjd", "to_mjd", "width"))])


def _trimmed(times: DataFrame, bins: DataFrame) -> DataFrame:
    """Bins whose edges reach over the next bin's, cut back to the middle between the last and the first time of the two.

    Only where no time is between: neighbours by their first times. A source has as many bins as its span has room for.
    """
    ends = members(times, bins).groupBy("psr", "ord").agg(F.min("mjd").alias("first"), F.max("mjd").alias("last"))
    w = Window.partitionBy("psr").orderBy("first", "last", "ord")
    next_low, next_first, last_high, last_last = F.lead("low").over(w), F.lead("first").over(w), F.lag("high").over(w), F.lag("last").over(w)
    middle = lambda a, b: (a + b) / F.lit(2.0)
    between = lambda a, m, b: (a < m) & (m < b)
    up, down = middle(F.col("last"), next_first), middle(last_last, F.col("first"))
    high = F.when((F.col("high") > next_low) & between(F.col("last"), up, next_first), F.least(F.col("high"), up)).otherwise(F.col("high"))
    low = F.when((last_high > F.col("low")) & between(last_last, down, F.col("first")), F.greatest(F.col("low"), down)).otherwise(F.col("low"))
    return bins.join(ends, ["psr", "ord"]).select("psr", low.alias("low"), high.alias("high"))


def _tangled(times: DataFrame, bins: DataFrame) -> DataFrame:
    """(psr, ord, part, lo, hi) of the bins in stretches of overlapping bins of which some share a time."""
    w = Window.partitionBy("psr").orderBy("low", "high", "ord")
    reach = F.max("high").over(w.rowsBetween(*scan.BEFORE_ALL))
    chained = bins.withColumn("part", F.when(F.col("low") < reach, 0).otherwise(1)).withColumn("part", F.sum("part").over(w))
    shared = holding(times, bins).filter("size(held) > 1").select("psr", F.explode("held").alias("ord")).distinct()
    whole = Window.partitionBy("psr", "part")
    return chained.join(chained.join(shared, ["psr", "ord"], "left_semi").select("psr", "part").distinct(), ["psr", "part"], "left_semi").select("psr", "ord", "part", F.min("low").over(whole).alias("lo"), F.max("high").over(whole).alias("hi"))


def repair(times: DataFrame, bins: DataFrame, widths: DataFrame, pad: float = 0.05, cover: bool = False, rounds: int = 8) -> DataFrame:
    """Bins in which ``check`` finds nothing wrong, made from ``bins`` by rebuilding only what it finds.

    Improper and empty bins go. Where overlapping bins share times, their stretch gets greedy bins of the source's width
    (``widths``: psr, width), inside the stretch; where they don't, the edges move to the middle between the bins' times.
    With ``cover`` times in no bin get bins too. What a round has changed is checked again, until nothing is found. Only
    distinct times (psr, mjd) are looked at.
    """
    return _repaired(settled(times.select("psr", "mjd").distinct()), bins, widths, pad, cover, rounds)


def _repaired(times: DataFrame, bins: DataFrame, widths: DataFrame, pad: float, cover: bool = False, rounds: int = 8) -> DataFrame:
    nameless = times.withColumn("toa_id", F.lit(None).cast("long"))
    for _ in range(rounds):
        wrong = settled(check(nameless, bins).filter(F.lit(cover) | (F.col("kind") != "in no bin")))
        if wrong.isEmpty():
            return bins
        gone = wrong.filter("kind in ('improper', 'empty')").select("psr", F.col("id").alias("ord"))
        sound = settled(bins.join(gone, ["psr", "ord"], "left_anti"))
        tangled = settled(_tangled(times, sound))
        inside = members(times, sound.join(tangled, ["psr", "ord"])).select("psr", "part", "lo", "hi", "mjd").join(widths, "psr")
        keys = {"psr": "string", "part": "long", "lo": "double", "hi": "double", "width": "double"}
        rebuilt = greedy_by(inside, keys, None, pad).select("psr", F.greatest("low", "lo").alias("low"), F.least("high", "hi").alias("high"))
        parts = [sound.join(tangled, ["psr", "ord"], "left_anti").select("psr", "low", "high"), rebuilt]
        if cover:
            loose = holding(times, bins).filter("size(held) = 0").drop("held").join(widths, "psr")
            parts.append(greedy_by(loose, {"psr": "string", "width": "double"}, None, pad).select("psr", "low", "high"))
        made = numbered(reduce(DataFrame.union, parts))
        bins = settled(numbered(_trimmed(times, settled(made))))
    raise RuntimeError(f"bins are not sound after {rounds} rounds")


def _nearest(points: DataFrame, marks: DataFrame) -> DataFrame:
    """Each point (psr, mjd) with the struct ``near`` (d, tie, mark) of the mark (psr, at, tie, mark) closest in time; the least tie first.

    Marks and points meet in time order, stretch by stretch: the closest mark is the last before a point or the first behind it.
    """
    first = marks.groupBy("psr", "at").agg(F.min(F.struct("tie", "mark")).alias("m")).select("psr", F.col("at").alias("mjd"), F.struct("at", "m.*").alias("mark"))
    both = scan.beside(points, first)
    far = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.at") - F.col("mjd")).alias("d"), F.col(f"{c}.tie").alias("tie"), F.col(f"{c}.mark").alias("mark")))
    return both.select("psr", "mjd", F.least(far("before"), far("behind")).alias("near")).filter("near is not null")


def nearest_bins(points: DataFrame, bins: DataFrame) -> DataFrame:
    """For each point (psr, mjd) the bin with the closest middle, the first on ties, and whether it holds the point."""
    marks = bins.select("psr", ((F.col("low") + F.col("high")) / 2).alias("at"), F.col("ord").alias("tie"), F.struct("low", "high").alias("mark"))
    b = _nearest(points, marks).select("psr", "mjd", F.col("near.tie").alias("ord"), "near.mark.*")
    return b.select("psr", "mjd", "ord", ((F.col("low") < F.col("mjd")) & (F.col("mjd") < F.col("high"))).alias("inside"))


def mutual_pairs(low: DataFrame, high: DataFrame, width: float = 15.0) -> DataFrame:
    """Session means of two receivers, each the other's nearest and less than ``width`` apart; the earlier one on ties."""
    marks = lambda df: df.select("psr", F.col("mean_mjd").alias("at"), F.col("mean_mjd").alias("tie"), F.lit(0).alias("mark"))
    points = lambda df: df.select("psr", F.col("mean_mjd").alias("mjd")).distinct()
    of_a = _nearest(points(low), marks(high)).filter(F.col("near.d") < width).select("psr", F.col("mjd").alias("a"), F.col("near.tie").alias("b"))
    of_b = _nearest(points(high), marks(low)).filter(F.col("near.d") < width).select("psr", F.col("near.tie").alias("a"), F.col("mjd").alias("b"))
    return of_a.join(of_b, ["psr", "a", "b"])


def paired_bins(pairs: DataFrame, group: float = 0.1, pad: float = 0.05) -> DataFrame:
    """A bin around each pair of sessions."""
    low = F.least(F.col("a") - group, F.col("b") - group) - pad - kernels.EDGE
    high = F.greatest(F.col("a") + group, F.col("b") + group) + pad + kernels.EDGE
    return numbered(pairs.select("psr", low.alias("low"), high.alias("high")))


def early_bins(toas: DataFrame, old_be: str, new_be: str, low_f: str, high_f: str, width: float = 15.0, pad: float = 0.05) -> DataFrame:
    """Bins of the older backend's era: sessions of its two receivers paired, then widened for rows they miss."""
    from pulsewright.operators.stats import group_dates

    toas = settled(toas.select("psr", "obs", "toa_id", "mjd", "be", "f"))
    end = toas.filter(F.col("be") == new_be).groupBy("psr").agg(F.min("mjd").alias("end"))
    era = settled(toas.filter(F.col("be") == old_be).join(end, "psr").filter("mjd < end").drop("end"))
    low, high = (group_dates(era.filter(F.col("f") == f), ["psr"], 0.1, 12) for f in (low_f, high_f))
    made = settled(paired_bins(mutual_pairs(settled(low), settled(high), width), 0.1, pad))
    return expand(era, made, width, pad)


def same_bins(new: DataFrame, old: DataFrame) -> DataFrame:
    """(psr, same): do both lists have as many bins, with edges that agree closely, in order?"""
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.lit(1e-5) + F.lit(1e-10) * F.abs(F.col(b))
    o = old.select("psr", "ord", F.col("low").alias("old_low"), F.col("high").alias("old_high"))
    both = new.join(o, ["psr", "ord"], "full")
    return both.groupBy("psr").agg(F.bool_and(F.coalesce(close("low", "old_low") & close("high", "old_high"), F.lit(False))).alias("same"))


def setup(
    toas: DataFrame, old_bins: DataFrame | None = None, events: DataFrame | None = None, single_site: str = "ao", ratio: float = 1.1, most_us: float = 0.1,
    early: tuple[str, str, str, str] | None = None, mend: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(toas with dmx cuts, bins that pass): the whole setup, from uncut rows to bins that ``check`` finds sound.

    Early-era bins are widened and completed by greedy ones, half a day wide where all rows of a source are of
    ``single_site``, else 6.5 days. Windows (psr, from_mjd, to_mjd, width) then get bins of their own width, half a day if
    they name none, and bins with too much solar wind are split. What ``check`` finds wrong is repaired (``mend``), so that
    every row that isn't cut lies in one bin. A source whose ``old_bins`` (psr, ord, low, high) are as many and agree
    closely keeps them with their numbers; all other sources' bins are numbered from 1.
    """
    toas = settled(toas)
    live = toas.filter("cut is null")
    first = settled(early_bins(live, *early)) if early else None
    one_site = live.groupBy("psr").agg(F.bool_and(F.col("obs") == single_site).alias("one_site"))
    widths = settled(one_site.select("psr", F.when(F.col("one_site"), 0.5).otherwise(6.5).alias("width")))
    times = settled(live.select("psr", "mjd").distinct())
    if first is None:
        bins = numbered(greedy_by(times.join(widths, "psr"), {"psr": "string", "width": "double"}, None, 0.05))
    else:
        of = lambda df, width: df.join(widths.filter(F.col("width") == width).select("psr"), "psr", "left_semi")
        parts = [expand(of(live, width), of(first, width), width, 0.05, add_new=True) for width in (0.5, 6.5)]
        bins = parts[0].unionByName(parts[1])
    bins = settled(bins)
    if events is not None:
        with_width = events if "width" in events.columns else events.withColumn("width", F.lit(0.5))
        bins = settled(rebin_events(times, bins, with_width.select("psr", "from_mjd", "to_mjd", F.coalesce("width", F.lit(0.5)).cast("double").alias("width"))))
    bins = settled(rebin(times, bins, settled(solar_bins(live, bins, most_us)), 0.5, 0.05))
    if mend:
        bins = _repaired(times, bins, widths, 0.05)
    pass_ = _passing(live, bins, ratio)
    good = settled(numbered(pass_))
    if old_bins is not None:
        good = settled(kept_or_new(good, old_bins))
    return _without_bin(toas, pass_), good


def kept_or_new(new: DataFrame, old: DataFrame) -> DataFrame:
    """The old bins of the sources whose new ones agree with them in order, else the new ones."""
    rank = lambda df: df.withColumn("ord", F.row_number().over(Window.partitionBy("psr").orderBy("low", "high")).cast("long"))
    same = same_bins(rank(new), rank(old)).filter("same").select("psr")
    return old.select("psr", "ord", "low", "high").join(same, "psr", "left_semi").unionByName(new.join(same, "psr", "left_anti"))


def after_drop(found: DataFrame) -> DataFrame:
    """(psr, ord, name, left): the rows that a bin has left without a file; zero means the bin goes with it."""
    per_file = found.groupBy("psr", "ord", "name").agg(F.count(F.lit(1)).alias("n"))
    return per_file.select("psr", "ord", "name", (F.sum("n").over(Window.partitionBy("psr", "ord")) - F.col("n")).alias("left"))
