"""Sampler chains to noise parameters. A chain stays one array column; only what passes a filter is exploded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsewright.functions.scalar import red_noise_amplitude
from pulsewright.operators import scan
from pulsewright.operators.settle import settled


def after_burn(chains: DataFrame, burn: float = 0.25, parts: int = 1024) -> DataFrame:
    """Samples from the burn-in share on, by sample number; equal numbers stay or go together, rows without one go.

    Only the number at which each chain starts is looked for, among the numbers alone: ``parts`` stretches of a chain are
    counted, and the one that the share ends in is ranked. No chain is sorted and no sample's values are moved.
    """
    ends = chains.groupBy("chain").agg(F.min("sample").alias("lo"), F.max("sample").alias("hi"), F.count("sample").alias("n"))
    part = F.floor((F.col("sample") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1) * parts)
    at = chains.select("chain", "sample").join(ends, "chain").select("chain", "sample", part.alias("part"), F.floor(F.col("n") * burn).alias("k")).filter("sample is not null")
    counts = at.groupBy("chain", "part", "k").agg(F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("chain").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ending = counts.withColumn("before", before).filter("before <= k and k < before + m").select("chain", "part", (F.col("k") - F.col("before")).alias("skip"))
    rank = F.row_number().over(Window.partitionBy("chain").orderBy("sample")) - 1
    start = at.select("chain", "sample", "part").join(ending, ["chain", "part"]).withColumn("rank", rank).filter("rank = skip").select("chain", F.col("sample").alias("start"))
    return chains.join(start, "chain").filter(F.col("sample") >= F.col("start")).select(*chains.columns)


def top_mean(chains: DataFrame, n: int = 50, burn: float = 0.25, digits: int = 9, blocks: int = 16) -> DataFrame:
    """(chain, pos, mean) of every parameter over the ``n`` samples of the highest likelihood, the last place of vals.

    The best of each block of samples are found first, so a chain of any length never meets in one task.
    """
    order = [F.desc(F.element_at("vals", -1)), F.desc("sample")]
    live = after_burn(chains, burn).withColumn("block", F.pmod(F.xxhash64("sample"), F.lit(blocks)))
    local = live.withColumn("r", F.row_number().over(Window.partitionBy("chain", "block").orderBy(*order))).filter(F.col("r") <= n)
    best = local.withColumn("r", F.row_number().over(Window.partitionBy("chain").orderBy(*order))).filter(F.col("r") <= n)
    return best.select("chain", F.posexplode("vals").alias("pos", "x")).groupBy("chain", "pos").agg(F.round(F.avg("x"), digits).alias("mean"))


def map_row(chains: DataFrame) -> DataFrame:
    """(chain, sample) of the sample with the highest posterior, the first place of vals; the later one on ties."""
    best = F.max(F.struct(F.element_at("vals", 1).alias("p"), "sample"))
    return chains.groupBy("chain").agg(best.alias("b")).select("chain", "b.sample", F.col("b.p").alias("lnpost"))


def medians(chains: DataFrame, digits: int = 9) -> DataFrame:
    """(chain, pos, median) of every parameter, exact, whatever the chain's length."""
    x = chains.select("chain", F.posexplode("vals").alias("pos", "x"))
    return scan.quantiles(x, ["chain", "pos"], "x", [0.5]).select("chain", "pos", F.round(F.col("q")[0], digits).alias("median"))


def histograms(chains: DataFrame, bins: int = 20) -> DataFrame:
    """(chain, pos, bin, n): equal bins between each parameter's extremes, the last one closed."""
    x = chains.select("chain", F.posexplode("vals").alias("pos", "x"))
    ends = x.groupBy("chain", "pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    k = F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / F.lit(float(bins)))), F.lit(bins - 1))
    return x.join(ends, ["chain", "pos"]).select("chain", "pos", F.when(F.col("hi") > F.col("lo"), k).otherwise(0).cast("int").alias("bin")).groupBy("chain", "pos", "bin").agg(F.count(F.lit(1)).alias("n"))


def pair_histograms(chains: DataFrame, pairs: list[tuple[int, int]] | None = None, bins: int = 80, want: Column | None = None) -> DataFrame:
    """(chain, i, j, bi, bj, n) of pairs of parameters, taken from the arrays by place; no self-join.

    Without ``pairs`` every parameter is paired with the next one; ``want`` is a column of pairs (i, j) for each row.
    """
    if want is not None:
        pass
    elif pairs is None:
        want = F.transform(F.sequence(F.lit(0), F.size("vals") - 2), lambda i: F.struct(i.alias("i"), (i + 1).alias("j")))
    else:
        want = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs])
    x = chains.select("chain", "vals", F.explode(want).alias("p")).select("chain", "p.i", "p.j", F.element_at("vals", F.col("p.i") + 1).alias("x"), F.element_at("vals", F.col("p.j") + 1).alias("y"))
    ends = x.groupBy("chain", "i", "j").agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for f, n in ((F.min, "lo"), (F.max, "hi"))])
    k = lambda c: F.least(F.floor((F.col(c) - F.col(f"lo_{c}")) / F.nullif((F.col(f"hi_{c}") - F.col(f"lo_{c}")) / F.lit(float(bins)), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    return x.join(ends, ["chain", "i", "j"]).groupBy("chain", "i", "j", k("x").alias("bi"), k("y").alias("bj")).agg(F.count(F.lit(1)).alias("n"))


#: Endings of noise parameters, and what each means.
NOISE_KINDS = {"efac": "EFAC", "log10_t2equad": "EQUAD", "log10_tnequad": "EQUAD", "log10_equad": "EQUAD", "log10_ecorr": "ECORR", "dmefac": "DMEFAC", "log10_dmequad": "DMEQUAD"}


def parse_names(params: DataFrame, mode: str = "nb") -> DataFrame:
    """(psr, name) to kind, mask value and convention, numbered by kind; ECORR only narrowband, DM kinds only wideband."""
    pattern = r"^([^_]+)_(.+)_(" + "|".join(sorted(NOISE_KINDS, key=len, reverse=True)) + ")$"
    kinds = F.create_map(*[F.lit(x) for kv in NOISE_KINDS.items() for x in kv])
    out = params.filter(F.col("name").rlike(pattern)).select("psr", "name", "ord", F.regexp_extract("name", pattern, 2).alias("mask_value"), F.regexp_extract("name", pattern, 3).alias("ending"))
    out = out.withColumn("kind", kinds[F.col("ending")])
    out = out.filter(~F.col("kind").startswith("DM")) if mode == "nb" else out.filter(F.col("kind") != "ECORR")
    return out.withColumn("number", F.row_number().over(Window.partitionBy("psr", "kind").orderBy("ord")).cast("long"))


#: Rows of a model for the power laws of signals (amplitude, slope, and number of harmonics, none for red noise).
SIGNALS = {"red_noise": ("RNAMP", "RNIDX", None), "dm_gp": ("TNDMAMP", "TNDMGAM", ("TNDMC", 100.0)), "chrom_gp": ("TNCMAMP", "TNCMGAM", ("TNCMC", 100.0)), "sw_gp": ("TNSWAMP", "TNSWGAM", ("TNSWC", 10.0))}


def signal_rows(best: DataFrame, keep_red: DataFrame | None = None) -> DataFrame:
    """(psr, kind, value) of correlated noise in named values (psr, name, value): amplitudes, slopes, harmonics and the solar wind's density.

    Only power laws, recognised by their amplitude. ``keep_red`` (psr, keep) says where red noise is kept; everywhere without it.
    """
    name = F.col("name")
    pick = lambda ending: F.max(F.when(name == F.concat("psr", F.lit(f"_{ending}")), F.col("value")))
    g = best.groupBy("psr").agg(pick("n_earth").alias("n_earth"), *[pick(f"{s}_{e}").alias(f"{s}_{e}") for s in SIGNALS for e in ("log10_A", "gamma")])
    if keep_red is not None:
        kept = g.join(keep_red.select("psr", "keep"), "psr", "left")
        g = kept.withColumn("red_noise_log10_A", F.when(F.coalesce("keep", F.lit(True)), F.col("red_noise_log10_A"))).drop("keep")
    row = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    made = [F.when(F.col("n_earth").isNotNull(), row("NE_SW", F.col("n_earth")))]
    for s, (amp, slope, harmonics) in SIGNALS.items():
        there = F.col(f"{s}_log10_A").isNotNull()
        made += [F.when(there, row(amp, red_noise_amplitude(F.col(f"{s}_log10_A")))), F.when(there, row(slope, -F.col(f"{s}_gamma")))]
        if harmonics:
            made.append(F.when(there, row(harmonics[0], F.lit(harmonics[1]))))
    return g.select("psr", F.inline(F.filter(F.array(*made), lambda r: r.isNotNull())))


#: Families of parameters that are looked at in pairs, and pairs of families across.
FAMILIES = ["dm_gp", "chrom_gp", "red_noise", "ecorr", "chrom_s1yr", "dm_s1yr", "exp"]
ACROSS = [("ecorr", "dm_gp"), ("dm_gp", "chrom_gp")]


def family_pairs(names: DataFrame) -> DataFrame:
    """(chain, i, j) of places (chain, pos, name) to look at together: within each family, and across some; never the chromatic index."""
    x = names.filter(~F.col("name").contains("chrom_gp_idx")).select("chain", "pos", F.explode(F.filter(F.array(*[F.when(F.col("name").contains(f), F.lit(f)) for f in FAMILIES]), lambda f: f.isNotNull())).alias("family"))
    a, b = x.select("chain", F.col("pos").alias("i"), F.col("family").alias("fi")), x.select("chain", F.col("pos").alias("j"), F.col("family").alias("fj"))
    same = a.join(b, (a.chain == b.chain) & (a.fi == b.fj) & (F.col("i") < F.col("j"))).select(a.chain, "i", "j")
    over = x.sparkSession.createDataFrame(ACROSS, "fi string, fj string")
    cross = a.join(over, "fi").join(b, ["chain", "fj"]).filter("i <> j").select("chain", "i", "j")
    return same.union(cross).distinct()


def joint_histograms(chains: DataFrame, pairs: DataFrame, bins: int = 80) -> DataFrame:
    """(chain, i, j, bi, bj, n) of pairs (chain, i, j) of places, as ``pair_histograms`` makes them."""
    of = pairs.groupBy("chain").agg(F.collect_set(F.struct("i", "j")).alias("want"))
    return pair_histograms(chains.join(of, "chain"), bins=bins, want=F.col("want"))


def run_histograms(now: DataFrame, past: DataFrame, names_now: DataFrame, names_past: DataFrame, bins: int = 20) -> DataFrame:
    """(chain, run, pos, bin, n) of two runs, where both have the same list of parameters (chain, names)."""
    same = names_now.join(names_past.select("chain", F.col("names").alias("old")), "chain").filter("names = old").select("chain")
    one = lambda df, run: histograms(df.join(same, "chain", "left_semi"), bins).withColumn("run", F.lit(run))
    return one(now, "now").unionByName(one(past, "past"))


def equad_convention(params: DataFrame) -> DataFrame:
    has = lambda s: F.bool_or(F.col("name").contains(s))
    g = params.groupBy("psr").agg(has("_t2equad").alias("t2"), has("_tnequad").alias("tn"))
    return g.select("psr", F.when(F.col("t2") & ~F.col("tn"), "t2").when(F.col("tn") & ~F.col("t2"), "tn").when(F.col("t2") & F.col("tn"), "mixed").otherwise("none").alias("convention"))


def red_noise_evidence(chains: DataFrame, pos: int, low: float, high: float, edges: list[float], least: float = 100.0) -> DataFrame:
    """Density ratio of prior to posterior at the low edge for several widths; kept where it is large or can't be told."""
    x = chains.select("chain", F.element_at("vals", pos + 1).alias("x"))
    n = F.count(F.lit(1))
    ratios = [F.when(F.count_if(F.col("x") < low + e) > 0, (F.lit(1.0) / (high - low)) / (F.count_if(F.col("x") < low + e) / n / e)) for e in edges]
    g = x.groupBy("chain").agg(F.array(*ratios).alias("r"))
    bf = F.aggregate(F.col("r"), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))) / F.nullif(F.size(F.filter("r", lambda v: v.isNotNull())), F.lit(0))
    return g.select("chain", F.round(bf, 9).alias("bf"), (bf.isNull() | (bf >= least)).alias("keep"))


def sampling_groups(params: DataFrame) -> DataFrame:
    """(psr, grp, idx): places of parameters that are sampled together: by backend, by red signal, across chromatic signals, and all.

    Signals that depend on frequency go together where a source has them: dispersion and solar wind, chromatic noise and
    solar wind, all three, and dispersion with chromatic noise.
    """
    name, whole = F.col("name"), Window.partitionBy("psr")
    is_dm, is_gp, is_chrom, is_sw = name.contains("dm_gp"), name.contains("chrom_gp"), name.contains("chrom"), name.rlike("n_earth|log10_sigma_ne")
    params = params.withColumn("has_sw", F.bool_or(name.isin("n_earth", "log10_sigma_ne") | name.rlike("_(n_earth|log10_sigma_ne)$")).over(whole)).withColumn("has_chrom", F.bool_or(is_chrom).over(whole))
    sw, chrom = F.col("has_sw"), F.col("has_chrom")
    label = F.array(
        F.lit("all"), F.when(name.rlike("red_noise"), "red"), F.when(is_dm, "dm"), F.regexp_extract(name, r"^[^_]+_(.+)_(?:efac|log10_\w*equad|log10_ecorr)$", 1),
        F.when(sw & (is_dm | is_sw), "dm, wind"), F.when(sw & chrom & (is_gp | is_sw), "chrom, wind"), F.when(sw & chrom & (is_dm | is_chrom | is_sw), "dm, chrom, wind"), F.when(chrom & (is_dm | is_chrom), "dm, chrom"),
    )
    x = params.select("psr", "ord", F.explode(F.filter(label, lambda v: v.isNotNull() & (v != ""))).alias("grp"))
    return x.groupBy("psr", "grp").agg(F.sort_array(F.collect_list("ord")).alias("idx"))


def seeded_draw(seed: int, *keys: str) -> Column:
    """A number in [0, 1) that depends on the seed and the row's keys alone, so that a task done again draws it again."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), *keys)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


#: Rows that a task makes by repeating rows, and repeats of one row that are made at once.
REPEATED, SLICE = 1 << 20, 1 << 12


def start_values(now: DataFrame, best: DataFrame, lo: Column, hi: Column, seed: int = 0) -> DataFrame:
    """For each parameter the earlier run's best value, else a seeded draw from its prior between ``lo`` and ``hi``.

    Rows with the same source and name meet each other, as in any join: so many equal rows are made, where names repeat,
    that they are counted before the join and dealt out to tasks by how many they become.
    """
    n = F.count(F.lit(1))
    held = best.groupBy("psr", "name", F.col("value").alias("best")).agg(n.alias("m"))
    asked = now.withColumn("draw", lo + seeded_draw(seed, "psr", "name") * (hi - lo)).groupBy("psr", "name", "draw").agg(n.alias("n"))
    met = asked.join(held, ["psr", "name"], "left").withColumn("rows", F.col("n") * F.coalesce("m", F.lit(1)))
    met = settled(met.select("psr", "name", F.coalesce("best", "draw").alias("start"), F.col("best").isNotNull().alias("from_chain"), "rows"))
    total = met.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()["rows"]
    slices = met.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(SLICE).cast("long"))))
    dealt = slices.repartition(1 + total // REPEATED)
    return dealt.select("psr", "name", "start", "from_chain", F.explode(F.sequence(F.lit(1), F.least(F.lit(SLICE), F.col("rows") - F.col("first")).cast("int"))).alias("again")).drop("again")
