"""Nested-model tests: batched weighted linear fits by triangular factors, F-tests, and what to add or remove.

A fit never sees rows: each file's weighted design is reduced to its triangular factor, and factors are merged by factoring
them side by side, in partitions first. Products of columns are never formed, so a fit keeps the digits that sums of
products would lose. Leaving a file out merges what is before it and what is behind it; nothing is subtracted.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from pulsewright.functions import kernels
from pulsewright.operators.settle import settled


@pandas_udf(DoubleType())
def f_tail(f: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series(kernels.f_sf(f.to_numpy(float), n1.to_numpy(float), n2.to_numpy(float)))


@pandas_udf(DoubleType())
def chi2_tail(chi2: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(kernels.chi2_sf(chi2.to_numpy(float), dof.to_numpy(float)))


def f_test(chi2_1: Column, dof_1: Column, chi2_2: Column, dof_2: Column) -> Column:
    """p-value that the larger model's gain is chance; null if it isn't better or has no fewer degrees of freedom.

    A larger model that leaves nothing (no chi-squared) has a gain that isn't chance: 0.
    """
    left = chi2_2 / F.nullif(dof_2, F.lit(0))
    f = F.coalesce(((chi2_1 - chi2_2) / F.nullif(dof_1 - dof_2, F.lit(0))) / F.nullif(left, F.lit(0.0)), F.lit(float("inf")))
    better = (chi2_1 > chi2_2) & (dof_1 > dof_2) & (dof_2 > 0)
    return F.when(better, f_tail(F.when(better, f).otherwise(1.0), F.when(better, dof_1 - dof_2).otherwise(1.0), F.when(better, dof_2).otherwise(1.0)))


def reduced_chi2(df: DataFrame) -> DataFrame:
    """Reduced chi-squared and its tail probability, with the usual warnings."""
    r, p = F.col("chi2") / F.col("dof"), F.col("p")
    out = df.withColumn("p", chi2_tail(F.col("chi2"), F.col("dof"))).withColumn("rchi2", r)
    return out.withColumn("warning", (F.col("rchi2") < 0.95) | (F.col("rchi2") > 1.05) | (p < 0.001) | (p > 0.999))


def report_lines(tests: DataFrame, alpha: float = 0.0027) -> DataFrame:
    """One line for each test: *** significant, -- not, xxx not better, and NaN for a fit that failed (no chi-squared)."""
    mark = F.when(F.col("chi2").isNull(), "NaN").when(F.col("ft").isNull(), "xxx").when(F.col("ft") < alpha, "***").otherwise("--")
    chi2, dof = F.coalesce("chi2", F.lit(float("nan"))), F.coalesce("dof", F.lit(0)).cast("int")
    return tests.select("psr", "label", F.format_string("%-12s %12.4f %5d %s", F.col("label"), chi2, dof, mark).alias("line"), mark.alias("mark"))


def recommend(tests: DataFrame, alpha: float = 0.0027) -> DataFrame:
    """(psr, action, label): remove what isn't significant, but never the parallax; add what is, but never spin derivatives; of FD terms only that with the least value either way."""
    p = F.col("ft")
    remove = (F.col("action") == "remove") & (p > alpha) & (F.col("label") != "PX")
    add = (F.col("action") == "add") & (p <= alpha) & (p > 0) & ~F.col("label").rlike(r"^F\d+$")
    said = tests.filter(remove | add)
    fd = said.filter("family = 'FD'").groupBy("psr", "action").agg(F.min_by("label", F.struct("ft", "ord")).alias("label"))
    return said.filter("family <> 'FD'").select("psr", "action", "label").union(fd)


#: Terms tested for each family of binary models; terms with a plus are tested together only.
_ORBIT = ["PBDOT", "A1DOT", "OMDOT", "EDOT", "M2+SINI"]
CANDIDATES = {
    "DD": _ORBIT, "BT": _ORBIT, "DDK": _ORBIT,
    "ELL1": ["PBDOT", "A1DOT", "M2+SINI", "EPS1DOT+EPS2DOT"],
    "ELL1 by FB0": ["A1DOT", "EPS1DOT+EPS2DOT"],
    "ELL1H": ["PBDOT", "A1DOT", "H4", "EPS1DOT+EPS2DOT", "H3+H4"],
}


def candidates(models: DataFrame, params: DataFrame, fd: int = 5) -> DataFrame:
    """(psr, action, label) of the tests for each source: fitted parameters are removed, others added; FD terms cumulatively.

    Of terms that are tested together all have to be fitted, or none. An ELL1 model with FB0 and without PB has the
    shorter list; sources of other models are tested for FD terms only.
    """
    spark = models.sparkSession
    rule = spark.createDataFrame([(m, c) for m, cs in CANDIDATES.items() for c in cs], "family string, label string")
    period = params.filter(F.col("name").isin("PB", "FB0")).groupBy("psr").agg(F.bool_or(F.col("name") == "PB").alias("pb"), F.bool_or(F.col("name") == "FB0").alias("fb"))
    by_fb = (F.col("model") == "ELL1") & F.coalesce(F.col("fb") & ~F.col("pb"), F.lit(False))
    family = models.join(period, "psr", "left").select("psr", F.when(by_fb, "ELL1 by FB0").otherwise(F.col("model")).alias("family"))
    t = family.join(rule, "family").select("psr", "label", F.explode(F.split("label", r"\+")).alias("name"))
    fitted = params.select("psr", "name", (~F.col("frozen")).alias("fitted"))
    is_fitted = F.coalesce("fitted", F.lit(False))
    state = t.join(fitted, ["psr", "name"], "left").groupBy("psr", "label").agg(F.bool_and(is_fitted).alias("all"), F.bool_or(is_fitted).alias("any"))
    binary = state.filter(F.col("all") | ~F.col("any")).select("psr", F.when(F.col("all"), "remove").otherwise("add").alias("action"), "label")
    have = params.filter(F.col("name").rlike(r"^FD\d+$")).groupBy("psr").agg(F.max(F.regexp_extract("name", r"(\d+)", 1).cast("int")).alias("n"))
    counts = models.select("psr").distinct().join(have, "psr", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    terms = lambda a, b: F.expr(f"if({a} > {b}, array(), sequence({a}, {b}))")
    label = F.concat(F.lit("FD"), F.col("k").cast("string"))
    up = counts.select("psr", F.explode(terms("n + 1", f"{fd}")).alias("k")).select("psr", F.lit("add").alias("action"), label.alias("label"))
    down = counts.select("psr", F.explode(terms("1", "n")).alias("k")).select("psr", F.lit("remove").alias("action"), label.alias("label"))
    return binary.union(up).union(down)


def other_candidates(models: DataFrame, params: DataFrame, fb: int = 5) -> DataFrame:
    """(psr, action, label) of tests beside those of a binary model's own parameters (``candidates``).

    F2 is always tried, PX tried without unless the model is DDK; an ELL1 model with FB terms is fitted without all but
    the first i of them (FBi+), and with more up to FBi, ``fb`` at most.
    """
    m = models.select("psr", "model").distinct()
    fixed = m.select("psr", F.inline(F.array(F.struct(F.lit("add").alias("action"), F.lit("F2").alias("label")))))
    px = m.filter("model is null or model <> 'DDK'").select("psr", F.lit("remove").alias("action"), F.lit("PX").alias("label"))
    n = params.filter(F.col("name").rlike(r"^FB\d+$")).groupBy("psr").agg(F.count_distinct("name").cast("int").alias("n"))
    series = m.filter("model = 'ELL1'").join(n, "psr")
    steps = lambda lo, hi: F.explode(F.expr(f"if({lo} > {hi}, array(), sequence({lo}, {hi}))")).alias("k")
    down = series.select("psr", steps("1", "n - 1")).select("psr", F.lit("remove"), F.concat(F.lit("FB"), F.col("k").cast("string"), F.lit("+")))
    up = series.select("psr", steps("n", str(fb))).select("psr", F.lit("add"), F.concat(F.lit("FB"), F.col("k").cast("string")))
    return fixed.union(px).union(down).union(up)


#: Files of a block, within which they are left out one by one.
BLOCK = 256


def _runs(batches, keys: list[str]):
    """Frames of sorted batches in which no run of equal keys is cut, with the bounds of their runs."""
    kept: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        kept.append(pdf)
        rows = pd.concat(kept, ignore_index=True) if len(kept) > 1 else pdf
        new = np.flatnonzero((rows[keys].to_numpy()[1:] != rows[keys].to_numpy()[:-1]).any(axis=1)) + 1
        if len(new):
            kept = [rows.iloc[new[-1] :]]
            yield rows.iloc[: new[-1]], np.array([0, *new])
        else:
            kept = [rows]
    if kept:
        rows = pd.concat(kept, ignore_index=True)
        yield rows, np.array([0, len(rows)])


def _stack(column: pd.Series, q: int) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(-1, q, q)


def _schema(df: DataFrame, keys: list[str], more: str) -> str:
    return ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), more])


def factors(rows: DataFrame, keys: list[str], columns: list[str], y: str = "y", w: str = "w") -> DataFrame:
    """(keys, r, n): the triangular factor of the weighted columns and y of each key, by rows, and how many rows it has.

    Rows of one key meet in one task; take keys with few rows, such as files, and merge those of larger ones.
    """
    names = [*columns, y]
    q = len(names)

    def run(batches):
        for part, bounds in _runs(batches, keys):
            x = part[names].to_numpy(float) * np.sqrt(part[w].to_numpy(float))[:, None]
            r = kernels.triangles(x, np.diff(bounds))
            out = part.iloc[bounds[:-1]][keys].reset_index(drop=True)
            yield out.assign(r=list(r.reshape(len(r), q * q)), n=np.diff(bounds))

    ready = rows.select(*keys, w, *names).repartition(*keys).sortWithinPartitions(*keys)
    return ready.mapInPandas(run, _schema(rows, keys, "r array<double>, n long"))


def merge(parts: DataFrame, keys: list[str], q: int) -> DataFrame:
    """(keys, r, n) of all ``parts`` with the same key: merged within each partition first, so that a key meets once for each."""

    def run(batches):
        for part, bounds in _runs(batches, keys):
            r = kernels.triangles(_stack(part["r"], q).reshape(-1, q), np.diff(bounds) * q)
            n = np.add.reduceat(part["n"].to_numpy(), bounds[:-1])
            yield part.iloc[bounds[:-1]][keys].reset_index(drop=True).assign(r=list(r.reshape(len(r), q * q)), n=n)

    schema, cols = _schema(parts, keys, "r array<double>, n long"), [*keys, "r", "n"]
    within = parts.select(*cols).sortWithinPartitions(*keys).mapInPandas(run, schema)
    return within.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def fit(total: DataFrame, q: int, use: list[int] | None = None) -> DataFrame:
    """(psr, chi2, dof, beta, sigma) of each source's factor (psr, r, n); zero error for a column without content."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                chi2, dof, beta, sigma = kernels.solved(_stack(pdf["r"], q), pdf["n"].to_numpy(), use)
                yield pd.DataFrame({"psr": pdf["psr"], "chi2": chi2, "dof": dof, "beta": list(beta), "sigma": list(sigma)})

    return total.select("psr", "r", "n").mapInPandas(run, "psr string, chi2 double, dof long, beta array<double>, sigma array<double>")


def post_fit(rows: DataFrame, fits: DataFrame, columns: list[str], y: str = "y") -> DataFrame:
    """``rows`` with ``post``: what the fit (psr, beta) of the columns leaves of y."""
    terms = [F.col("beta")[k] * F.col(c) for k, c in enumerate(columns)]
    return rows.join(fits.select("psr", "beta"), "psr").withColumn("post", F.col(y) - reduce(Column.__add__, terms)).drop("beta")


def _runs_of(batches, keys: list[str]):
    """As ``_runs``, for Arrow batches: (columns by name, bounds of runs)."""
    kept: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(pa.Table.from_batches([batch]))
        last = _changes(kept[-1], keys)
        if len(last) or (len(kept) > 1 and len(_changes(pa.concat_tables([kept[-2].slice(kept[-2].num_rows - 1), kept[-1].slice(0, 1)]), keys))):
            rows = pa.concat_tables(kept).combine_chunks()
            new = _changes(rows, keys)
            kept = [rows.slice(new[-1])]
            yield rows.slice(0, new[-1]), np.array([0, *new])
    if kept:
        rows = pa.concat_tables(kept).combine_chunks()
        yield rows, np.array([0, *_changes(rows, keys), rows.num_rows])


def _changes(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a row's keys are others than those of the row before."""
    new = np.zeros(max(0, rows.num_rows - 1), bool)
    for k in keys:
        a, b = rows[k].slice(0, len(new)).combine_chunks(), rows[k].slice(1).combine_chunks()
        same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
        new |= ~(same | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False)))
    return np.flatnonzero(new) + 1


def _numbers(rows: pa.Table, *names: str) -> np.ndarray:
    """Columns of numbers side by side."""
    return np.stack([rows[c].to_numpy().astype(float) for c in names], axis=1)


def _flat(rows: pa.Table, name: str, q: int) -> np.ndarray:
    """A column of arrays of q times q numbers, as matrices."""
    return rows[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, q, q)


def _arrays(r: np.ndarray) -> pa.Array:
    """Matrices as a column of arrays."""
    size = int(np.prod(r.shape[1:]))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1, dtype=np.int32) * size), pa.array(np.ascontiguousarray(r, float).ravel()))


def _without_each(units: DataFrame, q: int, own_column: bool, columns: list[str] | None = None) -> DataFrame:
    """(psr, unit, name, r, n, n_rows): each unit's factor without each of its files, and the whole unit's (name null).

    With ``own_column`` the first column is the unit's own and is projected out: ``r`` has the other ones, ``n`` one row less. A column that units' own ones make up has no content.
    ``units`` has the files' factors (r, n), or with ``columns`` their weighted rows (w, columns), which are factored here.
    """

    given = kernels.projected if own_column else lambda r, n: (r, n)

    def run(batches):
        for part, bounds in _runs_of(batches, ["psr", "unit"]):
            if columns is None:
                files, r, n = np.arange(part.num_rows), _flat(part, "r", q), part["n"].to_numpy()
            else:
                files = np.array([0, *_changes(part, ["psr", "unit", "name"])])
                n = np.diff([*files, part.num_rows])
                r = kernels.triangles(_numbers(part, *columns) * np.sqrt(_numbers(part, "w")), n)
            first = np.searchsorted(files, bounds[:-1])  # each unit's first file
            sizes = np.diff([*first, len(files)])
            rest, whole = kernels.others(r, sizes)
            every = np.add.reduceat(n, first)
            keys, types = part.select(["psr", "unit"]), part.schema.field("name").type
            of_files, of_units = keys.take(pa.array(files)), keys.take(pa.array(files[first]))
            for own, names, (rest_, left), rows in (
                (of_units, pa.nulls(len(first), types), given(whole, every), every),
                (of_files, part["name"].combine_chunks().take(pa.array(files)), given(rest, np.repeat(every, sizes) - n), n),
            ):
                done = [own["psr"].combine_chunks(), own["unit"].combine_chunks(), names, _arrays(rest_), pa.array(left, pa.int64()), pa.array(rows, pa.int64())]
                yield pa.RecordBatch.from_arrays(done, ["psr", "unit", "name", "r", "n", "n_rows"])

    ready = units.select("psr", "unit", "name", *(["r", "n"] if columns is None else ["w", *columns])).repartition("psr", "unit").sortWithinPartitions("psr", "unit", "name")
    return ready.mapInArrow(run, f"psr string, unit long, name {units.schema['name'].dataType.simpleString()}, r array<double>, n long, n_rows long")


def leave_one_out(per_file: DataFrame, q: int, threshold: float = 1e-6, unit: str | None = None) -> DataFrame:
    """(psr, name, n_removed, chi2, dof, ftest, drop) of each file: the fit without it against the full one.

    ``per_file`` are factors (psr, name, r, n) of q columns, y included. A file whose removal does not lower chi-squared
    has no p-value and is never dropped. A column that only the file's rows had leaves the fit with it. With ``unit``, a
    whole number that ``per_file`` has too, the first column is one for each unit, as of dispersion-measure bins: it is
    projected out, and a unit that only the file has rows in goes with it. A file may have rows in several units.
    """
    if unit is None:
        per_file = settled(per_file)  # counted, then dealt out
        blocks = per_file.groupBy("psr").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
        per_file = per_file.join(blocks, "psr").withColumn("unit", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("long"))
    else:
        per_file = per_file.withColumn("unit", F.col(unit).cast("long"))
    return _tests(settled(_without_each(per_file, q, unit is not None)), q - (unit is not None), threshold, unit is not None)


def leave_one_out_of_rows(rows: DataFrame, columns: list[str], threshold: float = 1e-6, unit: str = "unit", y: str = "y", w: str = "w") -> DataFrame:
    """``leave_one_out`` with a column for each ``unit``, the first of ``columns``, from weighted rows (psr, unit, name): a unit's rows meet once, and its files' factors are made there."""
    names = [*columns, y]
    ready = rows.select("psr", F.col(unit).cast("long").alias("unit"), "name", F.col(w).alias("w"), *names)
    return _tests(settled(_without_each(ready, len(names), True, names)), len(names) - 1, threshold, True)


def _tests(each: DataFrame, left: int, threshold: float, shared: bool) -> DataFrame:
    """The tests of files from units without each of their files; ``shared``: a file may be in several units."""

    def line(batches):
        for part, bounds in _runs(batches, ["psr"]):
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                own = part.iloc[a:b]
                before, behind, whole = kernels.besides_each(_stack(own["r"], left))
                n = own["n"].to_numpy()
                ahead = np.cumsum(n) - n
                flat = lambda r: list(r.reshape(len(r), -1))
                total = [whole.ravel()] + [None] * (b - a - 1)
                yield pd.DataFrame({
                    "psr": own["psr"].to_numpy(), "unit": own["unit"].to_numpy(), "rank": np.arange(b - a), "whole": own["r"].to_numpy(), "n": n, "before": flat(before), "n_before": ahead, "behind": flat(behind), "n_behind": n.sum() - ahead - n,
                    "beside": flat(kernels.merged(before, behind)), "n_beside": n.sum() - n, "total": total, "n_total": n.sum(),
                })

    # a source has few units beside its rows: bins of its span, or blocks of files
    units = each.filter("name is null").select("psr", "unit", "r", "n").repartition("psr").sortWithinPartitions("psr", "unit")
    of_line = "psr string, unit long, rank long, whole array<double>, n long, before array<double>, n_before long, behind array<double>, n_behind long, beside array<double>, n_beside long, total array<double>, n_total long"
    lined = settled(units.mapInPandas(line, of_line))
    files, name = each.filter("name is not null"), each.schema["name"].dataType.simpleString()
    schema = f"psr string, name {name}, n_removed long, chi2 double, dof long"

    def alone(batches):
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                r = np.concatenate([_flat(rows, "r", left), _flat(rows, "beside", left)], axis=1)
                chi2, dof, _, _ = kernels.solved(r, rows["n"].to_numpy() + rows["n_beside"].to_numpy())
                yield pa.RecordBatch.from_arrays([batch["psr"], batch["name"], batch["n_rows"], pa.array(chi2), pa.array(dof, pa.int64())], ["psr", "name", "n_removed", "chi2", "dof"])

    def merging(batches):
        for pdf in batches:
            if len(pdf):
                sizes = np.array([len(x) for x in pdf["parts"]])
                r = kernels.triangles(np.array([p["r"] for x in pdf["parts"] for p in x], float).reshape(-1, left), sizes * left)
                n = np.array([sum(p["n"] for p in x) for x in pdf["parts"]])
                chi2, dof, _, _ = kernels.solved(r, n)
                yield pd.DataFrame({"psr": pdf["psr"], "name": pdf["name"], "n_removed": pdf["n_removed"], "chi2": chi2, "dof": dof})

    single = files
    if shared:  # files in several units are put together from their units and all others; there are few
        several = settled(files.groupBy("psr", "name").agg(F.count(F.lit(1)).alias("units")).filter("units > 1").select("psr", "name"))
        single = files.join(several, ["psr", "name"], "left_anti")
    # of a file in one unit: what is left of that, beside all other units; these are written apart, so that Spark knows how little it is
    one = single.join(settled(lined.select("psr", "unit", "beside", "n_beside")), ["psr", "unit"]).select("psr", "name", "n_rows", "r", "n", "beside", "n_beside").mapInArrow(alone, schema)
    if shared:
        met = files.join(several, ["psr", "name"], "left_semi").join(lined.select("psr", "unit", "rank", "before", "n_before", "behind", "n_behind"), ["psr", "unit"])
        part = lambda r, n: F.struct(F.col(r).alias("r"), F.col(n).alias("n"))
        of_file = met.groupBy("psr", "name").agg(
            F.sum("n_rows").alias("n_removed"), F.collect_list(part("r", "n")).alias("parts"), F.min_by(part("before", "n_before"), "rank").alias("first"), F.max_by(part("behind", "n_behind"), "rank").alias("last"),
            F.sort_array(F.collect_list("rank")).alias("ranks"),
        )
        of_file = settled(of_file)  # read twice
        skipped = of_file.select("psr", "name", F.explode(F.array_except(F.sequence(F.element_at("ranks", 1), F.element_at("ranks", -1)), "ranks")).alias("rank"))
        between = skipped.join(lined.select("psr", "rank", "whole", "n"), ["psr", "rank"]).groupBy("psr", "name").agg(F.collect_list(part("whole", "n")).alias("between"))
        parts = of_file.join(between, ["psr", "name"], "left").select("psr", "name", "n_removed", F.concat("parts", F.array("first", "last"), F.coalesce("between", F.array())).alias("parts"))
        one = one.union(parts.mapInPandas(merging, schema))
    total = lined.filter("total is not null").select("psr", F.col("total").alias("r"), F.col("n_total").alias("n"))
    base = settled(fit(total, left).select("psr", F.col("chi2").alias("base_chi2"), F.col("dof").alias("base_dof")))
    out = one.join(base, "psr").withColumn("ftest", f_test(F.col("base_chi2"), F.col("base_dof"), F.col("chi2"), F.col("dof")))
    return out.select("psr", "name", "n_removed", "chi2", "dof", "ftest", F.coalesce(F.col("ftest") < threshold, F.lit(False)).alias("drop"))


def nested(total: DataFrame, q: int, models: dict[str, list[int]], full: str) -> DataFrame:
    """(psr, label, chi2, dof, ftest) of models that use some columns, against the one named ``full``: all from one factor."""
    base = fit(total, q, models[full]).select("psr", F.col("chi2").alias("b_chi2"), F.col("dof").alias("b_dof"))
    parts = [fit(total, q, use).select("psr", F.lit(label).alias("label"), "chi2", "dof") for label, use in models.items() if label != full]
    return reduce(DataFrame.union, parts).join(base, "psr").select("psr", "label", "chi2", "dof", f_test(F.col("chi2"), F.col("dof"), F.col("b_chi2"), F.col("b_dof")).alias("ftest"))
