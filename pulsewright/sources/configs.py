"""Per-source configurations: YAML files to one row each, with defaults filled in; rule tables taken from them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

try:
    import yaml
except ImportError:  # the other formats need no YAML
    yaml = None

IGNORE = pa.struct([
    ("mjd_start", pa.float64()), ("mjd_end", pa.float64()), ("snr_cut", pa.float64()), ("prob_outlier", pa.float64()),
    ("bad_toa", pa.list_(pa.struct([("name", pa.string()), ("chan", pa.int32()), ("subint", pa.int32()), ("reason", pa.string())]))),
    ("bad_toa_averaged", pa.list_(pa.string())),
    ("bad_file", pa.list_(pa.struct([("pattern", pa.string()), ("reason", pa.string())]))),
    ("bad_range", pa.list_(pa.struct([("lo", pa.float64()), ("hi", pa.float64()), ("be", pa.string())]))),
    ("orphaned_rec", pa.list_(pa.string())), ("poor_febe", pa.list_(pa.string())),
    ("bad_group", pa.list_(pa.struct([("flag", pa.string()), ("value", pa.string())]))),
    ("orb_phase_range", pa.list_(pa.float64())), ("keys", pa.list_(pa.string())), ("null_keys", pa.list_(pa.string())),
])
SCHEMA = pa.schema([
    ("path", pa.string()), ("psr", pa.string()), ("mode", pa.string()), ("timing_model", pa.string()), ("compare_model", pa.string()),
    ("toas", pa.list_(pa.string())), ("free_params", pa.list_(pa.string())), ("free_dmx", pa.bool_()), ("fitter", pa.string()),
    ("n_iterations", pa.int32()), ("ephem", pa.string()), ("bipm", pa.string()), ("fratio", pa.float64()), ("max_sw_delay", pa.float64()),
    ("custom_dmx", pa.list_(pa.list_(pa.float64()))), ("outlier_method", pa.string()), ("n_burn", pa.int32()), ("n_samples", pa.int32()),
    ("noise_dir", pa.string()), ("excised_tim", pa.string()), ("ignore", IGNORE), ("check", pa.map_(pa.string(), pa.string())), ("changelog", pa.list_(pa.string())),
])
#: What a missing key means.
DEFAULTS = {"ephem": "DE440", "bipm": "BIPM2019", "fratio": 1.1, "max_sw_delay": 0.1, "n_iterations": 1}


def _entries(values, names: list[str]) -> list[dict]:
    """Lists of fields, or single fields, to rows; what a list lacks is null."""
    return [dict(zip(names, [*(v if isinstance(v, list) else [v]), *[None] * len(names)], strict=False)) for v in values or []]


def _number(x):
    return None if x is None else float(x)


def parse(path: str, text: str) -> dict:
    c = yaml.safe_load(text) or {}
    part = lambda k: c.get(k) or {}
    ignore, dmx, outlier, results = part("ignore"), part("dmx"), part("outlier"), part("intermediate-results")
    bad = []
    for e in ignore.get("bad-toa") or []:  # narrowband: name, chan, subint, reason; wideband: name, subint
        name, *rest = e
        numbers = [x for x in rest if isinstance(x, int)]
        note = next((x for x in rest if isinstance(x, str)), None)
        bad.append({"name": name, "chan": numbers[0] if len(numbers) > 1 else None, "subint": numbers[-1] if numbers else None, "reason": note})
    files = [e if isinstance(e, list) else [e] for e in ignore.get("bad-file") or []]
    return {
        "path": path, "psr": c.get("source"), "mode": c.get("toa-type"), "timing_model": c.get("timing-model"), "compare_model": c.get("compare-model"),
        "toas": c.get("toas") or [], "free_params": c.get("free-params") or [], "free_dmx": bool(c.get("free-dmx")), "fitter": c.get("fitter"),
        "n_iterations": c.get("n-iterations") or DEFAULTS["n_iterations"], "ephem": c.get("ephem") or DEFAULTS["ephem"], "bipm": c.get("bipm") or DEFAULTS["bipm"],
        "fratio": float(dmx.get("fratio") or DEFAULTS["fratio"]), "max_sw_delay": float(dmx.get("max-sw-delay") or DEFAULTS["max_sw_delay"]),
        "custom_dmx": [[float(x) for x in r] for r in dmx.get("custom-dmx") or []], "outlier_method": outlier.get("method"), "n_burn": outlier.get("n-burn"), "n_samples": outlier.get("n-samples"),
        "noise_dir": results.get("noise-dir"), "excised_tim": results.get("excised-tim"),
        "ignore": {
            **{n.replace("-", "_"): _number(ignore.get(n)) for n in ("mjd-start", "mjd-end", "snr-cut", "prob-outlier")},
            "bad_toa": bad, "bad_toa_averaged": ignore.get("bad-toa-averaged") or [], "bad_file": _entries(files, ["pattern", "reason"]), "bad_range": _entries(ignore.get("bad-range"), ["lo", "hi", "be"]),
            "orphaned_rec": ignore.get("orphaned-rec") or [], "poor_febe": ignore.get("poor-febe") or [], "bad_group": _entries(ignore.get("bad-group"), ["flag", "value"]),
            "orb_phase_range": [float(x) for x in ignore.get("orb-phase-range") or []], "keys": sorted(ignore), "null_keys": sorted(k for k, v in ignore.items() if v is None),
        },
        "check": [(k, None if v is None else str(v)) for k, v in part("check").items()], "changelog": c.get("changelog") or [],
    }


def parse_configs(files: DataFrame) -> DataFrame:
    """Whole files (path, value) to configuration rows."""
    if yaml is None:
        raise ImportError("configurations need a YAML parser")

    def run(batches):
        for batch in batches:
            rows = [parse(p, t) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield from pa.Table.from_pylist(rows, SCHEMA).to_batches()

    return files.select("path", "value").mapInArrow(run, from_arrow_schema(SCHEMA))


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    return parse_configs(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))


def rules(configs: DataFrame, field: str) -> DataFrame:
    """(psr, ...) rule rows of one list under ``ignore``."""
    x = configs.select("psr", F.explode(f"ignore.{field}").alias("x"))
    return x.select("psr", "x.*") if field in ("bad_toa", "bad_file", "bad_range", "bad_group") else x.select("psr", F.col("x").alias("value"))


def excised_reasons(configs: DataFrame) -> DataFrame:
    """Why rows and files are left out: the reason given, or that it is missing, and how often."""
    of = lambda field, kind: rules(configs, field).select("psr", F.lit(kind).alias("kind"), F.coalesce("reason", F.lit("reason missing")).alias("reason"))
    return of("bad_toa", "bad-toa").union(of("bad_file", "bad-file")).groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("n"))
