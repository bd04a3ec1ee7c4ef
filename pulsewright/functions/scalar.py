"""Column expressions of single rows: dates, phases, noise conversions, flags."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_of(mjd: Column) -> Column:
    return (mjd - F.lit(51544.0)) / F.lit(365.25) + F.lit(2000.0)


def orbital_phase(mjd: Column, epoch: Column, period: Column, period_dot: Column | None = None) -> Column:
    """Phase in [0, 1) from the epoch of periastron or ascending node; a period derivative bends it."""
    turns = (mjd - epoch) / period
    if period_dot is not None:
        turns = turns - F.lit(0.5) * period_dot * turns * turns
    return turns - F.floor(turns)


def orbital_phase_fb(mjd: Column, epoch: Column, fb0: Column) -> Column:
    turns = (mjd - epoch) * F.lit(86400.0) * fb0
    return turns - F.floor(turns)


def whiten(resid: Column, noise: Column) -> Column:
    """Residual minus whichever of the red and DM noise components there are."""
    part = lambda k: F.coalesce(F.try_element_at(noise, F.lit(k)), F.lit(0.0))
    return resid - part("pl_red_noise") - part("pl_DM_noise")


def red_noise_amplitude(log10_a: Column) -> Column:
    return F.lit(86400.0 * 365.24 * 1e6 / (2.0 * pi * sqrt(3.0))) * F.pow(F.lit(10.0), log10_a)


def log10_to_us(value: Column) -> Column:
    return F.pow(F.lit(10.0), value) * F.lit(1e6)


def fd_delay(freq_mhz: Column, coefficients: Column, base: str = "log10") -> Column:
    """Sum of coefficients times powers of the logarithm of the frequency in GHz, by Horner's rule."""
    log = (F.log10 if base == "log10" else F.log)(freq_mhz / F.lit(1000.0))
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda acc, c: (acc + c) * log)


def standard_flags(flags: Column, f_alt: str = "sys", fe_alt: str = "r", be_alt: str = "i", pta: Column | None = None) -> Column:
    """Flags of a shared standard, each from its own name, else from an alternative, else unknown; decided for each row."""
    get = lambda *names: F.coalesce(*[F.try_element_at(flags, F.lit(n)) for n in names], F.lit("unknown"))
    new = {"f": get("f", f_alt), "fe": get("fe", fe_alt), "be": get("be", be_alt), **{k: get(k) for k in ("proc", "B", "bw", "tobs")}}
    new["pta"] = F.coalesce(F.try_element_at(flags, F.lit("pta")), pta if pta is not None else F.lit("unknown"))
    fresh = F.create_map(*[x for k, v in new.items() for x in (F.lit(k), v)])
    return F.map_concat(F.map_filter(flags, lambda k, _: ~k.isin(*new)), fresh)


def solar_wind_dm(sun_angle: Column, n0: float = 5.0) -> Column:
    """Excess dispersion measure at an elongation."""
    theta = F.lit(pi) - sun_angle
    return F.lit(n0 * 4.8481e-6) * theta / F.abs(F.sin(theta))


def significance(value: Column, error: Column) -> Column:
    return value / error
