"""Water-quality formulas as Column functions: null in, null out; a zero denominator gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounds that keep null (greatest and least alone would skip it)."""
    out = x if low is None else F.greatest(x, F.lit(low))
    out = out if high is None else F.least(out, F.lit(high))
    return F.when(x.isNotNull(), out)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def right_closed(x: Column, edges: list[float], names: list[str]) -> Column:
    """Bins (-inf, e1], (e1, e2], ...; null stays null."""
    out = F.when(x <= edges[0], names[0])
    for e, n in zip(edges[1:], names[1:]):
        out = out.when(x <= e, n)
    return out.when(x.isNotNull(), names[len(edges)]) if len(names) > len(edges) else out


def do_saturation(t: Column) -> Column:
    return 14.62 - 0.3898 * t + 0.006969 * t * t - 5.596e-5 * t * t * t


def do_pct_saturation(do: Column, t: Column, high: float = 200.0) -> Column:
    return clip(ratio(do, do_saturation(t)) * 100, 0.0, high)


def do_deficit(do: Column, t: Column) -> Column:
    return clip(do_saturation(t) - do, 0.0)


def cdom_absorption_440(colour: Column) -> Column:
    return 0.174 * F.pow(clip(colour, 0.1), F.lit(0.724))


def cdom_ratio(a420: Column, a436: Column) -> Column:
    return clip(ratio(a420, a436), 0.5, 20.0)


def spectral_slope(a420: Column, a436: Column) -> Column:
    return clip(F.ln(clip(ratio(a420, a436), 1e-6)) / 16, -0.05, 0.05)


def np_molar_ratio(tn: Column, tp: Column) -> Column:
    return clip(ratio(tn / 14.007, tp / 30.974), 0.0, 500.0)


def nutrient_regime(np_ratio: Column) -> Column:
    return right_closed(np_ratio, [10, 16], ["N-limited", "co-limited", "P-limited"])


def chla_tp_ratio(chla: Column, tp: Column) -> Column:
    return clip(ratio(chla, tp), 0.0, 10.0)


def tp_status(tp: Column) -> Column:
    return right_closed(tp, [8, 24, 42, 80], ["High", "Good", "Moderate", "Poor", "Bad"])


def tsi_chla(c: Column) -> Column:
    return 9.81 * F.ln(clip(c, 0.01)) + 30.6


def tsi_tp(p: Column) -> Column:
    return 14.42 * F.ln(clip(p, 0.1)) + 4.15


def tsi_secchi(s: Column) -> Column:
    return 60 - 14.41 * F.ln(clip(s, 0.01))


def mean_of(*cols: Column) -> Column:
    """Row mean of those that are not null; null if none is."""
    n = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    return F.when(n > 0, sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0)) / n)


def secchi_from_turbidity(t: Column, high: float = 40.0) -> Column:
    return clip(1.7 / (clip(t, 0.0) * 0.015 + 0.04), None, high)


def retention_days(volume: Column, discharge: Column) -> Column:
    return clip(ratio(volume, discharge) * 365, None, 3650.0)


def trophic_class(tp: Column) -> Column:
    return F.when((tp > 0) & (tp <= 10), "oligotrophic").when((tp > 10) & (tp <= 35), "mesotrophic").when((tp > 35) & (tp <= 100), "eutrophic").when(tp > 100, "hypereutrophic").otherwise("unknown")


def band_turbidity(nir: Column) -> Column:
    """Near-infrared below 0 counts as 0."""
    x = clip(nir, 0.0)
    return clip(610 * x / clip(1 - x / 0.194, 0.05), 0.0, 500.0)


def blue_green(blue: Column, green: Column) -> Column:
    """The ratio of reflectances, each 1e-6 at least."""
    return clip(blue, 1e-6) / clip(green, 1e-6)


def negative_blue(blue: Column) -> Column:
    """1 where the correction went too far: blue reflectance below 0."""
    return F.coalesce(blue < 0, F.lit(False)).cast("int")


def band_chla(blue: Column, green: Column) -> Column:
    r = F.log10(blue_green(blue, green))
    return clip(F.pow(F.lit(10.0), 0.366 - 3.067 * r + 1.930 * r * r + 0.649 * r * r * r), 0.01, 500.0)


def band_cdom(blue: Column, green: Column) -> Column:
    return clip(-0.5 * F.ln(blue_green(blue, green)), 0.0, 20.0)


def band_secchi(turbidity: Column) -> Column:
    return clip(1.7 / clip(turbidity * 0.015 + 0.04, 0.1), 0.1, 40.0)


def ndci(re: Column, red: Column) -> Column:
    return (re - red) / clip(re + red, 1e-9)


def ndci_chla(n: Column) -> Column:
    return 14.039 + 86.115 * n + 194.325 * n * n


def chla_choice(n: Column, other: Column) -> Column:
    """The index's estimate where the index is over -0.05, else the other."""
    return F.when(n > -0.05, ndci_chla(n)).otherwise(other)


def cross_ratio(vv_db: Column, vh_db: Column) -> Column:
    """In decibels, so a difference."""
    return vv_db - vh_db


#: Scene classes that hide the surface, for stations and lakes, and for patches; bits of the older product's quality band. Fixed values.
SCENE_HIDDEN, PATCH_HIDDEN, QUALITY_BITS = (0, 1, 3, 7, 8, 9, 10, 11), (3, 8, 9, 10), (1 << 10, 1 << 11)


def scene_clear(scene: Column, patch: bool = False) -> Column:
    """Whether a scene class leaves the surface in sight; null for a null class."""
    return ~scene.isin(*(PATCH_HIDDEN if patch else SCENE_HIDDEN))


def quality_clear(bits: Column) -> Column:
    """Whether neither opaque cloud nor cirrus is marked in the older product's quality band."""
    return bits.bitwiseAND(QUALITY_BITS[0] | QUALITY_BITS[1]) == 0


def ice_flag(mean_db: Column, std_db: Column) -> Column:
    """Bright and even: ice. Without a deviation (null or NaN) brightness decides; a null mean is none."""
    return F.coalesce(mean_db > -10, F.lit(False)) & (std_db.isNull() | F.isnan(std_db) | (std_db < 2))


def colour_class(colour: Column, left_closed: bool = False) -> Column:
    """clear, coloured, humic with edges at 30 and 100: right-closed, or left-closed."""
    if left_closed:
        return F.when(colour < 30, "clear").when(colour < 100, "coloured").when(colour.isNotNull(), "humic")
    return F.when((colour > 0) & (colour <= 30), "clear").when((colour > 30) & (colour <= 100), "coloured").when(colour > 100, "humic")


def snow_water(depth_m: Column) -> Column:
    return depth_m * 200


def sensor_count(*flags: Column) -> Column:
    return sum((F.coalesce(f.cast("int"), F.lit(0)) for f in flags), F.lit(0))


def any_flag(*flags: Column) -> Column:
    return F.greatest(*[F.coalesce(f.cast("int"), F.lit(0)) for f in flags]) > 0


def row_score(weather: Column, satellite: Column) -> Column:
    """0: both (complete), 1: weather only, 2: satellite only, 3: neither. Null counts as not there."""
    w, s = F.coalesce(weather, F.lit(False)), F.coalesce(satellite, F.lit(False))
    return F.when(w & s, 0).when(w, 1).when(s, 2).otherwise(3)


def water_type(blue: Column, red: Column, nir: Column, chla: Column) -> Column:
    """1 clear, 2 humic, 3 turbid (also by default), 4 eutrophic."""
    r = blue / clip(red, 1e-9)
    return F.when(chla > 20, 4).when(nir > 0.02, 3).when(r < 0.8, 2).when((r > 2) & (nir < 0.005), 1).otherwise(3)


def wind_speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def expected_phosphorus(retention_years: Column) -> Column:
    return 15 * F.pow(retention_years, F.lit(0.3))


def column_slug(number: Column, title: Column) -> Column:
    """p{number}_{title up to the first colon}, lower case, other signs as one underscore, 40 characters of it at most."""
    s = F.regexp_replace(F.lower(F.trim(F.split_part(title, F.lit(":"), F.lit(1)))), "[^a-z0-9]+", "_")
    return F.concat(F.lit("p"), number.cast("string"), F.lit("_"), F.substring(F.regexp_replace(s, "^_+|_+$", ""), 1, 40))


def first_place(*cols: Column) -> Column:
    """The first that is neither null nor 0."""
    return F.coalesce(*[F.nullif(c, F.lit(0.0)) for c in cols])


def scene_date(ts: Column, index: Column) -> Column:
    """The day of a time stamp, else of a scene's index: yyyy_MM_dd in its first ten characters, or its last eight as yyyyMMdd."""
    return F.coalesce(F.to_date(ts), F.to_date(F.try_to_timestamp(F.substring(index, 1, 10), F.lit("yyyy_MM_dd"))), F.to_date(F.try_to_timestamp(F.substring(index, -8, 8), F.lit("yyyyMMdd"))))


def known(x: Column) -> Column:
    """NaN to null."""
    return F.when(~F.isnan(x), x)


def attenuation_secchi(kd490: Column) -> Column:
    """Depth from attenuation at 490 nm, 0.1 to 40; null where it is not positive."""
    return F.when(known(kd490) > 0, clip(1.7 / kd490, 0.1, 40.0))


def matter_turbidity(tsm: Column) -> Column:
    return known(tsm) * 0.8


def product_chla(network: Column, ratio_based: Column) -> Column:
    """The network's value, else the band ratio's."""
    return F.coalesce(known(network), known(ratio_based))


def product_cdom(rw443: Column, rw560: Column) -> Column:
    return clip(-0.5 * F.ln(clip(known(rw443), 1e-9) / clip(known(rw560), 1e-9)), 0.0, 20.0)


def fixed_decimals(x: Column, digits: int) -> Column:
    """A number with fixed decimals, --- where it is null or not finite."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, "---").otherwise(F.format_string(f"%.{digits}f", x))


def place_in(x: Column, order: list[str]) -> Column:
    """Place of a category in a list, from 1; unknown ones come last."""
    at = F.array_position(F.array(*[F.lit(v) for v in order]), x)
    return F.when(at > 0, at).otherwise(len(order) + 1)
