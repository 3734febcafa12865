"""Numeric expressions: units, bands, deltas, loads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAVITY = 9.81  # fixed value


def kmh_to_ms(c: Column) -> Column:
    return c / 3.6


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session zone is."""
    day = F.unix_date(ts.cast("date")).cast("long") * F.lit(86_400_000_000)
    clock = F.hour(ts).cast("long") * 3600 + F.minute(ts).cast("long") * 60
    part = F.extract(F.lit("SECOND"), ts) * F.lit(1_000_000)
    return day + clock * F.lit(1_000_000) + part.cast("long")


def in_range(c: Column, lo: float, hi: float) -> Column:
    """Value when inside [lo, hi], else null."""
    return F.when(c.between(lo, hi), c)


def safe(c: Column) -> Column:
    """NaN as null, so that avg / min / max skip it."""
    return F.when(~F.isnan(c), c)


def band(c: Column, edges: list[tuple[float, str]], rest: str, inclusive_first: bool = False) -> Column:
    """Name of the first edge above the value; the first edge may include its bound."""
    out = F
    for i, (edge, name) in enumerate(edges):
        hit = c <= edge if (inclusive_first and i == 0) else c < edge
        out = out.when(hit, F.lit(name))
    return out.when(c.isNotNull(), F.lit(rest))


def light(c: Column, dead: float = 0.1) -> Column:
    """Lower is better: green below -dead, red above +dead, else yellow."""
    return F.when(c < -dead, "green").when(c > dead, "red").when(c.isNotNull(), "yellow")


def direction(parts: dict[str, Column], dead: float = 0.3, sep: str = "  |  ") -> Column:
    """Signed deltas as text; small ones read ``same``, missing ones are left out."""
    def one(label: str, d: Column) -> Column:
        shown = F.format_string("%+.1f", F.round(d, 1))
        return (F.when(F.abs(d) < dead, F.lit(f"{label}:same"))
                .when(d.isNotNull(), F.concat(F.lit(f"{label}:"), shown)))
    text = F.concat_ws(sep, *[one(k, d) for k, d in parts.items()])
    return F.when(text == "", F.lit("—")).otherwise(text)


def delta_text(a: Column, b: Column) -> Column:
    d = b - a
    shown = F.regexp_replace(F.format_string("%+.2f", F.round(d, 2)), r"\.?0+$", "")
    return F.when(d.isNull(), F.lit("")).when(F.abs(d) < 1e-9, F.lit("0")).otherwise(shown)


def delta_mark(a: Column, b: Column, polarity: Column) -> Column:
    """better / worse by polarity (``lower``, ``higher``, anything else is neutral)."""
    d = b - a
    good = ((polarity == "lower") & (d < 0)) | ((polarity == "higher") & (d > 0))
    return (F.when(d.isNull() | (F.abs(d) < 1e-9) | ~polarity.isin("lower", "higher"), F.lit(""))
            .when(good, F.lit("better")).otherwise(F.lit("worse")))


def tier(rn: Column, n: Column, fast: float = 0.33, slow: float = 0.67) -> Column:
    """FAST / MED / SLOW from a 1-based position; groups below three have no middle."""
    share = (rn - 1) / F.greatest(n - 1, F.lit(1))
    return (F.when(n < 3, F.when(rn == 1, "FAST").otherwise("SLOW"))
            .when(share <= fast, "FAST").when(share >= slow, "SLOW").otherwise("MED"))


def wheel_loads(mass: Column, ax: Column, wheelbase: Column, cog_h: Column, f_ratio: Column) -> dict[str, Column]:
    """Front and rear load in N under longitudinal acceleration (braking moves load forward)."""
    shift = -mass * ax * cog_h / wheelbase
    front = mass * GRAVITY * f_ratio + shift
    rear = mass * GRAVITY * (1 - f_ratio) - shift
    zero = F.lit(0.0)
    return {"load_f": F.greatest(zero, front), "load_r": F.greatest(zero, rear)}
