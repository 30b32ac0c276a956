"""Colours: hex text to channels, luminance, contrast, Lab and differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def channels(hex_: Column) -> tuple[Column, Column, Column]:
    return tuple(F.conv(F.substring(hex_, at, 2), 16, 10).cast("int") for at in (1, 3, 5))


def with_channels(df, hex_: str = "hex"):
    """``df`` with the columns r, g and b of its colours."""
    return df.withColumns(dict(zip("rgb", channels(F.col(hex_)))))


def normal_hex(c: Column) -> Column:
    """Six upper-case digits from forms like ``#0077ff`` or ``0077FFAA``."""
    return F.substring(F.upper(F.ltrim(F.trim(c), F.lit("#"))), 1, 6)


def linear(channel: Column) -> Column:
    v = channel / 255.0
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def contrast(one: Column, other: Column) -> Column:
    """WCAG contrast of two luminances."""
    return (F.greatest(one, other) + 0.05) / (F.least(one, other) + 0.05)


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE Lab (D65)."""
    lr, lg, lb = linear(r), linear(g), linear(b)
    f = lambda t: F.when(t > 0.008856, F.pow(t, F.lit(1.0 / 3))).otherwise(7.787 * t + 16.0 / 116)
    fx = f((lr * 0.4124 + lg * 0.3576 + lb * 0.1805) / 0.95047)
    fy = f(lr * 0.2126 + lg * 0.7152 + lb * 0.0722)
    fz = f((lr * 0.0193 + lg * 0.1192 + lb * 0.9505) / 1.08883)
    return 116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)


def with_lab(df, prefix: str = "", r: str = "r", g: str = "g", b: str = "b"):
    """``df`` with the columns L, A, B under ``prefix``."""
    l, a, bb = lab(F.col(r), F.col(g), F.col(b))
    return df.withColumns({f"{prefix}lab_l": l, f"{prefix}lab_a": a, f"{prefix}lab_b": bb})


def delta_e(a: str, b: str) -> Column:
    """CIE76 between two sets of Lab columns, by their prefixes."""
    return F.sqrt(sum((F.pow(F.col(f"{a}lab_{k}") - F.col(f"{b}lab_{k}"), F.lit(2.0)) for k in "lab"), F.lit(0.0)))


def hsl(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    r, g, b = r / 255.0, g / 255.0, b / 255.0
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    span, light = hi - lo, (hi + lo) / 2
    sat = F.when(hi == lo, 0.0).when(light <= 0.5, span / (hi + lo)).otherwise(span / (2.0 - hi - lo))
    hue = F.when(hi == lo, 0.0).when(r == hi, (g - b) / span).when(g == hi, 2.0 + (b - r) / span).otherwise(4.0 + (r - g) / span) / 6
    return hue - F.floor(hue), sat, light


def rgb_of(hue: Column, sat: Column, light: Column) -> tuple[Column, Column, Column]:
    """Channels from 0 to 255, not rounded, of hue, saturation and lightness from 0 to 1."""
    high = F.when(light <= 0.5, light * (1 + sat)).otherwise(light + sat - light * sat)
    low = 2 * light - high

    def channel(turn: Column) -> Column:
        t = turn - F.floor(turn)
        part = F.when(t < 1.0 / 6, low + (high - low) * t * 6).when(t < 0.5, high).when(t < 2.0 / 3, low + (high - low) * (2.0 / 3 - t) * 6).otherwise(low)
        return F.when(sat == 0, light).otherwise(part) * 255

    return channel(hue + 1.0 / 3), channel(hue), channel(hue - 1.0 / 3)


def modified(r: Column, g: Column, b: Column, tint: float | None = None, shade: float | None = None, lum_mod: float | None = None, lum_off: float = 0.0) -> Column:
    """The hex text of a colour after modifiers: tint towards white, shade towards black, then lightness times ``lum_mod``
    plus ``lum_off``."""
    rgb = [r.cast("double"), g.cast("double"), b.cast("double")]
    if tint is not None:
        rgb = [255 - (255 - c) * tint for c in rgb]
    if shade is not None:
        rgb = [c * shade for c in rgb]
    if lum_mod is not None or lum_off:
        h, s, l = hsl(*[F.bround(c, 0) for c in rgb])
        rgb = list(rgb_of(h, s, F.least(F.lit(1.0), l * (1.0 if lum_mod is None else lum_mod) + lum_off)))
    return F.upper(F.concat(*[F.lpad(F.hex(F.bround(c, 0).cast("int")), 2, "0") for c in rgb]))
