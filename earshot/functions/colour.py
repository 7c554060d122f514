"""Colours as column expressions: hue, saturation and lightness, and what a picture's pixels add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hsl(r, g, b) -> Column:
    """Struct h (0 to 360), s and l (0 to 100) of red, green and blue of 0 to 255."""
    r, g, b = (_c(x) / 255.0 for x in (r, g, b))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d, light = top - low, (top + low) / 2
    sat = F.when(d == 0, 0.0).when(light > 0.5, d / (2 - top - low)).otherwise(d / (top + low))
    turn = F.when(d == 0, 0.0).when(top == r, (g - b) / d + F.when(g < b, 6.0).otherwise(0.0)).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    return F.struct((turn * 60).alias("h"), (sat * 100).alias("s"), (light * 100).alias("l"))


def hex_of(h, s, l) -> Column:  # noqa: E741
    """#rrggbb of hue, saturation and lightness."""
    h, s, l = _c(h), _c(s) / 100.0, _c(l) / 100.0  # noqa: E741
    a = s * F.least(l, 1 - l)

    def part(n):
        k = F.pmod(n + h / 30.0, F.lit(12.0))
        x = l - a * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))
        return F.lower(F.lpad(F.hex(F.floor(255 * x + 0.5).cast("long")), 2, "0"))

    return F.concat(F.lit("#"), part(0), part(8), part(4))


def rgb_of(code) -> Column:
    """Struct r, g, b of #rgb or #rrggbb."""
    v = F.replace(_c(code), F.lit("#"), F.lit(""))
    v = F.when(F.length(v) == 3, F.regexp_replace(v, "(.)", "$1$1")).otherwise(v)
    return F.struct(*[F.conv(F.substring(v, 2 * k + 1, 2), 16, 10).cast("int").alias(n) for k, n in enumerate("rgb")])


def vivid_hues(pixels: DataFrame) -> DataFrame:
    """id, hue, saturation: the mean of the ten degrees in which a picture's saturated mid-tones weigh most. Pixels id, r, g, b, a; pictures without any are left out."""
    t = pixels.where("a >= 8").select("id", hsl("r", "g", "b").alias("x")).select("id", "x.*").where("l >= 12 and l <= 92")
    w = (F.col("s") / 100) * (F.col("s") / 100) * (1 - F.abs(F.col("l") - 55) / 55)
    t = t.withColumns({"w": w, "bin": F.least(F.lit(35), F.floor(F.col("h") / 10))}).where("w > 0")
    bins = t.groupBy("id", "bin").agg(F.sum("w").alias("w"), F.sum(F.col("h") * F.col("w")).alias("hw"), F.sum(F.col("s") * F.col("w")).alias("sw"))
    best = bins.groupBy("id").agg(F.max(F.struct("w", (-F.col("bin")).alias("o"), "hw", "sw")).alias("b"))
    return best.select("id", (F.col("b.hw") / F.col("b.w")).alias("hue"), F.greatest(F.lit(35.0), F.least(F.lit(95.0), F.col("b.sw") / F.col("b.w"))).alias("saturation"))


def luminance(pixels: DataFrame) -> DataFrame:
    """id, luminance: how light a picture is on the whole, 0 to 1, without what is transparent."""
    luma = (0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b")) / 255
    return pixels.where("a >= 8").groupBy("id").agg(F.avg(luma).alias("luminance"))
