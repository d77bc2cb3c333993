"""Colors: parsing, conversion, fading and palettes."""

from __future__ import annotations

import colorsys
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The named colors of CSS Color Module Level 4.
CSS = dict(
    x.split(":")
    for x in """
aliceblue:f0f8ff antiquewhite:faebd7 aqua:00ffff aquamarine:7fffd4 azure:f0ffff beige:f5f5dc bisque:ffe4c4 black:000000 blanchedalmond:ffebcd blue:0000ff
blueviolet:8a2be2 brown:a52a2a burlywood:deb887 cadetblue:5f9ea0 chartreuse:7fff00 chocolate:d2691e coral:ff7f50 cornflowerblue:6495ed cornsilk:fff8dc crimson:dc143c
cyan:00ffff darkblue:00008b darkcyan:008b8b darkgoldenrod:b8860b darkgray:a9a9a9 darkgreen:006400 darkkhaki:bdb76b darkmagenta:8b008b darkolivegreen:556b2f darkorange:ff8c00
darkorchid:9932cc darkred:8b0000 darksalmon:e9967a darkseagreen:8fbc8f darkslateblue:483d8b darkslategray:2f4f4f darkturquoise:00ced1 darkviolet:9400d3 deeppink:ff1493 deepskyblue:00bfff
dimgray:696969 dodgerblue:1e90ff firebrick:b22222 floralwhite:fffaf0 forestgreen:228b22 fuchsia:ff00ff gainsboro:dcdcdc ghostwhite:f8f8ff gold:ffd700 goldenrod:daa520
gray:808080 green:008000 greenyellow:adff2f honeydew:f0fff0 hotpink:ff69b4 indianred:cd5c5c indigo:4b0082 ivory:fffff0 khaki:f0e68c lavender:e6e6fa
lavenderblush:fff0f5 lawngreen:7cfc00 lemonchiffon:fffacd lightblue:add8e6 lightcoral:f08080 lightcyan:e0ffff lightgoldenrodyellow:fafad2 lightgray:d3d3d3 lightgreen:90ee90 lightpink:ffb6c1
lightsalmon:ffa07a lightseagreen:20b2aa lightskyblue:87cefa lightslategray:778899 lightsteelblue:b0c4de lightyellow:ffffe0 lime:00ff00 limegreen:32cd32 linen:faf0e6 magenta:ff00ff
maroon:800000 mediumaquamarine:66cdaa mediumblue:0000cd mediumorchid:ba55d3 mediumpurple:9370db mediumseagreen:3cb371 mediumslateblue:7b68ee mediumspringgreen:00fa9a mediumturquoise:48d1cc mediumvioletred:c71585
midnightblue:191970 mintcream:f5fffa mistyrose:ffe4e1 moccasin:ffe4b5 navajowhite:ffdead navy:000080 oldlace:fdf5e6 olive:808000 olivedrab:6b8e23 orange:ffa500
orangered:ff4500 orchid:da70d6 palegoldenrod:eee8aa palegreen:98fb98 paleturquoise:afeeee palevioletred:db7093 papayawhip:ffefd5 peachpuff:ffdab9 peru:cd853f pink:ffc0cb
plum:dda0dd powderblue:b0e0e6 purple:800080 rebeccapurple:663399 red:ff0000 rosybrown:bc8f8f royalblue:4169e1 saddlebrown:8b4513 salmon:fa8072 sandybrown:f4a460
seagreen:2e8b57 seashell:fff5ee sienna:a0522d silver:c0c0c0 skyblue:87ceeb slateblue:6a5acd slategray:708090 snow:fffafa springgreen:00ff7f steelblue:4682b4
tan:d2b48c teal:008080 thistle:d8bfd8 tomato:ff6347 turquoise:40e0d0 violet:ee82ee wheat:f5deb3 white:ffffff whitesmoke:f5f5f5 yellow:ffff00 yellowgreen:9acd32
""".split()
)

# Published categorical palettes.
PALETTES = {
    "plotly": "636efa ef553b 00cc96 ab63fa ffa15a 19d3f3 ff6692 b6e880 ff97ff fecb52".split(),
    "spring_pastel": "b2e061 7eb0d5 fd7f6f bd7ebe ffb55a ffee65 beb9db fdcce5 8bd3c7".split(),
    "dutch_field": "e60049 0bb4ff 50e991 e6d800 9b19f5 ffa300 dc0ab4 b3d4ff 00bfa0".split(),
}


def hex_channel(x: Column, i: int) -> Column:
    """Channel i (0 red, 1 green, 2 blue, 3 alpha) of a hex color as 0 to 255; null if x is not one."""
    bare = F.regexp_replace(x, "^#", "")
    ok = bare.rlike("^([0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})$")
    part = F.substring(bare, 2 * i + 1, 2)
    value = F.conv(part, 16, 10).cast("int")
    return F.when(ok & (part != ""), value).when(ok, 255)


def rgba(x: Column) -> Column:
    """CSS text of a hex color, channels with four decimals."""
    parts = [F.format_string("%.4f", hex_channel(x, i).cast("double")) for i in range(3)]
    return F.concat(F.lit("rgba("), F.concat_ws(",", *parts, F.format_string("%.4f", hex_channel(x, 3) / 255)), F.lit(")"))


def fade(x: Column, alpha: float) -> Column:
    return F.regexp_replace(rgba(x), r",[0-9.]+\)$", f",{alpha:.4f})")


def hex_of(r: Column, g: Column, b: Column) -> Column:
    """Hex text of channels from 0 to 255, rounded half to even."""
    return F.concat(F.lit("#"), *(F.lpad(F.lower(F.hex(F.bround(c, 0).cast("bigint"))), 2, "0") for c in (r, g, b)))


def hsv(r: Column, g: Column, b: Column) -> Column:
    """(h, s, v), each from 0 to 1, of channels from 0 to 255."""
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    span = F.nullif(hi - lo, F.lit(0).cast("double"))
    sector = F.when(hi == r, (g - b) / span).when(hi == g, 2 + (b - r) / span).otherwise(4 + (r - g) / span)
    h = F.coalesce(sector / 6 - F.floor(sector / 6), F.lit(0.0))
    return F.struct(h.alias("h"), F.coalesce((hi - lo) / F.nullif(hi, F.lit(0).cast("double")), F.lit(0.0)).alias("s"), (hi / 255).alias("v"))


def from_hsv(h: Column, s: Column, v: Column) -> Column:
    """(r, g, b), each from 0 to 255, of values from 0 to 1."""
    one = lambda n: 255 * (v - v * s * F.greatest(F.lit(0.0), F.least(F.pmod(n + h * 6, F.lit(6.0)), 4 - F.pmod(n + h * 6, F.lit(6.0)), F.lit(1.0))))
    return F.struct(one(F.lit(5.0)).alias("r"), one(F.lit(3.0)).alias("g"), one(F.lit(1.0)).alias("b"))


def coerce(color: str) -> str:
    """Hex text of a color given by name or as hex, on the driver."""
    text = CSS.get(color.lower(), color).lstrip("#").lower()
    if not re.fullmatch("[0-9a-f]{6}|[0-9a-f]{8}", text):
        raise ValueError(f"{color} is neither a color name nor six or eight hex digits")
    return "#" + text


def hsv_hex(h: float, s: float, v: float) -> str:
    return "#" + "".join(f"{round(255 * c):02x}" for c in colorsys.hsv_to_rgb(h, s, v))
