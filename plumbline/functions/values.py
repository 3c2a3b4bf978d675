"""Raw signal codes to values, and bit-level helpers, as column expressions.

No data is NaN in values (not null), as in the stored planes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def linear(raw: Column, scale: Column | float = 1.0, offset: Column | float = 0.0, invalid: Column | None = None) -> Column:
    value = raw * scale + offset
    return value if invalid is None else F.when(invalid.isNotNull() & (raw == invalid), F.lit(NAN)).otherwise(value)


def inverse_depth(raw: Column, near: Column | float, far: Column | float, levels: Column | int = 65536) -> Column:
    """Code 0 is no data; codes 1 to levels - 1 are even steps of 1/z from far to near."""
    near, far, levels = (x if isinstance(x, Column) else F.lit(float(x)) for x in (near, far, levels))
    step = (1 / near - 1 / far) / (levels - 2)
    return F.when(raw == 0, F.lit(NAN)).otherwise(1 / ((raw - 1) * step + 1 / far))


def quantize_inverse(z: Column, near: Column | float, far: Column | float, levels: int = 65536) -> Column:
    """The code of a depth; 0 for NaN, null and what lies outside."""
    near, far = (x if isinstance(x, Column) else F.lit(float(x)) for x in (near, far))
    code = F.round((1 / z - 1 / far) / (1 / near - 1 / far) * (levels - 2)) + 1
    return F.when(z.isNull() | F.isnan(z) | (z < near) | (z > far), F.lit(0)).otherwise(code.cast("int"))


def label(raw: Column, names: Column) -> Column:
    """Name of a code in a map<string,string>; null if it has none."""
    return F.try_element_at(names, raw.cast("string"))


def float16(bits: Column) -> Column:
    """The number that 16 bits stand for in half precision."""
    sign = F.when(bits.bitwiseAND(0x8000) != 0, -1.0).otherwise(1.0)
    exponent = F.shiftright(bits, 10).bitwiseAND(31)
    fraction = bits.bitwiseAND(1023)
    return (
        F.when(exponent == 0, sign * fraction * 2.0**-24)
        .when((exponent == 31) & (fraction == 0), sign * float("inf"))
        .when(exponent == 31, F.lit(NAN))
        .otherwise(sign * (1024 + fraction) * F.pow(F.lit(2.0), exponent - 25))
    )


def triangle_unfold(high: Column, low: Column) -> Column:
    """16-bit code of two bytes whose low one runs backwards at odd high bytes."""
    forward = F.when(high.bitwiseAND(1) == 1, 255 - low).otherwise(low)
    return F.shiftleft(high, 8).bitwiseOR(forward)


def triangle_fold(code: Column) -> tuple[Column, Column]:
    high = F.shiftright(code, 8)
    low = code.bitwiseAND(255)
    return high, F.when(high.bitwiseAND(1) == 1, 255 - low).otherwise(low)


def requantize(depth: Column, scale: float) -> Column:
    """Depth in units of scale, ties to even; what doesn't fit 16 bits, and NaN, is 0."""
    code = F.bround(depth / scale)
    return F.when(F.isnan(depth) | code.isNull() | (code < 1) | (code > 65535), F.lit(0)).otherwise(code.cast("int"))


def signal_value(raw: Column, value_map: Column) -> Column:
    """Value of a code by its map struct<type,scale,offset,invalid,near,far,levels>; no map: the code."""
    kind = value_map["type"]
    return (
        F.when(value_map.isNull() | kind.isNull() | kind.isin("labels", "identity"), raw.cast("double"))
        .when(kind == "linear", linear(raw, F.coalesce(value_map["scale"], F.lit(1.0)), F.coalesce(value_map["offset"], F.lit(0.0)), value_map["invalid"]))
        .when(kind == "inverse_depth", inverse_depth(raw, value_map["near"], value_map["far"], F.coalesce(value_map["levels"], F.lit(65536)).cast("double")))
        .when(kind == "float16_bits", float16(raw))
        .otherwise(F.raise_error(F.concat(F.lit("unknown value map "), kind)).cast("double"))
    )


def nearest_index(at: Column, size: Column, source_size: Column) -> Column:
    """Index in a plane of another size that a pixel falls on."""
    return F.least(F.greatest(F.floor(at * source_size / size), F.lit(0)), source_size - 1)
