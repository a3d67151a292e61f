"""Order-free digests of row sets.

Each row hashes on its own and the hashes add up, lane by lane (an additive
multiset hash). Sums combine map-side, so a digest over any number of rows,
or over one hot group, needs neither a sort nor a collected list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LANES = 4
LANE_HEX = 15


def _lane(text: Column, lane: int) -> Column:
    part = F.substring(F.sha2(text, 256), 1 + lane * LANE_HEX, LANE_HEX)
    return F.conv(part, 16, 10).cast("decimal(24,0)")


def multiset_digest(text: Column) -> Column:
    """Aggregate: count and lane sums of the rows' canonical texts."""
    parts = [F.count(text).cast("string")]
    parts += [F.coalesce(F.sum(_lane(text, lane)).cast("string"), F.lit("0")) for lane in range(LANES)]
    return F.concat_ws(":", *parts)


def exact_number(name: str, text_type: str = "STRING", refuse: bool = True) -> str:
    """SQL text: a double as ``n<mantissa>e<power of two>``, exact to the last bit; zero of either sign is ``n0``.

    The mantissa is the 53-bit integer of the value. A power taken from logarithms may be
    one off near a power of two, which the second step corrects. Non-finite values are refused.
    """
    guess = f"CAST(floor(ln(abs({name})) / ln(2e0)) AS INT)"
    size = f"(abs({name}) / pow(2e0, {guess}))"
    power = f"({guess} + CASE WHEN {size} >= 2e0 THEN 1 WHEN {size} < 1e0 THEN -1 ELSE 0 END)"
    mantissa = f"CAST({name} / pow(2e0, {power}) * 4503599627370496e0 AS BIGINT)"
    stop = f"WHEN isnan({name}) OR abs({name}) = CAST('Infinity' AS DOUBLE) THEN raise_error('a non-finite number has no digest') " if refuse else ""
    return (f"CASE WHEN {name} IS NULL THEN 'z' {stop}WHEN {name} = 0e0 THEN 'n0' "
            f"ELSE concat('n', CAST({mantissa} AS {text_type}), 'e', CAST({power} AS {text_type})) END")


def _number_text(name: str, kind: T.NumericType) -> Column:
    """Integers and floats of equal value have equal text; integers that no double holds keep their digits."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.expr(exact_number(f"CAST(`{name}` AS DOUBLE)"))
    back = "DECIMAL(38, 9)" if isinstance(kind, T.DecimalType) else "BIGINT"
    held = f"try_cast(CAST(`{name}` AS DOUBLE) AS {back}) = CAST(`{name}` AS {back})"
    digits = f"concat('d', CAST(CAST(`{name}` AS DECIMAL(38, 9)) AS STRING))"
    return F.expr(f"CASE WHEN {held} THEN {exact_number(f'CAST(`{name}` AS DOUBLE)')} ELSE coalesce({digits}, 'z') END")


def canonical_text(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Typed canonical text of a row: names sorted, int equals float, -0 equals 0, numbers exact."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for name in sorted(columns or df.columns):
        kind, c = kinds[name], F.col(f"`{name}`")
        if isinstance(kind, T.BooleanType):
            body = F.concat(F.lit("b"), c.cast("string"))
        elif isinstance(kind, T.NumericType):
            body = _number_text(name, kind)
        else:
            text = F.to_json(c) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string")
            body = F.concat(F.lit("s"), F.length(text).cast("string"), F.lit(":"), text)
        parts += [F.lit(name), F.coalesce(body, F.lit("z"))]
    return F.concat_ws("|", *parts)


def exact_sum(value: Column, places: int) -> Column:
    """A5: sum that does not depend on row order or partitioning.

    Values are rounded to ``places`` decimals first (a choice of the caller, since it changes
    the sum by at most half a unit of that place per value); decimal addition is exact, so partial sums
    combine to the same total on any cluster layout, where a fixed visiting
    order would need one task per group.
    """
    return F.sum(value.cast(f"decimal(28,{places})")).cast("double")
