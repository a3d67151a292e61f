"""Quality-control predicates over reading columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The good flags of each scheme.
GOOD_FLAGS = {"argo": ("1", "2"), "declared": ("1", "2"), "qartod": ("1",), "woce": ("2",)}
# Quantity definitions a reading and a field must share.
COMPATIBLE = (
    ("temperature", "In-situ sea-water temperature", "°C", "sea_water_temperature", "°C"),
    ("salinity", "Practical salinity, PSS-78; not absolute salinity", "psu", "sea_water_salinity", None),
    ("salinity", "Practical salinity, PSS-78; not absolute salinity", "psu", "sea_water_practical_salinity", None),
)
MAX_PRESSURE_DBAR = 12000


def good_flag(scheme: Column, flag: Column) -> Column:
    out = F.lit(False)
    for name, flags in GOOD_FLAGS.items():
        out = F.when(scheme == name, flag.isin(*flags)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def qc_reading(value: Column, flag: Column, scheme: Column, coordinate_ok: Column, mode: Column, bgc: Column) -> Column:
    """Q1: first failed rule of a reading, or ``accepted``; rules in fixed order."""
    return (F.when(value.isNull(), "missing")
            .when(~F.coalesce(coordinate_ok, F.lit(False)), "coordinate")
            .when(~good_flag(scheme, flag), "flag")
            .when(bgc & (mode == "R"), "inspect_only")
            .otherwise("accepted"))


def coordinate_eligible(scheme: Column, depth: Column, pressure_qc: Column, position_qc: Column, time_qc: Column) -> Column:
    """Q2: depth known and the coordinate flags of the scheme are good."""
    three = good_flag(scheme, pressure_qc) & good_flag(scheme, position_qc) & good_flag(scheme, time_qc)
    flags = F.when(scheme.isin("argo", "declared"), three).otherwise(good_flag(scheme, pressure_qc))
    return depth.isNotNull() & F.coalesce(flags, F.lit(False))


def strict_coordinates(scheme: Column, pressure_qc: Column, position_qc: Column, time_qc: Column) -> Column:
    """Q3: narrow argo and declared coordinate flags to 1; other schemes are already narrow."""
    ones = (pressure_qc == "1") & (position_qc == "1") & (time_qc == "1")
    return F.coalesce(F.when(scheme.isin("argo", "declared"), ones).otherwise(F.lit(True)), F.lit(False))


def strict_value(scheme: Column, flag: Column) -> Column:
    """Q3: the same narrowing for the reading's own flag."""
    return F.coalesce(~scheme.isin("argo", "declared") | (flag == "1"), F.lit(False))


def quantity_compatible(variable: Column, definition: Column, units: Column, standard_name: Column, field_units: Column,
                        instrument: Column, temperature_scale: Column) -> Column:
    """Q4: same physical quantity on both sides; ship CTD temperature must state ITS-90."""
    match = F.lit(False)
    for var, definition_text, unit, standard, field_unit in COMPATIBLE:
        one = (variable == var) & (definition == definition_text) & (units == unit) & (standard_name == standard)
        match = match | (one & (field_units == field_unit) if field_unit else one)
    scale_ok = ~((instrument == "ctd") & (variable == "temperature")) | F.coalesce(temperature_scale == "ITS-90", F.lit(False))
    return F.coalesce(match & scale_ok, F.lit(False))


def valid_position(lat: Column, lon: Column) -> Column:
    """Q5: finite and inside the geographic bounds (NaN fails the range test)."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def valid_pressure(pressure: Column) -> Column:
    """Q5."""
    return F.coalesce(pressure.between(0, MAX_PRESSURE_DBAR), F.lit(False))


def pressure_to_depth(pressure: Column, lat: Column) -> Column:
    """Q6: depth in metres from the published hydrostatic formula (Fofonoff and Millard, 1983).

    Expected within about 0.2 % of the modern seawater library (not measured
    here); not bit-equal.
    """
    s = F.sin(F.radians(lat))
    x = s * s
    gravity = 9.780318 * (1.0 + (5.2788e-3 + 2.36e-5 * x) * x) + 1.092e-6 * pressure
    p = pressure
    depth = (((-1.82e-15 * p + 2.279e-10) * p - 2.2512e-5) * p + 9.72659) * p / gravity
    return F.when(valid_pressure(pressure), F.greatest(F.lit(0.0), depth))


def range_status(temperature: Column, salinity: Column) -> Column:
    """Q7: supported source range of a temperature and salinity pair."""
    inside = temperature.between(-3, 45) & salinity.between(0, 50)
    return (F.when(temperature.isNull() | salinity.isNull(), "missing_source")
            .when(inside, "valid").otherwise("unsupported_source_range"))
