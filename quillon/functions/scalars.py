"""Column functions of the domain: circular angles, units, identifiers, signal detection, parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def angular_error(a: Column, b: Column) -> Column:
    """Smaller angle between two directions in degrees."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360 - d)


def cortisol_nmol(ug_dl: Column) -> Column:
    return ug_dl * 27.59


def below_detection(value: Column, lod: Column) -> Column:
    """Values under the limit of detection become it over the square root of two."""
    return F.when(value < lod, lod / F.sqrt(F.lit(2.0))).otherwise(value)


def gravity_corrected(value: Column, gravity: Column, reference: float = 1.024) -> Column:
    return value * (reference - 1) / (gravity - 1)


def master_id(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts joined by |."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def sample_id_part(sample: Column, part: int) -> Column:
    """1 dataset, 2 sample, 3 visit of DATASET_SAMPLE_VISIT."""
    return F.split_part(sample, F.lit("_"), F.lit(part))


def clipped_rate(rate: Column) -> Column:
    return F.least(F.greatest(rate, F.lit(0.01)), F.lit(0.99))


def cowan_k(set_size: Column, accuracy: Column) -> Column:
    return set_size * (2 * accuracy - 1)


def heartbeat_accuracy(recorded: Column, counted: Column) -> Column:
    return 1 - F.abs(recorded - counted) / recorded


def e_value(rr: Column) -> Column:
    """Confounding strength that would explain a risk ratio away; ratios under one are inverted."""
    r = F.when(rr < 1, 1 / rr).otherwise(rr)
    return r + F.sqrt(r * (r - 1))


def angular_sqrt(p: Column) -> Column:
    return F.asin(F.sqrt(p))


def concentration(text: Column) -> tuple[Column, Column]:
    """(value, spread) of `a-b`, `m±s`, `<x`, `>x` or `x`; rules in this order, NULL if none fits."""
    number = r"(\d+(?:\.\d+)?)"
    num = lambda pattern, g: F.expr("try_cast(NULL AS DOUBLE)") if g is None else F.nullif(F.regexp_extract(text, pattern, g), F.lit("")).try_cast("double")
    span, spread, bound, single = rf"^\s*{number}\s*-\s*{number}\s*$", rf"^\s*{number}\s*(?:±|\+/-)\s*{number}", rf"^\s*[<>]\s*{number}", rf"^\s*{number}\s*$"
    value = F.coalesce((num(span, 1) + num(span, 2)) / 2, num(spread, 1), num(bound, 1), num(single, 1))
    return value, F.coalesce((num(span, 2) - num(span, 1)) / 4, num(spread, 2))
