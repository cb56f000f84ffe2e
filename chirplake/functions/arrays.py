"""Waveforms as array columns, and names and ids as text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def overlap(a: Column, b: Column) -> Column:
    """Cosine of two waveforms; null where one is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def hrss(wave: Column, dt: float) -> Column:
    """Root of the summed squares times the sample interval."""
    return F.sqrt(dot(wave, wave) * dt)


def network_snr(energies: Column) -> Column:
    return F.sqrt(F.aggregate(energies, F.lit(0.0), lambda s, x: s + x.cast("double")))


def count_above(wave: Column, threshold: float) -> Column:
    return F.size(F.filter(wave, lambda x: x > threshold))


def order_statistic(wave: Column, start: int, stop: int, k: int) -> Column:
    """The k-th smallest sample (from 0) of a slice."""
    return F.get(F.sort_array(F.slice(wave, start + 1, stop - start)), F.lit(k))


def time_slice(wave: Column, rate: float, start: float, end: float) -> Column:
    return F.slice(wave, int(start * rate) + 1, int(end * rate) - int(start * rate))


def add_at(wave: Column, other: Column, at: int) -> Column:
    """``other`` added to a waveform from sample ``at`` on, cut at its end."""
    return F.transform(wave, lambda x, i: x + F.when(i >= at, F.coalesce(F.get(other, i - at), F.lit(0.0))).otherwise(F.lit(0.0)))


def slide(wave: Column, by: int) -> Column:
    """Moved cyclically by a number of samples."""
    n = F.size(wave)
    k = F.pmod(F.lit(by), n)
    return F.concat(F.slice(wave, n - k + 1, k), F.slice(wave, 1, n - k))


def cumulative_hrss(wave: Column, dt: float) -> Column:
    """The hrss of each beginning of a waveform."""
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        s = a["s"] + x.cast("double") * x.cast("double")
        return F.struct(s.alias("s"), F.concat(a["out"], F.array(F.sqrt(s * dt))).alias("out"))

    return F.aggregate(wave, start, step, lambda a: a["out"])


def quality_and_frequency(name: Column) -> tuple[Column, Column]:
    """Q and frequency (Hz) written in a waveform's name; null where it has none."""
    return F.regexp_extract(name, r"_Q(\d+)_", 1).try_cast("int"), F.regexp_extract(name, r"_(\d+)Hz", 1).try_cast("int")


def row_id(*parts: Column, keep: int = 16) -> Column:
    """The first hex digits of the md5 of integer keys, underscore-joined."""
    return F.substring(F.md5(F.concat_ws("_", *[p.cast("string") for p in parts])), 1, keep)


def long_id(gps: Column, short: Column) -> Column:
    return F.format_string("%.4f_%s", gps, short)


def id_ranges(text: Column) -> Column:
    """The numbers of "1-5,7" as an array."""
    part = lambda p: F.sequence(F.get(F.split(p, "-"), F.lit(0)).cast("int"), F.element_at(F.split(p, "-"), -1).cast("int"))
    return F.flatten(F.transform(F.split(F.replace(text, F.lit(" "), F.lit("")), ","), part))


def element(values: Column, i: int) -> Column:
    """The i-th element as a column of its own; null where the list is short."""
    return F.get(values, F.lit(i))


def shift_key(shift: Column) -> Column:
    """Numbers as text of 12 significant digits without trailing zeros, joined by commas: equal shifts have equal keys."""

    def one(x: Column) -> Column:
        text = F.format_string("%.11e", x)
        for size in range(11, -5, -1):  # as many decimals as 12 digits leave
            fixed = F.format_string(f"%.{11 - size}f", x)
            fixed = F.regexp_replace(F.regexp_replace(fixed, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
            text = F.when((F.abs(x) >= 10.0**size) & (F.abs(x) < 10.0 ** (size + 1)), fixed).otherwise(text)
        return F.when(x == 0, F.lit("0")).otherwise(text)

    return F.array_join(F.transform(shift, lambda x: one(x.cast("double"))), ",")


def lag_vectors(text: Column) -> Column:
    """"0,0;1,0" as an array of arrays; null if vectors differ in length, one is no number, or there is none."""
    rows = F.filter(F.transform(F.split(text, ";"), lambda e: F.trim(e)), lambda e: e != "")
    out = F.transform(rows, lambda e: F.transform(F.split(e, ","), lambda v: F.trim(v).try_cast("double")))
    good = (F.size(out) > 0) & F.forall(out, lambda v: (F.size(v) == F.size(F.get(out, F.lit(0)))) & ~F.exists(v, lambda x: x.isNull()))
    return F.when(good, out)


def leakage(wave: Column, reference: Column, steps: int) -> Column:
    """Strength of a reconstruction in each of ``steps`` samples behind the reference's end, over the reference's whole strength.

    The end is behind the last sample above a thousandth of the largest; both have one time axis.
    """
    top = F.array_max(F.transform(reference, lambda x: F.abs(x)))
    last = F.array_max(F.filter(F.transform(reference, lambda x, i: F.when(F.abs(x) > top * 1e-3, i)), lambda i: i.isNotNull()))
    total = F.sqrt(F.aggregate(reference, F.lit(0.0), lambda a, x: a + x * x))
    end = F.least(last + 1, F.size(reference) - 1)
    return F.when((total > 0) & last.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda j: F.abs(F.coalesce(F.get(wave, end + j), F.lit(0.0))) / total))
