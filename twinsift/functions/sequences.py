"""Distances between fingerprint lists, and which positions to sample."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .fingerprints import BITS, hamming

LONG_MEDIA_SECONDS = 1800.0
LONG_MEDIA_SAMPLES = 20


def _one_way(a: Column, b: Column) -> Column:
    nearest = F.transform(a, lambda p: F.array_min(F.transform(b, lambda q: hamming(p, q))))
    return F.aggregate(nearest, F.lit(0.0), lambda acc, d: acc + d) / F.size(a)


def mean_min_distance(a: Column, b: Column) -> Column:
    """Mean distance to the nearest element of the other list, better direction.

    Infinite when one of the lists is empty.
    """
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, F.lit(float("inf"))).otherwise(F.least(_one_way(a, b), _one_way(b, a)))


def aligned_distance(a: Column, b: Column) -> Column:
    """Mean distance position by position; the longer list is thinned evenly.

    64 when one of the lists is empty.
    """
    n = F.least(F.size(a), F.size(b))

    def gap(i: Column) -> Column:
        at_a = F.floor(i * F.size(a) / n).cast("int")
        at_b = F.floor(i * F.size(b) / n).cast("int")
        return hamming(F.get(a, at_a), F.get(b, at_b))

    total = F.aggregate(
        F.transform(F.sequence(F.lit(0), n - 1), gap), F.lit(0.0), lambda acc, d: acc + d
    )
    return F.when(n <= 0, F.lit(float(BITS))).otherwise(total / n)


def sample_positions(total: Column, samples: int) -> Column:
    """Frame positions: a tenth off either end, then evenly spaced."""
    total = total.cast("bigint")
    margin = F.floor(total * F.lit(0.1))
    start = margin
    span = F.greatest((total - margin) - start, F.lit(1))
    return F.transform(
        F.sequence(F.lit(0), F.lit(samples - 1)),
        lambda i: start + F.floor(i * span / F.lit(max(samples, 1))),
    )


def sample_count(seconds: Column, samples: int) -> Column:
    """Long media get at least twenty samples."""
    return F.when(
        seconds >= LONG_MEDIA_SECONDS, F.greatest(F.lit(samples), F.lit(LONG_MEDIA_SAMPLES))
    ).otherwise(F.lit(samples))


def sample_seconds(seconds: Column, samples: int) -> Column:
    """Times in microseconds: a twentieth off either end, end exclusive."""
    margin = seconds * F.lit(0.05)
    end = F.greatest(seconds - margin, margin + F.lit(1.0))
    n = sample_count(seconds, samples)
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.floor((margin + (end - margin) * i / n) * F.lit(1000000.0)).cast("bigint"),
    )


def sample_seconds_inclusive(seconds: Column, samples: int) -> Column:
    """Times in seconds from 10 % to 90 % of the duration, both ends included."""
    start = seconds * F.lit(0.1)
    span = seconds * F.lit(0.9) - start
    return F.transform(
        F.sequence(F.lit(0), F.lit(samples - 1)),
        lambda i: start + span * (i / F.lit(max(samples - 1, 1))),
    )
