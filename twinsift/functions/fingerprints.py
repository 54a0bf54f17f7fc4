"""64-bit fingerprints. A fingerprint is a BIGINT holding the 64 bits."""

from __future__ import annotations

import struct

from pyspark.sql import Column, functions as F

BITS = 64
SIDE = 8


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it inside ``body``.

    Lambda bodies are evaluated per element, so an expression they mention
    would otherwise be computed again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _pack(values: Column) -> Column:
    """Bit i is set when element i is above the mean of all elements."""
    def above(mean: Column) -> Column:
        bits = F.transform(
            values,
            lambda x, i: F.when(
                x > mean, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)
            ).otherwise(F.lit(0).cast("bigint")),
        )
        return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, bit: acc.bitwiseOR(bit))

    mean = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / F.size(values)
    return _bind(mean, above)


def sign_hash(vector: Column) -> Column:
    """Mean-threshold hash of a vector with at most 64 elements."""
    return _pack(vector.cast("array<double>"))


def _nearest(width: int) -> list[int]:
    """Source index for each of the nine sample positions.

    Computed in single precision, so that positions falling on a pixel border
    are assigned as the fingerprint format defines them.
    """
    def single(x: float) -> float:
        return struct.unpack("f", struct.pack("f", x))[0]

    step = single(width / (SIDE + 1))
    return [min(int(single(i * step)), width - 1) for i in range(SIDE + 1)]


def pixel_hash(pixels: Column, width: int) -> Column:
    """Difference hash of a gray image given row by row.

    The grid is sampled to 9 x 9; each of the 64 bits says whether one
    horizontal step in the first eight rows is larger than the mean step.
    Null when the grid is shorter than ``width * width``.
    """
    at = _nearest(width)
    steps = [(at[y] * width + at[x + 1], at[y] * width + at[x]) for y in range(SIDE) for x in range(SIDE)]
    right = F.array(*[F.lit(r) for r, _ in steps])
    left = F.array(*[F.lit(l) for _, l in steps])
    grid = pixels.cast("array<double>")
    diffs = F.zip_with(right, left, lambda r, l: F.get(grid, r) - F.get(grid, l))
    return F.when(F.size(pixels) >= width * width, _bind(diffs, _pack))


def luma(rgb: Column) -> Column:
    """Gray value per pixel of a flat r,g,b,r,g,b,... array."""
    pixels = F.floor(F.size(rgb) / 3).cast("int")

    def gray(p: Column) -> Column:
        total = F.get(rgb, p * 3) + F.get(rgb, p * 3 + 1) + F.get(rgb, p * 3 + 2)
        return F.floor(total / F.lit(3)).cast("int")

    index = F.when(pixels > 0, F.sequence(F.lit(0), pixels - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(index, gray)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def to_hex16(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def from_hex16(text: Column) -> Column:
    """Fingerprint from its hex digits; null when the text is not one."""
    return F.when(
        text.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(text, 16, -10).cast("bigint")
    )


def hamming_hex(a: Column, b: Column) -> Column:
    """Distance of two hex fingerprints; 64 when one of them is unreadable."""
    return F.coalesce(hamming(from_hex16(a), from_hex16(b)), F.lit(BITS))


def bit_text(fingerprint: Column) -> Column:
    """64 characters, least significant bit first."""
    return F.reverse(F.lpad(F.bin(fingerprint), BITS, "0"))
