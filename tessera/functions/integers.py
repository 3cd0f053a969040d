"""Permutation, chunk, bit and residual arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_BYTES = 65536
FRAME_BYTES = 131072


def expand_permutation(p: Column, block: int) -> Column:
    """out[i * block + b] = p[i] * block + b."""
    return F.flatten(F.transform(p, lambda x: F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda b: x * block + b)))


def is_power_of_two(x: Column) -> Column:
    return (x > 0) & (F.bit_count(x) == 1)


def ceil_div(a: Column, b) -> Column:
    return F.ceil(a / F.lit(b)).cast("long")


def align_down(a: Column, b: int) -> Column:
    return a - F.pmod(a, F.lit(b))


def first_chunk(off: Column, chunk: int = CHUNK_BYTES) -> Column:
    return F.floor(off / chunk).cast("long")


def last_chunk(off: Column, length: Column, chunk: int = CHUNK_BYTES) -> Column:
    """Null for an empty range, which covers no chunk."""
    return F.when(length > 0, F.floor((off + length - 1) / chunk).cast("long"))


def chunk_length(index: Column, total: Column, chunk: int = CHUNK_BYTES) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(chunk).cast("long"), total - index * chunk))


def element_count(shape: Column) -> Column:
    return F.aggregate(shape, F.lit(1).cast("long"), lambda a, x: a * x)


def trailing_elements(shape: Column, dim: int) -> Column:
    """Product of the extents after ``dim``."""
    return F.aggregate(F.slice(shape, dim + 2, F.greatest(F.size(shape), F.lit(1))), F.lit(1).cast("long"), lambda a, x: a * x)


def window_output(size: Column, kernel: Column, stride: Column, padding: Column) -> Column:
    """Output extent of a convolution or pooling window."""
    return F.floor((size + 2 * padding - kernel) / stride).cast("long") + 1


def zigzag_encode(target: Column, base: Column, bits: int = 16) -> Column:
    """Difference modulo 2^bits, folded so that small ones of either sign are small; up to 32 bits in LONG."""
    modulus = 1 << bits
    d = F.pmod(target.cast("long") - base.cast("long"), F.lit(modulus))
    return F.when(d >= modulus // 2, 2 * (modulus - d) - 1).otherwise(2 * d)


def zigzag_decode(base: Column, z: Column, bits: int = 16) -> Column:
    half = F.shiftright(z, 1)
    d = F.when(z.bitwiseAND(1) == 1, -half - 1).otherwise(half)
    return F.pmod(base.cast("long") + d, F.lit(1 << bits))


def quantile_positions(length: int, samples: int) -> list[int]:
    """Distinct positions floor(i (length - 1) / (samples - 1)) of a sorted row."""
    return sorted({i * (length - 1) // max(samples - 1, 1) for i in range(samples)}) if length else []
