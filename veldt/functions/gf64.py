"""Affine maps of GF(2^64), the field of the polynomial x^64 + x^4 + x^3 + x + 1."""

from __future__ import annotations

from functools import cache, reduce
from operator import xor

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: the polynomial's low part
REDUCTION = 0x1B
_MASK = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def multiply(a: int, x: int) -> int:
    """Product of two field elements, given and returned as signed 64-bit integers."""
    a, x = a & _MASK, x & _MASK
    # the carry-less product of up to 127 bits
    product = reduce(xor, (a << k for k in range(x.bit_length()) if x >> k & 1), 0)
    # x^64 is the polynomial's low part: fold the upper half down, whose own overflow has four bits at most
    for _ in range(2):
        upper, product = product >> 64, product & _MASK
        product ^= reduce(xor, (upper << k for k in range(5) if REDUCTION >> k & 1), 0)
    return _signed(product)


def affine(a: int | None, x: int | None, b: int | None) -> int | None:
    """a * x + b on the driver; null if any is null."""
    if a is None or x is None or b is None:
        return None
    return _signed((multiply(a, x) ^ b) & _MASK)


@cache
def _tables(a: int) -> tuple[tuple[int, ...], ...]:
    """Products of ``a`` with every half byte at each of the sixteen positions."""
    powers = [multiply(a, _signed(1 << i)) for i in range(64)]
    out = []
    for k in range(16):
        table = [0] * 16
        for v in range(1, 16):
            low = v & -v
            table[v] = table[v ^ low] ^ powers[4 * k + low.bit_length() - 1]
        out.append(tuple(table))
    return tuple(out)


def affine_column(a: int, x: Column, b: int) -> Column:
    """a * x + b for constants a, b: multiplication is linear over bits, so sixteen table lookups XORed.

    Half bytes keep the tables, and with them plans and generated code, small.
    """
    out = F.lit(_signed(b & _MASK)).cast("long")
    for k, table in enumerate(_tables(_signed(a & _MASK))):
        part = F.shiftrightunsigned(x, 4 * k).bitwiseAND(F.lit(15)).cast("int")
        out = out.bitwiseXOR(F.get(F.expr("array(" + ",".join(f"{v}L" for v in table) + ")"), part))
    return out
