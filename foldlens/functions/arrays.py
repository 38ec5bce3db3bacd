"""Probability vectors and 64-bit fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(p: Column) -> Column:
    """0-based place of the largest value, the first of equal ones."""
    return F.array_position(p, F.array_max(p)) - 1


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    raised = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def one_hot(value: Column, vocabulary: Column) -> Column:
    """1.0 at the value's place; all zero for a value outside of the vocabulary."""
    return F.transform(vocabulary, lambda v: F.coalesce((v == value).cast("double"), F.lit(0.0)))


def fingerprint(values: Column) -> tuple[Column, Column]:
    """(low, high) 32-bit halves of the 64 bits value > median of values 2 ... 64.

    Two halves, as 64-bit hashes don't fit a signed long when written in hexadecimal.
    """
    rest = F.array_sort(F.slice(values, 2, 63))
    middle = F.when(F.size(values) > 0, F.element_at(rest, F.lit(32)))
    # as a variable: an expression inside of the inner function would be sorted anew for each value
    bit = F.element_at(F.transform(F.array(middle), lambda m: F.transform(values, lambda v: (v > m).cast("long"))), 1)

    def half(start: int) -> Column:
        part = F.slice(bit, start + 1, 32)
        return F.aggregate(F.reverse(part), F.lit(0).cast("long"), lambda a, b: a * 2 + b)

    return half(0), half(32)


def hamming(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    return (F.bit_count(low_a.bitwiseXOR(low_b)) + F.bit_count(high_a.bitwiseXOR(high_b))).cast("int")


def hex_halves(digits: Column) -> tuple[Column, Column]:
    """(low, high) of a hash of 16 hexadecimal digits."""
    return F.conv(F.substring(digits, 9, 8), 16, 10).cast("long"), F.conv(F.substring(digits, 1, 8), 16, 10).cast("long")
