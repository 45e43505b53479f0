"""Scalar functions on columns: similarity, hashing, units, normal forms. All are Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Factors to the canonical unit of each kind of quantity.
UNITS = {
    "mg": ("mass", "g", 0.001), "g": ("mass", "g", 1.0), "kg": ("mass", "g", 1000.0),
    "mmol": ("amount", "mol", 0.001), "mol": ("amount", "mol", 1.0),
    "mL": ("volume", "L", 0.001), "L": ("volume", "L", 1.0),
}


def doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 if either is null vector or the sizes differ; within [-1, 1]."""
    length = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (length == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / length)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def distance(metric: str, a: Column, b: Column) -> Column:
    """"cosine" (1 - cosine), "l2" or "inner_product" (negated), so that smaller is nearer."""
    return {"cosine": lambda: F.lit(1.0) - cosine(a, b), "l2": lambda: l2(a, b), "inner_product": lambda: -dot(a, b)}[metric]()


def tanimoto(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 if both are empty."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / every)


def sign_bits(vector: Column) -> Column:
    """Places of a vector's positive entries, a set of bits."""
    return F.filter(F.transform(vector, lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(F.coalesce(x.cast("double"), F.lit(0.0)), F.lit(0.0))))


def band(score: Column, high: float, medium: float) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def blank_as(x: Column, other: str) -> Column:
    return F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit(other))


def fnv1a(text: Column) -> Column:
    """FNV-1a, 32 bits, as eight hex digits, over the code points of texts within the basic plane.

    Fixed values: the offset basis 2166136261 and the prime 16777619.
    """
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.expr("0L") + F.ascii(c).cast("bigint"))
    step = lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    return F.lpad(F.lower(F.hex(F.aggregate(codes, F.lit(2166136261).cast("bigint"), step))), 8, "0")


def units_map(part: int) -> Column:
    return F.create_map(*[F.lit(x) for u, v in UNITS.items() for x in (u, v[part])])


def convert(value: Column, unit: Column, to: Column) -> Column:
    """value in another unit of the same kind, else null."""
    kind, factor = units_map(0), units_map(2)
    return F.when(kind[unit] == kind[to], value * factor[unit] / factor[to])


def check_digit(number: Column) -> Column:
    """Whether a registry number (digits-dd-d) has the right last digit: digits from the right weighted 1, 2, ... modulo 10."""
    digits = F.regexp_replace(number, "[^0-9]", "")
    body = F.reverse(F.split(F.substring(digits, F.lit(1), F.length(digits) - 1), ""))
    total = F.aggregate(F.transform(F.filter(body, lambda c: c != ""), lambda c, i: c.cast("int") * (i + 1)), F.lit(0), lambda s, x: s + x)
    return number.rlike(r"^[0-9]{2,7}-[0-9]{2}-[0-9]$") & (total % 10 == F.right(digits, F.lit(1)).cast("int"))


def multiset_equal(a: Column, b: Column, by: str) -> Column:
    return F.array_sort(F.split(a, by)) == F.array_sort(F.split(b, by))


def signature(parts: list[tuple[str, Column]]) -> Column:
    """k=v joined by |, absent values left out."""
    return F.concat_ws("|", *[F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(f"{k}="), c.cast("string"))) for k, c in parts])


def present(*flags: tuple[str, Column]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags]))
