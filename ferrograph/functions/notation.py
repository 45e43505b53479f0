"""Names, identifiers and notations: normal forms, validators, readers, set fingerprints of two-sided records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import tanimoto

# Shapes of identifiers; spellings of statuses; the element symbols that formulas are made of.
KEY_27 = r"^[A-Z]{14}-[A-Z]{10}-[A-Z]$"
ALIASES = {"done": "completed", "complete": "completed", "ok": "completed", "finished": "completed", "fail": "failed", "error": "failed", "view": "started", "purchase": "completed"}
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi"
).split()


def normal_name(x: Column) -> Column:
    """Lower case, dashes and underscores as spaces, other signs away, one space between words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(x), "[-_]+", " "), "[^a-z0-9 ]", ""), " +", " "))


def is_key(x: Column) -> Column:
    return x.rlike(KEY_27)


def is_reaction(x: Column) -> Column:
    """Exactly one >> with both sides non-empty."""
    sides = F.split(x, ">>")
    return (F.size(sides) == 2) & (F.trim(sides[0]) != "") & (F.trim(F.get(sides, 1)) != "")


def is_formula(x: Column) -> Column:
    """Only element symbols with optional counts, a charge's sign at the end apart: at least two symbols, and a count."""
    plain = F.regexp_replace(x, "[+-]$", "")
    parts = F.regexp_extract_all(plain, F.lit("([A-Z][a-z]?)([0-9]*)"), F.lit(1))
    return plain.rlike("^([A-Z][a-z]?[0-9]*)+$") & F.forall(parts, lambda p: p.isin(*ELEMENTS)) & (F.size(parts) > 1) & plain.rlike("[0-9]")


def from_alias(x: Column) -> Column:
    table = F.create_map(*[F.lit(v) for kv in ALIASES.items() for v in kv])
    return F.coalesce(table[F.lower(x)], x)


def duration_hours(x: Column) -> Column:
    """Hours of the first duration in a text (min, h, d)."""
    n, unit = F.nullif(F.regexp_extract(x, r"([0-9]+(?:\.[0-9]+)?) ?(min|h|d)\b", 1), F.lit("")).cast("double"), F.regexp_extract(x, r"([0-9]+(?:\.[0-9]+)?) ?(min|h|d)\b", 2)
    return F.when(unit == "min", n / 60).when(unit == "h", n).when(unit == "d", n * 24)


def sentences(x: Column) -> Column:
    """Sentences of a text: cut after . ! ? before white space, but not after a digit or a short abbreviation."""
    return F.filter(F.transform(F.split(x, r"(?<=[.!?])(?<!\b[A-Za-z]\.)(?<!\be\.g\.)(?<!\bca\.)\s+"), F.trim), lambda s: s != "")


def canonical_json(entries: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def sided_bits(left: Column, right: Column, width: int) -> Column:
    """Bits of a two-sided record in four blocks of `width`: left, right, lost (left alone), gained (right alone)."""
    shifted = lambda a, k: F.transform(a, lambda x: x + k * width)
    return F.array_sort(F.concat(shifted(F.array_distinct(left), 0), shifted(F.array_distinct(right), 1), shifted(F.array_except(left, right), 2), shifted(F.array_except(right, left), 3)))


def sided_similarity(a: Column, b: Column, width: int, weights: tuple[float, ...] = (0.2, 0.2, 0.3, 0.3)) -> Column:
    """Tanimoto of two sided bit sets, block by block, weighted."""
    block = lambda s, k: F.filter(s, lambda x: (x >= k * width) & (x < (k + 1) * width))
    return F.round(sum((tanimoto(block(a, k), block(b, k)) * w for k, w in enumerate(weights)), F.lit(0.0)), 6)


def signature_similarity(a: Column, b: Column) -> Column:
    """Jaccard of the parts of two signatures, cut at > and ."""
    parts = lambda x: F.array_distinct(F.split(x, "[>.]"))
    return tanimoto(parts(a), parts(b))


def participants(left: Column, right: Column) -> Column:
    """Two lists as a+b=>c, none for an empty one."""
    side = lambda x: F.coalesce(F.nullif(F.array_join(x, "+"), F.lit("")), F.lit("none"))
    return F.concat(side(left), F.lit("=>"), side(right))


def numeric_order(x: Column) -> list[Column]:
    """Sort keys that put lane2 before lane10."""
    return [F.regexp_replace(x, "[0-9]+$", ""), F.nullif(F.regexp_extract(x, "([0-9]+)$", 1), F.lit("")).cast("bigint")]


def values_conflict(a: Column, b: Column) -> Column:
    """Percentages differ by more than 1e-9; other texts differ but for case."""
    number = lambda x: F.nullif(F.regexp_extract(x, r"^\s*([0-9.]+)\s*%\s*$", 1), F.lit("")).cast("double")
    both = number(a).isNotNull() & number(b).isNotNull()
    return F.when(both, F.abs(number(a) - number(b)) > 1e-9).otherwise(F.lower(F.trim(a)) != F.lower(F.trim(b)))
