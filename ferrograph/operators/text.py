"""Facts read out of text: quantities, references, mentions, links, taxonomies. Spark expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How a quantity is written.
NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
QUANTITY = rf"^\s*(<=|>=|<|>|~|=)?\s*{NUMBER}(?:\s*(?:-|to)\s*{NUMBER})?(?:\s*\+/-\s*{NUMBER})?\s*([A-Za-z%/°]*)\s*$"
SHORTHAND = {"rt": (25.0, "C"), "reflux": (None, "reflux"), "ice bath": (0.0, "C"), "overnight": (16.0, "h")}


def quantity(text: Column) -> dict[str, Column]:
    """Parts of a quantity: comparator, low, high, uncertainty, unit; shorthands stand for their values; null where none."""
    part = lambda i: F.nullif(F.regexp_extract(text, QUANTITY, i), F.lit(""))
    name = F.lower(F.trim(text))
    low, unit = part(2).cast("double"), part(5)
    for word, (value, of) in SHORTHAND.items():
        low = F.when(name == word, F.lit(value).cast("double")).otherwise(low)
        unit = F.when(name == word, F.lit(of)).otherwise(unit)
    return {"comparator": part(1), "low": low, "high": part(3).cast("double"), "uncertainty": part(4).cast("double"), "unit": unit}


def first_rule(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The name of the first rule one of whose words the text contains, any case."""
    low, found = F.lower(text), F.lit(default)
    for name, words in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        found = F.when(hit, name).otherwise(found)
    return found


def mentions(docs: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """Whole-word mentions of terms (single words), any case: key, term, n. Texts are cut into words once, whatever the number of terms."""
    words = F.filter(F.split(F.lower(F.col(text)), "[^a-z0-9_]+"), lambda w: w.isin(terms))
    return docs.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").cast("int").alias("n"))


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """References of pages: key, position from 0, target, scheme (absolute, root, fragment, relative)."""
    found = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))).alias("position", "target"))
    scheme = F.when(F.col("target").rlike("^[a-z]+://"), "absolute").when(F.col("target").startswith("/"), "root").when(F.col("target").startswith("#"), "fragment").otherwise("relative")
    return found.withColumn("scheme", scheme)


def aliases(url: Column) -> Column:
    """Names by which a url may be meant: its path without query, its last part, and that without extension."""
    path = F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "^[a-z]+://[^/]*", "")
    last = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    return F.array_distinct(F.filter(F.array(path, last, F.regexp_replace(last, r"\.[A-Za-z0-9]+$", "")), lambda x: x != ""))


def resolve(references: DataFrame, targets: DataFrame, scope: str) -> DataFrame:
    """references (ref, name, scope) with matches among targets (target, name, scope): status, n_matches, target.

    Targets of the same scope are preferred; one match resolves, several are ambiguous, none is unresolved.
    """
    t = targets.select("target", "name", F.col(scope).alias("__scope"))
    met = references.join(t, "name", "left").withColumn("same", F.coalesce(F.col(scope) == F.col("__scope"), F.lit(False)))
    counts = met.groupBy("ref").agg(F.count("target").alias("n"), F.count_if("same").alias("n_same"), F.min("target").alias("any"), F.min(F.when(F.col("same"), F.col("target"))).alias("own"))
    n = F.when(F.col("n_same") > 0, F.col("n_same")).otherwise(F.col("n"))
    status = F.when(n == 0, "unresolved").when(n == 1, "resolved").otherwise("ambiguous")
    return counts.select("ref", status.alias("status"), n.alias("n_matches"), F.when(n == 1, F.coalesce("own", "any")).alias("target"))


def line_column(text: Column, offset: Column) -> tuple[Column, Column]:
    """Line and column, from 1, of an offset from 0."""
    before = F.substring(text, F.lit(1), offset.cast("int"))
    return F.size(F.split(before, "\n")), F.length(F.substring_index(before, "\n", -1)) + 1


def compact(*parts: Column) -> Column:
    """Parts that are not blank, joined by one space."""
    return F.concat_ws(" ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def overlaps(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs of spans (id, key, start, end: whole numbers) of one key that overlap: left_id, right_id. Spans meet in bins of `width`; a pair counts in the first shared bin alone."""
    def binned(df: DataFrame, side: str) -> DataFrame:
        lo, hi = F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)
        return df.where("end > start").select(F.col("id").alias(f"{side}_id"), key, F.col("start").alias(f"{side}_start"), F.col("end").alias(f"{side}_end"), F.explode(F.sequence(lo, hi)).alias("bin"))

    met = binned(left, "left").join(binned(right, "right"), [key, "bin"])
    first = F.floor(F.greatest("left_start", "right_start") / width) == F.col("bin")
    return met.where(first & (F.col("left_start") < F.col("right_end")) & (F.col("right_start") < F.col("left_end"))).select("left_id", "right_id")
