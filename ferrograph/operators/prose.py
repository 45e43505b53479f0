"""Procedures and findings told in prose: actions, quantities, steps, observations, evidence, peaks. Spark expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words that tell of an action, by action, with the family of steps it is of.
ACTIONS = {
    "added": ("add", r"add(?:ed|s|ing)?"),
    "charged": ("charge", r"charg(?:ed|es|ing|e)"),
    "cooled": ("cool", r"cool(?:ed|s|ing)?"),
    "heated": ("heat", r"heat(?:ed|s|ing)?"),
    "warmed": ("heat", r"warm(?:ed|s|ing)?"),
    "stirred": ("hold", r"stir(?:red|s|ring)?"),
    "quenched": ("quench", r"quench(?:ed|es|ing)?"),
    "extracted": ("extract", r"extract(?:ed|s|ing)?"),
    "washed": ("wash", r"wash(?:ed|es|ing)?"),
    "dried": ("dry", r"(?:dry|dried|drying)"),
    "filtered": ("filter", r"filter(?:ed|s|ing)?"),
    "concentrated": ("concentrate", r"concentrat(?:e|ed|es|ing)"),
    "purified": ("purify", r"purif(?:y|ied|ies|ying)"),
}
OBSERVATION = r"(?:observed|detected|appeared|formed)"
MATERIAL = r"(?:[A-Z][a-z]?[0-9]*){2,}"
# Terms of evidence, by which way it points.
NEGATIVE = ["impurity", "impurities", "decomposition", "starting material remains", "incomplete", "multiple spots", "side product", "low conversion"]
POSITIVE = ["clean", "confirmed", "consistent", "matches", "single spot", "complete", "product observed"]
# Units of quantities in prose, by class.
UNITS = {"mass": ["mg", "kg", "g"], "volume": ["mL", "L"], "amount": ["mmol", "mol"], "time": ["min", "h", "s"], "temperature": ["°C", "K"]}


def unit_class(unit: Column) -> Column:
    return F.coalesce(*[F.when(unit.isin(names), kind) for kind, names in UNITS.items()], F.lit("unknown"))


def ledger(texts: DataFrame, key: str, text: str, known: list[str]) -> DataFrame:
    """Per text and action, observation or material-like token: source, action, family, n, status.

    An action of a family that steps are known for is covered; a text with none of all is narrative.
    """
    count = lambda pattern, flags="(?i)": F.regexp_count(F.col(text), F.lit(rf"{flags}\b{pattern}\b"))
    entry = lambda source, action, family, n, status: F.struct(F.lit(source).alias("source"), F.lit(action).alias("action"), F.lit(family).alias("family"), n.alias("n"), F.lit(status).alias("status"))
    found = [entry("english_action_keyword", a, f, count(p), "covered_by_step" if f in known else "uncovered_action_like") for a, (f, p) in ACTIONS.items()]
    found.append(entry("observation_keyword", "", "", count(OBSERVATION), "covered_by_observation"))
    found.append(entry("material_like", "", "", count(MATERIAL, ""), "uncovered_material_like"))
    rows = texts.select(key, F.filter(F.array(*found), lambda e: e["n"] > 0).alias("e"))
    narrative = F.array(entry("narrative", "", "", F.lit(1), "ignored_narrative"))
    return rows.select(key, F.explode(F.when(F.size("e") > 0, F.col("e")).otherwise(narrative)).alias("e")).select(key, "e.*")


def quantities(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Per text and class of unit the numbers with that unit: n and least, greatest; the class is unknown for other units."""
    pattern = r"(?<![A-Za-z0-9.])([+-]?[0-9]+(?:\.[0-9]+)?)\s+([A-Za-z°%]+)"
    parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("value"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("unit"))
    rows = texts.select(key, F.explode(parts).alias("q")).select(key, unit_class(F.col("q.unit")).alias("class"), F.col("q.value").cast("double").alias("value"))
    return rows.groupBy(key, "class").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest"))


def steps(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Sentences of texts as steps: key, place (from 0), family of the first action that one tells of, confidence; observe (0.35) where none."""
    sentences = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    rows = texts.select(key, F.posexplode(sentences).alias("place", "sentence"))
    hit = {a: F.regexp_instr("sentence", F.lit(rf"(?i)\b{p}\b")) for a, (_, p) in ACTIONS.items()}
    first = F.array_min(F.filter(F.array(*[F.when(n > 0, F.struct(n.alias("at"), F.lit(ACTIONS[a][0]).alias("family"))) for a, n in hit.items()]), lambda x: x.isNotNull()))
    rows = rows.withColumn("first", first)
    return rows.select(key, "place", F.coalesce("first.family", F.lit("observe")).alias("family"), F.when(F.col("first").isNull(), 0.35).otherwise(0.8).alias("confidence"))


def observed(text: Column) -> dict[str, Column]:
    """What a text tells of having been seen: event_type, linked_family, value, confidence."""
    low = F.lower(text)
    says = lambda *words: F.greatest(*[F.contains(low, F.lit(w)).cast("int") for w in words], F.lit(0)) == 1
    colour = says("color", "colour") | (low.rlike(r"\b(?:deep\s+red|red|yellow)\b") & low.rlike(r"\b(?:turn(?:ed)?|became|becomes|changed?|colour|color)\b"))
    event = F.when(colour, "color_change").when(says("precipitat"), "precipitation").when(says("gas", "bubble"), "gas_evolution")
    family = F.when(says("after add", "after adding"), "add").when(says("heated", "warming"), "heat").when(says("cooled", "cooling"), "cool")
    value = F.when(says("deep red"), "deep_red").when(says("yellow"), "yellow")
    return {"event_type": event, "linked_family": family, "value": value, "confidence": F.when(event.isNull(), 0.4).otherwise(0.78)}


def polarity(text: Column, analysis: Column) -> dict[str, Column]:
    """Which way evidence points and by which term: negative terms before positive ones, in the order of their list."""
    low = F.lower(text)
    first = lambda terms: F.coalesce(*[F.when(F.contains(low, F.lit(t)), t) for t in terms])
    negative, positive = first(NEGATIVE), first(POSITIVE)
    identifies = analysis & (F.contains(low, F.lit("nmr")) | F.contains(low, F.lit("ms")) | F.contains(low, F.lit("spectrum")))
    kind = F.when(negative.isNotNull(), "weakens").when(positive.isNotNull() & identifies, "identifies").when(positive.isNotNull(), "supports")
    return {"kind": kind, "signal": F.coalesce(negative, positive)}


def yield_basis(text: Column, percent: Column, isolated_mass: Column) -> Column:
    """What a reported yield rests on."""
    return (
        F.when(percent.isNull(), "not_reported").when(isolated_mass.isNotNull() | text.rlike("(?i)isolated"), "isolated").when(text.rlike(r"(?i)\bnmr\b"), "nmr")
        .when(text.rlike(r"(?i)\blc[-\s]?ms\b|\blcms\b"), "lcms").when(text.rlike("(?i)crude"), "crude").otherwise("unknown")
    )


def yield_confidence(basis: Column, conflict: Column) -> Column:
    return F.when(basis == "not_reported", "unknown").when(conflict, "estimated").when(basis.isin("isolated", "nmr", "lcms"), "confirmed").otherwise("estimated")


def intent(failure: Column, changed: Column, confirmed: Column, single: Column) -> Column:
    """Why an experiment was made: failure first, then what was changed, then what was confirmed."""
    return F.when(failure, "failure_diagnosis").when(changed > 0, "optimization").when(confirmed, "characterization").when(single, "synthesis").otherwise("baseline_observation")


def part(text: Column, pattern: str, group: int) -> Column:
    """A group of a pattern, null where it is empty or the pattern is not there."""
    return F.nullif(F.trim(F.regexp_extract(text, pattern, group)), F.lit(""))


def nmr_peak(raw: Column) -> dict[str, Column]:
    """shift (or min_shift and max_shift), multiplicity, coupling and integration of a peak such as 7.26-7.20 (m, J = 8.0 Hz, 2H)."""
    whole = r"^(\d+(?:\.\d+)?)(?:\s*(?:-|–|to)\s*(\d+(?:\.\d+)?))?\s*\((.*)\)\s*$"
    high, low = part(raw, whole, 1).cast("double"), part(raw, whole, 2).cast("double")
    return {
        "shift": F.when(low.isNull(), high), "min_shift": low, "max_shift": F.when(low.isNotNull(), high), "multiplicity": part(part(raw, whole, 3), r"^([^,]*)", 1),
        "coupling": part(raw, r"(?i)(J\s*=[^,)]*)", 1), "integration": part(raw, r"(?i)[,(]\s*(\d+(?:\.\d+)?\s*H)\s*[,)]", 1),
    }


def mass_ion(raw: Column) -> dict[str, Column]:
    """mz, adduct and component of an ion such as m/z 181.1 ([M+H]+, product)."""
    whole = r"(?i)^m/z\s+(\d+(?:\.\d+)?)\s*(?:\((.*?)\))?\s*$"
    return {"mz": part(raw, whole, 1).cast("double"), "adduct": part(part(raw, whole, 2), r"^([^,]*)", 1), "component": part(part(raw, whole, 2), r"^[^,]*,([^,]*)", 1)}


def chromatography_peak(raw: Column) -> dict[str, Column]:
    """retention, unit, area and component of a peak such as 3.2 min (95 %, product)."""
    whole = r"(?i)^(\d+(?:\.\d+)?)\s*(min|s)\s*(?:\((.*?)\))?\s*$"
    inner = part(raw, whole, 3)
    return {"retention": part(raw, whole, 1).cast("double"), "unit": F.lower(part(raw, whole, 2)), "area": part(inner, r"(\d+(?:\.\d+)?)\s*%", 1).cast("double"), "component": part(F.regexp_replace(inner, r"^\s*\d+(?:\.\d+)?\s*%\s*,?", ""), r"^([^,]*)", 1)}


def mapped_atoms(side: Column) -> Column:
    """The atoms [label:number] of one side of a mapped reaction, as a sorted array of number and label; labels of one number are a set."""
    numbers, labels = F.regexp_extract_all(side, F.lit(r"\[([^\]:]*):(\d+)\]"), F.lit(2)), F.regexp_extract_all(side, F.lit(r"\[([^\]:]*):(\d+)\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(F.arrays_zip(numbers.alias("n"), labels.alias("l")), lambda x: F.struct(x["n"].cast("int").alias("n"), x["l"].alias("l")))))


def changed_atoms(reaction: Column) -> Column:
    """The numbers of the atoms whose labels differ between the sides of left>>right."""
    left, right = mapped_atoms(F.substring_index(reaction, ">>", 1)), mapped_atoms(F.substring_index(reaction, ">>", -1))
    differ = F.concat(F.array_except(left, right), F.array_except(right, left))
    return F.array_sort(F.array_distinct(F.transform(differ, lambda x: x["n"])))


def arithmetic(kind: str, value: Column, unit: Column, other: Column, other_unit: Column | None = None) -> tuple[Column, Column]:
    """Value and unit of a quantity plus or minus another of its unit, or times or over a number; null where that cannot be."""
    if kind in ("+", "-"):
        return F.when(unit == other_unit, value + other if kind == "+" else value - other), F.when(unit == other_unit, unit)
    result = value * other if kind == "*" else F.try_divide(value, other)
    return result, F.when(result.isNotNull(), unit)


def conditions(text: Column) -> dict[str, Column]:
    """Solvent, catalyst, atmosphere, temperature, time and the other reagents of a list of conditions, comma by comma."""
    # What solvents, catalysts and atmospheres are called.
    solvents, gases = ["thf", "dmf", "dcm", "toluene", "water", "ethanol", "methanol"], ["n2", "ar", "air", "h2"]
    tokens = F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda t: t != "")
    first = lambda test: F.get(F.filter(tokens, test), 0)
    is_solvent, is_gas = lambda t: F.lower(t).isin(solvents), lambda t: F.lower(t).isin(gases)
    is_catalyst, is_degrees = lambda t: t.rlike(r"(?i)^pd|\bcat\b|catalyst"), lambda t: t.rlike(r"^-?\d+(?:\.\d+)?\s*(?:°C|K)$|^rt$")
    is_time = lambda t: t.rlike(r"^\d+(?:\.\d+)?\s*(?:min|h|d)$")
    rest = F.filter(tokens, lambda t: ~(is_solvent(t) | is_gas(t) | is_catalyst(t) | is_degrees(t) | is_time(t)))
    return {"solvent": first(is_solvent), "catalyst": first(is_catalyst), "atmosphere": first(is_gas), "temperature": first(is_degrees), "time": first(is_time), "reagents": F.array_join(rest, "+")}


def lanes(plates: DataFrame, key: str, text: str) -> DataFrame:
    """Spots of plates written lane:spot,spot;lane:spot: key, lane, spot, place, and `standard`: the one lane of the plate that is a standard (std...) with that spot, if just one is."""
    lane = plates.select(key, F.explode(F.split(text, ";")).alias("lane")).select(key, F.trim(F.substring_index("lane", ":", 1)).alias("lane"), F.substring_index("lane", ":", -1).alias("spots"))
    spots = lane.select(key, "lane", F.posexplode(F.split("spots", ",")).alias("place", "spot")).withColumn("spot", F.trim("spot")).where("spot <> ''")
    single = spots.where(F.col("lane").startswith("std")).groupBy(key, "spot").agg(F.min("lane").alias("standard"), F.count_distinct("lane").alias("n")).where("n = 1").drop("n")
    return spots.join(single, [key, "spot"], "left").select(key, "lane", "spot", "place", "standard")
