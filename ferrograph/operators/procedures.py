"""Procedures told in prose, lowered to steps: sentences, clauses and steps with spans, parameters that consume what they read, coverage by spans.

One pass over each text finds its frames; coverage and gaps are joins and windows over spans in Spark.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prose import ACTIONS, MATERIAL, OBSERVATION

FAMILIES = {name: family for name, (family, _) in ACTIONS.items()}
ACTION = re.compile("|".join(rf"(?P<{name}>\b{pattern}\b)" for name, (_, pattern) in ACTIONS.items()), re.I)
SEEN = re.compile(rf"\b(?:{OBSERVATION}|turned|became|precipitat\w*|bubbles?)\b", re.I)
# Abbreviations that end no sentence; words that part clauses; what may stand before a clause's action.
SHORT = re.compile(r"(?:\b(?i:e\.g|i\.e|ca|approx|etc|vs|no|fig|dr|eq|equiv|temp|aq|sat)|(?<![0-9°]\s)(?<![0-9°])\b[A-Z])\.$")
STOP = re.compile(r"[.!?]+(?=\s|$)")
PARTING = re.compile(r"[,;]|\b(?:and then|followed by|and|then)\b", re.I)
LEAD = re.compile(r"[\s,]*(?:(?:and|then|was|were|is|are)\s+|(?:it|they|the(?:\s+[\w-]+){1,3}|[\w-]+)\s+(?:was|were)\s+)*", re.I)
MARK = re.compile(r"\s*(?:[0-9]+[.)]|[-*•])\s+")
# How parameters are written.
TIMES = re.compile(r"\b([0-9]+)\s*(?:x|×)(?=\s|\d)|\b([0-9]+)\s+times\b|\b(once|twice|thrice)\b|\b(two|three|four|five)\s+times\b", re.I)
COUNTS = {"once": 1, "twice": 2, "thrice": 3, "two": 2, "three": 3, "four": 4, "five": 5}
TEMPERATURE = re.compile(r"([+-]?[0-9]+(?:\.[0-9]+)?)\s*°\s*C\b|\b(room temperature|rt|ambient temperature)\b|\b(?:an?\s+)?(ice bath)\b", re.I)
DURATION = re.compile(r"\b([0-9]+(?:\.[0-9]+)?)\s*(s|sec|seconds?|min|minutes?|h|hours?|d|days?)\b|\b(overnight)\b", re.I)
MINUTES = {"s": 1 / 60, "m": 1, "h": 60, "d": 1440}
AMOUNT = re.compile(r"\b([0-9]+(?:\.[0-9]+)?)\s*(mg|kg|g|mL|L|mmol|mol|equiv)\b")
AGENT = re.compile(r"\b(?:with|over|in)\s+((?!an?\b|the\b)[A-Za-z][A-Za-z0-9()/-]*)")
SURE, UNSURE, OBSERVED = 0.84, 0.35, 0.78
# Families of steps that come after a reaction; how sure a product and a material that is carried over are.
WORKUP = ["quench", "extract", "wash", "dry", "filter", "concentrate", "purify"]
PRODUCT = r"(?is)\b(?:to\s+yield|yielded|afforded)\s+(.+?)(?:\.|$)"
EXPLICIT, CARRIED = 0.82, 0.67
FRAME = "place int, kind string, family string, start int, end_ int, temperature double, minutes double, amount double, unit string, repeats int, material string, confidence double, diagnostic string"


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Spans of sentences: they end at . ! or ? before white space, but not after an abbreviation, and at the lines of a list; marks of lists are left out."""
    lines, at = [], 0
    for line in text.splitlines(keepends=True):
        lines.append((at, at + len(line)))
        at += len(line)
    if not any(MARK.match(text, a, b) for a, b in lines):
        lines = [(0, len(text))]
    for begin, end in lines:
        mark = MARK.match(text, begin, end)
        begin = mark.end() if mark else begin
        for m in STOP.finditer(text, begin, end):
            if m.end() < end and text[m.end() - 1] == "." and SHORT.search(text, max(begin, m.end() - 12), m.end()):
                continue
            yield from trimmed(text, begin, m.end())
            begin = m.end()
        yield from trimmed(text, begin, end)


def trimmed(text: str, start: int, end: int, away: str = " \t\r\n\f\v") -> Iterator[tuple[int, int]]:
    while start < end and text[start] in away:
        start += 1
    while end > start and text[end - 1] in away:
        end -= 1
    if start < end:
        yield start, end


def depths(text: str, start: int, end: int) -> list[int]:
    found, depth = [], 0
    for c in text[start:end]:
        depth = depth + 1 if c in "([{" else max(0, depth - 1) if c in ")]}" else depth
        found.append(depth)
    return found


def clauses(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Spans of a sentence's clauses: cut, outside brackets, at a comma, semicolon or joining word behind which an action follows."""
    depth, at = depths(text, start, end), start
    for m in PARTING.finditer(text, start, end):
        if m.start() < at or depth[m.start() - start]:
            continue
        lead = LEAD.match(text, m.end(), end)
        if ACTION.match(text, lead.end(), end):
            yield from trimmed(text, at, m.start(), " \t\r\n\f\v,;.!?")
            at = m.end()
    yield from trimmed(text, at, end, " \t\r\n\f\v,;.!?")


def parameters(said: str) -> tuple:
    """Temperature in °C, minutes, amount, unit, repeats and material of a step; each pattern blanks what it has read, so that none reads it again."""

    def take(pattern: re.Pattern) -> re.Match | None:
        nonlocal said
        m = pattern.search(said)
        if m:
            said = said[: m.start()] + " " * (m.end() - m.start()) + said[m.end() :]
        return m

    times, heat, time, amount, agent = take(TIMES), take(TEMPERATURE), take(DURATION), take(AMOUNT), take(AGENT)
    repeats = None if not times else int(times[1] or times[2] or COUNTS[(times[3] or times[4]).lower()])
    temperature = None if not heat else float(heat[1]) if heat[1] else 25.0 if heat[2] else 0.0
    minutes = None if not time else 960.0 if time[3] else float(time[1]) * MINUTES[time[2][0].lower()]
    return temperature, minutes, float(amount[1]) if amount else None, amount[2] if amount else None, repeats, agent[1] if agent else None


def frames(text: str, known: frozenset[str] | None = None) -> list[tuple]:
    """Steps, observations and what is neither, in order, as rows of FRAME.

    A clause has a step for each action outside brackets (of the known families), from its word to the next one's; the first has
    the clause's beginning too. A clause without one is an observation if it tells of something seen, else it is kept
    as `observe` with low confidence and a diagnostic.
    """
    found: list[tuple] = []
    for a, b in sentences(text):
        found += [(len(found) + k, kind, family, a + start, a + end, *rest) for k, (kind, family, start, end, *rest) in enumerate(said(text[a:b], known))]
    return found


def said(sentence: str, known: frozenset[str] | None = None) -> list[tuple]:
    """Frames of one sentence, without their places."""
    found: list[tuple] = []
    for start, end in clauses(sentence, 0, len(sentence)):
        depth = depths(sentence, start, end)
        acts = [m for m in ACTION.finditer(sentence, start, end) if not depth[m.start() - start] and (known is None or FAMILIES[m.lastgroup] in known)]
        for k, m in enumerate(acts):
            first, last = (start if not k else m.start()), (acts[k + 1].start() if k + 1 < len(acts) else end)
            tail = re.compile(r"(?:[\s,;]+(?:and|then))*[\s,;]*\Z", re.I).search(sentence[first:last])
            last = first + tail.start()
            found.append(("step", FAMILIES[m.lastgroup], first, last, *parameters(sentence[first:last]), SURE, None))
        if not acts and any(c.isalnum() for c in sentence[start:end]):
            seen = SEEN.search(sentence, start, end)
            nothing = (None,) * 6
            found.append(("observation", None, start, end, *nothing, OBSERVED, None) if seen else ("unparsed", "observe", start, end, *nothing, UNSURE, "W805"))
    return found


#: Sentences that a task remembers what was found in.
REMEMBERED = 50_000
ARROW = {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}


def by_sentence(texts: DataFrame, key: str, text: str, find: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """What `find` gives for each sentence of each text: key, place in the text, and the schema's columns, with start and end_ counted from the text's beginning.

    A sentence begins and ends beside white space, so no word reaches over it and it is read by itself: each different one of a batch once.
    """
    columns, kind = [tuple(f.split()) for f in schema.split(", ")], texts.schema[key].dataType.simpleString()
    names = [n for n, _ in columns]

    def run(batches):
        memory: dict[str, list[tuple]] = {}
        for batch in batches:
            if len(memory) > REMEMBERED:
                memory.clear()
            number: dict[str, int] = {}
            which, owner, at = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for a, b in sentences(t) if t else ():
                    which.append(number.setdefault(t[a:b], len(number)))
                    owner.append(i)
                    at.append(a)
            lists = [memory[s] if s in memory else memory.setdefault(s, find(s)) for s in number]
            flat = [f for found in lists for f in found]
            sizes = np.array([len(found) for found in lists], np.int64)
            which, owner, at = (np.array(x, np.int64) for x in (which, owner, at))
            n = sizes[which] if len(which) else which
            first = (np.cumsum(sizes) - sizes)[which] if len(which) else which
            rows = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            owners, shift = np.repeat(owner, n), np.repeat(at, n)
            place = np.arange(len(owners)) - np.searchsorted(owners, owners)
            made = [pa.array([f[k] for f in flat], ARROW[t]).take(pa.array(rows)) for k, (_, t) in enumerate(columns)]
            made = [pa.array((np.asarray(c) + shift).astype(np.int32)) if name in ("start", "end_") else c for name, c in zip(names, made, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners)), pa.array(place.astype(np.int32)), *made], ["key", "place", *names])

    return texts.select(key, text).mapInArrow(run, f"key {kind}, place int, {schema}").withColumnRenamed("key", key)


def lowered(texts: DataFrame, key: str, text: str, known: list[str] | None = None) -> DataFrame:
    """Frames of each text: key and FRAME (spans in code points, end exclusive). Null and empty texts have none; no shuffle."""
    only = frozenset(known) if known is not None else None
    return by_sentence(texts, key, text, lambda sentence: said(sentence, only), FRAME.removeprefix("place int, "))


def entries(texts: DataFrame, key: str, text: str) -> DataFrame:
    """What in a text looks like an action, an observation or a material: key, source, action, family, start, end_. Each is one word."""
    seen, material = re.compile(rf"\b{OBSERVATION}\b", re.I), re.compile(rf"\b{MATERIAL}\b")

    def find(t: str) -> list[tuple]:
        found = [("english_action_keyword", m.lastgroup, FAMILIES[m.lastgroup], m.start(), m.end()) for m in ACTION.finditer(t)]
        return found + [(source, None, None, m.start(), m.end()) for source, p in (("observation_keyword", seen), ("material_like", material)) for m in p.finditer(t)]

    return by_sentence(texts, key, text, find, "source string, action string, family string, start int, end_ int").drop("place")


def coverage(found: DataFrame, framed: DataFrame, key: str, width: int = 64) -> DataFrame:
    """entries (from `entries`) with status: covered_by_step if a step of their family overlaps them, covered_by_observation if an observation
    does, else uncovered_action_like; observation words are covered_by_observation, materials uncovered_material_like.

    Actions alone meet frames, in bins of `width` characters, so a long text's spans are not paired out. An action word is shorter
    than a bin: it is in the bin where it begins, a frame in its bins and the one before, and so an action's rows stay together.
    """
    e = found.where("source = 'english_action_keyword'").withColumn("bin", F.floor(F.col("start") / width))
    f = framed.where("kind <> 'unparsed'").select(key, "kind", F.col("family").alias("of"), F.col("start").alias("s"), F.col("end_").alias("e"))
    f = f.withColumn("bin", F.explode(F.sequence(F.floor(F.col("s") / width) - 1, F.floor((F.col("e") - 1) / width))))
    met = e.join(f, [key, "bin"], "left").withColumn("over", F.coalesce((F.col("s") < F.col("end_")) & (F.col("start") < F.col("e")), F.lit(False)))
    step = F.max((F.col("over") & (F.col("kind") == "step") & (F.col("of") == F.col("family"))).cast("int")) == 1
    seen = F.max((F.col("over") & (F.col("kind") == "observation")).cast("int")) == 1
    flags = met.groupBy(key, "bin", "start", "end_", "source", "action", "family").agg(step.alias("step"), seen.alias("seen"))
    status = F.when(F.col("step"), "covered_by_step").when(F.col("seen"), "covered_by_observation").otherwise("uncovered_action_like")
    plain = F.when(F.col("source") == "observation_keyword", "covered_by_observation").otherwise("uncovered_material_like")
    columns = [key, "source", "action", "family", "start", "end_"]
    return flags.select(*columns, status.alias("status")).union(found.where("source <> 'english_action_keyword'").select(*columns, plain.alias("status")))


def cover(framed: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """The text cut into covered and open intervals: key, start, end_, covered. Steps and observations are merged where they overlap or touch."""
    # a text's end is a row without an end of its own, behind all spans, so one shuffle brings all together
    ends = texts.where(F.length(text) > 0).select(key, F.length(text).alias("start"), F.lit(None).cast("int").alias("end_"))
    rows = framed.where("kind <> 'unparsed'").select(key, "start", "end_").union(ends)
    order = Window.partitionBy(key).orderBy("start", F.col("end_").isNull(), "end_")
    reach = rows.withColumn("reach", F.max("end_").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    cuts = reach.where("reach is null or start > reach or end_ is null").withColumn("reach", F.coalesce("reach", F.lit(0)))
    cuts = cuts.withColumn("until", F.lead("reach").over(order))
    part = lambda when, start, end, covered: F.when(when, F.struct(F.col(start).alias("start"), F.col(end).alias("end_"), F.lit(covered).alias("covered")))
    parts = F.array_compact(F.array(part(F.col("start") > F.col("reach"), "reach", "start", False), part(F.col("end_").isNotNull(), "start", "until", True)))
    return cuts.select(key, F.explode(parts).alias("p")).select(key, "p.*")


def reaction_facts(framed: DataFrame, key: str) -> DataFrame:
    """What the steps of each text tell of a reaction: key, place, role, raw, confidence, accepted.

    Up to the first step of a work-up, what is charged is a reactant, what is added a reagent (a step that names no material
    means the latest one named before, less surely), heating and cooling give the temperature, stirring the time. Materials
    of work-up steps are rejected reagents.
    """
    steps = framed.where("kind = 'step'")
    order = Window.partitionBy(key).orderBy("place")
    late = F.min(F.when(F.col("family").isin(WORKUP), F.col("place"))).over(Window.partitionBy(key))
    before = F.last("material", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = steps.withColumn("late", late).withColumn("referent", before)
    early = F.coalesce(F.col("place") < F.col("late"), F.lit(True))
    fact = lambda when, role, raw, sure, accepted=True: F.when(when & raw.isNotNull(), F.struct(F.lit(role).alias("role"), raw.alias("raw"), sure.alias("confidence"), F.lit(accepted).alias("accepted")))
    family, own = F.col("family"), F.col("material")
    text = lambda c: F.col(c).cast("string")
    found = F.array_compact(F.array(
        fact(early & (family == "charge"), "reactant", own, F.lit(SURE)), fact(early & (family == "add"), "reagent", F.coalesce(own, "referent"), F.when(own.isNotNull(), SURE).otherwise(CARRIED)),
        fact(early & family.isin("heat", "cool"), "temperature", text("temperature"), F.lit(SURE)), fact(early & (family == "hold"), "time", text("minutes"), F.lit(SURE)),
        fact(family.isin(WORKUP), "reagent", own, F.lit(SURE), False),
    ))
    return rows.select(key, "place", F.explode(found).alias("f")).select(key, "place", "f.*")


def reaction_candidates(framed: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """One row a text that tells of any fact: key, reactants, reagents, temperature, time, product, rejected, confidence, status.

    Of several temperatures and times the surest counts, then the first. A candidate needs a reactant and a reagent or condition, and a
    product that the text names (`product_required` without one, `insufficient` where there is no such skeleton). confidence
    is the mean of the facts that count. Lists are in order, each name once.
    """
    facts = reaction_facts(framed, key)
    one = lambda role: F.col("accepted") & (F.col("role") == role)
    listed = lambda when: F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("place", "raw")))), lambda x: x["raw"])), "+")
    best = lambda role: F.max(F.when(one(role), F.struct("confidence", (-F.col("place")).alias("p"), "raw")))["raw"]
    condition = lambda role: F.max(F.when(one(role), F.col("confidence")))
    sums = facts.groupBy(key).agg(
        listed(one("reactant")).alias("reactants"), listed(one("reagent")).alias("reagents"), best("temperature").alias("temperature"), best("time").alias("time"), listed(~F.col("accepted")).alias("rejected"),
        F.sum(F.when(one("reactant") | one("reagent"), F.col("confidence").cast("decimal(10,4)"))).alias("s"), F.count_if(one("reactant") | one("reagent")).alias("n"), condition("temperature").alias("ct"), condition("time").alias("cm"),
    )
    named = F.nullif(F.trim(F.regexp_extract(F.col(text), PRODUCT, 1)), F.lit(""))
    out = sums.join(texts.select(key, named.alias("product")), key)
    sure = F.coalesce(F.col("s").cast("double"), F.lit(0.0)) + F.coalesce("ct", F.lit(0.0)) + F.coalesce("cm", F.lit(0.0)) + F.when(F.col("product").isNotNull(), EXPLICIT).otherwise(0.0)
    n = F.col("n") + F.col("ct").isNotNull().cast("int") + F.col("cm").isNotNull().cast("int") + F.col("product").isNotNull().cast("int")
    skeleton = (F.col("reactants") != "") & ((F.col("reagents") != "") | F.col("ct").isNotNull() | F.col("cm").isNotNull())
    status = F.when(~skeleton, "insufficient").when(F.col("product").isNull(), "product_required").otherwise("candidate")
    return out.select(key, "reactants", "reagents", "temperature", "time", "product", "rejected", F.round(F.when(n > 0, sure / n), 4).alias("confidence"), status.alias("status"))
