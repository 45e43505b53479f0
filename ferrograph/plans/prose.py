"""Prose over the supplied tables: procedures and findings put together from a few phrases and the tables' numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import prose
from ..tables import table
from .registry import query

PHRASES = [
    "The flask was charged with NaCl", "Water was added and the mixture was stirred", "It was heated, then cooled", "The solution turned yellow after adding NaOH", "A precipitate formed, clean by NMR",
    "The layers were extracted and washed", "Bubbles appeared while it was heated", "Nothing of note", "The crude was purified; single spot", "Dried over MgSO4 and concentrated", "Color changed to deep red when cooled", "Starting material remains, low conversion",
]
UNITS = ["mL", "g", "mmol", "min", "drops"]
SQL = f"(select p_partkey, p_size, list_extract({PHRASES!r}, (p_partkey % 12 + 1)::int) || ' (' || p_size || ' ' || list_extract({UNITS!r}, (p_partkey % 5 + 1)::int) || '). ' || list_extract({PHRASES!r}, (p_partkey * 5 % 12 + 1)::int) || ' for ' || (p_size * 2) || ' h at 25 °C.' as t from part)"
HIT = "regexp_extract_all({t}, '(?i)\\b{p}\\b')"


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def told(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    t = F.concat(pick(PHRASES, k), F.lit(" ("), size, F.lit(" "), pick(UNITS, k), F.lit("). "), pick(PHRASES, k * 5), F.lit(" for "), size * 2, F.lit(" h at 25 °C."))
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", t.alias("t"))


KNOWN = ["add", "heat", "cool", "hold", "wash", "extract"]
_rows = " union all ".join(
    [f"select p_partkey, 'english_action_keyword' as source, '{a}' as action, '{f}' as family, len({HIT.format(t='t', p=p)}) as n, '{'covered_by_step' if f in KNOWN else 'uncovered_action_like'}' as status from t" for a, (f, p) in prose.ACTIONS.items()]
    + [f"select p_partkey, 'observation_keyword', '', '', len({HIT.format(t='t', p=prose.OBSERVATION)}), 'covered_by_observation' from t", f"select p_partkey, 'material_like', '', '', len(regexp_extract_all(t, '\\b{prose.MATERIAL}\\b')), 'uncovered_material_like' from t"]
)


@query(f"with t as {SQL}, r as (select * from ({_rows}) where n > 0) select p_partkey, source, action, family, n::int as n, status from r union all select p_partkey, 'narrative', '', '', 1, 'ignored_narrative' from t where p_partkey not in (select p_partkey from r)")
def action_ledger(spark, sf_dir):
    """What of a text is covered by steps and observations, and what is not."""
    return prose.ledger(told(spark, sf_dir), "p_partkey", "t", KNOWN)


_unit = " ".join(f"when u in ({', '.join(repr(x) for x in names)}) then '{kind}'" for kind, names in prose.UNITS.items())
_number = r"(?:^|[^A-Za-z0-9.])([+-]?[0-9]+(?:\.[0-9]+)?)\s+([A-Za-z°%]+)"


@query(f"with t as {SQL}, q as (select p_partkey, unnest(regexp_extract_all(t, '{_number}', 1)) as v, unnest(regexp_extract_all(t, '{_number}', 2)) as u from t) select p_partkey, case {_unit} else 'unknown' end as class, count(*) as n, min(v::double) as least, max(v::double) as greatest from q group by 1, 2")
def quantity_mentions(spark, sf_dir):
    """Quantities in texts by class of their unit."""
    return prose.quantities(told(spark, sf_dir), "p_partkey", "t")


_first = ", ".join(f"case when regexp_matches(s, '(?i)\\b{p}\\b') then {{'at': length(regexp_extract(s, '(?i)^(.*?)\\b{p}\\b', 1)), 'family': '{f}'}} end" for f, p in prose.ACTIONS.values())


@query(f"""
with t as {SQL}, c as (select p_partkey, regexp_split_to_array(regexp_replace(t, '([.!?])\\s+', '\\1\n', 'g'), '\n') as ss from t), e as (select p_partkey, unnest(ss) as s, unnest(range(len(ss)))::int as place from c),
f as (select p_partkey, place, list_min(list_filter([{_first}], lambda x: x is not null)) as m from e where trim(s) <> '')
select p_partkey, place, coalesce(m.family, 'observe') as family, case when m is null then 0.35 else 0.8 end::double as confidence from f""")
def procedure_steps(spark, sf_dir):
    """Sentences as steps of a family; observe, of little confidence, where none is told."""
    return prose.steps(told(spark, sf_dir), "p_partkey", "t")


@query(f"""
with t as {SQL}, l as (select p_partkey, lower(t) as l from t), e as (select p_partkey, case when contains(l, 'color') or contains(l, 'colour') or regexp_matches(l, '\\b(deep\\s+red|red|yellow)\\b') and regexp_matches(l, '\\b(turn(ed)?|became|becomes|changed?|colour|color)\\b') then 'color_change' when contains(l, 'precipitat') then 'precipitation' when contains(l, 'gas') or contains(l, 'bubble') then 'gas_evolution' end as event_type,
  case when contains(l, 'after add') then 'add' when contains(l, 'heated') or contains(l, 'warming') then 'heat' when contains(l, 'cooled') or contains(l, 'cooling') then 'cool' end as linked_family, case when contains(l, 'deep red') then 'deep_red' when contains(l, 'yellow') then 'yellow' end as value from l)
select *, case when event_type is null then 0.4 else 0.78 end::double as confidence from e""")
def observations(spark, sf_dir):
    """What texts tell of having been seen."""
    return told(spark, sf_dir).select("p_partkey", *[c.alias(n) for n, c in prose.observed(F.col("t")).items()])


_find = lambda terms: "coalesce(" + ", ".join(f"case when contains(l, '{x}') then '{x}' end" for x in terms) + ")"


@query(f"with t as {SQL}, l as (select p_partkey, lower(t) as l from t), s as (select *, {_find(prose.NEGATIVE)} as n, {_find(prose.POSITIVE)} as p from l) select p_partkey, case when n is not null then 'weakens' when p is not null and p_partkey % 2 = 0 and (contains(l, 'nmr') or contains(l, 'ms') or contains(l, 'spectrum')) then 'identifies' when p is not null then 'supports' end as kind, coalesce(n, p) as signal from s")
def evidence_polarity(spark, sf_dir):
    """Which way a text's evidence points, and by which term."""
    return told(spark, sf_dir).select("p_partkey", *[c.alias(n) for n, c in prose.polarity(F.col("t"), F.col("p_partkey") % 2 == 0).items()])


@query(f"""
with t as {SQL}, b as (select p_partkey, p_partkey % 9 = 0 as conflict, case when p_partkey % 4 = 0 then null when p_size > 40 or regexp_matches(t, '(?i)isolated') then 'isolated' when regexp_matches(t, '(?i)\\bnmr\\b') then 'nmr' when regexp_matches(t, '(?i)\\blc[-\\s]?ms\\b') then 'lcms' when regexp_matches(t, '(?i)crude') then 'crude' else 'unknown' end as basis from t)
select p_partkey, coalesce(basis, 'not_reported') as basis, case when basis is null then 'unknown' when conflict then 'estimated' when basis in ('isolated', 'nmr', 'lcms') then 'confirmed' else 'estimated' end as confidence from b""")
def yield_bases(spark, sf_dir):
    """What reported yields rest on, and how far to trust them."""
    k = F.col("p_partkey")
    basis = prose.yield_basis(F.col("t"), F.when(k % 4 != 0, 50.0), F.when(F.col("p_size") > 40, 1.0))
    return told(spark, sf_dir).select("p_partkey", basis.alias("basis"), prose.yield_confidence(basis, k % 9 == 0).alias("confidence"))


@query("""
with c as (select o_custkey, count_if(o_orderstatus = 'P') as bad, count(distinct o_orderpriority) - 1 as changed, max(o_totalprice) > 150000 as confirmed, count(*) = 1 as single from orders group by 1)
select o_custkey, case when bad > 4 then 'failure_diagnosis' when changed > 3 then 'optimization' when confirmed then 'characterization' when single then 'synthesis' else 'baseline_observation' end as intent from c""")
def intents(spark, sf_dir):
    """Why a customer's orders were made."""
    c = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "P").alias("bad"), F.count_distinct("o_orderpriority").alias("n"), F.max("o_totalprice").alias("best"), F.count("*").alias("all"))
    return c.select("o_custkey", prose.intent(F.col("bad") > 4, F.greatest(F.col("n") - 4, F.lit(0)), F.col("best") > 150000, F.col("all") == 1).alias("intent"))


@query("""
select p_partkey, case when p_partkey % 2 = 0 then p_size / 10.0::double end as shift, case when p_partkey % 2 = 1 then p_size / 10.0::double end as min_shift, case when p_partkey % 2 = 1 then (p_size + 3) / 10.0::double end as max_shift,
  case p_partkey % 3 when 0 then 's' when 1 then 'd' else 'm' end as multiplicity, case when p_partkey % 3 = 1 then 'J = 8.' || (p_size % 10) || ' Hz' end as coupling, (p_partkey % 4 + 1) || 'H' as integration from part""")
def nmr_peaks(spark, sf_dir):
    """Peaks written as text, read again."""
    k, size = F.col("p_partkey"), F.col("p_size")
    number = lambda x: F.format_string("%.1f", x / 10)
    raw = F.concat(F.when(k % 2 == 0, number(size)).otherwise(F.concat(number(size + 3), F.lit(" - "), number(size))), F.lit(" ("), pick(["s", "d", "m"], k), F.when(k % 3 == 1, F.concat(F.lit(", J = 8."), size % 10, F.lit(" Hz"))).otherwise(""), F.lit(", "), k % 4 + 1, F.lit("H)"))
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for n, c in prose.nmr_peak(raw).items()])


@query("select p_partkey, p_size + 0.5::double as mz, case when p_partkey % 3 > 0 then '[M+H]+' end as adduct, case when p_partkey % 3 = 2 then p_name end as component from part")
def mass_ions(spark, sf_dir):
    k = F.col("p_partkey")
    raw = F.concat(F.lit("m/z "), "p_size", F.lit(".5"), F.when(k % 3 > 0, F.concat(F.lit(" ([M+H]+"), F.when(k % 3 == 2, F.concat(F.lit(", "), "p_name")).otherwise(""), F.lit(")"))).otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for n, c in prose.mass_ion(raw).items()])


@query("select p_partkey, p_size + 0.25::double as retention, case when p_partkey % 2 = 0 then 'min' else 's' end as unit, case when p_partkey % 3 > 0 then p_size::double end as area, case when p_partkey % 3 = 2 then p_name end as component from part")
def chromatography_peaks(spark, sf_dir):
    k = F.col("p_partkey")
    raw = F.concat("p_size", F.lit(".25 "), pick(["min", "S"], k), F.when(k % 3 > 0, F.concat(F.lit(" ("), "p_size", F.lit(" %"), F.when(k % 3 == 2, F.concat(F.lit(", "), "p_name")).otherwise(""), F.lit(")"))).otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for n, c in prose.chromatography_peak(raw).items()])


@query("select p_partkey, case p_partkey % 4 when 0 then '' when 1 then '2' when 2 then '1,2' else '1,2,3' end as changed from part")
def changed_centers(spark, sf_dir):
    """Atoms that a mapped reaction changes."""
    said = pick(["[CH3:1][OH:2]>>[CH3:1][OH:2]", "[CH3:1][OH:2]>>[CH3:1][O-:2]", "[CH3:1][OH:2]>>[CH2:1][O:2]", "[CH3:1].[OH:2]>>[CH2:1][O:2][Na:3]"], F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(prose.changed_atoms(said), lambda x: x.cast("string")), ",").alias("changed"))


@query("""
select l_orderkey, l_linenumber, case when l_returnflag = 'A' then l_quantity + 5 end as plus, case when l_returnflag = 'A' then 'g' end as plus_unit, l_quantity * 2 as twice, round(l_quantity / nullif(l_linenumber % 3, 0), 9) as part, case when l_linenumber % 3 <> 0 then case when l_returnflag = 'A' then 'g' else 'mL' end end as part_unit from lineitem""")
def quantity_arithmetic(spark, sf_dir):
    """Sums of one unit, and multiples and parts of quantities; null where units differ or the divisor is 0."""
    q, unit = F.col("l_quantity"), F.when(F.col("l_returnflag") == "A", "g").otherwise("mL")
    (plus, plus_unit), (twice, _), (share, part_unit) = prose.arithmetic("+", q, unit, F.lit(5.0), F.lit("g")), prose.arithmetic("*", q, unit, F.lit(2.0)), prose.arithmetic("/", q, unit, (F.col("l_linenumber") % 3).cast("double"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", plus.alias("plus"), plus_unit.alias("plus_unit"), twice.alias("twice"), F.round(share, 9).alias("part"), part_unit.alias("part_unit"))


@query("""
select p_partkey, case p_partkey % 3 when 0 then 'THF' when 1 then 'water' end as solvent, case when p_size % 2 = 0 then 'Pd/C' end as catalyst, case when p_size % 3 = 0 then 'N2' end as atmosphere, p_size || ' °C' as temperature, case when p_size % 5 > 0 then (p_size % 5) || ' h' end as time, 'NaH' || case when p_partkey % 3 = 2 then '+LiCl' else '' end as reagents from part""")
def reaction_conditions(spark, sf_dir):
    """Conditions written as a list, told apart."""
    k, size = F.col("p_partkey"), F.col("p_size")
    said = F.concat_ws(", ", F.lit("NaH"), F.when(size % 2 == 0, F.lit("Pd/C")), pick(["THF", "water", "LiCl"], k), F.concat(size, F.lit(" °C")), F.when(size % 3 == 0, F.lit("N2")), F.when(size % 5 > 0, F.concat(size % 5, F.lit(" h"))))
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for n, c in prose.conditions(said).items()])


@query("""
with s as (select o_orderkey, lane, spot, place from (select o_orderkey, unnest(['std1', 'std2', 'mix']) as lane, unnest([['a', case when o_orderkey % 2 = 0 then 'b' else 'c' end], [case when o_orderkey % 3 = 0 then 'b' else 'd' end], ['b', 'd', 'x']]) as ss from orders), unnest(ss) with ordinality u(spot, n), (select 1) z(place0), lateral (select (n - 1)::int as place) p),
k as (select o_orderkey, spot, min(lane) as standard from s where lane like 'std%' group by 1, 2 having count(distinct lane) = 1)
select s.o_orderkey, lane, s.spot, place, standard from s left join k on k.o_orderkey = s.o_orderkey and k.spot = s.spot""")
def plate_lanes(spark, sf_dir):
    """Spots of plates, with the one standard that has them."""
    k = F.col("o_orderkey")
    said = F.concat(F.lit("std1:a,"), F.when(k % 2 == 0, "b").otherwise("c"), F.lit("; std2:"), F.when(k % 3 == 0, "b").otherwise("d"), F.lit("; mix:b,d,x"))
    return prose.lanes(table(spark, sf_dir, "orders").select("o_orderkey", said.alias("t")), "o_orderkey", "t")
