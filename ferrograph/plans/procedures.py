"""Procedures of orders: a sentence a line, of varied and broken build, lowered to steps with spans and parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import procedures
from ..operators.prose import ACTIONS, MATERIAL, OBSERVATION
from ..tables import stash, table
from .registry import query

#: Sentences as pieces: text, and for a frame its kind, family, temperature, minutes, amount, unit, repeats, material; {q} and {t} are numbers of the line.
SENTENCES = [
    [("The flask was charged with NaCl ({q} g) and water ({q} mL)", "step", "charge", None, None, "{q}", "g", None, "NaCl"), (".",)],
    [("Water was added", "step", "add"), (" and ",), ("the mixture was stirred for {q} min at 25 °C", "step", "hold", "25", "{q}"), (".",)],
    [("It was heated to {t} °C", "step", "heat", "{t}"), (", then ",), ("cooled to -5.5 °C", "step", "cool", "-5.5"), ("!",)],
    [("The layers were extracted with EtOAc (3 x {q} mL)", "step", "extract", None, None, "{q}", "mL", "3", "EtOAc"), (".",)],
    [("The organic phase was washed twice with brine", "step", "wash", None, None, None, None, "2", "brine"), (", ",), ("dried over MgSO4", "step", "dry", None, None, None, None, None, "MgSO4"), (", ",), ("filtered", "step", "filter"), (" and ",), ("concentrated", "step", "concentrate"), (".",)],
    [("A yellow precipitate formed (ca. {q} mg)", "observation"), (".",)],
    [("Nothing of note happened, e.g. no change", "unparsed", "observe"), ("?",)],
    [("The crude was purified by chromatography (silica, stirred slowly)", "step", "purify"), (".",)],
    [("It was stirred overnight", "step", "hold", None, "960"), ("; ",), ("warmed to room temperature", "step", "heat", "25"), (" and ",), ("quenched with HCl", "step", "quench", None, None, None, None, None, "HCl"), (".",)],
    [("ADDED", "step", "add"), (" ,, .",)],
    [("Heating at {t}.5 °C for 1.5 h gave no product", "step", "heat", "{t}.5", "90"), (".",)],
    [("NaBH4 was added portionwise, and then, after {q} min", "step", "add", None, "{q}"), (", ",), ("extracted 4 times", "step", "extract", None, None, None, None, "4"), (".",)],
    [("It afforded the ester no {q}", "unparsed", "observe"), (".",)],
]
KNOWN = [f for f in dict.fromkeys(f for f, _ in ACTIONS.values()) if f not in ("dry", "filter", "cool")]


def told(spark, sf_dir):
    """Each order's procedure; every 50th has none, every 51st a blank one."""
    q = F.col("l_quantity").cast("int").alias("q")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", q))).alias("ls"))

    def line(x):
        """A line's sentence, written behind the shuffle."""
        text = F.element_at(F.array(*[F.lit("".join(p[0] for p in s)) for s in SENTENCES]), (x["l_suppkey"] % len(SENTENCES) + 1).cast("int"))
        return F.replace(F.replace(text, F.lit("{q}"), x["q"].cast("string")), F.lit("{t}"), (x["q"] + 40).cast("string"))

    told = F.array_join(F.transform("ls", line), " ")
    return rows.select("key", F.when(F.col("key") % 50 == 0, F.lit(None)).when(F.col("key") % 51 == 0, F.lit(" \n ")).otherwise(told).alias("t"))


def _value(x: str | None) -> str:
    return "null" if x is None else f"'{x}'"


_pieces = ", ".join(f"({i}, {k}, '{p[0]}', {', '.join(_value(p[j] if j < len(p) else None) for j in range(1, 9))})" for i, s in enumerate(SENTENCES) for k, p in enumerate([*s, (" ",)]))
_fill = lambda c: f"replace(replace({c}, '{{q}}', q::varchar), '{{t}}', (q + 40)::varchar)"
PIECES = f"""
pieces(tpl, k, text, kind, family, temperature, minutes, amount, unit, repeats, material) as (values {_pieces}),
l as (select l_orderkey as key, l_suppkey % {len(SENTENCES)} as tpl, l_quantity::int as q, row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey, l_quantity::int) as n from lineitem where l_orderkey % 50 <> 0 and l_orderkey % 51 <> 0),
p as (select key, n, k, {_fill('text')} as text, kind, family, {_fill('temperature')}::double as temperature, {_fill('minutes')}::double as minutes, {_fill('amount')}::double as amount, unit, repeats::int as repeats, material from l join pieces using (tpl)),
s as materialized (select *, (sum(length(text)) over (partition by key order by n, k))::int as end_ from p),
fr as materialized (select key, (row_number() over (partition by key order by end_) - 1)::int as place, kind, family, end_ - length(text)::int as start, end_, temperature, minutes, amount, unit, repeats, material from s where kind is not null)"""


@query(f"with {PIECES} select *, case kind when 'step' then 0.84 when 'observation' then 0.78 else 0.35 end::double as confidence, case kind when 'unparsed' then 'W805' end as diagnostic from fr")
def procedure_frames(spark, sf_dir):
    """Steps, observations and the rest of every order's procedure, with spans and parameters."""
    return procedures.lowered(told(spark, sf_dir), "key", "t")


_action = " ".join(f"when regexp_full_match(w, '(?i){p}') then {{}}{name}{{}}" for name, (_, p) in ACTIONS.items())
_named = _action.replace("{}", "'")
_family = "case action " + " ".join(f"when '{n}' then '{f}'" for n, (f, _) in ACTIONS.items()) + " end"
ENTRIES = rf"""
whole as (select key, string_agg(text, '' order by n, k) as t from s group by key),
tok as (select key, unnest(x) as w, generate_subscripts(x, 1) as pos from (select key, regexp_extract_all(t, '[A-Za-z0-9_]+|[^A-Za-z0-9_]') as x from whole)),
w as (select key, w, (sum(length(w)) over (partition by key order by pos))::int as end_ from tok),
f as (select key, end_ - length(w)::int as start, end_, case {_named} end as action, w from w),
e as (select key, 'english_action_keyword' as source, action, {_family} as family, start, end_ from f where action is not null
  union all select key, 'observation_keyword', null, null, start, end_ from f where regexp_full_match(w, '(?i){OBSERVATION}') union all select key, 'material_like', null, null, start, end_ from f where regexp_full_match(w, '{MATERIAL}'))"""


@query(f"""
with {PIECES}, {ENTRIES}
select key, source, action, family, start, end_, case source when 'observation_keyword' then 'covered_by_observation' when 'material_like' then 'uncovered_material_like'
  else case when st then 'covered_by_step' when ob then 'covered_by_observation' else 'uncovered_action_like' end end as status
from (select e.key, source, action, e.family, e.start, e.end_, bool_or(fr.kind = 'step' and fr.family = e.family and fr.family in ({', '.join(f"'{x}'" for x in KNOWN)})) as st, bool_or(fr.kind = 'observation') as ob
  from e left join fr on fr.key = e.key and fr.start < e.end_ and e.start < fr.end_ group by 1, 2, 3, 4, 5, 6)""")
def procedure_coverage(spark, sf_dir):
    """What looks like an action, an observation or a material, and whether a step or observation covers it; steps of three families are not known."""
    texts = stash(told(spark, sf_dir), "told")
    return procedures.coverage(procedures.entries(texts, "key", "t"), procedures.lowered(texts, "key", "t", KNOWN), "key")


@query(f"""
with {PIECES}, c as (select key, start, end_ from fr where kind <> 'unparsed'), z as (select l_orderkey as key, case when l_orderkey % 51 = 0 then 3 end as n from lineitem where l_orderkey % 50 <> 0 group by 1, 2),
len as (select z.key, coalesce(z.n, (select max(end_) - 1 from s where s.key = z.key)) as n from z),
o as (select key, 0 as start, coalesce((select min(start) from c where c.key = len.key), n) as end_ from len union all select c.key, c.end_, coalesce(lead(c.start) over (partition by c.key order by c.start), n) from c join len using (key))
select key, start, end_, true as covered from c union all select key, start, end_::int, false from o where start < end_""")
def procedure_gaps(spark, sf_dir):
    """Every procedure cut into what frames cover and what they leave open."""
    texts = stash(told(spark, sf_dir), "told")
    return procedures.cover(procedures.lowered(texts, "key", "t"), texts, "key", "t")


_workup = ", ".join(f"'{f}'" for f in procedures.WORKUP)


@query(f"""
with {PIECES},
st as (select *, min(case when family in ({_workup}) then place end) over (partition by key) as late, last_value(material ignore nulls) over (partition by key order by place rows between unbounded preceding and 1 preceding) as ref_ from fr where kind = 'step'),
fa as (select key, place, 'reactant' as role, material as raw, 0.84 as c, true as ok from st where coalesce(place < late, true) and family = 'charge'
  union all select key, place, 'reagent', coalesce(material, ref_), case when material is null then 0.67 else 0.84 end, true from st where coalesce(place < late, true) and family = 'add'
  union all select key, place, 'temperature', temperature::varchar, 0.84, true from st where coalesce(place < late, true) and family in ('heat', 'cool')
  union all select key, place, 'time', minutes::varchar, 0.84, true from st where coalesce(place < late, true) and family = 'hold' union all select key, place, 'reagent', material, 0.84, false from st where family in ({_workup})),
fb as (select * from fa where raw is not null),
fd as (select key, role, ok, raw, min(place) as place from fb group by all),
g as (select key, coalesce((select string_agg(raw, '+' order by place) from fd where fd.key = fb.key and role = 'reactant'), '') as reactants, coalesce((select string_agg(raw, '+' order by place) from fd where fd.key = fb.key and role = 'reagent' and ok), '') as reagents,
  arg_min(raw, place) filter (where role = 'temperature') as temperature, arg_min(raw, place) filter (where role = 'time') as time, coalesce((select string_agg(raw, '+' order by place) from fd where fd.key = fb.key and not ok), '') as rejected,
  coalesce(sum(c) filter (where ok and role in ('reactant', 'reagent')), 0) + 0.84 * (count(*) filter (where role = 'temperature') > 0)::int + 0.84 * (count(*) filter (where role = 'time') > 0)::int as sure,
  count(*) filter (where ok and role in ('reactant', 'reagent')) + (count(*) filter (where role = 'temperature') > 0)::int + (count(*) filter (where role = 'time') > 0)::int as n from fb group by key),
h as (select g.*, (select regexp_extract(text, 'afforded (.*)', 1) from s where s.key = g.key and starts_with(text, 'It afforded') order by end_ limit 1) as product from g)
select key, reactants, reagents, temperature, time, product, rejected, round(case when n + (product is not null)::int > 0 then (sure + case when product is not null then 0.82 else 0 end)::double / (n + (product is not null)::int) end, 4) as confidence,
  case when reactants = '' or (reagents = '' and temperature is null and time is null) then 'insufficient' when product is null then 'product_required' else 'candidate' end as status from h""")
def reaction_candidates(spark, sf_dir):
    """What each order's procedure tells of a reaction, by role, with what it lacks."""
    texts = stash(told(spark, sf_dir), "told")
    return procedures.reaction_candidates(procedures.lowered(texts, "key", "t"), texts, "key", "t")
