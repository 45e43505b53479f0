"""Centres of mapped reactions, built from orders: lines are atoms and bonds, their flags what becomes of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import centers
from ..tables import table
from .registry import query


def reactions(spark, sf_dir):
    """A structure an order: atoms in line order, every third a branch, rings in even orders; behind the sign, bonds are broken or changed by the lines' flags."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.pmod("l_suppkey", F.lit(4)).alias("e"), F.pmod(F.col("l_quantity").cast("int"), F.lit(4)).alias("q"), "l_returnflag")
    last = F.struct("l_linenumber", "e", "q", "l_returnflag")
    rows = lines.groupBy(F.col("l_orderkey").alias("key")).agg(F.array_sort(F.collect_list(last)).alias("ls")).withColumn("n", F.size("ls"))
    pick = lambda words, i: F.element_at(F.array(*[F.lit(w) for w in words]), (i + 1).cast("int"))
    main_end = F.expr("case when n % 3 = 0 then n - 1 else n end")

    def side(product: bool):
        ring = F.col("key") % (3 if product else 2) == 0

        def piece(line, i):
            place = i + 1
            atom = F.concat(F.lit("["), pick(["C", "N", "Cl", "OH"], line["e"]), F.lit(":"), place.cast("string"), F.lit("]"))
            bond = pick(["", "=", "#", ":"], F.pmod(line["q"] + 1, F.lit(4)) if product else line["q"])
            bond = F.when(line["l_returnflag"] == "A", bond).otherwise(pick(["", "=", "#", ":"], line["q"])) if product else bond
            broken = (line["l_returnflag"] == "R") & F.lit(product)
            closes = F.when(ring & (F.col("n") >= 4) & ((place == 1) | (place == main_end)), "1").otherwise("")
            inner = F.concat(bond, atom, closes)
            return F.when(place == 1, F.concat(atom, closes)).when(place % 3 == 0, F.when(broken, "").otherwise(F.concat(F.lit("("), inner, F.lit(")")))).when(broken, F.concat(F.lit("."), atom, closes)).otherwise(inner)

        cut = F.transform("ls", lambda line, i: F.when(((i + 1) % 3 == 0) & (line["l_returnflag"] == "R") & F.lit(product), F.concat(F.lit(".["), pick(["C", "N", "Cl", "OH"], line["e"]), F.lit(":"), (i + 1).cast("string"), F.lit("]"))).otherwise(""))
        return F.concat(F.array_join(F.transform("ls", piece), ""), F.array_join(cut, ""))

    text = F.when(F.col("key") % 97 == 0, F.lit("C>>")).when(F.col("key") % 89 == 0, F.concat(side(False), F.lit(">>[C:1"))).otherwise(F.concat(side(False), F.lit(">[Na+]>"), side(True)))
    given = F.when(F.col("key") % 7 != 0, F.col("key") % 100 / 100)
    return rows.select("key", text.alias("reaction"), given.alias("given"))


SQL = """
l as (select l_orderkey as key, row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey % 4, l_quantity::int % 4, l_returnflag) as i, l_suppkey % 4 as e, l_quantity::int % 4 as q, l_returnflag as f, count(*) over (partition by l_orderkey) as n from lineitem),
at_ as (select key, i, ['C', 'N', 'Cl', 'O'][e + 1] as s from l),
o as (select key, case when (i - 1) % 3 = 0 and i > 1 then i - 2 else i - 1 end as a, i as b, ['single', 'double', 'triple', 'aromatic'][q + 1] as was, case f when 'R' then null when 'A' then ['single', 'double', 'triple', 'aromatic'][(q + 1) % 4 + 1] else ['single', 'double', 'triple', 'aromatic'][q + 1] end as now_ from l where i > 1
  union all select key, 1, case when n % 3 = 0 then n - 1 else n end, case when key % 2 = 0 then 'single' end, case when key % 3 = 0 then 'single' end from (select distinct key, n from l) where n >= 4),
c as (select o.*, x.s as sa, y.s as sb, case when was is null then 'formed' when now_ is null then 'broken' else 'changed' end as kind, case when was is null then now_ when now_ is null then was else was || '->' || now_ end as ord
  from o join at_ x on x.key = o.key and x.i = a join at_ y on y.key = o.key and y.i = b where was is distinct from now_ and o.key % 97 <> 0 and o.key % 89 <> 0),
g as (select key, 'bonds:' || string_agg(kind || ':' || least(sa, sb) || '-' || greatest(sa, sb) || ':' || ord, '|' order by kind || ':' || least(sa, sb) || '-' || greatest(sa, sb) || ':' || ord) as sig,
  string_agg(kind || ':' || sa || a || '-' || sb || b || ':' || ord, '|' order by a, b) as bonds, list(a) as xs, list(b) as ys from c group by key),
w as (select k.key, coalesce(sig, 'unresolved') as center_signature, coalesce(bonds, '') as changed_bonds, coalesce((select string_agg(s || i, '+' order by i) from at_ where at_.key = k.key and (list_contains(xs, i) or list_contains(ys, i))), '') as changed_atoms,
  case when k.key % 97 = 0 then 'mapped_reaction_missing_reactants_or_products' when k.key % 89 = 0 then 'mapped_reaction_has_unclosed_atom'
    else concat_ws('+', case when sig is null then 'reaction_center_not_reliably_detected' end, case when k.key % 7 = 0 then 'mapping_confidence_missing' when k.key % 100 < 65 then 'low_mapping_confidence' end) end as warnings from (select distinct key from l) k left join g using (key)),
z as materialized (select key, center_signature, changed_bonds, changed_atoms, case when warnings <> '' then 'low' when key % 100 >= 90 then 'high' else 'medium' end as confidence, warnings from w)"""


@query(f"with {SQL} select * from z")
def mapped_centers(spark, sf_dir):
    """The centre of every order's reaction."""
    found = centers.reaction_centers(reactions(spark, sf_dir), F.col("reaction"), F.col("given"))
    return found.select("key", "center_signature", F.array_join("changed_bonds", "|").alias("changed_bonds"), F.array_join("changed_atoms", "+").alias("changed_atoms"), "confidence", F.array_join("warnings", "+").alias("warnings"))


@query(f"""
with {SQL}, u as (select *, list_sort(list_distinct(list_transform(string_split(changed_atoms, '+'), lambda x: regexp_replace(x, '[0-9]', '', 'g')))) as el from z where center_signature <> 'unresolved')
select key, center_signature, confidence, min(key) over (partition by center_signature) as class_id, count(*) over (partition by center_signature) as n_same, min(key) over (partition by el) as group_id, count(*) over (partition by el) as n_compatible from u""")
def mapped_center_links(spark, sf_dir):
    """Reactions of the same centre, and of compatible ones."""
    found = centers.reaction_centers(reactions(spark, sf_dir), F.col("reaction"), F.col("given"))
    return centers.center_classes(found, "key")
