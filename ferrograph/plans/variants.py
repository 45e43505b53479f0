"""Records without a schema, from the events: nested objects and arrays, keys in differing order, wrong types, broken texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import variants
from ..tables import table
from .registry import query


def records(spark, sf_dir):
    """An event's type, user, items and props as JSON: two orders of keys by turns, ids that are text, every 97th cut short."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props", k.alias("k"))
    who = F.when(F.col("k") % 11 == 0, F.concat(F.lit('"x'), "user_id", F.lit('"'))).otherwise(F.col("user_id").cast("string"))
    vip = F.when(F.col("user_id") % 3 == 0, "true").otherwise("false")
    item = lambda a, b, first: F.format_string('{"k": %d,"q":%d}' if first else '{ "q" : %d, "k" : %d}', a if first else b, b if first else a)
    items = lambda first: F.when(F.col("k") % 4 == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.col("k") % 4, F.lit(1))), lambda i: item(F.col("k") + i, i, first)), ","))
    one = F.concat(F.lit('{"type":"'), "event_type", F.lit('","user":{"id":'), who, F.lit(',"vip":'), vip, F.lit('},"items":['), items(True), F.lit('],"props":'), "props", F.lit(',"note":null}'))
    two = F.concat(F.lit('{ "note": null, "props" :'), "props", F.lit(', "items":['), items(False), F.lit('], "user":{"vip": '), vip, F.lit(', "id": '), who, F.lit('}, "type":"'), "event_type", F.lit('"}'))
    text = F.when(F.col("event_id") % 2 == 0, one).otherwise(two)
    text = F.when(F.col("event_id") % 97 == 0, F.substring(text, 1, 30)).when(F.col("event_id") % 101 == 0, F.lit(None)).otherwise(text)
    return rows.select("event_id", variants.record(text).alias("v"))


E = """
e as (select event_id, user_id, event_type, (props->>'k')::int as k, event_id % 97 <> 0 and event_id % 101 <> 0 as valid from events),
r as (select *, case when k % 11 = 0 then '"x' || user_id || '"' else user_id::varchar end as who, case when user_id % 3 = 0 then 'true' else 'false' end as vip from e),
c as (select *, case when valid then '{"items":[' || array_to_string(list_transform(range(1, k % 4 + 1), lambda i: '{"k":' || (k + i) || ',"q":' || i || '}'), ',') || '],"note":null,"props":{"k":' || k || '},"type":"' || event_type || '","user":{"id":' || who || ',"vip":' || vip || '}}' end as t from r)"""


@query(f"with {E} select event_id, t as record, sha256(t) as record_hash, case when valid then count(*) over (partition by t) end as n_same from c")
def record_hashes(spark, sf_dir):
    """Every record in one form, with its hash and how many events have an equal one."""
    rows = records(spark, sf_dir).select("event_id", variants.canonical(F.col("v")).alias("record"), variants.record_hash(F.col("v")).alias("record_hash"))
    same = rows.where("record is not null").groupBy("record_hash").agg(F.count("*").alias("n_same"))
    return rows.join(same, "record_hash", "left").select("event_id", "record", "record_hash", "n_same")


@query(f"""with {E} select event_id, case when valid and k % 11 <> 0 then user_id end as user_id, case when valid then vip = 'true' end as vip, case when valid then k end as k, case when valid and k % 4 > 1 then k + 2 end as second_item,
  case when valid then 'object' end as kind_of_props, case when valid then 'array' end as kind_of_items, case when valid then 'void' end as kind_of_note from c""")
def record_fields(spark, sf_dir):
    """Guarded access: what is missing or of another type is null."""
    v = F.col("v")
    got = lambda path, kind: variants.guarded(v, path, kind)
    inner = lambda path: variants.kind_of(F.try_variant_get(v, path, "variant"))
    return records(spark, sf_dir).select(
        "event_id", got("$.user.id", "bigint").alias("user_id"), got("$.user.vip", "boolean").alias("vip"), got("$.props.k", "int").alias("k"), got("$.items[1].k", "int").alias("second_item"),
        inner("$.props").alias("kind_of_props"), inner("$.items").alias("kind_of_items"), inner("$.note").alias("kind_of_note"),
    )


@query(f"""
with {E}, i as (select event_id, k, unnest(range(1, k % 4 + 1)) as i from c where valid)
select event_id, '$.items[' || (i - 1) || '].k' as path, (k + i)::varchar as value from i union all select event_id, '$.items[' || (i - 1) || '].q', i::varchar from i
union all select event_id, '$.note', null from c where valid union all select event_id, '$.props.k', k::varchar from c where valid union all select event_id, '$.type', event_type from c where valid
union all select event_id, '$.user.id', trim(who, '"') from c where valid union all select event_id, '$.user.vip', vip from c where valid""")
def record_leaves(spark, sf_dir):
    """All scalars of all records by their paths, whatever the nesting."""
    return variants.leaves(records(spark, sf_dir), "event_id", "v").select("event_id", "path", "value")
