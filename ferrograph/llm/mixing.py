"""Mixing sources to target weights by hierarchical budgets (operator 8): DataFrame functions only.

A budget of tokens runs down the tree domain, language, source. At each node the children share their parent's budget
by weight; a child that cannot use its share leaves the rest to its siblings, and only what all siblings together cannot
use is missing at the parent and so goes to the parent's siblings. A leaf fills its quota with whole epochs of its
documents and the token-prefix of one more epoch in a seeded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop, free_name, stash

WORD = r"[^\x20\x09-\x0D]+"
LEVELS = ["domain", "lang", "source"]


def weight_of(weights: dict[str, int], name: Column) -> Column:
    """A child's weight: a whole number, 1 where none is given."""
    found = F.lit(1)
    for k, w in weights.items():
        found = F.when(name == k, F.lit(int(w))).otherwise(found)
    return found.cast("decimal(38,0)")


def shared_out(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Children (cap, weight, and their parent's budget) with `quota`: the least of cap and the weighted share.

    In order of cap / weight, a child takes all its cap while that is within its share of what is left; the first that
    is not, and all after it, share by weight. Whole numbers throughout.
    """
    group = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = group.orderBy((F.col("cap").cast("double") / F.col("weight").cast("double")), name)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("decimal(38,0)")
    return (
        children.withColumn("left", left)
        .withColumn("rest", F.sum("weight").over(after).cast("decimal(38,0)"))
        .withColumn("place", F.row_number().over(order))
        .withColumn("short", F.expr("cap * cast(rest as decimal(18,0)) > left * cast(weight as decimal(18,0))"))
        .withColumn("first", F.min(F.when(F.col("short"), F.col("place"))).over(whole))
        .withColumn("l", F.max(F.when(F.col("place") == F.col("first"), F.col("left"))).over(whole))
        .withColumn("r", F.max(F.when(F.col("place") == F.col("first"), F.col("rest"))).over(whole))
        .withColumn("quota", F.expr("case when first is null or place < first then cap else l * cast(weight as decimal(18,0)) div r end").cast("bigint"))
        .drop("left", "rest", "place", "short", "first", "l", "r")
    )


def quotas(leaves: DataFrame, budget: Column, weights: dict[str, dict[str, int]], epochs: int) -> DataFrame:
    """Leaves (domain, lang, source, tokens) with their quotas."""
    leaves = leaves.withColumn("cap", (F.col("tokens") * epochs).cast("decimal(18,0)"))
    total = leaves.agg(F.sum("cap").alias("all"), F.sum("tokens").alias("tokens"))
    parent = total.select(F.least("all", budget.cast("decimal(18,0)")).cast("decimal(18,0)").alias("budget"))
    on: list[str] = []
    for level in LEVELS:
        nodes = leaves.groupBy(*on, level).agg(F.sum("cap").cast("decimal(18,0)").alias("cap"))
        nodes = nodes.join(parent, on) if on else nodes.crossJoin(F.broadcast(parent))
        nodes = nodes.withColumn("weight", weight_of(weights.get(level, {}), F.col(level)))
        done = shared_out(nodes, on, level)
        on = [*on, level]
        parent = done.select(*on, F.col("quota").cast("decimal(18,0)").alias("budget"))
    return leaves.join(parent.withColumnRenamed("budget", "quota"), LEVELS).select(*LEVELS, "tokens", F.col("quota").cast("bigint").alias("quota"))


def mix(docs: DataFrame, weights: dict[str, dict[str, int]], domain: Column, share: float = 0.5, epochs: int = 2, seed: int = 1, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The chosen rows of docs, with mix_epoch (1 and up) and mix_quota of their leaf; a row comes once an epoch.

    The budget is `share` of all tokens (words); a document is used at most `epochs` times; `weights` gives whole-number
    weights by level ("domain", "lang", "source") and name, 1 elsewhere. An epoch's order is that of
    md5(seed:epoch:key), then key; its prefix ends with the document that reaches the quota. Null languages, sources and
    domains are "", null texts have no tokens. Rows of one key and text are taken or left together. Columns of docs are
    kept whatever their names; mix_epoch and mix_quota get underscores until they are free.

    Only sums by leaf and by slice of a leaf's order (4096 slices) are shuffled, after partial sums; the last slice of a
    leaf alone is ordered row by row. The choice is then a comparison with one row a leaf, so texts are not shuffled.
    """
    names = {"domain": F.coalesce(domain, F.lit("")), "lang": F.coalesce(F.col(lang), F.lit("")), "source": F.coalesce(F.col(source), F.lit(""))}
    n = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")
    narrow = stash(docs.select(F.col(key).alias("k"), n.alias("n"), *(c.alias(f"mix_{x}") for x, c in names.items())), "mix")
    narrow = narrow.withColumnsRenamed({f"mix_{x}": x for x in LEVELS})
    leaves = narrow.groupBy(*LEVELS).agg(F.sum("n").alias("tokens"))
    all_tokens = leaves.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    budget = F.lit(int(all_tokens * share))
    plan = quotas(leaves, budget, weights, epochs).where("tokens > 0")
    plan = stash(plan.withColumn("full", F.expr("quota div tokens")).withColumn("part", F.expr("quota % tokens")), "quotas")

    order = lambda full, k: F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col(full) + 1).cast("string"), F.col(k).cast("string")))
    rows = narrow.where("n > 0").join(plan.where("part > 0"), LEVELS).withColumn("h", order("full", "k")).withColumn("slice", F.substring("h", 1, 3))
    slices = rows.groupBy(*LEVELS, "slice").agg(F.sum("n").alias("m"), F.first("part").alias("part"))
    upto = F.sum("m").over(Window.partitionBy(*LEVELS).orderBy("slice"))
    last = slices.withColumn("before", upto - F.col("m")).where("before < part and before + m >= part").select(*LEVELS, "slice", "before")
    sums = Window.partitionBy(*LEVELS, "slice").orderBy("h", "k").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        rows.join(last, [*LEVELS, "slice"])
        .withColumn("so_far", F.col("before") + F.coalesce(F.sum("n").over(sums), F.lit(0)))
        .where("so_far < part")
        .groupBy(*LEVELS)
        .agg(F.max(F.struct("h", "k")).alias("mix_cut"))
    )
    chosen = stash(plan.join(cut, LEVELS, "left").select(*(F.col(x).alias(f"mix_{x}") for x in LEVELS), F.col("quota").alias("mix_quota"), F.col("full").alias("mix_full"), "mix_cut"), "cuts")
    drop(narrow, plan)
    # the rows travel as one column, so that no name of theirs meets one of ours
    marked = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("k"), n.alias("mix_n"), *(c.alias(f"mix_{x}") for x, c in names.items())).where("mix_n > 0")
    taken = marked.join(chosen, [f"mix_{x}" for x in LEVELS])
    partly = F.coalesce(F.struct(order("mix_full", "k").alias("h"), "k") <= F.col("mix_cut"), F.lit(False))
    times = (F.col("mix_full") + partly.cast("bigint")).cast("int")
    epoch, quota = free_name(docs.columns, "mix_epoch"), free_name(docs.columns, "mix_quota")
    taken = taken.withColumn("mix_times", times).where("mix_times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("mix_times"))).alias("mix_epoch"), "mix_quota")
    return taken.select(*(F.col("row")[c].alias(c) for c in docs.columns), F.col("mix_epoch").alias(epoch), F.col("mix_quota").alias(quota))


# The mix of the queries: domains are four groups of sources, by the CRC of the name.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "fr": 2, "de": 2, "es": 1}}


def source_domain(source: str = "source") -> Column:
    return F.concat(F.lit("d"), (F.crc32(F.coalesce(F.col(source), F.lit(""))) % 4).cast("string"))


def _sql_level(level: str, on: list[str], above: str, cases: str) -> str:
    """DuckDB's SQL for one level: nodes, then their quotas."""
    cols, by = ", ".join([*on, level]), f"partition by {', '.join(on)}" if on else ""
    join = f"join {above} using ({', '.join(on)})" if on else f", {above}"
    return f"""
n_{level} as (select {cols}, n.cap, case {level} {cases} else 1 end::hugeint as w, budget
  from (select {cols}, sum(cap)::hugeint as cap from leaves group by {cols}) n {join}),
o_{level} as (select *, (budget - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0))::hugeint as l,
    (sum(w) over (o rows between current row and unbounded following))::hugeint as r, row_number() over (o) as place
  from n_{level} window o as ({by} order by cap::double / w::double, {level})),
f_{level} as (select *, min(case when cap * r > l * w then place end) over ({by}) as f from o_{level}),
g_{level} as (select *, max(case when place = f then l end) over ({by}) as fl, max(case when place = f then r end) over ({by}) as fr from f_{level}),
q_{level} as (select {cols}, case when f is null or place < f then cap else fl * w // fr end::hugeint as budget from g_{level})"""


def mix_sql(share: float = 0.5, epochs: int = 2, seed: int = 1) -> str:
    """DuckDB's SQL for the query's rows, with the parameters above; crc32 is not DuckDB's, so domains come from a table."""
    import zlib

    domains = ", ".join(f"('{s}', 'd{zlib.crc32(s.encode()) % 4}')" for s in ["", *(f"src{i}" for i in range(200))])
    when = lambda m: " ".join(f"when '{k}' then {v}" for k, v in m.items()) or "when '' then 1"
    levels = ",".join(_sql_level(x, LEVELS[:i], "top" if not i else f"q_{LEVELS[i - 1]}", when(WEIGHTS.get(x, {}))) for i, x in enumerate(LEVELS))
    return rf"""
with d as (select doc_id as k, dom.v as domain, coalesce(lang, '') as lang, coalesce(source, '') as source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as n
  from documents join (values {domains}) dom(s, v) on dom.s = coalesce(source, '')),
leaves as (select domain, lang, source, sum(n)::hugeint as tokens, (sum(n) * {epochs})::hugeint as cap from d group by all),
top as (select least(sum(cap), floor(sum(tokens)::double * {share})::hugeint)::hugeint as budget from leaves),
{levels},
plan as (select l.*, budget as quota, budget // tokens as full_, budget % tokens as part from leaves l join q_source using (domain, lang, source) where tokens > 0),
r as (select d.*, quota, full_, part, md5('{seed}:' || (full_ + 1) || ':' || k) as h from d join plan using (domain, lang, source) where n > 0),
c as (select *, sum(n) over (partition by domain, lang, source order by h, k) - n as before from r),
t as (select *, full_ + (part > 0 and before < part)::int as times from c)
select k as doc_id, lang, source, n::bigint as n_words, e::int as mix_epoch, quota::bigint as mix_quota
from (select *, unnest(range(1, times::bigint + 1)) as e from t where times > 0)
"""
