"""The prefix trie of conversations (operator 12).

Turns are numbered by a distributed rank, so no conversation is one task's work. Equal conversations are folded into
classes. Then the trie grows level by level: the live classes, those that share their node with another class, are grouped
by (parent node, next turn), and the least conv_id names the node. A class alone in its node leaves the loop, for the
rest of its path is known: it is a chain of its own turns. Reverse level-by-level joins then roll leaves and savings up.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop, shared_dir, stash

#: Levels whose turns are read in one pass over the turns of live classes.
WINDOW = 8
#: Characters of one piece of a list of ids that is hashed.
PIECE = 8192


def placed(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Turns (c, i, dig, nb, cum) and conversations (c, n, b).

    i counts a conversation's turns from 1, by turn (null first; equal turns by the digest of role and text, so repeated
    rows are turns each); dig is a digest of role and text (null: empty), nb the UTF-8 bytes of text, cum their sum so
    far; n and b are the conversation's last i and cum. Rows without a key belong to no conversation.

    Rows are sorted by ranges of (key, turn) and numbered where they lie; only a conversation that crosses the border
    of two ranges gets a carry, so there are at most two a range, and they go through the driver.
    """
    said = [F.coalesce(F.col(c), F.lit("")) for c in (role, text)]
    dig = F.unhex(F.md5(F.concat(F.length(said[0]).cast("string"), F.lit(":"), *said)))
    rows = turns.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("c"), F.col(turn).alias("turn"), dig.alias("dig"), F.octet_length(said[1]).cast("bigint").alias("nb"))
    order = ["c", F.col("turn").asc_nulls_first(), "dig"]
    rows = rows.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order).select("c", "dig", "nb")

    def numbered(batches):
        held, j, jb = None, 0, 0  # the last row seen, which is the end of its run if another key follows
        task = TaskContext.get().partitionId()

        def made(table: pa.Table, last: int | None):
            nonlocal j, jb
            c, nb = np.asarray(table["c"], np.int64), np.asarray(table["nb"], np.int64)
            first = np.concatenate([[True], c[1:] != c[:-1]])
            start = np.flatnonzero(first)
            run = np.cumsum(first) - 1
            place, total = np.arange(len(c)) - start[run] + 1, np.cumsum(nb)
            sums = total - (total[start] - nb[start])[run]
            if made.c == c[0]:
                place[run == 0] += j
                sums[run == 0] += jb
            made.c, j, jb = c[-1], int(place[-1]), int(sums[-1])
            end = np.append(c[1:] != c[:-1], last is None or last != c[-1])
            yield from pa.table([pa.array(np.full(len(c), task, np.int32)), table["c"], pa.array(place, pa.int64()), table["dig"], table["nb"], pa.array(sums, pa.int64()), pa.array(end)], ["pid", "c", "j", "dig", "nb", "jb", "end"]).to_batches()

        made.c = None
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                if held is not None:
                    table = pa.concat_tables([held, table])
                held = table.slice(table.num_rows - 1)
                if table.num_rows > 1:
                    yield from made(table.slice(0, table.num_rows - 1), held["c"][0].as_py())
        if held is not None:
            yield from made(held, None)

    found = stash(rows.mapInArrow(numbered, "pid int, c bigint, j bigint, dig binary, nb bigint, jb bigint, end boolean"), "turns")
    ends = found.where("end").groupBy("c").agg(F.sum("j").alias("n"), F.sum("jb").alias("b"), F.sort_array(F.collect_list(F.struct("pid", "j", "jb"))).alias("parts"))
    ends = stash(ends, "conversations")
    carry = []
    for r in ends.where("size(parts) > 1").select("c", "parts").collect():
        j = jb = 0
        for p in r["parts"]:
            carry.append((r["c"], p["pid"], j, jb))
            j, jb = j + p["j"], jb + p["jb"]
    steps = found.select("c", F.col("j").alias("i"), "dig", "nb", F.col("jb").alias("cum"))
    if carry:
        more = found.sparkSession.createDataFrame(carry, "c bigint, pid int, dj bigint, db bigint")
        more = found.join(F.broadcast(more), ["c", "pid"], "left")
        steps = more.select("c", (F.col("j") + F.coalesce("dj", F.lit(0))).alias("i"), "dig", "nb", (F.col("jb") + F.coalesce("db", F.lit(0))).alias("cum"))
    return steps, ends.select("c", "n", "b")


def rebuilt(steps: DataFrame, convs: DataFrame, base: Column, heads: Column, longest: int) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations as `placed` gives them, each conversation's first `heads` turns replaced by those of conversation `base`.

    base and heads are expressions over c, heads at most `longest`; all turns of the base if it has fewer, none if it is
    absent. A conversation may come to have no turn; it still is one.
    """
    first = steps.where(F.col("i") <= longest)
    plan = convs.select("c", base.alias("base"), heads.cast("bigint").alias("h"), "n", "b")
    given = stash(plan.join(first.withColumnRenamed("c", "base"), "base").where("i <= h").select("c", F.col("i"), "dig", "nb", "cum"), "given")
    got = given.groupBy("c").agg(F.max("i").alias("m"), F.max("cum").alias("at"))
    own = plan.select("c", "h").join(first, "c").where("i <= h").groupBy("c").agg(F.max("cum").alias("gone"))
    meta = plan.join(got, "c", "left").join(own, "c", "left").na.fill(0, ["m", "at", "gone"])
    meta = stash(meta.select("c", "h", "m", "at", "gone", F.expr("m + greatest(n - h, 0)").alias("n"), F.expr("at + if(n > h, b - gone, 0)").alias("b")), "meta")
    rest = steps.join(meta.drop("n", "b"), "c").where("i > h").select("c", F.expr("m + i - h").alias("i"), "dig", "nb", F.expr("at + cum - gone").alias("cum"))
    out = stash(given.union(rest), "rebuilt")
    drop(given)
    return out, meta.select("c", "n", "b")


def ids_hashed(members: DataFrame) -> DataFrame:
    """(rep, sha): for each rep, the SHA-256 of its members' ids c, ascending and joined by commas.

    SHA-256 reads in order, so a list's bytes pass through one task; they come there as pieces of a thousand ids, made by
    ranges, and are read one after another.
    """

    def pieces(batches):
        rep, first, held, size = None, None, [], 0
        out: list[tuple] = []
        for batch in batches:
            for r, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (r != rep or size > PIECE):
                    out.append((rep, first, ",".join(held)))
                    held, size = [], 0
                if not held:
                    rep, first = r, c
                held.append(str(c))
                size += len(held[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["rep", "first", "piece"])
            out = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([first], pa.int64()), pa.array([",".join(held)], pa.string())], ["rep", "first", "piece"])

    def hashed(batches):
        rep, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for r, piece in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if r != rep:
                    if state is not None:
                        done.append((rep, state.hexdigest()))
                    rep, state = r, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(piece.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string())], ["rep", "sha"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([state.hexdigest()], pa.string())], ["rep", "sha"])

    cut = members.repartitionByRange("rep", "c").sortWithinPartitions("rep", "c").mapInArrow(pieces, "rep bigint, first bigint, piece string")
    return cut.repartition("rep").sortWithinPartitions("rep", "first").mapInArrow(hashed, "rep bigint, sha string")


def trie(steps: DataFrame, convs: DataFrame, key: str = "conv_id") -> DataFrame:
    """Per node of the trie of conversations (c, n, b) with turns (c, i, dig, nb, cum): conv_id (the smallest member), depth,
    parent_conv_id (root: null), n_convs, n_children, n_leaves and saved_tokens (both over its subtree), ends_sha256.

    A conversation without turns is a member of the root alone; without conversations there is no node. Equal
    conversations are one class with a weight (their digests of 128 bits are trusted to differ otherwise), so copies, long
    ones too, cost one path; the loop runs as deep as different conversations agree.
    """
    spark, nothing = steps.sparkSession, hashlib.sha256(b"").hexdigest()
    home = f"{shared_dir(spark)}/trie-{uuid.uuid4().hex}"
    # a path's name: two sums of hashes of its turns with their places, so turns of one conversation may be added anywhere
    name = steps.groupBy("c").agg(*(F.sum(F.xxhash64("dig", "i", F.lit(s)).cast("decimal(38,0)")).alias(f"f{s}") for s in (1, 2)))
    paths = stash(convs.join(name, "c", "left").na.fill(0, ["n", "b"]).select("c", "n", "b", *(F.coalesce(f"f{s}", F.lit(0).cast("decimal(38,0)")).alias(f"f{s}") for s in (1, 2))), "paths")
    classes = stash(paths.groupBy("n", "f1", "f2").agg(F.min("c").alias("rep"), F.count("*").alias("w"), F.max("b").alias("b")), "classes")
    whole = classes.agg(F.min("rep").alias("root"), F.sum("w").alias("w")).first()
    root = whole["root"]
    live = classes.where("n > 0").select("rep", "w", "n", "b", F.lit(root).cast("bigint").alias("node"))
    depth, levels = 0, 0
    while root is not None and not live.isEmpty():
        if depth % WINDOW == 0:
            window = f"{home}/window-{depth}"
            near = steps.where((F.col("i") > depth) & (F.col("i") <= depth + WINDOW)).join(live.select("rep"), F.col("c") == F.col("rep"), "left_semi")
            near.select(F.col("c").alias("rep"), "dig", "nb", "cum", F.col("i").alias("depth")).write.partitionBy("depth").parquet(window)
            ahead = spark.read.schema("rep bigint, dig binary, nb bigint, cum bigint, depth bigint").parquet(window)
        depth += 1
        met = ahead.where(F.col("depth") == depth).drop("depth").join(live, "rep")
        rest = F.col("b") - F.col("cum") + F.col("nb")  # bytes of the path from this turn on
        nodes = met.groupBy("node", "dig").agg(F.min("rep").alias("conv"), F.sum("w").alias("members"), F.count("*").alias("k"), F.max("nb").alias("nb"), F.max("n").alias("n"), F.max(rest).alias("rest"))
        nodes.withColumnRenamed("node", "parent").write.parquet(f"{home}/nodes/depth={depth}")
        known = spark.read.parquet(f"{home}/nodes/depth={depth}").where("k > 1").select(F.col("parent").alias("node"), "dig", "conv")
        shared = met.join(known, ["node", "dig"]).select("rep", "w", "n", "b", F.col("conv").alias("node"))
        shared.write.parquet(f"{home}/live/depth={depth}")
        live = spark.read.parquet(f"{home}/live/depth={depth}").where(F.col("n") > depth)
        levels = depth
    below = None
    for at in range(levels, 0, -1):
        found = spark.read.parquet(f"{home}/nodes/depth={at}")
        if below is not None:
            sums = below.groupBy(F.col("parent").alias("conv")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            found = found.join(sums, "conv", "left")
        else:
            found = found.selectExpr("*", "0L as children", "0L as leaves", "0L as saved")
        alone = F.col("k") == 1
        found = found.select(
            "conv", "parent", "members", "k", "n",
            F.when(alone, (F.col("n") > at).cast("bigint")).otherwise(F.coalesce("children", F.lit(0))).alias("n_children"),
            F.when(alone, F.lit(1)).otherwise(F.coalesce("leaves", F.lit(1))).cast("bigint").alias("n_leaves"),
            F.when(alone, (F.col("members") - 1) * F.col("rest")).otherwise((F.col("members") - 1) * F.col("nb") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"),
        )
        found.write.parquet(f"{home}/rolled/depth={at}")
        below = spark.read.parquet(f"{home}/rolled/depth={at}")
    out = "conv bigint, depth bigint, parent bigint, members bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, whole boolean"
    columns = [x.split()[0] for x in out.split(", ")]
    if root is None:
        made, ends = spark.createDataFrame([], out), classes.select(F.col("n").alias("depth"), F.col("rep").alias("conv"), F.lit("").alias("sha"))
    else:
        sides = [classes.where("n = 0 and w > 0").select(F.lit(0).cast("bigint").alias("depth"), F.lit(root).cast("bigint").alias("conv"), "rep")]
        if levels:
            rolled = spark.read.parquet(f"{home}/rolled").withColumn("depth", F.col("depth").cast("bigint"))
            # whole: one class ends here alone and is a single conversation, so its list is known
            heads = rolled.withColumn("whole", F.expr("k = 1 and members = 1 and n = depth"))
            alone = rolled.where("k = 1").select(F.col("conv").alias("rep"), F.col("depth").alias("from"), "members", "n")
            sums = classes.select("rep", "b")
            alone = stash(alone.join(sums, "rep"), "alone")
            tail = steps.join(alone, F.col("c") == F.col("rep")).where("i > from").select(
                F.col("c").alias("conv"), F.col("i").alias("depth"), F.col("c").alias("parent"), "members", (F.col("i") < F.col("n")).cast("bigint").alias("n_children"),
                F.lit(1).cast("bigint").alias("n_leaves"), F.expr("(members - 1) * (b - cum + nb)").alias("saved_tokens"), F.expr("members = 1 and i = n").alias("whole"),
            )
            made = heads.select(columns).union(tail.select(columns))
            shared = spark.read.parquet(f"{home}/live").withColumn("depth", F.col("depth").cast("bigint"))
            sides.append(shared.where("n = depth").select("depth", F.col("node").alias("conv"), "rep"))
            sides.append(alone.where("members > 1").select(F.col("n").alias("depth"), F.col("rep").alias("conv"), "rep"))
            top = below.agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).first()
        else:
            made, top = spark.createDataFrame([], out), {"children": 0, "leaves": 1, "saved": 0}
        made = made.union(spark.createDataFrame([(root, 0, None, whole["w"], top["children"], top["leaves"], top["saved"], False)], out))
        sides = sides[0].union(sides[1]).union(sides[2]) if levels else sides[0]
        sides = stash(sides, "ends")
        wanted = classes.join(sides.select("rep").distinct(), "rep", "left_semi")
        members = paths.join(wanted.select("n", "f1", "f2", "rep"), ["n", "f1", "f2"]).select("rep", "c")
        ends = stash(sides.join(ids_hashed(members), "rep").select("depth", "conv", "sha"), "hashes")
    known = made.join(ends, ["depth", "conv"], "left")
    sha = F.when(F.col("whole"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(F.coalesce("sha", F.lit(nothing)))
    return known.select(F.col("conv").alias(key), "depth", F.col("parent").alias(f"parent_{key}"), F.col("members").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", sha.alias("ends_sha256"))


def crc_mod(c: Column, by: int) -> Column:
    """The CRC-32 of the decimal c, modulo `by`."""
    return F.crc32(c.cast("string").cast("binary")) % by


def trie_sql(group: int = 5, most: int = 9) -> str:
    """DuckDB's SQL for the query's rows; CRC-32 is worked out bit by bit."""
    bits = "list_reduce([xor(x, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda y, z: case when y & 1 = 1 then xor(y >> 1, 3988292384) else y >> 1 end)"
    crc = f"xor(list_reduce([4294967295::bigint] || list_transform(string_split(c::varchar, ''), lambda s: ascii(s)::bigint), lambda x, b: {bits}), 4294967295)"
    return f"""
with t as (select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as x,
    row_number() over (partition by conv_id order by turn nulls first, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as i
  from conversations where conv_id is not null),
n as materialized (select c, {crc} % {most} as h, c - c % {group} as base from (select distinct c from t)),
given as (select n.c, i as d, r, x from n join t on t.c = base and i <= h),
m as (select c, count(*) as m from given group by c),
rows_ as (select * from given union all select n.c, coalesce(m, 0) + i - h, r, x from n join t using (c) left join m using (c) where i > h),
p as materialized (select c, d, x, md5(list({{'r': r, 'x': x}}) over (partition by c order by d)::varchar) as k from rows_ union all select c, 0, '', '' from n),
l as (select c, max(d) as l from p group by c),
nodes as materialized (select d, k, min(c) as conv, count(*) as n, (count(*) - 1) * strlen(any_value(x)) as own,
    coalesce(string_agg(c::varchar, ',' order by c) filter (where l = d), '') as ends from p join l using (c) group by d, k),
up as materialized (select v.*, q.k as pk, w.conv as parent from nodes v left join p q on q.c = v.conv and q.d = v.d - 1 left join nodes w on w.d = q.d and w.k = q.k),
kids as (select d - 1 as d, pk as k, count(*) as kids from up where parent is not null group by all),
full_ as materialized (select up.*, coalesce(kids, 0) as kids from up left join kids using (d, k)),
sub as (select q.d, q.k, sum(own) as saved, count(*) filter (where kids = 0) as leaves from full_ v join p q on q.c = v.conv and q.d <= v.d group by all)
select conv::bigint as conv_id, d::bigint as depth, parent::bigint as parent_conv_id, n::bigint as n_convs, kids::bigint as n_children, leaves::bigint as n_leaves,
  saved::bigint as saved_tokens, sha256(ends) as ends_sha256
from full_ join sub using (d, k)
"""
