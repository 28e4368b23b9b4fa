"""The prefix trie of conversations, level by level.

A node of depth d is a different sequence of d turns; its members are the conversations that
start with it, and its name is its smallest member. Downwards, one level at a time, the live
conversations are grouped by (parent node, next turn) and take the least conv_id of their group.
A conversation that is alone in its node has left the others: the nodes below are its own, one
for each further turn, so it is no longer live and the levels end where no two conversations
agree. Upwards, the sums of each level's nodes are joined to those above.

Turns are compared by SHA-256 of role and text, so no text is kept after the first pass. They
are numbered by ranges of (conv_id, turn, role, text): a conversation may span many tasks.
Members that end at a node are hashed as one stream, as SHA-256 wants, of blocks of ids; a
task holds one block and the hash's state.

Rows without a conv_id belong to no conversation and are left out. Null role or text counts as
empty; a null turn comes first; equal turns are ordered by role and text, and repeated rows are
turns of their own. Empty tables have no node, not even a root. Columns other than conv_id,
turn, role and text are ignored. Rounds are as many as the turns that two conversations share.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

#: Conversations of one shared opening, and the most turns of it that are put before a conversation, plus one.
SHARED, OPENINGS = 100, 6
#: Ids whose decimals are joined at a time, and nodes of a chain that are listed at a time.
BLOCK = 4096
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def positions(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), turn_key, chars of every turn, numbered by turn, role and text."""
    clean = lambda c: F.coalesce(F.col(c), F.lit(""))
    x = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", clean("role").alias("role"), clean("text").alias("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the length of the role says where the text begins
    key = F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), F.concat("role", "text")), 256))
    x = x.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # ids rise along the order, by one within a partition
    x = materialise(x.select("conv_id", key.alias("turn_key"), F.length("text").cast("long").alias("chars"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "turns")
    runs = x.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")
    return x.join(runs.withColumn("before", before), ["conv_id", "part"]).select("conv_id", (F.col("at") - F.col("first") + F.col("before") + 1).alias("pos"), "turn_key", "chars")


def opening(conv_id: Column) -> Column:
    """How many of its own first turns a conversation gives for those of the shared one."""
    return F.crc32(conv_id.cast("string").cast("binary")) % OPENINGS


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n_turns) and (conv_id, depth, turn_key, chars) of conversations with shared openings; turns: positions()."""
    size = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    shared = size.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    x = size.select("conv_id", "n", opening(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % SHARED).alias("base"))
    x = x.join(shared, "base", "left").withColumn("given", F.least(F.col("h"), F.coalesce("n_base", F.lit(0))))
    x = materialise(x.select("conv_id", "h", "base", "given", (F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")), "openings")
    first = turns.where(F.col("pos") < OPENINGS).where(F.col("conv_id") % SHARED == 0).withColumnRenamed("conv_id", "base")
    given = x.where("given > 0").join(first, "base").where("pos <= given").select("conv_id", F.col("pos").alias("depth"), "turn_key", "chars")
    own = turns.join(x.select("conv_id", "h", "given"), "conv_id").where("pos > h").select("conv_id", (F.col("given") + F.col("pos") - F.col("h")).alias("depth"), "turn_key", "chars")
    # a level reads the row groups that hold its depth
    return x.select("conv_id", "n_turns"), materialise(given.unionByName(own).sortWithinPartitions("depth"), "rebuilt")


def _level(live: DataFrame, turns: DataFrame, depth: int) -> DataFrame:
    """conv_id, n_turns, parent, node, n, chars of the live conversations that have a turn at this depth."""
    x = live.where(F.col("n_turns") >= depth).select("conv_id", "n_turns", F.col("node").alias("parent"))
    x = x.join(turns.where(F.col("depth") == depth).drop("depth"), "conv_id")
    groups = x.groupBy("parent", "turn_key").agg(F.min("conv_id").alias("node"), F.count("*").alias("n"))
    return x.join(groups, ["parent", "turn_key"]).select("conv_id", "n_turns", "parent", "node", "n", "chars")


def levels(sizes: DataFrame, turns: DataFrame) -> list[DataFrame]:
    """The conversations that are live at each depth, from the root on, with their nodes; the last ones to share a node are in the last."""
    root = sizes.agg(F.min("conv_id").alias("node"), F.count("*").alias("n"))
    out = [materialise(sizes.crossJoin(F.broadcast(root)).select("conv_id", "n_turns", F.lit(None).cast("long").alias("parent"), "node", "n", F.lit(0).cast("long").alias("chars")), "level0")]
    while not (live := out[-1].where("n > 1").where(F.col("n_turns") >= len(out))).isEmpty():
        out.append(materialise(_level(live, turns, len(out)), f"level{len(out)}"))
    return out


def _rolled_up(found: list[DataFrame]) -> list[DataFrame]:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, n_turns of the nodes of each level, from the deepest on."""
    out: list[DataFrame] = []
    for depth in range(len(found) - 1, -1, -1):
        own = found[depth].where("conv_id = node").select("conv_id", F.lit(depth).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_turns", "chars")
        if out:
            below = out[-1].groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            own = own.join(below, "conv_id", "left")
        else:
            own = own.withColumns({c: F.lit(None).cast("long") for c in ("kids", "leaves", "saved")})
        alone = F.col("n_convs") == 1
        children = F.when(alone, (F.col("n_turns") > depth).cast("long")).otherwise(F.coalesce("kids", F.lit(0)))
        saved = (F.col("n_convs") - 1) * F.col("chars") + F.coalesce("saved", F.lit(0))
        out.append(materialise(own.select("conv_id", "depth", "parent_conv_id", "n_convs", children.alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"), saved.alias("saved_tokens"), "n_turns"), f"nodes{depth}"))
    return out


def _chains(alone: DataFrame) -> DataFrame:
    """The nodes below those with one conversation: one for each of its further turns."""
    blocks = F.explode(F.sequence(F.col("depth") + 1, F.col("n_turns"), F.lit(BLOCK).cast("long"))).alias("from")
    x = alone.where("n_turns > depth").select("conv_id", "n_turns", blocks)
    x = x.select("conv_id", "n_turns", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + (BLOCK - 1), F.col("n_turns")))).alias("depth"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return x.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), (F.col("depth") < F.col("n_turns")).cast("long").alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), "n_turns")


def _hash_streams(batches):
    """conv_id, depth, ends of rows (conv_id, depth, block, ids) that are sorted: the SHA-256 of each node's ids, joined by commas."""
    node, state = None, None
    for batch in batches:
        done = []
        for conv_id, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids")), strict=True):
            if (conv_id, depth) != node:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = (conv_id, depth), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield _ends(done)
    if node is not None:
        yield _ends([(*node, state.hexdigest())])


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"conv_id": pa.int64(), "depth": pa.int64(), "ends": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], list(kinds))


def ends(found: list[DataFrame]) -> DataFrame:
    """conv_id, depth, ends of the nodes of many conversations where some end."""
    rows = None
    for depth, level in enumerate(found):
        here = level.where("n > 1").where(F.col("n_turns") == depth).select(F.col("node"), F.lit(depth).cast("long").alias("depth"), F.col("conv_id").alias("id"))
        rows = here if rows is None else rows.unionByName(here)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",")
    blocks = rows.groupBy(F.col("node").alias("conv_id"), "depth", F.floor(F.col("id") / BLOCK).alias("block")).agg(ids.alias("ids"))
    return blocks.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "block").mapInArrow(_hash_streams, "conv_id long, depth long, ends string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """All nodes, with the columns of NODE."""
    found = levels(*rebuilt(positions(conversations)))
    nodes = None
    for level in _rolled_up(found):
        nodes = level if nodes is None else nodes.unionByName(level)
    nodes = nodes.unionByName(_chains(nodes.where("n_convs = 1"))).join(ends(found), ["conv_id", "depth"], "left")
    own = F.when(F.col("n_convs") == 1, F.when(F.col("n_turns") == F.col("depth"), F.sha2(F.col("conv_id").cast("string"), 256)))
    return nodes.withColumn("ends_sha256", F.coalesce(own, "ends", F.lit(hashlib.sha256(b"").hexdigest()))).select(*NODE)


#: The same in SQL: CRC-32 bit by bit, prefixes as chains of MD5, sums over the ancestors of each node.
SQL = rf"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id),
b AS (SELECT conv_id, n, conv_id::VARCHAR AS d FROM s),
c AS (SELECT conv_id, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(d, ''), lambda e: list_transform(range(8), lambda i: ((ord(e) >> i) & 1)::BIGINT)))),
  lambda a, e: CASE WHEN xor(a, e) & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT) % {OPENINGS} AS h FROM b),
g AS (SELECT c.conv_id, h, c.conv_id - c.conv_id % {SHARED} AS base, least(h, coalesce(t.n, 0)) AS given, c.n FROM c LEFT JOIN s t ON t.conv_id = c.conv_id - c.conv_id % {SHARED}),
r AS (SELECT g.conv_id, o.pos AS depth, role, text FROM g JOIN o ON o.conv_id = g.base AND o.pos <= g.given
  UNION ALL SELECT g.conv_id, given + o.pos - h, role, text FROM g JOIN o ON o.conv_id = g.conv_id AND o.pos > h),
p AS (SELECT conv_id, depth, length(text) AS chars, string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS prefix FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM g),
l AS (SELECT conv_id, given + greatest(n - h, 0) AS n_turns FROM g),
m AS (SELECT depth, prefix, min(conv_id) AS node, count(*) AS n, max(chars) AS chars FROM p GROUP BY depth, prefix),
a AS (SELECT p.conv_id, p.depth, m.node FROM p JOIN m USING (depth, prefix)),
t AS (SELECT m.node, m.depth, a.node AS parent, m.n, m.chars FROM m LEFT JOIN a ON a.conv_id = m.node AND a.depth = m.depth - 1),
k AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS kids FROM t WHERE parent IS NOT NULL GROUP BY ALL),
u AS (SELECT t.*, coalesce(kids, 0) AS kids FROM t LEFT JOIN k USING (node, depth)),
w AS (SELECT a.node, a.depth, sum((kids = 0)::INT) AS leaves, sum((n - 1) * chars) AS saved FROM u JOIN a ON a.conv_id = u.node AND a.depth <= u.depth GROUP BY ALL),
e AS (SELECT a.node, a.depth, string_agg(a.conv_id::VARCHAR, ',' ORDER BY a.conv_id) AS ids FROM a JOIN l ON l.conv_id = a.conv_id AND l.n_turns = a.depth GROUP BY ALL)
SELECT u.node AS conv_id, u.depth::BIGINT AS depth, u.parent AS parent_conv_id, u.n::BIGINT AS n_convs, kids::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM u JOIN w USING (node, depth) LEFT JOIN e USING (node, depth)
"""
