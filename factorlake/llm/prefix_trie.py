"""The prefix trie of conversations, by smallest-member ownership.

A node is a distinct sequence of first turns, and its members are the
conversations that start with it. Each node belongs to its smallest member. As
the members of a node's children are some of its own, the nodes that a
conversation owns are the last ones of its path, from one depth on. So nothing
needs to walk the trie: a sum over the nodes of a subtree is a sum over the
members of its top, each of which answers for the nodes that it owns. Members'
tokens from the top on, less the tokens of the nodes that they own, are the
tokens that a subtree saves; members whose own last node has no children are its
leaves; members that own a node one deeper are its children. One grouping by
node gives all of them.

A node's key is its depth and 128 bits: the exclusive or of hashes of (position,
turn) along the path, a running value. Paths are cut into stretches of STRETCH
turns, so that a conversation of any length is run through by many tasks; texts
are hashed first and never shuffled. Groupings by node are sums that tasks
combine before the shuffle; joins are by conversation and stretch, or give the
few nodes with very many children to all tasks. The ids that end in a node are hashed in their
order from a sorted stream, after stretches of 256 ids were put together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scan
from .common import heavy_join, materialize, read_table

#: Turns of a path that one task runs through; turns of a conversation beyond which they are numbered by many tasks.
STRETCH, LONG = 4_096, 250_000
#: Ids below 2 ^ ID_BITS apart that may be put together before they are hashed.
ID_BITS = 8


def turn_hashes(role, text):
    """128 bits of a turn, null role or text as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.xxhash64(role, text), F.xxhash64(F.lit(7), role, text)


def _running(rows: DataFrame, sums: dict[str, tuple[str, str]], falling: dict[str, str]) -> DataFrame:
    """rows (conv, pos, ...) with running values along a path.

    sums: out -> (aggregate, column) up to and with a row; falling: out -> column summed from a row to its path's end.
    Values run within a stretch; what the stretches before or after hold is one
    row a stretch, and there are such rows only for paths of several stretches.
    """
    rows = rows.withColumn("_s", F.floor(F.col("pos") / STRETCH))
    w = Window.partitionBy("conv", "_s").orderBy("pos")
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    made = {k: getattr(F, f)(c).over(up) for k, (f, c) in sums.items()} | {k: F.sum(c).over(down) for k, c in falling.items()}
    # a stretch's own totals, by the same aggregates
    whole = [getattr(F, f)(c).alias(k) for k, (f, c) in sums.items()] + [F.sum(c).alias(k) for k, c in falling.items()]
    parts = rows.where(f"pos >= {STRETCH}").select("conv").distinct()
    parts = rows.join(parts, "conv", "left_semi").groupBy("conv", "_s").agg(*whole)
    path = Window.partitionBy("conv").orderBy("_s")
    before, after = path.rowsBetween(Window.unboundedPreceding, -1), path.rowsBetween(1, Window.unboundedFollowing)
    carried = [getattr(F, f)(k).over(before).alias(f"_c_{k}") for k, (f, _) in sums.items()] + [F.sum(k).over(after).alias(f"_c_{k}") for k in falling]
    carried = parts.select("conv", "_s", *carried)
    out = rows.withColumns(made).join(carried, ["conv", "_s"], "left")
    zero = lambda k: F.coalesce(F.col(f"_c_{k}"), F.lit(0).cast("long"))
    joined = {k: F.col(k).bitwiseXOR(zero(k)) if f == "bit_xor" else F.col(k) + zero(k) for k, (f, _) in sums.items()} | {k: F.col(k) + zero(k) for k in falling}
    return out.withColumns(joined).drop("_s", *[f"_c_{k}" for k in joined])


def paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv, pos, k1, k2, p1, p2 (the node of each turn, and its parent), tail (code points from this turn to the last), n_turns; with a row of pos 0 for the root.

    turns: conv, pos (1 to n, without gaps), t1, t2 (hashes of the turn), size; convs: conv and n_turns of every conversation.
    """
    at = {"x1": F.xxhash64("pos", "t1", "t2"), "x2": F.xxhash64(F.lit(7), "pos", "t2", "t1")}
    rows = turns.withColumns(at).select("conv", F.col("pos").cast("long").alias("pos"), "x1", "x2", F.col("size").cast("long").alias("size"))
    zero = F.lit(0).cast("long")
    roots = convs.select("conv", *[zero.alias(c) for c in ("pos", "x1", "x2", "size")])
    rows = _running(rows.unionByName(roots), {"k1": ("bit_xor", "x1"), "k2": ("bit_xor", "x2")}, {"tail": "size"})
    rows = rows.join(convs, "conv")
    # the parent's key is the node's own without this turn
    return rows.select("conv", "pos", "k1", "k2", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "tail", "n_turns")


def _digests(ends: DataFrame) -> DataFrame:
    """pos, k1, k2 and ends_sha256 of nodes in which conversations end. ends: pos, k1, k2, conv."""
    node = ["pos", "k1", "k2"]
    # ids that lie close go into one row first: at most 2 ^ ID_BITS of them, as a conversation ends once
    near = ends.groupBy(*node, F.shiftright("conv", ID_BITS).alias("stretch")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    rows = near.repartition(*node).sortWithinPartitions(*node, "stretch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def batch(done: list) -> pa.RecordBatch:
            columns = list(zip(*done)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(columns[i], pa.int64()) for i in range(3)] + [pa.array(columns[3], pa.string())], [*node, "ends_sha256"])

        for b in batches:
            done = []
            for pos, k1, k2, ids in zip(*(b.column(c).to_pylist() for c in (*node, "ids"))):
                if now != (pos, k1, k2):
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = (pos, k1, k2), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield batch(done)
        yield batch([(*now, state.hexdigest())] if now is not None else [])

    return rows.mapInArrow(run, "pos long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node: k1, k2 (its key besides the depth), conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns (conv, pos, t1, t2, size) and convs (conv, n_turns) as for paths(); conv is a long and unique in convs.
    n_leaves and saved_tokens go over the node's subtree; saved_tokens adds up
    (n_convs - 1) times the code points of each node's last turn. Conversations
    without turns are members of the root. No conversations give no rows.
    """
    node = ["pos", "k1", "k2"]
    rows = materialize(paths(turns, convs), "trie-paths")
    ends = (F.col("pos") == F.col("n_turns")).cast("long")
    least = F.min(F.struct("conv", "tail")).alias("_o")
    owned = rows.groupBy(*node).agg(least, (F.count(F.lit(1)) == F.sum(ends)).alias("childless"))
    # from which depth on a conversation owns its path, the tokens from there on, and whether its last node is a leaf
    own = owned.groupBy(F.col("_o.conv").alias("conv")).agg(F.min(F.struct(F.col("pos").alias("first"), F.col("_o.tail").alias("tail"))).alias("_f"), F.max(F.col("childless").cast("long")).alias("leaf"))
    own = own.select("conv", F.col("_f.first").alias("first"), F.col("_f.tail").alias("own_tail"), "leaf")
    rows = rows.join(own, "conv", "left")
    pos, first = F.col("pos"), F.col("first")
    not_own = F.when(pos >= first, F.lit(0).cast("long")).otherwise(F.col("tail") - F.coalesce("own_tail", F.lit(0)))
    child = F.coalesce((pos + 1 >= first) & (pos < F.col("n_turns")), F.lit(False)).cast("long")
    nodes = rows.groupBy(*node).agg(
        F.min("conv").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(child).alias("n_children"),
        F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"),
        F.sum(not_own).alias("saved_tokens"),
        F.coalesce(F.bool_or(pos == first), F.lit(False)).alias("top"),  # the first node that its owner owns: the parent is another's
        F.min("p1").alias("p1"),
        F.min("p2").alias("p2"),
    )
    nodes = materialize(nodes.join(_digests(rows.where(ends == 1).select(*node, "conv")), node, "left"), "trie-nodes")
    key = lambda pos, a, b: F.struct(pos.alias("pos"), F.col(a).alias("k1"), F.col(b).alias("k2"))
    tops = nodes.where("top and pos > 0").withColumn("_p", key(pos - 1, "p1", "p2"))
    parents = nodes.where("n_children > 0").select(key(pos, "k1", "k2").alias("_p"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    tops = heavy_join(tops, parents.withColumnRenamed("n_children", "_w"), "_p", "_w", tops.count())
    rest = nodes.where("not top or pos = 0").withColumn("parent_conv_id", F.when(pos > 0, F.col("conv_id")))
    names = [*node, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    out = tops.select(*names).unionByName(rest.select(*names))
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("k1", "k2", "conv_id", F.col("pos").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


def ordered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, pos (from 1), t1, t2, size of every turn, in order of turn with nulls first.

    Turns of one number go by role, then by a hash of the text; repeated rows are
    turns of their own. Null role or text is empty. Rows without a conversation's
    id belong to none and are left out. Other columns are ignored.
    """
    t1, t2 = turn_hashes(F.col(role_col), F.col(text_col))
    size = F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), t1.alias("t1"), t2.alias("t2"), size.alias("size"))
    rows, order = rows.where("conv is not null"), ["turn", "role", "t1", "t2"]  # nulls come first
    pos = F.row_number().over(Window.partitionBy("conv").orderBy(*order)).cast("long")
    names = ["conv", "pos", "t1", "t2", "size"]
    long = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LONG).select("conv")
    if long.isEmpty():
        return rows.withColumn("pos", pos).select(*names)
    # what one task shouldn't sort is numbered by ranges
    long = materialize(long, "trie-long")
    ranged = scan.with_index(rows.join(long, "conv", "left_semi"), ["conv"], order, "_k").withColumn("pos", F.col("_k") + 1)
    return rows.join(long, "conv", "left_anti").withColumn("pos", pos).select(*names).unionByName(ranged.select(*names))


def with_shared_heads(turns: DataFrame, every: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """turns and convs of rebuilt conversations: each c begins with the first h turns of conversation c - c % every, then goes on with its own after its first h; h = crc32(c) % (most + 1).

    A head has at most `most` turns and goes to fewer than 2 x `every` conversations.
    """
    turns = materialize(turns, "trie-turns")
    c = F.col("conv")
    h = (F.crc32(c.cast("string").cast("binary")) % (most + 1)).alias("h")
    heads = turns.where(F.col("pos") <= most).groupBy(c.alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "t1", "t2", "size"))).alias("head"))
    convs = turns.groupBy("conv").agg(F.max("pos").alias("n")).select("conv", "n", h, (c - c % every).alias("base"))
    convs = convs.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), 1, F.col("h").cast("int")))
    convs = materialize(convs.select("conv", "n", "h", "head", F.size("head").cast("long").alias("b")), "trie-heads")
    first = convs.select("conv", F.explode("head").alias("x")).select("conv", "x.pos", "x.t1", "x.t2", "x.size")
    rest = turns.join(convs.select("conv", "h", "b"), "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("b")).alias("pos"), "t1", "t2", "size")
    n_turns = F.col("b") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return first.unionByName(rest), convs.select("conv", n_turns.alias("n_turns"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = with_shared_heads(ordered_turns(read_table(spark, sf_dir, "conversations")))
    return prefix_trie(turns, convs).drop("k1", "k2").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: CRC-32 of an id's decimal digits goes bit by bit: each byte, then seven zeros, through one step.
OP11_SQL = """
with t as (select conv_id c, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, role, text) pos from conversations where conv_id is not null),
bits as (select c, list_prepend(4294967295::bigint, flatten(list_transform(string_split(c::varchar, ''), lambda x: [ascii(x)::bigint, 0, 0, 0, 0, 0, 0, 0]))) b from (select distinct c from t)),
crc as (select c, xor(list_reduce(b, lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295) % 6 h from bits),
rebuilt as (
  select k.c, t.pos, t.role, t.text from crc k join t on t.c = k.c - k.c % 100 and t.pos <= k.h
  union all select k.c, 1000000 + t.pos, t.role, t.text from crc k join t on t.c = k.c and t.pos > k.h),
whole as (select k.c, coalesce(list({'r': role, 't': text} order by pos) filter (where pos is not null), []) turns from crc k left join rebuilt using (c) group by k.c),
member as (select c, d, len(turns) n, list_slice(turns, 1, d) p from whole, lateral (select unnest(range(0, len(turns) + 1)) d)),
node as (select p, d, min(c) conv_id, count(*) n_convs, count(*) filter (where n = d) n_ends, case when d > 0 then length(p[-1].t) else 0 end as size, coalesce(string_agg(c::varchar, ',' order by c) filter (where n = d), '') as ends from member group by p, d),
above as (select list_slice(u.p, 1, a) p, u.d - a as deeper, u.n_convs, u.n_ends, u.size from node u, lateral (select unnest(range(0, u.d + 1)) a)),
total as (select p, count(*) filter (where deeper = 1) n_children, count(*) filter (where n_convs = n_ends) n_leaves, sum((n_convs - 1) * size) saved_tokens from above group by p)
select n.conv_id, n.d as depth, q.conv_id as parent_conv_id, n.n_convs, s.n_children, s.n_leaves, cast(s.saved_tokens as bigint) as saved_tokens, sha256(n.ends) as ends_sha256
from node n join total s on n.p = s.p left join node q on n.d > 0 and q.d = n.d - 1 and q.p = list_slice(n.p, 1, n.d - 1)
"""
