"""The prefix trie of conversations by truncation peeling.

1. A turn becomes a digest and its number of code points, and the turns of a conversation, in order, a path: the key of a node
   is the SHA-256 (128 bits of it) of its parent's key and the turn. Texts are read once and never shuffled.
2. Conversations with one path are one ended sequence: their ids are joined in blocks of neighbouring ids and streamed, in order,
   through SHA-256, so that no list of ids is held whole.
3. Peeling starts at the greatest depth. Sequences that end there are merged with the nodes that survived from deeper, grouped by
   key; each group is a node, complete with members, children, leaves and saved tokens, as all that lies below it has been
   merged already. Then its last turns are stripped and it goes on as one row, a child of its parent, to the next lower depth.
4. A node with a single child and no end has that child's members. So only nodes where sequences part or end ("stops") are
   grouped, and a strip takes all turns down to the next stop at once; the nodes between follow from the one above them.
   There are as many rounds as there are depths with stops: a conversation that is alone in most of its length takes one.

Defined cases: rows with a null conv_id take no part; a null turn sorts first, rows of one turn by role and then by the digest
of role and text; repeated rows are turns of their own; null role or text is empty; ids may be negative (c - c % 100 has the sign
of c then); an empty table gives no rows; other columns are ignored, whatever their names. The digests of one conversation are one
row, 20 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweft.llm.common import by_parts
from geoweft.tables import Rounds, materialize

PATH = "array<struct<key: binary, chars: bigint>>"
PATH_ARROW = pa.list_(pa.struct({"key": pa.binary(), "chars": pa.int64()}))
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: array of (turn, role, digest, chars) in order."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", F.struct("turn", role.alias("role"), digest.alias("digest"), F.length(text).cast("long").alias("chars")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(conversations: DataFrame, modulus: int = 6, every: int = 100) -> DataFrame:
    """conv_id, turns with the first h turns replaced by those of conversation c - c % every; h = crc32(c) % modulus."""
    own = turns(conversations)
    head = turns(conversations.where(F.col("conv_id") % every == 0)).select(F.col("conv_id").alias("base"), F.slice("turns", 1, modulus).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus).cast("int")
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(head, "base", "left")
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    return both.select("conv_id", F.when(F.col("head").isNull(), rest).otherwise(F.concat(F.slice("head", F.lit(1), h), rest)).alias("turns"))


def _paths(rows: list[list[dict]]) -> list[list[dict]]:
    out = []
    for turns_ in rows:
        key, path = b"", []
        for t in turns_:
            key = hashlib.sha256(key + t["digest"].encode()).digest()[:16]
            path.append({"key": key, "chars": t["chars"]})
        out.append(path)
    return out


def key_of(path: Column) -> Column:
    """The key of the node at a path's end; the root's is empty."""
    return F.when(F.size(path) > 0, F.element_at(path, -1)["key"]).otherwise(F.lit(b""))


def sequences(conversations: DataFrame) -> DataFrame:
    """key, path, conv_id (smallest), n, ends_sha256 of each different sequence of (conv_id, turns)."""
    path = by_parts(_paths, PATH, PATH_ARROW)(F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))))
    each = conversations.select("conv_id", path.alias("path")).withColumn("key", key_of(F.col("path")))
    blocks = each.groupBy("key", F.shiftright("conv_id", 16).alias("block")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"), F.any_value("path").alias("path"))
    blocks = blocks.select("key", "block", F.element_at("ids", 1).alias("conv_id"), F.size("ids").cast("long").alias("n"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), "path")

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.binary()), ("conv_id", pa.int64()), ("n", pa.int64()), ("ends_sha256", pa.string()), ("path", PATH_ARROW)])
        now, out = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if now is not None and now["key"] == r["key"]:
                    now["sha"].update(b",")
                    now["n"] += r["n"]
                else:
                    if now is not None:
                        out.append(now | {"ends_sha256": now["sha"].hexdigest()})
                    now = {k: r[k] for k in ("key", "conv_id", "n", "path")} | {"sha": hashlib.sha256()}
                now["sha"].update(r["ids"].encode())
            if out:
                yield pa.RecordBatch.from_pylist([{k: x[k] for k in schema.names} for x in out], schema)
                out = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([{"key": now["key"], "conv_id": now["conv_id"], "n": now["n"], "ends_sha256": now["sha"].hexdigest(), "path": now["path"]}], schema)

    return blocks.repartition("key").sortWithinPartitions("key", "block").mapInArrow(streamed, f"key binary, conv_id bigint, n bigint, ends_sha256 string, path {PATH}")


def with_stops(found: DataFrame) -> DataFrame:
    """sequences with `stops`: the depths below their own, in order, of nodes where sequences part or end; 0 is always one."""
    # the parent of depth d is at d - 1; the root is a stop anyway
    steps = found.select(F.col("key").alias("sequence"), F.posexplode("path").alias("at", "p")).select("sequence", F.col("at").alias("depth"), F.col("p.key").alias("key"))
    edges = found.select(F.explode(F.expr("transform(sequence(2, greatest(size(path), 2)), i -> if(i <= size(path), struct(path[i - 2].key as parent, path[i - 1].key as child), null))")).alias("e")).where("e is not null").select("e.*")
    # two different children: the smallest and the largest differ; both are combined before they are shuffled
    parted = edges.groupBy("parent").agg((F.min("child") != F.max("child")).alias("parts")).where("parts").select(F.col("parent").alias("key"))
    stop = parted.unionByName(found.where(F.size("path") > 0).select("key")).distinct()
    own = steps.join(stop, "key").groupBy("sequence").agg(F.collect_set(F.col("depth") + 1).alias("stops"))
    stops = F.array_sort(F.array_union(F.array(F.lit(0)), F.filter(F.coalesce("stops", F.array().cast("array<int>")), lambda d: d < F.size("path"))))
    return found.join(own.withColumnRenamed("sequence", "key"), "key", "left").withColumn("stops", F.when(F.size("path") > 0, stops).otherwise(F.array().cast("array<int>")))


def peel(found: DataFrame) -> DataFrame:
    """key, parent, depth, above (the stop below it), chars (of its last turns down to there), conv_id, n, children, leaves,
    saved, ends_sha256 of all stops of with_stops(...).

    What waits for a depth and what is done are tables by depth that each round adds to, so a round's plan names two tables however many
    rounds there were, and a round reads what waits for its own depth only."""
    none = lambda c: F.lit(0).cast("long").alias(c)
    ended = found.select(F.size("path").alias("at"), "path", "stops", "conv_id", "n", none("children"), none("leaves"), none("saved"), "ends_sha256")
    waiting, done = Rounds(ended, "waiting"), None
    waiting.add(ended)
    for d in sorted((r[0] for r in found.select(F.size("path").alias("d")).union(found.select(F.explode("stops"))).distinct().collect()), reverse=True):
        total = waiting.at(d).groupBy(key_of(F.col("path")).alias("key")).agg(
            F.any_value("path").alias("path"), F.any_value("stops").alias("stops"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.sum("children").alias("children"), F.sum("leaves").alias("leaves"),
            F.sum("saved").alias("saved"), F.max("ends_sha256").alias("ends_sha256"))
        above = F.coalesce(F.try_element_at("stops", F.lit(-1)), F.lit(-1))
        total = total.withColumns({"leaves": F.when(F.col("children") == 0, F.lit(1).cast("long")).otherwise(F.col("leaves")), "above": above})
        total = total.withColumn("chars", F.transform(F.slice("path", F.greatest("above", F.lit(0)) + 1, F.size("path")), lambda p: p["chars"]))
        last = F.coalesce(F.try_element_at("chars", F.lit(-1)), F.lit(0).cast("long"))
        total = total.withColumns({"at": F.size("path"), "saved": F.col("saved") + (F.col("n") - 1) * last})
        done = done or Rounds(total, "stops")
        done.add(total)
        between = F.aggregate(F.slice("chars", F.lit(1), F.size("chars") - 1), F.lit(0).cast("long"), lambda s, x: s + x)
        waiting.add(done.at(d).where("above >= 0").select(
            F.col("above").alias("at"), F.slice("path", F.lit(1), F.col("above")).alias("path"), F.filter("stops", lambda s: s < F.col("above")).alias("stops"), "conv_id", "n", F.lit(1).cast("long").alias("children"), "leaves",
            (F.col("saved") + (F.col("n") - 1) * between).alias("saved"), F.lit(None).cast("string").alias("ends_sha256")))
    if done is None:
        return ended.select(F.lit(b"").alias("key"), F.lit(b"").alias("parent"), F.lit(0).alias("depth"), F.lit(-1).alias("above"), F.array().cast("array<bigint>").alias("chars"), "conv_id", "n", "children", "leaves", "saved", "ends_sha256")
    parent = key_of(F.slice("path", F.lit(1), F.greatest("above", F.lit(0))))
    return done.all().select("key", parent.alias("parent"), F.size("path").alias("depth"), "above", "chars", "conv_id", "n", "children", "leaves", "saved", "ends_sha256")


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of (conv_id, turns)."""
    found = materialize(with_stops(materialize(sequences(conversations), "sequences")), "stops")
    stops = peel(found)
    parents = stops.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv"))
    known = stops.join(parents, "parent", "left")
    # the nodes from the one after the next stop to this one; all but this one have one child and no end
    each = known.withColumn("d", F.explode(F.when(F.col("depth") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.col("above") + 1, F.greatest("depth", F.col("above") + 1)))))
    own = F.col("d") == F.col("depth")
    more = F.aggregate(F.slice("chars", F.col("d") - F.col("above"), F.greatest(F.col("depth") - F.col("d"), F.lit(0))), F.lit(0).cast("long"), lambda s, x: s + x)
    return each.select(
        "conv_id", F.col("d").cast("long").alias("depth"), F.when(F.col("depth") == 0, None).when(F.col("d") == F.col("above") + 1, F.col("parent_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(own, F.col("children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.when(own, F.col("saved")).otherwise(F.col("saved") + (F.col("n") - 1) * more).alias("saved_tokens"), F.when(own, F.coalesce("ends_sha256", F.lit(NO_ENDS))).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"))


def report(conversations: DataFrame) -> DataFrame:
    """trie() of the rebuilt conversations."""
    return trie(rebuilt(conversations))


#: The same by listing all prefixes; crc32 is computed bit by bit.
SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, length(coalesce(text, '')) as chars, sha256(cast(length(coalesce(role, '')) as varchar) || ':' || coalesce(role, '') || coalesce(text, '')) as digest
  from conversations where conv_id is not null),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, digest, chars) as pos from t),
ids as (
  select distinct conv_id, conv_id - conv_id % 100 as base,
    xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(cast(conv_id as varchar), ''), lambda c: ascii(c)::ubigint)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0::ubigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384::ubigint * (x & 1)))), 4294967295::ubigint) % 6 as h
  from t),
kept as (
  select i.conv_id, 0 as part, n.pos, n.digest, n.chars from ids i join numbered n on n.conv_id = i.base and n.pos <= i.h
  union all
  select i.conv_id, 1, n.pos, n.digest, n.chars from ids i join numbered n on n.conv_id = i.conv_id and n.pos > i.h),
made as (select conv_id, digest, chars, row_number() over (partition by conv_id order by part, pos) as d from kept),
prefix as (
  select conv_id, 0 as depth, '' as key, 0 as chars from ids
  union all
  select conv_id, d, sha256(string_agg(digest, ',') over (partition by conv_id order by d rows unbounded preceding)), chars from made),
whole as (select conv_id, max(depth) as depth, arg_max(key, depth) as key from prefix group by conv_id),
nodes as (select key, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(chars) as chars from prefix group by key, depth),
edges as (select distinct p.key as parent, c.key as child from prefix p join prefix c on c.conv_id = p.conv_id and c.depth = p.depth + 1),
kids as (select parent, count(*) as n from edges group by parent),
below as (select distinct a.key as top, b.key as node from prefix a join prefix b on b.conv_id = a.conv_id and b.depth >= a.depth),
sums as (
  select b.top, sum((n.n_convs - 1) * n.chars) as saved, sum(case when k.n is null then 1 else 0 end) as leaves
  from below b join nodes n on n.key = b.node left join kids k on k.parent = b.node group by b.top),
ends as (select key, sha256(string_agg(cast(conv_id as varchar), ',' order by conv_id)) as sha from whole group by key)
select n.conv_id, cast(n.depth as bigint) as depth, u.conv_id as parent_conv_id, n.n_convs, coalesce(k.n, 0) as n_children, cast(s.leaves as bigint) as n_leaves, cast(s.saved as bigint) as saved_tokens,
       coalesce(e.sha, sha256('')) as ends_sha256
from nodes n left join edges g on g.child = n.key left join nodes u on u.key = g.parent left join kids k on k.parent = n.key join sums s on s.top = n.key left join ends e on e.key = n.key
"""
