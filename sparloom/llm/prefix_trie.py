"""Prefix trie of conversations by prefix-doubling naming.

Equal turns get one dense name; in round k blocks of 2^k turns, which begin at
multiples of 2^k, are pairs of named blocks of half the size and get dense names in
turn. A prefix of d turns is the blocks of d's binary digits, largest first: rounds
from the largest power down name pairs of (prefix without the last block, block). So
prefixes of all lengths have names after 2 log2(longest) rounds of joins, and equal
prefixes, which are the trie's nodes, have equal names.

Sums over subtrees need no walk: each node belongs to its smallest member, the nodes
of one conversation are a chain down to its end, and a chain adds its total to the
nodes that its conversation shares with smaller ones.

Rows are keyed by conversation and turn, so that a long conversation is spread over
tasks; windows see 1,024 turns, or one row for each such block. Hot names meet
their many rows in joins that Spark splits, after an aggregation with map-side sums.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import column, discard, stage

_LOW = (1 << 33) - 1
#: Turns of a conversation, as a power of two, that one window sorts; conversation ids of a node that one row joins.
BLOCK_BITS, IDS_BITS = 10, 12
WORD = r"[^\x20\x09-\x0D]+"


def _part(mid: Column) -> Column:
    return F.shiftright(mid, 33)


def _index(mid: Column) -> Column:
    return mid.bitwiseAND(F.lit(_LOW))


def positions(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, turn_key, words): turns numbered from 0 in the order of turn (null first), role and text.

    turn_key: SHA-256 of role and text, null as empty; words: of the text. Rows of a
    null conversation belong to none and are left out; repeated rows count each. The
    table is sorted by ranges once, a task counts its rows of a conversation and a
    conversation that goes on in further tasks takes what came before from one row a task.
    """
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("conv is not null")
    ranged = rows.repartitionByRange(F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.left("text", F.lit(64)))
    ordered = ranged.sortWithinPartitions(F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"))
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    sorted_rows = stage(ordered.select("conv", F.monotonically_increasing_id().alias("mid"), key.alias("turn_key"), F.size(F.regexp_extract_all("text", F.lit(WORD), 0)).cast("long").alias("words")))
    runs = sorted_rows.groupBy("conv", _part(F.col("mid")).alias("part")).agg(F.min(_index(F.col("mid"))).alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = runs.select("conv", "part", (before - F.col("first")).alias("shift"))
    return sorted_rows.withColumn("part", _part(F.col("mid"))).join(shift, ["conv", "part"]).select("conv", (_index(F.col("mid")) + F.col("shift")).alias("pos"), "turn_key", "words")


def rebuild(turns: DataFrame, family: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, pos, turn_key, words) and conversations (conv, len), after the first turns of each are replaced.

    A conversation c takes the first h = crc32(decimal c) % heads turns of
    conversation c - c % family (as many as there are, none if it is absent), then its
    own turns after its first h. At most 2 * family conversations share one source.
    """
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n"))
    source = F.col("conv") - F.col("conv") % family
    convs = sizes.select("conv", "n", source.alias("source"), F.when(source == F.col("conv"), 0).otherwise(F.crc32(F.col("conv").cast("string").cast("binary")) % heads).alias("h"))
    convs = convs.join(sizes.select(F.col("conv").alias("source"), F.col("n").alias("has")), "source", "left").withColumn("got", F.least("h", F.coalesce("has", F.lit(0)))).drop("has")
    convs = stage(convs)
    first = turns.where(F.col("pos") < heads - 1).withColumnRenamed("conv", "source")
    taken = first.join(convs.where("h > 0").select("conv", "source", "h"), "source").where("pos < h").select("conv", "pos", "turn_key", "words")
    blocks = turns.withColumn("block", F.shiftright("pos", BLOCK_BITS))
    moves = convs.select("conv", "h", "got", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("n") - 1, BLOCK_BITS))).alias("block"))
    own = blocks.join(moves, ["conv", "block"]).where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("got")).alias("pos"), "turn_key", "words")
    return own.unionByName(taken), convs.select("conv", (F.col("got") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))


def _named(rows: DataFrame, keys: list[str], start: int) -> tuple[DataFrame, int]:
    """The rows, staged, with `name`: one number from `start` on, without gaps, for each distinct value of keys; and the next number.

    The driver sums up one count for each partition of the distinct keys.
    """
    groups = stage(rows.select(*keys).distinct().withColumn("mid", F.monotonically_increasing_id()))
    counts = sorted((r.part, r.n) for r in groups.groupBy(_part(F.col("mid")).alias("part")).agg(F.count("*").alias("n")).collect())
    bases, at = [], start
    for part, n in counts:
        bases.append((part, at))
        at += n
    spark = rows.sparkSession
    base = F.broadcast(spark.createDataFrame(bases or [(0, start)], "part long, base long"))
    names = groups.withColumn("part", _part(F.col("mid")).cast("long")).join(base, "part").select(*keys, (F.col("base") + _index(F.col("mid"))).alias("name"))
    out = stage(rows.join(names, keys).drop(*keys))
    discard(groups)
    return out, at


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, depth, node): the name of each conversation's first `depth` turns, from depth 0, whose name is 0."""
    longest = convs.agg(F.max("len")).first()[0] or 0
    known = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("node"))
    if not longest:
        return known
    level, _ = _named(turns.select("conv", F.col("pos").alias("j"), "turn_key"), ["turn_key"], 1)
    levels = [level]
    for _ in range(int(longest).bit_length() - 1):
        even = levels[-1].where("j % 2 = 0").select("conv", F.shiftright("j", 1).alias("j"), F.col("name").alias("x"))
        odd = levels[-1].where("j % 2 = 1").select("conv", F.shiftright("j", 1).alias("j"), F.col("name").alias("y"))
        levels.append(_named(even.join(odd, ["conv", "j"]), ["x", "y"], 1)[0])
    following = 1
    for k in range(len(levels) - 1, -1, -1):
        last = levels[k].where("j % 2 = 0").select("conv", F.shiftleft("j", k).alias("depth"), F.col("name").alias("y"))
        pairs = last.join(known, ["conv", "depth"]).select("conv", (F.col("depth") + (1 << k)).alias("depth"), F.col("node").alias("x"), "y")
        named, following = _named(pairs, ["x", "y"], following)
        known = known.unionByName(named.withColumnRenamed("name", "node"))
    return known


def _digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of the node's conversations, ascending, comma-joined.

    Rows join up to 4,096 ids each; a task hashes one node's rows after another, in
    order, and keeps nothing but the hash's state.
    """
    pieces = ends.groupBy("node", F.shiftright("conv", IDS_BITS).alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv")), ",").alias("ids"))

    def run(batches):
        node, state = None, None
        for batch in batches:
            done: list[tuple[int, str]] = []
            for at, ids in zip(column(batch, "node").to_pylist(), column(batch, "ids").to_pylist()):
                if at != node:
                    if state is not None:
                        done.append((node, state.hexdigest()))
                    node, state = at, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.int64()), pa.array([s for _, s in done], pa.string())], ["node", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    return pieces.repartition("node").sortWithinPartitions("node", "block").select("node", "ids").mapInArrow(run, "node long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node: node, conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, n_ends, ends_sha256.

    turns: (conv, pos, turn_key, words) as of positions(); convs: (conv, len), which may
    name conversations without turns. saved_tokens: what sharing each node of the
    subtree saves, its words times its members but one. No conversations: no rows.
    """
    turns, convs = stage(turns), stage(convs)
    paths = stage(prefixes(turns, convs))
    ends = stage(paths.join(convs.select("conv", F.col("len").alias("depth")), ["conv", "depth"]).select("conv", "node"))
    ended = ends.groupBy("node").agg(F.count("*").alias("n_ends"))
    nodes = paths.groupBy("node").agg(F.min("conv").alias("conv"), F.max("depth").alias("depth"), F.count("*").alias("n_convs")).join(ended, "node", "left").fillna(0, ["n_ends"])
    nodes = nodes.join(turns.select("conv", (F.col("pos") + 1).alias("depth"), "words"), ["conv", "depth"], "left")
    chain = stage(nodes.select("node", "conv", "depth", F.shiftright("depth", BLOCK_BITS).alias("block"), "n_convs", "n_ends", (F.coalesce("words", F.lit(0)) * (F.col("n_convs") - 1)).alias("saves")))

    own = Window.partitionBy("conv")
    later = own.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = chain.groupBy("conv", "block").agg(F.sum("saves").alias("sum"), F.min("depth").alias("lo"), F.max("depth").alias("hi"), F.max((F.col("n_ends") == F.col("n_convs")).cast("long")).alias("leaf"))
    blocks = stage(blocks.select("conv", "block", F.coalesce(F.sum("sum").over(later), F.lit(0)).alias("after"), F.sum("sum").over(own).alias("all"), F.min("lo").over(own).alias("top"), F.max("hi").over(own).alias("bottom"), F.max("leaf").over(own).alias("leaf")))

    # Each conversation that owns nodes, at the nodes above its own.
    above = blocks.where(F.col("block") == F.shiftright("top", BLOCK_BITS)).where("top > 0")
    above = above.select("conv", "all", "top", "leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("top") - 1, BLOCK_BITS))).alias("b"))
    above = above.select("conv", "all", "top", "leaf", F.explode(F.sequence(F.shiftleft("b", BLOCK_BITS), F.least(F.shiftleft(F.col("b") + 1, BLOCK_BITS), F.col("top")) - 1)).alias("depth"))
    above = stage(above.join(paths, ["conv", "depth"]))
    given = above.groupBy("node").agg(F.sum("all").alias("side_saves"), F.sum("leaf").alias("side_leaves"), F.sum((F.col("depth") == F.col("top") - 1).cast("long")).alias("side_children"))
    parents = above.where("depth = top - 1").select(F.col("conv"), F.col("top").alias("depth"), "node").join(chain.select("node", F.col("conv").alias("above_conv")), "node").select("conv", "depth", "above_conv")

    inner = F.sum("saves").over(Window.partitionBy("conv", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0))
    out = chain.withColumn("inner", inner).join(blocks, ["conv", "block"]).join(parents, ["conv", "depth"], "left").join(given, "node", "left").join(_digests(ends), "node", "left")
    side = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return out.select(
        "node", F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > F.col("top"), F.col("conv")).otherwise(F.col("above_conv")).alias("parent_conv_id"), "n_convs",
        ((F.col("depth") < F.col("bottom")).cast("long") + side("side_children")).alias("n_children"), (F.col("leaf") + side("side_leaves")).alias("n_leaves"),
        (F.col("inner") + F.col("after") + side("side_saves")).alias("saved_tokens"), "n_ends", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt with heads of up to three turns from every twentieth; see trie() and rebuild().

    Turns are ordered by turn (null first), role, text; null role or text is empty;
    rows without conv_id are left out; repeated rows are turns of their own. Empty table: no rows.
    """
    turns = stage(positions(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return trie(*rebuild(turns)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


ORACLE = {
    "op11_prefix_trie": r"""
with recursive base as (
  select conv_id::bigint c, coalesce(role, '') role, coalesce(text, '') text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 pos
  from conversations where conv_id is not null),
convs as (
  select c, c - c % 20 src, case when c % 20 = 0 then 0 else xor(list_reduce(list_concat([4294967295::ubigint],
    flatten(list_transform(string_split(c::varchar, ''), lambda x: [ord(x)::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint]))),
    lambda a, b: xor(xor(a, b) >> 1, case when xor(a, b) & 1 = 1 then 3988292384::ubigint else 0::ubigint end)), 4294967295::ubigint) % 4 end h
  from (select distinct c from base)),
parts as (
  select v.c, 0 own, b.pos, b.role, b.text from convs v join base b on b.c = v.src and b.pos < v.h
  union all
  select v.c, 1 own, b.pos, b.role, b.text from convs v join base b on b.c = v.c and b.pos >= v.h),
turns as (select c, role, text, row_number() over (partition by c order by own, pos) d from parts),
paths as (
  select c, 0 d, '' path, 0 words from convs
  union all
  select c, d, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') over (partition by c order by d) path, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) words from turns),
sized as (select *, max(d) over (partition by c) len from paths),
nodes as (
  select d, path, min(c) conv_id, count(*) n, max(words) words,
    sha256(coalesce(string_agg(case when d = len then c::varchar end, ',' order by c), '')) ends
  from sized group by d, path),
ids as (select s.c, s.d, n.conv_id, n.n, n.words, n.ends from sized s join nodes n on n.d = s.d and n.path = s.path),
named as (select i.conv_id, i.d depth, any_value(p.conv_id) parent, any_value(i.n) n, any_value(i.words) words, any_value(i.ends) ends from ids i left join ids p on p.c = i.c and p.d = i.d - 1 group by i.conv_id, i.d),
kids as (select parent, depth - 1 depth, count(*) k from named where depth > 0 group by parent, depth - 1),
full_nodes as (select n.*, coalesce(k, 0) k from named n left join kids on kids.parent = n.conv_id and kids.depth = n.depth),
below as (
  select distinct a.conv_id top, a.d top_depth, b.conv_id, b.d depth from ids a join ids b on a.c = b.c and b.d >= a.d)
select f.conv_id, f.depth::bigint depth, f.parent parent_conv_id, f.n::bigint n_convs, f.k::bigint n_children,
  sum(case when g.k = 0 then 1 else 0 end)::bigint n_leaves, sum((g.n - 1) * g.words)::bigint saved_tokens, f.ends ends_sha256
from full_nodes f join below w on w.top = f.conv_id and w.top_depth = f.depth join full_nodes g on g.conv_id = w.conv_id and g.depth = w.depth
group by f.conv_id, f.depth, f.parent, f.n, f.k, f.ends
""",
}
