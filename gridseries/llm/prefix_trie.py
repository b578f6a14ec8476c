"""Prefix trie of conversations: one row for each distinct beginning.

A turn is named by 16 bytes of the SHA-256 of its role and text, so that a
conversation is a byte string of fixed-width big-endian names and the trie an
adaptive radix tree over such strings; only depths that are whole turns are nodes.

The trie is never in one place. Every beginning has a name of its own, the sum of
hashes of its (depth, turn) pairs, which running sums give for all turns. Long
conversations are cut into blocks of `BLOCK_TURNS` turns. Blocks are sorted by the name of what stands
before them and by their bytes and spread evenly; a task builds a radix tree for
each few thousand neighbours and gives one row per tree node. Adding up the rows
of equal names merges the trees. Neither a common beginning, nor copies of a
conversation, nor one endless conversation gather in a task.

Sums over subtrees need no walk over the whole trie. A node belongs to its
smallest member, and what a conversation owns is the lower end of its path. So
the tokens saved below a node are, summed over its members, the code points of
the turns from the node on that the member does not own; its leaves are the
members that own a childless node. Both add up in a second pass over the same blocks.

Cases: turns are ordered by turn (null first), then role and text by name; null roles and
texts are empty; rows without a conversation id belong to no conversation;
repeated rows are turns of their own; a conversation may become turnless and
then ends in the root; an empty table gives an empty result; other columns are
ignored. A negative id has a negative remainder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseries.llm.radix_tree import RadixTree
from gridseries.operators.timegrid import row_index
from gridseries.session import materialise

NAME_BYTES = 16
BLOCK_TURNS = 64
TREE_ROWS = 4096
CHUNK_IDS = 1024
HEAD_TURNS = 6  # a conversation takes fewer than so many turns of another
GROUP = 100
NAME_RANGE = 1 << 62
NODE = ["depth", "name_1", "name_2"]


def turn_name(role: Column, text: Column) -> Column:
    """Hexadecimal name of a turn; the length of the role keeps role and text apart."""
    named = F.concat_ws(":", F.octet_length(role).cast("string"), F.concat(role, text))
    return F.substring(F.sha2(named, 256), 1, 2 * NAME_BYTES)


def ordered_turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, part, pos, turn_name, chars): position of each turn; parts are stretches of the global order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = conversations.select(
        F.col(conv_col).cast("long").alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        turn_name(role, text).alias("turn_name"),
        F.char_length(text).cast("long").alias("chars"),
    ).filter("conv is not null")
    order = ["conv", "turn", "turn_name", "copy"]
    dealt = turns.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(*order)
    dealt = materialise(dealt.withColumn("part", F.spark_partition_id()), "turns")
    return row_index(dealt, order[1:], ["conv"], F.col("part"), "pos").select("conv", "part", "pos", "turn_name", "chars")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, part, depth, turn_name, chars) of the rebuilt conversations, and (conv) of all of them."""
    first = turns.filter(F.col("pos") < HEAD_TURNS - 1).groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("pos", "turn_name", "chars"))).alias("head")
    )
    convs = turns.select("conv").distinct()
    wanted = (F.crc32(F.col("conv").cast("string")) % HEAD_TURNS).cast("int")
    with_base = convs.withColumn("skip", wanted).withColumn("base", F.col("conv") - F.col("conv") % GROUP)
    heads = with_base.join(first.withColumnRenamed("conv", "base"), "base", "left").select(
        "conv", "skip", F.coalesce(F.slice("head", F.lit(1), F.col("skip")), F.array()).alias("head")
    )
    heads = materialise(heads, "heads")
    taken = heads.select("conv", F.posexplode("head").alias("at", "t")).select(
        "conv",
        F.lit(-1).alias("part"),
        (F.col("at") + 1).cast("long").alias("depth"),
        F.col("t.turn_name").alias("turn_name"),
        F.col("t.chars").alias("chars"),
    )
    own = turns.join(heads.select("conv", "skip", F.size("head").alias("n_head")), "conv").filter("pos >= skip")
    own = own.withColumn("depth", F.col("n_head") + F.col("pos") - F.col("skip") + 1)
    return taken.unionByName(own.select(*taken.columns)), heads.select("conv")


def with_names(rows: DataFrame) -> DataFrame:
    """Adds the names of what ends before (`before_k`) and with (`name_k`) each turn, and the code points before it."""
    wide = "decimal(20,0)"
    own = {
        "1": F.pmod(F.xxhash64("depth", "turn_name"), F.lit(NAME_RANGE)).cast(wide),
        "2": F.pmod(F.xxhash64("turn_name", "depth"), F.lit(NAME_RANGE)).cast(wide),
        "chars": F.col("chars").cast(wide),
    }
    rows = rows.withColumns({f"_{k}": value for k, value in own.items()})
    totals = rows.groupBy("conv", "part").agg(*[F.sum(f"_{k}").alias(f"_total_{k}") for k in own])
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "conv", "part", *[F.coalesce(F.sum(f"_total_{k}").over(earlier), F.lit(0)).alias(f"_offset_{k}") for k in own]
    )
    inside = Window.partitionBy("conv", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumns({f"_inside_{k}": F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0)) for k in own})
    placed = placed.join(offsets, ["conv", "part"])
    sums = {k: F.col(f"_offset_{k}") + F.col(f"_inside_{k}") for k in own}

    def name(total: Column) -> Column:
        return (total % F.lit(NAME_RANGE)).cast("long")

    return placed.select(
        "conv",
        "depth",
        "turn_name",
        "chars",
        *[name(sums[k]).alias(f"before_{k}") for k in "12"],
        *[name(sums[k] + F.col(f"_{k}")).alias(f"name_{k}") for k in "12"],
        sums["chars"].cast("long").alias("chars_before"),
    )


def blocks(named: DataFrame) -> DataFrame:
    """(conv, block, start_1, start_2, key, and lists over the block's turns)."""
    fields = ["depth", "turn_name", "before_1", "before_2", "name_1", "name_2", "chars", "chars_before"]
    block = F.floor((F.col("depth") - 1) / BLOCK_TURNS).alias("block")
    grouped = named.groupBy("conv", block).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("t"))
    return grouped.select(
        "conv",
        "block",
        F.col("t")[0]["before_1"].alias("start_1"),
        F.col("t")[0]["before_2"].alias("start_2"),
        F.unhex(F.array_join("t.turn_name", "")).alias("key"),
        *[F.col(f"t.{field}").alias(field) for field in fields if field not in ("depth", "turn_name")],
    )


def over_trees(rows: DataFrame, give: Callable[[list[dict], dict, int], tuple], fields: str) -> DataFrame:
    """Rows (depth, name_1, name_2, fields) for the nodes of radix trees over neighbouring blocks.

    `give(members, any member, place in the block)` returns the fields of one node of a tree.
    """
    schema = f"depth long, name_1 long, name_2 long, {fields}"
    columns = [field.split()[0] for field in schema.split(", ")]
    start = ["block", "start_1", "start_2"]

    def nodes(members: list[dict]) -> pa.RecordBatch:
        tree = RadixTree()
        for member in members:
            tree.add(member["key"], member)
        out = []
        for length, below in tree.aligned(NAME_BYTES):
            one, at = below[0], length // NAME_BYTES - 1
            depth = one["block"] * BLOCK_TURNS + at + 1
            out.append((depth, one["name_1"][at], one["name_2"][at], *give(below, one, at)))
        values = list(zip(*out, strict=True)) or [()] * len(columns)
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in values], columns)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (len(held) == TREE_ROWS or any(row[c] != held[0][c] for c in start)):
                    yield nodes(held)
                    held = []
                held.append(row)
        if held:
            yield nodes(held)

    order = [*start, "key", "conv"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(grow, schema)


def merged_nodes(cut: DataFrame) -> DataFrame:
    """One row per node but the root: its smallest member, number of members, parent's name and last turn's length."""

    def count(below: list[dict], one: dict, at: int) -> tuple:
        fixed = one["before_1"][at], one["before_2"][at], one["chars"][at]
        return min(m["conv"] for m in below), len(below), *fixed

    fields = "conv_id long, n_convs long, parent_1 long, parent_2 long, chars long"
    slim = cut.drop("chars_before")
    return over_trees(slim, count, fields).groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"),
        *[F.min(c).alias(c) for c in ("parent_1", "parent_2", "chars")],
    )


def subtree_sums(cut: DataFrame) -> DataFrame:
    """(node, n_leaves, saved_tokens) from blocks with `shared` and `leaf` of their conversation."""

    def add(below: list[dict], one: dict, at: int) -> tuple:
        before = one["chars_before"][at]
        return sum(m["leaf"] for m in below), sum(m["shared"] - before for m in below if m["shared"] > before)

    slim = cut.drop("before_1", "before_2", "chars")
    return over_trees(slim, add, "n_leaves long, saved_tokens long").groupBy(*NODE).agg(
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
    )


def hashed_ends(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): the conversations that end in each node, ascending, comma-joined, hashed.

    Ids are sorted in the cluster and joined piece by piece; only the hash itself
    runs through a node's pieces in order, holding one at a time.
    """
    keys = ["depth", "name_1", "name_2"]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def record() -> pa.RecordBatch:
            columns = [pa.array([v], pa.int64()) for v in (*node, ids[0])]
            return pa.RecordBatch.from_arrays([*columns, pa.array([",".join(map(str, ids))])], [*keys, "first", "ids"])

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in (*keys, "conv")], strict=True):
                if ids and (row[:3] != node or len(ids) == CHUNK_IDS):
                    yield record()
                    ids = []
                node = row[:3]
                ids.append(row[3])
        if ids:
            yield record()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*[(k, pa.int64()) for k in keys], ("ends_sha256", pa.string())])
        node, state = None, None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if own == node:
                    state.update(b",")
                else:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = own, hashlib.sha256()
                state.update(row["ids"].encode())
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d, strict=True)) for d in done], schema)
        if node is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*node, state.hexdigest()), strict=True))], schema)

    named = "depth long, name_1 long, name_2 long"
    order = [*keys, "conv"]
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = pieces.mapInArrow(chunks, f"{named}, first long, ids string")
    return pieces.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(digests, f"{named}, ends_sha256 string")


def prefix_trie(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    turns = materialise(ordered_turns(conversations, conv_col, turn_col, role_col, text_col), "placed_turns")
    rebuilt, convs = rebuilt_turns(turns)
    cut = materialise(blocks(with_names(rebuilt)), "blocks")

    last = F.size("name_1") - 1
    tails = cut.groupBy("conv").agg(F.max(F.struct("block", (last + 1).alias("n"), *[
        F.col(c)[last].alias(c) for c in ("name_1", "name_2", "chars", "chars_before")
    ])).alias("t"))
    ends = convs.join(tails, "conv", "left").select(
        "conv",
        F.coalesce(F.col("t.block") * BLOCK_TURNS + F.col("t.n"), F.lit(0)).cast("long").alias("depth"),
        *[F.coalesce(f"t.{c}", F.lit(0)).cast("long").alias(c) for c in ("name_1", "name_2")],
        F.coalesce(F.col("t.chars") + F.col("t.chars_before"), F.lit(0)).cast("long").alias("all_chars"),
    )
    ends = materialise(ends, "ends")

    nodes = materialise(merged_nodes(cut), "nodes")
    root = ends.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    zero = F.lit(0).cast("long")
    nothing = F.lit(None).cast("long")
    root = root.select(
        zero.alias("depth"), zero.alias("name_1"), zero.alias("name_2"), "conv_id", "n_convs",
        nothing.alias("parent_1"), nothing.alias("parent_2"), zero.alias("chars"),
    )
    every = nodes.unionByName(root)
    children = nodes.groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("parent_1").alias("name_1"), F.col("parent_2").alias("name_2")
    ).agg(F.count(F.lit(1)).alias("n_children"))
    every = every.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero))
    every = materialise(every, "trie_nodes")

    owned = every.groupBy(F.col("conv_id").alias("conv")).agg(
        F.sum("chars").alias("owned"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf")
    )
    shares = ends.join(owned, "conv", "left").select(
        "conv",
        (F.col("all_chars") - F.coalesce("owned", zero)).alias("shared"),
        F.coalesce("leaf", zero).alias("leaf"),
    )
    shares = materialise(shares, "shares")
    sums = subtree_sums(cut.join(shares, "conv"))
    all_sums = shares.agg(F.sum("leaf").alias("n_leaves"), F.sum("shared").alias("saved_tokens"))
    sums = sums.unionByName(all_sums.select(zero.alias("depth"), zero.alias("name_1"), zero.alias("name_2"), "*"))

    parents = every.select(
        (F.col("depth") + 1).alias("depth"), F.col("name_1").alias("parent_1"), F.col("name_2").alias("parent_2"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    none = hashlib.sha256(b"").hexdigest()
    return (
        every.join(sums, NODE)
        .join(parents, ["depth", "parent_1", "parent_2"], "left")
        .join(hashed_ends(ends.drop("all_chars")), NODE, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
        )
    )
