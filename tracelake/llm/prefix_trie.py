"""The trie of conversation prefixes, by partition refinement.

All conversations are one class, the root. A class is split by the next turn of its members, turn after turn; each
part is a node. A part with a single member is retired: what is left of that conversation is a chain of nodes with
one member, which come straight from its turns. What remains, shared nodes, is folded back to sums over subtrees.

Turns are told apart by 128 bits of a hash of role and text, which travel instead of the texts. A round splits
active classes at the next BLOCK turns at once: a member's next turns are one row, whose prefixes are the
parts. So there are as many rounds as the longest shared prefix has blocks, and one more. Members are grouped with
partial aggregation, classes of any size; a row holds at most BLOCK turns. The fold takes the rounds in reverse:
each node adds its leaves and saved bytes to the nodes above it in its block and to the class that the block began
with. Ids of conversations that end in a node are hashed in chunks of sorted ids, formatted in parallel; only the
chunks of one node, in order, are one task's.

Rows without conv_id belong to no conversation. Null role or text count as empty; a null turn comes first. Turns
with the same number follow each other by the hash of role and text, so repeated rows are turns of their own.
Without conversations there is no root and no row. Extra columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm._shared import arrow_limits, cut

#: Turns at which a round splits.
BLOCK = 16
#: Turn numbers in a slot: a conversation is numbered slot by slot.
SLOT = 4096
#: Ids of conversations in a chunk that is hashed.
CHUNK = 1 << 16
ROOT = "0" * 32


def _hash(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 32)


def numbered(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, place (from 1), hash and size (bytes of the text) of every turn."""
    who, said = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    # The length of the role keeps ("a", "b") and ("ab", "") apart.
    mark = _hash(F.encode(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said), "UTF-8"))
    rows = conversations.select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), mark.alias("hash"), F.octet_length(said).cast("long").alias("size"))
    rows = rows.filter("conv_id is not null").withColumn("slot", F.coalesce(F.floor(F.col("turn") / SLOT), F.lit(-(1 << 62))))
    sizes = rows.groupBy("conv_id", "slot").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # one row a slot
    before = sizes.select("conv_id", "slot", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "slot").orderBy(F.asc_nulls_first("turn"), "hash"))
    return rows.withColumn("inside", inside).join(before, ["conv_id", "slot"]).select("conv_id", (F.col("before") + F.col("inside")).alias("place"), "hash", "size")


def grafted(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations c that begin with the first h turns of conversation c - c % every and go on with their own
    after the first h; h is crc32(c) % most. Gives the turns, and conv_id and length of every conversation."""
    lengths = turns.groupBy("conv_id").agg(F.max("place").alias("length"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    base = (F.col("conv_id") - F.col("conv_id") % every).alias("base")
    members = lengths.select("conv_id", "length", h, base).join(lengths.select(F.col("conv_id").alias("base"), F.col("length").alias("there")), "base", "left")
    members = members.withColumn("graft", F.least("h", F.coalesce("there", F.lit(0)))).drop("there")
    own = turns.join(members.select("conv_id", "h", "graft"), "conv_id").filter("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("graft")).alias("place"), "hash", "size")
    heads = turns.filter((F.col("place") < most) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "base")
    taken = heads.join(members.select("base", "conv_id", "graft"), "base").filter("place <= graft").select("conv_id", "place", "hash", "size")
    return own.unionByName(taken), members.select("conv_id", (F.col("graft") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length"))


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: the turns, and conv_id and length of every conversation."""
    return turns, turns.groupBy("conv_id").agg(F.max("place").alias("length"))


def _rows_of_ends(ends: DataFrame) -> DataFrame:
    """key and ends_sha256 from rows of key and conv_id: the hash of a key's ids, ascending, joined by commas."""

    def chunks(batches):
        key, first, parts, n = None, None, [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([first], pa.int64()), pa.array([",".join(parts)])], names=["key", "first", "ids"])

        for batch in batches:
            keys, ids = batch.column(0), np.asarray(batch.column(1))
            runs = keys.dictionary_encode()
            edges = np.flatnonzero(np.diff(np.asarray(runs.indices))) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(ids)]):
                if a == b:
                    continue
                own = keys[a].as_py()
                if parts and (own != key or n >= CHUNK):
                    yield out()
                    parts, n = [], 0
                if not parts:
                    key, first = own, int(ids[a])
                parts.append(",".join(map(str, ids[a:b].tolist())))
                n += b - a
        if parts:
            yield out()

    def digests(batches):
        key, state = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

        for batch in batches:
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if own != key:
                    if key is not None:
                        yield out()
                    key, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if key is not None:
            yield out()

    made = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(chunks, "key string, first long, ids string")
    return made.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digests, "key string, ends_sha256 string")


def _split(turns: DataFrame, active: DataFrame, low: int) -> DataFrame:
    """A row an active conversation: keys of its prefixes that end in the block after ``low``, and their sizes."""
    here = turns.filter((F.col("place") > low) & (F.col("place") <= low + BLOCK))
    rows = here.join(active, "conv_id").groupBy("conv_id", "class", "length").agg(F.sort_array(F.collect_list(F.struct("place", "hash", "size"))).alias("next"))
    hashes = F.transform("next", lambda t: t["hash"])
    prefix = lambda t, i: _hash(F.col("class"), F.array_join(F.slice(hashes, F.lit(1), i + 1), ""))
    return rows.select("conv_id", "class", "length", F.transform("next", prefix).alias("keys"), F.transform("next", lambda t: t["size"]).alias("sizes"))


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    turns: conv_id, place from 1 without gaps, hash, size; members: conv_id, length."""
    spark = turns.sparkSession
    arrow_limits(spark)
    turns = cut(turns, "turns")
    active = members.select("conv_id", F.col("length").cast("long").alias("length"), F.lit(ROOT).alias("class"))
    members = active = cut(active, "members")
    root = members.groupBy().agg(F.count("*").alias("n"), F.min("conv_id").alias("rep"), F.count_if(F.col("length") == 0).alias("ends")).filter("n > 0")
    ends = [members.filter("length = 0").select(F.col("class").alias("key"), "conv_id")]
    rounds = []
    while not rounds or not active.isEmpty():
        low = BLOCK * len(rounds)
        rows = cut(_split(turns, active, low), "prefixes")
        each = rows.select("conv_id", "class", "length", "keys", F.posexplode(F.arrays_zip("keys", "sizes")).alias("at", "x"))
        parent = F.when(F.col("at") == 0, F.col("class")).otherwise(F.get("keys", F.col("at") - 1))
        depth = (low + 1 + F.col("at")).cast("long")
        each = each.select(F.col("x.keys").alias("key"), F.col("x.sizes").alias("size"), parent.alias("parent"), depth.alias("depth"), "conv_id", (F.col("length") == depth).alias("last"))
        nodes = cut(each.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("rep"), F.count_if("last").alias("ends"), *(F.first(c).alias(c) for c in ("size", "parent", "depth"))), "nodes")
        # A part with one member: that conversation is retired where it is first alone.
        alone = nodes.filter("n = 1").groupBy(F.col("rep").alias("conv_id")).agg(F.min("depth").alias("since"))
        retired = cut(rows.join(alone, "conv_id").select("conv_id", "length", "since", F.when(F.col("since") == low + 1, F.col("class")).otherwise(F.get("keys", (F.col("since") - low - 2).cast("int"))).alias("parent")), "retired")
        stay = rows.join(retired.select("conv_id"), "conv_id", "left_anti")
        ends.append(stay.filter(F.col("length") <= low + BLOCK).select(F.element_at("keys", F.size("keys")).alias("key"), "conv_id"))
        active = cut(stay.filter(F.col("length") > low + BLOCK).select("conv_id", "length", F.element_at("keys", BLOCK).alias("class")), "active")
        rounds.append((rows, nodes.filter("n > 1"), retired))

    names = ["leaves", "saved", "children"]
    folded, carried = [], None
    for low, (rows, shared, retired) in reversed([(BLOCK * i, r) for i, r in enumerate(rounds)]):
        own = shared.select("key", F.col("rep").alias("conv_id"), "depth", (F.col("ends") == F.col("n")).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("size")).alias("saved"))
        if carried is not None:  # what the block below found for the classes that it began with
            more = carried.select("key", *(F.col(c).alias("more_" + c) for c in ("leaves", "saved")))
            own = own.join(more, "key", "left").select("key", "conv_id", "depth", *((F.col(c) + F.coalesce("more_" + c, F.lit(0))).alias(c) for c in ("leaves", "saved")))
        single = retired.select("conv_id", F.col("since").alias("depth"), F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
        below = own.drop("key").unionByName(single).join(rows.select("conv_id", "class", "keys"), "conv_id")
        place = (F.col("depth") - low).cast("int")
        path = F.concat(F.array("class"), F.slice("keys", F.lit(1), place))
        up = below.select("leaves", "saved", place.alias("place"), F.posexplode(path).alias("at", "key"))
        sums = up.groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count_if(F.col("at") == F.col("place") - 1).alias("children"))
        carried = cut(sums, "folded")
        folded.append(carried)
    # A node at the end of a block has its own leaves and bytes from its block, its children from the next one.
    total = folded[0]
    for one in folded[1:]:
        total = total.unionByName(one)
    total = total.groupBy("key").agg(F.max("leaves").alias("leaves"), F.max("saved").alias("saved"), F.max("children").alias("children"))

    top = root.select(F.lit(ROOT).alias("key"), "n", "rep", "ends", F.lit(0).cast("long").alias("size"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"))
    shared = top
    for _, one, _ in rounds:
        shared = shared.unionByName(one.select(*top.columns))
    nodes = shared.join(total, "key", "left").join(_rows_of_ends(_union(ends)), "key", "left")
    none, zero = F.sha2(F.lit(""), 256), F.lit(0).cast("long")
    nodes = nodes.select(
        F.col("rep").alias("conv_id"), "depth", "parent", F.col("n").alias("n_convs"), F.coalesce("children", zero).alias("n_children"),
        F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("saved", zero).alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
    tails = turns.select("conv_id", F.col("place").cast("long").alias("depth")).join(_union([r for _, _, r in rounds]), "conv_id").filter("depth >= since")
    is_end = F.col("depth") == F.col("length")
    chains = tails.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("since"), F.col("parent")).alias("parent"), F.lit(1).cast("long").alias("n_convs"), (~is_end).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"), F.when(is_end, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(none).alias("ends_sha256"),
    )
    results = ["n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    reps = shared.select(F.col("key").alias("parent"), F.col("rep").alias("parent_conv_id"))
    headed = nodes.unionByName(chains.filter("parent is not null")).join(reps, "parent", "left")
    rest = chains.filter("parent is null").withColumn("parent_conv_id", F.col("conv_id"))
    return headed.select("conv_id", "depth", "parent_conv_id", *results).unionByName(rest.select("conv_id", "depth", "parent_conv_id", *results))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for one in parts[1:]:
        out = out.unionByName(one)
    return out


def last_turns(nodes: DataFrame, conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """nodes of the trie over ``whole(numbered(conversations))`` with role and text of their last turn: null for the
    root. Turns with the same number come in the order of their hash, as in numbered()."""
    who, said = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    mark = _hash(F.encode(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said), "UTF-8"))
    texts = conversations.select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"), mark.alias("hash"), who.alias("role"), said.alias("text")).filter("conv_id is not null").dropDuplicates(["conv_id", "hash"])
    marks = numbered(conversations, conv_id, turn, role, text).select("conv_id", F.col("place").alias("depth"), "hash")
    return nodes.join(marks, ["conv_id", "depth"], "left").join(texts, ["conv_id", "hash"], "left").drop("hash")
