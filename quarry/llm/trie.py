"""A prefix trie of conversations, built level by level.

Every distinct sequence of the first d turns of a conversation is a node of depth d. Texts are read once:
from then on a turn is a digest of its role and text, and its bytes. A level groups the live conversations
by (parent node, next turn); the least conv_id of a group names its node. A conversation that is alone in
its node is no longer live: what follows is a chain, written down without further grouping. So there is
one level of work for each depth at which at least two conversations are alike, whatever their lengths.
Then, from the deepest level up, joins add each level's leaves and savings to its parents'.

Order: by turn, null first; rows of one turn by their digest. A null role or text counts as empty, and a row
that repeats is a turn of its own. Rows without a conv_id are left out. An empty table has no node, not
even the root. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import HOT_KEYS, join_counted, map_arrow, materialize, whole

#: A key with so many rows or fewer is never taken for a hot one.
FEW = 4096
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NOTHING = hashlib.sha256(b"").hexdigest()


def number_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, place (from 0), key (a digest of role and text), bytes (of the text): every row with its place in its conversation.

    A conversation may hold any share of the rows: they are sorted by ranges of (conv_id, turn, key), places
    are counted within a range, and a conversation that began in earlier ranges is shifted by its rows there.
    """
    role, text = whole(f"`{role_col}`").cast("binary"), whole(f"`{text_col}`").cast("binary")
    turn = F.concat(F.octet_length(role).cast("string").cast("binary"), F.lit(b":"), role, text)
    key = F.unhex(F.substring(F.sha2(turn, 256), 1, 32))
    light = conversations.select(F.col(f"`{id_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    light = materialize(light.where("conv_id is not null"), "turns")
    order = ["conv_id", "turn", "key"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, seen = None, 0  # the conversation that the last batch ended with, and its rows so far
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.asarray(batch.column(0))
            starts = np.concatenate(([True], ids[1:] != ids[:-1]))
            first = np.maximum.accumulate(np.where(starts, np.arange(len(ids)), 0))
            place = np.arange(len(ids)) - first
            if ids[0] == before:
                place[first == 0] += seen
            before, seen = ids[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], ["conv_id", "key", "bytes", "part", "place"])

    ranged = light.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "key", "bytes", F.spark_partition_id().alias("part"))
    ordered = materialize(map_arrow(ranged, count, "conv_id long, key binary, bytes long, part int, place long"), "ordered")
    by_part = Window.partitionBy("conv_id").orderBy("part")
    lengths = ordered.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = lengths.withColumn("earlier", F.sum("n").over(by_part) - F.col("n")).where("earlier > 0").select("conv_id", "part", "earlier")
    shifted = ordered.join(F.broadcast(earlier), ["conv_id", "part"], "left")  # at most one row a part
    return materialize(shifted.select("conv_id", (F.col("place") + F.coalesce("earlier", F.lit(0))).alias("place"), "key", "bytes"), "numbered")


def whole_conversations(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What build takes, of conversations as they are: every turn with its depth, and every conversation's length."""
    turns = numbered.select("conv_id", (F.col("place") + 1).alias("depth"), "key", "bytes")
    return materialize(turns, "turns"), materialize(turns.groupBy("conv_id").agg(F.max("depth").alias("length")), "lengths")


def graft(numbered: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """What build takes, of conversations that go on from another: every conversation c begins with the first h turns of conversation c - c % every, then has its own after its first h.

    h is crc32 of c's decimal digits modulo ``most``. A conversation may lose all its turns: it stays, with length 0.
    """
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    lengths = materialize(numbered.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", taken), "own-lengths")
    first = numbered.where((F.col("conv_id") % every == 0) & (F.col("place") < most - 1))
    heads = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "key", "bytes"))).alias("head"))  # most - 1 at most
    based = lengths.join(heads.withColumnRenamed("conv_id", "base"), F.col("conv_id") - F.col("conv_id") % every == F.col("base"), "left")
    given = based.select("conv_id", "n", "h", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), 1, F.col("h").cast("int")).alias("head"))
    given = materialize(given, "grafts")
    begun = given.select("conv_id", F.explode("head").alias("t")).select("conv_id", (F.col("t.place") + 1).alias("depth"), "t.key", "t.bytes")
    shifts = materialize(given.select(F.col("conv_id").alias("c"), "n", "h", F.size("head").cast("long").alias("got")), "shifts")
    own = join_counted(numbered, shifts, [("conv_id", "c")], "n", least=FEW).where("place >= h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("got") + 1).alias("depth"), "key", "bytes")
    total = shifts.select(F.col("c").alias("conv_id"), (F.col("got") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    return materialize(begun.unionByName(own).sortWithinPartitions("depth"), "grafted"), materialize(total, "lengths")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, int]]:
    """Each run of rows of one (depth, node), the first two columns: the node, where it begins and where it ends."""
    depth, node = (np.asarray(batch.column(i)) for i in (0, 1))
    bounds = [0, *(np.flatnonzero((depth[1:] != depth[:-1]) | (node[1:] != node[:-1])) + 1).tolist(), batch.num_rows]
    for low, high in zip(bounds, bounds[1:]):
        if low < high:
            yield (int(depth[low]), int(node[low])), low, high


#: conv_ids in one written-out piece.
PIECE = 1 << 16


def _digests(ends: DataFrame) -> DataFrame:
    """depth, node, ends_sha256. conv_ids are sorted by ranges and written out in pieces there; a node's pieces stream through one digest in order.

    A digest has to be of one task, so a node with very many ends costs it the reading of their pieces, one at a time.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []  # the node of the ids held
        piece = lambda: pa.RecordBatch.from_arrays([*(pa.array([x]) for x in (*at, held[0])), pa.array([b",".join(b"%d" % i for i in held)], pa.binary())], ["depth", "node", "first", "ids"])
        for batch in batches:
            for node, low, high in _runs(batch):
                ids = np.asarray(batch.column(2))[low:high].tolist()
                if held and (node != at or len(held) + len(ids) > PIECE):
                    yield piece()
                    held = []
                at, held = node, held + ids
        if held:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, found.hexdigest())], ["depth", "node", "ends_sha256"])
        for batch in batches:
            for node, low, high in _runs(batch):
                for ids in batch.column(3).slice(low, high - low):
                    if node == at:
                        found.update(b"," + ids.as_py())
                        continue
                    if at is not None:
                        yield out()
                    at, found = node, hashlib.sha256(ids.as_py())
        if at is not None:
            yield out()

    order = ["depth", "node", "conv_id"]
    pieces = map_arrow(ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order), write, "depth long, node long, first long, ids binary")
    pieces = materialize(pieces, "pieces")
    return map_arrow(pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "first"), digest, "depth long, node long, ends_sha256 string")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def build(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of a trie: conv_id (the least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns (conv_id, depth from 1 without gaps, key, bytes) and lengths (conv_id, length; conversations
    without turns too) are written tables. A node is named by its depth and least member. saved_tokens sums
    (n_convs - 1) * bytes of the last turn over the subtree; ends_sha256 digests the members that end there.
    """
    spark, long = turns.sparkSession, lambda n: F.lit(n).cast("long")
    count, least = lengths.agg(F.count("*"), F.min("conv_id")).first()
    if not count:
        return spark.createDataFrame([], NODE)
    # Level by level down. shared: nodes of two members or more, and the root; alone: where a conversation is on its own.
    shared = [spark.createDataFrame([(least, None, count, 0)], "node long, parent long, n long, bytes long")]
    alone, ends = [], [lengths.where("length = 0").select(long(0).alias("depth"), long(least).alias("node"), "conv_id")]
    live = lengths.select("conv_id", long(least).alias("parent"), "length")
    while True:
        depth = len(shared)
        step = live.where(F.col("length") >= depth).join(turns.where(F.col("depth") == depth).drop("depth"), "conv_id")
        group = step.groupBy("parent", "key").agg(F.min("conv_id").alias("node"), F.count("*").alias("n"), F.min("bytes").alias("size"))
        group = materialize(group.withColumnsRenamed({"parent": "of", "key": "by"}), "level")
        nodes, many, members, most = group.agg(F.count("*"), F.count_if(F.col("n") > 1), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        if nodes:
            alone.append(group.where("n = 1").select(F.col("node").alias("conv_id"), long(depth).alias("since"), F.col("of").alias("parent")))
        if not many:
            break
        together = group.where("n > 1")
        shared.append(together.select("node", F.col("of").alias("parent"), "n", F.col("size").alias("bytes")))
        keys = [("parent", "of"), ("key", "by")]
        if most > max(FEW, members / HOT_KEYS):
            placed = join_counted(materialize(step, "step"), together, keys, "n", least=FEW)
        else:
            placed = step.join(together, [F.col(a) == F.col(b) for a, b in keys])
        placed = materialize(placed.select("conv_id", F.col("node").alias("parent"), "length"), "placed")
        ends.append(placed.where(F.col("length") == depth).select(long(depth).alias("depth"), F.col("parent").alias("node"), "conv_id"))
        live = placed
    # Level by level up.
    rolled, below = [], None
    for depth in range(len(shared) - 1, -1, -1):
        kids = [below] if below is not None else []
        if depth < len(alone):
            kids.append(alone[depth].select("parent", long(1).alias("leaves"), long(0).alias("saved")))
        here = shared[depth].select("node", "parent", "n", ((F.col("n") - 1) * F.col("bytes")).alias("own"))
        if kids:
            sums = _union(kids).groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
            here = here.join(sums, F.col("node") == F.col("of"), "left")
        else:
            here = here.withColumns({"children": F.lit(None).cast("long"), "leaves": F.lit(None).cast("long"), "saved": F.lit(None).cast("long")})
        here = here.select("node", "parent", "n", F.coalesce("children", long(0)).alias("children"), F.coalesce("leaves", long(1)).alias("leaves"), (F.col("own") + F.coalesce("saved", long(0))).alias("saved"))
        here = materialize(here, "rolled")
        rolled.append(here.withColumn("depth", long(depth)))
        below = here.select("parent", "leaves", "saved")
    digests = materialize(_digests(_union(ends)), "digests").withColumnsRenamed({"depth": "d", "node": "c"})
    top = _union(rolled).join(digests, (F.col("depth") == F.col("d")) & (F.col("node") == F.col("c")), "left")
    found = top.select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"),
    )
    return found.unionByName(_chains(turns, lengths, _union(alone))) if alone else found


def _chains(turns: DataFrame, lengths: DataFrame, single: DataFrame) -> DataFrame:
    """The nodes of conversations from where they are alone."""
    held = single.withColumnRenamed("conv_id", "c").join(lengths.withColumnRenamed("conv_id", "l"), F.col("c") == F.col("l")).select("c", "since", "parent", "length")
    rows = join_counted(turns.select("conv_id", "depth"), materialize(held, "alone"), [("conv_id", "c")], "length", least=FEW).where("depth >= since")
    last: Column = F.col("depth") == F.col("length")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return rows.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") == F.col("since"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        one.alias("n_convs"), F.when(last, none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(_NOTHING).alias("ends_sha256"),
    )
