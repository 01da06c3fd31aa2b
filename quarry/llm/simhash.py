"""SimHash near-dedup with pigeonhole blocks.

1. Fingerprints, map-side: every shingle's hash votes on each bit.
2. Equal fingerprints are one node (their smallest id); a group of exact copies is one row from here.
3. Blocks: fingerprints at most r bits apart, cut into B blocks, agree on at least B - r whole
   blocks; each choice of B - r blocks is a join key (seven blocks and r = 4: 35 keys of 27 bits).
4. Rows that share a key meet in one place, where a breadth-first search by Hamming distance links
   them: each row is taken up once, so a group of n gives at most n - 1 links, not its pairs, and
   nothing within the radius is left apart. A key with too many rows is cut into chunks, and every
   two of its chunks meet in a task of their own.
5. Components of the links.

Near copies by Jaccard similarity (near_groups) are searched exactly, by the prefixes of their sets of
shingles, and have no fingerprint.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import LOWER_AZ, blobs, join_counted, map_arrow, materialize, only_cache, slices, small, whole
from quarry.llm.graph import components

#: Rows of one key that meet in one task; beyond it the key is cut into chunks of half as many.
MEET = 4096
#: The same for rows of one shingle, which are heavier and compared by more.
MEET_SETS = 1024


def votes(hashes: np.ndarray) -> np.ndarray:
    """For an array (n, w) of 64-bit hashes: the (w,) words whose bits are set in over half of the rows."""
    n, w = hashes.shape
    counts = np.zeros(w * 64, np.int64)
    for i in range(0, n, 255):  # 255 rows fit byte-wide counters, eight to a word
        bits = np.unpackbits(np.ascontiguousarray(hashes[i : i + 255]).view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduce(bits.view(np.uint64), axis=0).view(np.uint8)
    return np.packbits(2 * counts > n, bitorder="little").view(np.uint64)


def shingle_hashes(text: bytes, k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the k-word shingles of a text, A-Z lower-cased, repeats included; fewer words are one shingle."""
    words = text.translate(LOWER_AZ).split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    ends = list(itertools.accumulate([len(w) + 1 for w in words]))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[a : b - 1], seed) for a, b in zip([0, *ends[: len(words) - k]], ends[k - 1 :], strict=True)]
    return np.array(hashes, np.uint64)


def fingerprint(text: bytes, k: int = 4, seed: int = 42) -> int:
    hashes = shingle_hashes(text, k, seed)
    return int(votes(hashes.reshape(-1, 1))[0]) if len(hashes) else 0


def block_keys(radius: int, blocks: int, bits: int = 64) -> list[list[tuple[int, int]]]:
    """Each key as a list of (shift, width) of the blocks that it joins."""
    edges = [bits * i // blocks for i in range(blocks + 1)]
    cuts = [(edges[i], edges[i + 1] - edges[i]) for i in range(blocks)]
    return [list(c) for c in itertools.combinations(cuts, blocks - radius)]


def link_bucket(nodes: list[int], prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join every two rows within radius: a breadth-first search that takes up each row once.

    prints is (n, w) of 64-bit words.
    """
    links, left = [], np.arange(len(nodes))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(prints[left] ^ prints[at]).sum(axis=1) <= radius
            if near.any():
                taken = left[near]
                links += [(nodes[at], nodes[i]) for i in taken]
                queue += list(taken)
                left = left[~near]
    return links


def _linker(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups():
            key, nodes, prints = None, [], []
            for batch in batches:
                for k, node, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    if k != key and nodes:
                        yield nodes, prints
                        nodes, prints = [], []
                    key = k
                    nodes.append(node)
                    prints.append(value)
            if nodes:
                yield nodes, prints

        out: list[tuple[int, int]] = []
        for nodes, prints in groups():
            if len(nodes) > 1:
                out += link_bucket(nodes, np.frombuffer(b"".join(prints), np.uint64).reshape(len(nodes), -1), radius)
                if len(out) > 50_000:
                    yield _links(out)
                    out = []
        yield _links(out)

    return run


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64())], ["a", "b"])


def _dealt(rows: DataFrame, most: int) -> DataFrame:
    """rows (key long, node long, n_rows: how many have the key, ...) with a part: a key of over most rows is cut into chunks, and every two of them meet in one part."""
    chunks = F.ceil(F.col("n_rows") / F.lit(max(1, most // 2))).cast("int")
    own = F.pmod(F.xxhash64("node"), chunks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.least(own, j) * chunks + F.greatest(own, j))
    parts = F.when(F.col("n_rows") <= most, F.array(F.lit(0))).otherwise(F.array_distinct(pairs))
    return rows.withColumn("part", F.explode(parts)).drop("n_rows")


def meet(rows: DataFrame, radius: int, most: int = MEET) -> DataFrame:
    """Links a, b among rows (key long, node long, print binary): all within radius that share a key are joined."""
    hot = materialize(rows.groupBy(F.col("key").alias("h_key")).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > most), "hot-keys")
    if hot.isEmpty():
        cut = rows.withColumn("part", F.lit(0))
    else:
        often = small(hot)
        cut = rows.join(often, F.col("key") == F.col("h_key"), "left_anti").withColumn("part", F.lit(0))
        cut = cut.unionByName(_dealt(rows.join(often, F.col("key") == F.col("h_key")).drop("h_key"), most))
    dealt = cut.select(F.xxhash64("key", "part").alias("meet"), "key", "part", "node", "print").repartition("meet").sortWithinPartitions("key", "part", "node")
    keyed = dealt.select(F.struct("key", "part").alias("k"), "node", "print")
    return map_arrow(keyed, _linker(radius), "a long, b long")


def _prints(docs: DataFrame, make: Callable[[bytes], tuple], fields: str, arrow: list, id_col: str, text_col: str, *more: str) -> DataFrame:
    """doc_id and what make gives for each text; columns of more (longs) go along, after the fields."""
    names = [x.split()[0] for x in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache("simhash")
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 500):  # what is made may be as large as the texts
                batch = whole_batch.slice(at, 500)
                made = [make(t) for t in blobs(batch.column(1))]
                columns = [pa.array([m[i] for m in made], kind) for i, kind in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *batch.columns[2:]], ["doc_id", *names, *more])

    schema = "".join(f", {m} long" for m in more)
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("t"), *more), run, f"doc_id long, {fields}{schema}")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def simhash_components(docs: DataFrame, k: int = 4, radius: int = 4, blocks: int = 7, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", most: int = MEET) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most radius differing bits.
    Texts without words (null, empty, white space) have fingerprint zero, linked like any other.
    Rows with a null id take part in links; a component of null ids alone has a null component_id.
    Repeated rows are judged each. An empty table gives an empty one.
    """
    prints = materialize(_prints(docs, lambda t: (_signed(fingerprint(t, k, seed)),), "print long", [pa.int64()], id_col, text_col), "simhash")
    nodes = materialize(prints.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_rows")), "nodes")
    keys = block_keys(radius, blocks)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = np.asarray(batch.column(0)).astype(np.int64)
            value, out = node.view(np.uint64), []
            for number, cuts in enumerate(keys):
                key = np.full(len(value), number, np.uint64)
                for shift, width in cuts:
                    key = (key << np.uint64(width)) | ((value >> np.uint64(shift)) & np.uint64((1 << width) - 1))
                out.append(key.view(np.int64))
            prints8 = [node[i : i + 1].tobytes() for i in range(len(node))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.tile(node, len(keys))), pa.array(prints8 * len(keys), pa.binary())], ["key", "node", "print"])

    spread = nodes.select("print").repartition(max(1, -(-nodes.count() // 20_000)), "print")  # a row becomes many
    rows = map_arrow(spread, expand, "key long, node long, print binary")
    found = components(meet(rows, radius, most))
    labelled = materialize(nodes.join(found, F.col("print") == F.col("node"), "left").select("print", "least", "n_rows", F.coalesce("component", "print").alias("c")), "labelled")
    smallest = materialize(labelled.groupBy(F.col("c").alias("c2")).agg(F.min("least").alias("component_id"), F.count("*").alias("n_prints")), "smallest")
    of = materialize(join_counted(labelled, smallest, [("c", "c2")], "n_prints").select(F.col("print").alias("p"), "component_id", "n_rows"), "labels")
    return join_counted(prints, of, [("print", "p")], "n_rows").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


#: Slots in which shingles are counted to tell common ones from rare ones, and slots of one row that is shuffled.
SLOTS, SLOT_ROW = 1 << 22, 1 << 14


def least_overlap(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Shingles that sets of n and m must share to be similar; rounding errors never raise it."""
    return np.ceil(similarity / (1 + similarity) * (n + m) - 1e-6)


def prefix(hashes: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a sorted set in an order that all sets share: rare before common by the counts of their slots, then by hash.

    Two sets that share similarity of their union share one of these: each lacks less than its prefix's length.
    """
    order = np.lexsort((hashes, counts[_slots(hashes, len(counts))]))
    return hashes[order[: len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-6)) + 1]]


def _slots(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (hashes >> np.uint64(11)).astype(np.int64) % slots  # the low bits are the parities'


def _counts(docs: DataFrame, k: int, text_col: str, slots: int = SLOTS) -> np.ndarray:
    """How often the distinct shingles of all documents fall on each slot.

    Every shingle of every document is counted; those of one slot together. The table has one size whatever the input, a
    task sends it once, and Spark adds up its rows. The counts only order the prefixes: any would be right, but the
    rarer the shingles of a prefix, the fewer candidates it has.
    """
    row = min(slots, SLOT_ROW)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache("simhash")
        held, at = np.zeros(slots, np.uint32), []
        for batch in slices(batches, 500):
            for t in blobs(batch.column(0)):
                at.append(_slots(np.unique(shingle_hashes(t, k)), slots))
            np.add.at(held, np.concatenate(at), np.uint32(1))
            at = []
        for i in range(0, slots, row):
            if held[i : i + row].any():
                yield pa.RecordBatch.from_arrays([pa.array([i // row], pa.int32()), pa.array([held[i : i + row].tobytes()], pa.binary())], ["part", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[part] = held.get(part, 0) + np.frombuffer(n, np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([*held], pa.int32()), pa.array([n.tobytes() for n in held.values()], pa.binary())], ["part", "n"])

    cores = docs.sparkSession.sparkContext.defaultParallelism  # as many tables are sent, however many parts the input has
    made = map_arrow(docs.select(whole(text_col).alias("t")).coalesce(cores), count, "part int, n binary")
    out = np.zeros(slots, np.uint32)
    found = map_arrow(made.repartition("part"), add, "part int, n binary").toArrow()  # one table of bounded size
    for part, n in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
        out[part * row : (part + 1) * row] = np.frombuffer(n, np.uint32)
    return out


def _longs(batch: pa.RecordBatch, names: tuple[str, ...]) -> list[np.ndarray]:
    return [np.asarray(batch.column(x)).astype(np.int64) for x in names]


def _may(n: np.ndarray, pos: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether rows i and j can be similar if this is the first shingle that they share: what is left of both suffices."""
    return np.minimum(n[i] - pos[i], n[j] - pos[j]) >= least_overlap(n[i], n[j], similarity)


def _pair_rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


#: Steps in a shingle's list within which every two nodes are candidates at once.
STEPS = 16


def _neighbours(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Candidates few steps apart in their key, in the order of size and node, which all keys share: in proportion to the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = _longs(batch, ("key", "node", "n", "pos"))
            key, node, n, pos = now if tail is None else [np.concatenate(c) for c in zip(tail, now, strict=True)]
            found = []
            for step in range(1, min(STEPS, len(key) - 1) + 1):
                i = np.flatnonzero(key[step:] == key[:-step])
                i = i[_may(n, pos, i, i + step, similarity)]
                found.append((node[i], node[i + step]))
            if found:
                yield _pair_rows(*(np.concatenate(c) for c in zip(*found, strict=True)))
            tail = [key[-STEPS:], node[-STEPS:], n[-STEPS:], pos[-STEPS:]]

    return run


def _across(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of a bucket (key and part, sorted) that aren't in one group and by size, place and parities may be near."""

    def pairs(node, n, pos, group, bits):
        if (group == group[0]).all():
            return
        order = np.argsort(n, kind="stable")
        node, n, pos, group, bits = (x[order] for x in (node, n, pos, group, bits))
        for i in range(len(n) - 1):
            end = np.searchsorted(n, n[i] / similarity + 1e-6, "right")  # sizes further apart can't be near
            j = np.arange(i + 1, end)
            j = j[group[j] != group[i]]
            j = j[_may(n, pos, np.full(len(j), i), j, similarity)]
            j = j[np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1) <= n[i] + n[j] - 2 * least_overlap(n[i], n[j], similarity)]
            if len(j):
                yield np.full(len(j), node[i]), node[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # parts of one bucket, which has a bounded number of rows
        a, b, size = [], [], 0

        def judged():
            nonlocal size
            for x, y in pairs(*(np.concatenate(c) for c in zip(*held, strict=True))):
                a.append(x)
                b.append(y)
                size += len(x)

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, part, node, n, pos, group = _longs(batch, ("key", "part", "node", "n", "pos", "grp"))
            bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(len(key), -1)
            edges = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
            for lo, hi in zip(edges, np.append(edges[1:], len(key)), strict=True):
                if (key[lo], part[lo]) != last and held:
                    judged()
                    held = []
                last = (key[lo], part[lo])
                held.append([x[lo:hi] for x in (node, n, pos, group, bits)])
                if size > 200_000:
                    yield _pair_rows(np.concatenate(a), np.concatenate(b))
                    a, b, size = [], [], 0
        if held:
            judged()
        if size:
            yield _pair_rows(np.concatenate(a), np.concatenate(b))

    return run


def parity(hashes: np.ndarray) -> bytes:
    """1024 bits, each the parity of the hashes that fall on it: two sets differ in as many hashes at least as these do in bits."""
    return np.packbits(np.bincount((hashes & np.uint64(1023)).astype(np.int64), minlength=1024) & 1).tobytes()


def _able(pairs: DataFrame, bits: DataFrame, similarity: float) -> DataFrame:
    """Pairs a, b whose sizes and parities (node, n, bits) let them be similar; no similar pair is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (np.asarray(batch.column(i)).astype(np.int64) for i in (2, 3))
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(len(n), -1) for i in (4, 5))
            kept = np.bitwise_count(x ^ y).sum(axis=1) <= n + m - 2 * least_overlap(n, m, similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(kept))

    left = pairs.join(bits.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("x")), "a")
    both = left.join(bits.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("y")), "b")
    return map_arrow(both.select("a", "b", "n_a", "n_b", "x", "y"), run, "a long, b long")


def _one_of_each_list(rows: DataFrame) -> DataFrame:
    """s_key, n_rows: of the shingles of rows (key, node, pos) that the very same nodes share, two at least, the first one.

    The shingles of a passage have one list of nodes: each would give its pairs again. All sets have them in one order, so
    the first has the smallest place in every node and rules out the least. Lists are told apart by length, least node and 64 bits
    of all nodes, which are hashes: for the many keys of one node, which are shuffled too, they repeat it, so it is packed.
    """
    lists = rows.groupBy("key").agg(F.count("*").alias("n_rows"), F.bit_xor("node").alias("x"), F.min(F.struct("node", "pos")).alias("first"))
    return lists.where("n_rows > 1").groupBy("n_rows", "x", "first.node").agg(F.min(F.struct("first.pos", "key")).alias("k")).select(F.col("k.key").alias("s_key"), "n_rows")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose whole sets (node, hashes: distinct longs) overlap enough."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    shared = both.select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("s"))
    return materialize(shared.where(F.col("s") >= similarity * (F.col("n") + F.col("m") - F.col("s")) - 1e-6).select("a", "b"), "links")


def near_groups(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", most: int = MEET_SETS) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), keep_id, keep_key for every document whose near-duplicate group has more than one.

    A document is an id with a text: two texts of one id are two documents, in one group only if they
    are near. keep_id and keep_key are those of the group's document of the smallest id, then key.

    Two documents are near when the Jaccard similarity of their sets of distinct k-word shingles (by
    64-bit hash) is ``similarity`` or more; groups are connected. The search is exact:

    1. Equal sets are one node. A node's prefix is its first shingles in an order that all nodes share,
       rare ones first; two near nodes share a shingle of their prefixes.
    2. Nodes at most 16 steps apart in a shingle's list are candidates; those whose whole sets overlap
       enough are linked. That joins most of a large group without its pairs.
    3. All other pairs of a longer list, of two groups and by size, place and parities able to be near, follow.

    128 bytes of parities a node bound the overlap of two sets from above; only pairs that pass leave a task.

    Texts without words and rows with a null id are in no group.
    """
    held = docs.sparkSession.sparkContext.broadcast(_counts(docs.where(F.col(id_col).isNotNull()), k, text_col))

    def make(text: bytes) -> tuple[int, int, bytes, bytes]:
        hashes = np.unique(shingle_hashes(text, k))
        return _signed(xxhash.xxh64_intdigest(hashes.tobytes())), len(hashes), prefix(hashes, held.value, similarity).tobytes() if len(hashes) else b"", parity(hashes)

    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("t"), F.xxhash64(whole(text_col)).alias("text_key"))
    made = _prints(source, make, "node long, n int, first binary, bits binary", [pa.int64(), pa.int32(), pa.binary(), pa.binary()], "doc_id", "t", "text_key")
    made = materialize(made.where("n > 0"), "prefixes")
    nodes = made.groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("least"), F.count("*").alias("n_rows"))
    nodes = materialize(nodes.select("node", F.col("least.doc_id").alias("x_id"), F.col("least.text_key").alias("x_key"), "n_rows"), "nodes")
    many = nodes.where("n_rows > 1").withColumnRenamed("node", "m_node")
    others = join_counted(made.select("doc_id", "text_key", "node"), many, [("node", "m_node")], "n_rows").where("doc_id <> x_id or text_key <> x_key")
    others = materialize(others.select(F.col("doc_id").alias("o_id"), F.col("text_key").alias("o_key")).distinct(), "others")
    alone = made.join(small(others), (F.col("doc_id") == F.col("o_id")) & (F.col("text_key") == F.col("o_key")), "left_anti")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, firsts = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2).to_pylist()
            lengths = np.array([len(x) // 8 for x in firsts], np.int64)
            pos = np.concatenate([np.arange(x, dtype=np.int32) for x in lengths]) if len(lengths) else np.empty(0, np.int32)
            columns = [np.frombuffer(b"".join(firsts), np.int64), np.repeat(node, lengths), np.repeat(n, lengths), pos]
            for i in range(0, len(pos), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000]) for c in columns], ["key", "node", "n", "pos"])

    if alone.count() > nodes.count():  # rows that repeat both id and text
        alone = alone.dropDuplicates(["node"])
    rows = map_arrow(alone.select("node", "n", "first"), expand, "key long, node long, n int, pos int")
    often = materialize(_one_of_each_list(rows), "shared-keys")
    shared = materialize(join_counted(rows, often, [("key", "s_key")], "n_rows").select("key", "node", "n", "pos", "n_rows"), "shared")
    bits = made.select("node", "n", "bits").join(small(materialize(shared.select(F.col("node").alias("s_node")).distinct(), "sharing")), F.col("node") == F.col("s_node"), "left_semi")
    bits = materialize(bits.groupBy("node", "n").agg(F.first("bits").alias("bits")), "bits")

    def whole_set(text: bytes) -> tuple[int, np.ndarray]:
        hashes = np.unique(shingle_hashes(text, k))
        return _signed(xxhash.xxh64_intdigest(hashes.tobytes())), hashes.view(np.int64)

    def verified(pairs: DataFrame) -> DataFrame:
        asked = pairs.select(F.col("a").alias("p_node")).union(pairs.select("b")).distinct()
        needed = materialize(nodes.join(asked, F.col("node") == F.col("p_node"), "left_semi").select("x_id", "x_key"), "needed")
        again = source.join(small(needed), (F.col("doc_id") == F.col("x_id")) & (F.col("text_key") == F.col("x_key")), "left_semi")
        sets = _prints(again, whole_set, "node long, hashes array<long>", [pa.int64(), pa.list_(pa.int64())], "doc_id", "t")
        sets = materialize(sets, "sets")
        if sets.count() > needed.count():  # rows that repeat both id and text
            sets = sets.groupBy("node").agg(F.first("hashes").alias("hashes"))
        return _verified(pairs, sets, similarity)

    # Short lists stay whole; a long one, which a third of all rows may share, goes on over many tasks.
    short = shared.where(F.col("n_rows") <= STEPS + 1).repartition("key")
    long = shared.where(F.col("n_rows") > STEPS + 1).repartitionByRange("key", "n", "node")
    steps = [map_arrow(x.sortWithinPartitions("key", "n", "node").select("key", "node", "n", "pos"), _neighbours(similarity), "a long, b long") for x in (short, long)]
    near = materialize(steps[0].unionByName(steps[1]).distinct(), "neighbours")
    links = verified(materialize(_able(near, bits, similarity), "able"))
    groups = components(links).select(F.col("node").alias("g_node"), F.col("component").alias("grp"))
    # Short lists have no pair left, nor have those of a single group.
    grouped = materialize(shared.where(F.col("n_rows") > STEPS + 1).join(groups, F.col("node") == F.col("g_node"), "left").select("key", "node", "n", "pos", F.coalesce("grp", "node").alias("grp")), "grouped")
    of_key = grouped.groupBy(F.col("key").alias("m_key")).agg(F.min("grp").alias("low"), F.max("grp").alias("high"), F.count("*").alias("n_rows"))
    mixed = materialize(of_key.where("low <> high").select("m_key", "n_rows"), "mixed")
    left = join_counted(grouped, mixed, [("key", "m_key")], "n_rows").select("key", "node", "n", "pos", "grp", "n_rows")
    left = _dealt(left, most).join(bits.select(F.col("node").alias("b_node"), "bits"), F.col("node") == F.col("b_node")).drop("b_node")
    met = left.select(F.xxhash64("key", "part").alias("meet"), "*").repartition("meet").sortWithinPartitions("key", "part").drop("meet")
    rest = map_arrow(met, _across(similarity), "a long, b long").distinct().join(near, ["a", "b"], "left_anti")
    links = links.unionByName(verified(materialize(rest, "rest")))

    found = components(links).select(F.col("node").alias("g_node"), F.col("component").alias("c"))
    labelled = materialize(nodes.join(found, F.col("node") == F.col("g_node"), "left").select(F.col("node").alias("l_node"), F.coalesce("c", "node").alias("c"), "n_rows"), "labelled")
    of = join_counted(made.select("doc_id", "text_key", "node"), labelled, [("node", "l_node")], "n_rows").select("doc_id", "text_key", "c")
    of = materialize(of.distinct(), "grouped")
    least = of.groupBy(F.col("c").alias("c2")).agg(F.min(F.struct("doc_id", "text_key")).alias("keep"), F.count("*").alias("n_docs")).where("n_docs > 1")
    return join_counted(of, materialize(least, "kept"), [("c", "c2")], "n_docs").select("doc_id", "text_key", F.col("keep.doc_id").alias("keep_id"), F.col("keep.text_key").alias("keep_key"))
