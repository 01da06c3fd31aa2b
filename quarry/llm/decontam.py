"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item is the set of its windows (13 words; a shorter item is one window). Each window
is a list of shingles (word pairs; one word where it has no pair). Containment of the whole window
needs all of its shingles, so the prefix of one shingle, the rarest in the corpus, suffices: pass 1
counts the benchmark's shingles over all documents, pass 2 looks up the rarest shingle of each
window, drops candidates by length and position (the window must fit between the document's first
and last word at that offset) and confirms the exact words.

The windows travel to the documents in blocks of bounded size, so no text is shuffled; with more
than one block, the blocks' findings are merged by document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ALNUM, blobs, map_arrow, materialize, only_cache, slices, whole

WINDOW = 13
#: Bytes of benchmark text in a block; a block's windows take about fifteen times as much.
BLOCK_BYTES = 4 << 20


def words_of(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII digits, letters (A-Z lower-cased) and all non-ASCII characters."""
    return text.translate(ALNUM).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[list[bytes]]:
    return [words[i : i + size] for i in range(max(1, len(words) - size + 1))] if words else []


def _shingles(window: list[bytes]) -> list[tuple[bytes, ...]]:
    return [*zip(window, window[1:], strict=False)] or [(window[0],)]


def _count(first: dict[bytes, set], single: set):
    """Counts the benchmark's shingles over a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches):
            for text in blobs(batch.column(0)):
                words = words_of(text)
                seen.update(w for w in words if w in single)
                n = len(words) - 1
                for i, w in enumerate(words):
                    if w in first and i < n and words[i + 1] in first[w]:
                        seen[(w, words[i + 1])] += 1
        keys = [b" ".join(k) if isinstance(k, tuple) else k for k in seen]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(list(seen.values()), pa.int64())], ["shingle", "n"])

    return run


def rarity(docs: DataFrame, items: list[tuple], text_col: str) -> dict[bytes, int]:
    """Occurrences over all documents of the shingles of items; at most one row a shingle reaches the driver."""
    first: dict[bytes, set] = {}
    single: set[bytes] = set()
    for _, words in items:
        if len(words) == 1:
            single.add(words[0])
        for a, b in zip(words, words[1:], strict=False):
            first.setdefault(a, set()).add(b)
    held = docs.sparkSession.sparkContext.broadcast((first, single))

    def run(batches):
        yield from _count(*held.value)(batches)

    counts = map_arrow(docs.select(whole(text_col).alias("t")), run, "shingle binary, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return {bytes(r.shingle): r.n for r in counts.collect()}


def build_index(items: list[tuple], counts: dict[bytes, int], size: int = WINDOW) -> dict:
    """shingle's first word -> second word (None: a single word) -> {(offset, length): {window: items}}."""
    index: dict = {}
    for item, words in items:
        for window in windows_of(words, size):
            shingles = _shingles(window)
            at = min(range(len(shingles)), key=lambda i: (counts.get(b" ".join(shingles[i]), 0), shingles[i], i))
            second = shingles[at][1] if len(shingles[at]) == 2 else None
            index.setdefault(shingles[at][0], {}).setdefault(second, {}).setdefault((at, len(window)), {}).setdefault(b" ".join(window), set()).add(item)
    return index


def find(words: list[bytes], index: dict) -> tuple[list[tuple[int, int]], set]:
    """The merged ranges of hit words and the items of the windows that occur."""
    n, ranges, found = len(words), [], set()
    for i, w in enumerate(words):
        if w not in index:
            continue
        by_second = index[w]
        for second in (words[i + 1] if i + 1 < n else None, None):
            for (offset, length), known in by_second.get(second, {}).items():
                start = i - offset
                if start < 0 or start + length > n:  # length and position
                    continue
                items = known.get(b" ".join(words[start : start + length]))
                if items:
                    ranges.append((start, start + length))
                    found |= items
            if second is None:
                break
    return merge(ranges), found


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


FOUND = "doc_id {id}, text_key long, n_words long, starts array<int>, ends array<int>, item_ids array<string>"


def _scan(docs: DataFrame, index: dict, id_col: str, text_col: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(index)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache("decontam")
        for batch in slices(batches):
            n_words, starts, ends, items = [], [], [], []
            for text in blobs(batch.column(2)):
                words = words_of(text)
                ranges, found = find(words, held.value)
                n_words.append(len(words))
                starts.append([a for a, _ in ranges])
                ends.append([b for _, b in ranges])
                items.append(sorted(x for x in found if x is not None))
            columns = [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n_words", "starts", "ends", "item_ids"])

    text = whole(text_col)
    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("t")), run, FOUND.format(id=kind))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, item_ids (sorted strings), contaminated,
    and text_key, the hash of the text, which tells rows of one id apart.

    A document word inside any occurrence of an item's window is hit; contaminated means n_hit > 0
    and 20 * n_hit >= n_words. Null texts have no words and are never contaminated. Items without
    words have no window; an item with a null id marks words but is not counted. Repeated items count
    once an id; repeated documents are judged each. An empty benchmark hits nothing.
    """
    size = benchmark.agg(F.sum(F.octet_length(F.col(item_text)).cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    found = []
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        rows = [(r.i, words_of(r.t.encode())) for r in part.toLocalIterator()]
        rows = [(i, w) for i, w in rows if w]
        found.append(_scan(docs, build_index(rows, rarity(docs, rows, text_col) if rows else {}), id_col, text_col))
    if blocks == 1:
        merged = found[0]
    else:
        union = materialize(found[0].unionByName(found[1]) if blocks == 2 else _union(found), "decontam")
        merged = union.groupBy("doc_id", "text_key").agg(
            F.first("n_words").alias("n_words"), F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        )  # one row a block and document: bounded
        rows = docs.select(F.col(id_col).alias("r_id"), F.xxhash64(whole(text_col)).alias("r_key"))
        merged = rows.join(merged, F.col("r_id").eqNullSafe(F.col("doc_id")) & (F.col("r_key") == F.col("text_key"))).drop("r_id", "r_key")
    pairs = F.array_sort(F.arrays_zip("starts", "ends"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        F.transform(pairs, lambda x: F.struct(x["starts"].alias("a"), x["ends"].alias("b"))),
        start,
        lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).cast("long").alias("n")),
        lambda s: s["n"],
    )
    return (
        merged.withColumn("n_hit", covered)
        .withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))
        .select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", "contaminated", "text_key")
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
