"""Substring dedup by super-k-mer partitioning.

A window is ``size`` consecutive words of one document; its minimiser is the least hash among its
word m-grams. Consecutive windows with one minimiser form a super-k-mer, which lies in the
minimiser's bucket, and so do all other occurrences of its windows.

1. One pass writes (minimiser, content hash, document, position) of every super-k-mer: light rows, no
   text. Minimisers whose rows have one document id alone lie in buckets without a repeat.
2. The rows of the other buckets stay. Equal super-k-mers are one row from here, with the least id: a
   group of copies, or a passage in a third of all documents, shrinks to one row in each map task.
3. Where a bucket has several different super-k-mers, each travels there once as one packed string
   of its words; its windows are sorted, and equal windows in a row get the least id of any.
   A document is packed where it lies. A bucket of very many strings (a common passage in varying surroundings) is opened: its windows
   are spread over all tasks by digest and aggregated there.
4. A window is struck in a document whose id is larger than that least id; what is left of each
   text is joined and digested; documents that lose nothing are not moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BROADCAST_ROWS, CACHES, blobs, join_counted, map_arrow, materialize, small, whole

SIZE, GRAM = 50, 12
#: Windows in a super-k-mer at most; a longer run is several.
RUN = 256
#: Different strings that one bucket sorts in one task.
BUCKET = 512

_Q = 0x9E3779B97F4A7C15 | 1
_QINV = pow(_Q, -1, 1 << 64)


class _Hashes(dict):
    """XXH64 of words, kept while there is room."""

    MOST = 400_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < self.MOST:
            self[word] = value
        return value


_HASHES = CACHES.setdefault("substring", _Hashes())
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Q**i and Q**-i modulo 2**64 for i below n."""
    for k, base in enumerate((_Q, _QINV)):
        while len(_POWERS[k]) < n:
            have = _POWERS[k]
            step = np.uint64(pow(base, len(have), 1 << 64))
            _POWERS[k] = np.concatenate((have, have * step))
    return _POWERS[0][:n], _POWERS[1][:n]


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if span < width else values


def super_kmers(words: list[bytes], size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, content hash, first window, windows) of a document's super-k-mers, in order."""
    n = len(words)
    if n < size:
        none = np.empty(0, np.uint64)
        return none, none, np.empty(0, np.int64), np.empty(0, np.int64)
    if len(_HASHES) >= _Hashes.MOST:
        _HASHES.clear()
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * power[:n], out=sums[1:])
    grams = _mix((sums[gram:] - sums[: n - gram + 1]) * inverse[: n - gram + 1])
    least = sliding_min(grams, size - gram + 1)
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    count = np.diff(np.append(first, len(least)))
    if count.max() > RUN:
        first = np.concatenate([np.arange(a, a + c, RUN) for a, c in zip(first, count, strict=True)])
        count = np.diff(np.append(first, len(least)))
    last = first + count + size - 1
    content = _mix((sums[last] - sums[first]) * inverse[first] + count.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return least[first], content, first, count


def _occurrences(size: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                found = [super_kmers(t.split(), size, gram) for t in blobs(part.column(2))]
                sizes = [len(x[0]) for x in found]
                if not sum(sizes):
                    continue
                key, content, first, count = (np.concatenate([x[k] for x in found]) for k in range(4))
                columns = [key.view(np.int64), content.view(np.int64), np.repeat(np.asarray(part.column(0)), sizes), np.repeat(np.asarray(part.column(1)), sizes), first << 12 | count]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "content", "doc_id", "text_key", "place"])

    return run


def _pack(size: int):
    """Documents with the places asked for -> one packed string for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, asked in zip(blobs(batch.column(0)), batch.column(1), strict=True):
                words, rows = text.split(), asked.as_py()
                for i in range(0, len(rows), 2000):
                    part = rows[i : i + 2000]
                    strings = [b" ".join(words[r["place"] >> 12 : (r["place"] >> 12) + (r["place"] & 4095) + size - 1]) for r in part]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], pa.int64()) for k in ("key", "content", "least")] + [pa.array(strings, pa.binary())], ["key", "content", "least", "packed"])

    return run


def windows(packed: bytes, size: int) -> list[bytes]:
    words = packed.split(b" ")
    return [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


def _sort_bucket(size: int):
    """Rows sorted by key -> for each string the least id of each of its windows."""

    def answer(rows: list[tuple]) -> list[tuple]:
        entries = sorted((w, least, r, i) for r, (_, _, least, packed) in enumerate(rows) for i, w in enumerate(windows(packed, size)))
        out: list[list[int]] = [[] for _ in rows]
        last, low = None, 0
        placed = []
        for w, least, r, i in entries:
            if w != last:
                last, low = w, least  # sorted: the first of equal windows has the least id
            placed.append((r, i, low))
        for r, _, low in sorted(placed):
            out[r].append(low)
        return [(key, content, lows) for (key, content, _, _), lows in zip(rows, out, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(out):
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int64()))], ["v_key", "v_content", "lows"])

        rows: list[tuple] = []
        out: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if rows and rows[0][0] != row[0]:
                    out += answer(rows)
                    rows = []
                    if len(out) >= 2000:
                        yield emit(out)
                        out = []
                rows.append(row)
        if rows:
            out += answer(rows)
        yield emit(out)

    return run


def _open_bucket(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, content, least, packed in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                digests = [hashlib.blake2b(w, digest_size=16).digest() for w in windows(packed, size)]
                n = len(digests)
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array([content] * n, pa.int64()), pa.array([least] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(digests, pa.binary())], ["key", "content", "least", "i", "digest"])

    return run


def _strike(size: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                n_words, n_removed, kept_texts = [], [], []
                for text, struck in zip(blobs(part.column(1)), part.column(2).to_pylist(), strict=True):
                    words = text.split()
                    n_words.append(len(words))
                    if struck:
                        gone = np.zeros(len(words) + 1, np.int32)
                        for r in struck:
                            starts = np.asarray(r["windows"], np.int64) + r["first"] if r["windows"] is not None else None
                            if starts is None:
                                gone[r["first"]] += 1
                                gone[r["first"] + r["count"] + size - 1] -= 1
                            else:
                                np.add.at(gone, starts, 1)
                                np.add.at(gone, starts + size, -1)
                        keep = np.cumsum(gone[:-1]) <= 0
                        words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                    n_removed.append(n_words[-1] - len(words))
                    kept_texts.append(b" ".join(words))
                columns = [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in kept_texts], pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    columns.append(pa.array([t.decode() for t in kept_texts], pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def substring_dedup(docs: DataFrame, size: int = SIZE, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, bucket: int = BUCKET) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_sha256 (and kept_text if asked for).

    Words are runs of anything but space and ASCII \\t to \\r. Every word goes that is covered by a
    window whose words also start in a document of a smaller id; windows are judged on the input.
    Null and empty texts have no words; texts of under ``size`` words have no window. Repeats within a
    document, or among rows of one id, stay. Rows with a null id lose nothing and strike nothing.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("t")).withColumn("text_key", F.xxhash64("t"))
    told = source.where("doc_id is not null")
    every = map_arrow(told.select("doc_id", "text_key", "t"), _occurrences(size, gram), "key long, content long, doc_id long, text_key long, place long")
    every = materialize(every, "super-k-mers")
    keys = every.groupBy(F.col("key").alias("s_key")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high")
    held = join_counted(every, materialize(keys.select("s_key", "n"), "shared-keys"), [("key", "s_key")], "n").select(*every.columns)
    held = materialize(held, "shared-super-k-mers")

    first = F.min(F.struct("doc_id", "text_key", "place"))
    distinct = held.groupBy("key", "content").agg(first.alias("first"), F.max("doc_id").alias("high"), F.count("*").alias("n_rows"))
    distinct = materialize(distinct.select("key", "content", F.col("first.doc_id").alias("least"), "first.text_key", "first.place", "high", "n_rows"), "distinct")
    several = distinct.groupBy("key").agg(F.count("*").alias("n"), F.min("least").alias("low"), F.max("high").alias("high")).where("n > 1 and low < high").select(F.col("key").alias("m_key"), "n")
    several = materialize(several, "several")
    asked = join_counted(distinct, several, [("key", "m_key")], "n")
    asked = asked.groupBy(F.col("least").alias("a_id"), F.col("text_key").alias("a_key")).agg(F.collect_list(F.struct("key", "content", "least", "place")).alias("asked"))
    asked = materialize(asked, "asked")  # a document's own super-k-mers: as long as its text at most
    texts = told
    if asked.count() <= BROADCAST_ROWS:  # spares the other documents the shuffle
        texts = texts.join(F.broadcast(asked.select(F.col("a_id").alias("only_id"), F.col("a_key").alias("only_key"))), (F.col("doc_id") == F.col("only_id")) & (F.col("text_key") == F.col("only_key")), "left_semi")
    wanted = texts.join(asked, (F.col("doc_id") == F.col("a_id")) & (F.col("text_key") == F.col("a_key")))
    packed = materialize(map_arrow(wanted.select("t", "asked"), _pack(size), "key long, content long, least long, packed binary"), "packed")
    hot = several.where(F.col("n") > bucket)
    often = small(hot)
    cool = packed.join(often, F.col("key") == F.col("m_key"), "left_anti")
    lows = map_arrow(cool.repartition("key").sortWithinPartitions("key"), _sort_bucket(size), "v_key long, v_content long, lows array<long>")
    if not hot.isEmpty():
        opened = map_arrow(packed.join(often, F.col("key") == F.col("m_key"), "left_semi"), _open_bucket(size), "key long, content long, least long, i int, digest binary")
        best = opened.groupBy(F.col("digest").alias("d")).agg(F.min("least").alias("low"))
        spread = opened.join(best, F.col("digest") == F.col("d")).groupBy(F.col("key").alias("v_key"), F.col("content").alias("v_content")).agg(F.array_sort(F.collect_set(F.struct("i", "low"))).alias("x"))
        lows = lows.unionByName(spread.select("v_key", "v_content", F.col("x.low").alias("lows")))
    lows = materialize(lows.dropDuplicates(["v_key", "v_content"]), "lows")  # repeated rows of a document ask twice

    verdict = distinct.join(lows, (F.col("key") == F.col("v_key")) & (F.col("content") == F.col("v_content")), "left").select(F.col("key").alias("v_key"), F.col("content").alias("v_content"), "least", "lows", "high", "n_rows")
    verdict = materialize(verdict.where("least < high or lows is not null"), "verdict")
    count = F.col("place").bitwiseAND(4095).cast("int")
    judged = join_counted(held, verdict, [("key", "v_key"), ("content", "v_content")], "n_rows")
    chosen = F.filter(F.transform("lows", lambda low, i: F.when(low < F.col("doc_id"), i)), lambda i: i.isNotNull())
    whole_run = F.when(F.col("lows").isNull(), F.col("least") < F.col("doc_id")).otherwise(F.forall("lows", lambda low: low < F.col("doc_id")))
    struck = judged.select("doc_id", "text_key", F.shiftright("place", 12).cast("int").alias("first"), count.alias("count"), F.when(whole_run, F.lit(None).cast("array<int>")).otherwise(F.coalesce(chosen, F.array().cast("array<int>"))).alias("windows"))
    struck = struck.where("windows is null or size(windows) > 0")
    per_doc = struck.groupBy(F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_key")).agg(F.collect_list(F.struct("first", "count", "windows")).alias("struck"))
    per_doc = materialize(per_doc, "struck")
    ids = per_doc.select(F.col("k_id").alias("j_id"), F.col("k_key").alias("j_key"))
    of_doc, listed = (F.col("doc_id") == F.col("k_id")) & (F.col("text_key") == F.col("k_key")), (F.col("doc_id") == F.col("j_id")) & (F.col("text_key") == F.col("j_key"))
    if per_doc.count() <= BROADCAST_ROWS:
        losing = source.join(F.broadcast(ids), listed, "left_semi").join(per_doc, of_doc).select("doc_id", "t", "struck")
        others = source.join(F.broadcast(ids), listed, "left_anti").select("doc_id", "t", F.lit(None).cast(per_doc.schema["struck"].dataType).alias("struck"))
        out = losing.unionByName(others)
    else:
        out = source.join(per_doc, of_doc, "left").select("doc_id", "t", "struck")
    return map_arrow(out, _strike(size, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
