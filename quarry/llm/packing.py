"""Best-fit packing by hierarchical residual packing.

Each partition tokenizes its documents, cuts what is longer than a sequence and packs the pieces
best-fit, a chunk at a time: nearly full bins are emitted, the others stay open and take pieces of
the next chunk. What is open at a partition's end becomes an item of the next round, where fewer
and fewer tasks (each of a bounded number of bins) pack the open bins best-fit again, dealt anew. A
bin too full for the smallest other open bin is closed, so rounds shrink; they end with one task's
worth, or when a whole round merges nothing (each task then has one bin at most that is half empty).
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import CACHES, blobs, map_arrow, materialize, only_cache, slices, whole

CAPACITY = 2048
#: A bin with at most so much room counts as nearly full.
SLACK = 4
#: Pieces sorted and packed at a time in a partition; bins that one task of a later round takes.
CHUNK, FAN_IN = 16_384, 8_192

# The tokenizer file's split, here for text of ASCII and Latin letters in lower case alone.
LETTERS, NUMBERS = "a-zªµºß-öø-ž", "0-9²³¹¼-¾"
#: SHA-256 of that part of the file for which the split holds; of another file every text goes to the library.
SPLIT_OF = "69b30970569b87d51c35dec9305472f3634a2ba2e3ff5648f3d6794ca0d319cc"
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")


class WordTokenizer:
    """Ids of a tokenizers file, from a cache of its words.

    The file's normalizer (NFC, white space, lower case) and split never join text across ASCII white
    space, so a text's ids are its words' ids in a row. Words not seen before are encoded together, a
    batch at a time; each ends in the one token that has the end-of-word suffix, which tells them
    apart again. Text outside ASCII and the composed Latin letters, or with a special token's mark,
    goes to the tokenizer itself, from white space to white space. The cache is bounded; when full,
    it keeps the words of the current batch.
    """

    PLAIN = re.compile(r"[\t-\r\x20-\x7E¡-¬®-įı-ňŊ-ž]*")
    MOST = 250_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known_split = split_digest(path) == SPLIT_OF
        suffix = self.tokenizer.model.end_of_word_suffix or ""
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = bool(suffix) and token.endswith(suffix)
        self.words: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        for i in range(0, len(new), 1000):
            part = new[i : i + 1000]
            raw = self._encode([" ".join(part)])[0]
            ends = (4 * (np.flatnonzero(self.last[np.frombuffer(raw, "<u4")]) + 1)).tolist()
            if len(ends) == len(part):
                self.words.update((w, raw[a:b]) for w, a, b in zip(part, [0, *ends], ends, strict=False))
            else:  # no such suffix: one by one
                self.words.update(zip(part, self._encode(part), strict=True))

    def _split(self, text: str) -> list[str]:
        """Words; what isn't plain stays whole, with a leading blank, which no word has."""
        if self.PLAIN.fullmatch(text) and "<|" not in text:
            return PIECES.findall(text.lower())
        out: list[str] = []
        for chunk in text.encode().split():
            part = chunk.decode()
            out += PIECES.findall(part.lower()) if self.PLAIN.fullmatch(part) and "<|" not in part else [" " + part]
        return out

    def encode(self, texts: list[bytes], step: int = 256) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        if not self.known_split:
            for i in range(0, len(texts), step):
                yield from self._encode([t.decode() for t in texts[i : i + step]])
            return
        for i in range(0, len(texts), step):
            parts = [self._split(t.decode()) for t in texts[i : i + step]]
            known = self.words
            new = [*{w for p in parts for w in p if w not in known}]
            if len(known) + len(new) > self.MOST:
                known = self.words = {w: known[w] for p in parts for w in p if w in known}
            odd = [w for w in new if w[0] == " "]
            self._learn([w for w in new if w[0] != " "])
            known.update(zip(odd, self._encode([w[1:] for w in odd]), strict=True))
            for p in parts:
                yield b"".join(map(known.__getitem__, p))


def split_digest(path: str) -> str:
    """SHA-256 of how a tokenizers file normalises and splits text, and of its tokens that stand for themselves."""
    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    parts = [content.get(k) for k in ("normalizer", "pre_tokenizer", "added_tokens")] + [content["model"].get("end_of_word_suffix")]
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()


_TOKENIZERS: dict[str, WordTokenizer] = CACHES.setdefault("packing", {})


def tokenizer(path: str) -> WordTokenizer:
    """One a worker process and path."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Best-fit in descending order of length (ties: position): the positions in each bin."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: a bin with room r exists
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        size = lengths[i]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        by_room[room - size].append(b)
        rooms |= 1 << (room - size)
    return bins


PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
BINS = "bin long, size int, open boolean, pieces array<struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long, offset: long>>"


def _emit(bins: list[tuple[int, bool, list]], first: int) -> pa.RecordBatch:
    for _, _, pieces in bins:
        offset = 0
        for piece in pieces:
            piece["offset"] = offset
            offset += piece["length"]
    return pa.RecordBatch.from_arrays(
        [pa.array(range(first, first + len(bins)), pa.int64()), pa.array([x[0] for x in bins], pa.int32()), pa.array([x[1] for x in bins], pa.bool_()), pa.array([x[2] for x in bins], pa.list_(PIECE))],
        ["bin", "size", "open", "pieces"],
    )


class _Packer:
    """Packs (size, pieces) items chunk by chunk; yields bins, numbered from base."""

    def __init__(self, base: int, capacity: int, slack: int):
        self.next, self.capacity, self.slack = base, capacity, slack
        self.items: list[tuple[int, list]] = []

    def pack(self, last: bool) -> Iterator[pa.RecordBatch]:
        bins = [(sum(self.items[i][0] for i in b), [p for i in b for p in self.items[i][1]]) for b in best_fit([x[0] for x in self.items], self.capacity)]
        full = lambda size: self.capacity - size <= self.slack
        out = [(size, not full(size), pieces) for size, pieces in bins if last or full(size)]
        self.items = [] if last else [x for x in bins if not full(x[0])]
        for i in range(0, len(out), 2000):
            yield _emit(out[i : i + 2000], self.next)
            self.next += len(out[i : i + 2000])


def _first_round(path: str, capacity: int, end_id: int, slack: int, chunk: int):
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache("packing")
        encode = tokenizer(path).encode
        packer = _Packer(TaskContext.get().partitionId() << 32, capacity, slack)
        for batch in slices(batches):
            ids_of = encode(blobs(batch.column(1)))
            for doc_id, ids in zip(batch.column(0).to_pylist(), ids_of, strict=True):
                ids += tail
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    packer.items.append((len(part) // 4, [{"doc_id": doc_id, "piece": k, "start": at // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)}]))
                if len(packer.items) >= chunk:
                    yield from packer.pack(False)
                    if len(packer.items) > chunk // 2:  # hardly anything fits: leave these to the next round
                        yield from packer.pack(True)
        yield from packer.pack(True)

    return run


def _later_round(number: int, capacity: int, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer((number << 56) | (TaskContext.get().partitionId() << 32), capacity, slack)
        got = [(b, s, p) for batch in batches for b, s, p in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
        got.sort(key=lambda x: (-x[1], x[0]))  # whatever order the rows came in
        packer.items = [(s, p) for _, s, p in got]
        yield from packer.pack(True)

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, slack: int = SLACK, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, fan_in: int = FAN_IN) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and end_id; only those over capacity are cut, into pieces of capacity.
    Null and empty texts are the one id end_id. Rows with null or repeated ids are packed like any
    others, each for itself. An empty table gives no sequence. Within a sequence the pieces lie
    gapless from offset 0.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("t"))
    rounds = [materialize(map_arrow(source, _first_round(path, capacity, end_id, slack, chunk), BINS), "packing")]
    closed = []
    number = 0
    while True:
        table = rounds[-1]
        number += 1
        still = table.where("open").agg(F.count("*"), F.min("size")).first()
        n, least = still[0], still[1]
        if not n:
            closed.append(table)
            break
        # A bin that has no room for the smallest open bin is done.
        closed.append(table.where(~F.col("open") | (F.col("size") > capacity - least)))
        rest = table.where(F.col("open") & (F.col("size") <= capacity - least)).select("bin", "size", "pieces")
        left = rest.count()
        if not left:
            break
        tasks = -(-left // fan_in)
        merged = materialize(map_arrow(rest.repartition(tasks, F.xxhash64("bin", F.lit(number))), _later_round(number, capacity, slack), BINS), "packing")
        after = merged.count()
        rounds.append(merged)
        if tasks == 1 or after == left:
            closed.append(merged)
            break
    out = closed[0]
    for frame in closed[1:]:
        out = out.unionByName(frame)
    return out.select("bin", F.explode("pieces").alias("p")).select("p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", F.col("bin").alias("sequence_id"), "p.offset")
