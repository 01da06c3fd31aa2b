"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text, one for each class, and every window of a text
is compressed under both. A window that comes out shorter under the toxic dictionary is evidence; how
much of it makes a text toxic is calibrated by a logistic regression on labelled documents that the
dictionaries have not seen.

A toxic document is ordinary text but for a few places, so its whole text would make a dictionary that
differs from the ordinary one by chance alone. Training finds those places by compression too: several
pairs of provisional dictionaries, each of random windows of the two classes, compress every word of
the training documents they don't hold; the words that come out shorter as toxic under nearly all pairs,
beyond what words of ordinary documents do, are the residue of their document. The toxic dictionary is
trained on the residues, the ordinary one on ordinary windows; either stands behind one base that is
trained on ordinary windows, so that ordinary words cost the same under both.

Learning reads a bounded sample: at most ``per_class`` labelled rows a class, the first by a hash of
their id, of texts of at most ``most_bytes``. Scoring reads every whole text, map-side.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import blobs, map_arrow, only_cache, whole

#: Bound of the training sample.
PER_CLASS, MOST_BYTES = 1500, 16_384
#: Words in a scored window and in a window that dictionaries are trained on; bytes of the base and of a class's part.
#: These and what follows were chosen on learnable rows alone: those of crc32 remainder 1 judged what 2, 3 and 4 had taught.
WINDOW, TRAINED_WINDOW, BASE_BYTES, PART_BYTES = 3, 12, 32_768, 2048
#: Provisional pairs and their bytes; folds of the documents that are judged by the others; the share of ordinary words that may pass for residue.
PAIRS, PAIR_BYTES, FOLDS, CHANCE = 16, 32_768, 3, 0.0002
#: Ends both dictionaries and begins each window, so that every window has a match and is never stored raw.
PRIMER = bytes(range(0x80, 0xA8))
#: Ends each window: the last eight bytes are never searched for a match.
TAIL = bytes(range(0xB0, 0xBA))
_PLAIN = dict(min_match=5, window_log=18, write_content_size=False, write_dict_id=False)
#: Scored: the best of many matches. Provisional: one match a place, which costs a third. Literals are too few to be entropy-coded.
SCORED = dict(_PLAIN, strategy=zstandard.STRATEGY_LAZY2, chain_log=16, hash_log=16, search_log=6)
PROVISIONAL = dict(_PLAIN, strategy=zstandard.STRATEGY_FAST, target_length=1, chain_log=6, hash_log=17, search_log=1)
#: Gains whose windows are counted.
STEPS = (1, 2, 3, 4, 5, 6, 8, 10)


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: list[float]  # of the features, the constant last


def windows(text: bytes, size: int) -> list[bytes]:
    """The text's words, A-Z lower-cased, size at a time, between blanks."""
    words = text.lower().split()
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(0, len(words), size)]


def compressor(content: bytes, parameters: dict) -> Callable[[bytes], int]:
    """The compressed length of a window given content."""
    held = zstandard.ZstdCompressionParameters(**parameters)
    given = zstandard.ZstdCompressionDict(content + PRIMER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    given.precompute_compress(compression_params=held)
    compress = zstandard.ZstdCompressor(dict_data=given, compression_params=held).compress
    return lambda window: len(compress(PRIMER + window + TAIL))


class Scorer:
    def __init__(self, model: Model):
        self.weights = np.array(model.weights)
        self.toxic, self.ordinary = (compressor(c, SCORED) for c in (model.toxic, model.ordinary))

    def features(self, text: bytes) -> list[float]:
        """How many windows gain each of STEPS bytes (logarithms, and as shares of all windows), how many there are, their mean gain, and 1."""
        gains = [self.ordinary(w) - self.toxic(w) for w in windows(text, WINDOW)]
        over, n = [sum(g >= t for g in gains) for t in STEPS], max(8, len(gains))
        return [*(math.log1p(x) for x in over), *(x / n * 10 for x in over), math.log1p(len(gains)), sum(gains) / n, 1.0]

    def score(self, text: bytes) -> float:
        z = float(np.dot(self.weights, self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> list[float]:
    """Logistic regression by Newton's steps; the classes weigh as they come."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def _trained(samples: list[bytes], size: int, segment: int, part: int) -> bytes:
    """A dictionary that zstandard trains on samples; their own ends where they are too few for it."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=part, steps=4).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _provisional(toxic: list[bytes], ordinary: list[bytes], rng: random.Random) -> tuple:
    """A pair of compressors given random windows of either class, equally many bytes."""
    most = min(PAIR_BYTES, sum(map(len, toxic)), sum(map(len, ordinary)))
    contents = []
    for whole_class in (toxic, ordinary):
        picked, size = [], 0
        for w in rng.sample(whole_class, len(whole_class)):
            if size >= most:
                break
            picked.append(w)
            size += len(w)
        contents.append(b"".join(picked))
    return tuple(compressor(c, PROVISIONAL) for c in contents)


def residues(rows: list[tuple[int, bytes, int]]) -> list[bytes]:
    """For each toxic document that has any, its words that are shorter as toxic under nearly all provisional pairs."""
    rng, found = random.Random(1), []
    cut = [(crc32(b"fold %d" % i) % FOLDS, windows(t, TRAINED_WINDOW), windows(t, 1), y) for i, t, y in rows]
    for fold in range(FOLDS):
        of = [[w for f, ws, _, label in cut if f != fold and label == y for w in ws] for y in (1, 0)]
        judged = [(words, y) for f, _, words, y in cut if f == fold]
        if not all(of) or not judged:
            continue
        pairs = [_provisional(*of, rng) for _ in range(PAIRS)]
        distinct = sorted({w for words, _ in judged for w in words if len(w) > _PLAIN["min_match"]})
        gains = np.array([[max(-8, min(8, ordinary(w) - toxic(w))) for w in distinct] for toxic, ordinary in pairs], float)
        evidence = dict(zip(distinct, gains.mean(axis=0) / (gains.std(axis=0) + 0.7), strict=True))
        usual = [evidence.get(w, 0.0) for words, y in judged if not y for w in words]
        least = max(float(np.quantile(usual, 1 - CHANCE)), 0.0) if usual else 0.0
        for words, y in judged:
            kept = [w.strip() for w in words if evidence.get(w, 0.0) > least] if y else []
            if kept:
                found.append(b" " + b" ".join(kept) + b" ")
    return found


def train(rows: list[tuple[int, bytes, int]], prior: float | None = None) -> Model:
    """rows: (id, text, label). Two of three rows make the dictionaries, the third calibrates.

    Without rows of both classes every score is 0. prior, the share of label 1 among all learnable
    rows, undoes the sample's balance.
    """
    if len({y for _, _, y in rows}) < 2:
        return Model(b" ", b" ", [0.0] * (2 * len(STEPS) + 2) + [-30.0])
    fit = [r for r in rows if crc32(b"%d" % r[0]) % 3]
    fit = [*{r[1]: r for r in fit}.values()]  # a copy is no further evidence
    if len({y for _, _, y in fit}) < 2:
        fit = rows
    ordinary = [w for _, t, y in fit if not y for w in windows(t, TRAINED_WINDOW)]
    base = _trained(ordinary, BASE_BYTES, 48, 8)
    part = _trained(found, PART_BYTES, 32, 6) if (found := residues(fit)) else b""
    other = random.Random(2).sample(ordinary, len(ordinary))
    # Of one length, so that the base is as far away in both.
    model = Model(base + part, base + b"".join(other)[: len(part)].rjust(len(part)), [])
    scorer = Scorer(Model(model.toxic, model.ordinary, [0.0]))
    held = [r for r in rows if not crc32(b"%d" % r[0]) % 3]
    if len({y for _, _, y in held}) < 2:
        held = rows
    x = np.array([scorer.features(t) for _, t, _ in held])
    y = np.array([label for _, _, label in held], float)
    model.weights = _calibrate(x, y)
    if prior is not None and 0 < prior < 1:
        here = min(max(y.mean(), 1e-6), 1 - 1e-6)
        model.weights[-1] += math.log(prior / (1 - prior)) - math.log(here / (1 - here))
    return model


def sample(docs: DataFrame, labels: DataFrame, learnable, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES) -> tuple[list[tuple[int, bytes, int]], float | None]:
    """The bounded training sample, and the share of label 1 among all learnable rows.

    learnable is a predicate on the column doc_id. Labels other than 0 and 1, and null ids, are left out.
    Of several texts of one id the least is learned from: at most 2 * per_class rows reach the driver.
    """
    told = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(learnable)
    told = told.groupBy("doc_id").agg(F.max("y").alias("y"))
    total = {r.y: r.n for r in told.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ids = None
    for y in (0, 1):
        some = told.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = some if ids is None else ids.unionByName(some)
    texts = docs.select(F.col(id_col).cast("long").alias("l_id"), whole(text_col).alias("t")).where(F.octet_length("t") <= most_bytes)
    joined = texts.join(F.broadcast(ids), F.col("l_id") == F.col("doc_id"))  # at most 2 * per_class ids
    one = joined.groupBy("doc_id", "y").agg(F.min("t").alias("t"))
    rows = sorted((r.doc_id, r.t.encode(), r.y) for r in one.toLocalIterator())
    n = sum(total.values())
    return rows, (total.get(1, 0) / n if n else None)


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col (0 to 1, a name that docs hasn't) of its whole texts; null and empty texts have no window and a score of the constant alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache("toxicity")
        scorer = Scorer(held.value)
        for whole_batch in batches:
            for i in range(0, whole_batch.num_rows, 500):
                batch = whole_batch.slice(i, 500)
                scores = [scorer.score(t) for t in blobs(batch.column(at))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*names, score_col])

    return map_arrow(docs, run, f"{kinds}, `{score_col}` double")


def held_out(doc_id):
    """Whether a row must not be learned from: crc32 of its id as text is 0 modulo 5."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted (1 if score >= threshold).

    Repeated rows score alike; a null id is held_out false; tables may be empty (without labels of
    both classes every score is next to 0).
    """
    model = train(*sample(docs, labels, ~held_out(F.col("doc_id")), id_col, text_col, label_col))
    scored = score_documents(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
