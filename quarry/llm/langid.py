"""Language of texts by a convolutional network over bytes.

A text's UTF-8 bytes are cut into windows of a fixed length, the last one padded. A byte becomes a short
learned vector, filters of several widths slide over the window, each filter's largest value is kept,
and a softmax over the languages follows. A text's evidence is the mean of its windows' logits, weighted by
their bytes, so the whole text counts. Everything is numpy: training here, on a bounded sample that Spark
draws, prediction in batches of windows inside Spark's tasks.

Learning reads at most ``per_lang`` texts of each of at most ``most_langs`` languages (the commonest; of
equally common ones the first by name), chosen by a hash of the text, and of each text at most ``per_text`` windows
chosen by a hash. Texts without a letter, null languages and null texts are not learned from. Without any
learnable text no language is learned and every prediction is ``und``. Of equally likely languages the first by
name is predicted; repeated rows are predicted alike; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import blobs, fresh, map_arrow

#: Bytes of a window; the byte vectors' length; filters by their width.
WINDOW, VECTOR, FILTERS = 192, 8, {2: 16, 3: 24, 4: 24}
#: Bounds of the training sample.
PER_LANG, PER_TEXT, MOST_LANGS = 400, 4, 500
EPOCHS, BATCH, RATE = 6, 32, 0.01
#: Of the training windows this share is cut to a random length from SHORTEST bytes, so that short texts are known too.
CUT, SHORTEST = 0.5, 4
#: Windows in one product: it stays in a core's cache.
AT_ONCE = 32
PAD, NONE = 256, "und"
WIDEST = max(FILTERS)


@dataclass
class Model:
    langs: list[str]
    vectors: np.ndarray  # 257 by VECTOR; the last row, of the padding, is zero
    filters: np.ndarray  # WIDEST * VECTOR by filters: zero beyond a filter's width
    bias: np.ndarray
    out: np.ndarray  # filters by languages
    out_bias: np.ndarray


def padded(texts: list[bytes], length: int = WINDOW) -> np.ndarray:
    """One row of byte numbers a text of at most ``length`` bytes, and what the widest filter reads beyond it."""
    table = np.full((len(texts), length + WIDEST - 1), PAD, np.int16)
    for row, t in zip(table, texts, strict=True):
        row[: len(t)] = np.frombuffer(t, np.uint8)
    return table


def _columns(vectors: np.ndarray, table: np.ndarray) -> np.ndarray:
    """What each place's filters see: places by WIDEST * VECTOR."""
    held = vectors[table].reshape(len(table), -1)
    seen = np.lib.stride_tricks.sliding_window_view(held, WIDEST * VECTOR, axis=1)[:, ::VECTOR]
    return np.ascontiguousarray(seen).reshape(-1, WIDEST * VECTOR)


def activations(model: Model, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each window's largest value of each filter, not below 0, and the columns that they came from."""
    seen = _columns(model.vectors, table)
    return (seen @ model.filters).reshape(len(table), -1, len(model.bias)), seen


def logits(model: Model, table: np.ndarray) -> np.ndarray:
    values, _ = activations(model, table)
    return np.maximum(values.max(axis=1) + model.bias, 0) @ model.out + model.out_bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _mask() -> np.ndarray:
    """Which entries of the filters are used: a filter of width w sees the first w bytes."""
    widths = np.repeat(list(FILTERS), list(FILTERS.values()))
    return (np.arange(WIDEST * VECTOR)[:, None] // VECTOR < widths).astype(np.float32)


def gradients(model: Model, table: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The mean cross-entropy of windows, and its gradients by vectors, filters, bias, out and out_bias."""
    n, rows = len(table), np.arange(len(table))
    values, seen = activations(model, table)
    best = values.argmax(axis=1)  # windows by filters
    top = np.take_along_axis(values, best[:, None], 1)[:, 0] + model.bias
    hidden = np.maximum(top, 0)
    shares = softmax(hidden @ model.out + model.out_bias)
    loss = float(-np.log(shares[rows, labels] + 1e-12).mean())
    shares[rows, labels] -= 1
    above = shares / n
    back = (above @ model.out.T) * (top > 0)
    at = rows[:, None] * values.shape[1] + best  # which column each maximum came from
    d_filters = np.einsum("bfk,bf->kf", seen[at], back) * _mask()
    d_vectors = np.zeros_like(model.vectors)
    pull = (back[:, :, None] * model.filters.T[None]).reshape(n, -1, WIDEST, VECTOR)
    read = table[rows[:, None, None], best[:, :, None] + np.arange(WIDEST)]
    np.add.at(d_vectors, read, pull)
    d_vectors[PAD] = 0
    return loss, [d_vectors, d_filters, back.sum(axis=0), hidden.T @ above, above.sum(axis=0)]


def train(rows: list[tuple[str, bytes]], seed: int = 1, epochs: int = EPOCHS) -> Model:
    """The model of labelled windows, by Adam; every language weighs the same in an epoch."""
    rng = np.random.default_rng(seed)
    langs, count = sorted({lang for lang, _ in rows}), sum(FILTERS.values())
    normal = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
    model = Model(langs, normal(257, VECTOR, by=0.5), normal(WIDEST * VECTOR, count, by=0.2) * _mask(), np.zeros(count, np.float32), normal(count, len(langs), by=0.1), np.zeros(len(langs), np.float32))
    model.vectors[PAD] = 0
    if len(langs) < 2:
        return model
    by_lang = [[w for lang, w in rows if lang == x] for x in langs]
    most = max(map(len, by_lang))
    weights = [model.vectors, model.filters, model.bias, model.out, model.out_bias]
    slow, fast, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    steps = epochs * -(-most * len(langs) // BATCH)
    for _ in range(epochs):
        drawn = [(w, i) for i, ws in enumerate(by_lang) for w in (ws * -(-most // len(ws)))[:most]]
        for at in np.array_split(rng.permutation(len(drawn)), -(-len(drawn) // BATCH)):
            windows = [_cut(drawn[k][0], rng) for k in at]
            loss, found = gradients(model, padded(windows), np.array([drawn[k][1] for k in at]))
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for w, g, m, v in zip(weights, found, slow, fast, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return model


def _cut(window: bytes, rng: np.random.Generator) -> bytes:
    """The window, or a part of it."""
    if len(window) <= SHORTEST or rng.random() >= CUT:
        return window
    size = int(rng.integers(SHORTEST, len(window)))
    start = int(rng.integers(0, len(window) - size + 1))
    return window[start : start + size]


def sample(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, per_text: int = PER_TEXT, most_langs: int = MOST_LANGS) -> list[tuple[str, bytes]]:
    """The bounded training sample, (language, window): at most most_langs * per_lang * per_text windows reach the driver.

    Equal texts of a language are drawn once. Of a language with more than 2 * (per_lang + 50) texts fewer than
    per_lang may come, if rarely. docs are the learnable rows alone.
    """
    told = docs.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    told = told.withColumn("key", F.xxhash64("text"))
    counts = told.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("key").alias("different")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()
    if not counts:
        return []
    # Keys are drawn by a hash: a language's share of it is one that holds per_lang of its texts with much to spare, so that few are sorted.
    share = F.coalesce(*[F.when(F.col("lang") == r.lang, F.lit(min(1.0, 2 * (per_lang + 50) / max(1, r.different)))) for r in counts], F.lit(0.0))
    drawn = F.pmod(F.xxhash64("key"), F.lit(1 << 32)) / float(1 << 32)
    light = told.where(drawn < share).select("lang", "key").distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key")
    chosen = light.withColumn("at", F.row_number().over(order)).where(F.col("at") <= per_lang).drop("at")
    texts = told.join(F.broadcast(chosen.withColumnsRenamed({"lang": "of", "key": "k"})), (F.col("lang") == F.col("of")) & (F.col("key") == F.col("k")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, keys, parts = [], [], []
            for lang, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), blobs(batch.column(2)), strict=True):
                starts = sorted(range(0, len(text), WINDOW), key=lambda i: xxhash.xxh64_intdigest(b"%d %d" % (key, i)))[:per_text]
                langs += [lang] * len(starts)
                keys += [key] * len(starts)
                parts += [text[i : i + WINDOW] for i in starts]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys, pa.int64()), pa.array(parts, pa.binary())], ["lang", "key", "part"])

    windows = map_arrow(texts.select("lang", "k", "text"), cut, "lang string, key long, part binary")
    return sorted((r.lang, bytes(r.part)) for r in windows.distinct().toLocalIterator())


class Predictor:
    def __init__(self, model: Model):
        self.model = model

    def __call__(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text, and its share; texts meet as windows, AT_ONCE in one product."""
        total = np.zeros((len(texts), len(self.model.langs)))
        owners, pending = [], []

        def meet() -> None:
            z = logits(self.model, padded(pending)) * np.array([[len(w)] for w in pending], float)
            np.add.at(total, owners, z)
            owners.clear(), pending.clear()

        for i, text in enumerate(texts):
            for at in range(0, len(text), WINDOW):
                owners.append(i)
                pending.append(text[at : at + WINDOW])
                if len(pending) == AT_ONCE:
                    meet()
        if pending:
            meet()
        shares = softmax(total / np.maximum([[len(t)] for t in texts], 1))
        best = shares.argmax(axis=1)
        return [self.model.langs[b] for b in best], shares[np.arange(len(best)), best].tolist()


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with lang_col and score_col (names that docs hasn't) of its whole texts; ``und`` with score 0 where a text is null or has no letter."""
    held, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(held.value)
        for whole_batch in batches:
            for i in range(0, whole_batch.num_rows, 500):
                batch = whole_batch.slice(i, 500)
                columns = batch.columns[:-1]
                known = np.flatnonzero(np.asarray(batch.column(batch.num_columns - 1).to_pylist(), bool)) if predictor.model.langs else np.zeros(0, int)
                langs, scores = np.full(batch.num_rows, NONE, object), np.zeros(batch.num_rows)
                if len(known):
                    langs[known], scores[known] = predictor(blobs(batch.column(at).take(pa.array(known))))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores)], [*names, lang_col, score_col])

    lettered = F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False)).alias(fresh(docs, "lettered")[0])
    return map_arrow(docs.select(*[F.col(f"`{c}`") for c in names], lettered), run, f"{kinds}, `{lang_col}` string, `{score_col}` double")
