"""Registered queries and the SQL that they are held against.

Stand-ins for the inputs: documents are the corpus, benchmark the queries, containment of an item's
text the relevance labels, embeddings (vec_id as doc_id or query_id) the vectors, conversations the
answers with their contexts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry import storage
from quarry.functions import chunking
from quarry.functions import text as T
from quarry.operators import answers as A
from quarry.operators import bundles
from quarry.operators import evaluation as E
from quarry.operators import feedback, impacts, reranked, sampling
from quarry.operators import scoring as C
from quarry.operators import search as S
from quarry.plans import models, pareto, rag, reports
from quarry.sources import tables

SIZE, OVERLAP = 600, 50
SWEEP = (256, 512, 1024, 2048)


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark, d):
    return _read(spark, d, "documents").select("doc_id", "text")


def _items(spark, d):
    return _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _qrels(spark, d):
    return storage.once(spark, d, "qrels", lambda: E.containment_qrels(_docs(spark, d), _items(spark, d)))


_INDEXES: dict[tuple, S.Index] = {}


def _index(spark, d, tokenize=T.tokens):
    """The index of the documents, built at its first use in the application: a corpus is indexed once, not for every query."""
    key = (spark.sparkContext.applicationId, d, storage.stamp(spark, d), tokenize.__name__)
    if key not in _INDEXES or not storage.alive(_INDEXES[key].stats):
        _INDEXES[key] = S.Index.build(_docs(spark, d), tokenize)
    return _INDEXES[key]


def _bm25(spark, d, k=20, tokenize=T.tokens, positive_only=True):
    """The sparse run of all items, found once for each setting in the application; a shorter list is the head of the longest."""
    depth = max(k, 20 if positive_only else 40)
    make = lambda: S.bm25(_index(spark, d, tokenize), _items(spark, d), depth, tokenize, positive_only)
    run = storage.once(spark, d, f"bm25-{depth}-{tokenize.__name__}-{positive_only}", make)
    return run if k == depth else run.where(F.col("rank") <= k)


def _vectors(spark, d):
    return _read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def _dense(spark, d):
    """Each item's own vector is the one of its id."""
    asked = _items(spark, d).join(_vectors(spark, d), F.col("query_id") == F.col("doc_id")).select("query_id", "embedding")
    return storage.once(spark, d, "dense", lambda: S.dense(_vectors(spark, d), asked))


def _fused(spark, d, weight=0.5, k=20):
    return S.fuse(_bm25(spark, d), _dense(spark, d), weight, k)


def _answers(spark, d):
    """query, answer and context: a user turn, the assistant turn after it, what was said before."""
    c = _read(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w)).withColumn("context", F.coalesce(F.lag("text").over(w), F.lit("")))
    return c.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("query"), "answer", "context")


def _r(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n).alias(c) if isinstance(c, str) else F.round(c, n)


_METRICS = ("precision", "recall", "f1", "mrr", "ndcg", "map")

# SQL parts.
_TOK = r"list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda x: length(x) >= 2)"
_RAW = r"list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: length(x) >= 2)"
_NORM = r"trim(regexp_replace(regexp_replace({0}, '(\p{{Nd}})', ' \1 ', 'g'), '[\s\x{{00A0}}]+', ' ', 'g'))"
_SQUEEZE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


def _bm25_sql(tok: str = _TOK, positive: bool = True, k: int = 20) -> str:
    scored = "SELECT query_id, doc_id, score FROM hits WHERE score > 0" if positive else "SELECT q.item_id AS query_id, d.doc_id, coalesce(score, 0) AS score FROM benchmark q CROSS JOIN documents d LEFT JOIN hits h ON h.query_id = q.item_id AND h.doc_id = d.doc_id"
    return f"""dt AS (SELECT doc_id, {tok} AS ts FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM dt) GROUP BY ALL),
dl AS (SELECT doc_id, len(ts) AS dl FROM dt), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
raw AS (SELECT term, count(*) AS df, ln((SELECT n FROM st) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf GROUP BY term),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({tok}) AS term FROM benchmark) GROUP BY ALL),
hits AS (SELECT query_id, tf.doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM st)))) AS score FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN dl ON dl.doc_id = tf.doc_id GROUP BY ALL),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ({scored})) WHERE rank <= {k})"""


_DENSE_SQL = """nv AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings),
dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (
  SELECT b.item_id AS query_id, d.doc_id, list_dot_product(q.v, d.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(d.v, d.v)) AS score FROM benchmark b JOIN nv q ON q.doc_id = b.item_id CROSS JOIN nv d)) WHERE rank <= 20)"""


def _fuse_sql(weight: str = "0.5", k: int = 20, extra: str = "", by: str = "query_id") -> str:
    return f"""fs AS (SELECT {by}, doc_id, sum(s) AS raw, max(b) AS in_bm25, max(v) AS in_dense FROM (
  SELECT {by}, doc_id, (1 - {weight}) / (60 + rank) AS s, true AS b, false AS v FROM bm {extra} UNION ALL SELECT {by}, doc_id, {weight} / (60 + rank), false, true FROM dn {extra}) GROUP BY ALL),
fm AS (SELECT *, CASE WHEN max(raw) OVER (PARTITION BY {by}) > 0 THEN raw / max(raw) OVER (PARTITION BY {by}) ELSE 0 END AS fusion_score FROM fs),
fu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round(fusion_score, 9) DESC, doc_id) AS rank FROM fm) WHERE rank <= {k})"""


_QRELS_SQL = "qr AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), nr AS (SELECT query_id, count(*) AS n_rel FROM qr GROUP BY 1)"


def _metric_sql(run: str, name: str = "me", k: int | None = None, by: str = "", base: str = "nr") -> str:
    keys = f"{by}query_id"
    ideal = f"least(n_rel, {k if k else 'coalesce(n, 0)'})"
    return f"""{name}_j AS (SELECT r.*, CASE WHEN q.doc_id IS NULL THEN 0 ELSE 1 END AS rel FROM {run} r LEFT JOIN qr q ON q.query_id = r.query_id AND q.doc_id = r.doc_id {f'WHERE r.rank <= {k}' if k else ''}),
{name}_h AS (SELECT *, sum(rel) OVER (PARTITION BY {keys} ORDER BY rank) AS hits FROM {name}_j),
{name}_s AS (SELECT {keys}, count(*) AS n, sum(rel) AS hit, min(CASE WHEN rel = 1 THEN rank END) AS first, sum(rel / log2(rank + 1)) AS dcg, sum(rel * hits / rank) AS ap FROM {name}_h GROUP BY ALL),
{name}_p AS (SELECT {', '.join('b.' + x for x in keys.split(','))}, n, n_rel, coalesce(hit / n, 0) AS p, coalesce(hit / n_rel, 0) AS r, first, dcg, ap, list_sum(list_transform(range(1, ({ideal} + 1)::BIGINT), lambda i: 1 / log2(i + 1))) AS idcg FROM {base} b LEFT JOIN {name}_s s ON {' AND '.join(f's.{x} = b.{x}' for x in keys.split(','))}),
{name} AS (SELECT {keys}, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1, coalesce(1.0 / first, 0) AS mrr, CASE WHEN coalesce(idcg, 0) > 0 THEN coalesce(dcg, 0) / idcg ELSE 0 END AS ndcg, coalesce(ap / n_rel, 0) AS map FROM {name}_p)"""


_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in _METRICS)
_BASE_SQL = _bm25_sql() + ",\n" + _DENSE_SQL
_ANSWERS_SQL = """c AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer, coalesce(lag(text) OVER w, '') AS context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
a AS (SELECT conv_id, turn, text AS query, answer, context FROM c WHERE role = 'user' AND next_role = 'assistant')"""


def _chunk_sql(size: int, overlap: int, kind: str) -> str:
    marks = [("'. '", "' .'", 2), ("'! '", "' !'", 2), ("'? '", "' ?'", 2), ("chr(10) || chr(10)", "chr(10) || chr(10)", 2)]

    def cut(s: str) -> str:
        p, e = f"greatest({s}, {s} + {size} - 100)", f"({s} + {size})"
        w = f"substr(t, {p} + 1, {e} - {p})"
        at = [f"(length({w}) - instr(reverse({w}), {b}) - {n} + 1)" for _, b, n in marks]
        has = [f"instr({w}, {m}) > 0" for m, _, _ in marks]
        if kind == "index":
            inner = "CASE " + " ".join(f"WHEN {h} THEN {p} + {a} + {n}" for h, a, (_, _, n) in zip(has, at, marks, strict=True)) + f" ELSE {e} END"
        else:
            best = "greatest(" + ", ".join(f"CASE WHEN {h} THEN {a} ELSE -1 END" for h, a in zip(has, at, strict=True)) + ")"
            inner = f"CASE WHEN {best} >= 0 THEN {p} + {best} + 1 ELSE {e} END"
        return f"CASE WHEN {e} >= n THEN n ELSE {inner} END"

    source = "text" if kind == "index" else _NORM.format("text")
    strip = r"regexp_replace(substr(t, s + 1, k - s), '^\s+|\s+$', '', 'g')"
    piece = _NORM.format(strip) if kind == "index" else strip
    short = f"SELECT doc_id, 0 AS chunk_index, {_NORM.format('t') if kind == 'index' else 't'} AS chunk FROM d WHERE n <= {size}" + ("" if kind == "index" else " AND trim(t) <> ''")
    return f"""WITH RECURSIVE d AS (SELECT doc_id, t, length(t) AS n FROM (SELECT doc_id, {source} AS t FROM documents WHERE text IS NOT NULL)),
st AS (SELECT doc_id, t, n, 0::BIGINT AS s, ({cut('0')})::BIGINT AS k FROM d WHERE n > {size} UNION ALL SELECT doc_id, t, n, k - {overlap} AS s, ({cut(f'(k - {overlap})')})::BIGINT AS k FROM st WHERE k < n),
ch AS ({short} UNION ALL SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INT, {piece} FROM st WHERE {strip} <> '')
SELECT printf('%s_chunk_%02d', doc_id::VARCHAR, chunk_index) AS chunk_id, doc_id, chunk_index, chunk FROM ch"""


def _grid(spark, d):
    """Mean metrics of every fusion weight over the labelled queries: the lists are found once and fused for each weight."""
    weights = spark.createDataFrame([(w,) for w in E.WEIGHTS], "weight double")
    sparse, dense = (x.crossJoin(F.broadcast(weights)) for x in (_bm25(spark, d), _dense(spark, d)))
    fused = S.fuse(sparse, dense, F.col("weight"), 20, ("weight", "query_id"))
    return E.rank_metrics(fused, _qrels(spark, d), by=("weight",))


_GRID_SQL = f"""WITH {_BASE_SQL}, {_QRELS_SQL}, ws AS (SELECT i / 10 AS weight FROM range(11) t(i)),
{_fuse_sql('weight', 20, 'CROSS JOIN ws', 'weight, query_id')}, wq AS (SELECT weight, query_id, n_rel FROM ws CROSS JOIN nr), {_metric_sql('fu', by='weight,', base='wq')}"""


def _q(sql: str):
    def wrap(f):
        f.sql = sql
        return f

    return wrap


@_q(_chunk_sql(SIZE, OVERLAP, "index"))
def chunk_index(spark, d):
    return chunking.chunk_table(_docs(spark, d), SIZE, OVERLAP, "index")


@_q(_chunk_sql(512, 51, "sweep"))
def chunk_sweep(spark, d):
    return chunking.chunk_table(_docs(spark, d), 512, 51, "sweep")


@_q(f"SELECT doc_id, sha256({_NORM.format('text')}) AS normalized FROM documents")
def normalize_digits(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(T.normalize(F.col("text")).cast("binary"), 256).alias("normalized"))


@_q(f"SELECT doc_id, len({_TOK}) AS n, len(list_distinct({_TOK})) AS n_distinct FROM documents")
def tokenize_a(spark, d):
    return _docs(spark, d).withColumn("t", T.tokens(F.col("text"))).select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@_q(f"SELECT doc_id, len({_RAW}) AS n, len(list_distinct({_RAW})) AS n_distinct FROM documents")
def tokenize_b(spark, d):
    return _docs(spark, d).withColumn("t", T.tokens_raw(F.col("text"))).select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@_q(f"SELECT item_id AS query_id, substr(sha256({_SQUEEZE.format('lower(text)')}), 1, 16) AS hash FROM benchmark")
def query_hash(spark, d):
    return _items(spark, d).select("query_id", T.query_hash(F.col("text")).alias("hash"))


@_q(f"SELECT k AS doc_key, min(doc_id) AS first_doc, count(*) AS n FROM (SELECT doc_id, CASE WHEN text = '' THEN '' ELSE md5({_SQUEEZE.format('text')}) END AS k FROM documents) GROUP BY 1")
def doc_key_dedup(spark, d):
    return _docs(spark, d).groupBy(T.doc_key(F.col("text")).alias("doc_key")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


@_q("SELECT substr(text, 1, 200) AS prefix, min(doc_id) AS first_doc FROM documents WHERE text <> '' GROUP BY 1")
def prefix_key(spark, d):
    return _docs(spark, d).where("text <> ''").groupBy(F.substring("text", 1, 200).alias("prefix")).agg(F.min("doc_id").alias("first_doc"))


@_q(f"""WITH t AS MATERIALIZED (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_TOK})) AS term FROM documents) GROUP BY 1),
r AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM t, (SELECT count(*) AS n FROM documents)), m AS MATERIALIZED (SELECT avg(raw) AS mean FROM r)
SELECT term, df, round(CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END, 6) AS idf FROM r, m""")
def bm25_stats(spark, d):
    return _index(spark, d).stats.select("term", "df", _r("idf"))


@_q(f"WITH {_bm25_sql()} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM bm")
def bm25_topk(spark, d):
    return _bm25(spark, d).select("query_id", "doc_id", "rank", _r("score"))


_IMPACTS: dict[tuple, impacts.Impacts] = {}


@_q(f"WITH {_bm25_sql()} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM bm")
def bm25_impact_topk(spark, d):
    """bm25_topk over postings by impact: parts of lists that can't reach a query's best are not gathered from."""
    key = (spark.sparkContext.applicationId, d, storage.stamp(spark, d))
    if key not in _IMPACTS or not storage.alive(_IMPACTS[key].postings):
        _IMPACTS[key] = impacts.Impacts.build(_index(spark, d))
    return impacts.bm25(_IMPACTS[key], _items(spark, d)).select("query_id", "doc_id", "rank", _r("score"))


@_q(f"WITH {_bm25_sql(_RAW, False, 40)} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM bm")
def bm25_sweep_topk(spark, d):
    return _bm25(spark, d, k=40, tokenize=T.tokens_raw, positive_only=False).select("query_id", "doc_id", "rank", _r("score"))


@_q("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_dot_product(q.v, d.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(d.v, d.v)) AS score FROM v q CROSS JOIN v d WHERE q.vec_id % 20 = 0) SELECT query_id, doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 20")
def dense_topk(spark, d):
    v = _vectors(spark, d)
    return S.dense(v, v.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "embedding")).select("query_id", "doc_id", "rank", _r("score"))


@_q("SELECT vec_id AS doc_id, round(list_sum(list_transform(v, lambda x: x / n)), 6) AS total FROM (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)")
def l2_normalize(spark, d):
    return _vectors(spark, d).select("doc_id", F.round(F.aggregate(T.l2_normalize(F.col("embedding")), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@_q(f"WITH {_bm25_sql()}, m AS (SELECT query_id // 4 AS parent_id, doc_id, max(score) AS score FROM bm GROUP BY ALL) SELECT parent_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY parent_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM m")
def multiquery_dedup(spark, d):
    run = _bm25(spark, d).withColumn("parent_id", F.floor(F.col("query_id") / 4).cast("long"))
    return S.merge_subqueries(run).select("parent_id", "doc_id", _r("score"), "rank")


_MERGED = "SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (SELECT query_id // 4 AS parent_id, doc_id, max(score) AS score FROM {} GROUP BY ALL)"


@_q(f"WITH {_BASE_SQL}, mb AS ({_MERGED.format('bm')}), md AS ({_MERGED.format('dn')}), {_fuse_sql(by='parent_id').replace('FROM bm', 'FROM mb').replace('FROM dn', 'FROM md')} SELECT parent_id, doc_id, rank, in_bm25, in_dense, round(fusion_score, 6) AS fusion_score FROM fu")
def hybrid_subqueries(spark, d):
    """Four items are the subqueries of one question: both lists merged by best score, then fused."""
    of = lambda run: run.withColumn("parent_id", F.floor(F.col("query_id") / 4).cast("long"))
    return S.hybrid(of(_bm25(spark, d)), of(_dense(spark, d))).select("parent_id", "doc_id", "rank", "in_bm25", "in_dense", _r("fusion_score"))


@_q(f"WITH {_BASE_SQL}, {_fuse_sql()} SELECT query_id, doc_id, rank, in_bm25, in_dense, round(fusion_score, 6) AS fusion_score FROM fu")
def wrrf_fusion(spark, d):
    return _fused(spark, d).select("query_id", "doc_id", "rank", "in_bm25", "in_dense", _r("fusion_score"))


@_q(f"WITH {_bm25_sql(_RAW, False, 20)}, {_DENSE_SQL}, {_fuse_sql('0.3', 10)} SELECT query_id, doc_id, rank, round(raw, 9) AS score FROM fu")
def wrrf_sweep(spark, d):
    run = S.fuse(_bm25(spark, d, tokenize=T.tokens_raw, positive_only=False), _dense(spark, d), 0.3, 10, normalise=False)
    return run.select("query_id", "doc_id", "rank", F.round("fusion_score", 9).alias("score"))


@_q(f"WITH {_BASE_SQL}, {_fuse_sql()} SELECT source, query_id, min(rank) AS first_rank FROM fu JOIN documents USING (doc_id) GROUP BY ALL")
def distinct_docs_first_seen(spark, d):
    return _fused(spark, d).join(_read(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source", "query_id").agg(F.min("rank").alias("first_rank"))


@_q(f"WITH {_QRELS_SQL} SELECT * FROM qr")
def qrels(spark, d):
    return _qrels(spark, d)


@_q("WITH ch AS (" + _chunk_sql(SIZE, OVERLAP, "index") + f"), {_QRELS_SQL} SELECT query_id, chunk_id FROM qr JOIN ch USING (doc_id)")
def qrels_chunk(spark, d):
    return _qrels(spark, d).join(chunking.chunk_table(_docs(spark, d), SIZE, OVERLAP), "doc_id").select("query_id", "chunk_id")


@_q(f"WITH {_QRELS_SQL} SELECT count(*) AS n_queries, sum(coalesce(n_rel, 0))::BIGINT AS n_relevant, round(avg(coalesce(n_rel, 0)), 6) AS mean, count(*) FILTER (n_rel IS NULL) AS n_empty FROM (SELECT item_id AS query_id FROM benchmark) LEFT JOIN nr USING (query_id)")
def qrels_stats(spark, d):
    n = _qrels(spark, d).groupBy("query_id").agg(F.count("*").alias("n"))
    joined = _items(spark, d).join(n, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.agg(F.count("*").alias("n_queries"), F.sum("n").alias("n_relevant"), F.round(F.avg("n"), 6).alias("mean"), F.sum((F.col("n") == 0).cast("long")).alias("n_empty"))


@_q(f"WITH {_QRELS_SQL} SELECT item_id AS query_id FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM qr)")
def queries_without_relevant(spark, d):
    return _items(spark, d).join(_qrels(spark, d), "query_id", "left_anti").select("query_id")


@_q(f"WITH {_QRELS_SQL} SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM qr)")
def corpus_semi(spark, d):
    return _read(spark, d, "documents").join(_qrels(spark, d), "doc_id", "left_semi").select("doc_id", "source")


@_q(f"WITH {_BASE_SQL}, {_QRELS_SQL}, {_fuse_sql()}, {_metric_sql('fu')} SELECT query_id, {_ROUNDED} FROM me")
def rank_metrics(spark, d):
    return E.rank_metrics(_fused(spark, d), _qrels(spark, d)).select("query_id", *[_r(m) for m in _METRICS])


@_q(f"WITH {_bm25_sql()}, {_QRELS_SQL}, {_metric_sql('bm', k=10)} SELECT query_id, {_ROUNDED} FROM me")
def ndcg_at_10(spark, d):
    return E.rank_metrics(_bm25(spark, d), _qrels(spark, d), 10).select("query_id", *[_r(m) for m in _METRICS])


@_q(f"WITH {_BASE_SQL}, {_QRELS_SQL}, {_fuse_sql()}, h AS (SELECT fu.* FROM fu JOIN qr USING (query_id, doc_id)) SELECT query_id, " + ", ".join(f"count(rank) FILTER (rank <= {k}) AS hits_at_{k}, round(count(rank) FILTER (rank <= {k}) / {k}, 6) AS precision_at_{k}, round(count(rank) FILTER (rank <= {k}) / n_rel, 6) AS recall_at_{k}" for k in (5, 10, 20)) + " FROM nr LEFT JOIN h USING (query_id) GROUP BY query_id, n_rel")
def rank_metrics_at_k(spark, d):
    m = E.metrics_at(_fused(spark, d), _qrels(spark, d))
    return m.select("query_id", *[F.round(c, 6).alias(c) if "hits" not in c else F.col(c) for c in m.columns[1:]])


@_q(f"WITH {_BASE_SQL}, {_QRELS_SQL}, {_fuse_sql()}, {_metric_sql('bm', 'm0')}, {_metric_sql('fu', 'm1')} SELECT query_id, round(m1.precision - m0.precision, 6) AS precision_delta, round(m1.recall - m0.recall, 6) AS recall_delta, round(m1.ndcg - m0.ndcg, 6) AS ndcg_delta, round(m1.mrr - m0.mrr, 6) AS mrr_delta, round((m1.precision - m0.precision + m1.ndcg - m0.ndcg + m1.mrr - m0.mrr) / 3, 6) AS overall FROM m0 JOIN m1 USING (query_id)")
def rerank_improvement(spark, d):
    q = _qrels(spark, d)
    m = E.improvement(E.rank_metrics(_bm25(spark, d), q), E.rank_metrics(_fused(spark, d), q))
    return m.select("query_id", *[_r(c) for c in m.columns[1:]])


@_q(_GRID_SQL + " SELECT round(weight, 1) AS weight, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, count(*) AS n FROM me GROUP BY weight")
def weight_grid(spark, d):
    return _grid(spark, d).groupBy(F.round("weight", 1).alias("weight")).agg(F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("f1"), 6).alias("f1"), F.count("*").alias("n"))


@_q(_GRID_SQL + " SELECT round(weight, 1) AS weight, round(avg(f1), 6) AS f1 FROM me GROUP BY weight ORDER BY round(avg(f1), 9) DESC, weight LIMIT 1")
def weight_best(spark, d):
    means = _grid(spark, d).groupBy(F.round("weight", 1).alias("weight")).agg(F.avg("f1").alias("f1"))
    return means.orderBy(F.round("f1", 9).desc(), "weight").limit(1).select("weight", _r("f1"))


@_q(_GRID_SQL + ", b AS (SELECT query_id, weight, f1, row_number() OVER (PARTITION BY query_id ORDER BY round(f1, 9) DESC, weight) AS k FROM me WHERE round(weight, 1) IN (0, 0.3, 0.5, 0.7, 0.9, 1)) SELECT item_id AS query_id, round(coalesce(weight, 0.5), 1) AS weight FROM benchmark LEFT JOIN b ON b.query_id = item_id AND k = 1")
def weight_per_query(spark, d):
    some = _grid(spark, d).where(F.round("weight", 1).isin(E.QUERY_WEIGHTS))
    best = some.groupBy("query_id").agg(F.max_by("weight", F.struct(F.round("f1", 9), -F.col("weight"))).alias("w"))
    return _items(spark, d).join(best, "query_id", "left").select("query_id", F.round(F.coalesce("w", F.lit(0.5)), 1).alias("weight"))


@_q(_GRID_SQL + ", x AS (SELECT unnest(['f1', 'mrr', 'ndcg']) AS metric, unnest([f1, mrr, ndcg]) AS v FROM me WHERE round(weight, 1) = 0.5) SELECT metric, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std FROM x GROUP BY 1")
def metric_mean_std(spark, d):
    m = E.rank_metrics(_fused(spark, d), _qrels(spark, d)).unpivot("query_id", ["f1", "mrr", "ndcg"], "metric", "v")
    return m.groupBy("metric").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), 6).alias("std"))


_T_SQL = "CASE WHEN n >= 30 THEN 1.96 " + " ".join(f"WHEN n = {k} THEN {v}" for k, v in E.T_TABLE.items()) + " ELSE 2.0 END"


@_q(f"WITH {_BASE_SQL}, {_QRELS_SQL}, {_fuse_sql()}, {_metric_sql('fu')}, s AS (SELECT count(*) AS n, avg(ndcg) AS mean, coalesce(stddev_samp(ndcg), 0) AS sd FROM me), t AS (SELECT *, CASE WHEN n >= 2 THEN {_T_SQL} * sd / sqrt(n) ELSE 0 END AS h FROM s) SELECT n, round(mean, 6) AS mean, round(sd, 6) AS std, round(mean - h, 6) AS ci_low, round(mean + h, 6) AS ci_high FROM t")
def confidence_interval(spark, d):
    return E.interval(E.rank_metrics(_fused(spark, d), _qrels(spark, d)), "ndcg").select("n", _r("mean"), _r("std"), _r("ci_low"), _r("ci_high"))


@_q(f"WITH {_BASE_SQL}, {_QRELS_SQL}, {_fuse_sql()}, {_metric_sql('bm', 'm0')}, {_metric_sql('fu', 'm1')}, s AS (SELECT count(*) AS n, avg(m1.ndcg - m0.ndcg) AS m, stddev_samp(m1.ndcg - m0.ndcg) AS s FROM m0 JOIN m1 USING (query_id)), t AS (SELECT n, m / (s / sqrt(n)) AS t FROM s) SELECT n, round(t, 6) AS t_stat, round(2 * (1 - least(0.9999, abs(t) / (abs(t) + n - 1))), 6) AS p_approx, CASE WHEN 2 * (1 - least(0.9999, abs(t) / (abs(t) + n - 1))) < 0.001 THEN '***' WHEN 2 * (1 - least(0.9999, abs(t) / (abs(t) + n - 1))) < 0.01 THEN '**' WHEN 2 * (1 - least(0.9999, abs(t) / (abs(t) + n - 1))) < 0.05 THEN '*' ELSE '' END AS stars FROM t")
def paired_t(spark, d):
    q = _qrels(spark, d)
    both = E.rank_metrics(_fused(spark, d), q).select("query_id", F.col("ndcg").alias("a")).join(E.rank_metrics(_bm25(spark, d), q).select("query_id", F.col("ndcg").alias("b")), "query_id")
    return E.paired_t(both, "a", "b").select("n", _r("t_stat"), _r("p_approx"), E.stars(F.col("p_approx")).alias("stars"))


@_q("SELECT 'train' AS split, floor(count(*) * 0.6)::BIGINT AS n FROM benchmark UNION ALL SELECT 'validation', floor(count(*) * 0.2)::BIGINT FROM benchmark UNION ALL SELECT 'test', (count(*) - floor(count(*) * 0.6) - floor(count(*) * 0.2))::BIGINT FROM benchmark")
def split_counts(spark, d):
    return E.split(_items(spark, d)).groupBy("split").agg(F.count("*").alias("n"))


@_q(f"WITH {_BASE_SQL}, {_QRELS_SQL}, {_fuse_sql()}, {_metric_sql('fu')} SELECT query_id, CASE WHEN precision > 0.6 AND recall < 0.3 THEN 'precise, low coverage' WHEN precision < 0.3 AND recall > 0.5 THEN 'broad, decent coverage' WHEN precision < 0.3 AND recall < 0.3 THEN 'off topic' WHEN ndcg < 0.7 * mrr AND mrr > 0.3 THEN 'good first hit, poor tail' WHEN ndcg > 0.5 AND recall < 0.5 THEN 'good ranking, incomplete' ELSE 'mixed' END AS pattern, round(0.6 * ndcg + 0.2 * mrr + 0.2 * precision, 6) AS score FROM me")
def retrieval_pattern(spark, d):
    m = E.rank_metrics(_fused(spark, d), _qrels(spark, d))
    return m.select("query_id", E.pattern(F.col("precision"), F.col("recall"), F.col("ndcg"), F.col("mrr")).alias("pattern"), F.round(0.6 * F.col("ndcg") + 0.2 * F.col("mrr") + 0.2 * F.col("precision"), 6).alias("score"))


def _set_sql(c: str, n: int = 0) -> str:
    return rf"list_distinct(list_filter(string_split_regex(lower({c}), '\s+'), lambda w: length(w) > {n}))"


@_q(f"WITH {_ANSWERS_SQL}, s AS (SELECT *, {_set_sql('answer')} AS aw, {_set_sql('context')} AS cw FROM a) SELECT conv_id, turn, length(answer) AS n_chars, round(CASE WHEN length(context) > 0 THEN length(answer) / length(context) ELSE 0 END, 6) AS length_ratio, round(CASE WHEN len(aw) > 0 THEN len(list_intersect(aw, cw)) / len(aw) ELSE 0 END, 6) AS overlap FROM s")
def generation_basic(spark, d):
    a = _answers(spark, d)
    ratio = F.when(F.length("context") > 0, F.length("answer") / F.length("context")).otherwise(0.0)
    return a.select("conv_id", "turn", F.length("answer").cast("long").alias("n_chars"), F.round(ratio, 6).alias("length_ratio"), F.round(A.share(A.word_set(F.col("answer")), A.word_set(F.col("context"))), 6).alias("overlap"))


@_q(f"WITH {_ANSWERS_SQL}, s AS (SELECT *, {_set_sql('answer', 4)} AS aw, {_set_sql('context', 4)} AS cw FROM a) SELECT conv_id, turn, round(CASE WHEN len(aw) > 0 THEN len(list_intersect(aw, cw)) / len(aw) ELSE 0 END, 6) AS usage FROM s")
def context_usage(spark, d):
    return _answers(spark, d).select("conv_id", "turn", F.round(A.share(A.word_set(F.col("answer"), 4), A.word_set(F.col("context"), 4)), 6).alias("usage"))


@_q(f"WITH {_ANSWERS_SQL}, s AS (SELECT *, {_set_sql('query', 3)} AS qw FROM a) SELECT conv_id, turn, round(CASE WHEN len(qw) > 0 THEN len(list_filter(qw, lambda w: contains(lower(answer), w))) / len(qw) ELSE 1 END, 6) AS addressed FROM s")
def query_addressing(spark, d):
    return _answers(spark, d).select("conv_id", "turn", F.round(A.addressing(F.col("query"), F.col("answer")), 6).alias("addressed"))


@_q(rf"WITH {_ANSWERS_SQL}, s AS (SELECT *, list_filter(string_split_regex(lower(answer), '\s+'), lambda w: w <> '') AS w FROM a) SELECT conv_id, turn, round(CASE WHEN len(w) > 0 THEN least(1, 10 * len(list_filter(w, lambda x: list_contains({A.HEDGES}, x))) / len(w)) ELSE 0 END, 6) AS hedging, regexp_matches(answer, '\d+') OR regexp_matches(answer, '\b[A-Z][a-z]+') AS specific FROM s")
def hedging(spark, d):
    return _answers(spark, d).select("conv_id", "turn", F.round(A.hedging(F.col("answer")), 6).alias("hedging"), A.specific(F.col("answer")).alias("specific"))


_PAIRS_SQL = rf"g AS (SELECT item_id, item_id // 4 AS parent_id, {_set_sql('text')} AS w FROM benchmark), p AS (SELECT a.parent_id, 1 - len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS x FROM g a JOIN g b ON a.parent_id = b.parent_id AND a.item_id < b.item_id)"


@_q(f"WITH {_PAIRS_SQL} SELECT parent_id, round(avg(x), 6) AS diversity FROM p GROUP BY 1")
def query_diversity(spark, d):
    g = _items(spark, d).select("query_id", F.floor(F.col("query_id") / 4).cast("long").alias("parent_id"), A.word_set(F.col("text")).alias("w"))
    other = g.select(F.col("query_id").alias("o_id"), F.col("parent_id").alias("o_parent"), F.col("w").alias("o_w"))
    pairs = g.join(other, (F.col("parent_id") == F.col("o_parent")) & (F.col("query_id") < F.col("o_id")))  # groups of four
    return pairs.groupBy("parent_id").agg(F.round(F.avg(1 - A.jaccard(F.col("w"), F.col("o_w"))), 6).alias("diversity"))


@_q(f"WITH {_BASE_SQL}, {_fuse_sql()}, j AS (SELECT bm.query_id, bm.rank AS old, fu.rank AS new FROM bm JOIN fu USING (query_id, doc_id)) SELECT query_id, round(avg(abs(new - old)), 6) AS mean_change, max(abs(new - old)) AS max_change, count(*) FILTER (old <= 5 AND new > 5) AS left_top5 FROM j GROUP BY 1")
def position_changes(spark, d):
    old = _bm25(spark, d).select("query_id", "doc_id", F.col("rank").alias("old"))
    j = old.join(_fused(spark, d).select("query_id", "doc_id", F.col("rank").alias("new")), ["query_id", "doc_id"])
    change = F.abs(F.col("new") - F.col("old"))
    return j.groupBy("query_id").agg(F.round(F.avg(change), 6).alias("mean_change"), F.max(change).alias("max_change"), F.count_if((F.col("old") <= 5) & (F.col("new") > 5)).alias("left_top5"))


@_q(f"WITH {_bm25_sql()}, q AS (SELECT item_id AS query_id, {_set_sql('text')} AS w FROM benchmark), j AS (SELECT bm.query_id, len(list_intersect(q.w, {_set_sql('d.text')})) / len(q.w) AS x FROM bm JOIN q USING (query_id) JOIN documents d USING (doc_id) WHERE rank <= 5) SELECT query_id, round(avg(x), 6) AS overlap FROM j GROUP BY 1")
def query_overlap(spark, d):
    top = _bm25(spark, d, k=5).join(_docs(spark, d).withColumnRenamed("text", "d_text"), "doc_id").join(_items(spark, d), "query_id")
    return top.groupBy("query_id").agg(F.round(F.avg(A.share(A.word_set(F.col("text")), A.word_set(F.col("d_text")))), 6).alias("overlap"))


_LIST_SQL = f"WITH {_bm25_sql()}, l AS (SELECT query_id, list(text ORDER BY rank) AS docs FROM bm JOIN documents USING (doc_id) WHERE rank <= 10 GROUP BY 1)"


def _lists(spark, d):
    top = _bm25(spark, d, k=10).join(_docs(spark, d), "doc_id")
    return top.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("docs"))


@_q(_LIST_SQL + ", s AS (SELECT query_id, greatest(1, len(docs) // 2) AS h, list_transform(docs, lambda x: len(list_filter(string_split_regex(x, '\\s+'), lambda w: w <> ''))) AS n FROM l), m AS (SELECT query_id, len(n) AS k, list_avg(n[1:h]) AS a, list_avg(n[h + 1:]) AS b FROM s) SELECT query_id, round(CASE WHEN k < 2 OR a + b = 0 THEN 0.5 ELSE a / (a + b) END, 6) AS bias FROM m")
def length_bias(spark, d):
    return _lists(spark, d).select("query_id", F.round(A.length_bias(F.col("docs")), 6).alias("bias"))


@_q(_LIST_SQL + " SELECT query_id, sha256(array_to_string(list_transform(docs, lambda x, i: '[' || i || '] ' || x), chr(10) || chr(10))) AS numbered, sha256(array_to_string(docs[1:3], chr(10) || chr(10))) AS context FROM l")
def numbered_docs(spark, d):
    return _lists(spark, d).select("query_id", F.sha2(T.numbered(F.col("docs")).cast("binary"), 256).alias("numbered"), F.sha2(F.array_join(F.slice("docs", 1, 3), "\n\n").cast("binary"), 256).alias("context"))


@_q("SELECT item_id AS query_id, CASE WHEN length(text) > 150 THEN substr(text, 1, 150) || '...' ELSE text END AS preview, 'Question: ' || text AS prompt FROM benchmark")
def text_preview(spark, d):
    return _items(spark, d).select("query_id", T.preview(F.col("text"), 150).alias("preview"), T.fill_template(F.lit("Question: {query}"), {"query": F.col("text")}).alias("prompt"))


@_q(f"WITH {_BASE_SQL}, {_QRELS_SQL}, {_metric_sql('bm', 'm0')}, {_metric_sql('dn', 'm1')}, {_fuse_sql()}, {_metric_sql('fu', 'm2')}, x AS (SELECT 'bm25' AS config, ndcg FROM m0 UNION ALL SELECT 'dense', ndcg FROM m1 UNION ALL SELECT 'hybrid', ndcg FROM m2), s AS (SELECT config, avg(ndcg) AS m FROM x GROUP BY 1), b AS (SELECT m AS base FROM s WHERE config = 'bm25') SELECT config, round(m, 6) AS ndcg, round(m - base, 6) AS gain, round(CASE WHEN base = 0 THEN 0 ELSE (m - base) / base * 100 END, 4) AS gain_pct FROM s CROSS JOIN b")
def ablation_table(spark, d):
    q = _qrels(spark, d)
    runs = {"bm25": _bm25(spark, d), "dense": _dense(spark, d), "hybrid": _fused(spark, d)}
    rows = None
    for name, run in runs.items():
        m = E.rank_metrics(run, q).agg(F.avg("ndcg").alias("m")).withColumn("config", F.lit(name))
        rows = m if rows is None else rows.unionByName(m)
    base = F.max(F.when(F.col("config") == "bm25", F.col("m"))).over(Window.partitionBy(F.lit(1)))  # three rows
    rows = rows.withColumn("base", base)
    return rows.select("config", F.round("m", 6).alias("ndcg"), F.round(F.col("m") - F.col("base"), 6).alias("gain"), F.round(F.when(F.col("base") == 0, 0.0).otherwise((F.col("m") - F.col("base")) / F.col("base") * 100), 4).alias("gain_pct"))


def _sweep_sql(size: int, fused: bool = False) -> str:
    """One row of the sweep: chunks take the documents' place, sparse lists of 20 are judged to the tenth, alone or fused with the dense ones."""
    chunk = _chunk_sql(size, size // 10, "sweep")
    lists = f""", dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (
  SELECT s.query_id, ch.chunk_id AS doc_id, s.score FROM sims s JOIN ch ON ch.doc_id = s.doc_id)) WHERE rank <= 20), {_fuse_sql('0.5', 10)}""" if fused else ""
    return f"""(WITH ch AS ({chunk}), docs AS (SELECT chunk_id AS doc_id, chunk AS text FROM ch), {_bm25_sql(_RAW, False, 20).replace("documents", "docs")}{lists},
qr AS (SELECT item_id AS query_id, chunk_id AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) JOIN ch USING (doc_id)), nr AS (SELECT query_id, count(*) AS n_rel FROM qr GROUP BY 1), {_metric_sql("fu" if fused else "bm", k=10)}
SELECT {size} AS chunk_size, {size // 10} AS chunk_overlap, (SELECT count(*) FROM ch) AS num_chunks, round((SELECT avg(length(chunk)) FROM ch), 6) AS avg_chunk_length,
  round(avg(ndcg), 6) AS ndcg, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(f1), 6) AS f1 FROM me)"""


_SIMS_SQL = """WITH nv AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings),
sims AS (SELECT b.item_id AS query_id, d.doc_id, list_dot_product(q.v, d.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(d.v, d.v)) AS score FROM benchmark b JOIN nv q ON q.doc_id = b.item_id CROSS JOIN nv d) """


def _sweep(spark, d, fused=False):
    """Fused, a chunk's vector is its document's, a query's that of its id; documents beyond the table of vectors have none."""
    asked = _items(spark, d).join(_vectors(spark, d), F.col("query_id") == F.col("doc_id")).select("query_id", "embedding")
    return rag.sweep(_docs(spark, d), _items(spark, d), _qrels(spark, d), SWEEP, vectors=(_vectors(spark, d), asked) if fused else None)


_SWEPT = ("ndcg", "precision", "recall", "mrr", "f1")


@_q(" UNION ALL ".join(f"SELECT * FROM {_sweep_sql(s)}" for s in SWEEP))
def chunk_size_sweep(spark, d):
    return _sweep(spark, d).select("chunk_size", "chunk_overlap", "num_chunks", _r("avg_chunk_length"), *[_r(m) for m in _SWEPT])


@_q(_SIMS_SQL + " UNION ALL ".join(f"SELECT * FROM {_sweep_sql(s, True)}" for s in SWEEP))
def chunk_size_sweep_fused(spark, d):
    return _sweep(spark, d, True).select("chunk_size", "chunk_overlap", "num_chunks", _r("avg_chunk_length"), *[_r(m) for m in _SWEPT])


@_q("SELECT chunk_size, chunk_overlap, ndcg FROM (" + " UNION ALL ".join(f"SELECT * FROM {_sweep_sql(s)}" for s in SWEEP) + ") ORDER BY ndcg DESC, chunk_size LIMIT 1")
def chunk_size_best(spark, d):
    return rag.best_size(_sweep(spark, d)).select("chunk_size", "chunk_overlap", _r("ndcg"))


def representative_queries(spark, d):
    """Items clustered by their vectors; k-means has no SQL."""
    asked = _items(spark, d).join(_vectors(spark, d), F.col("query_id") == F.col("doc_id")).select("query_id", "embedding")
    return sampling.representatives(asked)


def rag_answers(spark, d):
    """Plan, retrieve, rerank and answer every item by rules instead of a model: shows the plan, has no SQL."""
    return rag.answer(_items(spark, d), _docs(spark, d), models.RuleClient(), index=_index(spark, d)).select("query_id", F.size("documents").alias("n_documents"), F.sha2(F.col("answer").cast("binary"), 256).alias("answer"), "status")


def rag_quality(spark, d):
    """The answers of rag_answers judged, with their retrieval metrics; each item is its own truth."""
    answered = rag.answer(_items(spark, d), _docs(spark, d), models.RuleClient(), index=_index(spark, d))
    truths = _items(spark, d).withColumnRenamed("text", "ground_truth")
    return rag.evaluate(answered, truths, models.RuleClient(), E.rank_metrics(_bm25(spark, d), _qrels(spark, d)))


_JUDGED_SQL = f"""WITH {_ANSWERS_SQL}, s AS (SELECT *, {_set_sql('answer')} AS aw, {_set_sql('context')} AS cw, {_set_sql('query')} AS qw FROM a),
j AS (SELECT conv_id, turn, query, answer, CASE WHEN len(aw) > 0 THEN len(list_intersect(aw, cw)) / len(aw) ELSE 0 END AS fa, CASE WHEN len(qw) > 0 THEN len(list_intersect(qw, aw)) / len(qw) ELSE 0 END AS ac,
  CASE WHEN len(cw) > 0 THEN len(list_intersect(cw, aw)) / len(cw) ELSE 0 END AS cp, CASE WHEN len(qw) > 0 THEN len(list_intersect(qw, cw)) / len(qw) ELSE 0 END AS cr FROM s),
o AS (SELECT *, CASE WHEN cp + cr > 0 THEN 2 * cp * cr / (cp + cr) ELSE 0 END AS cf, (fa + ac) / 2 AS gq FROM j)"""


def _judged(spark, d):
    """Word overlaps stand in for a judge's metrics."""
    w = A.word_set
    return _answers(spark, d).withColumns({
        "fa": A.share(w(F.col("answer")), w(F.col("context"))), "ac": A.share(w(F.col("query")), w(F.col("answer"))),
        "cp": A.share(w(F.col("context")), w(F.col("answer"))), "cr": A.share(w(F.col("query")), w(F.col("context"))),
    })


@_q(_JUDGED_SQL + " SELECT conv_id, turn, round(gq, 6) AS generation_quality, round(0.3 * cf + 0.2 * cf + 0.5 * gq, 6) AS overall_quality FROM o")
def end_to_end_score(spark, d):
    j, none = _judged(spark, d), F.lit(None).cast("double")
    c = {x: F.col(x) for x in ("cp", "cr", "fa", "ac")}
    return j.select("conv_id", "turn", _r(C.generation_quality(c["fa"], c["ac"])).alias("generation_quality"), _r(C.end_to_end(none, none, c["cp"], c["cr"], c["fa"], c["ac"])).alias("overall_quality"))


@_q(_JUDGED_SQL + " SELECT conv_id, turn, CASE WHEN gq >= 0.6 THEN 'positive' WHEN gq >= 0.3 THEN 'partial' ELSE 'negative' END AS tier, CASE WHEN length(query) > 500 THEN substr(query, 1, 500) || '...' ELSE query END AS inputs, CASE WHEN length(answer) > 500 THEN substr(answer, 1, 500) || '...' ELSE answer END AS outputs FROM o")
def reflection_records(spark, d):
    gq = C.generation_quality(F.col("fa"), F.col("ac"))
    j = _judged(spark, d).withColumn("r", C.reflection("generator", F.col("query"), F.col("answer"), C.answer_note(F.col("fa"), F.col("ac")), gq))
    return j.select("conv_id", "turn", C.tier(gq, "generator").alias("tier"), F.col("r.Inputs").alias("inputs"), F.col("r.Generated Outputs").alias("outputs"))


@_q(f"WITH {_ANSWERS_SQL} SELECT conv_id, turn, CASE WHEN trim(context) <> '' THEN context ELSE 'No context retrieved.' END AS context, CASE WHEN trim(coalesce(answer, '')) <> '' THEN answer ELSE 'No answer generated.' END AS answer FROM a")
def evaluation_inputs(spark, d):
    return _answers(spark, d).select("conv_id", "turn", F.element_at(C.contexts_or_default(F.array("context")), 1).alias("context"), C.text_or_default(F.col("answer"), C.NO_ANSWER).alias("answer"))


@_q(f"WITH {_bm25_sql()}, n AS (SELECT query_id, count(*) AS n FROM bm GROUP BY 1) SELECT query_id, rank, round(1 - (rank - 1) / n, 6) AS score, round(1 / rank, 6) AS fallback FROM bm JOIN n USING (query_id)")
def rank_to_score(spark, d):
    lists = _bm25(spark, d).groupBy("query_id").agg(F.count("*").alias("n"))
    both = lists.select("query_id", F.posexplode(F.arrays_zip(C.rank_scores(F.col("n")).alias("s"), C.fallback_scores(F.col("n")).alias("f"))).alias("i", "x"))
    return both.select("query_id", (F.col("i") + 1).cast("long").alias("rank"), _r(F.col("x.s")).alias("score"), _r(F.col("x.f")).alias("fallback"))


@_q(f"WITH {_BASE_SQL}, {_QRELS_SQL}, {_fuse_sql()}, {_metric_sql('fu')}, k AS (SELECT query_id, count(*) FILTER (fu.rank <= 5 AND qr.doc_id IS NOT NULL) / 5 AS p5 FROM fu LEFT JOIN qr USING (query_id, doc_id) GROUP BY 1) SELECT item_id AS query_id, round(coalesce(ndcg, 0.5), 6) AS planner, round(0.6 * ndcg + 0.2 * mrr + 0.2 * p5, 6) AS reranker FROM benchmark LEFT JOIN me ON item_id = me.query_id LEFT JOIN k ON item_id = k.query_id")
def module_scores(spark, d):
    q, run = _qrels(spark, d), _fused(spark, d)
    at5 = E.metrics_at(run, q, (5,)).select("query_id", "precision_at_5")
    m = _items(spark, d).select("query_id").join(E.rank_metrics(run, q), "query_id", "left").join(at5, "query_id", "left")
    return m.select("query_id", _r(C.planner_score(F.col("ndcg"))).alias("planner"), _r(C.reranker_score(F.col("ndcg"), F.col("mrr"), F.col("precision_at_5"))).alias("reranker"))


@_q(f"WITH {_BASE_SQL}, {_QRELS_SQL}, {_fuse_sql()}, p AS (SELECT min(doc_id) AS pos, substr(text, 1, 200) AS key FROM documents WHERE text <> '' GROUP BY 2) SELECT query_id, doc_id, coalesce(pos, -1) AS pos FROM fu JOIN documents USING (doc_id) LEFT JOIN p ON substr(text, 1, 200) = key")
def prefix_lookup(spark, d):
    keyed = _docs(spark, d).withColumn("key", F.substring("text", 1, 200))
    run = _fused(spark, d).select("query_id", "doc_id").join(keyed.select("doc_id", "key"), "doc_id")
    return tables.lookup(run, keyed.select("key", F.col("doc_id").alias("pos")), "key", "pos", "pos").select("query_id", "doc_id", "pos")


@_q(f"WITH {_QRELS_SQL} SELECT item_id AS query_id, coalesce(array_to_string(list_sort(list(DISTINCT doc_id) FILTER (doc_id IS NOT NULL)), ','), '') AS doc_ids FROM benchmark LEFT JOIN qr ON item_id = query_id GROUP BY 1")
def label_lists(spark, d):
    lists = _qrels(spark, d).groupBy("query_id").agg(F.array_sort(F.collect_set("doc_id")).alias("l"))
    return _items(spark, d).join(lists, "query_id", "left").select("query_id", F.coalesce(F.array_join(F.col("l").cast("array<string>"), ","), F.lit("")).alias("doc_ids"))


@_q(f"WITH g AS (SELECT item_id // 4 AS parent_id, item_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '') AS w FROM benchmark), o AS (SELECT parent_id, arg_min(w, item_id) AS ow, count(*) AS n, round(avg(len(w)), 6) AS mean_words, list_distinct(flatten(list(w))) AS al FROM g GROUP BY 1) SELECT parent_id, n, mean_words, round(len(list_intersect(list_distinct(ow), al)) / len(list_distinct(ow)), 6) AS coverage FROM o")
def query_structure(spark, d):
    g = _items(spark, d).select(F.floor(F.col("query_id") / 4).cast("long").alias("parent_id"), "query_id", F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "").alias("w"))
    o = g.groupBy("parent_id").agg(F.min_by("w", "query_id").alias("ow"), F.count("*").alias("n"), F.avg(F.size("w")).alias("mean"), F.array_distinct(F.flatten(F.collect_list("w"))).alias("al"))
    return o.select("parent_id", "n", _r(F.col("mean")).alias("mean_words"), _r(A.share(F.array_distinct("ow"), F.col("al"))).alias("coverage"))


@_q("SELECT substr(md5('Question: ' || text), 1, 12) AS prompt_hash, item_id AS query_id FROM benchmark")
def prompt_hash(spark, d):
    return _items(spark, d).select(F.substring(F.md5(F.concat(F.lit("Question: "), "text").cast("binary")), 1, 12).alias("prompt_hash"), "query_id")


@_q(f"""WITH {_BASE_SQL}, {_QRELS_SQL}, {_fuse_sql()}, {_metric_sql('bm', 'm0')}, {_metric_sql('dn', 'm1')}, {_metric_sql('fu', 'm2')},
x AS (SELECT 'bm25' AS config, query_id, ndcg FROM m0 UNION ALL SELECT 'dense', query_id, ndcg FROM m1 UNION ALL SELECT 'hybrid', query_id, ndcg FROM m2),
s AS (SELECT config, count(*) AS n, avg(x.ndcg) AS mean, coalesce(stddev_samp(x.ndcg), 0) AS sd, avg(x.ndcg - m0.ndcg) AS dm, stddev_samp(x.ndcg - m0.ndcg) AS ds FROM x JOIN m0 USING (query_id) GROUP BY 1),
t AS (SELECT *, CASE WHEN n >= 2 THEN {_T_SQL} * sd / sqrt(n) ELSE 0 END AS h, CASE WHEN n < 2 THEN 0 WHEN ds = 0 THEN CASE WHEN dm <> 0 THEN 1e300 ELSE 0 END ELSE abs(dm / (ds / sqrt(n))) END AS t FROM s),
p AS (SELECT *, CASE WHEN n < 2 OR t = 0 THEN CASE WHEN n < 2 OR ds = 0 THEN 1 ELSE 2 END WHEN t = 1e300 THEN 0 ELSE 2 * (1 - least(0.9999, t / (t + n - 1))) END AS p FROM t)
SELECT config AS configuration, printf('%.4f', mean) AS score, printf('[%.4f, %.4f]', mean - h, mean + h) AS ci, printf('%+.4f', dm) AS gain, printf('%.4f', p) AS p_value, CASE WHEN p < 0.05 THEN 'Yes' ELSE 'No' END AS significant FROM p""")
def report_table(spark, d):
    """Three configurations against the first: mean, interval, gain, and the paired test of the gain."""
    q = _qrels(spark, d)
    runs = {"bm25": _bm25(spark, d), "dense": _dense(spark, d), "hybrid": _fused(spark, d)}
    scores = None
    for name, run in runs.items():  # three
        one = E.rank_metrics(run, q).select(F.lit(name).alias("config"), "query_id", F.col("ndcg").alias("a"))
        scores = one if scores is None else scores.unionByName(one)
    scores = storage.write(scores, "report-scores")
    base = scores.where("config = 'bm25'").select("query_id", F.col("a").alias("b"))
    both = scores.join(base, "query_id")
    i, gains = E.interval(both, "a", ("config",)), both.groupBy("config").agg(F.avg(F.col("a") - F.col("b")).alias("gain"))
    rows = i.join(E.paired_t(both, "a", "b", ("config",)).drop("n"), "config").join(gains, "config")
    rows = rows.select("config", F.col("mean").alias("score"), "ci_low", "ci_high", "gain", F.col("p_approx").alias("p_value"), (F.col("p_approx") < 0.05).alias("is_significant"))
    t = reports.ablation_table(rows)
    return t.select(F.col("Configuration").alias("configuration"), F.col("Test Score").alias("score"), F.col("95% CI").alias("ci"), F.col("vs Baseline").alias("gain"), F.col("p-value").alias("p_value"), F.col("Significant").alias("significant"))


@_q(f"WITH {_BASE_SQL}, {_QRELS_SQL}, {_fuse_sql()}, g AS (SELECT query_id, count(*) AS n, count(qr.doc_id) AS h FROM fu LEFT JOIN qr USING (query_id, doc_id) GROUP BY 1) SELECT query_id, round(h / n, 6) AS retrieval_precision, round(h / n_rel, 6) AS retrieval_recall, round(CASE WHEN h > 0 THEN 2 * (h / n) * (h / n_rel) / (h / n + h / n_rel) ELSE 0 END, 6) AS retrieval_f1, n AS chunks_retrieved, n_rel AS chunks_relevant, h AS chunks_hit, round(h / n, 6) AS id_precision, round(h / n_rel, 6) AS id_recall FROM g JOIN nr USING (query_id)")
def retrieval_bundle(spark, d):
    m = bundles.evaluate("retrieval", _fused(spark, d), _qrels(spark, d))
    return m.select("query_id", *[_r(c) if dict(m.dtypes)[c] == "double" else c for c in m.columns[1:]])


def _at5_sql(run: str, name: str) -> str:
    return f"{name} AS (SELECT n.query_id, count(r.rank) FILTER (r.rank <= 5 AND q.doc_id IS NOT NULL) / 5 AS p5 FROM nr n LEFT JOIN {run} r ON r.query_id = n.query_id LEFT JOIN qr q ON q.query_id = r.query_id AND q.doc_id = r.doc_id GROUP BY 1)"


def _gain_sql(c: str, old: str, new: str) -> str:
    return f"round({new} - {old}, 6) AS {c}_improvement, round(CASE WHEN {old} = 0 THEN 0 ELSE ({new} - {old}) / {old} * 100 END, 4) AS {c}_improvement_pct"


@_q(f"WITH {_BASE_SQL}, {_QRELS_SQL}, {_fuse_sql()}, {_metric_sql('bm', 'm0')}, {_metric_sql('fu', 'm1')}, {_at5_sql('bm', 'k0')}, {_at5_sql('fu', 'k1')} SELECT m0.query_id, {_gain_sql('ndcg', 'm0.ndcg', 'm1.ndcg')}, {_gain_sql('mrr', 'm0.mrr', 'm1.mrr')}, {_gain_sql('precision_at_5', 'k0.p5', 'k1.p5')} FROM m0 JOIN m1 USING (query_id) JOIN k0 USING (query_id) JOIN k1 USING (query_id)")
def reranker_bundle(spark, d):
    m = bundles.evaluate("reranker", _bm25(spark, d), _fused(spark, d), _qrels(spark, d))
    return m.select("query_id", *[F.round(c, 4 if c.endswith("pct") else 6).alias(c) for c in m.columns if "improvement" in c])


def _plans(spark, d):
    """Four items as the queries of one plan; a question of its own where a plan has one."""
    items = _items(spark, d).withColumn("parent_id", F.floor(F.col("query_id") / 4).cast("long"))
    plans = items.groupBy(F.col("parent_id").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("query_id", "text"))), lambda x: x["text"]).alias("queries"))
    return plans.withColumn("mode", F.when(F.col("query_id") % 2 == 0, "decomposition").otherwise("reformulation"))


@_q("SELECT item_id // 4 AS query_id, count(*) AS num_queries, CASE WHEN item_id // 4 % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_decomposition FROM benchmark GROUP BY 1")
def planner_bundle(spark, d):
    return bundles.evaluate("query_planner", _plans(spark, d))


@_q(f"WITH {_ANSWERS_SQL}, s AS (SELECT *, {_set_sql('answer')} AS aw, {_set_sql('context')} AS cw, {_set_sql('query')} AS gw FROM a) SELECT conv_id, turn, length(answer) AS answer_length, round(CASE WHEN length(context) > 0 THEN length(answer) / length(context) ELSE 0 END, 6) AS answer_length_ratio, round(CASE WHEN len(aw) > 0 THEN len(list_intersect(aw, cw)) / len(aw) ELSE 0 END, 6) AS context_term_overlap, round(CASE WHEN len(gw) > 0 THEN len(list_intersect(gw, aw)) / len(gw) ELSE 0 END, 6) AS ground_truth_term_overlap FROM s")
def generation_against_truth(spark, d):
    """The user's turn stands in for the truth."""
    found = bundles.generation_basic(F.col("answer"), F.col("query"), F.col("context"))
    return _answers(spark, d).select("conv_id", "turn", *[(c if n == "answer_length" else F.round(c, 6)).alias(n) for n, c in found.items()])


@_q(_JUDGED_SQL + ", b AS (SELECT role, gq AS score, gq >= 0.1 AS ok FROM (SELECT 'user' AS role, gq FROM o)) SELECT role, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(ok::INT), 6) AS success_rate, count(*) FILTER (NOT ok) AS n_errors FROM b GROUP BY 1")
def batch_summary(spark, d):
    gq = C.generation_quality(F.col("fa"), F.col("ac"))
    m = bundles.batch_summary(_judged(spark, d).select(F.lit("user").alias("role"), gq.alias("score"), (gq >= 0.1).alias("success")), ("role",))
    return m.select("role", "n", _r("mean_score"), _r("success_rate"), "n_errors")


@_q(_JUDGED_SQL + " SELECT conv_id, turn, round(cp, 6) AS context_precision, round(cr, 6) AS context_recall, round(cf, 6) AS context_f1 FROM o")
def context_scores(spark, d):
    j = bundles.contexts(_judged(spark, d).select("conv_id", "turn", F.col("cp").alias("context_precision"), F.col("cr").alias("context_recall")))
    return j.select("conv_id", "turn", _r("context_precision"), _r("context_recall"), _r("context_f1"))


_FEEDBACK_SQL = rf"""{_JUDGED_SQL}, u AS (SELECT o.*, context, {_set_sql('answer', 4)} AS a4, {_set_sql('context', 4)} AS c4, {_set_sql('query', 3)} AS q3, list_filter(string_split_regex(lower(answer), '\s+'), lambda w: w <> '') AS w FROM o JOIN a USING (conv_id, turn, query, answer)),
v AS (SELECT *, CASE WHEN len(a4) > 0 THEN len(list_intersect(a4, c4)) / len(a4) ELSE 0 END AS us, CASE WHEN len(q3) > 0 THEN len(list_filter(q3, lambda x: contains(lower(answer), x))) / len(q3) ELSE 1 END AS ad,
  CASE WHEN len(w) > 0 THEN least(1, 10 * len(list_filter(w, lambda x: list_contains({A.HEDGES}, x))) / len(w)) ELSE 0 END AS he, regexp_matches(answer, '\d+') OR regexp_matches(answer, '\b[A-Z][a-z]+') AS sp FROM u),
y AS (SELECT conv_id, turn, CASE WHEN gq >= 0.6 THEN concat_ws(' ', 'Works.', CASE WHEN us > 0.6 THEN 'It rests on the context.' END, CASE WHEN ad > 0.7 THEN 'It answers what was asked.' END, CASE WHEN he < 0.2 THEN 'It is plain.' END)
  WHEN gq >= 0.3 THEN concat_ws(' ', 'Half way.', CASE WHEN fa < ac THEN concat_ws(' ', 'Say only what the context says.', CASE WHEN us < 0.5 THEN 'Use more of it.' END) WHEN ac < fa THEN concat_ws(' ', 'It rests on the context but misses the question.', CASE WHEN ad < 0.5 THEN 'Take up the question''s words.' END) ELSE 'Both sides need work.' END, CASE WHEN he > 0.3 THEN 'Hedge less.' END)
  ELSE concat_ws(' ', 'Fails.', CASE WHEN fa < 0.3 THEN 'Most of it isn''t in the context.' END, CASE WHEN ac < 0.3 THEN 'It doesn''t answer the question.' END, CASE WHEN us < 0.3 THEN 'The context is hardly used.' END, CASE WHEN ad < 0.3 THEN 'The question is hardly taken up.' END, CASE WHEN he > 0.4 THEN 'It hedges too much.' END, CASE WHEN NOT sp THEN 'It names nothing specific.' END) END AS said FROM v)"""


@_q(_FEEDBACK_SQL + " SELECT conv_id, turn, said AS feedback FROM y")
def generator_feedback(spark, d):
    """Without the figures, whose halves the two systems round differently."""
    gq = C.generation_quality(F.col("fa"), F.col("ac"))
    told = feedback.generator(gq, F.col("fa"), F.col("ac"), A.share(A.word_set(F.col("answer"), 4), A.word_set(F.col("context"), 4)), A.addressing(F.col("query"), F.col("answer")), A.hedging(F.col("answer")), A.specific(F.col("answer")))
    return _judged(spark, d).select("conv_id", "turn", F.regexp_replace(told, "faithfulness [0-9.]+, accuracy [0-9.]+[.] ", "").alias("feedback"))


@_q(_GRID_SQL + ", s AS (SELECT round(weight, 1) AS weight, count(*) AS n, avg(ndcg) AS mean, coalesce(stddev_samp(ndcg), 0) AS sd FROM me GROUP BY 1) SELECT weight, n, round(mean, 6) AS mean, round(mean - (SELECT mean FROM s WHERE weight = 0), 6) AS gain FROM s")
def configurations_by_queries(spark, d):
    """Every configuration (here: fusion weights) over every labelled query, against the first."""
    means = _grid(spark, d).groupBy(F.round("weight", 1).alias("weight")).agg(F.count("*").alias("n"), F.avg("ndcg").alias("mean"))
    first = F.first("mean").over(Window.partitionBy(F.lit(1)).orderBy("weight"))  # eleven rows
    return means.select("weight", "n", _r("mean"), F.round(F.col("mean") - first, 6).alias("gain"))


def _candidates(spark, d):
    """The score matrix of a prompt search, with the fusion weights for its candidates."""
    return _grid(spark, d).select(F.round(F.col("weight") * 10).cast("long").alias("candidate"), "query_id", F.col("f1").alias("score"))


_CANDIDATES_SQL = _GRID_SQL + """, x AS (SELECT round(weight * 10)::BIGINT AS candidate, query_id, f1 AS score FROM me),
fr AS (SELECT candidate, query_id, score FROM (SELECT *, max(round(score, 9)) OVER (PARTITION BY query_id) AS b FROM x) WHERE round(score, 9) = b)"""


@_q(_CANDIDATES_SQL + " SELECT candidate, query_id, round(score, 6) AS score FROM fr")
def prompt_frontier(spark, d):
    return pareto.frontier(_candidates(spark, d)).select("candidate", "query_id", _r("score"))


@_q(_CANDIDATES_SQL + """, s AS (SELECT candidate, list_sort(list(query_id)) AS q, count(*) AS wins FROM fr GROUP BY 1), n AS (SELECT s.*, m FROM s JOIN (SELECT candidate, round(avg(score), 9) AS m FROM x GROUP BY 1) USING (candidate))
SELECT candidate, wins, round(m, 6) AS mean FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.candidate <> a.candidate AND list_has_all(b.q, a.q) AND (b.wins > a.wins OR b.m > a.m OR (b.m = a.m AND b.candidate < a.candidate)))""")
def prompt_parents(spark, d):
    return pareto.parents(_candidates(spark, d)).select("candidate", "wins", _r("mean"))


_RERANKED_SQL = _LIST_SQL.split(", l AS")[0] + r""", b AS (SELECT query_id, rank, doc_id, text, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS k FROM bm JOIN documents USING (doc_id) WHERE rank <= 10),
c AS (SELECT query_id, count(*) AS n FROM b GROUP BY 1),
a AS (SELECT query_id, n - rank + 1 AS rank, k FROM b JOIN c USING (query_id) UNION ALL SELECT query_id, n + 1, md5('a text of nobody') FROM c UNION ALL SELECT query_id, n + 2, k FROM b JOIN c USING (query_id) WHERE rank = 1),
bn AS (SELECT *, row_number() OVER (PARTITION BY query_id, k ORDER BY rank) AS nth FROM b), an AS (SELECT *, row_number() OVER (PARTITION BY query_id, k ORDER BY rank) AS nth FROM a)"""


def _reranked(spark, d):
    """The ten best of an item, and a list that reverses them, has a text of nobody, and the first text once more."""
    before = _bm25(spark, d).where("rank <= 10").join(_docs(spark, d), "doc_id").select("query_id", "rank", "doc_id", "text")
    sizes = before.groupBy("query_id").agg(F.count("*").alias("n"))
    of = before.join(sizes, "query_id")
    after = of.select("query_id", (F.col("n") - F.col("rank") + 1).alias("rank"), "text")
    after = after.unionByName(sizes.select("query_id", (F.col("n") + 1).alias("rank"), F.lit("a text of nobody").alias("text")))
    return before, after.unionByName(of.where("rank = 1").select("query_id", (F.col("n") + 2).alias("rank"), "text"))


@_q(_RERANKED_SQL + " SELECT an.query_id, an.rank, coalesce(bn.doc_id, -1) AS doc_id, bn.rank AS was FROM an LEFT JOIN bn ON bn.query_id = an.query_id AND bn.k = an.k AND bn.nth = an.nth")
def reranked_places(spark, d):
    return reranked.match(*_reranked(spark, d))


@_q(_RERANKED_SQL + """, p AS (SELECT coalesce(x.query_id, y.query_id) AS query_id, x.k IS DISTINCT FROM y.k AS other FROM (FROM b WHERE rank <= 5) x FULL JOIN (FROM a WHERE rank <= 5) y ON x.query_id = y.query_id AND x.rank = y.rank),
g AS (SELECT query_id, count(*) AS n FROM (SELECT query_id, k, count(*) AS m FROM b WHERE rank <= 5 GROUP BY 1, 2) x, (SELECT 1) LEFT JOIN (SELECT query_id AS q, k AS kk, count(*) AS mm FROM a WHERE rank <= 5 GROUP BY 1, 2) y ON q = query_id AND kk = k, range(1000) r(i) WHERE i < greatest(0, m - coalesce(mm, 0)) GROUP BY 1)
SELECT p.query_id, count(*) FILTER (other) AS n_changed, coalesce(max(g.n), 0) AS n_left FROM p LEFT JOIN g USING (query_id) GROUP BY 1""")
def reranked_changes(spark, d):
    return reranked.changed(*_reranked(spark, d))


_ALL = [
    chunk_index, chunk_sweep, normalize_digits, tokenize_a, tokenize_b, query_hash, doc_key_dedup, prefix_key, bm25_stats, bm25_topk, bm25_impact_topk, bm25_sweep_topk, dense_topk, l2_normalize,
    multiquery_dedup, hybrid_subqueries, wrrf_fusion, wrrf_sweep, distinct_docs_first_seen, qrels, qrels_chunk, qrels_stats, queries_without_relevant, corpus_semi, rank_metrics, ndcg_at_10,
    rank_metrics_at_k, rerank_improvement, weight_grid, weight_best, weight_per_query, metric_mean_std, confidence_interval, paired_t, split_counts, retrieval_pattern,
    generation_basic, context_usage, query_addressing, hedging, query_diversity, position_changes, query_overlap, length_bias, numbered_docs, text_preview, ablation_table,
    chunk_size_sweep, chunk_size_sweep_fused, chunk_size_best, representative_queries, rag_answers, rag_quality, end_to_end_score, reflection_records, evaluation_inputs, rank_to_score, module_scores,
    prefix_lookup, label_lists, query_structure, prompt_hash, report_table, retrieval_bundle, reranker_bundle, planner_bundle, generation_against_truth, batch_summary, context_scores,
    generator_feedback, configurations_by_queries, prompt_frontier, prompt_parents, reranked_places, reranked_changes,
]


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: f.sql for f in _ALL if hasattr(f, "sql")}
