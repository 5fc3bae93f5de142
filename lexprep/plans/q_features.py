"""Queries of the feature stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexprep import constants as C
from lexprep.operators import cleaning as K
from lexprep.operators import split as S
from lexprep.operators import vectors as V
from lexprep.options import PLAIN
from lexprep.plans import oracle as O
from lexprep.plans.catalog import register
from lexprep.plans.q_text import clean_sql, labelled_clean
from lexprep.sources import fixtures as X
from lexprep.sources.readers import table

R6 = 6
PT_STOP = C.spark_stopwords("portuguese")

_LABELLED_TEXT = O.with_(O.RESPONSES, O.LATEST, O.GRADED, O.DECISIONS, O.LABELLED) + \
    f",\nld AS (SELECT resp_id AS id, {clean_sql('html')} AS text, label FROM labelled WHERE html IS NOT NULL)"


def tfidf_ctes(max_df: float = 0.75) -> str:
    pat = O.q(C.TOKEN_PATTERNS["word2"][2])
    return f""",
tk AS (SELECT id, unnest(list_filter(regexp_extract_all(lower(text), {pat}),
                                     lambda w: NOT list_contains({O.sql_list(PT_STOP)}, w))) AS term FROM ld),
tf AS (SELECT id, term, count(*) AS tf FROM tk GROUP BY id, term),
nd AS (SELECT count(*) AS n FROM ld),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
voc AS (SELECT term, df FROM dfq WHERE df >= 1 AND df <= {max_df} * (SELECT n FROM nd)),
w AS (SELECT tf.id, tf.term, tf.tf, voc.df, tf.tf * (ln((1 + (SELECT n FROM nd)) / (1 + voc.df)) + 1) AS w
      FROM tf JOIN voc USING (term)),
tw AS (SELECT id, term, tf, df, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS tfidf FROM w)"""


@register("tfidf", _LABELLED_TEXT + tfidf_ctes() + """
SELECT id, term, CAST(tf AS BIGINT) AS tf, CAST(df AS BIGINT) AS df, round(tfidf, 6) AS tfidf FROM tw""")
def tfidf(spark, sf):
    """A6 over the cleaned labelled documents (the classifier's input)."""
    t = V.tfidf(labelled_clean(spark, sf), "id", "text", max_df=0.75)
    return t.select("id", "term", "tf", "df", F.round("tfidf", R6).alias("tfidf"))


_HAND = ", ".join(
    f"CAST(len(regexp_extract_all(text, {O.q('(?i)' + C.WORD + '*' + core + C.WORD + '*')})) AS DOUBLE) AS {name}"
    for core, name in ((C.LAW_CORE, "fl"), (C.TERM_CORE, "ft"), (C.PHRASE_CORE, "fp")))


@register("feature_table", _LABELLED_TEXT + tfidf_ctes() + f""",
vi AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS feature_index FROM (SELECT DISTINCT term FROM tw)),
vsize AS (SELECT count(*) AS v FROM vi),
hf AS (SELECT id, {_HAND}, CAST(length(text) AS DOUBLE) AS ln FROM ld),
hrows AS (SELECT id, k, x FROM hf, LATERAL (VALUES (0, fl), (1, ft), (2, fp), (3, ln),
            (4, coalesce(fl / nullif(ln, 0), 0)), (5, coalesce(ft / nullif(ln, 0), 0)),
            (6, coalesce(fp / nullif(ln, 0), 0))) t(k, x))
SELECT id, CAST(feature_index AS BIGINT) AS feature_index, round(tfidf, 6) AS value FROM tw JOIN vi USING (term)
UNION ALL
SELECT id, CAST((SELECT v FROM vsize) + k AS BIGINT), round(x, 6) FROM hrows""")
def feature_table(spark, sf):
    """M3 (TF-IDF + hand features, 'multi') as sparse rows."""
    docs = labelled_clean(spark, sf)
    w = V.tfidf(docs, "id", "text", max_df=0.75)
    hand = K.hand_features(docs, "text", ["id"])
    ft = V.feature_table(w, hand, "id")
    return ft.select("id", F.col("feature_index").cast("long").alias("feature_index"),
                     F.round("value", R6).alias("value"))


def _clean_docs(spark, sf):
    """Cleaned decisions."""
    d = X.decisions(spark, sf).where(F.col("html").isNotNull())
    return K.with_clean_text(d, "html", "text", PLAIN).select("doc_id", "text")


_CLEAN_DOCS = O.with_(O.DECISIONS) + \
    f",\ncd AS (SELECT doc_id, {clean_sql('html')} AS text FROM decisions WHERE html IS NOT NULL)"

_WORD_VECTORS = """,
wd AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS word FROM cd)
       WHERE word <> '' GROUP BY word),
wr AS (SELECT word, row_number() OVER (ORDER BY df DESC, word) - 1 AS vec_id FROM wd),
wv AS (SELECT wr.word, e.embedding FROM wr JOIN embeddings e ON e.vec_id = wr.vec_id)"""


@register("word_vectors", _CLEAN_DOCS + _WORD_VECTORS + """
SELECT wv.word, CAST(g.dim AS BIGINT) AS dim, round(CAST(wv.embedding[g.dim + 1] AS DOUBLE), 6) + 0.0 AS value
FROM wv, (SELECT unnest(range(64)) AS dim) g WHERE g.dim < len(wv.embedding)""")
def word_vectors(spark, sf):
    """Word-vector table: cleaned-document words ranked by document
    frequency take the embedding rows in order (long form)."""
    wv = V.ranked_word_vectors(_clean_docs(spark, sf), table(spark, sf, "embeddings"))
    return wv.select("word", F.posexplode("vector").alias("dim", "value")).select(
        "word", F.col("dim").cast("long").alias("dim"), F.round(F.col("value").cast("double"), R6).alias("value"))


@register("mean_pooled_embedding", _CLEAN_DOCS + _WORD_VECTORS + """,
words AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM cd),
ntok AS (SELECT doc_id, len(string_split(text, ' ')) AS n FROM cd),
dims AS (SELECT unnest(range(CAST((SELECT max(len(embedding)) FROM wv) AS BIGINT))) AS dim),
sums AS (SELECT w.doc_id, d.dim, sum(CAST(wv.embedding[d.dim + 1] AS DOUBLE)) AS s
         FROM words w JOIN wv ON w.word = wv.word, dims d GROUP BY w.doc_id, d.dim)
SELECT n.doc_id, CAST(d.dim AS BIGINT) AS dim, round(coalesce(s.s, 0) / n.n, 6) + 0.0 AS value
FROM ntok n, dims d LEFT JOIN sums s ON s.doc_id = n.doc_id AND s.dim = d.dim""")
def mean_pooled_embedding(spark, sf):
    """A7 + J3: mean of word vectors per cleaned decision (long form)."""
    docs = _clean_docs(spark, sf)
    wv = V.ranked_word_vectors(docs, table(spark, sf, "embeddings"))
    pooled = V.pooled_embeddings(docs, wv, "doc_id", "text")
    return pooled.select("doc_id", F.posexplode("embedding").alias("dim", "value")).select(
        "doc_id", F.col("dim").cast("long").alias("dim"), F.round("value", R6).alias("value"))


def _seq_tokens_sql(x: str) -> str:
    return (f"list_filter(string_split(translate(lower({x}), {O.q(C.SEQ_FILTERS)}, {O.q(' ' * len(C.SEQ_FILTERS))}),"
            f" ' '), lambda w: w <> '')")


_SEQ_CTES = _CLEAN_DOCS + f""",
sp AS (SELECT doc_id, text, CASE WHEN substr(md5('42|' || CAST(doc_id AS VARCHAR)), 1, 8) < '{S.hash_threshold(0.25)}'
                            THEN 'test' ELSE 'train' END AS split FROM cd),
st AS (SELECT doc_id, split, {_seq_tokens_sql('text')} AS t FROM sp),
ex AS (SELECT doc_id, split, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM st),
ti AS (SELECT token, row_number() OVER (ORDER BY n DESC, fd, fp) AS idx, n FROM
        (SELECT token, count(*) AS n, min(doc_id) AS fd, min_by(pos, doc_id * 100000000 + pos) AS fp
         FROM ex WHERE split = 'train' GROUP BY token))"""


def _train(spark, sf):
    return S.random_split(_clean_docs(spark, sf), "doc_id", 0.25, 42)


@register("token_index", _SEQ_CTES + "\nSELECT token, CAST(idx AS BIGINT) AS idx, CAST(n AS BIGINT) AS n FROM ti")
def token_index(spark, sf):
    """A15 + W1 on the 75% training part of the cleaned decisions."""
    sp = _train(spark, sf)
    return V.token_index(sp.where(F.col("split") == "train"), "doc_id", "text")


@register("padded_sequences", _SEQ_CTES + f""",
ids AS (SELECT doc_id, list(idx ORDER BY pos) AS s FROM ex JOIN ti USING (token) GROUP BY doc_id),
al AS (SELECT sp.doc_id, sp.split, coalesce(ids.s, []) AS s FROM sp LEFT JOIN ids USING (doc_id))
SELECT doc_id, split, CAST(len(s) AS BIGINT) AS n_ids,
       array_to_string(list_resize(s[greatest(len(s) - {C.SEQ_MAXLEN} + 1, 1):], {C.SEQ_MAXLEN}, 0), ' ') AS seq
FROM al""")
def padded_sequences(spark, sf):
    """K3 + K2 for both parts, with the index fitted on the training part."""
    sp = _train(spark, sf)
    # the index is counted in the texts that also get the sequences: they are cleaned and dealt by id once
    texts = S.random_split(V.seq_texts(sp, "doc_id", "text"), "doc_id", 0.25, 42)
    train = F.col("split") == "train"
    idx = V.token_index_of_texts(texts, train, sp.where(train).select("doc_id"), "doc_id")
    rows = sp.select("doc_id", "split").join(sp.select("doc_id"), "doc_id")
    seqs = V.padded_sequences(sp, idx, "doc_id", "text", rows=rows)
    return seqs.select("doc_id", "split", "n_ids", F.array_join(F.col("seq").cast("array<string>"), " ").alias("seq"))
