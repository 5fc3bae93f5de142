"""Text features.

Scale notes
- TF-IDF: the texts of an id meet in one row, whose words are sorted and
  counted there: no table of (document, term) pairs is held for the counting,
  so a task's memory is that of the texts it sorts by id. Document
  frequencies are an aggregate by term; the (doc, term) rows join the
  per-term table on ``term`` and the per-document norms on the id, in both
  joins without being sorted. A hot term (in every document) is a skewed
  join key: AQE's skew-join splits that partition of the (doc, term) side,
  and the per-term side holds one row for it. N is a scalar subquery;
  nothing is collected.
- Pooled embeddings: the (document, word, count) rows are dealt into groups
  of documents and every group gets the word vectors: a vector travels once
  for each group, not for each document, and a document is summed where its
  counts are, a few numbers of the vector in each row of the aggregate.
- Padded sequences: the words of a block of documents are codes into the
  block's distinct words, and only these meet the index; ids are put back by
  code in the block, and padded once they are with the rows that get them.
- The token index ranks the aggregated token table with the distributed
  global rank (no single-partition window).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexprep import constants as C
from lexprep.functions import text as T
from lexprep.operators.ranking import global_row_number, range_buckets
from lexprep.session import ship_package

TFIDF_PATTERN = C.TOKEN_PATTERNS["word2"][1]
#: Groups of documents that get the word vectors, and numbers of a vector summed in one row.
POOL_GROUPS, POOL_WIDTH = 96, 16
#: Bytes of texts whose words share a dictionary; a longer text has its own.
SEQ_BLOCK_BYTES = 4 << 20


def word_counts(words: Column) -> Column:
    """array<struct<term, tf>> of the words of an array column, which is sorted: runs of one word. Null for null."""
    n = F.size(words)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(n))
    runs = F.zip_with(starts, ends, lambda i, j: F.struct(F.get(words, i).alias("term"), (j - i).cast("long").alias("tf")))
    return F.when(n > 0, runs).when(words.isNotNull(), F.array().cast("array<struct<term:string,tf:bigint>>"))


def tfidf(docs: DataFrame, id_col: str = "id", text_col: str = "text", max_df: float = 0.75, min_df: int = 1,
          stopwords: list[str] | None = None) -> DataFrame:
    """(id, term, tf, df, tfidf): raw counts, smooth idf
    ln((1+N)/(1+df)) + 1, terms with df > max_df * N dropped, each
    document's vector L2-normalised. Tokens: lowercase runs of two or more
    word characters minus stopwords."""
    stop = stopwords if stopwords is not None else C.spark_stopwords("portuguese")
    # a token holds no space: the tokens of the joined texts of an id are those of its texts
    texts = docs.where(F.col(text_col).isNotNull()).groupBy(id_col).agg(F.array_join(F.collect_list(text_col), " ").alias("_text"))
    toks = F.filter(F.regexp_extract_all(F.lower("_text"), F.lit(TFIDF_PATTERN), 0), lambda w: ~w.isin(stop))
    # every document also counts the empty term once (no token is empty), so its document frequency is their number
    one = F.array(F.struct(F.lit("").alias("term"), F.lit(1).cast("long").alias("tf")))
    words = texts.select(id_col, F.sort_array(toks).alias("_words"))
    tf = words.select(id_col, F.explode(F.concat(one, word_counts(F.col("_words")))).alias("_c")).select(id_col, "_c.term", "_c.tf")
    dfreq = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n_docs = dfreq.select(F.max(F.when(F.col("term") == "", F.col("df")))).scalar()
    vocab = dfreq.where((F.col("term") != "") & (F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n_docs))
    # the smaller tables, a row for each term and for each document, are held by hash and the (id, term) rows stream
    # past them: no task sorts those
    w = tf.where(F.col("term") != "").join(vocab.hint("shuffle_hash"), "term").withColumn(
        "w", F.col("tf") * (F.log((1 + n_docs) / (1 + F.col("df"))) + 1))
    norms = w.groupBy(F.col(id_col).alias("_id")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    return w.join(norms.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("_id"))).select(
        id_col, "term", F.col("tf").cast("long").alias("tf"), F.col("df").cast("long").alias("df"),
        (F.col("w") / F.col("_norm")).alias("tfidf"))


def vocabulary_index(weights: DataFrame) -> DataFrame:
    """Column index of each term: rank in code-point order, from 0."""
    terms = weights.select("term").distinct()
    ranked = global_row_number(terms, [F.col("term").asc()], [F.substring("term", 1, 3)], "feature_index")
    return ranked.withColumn("feature_index", F.col("feature_index") - 1)


def feature_table(weights: DataFrame, hand: DataFrame, id_col: str = "id") -> DataFrame:
    """M3 + T26 + J4: long sparse feature rows (id, feature_index, value):
    TF-IDF columns first (vocabulary order), then the 7 hand features at
    V..V+6, joined on the document key (not on position)."""
    idx = vocabulary_index(weights)
    v = idx.select(F.count(F.lit(1))).scalar()
    tfidf_rows = weights.join(idx.hint("shuffle_hash"), "term").select(id_col, "feature_index", F.col("tfidf").alias("value"))
    names = ["freq_law", "freq_term", "freq_phrase", "len_doc", "ratio_law", "ratio_term", "ratio_phrase"]
    stacked = F.array(*[F.struct(F.lit(i).alias("k"), F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias("x"))
                        for i, n in enumerate(names)])
    hand_rows = hand.select(id_col, F.explode(stacked).alias("h")).select(
        id_col, (v + F.col("h.k")).alias("feature_index"), F.col("h.x").alias("value"))
    return tfidf_rows.unionByName(hand_rows)


# -- word vectors -------------------------------------------------------------

def pooled_embeddings(docs: DataFrame, word_vectors: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      word_col: str = "word", vec_col: str = "vector") -> DataFrame:
    """A7 + J3 + T28: (doc_id, embedding array<double>) = mean of the word
    vectors of ``text.split(' ')``; unknown words count as zero vectors."""
    dim = word_vectors.select(F.max(F.size(vec_col))).scalar()
    words = docs.select(id_col, F.explode(T.single_space_split(text_col)).alias(word_col))
    tf = words.groupBy(id_col, word_col).agg(F.count(F.lit(1)).alias("_tf"))
    group = F.pmod(F.hash(id_col), F.lit(POOL_GROUPS))
    last = F.floor((F.size(vec_col) - 1) / POOL_WIDTH).cast("int")
    pieces = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(
        k.alias("k"), F.slice(vec_col, k * POOL_WIDTH + 1, POOL_WIDTH).alias("x")))).cast("array<struct<k:int,x:array<double>>>")
    lookup = word_vectors.select(F.explode(F.sequence(F.lit(0), F.lit(POOL_GROUPS - 1))).alias("_g"), word_col, pieces.alias("_v"))
    # the vectors of a group's words stand before its documents' counts, so that each count finds them in its own task
    met = (tf.select(group.alias("_g"), word_col, id_col, "_tf").unionByName(lookup, allowMissingColumns=True)
           .repartition(POOL_GROUPS, "_g"))
    before = Window.partitionBy("_g", word_col).orderBy(F.col("_tf").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    own = met.withColumn("_v", F.flatten(F.collect_list("_v").over(before))).where(F.col("_tf").isNotNull())
    # piece -1 is the number of words, known or not
    one = F.array(F.struct(F.lit(-1).alias("k"), F.array(F.lit(1.0)).alias("x")))
    each = own.select("_g", id_col, "_tf", F.explode(F.concat(one, "_v")).alias("_p"))
    sums = each.groupBy("_g", id_col, F.col("_p.k").alias("_k")).agg(
        F.array(*[F.sum(F.col("_tf") * F.get(F.col("_p.x"), F.lit(i))) for i in range(POOL_WIDTH)]).alias("_s"))
    total = sums.groupBy("_g", id_col).agg(F.array_sort(F.collect_list(F.struct("_k", "_s"))).alias("_t"))
    dim = dim.cast("int")
    padded = F.concat(F.flatten(F.col("_t._s")), F.array_repeat(F.lit(0.0), dim))
    means = total.select(id_col, F.get(F.col("_t")[0]["_s"], F.lit(0)).alias("_n"), F.slice(padded, POOL_WIDTH + 1, dim).alias("_t"))
    return means.select(id_col, F.transform("_t", lambda x: F.coalesce(x, F.lit(0.0)) / F.col("_n")).alias("embedding"))


def ranked_word_vectors(docs: DataFrame, embeddings: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, vector): distinct words ranked by (document frequency desc,
    word); rank r takes embedding vec_id r-1. Words past the last vector
    are unknown."""
    words = docs.select(F.explode(F.array_distinct(F.filter(T.single_space_split(text_col),
                                                             lambda w: w != ""))).alias("word"))
    dfreq = words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    ranked = global_row_number(dfreq, [F.desc("df"), F.asc("word")], [-F.col("df"), F.substring("word", 1, 2)], "rk")
    return ranked.join(embeddings.select(F.col("vec_id"), F.col("embedding").alias("vector")),
                       (F.col("rk") - 1) == F.col("vec_id")).select("word", "vector")


# -- sequences ----------------------------------------------------------------

def seq_spaced(text) -> Column:
    """Lowercase, filter characters -> space."""
    return F.translate(F.lower(F.col(text) if isinstance(text, str) else text), C.SEQ_FILTERS, " " * len(C.SEQ_FILTERS))


def seq_tokens(text) -> Column:
    """Sequence-tokeniser words: lowercase, filter characters -> space,
    split on a space, no empty words."""
    return F.filter(F.split(seq_spaced(text), " ", -1), lambda w: w != "")


def seq_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, texts): the texts of each id, ready for being split on a space."""
    return docs.groupBy(id_col).agg(F.sort_array(F.collect_list(seq_spaced(text_col))).alias("texts"))


def token_index(train: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A15 + W1: (token, idx, n): rank by count desc, ties by first
    appearance (documents in id order, then position); from 1."""
    ex = train.select(id_col, F.posexplode(seq_tokens(text_col)).alias("pos", "token"))
    return _ranked_tokens(ex, train, id_col, F.lit(True))


def token_index_of_texts(texts: DataFrame, counts: Column, train: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``token_index`` of the rows of ``seq_texts`` for which ``counts`` holds, whose ids are those of ``train``. The
    others are left out where tokens are counted, so that all users of ``texts`` read the same rows."""
    each = texts.select(id_col, counts.alias("_counts"), F.explode("texts").alias("_text"))
    words = F.filter(F.split("_text", " ", -1), lambda w: w != "")
    ex = each.select(id_col, "_counts", F.posexplode(words).alias("pos", "token"))
    return _ranked_tokens(ex, train, id_col, F.col("_counts"))


def _ranked_tokens(ex: DataFrame, train: DataFrame, id_col: str, counts: Column) -> DataFrame:
    # first appearance as one number of fixed width, so that tokens are counted by hash, without a sort
    at = (F.col(id_col).cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("pos")).cast("decimal(32,0)")
    agg = ex.groupBy("token").agg(F.count(F.when(counts, 1)).alias("n"), F.min(F.when(counts, at)).alias("first")).where("n > 0")
    agg = agg.withColumn("_doc", F.floor(F.col("first") / F.lit(1 << 32)).cast("long"))
    first_doc = range_buckets(train.select(F.col(id_col).cast("long").alias("_doc")), "_doc")
    ranked = global_row_number(agg, [F.desc("n"), F.asc("first")], [-F.col("n"), *first_doc], "idx")
    return ranked.select("token", "idx", F.col("n").cast("long").alias("n"))


def _encoded(batches):
    """Blocks of documents (id, texts whose words stand between spaces): for each block a row for its words' codes, whose
    token holds a space and so is no word, and a row for each distinct word, ``pos`` being its code."""
    from pyspark import TaskContext

    task, k = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        n_texts = np.asarray(batch.column(1).value_lengths()).astype(np.int64)
        per_text = np.append(0, np.cumsum(np.asarray(pc.binary_length(batch.column(1).flatten())).astype(np.int64)))
        size, i = per_text[np.append(0, np.cumsum(n_texts))], 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(size, size[i] + SEQ_BLOCK_BYTES, "right")) - 1)
            part, texts, i = batch.slice(i, j - i), n_texts[i:j], j
            split = pc.split_pattern(part.column(1).flatten(), " ")
            words, of = split.flatten(), np.repeat(np.arange(len(split)), np.asarray(split.value_lengths()))
            full = pc.greater(pc.binary_length(words), 0)
            coded, of = words.filter(full).dictionary_encode(), of[np.asarray(full)]
            distinct, n = coded.dictionary, len(coded.dictionary) + 1
            raw = lambda v, t: pa.array([np.asarray(v).astype(t).tobytes(), *[None] * (n - 1)], pa.binary())
            ids = pa.ListArray.from_arrays(pa.array([0, *[len(texts)] * n], pa.int32()), part.column(0),
                                           mask=pa.array([False, *[True] * (n - 1)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, task | k)), pa.concat_arrays([pa.array([f" {task | k}"]), distinct.cast(pa.string())]),
                 pa.array([None, *range(n - 1)], pa.int32()), ids, raw(texts, np.int64),
                 raw(np.searchsorted(of, np.arange(len(split) + 1)), np.int64), raw(coded.indices, np.int32)],
                names=["block", "token", "pos", "ids", "texts", "bounds", "codes"])
            k += 1


def _sequences(batches):
    """(id, ids of its words) of the documents of blocks (pos, idx, ids, texts, bounds, codes): known words in order of
    their position, those of several texts of one id by position and then by idx."""
    for batch in batches:
        for r in range(batch.num_rows):
            pos, idx, ids = (batch.column(k)[r].values for k in range(3))
            texts, bounds, codes = (np.frombuffer(batch.column(k)[r].as_buffer(), t) for k, t in
                                    ((3, np.int64), (4, np.int64), (5, np.int32)))
            of = np.full(int(codes.max(initial=-1)) + 1, -1, np.int64)
            of[np.asarray(pos)] = np.asarray(idx)
            known = of[codes] >= 0
            found = of[codes][known]
            text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            doc = np.repeat(np.arange(len(texts)), texts)[text[known]]
            if texts.max(initial=0) > 1:
                place = (np.arange(len(codes)) - bounds[text])[known]
                found = found[np.lexsort((found, place, doc))]
            ends = np.append(0, np.cumsum(np.bincount(doc, minlength=len(texts))))
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found))], names=["id", "s"])


def padded_sequences(docs: DataFrame, index: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     maxlen: int = C.SEQ_MAXLEN, rows: DataFrame | None = None) -> DataFrame:
    """K3 + K2: token ids in order, unknown tokens dropped; a longer
    sequence keeps its last ``maxlen`` ids, a shorter one is padded with 0
    after. (id, n_ids, seq array<long>), and the other columns of ``rows``, if
    these (the ids of ``docs`` otherwise) are to get the sequences."""
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = seq_texts(docs, id_col, text_col).sortWithinPartitions(id_col)  # a task that runs again makes the same blocks
    blocks = texts.mapInArrow(_encoded, f"block bigint, token string, pos int, ids array<{kind}>, texts binary, bounds binary, codes binary")
    # the distinct words of a block meet the index; the block's codes go along under a token that is no word
    met = blocks.join(index.select("token", F.col("idx").cast("long").alias("idx")).hint("shuffle_hash"), "token", "left")
    body = ["ids", "texts", "bounds", "codes"]
    back = (met.where(F.col("idx").isNotNull() | F.col("pos").isNull()).groupBy("block")
            .agg(F.collect_list("pos").alias("pos"), F.collect_list("idx").alias("idx"), *[F.first(c, True).alias(c) for c in body]))
    ids = back.select("pos", "idx", *body).mapInArrow(_sequences, f"id {kind}, s array<bigint>")
    ids = ids.select(F.col("id").alias("_id"), F.col("s").alias("_s"))
    rows = docs.select(id_col) if rows is None else rows
    base = rows.join(ids, F.col(id_col) == F.col("_id"), "left").drop("_id").withColumn("_s", F.coalesce("_s", F.array().cast("array<long>")))
    n = F.size("_s")
    kept = F.slice("_s", F.greatest(n - maxlen + 1, F.lit(1)), F.lit(maxlen))
    padded = F.concat(kept, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(maxlen) - F.size(kept), F.lit(0))))
    return base.select(*rows.columns, n.cast("long").alias("n_ids"), padded.alias("seq"))
