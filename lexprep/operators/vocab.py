"""Vocabulary, pruning and topic preparation.

Scale notes
- Document frequency is ``explode(array_distinct(terms))`` then
  ``groupBy(corpus, term).count()``: map-side partial aggregation
  collapses a hot term to one row per map task before the shuffle.
- Pruning moves no single token: the heavy words (a bounded list) are taken to
  the documents. Where words may be too rare, those go to the documents that
  hold them, fewer than min_df each, and texts are shuffled once to meet them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexprep import constants as C
from lexprep.functions import text as T
from lexprep.operators import cleaning as K
from lexprep.options import TopicOptions

#: Hash buckets of a corpus' heavy words: some thousand words at most, so a few in each.
HEAVY_BUCKETS = 256
#: Rare words of a document that are looked up in one array; more are put into as many buckets as heavy words.
RARE_LIST = 64


def pattern_tokens(text, preset: str) -> Column:
    """Tokens found by a token pattern preset (lowercased text)."""
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    if preset == "letters_only":
        # a whole word run made only of ASCII letters, two or more
        runs = F.regexp_extract_all(t, F.lit(C.WORD + "+"), 0)
        return F.filter(runs, lambda w: w.rlike("^[a-zA-Z]{2,}$"))
    return F.regexp_extract_all(t, F.lit(C.TOKEN_PATTERNS[preset][1]), 0)


def is_term(word: Column, preset: str) -> Column:
    """Whether the preset's pattern finds the whole of a lower-cased word that stands between white space."""
    if preset == "letters_only":
        return word.rlike("^[a-zA-Z]{2,}$")
    return word.rlike(f"^(?:{C.TOKEN_PATTERNS[preset][1]})$")


def bigrams(tokens: Column) -> Column:
    """Adjacent token pairs joined by a space. Pattern tokens never contain
    a space, so on the space-joined tokens every pair starts after a space
    (or at the start): one regex pass with a look-ahead capture, about twice
    as fast as pairing the array with an interpreted lambda."""
    return F.regexp_extract_all(F.array_join(tokens, " "), F.lit("(?<![^ ])(?=([^ ]+ [^ ]+))"), 1)


def corpus_sizes(docs: DataFrame) -> DataFrame:
    return docs.groupBy("corpus").agg(F.count(F.lit(1)).alias("n_docs"))


def document_frequency(docs: DataFrame, text_col: str, preset: str, with_bigrams: bool = True) -> DataFrame:
    """(corpus, term, df) of unigrams and bigrams, before pruning; or of unigrams alone."""
    toks = pattern_tokens(text_col, preset)
    every = F.concat(toks, bigrams(toks)) if with_bigrams else toks
    terms = docs.select("corpus", F.explode(F.array_distinct(every)).alias("term"))
    return terms.groupBy("corpus", "term").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(docs: DataFrame, text_col: str = "text", opts: TopicOptions = TopicOptions(),
               with_bigrams: bool = True) -> DataFrame:
    """A4/A5: (corpus, term, df) with min_df <= df <= max_df * N per corpus."""
    dfreq = document_frequency(docs, text_col, opts.token_pattern, with_bigrams)
    sizes = corpus_sizes(docs)  # one row per corpus
    return (dfreq.join(sizes, "corpus")
            .where((F.col("df") >= opts.min_df) & (F.col("df") <= F.lit(opts.max_df) * F.col("n_docs")))
            .select("corpus", "term", F.col("df").cast("long").alias("df")))


def heavy_terms(docs: DataFrame, text_col: str, opts: TopicOptions, dfreq: DataFrame | None = None) -> DataFrame:
    """(corpus, heavy): the words that more than max_df of a corpus' documents hold, as one array. There are fewer of
    them than the mean number of distinct words of a document divided by max_df, however large the corpus. ``dfreq`` are
    the words' document frequencies, if they are there."""
    if dfreq is None:
        dfreq = document_frequency(docs, text_col, opts.token_pattern, with_bigrams=False)
    return (dfreq.join(corpus_sizes(docs), "corpus").where(F.col("df") > F.lit(opts.max_df) * F.col("n_docs"))
            .groupBy("corpus").agg(F.collect_list("term").alias("heavy")))


def bucket(word: Column) -> Column:
    return F.pmod(F.hash(word), F.lit(HEAVY_BUCKETS))


def heavy_buckets(heavy: DataFrame) -> DataFrame:
    """(corpus, buckets): the heavy words as ``HEAVY_BUCKETS`` short arrays, each word in that of its hash. A token is
    looked up in one of them: the time for it does not depend on how many words are heavy."""
    kept = heavy.select("corpus", F.explode("heavy").alias("word")).withColumn("at", bucket(F.col("word")))
    parts = kept.groupBy("corpus", "at").agg(F.collect_list("word").alias("words"))
    held = parts.groupBy("corpus").agg(F.map_from_entries(F.collect_list(F.struct("at", "words"))).alias("held"))
    none = F.array().cast("array<string>")
    return held.select("corpus", F.transform(F.sequence(F.lit(0), F.lit(HEAVY_BUCKETS - 1)),
                                             lambda i: F.coalesce(F.col("held")[i], none)).alias("buckets"))


def vocabulary_filter(docs: DataFrame, text_col: str = "text", opts: TopicOptions = TopicOptions()) -> DataFrame:
    """Keep whitespace tokens whose lower case is a vocabulary term,
    order, case and repeats kept. Bigram terms cannot equal a token.

    With min_df of 1 a token is a term if the pattern matches the whole of it
    (its own document then holds it) and it is not heavy: tokens stay in their
    row, only the heavy words travel. With a larger min_df the words of too few
    documents are taken out too: each meets the few documents that hold it.
    Rows of one (corpus, doc_id) are one document, with all their tokens in
    order of their position; a row without corpus or id keeps no token."""
    low = F.lower

    def is_heavy(word: Column) -> Column:
        return F.coalesce(F.array_contains(F.get(F.col("_heavy"), bucket(word)), word), F.lit(False))

    if opts.min_df <= 1:
        heavy = heavy_buckets(heavy_terms(docs, text_col, opts)).withColumnRenamed("buckets", "_heavy")
        with_heavy = docs.join(heavy, "corpus", "left")
        kept = F.filter(F.split(F.col(text_col), C.WS_RUN, -1), lambda t: (t != F.lit(""))
                        & is_term(low(t), opts.token_pattern) & ~is_heavy(low(t)))
        return with_heavy.withColumn(text_col, F.coalesce(F.array_join(kept, " "), F.lit(""))).select(*docs.columns)
    # a token never equals a bigram, so only single words are counted here
    words = docs.select("corpus", "doc_id", F.explode(F.array_distinct(pattern_tokens(text_col, opts.token_pattern))).alias("term"))
    dfreq = words.groupBy("corpus", "term").agg(F.count(F.lit(1)).alias("df"), F.min("doc_id").alias("_first"))
    # the condition always holds: with it both users read the same columns, so that words are counted in one shuffle
    heavy = heavy_buckets(heavy_terms(docs, text_col, opts, dfreq.where(F.hash("_first") >= F.lit(-1 << 31))))
    rare = dfreq.where(F.col("df") < opts.min_df)
    if opts.min_df == 2:  # the one document that holds a word
        rare = rare.select("corpus", F.col("_first").alias("doc_id"), F.col("term").alias("_rare"))
    else:
        rare = words.join(rare.select("corpus", "term").hint("shuffle_hash"), ["corpus", "term"], "left_semi").select(
            "corpus", "doc_id", F.col("term").alias("_rare"))
    no_key = F.col("corpus").isNull() | F.col("doc_id").isNull()
    # rows without a key keep nothing, and need not meet in one task
    met = docs.withColumn("_apart", F.when(no_key, F.xxhash64(text_col))).withColumn("_doc", F.lit(True)).unionByName(
        rare.where(~no_key), allowMissingColumns=True)
    own = Window.partitionBy("corpus", "doc_id", "_apart")
    # collect_list leaves out the nulls of the other kind of row
    whole = met.select(*docs.columns, "_doc", F.collect_list("_rare").over(own).alias("_out"), F.collect_list(text_col).over(own).alias("_texts"))
    whole = whole.where(F.col("_doc")).join(heavy.withColumnRenamed("buckets", "_heavy"), "corpus", "left")
    out = F.when(F.size("_out") <= RARE_LIST, F.array("_out")).otherwise(F.transform(
        F.sequence(F.lit(0), F.lit(HEAVY_BUCKETS - 1)), lambda i: F.filter("_out", lambda w: bucket(w) == i)))
    placed = F.flatten(F.transform("_texts", lambda t: F.transform(T.whitespace_tokens(t), lambda tok, pos: F.struct(pos.alias("pos"), tok.alias("tok")))))
    toks = F.when(F.size("_texts") <= 1, T.whitespace_tokens(F.get("_texts", F.lit(0)))).otherwise(F.array_sort(placed)["tok"])
    whole = whole.withColumn("_out", out)

    def is_rare(word: Column) -> Column:
        return F.array_contains(F.get("_out", F.pmod(F.hash(word), F.size("_out"))), word)

    kept = F.filter(toks, lambda t: is_term(low(t), opts.token_pattern) & ~is_heavy(low(t)) & ~is_rare(low(t)))
    pruned = F.when(no_key, "").otherwise(F.coalesce(F.array_join(kept, " "), F.lit("")))
    # generated: a filter on the pruned text is not evaluated in the place of the text, a second time
    return whole.select(*[c for c in docs.columns if c != text_col], F.explode(F.array(pruned)).alias(text_col)).select(*docs.columns)


def topic_prep(corpora: DataFrame, opts: TopicOptions = TopicOptions(), html_col: str = "html"):
    """Clean (T13) -> vocabulary per corpus (A4) -> keep vocabulary
    tokens (T15) -> drop documents left empty (P10).

    Returns (kept (corpus, doc_id, text), removed (corpus, n_removed))."""
    cleaned = K.with_clean_text(corpora.select("corpus", "doc_id", html_col), html_col, "text", opts.clean).select(
        "corpus", "doc_id", "text")
    filtered = vocabulary_filter(cleaned, "text", opts)
    kept = filtered.where(F.length("text") > 0)
    removed = filtered.groupBy("corpus").agg(
        F.sum(F.when(F.length("text") == 0, 1).otherwise(0)).cast("long").alias("n_removed"))
    return kept, removed
