"""Queries of the corpus stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexprep import constants as C
from lexprep.operators import cleaning as K
from lexprep.operators import labels as L
from lexprep.operators import vocab as V
from lexprep.options import PLAIN, TopicOptions
from lexprep.plans import oracle as O
from lexprep.plans.catalog import register
from lexprep.plans.q_text import clean_sql
from lexprep.sources import fixtures as X
from lexprep.sources.readers import labelled_line, table

# max_df 0.2: at the default 0.75 no term of the test documents is heavy,
# which would leave the pruning untested.
TOPIC = TopicOptions(min_df=1, max_df=0.2, token_pattern="letter_word")
TOPIC_EXACT = TopicOptions(min_df=2, max_df=0.2, token_pattern="letter_word")
CORPUS = TopicOptions(min_df=1, max_df=0.2, token_pattern="letters_only")


def corpora(spark, sf):
    """S3 + P1 + U1: decisions (one corpus per language), benchmark items and
    conversation turns as (corpus, doc_id, html), null documents dropped."""
    dec = X.decisions(spark, sf).where(F.col("html").isNotNull())
    bench = table(spark, sf, "benchmark").where(F.col("text").isNotNull()).select(
        F.lit("benchmark").alias("corpus"), F.col("item_id").alias("doc_id"), F.col("text").alias("html"))
    conv = table(spark, sf, "conversations").where(F.col("text").isNotNull()).select(
        F.lit("conversations").alias("corpus"), (F.col("conv_id") * 1000000000 + F.col("turn")).alias("doc_id"),
        F.col("text").alias("html"))
    return dec.unionByName(bench).unionByName(conv)


CORPORA_SQL = O.DECISIONS + """,
corpora AS (
  SELECT corpus, doc_id, html FROM decisions WHERE html IS NOT NULL
  UNION ALL SELECT 'benchmark', item_id, text FROM benchmark WHERE text IS NOT NULL
  UNION ALL SELECT 'conversations', conv_id * 1000000000 + turn, text FROM conversations WHERE text IS NOT NULL)"""


@register("corpus_union", "WITH " + CORPORA_SQL + "\nSELECT corpus, doc_id, html FROM corpora")
def corpus_union(spark, sf):
    return corpora(spark, sf)


def _pat_sql(preset: str) -> str:
    return O.q(C.TOKEN_PATTERNS[preset][2] or (C.WORD + "+"))


def tokens_sql(x: str, preset: str) -> str:
    toks = f"regexp_extract_all(lower({x}), {_pat_sql(preset)})"
    if preset == "letters_only":
        toks = f"list_filter({toks}, lambda w: regexp_full_match(w, '[a-zA-Z]{{2,}}'))"
    return toks


def full_match_sql(w: str, preset: str) -> str:
    if preset == "letters_only":
        return f"regexp_full_match({w}, '[a-zA-Z]{{2,}}')"
    return f"regexp_full_match({w}, {_pat_sql(preset)})"


def vocab_ctes(src: str, opts: TopicOptions) -> str:
    """CTEs docs(corpus, doc_id, text), dfreq, sizes, vocab, heavy."""
    return f"""docs AS (SELECT corpus, doc_id, {clean_sql('html')} AS text FROM {src}),
toks AS (SELECT corpus, doc_id, {tokens_sql('text', opts.token_pattern)} AS t FROM docs),
terms AS (SELECT corpus, doc_id,
            unnest(list_distinct(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))))
            AS term FROM toks),
dfreq AS (SELECT corpus, term, count(*) AS df FROM terms GROUP BY corpus, term),
sizes AS (SELECT corpus, count(*) AS n_docs FROM docs GROUP BY corpus),
vocab AS (SELECT corpus, term, CAST(df AS BIGINT) AS df FROM dfreq JOIN sizes USING (corpus)
          WHERE df >= {opts.min_df} AND df <= {opts.max_df} * n_docs),
heavy AS (SELECT corpus, list(term) AS hv FROM dfreq JOIN sizes USING (corpus)
          WHERE df > {opts.max_df} * n_docs AND NOT contains(term, ' ') GROUP BY corpus)"""


def pruned_sql(opts: TopicOptions) -> str:
    """relation (corpus, doc_id, text) after T15, empties included."""
    if opts.min_df <= 1:
        return f"""(SELECT d.corpus, d.doc_id, array_to_string(list_filter({O.ws_tokens('d.text')},
          lambda w: {full_match_sql('w', opts.token_pattern)} AND NOT list_contains(coalesce(h.hv, []), w)), ' ') AS text
        FROM docs d LEFT JOIN heavy h USING (corpus))"""
    return f"""(SELECT d.corpus, d.doc_id, coalesce(k.text, '') AS text FROM docs d LEFT JOIN
        (SELECT corpus, doc_id, string_agg(tok, ' ' ORDER BY pos) AS text FROM
           (SELECT corpus, doc_id, unnest(tt) AS tok, generate_subscripts(tt, 1) AS pos
            FROM (SELECT corpus, doc_id, {O.ws_tokens('text')} AS tt FROM docs)) x
         WHERE EXISTS (SELECT 1 FROM vocab v WHERE v.corpus = x.corpus AND v.term = x.tok)
         GROUP BY corpus, doc_id) k USING (corpus, doc_id))"""


_DEC_SRC = "(SELECT corpus, doc_id, html FROM decisions WHERE html IS NOT NULL)"


@register("vocabulary_df", O.with_(O.DECISIONS, vocab_ctes(_DEC_SRC, TOPIC)) + "SELECT corpus, term, df FROM vocab")
def vocabulary_df(spark, sf):
    d = X.decisions(spark, sf).where(F.col("html").isNotNull())
    cleaned = K.with_clean_text(d, "html", "text", PLAIN).select("corpus", "doc_id", "text")
    return V.vocabulary(cleaned, "text", TOPIC)


def _topic(spark, sf, opts):
    d = X.decisions(spark, sf).where(F.col("html").isNotNull())
    return V.topic_prep(d.select("corpus", "doc_id", "html"), opts)


@register("topic_prep", O.with_(O.DECISIONS, vocab_ctes(_DEC_SRC, TOPIC)) + f"""
SELECT corpus, doc_id, text FROM {pruned_sql(TOPIC)} WHERE length(text) > 0""")
def topic_prep(spark, sf):
    return _topic(spark, sf, TOPIC)[0]


@register("topic_prep_removed", O.with_(O.DECISIONS, vocab_ctes(_DEC_SRC, TOPIC)) + f"""
SELECT corpus, CAST(sum(CASE WHEN length(text) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_removed
FROM {pruned_sql(TOPIC)} GROUP BY corpus""")
def topic_prep_removed(spark, sf):
    return _topic(spark, sf, TOPIC)[1]


@register("topic_prep_exact", O.with_(O.DECISIONS, vocab_ctes(_DEC_SRC, TOPIC_EXACT)) + f"""
SELECT corpus, doc_id, text FROM {pruned_sql(TOPIC_EXACT)} WHERE length(text) > 0""")
def topic_prep_exact(spark, sf):
    """T15 with a least document frequency (min_df = 2)."""
    return _topic(spark, sf, TOPIC_EXACT)[0]


@register("training_corpus", "WITH " + CORPORA_SQL + ",\n" + vocab_ctes("corpora", CORPUS) + f"""
SELECT corpus, doc_id, text FROM {pruned_sql(CORPUS)} WHERE length(text) > 0""")
def training_corpus(spark, sf):
    """S4 content: every corpus prepared separately, then concatenated;
    write with readers.write_text_corpus (one document per line)."""
    return V.topic_prep(corpora(spark, sf), CORPUS)[0]


@register("labelled_lines", O.with_(O.RESPONSES, O.LATEST, O.GRADED, O.DECISIONS, O.LABELLED) + f"""
SELECT resp_id AS id,
  CASE WHEN label = 1 THEN {O.q(C.LABEL_POSITIVE)} ELSE {O.q(C.LABEL_NEGATIVE)} END || ' '
  || regexp_replace({clean_sql('html')}, '[\\t\\r\\n]+', ' ', 'g') AS line
FROM labelled WHERE html IS NOT NULL""")
def labelled_lines(spark, sf):
    """S5 + P5: ``__label__x cleaned document`` per labelled decision."""
    ls = L.labelled_set(X.responses(spark, sf), X.decisions(spark, sf)).where(F.col("html").isNotNull())
    t = K.with_clean_text(ls, "html", "text", PLAIN).select(
        F.col("resp_id").alias("id"), L.relevance_label_str("grade").alias("label_str"), "text")
    return t.select("id", labelled_line("label_str", "text").alias("line"))
