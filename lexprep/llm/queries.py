"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexprep.llm import brown_lm as B
from lexprep.llm import collocations as C
from lexprep.llm import decontaminate as D
from lexprep.llm import embedding_dedup as V
from lexprep.llm import exact_dedup as E
from lexprep.llm import labelled as L
from lexprep.llm import license_scan as N
from lexprep.llm import mixing as M
from lexprep.llm import quality as Q
from lexprep.llm import simhash as S
from lexprep.llm import suffix_dedup as R
from lexprep.llm import token_alignment as K
from lexprep.llm import toxicity as X
from lexprep.llm import url_reputation as U
from lexprep.llm.tables import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# words of a text in the oracles: A-Z lower-cased, then runs of other than ASCII punctuation, space and control
_SQL_WORDS = (r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
              r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")


@register("op2_decontaminate", f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS.format('text')} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS.format('text')} AS w FROM benchmark),
win AS (
  SELECT item, least(len(w), 13) AS m, list_slice(w, i, i + least(len(w), 13) - 1) AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM win),
vocab AS (SELECT DISTINCT g[1] AS f FROM win),
pos AS (SELECT doc_id, w, i, w[i] AS f FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
cand AS (SELECT doc_id, i, m, list_slice(w, i, i + m - 1) AS g FROM pos SEMI JOIN vocab USING (f), sizes
  WHERE i + m - 1 <= len(w)),
occ AS (SELECT doc_id, i, c.m AS m, item FROM cand c JOIN win ON c.m = win.m AND c.g = win.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM
  (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM occ)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s
  FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(its.s, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""")
def op2_decontaminate(spark, sf_dir):
    """Per document: its words, those in benchmark windows, and the items they come from."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = D.contamination(docs, read(spark, sf_dir, "benchmark"), "x")
    x = F.col("x")
    return found.select("doc_id", x["n_words"].alias("n_words"), x["n_hit"].alias("n_hit"),
                        F.size(x["item_ids"]).cast("long").alias("n_items"),
                        F.sha2(F.array_join(x["item_ids"], ","), 256).alias("items_sha256"),
                        x["contaminated"].alias("contaminated"))


@register("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    """Per document: toxicity by noisy-or over its sentences, and the sentences to blame."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = X.fit(docs, read(spark, sf_dir, "labels"))
    x = F.col("x")
    return X.with_score(docs, model, "x").select(
        "doc_id", L.held_out("doc_id", 4, 2).alias("held_out"), x["score"].alias("score"),
        (x["score"] >= 0.3).cast("int").alias("predicted"), x["n_sentences"].alias("n_sentences"),
        F.size(x["offending"]).cast("long").alias("n_offending"),
        F.try_element_at(x["offending"], F.lit(1))["sentence"].alias("first_offending"))


@register("op8_quality")
def op8_quality(spark, sf_dir):
    """Per document: probability of good quality from its subword embedding."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = Q.fit(docs, read(spark, sf_dir, "labels"))
    score = F.col("x")["score"]
    return Q.with_score(docs, model, "x").select(
        "doc_id", L.held_out("doc_id", 3, 1).alias("held_out"), score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"))


@register("op5_simhash")
def op5_simhash(spark, sf_dir):
    """Per document: 64-bit fingerprint and the component of fingerprints within two bits."""
    g = S.groups(read(spark, sf_dir, "documents"))
    return g.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op9_suffix_dedup")
def op9_suffix_dedup(spark, sf_dir):
    """Per document: bytes covered by strings of 200 bytes that start elsewhere too, and what is left."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    x = F.col("x")
    got = R.without_repeats(docs, "x", keep_text=False)
    return got.select("doc_id", *[x[c].alias(c) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")])


@register("op3_license_scan")
def op3_license_scan(spark, sf_dir):
    """Per document: base licence phrases and the labels of licence notices placed by their rare words."""
    x = F.col("x")
    got = N.scan(read(spark, sf_dir, "documents").select("doc_id", "text"), "x")
    return got.select("doc_id", x["n_words"].alias("n_words"), F.size(x["places"]).cast("long").alias("n_base"),
                      F.array_min(x["places"]).cast("long").alias("first_word"),
                      F.array_max(x["places"]).cast("long").alias("last_word"),
                      F.array_join(x["base_labels"], ",").alias("base_labels"),
                      F.array_join(x["labels"], ",").alias("labels"), x["score"].alias("score"))


_SQL_REST = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
_SQL_K = """(SELECT CASE WHEN coalesce(sum(n), 0) = 0 OR room <= 0 OR raw IN (0, 1) THEN 2.0
    ELSE 1 / least(greatest((btw / (raw * (1 - raw)) - (m - 1)) / room, 0.01), 0.9) - 1 END FROM
    (SELECT m, n, bad / n AS raw, sq - n * (bad / n) * (bad / n) AS btw, n - nn / n - (m - 1) AS room FROM
      (SELECT CAST(count(*) AS DOUBLE) AS m, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad,
        sum(bad * bad / n) AS sq, CAST(sum(n * n) AS DOUBLE) AS nn FROM {0} WHERE n > 0)) GROUP BY room, raw, btw, m)"""


@register("op6_url_reputation", f"""
WITH r AS (SELECT page_id, coalesce({_SQL_REST}, '') AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
f AS (SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p),
o AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 1 WHEN rule IS NOT NULL THEN 0 END AS bad FROM f),
b AS (SELECT *, regexp_replace(host, '{U._PORT}', '') AS bare FROM o),
h AS (SELECT host, CASE WHEN regexp_matches(bare, '{U._NUMERIC}') OR regexp_extract(bare, '{U._DOMAIN}', 1) = '' THEN bare
      ELSE regexp_extract(bare, '{U._DOMAIN}', 1) END AS domain,
    CASE WHEN regexp_matches(bare, '{U._NUMERIC}') THEN bare ELSE regexp_extract(bare, '{U._SUFFIX}', 1) END AS suffix,
    count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM b GROUP BY host, bare),
d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY suffix, domain),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suffix),
g AS (SELECT CASE WHEN coalesce(sum(n), 0) = 0 THEN 0.5 ELSE (sum(bad) + 0.5) / (sum(n) + 1.0) END AS share FROM s),
ks AS (SELECT {_SQL_K.format('s')} AS s, {_SQL_K.format('d')} AS d, {_SQL_K.format('h')} AS h),
s2 AS (SELECT suffix, (bad + ks.s * share) / (n + ks.s) AS m FROM s, g, ks),
d2 AS (SELECT d.suffix, domain, (bad + ks.d * m) / (n + ks.d) AS m FROM d JOIN s2 USING (suffix), ks),
h2 AS (SELECT host, bad + ks.h * m AS a, n - bad + ks.h * (1 - m) AS b FROM h JOIN d2 USING (suffix, domain), ks),
h3 AS (SELECT host, a / (a + b) - 1.64 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS bound FROM h2)
SELECT page_id, host, path, rule, CASE WHEN bad = 1 THEN 'block' WHEN bad = 0 THEN 'allow'
  WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM o JOIN h3 USING (host)""")
def op6_url_reputation(spark, sf_dir):
    """Per page: host, path, the rule that fits and the verdict, by rule or by the host's reputation."""
    x = F.col("judged")
    got = U.judged(read(spark, sf_dir, "pages").select("page_id", "url"))
    return got.select("page_id", *[x[c].alias(c) for c in ("host", "path", "rule", "verdict")])


@register("op10_embedding_dedup")
def op10_embedding_dedup(spark, sf_dir):
    """Per vector: how many others it links with at cosine 0.95, its component, and whether it is kept."""
    got = V.near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return got.withColumnRenamed("id", "vec_id")


@register("op4_brown_lm")
def op4_brown_lm(spark, sf_dir):
    """Per document: log10 probability under add-one unigrams and under the class bigrams."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model, got = B.perplexity(docs, ~B.held_out())
    return got.select(F.col("id").alias("doc_id"), B.held_out("id").alias("held_out"), "n_tokens", "n_known",
                      F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


@register("op7_mixing")
def op7_mixing(spark, sf_dir):
    """Per document and time taken: its source's weight, epoch, and block with its place in that epoch."""
    return M.mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))


@register("op11_collocations", r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g, count(*) AS f FROM
  (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)
  GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT c.lang, c.k, c.g, c.f AS a, j, x.f AS l, y.f AS r,
    CAST(CAST(1000000 AS HUGEINT) * c.f * c.f // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1) c
  JOIN f x ON x.lang = c.lang AND x.g = array_to_string(list_slice(string_split(c.g, ' '), 1, j), ' ')
  JOIN f y ON y.lang = c.lang AND y.g = array_to_string(list_slice(string_split(c.g, ' '), j + 1, c.k), ' ')),
weak AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
longer AS (SELECT lang, array_to_string(list_slice(string_split(g, ' '), s, s + 1), ' ') AS g, max(f) AS m
  FROM (SELECT *, unnest([1, 2]) AS s FROM f WHERE k = 3) GROUP BY ALL),
kept AS (SELECT weak.* FROM weak LEFT JOIN longer ON weak.lang = longer.lang AND weak.g = longer.g AND k = 2
  WHERE m IS NULL OR 100 * m < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000""")
def op11_collocations(spark, sf_dir):
    """Per language: the first 2000 phrases by the score of their weakest cut."""
    return C.phrases(read(spark, sf_dir, "documents").select("lang", "text"))


@register("op12_token_alignment")
def op12_token_alignment(spark, sf_dir):
    """Per document: tokens, groups and links of two tokenizers, and how common its links are in the corpus."""
    got = K.document_counts(K.align(read(spark, sf_dir, "documents").select("doc_id", "text")))
    return got.withColumnsRenamed({"id": "doc_id", "digest": "groups_sha256"})


@register("op13_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""")
def op13_exact_dedup(spark, sf_dir):
    """Per document: the id that stands for its text, the size of its group, and whether it stays: the whole table as
    the first batch of a new index."""
    index = E.open_index(spark, shared_folder(spark, "digest_index"))
    got = E.ingest(read(spark, sf_dir, "documents").select("doc_id", "text"), index, "documents")
    return got.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


register("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
