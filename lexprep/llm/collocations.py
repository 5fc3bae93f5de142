"""Phrase collocations counted in quotient filters.

Texts are lower-cased (A-Z), split at ``BREAKS`` into pieces and those into words at spaces and tabs; a phrase stands
inside one piece. Everything is counted within a language.

1. Blocks. Tasks turn their texts into blocks of one language: the distinct words and the text as codes into them.
2. Word ids. Words are counted over all blocks; a word of fewer than ``min_count`` occurrences is in no phrase of
   that many, nor a part of one, so only the others get ids: rows are numbered inside buckets of a hash, which keeps
   the numbers unique and short. The ids come back to each block by a join.
3. Filters. Each task packs the n-grams of words with ids into a sorted counting quotient filter and sends it on in
   parts, ranges of quotients. Parts are merged: what is sent is one counter for each n-gram and task, so a phrase
   that fills the corpus costs no more than a rare one.
4. Phrases. N-grams of at least ``min_count`` leave the filters as ids; the counts of their parts come by joins, and
   the score of a phrase is that of its weakest cut, in exact decimals.

Null texts have no words; a null language is ``und``. Empty texts and pieces count nothing, very long texts are a
block of their own, repeated rows count each time, and an empty table gives an empty result. Ties in score go to the
more frequent phrase and then to the one that comes first in UTF-8. Columns other than text and language are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexprep.llm import arrow as A
from lexprep.llm import quotient_filter as Q
from lexprep.llm.blocks import block_id, dictionary
from lexprep.llm.tables import quoted, written

BLOCK_BYTES = 4 << 20
#: Filter entries that a task holds before it sends them on, and those that a part shall have at most on average.
HELD_ENTRIES = 2 << 20
PART_ENTRIES = 1 << 20
ID_BUCKET = 1 << 16
#: Candidate phrases that one task ranks.
RANK_ROWS = 1 << 16

BREAKS = A._class(*((ord(c), ord(c)) for c in ".,;:!?"), (0x0A, 0x0D))  # False: ends a piece
_BREAK = ~BREAKS
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_WORD = ~(_BREAK | _BLANK)


@dataclass(frozen=True)
class Settings:
    min_count: int = 10
    top: int = 2000
    #: A phrase goes if a longer one that holds it has at least this share of its occurrences (in hundredths).
    absorbed: int = 50


BLOCK = T.StructType([T.StructField("block", T.LongType()), T.StructField("lang", T.StringType()),
                      T.StructField("n", T.LongType()), T.StructField("words", T.ArrayType(T.StringType())),
                      T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("codes", T.BinaryType())])


def coded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(codes, distinct words) of texts in order: a code for each word and -1 wherever a piece or a text ends."""
    starts, ends = A.word_ranges(data, offsets, _WORD)
    codes, distinct = dictionary(A.LOWER[data], starts, ends)
    if not len(codes):
        return np.zeros(0, np.int32), distinct
    broken = np.cumsum(_BREAK[data])
    text = np.searchsorted(offsets, starts, "right")
    cut = (broken[starts[1:]] != broken[starts[:-1]]) | (text[1:] != text[:-1])
    out = np.full(len(codes) + int(cut.sum()), -1, np.int32)
    out[np.arange(len(codes)) + np.concatenate([[0], np.cumsum(cut)])] = codes
    return out, distinct


def blocks(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The texts as blocks: language, words in it, distinct words with their counts, codes."""
    rows = docs.select(F.coalesce(F.col(quoted(lang_col)).cast("string"), F.lit("und")).alias("lang"), F.col(quoted(text_col)).alias("text"))
    names = [f.name for f in BLOCK.fields]

    def run(batches):
        k = 0
        for batch in batches:
            lang = batch.column(0).dictionary_encode()
            for v, name in enumerate(lang.dictionary.to_pylist()):
                own = np.flatnonzero(np.asarray(lang.indices) == v)
                texts = batch.column(1).take(pa.array(own))
                data, offsets = A.text_buffer(texts)
                for i, j in A.chunks(offsets, BLOCK_BYTES):
                    a, b = int(offsets[i]), int(offsets[j])
                    codes, distinct = coded(data[a:b], offsets[i:j + 1] - a)
                    if len(codes):
                        n = np.bincount(codes[codes >= 0], minlength=len(distinct))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([block_id(k)], pa.int64()), pa.array([name]), pa.array([int(n.sum())], pa.int64()),
                             pa.LargeListArray.from_arrays(pa.array([0, len(distinct)]), distinct.cast(pa.large_string()))
                             .cast(pa.list_(pa.string())),
                             pa.array([n], pa.list_(pa.int64())), pa.array([codes.tobytes()], pa.binary())], names=names)
                        k += 1

    return written(A.map_arrow(rows, run, BLOCK), "blocks")


def vocabulary(held: DataFrame, min_count: int) -> DataFrame:
    """(lang, word, n, id) of the words of at least ``min_count`` occurrences in their language. Ids start at 1, are
    unique over all languages and not much larger than their number."""
    common = written(held.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
                     .groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("n"))
                     .where(F.col("n") >= min_count), "words")
    buckets = max(1, -(-common.count() // ID_BUCKET))
    bucket = F.pmod(F.xxhash64("lang", "word"), F.lit(buckets))
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy("lang", "word"))
    return written(common.withColumn("bucket", bucket).withColumn("id", (nth - 1).cast("long") * buckets + F.col("bucket") + 1)
                   .drop("bucket"), "vocabulary")


def ngrams(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of two and of three ids other than 0, as keys; the third id of a run of two is 0."""
    two = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    three = two[:-1][two[1:] == two[:-1] + 1]
    return (np.concatenate([ids[two], ids[three]]), np.concatenate([ids[two + 1], ids[three + 1]]),
            np.concatenate([np.zeros(len(two), ids.dtype), ids[three + 2]]))


def _filled(layout: Q.Layout):
    """Blocks with their ids to packed filters, a row for each part."""

    def sent(f: Q.Filter):
        part = layout.part(f.x)
        edge = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(f) else np.zeros(0, np.int64)
        for i in range(0, len(edge), 256):
            at = edge[i:i + 257]
            stop = [*at[1:].tolist(), len(f)][:min(256, len(at))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[at[:len(stop)]].astype(np.int32)),
                 pa.array([Q.pack(layout, f.slice(a, b)) for a, b in zip(at.tolist(), stop)], pa.binary())], names=["part", "filter"])

    def run(batches):
        held: list[Q.Filter] = []
        for batch in batches:
            for r in range(batch.num_rows):
                codes = np.frombuffer(batch.column(0)[r].as_buffer(), np.int32)
                known = batch.column(1)[r].values
                lut = np.zeros(int(codes.max()) + 2, np.int64)  # -1 is the last: no word
                lut[np.asarray(known.field("at"))] = np.asarray(known.field("id"))
                held.append(Q.merged(layout, *layout.permute(*ngrams(lut[codes]))))
                if sum(map(len, held)) > HELD_ENTRIES:
                    held = [Q.merge(layout, held)]
                    if len(held[0]) > HELD_ENTRIES // 2:
                        yield from sent(held.pop())
        if held:
            yield from sent(Q.merge(layout, held))

    return run


GRAM = "w1 long, w2 long, w3 long, n long"


def _counted(layout: Q.Layout, min_count: int):
    """Packed filters, sorted by part, to the n-grams of at least ``min_count``."""

    def entries(held):
        f = Q.merge(layout, held)
        f = Q.Filter(*(v[f.n >= min_count] for v in (f.x, f.y, f.n)))
        return pa.RecordBatch.from_arrays([*map(pa.array, layout.restore(f.x, f.y)), pa.array(f.n)], names=["w1", "w2", "w3", "n"])

    def run(batches):
        held, at, fresh = [], -1, 0
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if part != at and held:
                    yield entries(held)
                    held, fresh = [], 0
                at = part
                held.append(Q.unpack(layout, part, raw.as_py()))
                fresh += len(held[-1])
                if len(held) > 8 and fresh > len(held[0]):  # what is held at once stays near the distinct keys
                    held, fresh = [Q.merge(layout, held)], 0
        if held:
            yield entries(held)

    return run


def count_ngrams(held: DataFrame, words: DataFrame, min_count: int) -> DataFrame:
    """(w1, w2, w3, n): ids and counts of the phrases of two (w3 = 0) and three words, ``min_count`` and more."""
    size = held.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    most = words.agg(F.coalesce(F.max("id"), F.lit(1)).alias("id")).first()["id"]
    bits = max(most.bit_length(), 2)
    parts = max(8, -(-2 * size // PART_ENTRIES))
    layout = Q.Layout(bits, min(parts.bit_length(), (3 * bits + 1) // 2, 31))
    at = held.select("block", "lang", F.posexplode("words").alias("at", "word"))
    ids = (at.join(words.select("lang", "word", "id"), ["lang", "word"])
           .groupBy("block").agg(F.collect_list(F.struct("at", "id")).alias("ids")))
    lines = held.select("block", "codes").join(ids, "block").select("codes", "ids")
    filters = A.map_arrow(lines, _filled(layout), "part int, filter binary")
    return written(A.map_arrow(filters.repartition("part").sortWithinPartitions("part"), _counted(layout, min_count), GRAM), "ngrams")


def cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact while counts have sixteen digits at most."""
    wide = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1000000).cast("decimal(7,0)"), wide(left) * wide(right))


def first_rows(rows: DataFrame, key: str, order: list[Column], top: int, name: str = "rank") -> DataFrame:
    """The first ``top`` rows of each key with their rank. Each task ranks about ``RANK_ROWS`` of a key and passes on
    its first ones, until one task can rank the rest."""
    n = rows.count()
    spread = F.xxhash64(*[c for c in rows.columns])
    salt = A.free_name(rows, "salt")
    while n > RANK_ROWS and n > 2 * top:
        groups = -(-n // max(RANK_ROWS, 4 * top))
        w = Window.partitionBy(key, salt).orderBy(*order)
        rows = rows.withColumn(salt, F.pmod(spread, F.lit(groups))).withColumn(name, F.row_number().over(w)).where(F.col(name) <= top).drop(salt, name)
        n = groups * top
        spread = F.xxhash64(F.lit(n), *[c for c in rows.columns])
        if groups == 1:
            break
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(name) <= top)


def phrases(docs: DataFrame, settings: Settings = Settings(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per language the first ``top`` phrases: lang, rank, phrase, a (its occurrences), l and r (those of the parts at
    its weakest cut), n (words of the language), score."""
    held = blocks(docs, text_col, lang_col)
    words = vocabulary(held, settings.min_count)
    grams = count_ngrams(held, words, settings.min_count)

    pairs = grams.where("w3 = 0").select("w1", "w2", F.col("n").alias("a"))
    triples = grams.where("w3 > 0").select("w1", "w2", "w3", F.col("n").alias("a"))
    one = lambda k, *more: words.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"word{k}"), F.col("n").alias(f"n{k}"), *more)
    head = pairs.select("w1", "w2", F.col("a").alias("n12"))
    tail = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("n23"))
    longer = triples.select("w1", "w2", "a").unionByName(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    longer = longer.groupBy("w1", "w2").agg(F.max("a").alias("most"))

    stay = (pairs.join(longer, ["w1", "w2"], "left")
            .where(F.col("most").isNull() | (100 * F.col("most") < settings.absorbed * F.col("a"))))
    two = (stay.join(one(1, "lang"), "w1").join(one(2), "w2")
           .select("lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.col("n1").alias("l"), F.col("n2").alias("r"))
           .withColumn("score", cut_score(F.col("a"), F.col("l"), F.col("r"))))
    cut = lambda k, left, right: F.struct(cut_score(F.col("a"), F.col(left), F.col(right)).alias("score"), F.lit(k).alias("k"),
                                          F.col(left).alias("l"), F.col(right).alias("r"))
    three = (triples.join(head, ["w1", "w2"]).join(tail, ["w2", "w3"]).join(one(1, "lang"), "w1").join(one(2), "w2").join(one(3), "w3")
             .withColumn("cut", F.least(cut(1, "n1", "n23"), cut(2, "n12", "n3")))
             .select("lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a", "cut.l", "cut.r", "cut.score"))
    found = written(two.unionByName(three), "phrases")
    best = first_rows(found, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], settings.top)
    total = held.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
