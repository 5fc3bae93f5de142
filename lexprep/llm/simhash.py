"""SimHash near-duplicates with pigeonring filtering.

A text's fingerprint is the bitwise majority over the XXH64 hashes of its
word shingles. Two fingerprints link at ``max_bits`` or fewer differing bits.

The 64 bits form a ring of ``segments`` equal segments. If two fingerprints
differ in at most t bits, then some chain that starts at one of the m segments
has, for every length l, at most l * t / m differing bits in its first l
segments. While l * t < m that budget is zero, so the chain begins with a run
of equal segments: fingerprints are bucketed by (start, run), the rest of the
chain prunes pairs within a bucket, and what remains gets the full Hamming
check. Only distinct fingerprints are compared.

A bucket of more than ``bucket_limit`` fingerprints is not paired up: its
fingerprints link through the variants they reach by flipping at most half
of ``max_bits``. Two fingerprints share such a variant exactly if they are
near enough (for even ``max_bits``), and a variant's group is small by
construction. Both ways are exact, so no link is lost.

Null and empty texts have fingerprint zero and link like any other. A null
id never becomes a component id unless all ids of the component are null.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexprep.llm import arrow as A
from lexprep.llm import components as C
from lexprep.llm.tables import quoted

SHINGLE = 3
MAX_BITS = 2
SEGMENTS = 16
BUCKET_LIMIT = 64


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = 42) -> bytes:
    """Eight bytes, most significant bit first."""
    w = text.lower().split()
    if not w:
        return bytes(8)
    grams = map(b" ".join, zip(*(w[k:] for k in range(shingle)))) if len(w) >= shingle else [b" ".join(w)]
    h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, grams, repeat(seed))), np.uint8).reshape(-1, 8)
    count = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        count += np.unpackbits(h[k:k + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * count > len(h)).tobytes()


def with_fingerprint(docs: DataFrame, name: str, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` and a struct ``name`` whose field ``bits`` is the fingerprint as a signed 64-bit number."""

    def make():
        def of(col):
            data, offsets = A.text_buffer(col)
            raw = b"".join(fingerprint(data[a:b].tobytes(), shingle) for a, b in zip(offsets[:-1], offsets[1:]))
            return {"bits": pa.array(np.frombuffer(raw, ">i8").astype(np.int64), pa.int64())}

        return of

    return A.with_result(docs, text_col, name, T.StructType([T.StructField("bits", T.LongType())]), make)


def _rotate(bits: Column, by: int) -> Column:
    if by == 0:
        return bits
    return F.shiftleft(bits, by).bitwiseOR(F.shiftrightunsigned(bits, 64 - by))


def _chain_holds(diff: Column, max_bits: int, segments: int) -> Column:
    """Whether the chain from the first segment of ``diff`` keeps each prefix within its share of the budget."""
    width = 64 // segments
    ok = F.lit(True)
    for n in range(1, segments + 1):
        if n == segments or n * max_bits // segments < (n + 1) * max_bits // segments:  # the last of equal budgets
            ok = ok & (F.bit_count(F.shiftrightunsigned(diff, 64 - n * width) if n < segments else diff)
                       <= n * max_bits // segments)
    return ok


def links(fps: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS,
          bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(a, b) links between distinct fingerprints (column ``fp``); together they join all that are within ``max_bits``.

    Pairs of ordinary buckets are listed; those of a crowded bucket are joined through shared variants."""
    width = 64 // segments
    run = -(-segments // max_bits) - 1  # segments with a budget of zero
    keys = F.array(*[F.struct(F.lit(k).alias("start"), _rotate(F.col("fp"), k * width).alias("ring"))
                     for k in range(segments)])
    ring = (fps.select("fp", F.explode(keys).alias("k"))
            .select("fp", F.col("k")["start"].alias("start"), F.col("k")["ring"].alias("ring"))
            .withColumn("run", F.shiftrightunsigned("ring", 64 - run * width)))
    shared = ring.groupBy("start", "run").count().where("count > 1").checkpoint()
    near = ring.join(shared, ["start", "run"]).checkpoint()
    fair = near.where(F.col("count") <= bucket_limit)
    x = fair.select("start", "run", F.col("fp").alias("a"), F.col("ring").alias("p"))
    y = fair.select("start", "run", F.col("fp").alias("b"), F.col("ring").alias("q"))
    diff = F.col("p").bitwiseXOR(F.col("q"))
    found = (x.join(y, ["start", "run"]).where((F.col("a") < F.col("b")) & _chain_holds(diff, max_bits, segments)
                                               & (F.bit_count(diff) <= max_bits)).select("a", "b"))
    # crowded buckets: fingerprints that meet in a variant are at most max_bits apart, and the other way round
    half = max_bits // 2
    masks = [sum(1 << b for b in c) for n in range(half + 1) for c in combinations(range(64), n)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    crowd = near.where(F.col("count") > bucket_limit).select("fp").distinct()
    variants = crowd.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("m")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("m")).alias("v"))
    met = (variants.groupBy("v").agg(F.collect_list("fp").alias("g")).where(F.size("g") > 1)
           .select(F.array_min("g").alias("a"), F.explode("g").alias("b")).where(F.col("a") != F.col("b")))
    return found.union(met)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
           max_bits: int = MAX_BITS, segments: int = SEGMENTS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(id, th, fp, root, component_id) of every row: hash of its text, fingerprint, a fingerprint that names its
    component, and the smallest id of the component."""
    if max_bits % 2 or 64 % segments:
        raise ValueError("max_bits must be even and segments divide 64")
    C.use_checkpoint_dir(docs.sparkSession)
    rows = with_fingerprint(docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")), "f", "text", shingle)
    rows = rows.select("id", F.xxhash64("text").alias("th"), F.col("f")["bits"].alias("fp")).checkpoint()
    fps = rows.groupBy("fp").agg(F.min("id").alias("least")).checkpoint()
    joined = C.components(links(fps.select("fp"), max_bits, segments, bucket_limit))
    rooted = (fps.join(joined.withColumnRenamed("node", "fp"), "fp", "left")
              .select("fp", F.coalesce("component", "fp").alias("root"), "least").checkpoint())
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id")).checkpoint()
    named = rooted.select("fp", "root").join(least, "root").checkpoint()
    return rows.join(named, "fp").select("id", "th", "fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component, the one with the smallest id, with the columns it came with.

    Of rows with that id the one whose text hash is smallest stays, of equal rows any one; a null id comes last."""
    order = F.struct(F.col("id").isNull().alias("no"), F.col("id").alias("id"), F.col("th").alias("th"))
    kept = (groups(docs, id_col, text_col, **options).groupBy("root")
            .agg(F.min(order).alias("o")).select("root", F.col("o")["id"].alias("k_"), F.col("o")["th"].alias("h_")).checkpoint())
    own_id, own_text = f"d.{quoted(id_col)}", f"d.{quoted(text_col)}"
    d, k = docs.alias("d"), kept.alias("k")
    mine = d.join(k, (F.col(own_id).eqNullSafe(F.col("k.k_"))) & (F.xxhash64(own_text) == F.col("k.h_")), "left_semi")
    # equal rows of the table: one of them stays
    twins = (docs.select(F.col(quoted(id_col)).alias("k_"), F.xxhash64(quoted(text_col)).alias("h_"))
             .groupBy("k_", "h_").count().where("count > 1").select("k_", "h_").checkpoint())
    if twins.isEmpty():
        return mine.select(*[F.col(f"d.{quoted(c)}") for c in docs.columns])
    t = twins.alias("t")
    same = (F.col(own_id).eqNullSafe(F.col("t.k_"))) & (F.xxhash64(own_text) == F.col("t.h_"))
    single = mine.join(t, same, "left_anti")
    double = mine.join(t, same, "left_semi").dropDuplicates([id_col, text_col])
    return single.unionByName(double)
