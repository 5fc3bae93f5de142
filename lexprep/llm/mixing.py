"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens to the power ``a``, normalised:
1 leaves the shares as they are, 0 makes all sources equal. The exponent is
the largest whose weights reach a target entropy, lowered no further than a
limit on repetition allows; both are found by sections of the interval, a
few sums over the sources at a time, so the driver sees sums and never the
sources. A budget of tokens then gives each source its share, realised as
epochs: whole passes over the source and a last part of one. Documents lie in
``blocks`` blocks of a source by hash; each epoch takes the blocks in an order
of its own, and in the last one the documents of the block where the budget
ends are taken one by one while they fit.

Only (id, source, tokens) leave the scan of the texts. The order of blocks is
a window over at most ``blocks`` rows, and only the block where a source's
budget ends is ordered by document, so a source with a third of all rows is
no larger a task than others.

Null is a source of its own. Null and empty texts have no tokens: they go
where their block goes. Repeated rows are rows of their own. An empty table
or one without a token gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexprep.llm.tables import written


@dataclass(frozen=True)
class Settings:
    budget: float = 1.0  # tokens to give out, as a multiple of those there are
    entropy: float = 0.9  # target, as a share of that of equal weights
    repeats: float = 4.0  # most passes over a source
    blocks: int = 1024
    seed: int = 31


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _sums_table(sources: DataFrame, total: int, exponents: list[float]) -> DataFrame:
    """(k, z, l, r) of each exponent. Exponents are data, not columns: the code that Spark compiles for it in the driver
    is small and the same for all exponents."""
    p, a = F.col("p"), F.col("a")
    each = sources.select((F.col("tokens") / F.lit(float(total))).alias("p"),
                          F.posexplode(F.array(*map(F.lit, exponents))).alias("k", "a"))
    return each.groupBy("k").agg(F.sum(F.pow(p, a)).alias("z"), F.sum(F.pow(p, a) * F.log(p)).alias("l"),
                                 F.max(F.pow(p, a - 1)).alias("r"))


def _sums(sources: DataFrame, total: int, exponents: list[float]) -> list[tuple[float, float, float]]:
    """For each exponent: sum of p**a, sum of p**a * ln p, largest p**(a-1)."""
    got = {x["k"]: (x["z"], x["l"], x["r"]) for x in _sums_table(sources, total, exponents).collect()}
    return [got[k] for k in range(len(exponents))]


def _largest(holds, lo: float = 0.0, hi: float = 1.0, parts: int = 16, rounds: int = 6) -> float:
    """The largest exponent for which a falling condition holds (lo if for none), by sections of the interval."""
    for _ in range(rounds):
        at = [lo + (hi - lo) * k / parts for k in range(parts + 1)]
        ok = holds(at)
        if ok[-1]:
            return at[-1]
        last = max((k for k in range(parts + 1) if ok[k]), default=0)
        lo, hi = at[last], at[last + 1]
    return lo


def exponent(sources: DataFrame, total: int, n: int, s: Settings) -> float:
    """Largest exponent whose weights have the target entropy, or the larger one that the limit on repeats asks for."""
    if n < 2:
        return 1.0
    target = s.entropy * math.log(n)

    def level(at):
        return [math.log(z) - a * l / z >= target - 1e-12 for a, (z, l, _) in zip(at, _sums(sources, total, at))]

    def over(at):  # holds while some source would be repeated too often
        return [s.budget * r / z > s.repeats + 1e-12 for z, _, r in _sums(sources, total, at)]

    a = _largest(level)
    if over([a])[0]:
        b = _largest(over, a, 1.0)
        a = min(1.0, b + (1.0 - a) / 16 ** 6 + 1e-9)
    return a


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        settings: Settings = Settings()) -> DataFrame:
    """(id, source, n_tokens, weight, epoch, block, place): a row for each time a document is taken. ``place`` is the
    rank of the document's block in that epoch of the source."""
    s = settings
    src = F.col(source_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), src.alias("source"), n_tokens(F.col(text_col)).alias("n_tokens"))
    key = F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit("")))
    rows = written(rows.withColumn("key", key).withColumn(
        "block", F.pmod(F.xxhash64(F.lit(s.seed), "id", "n_tokens"), F.lit(s.blocks)).cast("int")), "tokens")
    blocks = written(rows.groupBy("key", "block").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "blocks")
    sources = written(blocks.groupBy("key").agg(F.sum("tokens").alias("tokens")).where("tokens > 0"), "sources")
    r = sources.agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).first()
    total, n = r["t"] or 0, r["n"]
    a = exponent(sources, total, n, s) if total else 1.0
    z = _sums(sources, total, [a])[0][0] if total else 1.0
    weight = F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(a)) / F.lit(z)
    # a budget that even these weights cannot take within the limit is lowered for the source
    want = F.least(weight * F.lit(s.budget * total), F.col("tokens") * F.lit(s.repeats))
    plan = sources.select("key", weight.alias("weight"), F.floor(want + 1e-6).cast("long").alias("want"), F.col("tokens").alias("of"))
    plan = written(plan.withColumn("full", F.floor(F.col("want") / F.col("of")).cast("int")).withColumn(
        "rest", F.col("want") - F.col("full") * F.col("of")), "plan")
    epochs = plan.select("*", F.explode(F.sequence(F.lit(1), F.col("full") + F.when(F.col("rest") > 0, 1).otherwise(0))).alias("epoch"))
    order = Window.partitionBy("key", "epoch").orderBy(F.xxhash64(F.lit(s.seed), "key", "epoch", "block"), "block")
    each = blocks.withColumnRenamed("tokens", "in_block").join(epochs.where("full + rest > 0"), "key")
    each = each.withColumn("place", F.row_number().over(order)).withColumn(
        "before", F.sum("in_block").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    before = F.coalesce("before", F.lit(0))
    whole = (F.col("epoch") <= F.col("full")) | (before + F.col("in_block") <= F.col("rest"))
    each = written(each.withColumns({"whole": whole, "left": F.col("rest") - before}).where(
        F.col("whole") | (F.col("left") > 0)).select("key", "block", "weight", "epoch", "place", "whole", "left"), "epochs")
    taken = rows.join(each.where("whole"), ["key", "block"])
    # the one block of a source where its budget ends
    last = rows.join(each.where("not whole"), ["key", "block"])
    by_doc = Window.partitionBy("key", "block").orderBy(F.xxhash64(F.lit(s.seed + 1), "id"), "id", "n_tokens")
    last = last.withColumn("upto", F.sum("n_tokens").over(by_doc.rowsBetween(Window.unboundedPreceding, 0))).where(
        F.col("upto") <= F.col("left"))
    cols = ["id", "source", "n_tokens", "weight", "epoch", "block", "place"]
    return taken.select(*cols).unionByName(last.select(*cols)).withColumnRenamed("id", id_col)
