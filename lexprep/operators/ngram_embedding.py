"""Supervised n-gram embeddings (M7) whose vectors are rows of a table.

The word 1..n-grams of a document and its end are hashed into ``buckets``; each bucket met in training has a vector of
``dim`` numbers, a document is the mean of its grams' vectors, and a softmax over a small class matrix on top of it,
beside the classes' shares, gives the label. The bucket vectors are never gathered: a bucket meets its documents in a
join. The driver holds the class matrix (classes x dim), the class list and a few numbers a round.

Training minimises the mean log loss by conjugate gradients. Vectors start at zero, so every vector is a sum over
documents of weight times a coefficient of the document, and the state between rounds is a row for each document:
its mean vector and its coefficient, for the point and for the direction of search. A round is two joins: gradients of
the documents summed by bucket, and these summed back by document. The step is the best of ``STEPS`` by the loss, all
tried in one pass.

For these joins the grams of the training rows lie in cells, the (document, bucket, weight) of one block of some
``PART_ROWS`` documents and of one of ``PARTS`` parts of the buckets, as packed numbers that are shuffled once and kept
for the time of the fit. To a cell come the numbers of its block or of its part in one row, and it sends back one row
of sums, added up by part or by block as they come. So no task holds more than a few cells' rows, however often a
bucket is met.

Rows of one id are one document. Null texts count as empty; an empty text has its end as its only gram. Rows without a
label or an id are left out of training. Buckets not met in training count nothing. Equal scores go to the smaller label. An
empty training table is an error, one of a single class gives that class. Other columns are kept by ``scored``, which
replaces one of the name of its result.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexprep.operators.vectors import word_counts
from lexprep.session import interim, ship_package

#: Documents of a block, about, and parts of the buckets: a cell of the training grams is a block's share of a part.
PART_ROWS, PARTS = 1 << 14, 32
#: Grams of documents that are counted at once, and numbers of a row of a cell; one document may have more.
COUNTED, CELL_ROWS = 1 << 20, 1 << 18
#: Steps tried, as multiples of the one at which the direction moves a mean vector by 1.
STEPS = tuple(2.0 ** k for k in range(-7, 10))
END = "</s>"


@dataclass(frozen=True)
class Settings:
    n: int = 3
    buckets: int = 1 << 21
    dim: int = 10
    rounds: int = 8
    tolerance: float = 1e-3  # stop when a round lowers the loss by less
    seed: int = 42


def _hashed(text: Column, s: Settings) -> Column:
    """The buckets of all grams of a text, repeats included."""
    words = F.concat(F.filter(F.split(text, " "), lambda w: w != ""), F.array(F.lit(END)))

    def of(w: Column, k: int) -> Column:
        m = F.size(w)
        # the hash of k words is that of their slice, which would be cut out of the whole array for every gram
        hashed = F.transform(F.sequence(F.lit(0), m - k), lambda i: F.pmod(F.xxhash64(*[F.get(w, i + d) for d in range(k)]), F.lit(s.buckets)))
        return F.when(m >= k, hashed).otherwise(F.array().cast("array<bigint>"))

    return F.flatten(F.transform(F.array(words), lambda w: F.concat(*[of(w, k) for k in range(1, s.n + 1)])))


def _by_id(docs: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """(id, met): the buckets of all grams of a document, repeats included. Grams are those of single texts."""
    texts = docs.groupBy(F.col(id_col).alias("id")).agg(F.collect_list(F.coalesce(F.col(text_col), F.lit(""))).alias("texts"))
    return texts.select("id", F.flatten(F.transform("texts", lambda t: _hashed(t, s))).alias("met"))


def grams(docs: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """(id, bucket, weight): each bucket's share of the grams of a document."""
    rows = _by_id(docs, id_col, text_col, s).select("id", F.size("met").alias("n"), F.sort_array("met").alias("met"))
    counts = rows.select("id", "n", F.explode(word_counts(F.col("met"))).alias("x"))
    return counts.select("id", F.col("x.term").alias("bucket"), (F.col("x.tf") / F.col("n")).alias("weight"))


def _names(prefix: str, dim: int) -> list[str]:
    return [f"{prefix}{j}" for j in range(dim)]


def _dot(values, columns) -> Column:
    """Sum of numbers times columns."""
    total = F.lit(0.0)
    for v, c in zip(values, columns):
        total = total + F.lit(float(v)) * c
    return total


def _sums(df: DataFrame, by: str, prefix: str, dim: int) -> DataFrame:
    """Weighted sums of the vectors ``prefix`` of each ``by``."""
    return df.groupBy(by).agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in _names(prefix, dim)])


def _scores(head: np.ndarray, prior: np.ndarray, hidden: list[Column]) -> list[Column]:
    return [F.lit(float(b)) + _dot(row, hidden) for b, row in zip(prior, head)]


def _log_total(scores: list[Column]) -> Column:
    """log of the sum of exp, by way of the greatest."""
    top = F.greatest(*scores)
    total = F.lit(0.0)
    for x in scores:
        total = total + F.exp(x - top)
    return top + F.log(total)


def _picked(columns: list[Column], at: Column) -> Column:
    return F.element_at(F.array(*columns), at + 1)


def _cut(batches, buckets: int):
    """Pieces of cells from documents (block, at, buckets of all grams)."""
    for batch in batches:
        lengths = np.asarray(batch.column(2).value_lengths()).astype(np.int64)
        before, i = np.append(0, np.cumsum(lengths)), 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(before, before[i] + COUNTED, "right")) - 1)
            part, sizes, i = batch.slice(i, j - i), lengths[i:j], j
            block, at = (np.asarray(part.column(k)).astype(np.int64) for k in (0, 1))
            key, n = np.unique(np.repeat(np.arange(len(at)), sizes) * buckets + np.asarray(part.column(2).flatten()), return_counts=True)
            doc, bucket = key // buckets, key % buckets
            cell = block[doc] * PARTS + bucket % PARTS
            order = np.argsort(cell, kind="stable")
            cell, doc, bucket, weight = cell[order], doc[order], bucket[order] // PARTS, (n / sizes[doc])[order]
            first = np.flatnonzero(np.diff(cell, prepend=-1))
            ends = np.append(first[1:], len(cell))
            raw = lambda v, t: pa.array([v[a:b].astype(t).tobytes() for a, b in zip(first, ends)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(cell[first]), raw(at[doc], np.int32), raw(bucket, np.int32),
                                              raw(weight, np.float64)], names=["cell", "at", "bucket", "weight"])


def _merged(batches):
    """Neighbouring pieces of a cell in one row."""
    now, held, size = None, [], 0

    def told():
        return pa.RecordBatch.from_arrays([pa.array([now]), *[pa.array([b"".join(x[k] for x in held)], pa.binary()) for k in range(3)]],
                                          names=["cell", "at", "bucket", "weight"])

    for batch in batches:
        for r in range(batch.num_rows):
            cell, *piece = (batch.column(k)[r].as_py() for k in range(4))
            if held and (cell != now or size + len(piece[0]) > 4 * CELL_ROWS):
                yield told()
                held, size = [], 0
            now, size = cell, size + len(piece[0])
            held.append(piece)
    if held:
        yield told()


def _read(batch: pa.RecordBatch, r: int, column: int, kind) -> np.ndarray:
    return np.frombuffer(batch.column(column)[r].as_buffer(), kind)


def _told(key: int, met: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """(key, places, sums) of the places that were met."""
    places = np.flatnonzero(met)
    return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([places.astype(np.int32).tobytes()], pa.binary()),
                                       pa.array([sums[places].tobytes()], pa.binary())], names=["key", "places", "sums"])


def _grown(x: np.ndarray, size: int) -> np.ndarray:
    return x if size <= len(x) else np.concatenate([x, np.zeros((size - len(x), *x.shape[1:]), x.dtype)])


def _through_cells(batches, dim: int, to_parts: bool):
    """(key, places, sums): of each row of a cell, weighted sums by bucket (key: the part) of its documents' numbers, or
    by document (key: the block) of its buckets' numbers."""
    for batch in batches:
        for r in range(batch.num_rows):
            cell = batch.column(0)[r].as_py()
            at, bucket, weight = (_read(batch, r, k, t) for k, t in ((1, np.int32), (2, np.int32), (3, np.float64)))
            places, values = _read(batch, r, 4, np.int32), _read(batch, r, 5, np.float64).reshape(-1, dim)
            source, target = (at, bucket) if to_parts else (bucket, at)
            given = np.zeros((int(places.max()) + 1, dim))
            given[places] = values
            met = np.bincount(target) > 0
            total = np.column_stack([np.bincount(target, weight * given[source, j]) for j in range(dim)])
            yield _told(cell % PARTS if to_parts else cell // PARTS, met, total)


def _added(batches, dim: int):
    """Sums of the same key added up as they come; a task has few keys."""
    totals: dict[int, tuple] = {}
    for batch in batches:
        for r in range(batch.num_rows):
            key, places = batch.column(0)[r].as_py(), _read(batch, r, 1, np.int32)
            met, total = totals.get(key, (np.zeros(0, bool), np.zeros((0, dim))))
            met, total = _grown(met, int(places.max()) + 1), _grown(total, int(places.max()) + 1)
            met[places] = True
            total[places] += _read(batch, r, 2, np.float64).reshape(-1, dim)
            totals[key] = met, total
    for key, (met, total) in totals.items():
        yield _told(key, met, total)


def _packed(batches, dim: int):
    """Rows (key, [(at, numbers)]) as (key, places, sums)."""
    for batch in batches:
        for r in range(batch.num_rows):
            rows = batch.column(1)[r].values
            values = np.column_stack([np.asarray(rows.field(j + 1)) for j in range(dim)])
            places = np.asarray(rows.field(0)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(r, 1), pa.array([places.tobytes()], pa.binary()),
                                              pa.array([values.tobytes()], pa.binary())], names=["key", "places", "sums"])


def _unpacked(batches, dim: int, names: list[str]):
    """(key, places, sums) as a row for each place."""
    for batch in batches:
        for r in range(batch.num_rows):
            places, values = _read(batch, r, 1, np.int32), _read(batch, r, 2, np.float64).reshape(-1, dim)
            key = np.full(len(places), batch.column(0)[r].as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(places), *[pa.array(values[:, j].copy()) for j in range(dim)]], names=names)


_CELLS, _SUMS = "cell bigint, at binary, bucket binary, weight binary", "key bigint, places binary, sums binary"


class _Grams:
    """The training grams in cells, and the places of the documents (id, block, at)."""

    def __init__(self, rows: DataFrame, id_col: str, text_col: str, n: int, s: Settings):
        spark, dim = rows.sparkSession, s.dim
        ship_package(spark)
        self.dim, self.blocks = dim, max(1, math.ceil(n / PART_ROWS))
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        block = F.pmod(F.xxhash64("id"), F.lit(self.blocks))
        ids = rows.select(F.col(id_col).alias("id")).distinct().withColumn("block", block)
        at = F.row_number().over(Window.partitionBy("block").orderBy("id")) - 1
        self.places = interim(ids.withColumn("at", at), "ngram_places")
        placed = _by_id(rows, id_col, text_col, s).join(self.places, "id").select("block", "at", "met")
        pieces = placed.mapInArrow(lambda b: _cut(b, s.buckets), _CELLS).repartition(tasks, "cell").sortWithinPartitions("cell")
        # dealt once more after the merging, since Spark does not know that it leaves the rows where they are
        self.cells = pieces.mapInArrow(_merged, _CELLS).repartition(tasks, "cell").persist(StorageLevel.MEMORY_AND_DISK)

    def _sent(self, given: DataFrame, to_parts: bool) -> DataFrame:
        """The numbers of each block or part, summed through the cells."""
        dim, (others, cell) = self.dim, ((PARTS, F.col("key") * PARTS + F.col("other")) if to_parts else
                                         (self.blocks, F.col("other") * PARTS + F.col("key")))
        copies = (given.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
                  .select(cell.alias("cell"), "places", "sums"))
        met = self.cells.join(copies.hint("shuffle_hash"), "cell").select("cell", "at", "bucket", "weight", "places", "sums")
        parts = met.mapInArrow(lambda b: _through_cells(b, dim, to_parts), _SUMS)
        return parts.repartition(PARTS if to_parts else self.blocks, "key").mapInArrow(lambda b: _added(b, dim), _SUMS)

    def _rows(self, sums: DataFrame, names: list[str], prefix: str) -> DataFrame:
        dim, names = self.dim, [*names, *_names(prefix, self.dim)]
        kinds = ", ".join([f"{names[0]} bigint, {names[1]} int", *[f"{c} double" for c in names[2:]]])
        return sums.mapInArrow(lambda b: _unpacked(b, dim, names), kinds)

    def to_buckets(self, docs: DataFrame, prefix: str) -> DataFrame:
        """Packed sums by part of the buckets, of rows (block, at, numbers)."""
        dim = self.dim
        packed = docs.groupBy("block").agg(F.collect_list(F.struct("at", *_names(prefix, dim))).alias("rows"))
        return self._sent(packed.mapInArrow(lambda b: _packed(b, dim), _SUMS), True)

    def to_docs(self, sums: DataFrame, prefix: str) -> DataFrame:
        """(block, at, numbers) of the documents, each of which has a gram."""
        return self._rows(self._sent(sums, False), ["block", "at"], prefix)

    def vectors(self, sums: DataFrame, prefix: str) -> DataFrame:
        """(bucket, numbers) of packed sums by part."""
        rows = self._rows(sums, ["part", "place"], prefix)
        return rows.select((F.col("place") * F.lit(PARTS).cast("bigint") + F.col("part")).alias("bucket"), *_names(prefix, self.dim))

    def free(self) -> None:
        self.cells.unpersist()


@dataclass(frozen=True)
class NgramModel:
    vectors: DataFrame  # (bucket, v0, v1, ...)
    head: np.ndarray    # a row for each class
    prior: np.ndarray   # log shares of the classes
    classes: list
    settings: Settings
    losses: list

    def scored(self, docs: DataFrame, id_col: str = "id", text_col: str = "text", name: str = "prediction") -> DataFrame:
        """``docs`` and the likeliest label of each row. The vectors, at most ``buckets`` rows, are held by hash and the
        grams stream past them; words that most documents hold are hot keys there, which AQE splits."""
        dim = self.settings.dim
        hidden = _sums(grams(docs, id_col, text_col, self.settings).join(self.vectors.hint("shuffle_hash"), "bucket"), "id", "v", dim)
        if len(self.classes) == 1:
            return docs.withColumn(name, F.lit(self.classes[0]))
        at = [F.coalesce(F.col(c), F.lit(0.0)) for c in _names("v", dim)]
        scores = F.array(*_scores(self.head, self.prior, at))
        label = F.element_at(F.array(*map(F.lit, self.classes)), F.array_position(scores, F.array_max(scores)).cast("int"))
        known = hidden.select(F.col("id").alias("_id_of_hidden"), *_names("v", dim))
        found = docs.join(known, docs[id_col].eqNullSafe(known["_id_of_hidden"]), "left")
        return found.withColumn(name, label).drop("_id_of_hidden", *_names("v", dim))

    def save(self, path: str) -> None:
        told = {"head": self.head.tolist(), "prior": self.prior.tolist(), "classes": self.classes,
                "settings": asdict(self.settings), "losses": self.losses}
        self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
        spark = self.vectors.sparkSession
        spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")


def load(spark: SparkSession, path: str) -> NgramModel:
    told = json.loads(spark.read.text(f"{path}/head").first()[0])
    return NgramModel(spark.read.parquet(f"{path}/vectors"), np.array(told["head"]), np.array(told["prior"]), told["classes"],
                      Settings(**told["settings"]), told["losses"])


def fit(train: DataFrame, id_col: str = "id", text_col: str = "text", label_col: str = "label",
        settings: Settings = Settings()) -> NgramModel:
    """Train on the labelled rows. Vectors and the state of each round are interim tables (see ``interim``)."""
    s, dim = settings, settings.dim
    rows = train.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    shares = (rows.groupBy(F.col(id_col)).agg(F.min(label_col).alias("y")).groupBy("y").count().orderBy("y").collect())  # classes
    if not shares:
        raise ValueError("no labelled rows")
    classes, n = [r["y"] for r in shares], sum(r["count"] for r in shares)
    prior = np.log([r["count"] / n for r in shares])
    k = len(classes)
    rng = np.random.default_rng(s.seed)
    head = np.linalg.qr(rng.normal(size=(max(k, dim), max(k, dim))))[0][:k, :dim] * math.sqrt(max(k, dim) / dim)
    kept = _Grams(rows, id_col, text_col, n, s)
    y = F.array_position(F.array(*map(F.lit, classes)), F.col("y")).cast("int") - 1
    point, zero = ("h", "c", "dh", "dc"), F.lit(0.0)  # mean vector, coefficient, and the direction of both
    state = (rows.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y")).join(kept.places, "id")
             .select("block", "at", y.alias("y"), *[zero.alias(c) for p in point for c in _names(p, dim)]))
    turn, norm, losses = np.zeros_like(head), None, []
    cols = lambda p: [F.col(c) for c in _names(p, dim)]
    for _ in range(s.rounds if k > 1 else 0):
        # gradients at the point: of each document's mean vector (g), and their image by way of the buckets (r)
        scored = state.withColumns({f"s{i}": x for i, x in enumerate(_scores(head, prior, cols("h")))})
        score = [F.col(f"s{i}") for i in range(k)]
        errors = {f"e{i}": (F.exp(score[i] - F.col("total")) - (F.col("y") == i).cast("double")) / n for i in range(k)}
        scored = scored.withColumn("total", _log_total(score)).withColumns(errors)
        scored = scored.withColumns({f"g{j}": _dot(head[:, j], [F.col(f"e{i}") for i in range(k)]) for j in range(dim)})
        scored = scored.withColumn("loss", (F.col("total") - _picked(score, F.col("y"))) / n)
        scored = interim(scored.drop(*[f"s{i}" for i in range(k)], "total"), "ngram_gradients")
        image = kept.to_docs(kept.to_buckets(scored.select("block", "at", *_names("g", dim)), "g"), "r")
        at = interim(scored.join(image, ["block", "at"]), "ngram_round")
        product = lambda a, b: F.sum(sum((x * y for x, y in zip(cols(a), cols(b))), zero))
        got = at.agg(F.sum("loss"), product("g", "r"), product("g", "g"), product("h", "h"),
                     product("r", "r"), product("r", "dh"), product("dh", "dh"), *[F.sum(F.col(f"e{i}") * h) for i in range(k) for h in cols("h")]).first()
        losses.append(got[0])
        if norm is not None and len(losses) > 1 and losses[-2] - losses[-1] < s.tolerance:
            break
        # the class matrix moves at the pace of the vectors: curvature along the gradients, over that of its own block
        pace = got[1] / got[2] / got[3] if got[2] and got[3] else 0.0
        slant = np.array(got[7:]).reshape(k, dim)
        now = got[1] + pace * float((slant ** 2).sum())
        beta = now / norm if norm else 0.0
        norm = now
        turn = -pace * slant + beta * turn
        moved = {}
        for d, back in (("dh", "r"), ("dc", "g")):
            moved |= {c: F.lit(beta) * F.col(c) - F.col(f"{back}{j}") for j, c in enumerate(_names(d, dim))}
        at = at.withColumns(moved).drop("loss", *[f"e{i}" for i in range(k)], *_names("g", dim), *_names("r", dim))
        # the step: all candidates in one pass
        length = math.sqrt(max(got[4] - 2 * beta * got[5] + beta * beta * got[6], 0.0) / n)  # of dh now, -r + beta dh before
        if not length:
            break
        steps = [m / length for m in STEPS]
        tried = at.select("y", *_names("h", dim), *_names("dh", dim), F.explode(F.array(*map(F.lit, steps))).alias("step"))
        there = [h + F.col("step") * d for h, d in zip(cols("h"), cols("dh"))]
        bent = [F.lit(float(prior[i])) + sum(((F.lit(float(head[i, j])) + F.col("step") * F.lit(float(turn[i, j]))) * F.col(f"t{j}")
                                              for j in range(dim)), zero) for i in range(k)]
        tried = (tried.select("y", "step", *[x.alias(f"t{j}") for j, x in enumerate(there)])
                 .select("y", "step", *[x.alias(f"s{i}") for i, x in enumerate(bent)]))
        per = tried.groupBy("step").agg(F.avg(_log_total(score) - _picked(score, F.col("y"))).alias("loss")).collect()
        best = min(per, key=lambda r: (r["loss"], r["step"]))
        if best["loss"] >= losses[-1]:
            norm, turn = None, np.zeros_like(head)  # not downhill: start over from the gradient
            state = at.withColumns({c: zero for d in ("dh", "dc") for c in _names(d, dim)})
            if beta == 0.0:
                break
            continue
        step = best["step"]
        head = head + step * turn
        state = at.withColumns({f"{p}{j}": F.col(f"{p}{j}") + F.lit(step) * F.col(f"d{p}{j}") for p in "hc" for j in range(dim)})
    coefficients = state.select("block", "at", *[F.col(c).alias(f"v{j}") for j, c in enumerate(_names("c", dim))])
    vectors = interim(kept.vectors(kept.to_buckets(coefficients, "v"), "v"), "ngram_vectors")
    kept.free()
    return NgramModel(vectors, head, np.asarray(prior), classes, s, losses)
