"""Near-duplicate embeddings by a random-projection tree forest.

Each tree splits the vectors by random directions, at the median, again and
again; vectors near a split go to both sides, so near pairs seldom part.
Vectors are compared, in double precision, with those of their own leaves.
Many trees, and union-find over what they verify, find nearly all pairs at
or above the threshold and none below it.

The trees are fitted on a bounded sample (``Settings.sample``,
``sample_bytes``); every vector is dropped through them. A leaf that holds
more than ``leaf_limit`` vectors is split further by directions made from
its own name, with thresholds from all its vectors.

Hot groups are kept out of the leaves. Equal vectors are one row with a
count. Vectors within half the threshold's angle of a centre (a sampled
vector with many sampled ones so close) are all linked with each other: such
a tight ball needs a count, not pairs. A wide ball is a group spread over the
whole angle round the mean of its sample; its members are compared with each
other completely. What links a ball's members with others lies within its
radius and one angle more of its centre, and is compared with the members,
so members need no tree.

Random splits would part the links of a group that fills a node. So a node
of which a good part of the pairs links is split no further, in the sample as
in the full leaves, whatever its size: at most ``1 / dense`` comparisons for
each link. Balls and such leaves are cut into chunks of bounded size, and
each task compares two of them.

Vectors that are null, zero, or hold a null or non-finite component are
returned with no links, as their own component. Vectors of different length
never link. A pair found in several leaves counts once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexprep.llm import arrow as A
from lexprep.llm import components as C
from lexprep.llm.tables import written


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.95
    trees: int = 8
    leaf: int = 200  # rows a leaf is meant to hold
    leaf_limit: int = 1500
    spill: float = 0.06  # share of a node's sample on either side of the median that goes both ways
    sample: int = 8192
    sample_bytes: int = 32 << 20
    max_leaves: int = 4096  # of a tree that is sent to the executors
    ball_sample: int = 4096
    ball_share: float = 1 / 128  # of the sample within half the angle, for a centre
    dense: float = 1 / 8  # share of linked pairs from which on pairs are compared completely
    chunk: int = 512  # least rows of a chunk; the rows are dealt over ``parts`` while these stay within chunk_bytes
    parts: int = 12
    chunk_bytes: int = 16 << 20
    seed: int = 29


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision, a row for each list."""
    flat = np.asarray(col.flatten()).astype(np.float64).reshape(len(col), dim)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)  # no overflow in the square
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


@dataclass
class Tree:
    """Node k splits by direction[k] at low[k]..high[k] into child[k]; a negative child is leaf -child - 1."""

    direction: np.ndarray
    low: np.ndarray
    high: np.ndarray
    child: np.ndarray
    leaves: int


def linked_share(x: np.ndarray, threshold: float) -> float:
    """Share of the pairs that link."""
    n = len(x)
    return float(((x @ x.T >= threshold).sum() - n) / max(n * (n - 1), 1))


def fit_tree(x: np.ndarray, n_rows: int, s: Settings, rng) -> Tree:
    """Split the sample until a leaf would hold about ``leaf`` of ``n_rows`` rows."""
    scale = n_rows / max(len(x), 1)
    direction, low, high, child, leaves = [], [], [], [], 0

    def grow(idx, depth):
        nonlocal leaves
        few = len(idx) * scale <= s.leaf_limit
        if len(idx) * scale <= s.leaf or len(idx) < 8 or 2 ** depth >= s.max_leaves or \
                linked_share(x[idx[:128]], s.threshold) >= (s.dense / 4 if few else s.dense):
            leaves += 1
            return -leaves
        a, b = rng.choice(idx, 2, replace=False)
        d = x[a] - x[b]
        if not np.any(d):
            d = rng.standard_normal(x.shape[1])
        d = d / np.sqrt(d @ d)
        p = x[idx] @ d
        lo, hi = np.quantile(p, [0.5 - s.spill, 0.5 + s.spill])
        k = len(direction)
        direction.append(d)
        low.append(lo)
        high.append(hi)
        child.append([0, 0])
        left, right = idx[p <= hi], idx[p >= lo]
        if len(left) == len(idx) or len(right) == len(idx):  # all alike on this direction
            mid = len(idx) // 2
            order = np.argsort(p, kind="stable")
            left, right = idx[order[:mid]], idx[order[mid:]]
            low[k] = high[k] = p[order[mid]]
        child[k] = [grow(left, depth + 1), grow(right, depth + 1)]
        return k

    root = grow(np.arange(len(x)), 0)
    if root < 0:
        return Tree(np.zeros((0, x.shape[1])), np.zeros(0), np.zeros(0), np.zeros((0, 2), np.int64), leaves)
    return Tree(np.array(direction), np.array(low), np.array(high), np.array(child), leaves)


def drop(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every leaf that each row reaches."""
    if not len(tree.direction):
        return np.arange(len(x)), np.zeros(len(x), np.int64)
    rows, leaves, todo = [], [], [(0, np.arange(len(x)))]
    while todo:
        k, idx = todo.pop()
        if not len(idx):
            continue
        if k < 0:
            rows.append(idx)
            leaves.append(np.full(len(idx), -k - 1))
            continue
        p = x[idx] @ tree.direction[k]
        todo.append((int(tree.child[k, 0]), idx[p <= tree.high[k]]))
        todo.append((int(tree.child[k, 1]), idx[p >= tree.low[k]]))
    return np.concatenate(rows), np.concatenate(leaves)


@dataclass
class Balls:
    """Centres, the tight ones first; cosines from which on a row is a member, and may link with one."""

    centres: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    tight: int


def fit_balls(x: np.ndarray, s: Settings) -> Balls:
    """Centres of groups that hold a share of the sample, the fullest first: tight ones, none inside another's ball, and
    of what these leave wide ones, where a complete comparison makes no more than 1 / dense comparisons for each link."""
    x = x[:s.ball_sample]
    angle = math.acos(s.threshold)
    cos = lambda a: math.cos(min(a, math.pi))
    half, least = cos(angle / 2) + 1e-9, max(16, s.ball_share * len(x))
    near = np.zeros((len(x), len(x)), bool)
    count = np.zeros(len(x))
    for k in range(0, len(x), 512):
        c = x[k:k + 512] @ x.T
        count[k:k + 512] = (c >= half).sum(axis=1)
        near[k:k + 512] = c >= s.threshold
    free, centres = np.ones(len(x), bool), []
    untried = free.copy()
    while len(x):
        k = int(np.argmax(np.where(untried, count, 0)))
        if not untried[k] or count[k] < least:
            break
        inside = x @ x[k] >= half
        if (inside & free).sum() < least:
            untried[k] = False
            continue
        centres.append(x[k])
        free &= ~inside
        untried &= ~inside
    tight = len(centres)
    untried = free.copy()
    while untried.any():
        count = near[:, free].sum(axis=1)
        k = int(np.argmax(np.where(untried, count, 0)))
        if not untried[k] or count[k] < least:
            break
        inside = near[k] & free
        for _ in range(2):  # the mean of a spread group is nearer to all of it than any member
            centre = x[inside].sum(axis=0)
            centre /= np.sqrt(centre @ centre)
            to = x @ centre
            if not (free & (to >= s.threshold)).any():
                break
            inside = free & (to >= s.threshold)
        m, all_near = inside.sum(), (to >= cos(2 * angle)).sum()
        links = (near[inside][:, inside].sum() - m) / 2
        untried &= ~(near[k] | inside)
        if m >= least and s.dense * m * (m / 2 + all_near - m) <= links:
            centres.append(centre)
            free &= ~inside
            untried &= free
    wide = len(centres) - tight
    return Balls(np.array(centres) if centres else np.zeros((0, x.shape[1])), np.array([half] * tight + [s.threshold] * wide),
                 np.array([cos(1.5 * angle) - 1e-9] * tight + [cos(2 * angle) - 1e-9] * wide), tight)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that each row reaches over the pairs."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
        while (root[root] != root).any():
            root = root[root]
    return root


FOUND = "k long, to long, links long"


def _result(k, to, links):
    return pa.table({"k": pa.array(k, pa.int64()), "to": pa.array(to, pa.int64()), "links": pa.array(links, pa.int64())})


FEW = 1 << 15  # links of a block that are taken one by one


def _joined(root: np.ndarray, near: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that each row reaches, with the links of a block of rows a and b put in."""
    while True:
        apart = near & (root[a][:, None] != root[b][None, :])
        n = np.count_nonzero(apart)
        if not n:
            return root
        if n > FEW:  # the first of each row and column; what stays apart comes again
            p, q = np.flatnonzero(apart.any(axis=1)), np.flatnonzero(apart.any(axis=0))
            p, q = np.concatenate([p, apart.argmax(axis=0)[q]]), np.concatenate([apart.argmax(axis=1)[p], q])
        else:
            p, q = np.nonzero(apart)
        root = _forest(len(root), root[a[p]], root[b[q]])[root]


NONE = np.iinfo(np.int64).max


def _met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two blocks have a leaf in common."""
    common = np.intersect1d(a, b)
    common = common[common != NONE]
    if not len(common):
        return np.zeros((len(a), len(b)), bool)

    def marks(codes):
        at = np.minimum(np.searchsorted(common, codes), len(common) - 1)
        row, i = np.nonzero(common[at] == codes)
        out = np.zeros((len(codes), len(common)), np.float32)
        out[row, at[row, i]] = 1
        return out

    return marks(a) @ marks(b).T > 0


def _compare(dim: int, threshold: float):
    """Two chunks i and j of a ball or leaf, or one with itself, to: links found here and in no earlier leaf, and a row to
    be joined with."""

    def run(t: pa.Table) -> pa.Table:
        k, size, chunk = np.asarray(t["k"]), np.asarray(t["size"]), np.asarray(t["chunk"])
        x = matrix(t["v"].combine_chunks(), dim)
        own, i, j = (t[c][0].as_py() for c in ("leaf", "i", "j"))
        lists = t["leaves"].combine_chunks()
        count = np.diff(np.asarray(lists.offsets))
        width = int(count.max())
        codes = np.full((len(k), width), NONE)
        codes[np.arange(width) < count[:, None]] = np.asarray(lists.flatten())
        codes[codes >= own] = NONE
        left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        links, root = np.zeros(len(k), np.int64), np.arange(len(k))
        for u in range(0, len(left), 1024):
            for w in range(u if i == j else 0, len(right), 1024):
                a, b = left[u:u + 1024], right[w:w + 1024]
                near = x[a] @ x[b].T >= threshold
                if i == j and u == w:
                    near = np.triu(near, 1)
                n = np.count_nonzero(near)
                if not n:
                    continue
                root = _joined(root, near, a, b)
                if n > FEW:
                    if width:
                        near &= ~_met(codes[a], codes[b])
                    links[a] += np.rint(near @ size[b].astype(np.float64)).astype(np.int64)
                    links[b] += np.rint(size[a].astype(np.float64) @ near).astype(np.int64)
                    continue
                p, q = np.nonzero(near)
                p, q = a[p], b[q]
                seen = np.zeros(len(p), bool)
                for c in range(width):
                    early = (codes[p, c] != NONE) & ~seen
                    if early.any():
                        seen[early] = (codes[q[early]] == codes[p[early], c][:, None]).any(axis=1)
                p, q = p[~seen], q[~seen]
                links += np.bincount(p, size[q], len(k)).astype(np.int64) + np.bincount(q, size[p], len(k)).astype(np.int64)
        use = (links > 0) | (root != np.arange(len(k)))
        return _result(k[use], k[root[use]], links[use])

    return run


def _chunks(n, least: int, dim: int, s: Settings):
    """Number of chunks for n rows."""
    most = max(least, s.chunk_bytes // (8 * dim))
    return F.ceil(n / F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(n / s.parts)))).cast("int")


def _blocks(rows: DataFrame) -> DataFrame:
    """A row with its chunk and an array of others, to a row for each pair i <= j of its chunk and another."""
    return rows.withColumn("other", F.explode("others")).select(
        "k", "leaf", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))


def _density(dim: int, threshold: float):
    """Sampled rows of a leaf to the share of their pairs that link."""

    def run(t: pa.Table) -> pa.Table:
        share = linked_share(matrix(t["v"].combine_chunks(), dim), threshold)
        return pa.table({"leaf": t["leaf"].combine_chunks()[:1], "share": pa.array([share], pa.float64())})

    return run


def _place(dim: int, handle):
    """Rows to (k, tree, leaf) for each leaf, and (k, -1, ball) for a ball's member, (k, -2, ball) for one near it."""

    def run(batches):
        trees, balls = handle.value
        centres = balls.centres
        for b in batches:
            if not b.num_rows:
                continue
            k, x = np.asarray(b.column(0)), matrix(b.column(1), dim)
            ks, ts, ls = [], [], []
            free = np.ones(len(k), bool)
            if len(centres):
                cos = x @ centres.T
                first = (cos >= balls.inner).argmax(axis=1)
                inner = cos[np.arange(len(k)), first] >= balls.inner[first]
                free = ~inner
                ks.append(k[inner])
                ts.append(np.full(inner.sum(), -1))
                ls.append(first[inner])
                # a member of an earlier ball meets this one's members there
                row, ball = np.nonzero((cos >= balls.outer) & (~inner[:, None] | (first[:, None] > np.arange(len(centres)))))
                ks.append(k[row])
                ts.append(np.full(len(row), -2))
                ls.append(ball)
            own = np.flatnonzero(free)
            for t, tree in enumerate(trees):
                row, leaf = drop(tree, x[own])
                ks.append(k[own[row]])
                ts.append(np.full(len(row), t))
                ls.append(leaf)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ks), pa.int64()), pa.array(np.concatenate(ts), pa.int64()),
                                              pa.array(np.concatenate(ls), pa.int64())], names=["k", "tree", "leaf"])

    return run


def _project(dim: int):
    """(k, leaf, vector) to (k, leaf, projection on a direction that the leaf's name gives)."""

    def run(batches):
        for b in batches:
            k, leaf = np.asarray(b.column(0)), np.asarray(b.column(1))
            p = np.zeros(len(k))
            if len(k):
                x = matrix(b.column(2), dim)
                for code in np.unique(leaf):
                    at = leaf == code
                    p[at] = x[at] @ np.random.default_rng(int(code) & ((1 << 63) - 1)).standard_normal(dim)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p)], names=["k", "leaf", "p"])

    return run


def _split_full(placed: DataFrame, rows: DataFrame, dim: int, s: Settings, rounds: int = 64) -> DataFrame:
    """(k, leaf): leaves over the limit split by their own directions, until none is but dense ones."""
    done = None
    for _ in range(rounds):
        over = written(placed.groupBy("leaf").count().where(F.col("count") > s.leaf_limit), "full_leaves")
        if over.isEmpty():
            return placed if done is None else done.unionByName(placed)
        # some 256 rows of each leaf
        some = placed.join(over, "leaf").where(F.pmod(F.xxhash64(F.lit(s.seed), "leaf", "k"), F.col("count")) < 256)
        share = some.join(rows.select("k", "v"), "k").select("leaf", "v").groupBy("leaf").applyInArrow(
            _density(dim, s.threshold), "leaf long, share double")
        dense = written(share.where(F.col("share") >= s.dense).select("leaf"), "dense_leaves")
        full = over.select("leaf").join(dense, "leaf", "left_anti")
        fit = placed.join(full, "leaf", "left_anti")
        done = fit if done is None else done.unionByName(fit)
        p = placed.join(full, "leaf").join(rows.select("k", "v"), "k").select("k", "leaf", "v")
        p = written(A.map_arrow(p, _project(dim), "k long, leaf long, p double"), "projected")
        cut = p.groupBy("leaf").agg(F.percentile_approx("p", [0.5 - s.spill, 0.5 + s.spill], 1000).alias("q"))
        cut = written(cut.select("leaf", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi")), "cuts")
        side = F.when(F.col("lo") == F.col("hi"), F.array(F.pmod(F.xxhash64("k", "leaf"), F.lit(2)).cast("int"))).otherwise(
            F.concat(F.when(F.col("p") <= F.col("hi"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")),
                     F.when(F.col("p") >= F.col("lo"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))))
        placed = written(p.join(cut, "leaf").select("k", "leaf", F.explode(side).alias("side"))
                         .select("k", F.xxhash64("leaf", "side").alias("leaf")), "split")
    raise RuntimeError("leaves stay over the limit")


def _of_one_length(rows: DataFrame, dim: int, s: Settings) -> DataFrame:
    """(k, to, links) found among distinct vectors (k, v, size) of one length."""
    spark = rows.sparkSession
    n = rows.count()
    most = max(256, min(s.sample, s.sample_bytes // (8 * dim)))
    ids = rows.select("k").orderBy(F.xxhash64(F.lit(s.seed), "k"), "k").limit(most)
    got = rows.join(F.broadcast(ids), "k").select("k", "v").toArrow()  # at most ``most`` rows, in Arrow's columns
    got = got.take(np.argsort(np.asarray(got["k"]), kind="stable"))["v"]
    x = matrix(got.combine_chunks(), dim) if len(got) else np.zeros((0, dim))
    del got
    rng = np.random.default_rng(s.seed)
    x = x[rng.permutation(len(x))]
    balls = fit_balls(x, s)
    loose = x[(x @ balls.centres.T < balls.inner).all(axis=1)] if len(balls.centres) else x
    trees = [fit_tree(loose, max(1, round(n * len(loose) / len(x))), s, rng) for _ in range(s.trees)] if len(loose) else []
    if not trees:
        trees = [fit_tree(x, n, s, rng)]
    handle = spark.sparkContext.broadcast((trees, balls))
    placed = written(A.map_arrow(rows.select("k", "v"), _place(dim, handle), "k long, tree long, leaf long"), "placed")

    # tight balls: all members are linked with each other
    member = placed.where("tree = -1").select("k", "leaf")
    sizes = rows.select("k", "size")
    total = written(member.join(sizes, "k").groupBy("leaf").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("members"),
                                                                F.min("k").alias("to")), "balls")  # a row for each centre
    tight = F.col("leaf") < balls.tight
    of_ball = member.where(tight).join(sizes, "k").join(F.broadcast(total), "leaf").select("k", "to", (F.col("total") - F.col("size")).alias("links"))
    # members in chunks 0 to p - 1, what is near them in chunks p to p + q - 1
    near = placed.where("tree = -2").select("k", "leaf")
    p, q = F.col("p"), F.col("q")
    met = written(total.join(near.groupBy("leaf").agg(F.count(F.lit(1)).alias("near")), "leaf", "left").select(
        "leaf", _chunks(F.col("members"), s.chunk, dim, s).alias("p"),
        F.coalesce(_chunks(F.col("near"), s.chunk, dim, s), F.lit(0)).alias("q")), "met_balls")
    met = F.broadcast(met)
    own, outside = F.sequence(F.lit(0), p - 1), F.when(q > 0, F.sequence(p, p + q - 1)).otherwise(F.array().cast("array<int>"))
    inner = member.join(met, "leaf").select("k", "leaf", F.pmod(F.xxhash64("k"), p).cast("int").alias("chunk"),
                                            F.when(tight, outside).otherwise(F.concat(own, outside)).alias("others"))
    outer = near.join(met, "leaf").select("k", "leaf", (p + F.pmod(F.xxhash64("k"), q)).cast("int").alias("chunk"), own.alias("others"))
    across = (_blocks(inner.unionByName(outer)).withColumn("leaves", F.array().cast("array<long>")).join(rows, "k")
              .groupBy("leaf", "i", "j").applyInArrow(_compare(dim, s.threshold), FOUND))

    # leaves: a leaf's code orders first by tree
    in_leaf = placed.where("tree >= 0").select("k", (F.col("tree") * s.max_leaves * 2 + F.col("leaf")).alias("leaf"))
    in_leaf = _split_full(in_leaf, rows, dim, s)
    large = written(in_leaf.groupBy("leaf").count().where(F.col("count") > s.leaf_limit).select(
        "leaf", _chunks(F.col("count"), s.leaf_limit, dim, s).alias("p")), "large_leaves")
    whole = in_leaf.join(large, "leaf", "left").select("k", "leaf", F.coalesce("p", F.lit(1)).alias("p"))
    parts = _blocks(whole.select("k", "leaf", F.pmod(F.xxhash64("k", "leaf"), p).cast("int").alias("chunk"), F.sequence(F.lit(0), p - 1).alias("others")))
    full_rows = in_leaf.groupBy("k").agg(F.sort_array(F.collect_set("leaf")).alias("leaves")).join(rows, "k")
    inside = parts.join(full_rows, "k").groupBy("leaf", "i", "j").applyInArrow(_compare(dim, s.threshold), FOUND)
    return of_ball.unionByName(across).unionByName(inside)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    settings: Settings = Settings()) -> DataFrame:
    """(id, n_links, component_id, kept): a row for each row of ``vectors``. Equal vectors are linked with each other; a
    null id never names a component unless all ids of it are null."""
    A.ship(vectors.sparkSession)
    C.use_checkpoint_dir(vectors.sparkSession)
    v = F.col("v")
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    usable = v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda e: e != 0)
    every = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).select(
        "id", F.coalesce(usable, F.lit(False)).alias("ok"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), "v")
    good = every.where("ok").groupBy("h1", "h2").agg(F.any_value("v").alias("v"), F.count(F.lit(1)).alias("size"), F.min("id").alias("least"))
    rows = written(good.withColumn("k", F.monotonically_increasing_id()), "vectors")
    dims = [r[0] for r in rows.select(F.size("v")).distinct().collect()]
    found = None
    for d in sorted(dims):
        one = _of_one_length(rows.where(F.size("v") == d).select("k", "v", "size"), d, settings)
        found = one if found is None else found.unionByName(one)
    key = rows.select("k", "h1", "h2", "size", "least")
    if found is None:
        marks = key.select("h1", "h2", F.lit(0).cast("long").alias("n_links"), F.col("least").alias("component_id"))
    else:
        found = written(found, "links")
        links = found.groupBy("k").agg(F.sum("links").alias("links"))
        joined = C.components(found.select("k", "to"), "k", "to").withColumnRenamed("node", "k")
        rooted = written(key.join(links, "k", "left").join(joined, "k", "left").select(
            "h1", "h2", "least", F.coalesce("component", "k").alias("root"),
            (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")), "rooted")
        least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
        marks = written(rooted.join(least, "root").select("h1", "h2", "n_links", "component_id"), "marks")
    good_rows = every.where("ok").select("id", "h1", "h2").join(marks, ["h1", "h2"]).select("id", "n_links", "component_id")
    none = every.where(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = good_rows.unionByName(none)
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
