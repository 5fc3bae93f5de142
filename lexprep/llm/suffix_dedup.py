"""Suffix-array dedup: bytes covered by a string of ``MIN`` bytes that starts at two places.

A window is a string of MIN bytes of one text. It is removed if an equal one
starts elsewhere in the corpus. A suffix array of every byte is not needed
for that; the suffixes that matter are sorted by induction:

1. Sample. Each window chooses one of its grams of ``GRAM`` bytes, by content
   only (the least hash), as its anchor. Equal windows choose equal anchors.
   An anchor's domain is the text of all windows that chose it.
2. Only anchors whose gram occurs again can hold repeated windows. Anchors
   with equal gram and equal domain form a class; in a class of two or more
   every window is repeated.
3. What is left are classes of one whose gram occurs in another domain. Their
   sample suffixes, which start at the anchor, are sorted by Spark's external
   sort, the disk-backed queue of this method, and get the common prefix with
   their neighbour. From that order the order of the suffixes one byte further
   left is induced: sorted by that byte, ties in the order they had, common
   prefixes one longer than the least of those between. Level by level this
   reaches every window of the domain; it is repeated if the common prefix
   with a neighbour is MIN or more.
4. A gram with more than ``GROUP`` classes is not sorted in one task: its
   windows are counted by hash instead, pre-aggregated before the shuffle.

Tasks hold a batch of groups, never a shard, so a shard may be far larger
than memory. A gram that a third of all texts hold is counted by partial
sums and joined by splittable joins.

Null and empty texts have no bytes and lose none. Texts shorter than MIN
lose none. Equal texts of MIN bytes or more lose all their bytes. Equal rows
count as different places.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexprep.llm import arrow as A
from lexprep.llm.tables import written

MIN = 200
GRAM = 64
GROUP = 16384
PIECE = 512 << 10


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of x[i:i+w] for every i."""
    n, m = len(x), -(-len(x) // w) * w
    p = np.full(m, np.iinfo(x.dtype).max, x.dtype)
    p[:n] = x
    p = p.reshape(-1, w)
    ahead = np.minimum.accumulate(p, axis=1).ravel()
    back = np.minimum.accumulate(p[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - w + 1], ahead[w - 1:n])


def anchors(data: np.ndarray, offsets: np.ndarray, size: int = MIN, gram: int = GRAM):
    """(text, first window, windows, anchor - first window, gram hash, domain hash) of the anchors of some texts."""
    w = size - gram + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    lens = np.diff(offsets)
    long = np.flatnonzero(lens >= size)
    if not len(long):
        return none
    prefix = A.prefix_hash(data)
    g = A.gram_hash(prefix, gram)
    low = np.uint64((1 << 24) - 1)
    least = sliding_min((g & ~low) | np.arange(len(g), dtype=np.uint64), w)  # the first of equal grams
    inside = np.zeros(len(data) + 1, np.int32)
    np.add.at(inside, offsets[long], 1)
    np.add.at(inside, offsets[long + 1] - size + 1, -1)
    s = np.flatnonzero(np.cumsum(inside[:-1])[:len(least)] > 0)
    at = (least[s] & low).astype(np.int64)
    text = np.searchsorted(offsets, s, "right") - 1
    new = np.ones(len(s), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    f = np.flatnonzero(new)
    first, count, at, text = s[f], np.diff(np.append(f, len(s))), at[f], text[f]
    back = at - first
    domain = A.range_hash(prefix, first, first + count - 1 + size)
    with np.errstate(over="ignore"):
        domain = A.mix(domain + back.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + count.astype(np.uint64))
    return text, first - offsets[text], count, back, g[at].view(np.int64), domain.view(np.int64)


def pieces(data: np.ndarray, offsets: np.ndarray, size: int = MIN, limit: int = PIECE):
    """(first row, first byte, bytes, offsets): the texts in pieces of about ``limit`` bytes. A longer text comes in
    pieces that share size - 1 bytes, so each of its windows is in exactly one."""
    for i, j in A.chunks(offsets, limit):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= 2 * limit:
            yield i, 0, data[a:b], offsets[i:j + 1] - a
        else:  # one long text
            for k in range(a, max(a + 1, b - size + 1), limit):
                e = min(k + limit + size - 1, b)
                yield i, k - a, data[k:e], np.array([0, e - k])


ANCHOR = A.struct(rid="long", first="long", shape="int", gram="long", domain="long", h1="long", h2="long")


def sample(docs: DataFrame, id_col: str, text_col: str, size: int, gram: int) -> DataFrame:
    """Every anchor: row number, first window, (back << 8 | windows), gram, domain; on the first anchor of a text
    also the text's 128-bit hash and its id."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.xxhash64(text_col).alias("h1"),
                       F.xxhash64(F.lit(1), F.col(text_col)).alias("h2"), F.col(id_col).alias("id"),
                       F.col(text_col).alias("text"))
    schema = T.StructType(ANCHOR.fields + [T.StructField("id", docs.schema[id_col].dataType)])

    def run(batches):
        for b in batches:
            data, offsets = A.text_buffer(b.column(4))
            rid = np.asarray(b.column(0))
            for i, shift, part, offs in pieces(data, offsets, size):
                text, first, count, back, g, d = anchors(part, offs, size, gram)
                if not len(text):
                    continue
                row = text + i
                head = np.ones(len(row), bool)
                head[1:] = row[1:] != row[:-1]
                head &= shift == 0
                take = pa.array(np.where(head, row, 0), pa.int64(), mask=~head)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid[row]), pa.array(first + shift), pa.array((back << 8 | count).astype(np.int32)),
                     pa.array(g), pa.array(d), b.column(1).take(take), b.column(2).take(take), b.column(3).take(take)],
                    names=[f.name for f in schema.fields])

    return A.map_arrow(rows, run, schema)


def _lcp(m: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Common prefix of each row of a byte matrix with the row before (0 for the first)."""
    out = np.zeros(len(m), np.int64)
    if len(m) > 1:
        differ = m[1:] != m[:-1]
        at = np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1])
        out[1:] = np.minimum(at, np.minimum(lens[1:], lens[:-1]))
    return out


def _least_between(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least of values[a[i]+1 .. b[i]] for each i (a < b)."""
    table, k = [values], 1
    while 2 * k <= len(values):
        table.append(np.minimum(table[-1][:-k], table[-1][k:]))
        k *= 2
    n = b - a
    level = np.frexp(n)[1] - 1
    out = np.empty(len(a), values.dtype)
    for q in np.unique(level):
        at = level == q
        out[at] = np.minimum(table[q][a[at] + 1], table[q][b[at] - (1 << int(q)) + 1])
    return out


def induce(group: np.ndarray, domains: list[bytes], back: np.ndarray, count: np.ndarray, size: int = MIN) -> np.ndarray:
    """Which windows are repeated in another domain of their group: a row for each domain, a column for the distance
    from window to anchor.

    Domains come sorted by group and by the bytes from the anchor on."""
    n, depth = len(domains), int(back.max()) if len(back) else 0
    hit = np.zeros((n, depth + 1), bool)
    if not n:
        return hit
    rights = [d[b:] for d, b in zip(domains, back)]
    width = max(map(len, rights))
    m = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rights), np.uint8).reshape(n, width)
    left = np.frombuffer(b"".join(d[:b][::-1].ljust(max(depth, 1), b"\0") for d, b in zip(domains, back)),
                         np.uint8).reshape(n, max(depth, 1))
    order = np.arange(n)
    lcp = _lcp(m, np.array([len(r) for r in rights]))
    lcp[1:][group[1:] != group[:-1]] = -1
    lcp[0] = -1
    least = back - count + 1  # nearest window of each domain
    block = group
    for d in range(depth + 1):
        if d:
            alive = np.flatnonzero(back[order] >= d)  # the others have no window so far left
            byte = left[order[alive], d - 1]
            by = np.lexsort((byte, block[alive]))  # stable: ties keep the order of the suffixes to their right
            at = alive[by]
            same = np.zeros(len(at), bool)
            if len(at) > 1:
                same[1:] = (block[at][1:] == block[at][:-1]) & (byte[by][1:] == byte[by][:-1])
            new = np.full(len(at), -1, np.int64)
            j = np.flatnonzero(same)
            if not len(j):
                break  # no two suffixes agree any more
            new[j] = 1 + _least_between(lcp, at[j - 1], at[j])
            # suffixes that agree with no neighbour so far left never will again
            keep = same.copy()
            keep[:-1] |= same[1:]
            order, lcp, block = order[at][keep], new[keep], np.cumsum(~same)[keep]
        near = np.maximum(lcp, np.append(lcp[1:], -1)) >= size
        rows = order[near & (least[order] <= d)]
        hit[rows, d] = True
    return hit


SPAN = "rid long, lo long, hi long"


def _induced_spans(size: int):
    """Batches of domains, sorted by gram and right context, to spans of repeated windows."""

    def solve(t: pa.Table):
        gram, rid = np.asarray(t["gram"]), np.asarray(t["rid"])
        first, shape, alone = np.asarray(t["first"]), np.asarray(t["shape"]), np.asarray(t["n"]) == 1
        back, count = (shape >> 8).astype(np.int64), (shape & 255).astype(np.int64)
        hit = induce(gram, t["dom"].to_pylist(), back, count, size)
        hit[~alone] = False
        # runs of windows, from the leftmost
        row, dist = np.nonzero(hit[:, ::-1])
        dist = hit.shape[1] - 1 - dist
        s = first[row] + back[row] - dist
        new = np.ones(len(s), bool)
        new[1:] = (row[1:] != row[:-1]) | (s[1:] != s[:-1] + 1)
        f = np.flatnonzero(new)
        e = np.append(f[1:], len(s)) - 1
        return pa.RecordBatch.from_arrays([pa.array(rid[row[f]]), pa.array(s[f]), pa.array(s[e] + size if len(f) else s)],
                                          names=["rid", "lo", "hi"])

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            gram = np.asarray(held["gram"])
            other = np.flatnonzero(gram != gram[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut >= 2000:  # whole groups only; the last one may go on
                yield solve(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and len(held):
            yield solve(held)

    return run


PART = "kind int, gram long, domain long, rid long, first long, shape int, n long, dom binary, win long"


def _domains(size: int):
    """Text and its domains of interest to the domains' bytes, or to window hashes where the gram is crowded."""

    def run(batches):
        names = [x.split()[0] for x in PART.split(", ")]
        for b in batches:
            out = {x: [] for x in names}
            data, offsets = A.text_buffer(b.column(0))
            for k, want in enumerate(b.column(1).to_pylist()):
                text = data[offsets[k]:offsets[k + 1]]
                for w in want:
                    count = w["shape"] & 255
                    dom = text[w["first"]:w["first"] + count - 1 + size]
                    if w["crowded"]:
                        h = A.gram_hash(A.prefix_hash(dom), size).view(np.int64)
                        rows = [(1, w["gram"], w["domain"], w["rid"], w["first"] + i, 0, w["n"], None, int(x)) for i, x in enumerate(h)]
                    else:
                        rows = [(0, w["gram"], w["domain"], w["rid"], w["first"], w["shape"], w["n"], dom.tobytes(), 0)]
                    for r in rows:
                        for x, v in zip(names, r):
                            out[x].append(v)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(out[x], t) for x, t in zip(names, kinds)], names=names)

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = MIN,
                   gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(h1, h2, whole, spans): for each text hash with repeated windows, the byte spans they cover, unmerged; ``whole``
    if the text itself occurs again."""
    every = written(sample(docs, id_col, text_col, size, gram), "anchors")
    texts = every.where(F.col("h1").isNotNull()).select("rid", "h1", "h2", "id")
    same = texts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("id"), F.min("rid").alias("rid"))
    same = written(same, "texts")
    once = same.where("copies = 1").select("rid", "h1", "h2")

    grams = written(every.groupBy("gram").count().where("count > 1").select("gram"), "grams")
    again = written(every.select("rid", "first", "shape", "gram", "domain").join(grams, "gram"), "again")
    classes = written(again.groupBy("gram", "domain").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("rid")), "classes")
    shared = classes.where("n > 1").select("gram", "domain")
    full = again.join(shared, ["gram", "domain"]).select(
        "rid", F.col("first").alias("lo"), (F.col("first") + F.col("shape").bitwiseAND(255) - 1 + size).alias("hi"))

    # grams with a class of one beside another class
    mixed = written(classes.groupBy("gram").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("fewest"))
                    .where("c > 1 and fewest = 1").select("gram", (F.col("c") > group).alias("crowded")), "mixed")
    reps = (classes.join(mixed, "gram")
            .join(again.select("rid", "gram", "domain", "first", "shape"), ["rid", "gram", "domain"])
            .dropDuplicates(["gram", "domain"]))
    one = texts.join(same.select("h1", "h2", F.col("id").alias("one"), "copies"), ["h1", "h2"]).select("rid", "h1", "h2", "one")
    wanted = written(reps.join(one, "rid").groupBy("h1", "h2", "one").agg(F.collect_list(F.struct(
        "gram", "domain", "rid", "first", "shape", "n", "crowded")).alias("want")), "wanted")
    d = docs.select(F.xxhash64(text_col).alias("h1"), F.xxhash64(F.lit(1), F.col(text_col)).alias("h2"),
                    F.col(id_col).alias("own"), F.col(text_col).alias("text")).where(F.octet_length("text") >= size)
    at = d.join(wanted, ["h1", "h2"]).where(F.col("own").eqNullSafe(F.col("one"))).select("text", "want")
    parts = written(A.map_arrow(at, _domains(size), PART), "domains")

    # ordinary grams: sorted by Spark, then induced
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    from_anchor = F.expr("substring(dom, 1 + shiftright(shape, 8))")
    line = (parts.where("kind = 0").select("gram", "rid", "first", "shape", "n", "dom")
            .repartition(n_parts, "gram").sortWithinPartitions(F.col("gram"), from_anchor))
    fine = A.map_arrow(line, _induced_spans(size), SPAN)
    # crowded grams: windows that occur in two classes
    windows = parts.where("kind = 1").select("gram", "win", "domain", "rid", "first", "n")
    twice = written(windows.groupBy("gram", "win").agg(F.min("domain").alias("x"), F.max("domain").alias("y"))
                    .where("x <> y").select("gram", "win"), "windows")
    crowd = windows.where("n = 1").join(twice, ["gram", "win"]).select(
        "rid", F.col("first").alias("lo"), (F.col("first") + size).alias("hi"))

    spans = full.unionByName(fine).unionByName(crowd).join(once, "rid")
    spans = (spans.groupBy("h1", "h2", "lo").agg(F.max("hi").alias("hi")).groupBy("h1", "h2")
             .agg(F.collect_list(F.struct("lo", "hi")).alias("spans")).select("h1", "h2", F.lit(False).alias("whole"), "spans"))
    copies = same.where("copies > 1").select("h1", "h2", F.lit(True).alias("whole"), F.array().cast(spans.schema["spans"].dataType).alias("spans"))
    return written(spans.unionByName(copies), "spans")


CUT = A.struct(n_bytes="long", n_removed="long", n_spans="long", kept_sha256="string", kept="string")


def merge(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes in any span."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(lo, hi)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def without_repeats(docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text", size: int = MIN,
                    keep_text: bool = True, **options) -> DataFrame:
    """``docs`` and a struct ``name``: bytes before, bytes and maximal runs removed, SHA-256 of the bytes that are left,
    and (if ``keep_text``) these as text. A character that a cut has broken is left out of that text."""
    spans = repeated_spans(docs, id_col, text_col, size, **options)
    marks, a, b = (A.free_name(docs, x) for x in ("spans_", "h1_", "h2_"))
    found = spans.select(F.col("h1").alias(a), F.col("h2").alias(b), F.struct("whole", "spans").alias(marks))
    rows = (docs.withColumn(a, F.xxhash64(text_col)).withColumn(b, F.xxhash64(F.lit(1), F.col(text_col)))
            .join(found, [a, b], "left").select(*docs.columns, marks))
    at, n = docs.columns.index(text_col), len(docs.columns)
    out = T.StructType(docs.schema.fields + [T.StructField(name, CUT, False)])

    def run(batches):
        for batch in batches:
            data, offsets = A.text_buffer(batch.column(at))
            got = []
            for k, mark in enumerate(batch.column(n).to_pylist()):
                text = data[offsets[k]:offsets[k + 1]]
                runs, left = [], text.tobytes()
                if mark and mark["whole"]:
                    runs, left = [(0, len(text))], b""
                elif mark:
                    runs = merge([s["lo"] for s in mark["spans"]], [s["hi"] for s in mark["spans"]])
                    edges = [0, *(x for r in runs for x in r), len(text)]
                    left = b"".join(left[edges[i]:edges[i + 1]] for i in range(0, len(edges), 2))
                got.append({"n_bytes": len(text), "n_removed": len(text) - len(left), "n_spans": len(runs),
                            "kept_sha256": hashlib.sha256(left).hexdigest(),
                            "kept": left.decode("utf-8", "ignore") if keep_text else None})
            kind = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                              ("kept_sha256", pa.string()), ("kept", pa.string())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(got, kind)], names=[f.name for f in out.fields])

    return A.map_arrow(rows, run, out)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars",
                **options) -> DataFrame:
    """The documents with repeated bytes cut from their texts, with the columns they came with. A null text stays
    null. ``length_col``, if there, gets the new number of characters."""
    name = A.free_name(docs, "cut")
    got = without_repeats(docs, name, id_col, text_col, **options)
    kept: Column = F.when(F.col(text_col).isNull(), F.lit(None).cast("string")).otherwise(F.col(name)["kept"])
    cols = {text_col: kept}
    if length_col in docs.columns:
        cols[length_col] = F.when(F.col(name)["n_removed"] > 0, F.length(kept).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col))
    return got.withColumns(cols).select(*docs.columns)
