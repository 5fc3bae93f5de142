"""The digest index against brute force, over several batches, repeated batches and odd rows."""

import hashlib
import tempfile

from lexprep.llm import exact_dedup as E

SCHEMA = "doc_id long, text string, digest_of_text string, `a.b` int, n int"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "own", 7, k) for k, (i, t) in enumerate(rows)], SCHEMA)


def _index(spark, buckets=4):
    return E.open_index(spark, tempfile.mkdtemp(prefix="digest-index-") + "/x", buckets)


def _brute(batches):
    """(id, text) rows of each batch to their marks."""
    first, out = {}, []
    for rows in batches:
        best, size = {}, {}
        for i, t in rows:
            t = t or ""
            size[t] = size.get(t, 0) + 1
            best[t] = i if t not in best or best[t] is None else best[t] if i is None else max(best[t], i)
        known = set(first)
        for t in best:
            first.setdefault(t, best[t])
        out.append(sorted([(i, hashlib.sha256((t or "").encode()).hexdigest(), first[t or ""], size[t or ""], (t or "") in known,
                            (t or "") not in known and i == first[t or ""]) for i, t in rows], key=str))
    return out


def _got(df):
    return sorted([(r["id"], bytes(r["digest"]).hex(), r["keep_id"], r["group_size"], r["known"], r["kept"]) for r in df.collect()], key=str)


BATCHES = [
    [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "é" * 70000), (2, "b"), (None, "only null"), (None, "a")],
    [(10, "b"), (11, "new"), (12, "new"), (13, ""), (14, "é" * 70000 + "x")],
    [],
    [(20, "new"), (21, "last")] + [(30 + k, "hot") for k in range(3000)],
]


def test_batches_equal_brute_force(spark):
    index = _index(spark)
    for k, (rows, want) in enumerate(zip(BATCHES, _brute(BATCHES))):
        assert _got(E.ingest(_docs(spark, rows), index, f"b{k}")) == want
    digests = [bytes(r["digest"]) for r in index.rows().collect()]
    assert len(digests) == len(set(digests)) == len({t or "" for b in BATCHES for _, t in b})


def test_a_batch_taken_in_again_gives_the_same_answer(spark):
    index = _index(spark)
    want = _brute(BATCHES[:2])
    for k in (0, 1, 1, 0):
        assert _got(E.ingest(_docs(spark, BATCHES[k]), index, f"b{k}")) == want[k]


def test_new_documents_keep_all_columns(spark):
    index = _index(spark)
    docs = _docs(spark, BATCHES[0])
    E.ingest(docs, index, "b0")
    got = E.new_documents(docs, index, "b0")
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in got.where("doc_id is not null and text is not null").collect()) == [
        (2, "b"), (3, "a"), (5, ""), (6, "é" * 70000)]
    assert got.where("doc_id is null").select("text").collect() == [("only null",)]
    assert got.count() == 5 and got.where("digest_of_text = 'own'").count() == 5


def test_reopened_and_compacted_index_knows_its_texts(spark):
    index = _index(spark)
    E.ingest(_docs(spark, BATCHES[0]), index, "b0")
    E.ingest(_docs(spark, BATCHES[1]), index, "b1")
    spark.sql(f"DROP TABLE {index.table}")  # as in a new session: the data stays in its folder
    again = E.open_index(spark, index.path, 999)
    assert again.buckets == 4 and again.rows().count() == index.rows().count()
    small = E.compact(again, index.path + "-compact", 2)
    assert small.rows().count() == again.rows().count()
    for x in (again, small):
        got = E.ingest(_docs(spark, [(50, "new"), (51, "unheard of")]), x, "b9")
        assert {(r["id"], r["keep_id"], r["known"], r["kept"]) for r in got.collect()} == {(50, 12, True, False), (51, 51, False, True)}


def test_normal_form(spark):
    from pyspark.sql import functions as F
    got = E.ingest(_docs(spark, [(1, " A"), (2, "a")]), _index(spark), "b", normal=lambda c: F.lower(F.trim(c)))
    assert {r["keep_id"] for r in got.collect()} == {2}


def test_anti_join_leaves_the_index_in_its_buckets(spark):
    index = _index(spark)
    E.ingest(_docs(spark, BATCHES[0]), index, "b0")
    groups = spark.createDataFrame([(b"x", 1, 1)], "digest binary, keep_id long, n long")
    plan = E.unseen(groups, index, "b1")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and plan.count("Exchange hashpartitioning") == 1
    assert "Bucketed: true" in plan
