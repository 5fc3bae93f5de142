"""Callers' columns named like ours, or with a dot, come through unchanged."""

import time

import pytest

from lexprep.llm import decontaminate as D
from lexprep.llm import license_scan as N
from lexprep.llm import simhash as S
from lexprep.llm import url_reputation as U

NAMES = ["judged", "s_", "m_", "spans_of_all", "matches_of_all", "row_key", "contamination", "licence", "arr_of_scan", "hits_of_scan",
         "agreed_of_scan", "first_of_scan", "found_of_scan", "base_of_scan", "c_url", "host", "path", "rule", "fixed", "bad", "share",
         "bound", "id", "th", "fp", "root", "k_", "h_", "d", "k", "t", "x", "f", "a.b", "with`tick", "least"]


@pytest.fixture(scope="module")
def table(spark):
    texts = ["permission is hereby granted free of charge " * 3, "one two three four five six seven", "one two three four five six seven", None, ""]
    rows = [(k, t, f"http://h{k}.net/x", *[f"{c}{k}" for c in NAMES]) for k, t in enumerate(texts)]
    fields = ", ".join(f"`{c.replace('`', '``')}` string" for c in NAMES)
    return spark.createDataFrame(rows, f"doc_id long, text string, url string, {fields}")


def _own(df, table, extra=0):
    """Rows by id with the caller's columns."""
    assert df.columns[:len(table.columns)] == table.columns and len(df.columns) == len(table.columns) + extra
    return {r["doc_id"]: tuple(r)[:len(table.columns)] for r in df.collect()}


def test_scan(table):
    got = N.scan(table)
    assert _own(got, table, 1) == _own(table, table) and got.columns[-1] == "licence_"


def test_reputation(table):
    got = U.judged(table)
    assert _own(got, table, 1) == _own(table, table) and got.columns[-1] == "judged_"
    assert U.keep_allowed(table).columns == table.columns


def test_simhash(table):
    got = _own(S.keep_one(table), table)
    assert set(got) == {0, 1, 3} and all(got[k] == v for k, v in _own(table, table).items() if k in got)


@pytest.mark.parametrize("block_bytes", [1 << 20, 8])
def test_contamination(spark, table, block_bytes):
    bench = spark.createDataFrame([(1, "four five six"), (2, "granted free"), (3, "nothing of it")], "item_id long, text string")
    got = D.contamination(table, bench, block_bytes=block_bytes)
    assert _own(got, table, 1) == _own(table, table)
    assert {r["doc_id"]: r[-1]["n_hit"] for r in got.collect()} == {0: 6, 1: 3, 2: 3, 3: 0, 4: 0}
    assert set(_own(D.remove_contaminated(table, bench, block_bytes=block_bytes), table)) == {3, 4}


def test_many_notices_in_one_text_take_time_in_proportion(spark):
    """Each notice is found once, however many there are."""
    label, text, _ = N.TEMPLATES[0]
    took = {}
    for n in (1_000, 16_000):
        docs = spark.createDataFrame([(1, (text + " ") * n)], "doc_id long, text string")
        began = time.time()
        row = N.scan(docs, "x").select("x.found").first()["found"]
        took[n] = time.time() - began
        own = [f["first_word"] for f in row if f["label"] == label and f["share"] == 1.0]
        assert own == [k * len(text.split()) for k in range(n)]
    assert took[16_000] < 16 * took[1_000] + 10
