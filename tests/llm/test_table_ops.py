"""Host reputation, mixing, embeddings, components and the pipeline."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexprep.llm import components, decontaminate, embedding_dedup, mixing, quality, simhash, suffix_dedup, url_reputation
from lexprep.llm.queries import ORACLE, QUERIES


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 180)] + [(500, 500 + k) for k in range(1, 60)]
    edges += [(700 + k, 700 + (k + 1) % 20) for k in range(20)] + [(5, 5), (None, 3), (900, 901), (901, 900), (900, 901)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 100 for k in range(100, 181)} | {500 + k: 500 for k in range(60)} | {700 + k: 700 for k in range(20)} | {900: 900, 901: 900}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- host reputation ------------------------------------------------------------------------------------------

def brute_judge(url):
    at = (url or "").find("://")
    rest = (url or "")[at + 3:] if at >= 0 else ""
    host = ""
    while len(host) < len(rest) and rest[len(host)] not in "/?#":
        host += rest[len(host)]
    path = rest[len(host):]
    for c in "?#":
        path = path.split(c)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for r in url_reputation.RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path):
            if best is None or len(r.name) > len(best.name):
                best = r
    return host, path, best


def test_rules_and_parts_of_odd_urls(spark):
    urls = ["http://a.example.net/en/1", "HTTP://A.EXAMPLE.NET/en/x?q", "ftp://example.net/fr/#f", "http://net", "http://net/", None, "",
            "no scheme", "://", "http://x.org/fr/?a://b", "http://x.org/FR/", "http://example.com:80/de/", "http://É.org/fr/1",
            "http://notexample.net/en/", "http://a.example.com/de/1#x", "http://h?x/y", "http://h#f", "http://h/\n/x", "http://xnet/"]
    rows = [(k, u, "v", "w") for k, u in enumerate(urls)] + [(0, urls[0], "v", "w")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, fixed string")
    got = url_reputation.judged(pages).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"page_id", "url", "host", "fixed", "judged"}
    for r in got:
        host, path, best = brute_judge(r["url"])
        j = r["judged"]
        assert (j["host"], j["path"], j["rule"]) == (host, path, best and best.name)
        assert j["verdict"] == best.verdict if best else j["verdict"] in ("allow", "block")
        assert 0 <= j["bound"] <= j["share"] <= 1 or j["bound"] < 0
    assert url_reputation.judged(pages.limit(0)).count() == 0
    assert url_reputation.keep_allowed(pages).columns == pages.columns


def test_registered_domains(spark):
    want = {"a.b.co.uk": ("b.co.uk", "co.uk"), "b.co.uk:80": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"),
            "www.abco.uk": ("abco.uk", "uk"), "x.com.br": ("x.com.br", "com.br"), "a.example.com": ("example.com", "com"),
            "t.co": ("t.co", "co"), "co.com": ("co.com", "com"), "localhost": ("localhost", "localhost"), "": ("", ""),
            "1.2.3.4:8080": ("1.2.3.4", "1.2.3.4"), "[::1]": ("[::1]", "[::1]"), "a.": ("a.", ""), "x.y\n": ("x.y\n", "y\n")}
    df = spark.createDataFrame([(h,) for h in want], "host string")
    host = F.col("host")
    got = df.select(host, url_reputation.registered_domain(host).alias("d"), url_reputation.suffix(host).alias("s")).collect()
    assert {r["host"]: (r["d"], r["s"]) for r in got} == want


def test_sites_under_a_suffix_of_two_labels_are_strangers(spark):
    rows = [(f"h{k}.bad.co.uk", 1) for k in range(40)] + [(f"h{k}.good.co.uk", 0) for k in range(40)]
    rows += [("new.bad.co.uk", None), ("new.good.co.uk", None)]
    got = {r["host"]: r for r in url_reputation.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["new.bad.co.uk"]["share"] > 0.6 > 0.4 > got["new.good.co.uk"]["share"]


def test_shrinkage_follows_domain_and_evidence(spark):
    rows = [("a.bad.x", 1)] * 40 + [("b.bad.x", None)] + [("a.good.x", 0)] * 40 + [("b.good.x", None)] + [("new.y", None)]
    rows += [("c.bad.x", 0)] * 30 + [(f"h{k}.bad.x", 1) for k in range(30)] + [(f"h{k}.good.x", 0) for k in range(30)]
    got = {r["host"]: r for r in url_reputation.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["b.bad.x"]["share"] > 0.6 > 0.3 > got["b.good.x"]["share"]
    assert got["a.bad.x"]["bound"] > got["b.bad.x"]["bound"] and got["c.bad.x"]["share"] < got["b.bad.x"]["share"]


# -- mixing ---------------------------------------------------------------------------------------------------

def mix_table(spark, seed=3):
    rng = random.Random(seed)
    rows = []
    for k in range(1200):
        s = "big" if k % 3 == 0 else ["a", "b", "c", "d", None, ""][rng.randrange(6)]
        rows.append((k, " ".join("w" for _ in range(rng.randrange(60 if s == "big" else 20))), s, "z", 1))
    rows += [(1, None, "a", "z", 1), (None, "x y z", "b", "z", 1), (7, "", "zero", "z", 1), (7, rows[7][1], rows[7][2], "z", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, key string, epoch int")


@pytest.mark.parametrize("settings", [mixing.Settings(blocks=16), mixing.Settings(blocks=16, budget=2.5, entropy=1.0),
                                      mixing.Settings(blocks=16, budget=1.5, entropy=1.0, repeats=2.0), mixing.Settings(budget=9.0, repeats=3.0, blocks=8)])
def test_mixture_meets_weights_and_budget(spark, settings):
    rows, docs = mix_table(spark)
    got = mixing.mix(docs, settings=settings).collect()
    tokens = defaultdict(int)
    for _, t, s, *_ in rows:
        tokens[s] += len((t or "").split())
    total, real = sum(tokens.values()), {s: n for s, n in tokens.items() if n}
    weight = {r["source"]: r["weight"] for r in got}
    assert set(weight) == set(real) and abs(sum(weight.values()) - 1) < 1e-9
    # one exponent for all, the largest that meets the target, unless the limit on repeats asks for more
    logs = [(math.log(real[s] / total), math.log(weight[s])) for s in real]
    a = (logs[0][1] - logs[1][1]) / (logs[0][0] - logs[1][0])
    assert all(abs((logs[0][1] - y) - a * (logs[0][0] - x)) < 1e-6 for x, y in logs)

    def entropy(e):
        w = [(n / total) ** e for n in real.values()]
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)

    def most(e):
        w = {s: (n / total) ** e for s, n in real.items()}
        return max(settings.budget * total * w[s] / sum(w.values()) / real[s] for s in real)

    target = settings.entropy * math.log(len(real))
    if entropy(a) >= target - 1e-6:
        assert a > 1 - 1e-6 or entropy(min(1, a + 1e-4)) < target or most(max(0, a - 1e-4)) > settings.repeats
    if settings.budget <= settings.repeats:
        assert most(a) <= settings.repeats + 1e-4
    for s in real:
        want = min(weight[s] * settings.budget * total, settings.repeats * real[s])
        mine = [r for r in got if r["source"] == s]
        taken = sum(r["n_tokens"] for r in mine)
        longest = max(len((t or "").split()) for _, t, x, *_ in rows if x == s)
        assert want - longest - 1 <= taken <= want + 1e-3
        # whole epochs hold every row of the source, the last one some of them, block by block
        full = int((want + 1e-6) // real[s])
        per = Counter(r["epoch"] for r in mine)
        n_rows = sum(x == s for _, _, x, *_ in rows)
        assert all(per[e] == n_rows for e in range(1, full + 1)) and max(per) <= full + 1
        for e in per:
            place = defaultdict(set)
            for r in mine:
                if r["epoch"] == e:
                    place[r["block"]].add(r["place"])
            assert all(len(v) == 1 for v in place.values()) and len({min(v) for v in place.values()}) == len(place)


def test_exponents_are_tried_as_rows(spark):
    tokens, at = [1, 5, 14, 80], [k / 16 for k in range(17)]
    sources = spark.createDataFrame([(n,) for n in tokens], "tokens long")
    assert mixing._sums_table(sources, 100, at).columns == ["k", "z", "l", "r"]
    for a, (z, l, r) in zip(at, mixing._sums(sources, 100, at), strict=True):
        p = [n / 100 for n in tokens]
        assert z == pytest.approx(sum(x ** a for x in p)) and l == pytest.approx(sum(x ** a * math.log(x) for x in p))
        assert r == pytest.approx(max(x ** (a - 1) for x in p))


def test_training_gives_its_memory_back(spark, monkeypatch):
    given = []
    monkeypatch.setattr(quality.A, "release", lambda: given.append(1))
    docs = spark.createDataFrame([(k, "good text" if k % 2 else "bad words") for k in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    quality.fit(docs, labels)
    assert given


def test_mixture_of_nothing(spark):
    _, docs = mix_table(spark)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.where("text is null or text = ''")).count() == 0
    one = mixing.mix(docs.where("source = 'a'")).collect()
    assert {r["weight"] for r in one} == {1.0} and {r["epoch"] for r in one} == {1}


# -- embeddings -----------------------------------------------------------------------------------------------

def brute_links(vectors, threshold=0.95):
    ok = [i for i, v in enumerate(vectors) if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = defaultdict(set)
    for d in {len(vectors[i]) for i in ok}:
        at = [i for i in ok if len(vectors[i]) == d]
        x = np.array([vectors[i] for i in at], dtype=np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(x @ x.T >= threshold)):
            if a != b:
                near[at[a]].add(at[b])
    return near


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((700, 24))
    dense = base[0] + 0.02 * rng.standard_normal((400, 24))  # a ball
    middle = base[0] + 0.28 * rng.standard_normal((60, 24)) / 1.0  # around it
    close = base[1:80] + 0.05 * rng.standard_normal((79, 24))
    v = [list(map(float, x)) for x in np.concatenate([base, dense, middle, close])]
    v += [v[5], v[5], v[5], [2 * x for x in v[6]], None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [None] + [1.0] * 23,
          [float("inf")] * 24, [1.0, 2.0], [1.0, 2.1], [-x for x in v[9]], [1e300] * 24, [1e-300] * 24]
    rows = [(k, x, "l", 1) for k, x in enumerate(v)]
    near = brute_links(v)
    root = list(range(len(v)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in near:
        for b in near[a]:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    for s in (embedding_dedup.Settings(leaf=60, chunk=64), embedding_dedup.Settings(leaf=60, leaf_limit=150, max_leaves=2, trees=12)):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, leaf string, k int")
        got = {r["id"]: r for r in embedding_dedup.near_duplicates(df, settings=s).collect()}
        assert len(got) == len(v)
        found, true = sum(r["n_links"] for r in got.values()), sum(len(x) for x in near.values())
        assert 0.97 * true <= found <= true and all(got[k]["n_links"] <= len(near[k]) for k in got)
        same = sum(got[k]["component_id"] == find(k) for k in got)
        assert same >= 0.98 * len(v) and all(r["kept"] == (r["id"] == r["component_id"]) for r in got.values())
        for k in range(len(v)):
            if k not in near:
                assert got[k]["n_links"] == 0 and got[k]["component_id"] == k


def planted_group(n, cosine, dim, rng):
    """Vectors of independent noise round one centre, with a mean cosine of ``cosine`` to each other."""
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    return math.sqrt(cosine) * unit(rng.standard_normal(dim)) + math.sqrt(1 - cosine) * unit(rng.standard_normal((n, dim)))


@pytest.mark.parametrize("settings", [embedding_dedup.Settings(), embedding_dedup.Settings(ball_share=2.0),
                                      embedding_dedup.Settings(ball_share=2.0, sample=512, chunk=700)])
def test_links_inside_a_large_spread_group(spark, settings):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.standard_normal((4000, 64)), planted_group(4000, 0.96, 64, rng), planted_group(1000, 0.955, 64, rng)])
    near = brute_links([list(x) for x in v])
    df = spark.createDataFrame([(k, list(map(float, x))) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r["id"]: r for r in embedding_dedup.near_duplicates(df, settings=settings).collect()}
    assert all(got[k]["n_links"] <= len(near[k]) for k in got)
    for group in (range(4000, 8000), range(8000, 9000)):
        found, true = sum(got[k]["n_links"] for k in group), sum(len(near[k]) for k in group)
        print(f"recall of links in a group of {len(group)}: {found / true:.4f} of {true}")
        assert found >= 0.99 * true
        assert sum(got[k]["component_id"] == group[0] for k in group if near[k]) >= 0.999 * sum(k in near for k in group)


def test_no_task_gets_a_whole_shell(spark, monkeypatch):
    compare, most = embedding_dedup._compare, 600

    def bounded(*args):
        run = compare(*args)

        def checked(t):
            assert t.num_rows <= most
            return run(t)

        return checked

    monkeypatch.setattr(embedding_dedup, "_compare", bounded)
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(24)
    v = np.concatenate([centre + 0.03 * rng.standard_normal((600, 24)), centre + 0.3 * rng.standard_normal((1500, 24))])
    near = brute_links([list(x) for x in v])
    df = spark.createDataFrame([(k, list(map(float, x))) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r["id"]: r for r in embedding_dedup.near_duplicates(df, settings=embedding_dedup.Settings(chunk=128, leaf_limit=200)).collect()}
    assert sum(got[k]["n_links"] for k in range(600)) == sum(len(near[k]) for k in range(600))


def test_embeddings_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    rows = [(None, [1.0, 0.0]), (None, [1.0, 0.0]), (3, None), (3, [0.0, 1.0]), (4, [0.0, 1.0])]
    got = Counter((r["id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, kind)).collect())
    assert got == Counter([(None, 1, None), (None, 1, None), (3, 0, 3), (3, 1, 3), (4, 1, 3)])


# -- pipeline -------------------------------------------------------------------------------------------------

def test_pipeline_stages_one_by_one(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "suffix_dedup", "decontaminate", "mixing"]
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r["doc_id"] for r in quality.with_score(docs, model, "q").collect() if r["q"]["score"] >= 0.5}
    kept = corpus_pipeline.quality_stage(spark, docs, sf)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == good and len(good) > 0.7 * docs.count()
    ids = {r["component_id"] for r in simhash.groups(kept).collect()}
    one = corpus_pipeline.simhash_stage(spark, kept, sf)
    assert one.columns == docs.columns and sorted(r["doc_id"] for r in one.collect()) == sorted(ids)
    cut = corpus_pipeline.suffix_stage(spark, one, sf)
    assert cut.columns == docs.columns and cut.schema.simpleString() == docs.schema.simpleString() and cut.count() == one.count()
    left = {r["doc_id"]: r["x"]["n_bytes"] - r["x"]["n_removed"] for r in suffix_dedup.without_repeats(one, "x").collect()}
    assert all(0 <= left[r["doc_id"]] - len(r["text"].encode()) <= 30 for r in cut.collect())
    clean = corpus_pipeline.decontaminate_stage(spark, cut, sf)
    dirty = {r["doc_id"] for r in decontaminate.contamination(cut, spark.read.parquet(f"{sf}/benchmark.parquet"), "x").collect() if r["x"]["contaminated"]}
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in cut.collect()} - dirty
    mixed = corpus_pipeline.mixing_stage(spark, clean, sf).collect()
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in clean.collect()}
    want = Counter((r["doc_id"], r["epoch"], r["place"]) for r in mixed)
    assert Counter((r["doc_id"], r["epoch"], r["place"]) for r in corpus_pipeline.run(spark, sf).collect()) == want


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_dealt_operator_is_registered():
    assert {q.split("_")[0] for q in QUERIES} >= {f"op{n}" for n in range(1, 11)} | {"pipeline"}
    assert set(ORACLE) <= set(QUERIES)
