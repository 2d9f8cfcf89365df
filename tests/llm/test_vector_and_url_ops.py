"""Operators on embeddings and urls against brute force, and the registered queries' contracts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexisieve.llm import ann, neardup, urlfilter

SCHEMA = "vec_id long, embedding array<float>"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    x = (centres[rng.integers(0, 6, 700)] + 0.35 * rng.normal(size=(700, 16))).astype(np.float32)
    x[100:140] = x[100]  # a group of copies
    x[200:230] = x[200] * np.linspace(1, 2, 30)[:, None]
    out = [(i, v.tolist()) for i, v in enumerate(x)]
    out[7], out[8], out[9], out[11], out[12] = (7, None), (8, [0.0] * 16), (9, [float("nan")] * 16), (11, [1.0, None] * 8), (12, [1.0, 2.0])
    out[13] = (13, [float("inf")] * 16)
    return out


def valid(rows):
    return {i: np.array(v, float) for i, v in rows if v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)}


def test_neardup_equals_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(neardup, "CELL", 60)
    monkeypatch.setattr(neardup, "BLOCK", 64)
    ok = valid(rows)
    ids = sorted(ok)
    x = np.array([ok[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.9
    parent = {i: i for i, _ in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in zip(*np.nonzero(np.triu(link, 1))):
        p, q = sorted((find(ids[a]), find(ids[b])))
        parent[q] = p
    n = {i: int(link[k].sum()) - 1 for k, i in enumerate(ids)}
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rep", F.lit(1)).withColumn("cell", F.lit(2))
    got = {r["vec_id"]: r for r in neardup.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    for i, _ in rows:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n.get(i, 0), find(i), find(i) == i), i


def test_neardup_edges(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (2, [2.0, 0.0]), (4, [1.0, 0.0])], SCHEMA)
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in neardup.near_duplicates(df).collect())
    assert got == [("2", 1, "2", True), ("4", 1, "2", False), ("4", 1, "2", False), ("None", 0, "None", True)]
    assert neardup.near_duplicates(df.where("false")).count() == 0
    assert neardup.near_duplicates(df.withColumn("embedding", F.lit(None).cast("array<float>"))).where("kept").count() == 4


def test_neardup_counts_rows_of_one_vector_once(spark):
    df = spark.createDataFrame([(5, [1.0, 0.0])] * 12 + [(6, [1.0, 0.0]), (7, [0.0, 1.0]), (7, [1.0, 0.1]), (9, [0.0, 2.0])], SCHEMA)
    got = sorted({(r["vec_id"], r["n_links"], r["component_id"]) for r in neardup.near_duplicates(df).collect()})
    assert got == [(5, 2, 5), (6, 2, 5), (7, 1, 7), (7, 2, 5), (9, 1, 7)]


def test_neardup_follows_a_long_chain(spark):
    rng, n = np.random.default_rng(8), 300
    ids, at = rng.permutation(n), np.arange(n + 12)
    x = [((at >= i) & (at < i + 12)).astype(float).tolist() for i in range(n)]  # neighbours share 11 of 12 ones: cosine 0.917
    df = spark.createDataFrame([(int(ids[i]), x[i]) for i in range(n)], SCHEMA)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
    assert {c for _, c in got.values()} == {0}
    assert sorted(n for n, _ in got.values()) == [1, 1] + [2] * (n - 2)


def test_neardup_decides_at_the_threshold_in_double_precision(spark):
    def at(cosine, axis):
        v = [0.0] * 8
        v[axis], v[axis + 1] = cosine, (1 - cosine * cosine) ** 0.5
        return v

    rows = [(1, at(1.0, 0)), (2, at(0.9 + 1e-9, 0)), (3, at(1.0, 4)), (4, at(0.9 - 1e-9, 4))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}


def test_ann_recall_and_ties(spark, rows, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 20)
    monkeypatch.setattr(ann, "BLOCK", 50)
    ok = valid(rows)
    ids = np.array(sorted(ok))
    x = np.array([ok[i] for i in ids])
    df = spark.createDataFrame(rows, SCHEMA).withColumn("list", F.lit(1))
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, least=100, ratio=0.15).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q in [i for i in ids if i % 20 == 0]:
        d = np.sqrt(((x - ok[q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        want = [int(i) for i in ids[np.lexsort((ids, d))[:10]]]
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 11)) and [(s, i) for _, i, s in own] == sorted((s, i) for _, i, s in own)
        assert all(abs(s - np.sqrt(((ok[i] - ok[q]) ** 2).sum())) < 1e-12 for _, i, s in own)
        hits += len(set(want) & {i for _, i, _ in own})
        total += 10
    assert set(got) == {int(i) for i in ids if i % 20 == 0} and hits >= 0.9 * total
    assert [i for _, i, _ in sorted(got[120])] == [i for i in range(100, 112) if i != 120][:10]


def test_ann_edges(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [1.0, 1.0]), (2, None)], SCHEMA)
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1)]
    assert ann.search(df.where("false"), F.lit(True)).count() == 0


def test_ann_counts_rows_of_one_vector_once(spark):
    rows = [(0, [0.0, 1.0])] + [(5, [1.0, 1.0])] * 12 + [(i, [1.0, 1.0]) for i in (6, 7, 8, 9)] + [(300, [4.0, 4.0]), (301, [9.0, 9.0]), (301, [0.0, 1.5])]
    got = sorted((r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0).collect())
    assert got == [(1, 301, 0.5), (2, 5, 1.0), (3, 6, 1.0), (4, 7, 1.0), (5, 8, 1.0), (6, 9, 1.0), (7, 300, 5.0)]


def test_ann_recall_does_not_fall_with_the_number_of_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 8)
    monkeypatch.setattr(ann, "BLOCK", 64)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    hits = 0
    got = {}
    for r in ann.search(df, F.col("vec_id") % 200 == 0, lists=12).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q in range(0, 4000, 200):
        d = ((x.astype(float) - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.97 * 200


def test_ann_fits_on_distinct_vectors_of_a_table_of_copies(spark):
    df = spark.range(200_000).selectExpr("id AS vec_id", "array(1.0F, CAST(id % 2 AS FLOAT)) AS embedding")
    seen = []

    def fitted(x, lists, seed=9):
        seen.append(len(x))
        return x

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ann, "balanced", fitted)
        ann.search(df, F.col("vec_id") == 0)
    assert seen == [2]


def test_graph_search_finds_the_nearest_lists():
    rng = np.random.default_rng(1)
    c = rng.normal(size=(900, 12))
    graph, hit = ann.Graph(c), 0
    for _ in range(60):
        q = rng.normal(size=12)
        found, d = graph.search(q, 20)
        assert (np.diff(d) >= 0).all()
        hit += len(set(found[:10]) & set(np.argsort(((c - q) ** 2).sum(axis=1))[:10]))
    assert hit >= 540
    sizes = np.bincount(((rng.normal(size=(4000, 12))[:, None] - ann.balanced(c, 30)) ** 2).sum(axis=2).argmin(axis=1))
    assert 25 <= len(ann.balanced(c, 30)) <= 60 and sizes.max() > 0


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, after = rest[:k], rest[k:]
    j = min([after.find(c) for c in "?#" if c in after] or [len(after)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), after[:j]


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/1", "https://example.org/en/15?x", "https://xexample.org/en/1", "http://org/", "http://a.org", "ftp://b.COM/fr/#y", "http://com/de/", "x://c.com/de", "http://É.com/fr/x", "http://h?://z.org/", "https://casino7.biz/bonus.php?id=2", "https://docs.example-3.net/article/1", "http://p.net/" + "a" * 20_000]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit("clash"))
    labelled = urlfilter.labelled_urls(spark)
    got = {r["page_id"]: r for r in urlfilter.judge(df, labelled).collect()}
    for i, u in enumerate(urls):
        host, path = parts(u)
        assert (got[i]["host"], got[i]["path"]) == (host, path), u
        fits = [r for r in urlfilter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.host + r.path), default=None)
        assert got[i]["rule"] == (best and best.host + best.path)
        assert got[i]["verdict"] == (best.verdict if best else ("block" if got[i]["p_block"] > 0.5 else "allow"))
    assert got[13]["verdict"] == "block" and got[14]["verdict"] == "allow"
    assert urlfilter.judge(df.where("false"), labelled).count() == 0


def test_url_model_on_held_out_addresses(spark):
    rows = urlfilter.labelled_urls(spark).collect()
    learn = spark.createDataFrame([r for i, r in enumerate(rows) if i % 3], "url string, block boolean")
    rest = spark.createDataFrame([r for i, r in enumerate(rows) if i % 3 == 0], "url string, block boolean")
    right = urlfilter.judge(rest, learn, rules=()).where((F.col("verdict") == "block") == F.col("block")).count()
    assert right >= 0.9 * rest.count()
