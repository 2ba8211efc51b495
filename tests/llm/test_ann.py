import numpy as np

from logsieve.llm import ann

SF = "/root/testdata/sf0.01"


def brute(rows, k=20):
    ids, vectors = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)
    out = {}
    for i, q in enumerate(ids):
        if q % 20 == 0:
            score = (vectors * vectors[i]).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
            out[q] = [(ids[j], score[j]) for j in order]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_and_exact_scores(spark, monkeypatch):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute(rows)
    for candidates, queries in ((8192, 1024), (60, 5)):
        monkeypatch.setattr(ann, "CANDIDATES", candidates)
        monkeypatch.setattr(ann, "QUERIES", queries)
        got = result(ann.op9_nearest(spark, SF))
        assert got.keys() == want.keys()
        same = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
        assert same / sum(map(len, want.values())) >= 0.98
        for q in want:
            np.testing.assert_allclose([s for _, s in got[q]][:5], [s for _, s in want[q]][:5], rtol=0, atol=1e-9)


def test_bounds_hold():
    rnd = np.random.default_rng(2)
    vectors, query = rnd.standard_normal((2000, 64)) * rnd.uniform(0.1, 9, (2000, 1)), rnd.standard_normal(64)
    turn = ann.rotation(64, ann.CODE_BITS)
    codes, length, a = ann.codes_of(vectors, turn)
    x = (np.unpackbits(codes, axis=1).astype(float) * 2 - 1) / np.sqrt(ann.CODE_BITS)
    estimate = (x @ (query @ turn)) / a * length
    slack = ann.EPSILON * np.sqrt((1 - a * a) / (a * a) / (ann.CODE_BITS - 1)) * length * np.linalg.norm(query)
    assert np.mean(np.abs(estimate - vectors @ query) <= slack) > 0.98


def test_hard_vectors(spark):
    nan, inf = float("nan"), float("inf")
    fine = [(i, [float(i % 7 - 3), 1.0, float(i % 5)]) for i in range(45)]
    bad = [(100, None), (120, [0.0, 0.0, 0.0]), (140, [nan, 1.0, 1.0]), (160, [1.0, None, 1.0]), (180, [inf, 1.0, 1.0]), (200, []),
           (220, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    rows = [(i, v, "z") for i, v in fine + bad + fine[:3]]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, vec string")
    got = result(ann.nearest(docs, lambda i: i % 20 == 0))
    assert got == brute(fine)
    few = result(ann.nearest(docs.filter("vec_id < 4"), lambda i: i % 20 == 0))
    assert [v for v, _ in few[0]] == [v for v, _ in brute(fine[:4])[0]]
    assert ann.nearest(docs.limit(0), lambda i: i % 20 == 0).collect() == []


def test_vectors_of_several_lengths(spark, monkeypatch):
    """Each length is searched among its own, also the rare one."""
    monkeypatch.setattr(ann, "CANDIDATES", 20)
    rnd = np.random.default_rng(1)
    long = [(i, [float(x) for x in rnd.standard_normal(5)]) for i in range(0, 200, 2)]
    short = [(i, [float(x) for x in rnd.standard_normal(3)]) for i in range(1, 90, 2)] + [(1000, [1.0, 0.5, -1.0])]
    docs = spark.createDataFrame(long + short, "vec_id long, embedding array<double>")
    got = result(ann.nearest(docs, lambda i: i % 20 == 0))
    want = brute(long) | brute(short)
    assert {q: [v for v, _ in x] for q, x in got.items()} == {q: [v for v, _ in x] for q, x in want.items()}
