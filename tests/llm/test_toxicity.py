import numpy as np
from data import ROWS, hard_docs, no_docs

from logsieve.llm import toxicity as tx

SF = "/root/testdata/sf0.1"


def test_gradient_and_order_of_thresholds():
    rnd = np.random.default_rng(1)
    n, features = 600, 12
    x = (rnd.random((n, features)) < 0.3) * 1.0
    truth = np.array([3, -2, 1.5] + [0] * (features - 3))
    grades = np.digitize(x @ truth + rnd.logistic(size=n), [0.5, 2.5])
    rows, cols = np.nonzero(x)
    w, thresholds = tx.fit(rows, cols, x[rows, cols], grades, features)
    assert np.all(np.diff(thresholds) > 0)
    assert np.abs(w - truth).max() < 0.8 and np.abs(thresholds - [0.5, 2.5]).max() < 0.6
    model = tx.OrdinalModel({}, list(thresholds))
    levels = [model.severity(s) for s in (-9, 0, 2, 9)]
    assert levels == sorted(levels) and levels[0] < 0.01 and levels[-1] > 1.99


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").dropDuplicates(["text"])
    labels = spark.read.parquet(f"{SF}/labels.parquet").cache()
    model = tx.train(docs, labels.filter("doc_id % 10 < 7"))
    held = tx.score(docs.join(labels.filter("doc_id % 10 >= 7").select("doc_id", "toxic"), "doc_id"), model)
    counts = {(r.toxic, r.found): r["count"] for r in held.selectExpr("__row.toxic AS toxic", f"severity >= {tx.REJECT} AS found")
              .groupBy("toxic", "found").count().collect()}
    hit, miss = counts.get((1, True), 0), counts.get((1, False), 0)
    wrong, right = counts.get((0, True), 0), counts.get((0, False), 0)
    assert hit / (hit + miss) > 0.85 and wrong / (wrong + right) < 0.01


def test_hard_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 1), (2, 0, 1), (6, 1, None), (None, 1, 1), (99, 0, 1), (9, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    docs = hard_docs(spark)
    scored = tx.score(docs, tx.train(docs, labels))
    assert scored.count() == len(ROWS) and scored.filter("severity IS NULL").count() == 0
    assert tx.drop_toxic(docs, labels).columns == docs.columns
    none = tx.train(docs, labels.limit(0))
    assert tx.score(docs, none).filter("severity > 0").count() == 0
    assert tx.drop_toxic(no_docs(spark), labels).collect() == []


def test_severity_and_features_by_hand(spark):
    """Welch's t by plain loops picks the same features, and the severity is the sum of P(grade > k)."""
    rnd = np.random.default_rng(5)
    words = ["alpha", "beta", "gamma", "rude", "ruder", "vile", "kind", "some", "other", "thing"]
    rows, marks = [], []
    for i in range(60):
        toxic = i % 3 == 0
        text = " ".join(rnd.choice(words, 12)) + (" rude vile" * int(rnd.integers(1, 3)) if toxic else " kind")
        rows.append((i, text))
        marks.append((i, int(i % 2 == 0), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = tx.train(docs, labels, max_features=8)
    values = {i: tx.shares(t) for i, t in rows}
    kinds = {k: [i for i, _, x in marks if x == k] for k in (0, 1)}
    welch = {}
    for f in set().union(*values.values()):
        if sum(f in v for v in values.values()) < tx.MIN_DOCS:
            continue
        mean, spread = {}, 0.0
        for k, ids in kinds.items():
            x = [values[i].get(f, 0.0) for i in ids]
            mean[k] = sum(x) / len(x)
            spread += (sum(v * v for v in x) / len(x) - mean[k] ** 2) / len(x)
        welch[f] = round(abs(mean[1] - mean[0]) / (abs(spread) + 1e-12) ** 0.5, 6)
    best = sorted(welch, key=lambda f: (-welch[f], f))[:8]
    assert set(model.weights) == set(best)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    for r in tx.score(docs, model).collect():
        v = values[r["__row"].doc_id]
        s = sum(model.weights[f] * v.get(f, 0.0) for f in model.weights)
        want = sum(1 / (1 + np.exp(t - s)) for t in model.thresholds)
        assert abs(r.severity - want) < 1e-9


def test_equal_texts_take_the_highest_grade(spark):
    docs = spark.createDataFrame([(i, "vile rude words here") for i in range(12)] + [(50 + i, f"kind words number {'x' * i}") for i in range(12)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i == 7)) for i in range(12)] + [(50 + i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    a, b = tx.train(docs, labels), tx.train(docs.repartition(5), labels.repartition(4))
    assert a.thresholds and a.thresholds == b.thresholds and a.weights == b.weights
