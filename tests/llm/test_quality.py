import llm_rows
import numpy as np
from runlens.llm import quality

DATA = "/root/testdata/sf0.1"


def test_odd_rows_and_empty_tables(spark):
    docs, empty = llm_rows.odd_documents(spark), llm_rows.no_documents(spark)
    ratings = spark.createDataFrame(
        [(i, g) for i, g in ((0, 2), (1, 2), (2, 1), (6, 0), (7, 2), (9, 0), (9, 2), (None, 1), (4, None), (77, 2))],
        "doc_id long, grade int",
    )
    model = quality.train(docs, ratings, 2)
    got = quality.rate(docs, model, 2).collect()
    assert sorted([r["id"] for r in got], key=repr) == sorted([r[0] for r in llm_rows.odd_rows()], key=repr)
    assert all(0 <= r["expected_grade"] <= 2 and 0 <= r["tail"] <= 1 and r["kept"] == (r["tail"] >= 0.5) for r in got)
    assert quality.rate(empty, model, 2).collect() == []
    kept = quality.keep_good(docs, model, 2)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    for nothing in (ratings.where("false"), ratings.where("grade = 2 and doc_id < 5")):
        untrained = quality.train(docs, nothing, 2)
        assert all(r["kept"] for r in quality.rate(docs, untrained, 2).collect())
        assert quality.keep_good(docs, untrained, 2).count() == len(got)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    ratings = quality.graded(labels)
    model = quality.train(docs, ratings.where("pmod(xxhash64(doc_id), 4) <> 0"), quality.GOOD)
    held = labels.where("pmod(xxhash64(doc_id), 4) = 0")
    got = quality.rate(docs, model, quality.GOOD).join(held, quality.F.col("id") == held["doc_id"]).collect()
    clean = [r["kept"] for r in got if r["quality"] == 1 and r["toxic"] == 0]
    junk = [r["kept"] for r in got if r["quality"] == 0]
    toxic = [r["kept"] for r in got if r["toxic"] == 1]
    assert len(got) > 700
    assert np.mean(clean) > 0.97 and np.mean(junk) < 0.2 and np.mean(toxic) < 0.5


def test_more_grades_and_ordered_thresholds():
    random = np.random.default_rng(2)
    grades = random.integers(0, 4, 800)
    lists = [np.unique(np.concatenate([random.integers(100, 400, 5), [g, 10 + g // 2]])).astype(np.int32) for g in grades]
    model = quality.fit(lists, grades, 3)
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == 3
    expected = np.array([model.at_least(model.score(f)).sum() for f in lists])
    means = [expected[grades == g].mean() for g in range(4)]
    assert means == sorted(means) and means[3] > means[0] + 0.5


def loss_of(lists, grades, top, weights, thresholds, scale):
    """Mean negative log likelihood and penalty, document by document."""
    total = 0.0
    for places, grade in zip(lists, grades):
        score = sum(weights[p] * scale[p] for p in places)
        below = [0.0, *(1 / (1 + np.exp(score - t)) for t in thresholds), 1.0]
        total -= np.log(below[grade + 1] - below[grade])
    return total / len(grades) + quality.PENALTY / 2 * float(np.square(weights).sum())


def small_sample(seed=3, n=60, top=2):
    random = np.random.default_rng(seed)
    grades = random.integers(0, top + 1, n)
    lists = [np.unique(np.concatenate([random.integers(20, 30, 4), [g]])).astype(np.int32) for g in grades]
    return lists, grades


def test_first_round_moves_against_the_numerical_slope(monkeypatch):
    """After one round of the library's own fit every weight and threshold has moved against its slope."""
    lists, grades = small_sample()
    scale = quality.scales(lists, grades >= 2)
    monkeypatch.setattr(quality, "ROUNDS", 1)
    model = quality.fit(lists, grades, 2)
    start = np.array([-1.0, 0.0])
    used = np.nonzero(scale)[0]
    h = 1e-5
    assert len(used) > 8
    for p in used:
        step = np.zeros(40)
        step[p] = h
        slope = (
            loss_of(lists, grades, 2, step, np.array([-1.0, 0.0]), scale) - loss_of(lists, grades, 2, -step, start, scale)
        ) / (2 * h)
        moved = model.weights[p] / scale[p]
        assert np.isclose(moved, -quality.RATE * np.sign(slope), rtol=1e-3), p
    for k, change in enumerate(([h, h], [0, h])):  # the first threshold carries the second one along
        zero = np.zeros(40)
        slope = (loss_of(lists, grades, 2, zero, start + change, scale) - loss_of(lists, grades, 2, zero, start - change, scale)) / (2 * h)
        moved = (model.thresholds - start)[k] if k == 0 else np.log(np.diff(model.thresholds))[0]
        assert np.isclose(moved, -quality.RATE * np.sign(slope), rtol=1e-3)


def test_fit_reaches_the_minimum(monkeypatch):
    """A long fit is as good as the best of plain descents with numerical slopes."""
    lists, grades = small_sample(seed=5)
    scale = quality.scales(lists, grades >= 2)
    monkeypatch.setattr(quality, "ROUNDS", 3000)
    monkeypatch.setattr(quality, "RATE", 0.005)
    model = quality.fit(lists, grades, 2)
    weights = np.zeros(40)
    used = np.nonzero(scale)[0]
    weights[used] = model.weights[used] / scale[used]
    best = loss_of(lists, grades, 2, weights, model.thresholds, scale)
    random = np.random.default_rng(1)
    for size in (0.3, 0.03, 0.003):
        for _ in range(60):
            near = weights.copy()
            near[used] += size * random.normal(size=len(used))
            cuts = model.thresholds + size * random.normal(size=2)
            if cuts[0] < cuts[1]:
                assert loss_of(lists, grades, 2, near, cuts, scale) >= best - 1e-5


def test_one_task_fits_what_fit_fits(spark, monkeypatch):
    bodies = [llm_rows.prose(i % 5, 20 + i % 3) + (" good" * (i % 2)) for i in range(60)]
    docs = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)] * 2, "doc_id long, text string").repartition(3)
    ratings = spark.createDataFrame([(i, i % 3) for i in range(60)], "doc_id long, grade int")
    order = [r["doc_id"] for r in ratings.orderBy(quality.F.xxhash64("doc_id", quality.F.lit(quality.SEED))).collect()]
    lists = [quality.features(bodies[i], quality.Places()) for i in order]
    cells = [len(f) for f in lists]
    for most in (quality.FEATURES, sum(cells[:31])):
        monkeypatch.setattr(quality, "FEATURES", most)
        n = 60 if most > 1 << 20 else 31
        want = quality.fit(lists[:n], np.array([i % 3 for i in order[:n]]), 2)
        got = quality.train(docs, ratings, 2)
        assert np.array_equal(got.weights, want.weights) and np.array_equal(got.thresholds, want.thresholds)
