import llm_rows
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from runlens.llm import periodic


def plain_runs(words, least=6, times=4):
    """Runs by trying every period and every place."""
    found = []
    for q in range(1, len(words)):
        i = q
        while i < len(words):
            if words[i] == words[i - q]:
                start, end = i - q, i
                while end < len(words) and words[end] == words[end - q]:
                    end += 1
                stretch = words[start:end]
                smaller = any(stretch[p:] == stretch[:-p] for p in range(1, q))
                if end - start >= max(least, times * q) and not smaller:
                    found.append((start, end - start, q))
                i = end
            i += 1
    return sorted(found)


def plain_collapse(words, runs):
    dropped = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


unit = st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), st.integers(0, 60))
text = st.lists(unit, max_size=5).map(lambda parts: [u[i % len(u)] for u, n in parts for i in range(n)])


@settings(max_examples=120, deadline=None)
@given(st.lists(text, max_size=4), st.sampled_from([(6, 4), (2, 3), (9, 3), (10, 5)]))
def test_blocks_of_texts_against_brute_force(texts, bounds):
    words, starts = periodic.split(pa.array([" \n".join(t) + " \t" for t in texts], pa.string()))
    assert words.to_pylist() == sum(texts, [])
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    assert periodic.runs_of(codes, starts, *bounds) == [plain_runs(t, *bounds) for t in texts]


def test_blanks_are_the_ascii_ones_only():
    words, starts = periodic.split(pa.array(["a\x0bb\x0c\rc\x1cd\x85e\xa0f", "", " \t", "g"]))
    assert words.to_pylist() == ["a", "b", "c\x1cd\x85e\xa0f", "g"]
    assert starts.tolist() == [0, 3, 3, 3, 4]


def test_a_match_that_pauses_is_two_runs():
    words = "x y " * 4 + "z " + "x y " * 4 + "y y y y y y"
    assert periodic.runs_of(*coded(words)) == [plain_runs(words.split())]


def coded(text):
    words, starts = periodic.split(pa.array([text]))
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), starts


def test_odd_rows(spark):
    docs = llm_rows.odd_documents(spark)
    got = periodic.collapse(docs).collect()
    want = []
    for doc_id, body, *_ in llm_rows.odd_rows():
        words = (body or "").encode().split()
        runs = plain_runs(words[:300]) if len(words) < 300 else []
        want.append((doc_id, len(words), runs, plain_collapse([w.decode() for w in words], runs)))
    assert sorted([(r["id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got], key=repr) == sorted(
        want, key=repr
    )
    assert periodic.collapse(llm_rows.no_documents(spark)).collect() == []


@pytest.mark.parametrize("block", [1, 40, 10_000])
def test_size_of_blocks_changes_nothing(spark, monkeypatch, block):
    bodies = ["a b " * k + "c" * (k % 3) for k in range(12)]
    docs = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(periodic, "BLOCK", block)
    got = {r["id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.collapse(docs).collect()}
    for i, body in enumerate(bodies):
        runs = plain_runs(body.split())
        assert got[i] == (runs, plain_collapse(body.split(), runs))


def test_very_long_texts_take_linear_work():
    rng = np.random.default_rng(5)
    n = 400_000
    assert periodic.runs_of(np.zeros(n, np.int64), np.array([0, n])) == [[(0, n, 1)]]
    unit = rng.integers(0, 30, 1000)
    assert periodic.runs_of(np.tile(unit, n // 1000), np.array([0, n])) == [[(0, n, 1000)]]
    # Two words only: each has half of all earlier words as occurrences.
    place, _, _ = periodic.cells(rng.integers(0, 2, n), np.array([0, n]))
    assert len(place) < 2 * n


def test_less_than_three_periods_are_refused(spark):
    with pytest.raises(ValueError):
        periodic.collapse(llm_rows.no_documents(spark), times=2)
