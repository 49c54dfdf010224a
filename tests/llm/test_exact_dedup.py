import hashlib
import re
from collections import Counter, defaultdict

import llm_rows
from runlens.llm import exact_dedup


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[normal(text)].append(doc_id)
    out = []
    for text, ids in groups.items():
        first = min((i for i in ids if i is not None), default=None)
        out += [(i, hashlib.sha256(text.encode()).digest(), first, len(ids)) for i in ids]
    return sorted(out, key=repr)


def check(rows, docs, **options):
    got = exact_dedup.groups(docs, **options).collect()
    assert sorted([(r["id"], bytes(r["digest"]), r["keep_id"], r["group_size"]) for r in got], key=repr) == expected(rows)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({bytes(r["digest"]) for r in got}) == len({bytes(r["digest"]) for r in kept})
    assert all(r["id"] == r["keep_id"] for r in kept)


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in llm_rows.odd_rows()]
    check(rows, llm_rows.odd_documents(spark))


def test_empty_table(spark):
    assert exact_dedup.groups(llm_rows.no_documents(spark)).collect() == []
    assert exact_dedup.keep_first(llm_rows.no_documents(spark)).collect() == []


def test_frequent_texts_take_the_broadcast_way(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i % 700}" if i % 2 else f"only {i}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for counters in (1, 2, 50):
        check(rows, docs, counters=counters)


def test_summary_holds_all_frequent_keys(spark):
    rows = [(b"a" if i % 3 == 0 else b"b" if i % 5 == 0 else str(i).encode(),) for i in range(5000)]
    df = spark.createDataFrame(rows, "k binary").repartition(6)
    counts = Counter(r[0] for r in rows)
    for counters in (2, 9, 40):
        found = {bytes(r["k"]) for r in exact_dedup.frequent(df, "k", counters).collect()}
        assert len(found) <= counters + 1
        assert {k for k, n in counts.items() if n * (counters + 1) >= 2 * len(rows)} <= found


def test_keep_first_returns_the_rows_themselves(spark):
    docs = llm_rows.odd_documents(spark)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted(normal(r["text"]) for r in got) == sorted({normal(r[1]) for r in llm_rows.odd_rows()})
    assert {tuple(r) for r in got} <= {tuple(r) for r in docs.collect()}
