import llm_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from runlens.llm import token_counts, vocabulary

CONTENT = vocabulary.read()
TOKENIZER = vocabulary.tokenizer(CONTENT)
COUNTER = token_counts.Counter(
    TOKENIZER, token_counts.whole_tokens(TOKENIZER), token_counts.odd_characters(TOKENIZER)
)


def library(text):
    return len(TOKENIZER.encode(text or "", add_special_tokens=False).ids)


def test_odd_rows(spark):
    got = token_counts.count_tokens(llm_rows.odd_documents(spark), limit=60).collect()
    want = [(r[0], len((r[1] or "").encode()), library(r[1])) for r in llm_rows.odd_rows()]
    assert sorted([(r["id"], r["n_bytes"], r["n_tokens"]) for r in got], key=repr) == sorted(want, key=repr)
    assert all(r["over_limit"] == (r["n_tokens"] > 60) for r in got)


def test_empty_table(spark):
    assert token_counts.count_tokens(llm_rows.no_documents(spark)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sdlvret1!\x85\xa0  \x1c")), max_size=60))
def test_any_text(text):
    assert COUNTER.count(text) == library(text)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    counter = token_counts.Counter(TOKENIZER, COUNTER.whole, "")
    for seed in range(5):
        text = llm_rows.prose(seed, 40)
        assert counter.count(text) == library(text)


def test_proven_strings_are_one_token():
    assert len(COUNTER.whole) > 40_000
    assert all(library(s) == 1 for s in list(COUNTER.whole)[::97])
