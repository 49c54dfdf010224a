import itertools
import random
import unicodedata

import llm_rows
import numpy as np
import pytest
from pyspark.sql import functions as F
from runlens.llm import language
from runlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
LINES = {
    "en": "the quick answer that they gave was not what she would have thought of it with this",
    "fr": "le chat qui était sur la table avec une pomme dans les rues de cette ville et pour",
    "ru": "это было очень хорошо что они пришли к нам сегодня вечером и потом ушли домой",
    "uk": "це було дуже добре що вони прийшли до нас сьогодні ввечері і потім пішли додому її",
    "el": "αυτό ήταν πολύ καλό που ήρθαν σε μας σήμερα το βράδυ και μετά έφυγαν",
    "ja": "これはとても良かった彼らが今夜来てくれた後で家に帰った東京の町",
    "hi": "यह बहुत अच्छा था कि वे आज शाम हमारे पास आए और फिर घर चले गए",
}


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(3)
    rows = []
    for lang, line in LINES.items():
        words = line.split()
        rows += [(len(rows) + i, " ".join(rng.choice(words) for _ in range(12)), lang) for i in range(30)]
    rows += [(9999, "unlabelled words teach nothing", None)]
    return language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_scripts_narrow_the_candidates(model):
    words = language.cut(["the это λόγος 東京 ほん है 한국"])
    of = [{model.languages[k] for k in np.flatnonzero(model.used[c])} for c in words.script]
    assert of == [{"en", "fr"}, {"ru", "uk"}, {"el"}, {"ja"}, {"ja"}, {"hi"}, set()]


def test_mixed_text_is_parted_where_the_language_changes(model):
    order = ["fr", "ru", "en", "uk", "el", "ja", "en", "hi"]
    text = " ... ".join(LINES[k] for k in order)
    found = language.label_texts([text], model)
    spans = found.spans[0]
    assert [lang for _, _, lang in spans] == order
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(a[1] == b[0] for a, b in itertools.pairwise(spans))
    for (start, end, lang) in spans:
        assert text[start:end].strip(" .") == LINES[lang]


def test_a_stray_word_does_not_part_a_span(model):
    text = "the quick answer was été what she would have thought"
    assert [x for _, _, x in language.label_texts([text], model).spans[0]] == ["en"]


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(8)
    for _ in range(60):
        sizes = rng.integers(0, 6, rng.integers(1, 5))
        texts = np.concatenate([[0], np.cumsum(sizes)])
        n = int(rng.integers(1, 4))
        score, prior, switch = -6 * rng.random((texts[-1], n)), np.log(rng.random(n)), 3 * rng.random()
        got = language.viterbi(score, texts, prior, switch)

        def worth(labels, rows):
            first = prior[labels[0]] if len(labels) else 0
            changes = sum(a != b for a, b in itertools.pairwise(labels))
            return first + sum(row[k] for row, k in zip(rows, labels)) - switch * changes

        for a, b in itertools.pairwise(texts):
            best = max(worth(x, score[a:b]) for x in itertools.product(range(n), repeat=b - a))
            assert np.isclose(worth(got[a:b].tolist(), score[a:b]), best)


def plain_words(text):
    """Stretches of letters of one script, cut every WORD letters."""
    def script(char):
        for name, spans in language.SCRIPTS.items():
            if any(a <= ord(char) <= b for a, b in spans) and (char.isalpha() or unicodedata.category(char) in ("Mn", "Mc")):
                return name
        return "other" if char.isalpha() else None

    words = []
    for name, group in itertools.groupby(text, script):
        chars = "".join(group)
        if name:
            pieces = [chars[i : i + language.WORD] for i in range(0, len(chars), language.WORD)]
            words += [p for p in pieces if any(c.isalpha() for c in p)]
    return words


def test_words_and_features_against_plain_ones():
    texts = ["Ab c_d1e, naïve İI  x", "", "日本語のテスト abcабв", "a" * 40, "9 9", "é́ हिन्दी 😀"]
    words = language.cut(texts)
    flat = [w for t in texts for w in plain_words(t)]
    shown = ["".join(map(chr, words.points[a:b])) for a, b in zip(words.start, words.end)]
    assert [len(w) for w in shown] == [len(w) for w in flat]
    assert [w for w in shown if w.isascii()] == [w.lower() for w in flat if w.isascii()]
    assert np.diff(words.texts).tolist() == [len(plain_words(t)) for t in texts]
    bucket, word = language.features(words, 0, len(flat), 1 << 30)
    for i, w in enumerate(shown):
        padded = f" {w} "
        grams = {w[j] for j in range(len(w))} | {padded[j : j + k] for k in (2, 3, 4) for j in range(len(padded) - k + 1)}
        assert len(set(bucket[word == i].tolist())) == len(grams) + 1
    # Equal words have equal features wherever they stand.
    twice = language.cut(["xyz uvw", "uvw xyz"])
    b, w = language.features(twice, 0, 4, 1 << 30)
    assert sorted(b[w == 0]) == sorted(b[w == 3]) and sorted(b[w == 1]) == sorted(b[w == 2])


def test_blocks_change_nothing(model, monkeypatch):
    texts = [" ".join(LINES[k] for k in keys) for keys in (("en", "ru"), ("fr",), ("ja", "hi", "el"))] + ["", "1 2", "한국어"]
    whole = language.label_texts(texts, model)
    monkeypatch.setattr(language, "SCORED", 40)
    single = [language.label_texts([t], model) for t in texts]
    assert whole.language == [s.language[0] for s in single] and whole.spans == [s.spans[0] for s in single]
    assert np.allclose(whole.score, [s.score[0] for s in single])
    assert whole.language[3:5] == ["und", "und"] and whole.score[3:] == [0.0] * 3
    assert whole.language[5] == model.languages[int(model.prior.argmax())]


def test_odd_rows_and_empty_tables(spark, model):
    docs = llm_rows.odd_documents(spark)
    got = language.label(docs, model).collect()
    assert sorted([r["id"] for r in got], key=repr) == sorted([r[0] for r in llm_rows.odd_rows()], key=repr)
    assert all(0 <= r["score"] <= 1 and (r["lang"] == "und") == (not r["spans"]) for r in got)
    assert language.label(llm_rows.no_documents(spark), model).collect() == []
    nothing = language.train(llm_rows.no_documents(spark))
    assert {(r["lang"], r["score"]) for r in language.label(docs, nothing).collect()} == {("und", 0.0)}
    one = language.train(docs)
    assert one.languages == ["en"]
    assert {r["lang"] for r in language.label(docs, one).collect()} == {"und", "en"}


def test_held_out_accuracy(spark):
    got = QUERIES["op11_script_viterbi"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = got.join(docs, "doc_id").where("held_out and lang is not null").collect()
    assert len(held) > 150
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    remainder = F.crc32(F.col("doc_id").cast("string")) % 4
    assert got.where(F.col("held_out") != (remainder == 2)).count() == 0
