import random
import re
import string

import llm_rows
from runlens.llm import secrets

ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.A,
)


def base(text):
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    return found + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]


def only_base(spans):
    return sorted(s for s in spans if s[0] != "novel")


def test_base_spans_of_awkward_texts():
    pieces = (
        ["password", "PassWd", "secret", "token", "API_KEY", "apikey", "AKIA", "KelvinK", "ſecret", "é😀", "'", '"', " ", "  "]
        + ["=", ":", "\n", "abcdef0123456789", "0" * 31, "f" * 40, "ABCDEFGH1234", "x", "a.b-c_d", "/+="]
    )
    rng = random.Random(4)
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        assert only_base(secrets.scan_text(text)) == sorted(base(text)), text


def test_odd_rows(spark):
    got = secrets.scan(llm_rows.odd_documents(spark)).collect()
    assert sorted([(r["id"], [tuple(s) for s in r["spans"]]) for r in got], key=repr) == sorted(
        [(r[0], base(r[1] or "")) for r in llm_rows.odd_rows()], key=repr
    )
    assert secrets.scan(llm_rows.no_documents(spark)).collect() == []


def test_incompressible_strings_near_sensitive_words_are_found():
    rng = random.Random(8)
    for n in (20, 32, 40, 64):
        key = "".join(rng.choices(string.ascii_letters + string.digits, k=n))
        text = f"def connect(self):\n    self.auth_header = 'Bearer {key}'\n    return self.client.get(url)\n"
        at = text.index(key)
        assert ("novel", at, at + n) in secrets.scan_text(text)


def test_compressible_or_plain_strings_are_left_alone():
    for line in (
        "private_key_path = config/settings/production/application2/credentials3",
        "token_type = access_token_response_type_2_string_template_v1",
        "the secret of thonstthationed reinthewhhainonandthe",
        "auth 0000000000000000000000000000000000",
        "private abcdefghijklmnopqrstuvwxyz0123456789",
    ):
        assert [s for s in secrets.scan_text(line) if s[0] == "novel"] == []


def test_far_from_sensitive_words_nothing_is_novel():
    text = "token " + " word" * 40 + " 9fK2mZq7Lx0PvB4tRw8YcJ1d"
    assert secrets.scan_text(text) == []


def test_spans_in_order_and_long_text():
    text = llm_rows.prose(1, 20000) + " token=" + "f" * 40 + " AKIA" + "A1" * 10
    spans = secrets.scan_text(text)
    assert [s[0] for s in spans] == ["assign", "hex", "access"]
    assert spans == sorted(spans, key=lambda s: s[1])


def test_redact(spark):
    rows = [(1, "a token=abcdefgh12 b", 5), (2, None, 6), (3, "password: " + "0" * 40 + "!", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = secrets.redact(docs).collect()
    assert sorted(map(tuple, got)) == [(1, "a <secret> b", 5), (2, None, 6), (3, "<secret>!", None)]


def test_keys_that_occur_again_are_found_each_time(spark):
    rng = random.Random(9)
    for n in (20, 40, 64):
        key = "".join(rng.choices(string.ascii_letters + string.digits, k=n))
        line = f"curl -H 'Authorization: Bearer {key}' https://host/path\n"
        for text in (
            line * 2,
            line * 40,
            line + "some words between them " * 19 + line,
            line + f"Authorization: Bearer {key[: n // 2]}...\n",
            *(f"key {key}" + " x" * gap + f" auth {key} end" for gap in range(230, 260)),
        ):
            want = [(m.start(), m.end()) for m in re.finditer(key, text) if re.search("auth|bearer", text[max(0, m.start() - 48) : m.start()], re.I)]
            assert want and set(want) <= {(a, b) for kind, a, b in secrets.scan_text(text) if kind == "novel"}
    docs = spark.createDataFrame([(1, line * 3)], "doc_id long, text string")
    assert key not in secrets.redact(docs).first()["text"]


def test_values_are_measured_whatever_their_characters_and_side():
    rng = random.Random(10)

    def some(alphabet, n):
        return "".join(rng.choices(alphabet, k=n))

    for line, key in (
        ("Authorization: Bearer {}", some(string.ascii_letters, 40)),
        ("credential = '{}'", some(string.digits, 24)),
        ("pwd: {}", some(string.ascii_letters + string.digits, 8)),
        ("auth_id={}", some(string.ascii_letters, 24)),
        ('passphrase="{}"', some(string.ascii_letters + string.digits, 12)),
        ("'{}' is the auth", some(string.ascii_letters + string.digits, 20)),
        ("{} is the private one", some(string.ascii_letters, 24) + "7"),
    ):
        text = line.format(key)
        at = text.index(key)
        assert any(k == "novel" and a <= at and at + len(key) <= b for k, a, b in secrets.scan_text(text)), text
