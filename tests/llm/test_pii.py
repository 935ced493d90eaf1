import hashlib
import random
import re
import time

from tarnworks.llm import pii
from tarnworks.llm.common import read

from . import docs

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }
            if fits[kind]:
                found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda s: (s[0], pii.RANK[s[2]]))


def test_base_spans_equal_the_patterns():
    rng, anchors = random.Random(5), pii.automaton()
    texts = ["".join(rng.choice("0123456789..--  ++()@@ab.%_é\n") for _ in range(rng.randint(0, 60))) for _ in range(20_000)]
    texts += [r[1] for r in docs.ROWS]
    for text in texts:
        assert [s for s in pii.find(text, anchors) if s[2] in pii.BASE] == brute(text), text


def test_further_kinds():
    text = 'Account no: 12345678, IBAN DE89 3704 0044 0532 0130 00; see https://x.org/a?b=1. token = "abcdef123456"'
    kinds = {text[s:e]: k for s, e, k in pii.find(text, pii.automaton())}
    assert kinds["DE89 3704 0044 0532 0130 00"] == "iban"
    assert kinds["https://x.org/a?b=1"] == "url"
    assert kinds["abcdef123456"] == "secret"


def test_hostile_texts_take_linear_time():
    anchors = pii.automaton()
    for piece in ("a://", "1://", "token", "token=", "token: ", "account 1 ", "iban DE89 3704 ", "a@", "a@a.", "+1 (", "1.", "1-", "x://."):
        text = piece * (5_000_000 // len(piece))
        began = time.perf_counter()
        pii.find(text, anchors)
        assert time.perf_counter() - began < 20, piece


def test_spans_of_a_kind_do_not_overlap():
    rng, anchors = random.Random(8), pii.automaton()
    for _ in range(3000):
        text = "".join(rng.choice(["token", "=", "a1", "://", "http", " ", "account", "12345678", "password", ":", "\"", "b2c3d4e5", "x", "."]) for _ in range(30))
        spans = pii.find(text, anchors)
        for kind in ("url", "account", "secret"):
            own = [s for s in spans if s[2] == kind]
            assert all(a[1] <= b[0] for a, b in zip(own, own[1:])), text


def test_planted_secrets_are_found(spark):
    rows = read(spark, "/root/testdata/sf0.01", "documents").where("text rlike 'token = \"[0-9a-f]{40}\"'").collect()
    assert rows
    for r in rows:
        found = {r.text[s:e] for s, e, k in pii.find(r.text, pii.automaton()) if k == "secret"}
        assert set(re.findall(r'token = "([0-9a-f]{40})"', r.text)) <= found


def test_rows(spark):
    rows = pii.pii_digest(docs.docs(spark)).collect()
    assert len(rows) == len(docs.ROWS)
    nine = next(r for r in rows if r.doc_id == 9)
    assert (nine.n_email, nine.n_ip, nine.n_card, nine.n_phone) == (1, 1, 1, 1)
    assert nine.n_personal == 4 and nine.n_secret == nine.n_url == 0
    none = next(r for r in rows if r.doc_id == 1)
    assert none.spans == "" and none.base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.pii_digest(docs.empty(spark)).count() == 0
    values = {s.value for r in pii.find_pii(docs.docs(spark)).collect() for s in r.spans}
    assert "a.b@c.org" in values
