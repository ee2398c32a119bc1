from __future__ import annotations

import hashlib
import random
import re

import pytest

from covenantry.llm import automaton, secret_scan

RANDOM = [
    (["ab*c|b", "a+", "(ab|ba){2,3}"], "abc"),
    (["a[ab]{2}c?", "b+a*b", "c(a|bc)+", "[^a]".replace("^", "b")], "abc"),
    (["ab", "abab", "(a|b)*c", "ca{0,2}b"], "abc"),
]


def slow_matches(expression, text):
    """Leftmost, then longest, then on from its end: every place and every length is tried."""
    found, at = [], 0
    while at < len(text):
        ends = [e for e in range(len(text), at, -1) if re.fullmatch(expression, text[at:e])]
        if ends:
            found.append((at, ends[0]))
            at = ends[0]
        else:
            at += 1
    return found


@pytest.mark.parametrize(("expressions", "letters"), RANDOM)
def test_matches_are_those_of_all_places_and_lengths(expressions, letters):
    scanner = automaton.Scanner([(x, False) for x in expressions])
    draw = random.Random(5)
    for _ in range(300):
        text = "".join(draw.choices(letters, k=draw.randint(0, 18)))
        got = scanner.matches(text.encode())
        assert [got.get(k, []) for k in range(len(expressions))] == [slow_matches(x, text) for x in expressions], text


def test_minimal_automaton_has_the_least_number_of_states():
    assert automaton.Automaton.of(automaton.parse("(a|b)(c|d)|ac|bd")).n_states == 4  # three and a dead one
    assert automaton.Automaton.of(automaton.parse("a{3,}")).n_states == 5
    with pytest.raises(ValueError, match="empty"):
        automaton.Scanner([("a*", False)])


def slow_spans(text):
    """All rules by the standard library's expressions; for these its first match is the longest one."""
    found = []
    for k, rule in enumerate(secret_scan.RULES):
        for m in re.finditer(f"({rule.lead})({rule.body})", text, re.ASCII | (re.IGNORECASE if rule.either_case else 0)):
            body = m.end() - (re.match(rule.lead, m.group(), re.ASCII | (re.IGNORECASE if rule.either_case else 0)).end() + m.start())
            if body >= rule.least:
                found.append((m.start(), k, m.end()))
    return [f"{secret_scan.RULES[k].kind}:{a}:{b}" for a, k, b in sorted(found)]


PIECES = [
    "token", "Secret", "API_KEY", "apikey", "passwd", "password", "=", ":", " ", "  ", '"', "'", "abc", "abcdef", "x.y/z", "é", "語", "\n", "AKIA", "AKI",
    "A1B2C3D4E5F6G7H8", "ABCD", "0123456789abcdef", "deadbeef", "f", "ghp_", "x" * 36, "xoxb-", "AIza", "eyJ", ".", "sk_live_", "://", "@", "-----BEGIN ", "RSA ",
    "PRIVATE KEY-----", "http", "us", "\x00", "\x01", "\x02", "İ", "K", "ſecret",
]


def test_spans_against_the_standard_library(spark, docs_of):
    draw = random.Random(11)
    texts = ["".join(draw.choices(PIECES, k=draw.randint(0, 40))) for _ in range(1500)]
    # longer matches that random pieces hardly give
    texts += ["token=token:abcdef", "token==abcdef", "AKIAAKIA" + "B" * 20, "AKIA" + "A" * 15, "AKIA" + "A" * 16, "0" * 23, "0" * 24 + "g" + "a" * 30, "secretoken=abcdefg"]
    texts += ["key AIza" + "b" * 35, "eyJabc.eyJdef." + "g" * 20 + ".eyJ.eyJa.b", "https://ann:s3cr3t@host/ and http://a:b@c", "-----BEGIN RSA PRIVATE KEY-----\n-----BEGIN PRIVATE KEY-----"]
    got = {r.doc_id: r for r in secret_scan.digest(docs_of(list(enumerate(texts)))).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = slow_spans(text)
        base = [x for x in want if x.split(":")[0] in ("assign", "access", "hex")]
        assert got[i].spans == ",".join(want), text
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(x.startswith(k + ":") for x in base) for k in ("assign", "access", "hex")]


def test_null_empty_repeated_and_empty_table(docs_of):
    rows = secret_scan.digest(docs_of([(1, None), (1, None), (None, "token=abcdefg"), (2, "")])).collect()
    assert sorted((r.doc_id or 0, r.n_assign, r.spans) for r in rows) == [(0, 1, "assign:0:13"), (1, 0, ""), (1, 0, ""), (2, 0, "")]
    assert {r.base_sha256 for r in rows if r.doc_id} == {hashlib.sha256(b"").hexdigest()}
    assert secret_scan.digest(docs_of([])).count() == 0


def test_very_long_texts_are_scanned_in_linear_time():
    scanner = secret_scan.SecretScanner()
    n = 1 << 20
    for text, spans in (
        ("0123abcd" * (n // 8), [(0, 2, n)]),
        ("token=" * (n // 6), [(0, 0, n // 6 * 6)]),
        ("secret" + " " * n + "x", []),
        ("eyJa." * (n // 5), None),
        ("é" * n + " token = 'abcdefgh'", [(n + 1, 0, n + 18)]),
    ):
        got = scanner.spans(text.encode())
        assert spans is None or got == spans
