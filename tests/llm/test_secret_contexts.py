"""Values in credential contexts: short ones, contexts inside contexts, ends of values, planted secrets."""

import random
import string
import time

import public_tokenizers
import pytest

from weft.llm import secretscan


@pytest.fixture(scope="module")
def words():
    return secretscan.dictionary(public_tokenizers.path("word_bpe_49k.json"))


def found(text, words):
    return [text[s:e] for s, _, e in secretscan.added_spans(text, secretscan.base_spans(text), words)]


def test_short_and_nested(words):
    assert found("pwd: xK9$f2Q", words) == ["xK9$f2Q"]
    assert found("auth is pwd: xK9$f2Qz", words) == ["xK9$f2Qz"]
    assert found("the token is secret: qhwzkvtx", words) == ["qhwzkvtx"]
    assert found("pwd: a;pwd=xK9$f2Qz;auth=summer", words) == ["a;pwd=xK9$f2Qz;auth=summer"]
    assert found("pwd: ----pwd=----;pwd='xK9$f2Qz'", words)[-1].endswith("xK9$f2Qz")
    assert found("pwd: summer;pwd=winter", words) in ([], ["summer;pwd=winter"])
    assert found("token is, pwd: and secret:", words) == []


def test_ends_of_values(words):
    assert found("pwd: xK9$f2Q!", words) == ["xK9$f2Q!"]
    assert found("is pwd: xK9$f2Qz?", words) == ["xK9$f2Qz?"]
    assert found("(its pwd: xK9$f2Qz).", words) == ["xK9$f2Qz"]
    assert found("pwd: xK9(f2)z, then", words) == ["xK9(f2)z"]
    assert found("pwd: 'xK9$f2Q).'", words) == ["xK9$f2Q)."]


def test_many_contexts_take_linear_time(words):
    for text in ("pwd:" * 20_000, "pwd: " * 20_000, "auth is " * 10_000 + "x", "pwd:a" * 10_000):
        start = time.time()
        found(text, words)
        assert time.time() - start < 20


def test_planted_secrets(words):
    """Recall on random secrets of 7 to 20 characters, precision against words, phrases, dates and walks."""
    rnd = random.Random(11)
    letters = string.ascii_letters + string.digits + "!$%&*#?"
    leads = ("pwd: ", "password is ", "secret: ", "auth is pwd: ", "the token is secret: ", "passphrase=", "credentials: ")
    easy = [w for w in words if 4 <= len(w) <= 7][:4000]
    right = missed = wrong = 0
    for _ in range(2_000):
        lead = rnd.choice(leads)
        if rnd.random() < 0.5:
            value = "".join(rnd.choice(letters) for _ in range(rnd.randint(7, 20)))
            text = f"see {lead}{value} and go on"
            base = secretscan.base_spans(text)  # what a fixed pattern covers is found too
            got = [text[s:e] for s, _, e in base + secretscan.added_spans(text, base, words)]
            hit = any(g.endswith(value) for g in got)
            right, missed = right + hit, missed + (not hit)
        else:
            value = rnd.choice([rnd.choice(easy), rnd.choice(easy).title() + "1999", "2024-05-17", "qwertyuiop", "aaaaaaaaaa", "abcabcabcabc", rnd.choice(easy) + "12"])
            got = found(f"see {lead}{value} and go on", words) if not secretscan.base_spans(lead + value) else []
            wrong += bool(got)
    print("found", right, "missed", missed, "wrong", wrong)
    assert right >= 0.98 * (right + missed) and right >= 0.97 * (right + wrong)
