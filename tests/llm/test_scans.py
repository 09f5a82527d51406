import hashlib
import math
import random
import string
import re
import time
from collections import Counter

import numpy as np
import pytest

from creditloom.llm import private_data, quality_rules, secrets

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def slow_private(text):
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


def pieces(rng, alphabet, n=25):
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(0, n)))


def test_private_base_spans_equal_the_patterns():
    rng = random.Random(1)
    alphabet = ["a", "b1", "@", "@", ".", "-", " ", "+", "1", "255", "256", "0", "(", ")", "é", "\n", "4111111111111111",
                "+1 (017) 555-7713", "x.y@z.co", "1.2.3.4", "00012"]
    for _ in range(6000):
        text = pieces(rng, alphabet)
        assert private_data.base_spans(text) == slow_private(text), text


def test_private_patterns_are_linear_on_long_runs():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 200_000, "+" * 200_000, "a@" * 100_000):
        private_data.base_spans(text)
        private_data.candidates(text, [])
        secrets.scan(text)


def test_skip_edges_carry_a_label_to_other_mentions(stored_docs):
    known = [f"call +1 (017) 555-77{k:02d} now" for k in range(10, 60)]
    cards = [f"card 4111111111111111 or {k} more" for k in range(40)]
    # The second mention of the address has no dot in its domain, so no pattern takes it.
    mails = [f"write jo.{k}@mail.example.com first , then words and words jo.{k}@mailexamplecom again" for k in range(60)]
    docs = stored_docs(known + cards + mails + [None, "", "no data 12 here"])
    out = {r.doc_id: r for r in private_data.private_data(docs, sure=0.6).collect()}
    assert len(out) == len(known + cards + mails) + 3
    for r in docs.collect():
        base = slow_private(r.text or "")
        text = ",".join(f"{private_data.KINDS[k]}:{s}:{e}" for s, k, e in base)
        got = out[r.doc_id]
        assert got.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [got.n_email, got.n_ip, got.n_card, got.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert set(filter(None, text.split(","))) <= set(got.spans.split(","))
    first = len(known + cards)
    added = [k for k in range(first, first + len(mails)) if out[k].spans.count("email") == 2]
    assert len(added) > 50
    assert out[len(out) - 1].spans == ""


def exact_marginals(field, rows):
    """By summing over all labellings."""
    import itertools

    n, labels = len(rows), len(private_data.LABELS)
    skips = private_data.skip_edges(rows).tolist()
    total = np.zeros((n, labels))
    for y in itertools.product(range(labels), repeat=n):
        if any(r[5] != private_data.NONE and r[5] != v for r, v in zip(rows, y)):
            continue
        score = sum(field.unary[r[2], v] for r, v in zip(rows, y) if r[5] == private_data.NONE)
        score += sum(field.step[y[k], y[k + 1]] for k in range(n - 1))
        score += sum(field.skip[y[i], y[j]] for i, j in skips)
        for k, v in enumerate(y):
            total[k, v] += math.exp(score)
    return total / total.sum(axis=1, keepdims=True)


def test_message_passing_is_exact_on_chains_and_close_on_loops():
    rng = np.random.default_rng(2)
    field = private_data.Field(
        rng.integers(0, 30, (private_data.SHAPES, 5)), rng.integers(0, 30, (5, 5)), rng.integers(0, 30, (5, 5))
    )
    chain = np.array([(0, 1, 7, 0, 0, 4), (2, 3, 9, 0, 0, 4), (4, 5, 11, 0, 0, 0), (6, 7, 13, 0, 0, 4)])
    np.testing.assert_allclose(field.marginals(chain, rounds=40), exact_marginals(field, chain), atol=1e-6)
    loop = chain.copy()
    loop[[0, 3], 3] = 99
    assert private_data.skip_edges(loop).tolist() == [[0, 3]]
    np.testing.assert_allclose(field.marginals(loop, rounds=60), exact_marginals(field, loop), atol=0.1)


ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"""
    r"""[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def slow_secrets(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(s, e, secrets.KINDS[k]) for s, k, e in sorted(found)]


def test_secret_base_spans_equal_the_patterns():
    rng = random.Random(3)
    alphabet = ["password", "PassWd", "secret", "ToKen", "api_key", "apikey", "=", ":", " ", '"', "'", "abc", "0123456789abcdef",
                "AKIA", "ABCDEFGH12", "x" * 12, "é", "ſecret", "toKen", "f", "\n", "."]
    for _ in range(6000):
        text = pieces(rng, alphabet, 14)
        assert secrets.base_spans(text) == slow_secrets(text), text


def entropy(text):
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def test_incremental_entropy_equals_every_window():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("abcdeXYZ0189+/") for _ in range(rng.randint(1, 60)))
        for width in (1, 5, 20):
            w = min(width, len(text))
            want = max(entropy(text[k : k + w]) for k in range(len(text) - w + 1))
            assert secrets.max_entropy(text, width) == pytest.approx(want, abs=1e-9)


def test_entropy_finds_random_strings_and_spares_the_allow_list(stored_docs):
    random_key = "q7Zp0LxV2bN9dKfT4mWs8RyH"
    uuid = "123e4567-e89b-12d3-a456-426614174000"
    texts = [f"key {random_key} end", f"id {uuid} end", "a-very-long-name-of-plain-words here", "9" * 40, None, "",
             f"token = {random_key}", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1B"]
    docs = stored_docs(texts)
    out = [r for r in secrets.secrets(docs).orderBy("doc_id").collect()]
    assert out[0].spans == f"entropy:4:{4 + len(random_key)}"
    assert "entropy" not in "".join(r.spans for r in out[1:])
    assert out[6].spans == f"assign:0:{8 + len(random_key)}"
    own = secrets.secrets(docs, allow=(random_key,)).orderBy("doc_id").collect()
    assert own[0].spans == "" and own[6].spans == out[6].spans
    clean = [r.text for r in secrets.redacted(docs).orderBy("doc_id").collect()]
    assert clean[0] == "key [secret] end" and clean[4] is None and clean[2] == texts[2]
    assert secrets.secrets(docs.where("false")).count() == 0


def slow_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_counts_equal_the_definitions():
    rng = random.Random(6)
    for _ in range(800):
        text = pieces(rng, ["a", "b", "c d", " ", " ", "\n", "#", "é|", "\x1c", " ", "\t"], 60)
        assert quality_rules.statistics(text)[:5] == slow_counts(text), text


def test_scores_never_rise_on_falling_statistics():
    rng = np.random.default_rng(7)
    x = rng.random((3000, len(quality_rules.STATISTICS)))
    noise = rng.random(3000)
    good = (x[:, 2] + 0.5 * x[:, 5] - 0.8 * x[:, 0] + 0.4 * noise) < 0.4
    forest = quality_rules.fit(x, good)
    assert ((forest.score(x) > 0.5) == good).mean() > 0.85
    for name in quality_rules.FALLING:
        k = quality_rules.STATISTICS.index(name)
        probe = np.repeat(x[:50], 41, axis=0)
        probe[:, k] = np.tile(np.linspace(-0.2, 1.2, 41), 50)
        assert (np.diff(forest.score(probe).reshape(50, 41), axis=1) <= 1e-12).all()


def test_quality_verdicts(stored_docs, labels):
    good = ["These are plain words of a fair text number %d with nothing odd in them at all ." % k for k in range(60)]
    for k in range(0, 60, 4):
        good[k] = "### $$$ %% ** BUY && NOW || " * 1 + " ".join(f"W{j}#*" for j in range(k, k + 20))
    docs = stored_docs(good + [None, "too short"])
    setting = quality_rules.Boosting(least_weight=0.5)
    out = {r.doc_id: r for r in quality_rules.judged(docs, labels, setting).collect()}
    assert not out[60].kept and not out[61].kept and out[60].base_failed
    right = [out[k].kept == (k % 4 != 0) for k in range(60)]
    assert sum(right) >= 58
    alone = quality_rules.judged(docs, labels.where("false")).collect()
    assert all(r.kept != r.base_failed for r in alone)
    assert quality_rules.judged(docs.where("false"), labels).count() == 0


@pytest.mark.parametrize("run", ["a" * 100_000, "ACGT" * 25_000, "some-slug-of-words-" * 5_000, "Ab" * 50_000])
def test_allow_list_is_linear(run):
    began = time.process_time()
    secrets.scan(run + "7")
    assert time.process_time() - began < 5


def test_sequences_hide_only_themselves():
    secret = "q7Rk2ZpX9vLm4TbW8sYc"
    for text in (secret + "0123456789", "abcdefghijklm" + secret, secret[:12] + "0123456789" + secret[12:]):
        assert secrets.scan(text)[-1] == f"entropy:0:{len(text)}"
    for text in ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789abcdef" * 3, "my-0123456789-and-other-words"):
        assert "entropy" not in secrets.scan(text)[-1]


@pytest.mark.parametrize("letters", [string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters])
def test_letters_in_random_order_are_no_words(letters):
    rng = random.Random(9)
    found = sum("entropy" in secrets.scan("key " + "".join(rng.sample(letters, 22)) + " end")[-1] for _ in range(200))
    assert found >= 150
    for text in ("internationalisation-of-telecommunications", "someVeryLongIdentifierOfWords", "UNCOMMONLY_LONG_CONSTANT_NAME"):
        assert secrets.scan(text)[-1] == ""


def test_redacted_keeps_what_the_caller_allows(stored_docs):
    key = "q7Zp0LxV2bN9dKfT4mWs8RyH"
    docs = stored_docs([f"key {key} end"])
    assert secrets.redacted(docs, allow=(key,)).first().text == f"key {key} end"


def test_production_defaults_add_mentions_that_no_pattern_takes(stored_docs):
    # Known mentions that repeat tell that repeats can be believed.
    twice = [f"call +1 (017) 555-{k:04d} or +1-017-555-{k:04d} again" for k in range(2000)]
    mixed = [f"call +1-018-555-{k:04d} now , words 1018555{k:04d} and more 1018555{k:04d}" for k in range(40)]
    clean = [f"order 2018555{k:04d} of 3018555{k:04d}" for k in range(40)]
    out = {r.doc_id: r for r in private_data.private_data(stored_docs([*twice, *mixed, *clean])).collect()}
    added = [out[k].spans.count("phone") for k in range(len(twice), len(twice) + len(mixed))]
    assert sum(n == 3 for n in added) >= 38
    assert not any(out[k].spans for k in range(len(twice) + len(mixed), len(out)))
