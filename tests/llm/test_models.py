import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
import corpus_pipeline
from creditloom.llm import language_model, mixing, ngram_model, url_rules


def test_language_model_rejects_noise_and_keeps_text(spark, stored_docs, labels):
    random.seed(1)
    words = "the of and cat dog house tree water light stone river small great old".split()
    texts = [" ".join(random.choice(words) for _ in range(60)) + "." for _ in range(60)]
    for k in range(0, 60, 4):
        texts[k] = " ".join("".join(random.choice("QXZ#%&|JK!!") for _ in range(6)) for _ in range(60))
    docs = stored_docs(texts + [None, ""])
    cut = language_model.Cut(least=10)
    out = {r.doc_id: r for r in language_model.perplexities(docs, labels, cut).collect()}
    assert all(out[k].kept == (k % 4 != 0) for k in range(60)) and out[60].kept and out[61].kept
    kept = language_model.drop_poor(docs, labels, cut)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, r in out.items() if r.kept}
    assert language_model.drop_poor(docs, labels.where("false")).count() == docs.count()
    assert language_model.perplexities(docs.where("false"), labels).count() == 0


def slow_ngram_chances(texts, order):
    """Like ``slow_kneser_ney``, over code points as they are and a uniform share of all code points."""
    tables = [Counter()]
    for text in texts:
        padded = "\1" * (order - 1) + text
        tables[0].update(padded[k : k + order] for k in range(len(text)))
    for _ in range(order - 1):
        tables.append(Counter(g[1:] for g in tables[-1]))
    cuts = []
    for table in tables:
        spectrum = Counter(table.values())
        cuts.append([0.0, *ngram_model.discounts([spectrum[k] for k in (1, 2, 3, 4)])])

    def chance(gram):
        if not gram:
            return 1 / 0x110000
        k = order - len(gram)
        seen = [n for g, n in tables[k].items() if g[:-1] == gram[:-1]]
        if not seen:
            return chance(gram[1:])
        n = tables[k].get(gram, 0)
        own = n - cuts[k][min(n, 3)]
        return (own + sum(cuts[k][min(m, 3)] for m in seen) * chance(gram[1:])) / sum(seen)

    return chance


def test_perplexity_is_that_of_real_ngrams(spark, stored_docs, monkeypatch):
    monkeypatch.setattr(ngram_model, "BLOCK", 40)
    texts = ["the cat sat on the mat.", "The DOG sat, and the cat ran", "кошка сидит тут", "猫在这里𝒳", None, "", "кошка", "тут \U0010ffff\0"]
    docs = stored_docs(texts)
    labels = spark.createDataFrame([(k, 1, 0) for k in (0, 1, 2, 3, 3)], "doc_id long, quality int, toxic int")
    chance = slow_ngram_chances([t for t in texts[:4]], ngram_model.ORDER)
    out = {r.doc_id: r for r in language_model.perplexities(docs, labels, language_model.Cut(least=1)).collect()}
    for k, text in enumerate(t or "" for t in texts):
        padded = "\1" * (ngram_model.ORDER - 1) + text
        logs = [math.log(chance(padded[i : i + ngram_model.ORDER])) for i in range(len(text))]
        want = math.exp(-sum(logs) / len(logs)) if logs else 1.0
        assert (out[k].n_chars_scored, out[k].perplexity) == (len(text), pytest.approx(want, rel=1e-4))
    # Letters that one class of the old table held are told apart.
    assert out[6].perplexity < out[7].perplexity / 10


def test_language_model_shuffles_no_text(spark, stored_docs, labels, monkeypatch):
    plans, stored = [], ngram_model.stored

    def seen(df, name):
        plans.append(spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted"))
        return stored(df, name)

    monkeypatch.setattr(ngram_model, "stored", seen)
    language_model.perplexities(stored_docs(["the cat sat on the mat."] * 30), labels).collect()
    moved = [line for plan in plans for line in re.findall(r"\) Exchange\n(Input.*)", plan)]
    assert moved and not any("text#" in line or "data#" in line for line in moved)


def test_units_ask_in_parts(spark, stored_docs, monkeypatch):
    texts = ["the cat sat on the mat.", "", "кошка сидит тут", "the cat ran", None, "猫在这里𝒳 and the dog", "dog, and the cat", "x"] * 3
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 24, 2)], "doc_id long, quality int, toxic int")

    def found():
        rows = language_model.perplexities(stored_docs(texts), labels, language_model.Cut(least=1)).collect()
        return {r.doc_id: (r.n_chars_scored, pytest.approx(r.perplexity, rel=1e-6)) for r in rows}

    whole = found()
    for name, value in (("BLOCK", 20), ("UNIT", 3), ("HELD", 10)):
        monkeypatch.setattr(ngram_model, name, value)
    assert found() == whole and len(whole) == 24


def test_ngrams_are_taken_in_parts(monkeypatch):
    texts = ["abcdefgh" * 3, "", "кошка", "\0\U0010ffff", "z"]
    whole = [np.concatenate(c) for c in zip(*ngram_model.grams(texts))]
    monkeypatch.setattr(ngram_model, "PART", 5)
    parts = list(ngram_model.grams(texts))
    assert max(len(high) for high, _, _ in parts) == 5
    assert all((a == np.concatenate(b)).all() for a, b in zip(whole, zip(*parts)))
    assert np.bincount(whole[2], minlength=5).tolist() == [len(t) for t in texts]


def slow_rates(tokens, p, steps):
    rate = np.ones(len(tokens))
    for s in steps:
        rate = np.maximum(0, rate - p @ np.array(s))
    return rate


def test_rates_meet_the_targets(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([4, 1, 0.5], 400).round(3)
    p[:, 0] = 1 - p[:, 1] - p[:, 2]
    tokens = rng.integers(0, 900, 400)
    table = spark.createDataFrame(
        [(int(t), *map(float, row)) for t, row in zip(tokens, p)], "tokens long, p0 double, p1 double, p2 double"
    )
    setting = mixing.Mixing(good=0.8, poor=0.15, toxic=0.05, steps=200, tolerance=1e-4)
    steps, targets = mixing.fit_steps(table, setting)
    rate = slow_rates(tokens, p, steps)
    have = p.T @ (tokens * rate)
    assert (rate >= 0).all() and np.abs(have - targets).max() <= 1e-3 * max(targets)
    got = table.select(mixing.rate_of([F.col(f"p{k}") for k in range(3)], steps).alias("r")).collect()
    np.testing.assert_allclose([r.r for r in got], rate, atol=1e-9)


def test_scarce_domains_are_raised_to_their_weights(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.2, 0.02, 0.002], 3000) * 0.999 + [0.0004, 0.0003, 0.0003]
    tokens = rng.integers(1, 900, 3000)
    rows = [(int(t), *map(float, r)) for t, r in zip(tokens, p)]
    table = spark.createDataFrame(rows, "tokens long, p0 double, p1 double, p2 double")
    own = p.T @ tokens
    assert own[2] < 0.015 * own[0]
    steps, targets, reached = mixing.fit_rates(table, mixing.Mixing())
    assert targets == pytest.approx([own[0], own[0] * 0.04 / 0.94, own[0] * 0.02 / 0.94])
    rate = slow_rates(tokens, p, steps)
    assert rate.max() > 1 and p.T @ (tokens * rate) == pytest.approx(targets, rel=2e-3)
    assert reached == pytest.approx(targets, rel=2e-3)


def least_squares(tokens, p, targets, ceiling, steps=20_000):
    """The least sum of squared relative misses, with a rate for each document, by accelerated projected gradient steps."""
    rates, ahead, pace = np.ones(len(tokens)), np.ones(len(tokens)), 1.0
    mass = tokens[:, None] * p / targets
    length = 1 / np.linalg.eigvalsh(mass.T @ (mass / tokens[:, None])).max()
    for _ in range(steps):
        moved = np.clip(ahead - length * (mass / tokens[:, None]) @ (ahead @ mass - 1), 0, ceiling)
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        rates, ahead, pace = moved, moved + (pace - 1) / faster * (moved - rates), faster
    return ((rates @ mass - 1) ** 2).sum()


@pytest.mark.parametrize("seed, met", [(1, True), (4, True), (3, False), (8, False)])
def test_rates_reach_what_plain_least_squares_reach(spark, seed, met):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet((9, 0.7, 0.4), 300)
    tokens = rng.integers(1, 400, 300).astype(float)
    rows = [(float(t), *map(float, q)) for t, q in zip(tokens, p)]
    table = spark.createDataFrame(rows, "tokens double, p0 double, p1 double, p2 double")
    setting = mixing.Mixing(good=0.8, poor=0.05, toxic=0.15, strict=met)
    steps, targets, reached = mixing.fit_rates(table, setting)
    least = least_squares(tokens, p, np.array(targets), setting.ceiling)
    assert ((np.array(reached) / targets - 1) ** 2).sum() <= 1.25 * least + 3e-6 and (least < 1e-9) == met
    got = [r.r for r in table.select(mixing.rate_of([F.col(f"p{k}") for k in range(3)], steps).alias("r")).collect()]
    assert min(got) >= 0 and max(got) <= setting.ceiling
    assert np.allclose((np.array(got) * tokens) @ p, reached)


def test_a_domain_without_mass_has_no_target(spark):
    rows = [(100.0, 1 - 1e-6 - q, 1e-6, q) for q in np.linspace(0, 0.03, 200).tolist()]
    table = spark.createDataFrame(rows, "tokens double, p0 double, p1 double, p2 double")
    steps, targets, reached = mixing.fit_rates(table, mixing.Mixing(strict=True))
    assert targets[1] is None and reached[1] < 1
    assert reached[0] == pytest.approx(targets[0], rel=1e-3) and reached[2] == pytest.approx(targets[2], rel=1e-3)
    rates = [r.r for r in table.select(mixing.rate_of([F.col(f"p{k}") for k in range(3)], steps).alias("r")).collect()]
    assert sum(r > 0 for r in rates) > 100 and max(rates) <= 8


def test_targets_that_exclude_each_other_are_told(spark):
    table = spark.createDataFrame([(100.0, 0.5, 0.3, 0.2)] * 50, "tokens double, p0 double, p1 double, p2 double")
    with pytest.warns(UserWarning, match="not met"):
        assert mixing.fit_rates(table, mixing.Mixing())[1][0] == pytest.approx(2500)
    with pytest.raises(ValueError, match="not met"):
        mixing.fit_rates(table, mixing.Mixing(strict=True))


def test_mixture_repeats_documents(spark, stored_docs, labels, monkeypatch):
    docs = stored_docs([f"text {k}" for k in range(60)])
    fitted = mixing.fitted

    def twice(*args):
        return fitted(*args)[0], [(-1.5, -1.5, -1.5)], None, None

    monkeypatch.setattr(mixing, "fitted", twice)
    found = Counter(r.doc_id for r in mixing.mix(docs, labels).collect())
    assert set(found.values()) == {2, 3} and len(found) == 60


def test_mixing_of_odd_rows(spark, stored_docs, labels):
    texts = ["plain words of text number %d and some more words" % k for k in range(60)]
    for k in range(0, 60, 4):
        texts[k] = "# $ % & | " * 10 + str(k)
    for k in range(0, 60, 7):
        texts[k] = f"vile nasty words {k} vile nasty"
    docs = stored_docs(texts + [None, "", " "])
    out = mixing.mixing_rates(docs, labels, mixing.Mixing(least_documents=3)).collect()
    assert len(out) == 63 and all(r.rate >= 0 for r in out)
    for r in out:
        assert r.p_good + r.p_poor + r.p_toxic == pytest.approx(1, abs=1e-6)
    by = {r.doc_id: r for r in out}
    assert by[1].p_good > 0.9 and by[4].p_poor > 0.9 and by[7].p_toxic > 0.5
    assert by[1].rate > by[4].rate and by[1].rate > by[7].rate
    mixed = mixing.mix(docs, labels)
    assert mixed.columns == docs.columns
    kept = {r.doc_id for r in mixed.collect()}
    assert {k for k in range(60) if k % 4 and k % 7} <= kept
    assert mixing.mix(docs, labels.where("false")).count() == 63
    assert all(r.rate == 1 for r in mixing.mixing_rates(docs, labels.where("false")).collect())
    assert mixing.mixing_rates(docs.where("false"), labels).count() == 0


def test_main_path_of_mixing_is_native(spark, stored_docs, labels):
    docs = stored_docs()
    for df in (mixing.mixing_rates(docs, labels), mixing.mix(docs, labels)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


URLS = [
    ("http://Foo.NET/x", "foo.net", "/x", "net/", "block"),
    ("http://foo.net", "foo.net", "", None, "allow"),
    ("https://a.example.net/en/1?x=/de/", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://example.com/de/#a", "example.com", "/de/", "example.com/de/", "block"),
    ("https://badexample.com/de/", "badexample.com", "/de/", None, "allow"),
    ("ftp://x.org/fr/a", "x.org", "/fr/a", "org/fr/", "allow"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://", "", "", None, "allow"),
    ("http://x?y/z", "x", "", None, "allow"),
    ("http://ÀB.net:80/é?q#f", "Àb.net:80", "/é", None, "allow"),
    ("a://b\n.net/q\n?z", "b\n.net", "/q\n", "net/", "block"),
]


def test_given_rules(spark):
    rows = [(k, u, "x") for k, (u, *_) in enumerate(URLS)] + [(0, URLS[0][0], "x"), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = url_rules.judged_urls(pages, labels).collect()
    assert len(out) == len(rows) and sum(r.page_id == 0 for r in out) == 2
    by = {r.page_id: r for r in out}
    for k, (_, *want) in enumerate(URLS):
        r = by[k]
        assert [r.host, r.path, r.rule, r.verdict] == want
    assert url_rules.judged_urls(pages.where("false"), labels).count() == 0


def test_mined_rules_equal_brute_force(spark):
    random.seed(8)
    rows, known = [], []
    for k in range(300):
        host, part = random.choice(["a.test", "b.test", "www.c.test"]), random.choice(["buy", "read", "shop"])
        rows.append((k, f"https://{host}/{part}/{k}?id={k}"))
        bad = part == "buy" and host == "b.test" or random.random() < 0.1
        if k < 250:
            known.append((k, int(not bad), 0))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    mining = url_rules.Mining(support=0.01, confidence=0.8, lift=1.5, pages=5)
    out = {r.page_id: r for r in url_rules.judged_urls(pages, labels, (), mining).collect()}
    tokens = {
        r.page_id: frozenset(r.t)
        for r in pages.select("page_id", url_rules.tokens_of(F.col("url")).alias("t")).collect()
    }
    bad = {k for k, q, _ in known if not q}
    share = len(bad) / len(known)
    from itertools import combinations

    support, with_bad = Counter(), Counter()
    for k, _, _ in known:
        for n in range(1, 6):
            for some in combinations(sorted(tokens[k]), n):
                support[some] += 1
                with_bad[some] += k in bad
    least = max(mining.support, mining.pages / len(known)) * len(known)
    rules = {s for s, n in support.items() if with_bad[s] >= least and with_bad[s] / n >= 0.8 and with_bad[s] / n / share >= 1.5}
    assert rules
    for k, have in tokens.items():
        assert (out[k].verdict == "block") == any(set(r) <= have for r in rules), k


def test_pipeline_keeps_whole_and_right_rows(spark, tmp_path):
    from creditloom.llm.common import read

    sf = "/root/testdata/sf0.001"
    docs = read(spark, sf, "documents")
    before = {r.doc_id for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        path = str(tmp_path / name)
        stage(spark, docs, sf).write.parquet(path)
        docs, old = spark.read.parquet(path), docs
        assert docs.columns == old.columns
        kept = {r.doc_id for r in docs.collect()}
        assert kept <= before and len(kept) >= 0.5 * len(before)
        before = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.collect()} == before
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_every_stage_has_workers_that_give_memory_back(spark, monkeypatch):
    """Idle workers kept the memory of freed arrays beside the workers of the next stage."""
    environment = spark.sparkContext.environment
    for name in ("read", "positioned", "drop_poor", "drop_exact_duplicates", "drop_near_duplicates", "mix", "packed_pieces"):
        monkeypatch.setattr(corpus_pipeline, name, lambda *of, **named: None)
    for _, stage in corpus_pipeline.STAGES:
        for key in corpus_pipeline.WORKERS:
            monkeypatch.delitem(environment, key, raising=False)
        stage(spark, None, "")
        assert corpus_pipeline.WORKERS.items() <= environment.items()
    monkeypatch.setitem(environment, "MALLOC_ARENA_MAX", "7")
    assert corpus_pipeline.lean(spark).sparkContext.environment["MALLOC_ARENA_MAX"] == "7"


def test_stages_go_when_their_result_is_stored(spark):
    from creditloom.llm.common import released, stored

    first = stored(spark.range(10).toDF("k"), "first")
    second = stored(first.selectExpr("k * 2 k"), "second")
    with pytest.raises(ValueError):
        released(second.where("k > 2"), first)
    assert released(second, first) is second and second.count() == 10
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound"):
        spark.read.schema("k long").parquet(first._creditloom_path).count()


def test_every_operator_is_registered():
    names = registry.queries().keys()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
