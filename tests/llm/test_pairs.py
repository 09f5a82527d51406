import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.llm import divergence, hard_negatives, minhash

# ---- hard negatives ----------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, row string, anchor string, vector string"


def frame(spark, tmp_path_factory, rows, schema=VECTORS):
    path = str(tmp_path_factory.mktemp("rows") / "table.parquet")
    spark.createDataFrame(rows, schema).coalesce(3).write.parquet(path)
    return spark.read.parquet(path)


def brute_negatives(rows):
    kept = []
    for k, (i, v, label, *_) in enumerate(rows):
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label, k))
    out = []
    for i, v, label, k in kept:
        if i % 50:
            continue
        dots = sorted((-sum(a * b for a, b in zip(v, w)), j, m, other) for j, w, other, m in kept if m != k)
        for minus, j, _, _ in [d for d in dots if d[3] == label][:5]:
            inside = [d for d in dots if d[3] != label and 50 * -minus <= 100 * -d[0] <= 95 * -minus][:3]
            out += [(i, j, n, d[1], -minus, -d[0]) for n, d in enumerate(inside, 1)]
    return sorted(out)


def vector_rows(n, dims, seed, levels=None):
    rng = random.Random(seed)
    value = (lambda: rng.choice(levels)) if levels else (lambda: rng.gauss(0.2, 0.4))
    return [(k, [value() for _ in range(dims)], rng.randrange(4), "x", "y", "z") for k in range(n)]


@pytest.mark.parametrize("levels", [None, (0.0, 0.25, 0.5), (0.0,), (-1.0, 1.0)])
def test_hard_negatives_equal_brute_force(spark, tmp_path_factory, monkeypatch, levels):
    monkeypatch.setattr(hard_negatives, "ROWS", 60)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    rows = vector_rows(320, 6, 5, levels)
    rows[3], rows[50], rows[51] = (3, None, 1, "", "", ""), (50, [float("nan")] * 6, 1, "", "", ""), (51, [0.5] * 6, None, "", "", "")
    rows += [(None, [0.5] * 6, 1, "", "", ""), (900, [0.3, None, 0.1, 0.0, 0.0, 0.0], 1, "", "", ""), (901, [float("inf")] * 6, 2, "", "", "")]
    rows += [(902, [0.5, 0.5], 2, "", "", ""), (903, [], 1, "", "", ""), (950, [0.75] * 6, 3, "", "", "")]
    table = frame(spark, tmp_path_factory, rows)
    found = hard_negatives.hard_negatives(table, F.col("vec_id") % 50 == 0)
    got = sorted(tuple(r) for r in found.collect())
    assert got == brute_negatives(rows) and (got or levels == (0.0,))


def test_hard_negatives_of_repeated_rows_and_without_anchors(spark, tmp_path_factory):
    rows = [(0, [1.0], 1, "", "", ""), (0, [1.0], 1, "", "", ""), (1, [0.9], 1, "", "", ""), (2, [0.6], 2, "", "", ""), (2, [0.6], 2, "", "", "")]
    table = frame(spark, tmp_path_factory, rows)
    got = Counter(tuple(r) for r in hard_negatives.hard_negatives(table, F.col("vec_id") == 0).collect())
    assert got[(0, 0, 1, 2, 65536, 39168)] == 2 and got[(0, 0, 2, 2, 65536, 39168)] == 2
    assert hard_negatives.hard_negatives(table, F.col("vec_id") == 77).count() == 0
    assert hard_negatives.hard_negatives(table.where("false"), F.col("vec_id") == 0).count() == 0


def test_large_components_are_exact_or_refused(spark, tmp_path_factory):
    big = 2.0**30
    rows = [(k, [big, float(k)], k % 2, "", "", "") for k in range(4)]
    table = frame(spark, tmp_path_factory, [(k, v, n, a, b, c) for k, v, n, a, b, c in rows])
    with pytest.raises(Exception, match="beyond 64 bits"):
        hard_negatives.hard_negatives(table, F.col("vec_id") == 0).collect()
    near = frame(spark, tmp_path_factory, [(k, [2.0**20, float(k)], k % 2, "", "", "") for k in range(4)])
    spec = hard_negatives.Mining(high=100)
    got = {tuple(r)[:4] for r in hard_negatives.hard_negatives(near, F.col("vec_id") == 0, spec).collect()}
    assert got == {(0, 2, 1, 1), (0, 2, 2, 3)}


def test_keys_sort_as_their_numbers():
    rng = np.random.default_rng(2)
    rows = [tuple(int(x) for x in rng.integers(-50, 50, 6)) for _ in range(300)]
    import pyarrow as pa

    own = pa.table({"vec_id": [r[0] for r in rows], "row": [abs(r[1]) for r in rows]})
    other = pa.table({"vec_id": [r[4] for r in rows], "row": [abs(r[5]) for r in rows]})
    each = np.arange(len(rows))
    scores = hard_negatives._Diagonal(np.array([r[2] for r in rows]))
    keys = hard_negatives._keys(own, other, each, each, scores, 1)["key"].to_pylist()
    want = sorted(range(len(rows)), key=lambda k: (rows[k][0], abs(rows[k][1]), -rows[k][2], rows[k][4], abs(rows[k][5])))
    assert [keys[k] for k in want] == sorted(keys)
    assert hard_negatives.unpacked(keys[0])[:3] == (rows[0][0], abs(rows[0][1]), rows[0][2])


# ---- source divergence -------------------------------------------------------------------------


def brute_divergence(docs, least=3, top=200):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    seen, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for r in docs:
        lang, source = r.lang or "", r.source or ""
        groups.add((lang, source))
        seen[lang].update(set(words(r.text)))
        count[lang, source].update(words(r.text))
    out = []
    for lang, source in groups:
        kept = [w for w, n in seen[lang].items() if n >= least]
        own = [g for g in groups if g[0] == lang]
        share = lambda n, total: 1 + 10**9 * (n + 1) // (total + len(kept))
        total = {g: sum(count[g][w] for w in kept) for g in own}
        p = {g: {w: share(count[g][w], total[g]) for w in kept} for g in own}
        q = {w: share(sum(count[g][w] for g in own), sum(total.values())) for w in kept}
        f = lambda a, b: (a - b) ** 2 // b
        pairs = [(sum(f(p[lang, source][w], p[g][w]) for w in kept), g[1]) for g in own if g[1] != source]
        told = [(f(p[lang, source][w], q[w]), w) for w in kept if count[lang, source][w] and p[lang, source][w] > q[w]]
        for part, rows, limit in (("pair", pairs, None), ("term", told, top)):
            rows = sorted(rows, key=lambda x: (-x[0], x[1].encode()))[:limit]
            out += [(lang, source, part, item, v, k) for k, (v, item) in enumerate(rows, 1)]
    return sorted(out)


DOCS = "text string, lang string, source string, term string, n string, gid string"


@pytest.mark.parametrize("section_terms", [1_000_000, 9])
def test_divergence_equals_brute_force(spark, tmp_path_factory, monkeypatch, section_terms):
    for name, value in (("SOURCES", 4), ("ENTRIES", 20), ("AT_ONCE", 30)):
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(8)
    words = ["One", "two", "THREE", "Éé", "日本", "x1y", "a-b", "it's", *[f"w{chr(97 + k)}" for k in range(20)]]
    rows = []
    for k in range(400):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice([None, *[f"s{j}" for j in range(9)]])
        text = rng.choice([None, "", " 12 ", *[" ".join(rng.choices(words, k=rng.randrange(1, 30))) for _ in range(9)]])
        rows.append((text, lang, source, "c", "c", "c"))
    rows += [("rare words here", "zz", "s0", "", "", ""), ("1 2", "zz", "s1", "", "", ""), ("same", "", "only", "", "", "")]
    rows += [("long " * 100_000, "en", "s1", "", "", "")]
    docs = frame(spark, tmp_path_factory, rows, DOCS)
    audit = divergence.Audit(section_terms=section_terms)
    got = sorted(tuple(r) for r in divergence.source_divergence(docs, audit).collect())
    assert got == brute_divergence(docs.collect())


def test_only_the_leading_terms_and_no_documents(spark, tmp_path_factory):
    rows = [(f"{chr(97 + k % 26)}{chr(97 + k // 26)}", "en", f"s{k % 2}", "", "", "") for k in range(500) for _ in range(3)]
    docs = frame(spark, tmp_path_factory, rows, DOCS)
    found = divergence.source_divergence(docs, divergence.Audit(top=7))
    assert {(r.source, r["max(rank)"]) for r in found.where("part = 'term'").groupBy("source").agg({"rank": "max"}).collect()} == {("s0", 7), ("s1", 7)}
    assert divergence.source_divergence(docs.where("false")).count() == 0


def test_shares_beyond_64_bits_are_exact(spark):
    row = spark.sql("select 20000000000L n, 90000000000L total, 7L kept").select(divergence.share("n", "total", "kept").alias("p")).first()
    assert row.p == 1 + 10**9 * 20000000001 // 90000000007


# ---- MinHash -----------------------------------------------------------------------------------


def brute_sets(texts, words=3):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    return out


def brute_parts(sets, percent=85):
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(k) for k in range(len(sets))]


def families(seed, count, members, length):
    """Texts that drift apart step by step, so that links form chains, near the limit."""
    rng, texts = random.Random(seed), []
    for f in range(count):
        words = [f"f{f}w{rng.randrange(400)}" for _ in range(length)]
        for _ in range(members):
            texts.append(" ".join(words))
            words = list(rng.choice([words, texts[-1].split()]))
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    rng.shuffle(texts)
    return texts


def check_parts(docs):
    rows = docs.collect()
    sets = brute_sets([r.text for r in rows])
    parts = brute_parts(sets)
    got = {r.doc_id: r for r in minhash.minhash_duplicates(docs).collect()}
    assert len(got) == len(rows)
    least = defaultdict(list)
    for r, p in zip(rows, parts):
        least[p].append(r.doc_id)
    for r, s, p in zip(rows, sets, parts):
        found = got[r.doc_id]
        assert (found.n_shingles, found.component_id) == (len(s), min(least[p]))
        assert found.kept == (r.doc_id == found.component_id)
    return parts


def test_minhash_components_equal_brute_force(stored_docs):
    texts = families(1, 12, 8, 60) + ["", None, "one", "One", "one two", "one  TWO", "\x1cq \x85", "a b c", "a b c a b c", "A b c"]
    parts = check_parts(stored_docs(texts))
    assert len(set(parts)) < len(texts) - 20


@pytest.mark.parametrize("hubs", [1, 8])
def test_blocks_of_large_groups_lose_no_link(stored_docs, monkeypatch, hubs):
    monkeypatch.setattr(minhash, "BLOCK", 10)
    monkeypatch.setattr(minhash, "HUBS", hubs)
    check_parts(stored_docs(families(3, 3, 70, 60)))


def test_minhash_of_repeated_rows_null_ids_and_no_rows(stored_docs):
    docs = stored_docs(["a b c d", "a b c d", "A b c d", "z y", "z y", None, ""], [5, 5, 3, None, None, None, 9])
    got = Counter(tuple(r) for r in minhash.minhash_duplicates(docs).collect())
    want = [(5, 2, 3, False)] * 2 + [(3, 2, 3, True)] + [(None, 1, None, True)] * 2 + [(None, 0, None, True), (9, 0, 9, True)]
    assert got == Counter(want)
    assert minhash.minhash_duplicates(docs.where("false")).count() == 0


def test_estimates_are_near_the_similarity():
    spec, rng = minhash.MinHash(), np.random.default_rng(6)
    for similar in (0.3, 0.6, 0.85, 1.0):
        errors = []
        for _ in range(30):
            shared = rng.integers(0, 1 << 63, int(600 * similar), np.uint64)
            rest = [rng.integers(0, 1 << 63, (600 - len(shared)) // 2, np.uint64) for _ in range(2)]
            least = np.stack([minhash.minima(np.concatenate([shared, r]), spec) for r in rest])
            marks = minhash.signatures(least)
            assert marks.shape[1] == spec.hashes // 4
            errors.append(minhash.estimates(marks[:1], marks[1:], spec.hashes)[0, 0] - similar)
        assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.18


def test_bands_miss_next_to_nothing():
    spec, rng = minhash.MinHash(), np.random.default_rng(7)
    met = 0
    for _ in range(300):
        shared = rng.integers(0, 1 << 63, 170, np.uint64)
        rest = [rng.integers(0, 1 << 63, 15, np.uint64) for _ in range(2)]
        keys = minhash.band_keys(np.stack([minhash.minima(np.concatenate([shared, r]), spec) for r in rest]), spec)
        met += bool((keys[0] == keys[1]).any())
    assert met == 300
    assert abs(spec.floor - 0.667) < 0.01
