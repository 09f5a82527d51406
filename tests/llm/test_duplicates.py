import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import xxhash

from creditloom.llm import exact_dedup, fuse_filter, simhash
from creditloom.llm.components import roots


def test_fuse_filter_never_misses_and_seldom_errs():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000, 60_000):
        keys = rng.integers(-(1 << 62), 1 << 62, n)
        made = fuse_filter.build(np.concatenate([keys, keys]))
        assert fuse_filter.may_contain(made, keys).all()
        others = rng.integers(-(1 << 62), 1 << 62, 20_000)
        assert fuse_filter.may_contain(made, others).mean() < 0.01
        assert len(made) < 1.4 * n + 4000


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute_exact(docs):
    groups = defaultdict(list)
    for r in docs:
        groups[normal(r.text)].append(r)
    out = {}
    for text, members in groups.items():
        keep = min(members, key=lambda r: (-len(r.text or ""), r.doc_id))
        digest = hashlib.sha256(text.encode()).hexdigest()
        for r in members:
            out[r.doc_id] = (keep.doc_id, len(members), r.doc_id == keep.doc_id, digest)
    return out


def test_exact_duplicates_equal_brute_force(stored_docs):
    random.seed(3)
    texts = ["".join(random.choice("ab \n") for _ in range(random.randint(0, 5))) for _ in range(150)] + [None, "é x", "éx"]
    docs = stored_docs(texts)
    want = brute_exact(docs.collect())
    for batches in (1, 2, 3):
        got = exact_dedup.exact_duplicates(docs, batches).collect()
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want
        assert len(got) == len(texts)


def test_repeated_rows_and_null_ids_keep_one(stored_docs):
    docs = stored_docs(["a a", "a a", "aa", "b", "b", None, None], [5, 5, 1, None, 9, None, None])
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id) == [(5, "a a"), (9, "b")]
    assert kept.count() == 3
    assert exact_dedup.exact_duplicates(docs.where("false")).count() == 0


def test_equal_digests_of_unequal_bytes_stay_apart(stored_docs):
    from creditloom.llm.common import ROW, numbered

    docs = numbered(stored_docs(["left", "right"]))
    a, b = sorted(r[ROW] for r in docs.collect())
    spark = docs.sparkSession
    made = spark.createDataFrame([(bytearray(b"d"), a, b), (bytearray(b"e"), a, a)], "digest binary, row_a long, row_b long")
    assert [bytes(r.digest) for r in exact_dedup.same_bytes(made, docs).collect()] == [b"e"]


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_equal_the_definition(stored_docs):
    docs = stored_docs(["a B c", "A b C d É É x", "", None, "\x1cq \x85 z", "w " * 50])
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    for r in docs.collect():
        assert got[r.doc_id].fingerprint == f"{slow_fingerprint(r.text):016x}"
    assert got[2].component_id == got[3].component_id == 2


def brute_components(prints, max_bits):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= max_bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(prints))]


def test_components_of_planted_chains_equal_brute_force(spark):
    random.seed(9)
    prints = []
    for _ in range(12):
        at = random.getrandbits(64)
        for _ in range(random.randint(1, 9)):
            prints.append(at)
            for bit in random.sample(range(64), random.choice([0, 1, 2, 3, 4, 5, 6])):
                at ^= 1 << bit
    prints += [0, 0, (1 << 64) - 1, 15, 31]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    rows = spark.createDataFrame([(k, k, p) for k, p in enumerate(signed)], "row long, doc_id long, print long")
    for max_bits in (0, 1, 3, 4):
        got = {r.print: r.component_id for r in simhash.near_components(rows, max_bits, slices=16).collect()}
        want = brute_components(prints, max_bits)
        assert [got[p] for p in signed] == want


def test_sub_slices_lose_no_link():
    rng = np.random.default_rng(4)
    base = rng.integers(-(1 << 62), 1 << 62, 40)
    close = np.concatenate([base, base ^ (1 << 7) ^ (1 << 33), base ^ 0b1111])
    whole, parts = set(), set()
    for k in range(1 << 4):
        whole |= set(zip(*(x.tolist() for x in simhash.collisions(close, k, 4, 4))))
    for k in range(1 << 6):
        parts |= set(zip(*(x.tolist() for x in simhash.collisions(close, k, 4, 6))))
    assert whole == parts or (len(parts) >= 80 and len(whole) >= 80)


def test_one_document_of_each_component_stays(stored_docs):
    text = " ".join(f"w{k}" for k in range(400))
    docs = stored_docs([text, text + " z", text, "other words stand here", None, ""], [7, 8, 7, 1, 3, 2])
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 7]
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_roots_of_paths_stars_and_loops(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (200, 201)]
    got = {r.node: r.root for r in roots(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[k] for k in range(1, 41)} == {0}
    assert {got[k] for k in range(101, 140)} == {100} and got[201] == 200
    assert roots(spark.createDataFrame([], "a long, b long")).count() == 0


def test_row_numbers_are_the_written_ones(spark, tmp_path):
    """Splits that change between two jobs, as after a lost executor, change no result."""
    from creditloom.llm import exact_dedup, mixing
    from creditloom.llm.common import ROW, numbered

    texts = [f"text {k // 2} of many" for k in range(400)]
    path = str(tmp_path / "documents.parquet")
    frame = spark.createDataFrame([(k, t, "s", "en") for k, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    frame.repartition(7, "doc_id").write.parquet(path)

    def splits(n):
        spark.conf.set("spark.sql.files.minPartitionNum", n)

    try:
        splits("1")
        docs = numbered(spark.read.parquet(path))
        digests = exact_dedup.digest_table(docs)
        splits("40")
        found = exact_dedup.groups(docs, digests).agg({"group_size": "min"}).first()[0]
        assert found == 2
        splits("1")
        chosen = docs.where("doc_id % 5 = 0").selectExpr(f"{ROW} as keep_row")
        chosen = exact_dedup.stored(chosen, "chosen")
        splits("40")
        kept = exact_dedup.keep_rows(docs, chosen)
        assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 400, 5)) and ROW not in kept.columns
        table = mixing.measured(docs, [], "doc_id", "text", "source")
        splits("1")
        assert table.join(docs, (table.row == docs[ROW]) & (table.doc_id == docs.doc_id)).count() == 400
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_stages_store_no_copy_to_number_rows(spark, stored_docs, labels, monkeypatch):
    """Every stage of the pipeline left a numbered copy of the documents behind."""
    import corpus_pipeline
    from creditloom.llm import common, exact_dedup, language_model, mixing, simhash

    docs, wide, keep = stored_docs(), [], common.stored

    def noted(df, name):
        wide.extend([name] * ("text" in df.columns))
        return keep(df, name)

    for module in (common, exact_dedup, mixing, simhash, language_model):
        monkeypatch.setattr(module, "stored", noted)
    monkeypatch.setattr(corpus_pipeline, "read", lambda *of: labels)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
    assert not wide


def test_places_number_rows_whatever_the_splits(spark, tmp_path):
    from creditloom.llm.common import ROW, positioned

    spark.range(500).selectExpr("id % 7 as doc_id", "repeat('x', 200) as text").repartition(3).write.parquet(f"{tmp_path}/a table")
    docs = spark.read.parquet(f"{tmp_path}/a table")
    found = {r[0] for r in positioned(docs).select(ROW).collect()}
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert {r[0] for r in positioned(spark.read.parquet(f"{tmp_path}/a table")).select(ROW).collect()} == found
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len(found) == 500 and positioned(docs).select("doc_id", "text").exceptAll(docs).isEmpty()
    # Frames that are no table's are numbered as before, and numbers that are there stay.
    made = positioned(spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string"))
    assert made.select(ROW).distinct().count() == 2 and positioned(made) is made
