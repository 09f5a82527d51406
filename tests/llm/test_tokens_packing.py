import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from creditloom.llm import packing, token_counts

BYTES = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
WORDS = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
PIECES = ["a", "the", " ", "  ", "\n", "\t", "'s", "'ll", "'re", "'", "!", "<|endoftext|>", "<|endo", "é", "ß", "日", "12",
          "²", " ", "　", "\x1c", "ing", "\r\n", " the", "x" * 40]


def table():
    return token_counts.prefix_table(str(public_tokenizers.path("byte_bpe_50k.json")))


def library(text):
    return len(BYTES.encode(text, add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_every_prefix_counts_as_the_library_counts_it(text):
    counts = token_counts.prefix_counts(table().table(text))
    for k in range(len(text) + 1):
        assert counts[len(text[:k].encode())] == library(text[:k])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), max_size=4))
def test_texts_learnt_together_count_as_the_library_counts_them(texts):
    for text, made in zip(texts, table().tables(texts), strict=True):
        counts = token_counts.prefix_counts(made)
        for k in range(len(text) + 1):
            assert counts[len(text[:k].encode())] == library(text[:k])


def test_budgets_are_answered_from_the_table():
    text = "Tokens of a näive text, cut where a budget says. " * 5
    made = table().table(text)
    for budget in (0, 1, 7, 20, 1000):
        cut = token_counts.longest_within(made, text.encode(), budget)
        assert library(text.encode()[:cut].decode()) <= budget
        longer = [k for k in range(len(text)) if len(text[:k].encode()) > cut]
        assert all(library(text[:k]) > budget for k in longer[:40])


def test_token_counts_of_odd_rows(stored_docs):
    docs = stored_docs()
    found = {r.doc_id: r for r in token_counts.token_counts(docs).collect()}
    for r in docs.collect():
        text = r.text or ""
        got = found[r.doc_id]
        assert (got.n_bytes, got.n_tokens) == (len(text.encode()), library(text))
        assert got.over_limit == (library(text) > 512)
    tables = token_counts.token_tables(docs.limit(4)).collect()
    assert all(len(t.prefix_counts) >= 0 for t in tables)
    assert token_counts.token_counts(docs.where("false")).count() == 0


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(tokens=64, segments=3, loss=63, window=8)])
def test_pieces_hold_every_id_once_and_keep_all_limits(stored_docs, limits):
    docs = stored_docs()
    pieces = packing.pack_documents(docs, limits).collect()
    want = {r.doc_id: [*WORDS.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    got, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        got[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
        assert p.doc_tokens == len(want[p.doc_id]) and p.loss_tokens == p.length - 1
    for doc_id, ids in want.items():
        found = []
        for p in sorted(got[doc_id], key=lambda p: p.start):
            assert p.start == len(found)
            found += np.frombuffer(p.ids, "<u4").tolist()
        assert found == ids
    for members in sequences.values():
        at = 0
        for p in sorted(members, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= limits.tokens and len(members) <= limits.segments
        assert sum(p.loss_tokens for p in members) <= limits.loss
    lengths = [sum(p.length for p in m) for m in sequences.values()]
    padding = sum(limits.tokens - n for n in lengths if n & (n - 1))
    assert padding <= 0.02 * sum(lengths) + limits.tokens
    assert packing.pack_documents(docs.where("false")).count() == 0


def test_encoder_equals_the_library():
    random.seed(5)
    odd = ["a<|startoftext|>b <|endoftext|>", "Σας ὈΔΥΣΣΕΎΣ\x1cq", " ̀a İ ſ Ǆ", "x,y. (z)!", "12a's don't", "<|ENDOFTEXT|>"]
    texts = odd + ["".join(random.choice(PIECES) for _ in range(30)) for _ in range(200)]
    made = packing.encoder(str(public_tokenizers.path("word_bpe_49k.json"))).encode(texts)
    for text, ids in zip(texts, made):
        assert np.frombuffer(ids, "<u4").tolist() == WORDS.encode(text, add_special_tokens=False).ids


def test_examples_are_never_cut_and_keep_three_limits(spark):
    random.seed(2)
    rows = [(k, random.randint(0, 50), random.randint(0, 20)) for k in range(400)] + [(900, 500, 1), (901, None, None)]
    limits = packing.Limits(tokens=100, segments=5, loss=30, window=64)
    out = packing.pack_examples(spark.createDataFrame(rows, "k int, t int, l int"), limits, "t", "l", "k").collect()
    assert sorted(r.id for r in out) == sorted(k for k, _, _ in rows)
    assert [r.id for r in out if r.sequence_id is None] == [900]
    bins = defaultdict(list)
    for r in out:
        if r.sequence_id is not None:
            bins[r.sequence_id].append(r)
    for members in bins.values():
        assert sum(r.tokens for r in members) <= 100 and sum(r.loss_tokens for r in members) <= 30 and len(members) <= 5
    tokens = sum(t or 0 for _, t, _ in rows) - 500
    loss = sum(x or 0 for _, _, x in rows)
    assert len(bins) <= 1.25 * max(tokens / 100, loss / 30, len(rows) / 5) + 5


def test_query_digest_is_of_the_ids(stored_docs):
    import corpus_pipeline

    docs = stored_docs(["some words here"])
    (piece,) = [r for r in corpus_pipeline.packed_pieces(docs).collect() if r.start == 0]
    ids = [*WORDS.encode("some words here", add_special_tokens=False).ids, 2][: piece.length]
    assert piece.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_words_counted_together_equal_words_counted_alone():
    one = table()
    rng = random.Random(5)
    words = {"".join(rng.choice("aeinrst ,.\u00e9\u4e2d9-") for _ in range(rng.randint(1, 14))).encode() for _ in range(3000)}
    words |= {b" internationalisation", b"a" * 40, b"=" * 33}
    ordered = sorted(words, key=lambda w: -len(w))
    for word, made in zip(ordered, one.many_counts(ordered)):
        alone = one.counts(word)
        assert np.cumsum(np.frombuffer(made, np.int8), dtype=np.int64).tolist() == alone[1:], word


def test_a_full_memo_keeps_what_is_in_use():
    small = token_counts.PrefixTable(str(public_tokenizers.path("byte_bpe_50k.json")), memo_entries=8)
    for k in range(50):
        text = " ".join(f"word{n} kept" for n in range(k, k + 7))
        (made,) = small.tables([text])
        assert token_counts.count_at(made, len(made)) == library(text)


def test_sequences_that_end_at_the_segment_limit_need_no_padding(stored_docs):
    docs = stored_docs(["a b"] * 500)
    lengths = defaultdict(int)
    for p in packing.pack_documents(docs, packing.Limits(segments=5, window=16)).collect():
        lengths[p.sequence_id] += p.length
    assert all(n & (n - 1) == 0 for n in lengths.values())


def test_chunks_are_looked_up_once_a_batch():
    class Counting(dict):
        looks = 0

        def get(self, key, default=None):
            Counting.looks += 1
            return dict.get(self, key, default)

        def __getitem__(self, key):
            Counting.looks += 1
            return dict.__getitem__(self, key)

        def room(self, more=1):
            pass

        entries = 1_000_000

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    library, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    encoder.memo = Counting()
    texts = [" the cat, sat\x1fon  THE mat!! " * 50, None, "", "<|endoftext|> x\x85y \u3000z"] * 25
    found = [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)]
    assert found == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert Counting.looks < 100


def test_a_full_memo_gives_the_same_ids():
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    texts = [f"word{k} other, same! Ünï{k % 3}, don't" for k in range(3000)]
    assert list(packing.Encoder(path, memo_entries=50).encode(texts)) == list(packing.Encoder(path).encode(texts))
