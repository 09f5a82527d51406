"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

In byte pair encoding a prefix's last token decides everything: of all tokens that end at a byte, exactly one
is compatible with the last token of the prefix before it. So one pass over the bytes gives the last token and the
token count of every prefix (``PrefixTable``). The count table answers what a truncation or a budget costs without
encoding again: ``count_at`` and ``longest_within``.

A table holds, for every byte of the UTF-8 text, the change of the token count as a signed byte. At every
character boundary the running sum equals what the library gives for the text cut there: a run of white space at the cut,
a contraction or a special string that is cut short is encoded as it stands. Inside a multi-byte character
the value is that of the bytes so far. Tables are as long as their texts.

The pass is made for many words together (``many_counts``): arrays hold the last token and the count of every word at a position,
candidates are found by the bytes that end there, and tokens' compatibility is remembered in a table of fixed size.

Null texts count as empty: no bytes, no tokens. Repeated rows are counted again. Very long texts are counted whole. Other columns
are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import Generations, quoted, vocabulary_path

VOCABULARY = "byte_bpe_50k.json"

# White space of the Unicode property, and the contractions of the byte-level splitting pattern.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
CONTRACTIONS = "'s", "'t", "'re", "'ve", "'m", "'ll", "'d"

_SPLIT = regex.compile(
    "|".join(CONTRACTIONS)
    + rf"| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)
_NO_PARENT = 1 << 60
#: Marks that may end a word of letters and are split off it.
_MARKS = ".,;:!?"
#: Words up to so many bytes are counted together; longer ones one by one, by the same programme.
_TOGETHER = 48
#: Slots, as a power of two, of the table that remembers which tokens are compatible.
_SLOTS = 20
#: Bytes of text that are learnt at once.
_AT_ONCE = 1 << 24


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies spell printable bytes as themselves and the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        letters[chr(256 + k)] = b
    return letters


class PrefixTable:
    """Prefix tables under one byte-level vocabulary file."""

    def __init__(self, path: str, memo_entries: int = 500_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        spelled = {text: bytes(letters[c] for c in text) for text in vocab if all(c in letters for c in text)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        specials = {t["id"] for t in spec["added_tokens"]}
        self.token = {b: vocab[t] for t, b in spelled.items() if vocab[t] not in specials}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, made = vocab[left], vocab[right], vocab[left + right]
            self.merge.setdefault((a, b), (rank, made))
            self.halves.setdefault(made, (a, b, rank))
        self.fits: dict[int, bool] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        # A token that its own bytes do not encode to never occurs.
        self.token = {b: t for b, t in self.token.items() if t not in self.halves or self._made_last(t)}
        self.longest = max(map(len, self.token))
        self.done, self.last, self.count = b"", [0], [0]
        self.chunks, self.words = Generations(memo_entries), {}
        self._tails = self._by_last_bytes()
        self._pairs, self._pair_fits = np.zeros(1 << _SLOTS, np.uint64), np.zeros(1 << _SLOTS, bool)

    def _by_last_bytes(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length of token: the sorted numbers that its last eight bytes make, and the tokens (none if longer than eight)."""
        groups: dict[int, list[tuple[int, int]]] = {}
        for raw, token in self.token.items():
            groups.setdefault(len(raw), []).append((int.from_bytes(raw[-8:], "big"), token))
        made = {}
        for length, group in groups.items():
            keys = np.array([k for k, _ in group], np.uint64)
            tokens = np.array([t for _, t in group], np.int64)
            order = np.argsort(keys, kind="stable")
            made[length] = (keys[order], tokens[order]) if length <= 8 else (np.unique(keys), tokens[:0])
        return made

    # The dynamic programme.

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Pieces at the token's right (side 1) or left (side 0) edge, smallest first, with the rank that absorbs each."""
        known = self.spines[side].get(token)
        if known is None:
            known, at, absorbed = [], token, _NO_PARENT
            while True:
                known.append((at, absorbed))
                if at not in self.halves:
                    break
                left, right, absorbed = self.halves[at]
                at = right if side else left
            known.reverse()
            self.spines[side][token] = known
        return known

    def _first_merge(self, a: int, b: int) -> tuple[int, bool] | None:
        """The first merge over the boundary of two tokens: its rank, and whether it joins the tokens as wholes."""
        left, right, i, j = self._spine(a, 1), self._spine(b, 0), 0, 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            joined = self.merge.get((x, y))
            # Of equal ranks the leftmost pair is merged first.
            if joined is not None and joined[0] < x_until and joined[0] <= y_until:
                return joined[0], x_until == y_until == _NO_PARENT
            if x_until == y_until == _NO_PARENT:
                return None
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def compatible(self, a: int, b: int) -> bool:
        """Whether encoding the two tokens' bytes together gives the two tokens again."""
        known = self.fits.get(a << 32 | b)
        if known is None:
            known = self.fits[a << 32 | b] = self._first_merge(a, b) is None
        return known

    def _made_last(self, token: int) -> bool:
        """Whether encoding the token's bytes ends in the merge that makes the token."""
        a, b, rank = self.halves[token]
        return self._first_merge(a, b) == (rank, True) and all(
            t not in self.halves or self._made_last(t) for t in (a, b)
        )

    def counts(self, word: bytes) -> list[int]:
        """Token counts of the prefixes of one word, by length; element 0 is the empty prefix.

        What the word before shares from its start is not computed again, so sorted words are cheap.
        """
        get, fits, compatible, longest = self.token.get, self.fits.get, self.compatible, self.longest
        done, n, same = self.done, len(word), 0
        for a, b in zip(done, word):
            if a != b:
                break
            same += 1
        last, count = self.last, self.count
        del last[same + 1 :], count[same + 1 :]
        for end in range(same + 1, n + 1):
            # Exactly one token fits, so the order is free; short ones are the likeliest.
            for start in range(end - 1, max(end - longest, 0) - 1, -1):
                t = get(word[start:end])
                if t is not None:
                    if start:
                        fit = fits(last[start] << 32 | t)
                        if fit is None:
                            fit = compatible(last[start], t)
                        if not fit:
                            continue
                    last.append(t)
                    count.append(count[start] + 1)
                    break
        self.done = word
        return count

    def _fit_together(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``compatible`` of many pairs."""
        key = before.astype(np.uint64) << np.uint64(32) | token.astype(np.uint64)
        slot = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)
        fit, new = self._pair_fits[slot], np.flatnonzero(self._pairs[slot] != key)
        if len(new):
            asked, place = np.unique(key[new], return_inverse=True)
            told = np.fromiter((self._first_merge(k >> 32, k & 0xFFFFFFFF) is None for k in asked.tolist()), bool, len(asked))
            fit[new] = told[place]
            # A later pair takes an earlier one's slot.
            for k, s, f in zip(key[new].tolist(), slot[new].tolist(), fit[new].tolist()):
                self._pairs[s], self._pair_fits[s] = k, f
        return fit

    def many_counts(self, words: list[bytes]) -> Iterator[bytes]:
        """The tables of words of at most ``_TOGETHER`` bytes, the longest first: changes of the token count by byte."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        width, n = int(sizes[0]), len(words)
        letters = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width).T.astype(np.uint64)
        last, count = np.zeros((width + 1, n), np.int64), np.zeros((width + 1, n), np.int16)
        tail = np.zeros(n, np.uint64)
        for end in range(1, width + 1):
            rows = np.arange(np.searchsorted(-sizes, -end, "right"))
            tail = (tail << np.uint64(8)) | letters[end - 1]
            # Exactly one token fits, so the order is free; short ones are the likeliest.
            for length in range(1, min(end, self.longest) + 1):
                if not len(rows):
                    break
                if length not in self._tails:
                    continue
                keys, tokens = self._tails[length]
                asked = tail[rows] & np.uint64((1 << 8 * min(length, 8)) - 1)
                place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                hit, start = np.flatnonzero(keys[place] == asked), end - length
                if length <= 8:
                    token = tokens[place[hit]]
                else:
                    found = [self.token.get(words[r][start:end], -1) for r in rows[hit].tolist()]
                    token = np.array(found, np.int64)
                    hit, token = hit[token >= 0], token[token >= 0]
                if start:
                    fits = self._fit_together(last[start, rows[hit]], token)
                    hit, token = hit[fits], token[fits]
                own = rows[hit]
                last[end, own], count[end, own] = token, count[start, own] + 1
                rows = np.delete(rows, hit)
        steps = np.ascontiguousarray((count[1:] - count[:-1]).T.astype(np.int8)).tobytes()
        return (steps[k * width : k * width + len(w)] for k, w in enumerate(words))

    # From words to texts.

    def _word(self, word: str) -> bytes:
        known = self.words.get(word)
        if known is not None:
            return known
        raw = word.encode()
        count = [*range(len(raw)), self.counts(raw)[-1]] if word in CONTRACTIONS else self.counts(raw)
        return bytes([(b - a) & 0xFF for a, b in zip(count, count[1:])])

    def _plain(self, text: str) -> bytes:
        """The table of a text in which special strings are ordinary text."""
        words = _SPLIT.findall(text)
        table = bytearray(b"".join(map(self._word, words)))
        at, before = 0, ""
        for word in words:
            if before and word[0] in WHITE and before[-1] in WHITE:
                # Cut after the first character of this word, the run of white space would be one word.
                k = len(word[0].encode())
                run = self.counts((before + word[0]).encode())[-1]
                apart = self.counts(before.encode())[-1] + self.counts(word[0].encode())[-1]
                self._shift(table, at + k - 1, run - apart)
                if at + k < len(table):
                    self._shift(table, at + k, apart - run)
            at, before = at + len(word.encode()), word
        return bytes(table)

    @staticmethod
    def _shift(table: bytearray, at: int, by: int) -> None:
        table[at] = (table[at] + by) & 0xFF

    def table(self, text: str) -> bytes:
        """The table of a whole text, special strings being special as in the library."""
        for special in self.special:
            if special in text:
                return self._with_specials(text)
        first, *rest = text.split(" ")
        try:
            return b"".join([self._plain(first), *map(self.chunks.__getitem__, rest)])
        except KeyError:
            # White space at an edge takes part in a longer run, which only the whole text shows; or nothing was learnt.
            return self._plain(text)

    def learn(self, texts: list[str]) -> None:
        """Fill the memo with the chunks of some texts, whose words are counted together."""
        self.chunks.turn()
        new = set()
        for text in texts:
            new.update(text.split(" "))
        chunks, words = {}, set()
        for chunk in new:
            if not chunk or self.chunks.known(chunk) or chunk[0] in WHITE or chunk[-1] in WHITE:
                continue
            if chunk.isalpha():
                words.add(" " + chunk)
            elif chunk[-1] in _MARKS and chunk[:-1].isalpha():
                words.update((" " + chunk[:-1], chunk[-1]))
            else:
                words.update(_SPLIT.findall(" " + chunk))
            chunks[chunk] = chunk.isalpha()
        words.difference_update(CONTRACTIONS)
        spelled = sorted(((w.encode(), w) for w in words if len(w) <= _TOGETHER), key=lambda x: -len(x[0]))
        spelled = [x for x in spelled if len(x[0]) <= _TOGETHER]
        if spelled:
            self.words = dict(zip((w for _, w in spelled), self.many_counts([raw for raw, _ in spelled])))
        for chunk, plain in chunks.items():
            if plain:
                table = self._word(" " + chunk)
            elif chunk[-1] in _MARKS and chunk[:-1].isalpha():
                table = self._word(" " + chunk[:-1]) + self._word(chunk[-1])
            else:
                table = self._plain(" " + chunk)
            self.chunks[chunk] = table

    def tables(self, texts: list[str]) -> Iterator[bytes]:
        self.learn(texts)
        yield from map(self.table, texts)
        self.words = {}

    def _with_specials(self, text: str) -> bytes:
        pieces, rest = [], text
        while True:
            at, special = min(
                ((rest.find(s), s) for s in self.special if s in rest), default=(-1, ""), key=lambda x: (x[0], -len(x[1]))
            )
            if at < 0:
                return b"".join([*pieces, self.table(rest) if rest else b""])
            before = self._plain(rest[:at])
            cut = bytearray(self._plain(rest[:at] + special))
            whole = int(np.frombuffer(before, np.int8).sum(dtype=np.int64)) + 1
            self._shift(cut, len(cut) - 1, whole - int(np.frombuffer(bytes(cut), np.int8).sum(dtype=np.int64)))
            pieces.append(bytes(cut))
            rest = rest[at + len(special) :]


def prefix_counts(table: bytes) -> np.ndarray:
    """Token counts of all prefixes by length in bytes, the empty one first."""
    return np.concatenate(([0], np.cumsum(np.frombuffer(table, np.int8), dtype=np.int64)))


def count_at(table: bytes, n_bytes: int) -> int:
    """Tokens of the text's first ``n_bytes`` bytes."""
    return int(np.frombuffer(table, np.int8, min(n_bytes, len(table))).sum(dtype=np.int64))


def longest_within(table: bytes, text: bytes, budget: int) -> int:
    """The longest prefix, in bytes and at a character boundary, of at most ``budget`` tokens."""
    starts = np.append((np.frombuffer(text, np.uint8) & 0xC0) != 0x80, True)
    return int(np.flatnonzero(starts & (prefix_counts(table) <= budget))[-1])


@lru_cache(maxsize=2)
def prefix_table(path: str) -> PrefixTable:
    """One per worker and vocabulary."""
    return PrefixTable(path)


def _tables(vocabulary: str, texts: Iterable[str | None]) -> Iterator[bytes]:
    made, some, size = prefix_table(vocabulary_path(vocabulary)), [], 0
    for text in texts:
        some.append(text or "")
        size += len(some[-1])
        if size >= _AT_ONCE:
            yield from made.tables(some)
            some, size = [], 0
    yield from made.tables(some)


def token_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The id and ``prefix_counts``, the table of each whole text."""

    @F.pandas_udf("binary")
    def tables(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_tables(vocabulary, texts)), dtype=object)

    return docs.select(quoted(id_col).alias("doc_id"), tables(quoted(text_col)).alias("prefix_counts"))


def token_counts(
    docs: DataFrame, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, read off the prefix tables, which are not kept.

    ``n_tokens_at_4k`` is the count of the first 4,096 bytes, an answer about a truncation.
    """

    @F.pandas_udf("n_bytes long, n_tokens long, n_tokens_at_4k long")
    def counted(texts: pd.Series) -> pd.DataFrame:
        rows = [(len(t), count_at(t, len(t)), count_at(t, 4096)) for t in _tables(vocabulary, texts)]
        return pd.DataFrame(rows, columns=["n_bytes", "n_tokens", "n_tokens_at_4k"])

    counts = docs.select(quoted(id_col).alias("doc_id"), counted(quoted(text_col)).alias("c"))
    return counts.select(
        "doc_id", "c.n_bytes", "c.n_tokens", (F.col("c.n_tokens") > limit).alias("over_limit"), "c.n_tokens_at_4k"
    )
