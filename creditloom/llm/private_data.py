"""Personal data in whole texts: base patterns, and a skip-chain conditional random field.

The field's variables are a document's candidate words, those with a digit, ``@`` or ``+``; all other words are known to
hold no personal data. Its factors: a word's shape, the step between neighbouring candidates, and skip edges between
distant candidates that repeat one another (the same letters and digits) or resemble one another (the same digits
but for separators). Skip edges join each candidate to the one before it with the same key, and to the first one with that key that
a pattern took, so they grow with the text, not with its square. Loopy message passing in the log domain, until messages
stand still, makes repeated mentions agree, so that a number written once in a form that the patterns know marks its other mentions.

The factors are fitted piecewise on the labels that the base patterns give over the whole corpus: shapes, steps and
skips are categories, so their likeliest values are ratios of counts. A word that no pattern takes but that repeats one
which a pattern took is not counted as harmless: its label is what the field is to find. Skip edges reward equal
kinds, by how often two mentions that patterns took are of one kind. The counts are over fixed sets of
categories, a few thousand at most, whatever the corpus. Texts are read once: their candidates are stored, and
fitting and inference work on those.

Spans are in code points, ends exclusive. Base spans always stay; the method adds words (without the marks around
them) whose marginal for a kind reaches ``sure`` and which no base span touches. Null texts count as empty, without
spans. Very long texts are judged whole. Repeated rows are judged alike. Of equal marginals the kind listed first is taken. Other
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import quoted, stored

KINDS = ("email", "ip", "card", "phone")
LABELS = (*KINDS, "none")
NONE = len(KINDS)

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Runs are taken whole, so no start inside one can match more.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CANDIDATE = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@+]*+[0-9@+][^\x20\x09-\x0D]*+")
_EDGE = "\"'()[]{}<>.,;:!?|*#$%&"
#: The log odds that a skip edge can give at most.
MOST_REWARD = 8.0
#: Categories of a word's shape.
SHAPES = 21 * 2 * 2 * 2 * 4 * 4 * 2


def emails(text: str) -> list[tuple[int, int]]:
    found, at, free = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    return found


def _luhn(digits: str) -> bool:
    doubled = (2 * int(d) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d // 10 + d % 10 for d in doubled)) % 10 == 0


def _byte_sized(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    found = [(s, 0, e) for s, e in emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_byte_sized, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def shape(word: str) -> int:
    """The word's category: digits, signs and letters it has."""
    digits = sum("0" <= c <= "9" for c in word)
    parts = (
        (21, min(digits, 20)),
        (2, "@" in word),
        (2, "+" in word),
        (2, "(" in word or ")" in word),
        (4, min(word.count("."), 3)),
        (4, min(word.count("-"), 3)),
        (2, any(c.isalpha() for c in word)),
    )
    code = 0
    for size, value in parts:
        code = code * size + int(value)
    return code


def _keys(word: str) -> tuple[int, int]:
    """What repeats have in common, and what similar words have; zero for words too short to tell."""
    same = re.sub(r"[^\w@]", "", word.lower())
    digits = re.sub(r"[^0-9]", "", word)

    def key(text: str, least: int) -> int:
        digest = hashlib.blake2b(text.encode(), digest_size=8).digest()
        return int.from_bytes(digest, "little", signed=True) if len(text) >= least else 0

    return key(same, 5), key(digits, 7)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple]:
    """(start, end, shape, key of repeats, key of similar words, label) of the candidate words, in order."""
    found, at = [], 0
    for m in _CANDIDATE.finditer(text):
        left = len(m[0]) - len(m[0].lstrip(_EDGE))
        start, end = m.start() + left, m.start() + len(m[0].rstrip(_EDGE))
        if end <= start:
            continue
        while at < len(base) and base[at][2] <= start:
            at += 1
        label = next((k for s, k, e in base[at : at + 4] if s < end and e > start), NONE)
        word = text[start:end]
        found.append((start, end, shape(word), *_keys(word), label))
    return found


def skip_edges(rows: np.ndarray) -> np.ndarray:
    """Pairs (i, j) of candidates: each with the last one before it that has the same key, and with the first known one."""
    pairs = []
    labels = rows[:, 5].tolist()
    for column in (3, 4):
        keys = rows[:, column].tolist()
        known: dict[int, int] = {}
        for j, key in enumerate(keys):
            if key and labels[j] != NONE:
                known.setdefault(key, j)
        last: dict[int, int] = {}
        for j, key in enumerate(keys):
            if key:
                if key in last:
                    pairs.append((last[key], j))
                if labels[j] == NONE and key in known:
                    pairs.append((min(known[key], j), max(known[key], j)))
                last[key] = j
    return np.array(sorted(set(pairs)), np.int64).reshape(-1, 2)


def _repeats_a_known_one(rows: np.ndarray) -> np.ndarray:
    """Candidates outside base spans that share a key with one inside."""
    open_ = rows[:, 5] == NONE
    found = np.zeros(len(rows), bool)
    for column in (3, 4):
        keys = rows[:, column]
        found |= open_ & (keys != 0) & np.isin(keys, keys[~open_])
    return found


class Field:
    """Fitted log potentials."""

    def __init__(self, shapes: np.ndarray, steps: np.ndarray, skips: np.ndarray):
        own = shapes.sum(axis=0) + 1.0
        prior = own / own.sum()
        # Rare shapes fall back on the labels' shares, few of them personal.
        self.unary = np.log((shapes + 4 * prior) / (shapes.sum(axis=1, keepdims=True) + 4))
        self.step = self._affinity(steps)
        kinds = skips[:NONE, :NONE]
        agree, differ = np.trace(kinds), kinds.sum() - np.trace(kinds)
        # Mentions that patterns took one by one tell how far a repeat is to be believed.
        reward = float(np.clip(np.log((agree + 20) / (differ + 1)), 1.0, MOST_REWARD))
        self.skip = np.diag([*[reward] * NONE, 0.0])

    @staticmethod
    def _affinity(counts: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
        """Pointwise mutual information of the labels at an edge's ends, the same both ways."""
        joint = counts + counts.T + smoothing
        share = joint / joint.sum()
        side = share.sum(axis=1)
        return np.clip(np.log(share / np.outer(side, side)), -4.0, 4.0)

    def marginals(self, rows: np.ndarray, rounds: int = 100, damping: float = 0.3, still: float = 1e-8) -> np.ndarray:
        """Label probabilities of each candidate by loopy message passing until no message moves by ``still``; known base spans are clamped."""
        n = len(rows)
        unary = self.unary[rows[:, 2]].copy()
        known = np.flatnonzero(rows[:, 5] != NONE)
        unary[known] = -50.0
        unary[known, rows[known, 5]] = 0.0
        chain = np.stack([np.arange(n - 1), np.arange(1, n)], axis=1)
        skips = skip_edges(rows)
        ends = np.concatenate([chain, skips])
        pair = np.concatenate([np.repeat(self.step[None], len(chain), 0), np.repeat(self.skip[None], len(skips), 0)])
        source = np.concatenate([ends[:, 0], ends[:, 1]])
        target = np.concatenate([ends[:, 1], ends[:, 0]])
        pair = np.concatenate([pair, pair])  # symmetric
        back = np.concatenate([np.arange(len(ends)) + len(ends), np.arange(len(ends))])
        message = np.zeros((len(source), len(LABELS)))
        for _ in range(rounds):
            belief = unary.copy()
            np.add.at(belief, target, message)
            cavity = belief[source] - message[back]
            new = np.logaddexp.reduce(cavity[:, :, None] + pair, axis=1)
            new -= np.logaddexp.reduce(new, axis=1)[:, None]
            moved = np.abs(new - message).max(initial=0.0)
            message = damping * message + (1 - damping) * new
            if moved <= still:
                break
        belief = unary.copy()
        np.add.at(belief, target, message)
        return np.exp(belief - np.logaddexp.reduce(belief, axis=1)[:, None])


def _listed(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _matrix(flat) -> np.ndarray:
    return np.asarray(flat, np.int64).reshape(-1, 6)


def read_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (spans as start, kind, end in a flat array) and words (candidates in a flat array); stored."""

    @F.pandas_udf("base array<long>, words array<long>")
    def scanned(texts: pd.Series) -> pd.DataFrame:
        bases, words = [], []
        for text in texts:
            base = base_spans(text or "")
            bases.append([int(v) for span in base for v in span])
            words.append([int(v) for row in candidates(text or "", base) for v in row])
        return pd.DataFrame({"base": bases, "words": words})

    found = docs.select(quoted(id_col).alias("doc_id"), scanned(quoted(text_col).cast("string")).alias("s"))
    return stored(found.select("doc_id", "s.base", "s.words"), "candidates")


def fit(read: DataFrame) -> Field:
    """Counts over all documents with candidates. At most SHAPES * 5 + 50 sums reach the driver."""

    def count(batches):
        shapes = np.zeros((SHAPES, len(LABELS)), np.int64)
        pairs = np.zeros((2, len(LABELS), len(LABELS)), np.int64)
        for batch in batches:
            for flat in batch["words"]:
                rows = _matrix(flat)
                clear = rows[~_repeats_a_known_one(rows)]
                np.add.at(shapes, (clear[:, 2], clear[:, 5]), 1)
                np.add.at(pairs[0], (clear[:-1, 5], clear[1:, 5]), 1)
                skips = skip_edges(rows)
                np.add.at(pairs[1], (rows[skips[:, 0], 5], rows[skips[:, 1], 5]), 1)
        every = np.concatenate([shapes.ravel(), pairs.ravel()])
        at = np.flatnonzero(every)
        yield pd.DataFrame({"cell": at, "n": every[at]})

    counted = read.where(F.size("words") > 0).select("words").mapInPandas(count, "cell long, n long")
    every = np.zeros(SHAPES * len(LABELS) + 2 * len(LABELS) ** 2)
    for row in counted.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        every[row.cell] = row.n
    cut = SHAPES * len(LABELS)
    pairs = every[cut:].reshape(2, len(LABELS), len(LABELS))
    return Field(every[:cut].reshape(SHAPES, len(LABELS)), pairs[0], pairs[1])


def added_spans(rows: np.ndarray, base: list[tuple[int, int, int]], field: Field, sure: float) -> list[tuple[int, int, int]]:
    """Candidates outside base spans whose marginal for one kind reaches ``sure``."""
    if not len(rows):
        return []
    chance = field.marginals(rows)[:, :NONE]
    best = chance.argmax(axis=1)
    chosen = (rows[:, 5] == NONE) & (chance.max(axis=1) >= sure)
    return [(int(rows[i, 0]), int(best[i]), int(rows[i, 1])) for i in np.flatnonzero(chosen)]


def private_data(docs: DataFrame, sure: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every document."""
    read = read_candidates(docs, id_col, text_col)
    field = fit(read)
    fields = ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"

    @F.pandas_udf(fields)
    def judged(bases: pd.Series, words: pd.Series) -> pd.DataFrame:
        out = []
        for flat, listed in zip(bases, words):
            base = [tuple(int(v) for v in row) for row in np.asarray(flat, np.int64).reshape(-1, 3)]
            every = sorted([*base, *added_spans(_matrix(listed), base, field, sure)])
            counts = [sum(kind == k for _, kind, _ in base) for k in range(len(KINDS))]
            out.append((*counts, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(every)))
        return pd.DataFrame(out, columns=[f.split()[0] for f in fields.split(", ")])

    return read.select("doc_id", judged("base", "words").alias("j")).select("doc_id", "j.*")
