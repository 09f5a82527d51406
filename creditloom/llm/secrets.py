"""Secrets in whole texts: three base patterns, and strings of high entropy.

The method looks at candidates, runs of at least ``Windows.least`` letters, digits and ``+/_=-``. A window slides over a
candidate; the counts of its characters change by one in and one out, and with them the Shannon entropy of
each character class (hexadecimal, alphanumeric, base 64), so a step costs the same whatever the width. A candidate is
a secret where a window of its narrowest class reaches that class's limit, unless the allow list knows it: identifiers of
known form, text words joined by signs (``plain_words``: long ones only if they can be pronounced), and what the caller adds. Sequences (digits or letters in order, ten at
least) are left out of a candidate, and the rest of it is judged.

Spans are in code points, ends exclusive. The method's spans have the kind ``entropy`` and leave out what a base
span covers. Null texts count as empty, and have no spans. Candidates of any length are taken whole. Repeated rows are scanned
again. Other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import quoted

KINDS = ("assign", "access", "hex")

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

# Words that the assign pattern starts with, in lower case.
_NAMES = "password", "passwd", "secret", "token", "apikey", "api_key"
_HEX_BYTES = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
_CANDIDATE_BYTES = bytes(1 if b < 128 and (chr(b).isalnum() or chr(b) in "+/_=-") else 0 for b in range(256))

#: Allow list: what looks random but is not secret.
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"[0-9][0-9_=+/-]*",
)
# Possessive: each character has one place in the pattern, so a miss takes one pass.
_JOINED = re.compile(r"(?:[A-Z]?[a-z]++[_/=+-]*+)++|(?:[A-Z]++[_/=+-]*+)++")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CONSONANTS = re.compile(r"[^AEIOUYaeiouy]{6}")


def _ascending(characters: str, least: int = 10) -> str:
    """A pattern of the first ``least`` characters and as many of the following as there are."""
    tail = ""
    for c in reversed(characters[least:]):
        tail = f"(?:{c}{tail})?"
    return characters[:least] + tail


#: Sequences are left out, and what is left of the candidate is judged.
_SEQUENCE = re.compile("|".join(map(_ascending, ("0123456789", string.ascii_lowercase, string.ascii_uppercase))))


@dataclass(frozen=True)
class Windows:
    width: int = 20
    least: int = 20
    #: Bits a character, by class.
    hex_limit: float = 3.0
    alnum_limit: float = 3.6
    base64_limit: float = 3.7


def max_entropy(text: str, width: int) -> float:
    """The largest entropy of any window, in bits a character; of the whole text if it is shorter."""
    width = min(width, len(text))
    if not width:
        return 0.0
    # n log n of each count; the entropy is log width less their sum over width.
    part = [0.0, *(c * math.log2(c) for c in range(1, width + 1))]
    counts: dict[str, int] = {}
    total = 0.0
    for c in text[:width]:
        n = counts[c] = counts.get(c, 0) + 1
        total += part[n] - part[n - 1]
    least = total
    for k in range(width, len(text)):
        gone, come = text[k - width], text[k]
        if gone != come:
            n = counts[gone]
            counts[gone] = n - 1
            total += part[n - 1] - part[n]
            n = counts[come] = counts.get(come, 0) + 1
            total += part[n] - part[n - 1]
            least = min(least, total)
    return math.log2(width) - least / width


def plain_words(text: str, short: int = 12) -> bool:
    """Whether the text is words of one case joined by signs or capitals, and not letters in random order.

    Words have three letters on average. One of more than ``short`` letters has to be pronounceable: a vowel in four letters at
    least, and fewer than six consonants in a row.
    """
    if not _JOINED.fullmatch(text):
        return False
    words = _WORD.findall(text)
    if sum(map(len, words)) < 3 * len(words):
        return False
    long = [w for w in words if len(w) > short]
    return all(4 * sum(map(w.lower().count, "aeiouy")) >= len(w) and not _CONSONANTS.search(w) for w in long)


def _class_limit(text: str, w: Windows) -> float:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
        return w.hex_limit
    return w.alnum_limit if text.isalnum() else w.base64_limit


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, end) as (start, end, kind), in order of start and kind."""
    raw = text.encode()
    low = raw.lower()
    found = []
    if any(name.encode() in low for name in _NAMES):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if b"\1" * 16 in raw.translate(_HEX_BYTES):
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(start, end, KINDS[k]) for start, k, end in sorted(found)]


def entropy_spans(
    text: str, base: list[tuple[int, int, str]], w: Windows = Windows(), allowed: re.Pattern | None = None
) -> list[tuple[int, int, str]]:
    if b"\1" * w.least not in text.encode().translate(_CANDIDATE_BYTES):
        return []
    allowed, found, at = allowed or _ALLOWED, [], 0
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(base) and base[at][1] <= start:
            at += 1
        if any(s < end and e > start for s, e, _ in base[at : at + len(KINDS)]) or end - start < w.least:
            continue
        if allowed.fullmatch(m[0]) or plain_words(m[0]):
            continue
        word = _SEQUENCE.sub("", m[0])
        if len(word) < w.least or word != m[0] and (allowed.fullmatch(word) or plain_words(word)):
            continue
        if max_entropy(word, w.width) >= _class_limit(word, w):
            found.append((start, end, "entropy"))
    return found


_ALLOWED = re.compile("|".join(f"(?:{a})" for a in ALLOWED), re.DOTALL)


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(text: str | None, w: Windows = Windows(), allowed: re.Pattern | None = None) -> tuple:
    """Counts by base kind, base spans' digest and all spans."""
    text = text or ""
    base = base_spans(text)
    order = (*KINDS, "entropy")
    every = sorted([*base, *entropy_spans(text, base, w, allowed)], key=lambda s: (s[0], order.index(s[2])))
    counts = [sum(kind == k for _, _, kind in base) for k in KINDS]
    return (*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(every))


def secrets(
    docs: DataFrame, w: Windows = Windows(), allow: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every document. ``allow`` adds whole-candidate patterns."""
    patterns = "|".join(f"(?:{a})" for a in (*ALLOWED, *allow))
    fields = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    @F.pandas_udf(fields)
    def scanned(texts: pd.Series) -> pd.DataFrame:
        allowed = re.compile(patterns, re.DOTALL)
        rows = [scan(t, w, allowed) for t in texts]
        return pd.DataFrame(rows, columns=[f.split()[0] for f in fields.split(", ")])

    found = docs.select(quoted(id_col).alias("doc_id"), scanned(quoted(text_col).cast("string")).alias("s"))
    return found.select("doc_id", "s.*")


def redacted(
    docs: DataFrame, w: Windows = Windows(), allow: tuple[str, ...] = (), text_col: str = "text", mark: str = "[secret]"
) -> DataFrame:
    """The documents with every span in their text replaced; overlapping spans are one. ``allow`` is that of ``secrets``."""
    patterns = "|".join(f"(?:{a})" for a in (*ALLOWED, *allow))

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        allowed = re.compile(patterns, re.DOTALL)
        return pd.Series([None if t is None else _without(t, w, mark, allowed) for t in texts], dtype=object)

    return docs.withColumn(text_col, clean(quoted(text_col).cast("string")))


def _without(text: str, w: Windows, mark: str, allowed: re.Pattern) -> str:
    base = base_spans(text)
    pieces, at = [], 0
    for start, end, _ in sorted([*base, *entropy_spans(text, base, w, allowed)]):
        if start >= at:
            pieces += [text[at:start], mark]
        at = max(at, end)
    return "".join([*pieces, text[at:]])
