"""Vector bin packing of token sequences under several limits at once.

A sequence holds at most ``tokens`` tokens, ``segments`` pieces and ``loss`` loss-bearing tokens. Of the examples
waiting, the one goes in that fits and whose needs have the largest dot product with what the sequence has left,
each as a share of its limit: scarce room counts little, so small needs are kept for it. Every task packs
the rows of its own partition with a window of waiting examples, so nothing moves between tasks, memory is bounded,
and a task that is run again gives the same sequences. Sequence ids start with the partition's number.

``pack_documents`` cuts documents freely: what no waiting piece fits is filled with a cut one, and the rest at the end
of a partition is cut into sequences whose lengths are powers of two, which need no padding.
``pack_examples`` never cuts.

Null texts count as empty: a document of one end token. Repeated rows are packed again. Empty tables give empty results.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from creditloom.llm.common import Memo, quoted, vocabulary_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: Sequences of one partition are numbered below this.
_PER_PARTITION = 1 << 40


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 64
    loss: int = 4095
    window: int = 1024


class Encoder:
    """Token ids of texts as little-endian 32-bit integers; the library sees a distinct chunk once while the memo has it.

    The vocabulary drops white space and never joins over it, so chunks between ASCII spaces encode alone.
    """

    def __init__(self, path: str, memo_entries: int = 600_000):
        self.library = Tokenizer.from_file(path)
        self.memo = Memo(memo_entries)
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.marker = next(t.content for t in self.library.get_added_tokens_decoder().values() if t.special)
        self.marker_id = vocab[self.marker]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        for k in range(0, len(texts), 1000):
            folded = pa.array([self._folded(t or "") for t in texts[k : k + 1000]], pa.large_binary())
            split = pc.ascii_split_whitespace(folded.cast(pa.large_string()))
            coded = split.flatten().dictionary_encode()
            known = self._known(coded.dictionary.cast(pa.large_binary()).to_pylist())
            sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
            flat, starts, at = np.frombuffer(b"".join(known), "<u4"), np.cumsum(sizes) - sizes, coded.indices.to_numpy()
            lengths = sizes[at]
            ends = np.concatenate(([0], np.cumsum(lengths)))
            ids = flat[np.repeat(starts[at] - ends[:-1], lengths) + np.arange(ends[-1])]
            borders = ends[split.offsets.to_numpy()].tolist()
            for first, last in zip(borders, borders[1:]):
                yield ids[first:last].tobytes()

    def _known(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of distinct chunks."""
        memo = self.memo
        found = list(map(memo.get, chunks))
        lacking = [c for c, ids in zip(chunks, found) if ids is None]
        memo.room(2 * len(lacking))
        self._learn(lacking)
        return [memo[c] if ids is None else ids for c, ids in zip(chunks, found)]

    @staticmethod
    def _folded(text: str) -> bytes:
        """What is split at ASCII spaces. Lower case is the library's too, but special strings are as written."""
        raw = text.encode()
        low = raw.lower()
        return raw if b"<|" in low else low

    def _learn(self, chunks: list[bytes], together: int = 200) -> None:
        """Encode chunks, many in one text: words end in a token of their own kind, others are parted by a special token."""
        memo, words, marked, others = self.memo, set(), [], [b".", b",", b";", b":", b"!", b"?"]
        memo[b""] = b""
        for chunk, text in zip(chunks, b"\n".join(chunks).decode().split("\n")):
            if text.isalpha():
                words.add(chunk)
            elif text[-1:] in ".,;:!?" and text[:-1].isalpha():
                marked.append(chunk)
                if chunk[:-1] not in memo:
                    words.add(chunk[:-1])
            elif chunk:
                others.append(chunk)
        words = list(words)
        for k in range(0, len(words), together):
            some = words[k : k + together]
            ids = self._ids(b" ".join(some).decode())
            ends = np.flatnonzero(self.ends[ids]) + 1
            # Letters that lower-casing or composing turns into more than one word show in the number of ends.
            if len(ends) == len(some):
                self._keep(some, ids, [0, *ends[:-1].tolist()], ends.tolist())
            else:
                self._each(some)
        marker = self.marker.encode()
        for k in range(0, len(others), together):
            some = others[k : k + together]
            ids = self._ids(marker.join(some).decode())
            marks = np.flatnonzero(ids == self.marker_id)
            if len(marks) == len(some) - 1:
                self._keep(some, ids, [0, *(marks + 1).tolist()], [*marks.tolist(), len(ids)])
            else:
                self._each(some)
        memo.update((c, memo[c[:-1]] + memo[c[-1:]]) for c in marked)

    def _keep(self, chunks: list[bytes], ids: np.ndarray, starts: list[int], ends: list[int]) -> None:
        raw = ids.tobytes()
        self.memo.update((c, raw[4 * i : 4 * j]) for c, i, j in zip(chunks, starts, ends))

    def _each(self, chunks: list[bytes]) -> None:
        self.memo.update((c, self._ids(c.decode()).tobytes()) for c in chunks)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Packer:
    """Open sequences of one partition. Pieces are (key, start, tokens, loss) tuples."""

    def __init__(self, limits: Limits, cut: bool):
        self.limits, self.cut = limits, cut
        self.full = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.pool: list[tuple] = []
        self.needs = np.zeros((limits.window + 1, 3))
        self.sequences = 0

    def add(self, piece: tuple) -> Iterator[tuple]:
        """Take a piece; yields placed pieces as (sequence, offset, piece)."""
        most = min(self.limits.tokens, self.limits.loss + 1)
        while self.cut and piece[2] >= most:
            yield from self._close([(*piece[:2], most, most - 1)])
            piece = (piece[0], piece[1] + most, piece[2] - most, piece[2] - most - 1)
        if piece[2] == 0 and self.cut:
            return
        self._put(piece)
        if len(self.pool) > self.limits.window:
            yield from self._filled()

    def finish(self) -> Iterator[tuple]:
        while self.pool:
            yield from self._filled()

    def _filled(self) -> Iterator[tuple]:
        """A sequence; one that ends at another limit than its tokens is cut into lengths that need no padding."""
        pieces = self._fill()
        length = sum(p[2] for p in pieces)
        if self.cut and length < self.limits.tokens:
            yield from self._powers_of_two(pieces, length)
        else:
            yield from self._close(pieces)

    def _put(self, piece: tuple) -> None:
        self.needs[len(self.pool)] = piece[2], 1, piece[3]
        self.pool.append(piece)

    def _take(self, k: int) -> tuple:
        piece, last = self.pool[k], self.pool.pop()
        if k < len(self.pool):
            self.pool[k] = last
            self.needs[k] = self.needs[len(self.pool)]
        return piece

    def _fill(self) -> list[tuple]:
        left, pieces = self.full.copy(), []
        while self.pool:
            needs = self.needs[: len(self.pool)]
            score = np.where((needs <= left).all(axis=1), needs @ (left / self.full**2), -1.0)
            k = int(score.argmax())
            if score[k] < 0:
                break
            piece = self._take(k)
            pieces.append(piece)
            left -= (piece[2], 1, piece[3])
        room = int(min(left[0], left[2] + 1))
        if self.cut and self.pool and room >= 1 and left[1] >= 1:
            # Whatever waits is longer than the room.
            whole = self._take(int(self.needs[: len(self.pool), 0].argmax()))
            pieces.append((*whole[:2], room, room - 1))
            self._put((whole[0], whole[1] + room, whole[2] - room, whole[2] - room - 1))
        return pieces

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for piece in pieces:
            yield self.sequences, at, piece
            at += piece[2]
        self.sequences += 1

    def _powers_of_two(self, pieces: list[tuple], length: int) -> Iterator[tuple]:
        pieces = pieces[::-1]
        while length:
            want = 1 << (length.bit_length() - 1)
            length -= want
            chosen = []
            while want:
                key, start, tokens, _ = pieces.pop()
                now = min(tokens, want)
                chosen.append((key, start, now, now - 1))
                want -= now
                if now < tokens:
                    pieces.append((key, start + now, tokens - now, tokens - now - 1))
            yield from self._close(chosen)


def _first_sequence() -> int:
    return TaskContext.get().partitionId() * _PER_PARTITION


def pack_documents(
    docs: DataFrame,
    limits: Limits = Limits(),
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, loss_tokens,
    sequence_id, offset. The first token of a piece bears no loss, as nothing in its sequence precedes it."""
    source = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("start", T.LongType())])
    schema.add("length", "long").add("ids", "binary").add("doc_tokens", "long").add("loss_tokens", "long")
    schema.add("sequence_id", "long").add("offset", "long")
    end = np.array([end_id], "<u4").tobytes()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, first = encoder(vocabulary_path(vocabulary)).encode, Packer(limits, cut=True), _first_sequence()
        kind = None

        def rows(placed: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*placed)) or [()] * 8
            kinds = [kind, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema.names)

        def row(sequence: int, offset: int, piece: tuple) -> tuple:
            (doc_id, ids), start, tokens, loss = piece
            return doc_id, start, tokens, ids[4 * start : 4 * (start + tokens)], len(ids) // 4, loss, first + sequence, offset

        for batch in (whole.slice(k, 1000) for whole in batches for k in range(0, max(1, whole.num_rows), 1000)):
            kind, placed = batch.schema.field(0).type, []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                ids += end
                placed += [row(*p) for p in packer.add(((doc_id, ids), 0, len(ids) // 4, len(ids) // 4 - 1))]
                if len(placed) >= 2000:
                    yield rows(placed)
                    placed = []
            yield rows(placed)
        if kind is not None:
            yield rows([row(*p) for p in packer.finish()])

    return source.mapInArrow(packed, schema)


def packed_pieces(docs: DataFrame) -> DataFrame:
    """The pieces of ``pack_documents`` with a checksum of their ids instead of the ids."""
    return pack_documents(docs).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "loss_tokens",
    )


def pack_examples(examples: DataFrame, limits: Limits, tokens_col: str, loss_col: str, id_col: str) -> DataFrame:
    """Whole examples of given token and loss counts: id, tokens, loss_tokens, sequence_id, offset.

    Null counts are zero. An example that exceeds a limit by itself fits nowhere: its sequence and offset are null.
    """
    source = examples.select(
        quoted(id_col).alias("id"),
        F.coalesce(quoted(tokens_col).cast("long"), F.lit(0)).alias("tokens"),
        F.coalesce(quoted(loss_col).cast("long"), F.lit(0)).alias("loss_tokens"),
    )
    schema = T.StructType([*source.schema.fields]).add("sequence_id", "long").add("offset", "long")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, first, kinds = Packer(limits, cut=False), _first_sequence(), None

        def rows(placed: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*placed), kinds)], schema.names)

        for batch in batches:
            kinds, placed = [*batch.schema.types, pa.int64(), pa.int64()], []
            for key, tokens, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if tokens > limits.tokens or loss > limits.loss or limits.segments < 1:
                    placed.append((key, tokens, loss, None, None))
                    continue
                placed += [(p[0], p[2], p[3], first + s, at) for s, at, p in packer.add((key, 0, tokens, loss))]
            if placed:
                yield rows(placed)
        if placed := [(p[0], p[2], p[3], first + s, at) for s, at, p in packer.finish()]:
            yield rows(placed)

    return source.mapInArrow(packed, schema)
