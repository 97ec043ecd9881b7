"""Documents packed into training sequences by bounded-space online best-fit.

Texts are tokenized in parallel; a document is its ids and a closing id 0, cut into pieces of at most
``capacity`` ids. The piece table (no ids, about 40 bytes a piece) is written once and dealt by hash to
tasks of about ``PIECES_PER_TASK`` pieces, in hash order, which mixes long and short ones. Each task
keeps at most ``open_bins`` open sequences in a bitset keyed by free space: a piece goes to the open
sequence with the least room that still holds it; when none does and all places are taken, the fullest
sequence is closed. So a task's memory doesn't depend on its input, and a rerun after a lost executor
gives the same sequences.

Defined cases: null text counts as empty; an empty document is the single id 0; ids may be null or
repeated (each row is packed); an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import extended, settle

CAPACITY = 2048
OPEN_BINS = 512
PIECES_PER_TASK = 1 << 16
END_ID = b"\0\0\0\0"
KNOWN_WORDS = 600_000
SLICE = 256

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordTokenizer:
    """The ids of texts, as little-endian 32-bit words.

    The tokenizer splits texts at white space and into runs of letters, single digits and runs of other
    signs, and treats every part on its own, so the ids of a word are remembered. Texts outside Latin-1
    or with special tokens, where the split depends on Unicode tables, go to the tokenizer whole.
    """

    LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
    DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
    PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^{LETTERS}{DIGITS}\\x09-\\x0d\\x20\x85\xa0]+")
    ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _learn_parts(self, parts: list[str]) -> None:
        import numpy as np

        coded = self.tokenizer.encode(" ".join(parts), add_special_tokens=False)
        ids = np.array(coded.ids, dtype="<u4").tobytes()
        cuts = [0, *(np.flatnonzero(np.diff(np.array(coded.word_ids))) + 1).tolist(), len(coded.ids)]
        assert len(cuts) == len(parts) + 1
        for part, a, z in zip(parts, cuts, cuts[1:]):
            self.parts[part] = ids[4 * a : 4 * z]

    def _learn(self, words: list[str]) -> None:
        split = [self.PARTS.findall(w) for w in words]
        unknown = sorted({p for parts in split for p in parts if p not in self.parts})
        if unknown:
            self._learn_parts(unknown)
        for word, parts in zip(words, split):
            self.words[word] = b"".join([self.parts[p] for p in parts])

    def _whole(self, text: str) -> bool:
        """Whether the tokenizer has to see the text as it is."""
        if any(sign in text for sign in self.ODD):
            return True
        try:
            return not text.isascii() and not text.encode("latin-1")
        except UnicodeEncodeError:
            return True

    def encode(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        if len(self.words) > KNOWN_WORDS:
            self.words, self.parts = {}, {}
        plain = [None if self._whole(t) else t.lower().split() for t in texts]
        unknown = set().union(*(p for p in plain if p)).difference(self.words)
        if unknown:
            self._learn(sorted(unknown))
        of = self.words.__getitem__
        return [
            b"".join(map(of, p)) if p is not None else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
            for t, p in zip(texts, plain)
        ]


_LOADED: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids."""
    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
        part = ids[at : at + 4 * capacity]
        yield piece, at // 4, len(part) // 4, zlib.crc32(part)


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The piece table of the documents."""

    def work(batches):
        coder = _tokenizer(tokenizer_path)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), SLICE):
                coded = coder.encode([t or "" for t in texts.slice(at, SLICE).to_pylist()])
                rows = [(i, *piece) for i, c in zip(ids[at : at + SLICE], coded) for piece in cut(c + END_ID, capacity)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(work, PIECES)


class OpenBins:
    """Open sequences by free space; bit f of ``free`` is set while one with f free places is open."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit, self.free, self.open, self.made = capacity, limit, 0, 0, 0
        self.by_free: dict[int, list[int]] = {}

    def _take(self, room: int) -> int:
        at = self.by_free[room]
        number = at.pop()
        if not at:
            self.free ^= 1 << room
        self.open -= 1
        return number

    def place(self, size: int) -> tuple[int, int]:
        """(number of the sequence, offset there)"""
        fitting = self.free >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            number = self._take(room)
        else:
            room, number = self.capacity, self.made
            self.made += 1
            if self.open == self.limit and size < self.capacity:
                self._take((self.free & -self.free).bit_length() - 1)
        rest = room - size
        if rest:
            self.by_free.setdefault(rest, []).append(number)
            self.free |= 1 << rest
            self.open += 1
        return number, self.capacity - room


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """``pieces`` (with a column ``length``, at most ``capacity``) with sequence_id and offset added."""
    pieces = settle(pieces)
    tasks = -(-pieces.count() // pieces_per_task) or 1
    columns = pieces.columns

    def work(batches):
        bins, first = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            batch = batch.select(columns)
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([first + n for n, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())],
                [*columns, "sequence_id", "offset"],
            )

    mixed = F.xxhash64("doc_id", "piece", "ids_crc32")
    schema = extended(pieces, "sequence_id long, offset long")
    return pieces.repartition(tasks, mixed).sortWithinPartitions(mixed, "doc_id", "piece").mapInArrow(work, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(tokenized_pieces(docs, tokenizer_path, capacity), capacity)
