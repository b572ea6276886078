"""Sum-of-squares packing of token ids into windows of fixed length.

Full windows are cut off a document as they are; what remains of it is placed whole, online, at the fill level
h for which the sum over all levels 0 < h < length of (windows filled to h) squared becomes least; the counts
lie in a level array. What is placed stays: when a task ends, the emptiest open windows are taken apart, and their
pieces cut, only to fill the rooms of the fullest ones. What is left at the very end, less than a window, is cut at powers of
two, which need no padding. `placed` says of each piece whether it lies where the level array put it.
Packing runs where the rows lie: no shuffle, and a hot source is as good as any other.

Defined results: a null text is the empty text, whose only id is the end id; a null doc_id is kept;
repeated rows are packed as often as they come; an empty table gives an empty table. Only doc_id and text are read.
Sequence ids are (partition << 33) + a running number: unique, and the same when a lost task runs again on the same rows.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from pagelore.llm.common import held, tune


class Piece(NamedTuple):
    """Some ids of a document, four bytes each."""

    doc_id: object
    start: int
    ids: bytes
    doc_tokens: int
    placed: bool = True


class SumOfSquares:
    """One stream of windows. `emit` gets (sequence number, pieces) of each closed window.

    Only pieces of open windows are held: fewer than a window's ids of each document, and few of them, since the method keeps
    the number of open windows small: on the order of the square root of the documents, once these are many more than the levels.
    """

    def __init__(self, length: int, emit: Callable[[int, list[Piece]], None]):
        self.length, self.emit = length, emit
        self.levels = np.zeros(length + 1, np.int64)
        self.at: dict[int, list[int]] = defaultdict(list)
        self.open: dict[int, list[Piece]] = {}
        self.next = 0

    def add(self, doc_id: object, ids: bytes) -> None:
        """All ids of one document, four bytes each."""
        n, size = len(ids) // 4, self.length
        whole = n - n % size
        for start in range(0, whole, size):
            self.emit(self.number(), [Piece(doc_id, start, ids[4 * start : 4 * (start + size)], n)])
        if whole < n:
            self.place(Piece(doc_id, whole, ids[4 * whole :], n))

    def number(self) -> int:
        self.next += 1
        return self.next - 1

    def level_for(self, size: int) -> int:
        """The level whose use leaves the least sum of squares; 0 opens a window. Ties go to the fuller level."""
        counts, room = self.levels, self.length - size
        change = np.where(counts[: room + 1] > 0, 1 - 2 * counts[: room + 1], np.iinfo(np.int64).max // 2)
        change[:room] += 2 * counts[size : self.length] + 1
        change[0] = 2 * counts[size] + 1
        # filling a level that already holds the item's own size moves one window from it
        return int(len(change) - 1 - np.argmin(change[::-1]))

    def place(self, piece: Piece) -> None:
        size = len(piece.ids) // 4
        level = self.level_for(size)
        if level:
            which = self.at[level].pop()
            self.levels[level] -= 1
        else:
            which = self.number()
            self.open[which] = []
        self.open[which].append(piece)
        if level + size == self.length:
            self.emit(which, self.open.pop(which))
        else:
            self.at[level + size].append(which)
            self.levels[level + size] += 1

    def finish(self) -> None:
        """Fill the rooms of the fullest open windows with what the emptiest hold; the rest goes in powers of two."""
        fill = lambda which: sum(len(p.ids) // 4 for p in self.open[which])
        full = deque(sorted(self.open, key=lambda which: (fill(which), -which), reverse=True))
        numbers, hand = [], []  # numbers of the windows taken apart, and their pieces
        while full:
            which = full.popleft()
            window, room = self.open[which], self.length - fill(which)
            while room:
                if not hand:
                    if not full:
                        break
                    numbers.append(full.pop())
                    hand = self.open[numbers[-1]][::-1]
                piece, rest = cut(hand.pop(), room)
                hand += [rest] * bool(rest.ids)
                window.append(piece)
                room -= len(piece.ids) // 4
            if room:
                numbers.append(which)
                hand = window[::-1]
                break
            self.emit(which, window)
        left = sum(len(p.ids) // 4 for p in hand)
        while left:
            window, room = [], 1 << (left.bit_length() - 1)  # the largest power of two that can be filled
            left -= room
            while room:
                piece, rest = cut(hand.pop(), room)
                hand += [rest] * bool(rest.ids)
                window.append(piece)
                room -= len(piece.ids) // 4
            self.emit(numbers.pop() if numbers else self.number(), window)
        self.open.clear()
        self.at.clear()
        self.levels[:] = 0


def cut(piece: Piece, room: int) -> tuple[Piece, Piece]:
    """What of a piece goes into the room, and the rest of it, which may be empty."""
    ids = piece.ids
    return piece._replace(ids=ids[: 4 * room], placed=False), piece._replace(ids=ids[4 * room :], start=piece.start + min(room, len(ids) // 4), placed=False)


CHUNK = re.compile(r"[^ \n\t\r]+")
#: Letters, then signs: two pretokens. Left to the tokenizer: letters whose lower case depends on what is near or is no letter, and apostrophes.
WORD = re.compile(r"([^\W\d_\u0130\u03a3]+)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones are themselves, the others follow U+0100 in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class ChunkIds(dict):
    """Part of a text without white space -> its ids as bytes.

    White space only separates for such a tokenizer, so a text's ids are its parts' in turn. A part that is a plain word, or
    one with signs behind it, goes to the tokenizer's merges straight; any other takes the whole way. The last two
    generations of parts are kept.
    """

    def __init__(self, path: str, most: int = 250_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.older = Tokenizer.from_file(path), most, {}
        self.merges, self.letters = self.tokenizer.model, byte_letters()

    def __missing__(self, chunk: str) -> bytes:
        if (found := self.older.get(chunk)) is None:
            found = self.ids(chunk)
            if len(chunk) > 64:
                return found
        self[chunk] = found
        return found

    def ids(self, chunk: str) -> bytes:
        plain = WORD.fullmatch(chunk)
        if not plain or len(chunk) > 64 or not plain[1].isalpha():
            return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        word, signs = plain.groups()
        if signs:
            return self[word] + self._merged(signs)
        low = word.lower()
        return self[low] if low != word else self._merged(word)

    def _merged(self, pretoken: str) -> bytes:
        if not pretoken.isascii():
            pretoken = unicodedata.normalize("NFC", pretoken).encode("utf-8").decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.merges.tokenize(pretoken)]).tobytes()

    def of(self, text: str) -> bytes:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, CHUNK.findall(text)))


def tokenizer(path: str) -> ChunkIds:
    return held(("packing", path), lambda: ChunkIds(path))


COLUMNS = {"start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "placed": pa.bool_()}


def pack(docs: DataFrame, vocabulary: str, *, length: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, placed of each piece; with_ids adds the ids themselves."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = tokenizer(vocabulary), int(end_id).to_bytes(4, "little")
        first, rows = TaskContext.get().partitionId() << 33, []

        def emit(which: int, pieces: list[Piece]) -> None:
            offset = 0
            for doc_id, start, ids, n, placed in pieces:
                rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), n, first + which, offset, placed, ids))
                offset += len(ids) // 4

        def drained() -> Iterator[pa.RecordBatch]:
            if rows:
                doc_ids, *rest, ids = zip(*rows, strict=True)
                arrays = [pa.array(doc_ids, id_type), *(pa.array(x, t) for x, t in zip(rest, COLUMNS.values(), strict=True))]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *COLUMNS, *["ids"] * with_ids])
                rows.clear()

        packer, id_type = SumOfSquares(length, emit), pa.int64()
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                packer.add(doc_id, ids_of.of(text or "") + end)
            yield from drained()
        packer.finish()
        yield from drained()

    shape = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} {'boolean' if t == pa.bool_() else 'long'}" for c, t in COLUMNS.items()) + ", ids array<int>" * with_ids
    return docs.selectExpr("doc_id", "text").mapInArrow(run, shape)
