"""Byte-level BPE as a finite-state transducer that is determinised while it runs, and a streaming decoder.

The encoding of every prefix of a pretoken ends in exactly one token, and a token may follow another just if the
two alone encode to themselves. So a reader of bytes need only keep, for each place where a token may still be
open, the vocabulary's trie node reached from there and the token that ends there. That set is the state. States and
their transitions are made when first met and kept; tokens that all open readings share are emitted and forgotten.
A reading lives no longer than the longest token, which bounds the lookahead; time is linear in the length of
a pretoken. Kept states and pretokens are bounded in number, and dropped in whole generations.

Defined results: a null text encodes to no ids (and so decodes to no bytes); a null doc_id is kept; repeated
rows are each encoded; an empty table gives an empty table; only doc_id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pagelore.llm.common import held, tune

MAX_STATES, MAX_PAIRS, MAX_PIECES, LONG_PIECE = 250_000, 500_000, 400_000, 64
ROOT, NO_TOKEN = 0, -1


class State(dict):
    """byte -> next state. items: (trie node, token that ends where the reading begins) of each open reading, the newest last."""

    __slots__ = ("items_", "token")

    def __init__(self, items: tuple):
        super().__init__()
        self.items_, self.token = items, items[-1][1]


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.trie: dict[int, int] = {}
        self.token_at: list[int] = [NO_TOKEN]
        for token, rank in ranks.items():
            node = ROOT
            for byte in token:
                key = node << 8 | byte
                if (child := self.trie.get(key)) is None:
                    child = self.trie[key] = len(self.token_at)
                    self.token_at.append(NO_TOKEN)
                node = child
            self.token_at[node] = rank
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.longest = max(self.length.values(), default=1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.follows: dict[int, bool] = {}
        self.start = self.state(((ROOT, NO_TOKEN),))

    def state(self, items: tuple) -> State:
        if (found := self.states.get(items)) is None:
            found = self.states[items] = State(items)
        return found

    def merged(self, piece: bytes) -> list[int]:
        """The encoding by definition: merge the pair of lowest rank until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranked = [(self.ranks[p], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.ranks]
            if not ranked:
                break
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one (longer than a byte)."""
        if (found := self.parts.get(token)) is None:
            whole = self.bytes_of[token]
            parts = [whole[i : i + 1] for i in range(len(whole))]
            while len(parts) > 2:
                ranked = [(self.ranks[p], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.ranks]
                i = min(ranked)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            found = self.parts[token] = (self.ranks[parts[0]], self.ranks[parts[1]])
        return found

    def may_follow(self, before: int, token: int) -> bool:
        """Do the two tokens, side by side, encode to themselves?

        Merges are undone from the last to the first. At any time the boundary lies between one part of the left
        token and one of the right; if these merge before either is merged within its own token, the pair can't stand. At
        equal rank the place further left goes first.
        """
        if before == NO_TOKEN:
            return True
        key = before << 32 | token
        if (ok := self.follows.get(key)) is None:
            if len(self.follows) >= MAX_PAIRS:
                self.follows.clear()
            ok = self.follows[key] = self._stands(before, token)
        return ok

    def _stands(self, left: int, right: int) -> bool:
        ranks, bytes_of, never = self.ranks, self.bytes_of, 1 << 60
        left_until = right_until = never
        x, y = bytes_of[left], bytes_of[right]
        while True:
            rank = ranks.get(x + y)
            if rank is not None and rank < left_until and rank <= right_until:
                return False
            left_from, right_from = (left if len(x) > 1 else -1), (right if len(y) > 1 else -1)
            if left_from < 0 and right_from < 0:
                return True
            if left_from > right_from:
                left_until, left = left, self.halves(left)[1]
                x = bytes_of[left]
            else:
                right_until, right = right, self.halves(right)[0]
                y = bytes_of[right]

    def step(self, state: State, byte: int) -> State:
        items, ends = [], NO_TOKEN
        trie, token_at = self.trie, self.token_at
        for node, before in state.items_:
            if (child := trie.get(node << 8 | byte)) is None:
                continue
            items.append((child, before))
            token = token_at[child]
            if token != NO_TOKEN and ends == NO_TOKEN and self.may_follow(before, token):
                ends = token
        if ends == NO_TOKEN:
            raise ValueError("the vocabulary lacks a byte or has a token that its own merges don't make")
        items.append((ROOT, ends))
        state[byte] = then = self.state(tuple(items))
        return then

    def back(self, ends: list[int], at: int) -> list[int]:
        """The tokens that lead to place `at`, the last first; ends[i] is the token that ends at i + 1."""
        out = []
        while at > 0:
            token = ends[at - 1]
            out.append(token)
            at -= self.length[token]
        return out

    def stream(self, piece: bytes, window: int = 4096) -> Iterator[list[int]]:
        """The ids of one pretoken, in parts. After each window, what all open readings share is emitted and forgotten.

        An open reading began at most `longest` bytes ago, so no more than a window and that is held.
        """
        if len(self.states) > MAX_STATES:
            self.reset()
        state, ends = self.start, []
        for start in range(0, len(piece), window):
            for byte in piece[start : start + window]:
                state = state.get(byte) or self.step(state, byte)
                ends.append(state.token)
            if start + window >= len(piece):
                break
            # what the last places share, from the left, is settled: each open reading begins at one of them
            paths = [self.back(ends, len(ends) - k)[::-1] for k in range(min(self.longest, len(ends)))]
            shared = 0
            while all(len(p) > shared and p[shared] == paths[0][shared] for p in paths):
                shared += 1
            if shared:
                yield paths[0][:shared]
                del ends[: sum(self.length[t] for t in paths[0][:shared])]
            if len(self.states) > MAX_STATES:
                items = state.items_
                self.reset()
                state = self.state(items)
        yield self.back(ends, len(ends))[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one pretoken."""
        if len(piece) > 4096:
            return [i for part in self.stream(piece) for i in part]
        if len(self.states) > MAX_STATES:
            self.reset()
        state, ends = self.start, []
        for byte in piece:
            state = state.get(byte) or self.step(state, byte)
            ends.append(state.token)
        out, at, length = [], len(ends), self.length
        while at > 0:
            token = ends[at - 1]
            out.append(token)
            at -= length[token]
        out.reverse()
        return out


class StreamDecoder:
    """ids -> text, piece by piece: a UTF-8 machine holds back the bytes of a character that is not complete yet."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self.held = bytes_of, b""

    @staticmethod
    def open_tail(data: bytes) -> int:
        """How many bytes at the end begin a character that lacks bytes."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                return 0
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                return back if back < need else 0
        return 0

    def feed(self, ids: Iterable[int]) -> str:
        data = self.held + b"".join(map(self.bytes_of.__getitem__, ids))
        tail = self.open_tail(data)
        self.held = data[len(data) - tail :]
        return data[: len(data) - tail].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Pieces(dict):
    """pretoken -> (decimal ids joined by one space, ids as a tuple); the last two generations are kept."""

    def __init__(self, transducer: Transducer, most: int = MAX_PIECES):
        super().__init__()
        self.transducer, self.most, self.older = transducer, most, {}

    def __missing__(self, piece: str) -> tuple[str, tuple]:
        if (found := self.older.get(piece)) is None:
            ids = self.transducer.encode(piece.encode("utf-8"))
            found = (" ".join(map(str, ids)), tuple(ids))
            if len(piece) > LONG_PIECE:
                return found
        self[piece] = found
        return found

    def renew(self) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()


class Codec:
    """Encodes whole texts: pretokens by the pattern, each through the transducer."""

    BLOCK = 50_000

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        self.pieces = Pieces(self.transducer)

    def blocks(self, text: str) -> Iterator[list[tuple[str, tuple]]]:
        """Encoded pretokens, a bounded number at a time."""
        if len(text) <= 2 * self.BLOCK:
            self.pieces.renew()
            yield list(map(self.pieces.__getitem__, self.pattern.findall(text)))
            return
        found = self.pattern.finditer(text)
        while block := [m[0] for m in islice(found, self.BLOCK)]:
            self.pieces.renew()
            yield list(map(self.pieces.__getitem__, block))

    def encode(self, text: str) -> list[int]:
        return [i for block in self.blocks(text) for _, ids in block for i in ids]

    def decode(self, ids: Iterable[int], chunk: int = 4096) -> str:
        stream, ids = StreamDecoder(self.transducer.bytes_of), iter(ids)
        out = []
        while part := list(islice(ids, chunk)):
            out.append(stream.feed(part))
        return "".join(out) + stream.finish()

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids as text, SHA-256 of the bytes that the ids decode to."""
        said, back, stream, n = hashlib.sha256(), hashlib.sha256(), StreamDecoder(self.transducer.bytes_of), 0
        for block in self.blocks(text):
            if not block:
                continue
            words, groups = zip(*block, strict=True)
            line = " ".join(words)
            said.update((" " + line if n else line).encode())
            n += line.count(" ") + 1
            back.update(stream.feed(chain.from_iterable(groups)).encode())
        back.update(stream.finish().encode())
        return n, said.hexdigest(), back.hexdigest()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}


def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process and vocabulary."""
    return held(("bpe", path, pattern), lambda: Codec(read_ranks(path), pattern))


def encoded(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>: the operator's own output."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary, pattern)
        for batch in batches:
            ids = [coder.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.selectExpr("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decoded(rows: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    tune(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([coder.decode(i or []) for i in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.selectExpr("doc_id", "ids").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def token_digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; each text is encoded and its ids decoded again in blocks."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary, pattern)
        for batch in batches:
            got = [coder.digests(t or "") for t in batch.column("text").to_pylist()]
            n, said, back = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
