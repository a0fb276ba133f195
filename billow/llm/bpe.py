"""Byte-pair encoding by a lazily determinised transducer, and streaming decoding."""

from __future__ import annotations

import base64
import hashlib
import os
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billow.session import spread

#: How the vocabulary splits a text before merging; fixed by the public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A vocabulary file that may be sent to every task.
FILE_LIMIT = 64 << 20
#: Transducer states and whole pieces that a task keeps; beyond it starts afresh, so memory has a bound.
STATE_LIMIT, PIECE_LIMIT = 300_000, 300_000
#: Ids that a task keeps before it hands them on; one text is never divided.
OUT = 1_000_000


def default_path() -> str:
    """Where the public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class State:
    """A set of readings that still differ: (tokens not yet emitted, token before, trie node since then)."""

    __slots__ = ("final", "items", "next")

    def __init__(self, items: tuple):
        self.items = items
        self.next: dict[int, tuple[tuple[int, ...], State]] = {}
        self.final: tuple[int, ...] = next((pending for pending, _, node in items if node == 0), ())


class Transducer:
    """Bytes to token ids.

    A sequence of tokens is the encoding of its bytes exactly if every two neighbours are the encoding of theirs, and
    each prefix of a piece has one encoding. So a nondeterministic reader sits between tokens or inside one (a trie
    node), knows the token before, and may end a token where the pair with the one before is possible. Sets of such
    readings are the deterministic states, built when first reached. What all readings of a set agree on is emitted;
    a reading that runs on is dropped once no token goes that far, so output waits for less than the longest token.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                below = self.children[node].get(byte)
                if below is None:
                    below = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = below
            self.token_at[node] = rank
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pattern = regex.compile(PATTERN)
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.start = self.state((((), -1, 0),))

    def state(self, items: tuple) -> State:
        found = self.states.get(items)
        if found is None:
            found = self.states[items] = State(items)
        return found

    def merged(self, text: bytes) -> list[int]:
        """The encoding of a few bytes by merging the pair of least rank, again and again; used for pairs of tokens."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def possible(self, before: int, token: int) -> bool:
        """Can `token` come after `before` (-1: at the start of a piece)?"""
        key = (before, token)
        known = self.pairs.get(key)
        if known is None:
            tail = self.bytes_of[token]
            known = self.merged(tail) == [token] if before < 0 else self.possible(-1, token) and self.merged(self.bytes_of[before] + tail) == [before, token]
            if len(self.pairs) > 4 * STATE_LIMIT:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def step(self, state: State, byte: int) -> tuple[tuple[int, ...], State]:
        """Determinises one move and keeps it."""
        items = []
        for pending, before, node in state.items:
            below = self.children[node].get(byte)
            if below is None:
                continue
            token = self.token_at[below]
            if token >= 0 and self.possible(before, token):
                items.append(((*pending, token), token, 0))
            if self.children[below]:
                items.append((pending, before, below))
        common = os.path.commonprefix([pending for pending, _, _ in items])
        cut = len(common)
        move = (tuple(common), self.state(tuple((pending[cut:], before, node) for pending, before, node in items)))
        state.next[byte] = move
        return move

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        state, out = self.start, []
        for byte in piece:
            move = state.next.get(byte)
            if move is None:
                if len(self.states) >= STATE_LIMIT:  # a state is all that a reading needs, so it goes on in a fresh machine
                    self.reset()
                    state = self.state(state.items)
                move = self.step(state, byte)
            if move[0]:
                out += move[0]
            state = move[1]
        out += state.final
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, strings of special tokens being ordinary text; [] for ''."""
        out: list[int] = []
        pieces = self.pieces
        for piece in self.pattern.findall(text):
            ids = pieces.get(piece)
            if ids is None:
                ids = self.encode_piece(piece.encode("utf-8", "replace"))
                pieces = self.pieces
                if len(piece) <= 64:
                    if len(pieces) >= PIECE_LIMIT:
                        self.reset()
                        pieces = self.pieces
                    pieces[piece] = ids
            out += ids
        return out


class Utf8Machine:
    """Code points from bytes that come in any portions; U+FFFD for each maximal part that is not UTF-8."""

    def __init__(self) -> None:
        self.need, self.value, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes, out: list[str]) -> None:
        if not self.need and data.isascii():
            out.append(data.decode("ascii"))
            return
        for byte in data:
            if self.need:
                if self.low <= byte <= self.high:
                    self.value, self.need, self.low, self.high = self.value << 6 | byte & 0x3F, self.need - 1, 0x80, 0xBF
                    if not self.need:
                        out.append(chr(self.value))
                    continue
                out.append("�")
                self.need, self.low, self.high = 0, 0x80, 0xBF
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xDF:
                self.need, self.value = 1, byte & 0x1F
            elif 0xE0 <= byte <= 0xEF:
                self.need, self.value = 2, byte & 0x0F
                self.low, self.high = 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
            elif 0xF0 <= byte <= 0xF4:
                self.need, self.value = 3, byte & 0x07
                self.low, self.high = 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
            else:
                out.append("�")

    def end(self, out: list[str]) -> None:
        if self.need:
            out.append("�")
            self.need, self.low, self.high = 0, 0x80, 0xBF


def decode(tokens: Iterable[bytes]) -> str:
    """The text of tokens, read one token at a time."""
    machine, out = Utf8Machine(), []
    for token in tokens:
        machine.feed(token, out)
    machine.end(out)
    return "".join(out)


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


_built: dict[bytes, Transducer] = {}


def transducer(data: bytes) -> Transducer:
    """One transducer for each vocabulary and worker process, kept from task to task."""
    key = hashlib.sha256(data).digest()
    if key not in _built:
        _built.clear()
        _built[key] = Transducer(read_ranks(data))
    return _built[key]


def vocabulary(path: str | None) -> bytes:
    path = path or default_path()
    if os.path.getsize(path) > FILE_LIMIT:
        raise ValueError(f"{path} is larger than {FILE_LIMIT} bytes")
    with open(path, "rb") as file:
        return file.read()


def encode_texts(documents: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """key, ids: one row a row of `documents`, with the token ids of its whole text; [] for null and ''.

    The vocabulary file (at most FILE_LIMIT bytes) is read on the driver and broadcast, so executors need no copy.
    A map over Arrow batches, with memory for one batch of texts (spark.sql.execution.arrow.maxBytesPerBatch bounds it)
    and OUT ids beside the transducer, which never has more than STATE_LIMIT states; no shuffle, but for tables in fewer parts
    than there are cores.
    """
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary(path))
    rows = spread(documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(shared.value)
        for batch in batches:
            begin, flat, offsets = 0, array("i"), array("i", [0])
            for i, value in enumerate(batch.column(1)):
                flat.extend(machine.encode(value.as_py() or ""))
                offsets.append(len(flat))
                if len(flat) >= OUT or i == batch.num_rows - 1:
                    ids = pa.ListArray.from_arrays(pa.array(np.frombuffer(offsets, np.int32)), pa.array(np.frombuffer(flat, np.int32)) if flat else pa.array([], pa.int32()))
                    yield pa.record_batch([batch.column(0).slice(begin, i + 1 - begin), ids], ["key", "ids"])
                    begin, flat, offsets = i + 1, array("i"), array("i", [0])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ids array<int>").select(F.col("key").alias(key), "ids")


def decode_ids(encoded: DataFrame, key: str, ids: str, path: str | None = None) -> DataFrame:
    """key, text: the text of a list of ids; '' for null and []. Unknown ids raise an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))
    rows = encoded.select(F.col(f"`{key}`").alias("key"), F.col(f"`{ids}`").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {rank: token for token, rank in read_ranks(shared.value).items()}
        for batch in batches:
            texts = [decode(names[i] for i in value.as_py() or ()) for value in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, text string").select(F.col("key").alias(key), "text")
