"""Problem 8: encoding the corpus with a public byte-level BPE vocabulary.

Method: the merge table is compiled into a finite-state transducer that is determinised lazily.  A state holds the
*live boundaries* of the bytes read so far: every position from which the vocabulary's trie can still be walked to
the end, with the tokens that lead up to it.  A byte moves every live walk one edge on; where a walk spells a token
that may follow its predecessor, a boundary opens at the new end.  Tokens that all live boundaries agree on can't
change any more and are emitted at once: the lookahead is bounded by the longest token.  A token may follow another
if merging their bytes gives back just these two, which decides BPE completely.  States and transitions are built
when first needed and kept; whole pieces are kept as well.

Decoding streams: an incremental UTF-8 state machine turns bytes into characters as soon as they are complete.

Null and empty texts have the empty list of ids.  Special tokens in a text are ordinary text.  Text of any length
is encoded whole.  The vocabulary is read on the driver and sent to the executors; its size is fixed (50,256 tokens).
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("VELMIRA_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# fixed value: how the vocabulary's texts are cut into pieces before merging
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
_ASCII_PIECES = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+""")
_ANY_PIECES = regex.compile(PIECES)
_KEPT = 400_000
_STATES = 20_000  # determinised states that are kept; beyond them, walks are followed side by side


def read_vocabulary(path: str | None = None) -> bytes:
    with open(path or os.path.join(TOKENIZER_DIR, VOCABULARY), "rb") as f:
        return f.read()


class Transducer:
    """Lazily determinised transducer of one vocabulary."""

    def __init__(self, vocabulary: bytes):
        self.rank = {base64.b64decode(token): int(number) for token, number in (line.split() for line in vocabulary.splitlines() if line)}
        self.token = {number: token for token, number in self.rank.items()}
        # trie: node -> {byte: node}; the token that ends at a node
        self.edges: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for token, number in self.rank.items():
            node = 0
            for byte in token:
                step = self.edges[node].get(byte)
                if step is None:
                    step = self.edges[node][byte] = len(self.edges)
                    self.edges.append({})
                    self.ends.append(-1)
                node = step
            self.ends[node] = number
        self._may: dict[tuple[int, int], bool] = {}
        self._spines: tuple[dict[int, tuple[int, ...]], ...] = ({}, {})  # left edge, right edge
        # state: (last emitted token or -1, ((trie node, tokens since), ...)), boundaries oldest first
        self.start = (-1, ((0, ()),))
        self.number: dict[tuple, int] = {self.start: 0}
        self.states: list[tuple] = [self.start]
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def _spine(self, number: int, side: int) -> tuple[int, ...]:
        """The tokens that stand at one edge of a token's bytes while they are merged, first the edge byte itself.
        Each of them is formed at the time of its own rank."""
        known = self._spines[side].get(number)
        if known is None:
            data = self.token[number]
            parts = [data[i : i + 1] for i in range(len(data))]
            seen = [self.rank[parts[side]]]
            while len(parts) > 1:
                least, at = min((self.rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if self.rank[parts[side]] != seen[-1]:
                    seen.append(self.rank[parts[side]])
            known = self._spines[side][number] = tuple(seen)
        return known

    def may_follow(self, left: int, right: int) -> bool:
        """Whether no merge ever crosses the border between two neighbouring tokens."""
        known = self._may.get((left, right))
        if known is None:
            if len(self._may) > _KEPT:
                self._may.clear()
            known = self._may[left, right] = self._kept_apart(self._spine(left, -1), self._spine(right, 0))
        return known

    def _kept_apart(self, ours: tuple[int, ...], theirs: tuple[int, ...]) -> bool:
        i = j = 0
        never = 1 << 60
        while True:
            across = self.rank.get(self.token[ours[i]] + self.token[theirs[j]], never)
            grow_left = ours[i + 1] if i + 1 < len(ours) else never
            grow_right = theirs[j + 1] if j + 1 < len(theirs) else never
            # of equal ranks the leftmost is merged first
            if across < grow_left and across <= grow_right and across < never:
                return False
            if grow_left == grow_right == never:
                return True
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        last, live = self.states[state]
        walks, opened = [], None
        for node, tokens in live:
            step = self.edges[node].get(byte)
            if step is None:
                continue
            end = self.ends[step]
            if end >= 0 and opened is None:
                before = tokens[-1] if tokens else last
                if before < 0 or self.may_follow(before, end):
                    opened = (0, (*tokens, end))
            if self.edges[step]:
                walks.append((step, tokens))
        walks.append(opened)
        # what all live boundaries agree on is final
        first, agreed = walks[0][1], 0
        while agreed < len(first) and all(len(t) > agreed and t[agreed] == first[agreed] for _, t in walks):
            agreed += 1
        out = first[:agreed]
        key = (out[-1] if out else last, tuple((n, t[agreed:]) for n, t in walks))
        target = self.number.get(key)
        if target is None:
            target = self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        move = self.moves[state][byte] = (target, out)
        return move

    def piece(self, data: bytes) -> tuple[int, ...]:
        state, out = 0, []
        moves = self.moves
        for at, byte in enumerate(data):
            move = moves[state].get(byte)
            if move is None:
                if len(self.states) >= _STATES:
                    return (*out, *self._undetermined(state, data[at:]))
                move = self._move(state, byte)
            state = move[0]
            if move[1]:
                out.extend(move[1])
        out.extend(self.states[state][1][-1][1])  # the boundary at the end of the piece
        return tuple(out)

    def _undetermined(self, state: int, data: bytes) -> list[int]:
        """The rest of a piece whose states aren't kept: the same walks, followed side by side."""
        last, live = self.states[state]
        token, back, walks = [last], [-1], []
        for node, tokens in live:
            at = 0
            for t in tokens:
                token.append(t)
                back.append(at)
                at = len(token) - 1
            walks.append((node, at))
        edges, ends, may = self.edges, self.ends, self._may
        opened = walks[-1][1]
        for byte in data:
            ahead, opened = [], -1
            for node, at in walks:
                step = edges[node].get(byte)
                if step is None:
                    continue
                end = ends[step]
                if end >= 0 and opened < 0:
                    before = token[at]
                    if before >= 0:
                        fits = may.get((before, end))
                        if fits is None:
                            fits = self.may_follow(before, end)
                    if before < 0 or fits:
                        token.append(end)
                        back.append(at)
                        opened = len(token) - 1
                if edges[step]:
                    ahead.append((step, at))
            ahead.append((0, opened))
            walks = ahead
        out = []
        while opened > 0:
            out.append(token[opened])
            opened = back[opened]
        return out[::-1]

class _Pieces(dict):
    """piece -> ids; starts anew when full, so memory stays bounded and nothing is lost."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) > _KEPT:
            self.clear()
        ids = self.transducer.piece(piece.encode("utf-8", "replace"))
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, vocabulary: bytes):
        self.transducer = Transducer(vocabulary)
        self._pieces = _Pieces(self.transducer)

    def pieces(self, text: str) -> list[str]:
        return (_ASCII_PIECES if text.isascii() else _ANY_PIECES).findall(text)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self._pieces.__getitem__, self.pieces(text)))) if text else []

    def encode_batch(self, texts: Iterable[str | None]) -> tuple[array, np.ndarray]:
        """(flat ids, offsets)."""
        flat, ends, get = array("i"), [0], self._pieces.__getitem__
        for text in texts:
            if text:
                flat.extend(chain.from_iterable(map(get, self.pieces(text))))
            ends.append(len(flat))
        return flat, np.array(ends, dtype=np.int32)


class StreamDecoder:
    """ids -> text, piece by piece; characters appear as soon as their last byte is known.

    State: bytes of an unfinished character and how many it still lacks.  A byte that can't go on with the
    unfinished character, or can't start one, gives U+FFFD.
    """

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens, self.held, self.lacking, self.low, self.high = tokens, bytearray(), 0, 0x80, 0xBF

    def feed(self, ids: Iterable[int]) -> str:
        out: list[str] = []
        for number in ids:
            for byte in self.tokens[number]:
                self._byte(byte, out)
        return "".join(out)

    def _byte(self, byte: int, out: list[str]) -> None:
        if self.lacking:
            if self.low <= byte <= self.high:
                self.held.append(byte)
                self.lacking -= 1
                self.low, self.high = 0x80, 0xBF
                if not self.lacking:
                    out.append(self.held.decode())
                    self.held.clear()
                return
            out.append("�")
            self.held.clear()
            self.lacking, self.low, self.high = 0, 0x80, 0xBF
        if byte < 0x80:
            out.append(chr(byte))
        elif 0xC2 <= byte <= 0xF4:
            self.lacking = 1 + (byte >= 0xE0) + (byte >= 0xF0)
            self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
            self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
            self.held.append(byte)
        else:
            out.append("�")

    def end(self) -> str:
        rest = "�" if self.lacking else ""
        self.held.clear()
        self.lacking = 0
        return rest


_ENCODERS: dict[int, Encoder] = {}


def _encoder(vocabulary: bytes) -> Encoder:
    """One encoder per worker process, kept between tasks."""
    key = hash(vocabulary)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def _spread(df: DataFrame) -> DataFrame:
    """A few small files must not leave cores idle; large inputs keep their scan partitions."""
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(least) if df.rdd.getNumPartitions() < least else df


def encoded(df: DataFrame, key: str, text: str, vocabulary: bytes | None = None) -> DataFrame:
    """``key, ids``."""
    sent = df.sparkSession.sparkContext.broadcast(vocabulary or read_vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                flat, ends = encoder.encode_batch(part.column(1).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.empty(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [key, "ids"])

    kind = dict(df.dtypes)[key]
    return _spread(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def counted(df: DataFrame, text: str, vocabulary: bytes | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and ``n_tokens`` (0 for null and empty texts)."""
    sent = df.sparkSession.sparkContext.broadcast(vocabulary or read_vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                _, ends = encoder.encode_batch(part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(np.diff(ends).astype(np.int64))], [*keep, "n_tokens"])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_tokens bigint"])
    return _spread(df.select(*keep, F.col(text))).mapInArrow(run, schema)


def decoded(df: DataFrame, key: str, ids: str = "ids", vocabulary: bytes | None = None) -> DataFrame:
    """``key, text``: the exact inverse of ``encoded`` for valid text."""
    sent = df.sparkSession.sparkContext.broadcast(vocabulary or read_vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _encoder(sent.value).transducer.token
        for batch in batches:
            texts = []
            for row in batch.column(1).to_pylist():
                stream = StreamDecoder(tokens)
                texts.append(stream.feed(row or ()) + stream.end())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    kind = dict(df.dtypes)[key]
    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")
