"""Byte-level BPE by a lazily determinised transducer, and streaming decode.

Encoding of a piece is read left to right. Among the tokens that end at a byte
exactly one is the last token of the encoding of the prefix up to there: the
one that the merges leave untouched beside the last token of the prefix before
it. The transducer follows these unique chains for every position from which a
longer token may still grow. Its state holds, for each such position, the trie
node read since and the tokens of its chain that are not common to all; common
tokens are emitted as soon as they are, so lookahead is bounded by the longest
token. States and moves are made when first needed.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

#: Pieces, and states of the transducer, kept before their tables are emptied.
CACHE, STATES = 800_000, 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """The merges of a rank table, compiled on demand."""

    def __init__(self, ranks: dict[bytes, int], limit: int = STATES):
        self.ranks, self.limit = ranks, limit
        self.text = {i: t for t, i in ranks.items()}
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                step = self.trie[node].get(byte)
                if step is None:
                    step = self.trie[node][byte] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(-1)
                node = step
            self.token_at[node] = rank
        self._beside: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int]] = {}
        self.reset()

    def reset(self) -> None:
        """Forget the states and moves made so far."""
        # A state: the last token emitted, and for each live position its trie node and the tokens of its chain not yet emitted.
        self.states: list[tuple[int, tuple[tuple[int, tuple[int, ...]], ...]]] = []
        self.number: dict[object, int] = {}
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self.tails: list[tuple[int, ...] | None] = []
        self._state(-1, ((0, ()),), ())

    def _state(self, last: int, live: tuple, tail: tuple[int, ...] | None) -> int:
        key = (last, live, tail)
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.states)
            self.states.append((last, live))
            self.moves.append({})
            self.tails.append(tail)
        return found

    def merged(self, text: bytes, below: int = 1 << 60) -> list[int]:
        """The merges of rank under ``below`` applied one by one, for short texts."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; (token, token) for a byte."""
        found = self._halves.get(token)
        if found is None:
            text = self.text[token]
            found = (token, token)
            if len(text) > 1:
                parts = self.merged(text, below=token)
                found = (parts[0], parts[1]) if len(parts) == 2 else (-1, -1)
            self._halves[token] = found
        return found

    def stands(self, left: int, right: int) -> bool:
        """Whether the merges leave the two tokens as they are, side by side.

        They do unless, at some time while the two are built up, the parts
        that touch make a token that is merged earlier than the next step of
        either side. The steps are undone from the last to the first.
        """
        if left < 0:
            return self.halves(right)[0] >= 0
        key = left << 32 | right
        found = self._beside.get(key)
        if found is not None:
            return found
        if len(self._beside) > self.limit:
            self._beside.clear()
        found = self.halves(right)[0] >= 0
        # Rank at which either side is next joined; equal ranks on the left come first, as merges run from the left.
        a, b, due, text, ranks = left, right, 1 << 60, self.text, self.ranks
        while found:
            joint = ranks.get(text[a] + text[b])
            if joint is not None and joint < due:
                found = False
            elif len(text[a]) == 1 and len(text[b]) == 1:
                break
            elif len(text[b]) == 1 or (a > b and len(text[a]) > 1):
                due, a = a, self.halves(a)[1]
            else:
                due, b = b + 1, self.halves(b)[0]
        self._beside[key] = found
        return found

    def move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The next state and the tokens emitted; made once."""
        last, live = self.states[state]
        grown, chain = [], None
        for node, pending in live:
            node = self.trie[node].get(byte)
            if node is None:
                continue
            token = self.token_at[node]
            if chain is None and token >= 0 and self.stands(pending[-1] if pending else last, token):
                chain = (*pending, token)
            if self.trie[node]:
                grown.append((node, pending))
        if chain is not None:
            grown.append((0, chain))
        if not grown:
            raise ValueError("a byte has no token")
        if len(grown) == 1:
            out, rest = grown[0][1], ((grown[0][0], ()),)
        else:
            common, out = 0, ()
            for tokens in zip(*(p for _, p in grown)):
                if any(t != tokens[0] for t in tokens):
                    break
                common += 1
            if common:
                out = grown[0][1][:common]
                grown = [(node, p[common:]) for node, p in grown]
            rest = tuple(grown)
        if all(p for _, p in rest):
            last = -2  # no live chain starts beside it
        elif out:
            last = out[-1]
        nxt = self._state(last, rest, rest[-1][1] if chain is not None else None)
        self.moves[state][byte] = nxt, out
        return nxt, out

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece, as the merges give them; a piece that is itself a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > self.limit:
            self.reset()
        state, out, moves = 0, [], self.moves
        for byte in piece:
            step = moves[state].get(byte)
            state, tokens = step if step is not None else self.move(state, byte)
            if tokens:
                out += tokens
        tail = self.tails[state]
        if tail is None:  # cannot be where every byte is a token
            return self.merged(piece)
        return [*out, *tail]


class StreamDecoder:
    """Text from token ids as they come: only bytes that end a character are given out, the rest waits for the next call."""

    #: Bytes of a character, by its first byte; 0 within a character.
    WIDTH = bytes(1 if b < 0x80 else 0 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4 for b in range(256))

    def __init__(self, table: dict[int, bytes]):
        self.table, self.waiting = table, b""

    def feed(self, ids: Iterable[int]) -> bytes:
        """Whole characters so far, as UTF-8."""
        data = self.waiting + b"".join(map(self.table.__getitem__, ids))
        end, back = len(data), 1
        while back <= min(3, end):
            width = self.WIDTH[data[end - back]]
            if width:
                if width > back:
                    end -= back
                break
            back += 1
        self.waiting = data[end:]
        return data[:end]

    def close(self) -> bytes:
        """What is left; incomplete only if the ids were."""
        data, self.waiting = self.waiting, b""
        return data


class Codec:
    """Whole texts to ids and back, piece by piece."""

    def __init__(self, path: str, pattern: str, limit: int = CACHE):
        ranks = load_ranks(path)
        self.transducer = Transducer(ranks)
        self.pieces = regex.compile(pattern)
        self.table = {str(i): t for t, i in ranks.items()}
        encode, limit_ = self.transducer.encode, limit

        class Known(dict):
            def __missing__(self, piece: str) -> str:
                if len(self) >= limit_:
                    self.clear()
                found = ",".join(map(str, encode(piece.encode())))
                self[piece] = found
                return found

        self.known = Known()

    def encode_text(self, text: str) -> str:
        """The ids in decimal, joined by commas."""
        return ",".join(map(self.known.__getitem__, self.pieces.findall(text)))

    def decode_stream(self, ids: list[str], step: int = 1 << 16) -> Iterator[bytes]:
        decoder = StreamDecoder(self.table)
        for i in range(0, len(ids), step):
            yield decoder.feed(ids[i : i + step])
        yield decoder.close()


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each Python worker."""
    return Codec(path, pattern)


@contextmanager
def uncollected() -> Iterator[None]:
    """Python's search for cycles rests: states, moves and ids are many and hold no cycles, so it finds nothing among them."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _coded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            counts, ids_sha, back_sha = [], [], []
            with uncollected():
                for value in batch.column(1):
                    joined = own.encode_text(value.as_py() or "")
                    ids = joined.split(",") if joined else []
                    digest = hashlib.sha256()
                    for part in own.decode_stream(ids):
                        digest.update(part)
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                    back_sha.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_decode(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; null is the empty text.

    Each match of the pattern is encoded separately and no special tokens
    apply. Rows are independent: repeated ids give repeated rows, null ids
    stay null, other columns are not read. Texts of any length are taken
    whole; memory follows the longest one.
    """
    bounded(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_coded(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
