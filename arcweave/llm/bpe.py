"""Encoding a corpus with a public byte-level BPE vocabulary.

A text is cut into pieces by the vocabulary's public pattern; the distinct
pieces of a worker are encoded once and kept. A piece is encoded in linear
time, without replaying its merges: its UTF-8 bytes are mapped to Latin-1, an
Aho-Corasick automaton over all tokens gives the longest token at each byte,
and a walk takes longest tokens first and backtracks to a token's next shorter
prefix wherever a token can't stand beside its left neighbour. Two tokens can
stand side by side exactly if merging their joined bytes gives these two again;
that is answered from the tokens' merge trees and memoised. The only cut of a
piece in which all neighbours are compatible is the one that the merges give.

Only ``map`` work: no shuffle. The vocabulary (a public file of fixed size) is
read by the driver and broadcast in packed form.

Defined cases: null and empty texts give an empty list; strings that look like
special tokens are ordinary text; blanks and invisible characters are encoded
as they are; a text is never cut; rows are independent, so ties and repeated
rows need no rule, and other columns are ignored.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: fixed values: the public pre-tokenization pattern of this vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Vocabulary files above this are refused: what is broadcast stays small.
MAX_VOCABULARY_BYTES = 32 << 20
#: Pieces whose ids a worker keeps before it starts over.
KEPT_PIECES = 200_000
_NEVER = 1 << 62


def default_path() -> str:
    """Where the environment keeps byte_bpe_50k as ranks."""
    try:
        import public_tokenizers

        return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    except (ImportError, AttributeError):
        return "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ids."""
    data = Path(path).read_bytes()
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} holds {len(data)} bytes; at most {MAX_VOCABULARY_BYTES} are broadcast")
    pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in data.splitlines() if line))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must run from 0 without gaps")
    return [t for _, t in pairs]


class Encoder:
    """Encodes pieces with the tokens given in the order of their ids."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        ids = {t: i for i, t in enumerate(tokens)}
        self.length = [len(t) for t in tokens]
        self.born = [i if len(t) > 1 else -1 for i, t in enumerate(tokens)]
        self.left, self.right, self.shorter = list(range(len(tokens))), list(range(len(tokens))), [-1] * len(tokens)
        self.merged: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
            for k in range(len(t) - 1, 0, -1):
                if (p := ids.get(t[:k])) is not None:
                    self.shorter[i] = p
                    break
            if len(t) > 1:
                self.left[i], self.right[i] = self._last_merge(t, i, ids)
                self.merged[self.left[i], self.right[i]] = i
        self.automaton.make_automaton()
        self.known: dict[tuple[int, int], bool] = {}

    @staticmethod
    def _last_merge(token: bytes, rank: int, ids: dict[bytes, int]) -> tuple[int, int]:
        """The two parts from which a token is merged."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            at, best = -1, rank
            for i in range(len(parts) - 1):
                r = ids.get(parts[i] + parts[i + 1], rank)
                if r < best:
                    at, best = i, r
            if at < 0:
                raise ValueError(f"token {rank} can't be made by merges")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return ids[parts[0]], ids[parts[1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges of a's and b's joined bytes give a and b again.

        Walk back in time from the two whole tokens over the pieces that touch
        their border. A piece lives from its own merge (its id is its time) to
        its parent's; if the two pieces at the border could merge while both
        live, the border would vanish. Among merges of one rank the leftmost
        comes first.
        """
        key = (a, b)
        if (seen := self.known.get(key)) is not None:
            return seen
        born, merged = self.born, self.merged
        x, x_ends, y, y_ends, fine = a, _NEVER, b, _NEVER, True
        while True:
            m = merged.get((x, y))
            if m is not None and m < x_ends and m <= y_ends:
                fine = False
                break
            if born[x] < 0 and born[y] < 0:
                break
            if born[x] > born[y]:
                x, x_ends = self.right[x], x
            else:
                y, y_ends = self.left[y], y
        if len(self.known) > 2_000_000:
            self.known.clear()
        self.known[key] = fine
        return fine

    def piece(self, text: str) -> list[int]:
        """The ids of one piece."""
        data = text.encode("utf-8").decode("latin-1")
        n, length, shorter, compatible = len(data), self.length, self.shorter, self.compatible
        longest = [-1] * n
        for end, token in self.automaton.iter(data):  # ends ascend, so the last token at a start is the longest
            longest[end + 1 - length[token]] = token
        open_end = bytearray(b"\1") * (n + 1)  # places from which the rest may still be encoded
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            if token < 0:  # nothing fits here: take back the token before
                open_end[at] = 0
                token = out.pop()
                at -= length[token]
                token = shorter[token]
                continue
            end = at + length[token]
            if open_end[end] and (not out or compatible(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
            else:
                token = shorter[token]


class _Pieces(dict):
    """Packed ids by piece; what is missing is encoded."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        packed = array("i", self.encoder.piece(piece)).tobytes()
        if len(piece) <= 64:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = packed
        return packed


_loaded: dict[str, _Pieces] = {}


def _pieces(name: str, tokens: list[bytes]) -> _Pieces:
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = _Pieces(Encoder(tokens))
    return _loaded[name]


def encode(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``key`` (bigint) and ``ids array<int>`` of each row's ``text``."""
    path = path or default_path()
    shipped = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, find = _pieces(path, shipped.value), regex.compile(PATTERN).findall
        get = pieces.__getitem__
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                packed = [b"".join(map(get, find(t))) if t else b"" for t in part.column(1).to_pylist()]
                ends = np.zeros(len(packed) + 1, np.int32)
                np.cumsum([len(p) // 4 for p in packed], out=ends[1:])
                flat = pa.array(np.frombuffer(b"".join(packed), np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], names=[key, "ids"])

    return df.select(df[key].cast("long").alias(key), df[text].cast("string").alias("text")).mapInArrow(run, f"`{key}` bigint, ids array<int>")
