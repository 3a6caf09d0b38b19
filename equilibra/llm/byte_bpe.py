"""Byte-level BPE encoding and decoding.

Bytes are written as Latin-1 characters, so the vocabulary becomes one
Aho-Corasick automaton over strings.  A piece (one match of the split pattern)
is encoded by backtracking over longest matches: at each position take the
longest token that may follow the previous one; where none may, mark the
position dead, drop the previous token and try its next shorter prefix.  Two
adjacent tokens are compatible if plain merging of their joined bytes gives
back exactly these two; a sequence whose neighbours are all compatible is the
merge result.  Compatibility is memoised per pair and each position is marked
dead at most once, so a piece costs linear time whatever its length.

A task holds the automaton, the memo and a piece cache, the last two bounded
and refilled when full.  Ids are stored packed as little-endian unsigned
32-bit integers.  Encoding and decoding are one pass each without a shuffle.

Defined results: null or empty text gives no id (empty binary); repeated rows
encode alike; pieces of any length are encoded whole; other columns pass
through untouched.
"""

from __future__ import annotations

import base64
import sys
from array import array

import ahocorasick
import regex
from pyspark.sql import DataFrame

from equilibra.llm.common import add_columns, once

MEMO = 250_000      # remembered neighbour pairs, per generation
PIECES = 100_000    # remembered pieces, per generation
LONG = 64           # longer pieces are not remembered


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 token and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(data: bytes, ranks: dict[bytes, int], below: int = 1 << 62) -> list[bytes]:
    """Plain merging, lowest rank first, leftmost on ties; only ranks under ``below``."""
    parts = [data[i:i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = below, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1], below)
            if r < best:
                best, at = r, i
        if at < 0:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


def pack(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def unpack(data: bytes) -> list[int]:
    a = array("I")
    a.frombytes(data)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tolist()


class Memo:
    """A bounded memory of two generations: what is asked for again survives, the rest goes when both are full."""

    def __init__(self, most: int):
        self._most, self.young, self._old = most, {}, {}

    def recall(self, key):
        """The value of a key that is not in ``young``, or None."""
        got = self._old.get(key)
        return None if got is None else self.keep(key, got)

    def keep(self, key, value):
        if len(self.young) >= self._most:
            self._old, self.young = self.young, {}
        self.young[key] = value
        return value


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self._ranks = ranks
        self._split = regex.compile(pattern)
        self._bytes = {r: b for b, r in ranks.items()}
        self._size = [len(self._bytes.get(r, b"")) for r in range(max(ranks.values()) + 1)]
        self._auto = ahocorasick.Automaton()
        reachable = set()
        for b, r in ranks.items():
            # a token that merging never yields can only stand for a whole piece
            if len(b) == 1 or len(merge(b, ranks, r)) == 2:
                reachable.add(b)
                self._auto.add_word(b.decode("latin-1"), r)
        self._auto.make_automaton()
        self._shorter = {}
        for b in reachable:
            self._shorter[ranks[b]] = next((ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in reachable), -1)
        self._fits = Memo(MEMO)
        self._pieces = Memo(PIECES)

    def _compatible(self, left: int, right: int) -> bool:
        key = (left << 32) | right
        known = self._fits.recall(key)
        if known is None:
            a, b = self._bytes[left], self._bytes[right]
            # a pair that is a token itself would be merged further
            known = self._fits.keep(key, a + b not in self._ranks and merge(a + b, self._ranks) == [a, b])
        return known

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self._ranks.get(data)
        if whole is not None:
            return [whole]
        n, size, shorter, fits = len(data), self._size, self._shorter, self._fits
        longest = [-1] * (n + 1)
        for end, rank in self._auto.iter(data.decode("latin-1")):
            longest[end + 1 - size[rank]] = rank  # later ends are longer
        dead, out, pos, last = bytearray(n + 1), [], 0, -1
        token = longest[0]
        while pos < n:
            while token >= 0:
                end = pos + size[token]
                if not dead[end]:
                    if last < 0:
                        break
                    fit = fits.young.get(last << 32 | token)
                    if self._compatible(last, token) if fit is None else fit:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                last, pos, token = token, end, longest[end]
            elif not out:
                raise ValueError("the vocabulary lacks a byte of the text")
            else:
                dead[pos] = 1
                token = out.pop()
                pos -= size[token]
                last, token = out[-1] if out else -1, shorter[token]
        return out

    def encode(self, text: str | None) -> bytes:
        """Packed ids of a whole text, each match of the split pattern on its own."""
        known, out = self._pieces, []
        for piece in self._split.findall(text or ""):
            got = known.young.get(piece)
            if got is None:
                got = known.recall(piece)
            if got is None:
                got = pack(self.encode_piece(piece.encode("utf-8")))
                if len(piece) <= LONG:
                    known.keep(piece, got)
            out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes that packed ids stand for."""
        return b"".join(map(self._bytes.__getitem__, unpack(ids or b"")))


def _codec(path: str, pattern: str) -> Codec:
    return once("byte_bpe", (path, pattern), lambda: Codec(load_ranks(path), pattern))


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Append the packed ids of every whole text.  ``path`` names the rank file on every node."""
    return add_columns(df, text_col, f"`{out}` binary", lambda texts: [[_codec(path, pattern).encode(t) for t in texts]])


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Append the bytes that each row's packed ids decode to."""
    return add_columns(df, ids_col, f"`{out}` binary", lambda rows: [[_codec(path, pattern).decode(b) for b in rows]])


def round_trip(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_out: str = "ids",
               decoded_out: str = "decoded") -> DataFrame:
    """``encode``, then ``decode`` of its ids, in one Python worker instead of two."""

    def run(texts: list) -> list[list[bytes]]:
        codec = _codec(path, pattern)
        ids = [codec.encode(t) for t in texts]
        return [ids, [codec.decode(b) for b in ids]]

    return add_columns(df, text_col, f"`{ids_out}` binary, `{decoded_out}` binary", run)
