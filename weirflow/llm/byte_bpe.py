"""Byte-level BPE: texts to token ids and back, with the merges of a rank file, in time linear in the text.

A rank file gives each token's bytes and rank; merging always takes the adjacent pair whose bytes have the least rank, the
leftmost first. Merges aren't replayed here. Each token of two bytes and more has one last merge, by which it comes about; two
tokens may stand beside each other in a merged text if undoing their merges, the latest first, never meets a pair at the
boundary that would have merged earlier. That answer depends on the two tokens alone and is remembered. The text of a piece is
then covered from the left: an Aho-Corasick automaton over all tokens (bytes stand as Latin-1 characters) gives the longest
token at a place; where it can't follow its predecessor, the next shorter token that begins it is tried; where none can, the
predecessor goes and the place is closed for good. A place is closed once, so the work is linear in the piece.

Pieces are the matches of a pattern, each encoded by itself; a piece that is a token as a whole is that token, as the tiktoken
library has it. Texts stay in their rows: no shuffle, and each task reads its rows in Arrow batches.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A rank file goes to every executor, so its size is checked.
MOST_FILE_BYTES = 64 << 20
#: What a worker remembers: pieces of this length at most, twice so many of them, and so many pairs of tokens.
LONGEST_REMEMBERED, MOST_PIECES, MOST_PAIRS = 64, 1 << 17, 1 << 18
#: Ids that are turned into bytes in one go.
DECODED_AT_ONCE = 1 << 18
#: A walk of the automaton covers this many times the longest token, and is begun anew beyond it.
WALK = 4


class _Pieces(dict):
    """Ids of pieces, packed in four bytes each; what isn't there is encoded and, if it isn't long, kept.

    When there are MOST_PIECES, they become the older ones, which are asked before a piece is encoded, and new ones are gathered.
    """

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("i", self.encode(piece)).tobytes()
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= MOST_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Vocabulary:
    """Tokens by rank, ready to encode. `ranks` must hold all 256 bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the ranks must hold every byte")
        self.ranks, self.names = ranks, {rank: name for name, rank in ranks.items()}
        if len(self.names) != len(ranks) or min(self.names) < 0:
            raise ValueError("ranks must be distinct and not negative")
        self.width = max(self.names) + 1
        self.pairs: dict[int, int] = {}  # two tokens' key to what they merge to
        self.made = {rank: -1 if len(name) == 1 else rank for rank, name in self.names.items()}  # when a token comes about
        self.halves: dict[int, tuple[int, int]] = {}
        self.follows: dict[int, bool] = {}
        shorter: dict[int, int] = {}  # the longest token that begins one
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for rank in sorted(self.names):
            self._learn(rank, self.names[rank])
        for rank, name in self.names.items():
            if len(name) == 1 or rank in self.halves:
                shorter[rank] = next((r for n in range(len(name) - 1, 0, -1) if (r := self._reached(name[:n])) is not None), -1)
                self.automaton.add_word(name.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.longest = max(map(len, ranks))
        self.sizes = [len(self.names.get(rank, b"")) for rank in range(self.width)]
        self.shorter = [shorter.get(rank, -1) for rank in range(self.width)]
        self.split = regex.compile(pattern).findall
        self.pieces = _Pieces(self._piece)

    def _reached(self, name: bytes) -> int | None:
        """The rank of a token that merging can arrive at."""
        rank = self.ranks.get(name)
        return rank if rank is not None and (len(name) == 1 or rank in self.halves) else None

    def _learn(self, rank: int, name: bytes) -> None:
        """A token's last merge, out of tokens that were there before it. One without any never comes about by merging."""
        for n in range(len(name) - 1, 0, -1):
            a, b = self._reached(name[:n]), self._reached(name[n:])
            if a is not None and b is not None and max(self.made[a], self.made[b]) < rank and self._adjacent(a, b):
                self.halves[rank] = (a, b)
                self.pairs[a * self.width + b] = rank
                return

    def _adjacent(self, a: int, b: int) -> bool:
        """Whether merging leaves a and b side by side: undo their merges, the later one first (of equal ones the right one, as
        merging goes from the left), and see that no pair at the boundary would have merged while it was there."""
        until = self.width
        while True:
            merged = self.pairs.get(a * self.width + b)
            if merged is not None and merged < until:
                return False
            if self.made[a] > self.made[b]:
                until, a = a, self.halves[a][1]
            elif self.made[b] >= 0:
                until, b = b + 1, self.halves[b][0]
            else:
                return True

    def _piece(self, piece: str) -> list[int]:
        name = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(name)
        return [whole] if whole is not None else self.cover(name)

    def cover(self, name: bytes) -> list[int]:
        """The tokens that merging would leave of these bytes."""
        text, size, width, most = name.decode("latin-1"), len(name), self.width, self.longest
        sizes, shorter, follows = self.sizes, self.shorter, self.follows
        ids: list[int] = []
        closed: set[int] = set()
        at, walk, known = 0, None, 0
        while at < size:
            if walk is None or known < size and at + most > known:  # the slice, as a walk copies what it is given
                known = at + WALK * most
                walk = self.automaton.iter_long(text[at:known])
            token = next(walk)[1]
            while True:
                end = at + sizes[token]
                if end not in closed:
                    if not ids:
                        break
                    key = ids[-1] * width + token
                    fits = follows.get(key)
                    if fits is None:
                        if len(follows) >= MOST_PAIRS:
                            follows.clear()
                        fits = follows[key] = self._adjacent(ids[-1], token)
                    if fits:
                        break
                walk = None  # off the walk of longest tokens
                token = shorter[token]
                while token < 0:  # nothing may stand here
                    closed.add(at)
                    token = ids.pop()
                    at -= sizes[token]
                    token = shorter[token]
            ids.append(token)
            at = end
        return ids

    def packed(self, text: str) -> bytes:
        """The ids of a text, four bytes each."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "int32").tolist()


class Names:
    """The bytes of tokens by rank, ready to decode."""

    def __init__(self, ranks: dict[bytes, int]):
        names = {rank: name for name, rank in ranks.items()}
        self.table = pa.array([names.get(rank) for rank in range(max(names) + 1)], pa.large_binary())

    def decode(self, lists: pa.ListArray, at_once: int = DECODED_AT_ONCE) -> pa.Array:
        """The bytes of each list of ids, some lists with about so many ids at once."""
        bounds, at = lists.offsets.to_numpy(), 0
        data, ends = bytearray(), np.zeros(len(lists) + 1, "int32")
        while at < len(lists):
            rows = max(1, int(np.searchsorted(bounds, bounds[at] + at_once)) - at)
            part, own = self._decode(lists.slice(at, rows))
            ends[at + 1 : at + rows + 1] = own[1:] + len(data)
            data += part
            at += rows
        present = pa.py_buffer(np.packbits(lists.is_valid().to_numpy(zero_copy_only=False), bitorder="little").tobytes())
        return pa.Array.from_buffers(pa.binary(), len(lists), [present, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])

    def _decode(self, lists: pa.ListArray) -> tuple[memoryview, np.ndarray]:
        """(bytes, where each list's begin and end): tokens' bytes are taken from the table, and lie one after the other as they should."""
        ids, bounds = lists.values, lists.offsets.to_numpy()
        ids = ids.slice(bounds[0], bounds[-1] - bounds[0])
        number = ids.fill_null(0).to_numpy(zero_copy_only=False)
        if len(number) and (number.min() < 0 or number.max() >= len(self.table)):
            raise ValueError("no token has such an id")
        found = self.table.take(ids)
        if found.null_count > ids.null_count:
            raise ValueError("no token has such an id")
        _, at, data = found.buffers()
        at = np.frombuffer(at, "int64")[found.offset : found.offset + len(found) + 1] if len(found) else np.zeros(1, "int64")
        whole = memoryview(b"" if data is None else data)[int(at[0]) : int(at[-1])]
        return whole, at[bounds - bounds[0]] - at[0]


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks by token of a file with one `base64 rank` a line."""
    return {base64.b64decode(name): int(rank) for name, rank in (line.split() for line in content.splitlines() if line.strip())}


_BUILT: dict[tuple, Vocabulary | Names] = {}


def _built(kind: type, content: bytes, *more: str) -> Vocabulary | Names:
    """Built once in each worker, which then serves many tasks."""
    key = (kind, hashlib.sha256(content).hexdigest(), *more)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = kind(read_ranks(content), *more)
    return _BUILT[key]


def _content(ranks_path: str) -> bytes:
    content = Path(ranks_path).read_bytes()
    if len(content) > MOST_FILE_BYTES:
        raise ValueError(f"a rank file has {MOST_FILE_BYTES} bytes at most")
    return content


def token_ids(text: Column, ranks_path: str, pattern: str) -> Column:
    """The token ids of a text, array<int>, never null: of null and empty texts the empty list.

    Bytes that aren't UTF-8 count as U+FFFD. Texts of any length are read whole; long ones are encoded piece by piece.
    """
    content = _content(ranks_path)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = _built(Vocabulary, content, pattern)
        for batch in texts:
            ids, ends = bytearray(), [0]
            for text in batch:
                if text.is_valid:
                    ids += vocabulary.packed(text.as_py().decode("utf-8", "replace"))
                ends.append(len(ids) // 4)
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), len(ids) // 4, [None, pa.py_buffer(ids)]))

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<int>")(text.cast("string").cast("binary"))


def token_bytes(ids: Column, ranks_path: str) -> Column:
    """The bytes that token ids stand for, binary; null for a null list. Null ids in a list stand for nothing.

    An id that no token has raises, as a corpus that was encoded by other ranks would else decode to another text.
    """
    content = _content(ranks_path)

    def run(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = _built(Names, content)
        for batch in lists:
            yield names.decode(batch)

    run.__annotations__ = {"lists": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "binary")(ids)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", to: str = "ids") -> DataFrame:
    """docs with the token ids of a text column in a further column; a column of that name is replaced, others stay.

    Null and empty texts have no tokens; repeated rows are encoded each by itself; an empty table stays empty.
    """
    return docs.withColumn(to, token_ids(F.col(f"`{text_col}`"), ranks_path, pattern))


def decode(tokens: DataFrame, ranks_path: str, ids_col: str = "ids", to: str = "bytes") -> DataFrame:
    """tokens with the bytes of a column of ids in a further column; a column of that name is replaced, others stay.

    A null list gives null, an empty one no bytes; bytes are not checked to be UTF-8, as a list may begin or end within a character.
    """
    return tokens.withColumn(to, token_bytes(F.col(f"`{ids_col}`"), ranks_path))


def report(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row per document, repeats too: doc_id, n_tokens, ids_sha256 (of the decimal ids), decoded_sha256 (of what they decode to).

    A null text counts as empty: no tokens, and twice the digest of nothing. Null ids stay null. An empty table gives no rows.
    """
    tokens = encode(docs.select("doc_id", "text"), ranks_path, pattern).select("doc_id", "ids")
    both = decode(tokens, ranks_path)
    return both.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2(F.col("bytes"), 256).alias("decoded_sha256"),
    )
