"""Byte-level BPE encoding and decoding in linear time [operator 7].

Tokens are held as Latin-1 strings, one character a byte, in a pyahocorasick
automaton.  Its matches give the longest token at every position of a piece.
The encoder walks from longest match to longest match; a token may follow
another only if merging the two side by side would have left them apart, which
is worked out from the merge tree and memoised for each pair.  Where no token
fits, it steps back and marks the position as a dead end, so each position is
tried once for each token.  The result is the one that merging by rank gives.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.chunks import ChunkTable, latin_1_pattern
from millrace.llm.common import slices, texts, worker_cache

#: Pairs whose compatibility one worker remembers.
PAIR_MEMO = 200_000


class Vocabulary:
    """Ranks of a byte-level vocabulary with the tree of its merges.

    ranks: bytes -> rank, with every single byte that texts hold; a token made of
    two others has a higher rank than both.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.rank = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.token = dict(zip(self.rank.values(), ranks, strict=True))
        self.size = {rank: len(token) for rank, token in self.token.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.automaton.add_word(token, (len(token), rank))
        self.automaton.make_automaton()
        self.shorter: dict[int, int | None] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.memo: dict[tuple[int, int], bool] = {}
        for token, rank in self.rank.items():
            self.shorter[rank] = next((self.rank[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.rank), None)
        for token, rank in sorted(self.rank.items(), key=lambda x: x[1]):
            self.halves[rank] = self._halve(token, rank)
        self.memo.clear()

    def _halve(self, token: str, rank: int) -> tuple[int, int]:
        """The two tokens that the merge of this rank joins; twice itself if it is a leaf."""
        left = self.shorter[rank]
        while left is not None:
            right = self.rank.get(token[len(self.token[left]) :])
            if right is not None and left < rank and right < rank and self._apart(left, right):
                self.merged[left, right] = rank
                return left, right
            left = self.shorter[left]
        return rank, rank

    def _apart(self, a: int, b: int) -> bool:
        """Whether a and b side by side stay two tokens under merging by rank.

        Undo merges along the seam, latest first.  If at some moment the two tokens
        at the seam would have merged before either side's own later merge, they
        wouldn't have stayed apart.
        """
        last = 1 << 62  # the rank of the merge undone last
        while True:
            if self.merged.get((a, b), last) < last:
                return False
            if a > b and self.halves[a][0] != a:
                last, a = a, self.halves[a][1]
            elif self.halves[b][0] != b:
                last, b = b + 1, self.halves[b][0]
            elif self.halves[a][0] != a:
                last, a = a, self.halves[a][1]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        found = self.memo.get((a, b))
        if found is None:
            if len(self.memo) >= PAIR_MEMO:
                self.memo.clear()
            found = self.memo[a, b] = self._apart(a, b)
        return found

    def encode(self, piece: bytes) -> list[int]:
        """ids of one piece."""
        shorter, sizes, compatible = self.shorter, self.size, self.compatible
        text = piece.decode("latin-1")
        if not text:
            return []
        if text in self.rank:
            return [self.rank[text]]
        n = len(text)
        longest: list[int | None] = [None] * n
        size = [0] * n
        for end, (length, rank) in self.automaton.iter(text):
            start = end + 1 - length
            if length > size[start]:
                size[start], longest[start] = length, rank
        if None in longest:
            raise ValueError(f"the vocabulary lacks a byte of {piece!r}")
        out: list[int] = []
        alive = bytearray(b"\1") * (n + 1)
        at, following = 0, longest[0]
        while following is not None:
            now, before = following, out[-1] if out else None
            while True:
                to = at + sizes[now]
                if alive[to] and (before is None or compatible(before, now)):
                    out.append(now)
                    at, following = to, longest[to] if to < n else None
                    break
                if (less := shorter[now]) is not None:
                    now = less
                    continue
                alive[at] = 0
                out.pop()
                at, following = at - sizes[before], before
                break
        return out


def encoder(vocabulary: Vocabulary, pattern: str, limit: int = 400_000) -> ChunkTable:
    """Whole texts -> ids as little-endian unsigned 32-bit integers; each match of the pattern is encoded separately."""
    import regex

    find, encode = regex.compile(pattern).findall, vocabulary.encode
    try:
        plain = re.compile(latin_1_pattern(pattern)).findall
    except re.error:
        plain = find
    pieces: dict[str, bytes] = {}

    def chunk_ids(chunk: str) -> bytes:
        core = chunk[1:] if chunk[:1] in (" ", "\n") else chunk
        simple = core.isprintable() and (core.isascii() or max(core) < "Ā")
        out = []
        for piece in (plain if simple else find)(chunk):
            value = pieces.get(piece)
            if value is None:
                ids = encode(piece.encode())
                value = struct.pack(f"<{len(ids)}I", *ids)
                if len(pieces) >= limit // 2:
                    pieces.clear()
                if len(piece) <= 64:
                    pieces[piece] = value
            out.append(value)
        return b"".join(out)

    return ChunkTable(chunk_ids, limit)


def encode_decode(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None,
    schema: str = "doc_id long, ids binary, decoded binary",
) -> DataFrame:
    """(doc_id, ids binary, decoded binary) for every row; ids are little-endian unsigned 32-bit integers.

    then: makes something else of each batch where it arises, such as ``digests``; ``schema`` describes that.

    A null text counts as empty and has no ids; repeated rows and null doc_ids are
    kept as they are; an empty table gives an empty one; texts of any length are encoded
    whole; other columns are not read.
    The vocabulary is broadcast: its size is that of the vocabulary file.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(ranks))
    key = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, token = worker_cache(f"bpe {key}", lambda: encoder(shared.value, pattern)), shared.value.token.__getitem__
        for part in slices(batches):
            ids = [table.joined(t or "") for t in part.column("text").to_pylist()]
            decoded = [b"".join(map(token, np.frombuffer(i, "<u4").tolist())) for i in ids]
            batch = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])
            yield then(batch) if then else batch

    return texts(docs, id_col, text_col).mapInArrow(run, schema)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Digest columns of a batch of encode_decode() (see DIGESTS)."""
    counts, ids_hash, text_hash, names = [], [], [], {}
    for ids, decoded in zip(batch.column("ids").to_pylist(), batch.column("decoded").to_pylist(), strict=True):
        numbers = np.frombuffer(ids, "<u4").tolist()
        names.update((n, str(n)) for n in set(numbers).difference(names))
        counts.append(len(numbers))
        ids_hash.append(hashlib.sha256(" ".join(map(names.__getitem__, numbers)).encode()).hexdigest())
        text_hash.append(hashlib.sha256(decoded).hexdigest())
    columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file."""
    import base64

    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
