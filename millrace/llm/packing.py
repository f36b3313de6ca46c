"""Cost-balanced sequence packing [operator 1].

A piece of n tokens costs linear * n + quadratic * n * n.  Documents are packed
in groups of about ``group_tokens`` tokens, as a task reads them, so nothing is
shuffled and a task holds one group at a time.  A group gets as many sequences of
``capacity`` as its tokens fill, and for what is left over sequences whose sizes
are powers of two, which need no padding.  Pieces are taken by descending cost;
each goes to the cheapest sequence that has room for it.  Where none has, the
cheapest one that has any room takes what fits and the rest waits its turn.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from millrace.llm.chunks import worker_table
from millrace.llm.common import slices, texts

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long, sequence_cost double"


def sequence_sizes(total: int, capacity: int) -> list[int]:
    """Sizes that add up to ``total``: full sequences, then the binary digits of the rest."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], list[int], list[float]]:
    """Place documents of these lengths.

    Returns the pieces as (document, start, length, sequence, offset), the sizes of
    the sequences, all of them full, and their costs.  Ties go to the document and
    sequence that come first.
    """
    sizes = sequence_sizes(sum(lengths), capacity)
    room, cost = sizes.copy(), [0.0] * len(sizes)
    open_by_room: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    cheapest = np.full(capacity + 1, np.inf)
    for s, size in enumerate(sizes):
        open_by_room[size].append((0.0, s))
        cheapest[size] = 0.0
    waiting = [(-min(n - at, capacity), d, at) for d, n in enumerate(lengths) for at in range(0, n, capacity)]
    heapq.heapify(waiting)
    pieces = []
    while waiting:
        length, d, at = heapq.heappop(waiting)
        length = -length
        r = length + int(np.argmin(cheapest[length:]))
        if cheapest[r] == np.inf:
            r = 1 + int(np.argmin(cheapest[1:]))
        _, s = heapq.heappop(open_by_room[r])
        cheapest[r] = open_by_room[r][0][0] if open_by_room[r] else np.inf
        put = min(length, r)
        pieces.append((d, at, put, s, sizes[s] - room[s]))
        room[s] -= put
        cost[s] += linear * put + quadratic * put * put
        if room[s]:
            heapq.heappush(open_by_room[room[s]], (cost[s], s))
            cheapest[room[s]] = open_by_room[room[s]][0][0]
        if put < length:
            heapq.heappush(waiting, (put - length, d, at + put))
    return pieces, sizes, cost


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 1024,
    end_id: int = 0,
    linear: float = 1.0,
    quadratic: float = 1 / 4096,
    group_tokens: int = 1 << 20,
    table_entries: int = 600_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack all documents, each with ``end_id`` behind its ids; a row for each piece (see PIECES).

    tokenizer: path of a tokenizers file.  table_entries: chunks whose ids a worker keeps, in each
    of two generations; fewer take less memory and more time, the result is the same.  ids are little-endian unsigned 32-bit integers.
    A null text counts as empty: its document is the end id alone.  Repeated rows and
    null doc_ids are packed like any other; an empty table gives no piece; a text of
    any length is cut into pieces; other columns are not read.  Sequences are numbered by
    task in the order of its rows: a task that runs again gives the same numbers if it
    reads its rows in the same order, as from files; behind a shuffle, write ``docs`` first.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_table(tokenizer, table_entries).joined
        end = np.array([end_id], "<u4").tobytes()
        following = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        keys: list[int | None] = []
        ids: list[bytes] = []
        held = 0
        for part in slices(batches):
            for key, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                keys.append(key)
                ids.append(encode(text or "") + end)
                held += len(ids[-1]) // 4
                if held >= group_tokens:
                    batch, following = _group(keys, ids, following, capacity, linear, quadratic)
                    yield batch
                    keys, ids, held = [], [], 0
        if keys:
            yield _group(keys, ids, following, capacity, linear, quadratic)[0]

    return texts(docs, id_col, text_col).mapInArrow(run, PIECES)


def _group(keys: list, ids: list[bytes], first: int, capacity: int, linear: float, quadratic: float) -> tuple[pa.RecordBatch, int]:
    lengths = [len(i) // 4 for i in ids]
    pieces, sizes, cost = assign(lengths, capacity, linear, quadratic)
    columns: list[Callable] = [
        lambda d, at, n, s, o: keys[d],
        lambda d, at, n, s, o: at,
        lambda d, at, n, s, o: n,
        lambda d, at, n, s, o: ids[d][4 * at : 4 * (at + n)],
        lambda d, at, n, s, o: lengths[d],
        lambda d, at, n, s, o: first + s,
        lambda d, at, n, s, o: o,
        lambda d, at, n, s, o: sizes[s],
        lambda d, at, n, s, o: cost[s],
    ]
    kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 4 + [pa.float64()]
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([f(*p) for p in pieces], kind) for f, kind in zip(columns, kinds, strict=True)], names), first + len(sizes)
