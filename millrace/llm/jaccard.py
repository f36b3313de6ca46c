"""Exact n-gram Jaccard join by PartEnum signatures [operator 10].

Documents are sets of word shingles.  Two sets A and B of Jaccard similarity of at
least num/den differ in at most (|A| + |B|) * (den - num) / (den + num) shingles.
Sizes fall into bands that double.  For each band the domain of shingle hashes is cut
into m equal parts; a difference spoils one part, so of the parts that A fills at
least need(A) = filled(A) - (most differences with any partner in the band) are equal
in B.  A set emits one signature for each filled part, in its own band and, if larger
partners reach into it, in the next one.  (A set with need below 1 emits signatures for
its empty parts as well; two such sets share at least one.)

A signature that more than ``hot`` sets share isn't expanded.  A set with h hot
signatures and h < need still meets each of its partners in a colder one, often
need - h times, so pairs that meet less often are dropped.  What remains are the sets
with h >= need: members of large groups of near copies.  Each hot signature has a head,
the set that shares most signatures with others.  A set keeps those of its heads that have
most of its hot signatures, until what it drops is less than a quarter of its need, and is
compared with them; since a pair has need signatures in common, it keeps a head in common.
The heads of one component then stand for one another: all sets under any of them are compared
with one, so a set counts once for each component, however many heads its signatures have there.
Take two sets x and y that link with each other and share a signature under the heads that b
stands for, and let x lie outside b's component.  With D(x) the difference of x and b, |x ^ y| = |D(x) ^ D(y)|,
so x and y must share elements of their differences: at least half of what |D(x)| is beyond
a link with b, at least |D(x)| less the most differences of x with any partner, and of
x's elements outside b at least num/den * |x| - |x & b|.  Differences of independent edits
hardly meet, so an index of their elements finds the partners, unless elements that more
than ``hot`` sets share could make up all that is needed.  If x and y must share elements
outside b, x asks for those alone.  Of what is found, sizes, differences and parity sketches
leave the pairs that can be similar enough.  One component of those whose heads a pair
has in common suffices, so this matters only where it holds, with the dropped ones, for at least
half of the need of x; those sets are compared with all under such heads whose differences have
a possible size and parity sketch.

A signature that more than ``hot`` sets share within what a task has gathered is hot without
more ado: its holders are dealt by set, not by signature, and its bucket only gets word of it.  So no
bucket has to take in a group of near copies that makes up a third of all rows.

Only sets that differ are joined: documents with equal sets share an entity.  An entity is
named by 63 bits of a 128-bit xxHash of the set, and documents of one name whose other 63 bits
differ are split into entities of their own.  Links are verified on the full sets.
Components come from hashed-minimum label propagation over tables in the shared folder.
Words and shingles are told apart by 64-bit hashes (xxh3 of the word's bytes).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import discard, shared_dir, slices, texts, worker_cache, written

#: Signatures that a task gathers before it hands them on.
FLUSH = 500_000
#: Sets that a task remembers to hand each on once.
KNOWN = 1_000_000
_LEVEL_BITS = 5
#: Bits of a signature, its level included.  A chance collision only makes a candidate more.
SIGNATURE_BITS = 48
#: A larger need is handed on as this, which only keeps candidates more.
MOST_NEED = (1 << 15) - 1
PARITY_WORDS = 16
_PARITY = [f"p{k}" for k in range(PARITY_WORDS)]

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if 0x09 <= b <= 0x0D else b for b in range(256))
#: Distinct words whose hashes a worker keeps.
WORDS = 200_000
#: Bytes of text whose signatures go to a bucket, for inputs of less than MANY buckets and beyond.
BUCKET_BYTES, LARGE_BUCKET_BYTES, MANY = 16 << 20, 256 << 20, 20_000


class _Words(dict):
    """Word -> its hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = found
        return found


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(batch: list[str], n: int = 5) -> list[np.ndarray]:
    """The sorted shingle hashes of each text; one for the whole text if it has fewer than n words, none if it has no word."""
    out, part, size = [], [], 0
    for text in batch:
        raw = text.encode().translate(_FOLD)
        if part and size + len(raw) > 1 << 20:
            out += _sets(part, n)
            part, size = [], 0
        part.append(raw)
        size += len(raw) + 1
    return out + (_sets(part, n) if part else [])


def _joined(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n neighbours."""
    whole = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        whole = (whole ^ (whole >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + len(whole)]
    return mix(whole + np.uint64(n))


def _sets(raws: list[bytes], n: int) -> list[np.ndarray]:
    hash_of, words, cut = worker_cache("jaccard", _Words).__getitem__, [], [0]
    for raw in raws:
        words += map(hash_of, raw.split())
        cut.append(len(words))
    hashes = np.array(words, np.uint64)
    whole, out = _joined(hashes, n), []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        out.append(np.unique(whole[a : b - n + 1]) if b - a >= n else _joined(hashes[a:b], b - a) if b > a else np.empty(0, np.uint64))
    return out


def identity(found: np.ndarray) -> tuple[int, int]:
    """A set's entity and what tells it from others of the same name, 63 bits each."""
    digest = xxhash.xxh3_128_intdigest(found.tobytes())
    return digest >> 65, digest & (1 << 63) - 1


def parts_of(level: int) -> int:
    """Parts of the band of sizes below 2**level: enough that parts a typical set fills outnumber its differences well."""
    most = (1 << level) - 1
    return most * 2 if level <= 4 else most if level == 5 else (most + 1) // 2 if level <= 7 else most * 2 // 5


def signatures(found: np.ndarray, num: int, den: int) -> list[tuple[int, int, np.ndarray]]:
    """(level, need, signatures) for each band in which the set can have a partner other than itself."""
    size = len(found)
    largest = size * den // num
    out = []
    for level in {size.bit_length(), largest.bit_length()}:
        partner = min((1 << level) - 1, largest)
        if (size + partner) * (den - num) < den + num:
            continue  # no room for any difference
        m = parts_of(level)
        part = ((found >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sums = np.add.reduceat(mix(found), first)
        own = sums + (part[first] + 1).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        need = len(first) - (size + partner) * (den - num) // (den + num)
        if need < 1:
            empty = np.setdiff1d(np.arange(m), part[first])
            own = np.concatenate([own, (empty + 1).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)])
            need = 1
        own = mix(own + np.uint64(level * 0x8EBC6AF09C88C6E3 & (1 << 64) - 1))
        out.append((level, need, own >> np.uint64(64 - SIGNATURE_BITS + _LEVEL_BITS) << np.uint64(_LEVEL_BITS) | np.uint64(level)))
    return out


def packed(values: np.ndarray) -> bytes:
    """Signatures in six bytes each."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : SIGNATURE_BITS // 8]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) * 8 // SIGNATURE_BITS, 8), np.uint8)
    out[:, : SIGNATURE_BITS // 8] = np.frombuffer(data, np.uint8).reshape(len(out), SIGNATURE_BITS // 8)
    return out.reshape(-1).view("<u8").astype(np.uint64)


# --- one pass over the texts: documents and signatures, dealt into buckets ---------------------------------

#: role 0: documents, their entities, sizes (as marks) and checks (as counts).  1: sets and their signatures.
#: 2: the same for signatures known to be hot, dealt by set.  3: signatures of this bucket that are hot elsewhere.
_DEALT = "bucket int, role int, docs binary, entities binary, marks binary, counts binary, signatures binary"
_DEALT_TYPES = pa.schema([("bucket", pa.int32()), ("role", pa.int32()), *[(c, pa.binary()) for c in ("docs", "entities", "marks", "counts", "signatures")]])


class _Gathered:
    """What a task has gathered: documents as they are, each distinct set once."""

    def __init__(self, buckets: int, num: int, den: int, hot: int):
        self.buckets, self.num, self.den, self.hot = buckets, num, den, hot
        self.turn = TaskContext.get().partitionId() if TaskContext.get() else 0
        self.known: set[tuple[int, int]] = set()
        self.clear()

    def clear(self) -> None:
        self.docs, self.held = [], 0
        self.entities, self.marks, self.counts, self.parts = [], [], [], []

    def add(self, doc_id: int, found: np.ndarray) -> None:
        e, check = identity(found) if len(found) else (-1, 0)
        self.docs.append((doc_id, e, len(found), check))
        if (e, check) in self.known or not len(found):
            return
        if len(self.known) >= KNOWN:
            self.known.clear()
        self.known.add((e, check))
        for level, need, own in signatures(found, self.num, self.den):
            self.entities.append(e)
            self.marks.append(min(need, MOST_NEED) << 1 | (level == len(found).bit_length()))
            self.counts.append(len(own))
            self.parts.append(own)
            self.held += len(own)

    def bucket_of(self, signatures: np.ndarray) -> np.ndarray:
        return ((signatures >> np.uint64(SIGNATURE_BITS - 32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)

    def batches(self) -> Iterator[pa.RecordBatch]:
        """Rows of documents, sets and signatures for the buckets; see the roles above."""
        self.turn = (self.turn + 1) % self.buckets
        d = np.array(self.docs, np.int64).reshape(-1, 4)
        rows = [(self.turn, 0, *(np.ascontiguousarray(d[:, k]).tobytes() for k in range(4)), b"")]
        if self.parts:
            every = np.concatenate(self.parts)
            of = np.repeat(np.arange(len(self.counts)), self.counts)
            ordered = np.sort(every)
            far = ordered[self.hot :] == ordered[: len(ordered) - self.hot]
            hot = np.unique(ordered[self.hot :][far])
            is_hot = among(hot, every)
            of_hot = (mix(np.array(self.entities, np.uint64)) % np.uint64(self.buckets)).astype(np.int64)[of[is_hot]]
            rows += self._rows(1, self.bucket_of(every[~is_hot]), every[~is_hot], of[~is_hot])
            rows += self._rows(2, of_hot, every[is_hot], of[is_hot])
            edges = np.searchsorted(self.bucket_of(hot), np.arange(self.buckets + 1))
            rows += [(b, 3, b"", b"", b"", b"", packed(hot[edges[b] : edges[b + 1]])) for b in range(self.buckets) if edges[b] < edges[b + 1]]
        for k in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[k : k + 64]], f.type) for c, f in enumerate(_DEALT_TYPES)], schema=_DEALT_TYPES)
        self.clear()

    def _rows(self, role: int, bucket: np.ndarray, every: np.ndarray, of: np.ndarray) -> list[tuple]:
        """A row for each bucket, signatures grouped by set."""
        entities, marks = np.array(self.entities, np.int64), np.array(self.marks, np.uint16)
        order = np.argsort(bucket, kind="stable")
        every, of, rows = every[order], of[order], []
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for b in range(self.buckets):
            a, z = edges[b], edges[b + 1]
            if a < z:
                held, counts = np.unique(of[a:z], return_counts=True)
                rows.append((b, role, b"", *(x.tobytes() for x in (entities[held], marks[held], counts.astype(np.uint32))), packed(every[a:z])))
        return rows


def among(some: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Which of ``asked`` are in the sorted ``some``."""
    if not len(some):
        return np.zeros(len(asked), bool)
    return some[np.minimum(np.searchsorted(some, asked), len(some) - 1)] == asked


# --- a bucket: which sets meet in it ------------------------------------------------------------------------

#: kind 0: document x with entity y of size n; need_x: what tells the set from others of that name.  1: sets x and y meet n times in a band; need_x, need_y.
#: 2: set x has n hot signatures in a band; need_x; need_y counts their holders.  3: set y holds hot signature x.
_MET = "kind int, x long, y long, level int, n long, need_x long, need_y long"
_MET_NAMES = [c.split()[0] for c in _MET.split(", ")]


def _met_table(kind: int, x, y, level, n, need_x, need_y) -> pa.Table:
    size = len(x)
    full = lambda v: np.full(size, v, np.int64) if np.isscalar(v) else v.astype(np.int64)
    columns = [full(kind).astype(np.int32), full(x), full(y), full(level).astype(np.int32), full(n), full(need_x), full(need_y)]
    return pa.table([pa.array(c) for c in columns], names=_MET_NAMES)


def meet(signature: np.ndarray, who: np.ndarray, mark: np.ndarray, hot: int, known: np.ndarray | None, share: int = 1) -> list[pa.Table]:
    """Pairs of sets that share signatures, hot counts and hot members.

    known: sorted signatures that are hot whatever comes in; None: all.  One in ``share`` of a signature's
    holders comes in here; their number only ranks the sets that may become heads.
    """
    order = np.lexsort((who, signature))
    signature, who, need, inside = signature[order], who[order], mark[order].astype(np.int64) >> 1, mark[order] & 1 == 1
    again = np.zeros(len(signature), bool)
    again[1:] = (signature[1:] == signature[:-1]) & (who[1:] == who[:-1])
    signature, who, need, inside = signature[~again], who[~again], need[~again], inside[~again]
    first = np.flatnonzero(np.concatenate([[True], signature[1:] != signature[:-1]])) if len(signature) else np.empty(0, np.int64)
    length = np.diff(np.append(first, len(signature)))
    out = []
    left, right = [], []
    hot_here = length > hot if known is None or not len(known) else (length > hot) | among(known, signature[first])
    if known is None:
        hot_here[:] = True
    for g in range(2, hot + 1):
        starts = first[(length == g) & ~hot_here]
        if len(starts):
            i, j = np.triu_indices(g, 1)
            left.append((starts[:, None] + i).ravel())
            right.append((starts[:, None] + j).ravel())
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        level = (signature[a] & np.uint64((1 << _LEVEL_BITS) - 1)).astype(np.int64)
        fit = inside[a] | inside[b]  # the pair belongs to the band of its larger set
        a, b, level = a[fit], b[fit], level[fit]
        names, index = np.unique(who, return_inverse=True)
        key = (index[a] * len(names) + index[b]) * 64 + level
        key, at, counts = np.unique(key, return_index=True, return_counts=True)
        out.append(_met_table(1, who[a[at]], who[b[at]], level[at], counts, need[a[at]], need[b[at]]))
    is_hot = np.repeat(hot_here, length)
    if is_hot.any():
        signature, who, need, holders = signature[is_hot], who[is_hot], need[is_hot], np.repeat(length * share, length)[is_hot]
        level = (signature & np.uint64((1 << _LEVEL_BITS) - 1)).astype(np.int64)
        order = np.lexsort((level, who))
        w, v, d, k = who[order], level[order], need[order], holders[order]
        head = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (v[1:] != v[:-1])]))
        out.append(_met_table(2, w[head], 0, v[head], np.diff(np.append(head, len(w))), d[head], np.add.reduceat(k, head)))
        out.append(_met_table(3, signature.view(np.int64), who, level, 0, 0, need))
    return out


def _bucket(table: pa.Table, hot: int, buckets: int) -> pa.Table:
    of = lambda role: table.filter(pc.equal(table.column("role"), role))
    read = lambda t, c, kind=np.int64: np.frombuffer(b"".join(t.column(c).to_pylist()), kind)
    docs, known = of(0), np.unique(unpacked(b"".join(of(3).column("signatures").to_pylist())))
    out = [_met_table(0, read(docs, "docs"), read(docs, "entities"), 0, read(docs, "marks"), read(docs, "counts"), 0)]
    for role in (1, 2):
        rest = of(role)
        if not rest.num_rows:
            continue
        counts = read(rest, "counts", np.uint32)
        signature = unpacked(b"".join(rest.column("signatures").to_pylist()))
        if role == 1:
            order = np.argsort(signature, kind="stable")
            ordered = signature[order]
            same = ordered[1:] == ordered[:-1]
            chosen = order[np.concatenate([[False], same]) | np.concatenate([same, [False]]) | among(known, ordered)]
        else:
            chosen = np.arange(len(signature))
        row = np.repeat(np.arange(len(counts)), counts)[chosen]
        out += meet(signature[chosen], read(rest, "entities")[row], read(rest, "marks", np.uint16)[row], hot, *((known, 1) if role == 1 else (None, buckets)))
    return pa.concat_tables(out)


# --- the join ------------------------------------------------------------------------------------------------


class Join:
    """The tables of one join, written to a folder as they are made."""

    def __init__(self, docs: DataFrame, num: int, den: int, shingle: int, hot: int):
        self.spark: SparkSession = docs.sparkSession
        self.docs, self.num, self.den, self.shingle, self.hot = docs, num, den, shingle, hot
        self.folder, self.kept = shared_dir(self.spark), []
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        least = min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 2 * self.spark.sparkContext.defaultParallelism)
        self.buckets = max(1, least, min(-(-size // BUCKET_BYTES), MANY), -(-size // LARGE_BUCKET_BYTES))

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.kept.append(name)
        return written(self.spark, df, self.folder, name)

    def discard(self, *needed: str) -> None:
        """Delete the tables that the result isn't read from."""
        discard(self.spark, *(f"{self.folder}/{name}" for name in self.kept if name not in needed))

    def run(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(doc_id, entity, n_shingles), (entity, first): the smallest doc_id of each entity, (entity, component)."""
        met = self.keep(self.meetings(), "met")
        documents = met.where("kind = 0").select(F.col("x").alias("doc_id"), F.col("y").alias("entity"), F.col("need_x").alias("check"), F.col("n").alias("n_shingles"))
        pairs, led = self.candidates(met)
        documents, entities, pairs, led = self.told_apart(documents, pairs, led)
        star = self.keep(led.where("entity <> head").select(F.col("head").alias("a"), F.col("entity").alias("b")).distinct(), "star")
        self.sets = self.keep(self.entity_sets(entities, pairs.union(star)), "sets")
        # first each set with its least candidate, which joins most of a group; then what still lies apart
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        links = self.verified(both.groupBy("a").agg(F.min("b").alias("b")).union(star))
        labels = self.components(links, None, "first")
        labels = self.components(self.verified(self.keep(self.apart(pairs, labels), "apart")), labels, "second")
        grouped = self.keep(self.grouped(star, labels), "grouped")
        if not grouped.isEmpty():
            pairs = self.around(grouped, labels, led)
            labels = self.components(self.verified(self.keep(self.apart(pairs, labels), "across")), labels, "third")
        return documents, entities, labels

    def told_apart(self, documents: DataFrame, pairs: DataFrame, led: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """Documents, (entity, first), pairs and led, after different sets that share a name have got names of their own.

        What holds of a name, its candidates and heads, counts for each of its sets, which only adds comparisons.
        """
        every = documents.where("n_shingles > 0").groupBy("entity").agg(F.min("doc_id").alias("first"), F.min("check").alias("low"), F.max("check").alias("high"))
        every = self.keep(every, "entities")
        shared = every.where("low <> high").select("entity")
        if shared.isEmpty():
            return documents, every.select("entity", "first"), pairs, led
        sets = documents.join(shared, "entity").groupBy("entity", "check").agg(F.min("doc_id").alias("first"))
        own = self.keep(sets.withColumn("own", -F.row_number().over(Window.orderBy("entity", "check"))), "own")  # names below 0, for the few that collide
        documents = self.keep(documents.join(own.drop("first"), ["entity", "check"], "left").withColumn("entity", F.coalesce("own", "entity")).drop("own"), "documents")
        entities = every.where("low = high").select("entity", "first").union(own.select("own", "first"))

        def renamed(df: DataFrame, *names: str) -> DataFrame:
            for name in names:
                df = df.join(own.select(F.col("entity").alias(name), F.col("own").alias("_own").cast("long")), name, "left").withColumn(name, F.coalesce("_own", name)).drop("_own")
            return df

        within = own.alias("x").join(own.alias("y"), "entity").where("x.own < y.own").select(F.col("x.own").cast("long").alias("a"), F.col("y.own").cast("long").alias("b"))
        pairs = renamed(pairs, "a", "b").select("a", "b").union(within)
        return documents, entities, self.keep(pairs, "told-pairs"), self.keep(renamed(led, "entity", "head"), "told-led")

    def meetings(self) -> DataFrame:
        buckets, num, den, n, hot = self.buckets, self.num, self.den, self.shingle, self.hot

        def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gathered = _Gathered(buckets, num, den, hot)
            for part in slices(batches):
                sets = shingle_sets([t or "" for t in part.column("text").to_pylist()], n)
                for doc_id, found in zip(part.column("doc_id").to_pylist(), sets, strict=True):
                    gathered.add(doc_id, found)
                if gathered.held >= FLUSH:
                    yield from gathered.batches()
            yield from gathered.batches()

        dealt = self.docs.mapInArrow(deal, _DEALT)
        return dealt.repartition(2 * buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: _bucket(t, hot, buckets), _MET)

    def candidates(self, met: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Candidate pairs (a, b), and (entity, level, need, head, c, dropped) of the sets that hot signatures may hide.

        c: hot signatures of the set with that head; dropped: those with heads that it doesn't keep.
        """
        hot = met.where("kind = 2").groupBy(F.col("x").alias("entity"), "level")
        hot = self.keep(hot.agg(F.sum("n").alias("h"), F.min("need_x").alias("need"), F.sum("need_y").alias("others")), "hot")
        pairs = met.where("kind = 1").groupBy("x", "y", "level").agg(F.sum("n").alias("n"), F.min("need_x").alias("need_x"), F.min("need_y").alias("need_y"))
        less = lambda name: hot.select(F.col("entity").alias(name), "level", F.col("h").alias(f"h_{name}"))
        pairs = pairs.join(less("x"), ["x", "level"], "left").join(less("y"), ["y", "level"], "left")
        enough = (F.col("n") >= F.col("need_x") - F.coalesce("h_x", F.lit(0))) & (F.col("n") >= F.col("need_y") - F.coalesce("h_y", F.lit(0)))
        pairs = pairs.where(enough).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        heavy = hot.where("h >= need").select("entity", "level", "need", (F.col("others") / F.col("need")).alias("rank"))
        members = met.where("kind = 3").select(F.col("x").alias("signature"), F.col("y").alias("entity"), "level")
        members = self.keep(members.join(heavy, ["entity", "level"]), "members")
        heads = self.keep(members.groupBy("signature").agg(F.max(F.struct("rank", "entity"))["entity"].alias("head")), "heads")
        of_set = Window.partitionBy("entity", "level")
        before = of_set.orderBy(F.desc("c"), "head").rowsBetween(Window.unboundedPreceding, -1)
        led = members.join(heads, "signature").groupBy("entity", "level", "head").agg(F.count("*").alias("c"), F.min("need").alias("need"))
        led = led.withColumn("h", F.sum("c").over(of_set)).withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
        led = led.where("4 * (h - before) >= need").withColumn("dropped", F.col("h") - F.sum("c").over(of_set))
        return self.keep(pairs, "pairs"), self.keep(led.drop("h", "before"), "led")

    def entity_sets(self, entities: DataFrame, edges: DataFrame) -> DataFrame:
        """(entity, found): the sets of the entities in candidate pairs, from one document of each."""
        n = self.shingle
        wanted = edges.select(F.col("a").alias("entity")).union(edges.select("b")).distinct()
        firsts = self.keep(entities.select("entity", F.col("first").alias("doc_id")).join(wanted, "entity"), "firsts")

        def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                sets = shingle_sets([t or "" for t in part.column("text").to_pylist()], n)
                yield pa.RecordBatch.from_arrays([part.column("entity"), pa.array([s.tobytes() for s in sets], pa.binary())], ["entity", "found"])

        # planned alike at every size: the wanted ids grow with the documents
        return self.docs.join(firsts.hint("merge"), "doc_id").select("entity", "text").mapInArrow(make, "entity long, found binary")

    def with_sets(self, edges: DataFrame) -> DataFrame:
        """Pairs with their sets as left and right; b, which is met less often, is looked up first."""
        left = self.sets.select(F.col("entity").alias("a"), F.col("found").alias("left"))
        right = self.sets.select(F.col("entity").alias("b"), F.col("found").alias("right"))
        return edges.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "left", "right")

    def verified(self, edges: DataFrame) -> DataFrame:
        """The pairs whose sets are similar enough."""
        num, den = self.num, self.den

        def test(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "left"):
                keep = []
                for x, y in zip(part.column("left").to_pylist(), part.column("right").to_pylist(), strict=True):
                    total = (len(x) + len(y)) // 8
                    keep.append((den + num) * len(_difference(x, y)) <= (den - num) * total)
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return self.with_sets(edges).mapInArrow(test, "a long, b long")

    def grouped(self, star: DataFrame, labels: DataFrame) -> DataFrame:
        """(head, a): for the heads of each component that some set under them lies outside, the one head a that stands for them, under which most sets are."""
        of = lambda name: labels.select(F.col("entity").alias(name), F.col("component").alias(f"of_{name}"))
        placed = star.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", F.coalesce("of_a", "a").alias("of_a"), F.coalesce("of_b", "b").alias("of_b"))
        heads = placed.groupBy("of_a", "a").agg(F.count("*").alias("k"), F.max(F.col("of_a") != F.col("of_b")).alias("open"))
        heads = self.keep(heads, "component-heads")
        chosen = heads.groupBy("of_a").agg(F.max(F.struct("k", "a"))["a"].alias("chosen"), F.max("open").alias("open")).where("open")
        return heads.join(chosen.select("of_a", "chosen"), "of_a").select(F.col("a").alias("head"), F.col("chosen").alias("a"))

    def compared(self, star: DataFrame) -> DataFrame:
        """(a, b, linked, size, need, need_own, own, missing) for each pair with a head a; size: of b.  Behind them p0, p1, ...: the parity sketch of the difference.

        own: elements of b that a lacks; missing: those of a that b lacks; need: how many of
        either kind b shares with any partner if it isn't linked with a; need_own: of its own.
        """
        num, den = self.num, self.den
        least = lambda beyond: -(-beyond // (2 * (den + num)))

        def test(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "left"):
                rows = []
                for x, y in zip(part.column("left").to_pylist(), part.column("right").to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    own, missing = np.setdiff1d(y, x, assume_unique=True), np.setdiff1d(x, y, assume_unique=True)
                    d = len(own) + len(missing)
                    beyond = (den + num) * d - (den - num) * (len(x) + len(y))
                    widest = (len(y) + len(y) * den // num) * (den - num) // (den + num)
                    need_own = -(-num * len(y) // den) - (len(y) - len(own))
                    rows.append((beyond <= 0, len(y), max(1, least(beyond), d - widest), max(0, need_own), own.tobytes(), missing.tobytes(), *parity(own, missing)))
                kinds = (pa.bool_(), *[pa.int64()] * 3, *[pa.binary()] * 2, *[pa.int64()] * PARITY_WORDS)
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), *columns], ["a", "b", "linked", "size", "need", "need_own", "own", "missing", *_PARITY])

        kinds = ", ".join(f"{p} long" for p in _PARITY)
        return self.with_sets(star).mapInArrow(test, f"a long, b long, linked boolean, size long, need long, need_own long, own binary, missing binary, {kinds}")

    def around(self, grouped: DataFrame, labels: DataFrame, led: DataFrame) -> DataFrame:
        """Candidate pairs among sets under heads of the same component, for those outside it."""
        names = ["a", "b", "of_b", "outside", "own_alone", "need"]

        def elements(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "own"):
                for kind in ("own", "missing"):
                    found = [np.frombuffer(d, np.int64) for d in part.column(kind).to_pylist()]
                    row = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                    every = np.concatenate([np.empty(0, np.int64), *found])
                    columns = [*(part.column(c).take(row) for c in names), pa.array(every), pa.array(np.full(len(every), kind == "own", np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, [*names, "element", "is_own"])

        of = lambda name: labels.select(F.col("entity").alias(name), F.col("component").alias(f"of_{name}"))
        led = self.keep(led.where("entity <> head").join(grouped, "head").groupBy("a", "entity", "level").agg(F.sum("c").alias("c"), F.min("need").alias("need"), F.max("dropped").alias("dropped")), "led-grouped")
        compared = self.compared(self.keep(led.where("entity <> a").select("a", F.col("entity").alias("b")).distinct(), "groups"))
        placed = compared.join(of("b"), "b", "left").join(of("a"), "a", "left").withColumn("of_b", F.coalesce("of_b", "b"))
        beyond = F.coalesce("of_a", "a") != F.col("of_b")
        d = ((F.octet_length("own") + F.octet_length("missing")) / 8).cast("long")
        placed = placed.select("a", "b", "of_b", (beyond & ~F.col("linked")).alias("outside"), (beyond & F.col("linked")).alias("joins"), (F.col("need_own") > 0).alias("own_alone"), F.when(F.col("need_own") > 0, F.col("need_own")).otherwise(F.col("need")).alias("need"), "own", "missing", "size", d.alias("d"), *_PARITY)
        placed = self.keep(placed, "placed")
        useful = placed.join(self.keep(placed.where("outside").select("a").distinct(), "open"), "a")
        every = useful.select(*names, "own", "missing").mapInArrow(elements, "a long, b long, of_b long, outside boolean, own_alone boolean, need long, element long, is_own long")
        # a set outside asks for partners by what the head lacks if they must share some of that, else by all of its difference
        every = every.withColumn("asks", F.col("outside") & ((F.col("is_own") == 1) | ~F.col("own_alone"))).drop("outside", "own_alone", "is_own")
        every = self.keep(every, "elements")
        sizes = every.groupBy("a", "element").agg(F.count("*").alias("k"), F.max("asks").alias("some"), (F.min("of_b") < F.max("of_b")).alias("spans"))
        sizes = self.keep(sizes.where("some and spans").select("a", "element", "k"), "sizes")
        # of a hot element only the holders that ask count
        same = (every["a"] == sizes["a"]) & (every["element"] == sizes["element"]) & ((sizes["k"] <= self.hot) | every["asks"])
        every = self.keep(every.join(sizes, same).select(every["*"], "k"), "shared")
        warm = every.where((F.col("k") > self.hot) & F.col("asks")).groupBy("a", "b").agg(F.count("*").alias("h"), F.max("need").alias("need"))
        warm = self.keep(warm, "warm")
        cold = every.where(F.col("k") <= self.hot)
        x = cold.where("asks").select("a", "element", F.col("b").alias("x"), F.col("of_b").alias("of_x"), "need")
        y = cold.select("a", "element", F.col("b").alias("y"), F.col("of_b").alias("of_y"))
        met = x.join(y, ["a", "element"]).where("of_x <> of_y").groupBy("a", "x", "y").agg(F.count("*").alias("n"), F.max("need").alias("need"))
        met = met.join(warm.select("a", F.col("b").alias("x"), "h"), ["a", "x"], "left").where("n >= need - coalesce(h, 0)")
        sketch = lambda name: [F.col("b").alias(name), F.col("of_b").alias(f"of_{name}"), F.col("size").alias(f"size_{name}"), F.col("d").alias(f"d_{name}")]
        of_x = placed.select("a", *sketch("x"), *[F.col(p).alias(f"x{p}") for p in _PARITY])
        of_y = placed.select("a", *sketch("y"), *_PARITY)
        num, den = self.num, self.den
        apart = " + ".join(f"bit_count(x{p} ^ {p})" for p in _PARITY)  # at most |x ^ y|
        near = f"least(size_x, size_y) * {den} >= greatest(size_x, size_y) * {num} and abs(d_x - d_y) * {den + num} <= (size_x + size_y) * {den - num} and ({apart}) * {den + num} <= (size_x + size_y) * {den - num}"
        met = self.keep(met.select("a", "x", "y"), "hits").join(of_x, ["a", "x"]).join(of_y, ["a", "y"]).where(near)
        # sets whose need hot elements may cover under heads that have half of their signatures
        doubtful = self.keep(warm.where("h >= need").select("a", F.col("b").alias("entity")), "doubtful")
        unsettled = led.join(doubtful, ["a", "entity"]).groupBy("entity", "level").agg(F.sum(F.col("c")).alias("u"), F.max("dropped").alias("dropped"), F.min("need").alias("need"))
        unsettled = self.keep(unsettled.where("2 * (u + dropped) >= need").select("entity").distinct(), "unsettled")
        mine = doubtful.join(unsettled, "entity").select("a", F.col("entity").alias("b"))
        x = self.keep(of_x.join(mine.withColumnRenamed("b", "x"), ["a", "x"]), "rest")
        rest = x.join(of_y, "a").where(f"of_x <> of_y and {near}")
        found = met.select("x", "y").union(rest.select("x", "y")).union(placed.where("joins").select("a", "b"))
        return self.keep(found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "close")

    def components(self, links: DataFrame, known: DataFrame | None, name: str) -> DataFrame:
        """(entity, component): the least entity that links reach, for the entities that have any; known: of earlier links."""
        links = self.keep(links, f"links-{name}")
        if known is not None:
            links = self.keep(self.apart(links, known), f"new-{name}")
            if links.isEmpty():
                return known
            links = self.keep(links.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"), F.col("a").alias("x"), F.col("b").alias("y")), f"between-{name}")
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        labels = self.keep(both.groupBy(F.col("a").alias("entity")).agg(F.least(F.first("a"), F.min("b")).alias("component")), f"labels-{name}-0")
        turn, going = 0, True
        while going:
            turn += 1
            seen = both.join(labels.select(F.col("entity").alias("b"), "component"), "b").groupBy(F.col("a").alias("entity")).agg(F.min("component").alias("seen"))
            near = self.keep(labels.join(seen, "entity").select("entity", F.least("component", "seen").alias("component"), F.col("component").alias("before")), f"labels-{name}-{turn}-near")
            up = near.select(F.col("entity").alias("component"), F.col("component").alias("top"))
            labels = self.keep(near.join(up, "component").select("entity", F.col("top").alias("component"), "before"), f"labels-{name}-{turn}")
            going = not labels.where("component <> before").isEmpty()
        labels = labels.select("entity", "component")
        if known is None:
            return labels
        fresh = links.select("x").union(links.select("y")).distinct().toDF("entity").join(known, "entity", "left_anti").select("entity", F.col("entity").alias("component"))
        to = labels.select(F.col("entity").alias("component"), F.col("component").alias("top"))
        return self.keep(known.union(fresh).join(to, "component", "left").select("entity", F.coalesce("top", "component").alias("component")), f"labels-{name}")

    def apart(self, edges: DataFrame, labels: DataFrame) -> DataFrame:
        """The pairs that no component holds."""
        of = lambda name: labels.select(F.col("entity").alias(name), F.col("component").alias(f"of_{name}"))
        known = edges.join(of("a"), "a", "left").join(of("b"), "b", "left")
        return known.select("a", "b", F.coalesce("of_a", "a").alias("of_a"), F.coalesce("of_b", "b").alias("of_b")).where("of_a <> of_b")


def parity(*parts: np.ndarray) -> list[int]:
    """For each hash value modulo the sketch's bits, whether an odd number of elements has it; no two sets' sketches differ in more bits than the sets in elements."""
    odd = np.bincount(np.concatenate(parts).astype(np.uint64) % np.uint64(64 * PARITY_WORDS), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _difference(x: bytes, y: bytes) -> np.ndarray:
    """The elements in one of two sets only."""
    return np.setxor1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)


def components(docs: DataFrame, num: int = 75, den: int = 100, shingle: int = 5, hot: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id that links of similarity num/den reach.

    Words are runs of characters other than ASCII white space, with A-Z in lower case.  A text
    with fewer words than a shingle is one shingle; a null text or one without words is linked
    with nothing.  Rows with a null doc_id are left out; of rows with one doc_id the least text
    counts, once; an empty table gives an empty one; whole texts are read; other columns are not.
    """
    join = Join(_rows(docs, id_col, text_col), num, den, shingle, hot)
    found = _named(join, *join.run())
    join.discard("met", "documents", "named")
    return found


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = texts(docs, id_col, text_col).where("doc_id is not null")
    repeated = rows.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return rows
    one = rows.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return rows.join(repeated, "doc_id", "left_anti").union(one)


def _named(join: Join, documents: DataFrame, entities: DataFrame, labels: DataFrame) -> DataFrame:
    """Components of documents, named by their smallest doc_id."""
    alone = documents.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    first = join.keep(entities.join(labels, "entity", "left").select("entity", "first", F.coalesce("component", "entity").alias("component")), "first")
    smallest = join.keep(first.groupBy("component").agg(F.min("first").alias("component_id")), "smallest")
    of = join.keep(first.join(smallest, "component").select("entity", "component_id"), "named")
    return documents.where("n_shingles > 0").join(of, "entity").select("doc_id", "n_shingles", "component_id").union(alone)


ORACLE = """
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
    FROM documents),
s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 75 * (a.c + b.c - i)),
e AS (SELECT x AS a, y AS b FROM l UNION SELECT y, x FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, CAST(coalesce(n.c, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY 1) m ON m.a = w.doc_id
"""
