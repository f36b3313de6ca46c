"""Canonical exact document fingerprints [operator 8].

A text is folded to a canonical form (NFKC, case folding, white space runs to one
space, none at either end); its fingerprint is the 128-bit xxHash of that form.
Documents are grouped by fingerprint, and within an equal bucket the canonical
bytes themselves are compared, so a chance collision joins nothing.

A first pass over the texts keeps the fingerprints alone, which gives the buckets that
several rows share.  The one shuffle that moves the texts, to bring each document
beside the next one, then also marks the rows of shared buckets; only their forms are
kept and compared with the form of the bucket's smallest doc_id.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, shared_dir, slices, texts, written

#: Ranges per shuffle partition; small ranges even the partitions out.
RANGES = 4
#: Bytes of text a partition is to hold.
TARGET = 128 << 20
#: Rows from which one doc_id may be split.
MANY_ROWS = 1000
#: Ranges at most: the driver holds the first id of each.  Beyond that they grow.
MOST_RANGES = 1 << 16
_MOST_HASH = (1 << 64) - 1
_NONE = -(1 << 63)  # stands for a null doc_id: behind all others in descending order


def canonical(text: str) -> bytes:
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split()).encode()


def digest(form: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(form)


def likeness(a: tuple[str, bytes], b: tuple[str, bytes]) -> float:
    """1 if the fingerprints are equal and so are the bytes behind them, else 0."""
    return float(a[0] == b[0] and a[1] == b[1])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, size) of every row; size: bytes of its text.

    A null text counts as empty; null doc_ids and repeated rows are kept; an empty table
    gives an empty one; texts of any length are read whole; other columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            every = [t or "" for t in part.column("text").to_pylist()]
            found, sizes = [digest(canonical(t)) for t in every], [len(t.encode()) for t in every]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.string()), pa.array(sizes, pa.int64())], ["doc_id", "fingerprint", "size"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string, size long")


def edited_text(text: str, following: str) -> str:
    """The last third of the text replaced by as much of the start of the next one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


PAIRS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class _Ranges:
    """Ranges of rows by descending key; a key with more rows than a range should hold is split by the hash of its texts."""

    def __init__(self, cuts: list[int], heavy: dict[int, int]):
        """cuts: keys at which a range begins; heavy: key -> the ranges that it gets to itself."""
        self.heavy = heavy
        # a heavy key is a cut, and so is the key behind it
        self.bounds = np.array(sorted({*cuts, *heavy, *(k + 1 for k in heavy)}), np.int64)
        widths = [1] + [heavy.get(int(k), 1) for k in self.bounds]
        self.first = np.array([sum(widths[j + 1 :]) for j in range(len(widths))], np.int64)

    def of(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.bounds, keys, "right")
        out = self.first[at]
        for key, n in self.heavy.items():
            mine = keys == key
            out[mine] += ((hashes[mine] >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
        return out.astype(np.int32)

    def hashes(self, keys: np.ndarray, part: pa.RecordBatch) -> np.ndarray:
        """Hashes of the texts of rows with a heavy key, 0 for the others."""
        out = np.zeros(len(keys), np.uint64)
        for k in np.flatnonzero(np.isin(keys, list(self.heavy))) if self.heavy else ():
            out[k] = xxhash.xxh3_64_intdigest((part.column("text")[int(k)].as_py() or "").encode())
        return out


def _ranges(prints: DataFrame) -> tuple[_Ranges, int]:
    """Ranges for the rows of ``prints``, and the partitions to deal them to."""
    total, rows = prints.agg(F.sum("size"), F.count("*")).first()
    partitions = min(max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // TARGET)), MOST_RANGES)
    n = min(RANGES * partitions, MOST_RANGES)
    keys = prints.select(F.coalesce("doc_id", F.lit(_NONE)).alias("key"))
    cuts = keys.select(F.col("key").cast("double").alias("key")).approxQuantile("key", [k / n for k in range(1, n)], 0.1 / n)
    many = keys.groupBy("key").count().where(F.col("count") > max(MANY_ROWS, rows // n)).orderBy(F.desc("count")).limit(n).collect()  # no more than n keys can have so many
    return _Ranges([int(c) for c in set(cuts) if abs(c) < 1 << 62], {r["key"]: -(-r["count"] * n // rows) for r in many if r["key"] < (1 << 63) - 1}), partitions


def _with_next(docs: DataFrame, marked: DataFrame, prints: DataFrame) -> DataFrame:
    """(bucket int, place int, doc_id, text): documents in ranges of descending doc_id, each range with the next one's first.

    One shuffle brings every text to its range, and the few first texts also, as place 2, to
    the range before.  Partitions are sorted; the row after a document is the next one.  An id
    of ``marked`` stands, as place 0, before the documents with it, which have place 1.
    """
    ranges, partitions = _ranges(prints)
    rows = docs.withColumn("key", F.coalesce("doc_id", F.lit(_NONE)))
    keys_of = lambda part: part.column("key").to_numpy(zero_copy_only=False)

    def tops(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[int, int]] = {}
        for part in batches:
            keys = keys_of(part)
            hashes = ranges.hashes(keys, part)
            for b, k, h in zip(ranges.of(keys, hashes).tolist(), keys.tolist(), hashes.tolist(), strict=True):
                best[b] = min(best.get(b, (-k, h)), (-k, h))
        columns = [pa.array(list(best), pa.int32()), pa.array([-k for k, _ in best.values()], pa.int64()), pa.array([f"{_MOST_HASH - h:020d}" for _, h in best.values()])]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "key", "back"])

    asked = rows.select("key", *(["text"] if ranges.heavy else [])).mapInArrow(tops, "bucket int, key long, back string")
    heads = asked.groupBy("bucket").agg(F.max(F.struct("key", "back")).alias("top")).collect()  # a row a range
    order = sorted((r["bucket"], r["top"]["key"], _MOST_HASH - int(r["top"]["back"])) for r in heads)
    before = {(key, h): order[k - 1][0] for k, (_, key, h) in enumerate(order)}  # the first range's head follows the last one

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            keys = keys_of(part)
            hashes = ranges.hashes(keys, part)
            own, n = ranges.of(keys, hashes), len(keys)
            also = [(k, before[x]) for k, x in enumerate(zip(keys.tolist(), hashes.tolist(), strict=True)) if x in before]
            both = part.take(pa.array([*range(n), *(k for k, _ in also)]))
            place = np.repeat(np.array([1, 2], np.int32), [n, len(also)])
            tie = (np.concatenate([hashes, hashes[[k for k, _ in also]]]) >> np.uint64(1)).astype(np.int64)
            bucket = np.concatenate([own, np.array([b for _, b in also], np.int32)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(place), pa.array(tie), *both.columns], ["bucket", "place", "tie", *part.schema.names])

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keys = keys_of(part)
            for k in range(max([1, *ranges.heavy.values()])):  # in each range of a heavy key
                width = np.array([ranges.heavy.get(x, 1) for x in keys.tolist()]) if ranges.heavy else np.ones(len(keys), int)
                some = np.flatnonzero(width > k)
                bucket = ranges.of(keys[some], np.zeros(len(some), np.uint64)) + k
                none, zero = pa.nulls(len(some), pa.string()), np.zeros(len(some), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(zero.astype(np.int32)), pa.array(zero), part.column("key").take(pa.array(some)), none, pa.array(keys[some])], ["bucket", "place", "tie", "doc_id", "text", "key"])

    schema = "bucket int, place int, tie long, doc_id long, text string, key long"
    marks = marked.select(F.coalesce("doc_id", F.lit(_NONE)).alias("key")).mapInArrow(mark, schema)
    dealt = rows.mapInArrow(deal, schema).union(marks).repartition(partitions, "bucket")
    return dealt.sortWithinPartitions("bucket", F.col("place") == 2, F.desc("key"), F.col("place") > 0, "tie", "text").select("bucket", "place", "doc_id", "text", "key")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, how like they are (see PAIRS), and copy_of long.

    copy_of: the smallest doc_id of a row with the same canonical bytes, its own included; null
    where only rows without a doc_id have them.  The next document is the one with the next
    smaller doc_id, after the smallest the largest; a lone document follows itself.  A null text
    counts as empty; rows with the same doc_id follow each other in the order of their texts, or
    of their texts' hashes if they are so many that they are split; null doc_ids come last; an
    empty table gives an empty one; texts of any length are read whole; other columns are not read.

    The bucket of a fingerprint is a shuffled join with nothing above it, whose hot keys adaptive
    execution splits.  Rows that differ from the bucket's head, by a collision, are grouped by the
    SHA-256 of their bytes.
    """
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    rows = texts(docs, id_col, text_col)
    prints = written(spark, fingerprints(rows), folder, "prints")
    buckets = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    buckets = written(spark, buckets, folder, "buckets")
    marked = prints.join(buckets, "fingerprint").select("doc_id").distinct()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*(c.split()[0] for c in PAIRS.split(", ")), "form"]
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, pa.binary()]
        waiting, mark = None, None  # (bucket, doc_id, text, (fingerprint, form), marked)
        for part in slices(batches):
            out = []
            for b, place, doc_id, text, key in zip(*(part.column(c).to_pylist() for c in ("bucket", "place", "doc_id", "text", "key")), strict=True):
                if place == 0:
                    mark = (b, key)
                    continue
                text = text or ""
                form = canonical(text)
                own = (digest(form), form)
                if waiting and waiting[0] == b:
                    out.append((*_row(*waiting[1:4], text, own), waiting[3][1] if waiting[4] else None))
                    waiting = None
                if place == 1:
                    waiting = (b, doc_id, text, own, mark == (b, key))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    found = written(spark, _with_next(rows, marked, prints).mapInArrow(run, f"{PAIRS}, form binary"), folder, "found")
    forms = found.where("form is not null").select("doc_id", "fingerprint", "form")
    heads = forms.join(buckets, "fingerprint").where("doc_id <=> first").groupBy("fingerprint").agg(F.min("form").alias("head"))
    other = forms.join(written(spark, heads, folder, "heads"), "fingerprint").where("form <> head")
    other = written(spark, other.select("fingerprint", "doc_id", F.sha2("form", 256).alias("bytes")), folder, "differing")  # an aggregate on top would bind the join's hot buckets to one task each
    other = written(spark, other.groupBy("fingerprint", "bytes").agg(F.min("doc_id").alias("other")), folder, "other")
    columns = [c.split()[0] for c in PAIRS.split(", ")]
    discard(spark, *(f"{folder}/{name}" for name in ("prints", "heads", "differing")))
    if other.isEmpty():
        return found.select(*columns).join(buckets, "fingerprint", "left").select(*columns, F.coalesce("first", "doc_id").alias("copy_of"))
    bytes_of = found.select(*columns, F.sha2("form", 256).alias("bytes")).join(buckets, "fingerprint", "left").join(other.withColumn("differs", F.lit(True)), ["fingerprint", "bytes"], "left")
    return bytes_of.select(*columns, F.when(F.col("differs"), F.col("other")).otherwise(F.coalesce("first", "doc_id")).alias("copy_of"))


def _row(doc_id: int | None, text: str, own: tuple[str, bytes], following: str, following_own: tuple[str, bytes]) -> tuple:
    changed = edited_text(text, following)
    form = canonical(changed)
    edited = (digest(form), form)
    return doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own[0], edited[0], likeness(own, edited), likeness(own, following_own)
