"""Language identification by rank-order profiles [operator 6].

A profile is the list of a language's most frequent letter n-grams of one to three
characters, most frequent first.  A document's own list is compared with each
profile by the out-of-place distance: the sum over its n-grams of how far their
ranks differ, a missing n-gram counting as the profile's length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from millrace.llm.common import discard, shared_dir, slices, with_own_names, worker_cache, written

UNDETERMINED = "und"
_BITS = 21  # of a code point; three of them fit into 63 bits

def _letter_table() -> np.ndarray:
    return worker_cache("letters", lambda: np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a text's n-grams, in the order of the keys.

    Letters are lower-cased; every run of other characters, and either end, counts as
    one space.  The lone space and n-grams with a space in the middle are left out.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[codes]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    padded = np.full(len(codes) + 2, 32, np.int64)
    padded[1:-1] = np.where(letter, codes, 32)
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 32) | (padded[:-1] != 32)
    s = padded[keep]
    two = s[:-1] | s[1:] << _BITS
    three = two[:-1] | s[2:] << 2 * _BITS
    return np.unique(np.concatenate([s[s != 32], two, three[s[1:-1] != 32]]), return_counts=True)


def ranked(text: str, size: int) -> np.ndarray:
    """Keys of the text's most frequent n-grams, most frequent first; ties by key."""
    keys, counts = ngrams(text)
    return keys[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """The profiles as one sorted key table with a column of ranks for each language."""

    def __init__(self, lists: dict[str, list[int]], size: int):
        self.size, self.names = size, sorted(lists)
        self.keys = np.unique(np.array([k for keys in lists.values() for k in keys], np.int64))
        self.ranks = np.full((len(self.keys) + 1, len(self.names)), size, np.int64)
        for column, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.keys, np.array(lists[name], np.int64)), column] = np.arange(len(lists[name]))
        self.missing = np.full(len(self.names), size, np.int64)

    def predict(self, text: str) -> tuple[str, float]:
        """The nearest language, the first by name among equals, and 1 minus its distance as a share of the largest one."""
        own = ranked(text, self.size)
        if not len(own) or not self.names:
            return UNDETERMINED, 0.0
        at = np.searchsorted(self.keys, own)
        at[self.keys[np.minimum(at, len(self.keys) - 1)] != own] = len(self.keys)
        ranks = self.ranks[at]
        place = np.arange(len(own))[:, None]
        distance = np.where(ranks == self.size, self.size, np.abs(ranks - place)).sum(0)
        best = int(distance.argmin())
        return self.names[best], float(1 - distance[best] / (len(own) * self.size))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, size: int = 300, sample: int = 1000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles of the languages in ``lang_col``, from documents that aren't held out.

    sample: about how many documents are read for a language, chosen by a hash of
    their ids; a language with fewer gives all.  Null texts tell nothing; rows without a
    doc_id or a language aren't learned from; a repeated row counts as often as it comes; of
    equally frequent n-grams the smaller key comes first; an empty table gives no profile;
    whole texts are read.  The n-gram counts stay distributed; the driver gets the languages
    and ``size`` n-grams for each, in one job.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = rows.where("doc_id is not null and lang is not null").where(~held_out(F.col("doc_id")))
    per_language = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not per_language:
        return Profiles({}, size)
    share = F.create_map(*[F.lit(x) for lang, n in sorted(per_language.items()) for x in (lang, min(1.0, sample / n))])
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).where("text is not null")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            of: dict[str, list] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                of.setdefault(lang, []).append(ngrams(text))
            for lang, found in of.items():
                keys, inverse = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                counts = np.bincount(inverse, np.concatenate([c for _, c in found]), len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], ["lang", "key", "n"])

    counts = chosen.select("lang", "text").mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    folder = shared_dir(spark)
    counts = written(spark, counts, folder, "ngrams")
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "key")
    top = counts.withColumn("place", F.row_number().over(best)).where(F.col("place") <= size)
    lists: dict[str, list[int]] = {}
    for row in top.orderBy("lang", "place").select("lang", "key").collect():
        lists.setdefault(row["lang"], []).append(row["key"])
    discard(spark, folder)
    return Profiles(lists, size)


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred string and lang_score double behind its columns, which are all kept.

    A text that is null or has no letter gives "und" and 0, and so does an empty set of
    profiles; repeated rows and null ids are kept; an empty table gives an empty one; whole
    texts are read however long.  Columns of ``docs`` named lang_pred or lang_score are replaced;
    other columns may share names, of which the first counts.
    """
    docs = docs.drop("lang_pred", "lang_score")
    shared, at = docs.sparkSession.sparkContext.broadcast(profiles), docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            found = [shared.value.predict(t or "") for t in part.column(at).to_pylist()]
            new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, "lang_pred", "lang_score"])

    apart = with_own_names(docs)
    schema = StructType([*apart.schema.fields, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType())])
    return apart.mapInArrow(run, schema).toDF(*docs.columns, "lang_pred", "lang_score")
