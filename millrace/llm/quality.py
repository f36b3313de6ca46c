"""Quality classifier by ordinal cumulative-link regression [operator 9].

A document is the set of its hashed text features: its lower-cased words, the stems of
its longer words with whether they occur once, twice or more often, the shapes of its
tokens with their share of the text on a log scale, and how often a token follows
itself.  Stems see inflected words, each form of which may be too rare to tell anything.  All grades share one weight for each feature; ordered
thresholds separate them: P(grade >= j) = logistic(w.x - threshold_j).  The
expected grade and the tail probabilities follow.

Weights add up, so words that each settle a grade, as insults do, can't all get the
weight that one of them deserves.  The fit therefore finds the marks of each
threshold, features that hardly a document from that grade on holds, and gives one
more feature to the documents that hold any of them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import log2
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from millrace.llm.common import slices, with_own_names, worker_cache
from millrace.llm.langid import held_out

BITS = 22
_RUNS = re.compile(r"(.)\1+")
_CACHE = 300_000

#: Letters of the stem that a longer word has, and occurrences of it that are told apart.
STEM, STEM_COUNTS = 5, 3

#: Grades from low to high.
LOW, FAIR, GOOD = 0, 1, 2

#: A feature is a mark if it is so many standard deviations rarer from a grade on than
#: among all documents, and that grade's share of its documents is at most MARK_SHARE.
MARK_DEVIATIONS, MARK_SHARE = 6, 0.05
#: Standard deviations from which a feature's score against thresholds alone tells something.
LEAST_SCORE = 4


def _token(token: str, known: dict[str, tuple[int, int | None, str]]) -> tuple[int, int | None, str]:
    """The hash buckets of a token's word and of its stem, if it has one, and the token's shape."""
    found = known.get(token)
    if found is None:
        if len(known) >= _CACHE:
            known.clear()
        word = "".join(c for c in token.lower() if c.isalnum())
        shape = "".join("X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c for c in token)
        stem = crc32(b"p" + word[:STEM].encode()) & ((1 << BITS) - 1) if len(word) > STEM else None
        found = crc32(b"w" + word.encode()) & ((1 << BITS) - 1), stem, _RUNS.sub(r"\1", shape)
        if len(token) <= 64:
            known[token] = found
    return found


def features(text: str) -> np.ndarray:
    """Sorted distinct buckets; empty for a text without tokens."""
    tokens = text.split()
    if not tokens:
        return np.empty(0, np.int64)
    buckets, shapes, stems = set(), Counter(), Counter()
    known = worker_cache("quality", dict)
    for token, n in Counter(tokens).items():
        bucket, stem, shape = _token(token, known)
        buckets.add(bucket)
        shapes[shape] += n
        if stem is not None:
            stems[stem] += n
    for k in range(STEM_COUNTS):
        buckets.update([stem + k * 0x9E3779 & (1 << BITS) - 1 for stem, n in stems.items() if n > k])
    again = sum(map(str.__eq__, tokens, tokens[1:]))
    named = [(f"s{shape}", n) for shape, n in shapes.items()] + [("again", again)] * (again > 0)
    level = lambda n: int(log2(len(tokens) / n))
    buckets.update(crc32(f"{name}\0{level(n)}".encode()) & ((1 << BITS) - 1) for name, n in named)
    return np.array(sorted(buckets), np.int64)


def _held(found: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Which of ``asked`` are among the sorted ``found``."""
    if not len(found):
        return np.zeros(len(asked), bool)
    return found[np.minimum(np.searchsorted(found, asked), len(found) - 1)] == asked


def _with_marks(found: np.ndarray, marks: list[np.ndarray]) -> np.ndarray:
    """``found`` and a bucket behind all others for each threshold of whose marks it holds any."""
    return np.concatenate([found, [(1 << BITS) + j for j, asked in enumerate(marks) if _held(found, asked).any()]]).astype(np.int64)


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    marks: list[np.ndarray]

    def tails(self, found: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ...; zeros for a document without features."""
        if not len(found):
            return np.zeros(len(self.thresholds))
        weight = self.weights[_held(_with_marks(found, self.marks), self.buckets)].sum()
        return 1 / (1 + np.exp(-np.clip(weight - self.thresholds, -50, 50)))


def fit(documents: list[np.ndarray], grades: np.ndarray, n_grades: int = 3, least: int = 5, penalty: float = 1e-4, sparse: float = 1e-3, rounds: int = 400, rate: float = 0.05) -> Model:
    """Maximum likelihood with a quadratic and an absolute penalty, by full-batch Adam steps.

    The absolute penalty (``sparse``) drives the weights of words that tell nothing to zero.

    Features of fewer than ``least`` documents get no weight, nor do those, marks aside,
    whose score tells nothing: the steps move rare features as fast as frequent ones, and
    thousands of rare ones would explain the grades before the frequent ones could.
    Thresholds stay ordered: the first is free, the others are sums of positive steps.
    """
    share = [min(max((grades >= j).mean() if len(grades) else 1.0, 1e-3), 1 - 1e-3) for j in range(1, n_grades)]
    start = np.maximum.accumulate([-np.log(s / (1 - s)) for s in share] + 1e-3 * np.arange(n_grades - 1))
    if not len(grades):
        return Model(np.empty(0, np.int64), np.empty(0), start, [])
    frequent, column, row = _columns(documents)
    counts = np.bincount(column)
    marks = []
    for j, s in enumerate(share, 1):
        high = np.bincount(column, (grades >= j)[row], len(frequent))
        rare = high - s * counts <= -MARK_DEVIATIONS * np.sqrt(s * (1 - s) * counts)
        marks.append(frequent[rare & (high <= MARK_SHARE * counts)])
    documents = [_with_marks(d, marks) for d in documents]
    frequent, column, row = _columns(documents)
    counts = np.bincount(column)
    ends = np.concatenate([[1], 1 / (1 + np.exp(start)), [0]])
    residual = (1 - ends[:-1] - ends[1:])[grades]
    score = np.bincount(column, residual[row], len(frequent))
    tells = np.abs(score) >= LEAST_SCORE * np.sqrt(residual.var() * counts * (1 - counts / len(documents)))
    chosen = np.flatnonzero((counts >= least) & (tells | (frequent >> BITS > 0)))
    keep = np.isin(column, chosen)
    row = row[keep]
    place = np.full(len(frequent), -1)
    place[chosen] = np.arange(len(chosen))
    column = place[column[keep]]
    # parameters: weights, first threshold, logs of the steps between thresholds
    n = len(chosen)
    p = np.concatenate([np.zeros(n), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        _, g = loss(p, n, row, column, len(documents), grades, penalty)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        scale = rate / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        p -= scale * m / (1 - 0.9**t)
        p[:n] = np.sign(p[:n]) * np.maximum(np.abs(p[:n]) - np.minimum(scale[:n], 10.0) * sparse, 0)
    some = np.flatnonzero(p[:n])
    return Model(frequent[chosen][some], p[some], p[n] + np.concatenate([[0], np.cumsum(np.exp(p[n + 1 :]))]), marks)


def loss(p: np.ndarray, n: int, row: np.ndarray, column: np.ndarray, documents: int, grades: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """The mean negative log-likelihood with the quadratic penalty, and its gradient.

    p: n weights, the first threshold and the logs of the steps between thresholds; row and
    column: document and weight of each feature.
    """
    k = len(p) - n
    steps = np.exp(p[n + 1 :])
    theta = p[n] + np.concatenate([[0], np.cumsum(steps)])
    z = np.bincount(row, p[column], documents)
    tail = np.ones((documents, k + 2))
    tail[:, 1:-1] = 1 / (1 + np.exp(-np.clip(z[:, None] - theta, -50, 50)))
    tail[:, -1] = 0
    at = np.arange(documents)
    upper, lower = tail[at, grades], tail[at, grades + 1]
    likely = np.maximum(upper - lower, 1e-12)
    up, low = upper * (1 - upper) / likely, lower * (1 - lower) / likely
    dz = -(up - low) / documents
    dtheta = np.array([(up * (grades == j)).sum() - (low * (grades == j - 1)).sum() for j in range(1, k + 1)]) / documents
    gradient = np.concatenate([np.bincount(column, dz[row], n) + penalty * p[:n], [dtheta.sum()], [steps[j] * dtheta[j + 1 :].sum() for j in range(k - 1)]])
    return float(-np.log(likely).mean() + penalty / 2 * (p[:n] ** 2).sum()), gradient


def _columns(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct buckets of all documents, and for each bucket of each document its place among them and the document."""
    frequent, column = np.unique(np.concatenate(documents), return_inverse=True)
    return frequent, column, np.repeat(np.arange(len(documents)), [len(d) for d in documents])


def graded(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, grade): low quality 0, fair but toxic 1, neither 2; the lowest of a document's rows; rows without quality don't count."""
    grade = F.when(F.col("quality") <= 0, LOW).when(F.coalesce("toxic", F.lit(0)) > 0, FAIR).otherwise(GOOD)
    rows = labels.where("quality is not null").select(labels[id_col].cast("long").alias("doc_id"), grade.alias("grade"))
    return rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def learn(docs: DataFrame, labels: DataFrame, sample: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``sample`` labelled documents that aren't held out, chosen by a hash of their ids.

    The chosen ids, ``sample`` at most, are broadcast; their features, not their texts,
    go to the driver.  A document without a label and one without tokens, as with a null or
    empty text, isn't learned from; rows with one doc_id are learned from each; documents
    whose hashes tie are taken by id; empty tables give a model that knows no feature; whole
    texts are read.
    """
    chosen = graded(labels).where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [features(t or "").tolist() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("grade"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "grade", "found"])

    got = rows.mapInArrow(run, "doc_id long, grade int, found array<int>").toArrow().sort_by("doc_id")
    used = [(g, np.array(f, np.int64)) for g, f in zip(got.column("grade").to_pylist(), got.column("found").to_pylist(), strict=True) if f]
    return fit([f for _, f in used], np.array([g for g, _ in used], np.int64))


def grade(docs: DataFrame, model: Model, tail_from: int = FAIR, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` with expected_grade double, p_tail double and accepted boolean behind its columns, which are all kept.

    p_tail is P(grade >= tail_from); a document is accepted if it is at least ``least``.  A
    text that is null or without tokens has grade 0 and isn't accepted; repeated rows and
    null ids are kept; an empty table gives an empty one; whole texts are read however long;
    columns of ``docs`` with the new names are replaced; others may share names, of which the first counts.
    """
    docs = docs.drop("expected_grade", "p_tail", "accepted")
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            tails = [shared.value.tails(features(t or "")) for t in part.column(at).to_pylist()]
            high = [float(t[tail_from - 1]) for t in tails]
            new = [pa.array([float(t.sum()) for t in tails], pa.float64()), pa.array(high, pa.float64()), pa.array([h >= least for h in high], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, "expected_grade", "p_tail", "accepted"])

    added = [StructField("expected_grade", DoubleType()), StructField("p_tail", DoubleType()), StructField("accepted", BooleanType())]
    apart = with_own_names(docs)
    return apart.mapInArrow(run, StructType([*apart.schema.fields, *added])).toDF(*docs.columns, *(f.name for f in added))
