"""Primary-key tables: immutable Parquet segments, merged on read, last write wins.

A table is a folder with numbered manifests and segments.  Every statement that writes adds
one segment; the manifest lists them from old to new and gives each its sequence number when
it is committed.  Rows carry their place in the statement as __ord and __op (0 put, 1 delete).
A read takes the newest row of each key and drops deleted ones.

Commits: a change is made to the newest manifest and written as the next number, which only
one writer can create; another finds the number taken, reads the new manifest and makes its
change to that.  So no writer loses another one's rows.

Upkeep: the base is a segment of unique keys, bucketed and sorted by key, with a bloom filter
on it.  Behind it lie up to RUNS changed segments; one more, and a run of neighbours of like
size is merged into one (``pick``), so a row is rewritten about log(size) times; the base takes
part only when the changes amount to a share of it.  The base has as many buckets as keep what
a task needs to sort one of them under BUCKET_BYTES, by the counts in the manifest.  A read joins
the base with the changed keys, which are broadcast as long as the manifest bounds their bytes;
beyond that they are shuffled to the base's buckets, and the base itself isn't, unless the changes
are so much larger that its buckets can't take them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import InsertError, NotFound
from millrace.operators.relational import latest
from millrace.sources.files import Files

SPARK_TYPES = {"INT": T.IntegerType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType()}
_ARROW_TYPES = {"INT": pa.int32(), "DOUBLE": pa.float64(), "STRING": pa.string()}
#: Segments behind the base at which a write merges some of them.
RUNS = 8
#: A segment joins the run behind it if it has at most so many times the run's rows.
RATIO = 4
#: Changed rows, as a share of the base, from which the base is merged as well.
BASE_SHARE = 0.25
#: Bytes of changed keys up to which a read broadcasts them.
BROADCAST_BYTES = 64 << 20
#: Bytes that a key takes in a broadcast table besides its own.
_KEY_OVERHEAD = 16
#: Bytes of memory that the sort of a bucket of the base takes.
BUCKET_BYTES = 64 << 20
#: Bytes that a row takes in a sort besides its values: null bits and the sort's pointers, whose array doubles.
_ROW_OVERHEAD = 40
#: Manifests that stay when ``vacuum`` deletes old ones.
KEPT_MANIFESTS = 3
_MANIFEST = re.compile(r"manifest-([0-9]{9})\.json")


@dataclass
class Segment:
    name: str
    rows: int
    seq: int = 0
    key_bytes: int = 0
    sort_bytes: int = 0  # that a sort of all rows takes; 0: not known, as in older manifests
    unique: bool = False  # each key once, no deletes
    buckets: int = 0  # by the hash of the key; 0: none


@dataclass
class Manifest:
    columns: list[tuple[str, str]]
    key: str
    next_seq: int = 1
    row_counter: int = 0
    segments: list[Segment] = field(default_factory=list)
    last_epoch: dict[str, int] = field(default_factory=dict)


def pick(rows: list[int], based: bool) -> tuple[int, int] | None:
    """The run of segments that a write should merge, as (start, end); None while there are few.

    rows: of each segment, from old to new; based: the first is the base.
    """
    first = int(based)
    if len(rows) - first <= RUNS:
        return None
    start, total = len(rows) - 1, rows[-1]
    while start > first and rows[start - 1] <= RATIO * total:
        start -= 1
        total += rows[start]
    end = len(rows)
    if end - start < 2:  # all much larger than the newest: the smallest neighbours
        start = min(range(first, len(rows) - 1), key=lambda k: rows[k] + rows[k + 1])
        end, total = start + 2, rows[start] + rows[start + 1]
    if based and sum(rows[first:]) >= BASE_SHARE * rows[0]:
        return 0, len(rows)
    return start, end


class KeyedTable:
    def __init__(self, spark: SparkSession, files: Files, name: str, manifest: Manifest, version: int):
        self.spark, self.files, self.name, self.manifest, self.version = spark, files, name, manifest, version

    @classmethod
    def create(cls, spark: SparkSession, files: Files, name: str, columns: list[tuple[str, str]], key: str) -> KeyedTable | None:
        """A new table, or None if there is one."""
        files.make()
        made = Manifest(list(columns), key)
        if versions(files) or not files.create_json(_manifest_name(1), asdict(made)):
            return None
        return cls(spark, files, name, made, 1)

    @classmethod
    def open(cls, spark: SparkSession, files: Files, name: str) -> KeyedTable:
        table = cls(spark, files, name, None, 0)
        table.refresh()
        return table

    def refresh(self) -> KeyedTable:
        """See what other writers have committed."""
        while True:
            found = versions(self.files)
            if not found:
                raise NotFound(f"there is no table {self.name}")
            if found[-1] == self.version:
                return self
            try:
                read = self.files.read_json(_manifest_name(found[-1]))
            except FileNotFoundError:  # vacuumed meanwhile
                continue
            segments = [Segment(**s) for s in read.pop("segments")]
            columns = [tuple(c) for c in read.pop("columns")]
            self.manifest, self.version = Manifest(columns=columns, segments=segments, **read), found[-1]
            return self

    def commit(self, change: Callable[[Manifest], bool]) -> bool:
        """Make a change to the newest manifest; False if the change says that it no longer applies."""
        while True:
            self.refresh()
            new = Manifest(**{**asdict(self.manifest), "columns": self.manifest.columns, "segments": [Segment(**asdict(s)) for s in self.manifest.segments]})
            if not change(new):
                return False
            if self.files.create_json(_manifest_name(self.version + 1), asdict(new)):
                self.manifest, self.version = new, self.version + 1
                return True

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, SPARK_TYPES[k]) for n, k in self.manifest.columns])

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.manifest.columns]

    @property
    def _full(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("__ord", T.LongType()), T.StructField("__op", T.ByteType())])

    # --- reading ---

    def _segment(self, segment: Segment) -> DataFrame:
        path = f"{self.files.uri}/{segment.name}"
        if not segment.buckets:
            return self.spark.read.schema(self._full).parquet(path)
        known = f"millrace_{segment.name.rpartition('-')[2]}"
        if not self.spark.catalog.tableExists(known):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self._full)
            key = f"`{self.manifest.key}`"
            uri = (path if "://" in path else f"file://{path}").replace("\\", "\\\\").replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {known} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {segment.buckets} BUCKETS LOCATION '{uri}'")
        return self.spark.table(known)

    def _segments(self, segments: list[Segment]) -> DataFrame:
        """All rows of the segments, with the number of each as __seq."""
        if not segments:
            return self.spark.createDataFrame([], T.StructType([*self._full.fields, T.StructField("__seq", T.LongType())]))
        return reduce(DataFrame.union, [self._segment(s).withColumn("__seq", F.lit(s.seq).cast("long")) for s in segments])

    def _merged(self, segments: list[Segment]) -> DataFrame:
        """The newest row of each key, deletes included; of equal keys of one statement the last one, or else the one with the greatest values."""
        others = [F.desc_nulls_last(n) for n in self.names if n != self.manifest.key]
        return latest(self._segments(segments), [self.manifest.key], [F.desc("__seq"), F.desc("__ord"), F.desc("__op"), *others])

    def _split(self) -> tuple[list[Segment], list[Segment]]:
        segments = self.manifest.segments
        return (segments[:1], segments[1:]) if segments and segments[0].unique else ([], segments)

    def _live(self, df: DataFrame) -> DataFrame:
        return df.where("__op = 0").select(*self.names)

    def _newest(self, segments: list[Segment]) -> DataFrame:
        """The rows that the segments, which begin with the first one, leave."""
        base, rest = (segments[:1], segments[1:]) if segments and segments[0].unique else ([], segments)
        if not rest:
            return self._segments(base).select(*self.names)
        if not base:
            return self._live(self._merged(rest))
        key = self.manifest.key
        old, changed = self._segment(base[0]), self._segments(rest).select(key)
        if sum(s.key_bytes + _KEY_OVERHEAD * s.rows for s in rest) <= BROADCAST_BYTES:
            changed = F.broadcast(changed.distinct())
        else:
            # dealt here: Spark would shuffle a base that has fewer buckets than spark.sql.shuffle.partitions
            n = max(base[0].buckets, _parts(sum(s.key_bytes + (8 + _ROW_OVERHEAD) * s.rows for s in rest)))
            old = old if n == base[0].buckets else old.repartition(n, key)
            changed = changed.repartition(n, key).distinct().hint("merge")
        return old.join(changed, key, "left_anti").select(*self.names).union(self._live(self._merged(rest)))

    def read(self) -> DataFrame:
        """The table's rows as of the manifest that was read last."""
        return self._newest(self.manifest.segments)

    def get(self, value) -> DataFrame:
        """The row with this key, or none.  The predicate reaches every segment's scan; in the base it leaves one bucket, and there what bloom filter and key ranges let through."""
        return self.read().where(F.col(self.manifest.key) == F.lit(value).cast(SPARK_TYPES[dict(self.manifest.columns)[self.manifest.key]]))

    # --- writing ---

    def _new(self) -> str:
        return f"segment-{uuid.uuid4().hex}"

    def _write(self, df: DataFrame, buckets: int = 0) -> Segment:
        """Write rows as a segment, those of a base (buckets: how many) bucketed and sorted by key."""
        name, key = self._new(), self.manifest.key
        path = f"{self.files.uri}/{name}"
        options = {f"parquet.bloom.filter.enabled#{key}": "true", f"parquet.bloom.filter.adaptive.enabled#{key}": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
        if buckets:
            known = f"millrace_{name.rpartition('-')[2]}"
            rows = df.withColumns({"__ord": F.lit(0).cast("long"), "__op": F.lit(0).cast("byte")}).repartition(buckets, key).sortWithinPartitions(key)
            rows.write.options(**options).bucketBy(buckets, key).sortBy(key).format("parquet").option("path", path).saveAsTable(known)
        else:
            df.write.options(**options).parquet(path)
        return Segment(name, *self._measured(name), unique=buckets > 0, buckets=buckets)

    def _measured(self, name: str) -> tuple[int, int, int, int]:
        """A segment's rows, its number (0: none yet), and the bytes of its keys and of a sort of it."""
        lengths = {n: F.coalesce(F.sum(F.octet_length(n)), F.lit(0)) for n, kind in self.manifest.columns if kind == "STRING"}
        found = self.spark.read.schema(self._full).parquet(f"{self.files.uri}/{name}").agg(F.count(F.lit(1)), *lengths.values()).first()
        n, text = found[0], dict(zip(lengths, found[1:], strict=True))
        return n, 0, text.get(self.manifest.key, 4 * n), self._sort_bytes(n, sum(text.values()))

    def _sort_bytes(self, rows: int, text: int) -> int:
        """Bytes of memory that a sort of so many rows with so many bytes of text takes; a text also has its place and is filled up to 8."""
        strings = sum(kind == "STRING" for _, kind in self.manifest.columns)
        return rows * (8 * (len(self._full) + strings) + _ROW_OVERHEAD) + text

    def _buckets(self, segments: list[Segment]) -> int:
        """Buckets for a base of what these segments hold, as many as Spark allows at most."""
        size = sum(s.sort_bytes or self._measured(s.name)[3] for s in segments)
        return min(_parts(size), int(self.spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))

    def _add(self, segment: Segment, counter: int, stream: str | None = None, epoch: int | None = None) -> bool:
        def change(manifest: Manifest) -> bool:
            if stream is not None:
                if manifest.last_epoch.get(stream, -1) >= epoch:
                    return False
                manifest.last_epoch[stream] = epoch
            segment.seq, manifest.next_seq = manifest.next_seq, manifest.next_seq + 1
            manifest.segments.append(segment)
            manifest.row_counter = max(0, manifest.row_counter + counter)
            return True

        added = self.commit(change)
        if added and (run := pick([s.rows for s in self.manifest.segments], self.manifest.segments[0].unique)):
            self._merge(*run)
        return added

    def put_rows(self, rows: list[tuple]) -> int:
        """Upsert rows that the driver holds; of equal keys the last one counts."""
        if rows:
            name, key = self._new(), self.manifest.key
            (self.files / name).make()
            columns = [pa.array([row[k] for row in rows], _ARROW_TYPES[kind]) for k, (_, kind) in enumerate(self.manifest.columns)]
            columns += [pa.array(range(len(rows)), pa.int64()), pa.array([0] * len(rows), pa.int8())]
            pq.write_table(pa.table(columns, names=[*self.names, "__ord", "__op"]), self.files.path(f"{name}/part-0.parquet"), filesystem=self.files.system)
            keys = [row[self.names.index(key)] for row in rows]
            size = sum(len(k.encode()) if isinstance(k, str) else 4 for k in keys)
            text = sum(len(x.encode()) for row in rows for x in row if isinstance(x, str))
            self._add(Segment(name, len(rows), 0, size, self._sort_bytes(len(rows), text)), len(rows))
        return len(rows)

    def put(self, df: DataFrame, stream: str | None = None, epoch: int | None = None) -> int:
        """Upsert the rows of a DataFrame with the table's columns, in their order; returns their number.

        A DataFrame has no order: of its rows with one key the one with the greatest values, column by
        column, counts.  A null key fails.  stream, epoch: an epoch of a stream that is in the table
        already is left out.
        """
        return self._put(df, True, stream, epoch)

    def _put(self, df: DataFrame, counted: bool, stream: str | None = None, epoch: int | None = None) -> int:
        if stream is not None and self.refresh().manifest.last_epoch.get(stream, -1) >= epoch:
            return 0
        cast = [F.col(f"`{c}`").cast(SPARK_TYPES[kind]).alias(n) for c, (n, kind) in zip(df.columns, self.manifest.columns, strict=True)]
        key = self.manifest.key
        checked = F.coalesce(key, F.raise_error(F.lit(f"the key {key} is null")).cast(SPARK_TYPES[dict(self.manifest.columns)[key]])).alias(key)
        rows = df.select(*cast).select(*[checked if n == key else n for n in self.names])
        segment = self._write(rows.select("*", F.lit(0).cast("long").alias("__ord"), F.lit(0).cast("byte").alias("__op")))
        return segment.rows if self._add(segment, segment.rows * counted, stream, epoch) else 0

    def put_generated(self, n: int) -> int:
        """Upsert n generated rows, numbered on from the table's row counter, which is moved on first: two writers get different numbers."""
        taken = []

        def reserve(manifest: Manifest) -> bool:
            if "INT" in (kinds := [k for _, k in manifest.columns]) and manifest.row_counter + n + len(kinds) > 1 << 31:
                raise InsertError("the row counter would leave the range of INT")
            taken[:] = [manifest.row_counter]
            manifest.row_counter += n
            return True

        self.commit(reserve)
        row, columns = F.col("id"), []
        for k, (name, kind) in enumerate(self.manifest.columns):
            made = {"INT": row + k, "DOUBLE": row + F.lit(k * 0.01), "STRING": F.concat(F.lit(f"{name}_"), row.cast("string"))}[kind]
            columns.append(made.cast(SPARK_TYPES[kind]).alias(name))
        return self._put(self.spark.range(taken[0], taken[0] + n).select(*columns), False)

    def delete(self, keys: DataFrame) -> int:
        """Delete the rows with these keys (one column); returns their number."""
        key, kind = self.manifest.key, dict(self.manifest.columns)[self.manifest.key]
        others = [F.lit(None).cast(SPARK_TYPES[k]).alias(n) for n, k in self.manifest.columns if n != key]
        rows = keys.select(F.col(f"`{keys.columns[0]}`").cast(SPARK_TYPES[kind]).alias(key), *others).select(*self.names)
        segment = self._write(rows.select("*", F.lit(0).cast("long").alias("__ord"), F.lit(1).cast("byte").alias("__op")))
        if segment.rows:
            self._add(segment, -segment.rows)
        else:
            self.files.delete(segment.name)
        return segment.rows

    # --- upkeep ---

    def flush(self) -> None:
        """Put all segments behind the base into one, with the newest row of each key; deletes stay."""
        base, rest = self._split()
        if not base:
            self.compact()
        elif len(rest) > 1:
            self._merge(1, len(self.manifest.segments))

    def compact(self) -> None:
        """Rewrite the table as one segment of unique keys, bucketed and sorted by key."""
        if self.manifest.segments and not (len(self.manifest.segments) == 1 and self.manifest.segments[0].unique):
            self._merge(0, len(self.manifest.segments))

    def _merge(self, start: int, end: int) -> None:
        """Put a run of neighbouring segments into one that has the newest row of each key; from the first segment on, deletes go."""
        old = self.manifest.segments[start:end]
        new = self._write(self._newest(old), self._buckets(old)) if start == 0 else self._write(self._merged(old).drop("__seq"))
        names = [s.name for s in old]

        def change(manifest: Manifest) -> bool:
            have = [s.name for s in manifest.segments]
            at = have.index(names[0]) if names[0] in have else -1
            if at < 0 or have[at : at + len(names)] != names or (at == 0) != (start == 0):
                return False
            new.seq = old[-1].seq
            manifest.segments[at : at + len(names)] = [new]
            return True

        if not self.commit(change):  # another writer has merged some of them
            self.files.delete(new.name)

    def vacuum(self) -> None:
        """Delete the files of segments that the newest manifest doesn't list, and old manifests.

        A DataFrame read before may still need those files, and so may a statement that another
        session is running.
        """
        kept = {s.name for s in self.refresh().manifest.segments}
        for name in self.files.folders():
            if name not in kept:
                self.spark.sql(f"DROP TABLE IF EXISTS millrace_{name.rpartition('-')[2]}")
                self.files.delete(name)
        for version in versions(self.files)[:-KEPT_MANIFESTS]:
            self.files.delete_file(_manifest_name(version))


def _parts(size: int) -> int:
    """Tasks that so many bytes to be sorted are dealt to."""
    return max(1, -(-size // BUCKET_BYTES))


def versions(files: Files) -> list[int]:
    """Numbers of a table's manifests; none if there is no table."""
    return sorted(int(m[1]) for m in map(_MANIFEST.fullmatch, files.names()) if m)


def _manifest_name(version: int) -> str:
    return f"manifest-{version:09d}.json"
