"""Stored core tables: runs of rows per hash bucket, and a manifest that names the live ones.

A batch is written as one new run that holds its own rows only, so its cost follows the batch
and not the table. Readers merge: the newest version of a key wins, wherever it lies. When the
runs of a bucket outgrow a share of its folded part, that bucket alone is folded into one part
again. A manifest is a small table (one row per live part) written as a new version; it counts
from the moment it is complete, so a crash leaves the version before. Runs are named after their
writer and batch: a repeated batch overwrites its own run, and one that was committed is known.

One writer per table. Parts that a commit replaces are removed two commits later, so a reader has
that long to finish.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.contracts import VERSION_ORDER, Contract
from tidemark.functions import stamp
from tidemark.operators.cdc import newest, to_core
from tidemark.sources import files

BUCKET = "_bucket"
MARK = "_mark"
FEW_BUCKETS = 16  # so few that every task may write a file of its own into each
VERSION = "version"
KEPT_VERSIONS = 2
MANIFEST = "run string, bucket int, rows bigint, bytes bigint, folded boolean"
_WRITER, _BUCKETS = -1, -2  # manifest rows that name a writer's last batch, and the number of buckets


@dataclass(frozen=True)
class Part:
    """Rows of one bucket in one run. ``folded``: one row per key."""

    run: str
    bucket: int
    rows: int
    bytes: int
    folded: bool


class Store:
    def __init__(self, spark: SparkSession, root: str, contract: Contract, buckets: int = 64):
        self.spark, self.root, self.contract = spark, root, contract
        self.schema = to_core(spark.createDataFrame([], contract.landing_schema), contract).schema
        self.version, self.parts, self.writers = 0, [], {}
        self.buckets = buckets
        versions = self._versions()
        if versions:
            self.version = max(versions)
            self.parts, self.writers, self.buckets = self._manifest(self.version)

    # --- manifest -----------------------------------------------------------

    def _versions(self) -> list[int]:
        found = files.partitions(self.spark, f"{self.root}/manifest", VERSION)
        return sorted(int(v) for v, folder in found.items() if files.exists(self.spark, f"{folder}/_SUCCESS"))

    def _manifest(self, version: int) -> tuple[list[Part], dict[str, int], int]:
        # one row per live part, writer and table: no data
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/{VERSION}={version}").collect()
        parts = [Part(*r) for r in rows if r["bucket"] >= 0]
        writers = {r["run"]: r["rows"] for r in rows if r["bucket"] == _WRITER}
        (buckets,) = (r["rows"] for r in rows if r["bucket"] == _BUCKETS)
        return parts, writers, buckets

    def _commit(self, parts: list[Part], writers: dict[str, int]) -> None:
        rows = [(p.run, p.bucket, p.rows, p.bytes, p.folded) for p in parts]
        rows += [(w, _WRITER, batch, 0, False) for w, batch in writers.items()]
        rows.append(("", _BUCKETS, self.buckets, 0, False))
        folder = f"{self.root}/manifest/{VERSION}={self.version + 1}"
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(folder)
        self.version, self.parts, self.writers = self.version + 1, parts, writers
        self._clear()

    def _clear(self) -> None:
        """Remove what only versions before the last few name."""
        versions = self._versions()
        old, kept = versions[:-KEPT_VERSIONS], versions[-KEPT_VERSIONS:]
        live = {(p.run, p.bucket) for v in kept for p in self._manifest(v)[0]} if old else set()
        for version in old:
            for part in self._manifest(version)[0]:
                if (part.run, part.bucket) not in live:
                    files.delete(self.spark, self._folder(part.run, part.bucket))
            files.delete(self.spark, f"{self.root}/manifest/{VERSION}={version}")

    # --- rows ---------------------------------------------------------------

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.contract.key), F.lit(self.buckets)).cast("int")

    def _folder(self, run: str, bucket: int) -> str:
        return f"{self.root}/runs/{run}/{BUCKET}={bucket}"

    def _newest(self, rows: DataFrame) -> DataFrame:
        """The newest row of every key, in the order of the buckets, in which they are written."""
        return newest(rows.withColumn(BUCKET, self.bucket()), [BUCKET, *self.contract.key])

    def _write(self, rows: DataFrame, run: str, folded: Iterable[int]) -> list[Part]:
        path, folded = f"{self.root}/runs/{run}", set(folded)
        placed = rows if BUCKET in rows.columns else rows.withColumn(BUCKET, self.bucket())
        if self.buckets > FEW_BUCKETS:
            # a shuffle of all rows, or every task would write a small file into each of many buckets
            placed = placed.hint("rebalance", BUCKET)
        placed.write.mode("overwrite").option("compression", "zstd").partitionBy(BUCKET).parquet(path)
        if not files.partitions(self.spark, path, BUCKET):
            return []
        # at most one row per bucket
        counts = self.spark.read.parquet(path).groupBy(BUCKET).count().collect()
        return [Part(run, b, n, files.size(self.spark, self._folder(run, b)), b in folded) for b, n in counts]

    def _read(self, parts: list[Part]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[self._folder(p.run, p.bucket) for p in parts])

    def versions(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """All stored rows, several versions of a key among them."""
        wanted = None if buckets is None else set(buckets)
        return self._read([p for p in self.parts if wanted is None or p.bucket in wanted])

    def by_bucket(self) -> dict[int, list[Part]]:
        out = defaultdict(list)
        for part in self.parts:
            out[part.bucket].append(part)
        return out

    def table(self, told: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """The newest row of every key, deleted or not. Buckets that are folded are read as they
        are; only the others are merged, which needs a shuffle. ``told`` makes of the rows what
        the caller needs of them (with key and version), before they are merged."""
        single = [ps[0] for ps in self.by_bucket().values() if len(ps) == 1 and ps[0].folded]
        merged = newest(told(self._read([p for p in self.parts if p not in set(single)])), self.contract.key)
        return told(self._read(single)).unionByName(merged) if single else merged

    def current(self) -> DataFrame:
        return self.table().where(F.col("_is_deleted") == 0).select(*self.contract.columns, "_ingested_at")

    # --- writing ------------------------------------------------------------

    def append(self, core: DataFrame, writer: str, batch: int, one_per_key: bool = False) -> bool:
        """Add core rows as one run. A batch that its writer has already committed adds nothing.
        ``one_per_key`` keeps the newest row of each key of the batch."""
        if self.writers.get(writer, -1) >= batch:
            return False
        rows = self._newest(core) if one_per_key else core
        taken = set(self.by_bucket()) if one_per_key else set(range(self.buckets))
        new = self._write(rows, f"{writer}-{batch}", set(range(self.buckets)) - taken)
        self._commit([*self.parts, *new], {**self.writers, writer: batch})
        return True

    def replace(self, rows: DataFrame, buckets: Iterable[int], folded: bool) -> None:
        """Put ``rows`` in place of everything in ``buckets``."""
        buckets = set(buckets)
        new = self._write(rows, f"version-{self.version + 1}", buckets if folded else ())
        self._commit([p for p in self.parts if p.bucket not in buckets] + new, self.writers)

    def due(self, share: float = 0.25, most: int = 8) -> list[int]:
        """Buckets whose unfolded rows exceed ``share`` of the folded ones, or that have more
        than ``most`` unfolded parts."""
        out = []
        for bucket, parts in self.by_bucket().items():
            loose = [p for p in parts if not p.folded]
            if loose and (len(loose) > most or sum(p.rows for p in loose) > share * sum(p.rows for p in parts if p.folded)):
                out.append(bucket)
        return sorted(out)

    def fold(self, buckets: Iterable[int], tombstones_after: datetime | None = None) -> None:
        """Keep the newest row per key of some buckets, as one part each. A deleted key stays as a
        tombstone, unless it was ingested before ``tombstones_after``."""
        buckets = set(buckets)
        if not buckets:
            return
        kept = self._newest(self.versions(buckets))
        if tombstones_after is not None:
            kept = kept.where((F.col("_is_deleted") == 0) | (F.col("_ingested_at") >= stamp(tombstones_after)))
        self.replace(kept, buckets, folded=True)

    def superseded(self, tombstones_after: datetime | None = None) -> dict[int, int]:
        """Rows per bucket that compaction would drop. Buckets with one folded part have no older
        versions by the manifest and are only looked at for expired tombstones."""
        loose = [b for b, ps in self.by_bucket().items() if len(ps) > 1 or not ps[0].folded]
        per_key = self.versions(loose).groupBy(*self.contract.key).agg((F.count(F.lit(1)) - 1).alias("n"))
        found = per_key.where(F.col("n") > 0).select(self.bucket().alias("b"), "n")
        if tombstones_after is not None:
            expired = self.versions().where((F.col("_is_deleted") == 1) & (F.col("_ingested_at") < stamp(tombstones_after)))
            found = found.unionByName(expired.select(self.bucket().alias("b"), F.lit(1).cast("bigint").alias("n")))
        # at most one row per bucket
        return dict(sorted((r["b"], r["n"]) for r in found.groupBy("b").agg(F.sum("n").alias("n")).collect()))

    def compact(self, tombstones_after: datetime | None = None) -> list[int]:
        """Rewrite the buckets that hold rows to drop; the others keep their files."""
        hit = list(self.superseded(tombstones_after))
        self.fold(hit, tombstones_after)
        return hit

    # --- reconciliation with landing -----------------------------------------

    def marked(self, core: DataFrame) -> DataFrame:
        """Core rows as key, version and a hash of their columns: all that is shuffled where rows
        are only compared."""
        mark = F.xxhash64(*self.contract.columns, "_cdc_seq").alias(MARK)
        names = dict.fromkeys([*self.contract.key, *VERSION_ORDER, "_is_deleted"])
        return core.select(*names, mark)

    def fingerprints(self, state: DataFrame) -> DataFrame:
        """Count and hash sum per bucket of the live rows of ``state``, whatever their order."""
        marked = state if MARK in state.columns else self.marked(state)
        live = marked.where(F.col("_is_deleted") == 0)
        mark = F.col(MARK).cast("decimal(38,0)")
        return live.groupBy(self.bucket().alias(BUCKET)).agg(F.count(F.lit(1)).alias("n"), F.sum(mark).alias("mark"))

    def differing(self, landing: DataFrame) -> list[int]:
        """Buckets whose stored state is not that of the landing table."""
        there = self.fingerprints(newest(self.marked(to_core(landing, self.contract)), self.contract.key))
        both = self.fingerprints(self.table(self.marked)).alias("s").join(there.alias("l"), BUCKET, "full")
        unlike = ~(F.col("s.n").eqNullSafe(F.col("l.n")) & F.col("s.mark").eqNullSafe(F.col("l.mark")))
        return sorted(r[0] for r in both.where(unlike).select(BUCKET).collect())

    def differences(self, landing: DataFrame, buckets: Iterable[int]) -> DataFrame:
        """Keys of some buckets with the copies and sequence stored and landed, where unlike."""
        wanted, key = self.bucket().isin(*buckets), list(self.contract.key)

        def told(state: DataFrame, side: str) -> DataFrame:
            rows = state.where((F.col("_is_deleted") == 0) & wanted)
            mark = F.sum(F.col(MARK).cast("decimal(38,0)"))
            return rows.groupBy(*key).agg(
                F.count(F.lit(1)).alias(f"{side}_rows"), F.max("_cdc_seq").alias(f"{side}_seq"), mark.alias(f"_{side}")
            )

        landed = newest(self.marked(to_core(landing, self.contract).where(wanted)), self.contract.key)
        both = told(self.table(self.marked), "stored").join(told(landed, "landed"), key, "full")
        unlike = ~F.col("_stored").eqNullSafe(F.col("_landed"))
        return both.where(unlike).drop("_stored", "_landed").na.fill(0, ["stored_rows", "landed_rows"])

    def rebuild(self, landing: DataFrame, buckets: Iterable[int]) -> None:
        """Derive some buckets from the landing table again, by the same projection."""
        buckets = sorted(buckets)
        if buckets:
            self.replace(to_core(landing, self.contract).where(self.bucket().isin(*buckets)), buckets, folded=False)
