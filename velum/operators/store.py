"""The token map of a running service: written batch by batch, read by scope, compacted now and then.

    <path>/tokens/batch_id=<k>/bucket=<b>   tokens that batch k made
    <path>/ends/batch_id=<k>/...            scopes that end before batch k (erased or expired)
    <path>/base/upto=<k>/tokens, marks      what batches up to k left: live tokens, and the
                                            largest number ever given per (scope, label)

A scope's rows lie in one bucket, the remainder of its hash, so a batch reads the buckets
of its own scopes. Nothing is changed in place: a batch that is run again writes its own
folder again and sees the state before it. Numbers are never given twice, whatever ends.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.operators.tokens import TTL_SECONDS

TOKENS = "scope string, label string, n bigint, token string, value string, created_at timestamp, batch_id bigint, bucket int"
MARKS = "scope string, label string, n bigint, bucket int"
ENDS = "scope string, reason string, batch_id bigint"


@dataclass(frozen=True)
class TokenStore:
    spark: SparkSession
    path: str
    #: Fixed when a store is first written.
    buckets: int = 64

    # ---- folders -------------------------------------------------------------

    def _fs(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, kind: str, prefix: str, done: str | None = "") -> list[int]:
        """Numbers of the finished folders of a kind (of all with ``done`` None); since the last compaction, so few."""
        place, fs = self._fs(f"{self.path}/{kind}")
        if not fs.exists(place):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(place)]
        found = [int(n.removeprefix(prefix)) for n in names if n.startswith(prefix)]
        return sorted(k for k in found if done is None or fs.exists(self._fs(f"{self.path}/{kind}/{prefix}{k}{done}/_SUCCESS")[0]))

    def _read(self, paths: list[str], schema: str, base: str, buckets: Iterable[int] | None) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", base).parquet(*paths)
        return rows if buckets is None else rows.where(F.col("bucket").isin(*buckets))

    def _base(self, before: int) -> int | None:
        # marks are written last: a base without them is not finished
        return max((k for k in self._numbers("base", "upto=", "/marks") if k < before), default=None)

    def next_batch(self) -> int:
        return max([*self._numbers("tokens", "batch_id="), *self._numbers("base", "upto=", "/marks")], default=-1) + 1

    def bucket(self, scope: Column) -> Column:
        return F.pmod(F.xxhash64(scope), F.lit(self.buckets)).cast("int")

    def buckets_of(self, rows: DataFrame, scope: str = "scope") -> list[int]:
        """Buckets that hold the scopes of ``rows``; never more than there are buckets."""
        return sorted(r[0] for r in rows.select(self.bucket(F.col(scope))).distinct().collect())

    # ---- reading ---------------------------------------------------------------

    def _since(self, before: int) -> tuple[int | None, list[str]]:
        base = self._base(before)
        fresh = [k for k in self._numbers("tokens", "batch_id=") if (base is None or k > base) and k < before]
        return base, [f"{self.path}/tokens/batch_id={k}" for k in fresh]

    def ends(self, before: int) -> DataFrame:
        """(scope, _ended): the last batch before which each ended scope ended."""
        known = [f"{self.path}/ends/batch_id={k}" for k in self._numbers("ends", "batch_id=", None) if k <= before]
        rows = self._read([f"{place}/*" for place in known], ENDS, f"{self.path}/ends", None)
        return rows.groupBy("scope").agg(F.max("batch_id").alias("_ended"))

    def live(self, before: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """Tokens that hold when batch ``before`` begins, of some buckets or all."""
        before = self.next_batch() if before is None else before
        base, fresh = self._since(before)
        rows = self._read(fresh, TOKENS, f"{self.path}/tokens", buckets)
        if base is not None:
            place = f"{self.path}/base/upto={base}/tokens"
            rows = rows.unionByName(self._read([place], TOKENS, place, buckets))
        rows = rows.join(self.ends(before), "scope", "left")
        return rows.where(F.col("_ended").isNull() | (F.col("batch_id") >= F.col("_ended"))).drop("_ended")

    def marks(self, before: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """(scope, label, n): the largest number ever given, of ended scopes too."""
        before = self.next_batch() if before is None else before
        base, fresh = self._since(before)
        columns = ["scope", "label", "n", "bucket"]
        rows = self._read(fresh, TOKENS, f"{self.path}/tokens", buckets).select(*columns)
        if base is not None:
            place = f"{self.path}/base/upto={base}/marks"
            rows = rows.unionByName(self._read([place], MARKS, place, buckets).select(*columns))
        return rows.groupBy("scope", "label", "bucket").agg(F.max("n").alias("n"))

    # ---- writing ---------------------------------------------------------------

    def append(self, batch_id: int, token_map: DataFrame, created_at: Column | None = None) -> None:
        """The tokens a batch made (scope, label, n, token, value); the batch's own folder is replaced."""
        at = F.current_timestamp() if created_at is None else created_at
        rows = token_map.select("scope", "label", "n", "token", "value", at.alias("created_at"), self.bucket(F.col("scope")).alias("bucket"))
        # a hot scope fills a bucket: rebalancing cuts it into several files
        rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/tokens/batch_id={batch_id}")

    def _end(self, batch_id: int, scopes: DataFrame, reason: str) -> None:
        # a folder of its own for every call: ends only add up
        place = f"{self.path}/ends/batch_id={batch_id}/{reason}-{uuid.uuid4().hex}"
        scopes.select("scope", F.lit(reason).alias("reason")).distinct().write.parquet(place)

    def erase(self, scopes: Iterable[str], before: int | None = None) -> None:
        """Forget the values of the named scopes from batch ``before`` on (default: the next one)."""
        rows = self.spark.createDataFrame([(s,) for s in scopes], "scope string")
        self._end(self.next_batch() if before is None else before, rows, "erased")

    def expire(self, now: Column, ttl_seconds: int = TTL_SECONDS, before: int | None = None) -> None:
        """End every scope whose last new token is older than its lifetime."""
        before = self.next_batch() if before is None else before
        last = self.live(before).groupBy("scope").agg(F.max("created_at").alias("last"))
        old = last.where(F.col("last") + F.expr(f"interval {ttl_seconds} seconds") <= now)
        self._end(before, old, "expired")

    def compact(self, upto: int) -> None:
        """Fold batches up to ``upto`` into a new base: ended values leave it, numbers stay."""
        place = f"{self.path}/base/upto={upto}"
        live, marks = self.live(upto + 1), self.marks(upto + 1)
        live.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{place}/tokens")
        marks.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{place}/marks")

    def vacuum(self) -> None:
        """Delete what the newest base has taken over: earlier bases, batches and ends.

        Values that ended before the base was written are gone then. A batch that is run
        again must come after the base, as the last batch of a stream does.
        """
        base = self._base(1 << 62)
        if base is None:
            return
        # ends of the batch after the base may be younger than it, so they stay
        old = [f"tokens/batch_id={k}" for k in self._numbers("tokens", "batch_id=") if k <= base]
        old += [f"ends/batch_id={k}" for k in self._numbers("ends", "batch_id=", None) if k <= base]
        old += [f"base/upto={k}" for k in self._numbers("base", "upto=", "/marks") if k < base]
        for name in old:
            place, fs = self._fs(f"{self.path}/{name}")
            fs.delete(place, True)
