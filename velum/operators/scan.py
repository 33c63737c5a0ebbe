"""A discovery scan over many tables that can be stopped and taken up again.

Every table is one job: its columns are profiled in one pass, and its proposals are written
to a folder of its own, which a repeated job replaces. The ledger has one row for every
attempt; a table that it calls done is not read again.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.operators.columns import Classifier, label_profiles, labelled_places, profile_catalog, scan_summary, scan_to_kb
from velum.operators.kb import kb_upsert, new_rows

LEDGER = "db string, table string, status string, n_columns long, last_column string, problem string, at_us long"
PROPOSALS = (
    "db string, table string, column string, sql_type string, n_values long, strategy string, label string, "
    "confidence double, status string, regex string"
)
#: Characters of a reason that are kept.
LONGEST_PROBLEM = 500

#: A table, or what opens it; opened only when its turn comes.
Source = DataFrame | Callable[[], DataFrame]


class Scan:
    """A scan whose ledger and proposals are in folder ``path``, which outlives the session."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self, path: str) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def _folder(self, db: str | None, table: str) -> str:
        return os.path.join(self.path, "proposals", hashlib.sha256(json.dumps([db, table]).encode()).hexdigest())

    def ledger(self) -> DataFrame:
        """One row an attempt: db, table, status (done or failed), n_columns, last_column, problem, at_us."""
        path = os.path.join(self.path, "ledger")
        if not self._exists(path):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(path)

    def progress(self) -> DataFrame:
        """The last attempt of every table; once done, a table stays done."""
        order = F.struct(F.col("status") == "done", "at_us")
        last = self.ledger().groupBy("db", "table").agg(F.max_by(F.struct("status", "n_columns", "last_column", "problem", "at_us"), order).alias("l"))
        return last.select("db", "table", "l.*")

    def proposals(self) -> DataFrame:
        """Label proposals of all tables done; what a stopped job left half written is not among them."""
        done = self.progress().where("status = 'done'").select("db", "table").collect()  # one row a table
        if not done:
            return self.spark.createDataFrame([], PROPOSALS)
        return self.spark.read.schema(PROPOSALS).parquet(*[self._folder(r["db"], r["table"]) for r in done])

    def summary(self, inventory: DataFrame, db: str | None) -> DataFrame:
        """Totals so far against ``inventory`` (table, column), and the last place reached; running until all its tables are done."""
        done = self.progress().where(F.col("db").eqNullSafe(F.lit(db)) & (F.col("status") == "done")).select("table")
        reached = inventory.select("table", "column").join(done, "table", "left_semi")
        found = scan_summary(self.proposals().where(F.col("db").eqNullSafe(F.lit(db))), reached)
        whole = inventory.agg(F.count("*").alias("n"))
        state = F.when(F.col("total_cols") < F.col("n"), "running").otherwise("done")
        return found.crossJoin(whole).select(  # one row each
            state.alias("status"), F.col("n").alias("total_cols"), "sampled_cols", "found_labels", "last_table", "last_column"
        )

    def _note(self, *entry) -> None:
        # a folder an attempt: tables scanned side by side do not share one to commit to
        row = self.spark.createDataFrame([(*entry, time.time_ns() // 1000)], LEDGER)
        row.coalesce(1).write.parquet(os.path.join(self.path, "ledger", uuid.uuid4().hex))

    def _one(self, name: str, source: Source, db: str | None, kb: DataFrame | None, threshold: float, classifier: Classifier | None) -> None:
        try:
            df = source if isinstance(source, DataFrame) else source()
            skip = labelled_places({name: df}, db, kb)
            if all((name, c) in skip for c in df.columns):
                rows = self.spark.createDataFrame([], PROPOSALS)
            else:
                rows = label_profiles(profile_catalog({name: df}, db, skip), threshold, classifier)
                rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in self.spark.createDataFrame([], PROPOSALS).schema])
            rows.write.mode("overwrite").parquet(self._folder(db, name))
        except (PySparkException, Py4JError) as error:
            self._note(db, name, "failed", None, None, str(error).strip()[:LONGEST_PROBLEM])
        else:
            self._note(db, name, "done", len(df.columns), max(df.columns, default=None), None)

    def run(
        self, tables: Mapping[str, Source], db: str | None, kb: DataFrame | None = None, threshold: float = 0.7,
        classifier: Classifier | None = None, most: int | None = None, at_once: int = 2,
    ) -> DataFrame:
        """Scan the tables not done yet, by name, ``at_once`` side by side; ``most`` is how many this call takes. Returns progress().

        A table that cannot be opened or read is noted as failed with the reason, and is tried
        again by the next call; the others go on. Anything else that goes wrong, in a
        classifier say, ends the call; what was done by then stays done. Columns with an
        active label for this place are not read.
        """
        done = {r["table"] for r in self.progress().where(F.col("db").eqNullSafe(F.lit(db)) & (F.col("status") == "done")).select("table").collect()}
        left = [name for name in sorted(tables) if name not in done][:most]
        with ThreadPoolExecutor(max(1, at_once)) as pool:
            for job in [pool.submit(self._one, name, tables[name], db, kb, threshold, classifier) for name in left]:
                job.result()
        return self.progress()

    def into_kb(self, kb: DataFrame) -> DataFrame:
        """``kb`` with the labels found so far; the same again when it is repeated, as rows are matched by their key."""
        found = scan_to_kb(self.proposals())
        rows = new_rows(found)
        return kb_upsert(kb, rows)
