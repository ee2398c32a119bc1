"""A collection of documents that grows by batches, each of which is visible as a whole or not at all.

A batch is written below a folder of its own attempt, where no reader looks; one small manifest, put under the next
version's number only if nothing is there, then makes all its tables visible at once. An attempt that fails before
leaves nothing to read and its folder is removed. Two drivers that write at once cannot both take a number: the
later one takes the numbers of its documents anew and tries the next version. A batch has a key, and a key that has been
committed is not committed again, so a repeated batch (a retry, a stream's batch after a crash) adds nothing.

Rows stay where they were written: a document that a later batch replaces or deletes is superseded by its id when it is
read, so that no batch reads documents that it does not bring itself.

Putting a manifest is a rename that fails where the target is; that is atomic on HDFS and the like. On a local folder it is a
check followed by a rename, enough for one driver, as in tests.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.numbering import numbered

Derive = Callable[[DataFrame], dict[str, DataFrame]]
_MANIFEST = "version int, batch string, attempt string, replaces boolean, last_number long, tables array<string>"
_TOUCHED = "_touched"


class IngestError(Exception):
    """A batch that was not taken: the stage at which it failed, and why."""

    def __init__(self, stage: str, why: object):
        super().__init__(f"ingestion failed at stage {stage}: {why}")
        self.stage = stage


class Committed(NamedTuple):
    version: int
    fresh: bool  # False if the batch had been committed before


class Collection:
    """Tables of documents below ``folder``; each has a document_id."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        conf = spark._jsc.hadoopConfiguration()
        self._files = self._path(self.folder).getFileSystem(conf)
        root = self._files.makeQualified(self._path(self.folder))
        self._context = hadoop.FileContext.getFileContext(root.toUri(), conf)
        self._files.mkdirs(self._path(f"{self.folder}/manifest"))

    # manifests: a row per batch

    def history(self) -> list:
        """The manifests by version."""
        return self.spark.read.schema(_MANIFEST).json(f"{self.folder}/manifest").orderBy("version").collect()

    def _put_if_absent(self, version: int, manifest: dict) -> bool:
        options = getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        none = self.spark.sparkContext._gateway.new_array(options, 1)
        none[0] = options.NONE
        draft = self._path(f"{self.folder}/manifest/.{uuid.uuid4().hex}")
        out = self._files.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            self._context.rename(self._files.makeQualified(draft), self._files.makeQualified(self._path(f"{self.folder}/manifest/{version:09d}.json")), none)
        except Py4JJavaError as e:
            self._files.delete(draft, False)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    # reading

    def table(self, name: str, schema: StructType | None = None, version: int | None = None) -> DataFrame:
        """The visible rows of a table, as of ``version`` (the latest): those of each document's latest batch.

        ``schema`` is needed only while no batch has brought that table."""
        known = [m for m in self.history() if version is None or m["version"] <= version]
        holding = [m for m in known if name in m["tables"]]
        if not holding:
            if schema is None:
                raise ValueError(f"no batch has brought {name!r}; give its schema")
            return self.spark.createDataFrame([], schema)
        rows = self._rows(holding, name)
        replacing = [m for m in known if m["replaces"]]
        if replacing:
            newest = self._rows(replacing, _TOUCHED).groupBy("document_id").agg(F.max("_version").alias("_newest"))
            rows = rows.join(newest, "document_id", "left").filter(F.col("_newest").isNull() | (F.col("_version") >= F.col("_newest")))
        return rows.select(*(c for c in self._rows(holding, name).columns if c != "_version"))

    def _rows(self, manifests: list, name: str) -> DataFrame:
        versions = F.create_map(*(F.lit(x) for m in manifests for x in (m["attempt"], m["version"])))
        rows = self.spark.read.parquet(*(f"{self.folder}/attempts/{m['attempt']}/{name}" for m in manifests))
        return rows.withColumn("_version", F.element_at(versions, F.col("_attempt"))).drop("_attempt")

    # writing

    def ingest(self, batch: str, files: DataFrame, refuse: Column, derive: Derive) -> Committed:
        """New documents from ``files`` (filename and whatever ``derive`` reads): numbers after the greatest one, in order of names.

        One file for which ``refuse`` names a reason refuses the batch. Tables: ``documents`` and those that ``derive`` makes of it."""
        bad = {r["why"]: r["n"] for r in files.select(refuse.alias("why")).filter("why IS NOT NULL").groupBy("why").agg(F.count(F.lit(1)).alias("n")).collect()}
        if bad:
            raise IngestError("VALIDATING", bad)

        def numbers(last: int) -> DataFrame:
            n = numbered(files, "filename", name="_n").withColumn("number", F.col("_n") + last).drop("_n")
            return n.withColumn("document_id", F.format_string("doc_%02d", "number"))

        return self._commit(batch, numbers, derive, replaces=False)

    def replace(self, batch: str, documents: DataFrame, derive: Derive, newest: str | None = None) -> Committed:
        """Documents under their own document_id, new or in place of what they had; only they are read and derived from.

        Of rows that share an id that with the greatest ``newest`` holds; without it they refuse the batch, as null ids do."""
        if newest is not None:
            documents = documents.groupBy("document_id").agg(F.max_by(F.struct(*(c for c in documents.columns if c != "document_id")), newest).alias("d")).select("document_id", "d.*")
        bad = documents.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR document_id IS NULL").limit(3).collect()
        if bad:
            raise IngestError("VALIDATING", [r["document_id"] for r in bad])
        return self._commit(batch, lambda last: documents, derive, replaces=True)

    def delete(self, batch: str, ids: DataFrame) -> Committed:
        """Documents (document_id) that go from all tables."""
        return self._commit(batch, lambda last: ids.select("document_id").distinct(), None, replaces=True)

    def _commit(self, batch: str, numbers: Callable[[int], DataFrame], derive: Derive | None, replaces: bool) -> Committed:
        while True:
            known = self.history()
            done = [m["version"] for m in known if m["batch"] == batch]
            if done:
                return Committed(done[0], False)
            version, last = len(known) + 1, max((m["last_number"] for m in known), default=0)
            attempt, stage = f"{version:09d}-{uuid.uuid4().hex}", "WRITING documents"
            folder = f"{self.folder}/attempts/{attempt}"
            try:
                documents = self._write(numbers(last), folder, "documents" if derive else _TOUCHED, attempt)
                tables = ["documents"] if derive else []
                stage = "DERIVING"
                for name, rows in derive(documents).items() if derive else ():
                    stage = f"WRITING {name}"
                    self._write(rows, folder, name, attempt)
                    tables.append(name)
                if replaces and derive:
                    self._write(documents.select("document_id"), folder, _TOUCHED, attempt)
                if not replaces:
                    last = documents.agg(F.max("number").alias("n")).collect()[0]["n"] or last
                stage = "PUBLISHING"
                if self._put_if_absent(version, {"version": version, "batch": batch, "attempt": attempt, "replaces": replaces, "last_number": last, "tables": tables}):
                    return Committed(version, True)
            except Exception as e:
                if stage != "PUBLISHING":  # there the manifest may have arrived before the error did
                    self._files.delete(self._path(folder), True)
                raise IngestError(stage, e) from e
            self._files.delete(self._path(folder), True)  # another driver was first: its documents have these numbers

    def _write(self, rows: DataFrame, folder: str, name: str, attempt: str) -> DataFrame:
        rows.withColumn("_attempt", F.lit(attempt)).write.parquet(f"{folder}/{name}")
        return self.spark.read.parquet(f"{folder}/{name}").drop("_attempt")
