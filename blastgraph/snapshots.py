"""Ingest in stages that are taken up again after a crash and brought up to date by what changed.

A folder holds tables, each written once under a name of its own, and a ledger: numbered JSON files, of which
the last whole one of this ``VERSION`` counts. A stage is entered when its table is complete, never before, so a
run that died goes on behind its last entered stage; edges are linked bucket by bucket of their sources, and
each bucket is entered by itself. A ledger of another version is as none: everything is made anew.

A run is known by what came in. Documents are compared by digest with those of the last complete run. A
package's releases, timeline and declarations come from its own documents, and an edge from those of its two
packages: only what belongs to changed, new or gone packages is parsed and resolved again, the rest is taken over.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ingest
from . import schema as S
from .functions.coordinates import package_of
from .sources import packuments
from .storage import written

VERSION = 1
#: Buckets of sources whose edges are linked and entered one after another.
BUCKETS = 4


class Ledger:
    """run: key, stages (name: path) of the run in progress; last: the same of the last complete one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.number, state = self._read()
        self.run, self.last = state.get("run"), state.get("last")

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/ledger")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _read(self) -> tuple[int, dict]:
        files, path = self._files()
        if not files.exists(path):
            return 0, {}
        names = {int(n.split(".")[0]): n for n in (f.getPath().getName() for f in files.listStatus(path))}
        for number in sorted(names, reverse=True):
            opened = files.open(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, names[number]))
            try:
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8")
            finally:
                opened.close()
            try:
                state = json.loads(text)
            except ValueError:
                continue  # it was being written when the run died
            return max(names), state if state.get("version") == VERSION else {}
        return max(names, default=0), {}

    def publish(self) -> None:
        files, path = self._files()
        self.number += 1
        out = files.create(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, f"{self.number:08d}.json"), False)
        try:
            out.write(bytearray(json.dumps({"version": VERSION, "run": self.run, "last": self.last}).encode()))
        finally:
            out.close()

    def begin(self, key: str) -> None:
        """Goes on with the run of this key, or begins it."""
        if not self.run or self.run["key"] != key:
            self.run = {"key": key, "stages": {}}
            self.publish()

    def stage(self, name: str, make) -> DataFrame:
        """The table of a stage: read where it is entered, else made, written and entered."""
        if name not in self.run["stages"]:
            path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
            made = make()
            made.write.parquet(path)
            self.run["stages"][name] = path
            self.publish()
        return self.spark.read.parquet(self.run["stages"][name])

    def before(self, name: str) -> DataFrame | None:
        """The table of a stage in the last complete run."""
        return self.spark.read.parquet(self.last["stages"][name]) if self.last else None

    def complete(self) -> None:
        self.last, self.run = self.run, None
        self.publish()


def digests(documents: DataFrame) -> DataFrame:
    """package, digest of all that is known of it."""
    each = documents.select(F.get_json_object("document", "$.name").alias("package"), F.sha2("document", 256).alias("d")).where("package <> ''")
    return each.groupBy("package").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ","), 256).alias("digest"))


def _key(*parts) -> str:
    """What a run's inputs come to, whatever order they are in."""
    return ":".join(str(p) for p in parts)


def _sum(rows: DataFrame) -> str:
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*rows.columns)).alias("x")).first()
    return f"{r.n}-{r.x}"


def refresh(
    folder: str, documents: DataFrame, services: DataFrame, files: DataFrame, advisories: DataFrame, dev_packages: DataFrame | None = None,
    versions_kept: int = S.VERSIONS_KEPT, windows_kept: int = S.WINDOWS_PER_DEPENDENCY,
) -> ingest.Ingested:
    """``ingest.build`` over a folder: the same graph and counters, from what changed since the last run.
    With other options, or development dependencies of other packages, everything counts as changed."""
    spark = documents.sparkSession
    ledger = Ledger(spark, folder)
    arrived = written(digests(documents), "digests")
    options = _key(versions_kept, windows_kept, "" if dev_packages is None else _sum(dev_packages.select("package").distinct()))
    key = _key(_sum(arrived), options)
    if ledger.last and ledger.last["key"] == key and not ledger.run:
        ledger.run = ledger.last  # nothing changed: every stage is read
    ledger.begin(key)
    if ledger.last and ledger.last["key"].split(":", 1)[1] != options:
        ledger.last = None
    ledger.stage("digests", lambda: arrived)
    old = ledger.before("digests")

    def compared() -> DataFrame:
        if old is None:
            return arrived.select("package")
        both = arrived.join(old.withColumnRenamed("digest", "before"), "package", "full")
        return both.where(~F.col("digest").eqNullSafe(F.col("before"))).select("package")

    touched = ledger.stage("touched", compared)
    named = documents.withColumn("package", F.get_json_object("document", "$.name"))
    changed = named.join(touched, "package", "left_semi").select("document")
    if any(name not in ledger.run["stages"] for name in ingest.REDUCED):
        changed = ledger.stage("documents", lambda changed=changed: packuments.opened(changed))  # each of the tables below reads them
    parsed = ingest.reduced(changed, versions_kept)
    tables = {name: ledger.stage(name, lambda name=name: _taken_over(ledger.before(name), touched, "name" if name == "packages" else "package", parsed[name])) for name in parsed}
    facts = tables["facts"] = ledger.stage("facts", lambda: ingest.facts_of(tables, dev_packages))

    again = F.col("of_source").isNotNull() | F.col("of_dependency").isNotNull()
    sources = touched.select(F.col("package").alias("source_package"), F.lit(1).alias("of_source"))
    targets = touched.select(F.col("package").alias("dependency"), F.lit(1).alias("of_dependency"))
    stale = facts.withColumn("source_package", package_of(F.col("source"))).join(sources, "source_package", "left").join(targets, "dependency", "left").where(again)
    stale = ledger.stage("stale", lambda: stale.select("source", "published_at", "dependency", "range", "kind"))
    if "windows" not in ledger.run["stages"] or "judged" not in ledger.run["stages"]:
        windows, judged = ingest.windows_of(stale, tables["timeline"])
        ledger.stage("windows", lambda: windows)
        ledger.stage("judged", lambda: _judged(ledger.before("judged"), facts, written(judged, "judged")))
    windows, tables["judged"] = ledger.stage("windows", None), ledger.stage("judged", None)
    bucket = F.pmod(F.xxhash64("source"), F.lit(BUCKETS))
    parts = [ledger.stage(f"edges-{i}", lambda i=i: ingest.linked(stale.where(bucket == i), windows, tables["releases"], windows_kept)) for i in range(BUCKETS)]

    def edges() -> DataFrame:
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        kept = ledger.before("edges")
        if kept is None:
            return out
        ends = kept.withColumn("source_package", package_of(F.col("source"))).withColumn("dependency", package_of(F.col("target")))
        still = ends.join(sources, "source_package", "left_anti").join(targets, "dependency", "left_anti")
        return still.select(*out.columns).unionByName(out)

    tables["edges"] = ledger.stage("edges", edges)
    if ledger.run is not ledger.last:
        ledger.complete()
    return ingest.assemble(tables, services, files, advisories)


def _taken_over(before: DataFrame | None, touched: DataFrame, name: str, new: DataFrame) -> DataFrame:
    """Rows of packages that didn't change, and new rows of those that did."""
    if before is None:
        return new
    return before.join(touched.withColumnRenamed("package", name), name, "left_anti").select(*new.columns).unionByName(new)


def _judged(before: DataFrame | None, facts: DataFrame, new: DataFrame) -> DataFrame:
    """Of every range that is still asked for: as it is found now, else as it was."""
    if before is None:
        return new
    asked = facts.select(F.col("dependency").alias("package"), "range").distinct()
    same = before.join(new, ["package", "range"], "left_anti").join(asked, ["package", "range"], "left_semi")
    return new.unionByName(same.select(*new.columns))
