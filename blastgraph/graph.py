"""The property graph as typed tables, one for each label and relationship."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .functions.coordinates import package_of
from .operators import edges as E
from .operators import traverse as T
from .storage import written


DEPENDENCIES = "source string, target string, range string, resolved_to string, kind string, valid_from long, valid_to long, rel_type string"


@dataclass
class Graph:
    """packages(name, ecosystem, first_published), releases(key, package, version, published_at,
    integrity, deprecated), maintainers(username, ecosystem, email), services(name, repo,
    criticality), lockfiles(key, path, service, committed_at), advisories(osv_id, severity,
    published_at, summary, cwe, aliases); can_publish(maintainer, package), published(maintainer,
    release, at), pins(source, target, package, version, direct), dependencies(rel_type, source,
    target, range, resolved_to, kind, valid_from, valid_to), affects(osv_id, target, package,
    version, introduced, fixed_in, range_source)."""

    packages: DataFrame
    releases: DataFrame
    maintainers: DataFrame
    services: DataFrame
    lockfiles: DataFrame
    advisories: DataFrame
    can_publish: DataFrame
    published: DataFrame
    pins: DataFrame
    dependencies: DataFrame
    affects: DataFrame

    def save(self, folder: str) -> None:
        """A snapshot as Parquet; dependencies lie in a folder for each type, so a query on one
        type reads that alone."""
        for f in fields(self):
            table = getattr(self, f.name)
            writer = table.repartition("target").sortWithinPartitions("target").write if f.name == "dependencies" else table.write
            (writer.partitionBy("rel_type") if f.name == "dependencies" else writer).mode("overwrite").parquet(f"{folder}/{f.name}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Graph:
        """A snapshot of ``save``. Dependencies have no files where there are none, so their columns are named here."""
        typed = spark.read.schema(DEPENDENCIES)
        return cls(**{f.name: (typed if f.name == "dependencies" else spark.read).parquet(f"{folder}/{f.name}") for f in fields(cls)})

    def loops(self) -> DataFrame:
        """package of those that may lie on a cycle of dependencies; found once."""
        if "_loops" not in self.__dict__:
            self.__dict__["_loops"] = written(T.looping(self.links()), "loops")
        return self.__dict__["_loops"]

    def leading(self, targets: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
        """The dependencies that chains of at most ``hops`` of them to the targets can be made of, and the links between their
        packages. Which packages are near enough is found over links, which are far fewer: all dependencies are read once, not at
        every hop. targets: key."""
        near = T.near_packages(targets, self.links(), hops)
        led = self.dependencies.join(near, package_of(F.col("target")) == F.col("package"), "left_semi")
        return written(led, "leading"), written(T.linked_to(self.links(), near), "leading-links")

    def links(self) -> DataFrame:
        """``package_links`` of the dependencies; found once."""
        if "_links" not in self.__dict__:
            self.__dict__["_links"] = T.package_links(self.dependencies)
        return self.__dict__["_links"]

    def dependents(self) -> DataFrame:
        return E.dependent_counts(self.dependencies, self.packages)


def census(graph: Graph) -> DataFrame:
    """label, n for every kind of vertex."""
    tables = zip(S.LABELS, (graph.packages, graph.releases, graph.maintainers, graph.services, graph.lockfiles, graph.advisories))
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("label"), "n") for label, t in tables]
    return reduce(DataFrame.unionByName, parts)


def census_edges(graph: Graph) -> DataFrame:
    """rel_type, n for every relationship, those without edges included."""

    def counted(rel: str, table: DataFrame) -> DataFrame:
        return table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rel).alias("rel_type"), "n")

    deps = graph.dependencies
    parts = [
        counted(S.VERSION_OF, graph.releases), counted(S.DEPENDS_ON, deps.where(F.col("rel_type") == S.DEPENDS_ON)),
        counted(S.DEV_DEPENDS_ON, deps.where(F.col("rel_type") == S.DEV_DEPENDS_ON)), counted(S.CAN_PUBLISH, graph.can_publish),
        counted(S.PUBLISHED, graph.published), counted(S.USES_LOCKFILE, graph.lockfiles), counted(S.PINS, graph.pins),
        counted(S.AFFECTS, graph.affects),
    ]
    return reduce(DataFrame.unionByName, parts)


def census_totals(graph: Graph, with_edges: bool = True) -> DataFrame:
    """One row: vertices, edges (null where they aren't asked for), is_empty, counted_everything."""
    vertices = census(graph).agg(F.sum("n").alias("vertices"))
    edges = census_edges(graph).agg(F.sum("n").alias("edges")) if with_edges else vertices.select(F.lit(None).cast("bigint").alias("edges"))
    both = vertices.crossJoin(edges)  # two single rows
    return both.withColumn("is_empty", F.col("vertices") == 0).withColumn("counted_everything", F.col("edges").isNotNull())
