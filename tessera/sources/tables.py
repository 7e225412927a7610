"""Parquet tables in versions, replaced one partition at a time.

    <table>/_current                       the name of the version that readers see
    <table>/_versions/v=<name>             its manifest: each partition and the version that wrote it
    <table>/data/v=<name>/<partitions>     what a version wrote, never changed afterwards

A write adds the new content of the touched partitions as a version of its own, then a manifest that points to it and, for
all other partitions, to the versions that hold them; at last one rename makes the manifest current. So a reader sees a table
wholly before or wholly after a write, a write that fails leaves no trace but unread files, and nothing untouched is read or
written again. Readers name the partitions they need and open no others. One writer at a time is assumed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera import schemas
from tessera.functions.tenant import branch_or_main, tenant_prefix

CHUNK_PARTITIONS = ["tenant", "p_repo", "p_branch"]
NODE_PARTITIONS = ["tenant", "p_repo", "p_label"]
EDGE_PARTITIONS = ["tenant", "p_repo", "p_rel"]


def with_chunk_partitions(chunks: DataFrame) -> DataFrame:
    return chunks.withColumns({
        "tenant": tenant_prefix(F.col("user_id"), F.col("is_public")),
        "p_repo": F.col("repo"),
        "p_branch": branch_or_main(F.col("branch")),
    })


def with_node_partitions(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns({
        "tenant": tenant_prefix(F.col("user_id"), F.col("is_public")), "p_repo": F.coalesce("repo", F.lit("-")), "p_label": F.col("label"),
    })


def _edge_repo(src: Column) -> Column:
    """The repository in a scoped id (tenant, repository, branch, ...); an id without a branch belongs to none."""
    parts = F.split(src, "::")
    return F.when(F.size(parts) > 2, parts[1]).otherwise("-")


def with_edge_partitions(edges: DataFrame) -> DataFrame:
    return edges.withColumns({
        "tenant": F.substring_index(F.col("src"), "::", 1), "p_repo": _edge_repo(F.col("src")), "p_rel": F.col("rel_type"),
    })


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def current_version(spark: SparkSession, path: str) -> str | None:
    """The version that readers see now; None before the first write."""
    files, where = _hadoop(spark, f"{path.rstrip('/')}/_current")
    if not files.exists(where):
        return None
    stream = files.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def _point(spark: SparkSession, path: str, version: str) -> None:
    """Makes a version current, by one rename."""
    files, ready = _hadoop(spark, f"{path}/_current-{version}")
    stream = files.create(ready, True)
    stream.write(bytearray(version, "utf-8"))
    stream.close()
    jvm = spark._jvm
    options = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    whole = files.makeQualified(ready)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), spark._jsc.hadoopConfiguration()).rename(
        whole, files.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{path}/_current")), options)


def manifest(spark: SparkSession, path: str, partitions: list[str], version: str | None = None) -> DataFrame:
    """(*partitions, version): a row for each partition that the table has."""
    path, ddl = path.rstrip("/"), ", ".join(f"{p} string" for p in [*partitions, "version"])
    version = version or current_version(spark, path)
    return spark.createDataFrame([], ddl) if version is None else spark.read.schema(ddl).parquet(f"{path}/_versions/v={version}")


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    """A frame without rows that plans see as such, so joins with it fall away."""
    return spark.createDataFrame([], ddl).where(F.lit(False))


def read_table(spark: SparkSession, path: str, ddl: str, only: DataFrame | None = None, partitions: list[str] | None = None) -> DataFrame:
    """The table as it stands, or an empty frame of the same layout before the first write.

    `only` holds some of the partition columns (named by `partitions`): other partitions are not opened. What comes to the
    driver is the list of the folders to open, one for each partition that is read, as in any scan of a partitioned table.
    """
    path, version = path.rstrip("/"), current_version(spark, path)
    if version is None:
        return empty(spark, ddl)
    partitions = partitions or _stored_partitions(spark, path, version)
    wanted = manifest(spark, path, partitions, version)
    if only is not None:
        keys = [p for p in partitions if p in only.columns]
        wanted = wanted.join(only.select(*keys).distinct(), keys, "left_semi")
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    folders = ["/".join([f"{path}/data/v={r['version']}", *(escape(p, r[p]) for p in partitions)]) for r in wanted.toLocalIterator()]
    if not folders:
        return empty(spark, ddl)
    layout = ddl + "".join(f", {p} string" for p in ["v", *partitions])
    return spark.read.schema(layout).option("basePath", f"{path}/data").parquet(*folders).select(*StructType.fromDDL(ddl).fieldNames())


def _stored_partitions(spark: SparkSession, path: str, version: str) -> list[str]:
    return [c for c in spark.read.parquet(f"{path}/_versions/v={version}").columns if c != "version"]


def replace_partitions(new_content: DataFrame, path: str, partitions: list[str], touched: DataFrame) -> None:
    """Write the complete new content of the partitions named by `touched` and those that occur in `new_content`.

    Partitions of `touched` that nothing replaces are gone in the new version. The rebalance hint sizes output files and splits
    a hot partition over several tasks.
    """
    spark, path, version = new_content.sparkSession, path.rstrip("/"), uuid.uuid4().hex
    old = manifest(spark, path, partitions)
    data = f"{path}/data/v={version}"
    new_content.hint("rebalance", *partitions).write.partitionBy(*partitions).parquet(data)
    written = _written(spark, data, partitions, version)
    keys = touched.select(*partitions).unionByName(written.select(*partitions)).distinct()
    rows = old.join(keys, partitions, "left_anti").select(*partitions, "version").unionByName(written)
    rows.write.parquet(f"{path}/_versions/v={version}")
    _point(spark, path, version)


def _written(spark: SparkSession, data: str, partitions: list[str], version: str) -> DataFrame:
    """The partitions below a folder, from its folder names alone."""
    ddl = ", ".join(f"{p} string" for p in [*partitions, "version"])
    files, where = _hadoop(spark, data)
    unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    level = [(where, ())]
    for name in partitions:
        level = [(s.getPath(), (*held, unescape(s.getPath().getName().split("=", 1)[1]))) for at, held in level for s in files.listStatus(at) if s.getPath().getName().startswith(f"{name}=")]
    return spark.createDataFrame([(*held, version) for _, held in level], ddl)


def vacuum(spark: SparkSession, path: str) -> None:
    """Deletes the files that the current version does not use. Readers that opened an older version must be done."""
    path, version = path.rstrip("/"), current_version(spark, path)
    if version is None:
        return
    used = {r["version"] for r in spark.read.parquet(f"{path}/_versions/v={version}").select("version").distinct().collect()}
    for below, stay in (("data", used), ("_versions", {version})):
        files, where = _hadoop(spark, f"{path}/{below}")
        for found in files.listStatus(where) if files.exists(where) else []:
            if found.getPath().getName().removeprefix("v=") not in stay:
                files.delete(found.getPath(), True)


def spread_small(scan: DataFrame) -> DataFrame:
    """A scan with fewer splits than there are cores, spread over the cores for per-row work that costs
    more than moving the rows.  A scan with enough splits stays as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def drop_all(spark: SparkSession, path: str, ddl: str, partitions: list[str]) -> None:
    """Full reset: an explicit call whose version of the table holds nothing."""
    path, version = path.rstrip("/"), uuid.uuid4().hex
    spark.createDataFrame([], ", ".join(f"{p} string" for p in [*partitions, "version"])).write.parquet(f"{path}/_versions/v={version}")
    _point(spark, path, version)


def write_chunks(chunks: DataFrame, path: str, before: DataFrame | None = None) -> None:
    """Replace the (tenant, repository, branch) partitions of `before`, the rows they replace, by those of `chunks`.

    Without `before` the whole table as it stands is replaced.
    """
    _write(chunks, path, before, schemas.CHUNKS, CHUNK_PARTITIONS, with_chunk_partitions)


def write_nodes(nodes: DataFrame, path: str, before: DataFrame | None = None) -> None:
    _write(nodes, path, before, schemas.NODES, NODE_PARTITIONS, with_node_partitions)


def write_edges(edges: DataFrame, path: str, before: DataFrame | None = None) -> None:
    _write(edges, path, before, schemas.EDGES, EDGE_PARTITIONS, with_edge_partitions)


def _write(rows: DataFrame, path: str, before: DataFrame | None, ddl: str, partitions: list[str], place) -> None:
    old = manifest(rows.sparkSession, path, partitions) if before is None else place(before)
    replace_partitions(place(rows), path, partitions, old)


def merge_chunks(spark: SparkSession, path: str, touched: DataFrame, merge) -> None:
    """Rewrite the (tenant, repository, branch) partitions of `touched` (columns user_id, is_public, repo, branch): `merge`
    maps their rows to the new ones. Other partitions are neither read nor written."""
    keys = with_chunk_partitions(touched).select(*CHUNK_PARTITIONS).distinct()
    held = read_table(spark, path, schemas.CHUNKS, keys, CHUNK_PARTITIONS)
    replace_partitions(with_chunk_partitions(merge(held)), path, CHUNK_PARTITIONS, keys)
