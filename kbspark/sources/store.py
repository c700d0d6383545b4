"""Versioned chunk store: copy-on-write upserts by tenant and system, vectors, and cells of near vectors.

``data/folder=N/tenant_code=T/system_type=S`` holds the rows that version N wrote for T and S. A manifest, one file for each version, names the folder
that is live for every tenant and system; writing it is the commit. Readers take one manifest, so they see one version while the next is written.

Within a tenant and system, vectors are ordered by their nearest anchor and cut into cells; ``cells`` holds each cell's centre, radius and size.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.session import cut_lineage
from kbspark.sources.sinks import embed

#: Rows of a cell at most, and vectors that rows are ordered by (the sample's documented bound).
CELL_ROWS, ANCHORS = 2048, 64
CELLS = "tenant_code string, system_type string, cell string, dim int, n bigint, center array<double>, radius double"
#: Columns that the store adds to those of the rows.
OWN = ("text_id", "digest", "cell", "embedding")


def unit_rows(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


class ChunkStore:
    """Rows by ``chunk_id`` with tenant_code, system_type, chunk_type (FINE or COARSE), content, and any other columns."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- versions ---

    def _manifests(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("version bigint, tenant_code string, system_type string, folder bigint, fields string").parquet(f"{self.path}/manifest")
        except AnalysisException:
            return None

    def version(self) -> int:
        """Number of the last committed version, 0 for an empty store."""
        m = self._manifests()
        return 0 if m is None else m.agg(F.max("version")).first()[0] or 0

    def live(self, version: int | None = None) -> list[tuple[str | None, str | None, int]]:
        """(tenant, system, folder) of a version: one row for each tenant and system that has rows."""
        version = self.version() if version is None else version
        return [] if not version else [tuple(r) for r in self._manifests().filter(F.col("version") == version).filter("folder IS NOT NULL")
                                       .select("tenant_code", "system_type", "folder").collect()]

    def _fields(self, version: int) -> T.StructType:
        return T.StructType.fromJson(json.loads(self._manifests().filter(F.col("version") == version).first()["fields"]))

    def _read(self, part: str, schema: T.StructType, version: int, tenants: Sequence[str] | None, systems: Sequence[str] | None) -> DataFrame:
        live = [x for x in self.live(version) if (tenants is None or x[0] in tenants) and (systems is None or x[1] in systems)]
        if not live:
            return self.spark.createDataFrame([], schema)
        whole = T.StructType([*schema.fields, T.StructField("folder", T.LongType())])
        one = [(F.col("folder") == f) & F.col("tenant_code").eqNullSafe(t) & F.col("system_type").eqNullSafe(s) for t, s, f in live]
        return self.spark.read.schema(whole).parquet(f"{self.path}/{part}").filter(reduce(Column.__or__, one)).drop("folder")

    def read(self, version: int | None = None, tenants: Sequence[str] | None = None, systems: Sequence[str] | None = None) -> DataFrame:
        """Rows of one version, of some tenants and systems where given; other folders are not read."""
        version = self.version() if version is None else version
        if not version:
            raise ValueError("the store is empty")
        return self._read("data", self._fields(version), version, tenants, systems)

    def cells(self, version: int | None = None, tenants: Sequence[str] | None = None, systems: Sequence[str] | None = None) -> DataFrame:
        """Cells of near vectors: centre (unit), radius (greatest angle to it) and number of vectors."""
        version = self.version() if version is None else version
        return self._read("cells", T.StructType.fromDDL(CELLS), version, tenants, systems)

    # --- writing ---

    def upsert(self, rows: DataFrame, embedder: Callable[[list[str]], list[list[float]]] | None = None, batch: int = 16) -> int:
        """New version with ``rows``: fine rows replace those of their id, coarse rows are only added. Returns its number, or the present one if nothing changes.

        Rows with a vector in ``embedding`` keep it. Other fine rows keep the stored vector while their text is the same, and else get one from ``embedder``, called
        with ``batch`` texts at a time. Of several rows of one id one is taken, by its content. Rows without id are an error. A tenant and system that
        nothing changes keeps its folder; those that rows come to, or leave, are written anew. Two writers of one version: the second one fails.
        """
        version = self.version()
        if "embedding" not in rows.columns:
            rows = rows.withColumn("embedding", F.lit(None).cast("array<float>"))
        names = sorted(c for c in rows.columns if c not in OWN)
        rows = (rows.withColumn("chunk_id", F.coalesce("chunk_id", F.raise_error(F.lit("a chunk has no id")).cast("string")))
                .withColumn("text_id", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256)).withColumn("embedding", F.col("embedding").cast("array<float>")))
        rows = rows.withColumn("digest", F.sha2(F.to_json(F.struct(*names, "embedding"), {"ignoreNullFields": "false"}).cast("binary"), 256))
        whole = [*names, "embedding", "text_id", "digest"]
        rows = rows.groupBy("chunk_id").agg(F.max_by(F.struct(*whole), "digest").alias("r")).select("r.*")
        if not version:
            changed, kept = cut_lineage(rows), None
        else:
            rows = cut_lineage(rows)
            was = self.read(version).select("chunk_id", F.col("digest").alias("old_digest"), F.col("text_id").alias("old_text"), F.col("tenant_code").alias("old_tenant"),
                                            F.col("system_type").alias("old_system"))
            found = rows.join(was, "chunk_id", "left")
            changed = cut_lineage(found.filter(F.col("old_digest").isNull() | ((F.col("chunk_type") == "FINE") & (F.col("old_digest") != F.col("digest")))))
        ends = changed.select("tenant_code", "system_type")
        if version:
            ends = ends.unionByName(changed.filter("old_digest IS NOT NULL").select(F.col("old_tenant").alias("tenant_code"), F.col("old_system").alias("system_type")))
        touched = {tuple(r) for r in ends.distinct().collect()}  # one row for each tenant and system
        if not touched:
            return version
        if version:
            before = self.read(version)
            here = reduce(Column.__or__, [F.col("tenant_code").eqNullSafe(t) & F.col("system_type").eqNullSafe(s) for t, s in touched])
            kept = before.filter(here).join(changed.select("chunk_id"), "chunk_id", "left_anti").drop("cell")
            same = changed.filter((F.col("old_text") == F.col("text_id")) & F.col("embedding").isNull()).select("chunk_id")
            stored = before.select("chunk_id", F.col("embedding").alias("stored")).join(same, "chunk_id", "left_semi")
            changed = (changed.join(stored, "chunk_id", "left").withColumn("embedding", F.coalesce("embedding", "stored"))
                       .drop("stored", "old_digest", "old_text", "old_tenant", "old_system"))
        if embedder is not None:
            missing = F.col("embedding").isNull() & (F.col("chunk_type") == "FINE")
            changed = changed.filter(~missing).unionByName(embed(changed.filter(missing), embedder, batch=batch).select(*changed.columns))
        new = changed if kept is None else kept.unionByName(changed, allowMissingColumns=True)
        fields = T.StructType([f for f in new.schema.fields if f.name not in ("tenant_code", "system_type")] +
                              [T.StructField(c, T.StringType()) for c in ("cell", "tenant_code", "system_type")])
        self._write(new.withColumns({c: F.col(c).cast("string") for c in ("tenant_code", "system_type")}), fields, version + 1)
        rest = [(t, s, f) for t, s, f in self.live(version) if (t, s) not in touched]
        filled = self._folder("data", fields, version + 1).select("tenant_code", "system_type").distinct().collect()
        self._commit(version + 1, rest + [(r[0], r[1], version + 1) for r in filled], fields)
        return version + 1

    def _folder(self, part: str, schema: T.StructType, folder: int) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part}/folder={folder}")

    def _commit(self, version: int, live: list[tuple], fields: T.StructType) -> None:
        text = json.dumps(fields.jsonValue())
        rows = [(t, s, f, text) for t, s, f in live] or [(None, None, None, text)]
        (self.spark.createDataFrame(rows, "tenant_code string, system_type string, folder bigint, fields string").coalesce(1)
         .write.mode("error").parquet(f"{self.path}/manifest/version={version}"))

    def _write(self, rows: DataFrame, fields: T.StructType, folder: int) -> None:
        rows = cut_lineage(rows)
        usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
        sample = rows.filter(usable).select("chunk_id", "embedding").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(ANCHORS).collect()
        by_dim: dict[int, list] = {}
        for r in sample:
            by_dim.setdefault(len(r["embedding"]), []).append(r["embedding"])
        anchors = {d: unit_rows(np.array(v, np.float64)) for d, v in by_dim.items()}

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Number of the nearest anchor of the vector's dimension; -1 for rows without a usable vector."""
            for b in batches:
                out = np.full(b.num_rows, -1, np.int32)
                ok = b.column("usable").to_numpy(zero_copy_only=False).astype(bool)
                vectors = b.column("embedding")
                size = np.where(ok, np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False), nan=0), 0).astype(np.int64)
                for d in np.unique(size[ok]).tolist():
                    at = np.flatnonzero(size == d)
                    m = unit_rows(vectors.take(pa.array(at)).flatten().to_numpy().astype(np.float64).reshape(-1, d))
                    out[at] = (m @ anchors[d].T).argmax(axis=1) if d in anchors else 0
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(size, pa.int32()), pa.array(out)], [*b.schema.names[:-1], "dim", "near"])

        marked = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
        placed = T.StructType([*rows.schema.fields, T.StructField("dim", T.IntegerType()), T.StructField("near", T.IntegerType())])
        order = ["tenant_code", "system_type", "dim", "near", "chunk_id"]
        n = max(1, -(-rows.count() // (16 * CELL_ROWS)))
        spread = marked.mapInArrow(nearest, placed).repartitionByRange(n, *order).sortWithinPartitions(*order)
        names = [f.name for f in rows.schema.fields]

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The name of each row's cell: the id of the cell's first row."""
            last, cell, held = None, None, 0
            for b in batches:
                keys = list(zip(*(b.column(c).to_pylist() for c in order)))
                cells = []
                for key in keys:
                    if key[3] < 0:
                        cells.append(None)
                        continue
                    if key[:4] != last or held == CELL_ROWS:
                        last, cell, held = key[:4], key[4], 0
                    held += 1
                    cells.append(cell)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(cells, pa.string())], [*names, "cell"])

        cells = T.StructType([*rows.schema.fields, T.StructField("cell", T.StringType())])
        spread.mapInArrow(cut, cells).write.mode("overwrite").partitionBy("tenant_code", "system_type").parquet(f"{self.path}/data/folder={folder}")

        def measure(group: pa.Table) -> pa.Table:
            m = unit_rows(np.array(group["embedding"].to_pylist(), np.float64))
            center = unit_rows(m.mean(axis=0, keepdims=True))[0]
            radius = float(np.arccos(np.clip((m @ center).min(), -1, 1)))
            row = {c: [group[c][0].as_py()] for c in ("tenant_code", "system_type", "cell")} | {"dim": [m.shape[1]], "n": [len(m)], "center": [center.tolist()], "radius": [radius]}
            return pa.table(row, schema=pa.schema([("tenant_code", pa.string()), ("system_type", pa.string()), ("cell", pa.string()), ("dim", pa.int32()), ("n", pa.int64()),
                                                   ("center", pa.list_(pa.float64())), ("radius", pa.float64())]))

        done = self._folder("data", fields, folder).filter("cell IS NOT NULL").select("tenant_code", "system_type", "cell", "embedding")
        (done.groupBy("tenant_code", "system_type", "cell").applyInArrow(measure, CELLS)
         .write.mode("overwrite").partitionBy("tenant_code", "system_type").parquet(f"{self.path}/cells/folder={folder}"))

    def rejected(self, version: int | None = None) -> DataFrame:
        """(chunk_id, reason) of fine rows that recall can't find by their vector."""
        e = F.col("embedding")
        reason = (F.when(e.isNull(), "no vector").when(F.size(e) == 0, "empty vector").when(F.exists(e, lambda x: x.isNull() | F.isnan(x)), "component is null or not a number"))
        return self.read(version).filter("chunk_type = 'FINE' AND cell IS NULL").select("chunk_id", reason.alias("reason"))

    def vacuum(self, keep: int = 1) -> list[int]:
        """Removes manifests and folders that none of the last ``keep`` versions needs; returns the folders removed. Not while older versions are read."""
        versions = sorted(r[0] for r in self._manifests().select("version").distinct().collect())
        used = {f for v in versions[-keep:] for _, _, f in self.live(v)}
        old = [f for f in range(1, (versions or [0])[-1] + 1) if f not in used]
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in [f"manifest/version={v}" for v in versions[:-keep]] + [f"{part}/folder={f}" for f in old for part in ("data", "cells")]:
            target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            target.getFileSystem(conf).delete(target, True)
        return old
