"""Tables in hash buckets: writes, deletes and reads of a key touch its bucket alone.

Rows lie by a hash of their keys in folders v=<write>/bucket_=<number>. A small
manifest for each version tells which folders a bucket consists of; a version
counts once its manifest is there, so a write that breaks off changes nothing. A
keyed table puts new rows beside the old ones and merges them when it is read;
once a bucket has many parts, the next write makes one of them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wardspan.operators.history import latest

#: Parts that a bucket has at most after a write, and versions whose files are kept for readers that still use them.
PARTS, KEPT = 8, 2


@dataclass
class Manifest:
    """What a version is made of: for each bucket the writes that made its parts, in their order."""

    version: int = 0
    buckets: int = 0
    schema: str = ""
    parts: dict[str, list[str]] = field(default_factory=dict)


@dataclass
class Store:
    """A table at ``path``, in buckets by ``by`` (the keys if not told).

    With ``order`` a key has one row, the last in that order, of equal ones the
    last written; without, rows are only added. One writer at a time.
    """

    spark: SparkSession
    path: str
    keys: list[str]
    order: list[str] | None = None
    by: list[str] | None = None
    buckets: int = 64

    def _fs(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(folder)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def manifest(self) -> Manifest:
        """Of the newest version; of version 0, which has nothing, if there is none."""
        done = max((n for n in self._names("manifests") if n.endswith(".json")), default=None)
        if done is None:
            return Manifest(buckets=self.buckets)
        fs, at = self._fs(f"manifests/{done}")
        source = fs.open(at)
        try:
            return Manifest(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")))
        finally:
            source.close()

    def _publish(self, m: Manifest) -> None:
        name = f"manifests/{m.version:012d}.json"
        fs, at = self._fs(name)
        _, new = self._fs(f"{name}.new")
        if fs.exists(at):
            raise RuntimeError(f"{name} is there already: another writer was faster")
        out = fs.create(new, True)
        try:
            out.write(bytearray(json.dumps(vars(m)).encode()))
        finally:
            out.close()
        if not fs.rename(new, at):
            raise RuntimeError(f"{name} can't be published")
        self._clean(m)

    def _clean(self, m: Manifest) -> None:
        """Deletes manifests before the last KEPT, and folders of writes that no kept one names."""
        names = sorted(n for n in self._names("manifests") if n.endswith(".json"))
        for n in names[:-KEPT]:
            fs, at = self._fs(f"manifests/{n}")
            fs.delete(at, False)
        used = set()
        for n in names[-KEPT:]:
            fs, at = self._fs(f"manifests/{n}")
            source = fs.open(at)
            told = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
            source.close()
            used |= {(v, b) for b, writes in told["parts"].items() for v in writes}
        for folder in self._names(""):
            if folder.startswith("v=") and int((v := folder[2:]).split("-")[0]) <= m.version:
                kept = [b for b in self._names(folder) if b.startswith("bucket_=") and (v, b[8:]) in used]
                for b in [folder] if not kept else [f"{folder}/{b}" for b in self._names(folder) if b.startswith("bucket_=") and b not in kept]:
                    fs, at = self._fs(b)
                    fs.delete(at, True)

    def _bucket(self, n: int, columns: list[Column] | None = None) -> Column:
        """A row's bucket; keys are hashed as text, so equal keys of other types meet."""
        of = columns or [F.col(c) for c in self.by or self.keys]
        return F.pmod(F.xxhash64(*[c.cast("string") for c in of]), F.lit(n)).cast("int")

    def _write(self, rows: DataFrame, version: int, n: int) -> tuple[str, list[str]]:
        """Writes rows into a folder of its own; the write's name and its buckets. Ranges of bucket and keys go to a task each, so a frequent key is dealt out too."""
        name = f"{version:012d}-{uuid.uuid4().hex[:8]}"
        sort = ["bucket_", *self.keys, *[c for c in self.order or [] if c not in self.keys]]
        rows = rows.withColumn("bucket_", self._bucket(n))
        rows.repartitionByRange(*sort).sortWithinPartitions(*sort).write.partitionBy("bucket_").parquet(f"{self.path}/v={name}")
        return name, [b[8:] for b in self._names(f"v={name}") if b.startswith("bucket_=")]

    def write(self, rows: DataFrame) -> None:
        """Adds rows; in a keyed table they take the place of older ones of their keys."""
        m = self.manifest()
        schema = StructType.fromJson(json.loads(m.schema)) if m.schema else StructType()
        schema = StructType([*schema.fields, *[f for f in rows.schema.fields if f.name not in schema.names]])
        version, parts = m.version + 1, {b: list(v) for b, v in m.parts.items()}
        name, written = self._write(rows, version, m.buckets)
        for b in written:
            parts.setdefault(b, []).append(name)
        made = Manifest(version, m.buckets, schema.json(), parts)
        if many := [b for b, v in parts.items() if len(v) > PARTS]:
            made = self._rewritten(made, many, self._rows(made, many))
        self._publish(made)

    def _rewritten(self, m: Manifest, buckets: list[str], rows: DataFrame) -> Manifest:
        """A manifest of the next version, with rows as the only part of the buckets."""
        name, written = self._write(rows, m.version + 1, m.buckets)
        parts = {b: v for b, v in m.parts.items() if b not in buckets} | {b: [name] for b in written}
        return Manifest(m.version + 1, m.buckets, m.schema, parts)

    def _rows(self, m: Manifest, buckets: list[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(m.schema))
        chosen = {b: v for b, v in m.parts.items() if buckets is None or b in buckets}

        def read(of: dict[str, list[str]]) -> DataFrame:
            folders = [f"{self.path}/v={v}/bucket_={b}" for b, writes in of.items() for v in writes]
            return self.spark.read.schema(schema).option("basePath", self.path).parquet(*folders)

        single = chosen if self.order is None else {b: v for b, v in chosen.items() if len(v) == 1}
        several = {b: v for b, v in chosen.items() if b not in single}
        out = [read(single).select(*schema.names)] if single else []
        if several:
            out.append(latest(read(several).drop("bucket_"), self.keys, [*self.order, "v"]).select(*schema.names))
        return out[0].unionByName(out[1]) if len(out) == 2 else out[0] if out else self.spark.createDataFrame([], schema)

    def upsert(self, rows: DataFrame) -> None:
        """write() of the last of the rows of each key."""
        self.write(latest(rows, self.keys, self.order))

    def read(self) -> DataFrame | None:
        """All rows of the newest version, None before the first."""
        m = self.manifest()
        return self._rows(m) if m.version else None

    def _bucket_of(self, m: Manifest, **values) -> list[str] | None:
        """The only bucket that rows with such values can lie in, None if that can't be told."""
        by = self.by or self.keys
        if not set(by) <= set(values):
            return None
        return [str(self.spark.range(1).select(self._bucket(m.buckets, [F.lit(values[c]) for c in by])).first()[0])]

    def read_key(self, **values) -> DataFrame | None:
        """Rows with such values in columns; with all of ``by`` told, the files of one bucket are read."""
        m = self.manifest()
        if not m.version:
            return None
        rows = self._rows(m, self._bucket_of(m, **values))
        for c, v in values.items():
            rows = rows.filter(F.col(c).eqNullSafe(F.lit(v)))
        return rows

    def delete_key(self, **values) -> None:
        """Deletes the rows that read_key() gives; with all of ``by`` told, one bucket is written again."""
        m = self.manifest()
        if not m.version:
            return
        buckets = [b for b in self._bucket_of(m, **values) or list(m.parts) if b in m.parts]
        if not buckets:
            return
        gone = F.lit(True)
        for c, v in values.items():
            gone &= F.col(c).eqNullSafe(F.lit(v))
        self._publish(self._rewritten(m, buckets, self._rows(m, buckets).filter(~gone)))

    def delete(self, gone: DataFrame) -> None:
        """Deletes the rows that meet a row of ``gone`` in its columns, which include ``by``; the buckets of its rows are written again."""
        m = self.manifest()
        touched = [str(r[0]) for r in gone.select(self._bucket(m.buckets)).distinct().collect()] if m.version else []
        buckets = [b for b in touched if b in m.parts]
        if buckets:
            told = gone.select(*[F.col(c).alias(f"{c}_gone_") for c in gone.columns]).distinct()
            meets = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}_gone_")) for c in gone.columns])
            self._publish(self._rewritten(m, buckets, self._rows(m, buckets).join(told, meets, "left_anti")))

    def purge(self) -> None:
        """Deletes all rows; the columns stay."""
        m = self.manifest()
        if m.version:
            self._publish(Manifest(m.version + 1, m.buckets, m.schema, {}))
