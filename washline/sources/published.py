"""Tables that change by published batches.

A batch of rows replaces whole partitions. Its files are staged in a folder of their own; then one small
manifest file, which names the folder of every partition, is renamed into place. Readers open the newest
manifest and the folders it names, so they see all of a batch or nothing, and a run that dies between
staging and the switch leaves the table as it was. A batch has an id: publishing it again (a replay) changes
nothing. Two publishers cannot both make the same version: the rename of the second fails, and it starts
again from the table it then finds.

The manifest is a line of JSON per partition, so what the driver handles is bounded by the number of
partitions, never by rows. Files of replaced partitions stay until ``vacuum``.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class PublishedTable:
    """A table under ``root`` on shared storage, partitioned by ``partition`` (a column of text or numbers)."""

    def __init__(self, spark: SparkSession, root: str, partition: str):
        self.spark, self.root, self.partition = spark, root.rstrip("/"), partition
        self._Path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _list(self, path: str) -> list[str]:
        p = self._Path(path)
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def version(self) -> int:
        """The newest manifest's number, 0 before the first batch."""
        return max((int(n) for n in self._list(f"{self.root}/_manifest") if n.isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """schema (JSON), parts (partition value -> folder) and batches (ids in order)."""
        version = self.version() if version is None else version
        if not version:
            return {"schema": None, "parts": {}, "batches": []}
        reader = self.fs.open(self._Path(f"{self.root}/_manifest/{version:012d}"))
        try:
            lines = self.spark._jvm.org.apache.commons.io.IOUtils.toString(reader, "UTF-8").splitlines()
        finally:
            reader.close()
        head, *parts = map(json.loads, lines)
        return {**head, "parts": dict(parts)}

    def stage(self, batch: str, rows: DataFrame) -> dict[str, str]:
        """Write the rows of a batch beside the table; gives the folder of each partition it holds.

        A folder left by a run that died is overwritten."""
        path = f"{self.root}/data/{batch}"
        part = F.coalesce(F.col(self.partition).cast("string"), F.lit("__null__"))
        # rebalance: few files per partition, and a large partition is split over tasks
        (rows.withColumn("_part", part).hint("rebalance", "_part").write.mode("overwrite")
         .partitionBy("_part").parquet(path))
        plain = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        return {plain(n.removeprefix("_part=")): f"data/{batch}/{n}"
                for n in self._list(path) if n.startswith("_part=")}

    def switch(self, batch: str, schema: str, staged: dict[str, str], dropped: Iterable[str] = ()) -> bool:
        """Put the staged partitions in place of those of the same values, and take ``dropped`` ones out.
        False if the batch is in the table already."""
        while True:
            version = self.version()
            now = self.manifest(version)
            if batch in now["batches"]:
                return False
            parts = {k: v for k, v in now["parts"].items() if k not in set(dropped)} | staged
            head = {"schema": now["schema"] or schema, "batches": now["batches"] + [batch]}
            text = "\n".join(json.dumps(x) for x in [head, *sorted(parts.items())])
            temporary = self._Path(f"{self.root}/_manifest/.{batch}")
            out = self.fs.create(temporary, True)
            out.write(bytearray(text.encode()))
            out.close()
            final = self._Path(f"{self.root}/_manifest/{version + 1:012d}")
            if not self.fs.exists(final) and self.fs.rename(temporary, final):
                return True

    def publish(self, batch: str, rows: DataFrame, dropped: Iterable[str] = ()) -> bool:
        """Replace the partitions that ``rows`` hold by ``rows``. False, and no work, if the batch is in already."""
        if batch in self.manifest()["batches"]:
            return False
        return self.switch(batch, rows.schema.json(), self.stage(batch, rows), dropped)

    def read(self, parts: Iterable[str] | None = None) -> DataFrame:
        """The table as of now, or only the partitions of the given values: other folders are not opened."""
        from pyspark.sql.types import StructType

        now = self.manifest()
        if now["schema"] is None:
            raise ValueError(f"nothing has been published to {self.root}")
        schema = StructType.fromJson(json.loads(now["schema"]))
        keep = None if parts is None else {str(p) for p in parts}
        folders = [f"{self.root}/{f}" for k, f in now["parts"].items() if keep is None or k in keep]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def vacuum(self) -> int:
        """Delete the folders that the newest manifest does not name; gives their number. For times without readers
        of older versions and without publishers."""
        kept, gone = set(self.manifest()["parts"].values()), 0
        for batch in self._list(f"{self.root}/data"):
            for name in self._list(f"{self.root}/data/{batch}"):
                if name.startswith("_part=") and f"data/{batch}/{name}" not in kept:
                    self.fs.delete(self._Path(f"{self.root}/data/{batch}/{name}"), True)
                    gone += 1
        return gone
