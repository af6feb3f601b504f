"""Names and markers on any Hadoop file system, as the driver needs them for a store's upkeep."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def names(self, path: str) -> list[str]:
        """What a folder holds; nothing where there is no folder."""
        fs, p = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def touch(self, path: str) -> None:
        """Create an empty file; it must be new."""
        fs, p = self._at(path)
        if not fs.createNewFile(p):
            raise FileExistsError(path)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def text(self, path: str) -> str:
        """A small file's text; a missing file is an error."""
        fs, p = self._at(path)
        if not fs.exists(p):
            raise FileNotFoundError(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
