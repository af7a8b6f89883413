"""Small files and folders of the store, through Hadoop's file systems (driver side)."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def rename(self, source: str, target: str) -> None:
        fs, p = self._at(source)
        fs.mkdirs(self._at(target)[1].getParent())
        if not fs.rename(p, self._at(target)[1]):
            raise OSError(f"can't rename {source} to {target}")

    def folders(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def read(self, path: str) -> str | None:
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Written beside and renamed over it, so a reader sees the old text or the new."""
        fs, p = self._at(path)
        other = self.jvm.org.apache.hadoop.fs.Path(path + ".new")
        stream = fs.create(other, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        over = self.gateway.new_array(kind, 1)
        over[0] = kind.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf).rename(fs.makeQualified(other), fs.makeQualified(p), over)
