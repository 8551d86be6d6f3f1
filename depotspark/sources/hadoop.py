"""Files by Hadoop's file systems: listing, and archives written from part files in streams of the JVM."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def part_files(spark: SparkSession, folder: str) -> list[str]:
    """Part files that Spark wrote to a folder, in the order of its partitions."""
    fs, p = _at(spark, folder)
    return sorted(f.getPath().toString() for f in fs.listStatus(p) if f.getPath().getName().startswith("part-") and f.getLen())


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


@dataclass
class Member:
    """A file of an archive: bytes before, part files, bytes behind."""

    name: str
    head: bytes = b""
    parts: list[str] = field(default_factory=list)
    tail: bytes = b""


def write_archive(spark: SparkSession, target: str, members: list[Member]) -> None:
    """One ZIP at target. Parts go through buffers of 64 KB inside the JVM, so no memory grows with them; the archive appears under its name when it is whole."""
    jvm = spark._jvm
    fs, done = _at(spark, target)
    _, open_ = _at(spark, target + ".part")
    z = jvm.java.util.zip.ZipOutputStream(fs.create(open_, True))
    try:
        for m in members:
            z.putNextEntry(jvm.java.util.zip.ZipEntry(m.name))
            z.write(m.head)
            for part in m.parts:
                source, p = _at(spark, part)
                stream = source.open(p)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, z, 65536, False)
                stream.close()
            z.write(m.tail)
            z.closeEntry()
    finally:
        z.close()
    fs.delete(done, False)
    if not fs.rename(open_, done):
        raise OSError(f"can't write {target}")
