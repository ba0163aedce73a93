"""Hand-over of results to files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Folders of a hand-over that is under way, and the mark that the old form is aside as a whole. Readers skip such names.
STAGED, KEPT, ASIDE = "_staged-", "_kept-", "_aside"


def write_extract(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "errorifexists",
    partition_by: Sequence[str] = (),
) -> None:
    """Write a result as Parquet, or as CSV with a header for dashboard tools."""
    writer = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


class _Folder:
    """Renames and listings below a path, in whichever file system it lies."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.root = path.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str) -> Any:
        return self._path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return bool(self._fs.exists(self._at(name)))

    def names(self, inside: str = "") -> list[tuple[str, bool]]:
        if not self.exists(inside):
            return []
        return [(s.getPath().getName(), bool(s.isDirectory())) for s in self._fs.listStatus(self._at(inside))]

    def move(self, old: str, new: str) -> None:
        parent = self._at(new).getParent()
        self._fs.mkdirs(parent)
        if not self._fs.rename(self._at(old), self._at(new)):
            raise OSError(f"{self.root}: could not rename {old} to {new}")

    def make(self, name: str) -> None:
        self._fs.mkdirs(self._at(name))

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def parts(self, inside: str, depth: int) -> Iterator[str]:
        """Partition folders ``a=1/b=2`` below ``inside``, ``depth`` levels down; with depth 0 the files."""
        for name, is_folder in self.names(inside):
            if depth == 0:
                if not is_folder and not name.startswith(("_", ".")):
                    yield name
            elif is_folder and "=" in name:
                if depth == 1:
                    yield name
                else:
                    yield from (f"{name}/{rest}" for rest in self.parts(f"{inside}/{name}", depth - 1))


def replace_extract(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> list[str]:
    """Replace the partitions of the result at ``path`` that ``df`` has rows for, or the whole result if it has no partitions.

    The rows are first written to a folder that readers skip. Only when all are there does each touched
    partition change places by renames: the old ones go aside, a mark is set, the new ones come. A
    failed write therefore leaves the old result as it was. Should the job die between renames,
    ``settle_extract``, which also runs before each replacement, brings the old partitions back, or, from
    the mark on, finishes the exchange. One writer at a time. Returns the partitions replaced.
    """
    folder, run = _Folder(df.sparkSession, path), uuid.uuid4().hex
    settle_extract(df.sparkSession, path)
    staged, kept, depth = f"{STAGED}{run}", f"{KEPT}{run}", len(partition_by)
    try:
        write_extract(df, f"{folder.root}/{staged}", fmt, partition_by=partition_by)
    except BaseException:
        folder.remove(staged)
        raise
    new = sorted(folder.parts(staged, depth))
    # What goes away: the same partitions, or without partitions all files.
    old = [p for p in new if folder.exists(p)] if depth else sorted(folder.parts("", 0))
    for part in old:
        folder.move(part, f"{kept}/{part}")
    folder.make(f"{kept}/{ASIDE}")
    for part in new:
        folder.move(f"{staged}/{part}", part)
    folder.remove(staged)
    folder.remove(kept)
    return new if depth else []


def settle_extract(spark: SparkSession, path: str) -> None:
    """Undo a replacement that broke off, or finish it if all of the old result was aside already."""
    folder = _Folder(spark, path)
    names = [name for name, is_folder in folder.names() if is_folder]
    for kept in (n for n in names if n.startswith(KEPT)):
        staged = STAGED + kept.removeprefix(KEPT)
        source = staged if folder.exists(f"{kept}/{ASIDE}") else kept
        for part in _parts(folder, source):
            folder.move(f"{source}/{part}", part)
        folder.remove(staged)
        folder.remove(kept)
    for staged in (n for n in names if n.startswith(STAGED)):
        folder.remove(staged)


def _parts(folder: _Folder, inside: str) -> list[str]:
    """Files or, where there are folders of partitions, the innermost of these."""
    depth, at = 0, inside
    while (inner := next((n for n, is_folder in folder.names(at) if is_folder and "=" in n), None)) is not None:
        at, depth = f"{at}/{inner}", depth + 1
    return list(folder.parts(inside, depth))


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``. Where that is unset, in local mode only, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="stepfall-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/stepfall-{uuid.uuid4().hex}"
