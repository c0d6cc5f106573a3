"""Whole generations of a table behind one atomic pointer.

A generation is written to a folder of its own and becomes visible when its pointer, a small file named by its number, is
renamed into place; a rename either happens or does not, and never replaces a pointer. A job that dies in between leaves a
folder that no reader sees, and a batch that is retried after its pointer was set changes nothing, so every number is
published exactly once. Readers take the last pointer and see that generation whole, whatever is being written. The last
``keep`` generations stay for readers that began earlier.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Generations:
    """Generations of one table of ``schema`` below ``root``, which all executors share."""

    def __init__(self, spark: SparkSession, root: str, schema: str, keep: int = 3):
        self.spark, self.root, self.schema, self.keep = spark, root, schema, keep
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointers(self) -> dict[int, str]:
        """Folders by number: a pointer is an empty file named <number>.<folder>."""
        place = self._path(f"{self.root}/pointers")
        if not self._fs.exists(place):
            return {}
        names = [s.getPath().getName() for s in self._fs.listStatus(place)]
        return {int(n.split(".")[0]): n.split(".")[1] for n in sorted(names, reverse=True)}

    def number(self) -> int | None:
        return max(self._pointers(), default=None)

    def current(self, before: int | None = None) -> DataFrame:
        """The last generation, or the last one with a number below ``before``; an empty table if there is none."""
        known = {k: f for k, f in self._pointers().items() if before is None or k < before}
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/data/{known[max(known)]}")

    def publish(self, number: int, make: Callable[[DataFrame], DataFrame]) -> bool:
        """Write ``make`` of the generation before ``number`` as that number; False if it has been published before.

        One writer at a time, as a streaming query is: a second one that publishes the same number at the same moment may set
        a pointer too, of which the first by name counts.
        """
        if number in self._pointers():
            return False
        folder = uuid.uuid4().hex
        make(self.current(before=number)).write.parquet(f"{self.root}/data/{folder}")
        pending, place = self._path(f"{self.root}/pending-{folder}"), self._path(f"{self.root}/pointers/{number:012d}.{folder}")
        self._fs.create(pending, True).close()
        self._fs.mkdirs(place.getParent())
        if not self._fs.rename(pending, place):
            raise OSError(f"generation {number} could not be published")
        self._forget()
        return True

    def _forget(self) -> None:
        pointers = self._pointers()
        for number in sorted(pointers)[: -self.keep]:
            self._fs.delete(self._path(f"{self.root}/pointers/{number:012d}.{pointers[number]}"), False)
            self._fs.delete(self._path(f"{self.root}/data/{pointers[number]}"), True)
