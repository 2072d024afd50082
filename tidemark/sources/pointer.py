"""One small versioned file that says which folders of a stored table are in force.

A table's data lies in folders that are written once and never changed. Which of them
count is the newest of a few numbered files. A change writes the next number, which
only one writer can create, so writers that collide try again on what the other one
left. Folders that a change replaces are removed a few versions later, when nobody who
read the older version should still need them; so neither the folders nor the numbers
grow with the number of changes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

KEEP = 8  # versions whose folders stay for running readers
TRIES = 50


@dataclass(frozen=True)
class Pointer:
    """The state of a table below ``path``: a JSON object, by version.

    Its ``folders`` are names below ``path``, or whole paths where they hold a slash.
    """

    spark: SparkSession
    path: str

    def _hadoop(self, *parts: str):
        jvm = self.spark._jvm
        whole = parts[0] if "/" in parts[0] else "/".join([self.path.rstrip("/"), *parts])
        path = jvm.org.apache.hadoop.fs.Path(whole)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _versions(self) -> list[int]:
        fs, path = self._hadoop("versions")
        if not fs.exists(path):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(path)]
        return sorted(int(n) for n in names if n.isdigit())

    def read(self) -> tuple[int, dict]:
        """The newest version and its state; (0, {}) for a table nobody has written."""
        for _ in range(TRIES):
            known = self._versions()
            if not known:
                return 0, {}
            fs, path = self._hadoop("versions", f"{known[-1]:012d}")
            try:
                stream = fs.open(path)
            except Py4JJavaError:  # replaced in the meantime
                continue
            try:
                return known[-1], json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        raise RuntimeError(f"no version of {self.path} stays in place")

    def change(self, make: Callable[[dict], dict | None]) -> dict:
        """Replace the state by ``make(state)``, on the newest state there is; None changes nothing.

        ``make`` may run several times. What it no longer lists under ``folders`` is
        removed ``KEEP`` versions later.
        """
        for _ in range(TRIES):
            version, state = self.read()
            new = make(json.loads(json.dumps(state)))
            if new is None:
                return state
            number = version + 1
            left = [*state.get("left", ())]
            left += [[number, f] for f in state.get("folders", ()) if f not in new.get("folders", ())]
            for since, folder in left:
                if since <= number - KEEP:
                    self.remove(folder)
            new["left"] = [[since, folder] for since, folder in left if since > number - KEEP]
            if self._create(number, json.dumps(new)):
                for old in self._versions():
                    if old <= number - KEEP:
                        self.remove("versions", f"{old:012d}")
                return new
        raise RuntimeError(f"{self.path} is changed by others all the time")

    def exists(self, *parts: str) -> bool:
        fs, path = self._hadoop(*parts)
        return fs.exists(path)

    def remove(self, *parts: str) -> None:
        fs, path = self._hadoop(*parts)
        fs.delete(path, True)

    def _create(self, number: int, text: str) -> bool:
        """Write a version whole under another name, then give it its number, unless that is taken."""
        jvm = self.spark._jvm
        fs, draft = self._hadoop("versions", f"draft-{uuid.uuid4().hex}")
        _, path = self._hadoop("versions", f"{number:012d}")
        out = fs.create(draft, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, path, options)  # refuses to replace
        except Py4JJavaError:
            fs.delete(draft, False)
            if not fs.exists(path):
                raise
            return False
        return True
