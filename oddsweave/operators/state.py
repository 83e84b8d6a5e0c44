"""Small state in a shared folder, changed by compare-and-set: a lease, a watermark.

Each version is a file named by its number.  A writer drafts it under a name of
its own and then gives it the number in one step that fails if the number is
taken: a rename on HDFS, a hard link on a local file system (whose ``create``
looks first and writes later).  So of two writers of one version one wins, and a
version is whole or not there.  An object store without such a step won't do.
What is kept here is one row a name; tables stay tables.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from oddsweave.operators import consensus


class Versions:
    """The versions of one named state in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, name: str):
        self.jvm, self.context = spark.sparkContext._jvm, spark.sparkContext
        self.path = self.jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
        self.fs = self.path.getFileSystem(self.context._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.path)

    def latest(self) -> tuple[int, dict | None]:
        """The highest whole version and its value; 0 and None at first."""
        numbers = sorted((int(s.getPath().getName()) for s in self.fs.listStatus(self.path) if s.getPath().getName().isdigit()), reverse=True)
        for n in numbers:
            stream = self.fs.open(self.jvm.org.apache.hadoop.fs.Path(self.path, str(n)))
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            if text.endswith("\n"):
                return n, json.loads(text)
        return 0, None

    def commit(self, version: int, value: dict) -> bool:
        """Writes ``value`` as the version after ``version``; false if somebody else has."""
        of = self.jvm.org.apache.hadoop.fs.Path
        draft, target = of(self.path, f"draft-{uuid.uuid4().hex}"), of(self.path, str(version + 1))
        stream = self.fs.create(draft, False)
        try:
            stream.write(bytearray((json.dumps(value) + "\n").encode()))
        finally:
            stream.close()
        try:
            return self._numbered(draft, target)
        finally:
            self.fs.delete(draft, False)

    def _numbered(self, draft, target) -> bool:
        if self.fs.getUri().getScheme() != "file":
            return bool(self.fs.rename(draft, target))
        local = lambda path: self.jvm.java.io.File(path.toUri().getPath()).toPath()
        try:
            self.jvm.java.nio.file.Files.createLink(local(target), local(draft))
            return True
        except Exception:
            if self.fs.exists(target):
                return False
            raise


def acquire(versions: Versions, owner: str, now: datetime, minutes: int = 30) -> bool:
    """Takes a collector's lease if nobody runs it or its lease has run out; of several that try at once one gets it."""
    version, held = versions.latest()
    if held and held["running"] and datetime.fromisoformat(held["until"]) >= now:
        return False
    return versions.commit(version, {"owner": owner, "running": True, "until": (now + timedelta(minutes=minutes)).isoformat()})


def release(versions: Versions, owner: str) -> bool:
    """Ends a lease that ``owner`` holds."""
    version, held = versions.latest()
    return bool(held and held["owner"] == owner and held["running"]) and versions.commit(version, held | {"running": False})


def swept(versions: Versions, read_prices: Callable[[], DataFrame], upcoming: DataFrame, write: Callable[[DataFrame], None], began: datetime, column: str = "updated_at") -> bool:
    """A sweep since the stored watermark, and the watermark after it.

    ``began`` is taken before anything is read, so what comes in meanwhile is
    judged next time.  The watermark moves only if ``write`` succeeded and there
    were upcoming fixtures; ``write`` must be idempotent, for a sweep whose
    commit is lost is done again.  The first sweep judges everything.
    """
    version, stored = versions.latest()
    if upcoming.isEmpty():
        return False
    since = datetime.fromisoformat(stored["since"]) if stored else None
    write(consensus.sweep(read_prices(), upcoming, since, column))
    return versions.commit(version, {"since": began.isoformat()})
