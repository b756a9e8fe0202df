"""Versions of a stored star, and the commits that say which of them count.

A load writes its tables into folders of a version of its own, ``<table>/version=<id>``, and then one
small commit file that lists, for every table, the versions it is made of. Readers follow the commit
of the highest number. A load that ends early leaves folders that no commit names: readers go on
with the star as it was, and a repeated load adds nothing twice. One load at a time writes to a folder.
"""

import json
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import SparkSession

COMMITS = "_commits"


@dataclass(frozen=True)
class Commit:
    number: int = 0
    versions: dict[str, list[str]] = field(default_factory=dict)  # by table, oldest first
    filters: dict[str, list[str]] = field(default_factory=dict)  # by table, versions with a filter of keys
    loads: list[str] = field(default_factory=list)  # names of the loads it holds

    def with_version(self, tables: Iterable[str], version: str, *, keep: bool, load: str | None) -> "Commit":
        """The next commit: this one's versions and ``version``, or that alone."""
        old = self.versions if keep else {}
        versions = dict(old) | {t: [*old.get(t, []), version] for t in tables}
        loads = ([*self.loads] if keep else []) + ([load] if load else [])
        return replace(self, number=self.number + 1, versions=versions, filters=self.filters if keep else {}, loads=loads)


def _system(spark: SparkSession, place: str):
    """The file system of a place, and the place as its path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def path_of(folder: str, table: str, version: str) -> str:
    return f"{folder}/{table}/version={version}"


def new_version() -> str:
    return uuid.uuid4().hex


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    system, pattern = _system(spark, f"{folder}/{COMMITS}/*.json")
    found = system.globStatus(pattern) or []
    return sorted(int(f.getPath().getName().removesuffix(".json")) for f in found)


def latest(spark: SparkSession, folder: str) -> Commit | None:
    """The commit that readers follow, None in a folder without any."""
    numbers = _numbers(spark, folder)
    if not numbers:
        return None
    system, path = _system(spark, f"{folder}/{COMMITS}/{numbers[-1]:010d}.json")
    stream = system.open(path)
    try:
        return Commit(**json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def publish(spark: SparkSession, folder: str, commit: Commit) -> None:
    """Makes the commit the one that readers follow, by a rename; fails if its number is taken."""
    place = f"{folder}/{COMMITS}"
    system, target = _system(spark, f"{place}/{commit.number:010d}.json")
    _, draft = _system(spark, f"{place}/.{uuid.uuid4().hex}")
    stream = system.create(draft, False)
    stream.write(bytearray(json.dumps(asdict(commit)).encode()))
    stream.close()
    if system.exists(target) or not system.rename(draft, target):
        system.delete(draft, False)
        raise RuntimeError(f"commit {commit.number} of {folder} has been written by another load")
