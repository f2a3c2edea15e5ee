"""A commit log: numbered files, the last of which says what a set of tables consists of.

Tables are written to folders that nothing else uses; a commit makes them visible by one rename to the next number, which fails if
another writer was first. A run that stops before its rename leaves folders that no reader looks at (``vacuum`` removes them); one that stops
after it is done.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from seqstats.session import delete_path

FOLDER = "_commits"


class Conflict(Exception):
    """Another writer has committed since the state was read."""


def _system(spark: SparkSession, path: str):
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name, name.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    name, system = _system(spark, path)
    return sorted(x.getPath().getName() for x in system.listStatus(name)) if system.exists(name) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    return [int(x.removesuffix(".json")) for x in names(spark, f"{root}/{FOLDER}") if x.endswith(".json") and x[0].isdigit()]


def read_commit(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, dict]:
    """Number and content of a commit, of the last one by default; (0, {}) if there is none."""
    if version is None:
        version = max(versions(spark, root), default=0)
    if not version:
        return 0, {}
    name, system = _system(spark, f"{root}/{FOLDER}/{version:012d}.json")
    stream = system.open(name)
    try:
        return version, json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, root: str, content: dict, after: int) -> int:
    """Make ``content`` the state that follows version ``after``; ``Conflict`` if something else already does."""
    version = after + 1
    folder = f"{root}/{FOLDER}"
    draft, system = _system(spark, f"{folder}/draft-{spark.sparkContext.applicationId}-{id(content)}")
    stream = system.create(draft, True)
    try:
        stream.write(bytearray(json.dumps(content, sort_keys=True, indent=1).encode()))
    finally:
        stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    # Renaming through a file context never replaces a file; a plain rename may.
    only_new = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    only_new[0] = hadoop.Options.Rename.NONE
    context = hadoop.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration())
    target = hadoop.Path(f"{folder}/{version:012d}.json")
    try:
        context.rename(draft, target, only_new)
    except Exception as error:
        if not system.exists(target):
            raise
        system.delete(draft, False)
        raise Conflict(f"version {version} of {root} was written by another run") from error
    return version


def vacuum(spark: SparkSession, root: str, used: set[str], keep: int = 2) -> list[str]:
    """Remove folders below ``root`` that no commit to be kept uses, and older commits; gives what went.

    ``used``: the folders of the last ``keep`` commits. Not to be run while another run is writing.
    """
    gone = [x for x in names(spark, root) if x != FOLDER and x not in used]
    old = versions(spark, root)[:-keep] if keep else []
    drafts = [f"{FOLDER}/{x}" for x in names(spark, f"{root}/{FOLDER}") if x.startswith("draft-")]
    for name in gone + [f"{FOLDER}/{v:012d}.json" for v in old] + drafts:
        delete_path(spark, f"{root}/{name}")
    return gone
