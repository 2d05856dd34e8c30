"""Tables that change together: all of a commit become visible in one step, or none.

A store is a folder. A commit writes its rows of every table, and the scopes that they
replace, into a folder of its own; nobody reads that yet. Then one small file, renamed into
``commits`` under the next number, makes all of them count. A reader takes a snapshot: the
commits up to a number. Of each scope it sees the rows of the last commit that replaced it, in
every table. A commit that ends early leaves files that nothing names; ``vacuum`` removes these and
what later commits have replaced.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.sources.files import Files

COMMIT = "_commit"


@dataclass
class Snapshot:
    """The store as of its commit number ``number``; 0 is the empty store."""

    spark: SparkSession
    store: str
    number: int
    commits: list[dict] = field(repr=False)

    def _last(self) -> DataFrame:
        """(scope, _commit): the commit that counts for each scope."""
        rows = self.spark.read.parquet(*(f"{self.store}/{c['folder']}/scopes" for c in self.commits))
        last = rows.groupBy("scope").agg(F.max_by(COMMIT, "number").alias(COMMIT), F.max_by("removed", "number").alias("removed"))
        return last.where("not removed").drop("removed")

    def scopes(self) -> DataFrame:
        if not self.commits:
            return self.spark.createDataFrame([], "scope string")
        return self._last().select("scope")

    def table(self, name: str, scopes: list | None = None) -> DataFrame | None:
        """A table's rows, of some scopes if given; None if no commit has had that table. Filters on the
        scope reach the files, which are sorted by it."""
        having = [c for c in self.commits if name in c["tables"]]
        if not having:
            return None
        scope = having[-1]["tables"][name]
        rows = self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.store}/{c['folder']}/{name}" for c in having))
        last = self._last().withColumnRenamed("scope", "_scope")
        if scopes is not None:
            rows = rows.where(rows[scope].isin(*scopes))
            last = last.where(F.col("_scope").isin(*map(str, scopes)))
        # whichever side is small goes to all tasks, if Spark knows it to be
        return rows.join(last, (rows[scope].cast("string") == last["_scope"]) & (rows[COMMIT] == last[COMMIT]), "left_semi").drop(COMMIT)


def snapshot(spark: SparkSession, store: str, number: int | None = None) -> Snapshot:
    """The newest snapshot, or an earlier one that is still there."""
    files = Files(spark, store)
    found = sorted(n for n in files.names(f"{store}/commits") if n.endswith(".json"))
    if number is not None:
        found = [n for n in found if int(n[:-5]) <= number]
    commits = [json.loads(files.read(f"{store}/commits/{n}")) for n in found]
    whole = [i for i, c in enumerate(commits) if c["whole"]]
    return Snapshot(spark, store, int(found[-1][:-5]) if found else 0, commits[whole[-1] if whole else 0 :])


def commit(spark: SparkSession, store: str, tables: dict[str, DataFrame], scope: str, scopes: DataFrame | None = None, whole: bool = False, removed: DataFrame | None = None) -> int:
    """Replaces what the store has of some scopes, in all ``tables`` at once; returns the
    commit's number. ``scopes`` (one column) are those that are replaced, also where they have no new
    rows; without it, those that occur in the rows. Scopes in ``removed`` are no more. Tables
    that are not named have no rows of these scopes afterwards. A ``whole`` commit makes all earlier ones
    meaningless. Rows of null scope belong to none and are an error."""
    files = Files(spark, store)
    name = uuid.uuid4().hex
    folder = f"data/{name}"
    for table, rows in tables.items():
        checked = F.coalesce(rows[scope].cast("string"), F.raise_error(F.lit(f"{table}: a row has no scope")))
        rows.withColumn(COMMIT, F.lit(name)).where(checked.isNotNull()).sortWithinPartitions(scope).write.parquet(f"{store}/{folder}/{table}")
    if scopes is None:
        written = [spark.read.parquet(f"{store}/{folder}/{t}").select(F.col(scope).cast("string").alias("scope")) for t in tables]
        listed = written[0]
        for w in written[1:]:
            listed = listed.union(w)
    else:
        listed = scopes.select(F.col(scopes.columns[0]).cast("string").alias("scope"))
    listed = listed.distinct().withColumn("removed", F.lit(False))
    if removed is not None:
        gone = removed.select(F.col(removed.columns[0]).cast("string").alias("scope")).distinct()
        listed = listed.join(gone, "scope", "left_anti").union(gone.withColumn("removed", F.lit(True)))
    while True:  # another writer may take a number first
        number = 1 + max((int(n[:-5]) for n in files.names(f"{store}/commits") if n.endswith(".json")), default=0)
        files.delete(f"{store}/{folder}/scopes")
        listed.withColumn(COMMIT, F.lit(name)).withColumn("number", F.lit(number)).write.parquet(f"{store}/{folder}/scopes")
        entry = json.dumps({"folder": folder, "tables": dict.fromkeys(tables, scope), "whole": whole})
        if files.put_new(f"{store}/commits/{number:012d}.json", entry):
            return number


def compact(spark: SparkSession, store: str) -> int:
    """One commit with all that counts, so that readers need no earlier one."""
    now = snapshot(spark, store)
    tables = {t: scope for c in now.commits for t, scope in c["tables"].items()}
    if len(set(tables.values())) > 1:
        raise ValueError("tables of one store have one scope column")
    if not tables:
        return 0
    return commit(spark, store, {t: now.table(t) for t in tables}, next(iter(tables.values())), now.scopes(), whole=True)


def vacuum(spark: SparkSession, store: str) -> int:
    """Deletes folders that no commit of the newest snapshot names, and earlier commits. Call it
    while nothing is being written and no earlier snapshot is read; returns how many went."""
    files = Files(spark, store)
    now = snapshot(spark, store)
    named = {c["folder"] for c in now.commits}
    old = [f"data/{n}" for n in files.names(f"{store}/data") if f"data/{n}" not in named]
    for n in files.names(f"{store}/commits"):
        if not n.endswith(".json") or json.loads(files.read(f"{store}/commits/{n}"))["folder"] not in named:
            files.delete(f"{store}/commits/{n}")
    for folder in old:
        files.delete(f"{store}/{folder}")
    return len(old)
