"""Several relations of notes that change together: readers see all of a change or nothing of it.

A version is a small file that names the folders of every relation. A change writes the rows of the changed notes to new
folders, with the list of these notes, and then publishes the next version by one rename; until then nobody knows the
folders. A row counts if it was written by the last version that changed its note, so nothing old is rewritten, and a
note that was changed without rows is gone. Compaction publishes a version whose folders hold the rows that count;
folders of older versions stay for their readers until they are swept.
"""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGED = "_changed"


class Versions:
    """Relations with a note column each, {"sections": "note_id", ...}, in the folder `root` (any that Spark writes to).

    Writers are one at a time: of two that publish the same number the second fails and can try again.
    """

    def __init__(self, spark: SparkSession, root: str, relations: dict[str, str]):
        self.spark, self.root, self.relations = spark, root.rstrip("/"), relations
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Published versions, oldest first."""
        at = self._path(f"{self.root}/versions")
        if not self._fs.exists(at):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(at)]
        return sorted(int(x[:-5]) for x in names if x.endswith(".json") and x[:-5].isdigit())

    def manifest(self, number: int | None = None) -> dict:
        """What a version says, the last if none is asked for; before the first one there is nothing in it."""
        known = self.numbers()
        if number is None and not known:
            return {"number": 0, "batch": None, "folders": {}}
        text = self.spark.read.text(f"{self.root}/versions/{known[-1] if number is None else number}.json", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, relation: str, number: int | None = None) -> DataFrame:
        """The rows of a relation as of a version. An unknown relation, or one that never had rows, is an error."""
        said = self.manifest(number)
        note = self.relations[relation]
        rows = self.spark.read.parquet(*said["folders"][relation])
        last = self.spark.read.parquet(*said["folders"][CHANGED]).groupBy("_note").agg(F.max("_version").alias("_version"))
        return rows.join(last.withColumnRenamed("_note", note), [note, "_version"]).drop("_version")

    def change(self, notes: DataFrame, rows: dict[str, DataFrame], batch: int | None = None) -> int:
        """Replaces everything of these notes (a column of ids) by the rows given for each relation; ids without rows
        are deleted. Returns the new version's number. A numbered batch that has been published is passed over, so a
        stream can run it again."""
        said = self.manifest()
        if batch is not None and said["batch"] is not None and batch <= said["batch"]:
            return said["number"]
        number = said["number"] + 1
        folders = {k: list(v) for k, v in said["folders"].items()}
        version = F.lit(number).cast("long").alias("_version")
        ids = notes.select(F.col(notes.columns[0]).alias("_note")).where("_note is not null").distinct()
        self._written(folders, CHANGED, ids.select("_note", version))
        for name, note in self.relations.items():
            if name in rows:
                own = rows[name].join(ids.withColumnRenamed("_note", note), note, "left_semi")
                self._written(folders, name, own.select("*", version))
        self._published({"number": number, "batch": batch if batch is not None else said["batch"], "folders": folders})
        return number

    def compacted(self) -> int:
        """Publishes a version in which each relation is one folder with the rows that count."""
        said = self.manifest()
        number, folders = said["number"] + 1, {}
        last = self.spark.read.parquet(*said["folders"][CHANGED]).groupBy("_note").agg(F.max("_version").alias("_version"))
        there = None
        for name, note in self.relations.items():
            if name in said["folders"]:
                rows = self.spark.read.parquet(*said["folders"][name]).join(last.withColumnRenamed("_note", note), [note, "_version"])
                self._written(folders, name, rows)
                ids = self.spark.read.parquet(folders[name][0]).select(F.col(note).alias("_note"), "_version").distinct()
                there = ids if there is None else there.union(ids)
        # notes that are gone need no mark any more, as their rows are
        self._written(folders, CHANGED, there.distinct())
        self._published({"number": number, "batch": said["batch"], "folders": folders})
        return number

    def swept(self, keep: int = 1) -> int:
        """Forgets all but the last `keep` versions and deletes folders that none of these names; how many went. Also
        what writers left behind that didn't get to publish, so not while one writes."""
        known = self.numbers()
        named = {x.rsplit("/", 1)[1] for n in known[-keep:] for xs in self.manifest(n)["folders"].values() for x in xs}
        for n in known[:-keep]:
            self._fs.delete(self._path(f"{self.root}/versions/{n}.json"), False)
        gone = 0
        at = self._path(f"{self.root}/data")
        for x in self._fs.listStatus(at) if self._fs.exists(at) else []:
            if x.getPath().getName() not in named:
                self._fs.delete(x.getPath(), True)
                gone += 1
        return gone

    def _written(self, folders: dict, name: str, rows: DataFrame) -> None:
        path = f"{self.root}/data/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        folders.setdefault(name, []).append(path)

    def _published(self, said: dict) -> None:
        """One rename makes the version known; it fails where the number is taken."""
        made = self._path(f"{self.root}/making-{uuid.uuid4().hex}.json")
        out = self._fs.create(made, True)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        final = self._path(f"{self.root}/versions/{said['number']}.json")
        self._fs.mkdirs(final.getParent())
        if self._fs.exists(final) or not self._fs.rename(made, final):
            self._fs.delete(made, False)
            raise RuntimeError(f"version {said['number']} has been published by another writer")
