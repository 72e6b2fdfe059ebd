"""A durable store of chunks and feedback: immutable parquet parts behind numbered states.

Every change writes new parts and then one new state file with the next
number, which no other writer may have taken; readers use the newest complete
one. So they see the old state or the new one at any moment, a writer that dies
leaves the old one, of two writers at once one fails, and an earlier state can
be restored. The folder must be shared by the cluster.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import folded
from corpusloom.session import read_text, write_text

SCHEMA_VERSION = 2


class SnapshotStore:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.folder}/states"))
        if not self._numbers():
            self._point({"version": SCHEMA_VERSION, "tables": {}, "meta": {}, "before": None}, 0)

    # ---- states

    def _numbers(self) -> list[int]:
        names = (f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.folder}/states")))
        return sorted(int(n) for n in names if n.isdigit())

    def _state(self) -> dict:
        n = self._numbers()[-1]
        return {**json.loads(read_text(self.spark, f"{self.folder}/states/{n}")), "n": n}

    def _point(self, state: dict, n: int) -> None:
        """Make a state the newest, if no other writer has made one since it was read."""
        new, at = f"{self.folder}/states/.{uuid.uuid4().hex}", self._path(f"{self.folder}/states/{n}")
        write_text(self.spark, new, json.dumps({k: v for k, v in state.items() if k != "n"}), overwrite=False)
        taken = self._fs.exists(at)
        if taken or not self._fs.rename(self._path(new), at):
            self._fs.delete(self._path(new), False)
            raise RuntimeError("the store was changed by another writer; read it again")

    def _write(self, name: str, df: DataFrame) -> str:
        place = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(place)
        return place

    def _swap(self, state: dict | None = None, append: bool = False, **tables: DataFrame) -> None:
        """Write tables anew, or with ``append`` as further parts, and make that the newest state."""
        state = state or self._state()
        places = {k: list(v) for k, v in state["tables"].items()}
        for name, df in tables.items():
            places[name] = [*(places.get(name, []) if append else []), self._write(name, df)]
        self._point({**state, "tables": places, "before": {k: state[k] for k in ("tables", "meta")}}, state["n"] + 1)

    def _table(self, name: str) -> DataFrame | None:
        parts = self._state()["tables"].get(name)
        return self.spark.read.parquet(*parts) if parts else None

    def restore(self) -> None:
        """Go back to the state before the last change."""
        state = self._state()
        if state["before"]:
            self._point({"version": state["version"], **state["before"], "before": None}, state["n"] + 1)

    # ---- chunks

    def load_all(self) -> DataFrame | None:
        return self._table("chunks")

    def load_source(self, source_id: str) -> DataFrame:
        return self.load_all().where(F.col("source_id") == source_id)

    def ids_by_source(self, source_id: str) -> DataFrame:
        return self.load_source(source_id).select("id")

    def get_many(self, ids: DataFrame) -> DataFrame:
        return self.load_all().join(ids.select("id").distinct(), "id", "left_semi")

    def upsert_many(self, chunks: DataFrame) -> None:
        """New rows replace those with their id; of equal ids given at once the last stays."""
        self._swap(chunks=upserted(self.load_all(), chunks, "id"))

    add = add_many = upsert_many

    def remove_many(self, ids: DataFrame) -> int:
        return self.delete_ids(ids)

    def clear(self) -> None:
        """Leave no chunks; feedback and metadata stay."""
        old = self.load_all()
        if old is not None:
            self._swap(chunks=old.limit(0))

    def replace_source(self, source_id: str, chunks: DataFrame) -> None:
        self._swap(chunks=replaced(self.load_all(), chunks, source_id))

    def delete_ids(self, ids: DataFrame) -> int:
        old = self.load_all()
        n = old.join(ids.select("id").distinct(), "id", "left_semi").count()
        self._swap(chunks=old.join(ids.select("id").distinct(), "id", "left_anti"))
        return n

    def delete_source(self, source_id: str) -> int:
        """Delete a source's chunks and the feedback on them in one swap; gives the number of chunks."""
        gone = self.load_source(source_id).select("id")
        n = gone.count()
        tables = {"chunks": self.load_all().where(F.col("source_id").isNull() | (F.col("source_id") != source_id))}
        feedback = self._table("feedback")
        if feedback is not None:
            tables["feedback"] = feedback.join(gone.select(F.col("id").alias("document_id")), "document_id", "left_anti")
        self._swap(**tables)
        return n

    # ---- feedback and metadata

    def append_feedback(self, events: DataFrame) -> None:
        """Append ``query_text, document_id, relevance, kind`` with the time of arrival as a part of its own, the query folded, the relevance from -1 to 1."""
        relevance = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("relevance").cast("double")))
        new = events.select(folded("query_text").alias("query_text"), "document_id", relevance.alias("relevance"), "kind").withColumn("created_at", F.current_timestamp())
        self._swap(append=True, feedback=new)

    def delete_feedback_documents(self, ids: DataFrame) -> None:
        """Drop the feedback on some documents ``id``."""
        old = self._table("feedback")
        if old is not None:
            self._swap(feedback=old.join(ids.select(F.col("id").alias("document_id")).distinct(), "document_id", "left_anti"))

    def load_feedback(self) -> DataFrame | None:
        rows = self._table("feedback")
        return None if rows is None else rows.orderBy("created_at")

    def get_metadata(self, key: str, default: str | None = None) -> str | None:
        return self._state()["meta"].get(key, default)

    def set_metadata(self, key: str, value: str) -> None:
        state = self._state()
        self._point({**state, "meta": {**state["meta"], key: value}}, state["n"] + 1)


def upserted(old: DataFrame | None, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of ``new`` and those of ``old`` whose key ``new`` lacks; of equal keys in ``new`` the last by ``order``, or as the rows come."""
    place = F.monotonically_increasing_id() if order is None else F.col(order)
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_place")))
    new = new.withColumn("_place", place).withColumn("_last", last).where("_last = 1").drop("_place", "_last")
    return new if old is None else old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def replaced(old: DataFrame | None, new: DataFrame, source_id: str, source: str = "source_id") -> DataFrame:
    """``old`` with all rows of a source exchanged for ``new``."""
    return new if old is None else old.where(F.col(source).isNull() | (F.col(source) != source_id)).unionByName(new, allowMissingColumns=True)
