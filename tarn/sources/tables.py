"""Tables that statements change: Parquet folders under a root, with a list of which folders a table is now.

A statement writes new folders and then, in one step, a new version of the list, so that
readers see all of it or nothing.  Inserts only add a folder; updates, deletes and upserts
write the table anew.  Inside a transaction the new list is kept back until it commits.
One writer at a time is assumed; a version that another writer took is an error.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tarn.operators import relational


class Database:
    """Tables, views, sequences and comments under a folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._pending: dict | None = None
        self.views: dict[str, DataFrame] = {}

    # The list of tables

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _version(self) -> int:
        fs, path = self._fs(f"{self.root}/versions")
        found = [int(f.getPath().getName()) for f in fs.listStatus(path)] if fs.exists(path) else []
        return max(found, default=0)

    def _read(self) -> dict:
        if self._pending is not None:
            return self._pending
        version = self._version()
        if not version:
            return {"tables": {}, "sequences": {}, "comments": {}}
        row = self.spark.read.text(f"{self.root}/versions/{version}", wholetext=True).first()
        return json.loads(row.value)

    def _write(self, state: dict) -> None:
        if self._pending is not None:
            self._pending = state
            return
        fs, path = self._fs(f"{self.root}/versions/{self._version() + 1}")
        out = fs.create(path, False)  # an existing version is never overwritten
        out.write(bytearray(json.dumps(state).encode()))
        out.close()

    def _save(self, df: DataFrame) -> str:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return folder

    def _entry(self, state: dict, name: str) -> dict:
        if name not in state["tables"]:
            raise KeyError(f"table {name} does not exist")
        return state["tables"][name]

    # Transactions

    def begin(self) -> None:
        if self._pending is not None:
            raise RuntimeError("a transaction is open already")
        self._pending = json.loads(json.dumps(self._read()))

    def commit(self) -> None:
        if self._pending is None:
            raise RuntimeError("no transaction is open")
        state, self._pending = self._pending, None
        self._write(state)

    def rollback(self) -> None:
        if self._pending is None:
            raise RuntimeError("no transaction is open")
        self._pending = None

    # Tables

    def tables(self) -> list[str]:
        return sorted(self._read()["tables"])

    def table(self, name: str) -> DataFrame:
        if name in self.views:
            return self.views[name]
        entry = self._entry(self._read(), name)
        schema = StructType.fromJson(entry["schema"])
        return self.spark.read.schema(schema).parquet(*entry["folders"]) if entry["folders"] else self.spark.createDataFrame([], schema)

    def create(self, name: str, rows: DataFrame | StructType, replace: bool = False, if_not_exists: bool = False) -> None:
        """CREATE TABLE with a schema, or CREATE TABLE AS with rows."""
        state = self._read()
        if name in state["tables"] and not replace:
            if if_not_exists:
                return
            raise ValueError(f"table {name} exists")
        schema = rows if isinstance(rows, StructType) else rows.schema
        schema = StructType([StructField(f.name, f.dataType, True) for f in schema.fields])
        folders = [] if isinstance(rows, StructType) else [self._save(rows)]
        state["tables"][name] = {"schema": schema.jsonValue(), "folders": folders}
        self._write(state)

    def drop(self, name: str, if_exists: bool = False) -> None:
        state = self._read()
        if name in state["tables"] or not if_exists:
            self._entry(state, name)
            del state["tables"][name]
            self._write(state)

    def _cast(self, name: str, rows: DataFrame, by_name: bool) -> DataFrame:
        schema = self.table(name).schema
        if by_name:
            unknown = set(rows.columns) - set(schema.fieldNames())
            if unknown:
                raise ValueError(f"table {name} has no columns {sorted(unknown)}")
            return rows.select(
                *((F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields)
            )
        if len(rows.columns) != len(schema.fields):
            raise ValueError(f"table {name} has {len(schema.fields)} columns but {len(rows.columns)} values were supplied")
        own = rows.toDF(*(f"c{i}" for i in range(len(rows.columns))))
        return own.select(*(F.col(f"c{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)))

    def insert(self, name: str, rows: DataFrame, by_name: bool = False) -> DataFrame:
        """INSERT, by position or BY NAME (absent columns are null); the inserted rows come back, as RETURNING * gives them."""
        folder = self._save(self._cast(name, rows, by_name))
        state = self._read()
        entry = self._entry(state, name)
        entry["folders"].append(folder)
        self._write(state)
        return self.spark.read.schema(StructType.fromJson(entry["schema"])).parquet(folder)

    def _rewrite(self, name: str, rows: DataFrame) -> None:
        folder = self._save(rows)
        state = self._read()
        entry = self._entry(state, name)
        entry["folders"], entry["schema"] = [folder], StructType([StructField(f.name, f.dataType, True) for f in rows.schema.fields]).jsonValue()
        self._write(state)

    def upsert(self, name: str, rows: DataFrame, keys: Sequence[str], update: Mapping[str, Column] | None = None) -> None:
        self._rewrite(name, relational.insert_or(self.table(name), rows, keys, update))

    def update(self, name: str, condition: Column, **columns: Column) -> None:
        self._rewrite(name, relational.update_where(self.table(name), condition, **columns))

    def update_from(self, name: str, other: DataFrame, on: Sequence[str], **columns: Column) -> None:
        self._rewrite(name, relational.update_from(self.table(name), other, on, **columns))

    def delete(self, name: str, condition: Column) -> None:
        self._rewrite(name, relational.delete_where(self.table(name), condition))

    def delete_using(self, name: str, other: DataFrame, on: Sequence[str]) -> None:
        self._rewrite(name, relational.delete_using(self.table(name), other, on))

    def truncate(self, name: str) -> None:
        state = self._read()
        self._entry(state, name)["folders"] = []
        self._write(state)

    def copy_from(self, name: str, path: str, fmt: str = "parquet", **options) -> int:
        """COPY .. FROM a file of the table's columns; the number of rows.  A value that does not fit is an error."""
        schema = self.table(name).schema
        reader = self.spark.read.schema(schema).format(fmt).options(**({"mode": "FAILFAST"} if fmt in ("csv", "json") else {}), **options)
        return self.insert(name, reader.load(path)).count()

    # ALTER TABLE

    def add_column(self, name: str, column: str, kind: str, default: Column | None = None) -> None:
        value = (F.lit(None) if default is None else default).cast(kind)
        self._rewrite(name, self.table(name).withColumn(column, value))

    def drop_column(self, name: str, column: str) -> None:
        self._rewrite(name, relational.exclude(self.table(name), column))

    def rename_column(self, name: str, column: str, new: str) -> None:
        self._rewrite(name, self.table(name).withColumnRenamed(column, new))

    def set_type(self, name: str, column: str, kind: str) -> None:
        """ALTER .. TYPE: a value that cannot be cast is an error (with ANSI mode on)."""
        self._rewrite(name, relational.replace(self.table(name), **{column: F.col(column).cast(kind)}))

    def rename(self, name: str, new: str) -> None:
        state = self._read()
        if new in state["tables"]:
            raise ValueError(f"table {new} exists")
        state["tables"][new] = self._entry(state, name)
        del state["tables"][name]
        self._write(state)

    def comment(self, name: str, text: str | None = None) -> str | None:
        """COMMENT ON with ``text``; the comment without."""
        state = self._read()
        if text is not None:
            self._entry(state, name)
            state["comments"][name] = text
            self._write(state)
        return state["comments"].get(name)

    # Views and sequences

    def create_view(self, name: str, query: DataFrame, replace: bool = False) -> None:
        if name in self.views and not replace:
            raise ValueError(f"view {name} exists")
        self.views[name] = query

    def create_sequence(self, name: str, start: int = 1, increment: int = 1) -> None:
        state = self._read()
        if name in state["sequences"]:
            raise ValueError(f"sequence {name} exists")
        state["sequences"][name] = {"next": start, "increment": increment, "last": None}
        self._write(state)

    def nextval(self, name: str, rows: int = 1) -> int:
        """The next number, or the first of ``rows`` numbers taken at once."""
        state = self._read()
        own = state["sequences"][name]
        first = own["next"]
        own["next"] = first + rows * own["increment"]
        own["last"] = own["next"] - own["increment"]
        self._write(state)
        return first

    def currval(self, name: str) -> int:
        last = self._read()["sequences"][name]["last"]
        if last is None:
            raise RuntimeError(f"sequence {name} has given no value yet")
        return last

    def numbered(self, name: str, df: DataFrame, order: Sequence[Column | str], column: str = "id") -> DataFrame:
        """``df`` with a value of the sequence for each row, taken as one block."""
        from tarn.operators.joins import with_position

        step = self._read()["sequences"][name]["increment"]
        first = self.nextval(name, df.count())
        placed = with_position(df, order, "place_x")
        return placed.select((F.lit(first) + step * (F.col("place_x") - 1)).alias(column), *df.columns)

    def vacuum(self) -> int:
        """Deletes folders that no table of the current version is made of; how many."""
        state = self._read()
        used = {f.rsplit("/", 1)[-1] for t in state["tables"].values() for f in t["folders"]}
        fs, path = self._fs(f"{self.root}/data")
        gone = [f.getPath() for f in fs.listStatus(path) if f.getPath().getName() not in used] if fs.exists(path) else []
        for p in gone:
            fs.delete(p, True)
        return len(gone)
