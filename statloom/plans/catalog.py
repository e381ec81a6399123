"""Named datasets and how each came about, kept as temporary views and one lineage table."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

LINEAGE = "name string, parent string, kind string, transform string, params string, ts string"


@dataclass
class Entry:
    name: str
    parent: str | None
    kind: str  # original, transform, split, doe_design, results, session
    transform: str | None
    params: dict = field(default_factory=dict)
    ts: str = ""


class Workspace:
    """Datasets of one analysis: lazy DataFrames under names, with their lineage."""

    def __init__(self, spark: SparkSession):
        self.spark, self.entries, self.frames, self.current = spark, {}, {}, None

    def save(self, name: str, df: DataFrame, parent: str | None = None, kind: str = "original", transform: str | None = None, **params) -> DataFrame:
        """Keep a dataset; an original of the same name is kept once."""
        if kind == "original" and name in self.entries:
            return self.frames[name]
        self.entries[name] = Entry(name, parent, kind, transform, params, datetime.now(timezone.utc).isoformat())
        self.frames[name] = df
        df.createOrReplaceTempView(self.view(name))
        return df

    @staticmethod
    def view(name: str) -> str:
        return "ws_" + "".join(c if c.isalnum() else "_" for c in name)

    def split(self, name: str, row_id: str, chosen: DataFrame, method: str = "Manual") -> tuple[DataFrame, DataFrame]:
        from statloom.operators.select import split

        a, b = split(self.frames[name], row_id, chosen)
        for suffix, df in (("Selected", a), ("Remaining", b)):
            self.save(f"{name}_{suffix}", df, name, "split", method)
        return a, b

    def activate(self, name: str) -> DataFrame:
        self.current = name
        return self.frames[name]

    def metadata(self, name: str) -> Entry | None:
        return self.entries.get(name)

    def delete(self, name: str) -> bool:
        if name not in self.entries:
            return False
        self.spark.catalog.dropTempView(self.view(name))
        del self.entries[name], self.frames[name]
        self.current = None if self.current == name else self.current
        return True

    def clear(self, kind: str) -> int:
        names = [n for n, e in self.entries.items() if e.kind == kind]
        return sum(self.delete(n) for n in names)

    def lineage(self) -> DataFrame:
        rows = [(e.name, e.parent, e.kind, e.transform, json.dumps(e.params, default=str), e.ts) for e in self.entries.values()]
        return self.spark.createDataFrame(rows, LINEAGE)

    def recent(self, n: int = 5) -> DataFrame:
        return self.lineage().where("kind = 'transform'").orderBy("ts", ascending=False).limit(n)

    def counts(self) -> DataFrame:
        """Number of datasets by kind and by parent, and in all."""
        return self.lineage().groupingSets([["kind"], ["parent"], []], "kind", "parent").count()

    def write(self, path: str) -> None:
        for n, df in self.frames.items():
            df.write.mode("overwrite").parquet(f"{path}/{self.view(n)}")
        body = json.dumps([asdict(e) for e in self.entries.values()], default=str)
        self.spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/entries")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Workspace:
        self = cls(spark)
        for d in json.loads(spark.read.text(f"{path}/entries").first()[0]):
            e = Entry(**d)
            self.entries[e.name], self.frames[e.name] = e, spark.read.parquet(f"{path}/{self.view(e.name)}")
        return self

    def pretreatments(self, name: str) -> list[Entry]:
        """The transforms that led to a dataset, the latest first."""
        out, at = [], self.entries.get(name)
        while at is not None:
            if at.kind == "transform":
                out.append(at)
            at = self.entries.get(at.parent) if at.parent else None
        return out
