"""Where facts, memberships, values and pointers live: in memory for tests, or in a folder of Parquet tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from .lineage import cut


#: Changes that lie on a table unmerged; the share of a table's rows that they reach before it is written anew.
LAYERS, SHARE = 8, 0.25


class Layered:
    """Tables as a base and the changes since, so that a change writes what changed and not the table.

    A change takes all rows away that have certain keys, then adds rows. Reads put the layers together. Where there are LAYERS
    changes, they are merged into one, and into the base only where their keys come to SHARE of its rows, so that each row is
    written a number of times that grows with the logarithm of the table.
    """

    #: For each table: the base and its rows, and the changes, oldest first: column, keys, rows and how many keys.
    tables: dict[str, dict]
    #: Bookkeeping that is committed with the tables: versions, debts, marks of streams.
    pointers: dict[str, str]

    def _save(self, df: DataFrame, at: str) -> object:
        raise NotImplementedError

    def _load(self, handle: object) -> DataFrame:
        raise NotImplementedError

    def get(self, area: str, name: str) -> DataFrame | None:
        t = self.tables.get(f"{area}/{name}")
        if t is None:
            return None
        df = self._load(t["base"])
        for column, keys, rows, _ in t["changes"]:
            df = df.join(self._load(keys), column, "left_anti").select(df.columns).unionByName(self._load(rows))
        return df

    def put(self, area: str, name: str, df: DataFrame) -> DataFrame:
        """Write a whole table."""
        at = f"{area}/{name}"
        base = self._save(df, at)
        out = self._load(base)
        self.tables[at] = {"base": base, "rows": None, "changes": []}
        return out

    def change(self, area: str, name: str, rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
        """Of a table that is there, take away the rows with these keys (a column of that name) and add the rows."""
        at = f"{area}/{name}"
        t = self.tables[at]
        keys, rows = self._save(keys.select(column).distinct(), at), self._save(rows.select(self._load(t["base"]).columns), at)
        n = self._load(keys).count()
        changes = [*t["changes"], [column, keys, rows, n]]
        whole = t["rows"] if t["rows"] is not None else self._load(t["base"]).count()
        self.tables[at] = {"base": t["base"], "rows": whole, "changes": changes}
        if sum(c[3] for c in changes) > SHARE * max(whole, 1):
            return self.put(area, name, self.get(area, name))
        if len(changes) >= LAYERS and len({c[0] for c in changes}) == 1:
            every, merged = self._load(changes[0][1]), self._load(changes[0][2])
            for _, k, r, _ in changes[1:]:
                merged = merged.join(self._load(k), column, "left_anti").select(merged.columns).unionByName(self._load(r))
                every = every.unionByName(self._load(k))
            keys, rows = self._save(every.distinct(), at), self._save(merged, at)
            self.tables[at]["changes"] = [[column, keys, rows, self._load(keys).count()]]
        return self.get(area, name)

    def names(self, area: str) -> list[str]:
        return [at.split("/", 1)[1] for at in self.tables if at.split("/", 1)[0] == area]

    def drop(self, area: str, name: str) -> None:
        self.tables.pop(f"{area}/{name}", None)


class MemoryStore(Layered):
    """State as checkpointed frames of one session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables, self.pointers = spark, {}, {}

    def _save(self, df: DataFrame, at: str) -> DataFrame:
        return cut(df)

    def _load(self, handle: DataFrame) -> DataFrame:
        return handle

    def commit(self) -> None:
        """Nothing to do: writes take effect at once."""


class FolderStore(Layered):
    """A folder that all machines reach. Tables are written beside those in use; one small state row, written last,
    says which ones count, so a pass takes effect as a whole or not at all. Readers see the last whole state."""

    def __init__(self, spark: SparkSession, folder: str, tenant: str = "default"):
        self.spark, self.root = spark, f"{folder.rstrip('/')}/{tenant}"
        self.number, state = self._latest()
        self.tables, self.pointers = state.get("tables", {}), state.get("pointers", {})

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _latest(self) -> tuple[int, dict]:
        fs, p = self._fs(f"{self.root}/state")
        if not fs.exists(p):
            return 0, {}
        done = [int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit() and fs.exists(self._fs(f"{s.getPath()}/_SUCCESS")[1])]
        if not done:
            return 0, {}
        return max(done), json.loads(self.spark.read.text(f"{self.root}/state/{max(done):09d}").first()["value"])

    def _save(self, df: DataFrame, at: str) -> str:
        path = f"{self.root}/{at}/{uuid.uuid4()}"
        df.write.parquet(path)
        return path

    def _load(self, handle: str) -> DataFrame:
        return self.spark.read.parquet(handle)

    def commit(self) -> None:
        self.number += 1
        state = json.dumps({"tables": self.tables, "pointers": self.pointers}, sort_keys=True)
        self.spark.createDataFrame([(state,)], "value string").coalesce(1).write.text(f"{self.root}/state/{self.number:09d}")

    def vacuum(self, keep: int = 1) -> int:
        """Delete tables that none of the last `keep` states names; the number deleted."""
        fs, p = self._fs(self.root)
        states = range(max(1, self.number - keep + 1), self.number + 1)
        tables = [t for n in states for t in json.loads(self.spark.read.text(f"{self.root}/state/{n:09d}").first()["value"])["tables"].values()]
        used = {at for t in tables for at in [t["base"], *[x for c in t["changes"] for x in c[1:3]]]}
        gone = 0
        for area in fs.listStatus(p):
            if area.getPath().getName() == "state":
                continue
            for name in fs.listStatus(area.getPath()):
                for version in fs.listStatus(name.getPath()):
                    at = str(version.getPath())
                    if not any(at.endswith(u.split(":", 1)[-1].lstrip("/")) for u in used):
                        gone += bool(fs.delete(version.getPath(), True))
        return gone

    def delete_tenant(self) -> bool:
        """Remove all that the tenant has."""
        fs, p = self._fs(self.root)
        self.tables, self.pointers, self.number = {}, {}, 0
        return bool(fs.exists(p) and fs.delete(p, True))
