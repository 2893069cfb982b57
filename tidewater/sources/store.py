"""A versioned table: Parquet files under numbered manifests, with two time axes.

Each row has a birth ``_seq`` and a row id ``_rid``; a delete or an update writes the rows that it ends, with the sequence that ended them. A manifest lists
the files of one version, with the ranges of sequences and keys in them, and is published by one rename; readers hold a manifest and never see later
writes. A row is visible as of n if its birth is at most n and it has no kill or one after n. What changed since a sequence is read from the
files whose ranges reach it, so that costs what changed and not what the table holds. Compaction sorts live rows by the ordering key into new files; the ended
ones stay where they are, as history.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.plans.parse import Refused
from tidewater.sources.fs import Folder

SPARK_TYPES = {"bigint": T.LongType(), "double": T.DoubleType(), "symbol": T.StringType()}
SEQ, RID, KILL = "_seq", "_rid", "_kill"
FLUSH_ROWS = 65536
GROUP_MS = 100


@dataclass
class Manifest:
    version: int = 0
    next_seq: int = 0
    next_rid: int = 0
    generation: int = 0
    #: Files: {"path", "rows", "seq": [least, largest], "key": [least, largest]}; of kills and history, ``seq`` is that of the kill.
    adds: list = field(default_factory=list)
    kills: list = field(default_factory=list)
    history: list = field(default_factory=list)
    streams: dict = field(default_factory=dict)  # stream -> its last batch


def schema_of(columns: list[tuple[str, str, bool]]) -> T.StructType:
    return T.StructType([T.StructField(n, SPARK_TYPES[k], null, {"kind": k}) for n, k, null in columns])


def coerce(value, name: str, kind: str, nullable: bool):
    """Exact or loud: a whole number becomes a double only if that is exact, a fraction never becomes a bigint, numbers and symbols don't mix."""
    if value is None:
        if not nullable:
            raise Refused(f"{name} is NOT NULL")
        return None
    if kind == "symbol":
        if not isinstance(value, str):
            raise Refused(f"{name} is a SYMBOL, {value!r} isn't")
        return value
    if isinstance(value, (str, bool)) or not isinstance(value, (int, float)):
        raise Refused(f"{name} is a number, {value!r} isn't")
    if kind == "bigint":
        if not isinstance(value, int) or not -(2**63) <= value < 2**63:
            raise Refused(f"{name} is a BIGINT, {value!r} isn't")
        return value
    if isinstance(value, int) and int(float(value)) != value:
        raise Refused(f"{value} isn't exact as a DOUBLE")
    return float(value)


class Store:
    def __init__(self, spark: SparkSession, path: str, columns: list[tuple[str, str, bool]], key: str, read_only: bool = False, sync: str = "full", flush_rows: int = FLUSH_ROWS):
        if sync not in ("full", "group", "off"):
            raise ValueError(f"sync is full, group or off, not {sync}")
        self.spark, self.columns, self.key, self.read_only, self.sync, self.flush_rows = spark, columns, key, read_only, sync, flush_rows
        self.log, self.synced = None, 0.0
        self.folder, self.schema, self.buffer = Folder(spark, path), schema_of(columns), []
        self.full = T.StructType([*self.schema.fields, T.StructField(SEQ, T.LongType(), False), T.StructField(RID, T.LongType(), False)])
        self.ended = T.StructType([*self.full.fields, T.StructField(KILL, T.LongType(), True)])
        self.refresh()
        if not read_only:
            self._replay()

    @classmethod
    def create(cls, spark: SparkSession, path: str, columns: list[tuple[str, str, bool]], key: str, sync: str = "full") -> Store:
        folder = Folder(spark, path)
        folder.make()
        folder.write("def.json", json.dumps({"columns": columns, "key": key}), new=True)
        folder.write(_name(0), json.dumps(asdict(Manifest())), new=True)
        return cls(spark, path, columns, key, sync=sync)

    @classmethod
    def open(cls, spark: SparkSession, path: str, read_only: bool = False, sync: str = "full") -> Store:
        made = json.loads(Folder(spark, path).read("def.json"))
        return cls(spark, path, [tuple(c) for c in made["columns"]], made["key"], read_only, sync)

    # versions
    def refresh(self) -> int:
        """Takes up the newest version that is published."""
        self.manifest = Manifest(**json.loads(self.folder.read(self.folder.names("manifest-")[-1])))
        return self.manifest.version

    def _publish(self, m: Manifest) -> None:
        if self.read_only:
            raise Refused("the table is open for reading only")
        m.version += 1
        self.folder.write(_name(m.version), json.dumps(asdict(m)), new=True)  # a second writer's version fails here
        self.manifest = m

    def _copy(self) -> Manifest:
        return Manifest(**json.loads(json.dumps(asdict(self.manifest))))

    def next_sequence(self) -> int:
        return self.manifest.next_seq + len(self.buffer)

    # writing
    def append(self, values: dict | list) -> int:
        """One row; it is checked now and written with others. Returns its row id."""
        return self.append_rows([values])

    def append_rows(self, rows: list) -> int:
        made = []
        for r in rows:
            if isinstance(r, dict):
                unknown = [c for c in r if c not in self.schema.fieldNames()]
                if unknown:
                    raise Refused(f"no column {unknown[0]}")
                r = [r.get(n) for n in self.schema.fieldNames()]
            if len(r) != len(self.columns):
                raise Refused(f"a row has {len(self.columns)} values, not {len(r)}")
            made.append(tuple(coerce(v, *c) for v, c in zip(r, self.columns, strict=True)))
        if self.read_only:
            raise Refused("the table is open for reading only")
        first = self.manifest.next_rid + len(self.buffer)
        if self.sync != "off":
            self._logged(made)
        self.buffer += made
        if len(self.buffer) >= self.flush_rows:
            self.flush()
        return first

    def _logged(self, rows: list) -> None:
        """Rows go to a log before append returns; the log is named by the first row id that isn't published, so a version that holds the rows ends it."""
        if self.log is None:
            self.log = self.folder.log(f"log-{self.manifest.next_rid:020d}.jsonl")
        self.log.write(bytearray("".join(json.dumps(r) + "\n" for r in rows).encode("utf-8")))
        if self.sync == "full" or time.monotonic() - self.synced > GROUP_MS / 1000:
            self.log.hsync()
            self.synced = time.monotonic()

    def _replay(self) -> None:
        """Rows that were appended and not published when the last writer ended. A last line that isn't whole was never acknowledged."""
        for name in self.folder.names("log-"):
            if int(name[4:24]) == self.manifest.next_rid:
                self.buffer = [tuple(json.loads(x)) for x in self.folder.read(name).split("\n")[:-1]]
        if self.buffer:
            self.flush()
        self._end_log()

    def _end_log(self) -> None:
        if self.log is not None:
            self.log.close()
            self.log = None
        for name in self.folder.names("log-"):
            if int(name[4:24]) < self.manifest.next_rid:
                self.folder.remove(name)

    def flush(self) -> None:
        if not self.buffer:
            return
        m = self._copy()
        rows = [(*r, m.next_seq + i, m.next_rid + i) for i, r in enumerate(self.buffer)]
        at = self.schema.fieldNames().index(self.key)
        keys = [r[at] for r in rows]
        self._add(m, self.spark.createDataFrame(rows, self.full).coalesce(1), len(rows), (m.next_seq, m.next_seq + len(rows) - 1), (min(keys), max(keys)))
        m.next_seq, m.next_rid = m.next_seq + len(rows), m.next_rid + len(rows)
        self._publish(m)
        self.buffer = []
        if self.sync != "off":
            self._end_log()

    def _add(self, m: Manifest, df: DataFrame, rows: int, seq: tuple, key: tuple) -> None:
        path = self.folder.at("adds", uuid.uuid4().hex)
        df.write.parquet(path)
        m.adds.append({"path": path, "rows": rows, "seq": list(seq), "key": list(key)})

    def _staged(self, local: DataFrame) -> tuple[str, DataFrame, Column, int, tuple]:
        """Rows with __n (part * 2^33 + place in it), written: (folder, rows, their place among all rows, how many they are, range of keys). Only one
        row a part comes to the driver."""
        path = self.folder.at("staged", uuid.uuid4().hex)
        local.write.parquet(path)
        staged = self.spark.read.parquet(path)
        part = F.shiftright("__n", 33)
        found = staged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min(self.key).alias("lo"), F.max(self.key).alias("hi")).collect()
        before, total = [0] * (max((r["p"] for r in found), default=-1) + 1), 0
        for r in sorted(found, key=lambda r: r["p"]):
            before[r["p"]], total = total, total + r["n"]
        place = F.get(F.array(*[F.lit(x).cast("long") for x in before]), part.cast("int")) + (F.col("__n") % F.lit(1 << 33)) if total else F.lit(0)
        return path, staged, place, total, (min((r["lo"] for r in found), default=0), max((r["hi"] for r in found), default=0))

    def append_frame(self, df: DataFrame, order: list[str] | None = None, batch: tuple[str, int] | None = None) -> int:
        """Rows of a DataFrame, numbered in ``order`` (default: the ordering key). They are sorted and numbered in parallel: parts are written with local numbers,
        and only the parts' row counts come to the driver. batch: (stream, number); a batch up to the last one of that stream isn't appended again."""
        self.flush()
        m = self._copy()
        if batch is not None:
            if m.streams.get(batch[0], -1) >= batch[1]:
                return 0
            m.streams[batch[0]] = batch[1]
        order = order or [self.key]
        local = self._checked(df).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__n", F.monotonically_increasing_id())
        path, staged, place, total, keys = self._staged(local)
        if total:
            rows = staged.select(*self.schema.fieldNames(), (place + m.next_seq).alias(SEQ), (place + m.next_rid).alias(RID))
            self._add(m, rows, total, (m.next_seq, m.next_seq + total - 1), keys)
            m.next_seq, m.next_rid = m.next_seq + total, m.next_rid + total
        if total or batch is not None:
            self._publish(m)
        self.folder.remove(f"staged/{path.rsplit('/', 1)[1]}")
        return total

    def _checked(self, df: DataFrame) -> DataFrame:
        unknown = [c for c in df.columns if c not in self.schema.fieldNames()]
        if unknown:
            raise Refused(f"no column {unknown[0]}")
        cols = []
        for n, kind, null in self.columns:
            c = F.col(n).cast(SPARK_TYPES[kind]) if n in df.columns else F.lit(None).cast(SPARK_TYPES[kind])
            cols.append((c if null else F.when(c.isNull(), F.raise_error(F.lit(f"{n} is NOT NULL")).cast(SPARK_TYPES[kind])).otherwise(c)).alias(n))
        return df.select(*cols)

    # reading
    def _read(self, files: list[dict], schema: T.StructType, since: int | None = None, keys: tuple | None = None) -> DataFrame:
        """since: only files with sequences from there on; keys: only files that have keys in this range."""
        relaxed = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in schema.fields])
        paths = [f["path"] for f in files if (since is None or f["seq"][1] >= since) and (keys is None or f["key"][0] <= keys[1] and f["key"][1] >= keys[0])]
        return self.spark.read.schema(relaxed).parquet(*paths) if paths else self.spark.createDataFrame([], relaxed)

    def key_range(self) -> tuple[int, int] | None:
        """Least and largest key of rows that were ever alive since the last compaction: no row has one outside."""
        self.flush() if not self.read_only else None
        found = [f["key"] for f in self.manifest.adds if f["rows"]]
        return (min(k[0] for k in found), max(k[1] for k in found)) if found else None

    def frame(self, as_of: int | None = None, manifest: Manifest | None = None, keys: tuple | None = None) -> DataFrame:
        """Visible rows with _seq and _rid, now or as of a sequence. keys: those with other keys may be left out."""
        if manifest is None:
            self.flush() if not self.read_only else None
        m = manifest or self.manifest
        adds = self._read(m.adds, self.full, keys=keys)
        live = adds.join(self._read(m.kills, self.ended, keys=keys).select(RID), RID, "left_anti").select(*self.full.fieldNames()) if m.kills else adds
        if as_of is None:
            return live
        n = F.lit(as_of).cast("long")
        ended = self._read([*m.kills, *m.history], self.ended, keys=keys).where(F.col(KILL) > n).drop(KILL)
        return live.unionByName(ended).where(F.col(SEQ) <= n)

    def touched_rows(self, since: int) -> DataFrame:
        """Rows that were born or ended at or after ``since``, read from the files that hold such rows."""
        self.flush() if not self.read_only else None
        m = self.manifest
        born = self._read(m.adds, self.full, since).where(F.col(SEQ) >= since)
        return born.unionByName(self._read([*m.kills, *m.history], self.ended, since).where(F.col(KILL) >= since).drop(KILL))

    def touched_range(self, since: int) -> tuple[int, int] | None:
        """Least and largest key of files with rows that were born or ended at or after ``since``, by the manifest alone; None: there are none."""
        self.flush() if not self.read_only else None
        m = self.manifest
        found = [f["key"] for f in [*m.adds, *m.kills, *m.history] if f["seq"][1] >= since]
        return (min(k[0] for k in found), max(k[1] for k in found)) if found else None

    def touched_keys(self, since: int) -> DataFrame:
        """Ordering keys of ``touched_rows``."""
        return self.touched_rows(since).select(self.key).distinct()

    # changing
    def _kill(self, m: Manifest, hit: DataFrame) -> int:
        """Ends rows at the next sequence; returns how many."""
        path = self.folder.at("kills", uuid.uuid4().hex)
        hit.select(*self.full.fieldNames(), F.lit(m.next_seq).cast("long").alias(KILL)).write.parquet(path)
        n, lo, hi = self.spark.read.parquet(path).agg(F.count(F.lit(1)), F.min(self.key), F.max(self.key)).first()
        if n:
            m.kills.append({"path": path, "rows": n, "seq": [m.next_seq, m.next_seq], "key": [lo, hi]})
        return n

    def delete(self, where: Column | None) -> int:
        """All rows it ends have one sequence; a delete that matches nothing spends none."""
        self.flush()
        m = self._copy()
        n = self._kill(m, self.frame() if where is None else self.frame().where(where))
        if n:
            m.next_seq += 1
            self._publish(m)
        return n

    def update(self, sets: dict, where: Column | None) -> int:
        """Replacements and kills share one sequence."""
        for c, v in sets.items():
            found = [x for x in self.columns if x[0] == c]
            if not found:
                raise Refused(f"no column {c}")
            coerce(v, *found[0])
        hit = self.frame() if where is None else self.frame().where(where)
        kinds = {n: k for n, k, _ in self.columns}
        new = hit.select(*[F.lit(None if sets[c] is None else float(sets[c]) if kinds[c] == "double" else sets[c]).cast(SPARK_TYPES[kinds[c]]).alias(c) if c in sets else F.col(c) for c in self.schema.fieldNames()], RID)
        return self.supersede(new, hit)

    def supersede(self, rows: DataFrame, victims: DataFrame, least: int = 1) -> int:
        """Rows replace victims in one event; without victims nothing happens unless least is 0."""
        self.flush()
        m = self._copy()
        n = self._kill(m, victims)
        if n < least:
            return 0
        numbered = self._numbered(rows, m)
        if n or numbered:
            m.next_seq += 1
            self._publish(m)
        return n

    def _numbered(self, rows: DataFrame, m: Manifest) -> int:
        local = rows.sortWithinPartitions(*([RID] if RID in rows.columns else [self.key])).select(*self.schema.fieldNames(), F.monotonically_increasing_id().alias("__n"))
        path, staged, place, total, keys = self._staged(local)
        if total:
            self._add(m, staged.select(*self.schema.fieldNames(), F.lit(m.next_seq).cast("long").alias(SEQ), (place + m.next_rid).alias(RID)), total, (m.next_seq, m.next_seq), keys)
            m.next_rid += total
        self.folder.remove(f"staged/{path.rsplit('/', 1)[1]}")
        return total

    def compact(self) -> None:
        """Live rows sorted by (key, row id) in new files; the ended ones become history as they are. Sequences and row ids stay."""
        self.flush()
        m = self._copy()
        path = self.folder.at("adds", uuid.uuid4().hex)
        self.frame().repartitionByRange(self.key, RID).sortWithinPartitions(self.key, RID).write.parquet(path)
        name = F.col("_metadata.file_path")
        found = self.spark.read.schema(self.full).parquet(path).groupBy(name.alias("f")).agg(F.count(F.lit(1)).alias("n"), F.min(SEQ).alias("s"), F.max(SEQ).alias("t"), F.min(self.key).alias("lo"), F.max(self.key).alias("hi")).collect()
        m.adds = [{"path": r["f"], "rows": r["n"], "seq": [r["s"], r["t"]], "key": [r["lo"], r["hi"]]} for r in sorted(found, key=lambda r: (r["lo"], r["f"]))]
        m.history, m.kills, m.generation = [*m.history, *m.kills], [], m.generation + 1
        self._publish(m)

    def vacuum(self, keep: int = 1) -> int:
        """Removes files that none of the last ``keep`` versions names, and older manifests; returns how many. Readers of older versions lose theirs."""
        self.flush()
        names = self.folder.names("manifest-")
        used = {f["path"] for n in names[-keep:] for kind in ("adds", "kills", "history") for f in json.loads(self.folder.read(n))[kind]}
        gone = 0
        for kind in ("adds", "kills", "history", "staged"):
            for n in self.folder.names(under=kind):
                path = self.folder.at(kind, n)
                if not any(u == path or u.split(":", 1)[-1].lstrip("/").startswith(path.split(":", 1)[-1].lstrip("/") + "/") for u in used):
                    self.folder.remove(f"{kind}/{n}")
                    gone += 1
        for n in names[:-keep]:
            self.folder.remove(n)
        return gone


def _name(version: int) -> str:
    return f"manifest-{version:012d}.json"
