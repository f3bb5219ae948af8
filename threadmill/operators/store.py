"""The store of session records: versioned Parquet, incremental upsert, exclusions, tombstones, status.

Tables are written to fresh folders; then one manifest names the folders of all tables. Manifests are numbered, and a writer moves its
own to the next free number with a rename that fails where that number is taken. So a reader never sees half a store,
several tables move on together or not at all, a stopped writer leaves the store as it was, and of two writers that started from the same
manifest the second fails and starts again from the first one's result.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadmill.functions import text as T

#: Manifests kept, so that readers of an older one finish; tries of a writer, and seconds between them.
KEPT, TRIES, WAIT = 5, 8, 0.25


class Conflict(RuntimeError):
    """Another writer has moved the store on."""


class Store:
    """A folder on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path, hadoop = jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(hadoop)
        self.root = self._fs.makeQualified(self._path(self.root)).toString()
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), hadoop)
        self._scratch: list[str] = []
        options = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        self._no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        self._no_overwrite[0] = next(x for x in options.getEnumConstants() if x.toString() == "NONE")

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self, number: int | None = None) -> tuple[int, dict[str, str]]:
        """Number of the latest manifest, 0 for none, and the folder of every table."""
        number = number or next(reversed(self._numbers()), 0)
        if not number:
            return 0, {}
        with_lines = self.spark.read.text(f"{self.root}/manifest-{number}.json", wholetext=True).first()
        return number, json.loads(with_lines[0])

    def version(self, table: str) -> str | None:
        return self.manifest()[1].get(table)

    def read(self, table: str, of: dict[str, str] | None = None) -> DataFrame | None:
        name = (self.manifest()[1] if of is None else of).get(table)
        return self.spark.read.parquet(f"{self.root}/{name}") if name else None

    def put(self, table: str, df: DataFrame) -> str:
        """Write a table's new content aside; the name goes into a manifest."""
        name = f"{table}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        return name

    def scratch(self, df: DataFrame) -> DataFrame:
        """``df`` written once and read back, for what a change uses several times; goes when the change is through."""
        self._scratch.append(self.put("scratch", df))
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{self._scratch[-1]}")

    def commit(self, base: int, tables: dict[str, str]) -> int:
        """Publish ``tables`` as the manifest after ``base``."""
        temporary, number = self._path(f"{self.root}/.{uuid.uuid4().hex}.manifest"), base + 1
        out = self._fs.create(temporary, True)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        try:
            self._files.rename(temporary, self._path(f"{self.root}/manifest-{number}.json"), self._no_overwrite)
        except Py4JJavaError as e:
            self._fs.delete(temporary, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"manifest {number} is taken") from e
            raise
        return number

    def change(self, make: Callable[[dict[str, str]], dict[str, DataFrame | str | None]]) -> None:
        """Publish the tables that ``make`` derives from a manifest, all at once; anew if another writer was faster.

        A string is an entry as it stands, None takes an entry out.
        """
        for k in range(TRIES):
            number, tables = self.manifest()
            try:
                made = make(tables)
                if not made:
                    return
                made = {t: self.put(t, x) if isinstance(x, DataFrame) else x for t, x in made.items()}
                self.commit(number, {t: name for t, name in (tables | made).items() if name is not None})
            except Conflict:
                if k == TRIES - 1:
                    raise
                time.sleep(WAIT * 2**k)
            else:
                self._clean(number + 1)
                return
            finally:
                while self._scratch:
                    self._fs.delete(self._path(f"{self.root}/{self._scratch.pop()}"), True)

    def write(self, table: str, df: DataFrame) -> None:
        self.change(lambda _: {table: df})

    def _clean(self, number: int) -> None:
        """Delete manifests that are too old, and the folders that only they name."""
        old = [n for n in self._numbers() if n <= number - KEPT]
        if not old:
            return
        kept = set().union(*(self.manifest(n)[1].values() for n in self._numbers() if n > number - KEPT))
        for n in old:
            for name in set(self.manifest(n)[1].values()) - kept:
                self._fs.delete(self._path(f"{self.root}/{name}"), True)
            self._fs.delete(self._path(f"{self.root}/manifest-{n}.json"), False)


def latest_per_key(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(order.desc())
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def changed_only(files: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Transcripts (key, mtime, size, ...) whose size differs from the watermark's; the time does not count."""
    seen = watermarks.select("key", F.col("size").alias("_seen"))
    return files.join(seen, "key", "left").where(F.col("_seen").isNull() | (F.col("_seen") != F.col("size"))).drop("_seen")


def actions(stored: DataFrame, extracted: DataFrame, tombstones: DataFrame, globs: list[str], same: list[str]) -> DataFrame:
    """(sid, action) of an upsert: purged, tombstoned, excluded, new, changed or kept. ``same`` are the columns that tell a change."""
    a = stored.select("sid", F.col("cwd").alias("_cwd"), F.lit(True).alias("_old"), F.xxhash64(*same).alias("_h"))
    b = extracted.select("sid", F.col("cwd").alias("_cwd2"), F.lit(True).alias("_new"), F.xxhash64(*same).alias("_h2"))
    t = tombstones.select("sid", F.lit(True).alias("_dead")).distinct()
    both = a.join(b, "sid", "full_outer").join(t, "sid", "left")
    old, new = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    action = (
        F.when(old & T.cwd_excluded(F.col("_cwd"), globs), "purged").when(new & T.cwd_excluded(F.col("_cwd2"), globs), "excluded")
        .when(F.col("_dead").isNotNull(), "tombstoned").when(new & ~old, "new").when(new & (F.col("_h") != F.col("_h2")), "changed").otherwise("kept"))
    return both.select("sid", action.alias("action"))


def counters(done: DataFrame) -> DataFrame:
    """One row with the number of each action."""
    names = ["new", "changed", "kept", "purged", "excluded", "tombstoned"]
    return done.agg(*(F.count_if(F.col("action") == n).alias(n) for n in names), F.count("*").alias("total"))


def upsert(stored: DataFrame, extracted: DataFrame, tombstones: DataFrame, globs: list[str], carried: list[str], rescrub: bool = True) -> DataFrame:
    """The new store: extracted records replace stored ones but keep the ``carried`` columns (summary, segments, state);
    excluded and tombstoned ones go; what the others say of excluded paths is scrubbed, with ``rescrub`` in stored records, too, as it has
    to be when the globs have changed."""
    names = stored.columns
    dead = tombstones.select("sid").distinct()
    fresh = extracted.join(dead, "sid", "left_anti").where(~T.cwd_excluded(F.col("cwd"), globs))
    old = stored.where(~T.cwd_excluded(F.col("cwd"), globs))
    kept = old.join(fresh.select("sid"), "sid", "left_anti").select(*names)
    before = old.select("sid", *(F.col(c).alias(f"_{c}") for c in carried))
    merged = fresh.join(before, "sid", "left").select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in carried else F.col(c) for c in names))
    return (scrubbed(kept, globs) if rescrub else kept).unionByName(scrubbed(merged, globs))


def scrubbed(records: DataFrame, globs: list[str]) -> DataFrame:
    """Records whose manifests, excerpts and turns name no excluded path."""
    if not globs:
        return records
    for name, clean in (("files", T.scrub_files), ("excerpt", T.scrub_text), ("turns", lambda c, g: F.transform(c, lambda t: T.scrub_text(t, g)))):
        if name in records.columns:
            records = records.withColumn(name, clean(F.col(name), globs))
    return records


def same_globs(a: list[str], b: list[str]) -> bool:
    """Whether two sets of exclusions say the same; order and repeats don't count."""
    return sorted(set(a)) == sorted(set(b))


def forget(stored: DataFrame, tombstones: DataFrame, hit: Column) -> tuple[DataFrame, DataFrame]:
    """The store without the records ``hit``, and the tombstones with them."""
    gone = stored.where(hit).select("sid")
    return stored.where(~F.coalesce(hit, F.lit(False))), tombstones.select("sid").union(gone).distinct()


def status(records: DataFrame) -> DataFrame:
    """Counts by harness, and over all in the row whose harness is null."""
    state = F.col("summary_state")
    return records.rollup("harness").agg(
        F.count("*").alias("sessions"), F.count_if(state.isin("pending", "stale", "partial")).alias("pending"), F.count_if(state == "error").alias("errors"))


def index_diff(indexed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, change): delete, add or update by indexed_at; unchanged rows are left out."""
    a, b = indexed.select("sid", F.col("indexed_at").alias("_a"), F.lit(1).alias("_in")), wanted.select("sid", F.col("indexed_at").alias("_b"), F.lit(1).alias("_want"))
    d = a.join(b, "sid", "full_outer")
    change = F.when(F.col("_want").isNull(), "delete").when(F.col("_in").isNull(), "add").when(~F.col("_a").eqNullSafe(F.col("_b")), "update")
    return d.select("sid", change.alias("change")).where("change is not null")


def legacy_key(source: Column, session_id: Column) -> Column:
    """sid of an old row; null for unknown sources and empty ids."""
    some = F.coalesce(session_id, F.lit("")) != ""
    return F.when(some & (source == "claude"), F.concat(F.lit("claude/"), session_id)).when(some & (source == "codex"), F.concat(F.lit("codex/"), T.rollout_uuid(session_id)))


def legacy_bullets(blob: Column) -> Column:
    """(asked, completed, left_off) of an old bullet summary: a known header opens a field, further lines add to it, an unknown header ends it."""
    lines = F.split(F.coalesce(blob, F.lit("")), "\n")
    header = r"^\s*-\s*\*\*([^:*]+):\*\*\s*(.*)$"
    start = F.struct(*(F.lit("").alias(k) for k in ("current", "asked", "completed", "left_off")))

    def step(acc, raw):
        is_header = F.rlike(raw, F.lit(header))
        label = F.lower(T.trim_all(F.regexp_extract(raw, header, 1)))
        field = F.when(label == "asked", "asked").when(label == "done", "completed").when(label.isin("left off", "left-off"), "left_off").otherwise("")
        said, more = T.trim_all(F.regexp_extract(raw, header, 2)), T.trim_all(raw)
        current = F.when(is_header, field).otherwise(acc["current"])
        put = lambda k: F.when(is_header & (field == k), said).when(~is_header & (acc["current"] == k) & (more != ""), T.trim_all(F.concat(acc[k], F.lit(" "), more))).otherwise(acc[k])
        return F.struct(current.alias("current"), *(put(k).alias(k) for k in ("asked", "completed", "left_off")))

    blank = lambda c: F.when(F.contains(c, F.lit("_(summary unavailable)_")), "").otherwise(c)
    return F.aggregate(lines, start, step, lambda a: F.struct(*(blank(a[k]).alias(k) for k in ("asked", "completed", "left_off"))))


LEGACY = ("source string, session_id string, date string, cwd string, last_active string, model string, repo string, branch string, files array<array<string>>, "
          "commits array<array<string>>, keywords array<string>, prs array<string>, skills array<string>, mcp array<string>, open_todos array<string>, "
          "subagents array<array<string>>, resolved string, tests struct<text:string,broken:boolean>, summary string, transcript_path string")


def read_legacy(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Rows of an older store's JSON lines, and the number of lines that are no JSON objects."""
    raw = spark.read.text(path).where(F.rlike("value", F.lit(r"\S"))).select("value", F.try_parse_json("value").alias("v"))
    good = F.col("v").isNotNull() & F.startswith(F.schema_of_variant("v"), F.lit("OBJECT"))
    bad = raw.where(~F.coalesce(good, F.lit(False))).count()
    return raw.where(good).select(F.from_json("value", LEGACY).alias("r")).select("r.*"), bad


def convert(stored: DataFrame, legacy: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(sid, action) of an import: merge where the record exists without a summary, skip where it has one, append, tombstoned, unknown."""
    old = legacy.withColumn("sid", legacy_key(F.col("source"), F.col("session_id")))
    known = stored.select("sid", F.col("summary_state").alias("_state"))
    dead = tombstones.select("sid", F.lit(True).alias("_dead")).distinct()
    action = (
        F.when(F.col("sid").isNull(), "unknown").when(F.col("_dead").isNotNull(), "tombstoned").when(F.col("_state").isNull(), "append")
        .when(F.col("_state").isin("pending", "stale", "error"), "merge").otherwise("skip"))
    return old.join(known, "sid", "left").join(dead, "sid", "left").select("sid", "session_id", action.alias("action"))
