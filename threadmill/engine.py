"""The verbs over a store: ingest, search, show, resume, status, forget, backfill, capture, convert."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.functions import text as T
from threadmill.operators import records as R
from threadmill.operators import index, render, search, segments, store
from threadmill.sources import logs
from threadmill.streaming import capture


class Engine:
    """``sources`` are (family, roots); ``exclude`` are globs of folders whose sessions must not be kept."""

    def __init__(self, spark: SparkSession, root: str, sources: list[tuple[str, list[str]]] = (), exclude: list[str] = (), prefer: str = "same"):
        self.spark, self.store, self.sources, self.exclude, self.prefer = spark, store.Store(spark, root), list(sources), list(exclude), prefer

    def _table(self, name: str, kind: str, tables: dict[str, str] | None = None) -> DataFrame:
        found = self.store.read(name, tables)
        return self.spark.createDataFrame([], kind) if found is None else found

    def sessions(self, tables: dict[str, str] | None = None) -> DataFrame:
        found = self.store.read("sessions", tables)
        return R.conform(self.spark.createDataFrame([], "sid string")) if found is None else found

    def tombstones(self, tables: dict[str, str] | None = None) -> DataFrame:
        return self._table("tombstones", "sid string", tables)

    def listed(self, only: list[str] | None = None) -> DataFrame:
        """family, key, path, mtime and size of the transcripts, none of them read; ``only`` keeps those whose path ends with one of some."""
        found = self.spark.createDataFrame([], "family string, key string, path string, mtime timestamp, size bigint")
        for family, roots in self.sources:
            if roots:
                found = found.unionByName(logs.keyed(logs.files(self.spark, roots, family), family).withColumn("family", F.lit(family)))
        if only is None:
            return found
        ends = [F.endswith("path", F.lit(x)) for x in only]
        return found.where(reduce(lambda a, b: a | b, ends)) if ends else found.limit(0)

    def extracted(self, files: list[tuple[str, str]]) -> DataFrame:
        """Records of (family, path) files."""
        out = R.conform(self.spark.createDataFrame([], "sid string"))
        for family in sorted({f for f, _ in files}):
            rows = logs.extract_files(self.spark, [p for f, p in files if f == family], family)
            said = F.transform("turns", lambda t: F.concat(t["role"], F.lit(": "), t["text"]))
            out = out.unionByName(R.conform(rows.withColumn("transcript_path", F.col("path")).withColumn("turns", said)))
        return out

    def ingest(self, now: str, event: str | None = None, trigger: str | None = None, only: str | None = None) -> dict:
        """Read the transcripts whose size has changed, fold them, cut segments, and move the store on. Returns the counters."""
        calls = self.spark.createDataFrame([(only or "", event, trigger)], "suffix string, event string, trigger string")
        return self.ingest_calls(now, calls, None if only is None else [only])

    def ingest_calls(self, now: str, calls: DataFrame, only: list[str] | None) -> dict:
        """One ingest for any number of calls (suffix of a path, event, trigger); ``only`` are the suffixes, None is every transcript.

        Files are told by size before any is read; sessions, watermarks and exclusions move on together.
        """
        done: dict = {}

        def make(tables: dict[str, str]) -> dict[str, DataFrame]:
            marks = self._table("watermarks", "key string, mtime timestamp, size bigint", tables)
            was = [r[0] for r in self._table("exclusions", "glob string", tables).collect()]
            seen = self.listed(only)
            # a listing, as the readers hold on the driver, too
            files = [(r["family"], r["path"]) for r in store.changed_only(seen, marks).select("family", "path").collect()]
            old = self.sessions(tables)
            new = store.scrubbed(self.extracted(files).withColumn("indexed_at", F.lit(now)), self.exclude)
            had = old.select("sid", F.col("segments").alias("_segments"), F.col("summary_state").alias("_state"), F.col("summary").alias("_summary"), F.col("client").alias("_client"))
            why = new.select("sid", "transcript_path").join(F.broadcast(calls), F.endswith("transcript_path", F.col("suffix"))) if files else None
            new = new.join(had, "sid", "left").withColumn("segments", F.coalesce("_segments", "segments")).withColumn("client", F.coalesce("client", "_client"))
            none = F.lit(None).cast("string")
            new = new.join(why.groupBy("sid").agg(F.max("event").alias("_event"), F.max("trigger").alias("_trigger")), "sid", "left") if files else new.withColumns({"_event": none, "_trigger": none})
            cut = segments.cut(F.col("segments"), F.col("boundaries"), F.col("turn_count"), F.coalesce("size", F.lit(0)), F.lit(now), F.col("_event"), F.col("_trigger"))
            state = F.when(F.col("_state") == "done", "stale").otherwise(F.coalesce("_state", "summary_state"))
            new = new.withColumn("segments", cut).withColumn("summary_state", segments.rollup(F.col("segments"), state))
            new = self.store.scratch(R.conform(new))  # counted and merged from one extraction
            same = ["date", "cwd", "model", "excerpt", "size"]
            done.clear()
            done.update(store.counters(store.actions(old, new, self.tombstones(tables), self.exclude, same)).first().asDict())
            kept = marks.join(seen.select("key"), "key", "left_anti").select("key", "mtime", "size")
            changed = not store.same_globs(was, self.exclude)
            return {
                "sessions": R.conform(store.upsert(old, new, self.tombstones(tables), self.exclude, ["summary"], rescrub=changed)),
                "watermarks": kept.unionByName(seen.select("key", "mtime", "size")),
                "exclusions": self.spark.createDataFrame([(g,) for g in sorted(set(self.exclude))], "glob string")}

        self.store.change(make)
        return done

    def search(self, terms: list[str], today: str, engine: str = "fts", limit: int = search.LIMIT, **wanted) -> DataFrame:
        """Ranked records. The stored index is brought up to the store first."""
        if engine == "linear" or not terms or self.store.version("sessions") is None:
            return search.search(self.sessions(), search.haystack(R.search_text()), terms, today, "linear", limit, **wanted)
        index.sync(self.store)
        return search.rank(search.filters(self.sessions(), **wanted), index.scores(self.store, terms), today, limit)

    def lines(self, hits: DataFrame, form: str = "compact") -> DataFrame:
        """(score, line) of search results as compact lines, full blocks or JSON objects."""
        c = F.col
        forms = {"compact": lambda: render.compact(c("date"), c("harness"), c("model"), c("cwd"), c("sid"), c("summary")["asked"]), "full": render.full, "ndjson": lambda: render.ndjson([n for n in R.SCHEMA if n in hits.columns])}
        return hits.select("score", forms[form]().alias("line"))

    def show(self, prefix: str, tail: int = 4000) -> str:
        one = search.resolve_one(self.sessions(), prefix)["sid"]
        r = self.sessions().where(F.col("sid") == one)
        return render.show(r, r.select("sid", "excerpt"), tail).first()["shown"]

    def resume(self, prefix: str) -> str:
        one = search.resolve_one(self.sessions(), prefix)["sid"]
        return self.sessions().where(F.col("sid") == one).select(T.resume_string(F.col("harness"), F.col("cwd"), F.col("native_id"))).first()[0]

    def status(self) -> DataFrame:
        return store.status(self.sessions())

    def forget(self, target: str, dry_run: bool = False) -> list[str]:
        """Remove the sessions of a folder glob or of one prefix for good; returns their sids."""
        if any(x in target for x in "*?["):
            hit = T.cwd_excluded(F.col("cwd"), [target])
        else:
            hit = F.col("sid") == search.resolve_one(self.sessions(), target)["sid"]
        gone = [r["sid"] for r in self.sessions().where(hit).select("sid").orderBy("sid").toLocalIterator()]
        if gone and not dry_run:
            def make(tables: dict[str, str]) -> dict[str, DataFrame]:
                left, dead = store.forget(self.sessions(tables), self.tombstones(tables), hit)
                return {"tombstones": dead, "sessions": left}

            self.store.change(make)
            index.sync(self.store)  # nothing of them stays searchable
        return gone

    def backfill(self, summarizer: Callable[[str, str], str] | dict[str, Callable[[str, str], str]], only: str | None = None, max_batches: int | None = None) -> int:
        """Summarize what is pending, in batches of sessions; returns the number of answers. ``max_batches`` leaves the rest for the next call.
        Of several summarizers by family the options' preference picks one for each session.

        A second backfill that started from the same store fails at its commit and goes over what the first one left.
        """
        answered = []

        def make(tables: dict[str, str]) -> dict[str, DataFrame]:
            r = self.sessions(tables)
            items = segments.work(r if only is None else r.where(F.col("sid") == only))
            if isinstance(summarizer, dict):
                items = segments.assign(items, self.prefer, sorted(summarizer))
            if max_batches is not None:
                items = segments.batches(items).where(F.col("batch") < max_batches)
            answers = self.store.scratch(segments.summarize(items, summarizer))
            answered[:] = [answers.count()]
            return {"sessions": R.conform(R.apply_answers(r, answers))} if answered[0] else {}

        self.store.change(make)
        return answered[0]

    def capture(self, folder: str, checkpoint: str, now: str):
        """Ingest what a spool of hook payloads names, once for a micro-batch; payloads without a path start a full sweep."""
        def handle(batch: DataFrame, n: int) -> None:
            calls = batch.select(F.col("path").alias("suffix"), "event", "trigger")
            paths = [r[0] for r in calls.select("suffix").distinct().collect()]  # as many as sessions that called since the last batch
            if paths:
                self.ingest_calls(now, calls, paths)

        return capture.run(capture.spool(self.spark, folder), handle, checkpoint, lambda n: self.ingest(now))

    def convert(self, legacy: DataFrame, dry_run: bool = False) -> DataFrame:
        """Import rows of an older store; returns (sid, session_id, action)."""
        done = store.convert(self.sessions(), legacy, self.tombstones())
        if not dry_run:
            old = legacy.withColumn("sid", store.legacy_key(F.col("source"), F.col("session_id"))).withColumn("_b", store.legacy_bullets(F.col("summary"))).drop("summary")
            five = ("asked", "learned", "completed", "left_off", "next_steps")
            bullets = F.struct(*(F.coalesce(F.col("_b")[k] if k in ("asked", "completed", "left_off") else F.lit(None), F.lit("")).alias(k) for k in five))
            rows = old.join(done.where("action in ('append', 'merge')").select("sid", "action"), "sid").withColumn("summary", bullets)
            rows = rows.withColumn("harness", F.split_part("sid", F.lit("/"), F.lit(1))).withColumn("native_id", T.sid_uuid(F.col("sid"))).withColumn("summary_state", F.when(R.has_summary(F.col("summary")), "done").otherwise("pending"))
            lists = [c for c in ("keywords", "prs", "skills", "mcp", "open_todos") if c in legacy.columns]

            def make(tables: dict[str, str]) -> dict[str, DataFrame]:
                graft = rows.where("action = 'merge'").select("sid", F.col("summary").alias("_s"), (F.col("summary_state") == "done").alias("_known"), *(F.col(c).alias(f"_{c}") for c in lists))
                m = self.sessions(tables).join(graft, "sid", "left")
                m = m.withColumn("summary_state", F.when(F.col("_known"), "done").otherwise(F.col("summary_state"))).withColumn("summary", F.when(F.col("_known"), F.col("_s")).otherwise(F.col("summary")))
                for c in lists:  # what the record has comes first
                    m = m.withColumn(c, F.when(F.col(f"_{c}").isNotNull(), T.ordered_union(F.col(c), F.col(f"_{c}"))).otherwise(F.col(c)))
                return {"sessions": R.conform(m).unionByName(R.conform(rows.where("action = 'append'")))}

            self.store.change(make)
        return done
