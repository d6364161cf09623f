"""A store of snapshots: each table is a folder of versions, and a small file names the one that counts.

A write makes a new version beside the old one and then changes the name, so readers see a table before the write or after
it, and a failed write leaves nothing but an unnamed folder. One writer at a time is assumed, as with any store of files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrolith import schemas
from corrolith.operators import consolidate, graph, history, ledger, planner, recall, store
from corrolith.operators.recall import Visibility
from corrolith.sources import bundles, sessions
from corrolith.sources.providers import EmbeddingProvider, LlmProvider, embedded


class MemoryStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ---- tables ----

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _files(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _named(self, table: str) -> tuple[int, str, int] | None:
        """Number and folder of the version of a table that counts, and the layout under which it was written. They stand in
        the name of an empty file; the file of the highest number counts."""
        at = self._path(table)
        if not self._files().exists(at):
            return None
        names = [str(f.getPath().getName()) for f in self._files().listStatus(at)]
        told = [n[2:].split("-") for n in names if n.startswith("_v")]
        return max(((int(n), folder, int(layout)) for n, folder, layout in told), default=None)

    def table(self, name: str) -> DataFrame:
        """A table as it is now, in the present layout."""
        now = self._named(name)
        if now is None:
            return schemas.empty(self.spark, name)
        return schemas.migrated(self.spark.read.parquet(f"{self.root}/{name}/{now[1]}"), name, now[2])

    def replace(self, name: str, df: DataFrame) -> None:
        """Makes df the new version of a table. The version before it stays until the next write, for those who read it."""
        version, before = uuid.uuid4().hex, self._named(name)
        schemas.shaped(df, name).write.parquet(f"{self.root}/{name}/{version}")
        number = before[0] + 1 if before else 1
        self._files().create(self._path(name, f"_v{number}-{version}-{schemas.VERSION}"), False).close()
        for f in self._files().listStatus(self._path(name)):
            old = str(f.getPath().getName())
            if old.startswith("_v") and int(old[2:].split("-")[0]) < number - 1:
                self._files().delete(self._path(name, old.split("-")[1]), True)
                self._files().delete(f.getPath(), False)

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows whose keys are not stored yet."""
        held = self.table(name)
        new = store.insert_or_ignore(schemas.shaped(rows, name), held, schemas.KEYS[name], schemas.KEYS[name])
        self.replace(name, held.unionByName(new))

    def init(self) -> None:
        """Makes the tables that are missing."""
        for name in schemas.SCHEMAS:
            if self._named(name) is None:
                self.replace(name, schemas.empty(self.spark, name))

    # ---- verbs ----

    def ingest(self, path: str, workspace: str, now: str) -> DataFrame:
        """Reads session files into raw memory; gives the files of no known format."""
        rows, unknown = sessions.parse_sessions(sessions.read_files(self.spark, path, workspace), now)
        self.append("raw_memory", rows)
        return unknown

    def extract(self, workspace: str, llm: LlmProvider, now: str, session: str | None = None) -> DataFrame:
        """Extracts observations from messages and carries out what is planned for them; gives the effects."""
        raw = self.table("raw_memory").filter(F.col("workspace_id") == workspace)
        raw = raw if session is None else raw.filter(F.col("session_id") == session)
        new = planner.extract(raw, llm, ["created_at", "memory_id"], now)
        obs = self.table("observation")
        effects = planner.apply_plan(new, obs.withColumn("created_ts", F.col("created_at")))
        kept = new.join(effects.filter("action IN ('add', 'update')").select(F.col("candidate_id").alias("observation_id")), "observation_id", "left_semi")
        self.replace("observation", planner.applied(obs, effects).unionByName(schemas.shaped(kept, "observation")))
        self.append("timeline", history.from_observations(kept, F.lit(now)).withColumns({"kind": F.lit("append"), "entry_id": F.concat(F.lit("tl-"), F.md5(F.concat_ws("\\x00", "observation_id", F.lit(now)))), "created_at": F.lit(now)}))
        return effects

    def seed(self, path: str, now: str) -> None:
        """Puts bundles into the store."""
        added = bundles.applied(bundles.read_bundles(self.spark, path), {t: self.table(t) for t in ("raw_memory", "observation", "concept", "concept_relation")}, now)
        added["timeline"] = added["timeline"].withColumns({"entry_id": F.concat(F.lit("tl-"), F.md5(F.concat_ws("\\x00", "observation_id", F.lit(now)))), "created_at": F.lit(now)})
        for name, rows in added.items():
            self.append(name, rows)
        obs = self.table("observation")
        self.replace("observation", store.with_cross_counts(obs, ledger.cross_workspace_count(obs.drop("cross_project_count"))))

    def consolidate(self, workspace: str, domain: str | None = None) -> DataFrame:
        """Maintenance, linking and promotion; gives the report."""
        con, obs = self.table("concept"), self.table("observation")
        own = con.filter(F.col("workspace_id") == workspace)
        done = consolidate.consolidate(own, obs.filter(F.col("workspace_id") == workspace).withColumn("created_ts", F.col("created_at")), domain)
        self.replace("observation", obs.filter(F.col("workspace_id") != workspace).unionByName(schemas.shaped(done.observations, "observation")))
        before = self.table("concept_relation")
        edges = schemas.shaped(done.edges, "concept_relation")
        self.replace("concept_relation", before.join(edges.select(*schemas.KEYS["concept_relation"]), schemas.KEYS["concept_relation"], "left_anti").unionByName(edges))
        self.replace("concept", con.filter(F.col("workspace_id") != workspace).unionByName(schemas.shaped(done.concepts, "concept")))
        return done.report

    def embed(self, provider: EmbeddingProvider, now: str) -> None:
        """Vectors of all concepts, by name and definition."""
        rows = self.table("concept").select(F.lit("concept").alias("source_type"), F.col("concept_id").alias("source_id"), "workspace_id", F.concat_ws(": ", "name", "definition").alias("text"), F.lit(now).alias("created_at"))
        self.replace("embedding", store.upsert(schemas.shaped(embedded(rows, "text", provider), "embedding"), self.table("embedding"), schemas.KEYS["embedding"], ["created_at"]))

    def recall(self, query: str, workspace: str, provider: EmbeddingProvider, now: str, most: int = 1500, see: Visibility = Visibility()) -> DataFrame:
        """The context of a query by compact search; the first concepts count one recall more."""
        con = self.table("concept").withColumns({"entities_json": F.to_json("related_entities"), "facts_json": F.to_json("known_facts")})
        vector = self.spark.createDataFrame([([float(x) for x in provider.embed(query)],)], "vector array<double>")
        edges = self.table("concept_relation").withColumn("weight", F.col("alpha") / (F.col("alpha") + F.col("beta")))
        hits = recall.compact_search(con, self.table("embedding"), edges, workspace, query, vector, see=see)
        best = recall.best_concepts(hits, con)
        intent = self.spark.createDataFrame([(query,)], "q string").select(recall.S.intent_class(F.col("q"))).first()[0]
        context = recall.build_context(best, workspace, intent, most)
        lines = [r.line for r in recall.provenance(hits).orderBy(F.desc("score"), "concept_id").limit(3).collect()]
        notes = F.array(*[F.lit(f"[compact] {line}") for line in lines]) if lines else F.array().cast("array<string>")
        answer = self.spark.createDataFrame(context.withColumn("relevant_entities", F.concat("relevant_entities", notes)).collect(), context.schema)
        self.replace("concept", store.record_recalls(self.table("concept"), recall.recalled(best).withColumn("at", F.lit(now))))
        return answer

    def feedback(self, concept_id: str, text: str, workspace: str, now: str, observation: str | None = None) -> None:
        """What a user says about a concept, and about an observation if given."""
        con = self.table("concept")
        if con.filter((F.col("concept_id") == concept_id) & (F.col("workspace_id") == workspace)).isEmpty():
            raise store.MissingKey(f"concept {concept_id!r} is not stored")
        event = self.spark.createDataFrame([(uuid.uuid4().hex, concept_id, now, text, observation)], "event_id string, concept_id string, ts string, feedback_text string, observation_id string")
        self.replace("concept", history.revised(event, con))
        rows = history.ledger(event).withColumnsRenamed({"event_id": "feedback_id", "ts": "created_at"}).withColumn("workspace_id", F.lit(workspace))
        self.replace("feedback", store.append_strict(schemas.shaped(rows, "feedback"), self.table("feedback"), "feedback_id"))
        if observation is not None:
            self.replace("observation", schemas.shaped(history.corrected(event, self.table("observation")), "observation"))

    def concepts(self, workspace: str, see: Visibility = Visibility()) -> DataFrame:
        return graph.visible(self.table("concept"), workspace, list(see.domains), see.with_global)

    def observations(self, workspace: str, status: str | None = None) -> DataFrame:
        return ledger.by_status(self.table("observation"), workspace, status)

    def timeline(self, workspace: str, entity: str, prop: str | None = None) -> DataFrame:
        versions = history.versions_with_expiry(self.table("timeline").withColumn("kind", F.coalesce("kind", F.lit("append"))))
        return history.history_of(versions, workspace, entity, prop)
