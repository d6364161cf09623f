"""Command line of a store: python -m corrolith.cli --root DIR VERB ..."""

from __future__ import annotations

import argparse
import datetime
import sys

from corrolith import config, vocab
from corrolith.operators import transfer
from corrolith.operators.recall import Visibility
from corrolith.sources.providers import EmbeddingProvider, HttpEmbedding, HttpLlm, StubEmbedding
from corrolith.store import MemoryStore


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corrolith", description=__doc__)
    p.add_argument("--root", help="folder of the store")
    p.add_argument("--workspace", default="default")
    verbs = p.add_subparsers(dest="verb", required=True)
    verbs.add_parser("init", help="make the tables")
    verbs.add_parser("ingest-session", help="read session files").add_argument("path")
    x = verbs.add_parser("list-observations", help="observations, newest first")
    x.add_argument("--status", choices=vocab.OBSERVATION_STATUSES)
    verbs.add_parser("list-concepts", help="concepts").add_argument("--elevated", action="store_true")
    verbs.add_parser("dream", help="maintenance of the ledger")
    x = verbs.add_parser("promote", help="promote concepts by their evidence")
    x.add_argument("--domain")
    x = verbs.add_parser("recall-compact", help="the context of a query")
    x.add_argument("query")
    x.add_argument("--max-tokens", type=int, default=1500)
    x = verbs.add_parser("extract", help="observations from messages; needs a service")
    x.add_argument("--session")
    verbs.add_parser("link", help="edges between concepts")
    verbs.add_parser("transfer", help="notes from alike concepts elsewhere").add_argument("concept_id")
    x = verbs.add_parser("feedback", help="what a user says about a concept")
    x.add_argument("concept_id")
    x.add_argument("text")
    x.add_argument("--observation")
    verbs.add_parser("consolidate", help="dream, link and promote").add_argument("--domain")
    verbs.add_parser("seed", help="put bundles into the store").add_argument("path")
    x = verbs.add_parser("timeline", help="values of an entity over time")
    x.add_argument("kind", choices=("history", "entity", "current"))
    x.add_argument("entity")
    x.add_argument("property", nargs="?")
    return p


def provider(settings: config.Settings) -> EmbeddingProvider:
    """The service of the settings, or the stub where there is none."""
    s = settings.embedding
    return HttpEmbedding(s.base_url, s.api_key, s.model, s.dim, s.timeout) if s.base_url else StubEmbedding()


def run(args: argparse.Namespace, spark, out=print, settings: config.Settings | None = None) -> int:
    """One verb; gives the exit code."""
    from pyspark.sql import functions as F

    settings = settings or config.load()
    memory = MemoryStore(spark, args.root or settings.root)
    now = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    ws = args.workspace
    if args.verb == "init":
        memory.init()
    elif args.verb == "ingest-session":
        unknown = [r.source_ref for r in memory.ingest(args.path, ws, now).select("source_ref").limit(20).collect()]
        for ref in unknown:
            out(f"unknown session format: {ref}")
        return int(bool(unknown))
    elif args.verb == "list-observations":
        for r in memory.observations(ws, args.status).orderBy(F.desc("created_at"), "observation_id").limit(1000).collect():
            out(f"[{r.status}] {r.subject_text} {r.predicate} {r.object_text or ''} ({r.observation_id})")
    elif args.verb == "list-concepts":
        for r in memory.concepts(ws, Visibility((), args.elevated)).orderBy(F.desc("confidence"), "concept_id").limit(1000).collect():
            out(f"[{r.status}/{r.lifecycle_scope}] {r.name} ({r.concept_id})")
    elif args.verb in ("dream", "link", "promote", "consolidate"):
        for r in memory.consolidate(ws, getattr(args, "domain", None)).collect():
            out(", ".join(f"{k}={v}" for k, v in r.asDict().items()))
    elif args.verb == "recall-compact":
        p = provider(settings)
        memory.embed(p, now)
        out(memory.recall(args.query, ws, p, now, args.max_tokens).first().prompt)
    elif args.verb == "extract":
        s = settings.llm
        if not s.base_url:
            out("no service is set for extraction")
            return 2
        for r in memory.extract(ws, HttpLlm(s.base_url, s.api_key, s.model, s.timeout), now, args.session).groupBy("action").count().collect():
            out(f"{r.action}={r['count']}")
    elif args.verb == "transfer":
        con = memory.table("concept")
        nodes = transfer.nodes_of(con)
        halves = transfer.half_edges(nodes, memory.table("observation"))
        peers = transfer.structural_peers(con, transfer.bags(transfer.labels(nodes, halves)), args.concept_id, ws)
        edges = memory.table("concept_relation").withColumn("weight", F.col("alpha") / (F.col("alpha") + F.col("beta")))
        for r in transfer.transfer_notes(peers, transfer.transfer_edges(peers, edges)).orderBy("place").collect():
            out(r.note)
    elif args.verb == "feedback":
        memory.feedback(args.concept_id, args.text, ws, now, args.observation)
    elif args.verb == "seed":
        memory.seed(args.path, now)
    elif args.verb == "timeline":
        rows = memory.timeline(ws, args.entity, None if args.kind == "entity" else args.property)
        rows = rows.filter("status = 'active'") if args.kind == "current" else rows
        for r in rows.orderBy("property", F.desc("valid_from")).limit(1000).collect():
            out(f"{r.property}={r.value} [{r.status}] {r.valid_from} - {r.valid_to or 'now'}")
    return 0


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    args = parser().parse_args(argv)
    if not (args.root or config.load().root):
        print("name the folder of the store by --root or CORROLITH_ROOT", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("corrolith").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    return run(args, spark)


if __name__ == "__main__":
    sys.exit(main())
