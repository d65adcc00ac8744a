"""Commands: index, update, qa, answers, analyze, eval, serve. Exit codes: 0, 1 (failed), 2 (settings), 130 (interrupted)."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone.plans import answers as batch
from lodestone.plans import config, llm_client, logs
from lodestone.plans.engine import Engine
from lodestone.sources import questions

ABLATION = {"dense": {"hybrid": False, "rerank": False}, "hybrid": {"hybrid": True, "rerank": False}, "hybrid+rerank": {"hybrid": True, "rerank": True}}


def main(argv: list[str] | None = None, engine: Engine | None = None) -> int:
    # The names of commands and options that users know.
    p = argparse.ArgumentParser(prog="lodestone")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("index").add_argument("--incremental", action="store_true")
    sub.add_parser("update")
    sub.add_parser("qa")
    sub.add_parser("analyze").add_argument("file")
    a = sub.add_parser("answers")
    a.add_argument("--questions", default="eval/questions.yaml")
    a.add_argument("--kept", required=True)
    a.add_argument("--output", required=True)
    a.add_argument("--tasks", type=int, default=4)
    a.add_argument("--concurrent", type=int, default=4)
    e = sub.add_parser("eval")
    e.add_argument("--questions", default="eval/questions.yaml")
    e.add_argument("--ablate", action="store_true")
    e.add_argument("--json")
    e.add_argument("--k", default="1,3,5,10")
    e.add_argument("--chunk-sizes")
    s = sub.add_parser("serve")
    s.add_argument("--host", default="127.0.0.1")
    s.add_argument("--port", type=int, default=8000)
    args = p.parse_args(argv)
    try:
        if engine is None:
            settings = config.load(args.config)
            logs.start(settings)
            engine = Engine(SparkSession.builder.appName("lodestone").getOrCreate(), settings)
    except (ValueError, OSError) as err:
        print(err, file=sys.stderr)
        return 2
    try:
        return COMMANDS[args.command](engine, args)
    except KeyboardInterrupt:
        return 130
    except (ValueError, OSError, llm_client.LLMError) as err:
        logs.log.error("%s", err)
        print(err, file=sys.stderr)
        return 1


def index(engine: Engine, args: argparse.Namespace) -> int:
    done = engine.sync(full=args.command == "index" and not args.incremental, lazy=True).groupBy("action").count().collect()
    print(", ".join(f"{r['action']}: {r['count']}" for r in sorted(done)) or "nothing to do")
    return int(any(r["action"] == "failed" for r in done))


def qa(engine: Engine, args: argparse.Namespace) -> int:
    if not engine.health().first()["chunks"]:
        print("the index is empty", file=sys.stderr)
        return 1
    engine.one.warm()
    while (line := sys.stdin.readline()) and line.strip().lower() not in ("", "quit", "exit", "q"):
        try:
            for part in engine.ask_stream(line.strip())[1]:
                print(part, end="", flush=True)
            print()
        except (llm_client.LLMError, ValueError) as err:  # the next question may do better
            print(err, file=sys.stderr)
    return 0


def analyze(engine: Engine, args: argparse.Namespace) -> int:
    print(engine.analyze(args.file))
    return 0


def answers(engine: Engine, args: argparse.Namespace) -> int:
    """Answers to a file of questions as JSON lines; 1 where a question has none. A rerun asks only those."""
    asked = questions.load(engine.spark, args.questions).select(F.col("id").alias("query_id"), "question")
    batch.answer(engine, asked, args.kept, args.tasks, args.concurrent).write.mode("overwrite").json(args.output)
    rows, failed = engine.spark.read.schema("error string").json(args.output).agg(F.count("*"), F.count("error")).first()
    print(f"answered: {rows - failed}, failed: {failed}")
    return int(failed > 0)


def evaluation(engine: Engine, args: argparse.Namespace) -> int:
    ks = tuple(int(k) for k in args.k.split(","))
    asked = questions.load(engine.spark, args.questions)
    if not engine.health().first()["chunks"]:
        print("the index is empty", file=sys.stderr)
        return 1
    done = engine.records(asked, ABLATION if args.ablate else {engine.label(): {}}, ks)
    for size in args.chunk_sizes.split(",") if args.chunk_sizes else []:
        s = config.replace(engine.settings, chunk_size_chars=int(size), chunk_overlap_chars=min(engine.settings.chunk_overlap_chars, int(size) - 1), index_dir=f"{engine.settings.index_dir}-chunk-{size}")
        other = Engine(engine.spark, s, engine.embedder, engine.scorer, engine.searcher)
        other.sync(full=True)
        done += other.records(asked, {f"hybrid chunk={size}": {"hybrid": True, "rerank": False}}, ks)
    print("\t".join(["", *(r["config"] for r in done)]))
    lines = {f"recall@{k}": [r["recall_at_k"][str(k)] for r in done] for k in ks}
    lines |= {label: [r[key] for r in done] for label, key in (("MRR", "mrr"), ("latency p50 (ms)", "latency_p50_ms"), ("latency p95 (ms)", "latency_p95_ms"), ("answerable", "num_answerable"), ("unanswerable", "num_unanswerable"))}
    for label, values in lines.items():
        print("\t".join([label, *map(str, values)]))
    if args.json:
        with open(args.json, "w", encoding="utf-8") as f:
            json.dump({"corpus_chunks": engine.health().first()["chunks"], "embedding_model": engine.settings.embedding_model, "top_k": engine.settings.top_k, "ks": list(ks), "configs": done}, f, indent=2)
    return 0


def serve(engine: Engine, args: argparse.Namespace) -> int:
    from lodestone.plans import service

    service.serve(engine, args.host, args.port)
    return 0


COMMANDS = {"index": index, "update": index, "qa": qa, "answers": answers, "analyze": analyze, "eval": evaluation, "serve": serve}

if __name__ == "__main__":
    sys.exit(main())
