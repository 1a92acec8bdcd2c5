"""Command line: `python -m veritrail.cli --root FOLDER COMMAND WORKSPACE ...`; results are JSON, the report is Markdown."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import SparkSession

from veritrail import service
from veritrail.operators import synthesis
from veritrail.sources.models import Recorded
from veritrail.workspace import Models, Workspace, workspaces

#: command: (help, further arguments)
COMMANDS = {
    "ingest": ("add the videos of a JSON file", ["path"]), "index": ("embed the chunks", []), "extract-claims": ("ask a model for claims", []), "cluster": ("cluster the claims", []),
    "synthesize": ("relate the clusters' sources, find and label cross-source themes", []), "chat": ("answer one question", ["question"]), "talk": ("answer the questions of standard input", []), "evaluate": ("score retrieval", ["path"]),
    "report": ("print the report", []), "status": ("count the records", []), "delete": ("delete the workspace", []), "list": ("list all workspaces", []),
    "add": ("fetch one video and run all steps", ["url"]), "batch": ("add the videos of a list of URLs", ["path"]), "serve": ("answer HTTP requests", ["port"]),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="veritrail", description=__doc__)
    top.add_argument("--root", required=True, help="folder of the tables")
    top.add_argument("--client", help="module:function that makes a text model's client")
    top.add_argument("--fetch", help="module:function from a URL to {metadata, transcript}")
    top.add_argument("--embedder", help="module:function that makes an embedder of texts")
    top.add_argument("--scorer", help="module:function that makes a scorer of (question, text) pairs")
    top.add_argument("--query-prefix", default="", help="what the embedder wants before a question")
    top.add_argument("--force", action="store_true", help="run a step again though its input is unchanged")
    top.add_argument("--out", help="file of the report, or folder of the evaluation's results")
    top.add_argument("--mode", choices=("grounded", "assist"), default="grounded")
    sub = top.add_subparsers(dest="command", required=True)
    for name, (text, extra) in COMMANDS.items():
        one = sub.add_parser(name, help=text)
        for arg in ([] if name in ("list", "serve") else ["workspace"]) + extra:
            one.add_argument(arg)
    return top


def client_maker(name: str | None):
    """The named function, or a client that always says that there is none."""
    return named(name) if name else lambda: Recorded({})


def named(name: str):
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def fetcher(name: str | None):
    """The named function, or one that says that there is none."""

    def none(url: str) -> dict:
        raise LookupError(f"no --fetch is given, so {url} can't be fetched")

    return named(name) if name else none


def run(spark: SparkSession, args: argparse.Namespace):
    if args.command == "list":
        return workspaces(spark, args.root)
    make, fetch = client_maker(args.client), fetcher(args.fetch)
    if args.command == "serve":
        return service.serve(service.Service(spark, args.root, make, fetch), int(args.port))
    models = Models(*(named(x) if x else None for x in (args.embedder, args.scorer)), args.query_prefix)
    w = Workspace(spark, args.root, args.workspace, models)
    agrees = synthesis.asking(make) if args.client else None
    steps = {
        "ingest": lambda: w.ingest(args.path), "index": w.index, "extract-claims": lambda: w.extract_claims(make), "cluster": lambda: w.cluster(agrees, args.force), "synthesize": lambda: w.synthesize(make, args.force),
        "chat": lambda: w.ask(args.question, make, args.mode), "talk": lambda: [w.ask(q.strip(), make, args.mode) for q in sys.stdin if q.strip()],
        "evaluate": lambda: w.evaluate(args.path, args.out), "report": lambda: w.report(args.out), "status": lambda: {**w.status(), "titles": w.titles()}, "delete": w.delete,
        "add": lambda: w.add(fetch(args.url), make), "batch": lambda: w.add_all(w.urls(args.path), fetch, make),
    }
    return steps[args.command]()


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    found = run(spark, args)
    print(found if isinstance(found, str) else json.dumps(found, default=str, ensure_ascii=False))


if __name__ == "__main__":
    main()
