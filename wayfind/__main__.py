"""python -m wayfind: batch (build an index), search, reverse, shell, serve, reset."""

from __future__ import annotations

import argparse
import sys
from wsgiref.simple_server import make_server

from pyspark.sql import SparkSession

from wayfind.config import load_config
from wayfind.operators.index import Index, build, edge_ngram_table
from wayfind.plans.search import Engine
from wayfind.plugins import Plugins
from wayfind.sources import readers, sinks
from wayfind.sources.store import DocumentStore, exists


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="wayfind")
    parser.add_argument("--config", help="a Python file with settings")
    parser.add_argument("--home", default="wayfind-data", help="the folder of documents and index")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, what in (("batch", "read JSON lines, CSV or msgpack files, or standard input"), ("search", "answer a query"), ("shell", "answer lines of standard input"), ("ngrams", "make the index's edge n-grams anew"), ("reset", "delete documents and index"), ("serve", "answer HTTP")):
        sub.add_parser(name, help=what)
    sub.choices["batch"].add_argument("path", nargs="*")
    sub.choices["batch"].add_argument("--no-ngrams", action="store_true", help="leave edge n-grams to the ngrams command")
    sub.choices["search"].add_argument("query")
    sub.choices["reset"].add_argument("--force", action="store_true")
    sub.choices["serve"].add_argument("--port", type=int, default=7878)
    near = sub.add_parser("reverse", help="the nearest places")
    near.add_argument("lat", type=float)
    near.add_argument("lon", type=float)
    plugins = Plugins()
    plugins.load()
    plugins.call("register_command", sub)
    got = parser.parse_args(args)
    defaults: dict = {}
    plugins.call("preconfigure", defaults)
    config = load_config(got.config, defaults=defaults)
    for changed in plugins.call("configure", config):
        config = changed or config
    spark = SparkSession.builder.appName("wayfind").getOrCreate()
    store, at = DocumentStore(spark, f"{got.home}/documents"), f"{got.home}/index"
    if got.command == "reset":
        if not got.force and input("Delete all documents and the index (y/N)? ").strip().lower() != "y":
            return 1
        store.reset()
        DocumentStore(spark, at).reset()
        return 0
    if got.command == "ngrams":
        index = Index.read(spark, at)
        index.write_table("edge_ngrams", edge_ngram_table(index.token_stats, config), at)
        return 0
    if got.command == "batch":
        if missing := [p for p in got.path if not exists(spark, p)]:
            print(f"no such file: {', '.join(missing)}", file=sys.stderr)
            return 1
        kinds = {".csv": readers.read_csv, ".msgpack": readers.read_msgpack}
        if got.path:
            for path in got.path:
                store.apply(next((f for end, f in kinds.items() if path.endswith(end)), readers.read_json_lines)(spark, path, config))
        else:
            store.apply(readers.read_stdin(spark, sys.stdin, config))
        index = build(store.read(), config)
        if got.no_ngrams:
            index.edge_ngrams = index.edge_ngrams.limit(0)
        index.write(at)
        return 0
    engine = Engine(Index.read(spark, at), config)
    if got.command == "search":
        q = engine.queries([{"q": got.query}])
        print(sinks.collections(engine.search(q, whole=True), q, config).first().geojson)
    elif got.command == "reverse":
        q = spark.createDataFrame([(0, got.lat, got.lon, 1, {})], "query_id long, lat double, lon double, limit int, filters map<string,array<string>>")
        print(sinks.collections(engine.reverse(q, whole=True), q, config).first().geojson)
    elif got.command == "shell":
        from wayfind.shell import Shell

        shell = Shell(engine)
        plugins.call("register_shell_command", shell.commands)
        for line in sys.stdin:
            if line.strip() in ("QUIT", "EXIT"):
                break
            out = shell.run(line)
            out.show(truncate=False) if hasattr(out, "show") else print(out)
    else:
        from wayfind.http import App

        app = App(engine)
        plugins.call("register_http_endpoint", app.routes)
        plugins.call("register_http_middleware", app.headers)
        make_server("", got.port, app).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
