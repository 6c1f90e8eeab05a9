"""``run`` and ``check`` of a pipeline configuration."""

from __future__ import annotations

import argparse
import logging
import signal
import sys
import tempfile

from pyspark.sql import SparkSession

from .plans.config import ConfigError, load_config
from .plans.graph import Pipeline
from .sql.errors import SqlError
from .streaming.runner import finish, start
from .streaming.supervisor import RestartPolicy, supervise

log = logging.getLogger("emberlog")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="emberlog", description="Log pipelines in SQL on Spark.")
    commands = top.add_subparsers(dest="command", required=True)
    for name, what in (("run", "run a pipeline"), ("check", "look whether a pipeline can run")):
        p = commands.add_parser(name, help=what)
        p.add_argument("--config", required=True)
        if name == "run":
            p.add_argument("--once", action="store_true", help="stop after what is there now")
            p.add_argument("--max-batches", type=int, help="stop after so many batches")
            p.add_argument("--path", action="append", default=[], metavar="SOURCE=DIR", help="read a source's lines from files")
            p.add_argument("--checkpoint", help="folder for the stream's progress")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="[%(levelname)s] %(message)s")
    try:
        config = load_config(args.config)
        Pipeline(config)
    except (OSError, ConfigError, SqlError) as e:
        log.error("%s", e)
        return 1
    for name in config.without_effect():
        log.warning("%s is checked but has no effect on Spark", name)
    if args.command == "check":
        print("Configuration OK")
        return 0
    spark = spark or SparkSession.builder.appName("emberlog").getOrCreate()
    if not args.checkpoint and not spark.sparkContext.master.startswith("local"):
        log.error("on a cluster, --checkpoint must name a shared folder")
        return 1
    checkpoint = args.checkpoint or tempfile.mkdtemp(prefix="emberlog-")
    ended, policy = {"now": False}, RestartPolicy()

    def run() -> None:
        query = start(spark, config, checkpoint, dict(p.split("=", 1) for p in args.path), args.once, args.max_batches, on_batch=policy.succeeded)

        def stop(*_) -> None:
            ended["now"] = True
            query.stop()

        for s in (signal.SIGINT, signal.SIGTERM):
            try:
                signal.signal(s, stop)
            except ValueError:  # not in the main thread
                pass
        finish(query)

    try:
        supervise(run, policy, stop=lambda: ended["now"])
    except Exception as e:
        log.error("%s", e)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
