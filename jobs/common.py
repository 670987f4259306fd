"""What the jobs share: configuration, logging and the session of the command line."""

from __future__ import annotations

import argparse
import json
import logging
import os
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from skyframe.plans.durable import shared_dir


def settings(defaults: dict, path: str | None) -> dict:
    """``defaults`` with the values of a small JSON file; unknown names raise."""
    given = {}
    if path:
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
    if unknown := set(given) - set(defaults):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return defaults | given


def beside(file: str) -> str:
    """The configuration file that lies beside a job."""
    return os.path.splitext(os.path.abspath(file))[0] + ".json"


def command(name: str, doc: str, paths: tuple[str, ...], config: str, run: Callable, args: list[str] | None = None) -> None:
    """Reads arguments, starts a session, runs the job and stops the session."""
    p = argparse.ArgumentParser(prog=name, description=doc)
    for x in paths:
        p.add_argument(f"--{x}", required=True)
    p.add_argument("--config", default=config)
    p.add_argument("--shared", help="folder that driver and executors share (spark.checkpoint.dir)")
    a = vars(p.parse_args(args))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    if a["shared"]:
        builder = builder.config("spark.checkpoint.dir", a["shared"])
    spark = builder.getOrCreate()
    try:
        run(spark, *(a[x] for x in paths), a["config"])
    finally:
        spark.stop()


def new_folder(spark: SparkSession, job: str) -> str:
    return f"{shared_dir(spark)}/jobs/{job}-{uuid.uuid4().hex}"
