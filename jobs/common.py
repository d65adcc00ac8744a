"""What the jobs share: settings files, logging, and folders for the registered queries."""

from __future__ import annotations

import argparse
import json
import logging
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def settings(defaults: Path, given: str | None) -> dict:
    """The job's defaults with what another settings file says."""
    out = json.loads(defaults.read_text())
    if given:
        own = json.loads(Path(given).read_text())
        if unknown := own.keys() - out.keys():
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        out |= own
    return out


def command(job: str, *paths: str) -> argparse.Namespace:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{job}")
    for path in paths:
        parser.add_argument(f"--{path}", required=True, help=f"path of {path}; any that Spark reads")
    parser.add_argument("--config", help="a JSON file with settings that differ from the job's own")
    return parser.parse_args()


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder that nothing uses yet, below the one that driver and executors share."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"  # a local session has no other machines
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/jobs/{name}-{uuid.uuid4().hex}"
