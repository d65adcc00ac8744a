"""Answers to many questions at once: calls side by side in tasks, tried again with growing pauses, kept by content.

A kept answer's key is a hash of everything that the model is sent and asked with, so a rerun asks only what has no
answer yet, and a question whose passages changed is asked anew.
"""

from __future__ import annotations

import logging
import math
import random
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans import config, llm_client
from lodestone.plans.engine import NO_CONTEXT, Engine

ASKED = "key string, answer string, error string"  # what a task tells of a prompt
KEPT = f"{ASKED}, run string"
WAVE = 10_000  # prompts whose answers are written together: what a lost run can lose
LONGEST_PAUSE = 60.0  # seconds
log = logging.getLogger(__name__)


def patient(client: llm_client.ChatClient, system: str, prompt: str, attempts: int, pause: float) -> tuple[str | None, str | None]:
    """(answer, error) of one prompt. Calls that may do better later are repeated after pause, 2 * pause, ... seconds, partly random."""
    for n in range(attempts):
        try:
            return client.chat(system, prompt), None
        except llm_client.LLMError as e:
            if not e.again or n + 1 == attempts:
                return None, str(e)
            time.sleep(min(LONGEST_PAUSE, max(e.wait, pause * 2**n * random.uniform(0.5, 1))))
    return None, "never asked"


def asking(settings: config.Settings, system: str, concurrent: int, attempts: int, pause: float):
    """A function for mapInPandas: (key, prompt) to (key, answer, error), at most ``concurrent`` calls of a task open at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = llm_client.ChatClient(settings)
        with ThreadPoolExecutor(concurrent) as pool:
            for rows in batches:
                got = list(pool.map(partial(patient, client, system, attempts=attempts, pause=pause), rows["prompt"]))
                yield pd.DataFrame({"key": rows["key"], "answer": [a for a, _ in got], "error": [e for _, e in got]})

    return run


def answer(engine: Engine, questions: DataFrame, kept: str, tasks: int = 4, concurrent: int = 4, attempts: int = 4, pause: float = 1.0, wave: int = WAVE) -> DataFrame:
    """(query_id, answer, error, contexts) for questions (query_id, question); prompts and answers stay as Parquet below folder ``kept``.

    At most ``tasks`` times ``concurrent`` calls are open at a time. Equal prompts are asked once. Prompts are dealt
    over waves by their hash, and each wave's answers are written before the next one is asked. A question without
    passages is not sent and gets the fixed reply; one that fails to the last has an error, no answer, and is asked again
    by the next run. A task that is lost is asked again. One writer at a time is assumed; should two have written an
    answer, the least of them counts.
    """
    if min(tasks, concurrent, attempts, wave) < 1 or pause < 0:
        raise ValueError("tasks, concurrent, attempts and wave must be positive, pause not negative")
    spark, s, run = engine.spark, engine.settings, uuid.uuid4().hex
    system = config.system_prompt(s)
    sent = [F.lit(str(x)) for x in (s.llm_model, s.llm_temperature, s.llm_max_tokens, system)]
    key = F.when(F.col("prompt").isNotNull(), F.sha2(F.to_json(F.array(*sent, F.col("prompt"))), 256))
    engine.prompts(questions).withColumn("key", key).write.parquet(f"{kept}/asked/run={run}")
    asked = spark.read.parquet(f"{kept}/asked/run={run}")
    folder = f"{kept}/answers"

    def told() -> DataFrame:
        return spark.read.schema(KEPT).parquet(folder)

    spark.createDataFrame([], KEPT).write.mode("append").parquet(folder)  # so that it can be read
    have = told().where("error IS NULL").select("key")
    todo = asked.where("key IS NOT NULL").select("key", "prompt").dropDuplicates(["key"]).join(have, "key", "left_anti")
    todo.write.parquet(f"{kept}/todo/run={run}")  # a cached table would follow the answers that its plan reads
    todo = spark.read.schema("key string, prompt string").parquet(f"{kept}/todo/run={run}")
    count = todo.count()
    waves = math.ceil(count / wave)
    for n in range(waves):
        part = todo.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == n).repartition(tasks, "key")
        part.mapInPandas(asking(s, system, concurrent, attempts, pause), ASKED).withColumn("run", F.lit(run)).write.mode("append").parquet(folder)
    answers = told().where("error IS NULL").groupBy("key").agg(F.min("answer").alias("answer"))
    failed = told().where((F.col("run") == run) & F.col("error").isNotNull()).select("key", "error")
    log.info("%d prompts sent in %d waves, %d without an answer", count, waves, failed.count())
    both = asked.join(answers, "key", "left").join(failed, "key", "left")
    return both.select("query_id", F.when(F.col("prompt").isNull(), NO_CONTEXT).otherwise(F.col("answer")).alias("answer"), "error", "contexts")
