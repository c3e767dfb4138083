"""The user's summarising model as a partition-wise map, with one retry."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from queue import Empty, SimpleQueue
from threading import Thread

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailframe import fixed
from mailframe.functions.replies import with_validation
from mailframe.functions.text import null_to_empty
from mailframe.schemas import ATTEMPT
from mailframe.session import stage, work_dir
from mailframe.sources.corpus_files import file_system

# A client answers (system, user, timeout in seconds) with the reply text, or raises.
Client = Callable[[str, str, float], str]
ClientFactory = Callable[[], Client]
# Rows whose answers are journalled together, about.
SLICE_ROWS = 64

# Own wording of the task; callers with a tuned prompt pass theirs to ``build_prompt``.
SYSTEM_PROMPT = (
    "Summarise one e-mail in a single neutral, factual sentence in {language}. "
    "Leave out emotion and judgement. Answer with one JSON object that has the keys summary, "
    "action_required (" + ", ".join(fixed.ACTIONS) + "), deadline (YYYY-MM-DD for an explicit "
    "date by which to answer or act, else null) and tone (" + ", ".join(fixed.TONES) + ")."
)
STRICT_SUFFIX = "\n\nReturn the JSON object and nothing else, with the summary in {language}."

def build_prompt(
    df: DataFrame,
    language: str = "fr",
    strict: bool = False,
    system: str = SYSTEM_PROMPT,
    strict_suffix: str = STRICT_SUFFIX,
) -> DataFrame:
    """Add ``system_prompt`` and ``user_prompt``; ``en`` asks for English, all else for French."""
    name = "English" if language == "en" else "French"
    text = (system + (strict_suffix if strict else "")).replace("{language}", name)
    user = F.concat(
        F.lit("From: "),
        null_to_empty("from_display"),
        F.lit("\nSubject: "),
        null_to_empty("subject"),
        F.lit("\n\n"),
        null_to_empty("body_text"),
    )
    return df.withColumn("system_prompt", F.lit(text)).withColumn("user_prompt", user)


def _answer(client: Client, system: str, user: str, budget: float, out: SimpleQueue) -> None:
    try:
        out.put((client(system, user, budget), None))
    except Exception as failure:  # noqa: BLE001 - any failure of the client is data
        out.put((None, str(failure) or type(failure).__name__))


def _one_call(client: Client, system: str, user: str, budget: float) -> tuple[str | None, str | None, int]:
    """Reply or error, and how long it took; a call over its limit is given up."""
    start = time.monotonic()
    raw, error = None, "time limit exceeded"
    if budget > 0:
        # A late call keeps its thread, which does not keep the worker from ending.
        out = SimpleQueue()
        Thread(target=_answer, args=(client, system, user, budget, out), daemon=True).start()
        try:
            raw, error = out.get(timeout=budget)
        except Empty:
            pass
    return raw, error, int((time.monotonic() - start) * 1000)


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """The rows of each slice together; slices arrive in order."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        for number, rows in batch.groupby("_slice", sort=False):
            if held and held[0]["_slice"].iloc[0] != number:
                yield int(held[0]["_slice"].iloc[0]), pd.concat(held, ignore_index=True)
                held = []
            held.append(rows)
    if held:
        yield int(held[0]["_slice"].iloc[0]), pd.concat(held, ignore_index=True)


class Journal:
    """Answers of whole slices as files in a folder that all executors reach."""

    def __init__(self, path: str):
        self.system, self.root = file_system(path)

    def read(self, number: int) -> pd.DataFrame | None:
        path = f"{self.root}/{number}.parquet"
        if self.system.get_file_info(path).type == fs.FileType.NotFound:
            return None
        return pq.read_table(path, filesystem=self.system).to_pandas()

    def write(self, number: int, rows: pd.DataFrame) -> None:
        """In one move, so that a slice is there whole or not at all."""
        self.system.create_dir(self.root, recursive=True)
        part = f"{self.root}/.{number}-{uuid.uuid4().hex}"
        pq.write_table(pa.Table.from_pandas(rows, preserve_index=False), part, filesystem=self.system)
        self.system.move(part, f"{self.root}/{number}.parquet")


def _attempt_runner(factory: ClientFactory, journal: str, in_flight: int) -> Callable[[Iterator], Iterator]:
    """A map over slices: one client per partition, so many calls at a time, every failure a row."""
    asked = ["system_prompt", "user_prompt", "budget_s"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, log = None, Journal(journal)
        with ThreadPoolExecutor(in_flight) as pool:
            for number, rows in _slices(batches):
                keys = rows.drop(columns=["_slice", *asked])
                known = log.read(number)
                if known is None:
                    client = client or factory()
                    results = list(pool.map(partial(_one_call, client), *(rows[c] for c in asked)))
                    known = pd.DataFrame(results, columns=ATTEMPT.names).astype({"latency_ms": "int64"})
                    log.write(number, known)
                yield pd.concat([keys, known], axis=1)

    return run


def run_model(
    df: DataFrame,
    factory: ClientFactory,
    keys: list[str],
    timeout: float = fixed.MODEL_TIMEOUT_SECONDS,
    parallelism: int | None = None,
    in_flight: int = 1,
    journal: str | None = None,
) -> DataFrame:
    """One model call per row: ``keys`` plus raw, call_error, latency_ms.

    Rows go to slices of about SLICE_ROWS by their keys, which have to identify them. A slice's
    answers are written to the journal once it is through: a task that is tried again, and a run
    that gets the ``journal`` folder of one that died, asks for the slices that are missing only.
    At most ``in_flight`` calls of a partition run at a time, of one client in as many threads.
    ``parallelism`` is the number of partitions, as many as the session has cores unless given: calls
    are slow, so rows that sit together in few partitions would leave most workers idle. A ``budget_s`` column overrides ``timeout``.
    """
    if "budget_s" not in df.columns:
        df = df.withColumn("budget_s", F.lit(float(timeout)))
    # Written first: slices have to hold the same rows in the same order when they are read again.
    calls = stage(df.select(*keys, "system_prompt", "user_prompt", "budget_s"), "model-calls")
    number = F.pmod(F.xxhash64(*keys), F.lit(max(1, -(-calls.count() // SLICE_ROWS)))).cast("int")
    journal = journal or work_dir(df.sparkSession, "model-journal")
    spread = parallelism or df.sparkSession.sparkContext.defaultParallelism
    sliced = calls.withColumn("_slice", number).repartition(spread, "_slice").sortWithinPartitions("_slice", *keys)
    schema = T.StructType([calls.schema[k] for k in keys] + ATTEMPT.fields)
    return sliced.mapInPandas(_attempt_runner(factory, journal, in_flight), schema)


def summarize(
    df: DataFrame,
    factory: ClientFactory,
    keys: list[str],
    language: str = "fr",
    timeout: float = fixed.MODEL_TIMEOUT_SECONDS,
    parallelism: int | None = None,
    prompt: Callable[..., DataFrame] = build_prompt,
    in_flight: int = 1,
    journal: str | None = None,
) -> DataFrame:
    """``keys`` plus both attempts; the second one only where the first did not hold up.

    Attempts are written before anything reads them: a model call is dear and need not give the
    same answer twice. The time limit covers both attempts of a message.
    """
    ask = partial(run_model, factory=factory, keys=keys, timeout=timeout, parallelism=parallelism, in_flight=in_flight)
    folders = [journal and f"{journal}/{attempt}" for attempt in (1, 2)]
    answered = ask(prompt(df, language, False), journal=folders[0])
    held = F.col("call_error").isNull() & (F.col("checked.status") == "ok")
    first = stage(
        with_validation(answered).withColumn("_ok", held).drop("checked"), "attempt-1"
    )
    left = F.lit(float(timeout)) - F.col("latency_ms") / 1000.0
    failed = first.where("not _ok").select(*keys, left.alias("budget_s"))
    again = df.join(failed, keys)
    second = stage(
        ask(prompt(again, language, True), journal=folders[1]), "attempt-2"
    )
    one = first.select(*keys, *(F.col(c).alias(f"{c}_1") for c in ATTEMPT.names))
    two = second.select(*keys, *(F.col(c).alias(f"{c}_2") for c in ATTEMPT.names))
    return one.join(two, keys, "left")


def pick_attempt(df: DataFrame) -> DataFrame:
    """Add ``model`` (the summary), ``raw_response``, ``latency_ms`` and ``retried``."""
    first = F.when(F.col("call_error_1").isNull(), F.col("_v1"))
    second = F.when(F.col("call_error_2").isNull(), F.col("_v2"))
    fallback = F.struct(
        F.lit(fixed.FALLBACK_SUMMARY).alias("text"),
        F.lit(None).cast("string").alias("action"),
        F.lit(None).cast("string").alias("deadline"),
        F.lit(None).cast("string").alias("tone"),
        F.lit("error").alias("status"),
        F.coalesce(F.col("call_error_2"), F.lit(fixed.VALIDATION_FAILED)).alias("err"),
    )
    held = F.coalesce(first["status"] == "ok", F.lit(False))
    held_again = F.coalesce(second["status"] == "ok", F.lit(False))
    checked = with_validation(with_validation(df, "raw_1", "_v1"), "raw_2", "_v2")
    return (
        checked.withColumn("model", F.when(held, first).when(held_again, second).otherwise(fallback))
        .withColumn("raw_response", F.when(held, F.col("raw_1")).otherwise(F.col("raw_2")))
        .withColumn(
            "latency_ms",
            F.coalesce("latency_ms_1", F.lit(0))
            + F.when(held, 0).otherwise(F.coalesce("latency_ms_2", F.lit(0))),
        )
        .withColumn("retried", ~held)
        .drop("_v1", "_v2")
    )
