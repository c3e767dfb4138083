"""Model calls in slices: what a failed run has asked is not asked again."""

import os
import threading
import time

import pytest

from mailframe.operators import model

ROWS = [(i, f"from {i}", "s", f"body {i}") for i in range(60)]
SHAPE = "i long, from_display string, subject string, body_text string"


def recording(path, fail_at=None):
    """A factory of clients that note every call; at its n-th call a client's worker dies."""

    def factory():
        calls = []

        def client(system, user, timeout):
            body = user.rsplit(" ", 1)[1]
            calls.append(body)
            if fail_at is not None and len(calls) >= fail_at:
                os._exit(1)
            with open(path, "a") as file:
                file.write(body + "\n")
            return f"answer {body}"

        return client

    return factory


def asked(path):
    return [int(x) for x in path.read_text().split()] if path.exists() else []


def test_a_run_that_died_asks_only_for_what_is_missing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(model, "SLICE_ROWS", 4)
    df = model.build_prompt(spark.createDataFrame(ROWS, SHAPE))
    log, journal = tmp_path / "calls", str(tmp_path / "journal")
    with pytest.raises(Exception):  # noqa: B017 - whatever Spark makes of a dead worker
        model.run_model(df, recording(log, fail_at=12), ["i"], parallelism=1, journal=journal).collect()
    before = asked(log)
    kept = [name for name in os.listdir(journal) if name.endswith(".parquet")]
    assert 0 < len(before) < 60 and kept
    rows = model.run_model(df, recording(log), ["i"], parallelism=3, journal=journal).collect()
    assert sorted((r.i, r.raw) for r in rows) == [(i, f"answer {i}") for i in range(60)]
    again = [x for x in asked(log)[len(before) :] if x in before]
    # Only the slice that was under way is asked again.
    assert len(again) < 12 and len(asked(log)) == 60 + len(again)
    third = model.run_model(df, recording(log), ["i"], parallelism=2, journal=journal).collect()
    assert len(third) == 60 and len(asked(log)) == 60 + len(again)


def test_calls_in_flight_are_bounded(spark, tmp_path):
    path = tmp_path / "levels"

    def factory():
        lock, running = threading.Lock(), [0]

        def client(system, user, timeout):
            with lock:
                running[0] += 1
                with open(path, "a") as file:
                    file.write(f"{running[0]}\n")
            time.sleep(0.05)
            with lock:
                running[0] -= 1
            return "x"

        return client

    df = model.build_prompt(spark.createDataFrame(ROWS, SHAPE))
    assert model.run_model(df, factory, ["i"], parallelism=1, in_flight=5).count() == 60
    levels = [int(x) for x in path.read_text().split()]
    assert 1 < max(levels) <= 5


def test_every_failure_is_a_row(spark):
    def factory():
        def client(system, user, timeout):
            if user.endswith(("1", "3")):
                raise RuntimeError("refused")
            if user.endswith("2"):
                time.sleep(5)
            return None if user.endswith("4") else "y"

        return client

    df = model.build_prompt(spark.createDataFrame(ROWS[:10], SHAPE))
    rows = {r.i: r for r in model.run_model(df, factory, ["i"], timeout=0.3, in_flight=3).collect()}
    assert [rows[i].call_error for i in range(5)] == [None, "refused", "time limit exceeded", "refused", None]
    assert rows[4].raw is None and rows[5].raw == "y" and rows[2].latency_ms >= 300
    assert model.run_model(df.limit(0), factory, ["i"]).count() == 0
