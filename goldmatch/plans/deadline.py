"""A time limit for one statement, on a clock of its own.

The clock is wall time from the statement's start. It stands still only while the
statement waits for others: it has a stage without a running task, and tasks of other
statements run. Stages too short to be seen, the gaps between them and the time the
driver spends on analysis and planning therefore count.
"""

from __future__ import annotations

import threading
import time
import traceback
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import InheritableThread, SparkContext

POLL_SECONDS, CANCEL_SECONDS = 0.02, 0.25
GRACE_SECONDS, GRACE_FACTOR = 2.0, 0.75  # a cancelled statement may take the smaller of these, the second times its limit, to end
CALL_FACTOR = 20.0  # waiting included, a statement may take this many times its limit


@dataclass
class Outcome:
    error: Exception | None
    timed_out: bool
    seconds: float


def _waits(sc: SparkContext, group: str) -> bool:
    """Whether the group has a stage but no running task while others have running tasks."""
    tracker = sc.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
    own = {s for j in jobs if j and j.status == "RUNNING" for s in j.stageIds}
    active = {s: tracker.getStageInfo(s) for s in tracker.getActiveStageIds()}
    running = {s for s, info in active.items() if info and info.numActiveTasks}
    return bool(own & active.keys()) and not own & running and bool(running - own)


def run_limited(sc: SparkContext, group: str, pool: str, seconds: float, body: Callable[[], None], call_factor: float = CALL_FACTOR) -> Outcome:
    """Run ``body`` as job group ``group`` in scheduler pool ``pool`` and stop it at the limit.

    The body has a thread of its own. At the limit its jobs are cancelled and later ones
    refused; when it does not end soon after, because the driver still plans, it is left
    to end by itself and the call returns. Pools share the slots evenly in a session with
    ``spark.scheduler.mode=FAIR``; otherwise statements queue, which their clocks leave out.
    """
    done, failure = threading.Event(), []

    def work() -> None:
        try:
            sc.setJobGroup(group, "evaluated statement", True)
            sc.setLocalProperty("spark.scheduler.pool", pool)
            body()
        except Exception as e:  # noqa: BLE001 - every failure is an outcome of the statement
            traceback.clear_frames(e.__traceback__)
            failure.append(e)
        finally:
            done.set()

    InheritableThread(target=work, daemon=True).start()
    started = seen = time.monotonic()
    used = 0.0
    while not done.wait(POLL_SECONDS):
        now = time.monotonic()
        if not _waits(sc, group):
            used += now - seen
        seen = now
        if used >= seconds or now - started >= call_factor * seconds:
            break
    else:
        return Outcome(failure[0] if failure else None, False, time.monotonic() - started)
    stop = time.monotonic() + min(GRACE_SECONDS, GRACE_FACTOR * seconds)
    while True:
        sc._jsc.sc().cancelJobGroupAndFutureJobs(group)
        if done.wait(CANCEL_SECONDS) or time.monotonic() > stop:
            return Outcome(failure[0] if failure else None, True, time.monotonic() - started)
