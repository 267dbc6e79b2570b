"""Model calls of a whole job at one pace.

A fixed number of call lanes shares one schedule: slot ``k`` is at
``start + k / rate`` and belongs to lane ``k mod lanes``.  A lane is one partition,
so one task walks it and takes its next free slot for every call.  No two calls
share a slot, whatever tasks and Arrow batches they come from, so the job as a
whole never calls faster than ``rate`` -- without a counter that all tasks would
have to ask.  (Clocks of the executors are taken to agree; leave speculative
execution off, as a second copy of a task would call again.)

A call that raises is repeated up to ``max_attempts`` times, waiting 1, 2, 4, ...
of its lane's slots longer; then its prompts go to the dead letters with the last
error.  Replies and dead letters together hold every prompt.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.operators.embedding import DEFAULT_BATCH_SIZE, made
from matchbook.session import cut_lineage


class Lane:
    """The slots of one lane."""

    def __init__(self, number: int, lanes: int, rate: float, start: float):
        self.step, self.first, self.used = lanes / rate, start + number / rate, -1

    def wait(self, skip: int = 0) -> None:
        """Sleep until the lane's next free slot, leaving ``skip`` out first."""
        now = math.ceil((time.time() - self.first) / self.step)
        self.used = max(self.used + 1 + skip, now)
        left = self.first + self.used * self.step - time.time()
        if left > 0:
            time.sleep(left)


def paced_calls(df: DataFrame, prompt_col: str, key_cols, client: Callable, rate: float, lanes: int = 4,
                batch_size: int = DEFAULT_BATCH_SIZE, max_attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """``(replies, dead_letters)``: rows (key, reply) and (key, prompt, attempts,
    error).  ``client`` (or a factory of one) gets at most ``batch_size`` prompts a
    call; ``rate`` is in calls a second over the whole job.  The replies are
    checkpointed, so each call is made once."""
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    asked = df.select(*keys, F.col(prompt_col).alias("_prompt")).repartition(lanes, F.xxhash64(*keys, prompt_col))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields if f.name in keys)
    start = time.time()

    def run(batches):
        model, lane = made(client), Lane(TaskContext.get().partitionId(), lanes, rate, start)
        for pdf in batches:
            prompts = pdf["_prompt"].tolist()
            replies, attempts, errors = [], [], []
            for i in range(0, len(prompts), batch_size):
                part, error, got, tries = prompts[i:i + batch_size], None, None, 0
                while got is None and tries < max_attempts:
                    lane.wait(2 ** (tries - 1) if tries else 0)
                    tries += 1
                    try:
                        got, error = list(model(part)), None
                        if len(got) != len(part):
                            raise ValueError(f"{len(got)} replies to {len(part)} prompts")
                    except Exception as failed:  # noqa: BLE001 -- whatever a client raises
                        got, error = None, f"{type(failed).__name__}: {failed}"[:500]
                replies += got if got is not None else [None] * len(part)
                attempts += [tries] * len(part)
                errors += [error] * len(part)
            out = pdf.copy()
            out["reply"] = pd.Series(replies, index=pdf.index, dtype=object)
            out["attempts"] = attempts
            out["error"] = pd.Series(errors, index=pdf.index, dtype=object)
            yield out

    done = cut_lineage(asked.mapInPandas(run, f"{kinds}, _prompt string, reply string, attempts int, error string"))
    dead = done.where("error is not null").select(*keys, F.col("_prompt").alias("prompt"), "attempts", "error")
    return done.where("error is null").select(*keys, "reply"), dead
