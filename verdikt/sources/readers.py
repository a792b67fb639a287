"""Model readers behind one interface: a reader turns prompts into readout rows, a partition at a time.

Inference is outside the engine. ``from_table`` serves stored readouts; a network client (``clients``) implements ``read``
and gets its rows in batches of the partition, sorted or batched by length if asked, which also keeps a prefix cache warm.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

READOUT = "id string, raw_logprobs map<string,double>, latency_ms double, error string, option_mass double, first_token string, top_tokens array<string>, prompt_tokens long, cached_tokens long, content string, finish_reason string"
#: What a reader may tell of a row besides its letters, time and error.
DETAILS = ("option_mass", "first_token", "top_tokens", "prompt_tokens", "cached_tokens", "content", "finish_reason")


class Reader(Protocol):
    def read(self, prompts: list[tuple[str, str]]) -> list[tuple]:
        """(id, prompt) pairs to (id, log-probabilities, milliseconds, error) and, where known, a dictionary of ``DETAILS``."""


REGISTRY: dict[str, Callable[..., Reader]] = {}


def register(name: str, make: Callable[..., Reader]) -> None:
    REGISTRY[name] = make


class UniformReader:
    """Equal probabilities for the given letters: a stand-in for checks."""

    def __init__(self, letters: list[str]) -> None:
        self.letters = letters

    def read(self, prompts):
        import math

        return [(i, dict.fromkeys(self.letters, -math.log(len(self.letters))), 0.0, None) for i, _ in prompts]


register("uniform", UniformReader)


def acquire(rows: DataFrame, backend: str, options: dict | None = None, batch: int = 32, attempts: int = 3, sort_by: str | None = None, budget: int | None = None, wait: float = 0.5) -> DataFrame:
    """Readouts for rows of id and prompt. A batch that fails is tried again, after ``wait`` seconds and twice as many each
    time, then its rows carry the error. With ``budget``
    rows are batched by length, so that a batch padded to its longest prompt holds at most so many characters."""
    options = options or {}
    if backend not in REGISTRY:
        from . import clients  # noqa: F401  registers the network clients
    make = REGISTRY[backend]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = make(**options)
        for pdf in parts:
            pairs = list(zip(pdf["id"], pdf["prompt"], strict=True))
            if budget is None:
                groups = [pairs[at : at + batch] for at in range(0, len(pairs), batch)]
            else:
                from .clients import budget_batches

                groups = [[pairs[i] for i in g] for g in budget_batches([len(p) for _, p in pairs], budget, batch)]
            for one in groups:
                error = "no attempt"
                for attempt in range(attempts):
                    if attempt:
                        time.sleep(wait * 2 ** (attempt - 1))
                    try:
                        out = reader.read(one)
                        break
                    except Exception as e:  # noqa: BLE001  any failure of a backend becomes an error row
                        error = str(e)
                else:
                    out = [(i, None, float("nan"), error) for i, _ in one]
                known = [x[4] if len(x) > 4 else {} for x in out]
                table = pd.DataFrame([x[:4] for x in out], columns=["id", "raw_logprobs", "latency_ms", "error"])
                for c in DETAILS:
                    kind = "Int64" if c.endswith("_tokens") and c != "top_tokens" else "float64" if c == "option_mass" else object
                    table[c] = pd.Series([k.get(c) for k in known], dtype=kind)
                yield table

    rows = rows.select("id", "prompt") if sort_by is None else rows.sortWithinPartitions(sort_by).select("id", "prompt")
    return rows.mapInPandas(run, READOUT)


def from_table(rows: DataFrame, readouts: DataFrame) -> DataFrame:
    """Stored readouts of the rows; a row without one carries an error."""
    out = rows.select("id").join(readouts.select("id", "raw_logprobs", "latency_ms"), "id", "left")
    return out.withColumn("error", F.when(F.col("raw_logprobs").isNull(), "no readout"))


def joint_schema_logprobs(probs: DataFrame, column: str = "probs") -> DataFrame:
    """Probabilities of a joint-schema endpoint as log-probabilities, floored at 1e-12."""
    return probs.withColumn("raw_logprobs", F.transform_values(column, lambda _, p: F.log(F.greatest(p, F.lit(1e-12)))))
