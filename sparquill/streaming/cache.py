"""Semantic cache as a stateful operator: each shard keeps its entries, looks up and stores in order of arrival."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.cache import CacheConfig

OUTPUT = "shard bigint, request_id bigint, hit boolean, entry_id bigint, similarity double"
STATE = "ids array<bigint>, times array<double>, vectors array<array<double>>"


def step(entries: list[tuple[int, float, np.ndarray]], request_id: int, ts: float, vector: np.ndarray, config: CacheConfig) -> tuple[bool, int | None, float | None]:
    """Look up a request, and store it if nothing is near enough. ``entries`` is changed in place, oldest first."""
    if config.ttl_seconds is not None:
        entries[:] = [e for e in entries if ts - e[1] <= config.ttl_seconds]
    size = float(np.linalg.norm(vector))
    best, near = None, None
    for entry_id, _, other in entries:
        n = size * float(np.linalg.norm(other))
        cosine = float(vector @ other) / n if n else 0.0
        if near is None or cosine > near:
            best, near = entry_id, cosine
    if near is not None and size and near >= config.threshold:
        return True, best, near
    if len(entries) >= config.max_entries:
        entries.pop(0)
    entries.append((request_id, ts, vector))
    return False, None, near


def stream(requests: DataFrame, config: CacheConfig = CacheConfig()) -> DataFrame:
    """requests(shard, request_id, ts double, vector array<double>), a stream, to its lookups. A shard's state holds max_entries at most."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entries = []
        if state.exists:
            entries = [(int(i), float(t), np.array(v, float)) for i, t, v in zip(*state.get)]
        rows = pd.concat(list(batches)).sort_values(["ts", "request_id"])
        out = []
        for r in rows.itertuples():
            hit, entry, near = step(entries, int(r.request_id), float(r.ts), np.array(r.vector, float), config)
            out.append((key[0], int(r.request_id), hit, entry, near))
        state.update(([e[0] for e in entries], [e[1] for e in entries], [e[2].tolist() for e in entries]))
        yield pd.DataFrame(out, columns=["shard", "request_id", "hit", "entry_id", "similarity"]).astype({"entry_id": "Int64"})

    return requests.groupBy("shard").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
