"""Tags over a stream: a value keeps the tag it got first, and new ones count on.

Numbers can't follow frequency as they do in a batch, since a tag that is out
must never change.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.functions.constants import TAG_PREFIX, TAG_SUFFIX

OUT = "job_id string, category string, key string, value string, tag string"


def append_only_tags(found: DataFrame, prefix: str = TAG_PREFIX, suffix: str = TAG_SUFFIX) -> DataFrame:
    """A stream of finds (job_id, category, key, value) to a row with a tag for each new key.

    The state of a job's category is its keys in the order of their numbers,
    what one person reviews.  Within a batch keys are numbered in their order.
    """

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job, category = group
        keys = list(state.get[0]) if state.exists else []
        known = set(keys)
        rows = pd.concat(list(frames)).sort_values(["key", "value"]).drop_duplicates("key")
        name = re.sub("[^A-Z0-9]+", "_", category.upper()).strip("_") or "OTHER"
        out = []
        for key, value in zip(rows["key"], rows["value"], strict=True):
            if key not in known:
                keys.append(key)
                out.append((job, category, key, value, f"{prefix}{name}_{len(keys):03d}{suffix}"))
        state.update((keys,))
        yield pd.DataFrame(out, columns=["job_id", "category", "key", "value", "tag"])

    rows = found.select("job_id", "category", "key", "value")
    return rows.groupBy("job_id", "category").applyInPandasWithState(run, OUT, "keys array<string>", "append", GroupStateTimeout.NoTimeout)
