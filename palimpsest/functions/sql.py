"""The functions that plain SQL lacks, registered with a session.

``normalise_nfkc(text)`` and ``fold_case(text)`` are scalar; ``detect(text)`` is a
table function for LATERAL joins.  Frames should use ``operators.detect``, which stays in the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from palimpsest.functions import text as T
from palimpsest.functions.constants import DETECTORS


class Detect:
    """(rule, category, match_ord, value) of each find in a text; none for null."""

    def __init__(self):
        self.rules = [(name, category, re.compile(pattern), group) for name, (category, pattern, group) in DETECTORS.items()]

    def eval(self, text: str):
        for name, category, pattern, group in self.rules:
            found = (m.group(group).strip(" .,;:") for m in pattern.finditer(text or ""))
            for place, value in enumerate(v for v in found if v):
                yield name, category, place, value


def register(spark: SparkSession) -> None:
    spark.udf.register("normalise_nfkc", T.nfkc)
    spark.udf.register("fold_case", T.casefold)
    spark.udtf.register("detect", udtf(Detect, returnType="rule string, category string, match_ord int, value string"))
