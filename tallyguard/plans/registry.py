"""The table of queries: a builder and, where SQL can say it, the cross-check SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyguard.operators.scoring import DEFAULT_SCORER
from tallyguard.plans.oracle_parts import FEEDBACK, MESSAGES, TX, features_cte, scored_cte

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}

_scorer = json.loads(DEFAULT_SCORER.read_text(encoding="utf-8"))
_SCORED = scored_cte(_scorer["intercept"], _scorer["weights"])

# SQL prefixes by depth: transactions, messages, features, scores, cases with feedback.
WITH_TX = f"WITH {TX}"
WITH_MESSAGES = f"{WITH_TX}, {MESSAGES}"
WITH_FEATURES = f"{WITH_TX}, {features_cte()}"
WITH_SCORES = f"{WITH_FEATURES}, {_SCORED}"
WITH_CASES = f"{WITH_SCORES}, {FEEDBACK}"
WITH_VALID_SCORES = f"{WITH_MESSAGES}, {features_cte('valid_tx')}, {_SCORED}"

# A fixed clock for trailing windows: the end of the time span of the data.
AS_OF = 1_704_067_200 + 64_800 + 43_200


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def add(builder: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"query {name} is defined twice")
        QUERIES[name] = builder
        if sql is not None:
            ORACLES[name] = sql
        return builder

    return add
