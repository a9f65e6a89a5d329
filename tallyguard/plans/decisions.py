"""The decision job: events in, scored events with rule hits, reasons and cases out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyguard.operators.dedupe import claim_first
from tallyguard.operators.features import add_features
from tallyguard.operators.rules import Rule, apply_rules, load_rules
from tallyguard.operators.scoring import FittedScorer, LogisticScorer, score
from tallyguard.operators.validate import dead_letters, normalise, route_messages, valid_events
from tallyguard.session import written
from tallyguard.sources.sinks import with_case


def decide(
    events: DataFrame,
    scorer: LogisticScorer | FittedScorer | None = None,
    rules: list[Rule] | None = None,
    decided_at: str | None = "event_time",
    **feature_options: object,
) -> DataFrame:
    """Valid, distinct events with features, rule hits, score, decision, reasons and case."""
    enriched = add_features(normalise(events), **feature_options)
    judged = apply_rules(enriched, load_rules() if rules is None else rules)
    return with_case(score(judged, scorer or LogisticScorer()), decided_at)


def decide_messages(messages: DataFrame, **options: object) -> tuple[DataFrame, DataFrame]:
    """Decisions and dead letters of a set of raw messages.

    The routed messages are written once to the work folder: the feature job reads its input
    several times, and decoding is the costly part.
    """
    routed = written(route_messages(messages), "routed")
    return decide(claim_first(valid_events(routed)), **options), dead_letters(routed)
