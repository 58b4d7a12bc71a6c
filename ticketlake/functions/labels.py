"""Lookup expressions: labels onto the taxonomies, actions onto next steps.

The tables are constants of at most 18 entries, so they are folded into the
plan as map literals; no join and no broadcast is needed.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import (
    ACTION_STEPS,
    FORWARD_STEPS,
    PRIORITY_URGENCY,
    QUEUE_TOPICS,
    URGENCY_LEVELS,
    VERSION_RANKS,
)
from .text import strip


def lookup(table: dict, key: Column) -> Column:
    """``table[key]``, null where the key is absent."""
    literal = F.create_map(*(F.lit(x) for x in chain.from_iterable(table.items())))
    return F.try_element_at(literal, key)


def has_explicit_topic(queue: Column) -> Column:
    return F.coalesce(queue.isin(list(QUEUE_TOPICS)), F.lit(False))


def queue_topic(queue: Column) -> Column:
    """Exact, case-sensitive lookup; other queues are ``Other``, no queue stays null."""
    return F.when(
        queue.isNotNull(), F.coalesce(lookup(QUEUE_TOPICS, queue), F.lit("Other"))
    )


def priority_urgency(priority: Column) -> Column:
    """Trimmed, case-insensitive lookup; unknown priorities give null."""
    return lookup(PRIORITY_URGENCY, F.lower(strip(priority)))


def urgency_ordinal(level: Column) -> Column:
    return lookup({name: i for i, name in enumerate(URGENCY_LEVELS)}, level)


def version_rank(version: Column) -> Column:
    return F.coalesce(lookup(VERSION_RANKS, version), F.lit(0))


def next_step(action: Column, topic: Column) -> Column:
    """Every action but FORWARD has one step; FORWARD goes by topic."""
    return F.coalesce(
        lookup(ACTION_STEPS, action),
        F.when(action == "FORWARD", lookup(FORWARD_STEPS, topic)),
    )
