"""Proposals against the catalogue, end to end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from reelwright.operators import match
from reelwright.session import cut_lineage


def scored_catalogue(items: DataFrame, priorities: Sequence[str], as_of_epoch: int) -> DataFrame:
    """Scored items, written once: four kinds of candidate sets are built from them."""
    return cut_lineage(match.scored_columns(match.score_existing(items, priorities, as_of_epoch)))


def check(proposals: DataFrame, items: DataFrame, series: DataFrame, priorities: Sequence[str], as_of_epoch: int,
          excluded: Sequence[str] = ()) -> DataFrame:
    """Proposals to decisions."""
    scored = scored_catalogue(items, priorities, as_of_epoch)
    matched = match.match_cascade(proposals, scored, series, excluded)
    return match.compare_copies(match.score_proposed(matched, priorities, as_of_epoch), priorities)


def check_episode_sets(requests: DataFrame, items: DataFrame, series: DataFrame, priorities: Sequence[str],
                       as_of_epoch: int, excluded: Sequence[str] = ()) -> DataFrame:
    """Requests for sets of episodes to one result each."""
    asked = match.explode_episode_set(requests)
    return match.episode_set_result(check(asked, items, series, priorities, as_of_epoch, excluded))
