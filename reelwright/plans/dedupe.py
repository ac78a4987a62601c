"""Catalogue to keep/delete decisions, with the path guard."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelwright.functions.util import non_blank
from reelwright.operators import components, guard, index, select
from reelwright.session import cut_lineage, written


@dataclass(frozen=True)
class DedupeParams:
    """Settings of a duplicate run."""

    language_priorities: Sequence[str] = ()
    excluded_ids: Sequence[str] = ()


# What the group checks read of an item.
CHECK_COLUMNS = ("item_id", "series_name", "path", "provider_ids")


def full_index(items: DataFrame) -> DataFrame:
    return index.merge_indexes(index.provider_index(items), index.series_episode_index(items))


def duplicate_groups(items: DataFrame, params: DedupeParams = DedupeParams()) -> DataFrame:
    """(group_id, item_id) of items that share identifiers, directly or through others.

    The steps below read their input more than once, so each input is written to the
    checkpoint folder instead of being computed again from the catalogue.
    """
    entries = written(full_index(items), "entries")
    edges = index.duplicate_edges(entries, params.excluded_ids)
    labels = components.connected_components(edges)
    members = cut_lineage(select.component_members(labels, index.item_metadata(entries)))
    return cut_lineage(select.verify_groups(members))


def candidates(items: DataFrame, params: DedupeParams = DedupeParams()) -> DataFrame:
    """(group_id, item_id) left after exclusions and path checks."""
    kept = written(select.commonest_episode(checked_members(items, params)).select("group_id", "item_id", "path"), "kept")
    return select.dedupe_by_path(kept).select("group_id", "item_id")


def checked_members(items: DataFrame, params: DedupeParams = DedupeParams()) -> DataFrame:
    """Members of the groups without any excluded id, with what their file name says, as a table.

    Ids and file names are looked at where the items are read, once, not in every step that needs what they say.
    """
    ids = [select.excluded_id(params.excluded_ids).alias("excluded_id")] if params.excluded_ids else []
    seen = select.with_episode_key(items.select(*CHECK_COLUMNS)).select("item_id", "path", "_key", *ids)
    members = written(duplicate_groups(items, params).join(seen, "item_id"), "members")
    return written(select.without_excluded(members), "allowed") if ids else members


def rated_members(items: DataFrame, params: DedupeParams = DedupeParams()) -> DataFrame:
    """Candidate members with their item columns, score and languages.

    Items are rated where they are read, so that their streams are not shuffled.
    """
    rated = select.with_languages(select.rate_items(items), params.language_priorities)
    return candidates(items, params).join(rated, "item_id")


def decide(items: DataFrame, params: DedupeParams = DedupeParams(), columns: Sequence[str] | None = None) -> DataFrame:
    """Long decision table: one row per member, keep or delete, with all columns of decisions or with those named.

    Items are rated where they are read, so that their streams are not shuffled. The members are written between the
    rating and the choice, and a written table hides from Spark which columns its reader leaves out: so a caller
    that reads a few can name them.
    """
    rated = select.with_languages(select.rate_items(items), params.language_priorities)
    details = select.decision_columns(rated)
    if columns is not None:
        details = details.select(*dict.fromkeys((*select.CHOICE_COLUMNS, *columns)))
    decisions = select.select_keep_delete(cut_lineage(candidates(items, params).join(details, "item_id")))
    if columns is None:
        return decisions
    return decisions.drop(*[c for c in select.CHOICE_COLUMNS if c not in ("item_id", *columns)])


def guarded_decisions(items: DataFrame, params: DedupeParams = DedupeParams(), columns: Sequence[str] | None = None) -> DataFrame:
    """Decisions with their group's keeper; delete rows carry the guard's verdict and a status.

    ``columns`` names the columns of decisions that the caller reads besides those of keepers and guard; all if not given.
    """
    needed = None if columns is None else (*select.KEEPER_COLUMNS, *columns)
    decisions = cut_lineage(select.enrich_decision(decide(items, params, needed)))
    # Decided items are items, so the paths of the items are all that are known.
    known = items.select("path").where(non_blank(F.col("path")))
    checked = guard.guard_pass(decisions, known)
    keepers = decisions.where("role = 'keep'").withColumn("status", F.lit(None).cast("string"))
    return keepers.unionByName(checked, allowMissingColumns=True)
