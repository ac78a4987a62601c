"""Reading media streams: first video or audio stream, languages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelwright.constants import LANGUAGE_ALIASES, NO_LANGUAGE_RANK
from reelwright.functions.util import literal_map, string_array


def first_stream(streams: Column, kind: str) -> Column:
    """First stream of a kind, or null."""
    return F.try_element_at(F.filter(streams, lambda s: s["type"] == kind), F.lit(1))


def audio_languages(streams: Column) -> Column:
    """Distinct known audio languages in stream order, spelling kept."""
    audio = F.filter(streams, lambda s: s["type"] == "Audio")
    spoken = F.transform(audio, lambda s: s["language"])
    known = F.filter(spoken, lambda x: x.isNotNull() & (x != "") & (x != "unknown"))
    return F.coalesce(F.array_distinct(known), F.array().cast("array<string>"))


def normalize_language(language: Column) -> Column:
    """Lower-case code with the spellings of one language folded together."""
    code = F.lower(language)
    return F.coalesce(F.try_element_at(literal_map(LANGUAGE_ALIASES), code), code)


def normalize_priorities(priorities: Sequence[str]) -> list[str]:
    """Priority list in canonical codes, order kept, repeats dropped."""
    codes = (LANGUAGE_ALIASES.get(p.strip().lower(), p.strip().lower()) for p in priorities)
    return list(dict.fromkeys(c for c in codes if c))


def language_rank(languages: Column, priorities: Sequence[str]) -> Column:
    """Position of the best priority language, or 9999 when there is none."""
    wanted = string_array(normalize_priorities(priorities))
    places = F.transform(
        languages, lambda x: F.array_position(wanted, normalize_language(x)).cast("int") - 1
    )
    best = F.array_min(F.filter(places, lambda p: p >= 0))
    return F.coalesce(best, F.lit(NO_LANGUAGE_RANK))


def matched_language(rank: Column, priorities: Sequence[str]) -> Column:
    """The priority language behind a rank, null when there is none."""
    return F.get(string_array(normalize_priorities(priorities)), rank)
