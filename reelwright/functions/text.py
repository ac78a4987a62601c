"""Titles, lists, credentials in URLs, and a light English check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelwright.constants import (
    CREDENTIAL_PARAMS,
    ENGLISH_WORDS,
    SLAVIC_LETTERS,
    SLAVIC_WORDS,
)


def normalize_title(title: Column) -> Column:
    """Lower case, letters, digits and underscores of any script, single spaces."""
    words = F.regexp_replace(F.lower(title), r"(?U)[^\p{L}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(words, r"(?U)\s+", " "))


def titles_match(left: Column, right: Column, fuzzy: bool = True) -> Column:
    """Equal after normalising, or (fuzzy) one inside the other."""
    a, b = normalize_title(left), normalize_title(right)
    same = a == b
    return same | a.contains(b) | b.contains(a) if fuzzy else same


def _word_pattern(words: Sequence[str]) -> str:
    return r"(?iU)\b(" + "|".join(words) + r")\b"


def is_english_text(text: Column) -> Column:
    """No Slavic letter, at least two English function words, no Slavic function word."""
    filled = F.trim(F.coalesce(text, F.lit(""))) != ""
    english = F.regexp_count(text, F.lit(_word_pattern(ENGLISH_WORDS)))
    slavic = text.rlike(f"[{SLAVIC_LETTERS}]") | text.rlike(_word_pattern(SLAVIC_WORDS))
    return filled & F.coalesce(~slavic & (english >= 2), F.lit(False))


def parse_id_list(text: Column) -> Column:
    """Comma list as trimmed, non-empty, distinct entries."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def _is_credential(pair: Column, params: Sequence[str]) -> Column:
    name = F.lower(F.substring_index(pair, "=", 1))
    return name.isin(*[p.lower() for p in params])


def strip_url_credentials(url: Column, params: Sequence[str] = CREDENTIAL_PARAMS) -> Column:
    """URL without the credential parameters of its query; the others keep their order."""
    head = F.substring_index(url, "?", 1)
    rest = F.substring(url, F.length(head) + 2, F.length(url))
    query = F.substring_index(rest, "#", 1)
    fragment = F.substring(rest, F.length(query) + 1, F.length(rest))
    kept = F.array_join(
        F.filter(F.split(query, "&"), lambda p: (p != "") & ~_is_credential(p, params)), "&"
    )
    rebuilt = F.concat(
        head, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")), fragment
    )
    return F.when(url.contains("?"), rebuilt).otherwise(url)


def extract_url_key(url: Column, params: Sequence[str] = CREDENTIAL_PARAMS) -> Column:
    """First non-empty credential value of the query, null when there is none."""
    query = F.substring_index(F.regexp_extract(url, r"\?(.*)$", 1), "#", 1)
    hits = F.filter(F.split(query, "&"), lambda p: p.rlike("=.") & _is_credential(p, params))
    first = F.try_element_at(hits, F.lit(1))
    return F.try_url_decode(F.substring(first, F.instr(first, "=") + 1, F.length(first)))


def cache_key_hash(*fields: Column) -> Column:
    """Sixteen hex digits that identify a set of parameters (given in name order)."""
    return F.substring(F.md5(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})), 1, 16)
