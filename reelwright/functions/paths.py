"""Path expressions: normal form, folder, file name, ancestors, episode keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelwright.constants import EXTRAS_IN_NAME, SEASON_FOLDER, VIDEO_EXTENSIONS


def path_norm(path: Column) -> Column:
    """Forward slashes, no trailing slash, blank for null."""
    slashed = F.translate(F.coalesce(path, F.lit("")), "\\", "/")
    return F.rtrim(slashed, F.lit("/"))


def parent_dir(path: Column) -> Column:
    """Folder part; the root for files directly under it, blank without a slash."""
    head = F.substring(path, F.lit(1), F.length(path) - F.length(basename(path)))
    return F.coalesce(F.nullif(F.rtrim(head, F.lit("/")), F.lit("")), head)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(name: Column) -> Column:
    """File name without its last extension; names that only start with dots keep it."""
    return F.regexp_replace(name, r"^(.*[^.].*)\.[^.]*$", "$1")


def path_stem(path: Column) -> Column:
    return stem(basename(path))


def is_per_title(path: Column) -> Column:
    """True when the folder is named after the file in it."""
    folder = basename(parent_dir(path))
    return (folder != "") & path_stem(path).startswith(folder)


def ancestors(directory: Column) -> Column:
    """The folder and every folder above it, root excluded."""
    parts = F.split(directory, "/")
    every = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )
    return F.filter(every, lambda d: ~d.isin("", "/"))


def is_video(name: Column) -> Column:
    extensions = "|".join(e[1:] for e in VIDEO_EXTENSIONS)
    return name.rlike(rf"(?i)[^.].*\.({extensions})$")


def is_extra(name: Column) -> Column:
    return stem(name).rlike(EXTRAS_IN_NAME)


def season_folder(directory: Column) -> Column:
    """Nearest folder above that names a season, or null."""
    seasons = F.filter(ancestors(directory), lambda d: basename(d).rlike(SEASON_FOLDER))
    return F.try_element_at(seasons, F.lit(-1))


# season/episode spellings in file names, tried in this order.
EPISODE_PATTERNS = (
    r"[Ss](\d+)[Ee](\d+)",
    r"(\d+)[xX](\d+)",
    r"[sS](\d+)\.?[eE](\d+)",
    r"[sS](\d+)_[eE](\d+)",
    r"(?<!\d)([1-9])(\d{2})(?!\d)",
)


# All of them in one search: the first that is found anywhere in the name, at its first place; else nothing. The whole
# name is matched, so what replaces it is the numbers alone.
_ANY_EPISODE = "(?s)^(?:" + "|".join(f".*?{p}" for p in EPISODE_PATTERNS) + "|).*"
_NUMBERS = "|".join("".join(f"${2 * i + side}" for i in range(len(EPISODE_PATTERNS))) for side in (1, 2))


def episode_numbers(path: Column) -> Column:
    """Season and episode in the file name as "season|episode", "|" when nothing matches."""
    return F.regexp_replace(basename(path), _ANY_EPISODE, _NUMBERS)


def episode_of(numbers: Column) -> Column:
    """struct(season, episode) of ``episode_numbers``; text without leading zeros, null when nothing matched."""

    def plain(digits: Column) -> Column:
        return F.when(numbers != "|", F.coalesce(F.nullif(F.ltrim(digits, F.lit("0")), F.lit("")), F.lit("0")))

    return F.struct(
        plain(F.substring_index(numbers, "|", 1)).alias("season"),
        plain(F.substring_index(numbers, "|", -1)).alias("episode"),
    )


def episode_key_from_filename(path: Column) -> Column:
    """struct(season, episode) read from the file name; both null when nothing matches.

    The three-digit rule also reads 720p as season 7 episode 20, so callers apply this to
    items that belong to a series only. Numbers stay text without leading zeros.
    """
    return episode_of(episode_numbers(path))
