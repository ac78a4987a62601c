"""Token ids in length-delimited binary records with an offset index.

A data file holds records one after another. A record is

    length of the payload    8 bytes, little-endian
    masked checksum of the length    4 bytes
    payload                  ids, each of ``id_bytes`` bytes, little-endian
    masked checksum of the payload   4 bytes
    line feed                1 byte, ends the record

A checksum is the CRC-32 of the bytes, rotated right by 15 bits and raised by 0xA282EAD8, so that
checksums stored inside data that is itself checked do not disturb the check. The index is a
Parquet table (file, position, record offset, record length, doc_id, number of ids, first id's
number in its file) for reads in any order: a reader fetches the bytes at an offset and checks them.

Files are written and read by Spark alone, so any store that Spark knows will do, and a task that
runs again writes the same file. Documents are dealt into files by ranges of doc_id and sorted
inside them; a file's number follows its range. Ids take two bytes if the vocabulary allows it.

Tokens of a white-space word do not depend on its neighbours for the tokenizers meant here
(checked on the tokenizer's own settings): no piece of theirs crosses white space. So a worker
encodes each word once and keeps the words it has met in a table of bounded size (a text's own
words may lie above the bound while it is encoded); the table changes the time only. Other tokenizers encode whole texts.

Defined results: null and empty texts have no ids but the end id. Null doc_ids come first. Equal
doc_ids are ordered by a hash of the text; equal rows are interchangeable. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelwright.operators.grouping import spread_join
from reelwright.session import shared_folder, shuffles_released

MASK_DELTA = 0xA282EAD8
HEAD = struct.Struct("<QI")
TAIL = struct.Struct("<Ic")
WORDS_KEPT = 500_000
CHARS_AT_ONCE = 1 << 21
FILE_BYTES = 24 << 20  # of text
#: A full stop or comma beside another sign makes a piece with it.
SIGNS_MEET = re.compile(r"[.,](?:(?=[^\s\w]|_)|(?<=[^\s\w].)|(?<=_.))")
#: Python's white space that the tokenizers do not take for white space.
NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
#: White space beyond ASCII.
WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record."""
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, TAIL.pack(masked(payload), b"\n")))


def unframe(data: bytes | memoryview, at: int) -> tuple[memoryview, int]:
    """The payload of the record at an offset, and where the next begins; fails on any damage."""
    view = memoryview(data)
    size, check = HEAD.unpack_from(view, at)
    if masked(bytes(view[at:at + 8])) != check:
        raise ValueError(f"damaged length at {at}")
    payload = view[at + HEAD.size:at + HEAD.size + size]
    check, end = TAIL.unpack_from(view, at + HEAD.size + size)
    if end != b"\n" or masked(payload) != check:
        raise ValueError(f"damaged record at {at}")
    return payload, at + HEAD.size + size + TAIL.size


class Encoder:
    """Ids of texts as bytes, by the tokenizers library.

    Where the tokenizer's settings allow it, texts are cut into words, at white space and around single
    full stops and commas. The words of many texts are numbered by Arrow, each different word is looked up
    once, and the ids of the texts are gathered from a table of the words' ids. New words that are runs of
    lower-case letters in composed form, which normalising and cutting leave as they are, go to the
    tokenizer's model many at a time; other new words go to the whole tokenizer, parted by a special token.
    """

    def __init__(self, path: str, id_bytes: int):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = Split(" ", "removed")
        self.dtype = f"<u{id_bytes}"
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        self.by_words = splits_at_white_space(settings)
        self.by_letters = self.by_words and cuts_letters_whole(settings)
        self.of_byte = byte_letters()
        added = [(t["content"], t["id"]) for t in settings.get("added_tokens", ())]
        self.special = re.compile("|".join(re.escape(c) for c, _ in added) or r"(?!)", re.IGNORECASE)
        self.parting = added[-1] if added else None
        suffix = settings["model"].get("end_of_word_suffix")
        vocabulary = settings["model"].get("vocab", {})
        self.ends_word = None
        if suffix and isinstance(vocabulary, dict):
            self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends_word[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, self.dtype)
        self.until = np.zeros(1 << 14, np.int64)  # where the ids of each known word end; the first entry is no word

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype) for e in found]

    def _words(self, text: str) -> str | None:
        """The text with its words between spaces, each of which encodes alone; none if it has to be encoded whole."""
        if not self.by_words or any(c in text for c in NOT_SPACE) or self.special.search(text):
            return None
        if self.by_letters and "\u03a3" not in text:  # final sigma: lower-cased by its neighbours
            text = text.lower()
            if not SIGNS_MEET.search(text):
                text = text.replace(".", " . ").replace(",", " , ")
        return text if text.isascii() else WIDE_SPACE.sub(" ", text)

    def _piece(self, word: str) -> str | None:
        """The word as the model takes it, if it is a run of lower-case letters."""
        if not self.by_letters or not word.isalpha():
            return None
        if word.isascii():
            return word if word.islower() else None
        if word == word.lower() and unicodedata.is_normalized("NFC", word):
            return word.encode().decode("latin-1").translate(self.of_byte)
        return None

    def _add(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """Words with their ids, one after another, and where each word's ids end."""
        n, at = len(self.known), self.until[len(self.known)]
        while at + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while n + len(words) >= len(self.until):
            self.until = np.concatenate((self.until, np.zeros_like(self.until)))
        self.ids[at:at + len(ids)] = ids
        self.until[n + 1:n + 1 + len(words)] = at + ends
        self.known.update(zip(words, range(n, n + len(words))))

    def _add_each(self, words: list[str]) -> None:
        found = self._whole(words)
        self._add(words, np.concatenate(found), np.cumsum([len(x) for x in found]))

    def _learn(self, words: list[str]) -> None:
        pieces = [self._piece(w) for w in words]
        plain = [w for w, p in zip(words, pieces) if p is not None]
        others = [w for w, p in zip(words, pieces) if p is None]
        if plain:
            text = " ".join([p for p in pieces if p is not None])
            if self.ends_word is not None:
                ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
                ends = np.flatnonzero(self.ends_word[ids]) + 1
            else:
                found = self.bare.encode(text, add_special_tokens=False)
                ids = np.array(found.ids, self.dtype)
                ends = np.searchsorted(np.array(found.word_ids), np.arange(1, len(plain) + 1))
            if len(ends) != len(plain):  # a word without a last piece of its own
                others = words
            else:
                self._add(plain, ids, ends)
        if others and self.parting:
            text, mark = self.parting
            joined = f" {text} ".join([*others, ""])
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.dtype)
            parted = ids == mark
            ends = np.flatnonzero(parted)
            if len(ends) == len(others):
                self._add(others, ids[~parted], ends - np.arange(len(ends)))
                return
        if others:
            self._add_each(others)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > WORDS_KEPT:
            self._forget()
        spaced = [self._words(t) for t in texts]
        lists = pc.ascii_split_whitespace(pa.array(spaced, pa.large_string()))
        numbered = lists.flatten().dictionary_encode()
        different = numbered.dictionary.to_numpy(zero_copy_only=False)
        place = np.array([self.known.get(w, -1) for w in different], np.int64)
        new = np.flatnonzero((place < 0) & (different != ""))  # splitting leaves an empty word at either end
        if len(new):
            words = different[new].tolist()
            self._learn(words)
            place[new] = [self.known[w] for w in words]
        begin, end = np.where(place < 0, 0, self.until[place]), np.where(place < 0, 0, self.until[place + 1])
        codes = numbered.indices.to_numpy(zero_copy_only=False)
        sizes = (end - begin)[codes]
        before = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.ids[np.repeat(begin[codes] - before[:-1], sizes) + np.arange(before[-1])]
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        cuts = before[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [self._whole([t])[0].tobytes() if s is None else ids[a:b].tobytes()
                for t, s, a, b in zip(texts, spaced, cuts, cuts[1:])]


def byte_letters() -> dict[int, str]:
    """The letters that byte-level tokenizers write for bytes: visible Latin-1 characters for themselves,
    the others, in order, for the characters from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(0x100 + i) for i, b in enumerate(hidden)}


def cuts_letters_whole(settings: dict) -> bool:
    """True if a run of letters, and a sign behind it, are pieces of their own, written byte by byte."""
    pre = settings.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers") or []
    if len(steps) != 2 or steps[1].get("type") != "ByteLevel" or steps[1].get("use_regex"):
        return False
    pattern = (steps[0].get("pattern") or {}).get("Regex", "")
    return r"|[\p{L}]+|" in pattern and pattern.endswith(r"[^\s\p{L}\p{N}]+") and not steps[1].get("add_prefix_space")


def splits_at_white_space(settings: dict) -> bool:
    """True if the settings drop white space and let no piece cross it, so that words encode alone."""
    steps = (settings.get("normalizer") or {}).get("normalizers") or [settings.get("normalizer") or {}]
    local = all(s.get("type") in ("NFC", "Lowercase") or s.get("type") == "Replace"
                and s["pattern"] == {"Regex": "\\s+"} and s["content"] == " " for s in steps)
    pre = settings.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    # Inverted and removed: what the pattern does not match is dropped. No alternative takes white space.
    pattern = (first.get("pattern") or {}).get("Regex", "\\s")
    drops = first.get("behavior") == "Removed" and first.get("invert") is True
    crosses = "\\s" in pattern.replace("[^\\s", "[^") or " " in pattern or "." in pattern
    added = any(c.isspace() for t in settings.get("added_tokens", ()) for c in t["content"])
    return local and drops and not crosses and not added and settings["model"]["type"] == "BPE"


@lru_cache(2)
def encoder(path: str, id_bytes: int) -> Encoder:
    """One per worker process."""
    return Encoder(path, id_bytes)


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about ``CHARS_AT_ONCE`` bytes of the second column, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        until = max(at + 1, int(np.searchsorted(sizes, before + CHARS_AT_ONCE, "right")))
        yield batch.slice(at, until - at)
        at = until


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
                  text_col: str = "text", id_bytes: int = 2) -> None:
    """Encode every text, end it with ``end_id``, and write data files under ``folder``/data."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from reelwright.llm.records import encoder as shared

        encode = shared(tokenizer, id_bytes).encode
        end = int(end_id).to_bytes(id_bytes, "little")
        for batch in batches:
            for part in parts(batch):
                found = encode([t or "" for t in part.column(1).to_pylist()])
                # The payload opens with the doc_id, so that files can be read without their index.
                heads = [struct.pack("<?q", d is not None, d or 0) for d in part.column(0).to_pylist()]
                rows = [frame(head + ids + end)[:-1] for head, ids in zip(heads, found)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])

    # Ranges are found from a sample of the keys on the driver, so the text itself is none of them.
    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"),
                          F.col(text_col).alias("text"))
    # Files stay small enough to be read as one value each, at any size of the input.
    total = ordered.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spark = docs.sparkSession
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_BYTES))
    # A last key without ties lets equal rows lie in several files.
    dealt = ordered.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(files, "id", "hash", "row")
    rows = dealt.sortWithinPartitions("id", "hash", "row").select("id", "text").mapInArrow(of_batches, "value binary")
    with shuffles_released(spark):
        # Spark's text writer ends each value with the line feed of the format.
        rows.select(F.col("value").cast("string").alias("value")).write.text(f"{folder}/data")


FIELDS = "file string, position long, offset long, length long, doc_id long, n_tokens long, start_in_file long, ids_crc32 long"


def _scan(id_bytes: int):
    types = [pa.string(), *[pa.int64()] * 7]
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from reelwright.llm.records import encoder as shared

        shared.cache_clear()  # a worker that wrote before holds its words no longer
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                data = content.as_buffer() if content.is_valid else b""
                at, before, rows = 0, 0, []
                file = path.as_py().rpartition("/")[2]
                while at < len(data):
                    payload, after = unframe(data, at)
                    has_id, doc = struct.unpack_from("<?q", payload)
                    ids = np.frombuffer(payload, f"<u{id_bytes}", offset=9)
                    rows.append((file, len(rows), at, after - at, doc if has_id else None, len(ids), before,
                                 zlib.crc32(ids.astype("<u4").tobytes())))
                    at, before = after, before + len(ids)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return of_batches


def read_records(spark: SparkSession, folder: str, id_bytes: int = 2) -> DataFrame:
    """One row per record, read from the data files with every checksum checked."""
    files = spark.read.format("binaryFile").load(f"{folder}/data").where("length > 0").select("path", "content")
    return files.mapInArrow(_scan(id_bytes), FIELDS)


def write_index(spark: SparkSession, folder: str, id_bytes: int = 2) -> DataFrame:
    """The offset index of the data files, written beside them and read back."""
    read_records(spark, folder, id_bytes).write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def fetch(spark: SparkSession, folder: str, wanted: DataFrame, id_bytes: int = 2) -> DataFrame:
    """(doc_id, ids) of the index rows in ``wanted``, in any order: only their bytes are decoded."""
    by_file = wanted.groupBy("file").agg(F.collect_list(F.struct("offset", "doc_id")).alias("at"))
    files = spark.read.format("binaryFile").load(f"{folder}/data").select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, at in zip(batch.column(0), batch.column(1)):
                data = content.as_buffer()
                rows = at.as_py()
                ids = [np.frombuffer(unframe(data, r["offset"])[0], f"<u{id_bytes}", offset=9) for r in rows]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["doc_id"] for r in rows], pa.int64()),
                    pa.array([x.tolist() for x in ids], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return files.join(by_file, "file").select("content", "at").mapInArrow(of_batches, "doc_id long, ids array<long>")


def encoded(docs: DataFrame, tokenizer: str, end_id: int = 1, id_bytes: int = 2) -> DataFrame:
    """Write ``docs`` to new files, read them back: (doc_id, start, n_tokens, ids_crc32, file, offset, length).

    ``start`` counts the ids of all records before, in the order of files and records.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "records")
    write_records(docs, folder, tokenizer, end_id, id_bytes=id_bytes)
    index = write_index(spark, folder, id_bytes)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    starts = totals.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    rows = spread_join(index, starts, "file")
    return rows.select("doc_id", (F.col("before") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32",
                       "file", "offset", "length")
