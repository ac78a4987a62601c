"""The filter audit, importance resampling and packing against plain Python, on odd rows and on empty tables."""

import collections
import itertools
import math
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from reelwright.llm import audit, importance, packing, records, registered

SF = "/root/testdata/sf0.001"
WHITE = r"[^\x20\x09-\x0D]+"


def plain_masks(rows):
    """(part, mask, doc_id) by the five failure conditions as they are worded."""
    for doc_id, source, text in rows:
        text = text or ""
        words = regex.findall(WHITE, text)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words),
                 100 * len(regex.findall("[A-Z]", text)) > 2 * len(text), bool(regex.search("[#$%&*|]", text)),
                 any(o is not None and doc_id is not None and o < doc_id and (t or "") == text for o, _, t in rows)]
        yield source or "", sum(f << i for i, f in enumerate(fails)), doc_id


def plain_report(rows, good, toxic):
    masks = list(plain_masks(rows))
    out = []
    for part in {m[0] for m in masks}:
        own = [(m, d) for p, m, d in masks if p == part]
        removed = collections.Counter()
        lines = []
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, letter in enumerate(order):
                bit = 1 << "ABCDE".index(letter)
                gone, left_after = [x for x in left if x[0] & bit], [x for x in left if not x[0] & bit]
                removed[letter] += len(gone)
                lines.append((part, "".join(order), k + 1, len(left_after), len(gone),
                              sum(bool(m & bit) for m, _ in own) - len(gone), sum(m == bit for m, _ in own),
                              sum(d in good for _, d in gone), sum(d in toxic for _, d in gone), letter))
                left = left_after
        out += [(*x[:-1], removed[x[-1]]) for x in lines]
    return sorted(out)


ODD = [
    (9, "Aa " * 300, "x"), (4, "Aa " * 300, "y"), (4, "Aa " * 300, "x"), (2, "Aa " * 300, None), (None, "Aa " * 300, "x"),
    (5, None, "x"), (3, "", "x"), (3, "", "x"), (7, "a|b", "y"), (None, None, None), (8, "é" * 9, "y"),
    (11, " ".join(f"w{i}" for i in range(250)), "y"), (12, " ".join(f"w{i % 200}" for i in range(20000)), "y"),
    (13, "a b c " * 250, "x"), (14, "a|b", "x"), (1, "a|b", "x"),
]


@pytest.mark.parametrize("files", [1, 16])
def test_audit_takes_back_what_smaller_ids_change(spark, tmp_path, files):
    rows = spark.createDataFrame(ODD, "doc_id long, text string, source string").withColumns(
        {"part": F.lit("p"), "mask": F.lit(1), "key": F.lit("k"), "n": F.lit(2)})
    path = str(tmp_path / "documents.parquet")
    rows.repartition(files, "doc_id", F.rand(1)).write.option("maxRecordsPerFile", 1 if files > 1 else 0).parquet(path)
    labels = spark.createDataFrame([(4, 1, 0), (2, 1, 1), (4, 0, 1), (None, 1, 1), (7, None, 1), (99, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    found = audit.report(audit.counters(spark, path, labels, micro_batches=16 if files > 1 else 1))
    want = plain_report([(i, s, t) for i, t, s in ODD], {4, 2}, {2, 4, 7})
    assert sorted(tuple(r) for r in found.collect()) == want


def test_audit_goes_on_where_it_was_broken_off(spark, tmp_path, monkeypatch):
    path, folder = str(tmp_path / "documents.parquet"), str(tmp_path / "state")
    spark.createDataFrame(ODD, "doc_id long, text string, source string").repartition(6).write.option("maxRecordsPerFile", 3).parquet(path)
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    write, calls = audit.Folder.write, []

    def breaks_once(self, rows, name, number):
        calls.append(name)
        if name == "changes" and number == 2 and calls.count("heads") <= 4:
            raise RuntimeError("lost")
        return write(self, rows, name, number)

    monkeypatch.setattr(audit.Folder, "write", breaks_once)
    with pytest.raises(Exception, match="lost"):
        audit.counters(spark, path, labels, micro_batches=5, folder=folder)
    found = audit.report(audit.counters(spark, path, labels, micro_batches=5, folder=folder))
    assert sorted(tuple(r) for r in found.collect()) == plain_report([(i, s, t) for i, t, s in ODD], {4}, set())


def test_a_micro_batch_of_the_audit_writes_few_files(spark, tmp_path):
    """A segment has no more files than its micro-batch was read in, however many partitions a shuffle has."""
    path, deal = str(tmp_path / "documents.parquet"), {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false",
                                                        "spark.sql.autoBroadcastJoinThreshold": "-1"}
    spark.range(3000).selectExpr("id AS doc_id", "concat('copy ', id div 2) AS text", "'s' AS source").repartition(2).write.parquet(path)
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    state = audit.Folder(spark, str(tmp_path / "state"))
    audit.label_rows(labels).write.parquet(f"{state.path}/labels")
    before = {k: spark.conf.get(k) for k in deal}
    try:
        for k, v in deal.items():
            spark.conf.set(k, v)
        audit.take(spark.read.parquet(path), 0, audit.label_rows(labels), state)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    read_in = spark.read.parquet(path).rdd.getNumPartitions()
    for name in ("marks", "heads", "changes"):
        assert len(list((tmp_path / "state" / name / "segment=0").glob("*.parquet"))) <= read_in
    found = spark.read.parquet(f"{state.path}/changes/segment=0").groupBy("mask").sum("n", "good").collect()
    alone = audit.failed(b"copy 1")
    assert sorted(map(tuple, found)) == [(alone, 1500, 1), (alone | audit.REPEAT, 1500, 0)]


def test_audit_of_nothing(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(path)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.report(audit.counters(spark, path, labels)).count() == 0


def plain_weights(rows, target, buckets, ngram):
    def features(text):
        words = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", regex.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        runs = [" ".join(words[i:i + n]) for n in range(1, ngram + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(f.encode()) % buckets for f in runs]

    corpus = collections.Counter(b for _, t in rows for b in features(t)[1])
    aim = collections.Counter(b for t in target for b in features(t)[1])
    s_all, t_all = corpus.total(), aim.total()
    gain = {b: math.floor(1000 * math.log((aim[b] + 1.0) * (s_all + buckets) / ((corpus[b] + 1.0) * (t_all + buckets)))) for b in corpus}
    for doc_id, text in rows:
        n, found = features(text)
        yield doc_id, n, len(found), sum(gain[b] for b in found) // len(found) if found else 0


@pytest.mark.parametrize("buckets,ngram", [(10_000, 1), (100, 3)])
def test_importance(spark, docs, no_docs, buckets, ngram):
    target = spark.createDataFrame([("Le chat dort dans la maison",), (None,), ("",)], "text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = importance.resampled(docs, target, buckets, ngram, share=50, least_words=5).collect()
    want = list(plain_weights(rows, [r.text for r in target.collect()], buckets, ngram))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_features, r.weight) for r in found), key=key) == sorted(want, key=key)
    drawn = sorted((r["rank"], -r.score, r.doc_id is None, r.doc_id) for r in found if r["rank"])
    long_enough = sorted((-r.score, r.doc_id is None, r.doc_id) for r in found if r.n_words >= 5)
    assert [d[0] for d in drawn] == list(range(1, len(long_enough) * 50 // 100 + 1))
    assert [d[1:] for d in drawn] == long_enough[:len(drawn)]
    assert importance.resampled(no_docs, target, buckets, ngram).count() == 0
    assert {r.weight for r in importance.resampled(docs, target.where("false"), buckets, ngram).collect()} is not None


def test_bit_planes_give_exact_sums():
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 5, (7, 130)) * rng.integers(0, 40_000, (7, 130))
    gains = rng.integers(-15_000, 15_000, 130)
    assert (importance.total_gains(counts, importance.gain_planes(gains)) == counts @ gains).all()
    assert (importance.total_gains(np.zeros((2, 130), np.int64), importance.gain_planes(gains)) == 0).all()


def check_pieces(pieces, texts_ids, window):
    """Every id once, in gapless sequences of one window, or of a power of two."""
    by_sequence, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 2 * p.length > 0
        by_sequence[p.sequence_id].append((p.offset, p.length))
        by_doc[p.doc_id, p.doc_tokens].append((p.start, bytes(p.ids)))
    for n, parts in by_sequence.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or at.bit_count() == 1 and at < window, (n, at)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert sum(p.length for p in pieces) == sum(len(x) // 2 for _, x in texts_ids)
    covered = collections.defaultdict(collections.Counter)
    for (doc_id, n), parts in by_doc.items():
        for start, ids in parts:
            whole = next(x for d, x in texts_ids if d == doc_id and len(x) == 2 * n and x[2 * start:2 * start + len(ids)] == ids)
            covered[doc_id, whole].update(range(start, start + len(ids) // 2))
    for (doc_id, whole), times in collections.Counter(texts_ids).items():
        assert [covered[doc_id, whole][i] for i in range(len(whole) // 2)] == [times] * (len(whole) // 2)


def library_ids(rows):
    encoder = records.Encoder(registered.tokenizer_path(), 2)
    return [(i, x.tobytes() + b"\1\0") for (i, _), x in zip(rows, encoder._whole([t or "" for _, t in rows]))]


@pytest.mark.parametrize("window,size", [(2048, 256), (64, 16), (100, 256)])
def test_packing_holds_every_id_once(docs, no_docs, window, size):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = packing.packed(docs, registered.tokenizer_path(), 1, window, size)
    check_pieces(found.collect(), library_ids(rows), window)
    for s in packing.sequences(found, window).collect():
        assert len(s.ids) == 2 * s.length and (s.length == window or s.length.bit_count() == 1)
    assert packing.packed(no_docs, registered.tokenizer_path()).count() == 0


def test_packing_query_equals_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = packing.packed(docs, registered.tokenizer_path(), 1)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_pieces(found.collect(), library_ids(rows), packing.WINDOW)
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in registered.op13_packing(spark, SF).collect()}
    for doc_id, ids in library_ids(rows):
        whole = np.frombuffer(ids, "<u2").astype("<u4")
        own = sorted((s, c) for (d, s), c in crc.items() if d == doc_id)
        for (a, c), (b, _) in zip(own, [*own[1:], (len(whole), 0)]):
            assert zlib.crc32(whole[a:b].tobytes()) == c


def test_windows_hold_the_targets(spark):
    rows = [(i, "the cat and the dog " * (5 + i % 37), s) for i, s in enumerate(["a"] * 600 + ["b"] * 300 + ["c"] * 95 + [None] * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    source = {r[0]: r[2] for r in rows}

    def shares(weights=None, first=40):
        found = packing.packed(docs, registered.tokenizer_path(), 1, 2048, 64, weights=weights).collect()
        tokens = collections.Counter()
        for p in found:
            tokens[p.sequence_id, source[p.doc_id]] += p.length
        return [[tokens[n, s] / 2048 for s in ("a", "b", "c")] for n in range(first)]

    everything = packing.packed(docs, registered.tokenizer_path(), 1).collect()
    total = collections.Counter()
    for p in everything:
        total[source[p.doc_id]] += p.length
    aim = [total[s] / total.total() for s in ("a", "b", "c")]
    for window in shares():
        assert all(abs(x - y) < 0.1 for x, y in zip(window, aim)), (window, aim)
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 2.0), (None, 0.01), ("none", 5.0)], "source string, weight double")
    for window in shares(weights, 10):
        assert all(abs(x - y) < 0.1 for x, y in zip(window, (0.25, 0.25, 0.5))), window
