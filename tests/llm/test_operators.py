"""Each operator against a brute-force version on odd rows, and on an empty table."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from oracle import compare, connect
from pyspark.sql import functions as F

from reelwright.llm import (
    decontaminate, fixity, language, mixing, nearcopies, records, registered, repeats, simhash, topk, toxicity, urls,
)

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registered.SQL))
def test_sql(spark, name):
    problem = compare(registered.QUERIES[name](spark, SF), connect(SF), registered.SQL[name])
    assert problem is None or name == "op1_warc_fixity" and problem == "empty on both sides", problem


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if sum(h >> j & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_classes(docs, no_docs):
    got = sorted((r.doc_id is None, r.doc_id, r.fp & (1 << 64) - 1, r.component_id)
                 for r in simhash.near_duplicate_classes(docs).collect())
    rows = [(r.doc_id, _fingerprint(r.text)) for r in docs.collect()]
    want = []
    for i, fp in rows:
        reach, seen = [fp], {fp}
        while reach:
            at = reach.pop()
            new = {f for _, f in rows if f not in seen and (f ^ at).bit_count() <= 3}
            seen |= new
            reach += new
        want.append((i is None, i, fp, min((j for j, f in rows if f in seen and j is not None), default=None)))
    assert got == sorted(want)
    assert simhash.near_duplicate_classes(no_docs).count() == 0
    kept = simhash.keep_one_per_class(docs)
    assert kept.columns == docs.columns
    names = {i: c for _, i, _, c in got}
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted({c for i, c in names.items() if i is not None} | {0})


def test_large_signature_groups_lose_no_link():
    rng = np.random.default_rng(1)
    base = np.uint64(0x0123456789ABCDEF)
    flips = rng.integers(0, 32, (6000, 4)).astype(np.uint64)
    fps = np.unique(base ^ np.bitwise_xor.reduce(np.uint64(1) << flips, axis=1))
    assert len(fps) > simhash.MATRIX_ROWS
    a, b = simhash.group_links(fps, 0)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    n = len(fps)
    every = np.nonzero(near)
    assert (near[a, b]).any() and (simhash._roots(n, a, b) == simhash._roots(n, *every)).all()


def _covered(rows, length):
    count = collections.Counter(b[p:p + length] for _, b in rows for p in range(len(b) - length + 1))
    for i, b in rows:
        marks = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if count[b[p:p + length]] > 1:
                marks[p:p + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, marks) if not m)
        yield i is None, i, len(b), sum(marks), len(re.findall(b"\1+", bytes(marks))), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("length", [100, 400])
def test_repeats(docs, no_docs, length):
    got = [(r.doc_id is None, r.doc_id, r.n_bytes, sum(s.hi - s.lo for s in r.spans), len(r.spans),
            hashlib.sha256(r.kept).hexdigest()) for r in repeats.remove_repeats(docs, length=length).collect()]
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    assert sorted(got) == sorted(_covered(rows, length))
    assert repeats.remove_repeats(no_docs, length=length).count() == 0


def test_repeats_of_mixed_passages(spark):
    rng = np.random.default_rng(3)
    words = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    shared = [words(n) for n in (90, 150, 400)]
    rows = [(i, words(int(rng.integers(0, 80))) + shared[i % 3][: 60 + 7 * i] + words(40) + shared[(i + 1) % 3]) for i in range(25)]
    rows += [(100, "ab" * 300), (101, "ab" * 130 + "c"), (102, "é" * 200)]
    got = [(r.doc_id is None, r.doc_id, r.n_bytes, sum(s.hi - s.lo for s in r.spans), len(r.spans),
            hashlib.sha256(r.kept).hexdigest())
           for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=100).collect()]
    assert sorted(got) == sorted(_covered([(i, t.encode()) for i, t in rows], 100))


def test_records_round_trip(docs, no_docs):
    from tokenizers import Tokenizer

    path = registered.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    got = records.encoded(docs, path).orderBy("start").collect()
    rows = sorted(((r.doc_id is not None, r.doc_id, r.text or "") for r in docs.collect()))
    assert [r.doc_id for r in got] == [i for _, i, _ in rows]
    at = 0
    for r, (_, _, text) in zip(got, rows):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert records.encoded(no_docs, path).count() == 0


def test_encoder_equals_library_on_odd_words():
    texts = ["it's don't I'LL", "Ünder ÉTÉ été naïve. x", "a,b.c ..., ,a a., a.. 12a 3.5", "<|endoftext|> a<|endoftext|>b.",
             "ΣΑΣ ς İstanbul ﬁ ª º", "日本語 テスト。 x\x1cy z", "ß ẞ Straße, ǅ İ.", "", " ", ".", "e\u0301a á.", "a_.b ._ x%%%. y!!,"]
    e = records.Encoder(registered.tokenizer_path(), 2)
    want = [np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert e.by_letters and e.encode(texts) == want


def test_damaged_record_is_noticed():
    data = bytearray(records.frame(b"abc") + records.frame(b"defg"))
    payload, after = records.unframe(bytes(data), 0)
    assert bytes(payload) == b"abc" and bytes(records.unframe(bytes(data), after)[0]) == b"defg"
    data[after + 13] ^= 1
    with pytest.raises(ValueError):
        records.unframe(bytes(data), after)


def test_language(spark, docs, no_docs):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = registered.op4_language(spark, SF).join(table.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    model = language.fit(table)
    odd = language.identify(docs, model).toDF(*[f"c{i}" for i in range(6)], "lang_pred", "cosine", "rejected").collect()
    assert [r.lang_pred for r in odd if r.c0 in (4, 5, 7)] == ["und"] * 3 and all(0 <= r.cosine <= 1 for r in odd)
    assert language.identify(no_docs, language.fit(no_docs)).count() == 0
    kept = language.without_rejected(docs, model)
    assert kept.columns == docs.columns
    # A few sentences over and over lie far from the table's prose; what stays is what lies within its winner's radius.
    inside = collections.Counter()
    for r in docs.collect():
        if language.has_letter(r.text):
            best, cosine = model.predict([r.text.encode()])
            size = sum(len(r.text.encode()) >= s for s in language.PIECE_SIZES)
            inside[r.doc_id] += int(cosine[0] >= model.least[best[0], size])
    assert collections.Counter(r.doc_id for r in kept.collect()) == +inside and 0 < inside.total() < len(odd) - 3


FOREIGN = {
    "polish": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i "
              "sumieniem i powinni postępować wobec innych w duchu braterstwa. Każdy człowiek posiada wszystkie prawa",
    "finnish": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja "
               "omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Jokainen on oikeutettu kaikkiin",
    "russian": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и "
               "должны поступать в отношении друг друга в духе братства. Каждый человек должен обладать",
    "keys": "xkcd qwrtp zzzpl mnbvc 234 lkjh gfdsa qpwo eiru tyal skdj fhgz mxnc bvqw ertz uiop asdf ghjk lyxc vbnm",
    "numbers": "a 123 456 b 789 c 11 22 d 99 88 k 1 2 3 " * 20,
}


def test_language_rejects_what_it_has_not_learned(spark):
    """Foreign and junk texts go, clean texts of every length stay; radii come from rows the centroids have not seen."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(table)
    assert model.least.shape == (len(model.langs), len(language.PIECE_SIZES) + 1)
    assert (np.diff(model.least, axis=1) >= 0).all() and (model.least[:, 1:] > 0).all()
    odd = spark.createDataFrame([(k, t * n) for k, t in FOREIGN.items() for n in (3, 30)], "k string, text string")
    assert {(r.k, r.rejected) for r in language.identify(odd, model).collect()} == {(k, True) for k in FOREIGN}
    good = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1")
    clean = table.join(good, "doc_id")
    assert clean.count() > 300 and language.identify(clean, model).where("rejected").count() == 0
    words = clean.where("lang is not null").selectExpr("doc_id", "lang", "substring_index(text, ' ', 6) AS text", "'x' AS rejected")
    short = language.identify(words, model).toDF("doc_id", "lang", "text", "theirs", "lang_pred", "score", "rejected")
    assert short.where("rejected").count() <= 0.03 * words.count()
    few = language.fit(table.where("lang = 'fr'").limit(10))
    assert len(few.langs) and not few.least.any()


def test_language_counts_are_not_clipped(spark):
    text = "la " * 80000
    rows = spark.createDataFrame([("fr", text), ("fr", "une autre phrase"), ("en", "some other words")], "lang string, text string")
    model = language.fit(rows, centroids=2)
    own = model.vectors(language.gram_counts([text.encode()])) @ model.centroids.T
    assert own.max() > 0.999


def test_toxicity(spark, docs, no_docs):
    words = "you idiot go away"
    rows = [(i, f"{words if i % 2 else 'a calm day'} {'abcdefgh'[i % 8] * 5} text {i}") for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    lexicon = toxicity.fit(table, labels)
    got = {r.doc_id: r for r in toxicity.toxicity(table, lexicon).collect()}
    assert all(got[i].predicted == i % 2 for i in range(400))
    assert toxicity.fold("ID1OT Іdіоt") == " idiot idiot "
    spared = toxicity.Lexicon((("clown", 5.0), (" idiot ", 5.0)), ("clown fish",), -2.0, 3.0, 1.0, True)
    assert spared.score("a clown fish swims")[0] < 0.5 < spared.score("an idiot swims")[0]
    assert toxicity.toxicity(docs, lexicon).count() == 10
    assert toxicity.toxicity(no_docs, toxicity.fit(no_docs, labels)).count() == 0


def test_mixing(docs, no_docs, spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    for source in (docs, table):
        got = mixing.mix(source, block=16).collect()
        sizes = collections.Counter()
        for r in got:
            sizes[r.source] += r["size"]
            assert 0 <= r.taken <= 2 * r["size"]
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        left, capped, share = 1.5 * sum(sizes.values()), {}, {}
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        while True:
            rest = [s for s in order if s not in capped]
            level = (left - sum(capped.values())) / max(1, sum(weight[s] for s in rest))
            over = [s for s in rest if level * weight[s] > 2 * sizes[s]]
            if not over:
                break
            capped |= {s: 2.0 * sizes[s] for s in over}
        share = {s: capped.get(s, level * weight[s]) for s in order}
        for s in order:
            own = [r for r in got if r.source == s]
            assert all(math.isclose(r.target, share[s], abs_tol=1e-6) and r.source_size == sizes[s] for r in own)
            assert abs(sum(r.taken for r in own) - share[s]) <= 3 * 16 + 0.01 * share[s]
        again = mixing.mix(source, block=16).collect()
        tell = lambda rows: collections.Counter((r.key, r.taken) for r in rows)
        assert sum((tell(got) - tell(again)).values()) == 0 or source is docs
    assert mixing.mix(no_docs).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_urls(spark):
    pages = spark.createDataFrame([
        (1, "http://Example.com/en/x?q"), (2, "https://www.example.com/en/"), (3, None), (4, "no scheme"), (5, "x://"),
        (6, "http://a.b.net/fr/x"), (7, "http://net/es/"), (8, "http://notexample.com/en/"), (8, "http://example.com"),
        (9, "http://example.com:80/en/"), (None, "http://x.example.com/en/#f"),
    ], "page_id long, url string")
    got = collections.Counter((r.page_id, r.rule, r.verdict) for r in urls.judge(pages, urls.rules_table(spark)).collect())
    assert got == collections.Counter([
        (1, "example.com/en/", "block"), (2, "www.example.com/en/", "allow"), (3, None, "allow"), (4, None, "allow"),
        (5, None, "allow"), (6, "net/fr/", "block"), (7, "net/es/", "block"), (8, "com/", "allow"), (8, None, "allow"),
        (9, None, "allow"), (None, "example.com/en/", "block")])
    assert urls.judge(pages.limit(0), urls.rules_table(spark)).count() == 0
    assert urls.judge(pages, urls.rules_table(spark).limit(0)).where("rule is not null").count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(0, rng.random(), 8)]) for i in range(700)]
    rows += [(5000, None), (5050, [1.0, None]), (5100, [float("nan")] * 8), (5150, [1.0, 2.0]), (5200, []), (0, rows[0][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = {i: np.pad(np.floor(256 * np.array(x, np.float32).astype(float)), (0, 8 - len(x))).astype(int)
         for i, x in rows if x is not None and None not in x and np.isfinite(x).all()}
    got = topk.top_k(table, "vec_id % 50 = 0", block_rows=100, query_rows=4).collect()
    want = [(q, r + 1, c, int(v[q] @ v[c])) for q in v if q % 50 == 0
            for r, c in enumerate(sorted((c for c in v if c != q), key=lambda c: (-int(v[q] @ v[c]), c))[:5])]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(table.limit(0), "vec_id % 50 = 0").count() == 0


def test_decontamination(spark, docs, no_docs):
    items = spark.createDataFrame([(1, "The quick, brown fox JUMPS over the lazy dog"), (2, None), (3, ""), (4, "le chat"),
                                   (5, "nothing like it is to be found anywhere here")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_shared) for r in decontaminate.contained_items(docs, items).collect())
    assert got == [(1, 1, 5), (2, 1, 5), (3, 1, 5)]
    assert sorted(r.doc_id or 0 for r in decontaminate.without_leaks(docs, items).collect()) == [0, 4, 5, 7, 8, 9]
    assert decontaminate.contained_items(no_docs, items).count() == 0
    assert decontaminate.contained_items(docs, items.limit(0)).count() == 0
    plan = decontaminate.contained_items(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_fixity(spark):
    rows = [(i * 10, 10, f"d{i}") for i in range(40_000)]
    one = spark.createDataFrame(rows, "offset long, length long, digest string")
    other = one.where("offset <> 70").union(spark.createDataFrame([(399_990, 9, "x"), (70_005, 1, "e")], one.schema)).where(
        "not (offset = 399990 and digest <> 'x')")
    got = {r.offset: r.kind for r in fixity.audit(one, other).collect()}
    assert got == {70: "missing", 399_990: "changed", 70_005: "extra"}
    assert fixity.audit(one, one).count() == 0 and fixity.audit(one.limit(0), one.limit(0)).count() == 0
    assert fixity.audit(one.limit(5), one.limit(0)).count() == 5


def test_fixity_counts_repeated_records(spark):
    schema = "offset long, length long, digest string"
    base = [(i * 10, 10, f"d{i}") for i in range(20_000)]
    one = spark.createDataFrame([*base, (50, 10, "d5"), (50, 10, "d5"), (90, 10, "d9"), (120, 9, "a")], schema)
    other = spark.createDataFrame([*base, (90, 10, "d9"), (120, 9, "b"), (120, 9, "c"), (70_000, 10, "d7000")], schema)
    got = collections.Counter((r.offset, r.kind, r.digest, r.found_digest) for r in fixity.audit(one, other).collect())
    assert got == {(50, "missing", "d5", None): 2, (120, "changed", "a", "b"): 1, (120, "extra", None, "c"): 1,
                   (70_000, "extra", None, "d7000"): 1}


def test_fixity_of_odd_pages(spark):
    """Null, empty, repeated and very long pages: each damaged record is reported once, with its page."""
    rows = [(i, f"http://x/{i}", "body " * (i % 50)) for i in range(900)] * 2
    rows += [(None, None, None), (None, "", ""), (7, None, "x" * 2_000_000), (1, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archive, copy, places = fixity.trial_copies(pages)
    ours, theirs = ({r.offset: (r.length, r.digest) for r in side.collect()} for side in (archive, copy))
    page = {r.offset: r.page_id for r in places.collect()}
    assert len(page) == len(rows)
    expected = {(page[o], o, *ours.get(o, (None, None)), *theirs.get(o, (None, None))) for o in ours.keys() | theirs.keys() if ours.get(o) != theirs.get(o)}
    found = fixity.audited_pages(pages.withColumn("offset", F.lit("clash")).withColumn("kind", F.lit(1)))
    got = [(r.page_id, r.offset, r.length, r.digest, r.found_length, r.found_digest) for r in found.collect()]
    assert len(got) == len(set(got)) > 0 and set(got) == expected
    assert fixity.audited_pages(pages.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.deduplicated(spark, corpus_pipeline.recognised(spark, docs, SF), SF)
    assert kept.columns == docs.columns and kept.count() < docs.count()
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_mixture_emits_what_the_schedule_takes(spark, docs):
    rng = np.random.default_rng(8)
    # Long documents in every source, a source with most of the words, repeated rows, and white space of all kinds.
    rows = [(i, "\n " + "".join(f"s{i % 7}d{i}w{j}" + " \t\n"[j % 3] for j in range(int(rng.choice([3, 300, 4000])))),
             f"src{min(i % 7, 4)}", i % 3) for i in range(60)]
    rows += [(100, " ".join(f"hot{j}" for j in range(60_000)), "src1", 0), (101, "twice " * 900, "src2", 0),
             (101, "twice " * 900, "src2", 1), (None, None, "src0", 2), (102, "", "src3", 2)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    got = mixing.mixed_documents(table).collect()
    emitted, targets, words = collections.Counter(), {}, collections.Counter()
    for r in mixing.mix(table).collect():
        targets[r.source], words[r.source] = r.target, r.source_size
    by_id = {(r[0], r[3]): r for r in rows}
    for r in got:
        emitted[r.source] += len((r.text or "").split())
        assert (r.text or "") in (by_id[r.doc_id, r.extra][1] or "") and r.source == by_id[r.doc_id, r.extra][2]
    assert all(abs(emitted[s] - targets[s]) <= 3 * 256 + 0.01 * targets[s] for s in targets), (emitted, targets)
    passes = collections.Counter(w for r in got if r.doc_id != 101 for w in (r.text or "").split())
    assert max(passes.values()) <= 2 and any(0 < targets[s] < 2 * words[s] for s in targets)
    assert sum(r.doc_id is None and r.text is None for r in got) == 1 and sum(r.doc_id == 102 for r in got) == 1
    odd = mixing.mixed_documents(docs, block=16)
    taken = sum(r.taken for r in mixing.mix(docs, block=16).collect())
    assert abs(sum(len((r.text or "").split()) for r in odd.collect()) - taken) <= 2 * 16 * 4


def _similarity(a, b):
    sets = []
    for t in (a, b):
        words = t.lower().split()
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def test_near_copies_are_found_by_similarity(spark):
    rng = np.random.default_rng(11)
    rows, pairs = [], []
    for i in range(120):
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(60, 400)))]
        other = list(words)
        for at in rng.choice(len(words), max(1, int(len(words) * rng.uniform(0.005, 0.06))), replace=False):
            other[at] = f"new{at}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        pairs.append(_similarity(rows[-2][1], rows[-1][1]))
    base = [f"c{x}" for x in rng.integers(0, 5000, 300)]  # a hot group: copies of one text, each with its own words
    hot = [(1000 + i, " ".join(w if j != i else "own" for j, w in enumerate(base))) for i in range(200)]
    assert sum(0.8 <= p < 0.95 for p in pairs) > 20 and sum(p < 0.8 for p in pairs) > 20
    kept = {r.doc_id for r in nearcopies.keep_one_per_class(spark.createDataFrame(rows + hot, "doc_id long, text string")).collect()}
    assert kept == {2 * i for i in range(120)} | {2 * i + 1 for i, p in enumerate(pairs) if p < 0.8} | {1000}


def test_one_row_of_each_class_stays_whatever_its_id(spark):
    one, other, third = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(1, one, "x"), (1, other, "x"), (2, one, "x"), (None, one, "y"), (3, other, "x"), (3, other, "x")]
    rows += [(None, third, "z")] * 30 + [(None, None, "z"), (4, "", "z")]
    got = nearcopies.keep_one_per_class(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(
        [(1, one), (1, other), (None, third), (4, "")])


def test_pipeline_keeps_one_document_of_each_simhash_class(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    named = {r.doc_id for r in simhash.near_duplicate_classes(docs).where("doc_id = component_id").collect()}
    assert {r.doc_id for r in corpus_pipeline.deduplicated(spark, docs, SF).collect()} == named
