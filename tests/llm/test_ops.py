"""Each operator against a brute-force version, an exact round trip or held-out labels, and on odd rows."""

import hashlib
import random
import unicodedata
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import Row
from pyspark.sql import functions as F

from corvane.llm import byte_bpe, chat, common, html_text, neighbours, ngram_join, packing, quality_classifier, quality_rules, sharding, token_files, word_bpe
from corvane.llm.catalogue import BYTE_BPE, QUERIES, SQL, WORD_BPE
from corvane.llm.byte_bpe import ByteBPE

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string"
ODD = [
    (1, None, "en", "a", 0, "x"), (2, "", "en", "a", 0, "x"), (3, "one two", None, "a", 7, None), (4, "one two", "en", None, 7, "x"), (4, "one two", "en", None, 7, "x"),
    (None, "lost words here and there", "en", "a", 1, "x"), (6, "w " * 6_000, "de", "b", 12_000, "x"), (7, " \n\t ", "en", "a", 4, "x"), (8, "ÉÀ <|endoftext|> </s>", "fr", "c", 20, "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{D}/documents.parquet")


@pytest.fixture(scope="module")
def byte_ids(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE_BPE)
    texts = docs.text.fillna("").tolist() + [r[1] or "" for r in ODD]
    return {x: e.ids for x, e in zip(texts, t.encode_batch(texts, add_special_tokens=False))}


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def classes(rows):
    """Components by comparing every pair."""
    sets = {}
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc_id] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_join_matches_all_pairs(spark, docs):
    rnd = random.Random(3)
    rows = list(zip(docs.doc_id.tolist(), docs.text.tolist()))
    base = [f"w{i}" for i in range(60)]
    for k in range(40):  # copies with more and more edits, and a shared passage in short texts
        w = list(base)
        for _ in range(k // 4):
            w[rnd.randrange(60)] = f"e{rnd.randrange(999)}"
        rows.append((100_000 + k, " ".join(w)))
        rows.append((200_000 + k, " ".join(base[:12] + [f"u{k}x{i}" for i in range(rnd.randrange(6))])))
    want = classes(rows)
    got = ngram_join.similarity_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(rows)


def test_join_yields_all_links(spark, docs, monkeypatch):
    """Every link between different sets, also within components whose pairs the leaders skip; small blocks, so that units have two."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rnd = random.Random(9)
    rows = [(i, t) for i, t in zip(docs.doc_id.tolist(), docs.text.tolist()) if t][:60]
    base = [f"w{i}" for i in range(200)]
    for k in range(70):
        w = list(base)
        for _ in range(k // 14):
            w[rnd.randrange(200)] = f"e{rnd.randrange(999)}"
        rows.append((100_000 + k, " ".join(w)))
    sets = {}
    for i, t in rows:
        w = t.encode().lower().split()
        sets.setdefault(frozenset(tuple(w[j : j + 4]) for j in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)]), []).append(i)
    keys = list(sets)
    want = {tuple(sorted((min(sets[a]), min(sets[b])))) for k, a in enumerate(keys) for b in keys[:k] if a and b and 100 * len(a & b) >= 85 * len(a | b)}
    assert len(want) > 200
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r.doc_a, r.doc_b) for r in ngram_join.links(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    counts = {r.doc_id: r.n_links for r in ngram_join.similarity_classes(frame, links=True).collect()}
    assert counts == {i: sum(min(ids) in p for p in want) for ids in sets.values() for i in ids}


def test_join_candidates_of_a_group_stay_few(spark, monkeypatch):
    """Copies with scattered edits, three quarters of whose pairs link: what leaders leave apart is not compared all with all."""
    rnd = random.Random(5)
    rows = []
    for k in range(100):
        w = [f"w{i}" for i in range(280)]
        for j in range(3):
            w[100 + rnd.randrange(60)] = f"e{k}x{j}"
        rows.append((k, " ".join(w)))
    made, verified = [], ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda near, *rest: made.append(near.count()) or verified(near, *rest))
    got = ngram_join.similarity_classes(spark.createDataFrame(rows, "doc_id bigint, text string"), links=True).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == classes(rows)
    assert sum(r.n_links for r in got) == 2 * 3700 and sum(made) < 3 * len(rows)


def test_join_keeps_the_first_of_equal_lists(spark):
    """Tokens 1 and 2 list the same sets, 2 earlier; 3 has one set more, 4 as many others."""
    rows = [(1, 7, 5), (1, 8, 3), (2, 7, 4), (2, 8, 2), (3, 7, 6), (3, 8, 4), (3, 9, 0), (4, 7, 7), (4, 9, 1)]
    lists = spark.createDataFrame([(t, -1, i, 50, pos) for t, i, pos in rows], "token bigint, salt bigint, set_id bigint, n int, pos int")
    assert {(r.token, r.set_id, r.pos) for r in ngram_join._first_of_equal(lists).collect()} == {r for r in rows if r[0] != 1}


def test_join_workers_give_memory_back(monkeypatch):
    """After a task, when its batches are gone, the worker's free memory goes back to the system."""
    gone, seen = [], []

    class Texts:
        """Runs what a Python worker would, in this process."""

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words of a text", None])], ["doc_id", "text"])
            return [seen.append(len(gone)) or b.num_rows for b in run(iter([batch]))]

    monkeypatch.setattr(common, "give_back", lambda: gone.append(1))
    assert ngram_join._scan(Texts(), 4)[0] == 2
    assert len(gone) == 1 and not any(seen)


def test_texts_go_to_workers_in_small_batches(spark):
    """However many rows a task has; the session's own setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, rows = spark.conf.get(key), spark.range(0, 3000, 1, 1)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    for module in (ngram_join, packing, token_files):
        assert sorted(r.n for r in module.stage(rows.mapInArrow(run, "n bigint"), "batches").collect()) == [952, 1024, 1024]
    assert spark.conf.get(key) == before


def test_pipeline_takes_five_words_at_80_percent(spark):
    """Scattered edits that leave 0.80 of 5-word shingles but under 0.85 of 4-word ones; op1 keeps its own values."""
    import corpus_pipeline

    base = [f"w{i}" for i in range(340)]
    edited = [f"e{i}" if i % 47 == 20 else w for i, w in enumerate(base)]
    appended = base[:336] + [f"x{i}" for i in range(70)]
    rows = [(1, " ".join(base)), (2, " ".join(edited)), (3, " ".join(appended)), (4, " ".join(base[:250]))]

    def jaccard(a, b, k):
        x, y = ({tuple(t.split()[i : i + k]) for i in range(len(t.split()) - k + 1)} for t in (a, b))
        return len(x & y) / len(x | y)

    assert [jaccard(rows[0][1], rows[i][1], 5) >= 0.8 for i in (1, 2, 3)] == [True, True, False]
    assert [jaccard(rows[0][1], rows[i][1], 4) >= 0.85 for i in (1, 2, 3)] == [False, False, False]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in corpus_pipeline.deduplicate(spark, frame, D).collect()} == {1, 4}
    assert {r.doc_id for r in ngram_join.keep_one_of_each(frame).collect()} == {1, 2, 3, 4}


def test_join_on_odd_rows(spark, odd, empty):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similarity_classes(odd).collect()}
    assert got == {(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (None, 2, None), (6, 1, 6), (7, 0, 7), (8, 1, 8)}
    assert ngram_join.similarity_classes(empty).count() == 0
    kept = ngram_join.keep_one_of_each(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "6", "7", "8", "None"]


def check_pieces(rows, texts, ids):
    for r in rows:
        assert crc((ids[texts[r.doc_id]] + [0])[r.start : r.start + r.length]) == r.ids_crc32
    f = pd.DataFrame([r.asDict() for r in rows]).sort_values(["sequence_id", "offset"])
    end = f.offset + f.length
    assert end.max() <= 2048 and (end.groupby(f.sequence_id).shift().fillna(0) == f.offset).all()
    for _, g in f.groupby("doc_id"):
        assert (g[g.piece > 0].length == 2048).all()
    return f


def test_packing(spark, docs, byte_ids, odd, empty):
    rows = QUERIES["op2_packing"](spark, D).collect()
    f = check_pieces(rows, dict(zip(docs.doc_id, docs.text.fillna(""))), byte_ids)
    assert f.length.sum() == sum(len(byte_ids[t]) + 1 for t in docs.text.fillna(""))
    assert f.sequence_id.nunique() <= 1.01 * -(-f.length.sum() // 2048) + 1
    rows = packing.pack_documents(odd.where("doc_id is not null and n_chars <> 7"), BYTE_BPE).collect()
    check_pieces(rows, {r[0]: r[1] or "" for r in ODD}, byte_ids)
    assert packing.pack_documents(odd, BYTE_BPE).where("doc_id is null").count() == 1
    assert packing.pack_documents(empty, BYTE_BPE).count() == 0
    # one row many times, and few long rows, spread over groups alike
    same = spark.createDataFrame([(5, "one two")], "doc_id bigint, text string").crossJoin(spark.range(300).select()).select("doc_id", "text")
    sizes = packing.pack_documents(same, BYTE_BPE, group=50).groupBy((F.col("sequence_id") / (1 << 40)).cast("int").alias("g")).count().collect()
    assert len(sizes) == 6 and all(25 <= r["count"] <= 80 for r in sizes)
    long = spark.createDataFrame([(1, "a b c " * 3000)], "doc_id bigint, text string")
    assert packing.pack_documents(long, BYTE_BPE, length=16, group=100).select((F.col("sequence_id") / (1 << 40)).cast("int")).distinct().count() > 3


def test_a_word_is_encoded_once(monkeypatch):
    """Words are taken from parts that have other ends, and a part that is known is looked up once."""
    bpe, asked, looks = ByteBPE(BYTE_BPE), [], []
    tokenize = bpe._tokenize
    monkeypatch.setattr(bpe, "_tokenize", lambda w: asked.append(w) or tokenize(w))
    find = bpe._young._find
    monkeypatch.setattr(bpe._young, "_find", lambda p: looks.append(p) or find(p))
    text = "A wörd wörd, wörd. wörd! word, word. wörd\nA wörd."
    want = bpe._tokenizer.encode(text, add_special_tokens=False).ids
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode([[text, None], [text]])] == [want, [], want]
    assert sorted(asked) == sorted(["A", "\u0120wÃ¶rd", *["\u0120word"] * 2, ",", ".", "!", "\u010a"])
    assert len(looks) == len(set(looks)) == 11


def test_pipeline_packing_leaves_no_parts_in_workers(monkeypatch):
    import corpus_pipeline

    class Frame:
        """Runs what a Python worker would, in this process."""

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            self.pieces = list(run(iter([pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words of a text", None])], ["doc_id", "text"])])))
            return self

        def count(self):
            return 2

    monkeypatch.setattr(byte_bpe, "_LOADED", {})
    monkeypatch.setattr(packing, "stage", lambda df, _: df)
    monkeypatch.setattr(packing, "pack", lambda pieces, *_: pieces)
    held = lambda: sum(len(b._young) + len(b._old) for b in byte_bpe._LOADED.values())
    whole = packing.pack_documents(Frame(), BYTE_BPE).pieces
    assert held() == 5
    assert corpus_pipeline.pack(None, Frame(), "").pieces == whole and sum(b.num_rows for b in whole) == 2
    assert held() == 0


def test_sum_of_squares_places_by_the_rule():
    rnd = np.random.default_rng(2)
    sizes = rnd.integers(1, 31, 300)
    where, _ = packing.sum_of_squares(sizes, 30)
    left, sums = {}, []
    for s, b in zip(sizes.tolist(), where.tolist()):
        counts = np.bincount([g for g in left.values() if g], minlength=31)
        options = {}
        for g in {g for g in left.values() if g >= s} or {30}:
            c = counts.copy()
            if counts[g]:
                c[g] -= 1
            if g - s:
                c[g - s] += 1
            options[g] = int((c[1:] ** 2).sum())
        before = left.get(b, 30)
        left[b] = before - s
        sums.append(int((np.bincount([g for g in left.values() if g], minlength=31)[1:] ** 2).sum()) == min(options.values()))
    assert all(sums)


def plain_statistics(text):
    w = (text or "").encode().split()
    n, seen, cover = len(w), {}, set()
    for i in range(n - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            cover |= {j for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return n, sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_quality_rules(spark, docs, odd, empty):
    got = {r.doc_id: r for r in QUERIES["op3_quality_rules"](spark, D).collect()}
    for doc_id, text in zip(docs.doc_id, docs.text):
        r = got[doc_id]
        assert plain_statistics(text) == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    rows = quality_rules.quality_rules(odd).collect()
    assert len(rows) == len(ODD) and all(r.base_failed and not r.kept for r in rows)
    assert {r.doc_id: (r.n_words, r.n_repeat_words) for r in rows if r.doc_id in (1, 6)} == {1: (0, 0), 6: (6_000, 6_000)}
    assert quality_rules.quality_rules(empty).count() == 0
    assert quality_rules.keep_quality(odd).columns == odd.columns


def test_rules_leave_no_texts_behind(spark, docs, odd, tmp_path, monkeypatch):
    """The pipeline's next stage starts with what this one staged; rows are told apart without their ids."""
    whole = spark.read.parquet(f"{D}/documents.parquet")
    verdict = {r.doc_id: r.kept for r in quality_rules.quality_rules(whole).collect()}
    want = sorted(t for i, t in zip(docs.doc_id, docs.text) if verdict[i])
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    twice = whole.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, 1).cast("bigint"))
    twice = twice.unionByName(twice)
    rows = quality_rules.keep_quality(twice).collect()
    assert 0 < len(want) < len(docs) and sorted(r.text for r in rows) == sorted(want * 2) and quality_rules.keep_quality(twice).columns == twice.columns
    left = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    assert left < sum(len(t.encode()) for t in docs.text) / 10
    assert quality_rules.keep_quality(odd).count() == 0


def test_robust_estimates_find_planted_outliers(spark):
    rnd = np.random.default_rng(5)
    rows = [("en", "s", *map(float, rnd.normal(size=4))) for _ in range(600)] + [("en", "s", 9.0, -9.0, 9.0, 9.0) for _ in range(100)]
    frame = spark.createDataFrame(rows, "lang string, source string, x0 double, x1 double, x2 double, x3 double").withColumn("base_failed", F.lit(False))
    params = quality_rules.fit(frame)
    rows = quality_rules.judge(frame, params).select("x0", "kept").collect()
    assert not any(r.kept for r in rows if r.x0 == 9) and sum(r.kept for r in rows) == 600
    m = params.where("_g = '=s'").first()._p
    assert abs(m.m0) < 0.15 and 0.8 < m.l00 < 1.25


def test_small_languages_get_a_verdict(spark, docs):
    """A language under LEAST rows is held against all rows, and a few rows in all against the prior."""
    got = {r.doc_id: r for r in QUERIES["op3_quality_rules"](spark, D).collect()}
    assert all(r.mahalanobis2 is not None for r in got.values()) and not any(got[i].kept for i in (83, 148, 179))
    labels = pd.read_parquet(f"{D}/labels.parquet")
    small = set(docs[docs.lang.isin(["de", "fr", "es"])].doc_id) & set(labels[labels.quality == 1].doc_id)
    assert len(small) > 15 and all(got[i].kept or got[i].base_failed for i in small)
    soup = docs.set_index("doc_id").text[179]
    clean = [t for i, t in zip(docs.doc_id, docs.text) if i in small and got[i].kept][:5]
    few = spark.createDataFrame([(i, t, None, "a") for i, t in enumerate([soup, *clean])], "doc_id bigint, text string, lang string, source string")
    assert {r.doc_id: r.kept for r in quality_rules.quality_rules(few).collect()} == {0: False, 1: True, 2: True, 3: True, 4: True, 5: True}


def test_quality_classifier(spark, odd, empty):
    d = "/root/testdata/sf0.01"
    got = QUERIES["op4_quality_classifier"](spark, d).toPandas().merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id")
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out))
    held = got[got.held_out]
    assert ((held.score >= 0.3) == held.predicted).all() and ((held.predicted == held.quality).mean() > 0.9)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in quality_classifier.classify_documents(odd, labels).collect()} == {0.5}
    assert quality_classifier.classify_documents(empty, labels).count() == 0
    assert quality_classifier.keep_good(odd, labels).columns == odd.columns
    # columns that clash with the operator's own, and one doc_id on many rows
    good, bad = (" ".join(f"{w}{i % 7}" for i in range(200)) for w in ("fine", "junk#"))
    rows = [(i, f"{good if i % 2 else bad} {i}", 9.0, 1) for i in range(1, 60)] + [(1, f"{good} again", 9.0, 1)] * 30 + [(100 + i, "", 9.0, 1) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double, _score int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 60)] + [(100 + i, 0, 0) for i in range(9)], "doc_id bigint, quality int, toxic int")
    kept = quality_classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(1, 60, 2))
    scores = {r.doc_id: r.score for r in quality_classifier.classify_documents(docs, labels).collect()}
    assert 0 < scores[100] < 0.3 and scores[100] == scores[108]


def test_dictionary_samples_are_spread_over_all_rows():
    texts = [chr(97 + i) * (80 * quality_classifier.BLOCK if i == 0 else 2 * quality_classifier.BLOCK) for i in range(8)]
    blocks = [quality_classifier._blocks(t) for t in texts]
    got = quality_classifier._samples(blocks, 10 * quality_classifier.BLOCK)
    assert len(got) == 10 and {b[:1] for b in got} == {t[:1].encode() for t in texts}
    assert quality_classifier._samples(blocks, 1 << 30) == [b for bs in blocks for b in bs]
    long = "".join(chr(97 + i) * quality_classifier.BLOCK for i in range(24))
    assert [b[:1] for b in quality_classifier._spread(long)] == [b"a", b"d", b"g", b"j", b"m", b"p", b"s", b"v"]


def test_sharding(spark, docs, odd, empty):
    for rows, n in ((QUERIES["op5_sharding"](spark, D).collect(), len(docs)), (sharding.shard_documents(odd).collect(), len(ODD))):
        f = pd.DataFrame([r.asDict() for r in rows])
        sizes = f.groupby("shard").size().reindex(range(24), fill_value=0)
        assert len(f) == n and sizes.max() - sizes.min() <= 1
        assert all(sorted(s) == list(range(len(s))) for _, s in f.groupby("shard").slot)
    got = {r.doc_id: r for r in QUERIES["op5_sharding"](spark, D).collect()}
    assert all(got[i].size == len((t or "").encode()) + 8 and got[i].text_crc32 == zlib.crc32((t or "").encode()) for i, t in zip(docs.doc_id, docs.text))
    table = pd.crosstab([r.shard for r in got.values()], [r.source for r in got.values()])
    assert ((table - table.mean()).abs() < 2).all().all()
    assert sharding.shard_documents(empty).count() == 0


def test_token_files(spark, docs, byte_ids, odd, empty, tmp_path):
    rows = sorted(token_files.token_files(spark, spark.read.parquet(f"{D}/documents.parquet"), BYTE_BPE, f"file://{tmp_path}/f").collect(), key=lambda r: r.doc_id)
    start = 0
    for r, text in zip(rows, docs.sort_values("doc_id").text.fillna(""), strict=True):
        want = byte_ids[text] + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), crc(want))
        start += len(want)
    # another session has the folder alone: dictionary and manifest lie in it, and one document is read by ranges
    for doc_id, text in list(zip(docs.doc_id.tolist(), docs.text.fillna("")))[::40]:
        assert token_files.read_document(spark, f"{tmp_path}/f", doc_id) == [byte_ids[text] + [2]]
    assert token_files.read_document(spark, f"{tmp_path}/f", -5) == [] and len(list(tmp_path.glob("f/*.dict"))) == 1
    rows = token_files.token_files(spark, odd, BYTE_BPE, f"{tmp_path}/odd").collect()
    assert len(rows) == len(ODD) and sorted(r.start for r in rows)[0] == 0
    assert token_files.read_document(spark, f"{tmp_path}/odd", 4) == [byte_ids["one two"] + [2]] * 2
    assert token_files.token_files(spark, empty, BYTE_BPE, f"{tmp_path}/none").count() == 0
    assert token_files.read_document(spark, f"{tmp_path}/none", 1) == []


def test_one_document_costs_one_index_and_one_frame():
    frames = [(i, 100, zstandard.compress(bytes(400))) for i in range(50)]
    data, fetched = token_files.file_bytes(frames, b""), []

    def read(at, size):
        fetched.append(size)
        return data[at : at + size]

    file = token_files.TokenFile(read, b"")
    assert file.ids(file.places(7)[0]) == bytes(400) and list(file.places(99)) == []
    assert fetched == [24, 50 * token_files._INDEX.itemsize, len(frames[7][2])]


def test_dictionary_sample_is_bounded(spark):
    """One doc_id on most rows and long texts: the driver gets one piece a document."""
    rows = [(5, f"word{i} " * 2000) for i in range(60)] + [(i, "some words " * 300) for i in range(100, 140)]
    got = token_files.sample_ids(spark.createDataFrame(rows, "doc_id bigint, text string"), BYTE_BPE, sample=10, most=1000)
    assert len(got) == 10 and all(len(x) <= 1000 for x in got)


def test_token_file_refuses_another_dictionary():
    data = token_files.file_bytes([(1, 1, b"x")], b"")
    with pytest.raises(ValueError, match="another"):
        token_files.TokenFile(lambda at, size: data[at : at + size], b"other")


TEXTS = ["", "  a  b\n\n c <|endoftext|> x<|startoftext|>y  ", "ΑΣ ΑΣΣ İstanbul ǅ ﬁ é ́a a\x1cb!\x1d! \x85 　z", "don't WE'LL 123 45½ ²", "\n\n lead", " trail \n", "a  <|endoftext|>  b", "🙂 👩‍👩‍👧", "​ ﻿", "x" * 5000]


def test_tokenizers_match_the_library():
    from tokenizers import Tokenizer

    for path, own in ((BYTE_BPE, None), (WORD_BPE, word_bpe.WordBPE(WORD_BPE))):
        t = Tokenizer.from_file(path)
        for text, e in zip(TEXTS, t.encode_batch(TEXTS, add_special_tokens=False)):
            if own:
                assert own.digests(text) == (len(e.ids), " ".join(map(str, e.ids)), t.decode(e.ids, skip_special_tokens=False))
            else:
                assert np.frombuffer(next(ByteBPE(path).encode([[text]])), "<u4").tolist() == e.ids


def test_long_words_merge_alike(monkeypatch):
    """The heap gives what the scanned array gives, and a word of a million letters ends soon."""
    own, rnd = word_bpe.WordBPE(WORD_BPE), random.Random(6)
    found = []
    for short in (1 << 60, 0):
        monkeypatch.setattr(word_bpe, "SHORT", short)
        r = random.Random(6)
        words = ["".join(r.choice(letters) for _ in range(r.randrange(1, 400))) for letters in ("ab", "the", "aeioulrstn", "aaab", "éaz") for _ in range(40)]
        found.append([own.merge(w) for w in words])
    assert found[0] == found[1]
    import time

    began = time.time()
    own.merge("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000)))
    assert time.time() - began < 60


def test_word_bpe_query(spark, docs, odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in QUERIES["op7_bpe"](spark, D).collect()}
    for doc_id, e in zip(docs.doc_id, t.encode_batch(docs.text.fillna("").tolist(), add_special_tokens=False)):
        assert got[doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256(t.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()
    assert word_bpe.encode_documents(odd, WORD_BPE).count() == len(ODD) and word_bpe.encode_documents(empty, WORD_BPE).count() == 0


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "a\\</s>", "\\\\<|turn|>x\n<|text|>\\", "", None, "<|end|></s>", "$1 \\$1", "<\\/s> <\\\\|turn|> <<s> [\\INST] <INST]"]
    rows = [(c, i, "assistant" if i % 2 else "user", t) for c in (1, 2) for i, t in enumerate(texts)] + [(3, 1, None, "x"), (3, 1, None, "x"), (None, 1, "user", "y")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("tree", F.lit(1))
    got = {r.conv_id: r for r in chat.format_conversations(spark, frame).collect()}
    assert set(got) == {1, 2, 3, -7} and got[3].n_turns == 2
    said = "".join(f"{'assistant' if i % 2 else 'user'}\n{t or ''}\n" for i, t in enumerate(texts))
    under = "".join(t or "" for t in texts[1::2])
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(under), hashlib.sha256(under.encode()).hexdigest())
    assert chat.format_conversations(spark, frame.limit(0)).count() == 1
    escaped = [r.e for r in spark.createDataFrame([(t or "",) for t in texts], "t string").select(chat.escape(F.col("t")).alias("e")).collect()]
    assert not any(c in e for e in escaped for c in chat.CONTROL)


def test_leaf_off_a_long_cycle(spark, monkeypatch):
    """A leaf that leads into a cycle gives no path, and costs no more than the deepest tree."""
    rows = [("c", i, (i + 1) % 300, 0.0) for i in range(300)] + [("c", 999, 5, 0.0)] + [("t", i, i - 1 if i else None, float(i)) for i in range(20)] + [("t", 100, 3, 99.0)]
    nodes = spark.createDataFrame(rows, "tree string, node bigint, parent bigint, score double").withColumns({"role": F.lit("user"), "text": F.lit("x")})
    sizes, stage = [], chat.stage
    monkeypatch.setattr(chat, "stage", lambda df, name: (out := stage(df, name), sizes.append(out.where("tree = 'c'").count() if name == "chat-paths" else 0))[0])
    paths = chat.best_paths(nodes, top=5).collect()
    assert {(r.leaf, r.rank) for r in paths} == {(100, 1), (19, 2)} and len(paths) == 25 and max(sizes) <= 64


def test_reply_trees(spark):
    rows = [("t", "r", None, 1.0), ("t", "a", "r", 0.0), ("t", "b", "r", 5.0), ("t", "c", "b", 0.0), ("t", "d", "b", 3.0), ("t", "d", "b", 3.0), ("u", "x", "y", 1.0), ("u", "y", "x", 1.0), ("v", "o", "gone", None)]
    nodes = spark.createDataFrame(rows, "tree string, node string, parent string, score double").withColumns({"role": F.lit("user"), "text": F.col("node")})
    paths = chat.best_paths(nodes, top=2).orderBy("tree", "rank", F.col("dist").desc()).collect()
    assert [(r.tree, r.rank, r.node) for r in paths] == [("t", 1, "r"), ("t", 1, "b"), ("t", 1, "d"), ("t", 2, "r"), ("t", 2, "b"), ("t", 2, "c"), ("v", 1, "o")]


def test_neighbours(spark):
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(12, 16)) * 3
    x = centres[rnd.integers(0, 12, 6400)] + rnd.normal(size=(6400, 16))
    x[100:400] = x[0]
    frame = pd.DataFrame({"vec_id": np.arange(6400), "embedding": list(x.astype(np.float32))})
    odd = [(7_000_000, None), (7_000_100, [0.0] * 16), (7_000_200, [float("nan")] * 16), (7_000_300, [None] * 16), (7_000_400, [1.0] * 3)]
    table = spark.createDataFrame(frame.assign(embedding=frame.embedding.map(lambda v: v.tolist()))).select("vec_id", F.col("embedding").cast("array<float>"))
    table = table.unionByName(spark.createDataFrame(odd, "vec_id bigint, embedding array<float>"))
    got, want = neighbours.search_embeddings(table).toPandas(), neighbours.brute_force(frame)
    both = want.merge(got, on=["query_id", "vec_id"])
    assert len(both) / len(want) >= 0.9 and np.allclose(both.score_x, both.score_y, rtol=0, atol=1e-9)
    assert got[got.query_id == 100].sort_values("rank").vec_id.tolist()[:3] == [0, 101, 102]
    told = {}
    neighbours.search(table, table.where("vec_id % 100 = 0"), told=told)
    assert told["rows"] == 6400 and told["parts"] == 8 and told["probes"] < 8  # 12 clusters of 16 dimensions
    assert neighbours.search_embeddings(table.limit(0)).count() == 0
    few = neighbours.search_embeddings(table.where("vec_id in (0, 5, 7)")).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(0, 1), (0, 2)]


PAGE = """<html><head><title>T</title></head><body><nav><a>menu</a></nav><div class="x">Site of {h}<p>join us</p></div>{body}<div id="comments"><p>nice</p></div><footer>f</footer></body>"""


def test_html_parsing():
    parse = lambda s: "\n\n".join(html_text.parse(s)[0])
    assert parse("<body><p>a&amp;b <b>c</b>d<br>e<p>f<script>var x='</p>'</script>g<!-- <p>no</p> --></body>") == "a&b cd e\n\nfg"
    assert parse("<article><h1>A</h1><p>x < y &lt;<div class='notice'>s</div><ul><li>1<li>2</ul></article><p>out</p>") == "A\n\nx < y <\n\n1\n\n2"
    # what is no menu, header, footer, sidebar, notice, advert, form or comment stays, whatever its class says
    assert parse("<article><p>a</p><div class='related'>r</div><div class='share'>s</div></article>") == "a\n\nr\n\ns"
    deep = "<i>" * 3000 + "<p>x" + "</b>" * 3000 + "</i>" * 10
    assert parse(f"<article>{deep}<aside>no</aside>y</article>") == "x\n\ny"
    assert parse(None) == parse("") == "" and parse("plain  text") == "plain text" and parse("<p title='>'>q</p><p unclosed") == "q"
    assert parse("<article><p><b>a<p>b</article>c") == "a\n\nb"


def test_class_names_take_no_main_text():
    parse = lambda s: "\n\n".join(html_text.parse(s)[0])
    for page in (
        "<article class='post comments-open'><p>own text</p></article>", "<div class='layout has-sidebar'><p>own text</p></div>", "<article class='post tag-social'><p>own text</p></article>",
        "<section id='sharing-economy'><p>own text</p></section>", "<article class='comment'><p>own text</p></article>", "<div class='widget'><article><p>own text</p></article></div>",
        "<div class='sidebar'><div class='menu'>own text<main></main></div></div>", "<p>own</p><p class=ad>x</p> <span class='sponsored'>y</span><p>text</p>",
    ):
        assert parse(page).split() == ["own", "text"], page
    assert parse("<div><p>long own text of the page</p><div><article><p>card</p></article></div></div>") == "long own text of the page\n\ncard"
    assert parse("<article><p>own text</p><div class='sidebar_left'>r</div><div class='x site-footer'>f</div><div id='comments-section'>c</div></article>") == "own text"


def test_site_templates_go(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE.format(h=i % 2, body=f"<p>own {i}</p>")) for i in range(12)] + [(90, None, None), (91, "", ""), (92, "http://z.org/", "<p>join us</p>")]
    rows += [(100 + i, "http://copy.org/a", "<p>same text</p>") for i in range(9)]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit(1))).collect()}
    assert all(got[i].text == f"own {i}" for i in range(12))
    assert got[90].text == got[91].text == "" and got[92].text == "join us" and got[104].text == "same text" and got[92].n_chars == 7
    assert html_text.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_template_counts_against_brute_force(spark):
    """The counts decide, with class names off too: templates of whole hosts, one of them hot, recounted plainly."""
    rnd, rows = random.Random(8), []
    for i in range(400):
        host = "hot" if i % 4 else f"h{i % 16}"
        parts = [f"<div class='ad'>buy {rnd.randrange(3)}</div>", f"<div><p>join {host}</p></div>", f"<p>own {rnd.randrange(150)}</p>", f"<p>{host} line {rnd.randrange(40)}</p>"]
        rnd.shuffle(parts)
        rows.append((i, f"http://{host}/{i}", "".join(parts)))
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for names in (True, False):
        seen, prints = {}, {}
        for i, url, page in rows:
            host, (blocks, elements) = url.split("/")[2], html_text.parse(page, names)
            prints.setdefault(host, set()).add(tuple(blocks))
            for h, _, _, text in elements:
                seen.setdefault((host, h, text), set()).add(tuple(blocks))
        c = html_text.COUNTS
        want = {k for k, v in seen.items() if len(v) >= max(c[0], min(c[2], c[1] * len(prints[k[0]])))}
        parsed = html_text.parse_pages(frame, names).withColumn("row", F.monotonically_increasing_id())
        assert {(r.host, r.hash, r.text) for r in html_text.templates(parsed).collect()} == want and len(want) > 5
        got = {r.page_id: r.text for r in html_text.extract(frame, names).collect()}
        for i, url, page in rows:
            host, (blocks, elements) = url.split("/")[2], html_text.parse(page, names)
            gone = {k for h, a, b, t in elements if (host, h, t) in want for k in range(a, b)}
            assert got[i] == "\n\n".join(b for k, b in enumerate(blocks) if k not in gone)
        assert not any("join" in t or "buy" in t for t in got.values())


def test_templates_of_large_hosts_and_articles(spark):
    """A menu on 60 of 400 pages goes; a notice on all pages of an article host goes, a paragraph on some of them stays."""
    menu = "<div class='x'>section menu<p>of the host</p></div>"
    rows = [(i, f"http://big.org/{i}", f"{menu if i < 60 else ''}<p>own {i}</p>") for i in range(400)]
    rows += [(1000 + i, "http://art.org/", f"<article><h2>Part of a series</h2><p>own {i}</p>{'<p>quoted now and then</p>' if i < 8 else ''}<blockquote>notice to all</blockquote></article>") for i in range(24)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[i] == f"own {i}" for i in range(400))
    assert all(got[1000 + i] == f"own {i}" + ("\n\nquoted now and then" if i < 8 else "") for i in range(24))


def test_byte_bpe_parts_match_the_library():
    rnd = random.Random(7)
    some = [" ", " ", " ", "\n", "a", "Bc", "é", "ªb", "ß", "Ÿ", "ж", "x'll", "'", "1", "½", "²", "·", "«", ",", ".", "***", "!?", "<", "|", "<|endoftext|>", "\0", "\t", "\r\n", "\xa0", "\x85", "\x1c", "\x7f", "\u3000", "🙂"]
    usual = some[:23]
    texts = ["".join(rnd.choices(pool, k=rnd.randint(1, 30))) for pool in (some, usual) for _ in range(3000)]
    texts += [" ", "\n", " a", "a ", "\na", "a\n", "a\nb", "a\0 b", "a, b. a b,\nA b!"]
    bpe = ByteBPE(BYTE_BPE)
    want = [e.ids for e in bpe._tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode([texts[i : i + 256] for i in range(0, len(texts), 256)])] == want


def test_frames_are_made_one_document_at_a_time(monkeypatch):
    """Of a batch's ids only one document's are held."""

    class Ids(bytes):
        held = most = 0

        def __new__(cls, *a):
            Ids.held += 1
            Ids.most = max(Ids.most, Ids.held)
            return super().__new__(cls, *a)

        def __add__(self, other):
            return Ids(bytes(self) + other)

        def __del__(self):
            Ids.held -= 1

    class Frame:
        """Runs what a Python worker would, in this process."""

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return list(run(iter([pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([f"text {i}" for i in range(299)] + [None])], ["doc_id", "text"])])))

    encode = ByteBPE.encode
    monkeypatch.setattr(ByteBPE, "encode", lambda self, texts: map(Ids, encode(self, texts)))
    (got,) = token_files.encode_frames(Frame(), BYTE_BPE, b"")
    ids = [np.frombuffer(zstandard.decompress(x), "<u4").tolist() for x in got.column(2).to_pylist()]
    assert ids[299] == [2] and all(x[-1] == 2 for x in ids) and got.column(1).to_pylist() == list(map(len, ids))
    assert len(ids) == 300 and Ids.most <= 3


def test_pipeline(spark):
    """run() against its operators' own answers, stage by stage, and a plain recount of what must hold."""
    import corpus_pipeline

    docs = pd.read_parquet(f"{D}/documents.parquet").set_index("doc_id")
    out = corpus_pipeline.run(spark, D).toPandas()
    good = {r.doc_id for r in QUERIES["op4_quality_classifier"](spark, D).where("predicted = 1").collect()}
    kept = set(out.doc_id)
    assert kept <= good
    assert all(not (s[0] < 20 or 100 * s[4] > 30 * s[0]) for s in map(plain_statistics, docs.text[list(kept)]))
    links = classes([(i, docs.text[i]) for i in kept])
    assert all(top == i for i, (_, top) in links.items())
    assert (out.groupby("doc_id").piece.max() + 1 == out.groupby("doc_id").size()).all()


def plain_verdicts(rows):
    """doc_ids that base rules and robust distance keep, from (doc_id, text, lang, source), with numpy alone."""
    q, x = quality_rules, {}
    for doc_id, text, _, _ in rows:
        n, c, symbols, _, repeat = plain_statistics(text)
        if n >= 20 and 100 * repeat <= 30 * n:
            upper = sum(unicodedata.category(ch) == "Lu" for ch in text)
            x[doc_id] = [np.log((c + 500) / (n + 100)), np.arcsinh(symbols * 50 / (c + 500)), np.arcsinh(upper * 20 / (c + 500)), np.sqrt(repeat / (n + 20))]
    ids = [r for r in rows if r[0] in x]
    at = lambda v, p: np.sort(v, axis=0)[int(np.ceil(p * len(v))) - 1]

    def estimate(v):
        def far(mean, cov):
            inverse = np.linalg.inv(cov * q.CONSISTENT + np.diag(q.FLOOR) ** 2)
            return lambda w: np.einsum("ij,jk,ik->i", w - mean, inverse, w - mean)

        def step(mean, cov):
            d = far(mean, cov)(v)
            core = v[d <= at(d, q.SHARE)]
            return core.mean(0), np.cov(core.T, bias=True)

        det = lambda e: np.linalg.slogdet(e[1] * q.CONSISTENT + np.diag(q.FLOOR) ** 2)[1]
        mid, wide = at(v, 0.5), at(v, 0.75) - at(v, 0.25)
        box = v[(np.abs(v - mid) <= wide).all(1)]
        starts = [(mid, np.diag((wide / 1.349) ** 2 / q.CONSISTENT))] + [(c.mean(0), np.cov(c.T, bias=True).reshape(4, 4)) for c in (box, v) if len(c)]
        for _ in range(q.STEPS):
            starts = [step(*s) for s in starts]
        now = min(starts, key=det)
        for _ in range(q.MOST_STEPS):
            before, now = now, step(*now)
            if det(before) - det(now) < q.STILL:
                break
        return far(*now)

    kept, seen = set(), {}
    for doc_id, _, lang, source in ids:
        for group in ([r for r in ids if r[2:] == (lang, source)], [r for r in ids if r[2] == lang], ids):
            if len(group) >= q.LEAST:
                break
        key = tuple(r[0] for r in group)
        if key not in seen:
            seen[key] = estimate(np.array([x[i] for i in key]))
        if seen[key](np.array([x[doc_id]]))[0] <= q.CUTOFF:
            kept.add(doc_id)
    return kept


def test_pipeline_stages_exactly(spark, byte_ids, monkeypatch):
    """The set of documents after each stage, and the pieces, recomputed plainly; only the classifier's verdicts are op4's."""
    import corpus_pipeline

    seen = []

    def recording(stage):
        return lambda s, docs, d: seen.append(sorted(r.doc_id for r in docs.select("doc_id").collect())) or stage(s, docs, d)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, recording(f)) for n, f in corpus_pipeline.STAGES])
    out = corpus_pipeline.run(spark, D).toPandas()
    docs = pd.read_parquet(f"{D}/documents.parquet")
    rows = list(docs[["doc_id", "text", "lang", "source"]].itertuples(index=False, name=None))
    good = {r.doc_id for r in QUERIES["op4_quality_classifier"](spark, D).where("predicted = 1").collect()}
    assert seen[0] == sorted(docs.doc_id) and seen[1] == sorted(good)
    ruled = plain_verdicts([r for r in rows if r[0] in good])
    assert seen[2] == sorted(ruled) and len(ruled) > 100
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t, _, _ in rows if i in ruled for w in [t.encode().lower().split()]}
    left, single = set(sets), []
    while left:
        todo, comp = [left.pop()], []
        while todo:
            comp.append(i := todo.pop())
            near = {j for j in left if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
            left -= near
            todo += near
        single.append(min(comp))
    assert seen[3] == sorted(single) and len(single) < len(ruled)
    texts = dict(zip(docs.doc_id, docs.text))
    want = {i: len(byte_ids[texts[i]]) + 1 for i in single}
    check_pieces([Row(**r) for r in out.to_dict("records")], texts, byte_ids)
    assert out.groupby("doc_id").length.sum().to_dict() == want and all(len(g) == -(-want[i] // 2048) for i, g in out.groupby("doc_id"))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    got, want = QUERIES[name](spark, D).toPandas(), c.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = want.columns[0]
    pd.testing.assert_frame_equal(got.sort_values(key, ignore_index=True)[want.columns], want.sort_values(key, ignore_index=True), check_dtype=False)
