"""Edge rows of every training-data operator, and decontamination against brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

import corpus_pipeline
from rasterlake.llm import ann, bpe, decontam, idfilter, jaccard, kernels, langid, packing, pii, substrings, toxicity, warczip

JSON = P.path("byte_bpe_50k.json")
WIDE = "doc_id bigint, text string, lang string, source string, n_chars bigint, label int, score double, spans string, row string, key int, told int, part int"


def table(spark, texts):
    """Documents with columns whose names the operators use themselves; ids repeat and one is null."""
    ids = [None if i == 1 else i // 2 for i in range(len(texts))]
    rows = [(k, t, "en", "s", 0, 7, 0.5, "x", "y", 1, 2, 3) for k, t in zip(ids, texts)]
    return spark.createDataFrame(rows, WIDE).repartition(3)


LONG = " ".join(f"w{i % 5003}" for i in range(60_000))
TEXTS = [None, "", " ", "one", "one", "mail a@b.cd now", LONG, LONG, "é" * 5000, "the same words again " * 20, "the same words again " * 20]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def labels_of(d):
    return d.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic", "label")


@pytest.mark.parametrize("empty", [False, True])
def test_edge_rows(spark, tmp_path, empty):
    d = table(spark, TEXTS)
    d = d.filter("doc_id > 99") if empty else d
    n = 0 if empty else len(TEXTS)

    found = pii.digest(pii.extract(d)).collect()
    assert len(found) == n and sorted(r.n_email for r in found)[-1:] == ([] if empty else [1])
    masked = pii.redact(d)
    assert masked.columns == d.columns and masked.count() == n
    assert sorted(r.n_chars for r in masked.filter("text like '%[EMAIL]%'").collect()) == ([] if empty else [len("mail [EMAIL] now")])

    model = langid.train(d)
    seen = langid.predict(d, model).collect()
    assert len(seen) == n and all(r.lang_pred in ("en", "und") and 0 <= r.score <= 1 for r in seen)
    assert sum(r.lang_pred == "und" for r in seen) == (0 if empty else 3)

    coded = bpe.encode(d, JSON, P.PATTERN, with_ids=True)
    assert coded.count() == n
    back = sorted(r.text for r in bpe.decode(coded, JSON, P.PATTERN).collect())
    assert back == ([] if empty else sorted(t or "" for t in TEXTS))

    folder = f"file://{tmp_path}/packed"
    got = packing.unpack(packing.pack(d, folder, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, row_len=256, pool_tokens=500), folder).collect()
    assert len(got) == n and sorted(r.n_tokens for r in got) == sorted(r.n_tokens for r in coded.collect())

    cut = substrings.dedup(d).collect()
    assert len(cut) == n and all(r.n_removed in (0, 60_000, 80) for r in cut)
    if not empty:
        # ids 3 and 3 hold the long text: no smaller id has it; ids 4 and 5 the sentence
        assert [r.n_removed for r in cut if r.doc_id == 3] == [0, 0] and sorted(r.n_removed for r in cut if r.n_words == 80) == [0, 80]

    model = toxicity.train(d, labels_of(d))
    assert toxicity.score(d, model).count() == n
    kept = toxicity.score(d, model, ["doc_id", "score"])
    assert kept.columns == ["doc_id", "score", "toxic_score"] and kept.count() == n

    items = spark.createDataFrame([(1, "the same words again the same words again", "z"), (1, "the same words again the same words again", "z"), (2, None, "z"), (3, "", "z")], "item_id bigint, text string, doc_id string")
    hit = decontam.leaks(d, items).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in hit} == (set() if empty else {(4, 1, 0), (5, 1, 0)}) and len(hit) == (0 if empty else 2)
    left = decontam.clean(d, items)
    assert left.columns == d.columns and left.count() == max(0, n - 2)
    assert decontam.leaks(d, items.limit(0)).count() == 0 and decontam.clean(d, items.limit(0)).count() == n

    pages = d.selectExpr("doc_id as page_id", "source as url", "text as html", "key", "told as refers_to", "part as digest")
    read = warczip.round_trip(pages).collect()
    assert sorted(r.payload_digest for r in read) == ([] if empty else sorted(sha(t or "") for t in TEXTS))


def test_leaks_equal_brute_force_over_many_items_and_edits(spark):
    r = random.Random(11)
    common = [f"c{i}" for i in range(120)]
    word = lambda: r.choice(common) if r.random() < 0.4 else f"v{r.randrange(6000)}"
    items = [[word() for _ in range(r.choice([8, 15, 24, 40, 70]))] for _ in range(240)]
    texts, want, met = [], set(), {}
    for i, item in enumerate(items):
        share = r.choice([0.0, 0.05, 0.1, 0.2])
        copy = list(item)
        for _ in range(int(share * len(item) + 1e-9)):
            at = r.randrange(len(copy))
            copy[at : at + 1] = r.choice([["zz"], [], [copy[at], "yy"]])
        texts.append(" ".join([word() for _ in range(r.randrange(60))] + copy + [word() for _ in range(r.randrange(60))]))
    texts += [" ".join(word() for _ in range(100)) for _ in range(60)]
    for d, text in enumerate(texts):
        w = np.array(text.split())
        for i, item in enumerate(items):
            if len(set(item) & set(w)) >= 0.5 * len(set(item)):
                distance, _ = decontam.infix_distance(np.array(item), w)
                if distance <= decontam.errors(len(item), 0.8):
                    want.add((d, i))
                    met[d, i] = distance
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id bigint, text string")
    got = {(x.doc_id, x.item_id): x.distance for x in decontam.leaks(rows, bench).collect()}
    assert set(got) <= want and all(got[k] == met[k] for k in got)
    assert len(want) >= 230 and len(got) / len(want) >= 0.97


def test_several_blocks_of_items_give_the_same_leaks(spark, monkeypatch):
    r = random.Random(12)
    items = [" ".join(f"k{r.randrange(900)}" for _ in range(20)) for _ in range(30)]
    texts = [f"before {t} after" for t in items] + ["nothing here at all"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 300)
    assert {(x.doc_id, x.item_id, x.distance) for x in decontam.leaks(d, bench).collect()} == {(i, i, 0) for i in range(30)}
    assert [x.doc_id for x in decontam.clean(d, bench).collect()] == [30]


def test_leaks_are_met_across_case_quotes_and_scripts(spark):
    items = ["La información de la nación está en la canción más pequeña de España", "Die Straße führt über große Brücken nach Süden und weiter", "今日は天気がとても良いです", "he said it was not the end of all things"]
    texts = [items[0].upper(), items[1].upper(), "前の文。" + items[2] + "後の文", "“He said ‘it—was’ not the end…of all things”", "nada que ver con la nación", "今日"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    assert {(x.doc_id, x.item_id, x.distance) for x in decontam.leaks(d, bench).collect()} == {(i, i, 0) for i in range(4)}


def test_id_filter_holds_no_id_back(spark):
    ids = [*range(-50, 3000, 7), 2**62, None]
    sent = idfilter.build(spark.createDataFrame([(i,) for i in ids], "id bigint"))
    mask = idfilter.mask(sent.value, pa.array(ids, pa.int64()))
    assert mask[:-1].all() and not mask[-1]
    other = idfilter.mask(sent.value, pa.array(range(10_000, 20_000), pa.int64()))
    assert other.mean() < 0.01
    assert not idfilter.mask(idfilter.build(spark.createDataFrame([], "id bigint")).value, pa.array([1, None], pa.int64())).any()


def test_neighbours_of_few_repeated_and_far_vectors(spark):
    assert ann.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<double>")).count() == 0
    rows = [(0, [1.0, 2.0], "a"), (0, [9.0, 9.0], "a"), (1, [1.0, 3.0], "b"), (2, [1e300, 0.0], "c"), (None, [1.0, 1.0], "d"), (3, [1.0, None], "e")]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score string")).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2)] and got[0].score == 1.0
    # far from the origin single precision must not blur the distances
    rng = np.random.default_rng(1)
    x = 1e6 + rng.normal(size=(400, 6))
    near = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>"), every=50).collect()
    hit = 0
    for q in range(0, 400, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hit += len(set(np.argsort(d)[:10]) & {r.vec_id for r in near if r.query_id == q})
    assert hit >= 76


def test_neighbours_of_vectors_without_clusters_reach_recall(spark):
    x = np.random.default_rng(5).normal(size=(3000, 12)).astype(np.float32)
    got = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")).collect()
    hit = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x.astype(float) - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hit += len(set(np.argsort(d)[:10]) & {r.vec_id for r in got if r.query_id == q})
    assert hit / 300 >= 0.9


def plain_ftrl(rows, epochs, alpha, beta, l1, l2, positive):
    """The published per-coordinate update, one coordinate after the other."""
    z, n = {}, {}

    def weight(i):
        a = z.get(i, 0.0)
        pull = 0.0 if i == "bias" else l1
        return 0.0 if abs(a) <= pull else -(a - np.sign(a) * pull) / ((beta + np.sqrt(n.get(i, 0.0))) / alpha + l2)

    for epoch in range(epochs):
        for r in np.random.default_rng(epoch).permutation(len(rows)):
            label, slots = rows[r]
            at = [*slots, "bias"]
            w = {i: weight(i) for i in at}
            g = (1 / (1 + np.exp(-sum(w.values()))) - label) * (positive if label else 1)
            for i in at:
                m = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (np.sqrt(m + g * g) - np.sqrt(m)) / alpha * w[i]
                n[i] = m + g * g
    return {i: weight(i) for i in z}


def test_the_learner_equals_a_plain_loop():
    rng = np.random.default_rng(7)
    rows = [(int(i % 3 == 0), np.unique(np.append(rng.integers(0, 60, 12), 5 if i % 3 == 0 else 8)).astype(np.int32)) for i in range(200)]
    flat, size, label = np.concatenate([s for _, s in rows]), np.array([len(s) for _, s in rows]), np.array([y for y, _ in rows], float)
    slot, w = toxicity._ftrl(flat, size, label, 3, 1.0, 1.0, 0.5, 0.1, 1.5)
    want = plain_ftrl([(y, s.tolist()) for y, s in rows], 3, 1.0, 1.0, 0.5, 0.1, 1.5)
    got = {("bias" if s == toxicity.BIAS else int(s)): v for s, v in zip(slot, w)}
    assert all(abs(got.get(k, 0.0) - v) < 1e-9 for k, v in want.items()) and set(got) <= set(want)


def test_the_sample_is_bounded_in_features(spark):
    texts = [" ".join(f"t{i}x{j}" for j in range(40)) + (" vile" if i % 2 else " kind") for i in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    whole, part, one = (toxicity.train(d, labels, max_slots=m) for m in (1 << 25, 1500, 1))
    assert len(whole[0]) > 0 and not np.array_equal(whole[1], part[1]) and len(one[0]) == 0
    twice = labels.unionByName(labels.selectExpr("doc_id", "0 as toxic"))
    assert np.array_equal(toxicity.train(d, twice)[1], whole[1])  # either label says so


def test_language_model_equals_a_plain_count(spark):
    r = random.Random(2)
    words = {"en": ["the", "house", "is", "there", "and"], "de": ["das", "haus", "ist", "dort", "und"]}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(12)) + f" {lang}{i}", lang) for i, lang in enumerate(["en", "de"] * 40)]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    texts = ["the haus", "dort", "unde there", "xyz", "houses ist"]
    got = {x.doc_id: (x.lang_pred, x.score) for x in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).collect()}
    for i, text in enumerate(texts):
        scores = np.mean([langid.word_scores(w, model) for w in text.split()], axis=0)
        best = int(np.argmax(scores))
        assert got[i][0] == model["langs"][best]
        assert abs(got[i][1] - 1 / np.exp((scores - scores[best]) * np.sqrt(len(text.split()))).sum()) < 1e-9


def test_stages_on_empty_and_wide_tables(spark, tmp_path):
    d = table(spark, TEXTS)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    labels_of(d).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for docs in (d.limit(0), d):
            out = stage(spark, docs, str(tmp_path))
            n = out.count()
            assert n == 0 if docs is not d else 0 < n <= len(TEXTS), name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == corpus_pipeline.COLUMNS, name


def test_a_worker_keeps_little():
    coder = bpe.ByteBPE(JSON, P.PATTERN)
    for i in range(40):
        coder.encode_batch([" ".join(f"q{i}z{j}" for j in range(20_000))])
        assert coder.held <= bpe.CACHE_BYTES + 20_000 * 1000


def thue_morse(n):
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_regular_words_do_not_collide():
    word = thue_morse(10)
    other = word.translate(str.maketrans("ab", "ba"))
    column = pa.array([f"{word} {other} x{word} {word}", "p q q p", "q p p q"])
    data, offsets = kernels.texts(column)
    h = kernels.word_hashes(data, *kernels.words(data, offsets)[:2])
    assert h[0] != h[1] and h[0] == h[3] and h[2] != h[0]
    x, y = h[4], h[5]
    bits = [c == "a" for c in thue_morse(6)]
    one, two = np.where(bits, x, y), np.where(bits, y, x)
    assert kernels.window_hashes(one, 64) != kernels.window_hashes(two, 64)
    long = np.arange(120, dtype=np.uint64)
    for k in (1, 2, 3, 4, 5, 25, 50):
        g = kernels.window_hashes(long, k)
        assert len(g) == 121 - k and len(np.unique(g)) == len(g) and (kernels.window_hashes(long[7:], k) == g[7:]).all()


def test_collision_pair_in_the_joins(spark):
    word = thue_morse(10)
    other = word.translate(str.maketrans("ab", "ba"))
    rest = [f"w{i}" for i in range(49)]
    texts = [" ".join([*rest[:25], w, *rest[25:]]) for w in (word, other)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [r.n_removed for r in substrings.dedup(d).collect()] == [0, 0]
    short = spark.createDataFrame([(0, word), (1, other)], "doc_id bigint, text string")
    assert sorted(r.component_id for r in jaccard.similar_classes(short).collect()) == [0, 1]


def test_remainders_are_those_of_crc32(spark):
    from rasterlake.llm.queries import remainder

    got = {r.doc_id: r.m for r in spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", remainder("doc_id", 4).alias("m")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 for i in range(50)}
