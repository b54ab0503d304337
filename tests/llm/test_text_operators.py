"""The text operators against plain loops, with nulls, empty and long texts, repeats and further columns."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from rasterlake.llm import bpe, contexts, decontam, idfilter, jaccard, kernels, langid, packing, pii, queries, substrings, toxicity

SCHEMA = "doc_id bigint, text string, score int, part string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = str.maketrans("0123456789", "abcdefghij")


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, 1, "x") for i, t in enumerate(texts)], SCHEMA).repartition(3)


def corpus(seed=1, n=120):
    r = random.Random(seed)
    v = [f"w{i}" for i in range(12)]
    base = [[r.choice(v) for _ in range(r.choice([2, 5, 11, 30, 70]))] for _ in range(20)]
    out = []
    for _ in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2])):
            w[r.randrange(len(w))] = r.choice(v)
        out.append(" ".join(w))
    return [*out, None, "", "  \n ", "One two\tTHREE", "é" * 3000]


def test_bpe_equals_the_library(spark):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["It's  1st\n\n don't", "a" * 3000, "<|endoftext|>x <|endoftext|>", "naïve 日本語 ‍", "", None, "x", "x"]
    got = {r.doc_id: r for r in bpe.encode(docs(spark, texts), P.path("byte_bpe_50k.json"), P.PATTERN, with_ids=True).collect()}
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def brute_pii(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def test_base_spans_equal_plain_patterns():
    r = random.Random(3)
    for _ in range(4000):
        t = "".join(r.choice("12.@+- a)b.5é") for _ in range(r.randint(0, 50)))
        assert pii.base_spans(t) == brute_pii(t)
    assert pii.base_spans("4" * 20000) == [] and pii.emails("@" * 50000 + "a@b.c") == [(50000, 50005)]


def test_contexts_find_what_the_patterns_miss(spark):
    texts = [f"the server address is 10.0.0.{i} today" for i in range(9)] + ["the server address is 10.0.0.999 today", "page 12345 of", None, ""]
    got = {r.doc_id: r for r in pii.digest(pii.extract(docs(spark, texts))).collect()}
    assert got[9].n_ip == 0 and got[9].spans == "ip:22:32" and got[10].spans == "" and got[11].spans == ""
    masked = {r.doc_id: r.text for r in pii.redact(docs(spark, texts)).collect()}
    assert masked[0] == masked[9] == "the server address is [IP] today" and masked[11] is None


def test_contexts_find_tokens_of_any_length_and_digits(spark):
    long = "k" * 90
    texts = [f"please write to user{i}@site.com today" for i in range(9)] + ["please write to john(at)site.com today", f"please write to {long} today"]
    got = {r.doc_id: r.spans for r in pii.digest(pii.extract(docs(spark, texts))).collect()}
    assert got[9] == "email:16:32" and got[10] == "email:16:106"
    masked = {r.doc_id: r.text for r in pii.redact(docs(spark, texts)).collect()}
    assert masked[9] == masked[10] == "please write to [EMAIL] today"
    # every other token counts against the pattern: 9 of 13 occurrences are too few
    texts += ["please write to them today", "please write to me today"]
    assert pii.learn(docs(spark, texts)).count() == 0


def test_patterns_of_newly_known_instances_are_read_too(spark):
    texts = [f"mail reaches user{i}@site.com daily" for i in range(40)] + [f"mail reaches {w} daily" for w in ("ann", "bob", "cleo")] + [f"login name {w} here" for w in ("ann", "bob", "cleo", "dora")]
    got = {r.doc_id: r.spans for r in pii.digest(pii.extract(docs(spark, texts), confidence=0.7)).collect()}
    assert got[40] == "email:13:16" and got[46] == "email:11:15"


def test_joined_patterns_equal_broadcast_ones(spark, monkeypatch):
    texts = [f"please write to user{i}@site.com today" for i in range(9)] + ["please write to john(at)site.com today", None, ""]
    want = {r.doc_id: r.spans for r in pii.digest(pii.extract(docs(spark, texts))).collect()}
    masked = {r.doc_id: r.text for r in pii.redact(docs(spark, texts)).collect()}
    monkeypatch.setattr(pii, "MAX_APPLIED", 0)
    assert {r.doc_id: r.spans for r in pii.digest(pii.extract(docs(spark, texts))).collect()} == want
    assert {r.doc_id: r.text for r in pii.redact(docs(spark, texts)).collect()} == masked


def test_frequent_contexts_are_left_before_all_their_tokens_are_read(spark, monkeypatch):
    texts = [f"one of the user{i}@site.com is here" for i in range(5)] + ["one of the " + f"word{i} is here".translate(LETTERS) for i in range(4000)]
    texts += [f"please write to name{i}@site.com today" for i in range(5)] + ["please write to john(at)site.com today"]
    rows, keep = [], pii.materialize

    def counted(df, *more):
        out = keep(df, *more)
        if out.columns == ["pattern", "instance", "n", "seed"]:
            rows.append(out.count())
        return out

    monkeypatch.setattr(pii, "materialize", counted)
    learned = {r.pattern for r in pii.learn(docs(spark, texts)).collect()}
    assert learned == {"write to _", "to _ today"} and max(rows) < 100


def test_marked_tokens_hold_all_with_a_wanted_pattern():
    r = random.Random(3)
    parts = ["to", "É", "İ", "Σ", "𝐀", "_", "w" * 45, "q" * 20, " ", " ", "\t", "-", ".", ":", "= ", "(", "x1", "1@b.c", "          "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(2000)]
    found = {t: {(s, e): pii.patterns(t, s, e) for s, e in pii.candidates(t, [])} for t in texts}
    known = r.sample(sorted({p for f in found.values() for ps in f.values() for p in ps}), 300)
    bits = np.zeros(idfilter.BITS, bool)
    ids = next(contexts.pattern_ids(iter([pa.RecordBatch.from_arrays([pa.array(known)], names=["pattern"])])))
    bits[idfilter._slots(ids.column(0).to_numpy())] = True
    got = [m for lo, hi in contexts.pieces(texts) for m in contexts.marked(texts[lo:hi], np.packbits(bits), pii.LEAD, pii.TRAIL, pii.CONTEXT_CHARS)]
    assert len(got) == len(texts)
    for t, m in zip(texts, got):
        assert {at for at, ps in found[t].items() if set(ps) & set(known)} <= set(m)
    assert contexts.marked(["one two three four"], np.zeros(idfilter.BITS >> 3, np.uint8), pii.LEAD, pii.TRAIL, pii.CONTEXT_CHARS) == [[]]


def test_skipped_tokens_have_none_of_the_patterns():
    r = random.Random(9)
    known = {"to", "é", "_"}
    for _ in range(3000):
        text = "".join(r.choice(["to", "é", "É", "_", "w" * 45, " ", "  ", "-", ".", ":", "....", "(", "x1", "          "]) for _ in range(r.randint(0, 25)))
        some = set(pii.candidates(text, [], pii.Lookup(pii.tail_test(known.__contains__))))
        for s, e in set(pii.candidates(text, [])) - some:
            before = pii.WORD.findall(text[max(0, s - pii.CONTEXT_CHARS) : s].lower())
            assert not before or before[-1] not in known


def brute_jaccard(texts, k=4, num=85):
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if v in (x, y) else v for v in root]
    return {i: (len(s), root[i]) for i, s in enumerate(sets)}


def test_jaccard_components_equal_all_pairs(spark):
    texts = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_classes(docs(spark, texts)).collect()}
    assert got == brute_jaccard(texts)


def edited(r, words, share):
    """A copy with words replaced, dropped or doubled."""
    out = []
    for w in words:
        x = r.random()
        out += [w] if x > share else [[f"n{r.random()}"], [], [w, w]][r.randrange(3)]
    return out


def test_jaccard_of_a_large_group_just_under_the_threshold(spark):
    r = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    kin = edited(r, base, 0.04)  # a second original, with copies of its own
    group = [edited(r, base, r.choice([0.0, 0.01, 0.02, 0.03, 0.05])) for _ in range(330)]
    group += [edited(r, kin, r.choice([0.01, 0.02, 0.03])) for _ in range(90)]
    group += [edited(r, group[-1], 0.01), edited(r, group[5], 0.0), *(g[:-20] for g in group[:30])]
    texts = [" ".join(g) for g in group]
    want = brute_jaccard(texts)
    assert len({c for _, c in want.values()}) > 30
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.similar_classes(docs(spark, texts)).collect()}
    assert got == want


def test_jaccard_edge_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    rows = [(1, long), (1, long), (2, long + " end"), (None, long), (3, None), (4, "one two"), (4, "one two"), (5, "ONE two")]
    d = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in rows], "doc_id bigint, text string, key int, pivot int, component int")
    got = sorted((x.doc_id is None, x.doc_id or 0, x.component_id) for x in jaccard.similar_classes(d).collect())
    assert got == [(False, 1, 1), (False, 1, 1), (False, 2, 1), (False, 3, 3), (False, 4, 4), (False, 4, 4), (False, 5, 4), (True, 0, None)]
    assert jaccard.similar_classes(d.filter("doc_id > 9")).count() == 0


@pytest.mark.parametrize("num", [70, 80, 85, 95])
def test_tiles_lose_no_linked_pair(num):
    rule, rng = jaccard.Rule(num=num), np.random.default_rng(5)
    for n in [7, 9, 14, 40, 120, 600, 4000] * 6:
        u = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        drop = int(rng.integers(0, rule.differ(len(u)) // 2 + 1))
        v = np.unique(np.concatenate([u[drop:], rng.integers(0, 2**63, drop, dtype=np.uint64)]))
        if rule.linked(u, v) and rule.differ(max(len(u), len(v))):
            assert np.intersect1d(jaccard.tile_keys(u, rule), jaccard.tile_keys(v, rule)).size


def test_repeats_equal_a_plain_loop(spark):
    r = random.Random(2)
    passages = [" ".join(r.choice("abcdefg") for _ in range(n)) for n in (9, 10, 11, 25)]
    texts = [" ".join(r.choice(passages) if r.random() < 0.5 else r.choice("abcdefg") for _ in range(r.randint(0, 8))) for _ in range(150)] + [None, "", "Ab"]
    first = {}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        for j in range(len(w) - 9):
            first.setdefault(tuple(w[j : j + 10]), i)
    want = {}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        gone = {k for j in range(len(w) - 9) if first[tuple(w[j : j + 10])] < i for k in range(j, j + 10)}
        want[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup(docs(spark, texts), 10).collect()}
    assert got == want


def test_language_falls_back_to_word_parts(spark):
    rows = [(i, t, l) for i, (t, l) in enumerate([("the house is there", "en"), ("das haus ist dort", "de")] * 20)]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), 1e-3, 1e-3)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs(spark, ["the house", "dortig haushaus", "", None, "12 ..", "THERE"]), model).collect()}
    assert [got[i][0] for i in range(6)] == ["en", "de", "und", "und", "und", "en"] and all(0 <= s <= 1 for _, s in got.values())


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(4)
    plain = [f"word{i}" for i in range(300)]
    texts = [" ".join([r.choice(plain) for _ in range(30)] + ([r.choice(["vile", "nasty", "foul"])] if i % 4 == 0 else [])) for i in range(800)]
    labels = spark.createDataFrame([(i, 0 if i % 4 else 1) for i in range(600)] + [(601, None)], "doc_id bigint, toxic int")
    model = toxicity.train(docs(spark, texts), labels)
    got = {x.doc_id: x.score for x in toxicity.score(docs(spark, texts + [None, ""]), model).collect()}
    wrong = [i for i in range(600, 800) if (got[i] >= 0.5) != (i % 4 == 0)]
    assert len(wrong) <= 4 and 0 <= got[800] <= 1
    none = toxicity.train(docs(spark, texts[:3]), labels.filter("toxic is null"))
    assert {x.score for x in toxicity.score(docs(spark, ["a", None]), none).collect()} == {0.5}


def test_leaks_are_found_with_edits_and_nothing_else(spark):
    r = random.Random(6)
    v = [f"t{i}" for i in range(400)]
    items = [" ".join(r.choice(v) for _ in range(n)) for n in (12, 25, 40)]
    spoilt = items[2].split()
    spoilt[5:6], spoilt[20:21] = [], ["zz", "yy"]
    other = [" ".join(r.choice(v) for _ in range(80)) for _ in range(20)]
    texts = [other[0] + " " + items[0] + " " + other[1], other[2] + " " + " ".join(spoilt), items[1].upper(), None, "", *other]
    bench = spark.createDataFrame([(7, items[0]), (8, items[1]), (9, items[2]), (10, None), (11, "one two")], "item_id bigint, text string")
    got = {(x.doc_id, x.item_id): x.distance for x in decontam.leaks(docs(spark, texts), bench).collect()}
    assert got == {(0, 7): 0, (1, 9): 3, (2, 8): 0}
    assert {x.doc_id for x in decontam.clean(docs(spark, texts), bench).collect()} == set(range(len(texts))) - {0, 1, 2}


def test_packing_loses_nothing(spark, tmp_path):
    texts = ["word " * n for n in (1, 5, 700, 33, 64, 65)] + [None, "", "x", "x"]
    folder = "file://" + str(tmp_path)
    manifest = packing.pack(docs(spark, texts), folder, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, row_len=64)
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in packing.unpack(manifest, folder).collect()}
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].n_pieces == -(-len(ids) // 64)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_best_fit_takes_the_fullest_row():
    r = random.Random(8)
    sizes = [r.randint(1, 20) for _ in range(200)]
    place, rows = packing.best_fit(sizes, 20)
    left, want = [], {}
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fit = [c for c in left if c >= sizes[i]]
        if fit and sizes[i] < 20:
            left.remove(min(fit))
            left.append(min(fit) - sizes[i])
            want[i] = 20 - min(fit)
        else:
            left.append(20 - sizes[i])
            want[i] = 0
    assert rows == len(left) and all(place[i][1] == want[i] for i in want)


@pytest.mark.parametrize("run", [lambda d: jaccard.similar_classes(d), lambda d: substrings.dedup(d), lambda d: bpe.encode(d, P.path("byte_bpe_50k.json"), P.PATTERN), lambda d: pii.extract(d)])
def test_empty_tables_give_empty_tables(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0


def test_matchers_are_sent_in_bytes_and_read_in_slices():
    r = random.Random(4)
    rows = [None, ""] + [" ".join(r.choice(["Straße", "x1", "漢字", "b-c", "w"]) for _ in range(r.randint(0, 9))) for _ in range(700)]
    got = [tuple(h[a:z]) for _, h, at in decontam._words_of(pa.array(rows)) for a, z in zip(at[:-1], at[1:])]
    assert got == [tuple(h[a:z]) for t in rows for _, h, at in decontam._words_of(pa.array([t], pa.string())) for a, z in zip(at[:-1], at[1:])]
    walk = decontam.Walk(0, 50)
    assert walk.bits.nbytes == walk.bits.size and list(decontam._words_of(pa.array([], pa.string()))) == []


class Held:
    """A table of one batch, whose mapInArrow runs here."""

    def __init__(self, texts):
        self.batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):
        return run(iter([self.batch]))


def peak_mb(rows):
    tracemalloc.start()
    n = sum(b.num_rows for b in rows)
    peak = tracemalloc.get_traced_memory()[1] / 2**20
    tracemalloc.stop()
    return n, peak


def test_bpe_splits_a_bounded_part_of_a_batch_at_once():
    r = random.Random(3)
    v = ["".join(r.choices("abcdefgh", k=5)) for _ in range(2000)]
    args = P.path("byte_bpe_50k.json"), P.PATTERN, True
    bpe.load(*args[:2])
    n, peak = peak_mb(bpe.encode(Held([" ".join(r.choices(v, k=400)) for _ in range(1000)]), *args))
    assert n == 1000 and peak < 16


def test_keys_of_a_task_meet_in_little_memory():
    r = random.Random(4)
    v = [f"w{i}" for i in range(5000)]
    texts = Held([" ".join(r.choices(v, k=500)) for _ in range(1000)])
    n, peak = peak_mb(texts.mapInArrow(jaccard._keys(jaccard.Rule(5, 80, 100)), None))
    assert n > 150_000 and peak < 16


def test_what_goes_to_spark_goes_in_pieces():
    whole = pa.RecordBatch.from_arrays([pa.array(range(100_000)), pa.array(["x" * 100] * 100_000)], names=["a", "b"])
    got = list(kernels.tidy(lambda batches: batches)(iter([whole, whole.slice(0, 0)])))
    assert max(b.nbytes for b in got) <= 1.1 * kernels.PIECE_BYTES
    assert pa.Table.from_batches(got) == pa.Table.from_batches([whole])


def test_batches_of_a_table_are_bounded_in_bytes(spark, tmp_path):
    docs(spark, ["x" * 10_000] * 1500).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches)
    got = [r.n for r in queries.table(spark, str(tmp_path), "documents").select("text").mapInArrow(sizes, "n bigint").collect()]
    assert sum(got) > 15_000_000 and max(got) < 2_200_000
