import hashlib
import io
import struct
import zipfile

import numpy as np
import pytest

import corpus_pipeline
from rasterlake.llm import ann, warczip

PAGES = [(1, "http://a/x y", "p" * 200, 5), (2, None, "p" * 200, 5), (3, "u", "short", 5), (4, "u", "short", 5), (5, "u", None, 5), (None, "u", "é" * 60, 5), (7, "u", "é" * 60, 5)]


def test_records_come_back_and_copies_are_revisits(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string, refers_to int")
    got = warczip.round_trip(pages, package_bytes=300).collect()
    want = {(i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if i == 2 else "response", 1 if i == 2 else None) for i, _, h, _ in PAGES if i is not None}
    seen = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got if r.page_id is not None}
    assert seen == want and len(got) == len(PAGES)
    assert warczip.round_trip(pages.limit(0)).count() == 0


def test_zip64_directories_are_read():
    body, out = b"hello" * 10, io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", b"x")
        z.writestr("b", body)
    raw = out.getvalue()
    end = raw.rfind(b"PK\x05\x06")
    count, size, begin = struct.unpack("<HII", raw[end + 10 : end + 20])
    directory, pos, wide = raw[begin : begin + size], 0, b""
    for _ in range(count):
        head = bytearray(directory[pos : pos + 46])
        packed, plain, n = struct.unpack("<IIH", bytes(head[20:30]))
        offset = struct.unpack("<I", bytes(head[42:46]))[0]
        head[20:28], head[30:32], head[42:46] = b"\xff" * 8, struct.pack("<H", 28), b"\xff" * 4
        wide += bytes(head) + directory[pos + 46 : pos + 46 + n] + struct.pack("<HHQQQ", 1, 24, plain, packed, offset)
        pos += 46 + n
    end64 = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, count, count, len(wide), begin)
    locator = struct.pack("<IIQI", 0x07064B50, 0, begin + len(wide), 1)
    end32 = struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    raw = raw[:begin] + wide + end64 + locator + end32
    members = warczip.zip_members(io.BytesIO(raw), len(raw))
    at, n, method = members["b"]
    assert raw[at : at + n] == body and method == 0


def test_damaged_payload_is_refused():
    good = warczip.build_record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None)
    assert warczip.parse_record(good)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warczip.parse_record(warczip.build_record(1, "u", b"abd", hashlib.sha256(b"abc").hexdigest(), None))


def test_neighbours_reach_recall(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    x = [(centres[i % 12] + 0.4 * rng.normal(size=16)).astype(np.float32).tolist() for i in range(900)]
    x[3:8] = [x[0]] * 5
    rows = list(enumerate(x)) + [(1000, None), (1100, [0.0] * 16), (1200, [float("nan")] * 16), (1300, [1.0, 2.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), every=100).collect()
    v, hit, total = np.array(x), 0, 0
    for q in range(0, 900, 100):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(900), d))[:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and all(abs(s - d[i]) < 1e-9 for _, i, s in mine)
        hit, total = hit + len(set(want) & {m[1] for m in mine}), total + 10
    assert hit / total >= 0.9 and {r.query_id for r in got} == set(range(0, 900, 100))
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 0][:5] == [3, 4, 5, 6, 7]


def test_pipeline_stages_take_effect(spark, tmp_path):
    clean = [" ".join(f"c{i}w{j}" for j in range(40)) for i in range(30)]
    item = " ".join(f"item{j}" for j in range(30))
    rude = [" ".join([f"r{i}w{j}" for j in range(20)] + ["vile", "nasty"]) for i in range(30)]
    texts = [*clean, clean[0], clean[1] + " more", clean[2] + " " + item, "mail me at a.b@c.de", *rude, None, ""]
    d = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(d, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(34 <= i < 64)) for i in range(64)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {*range(30), 33, 64, 65}
    assert got[33].decoded_sha256 == hashlib.sha256(b"mail me at [EMAIL]").hexdigest()
