"""Token ids packed into fixed-length rows and written as binary matrices.

Each task tokenizes its documents, cuts those longer than a row into pieces
(nothing is lost), and packs the pieces of a bounded pool by best fit in
decreasing order; a segment tree over free capacities finds the fullest row in
which a piece still fits.  A pool becomes one shard of three files: the id
matrix, the position ids, which begin again at 0 with every piece, and the
cumulative lengths of the pieces in each row.  Shards are written through
``pyarrow.fs`` under names of their own and count only when the manifest lists
them, so a repeated task leaves no second copy.

Edge cases: a null or empty text has no tokens and no piece (its row says so);
equal lengths are packed in order of arrival; repeated rows are packed as often
as they occur; an empty table gives no shard and no row.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from rasterlake.session import materialize

POOL_TOKENS = 4_000_000
PAD = 50256  # free in the vocabulary file
MANIFEST = "path string, n_rows bigint, row_len int, doc_ids array<bigint>, doc_tokens array<bigint>, piece_doc array<int>, piece_row array<int>, piece_start array<int>, piece_len array<int>"


class Capacities:
    """Segment tree over free capacities 0..n: how many rows have each."""

    def __init__(self, n: int) -> None:
        self.base = 1 << n.bit_length()
        self.tree = [0] * (2 * self.base)

    def add(self, capacity: int, by: int) -> None:
        at = capacity + self.base
        while at:
            self.tree[at] += by
            at >>= 1

    def least_from(self, size: int) -> int:
        """Smallest capacity of at least ``size`` that some row has, or -1."""
        at = size + self.base
        if self.tree[at]:
            return size
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.base:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.base
            at >>= 1
        return -1


def best_fit(sizes: list[int], row_len: int) -> tuple[list[tuple[int, int]], int]:
    """(row, start) of each piece, and the number of rows."""
    tree, free, place, rows = Capacities(row_len), {}, [(0, 0)] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        capacity = tree.least_from(sizes[i]) if sizes[i] < row_len else -1
        if capacity < 0:
            row, capacity, rows = rows, row_len, rows + 1
        else:
            row = free[capacity].pop()
            tree.add(capacity, -1)
        place[i] = (row, row_len - capacity)
        left = capacity - sizes[i]
        if left:
            free.setdefault(left, []).append(row)
            tree.add(left, 1)
    return place, rows


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pack(docs: DataFrame, folder: str, path: str, pattern: str, row_len: int = 2048, pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """Writes shards of ``docs(doc_id, text)``; returns their manifest, a row per shard."""
    base = folder if "://" in folder else "file://" + folder.removeprefix("file:")

    def shard(fs, root: str, ids: list, tokens: list[np.ndarray]) -> pa.RecordBatch:
        doc, lo, size = [], [], []
        for i, t in enumerate(tokens):
            for a in range(0, len(t), row_len):
                doc.append(i)
                lo.append(a)
                size.append(min(row_len, len(t) - a))
        place, rows = best_fit(size, row_len)
        matrix, position = np.full((rows, row_len), PAD, np.uint16), np.zeros((rows, row_len), np.uint16)
        ends: list[list[int]] = [[0] for _ in range(rows)]
        for (row, start), i, a, n in sorted(zip(place, doc, lo, size)):
            matrix[row, start : start + n] = tokens[i][a : a + n]
            position[row, start : start + n] = np.arange(n)
            ends[row].append(start + n)
        lengths = np.concatenate([np.array([len(e), *e], np.int32) for e in ends]) if ends else np.zeros(0, np.int32)
        name = f"{root}/{uuid.uuid4().hex}"
        for kind, value in (("ids", matrix), ("pos", position), ("cu", lengths)):
            with fs.open_output_stream(f"{name}.{kind}.bin") as f:
                f.write(value.tobytes())
        row = {"path": name, "n_rows": rows, "row_len": row_len, "doc_ids": ids, "doc_tokens": [len(t) for t in tokens], "piece_doc": doc, "piece_row": [p[0] for p in place], "piece_start": [p[1] for p in place], "piece_len": size}
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 4]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], names=list(row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(base)
        fs.create_dir(root, recursive=True)
        encode, ids, tokens, held = _encoder(path, pattern).encode_ordinary, [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = np.array(encode(text), np.uint16) if text else np.zeros(0, np.uint16)
                ids.append(doc_id)
                tokens.append(t)
                held += len(t)
                if held >= pool_tokens:
                    yield shard(fs, root, ids, tokens)
                    ids, tokens, held = [], [], 0
        if ids:
            yield shard(fs, root, ids, tokens)

    return materialize(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, MANIFEST), "packing")


def unpack(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, n_tokens, n_pieces, ids_sha256`` read back from the shards.

    Pieces are joined in order and hashed as decimal ids joined by commas;
    positions and cumulative lengths are checked against the manifest.
    """
    base = folder if "://" in folder else "file://" + folder.removeprefix("file:")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(base)
        for batch in batches:
            for r in batch.to_pylist():
                def load(kind: str, dtype) -> np.ndarray:
                    with fs.open_input_file(f"{r['path']}.{kind}.bin") as f:
                        return np.frombuffer(f.read(), dtype)

                matrix, position = load("ids", np.uint16).reshape(-1, r["row_len"]), load("pos", np.uint16).reshape(-1, r["row_len"])
                lengths, at, marks = load("cu", np.int32), 0, []
                for row in range(r["n_rows"]):
                    n = int(lengths[at])
                    marks += [(row, s) for s in lengths[at + 1 : at + n].tolist()]
                    at += 1 + n
                if sorted(marks) != sorted(zip(r["piece_row"], r["piece_start"])):
                    raise ValueError(f"{r['path']}: cumulative lengths do not match the pieces")
                parts: list[list[np.ndarray]] = [[] for _ in r["doc_ids"]]
                for d, row, start, n in zip(r["piece_doc"], r["piece_row"], r["piece_start"], r["piece_len"]):
                    if position[row, start] != 0 or position[row, start + n - 1] != n - 1:
                        raise ValueError(f"{r['path']}: positions do not begin again")
                    parts[d].append(matrix[row, start : start + n])
                sha = [hashlib.sha256(",".join(map(str, np.concatenate(p).tolist())).encode() if p else b"").hexdigest() for p in parts]
                cols = [pa.array(r["doc_ids"], pa.int64()), pa.array([sum(map(len, p)) for p in parts], pa.int64()), pa.array([len(p) for p in parts], pa.int32()), pa.array(sha)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "n_pieces", "ids_sha256"])

    n = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    return manifest.repartition(n).mapInArrow(run, "doc_id bigint, n_tokens bigint, n_pieces int, ids_sha256 string")
