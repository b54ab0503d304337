"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words stand in one flat array.  A round looks up every
adjacent pair by binary search over the sorted pair keys, takes the lowest rank
of each word with ``minimum.reduceat`` and merges all its occurrences.  Words
seen before come from a cache of the task, bounded in bytes.  A batch's texts are
taken in groups of bounded size, as their pieces need many times their bytes.

Edge cases: a null or empty text has no tokens (hash of the empty string);
texts of any length are encoded whole; repeated rows give repeated results; an
empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from rasterlake.llm.kernels import tidy

CACHE_BYTES = 24 << 20
ENTRY_BYTES = 200
#: Characters that are split at once (one text at least), and words that merge in the same rounds.
GROUP_CHARS, MERGE_WORDS = 1 << 18, 10_000
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, of_char = spec["model"]["vocab"], _byte_chars()
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split = regex.compile(pattern)
        self.added = added
        self.cut = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        top = max([*vocab.values(), *added.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * top
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(of_char[c] for c in token)
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        self.text_of = [str(i) for i in range(top)]
        self.id_of = list(range(top))  # one object an id, which all cached words share
        self.first = np.zeros(256, np.int64)
        for c, b in of_char.items():
            self.first[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        rank = np.arange(len(pairs), dtype=np.int64)
        born = np.full(top, -1, np.int64)
        born[made] = rank
        if len(np.unique(made)) < len(made) or (born[left] >= rank).any() or (born[right] >= rank).any():
            raise ValueError("a merge uses a token that a later merge makes")
        self.width, self.none = top, len(pairs)
        order = np.argsort(left * top + right)
        self.keys = np.append((left * top + right)[order], np.iinfo(np.int64).max)
        self.rank = np.append(rank[order], self.none)
        self.made = made
        self.cache: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def _ranks(self, sym: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each symbol; ``none`` where there is none."""
        out = np.full(len(sym), self.none, np.int64)
        key = sym[:-1] * self.width + sym[1:]
        at = np.searchsorted(self.keys, key)
        out[:-1] = np.where((self.keys[at] == key) & (word[1:] == word[:-1]), self.rank[at], self.none)
        return out

    def merge(self, tokens: list[str]) -> list[tuple[int, ...]]:
        """Ids of each word, all words in the same rounds."""
        raw = [t.encode() for t in tokens]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        sym = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), size)
        out: list[tuple[int, ...]] = [()] * len(raw)
        while len(sym):
            rank = self._ranks(sym, word)
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, begin)
            length = np.diff(np.append(begin, len(sym)))
            done = least == self.none
            if done.any():
                for b, n in zip(begin[done].tolist(), length[done].tolist()):
                    out[word[b]] = tuple(map(self.id_of.__getitem__, sym[b : b + n].tolist()))
                stay = np.repeat(~done, length)
                sym, word, rank = sym[stay], word[stay], rank[stay]
                least, length = least[~done], length[~done]
                if not len(sym):
                    break
            hit = rank == np.repeat(least, length)
            # of pairs that overlap (a run of one symbol) every second one merges
            at = np.flatnonzero(hit)
            run = np.append(True, (np.diff(at) > 1) | (word[at[1:]] != word[at[:-1]]))
            since = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[since % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, word = sym[keep], word[keep]
        return out

    def forget(self) -> None:
        """Empties the cache of words."""
        self.cache.clear()
        self.held = 0

    def _pieces(self, text: str) -> list[str]:
        if self.cut is None or not self.cut.search(text):
            return self.split.findall(text)
        out, last = [], 0
        for m in self.cut.finditer(text):
            out += self.split.findall(text[last : m.start()])
            out.append(m.group())
            last = m.end()
        return out + self.split.findall(text[last:])

    def encode_batch(self, batch: list[str]) -> list[list[int]]:
        """Ids of each text."""
        split = [self._pieces(t) for t in batch]
        seen = set(chain.from_iterable(split))
        if self.held > CACHE_BYTES:
            self.forget()
        fresh = [w for w in seen if w not in self.cache and w not in self.added]
        known = self.cache
        for lo in range(0, len(fresh), MERGE_WORDS):
            part = fresh[lo : lo + MERGE_WORDS]
            made = self.merge(part)
            known.update(zip(part, made))
            self.held += ENTRY_BYTES * len(part) + sum(map(len, part)) + 8 * sum(map(len, made))
        known.update((t, (i,)) for t, i in self.added.items())
        get = known.__getitem__
        return [list(chain.from_iterable(map(get, ws))) for ws in split]

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        """UTF-8 of the decoded text; broken sequences become U+FFFD."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBPE:
    """The encoder, made once in each Python worker."""
    return ByteBPE(path, pattern)


def _groups(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """Row ranges of about ``GROUP_CHARS`` characters and their texts; nulls are empty."""
    size = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)
    ends, lo = np.cumsum(size), 0
    while lo < len(column):
        before = ends[lo - 1] if lo else 0
        hi = min(len(column), int(np.searchsorted(ends, before + GROUP_CHARS)) + 1)
        yield lo, hi, [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
        lo = hi


def encoded(bpe: ByteBPE, batch: pa.RecordBatch, with_ids: bool = False) -> Iterator[pa.RecordBatch]:
    """The rows of ``encode`` for a batch of ``doc_id, text``."""
    for lo, hi, group in _groups(batch.column(1)):
        n, ids_sha, text_sha, kept = [], [], [], []
        for ids in bpe.encode_batch(group):
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(bpe.text_of.__getitem__, ids)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(bpe.decode_bytes(ids)).hexdigest())
            if with_ids:
                kept.append(ids)
        cols = [batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            cols, names = [*cols, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
        yield pa.RecordBatch.from_arrays(cols, names=names)


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: its token count and hashes.

    ``ids_sha256`` is over the decimal ids joined by commas, ``decoded_sha256``
    over the text decoded from those ids; ``with_ids`` adds the ids themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            yield from encoded(bpe, batch, with_ids)
        bpe.forget()

    return docs.select("doc_id", "text").mapInArrow(tidy(run), SCHEMA + ", ids array<int>" * with_ids)


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """Texts of ``tokens(doc_id, ids array<int>)``; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            out = [bpe.decode_bytes(ids or ()).decode() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id bigint, text string")
