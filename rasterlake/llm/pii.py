"""Personal data: base patterns plus bootstrapped contextual extraction.

The base patterns find entities.  Candidates are all other tokens, of any length
and with or without digits, in the context of a pattern that known entities
have.  Every occurrence has lexical patterns, the words before and after it.
Spark then scores the graph of patterns and instances in rounds: entities that
are known give a pattern its confidence for a kind (the share of the pattern's
occurrences that are known entities of that kind), patterns of high confidence
give instances a noisy-or score, and instances of high score are known in the
next round.  The final patterns' instances become further spans.

Edge cases: null and empty texts have no entities; ties of start go by kind in
the listed order; repeated rows give repeated results; an empty table gives an
empty table; further columns pass through ``redact`` and are else ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rasterlake.llm import contexts, idfilter
from rasterlake.llm.kernels import tidy
from rasterlake.session import materialize

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# the look-behinds and possessive runs only cut repeated work in long digit runs
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
SEED = re.compile(r"[0-9@]")  # every base span has one
SPACES = re.compile(r"([\x20\x09-\x0D]+)")
LEAD, TRAIL = "\"'([{<.,;:", "\"')]}>.,;:!?"
# between two tokens, so much that the word before may be cut by the context's bound
WIDE = re.compile(r"[\x20\x09-\x0D\"'(\[{<.,;:]{8}")
WORD = re.compile(r"\w+")
CONTEXT_CHARS = 48
CACHE = 100_000
#: Parts of the texts, of 1024, in which too frequent patterns are found.
PARTS = (4, 64)
SPAN = "array<struct<kind:string,start:int,end:int>>"
CANDIDATE = "array<struct<kind:string,start:int,end:int,patterns:array<string>>>"


def luhn(digits: str) -> bool:
    """The public check-digit rule of payment cards."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their at-signs."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        head = text[floor:at]
        start = floor + len(head.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        floor = at + 1
        if m:
            out.append((start, m.end()))
            floor = m.end()
        at = text.find("@", floor)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base patterns, sorted."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of an occurrence: two words before, one before and one after."""
    before = WORD.findall(text[max(0, start - CONTEXT_CHARS) : start].lower())[-2:]
    after = WORD.findall(text[end : end + CONTEXT_CHARS].lower())[:1]
    out = []
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    if before and text[start - 2 : start].strip(" ") in (":", "=", "#"):
        out.append(f"{before[-1]}: _")
    return out


class Lookup(dict):
    """Answers of ``test`` by key, kept up to a bound."""

    def __init__(self, test) -> None:
        super().__init__()
        self.test = test

    def __missing__(self, key: str):
        value = self.test(key)
        if len(key) <= 64:
            if len(self) > CACHE:
                self.clear()
            self[key] = value
        return value


def tail_test(known):
    """Whether the word before a token that follows ``token`` may be one that ``known`` accepts.

    True as well where that word cannot be told from ``token`` alone.
    """

    def test(token: str) -> bool:
        low, m = token.lower(), None
        if low.isalnum():
            return len(low) > CONTEXT_CHARS - 8 or known(low)
        for m in WORD.finditer(low):
            pass
        return m is None or len(low) - m.start() > CONTEXT_CHARS - 8 or known(m.group())

    return test


def trim(token: str) -> tuple[int, int]:
    """Where a token begins and ends without the punctuation around it."""
    start = len(token) - len(token.lstrip(LEAD))
    return start, start + len(token[start:].rstrip(TRAIL))


def candidates(text: str, base: list[tuple[int, int, int]], tails: Lookup | None = None, own: Lookup | None = None) -> list[tuple[int, int]]:
    """Tokens of any kind and length that overlap no base span.

    With ``tails`` only those after a token that it accepts, with ``own`` only
    those that it accepts themselves.
    """
    pieces = SPACES.split(text)  # tokens, and the space between them
    tokens = pieces[::2]
    if own is not None:
        some = [i for i, f in enumerate(map(own.__getitem__, tokens)) if f and i]
    elif tails is not None and not WIDE.search(text):
        some = [i + 1 for i, f in enumerate(map(tails.__getitem__, tokens[:-1])) if f]
    else:
        some = range(1, len(tokens))  # a first token has no word before it
    if not some:
        return []
    taken: list[list[int]] = []
    for s, _, e in base:
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    ends = list(accumulate(map(len, pieces)))
    out, k = [], 0
    for i in some:
        a, z = trim(tokens[i])
        at = ends[2 * i - 1]
        s, e = at + a, at + z
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if s < e and not (k < len(taken) and taken[k][0] < e):
            out.append((s, e))
    return out


def instance_of(text: str, start: int, end: int) -> str:
    """The token in lower case; a digest stands for a long one."""
    low = text[start:end].lower()
    return low if len(low) <= 64 else "\0" + hashlib.blake2b(low.encode(), digest_size=16).hexdigest()


def _bit_test(packed: np.ndarray, prefix: str):
    """Whether a string may be in a bit set built from the crc32 of ``prefix`` and the string."""
    bits = packed.tobytes()

    def test(s: str) -> bool:
        slot = idfilter.slot(zlib.crc32((prefix + s).encode()))
        return bool(bits[slot >> 3] >> (7 - (slot & 7)) & 1)

    return test


def _code(prefix: str, col):
    return F.crc32(F.concat(F.lit(prefix), col).cast("binary")).alias("id")


def _pattern_set(wanted: DataFrame):
    """Bit set of ``pattern``, as text and as ``contexts`` hashes its words."""
    return idfilter.build(wanted.select(_code("p", F.col("pattern"))).unionByName(wanted.select("pattern").mapInArrow(contexts.pattern_ids, "id bigint")))


def _marked(texts: list[str | None], bits: np.ndarray) -> Iterator[tuple[str | None, list[tuple[int, int]]]]:
    """Each text and its tokens that may have a pattern of the set; base spans are not looked at."""
    for lo, hi in contexts.pieces([t or "" for t in texts]):
        part = texts[lo:hi]
        yield from zip(part, contexts.marked([t or "" for t in part], bits, LEAD, TRAIL, CONTEXT_CHARS))


def _apart(some: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Those of the sorted ``some`` that overlap no base span."""
    if not base or not some:
        return some
    reach, out, k = 0, [], 0
    for s, e in some:
        while k < len(base) and base[k][0] < e:
            reach = max(reach, base[k][2])
            k += 1
        if reach <= s:
            out.append((s, e))
    return out


def _occurrences(texts: DataFrame, sent=None, by: str = "base") -> DataFrame:
    """``kind, instance, pattern, n``, counted in each batch.

    By "base" the base spans, and the other tokens that may be equal to one; by
    "pattern" base spans and tokens, with the patterns of the set; by "instance"
    base spans and tokens whose instance is in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if by == "pattern":
            listed = Lookup(_bit_test(sent.value, "p"))
        elif by == "instance":
            listed = Lookup(_bit_test(sent.value, "i"))
            own = Lookup(lambda t: listed[instance_of(t, *trim(t))])
        else:
            own = Lookup(lambda t: SEED.search(t) is not None)
        for batch in batches:
            counts: Counter = Counter()
            texts = batch.column(0).to_pylist()
            for text, some in _marked(texts, sent.value) if by == "pattern" else ((t, None) for t in texts):
                base = base_spans(text)
                seen = [(KINDS[k], s, e) for s, k, e in base]
                if by == "pattern":
                    seen += [(None, s, e) for s, e in _apart(some, base)]
                elif by == "instance" or SEED.search(text):
                    seen += [(None, s, e) for s, e in candidates(text, base, own=own)]
                for kind, s, e in seen:
                    if by == "instance" and not listed[instance_of(text, s, e)]:
                        continue
                    found = patterns(text, s, e)
                    if by == "pattern":
                        found = [p for p in found if listed[p]]
                    if found:
                        instance = instance_of(text, s, e)
                        counts.update((kind, instance, p) for p in found)
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(3)), pa.array([counts[k] for k in keys], pa.int64())], names=["kind", "instance", "pattern", "n"])

    return texts.mapInArrow(tidy(run), "kind string, instance string, pattern string, n bigint")


def _rarer(texts: DataFrame, wanted: DataFrame, confidence: float) -> tuple[DataFrame, DataFrame]:
    """Those of ``wanted(pattern, pos)`` that ``pos`` occurrences may make confident, and ``pattern, least`` of the others.

    Patterns of frequent words get their known instances by chance, and have far more
    other occurrences.  ``PARTS`` of the texts, each larger than the one before, are
    looked at first; a pattern with too many occurrences there has as many in all, so
    none is dropped that could be confident, and no step reads many more occurrences
    than there are texts or known ones.
    """
    gone = None
    for part in PARTS:
        some = texts.filter(F.pmod(F.xxhash64("__text"), F.lit(1024)) < part)
        found = _occurrences(some, _pattern_set(wanted), "pattern").groupBy("pattern").agg(F.sum("n").alias("least"))
        seen = materialize(wanted.join(found, "pattern", "left"), "pii")
        over = F.coalesce(F.col("least") * confidence > F.col("pos") + 1, F.lit(False))
        dropped = seen.filter(over).select("pattern", "least")
        gone = dropped if gone is None else gone.unionByName(dropped)
        wanted = seen.filter(~over).select("pattern", "pos")
    return wanted, gone


def learn(docs: DataFrame, rounds: int = 3, confidence: float = 0.8, support: int = 3) -> DataFrame:
    """``pattern, kind, conf`` after some rounds over the texts.

    A pattern needs ``support`` different known instances; all its other
    occurrences, whatever token stands there, count against it.  Each round
    first finds the patterns with enough known instances, leaves out those
    whose occurrences in a part of the texts are too many already, and then reads
    every occurrence of the others; no text is shuffled.
    """
    texts = docs.filter("text is not null and text <> ''").select(F.col("text").alias("__text"))
    grouped = lambda o: o.groupBy("pattern", "instance").agg(F.sum("n").alias("n"), F.max("kind").alias("seed"))
    read = materialize(grouped(_occurrences(texts)), "pii")
    seeds = materialize(read.filter("seed is not null").select("instance", F.col("seed").alias("kind")).distinct(), "pii")
    # with the tokens equal to a seed that are no base span themselves
    first = materialize(read.join(seeds.select("instance").distinct(), "instance", "left_semi"), "pii")
    held, known, over = first, seeds, None
    for i in range(rounds):
        wanted = held.join(known, "instance").groupBy("pattern", "kind").agg(F.count_distinct("instance").alias("c"), F.sum("n").alias("pos")).filter(F.col("c") >= support)
        wanted = wanted.groupBy("pattern").agg(F.max("pos").alias("pos"))
        if over is not None:  # what the rounds before counted
            wanted = wanted.join(over.groupBy("pattern").agg(F.max("least").alias("least")), "pattern", "left").filter(~F.coalesce(F.col("least") * confidence > F.col("pos") + 1, F.lit(False)))
        wanted = materialize(wanted.select("pattern", "pos"), "pii")
        if not wanted.isEmpty():
            wanted, gone = _rarer(texts, wanted, confidence)
        if wanted.isEmpty():
            return known.select(F.col("instance").alias("pattern"), "kind", F.lit(0.0).alias("conf")).limit(0)
        over = gone if over is None else over.unionByName(gone)
        edges = grouped(_occurrences(texts, _pattern_set(wanted), "pattern").join(wanted, "pattern", "left_semi"))
        edges = materialize(edges, "pii")
        total = edges.groupBy("pattern").agg(F.sum("n").alias("total"))
        votes = edges.join(known, "instance").groupBy("pattern", "kind").agg(F.sum("n").alias("pos"), F.count("*").alias("support"))
        kept = votes.filter(F.col("support") >= support).join(total, "pattern").withColumn("conf", F.col("pos") / F.col("total")).filter(F.col("conf") >= confidence)
        kept = materialize(kept.select("pattern", "kind", "conf"), "pii")
        if i + 1 == rounds:
            break
        scored = edges.filter("seed is null").join(kept, "pattern").groupBy("instance", "kind").agg(F.sum(F.log(1.0 - F.least("conf", F.lit(0.99)))).alias("miss"))
        best = scored.filter(1 - F.exp("miss") >= confidence).groupBy("instance").agg(F.max_by("kind", F.struct(-F.col("miss"), F.col("kind"))).alias("kind"))
        best = materialize(best, "pii")
        now = materialize(seeds.unionByName(best).distinct(), "pii")
        if best.isEmpty() or (now.exceptAll(known).isEmpty() and known.exceptAll(now).isEmpty()):
            break  # a further round would repeat this one
        known = now
        found = _occurrences(texts, idfilter.build(best.select(_code("i", F.col("instance")))), "instance").join(best.select("instance"), "instance", "left_semi")
        held = materialize(grouped(found).join(first.select("pattern", "instance"), ["pattern", "instance"], "left_anti").unionByName(first), "pii")
    return kept


def _applied(learned: DataFrame) -> dict[str, tuple[float, str]] | None:
    """Confidence and kind by pattern, None if there are more than are broadcast."""
    hit = learned.groupBy("pattern").agg(F.max_by("kind", F.struct("conf", "kind")).alias("kind"), F.max("conf").alias("conf"))
    rows = hit.limit(MAX_APPLIED + 1).collect()
    return {r["pattern"]: (r["conf"], r["kind"]) for r in rows} if len(rows) <= MAX_APPLIED else None


def _tails(table: dict) -> Lookup:
    """The words before tokens of the table's patterns."""
    words = {w for p in table for a, b in [p.split(" ")[:2]] for w in (a, b, a.removesuffix(":"))}
    return Lookup(tail_test(words.__contains__))


def _discovered(text: str, base: list, table: dict, tails: Lookup) -> list[tuple[int, int, str]]:
    """Spans of the table's patterns."""
    out = []
    for s, e in candidates(text, base, tails) if table else ():
        hits = [table[p] for p in patterns(text, s, e) if p in table]
        if hits:
            out.append((s, e, max(hits)[1]))
    return out


def _scan(table: dict | None, marks=None):
    """(row, doc_id, text) to base spans, and discovered ones or, without a table, candidates with a pattern of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if table is None:
            listed = Lookup(_bit_test(marks.value, "p"))
        else:
            given = table.value
            tails = _tails(given)
        for batch in batches:
            base_col, found_col = [], []
            texts = batch.column(2).to_pylist()
            for text, some in _marked(texts, marks.value) if table is None else ((t, None) for t in texts):
                base = base_spans(text) if text else []
                base_col.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in base])
                if not text:
                    found_col.append([])
                elif table is None:
                    found_col.append([{"kind": None, "start": s, "end": e, "patterns": f} for s, e in _apart(some, base) if (f := [p for p in patterns(text, s, e) if listed[p]])])
                else:
                    found_col.append([{"kind": k, "start": s, "end": e, "patterns": []} for s, e, k in _discovered(text, base, given, tails)])
            kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
            cand = pa.struct([*kind, ("patterns", pa.list_(pa.string()))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(base_col, pa.list_(kind)), pa.array(found_col, pa.list_(cand))], names=["row", "doc_id", "base", "found"])

    return run


def _joined(keyed: DataFrame, learned: DataFrame) -> DataFrame:
    """``row, doc_id, base, more`` of ``(row, doc_id, text)`` for more patterns than are broadcast."""
    seen = materialize(keyed.mapInArrow(tidy(_scan(None, _pattern_set(learned.select("pattern").distinct()))), f"row string, doc_id bigint, base {SPAN}, found {CANDIDATE}"), "pii")
    occ = seen.select("row", F.explode("found").alias("f")).select("row", "f.start", "f.end", F.explode("f.patterns").alias("pattern"))
    fresh = occ.join(learned, "pattern").groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("conf", "kind")).alias("kind"))
    fresh = fresh.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))  # at most one row's spans
    return seen.select("row", "doc_id", "base").join(fresh, "row", "left").withColumn("more", F.coalesce("more", F.expr(f"cast(array() as {SPAN})")))


def extract(docs: DataFrame, rounds: int = 3, confidence: float = 0.8, support: int = 3) -> DataFrame:
    """``row, doc_id, base, spans``: base spans, and all spans with the discovered ones.

    ``row`` is new and unique.  A discovered span has the kind of its most
    confident pattern.
    """
    learned = learn(docs, rounds, confidence, support)
    table = _applied(learned)
    rows = docs.select(F.expr("uuid()").alias("row"), "doc_id", F.col("text").alias("__text"))
    if table is None:
        seen = _joined(materialize(rows, "pii"), learned)
    else:
        sent = docs.sparkSession.sparkContext.broadcast(table)
        seen = rows.mapInArrow(tidy(_scan(sent)), f"row string, doc_id bigint, base {SPAN}, found {CANDIDATE}")
        seen = seen.select("row", "doc_id", "base", F.expr("transform(found, s -> struct(s.kind as kind, s.start as start, s.end as end))").alias("more"))
    rank = F.expr("transform(concat(base, more), s -> struct(s.start as start, array_position(array('email','ip','card','phone'), s.kind) as k, s.end as end, s.kind as kind))")
    spans = F.expr("transform(array_sort(ranked), s -> struct(s.kind as kind, s.start as start, s.end as end))")
    return seen.withColumn("ranked", rank).select("row", "doc_id", "base", spans.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``doc_id, base, spans``."""

    def listed(col: str):
        return F.concat_ws(",", F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with every span replaced by its kind in brackets; overlaps merge."""
    out, floor = [], 0
    for s, e, kind in sorted(spans):
        if s >= floor:
            out += [text[floor:s], f"[{kind.upper()}]"]
        floor = max(floor, e)
    return "".join([*out, text[floor:]])


def redact(docs: DataFrame, rounds: int = 3, confidence: float = 0.8, support: int = 3) -> DataFrame:
    """``docs`` with personal data masked in ``text`` and ``n_chars`` set anew.

    The learned patterns are applied in the task that scans a text again, so no
    text is shuffled; they are broadcast when small, as adaptive joins decide.
    """
    learned = learn(docs, rounds, confidence, support)
    table = _applied(learned)
    return _redact_joined(docs, learned) if table is None else _masked(docs, table)


MAX_APPLIED = 100_000


def _masked(docs: DataFrame, table: dict[str, tuple[float, str]]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(table)
    cols = docs.columns
    at = cols.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        tails = _tails(table)
        for batch in batches:
            out = []
            for text in batch.column(at).to_pylist():
                if text:
                    base = base_spans(text)
                    spans = [(s, e, KINDS[k]) for s, k, e in base]
                    spans += _discovered(text, base, table, tails)
                    text = mask(text, spans) if spans else text
                out.append(text)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(out, pa.string()), *batch.columns[at + 1 :]], names=cols)

    done = docs.mapInArrow(tidy(run), docs.schema)
    return done.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in cols else done


def _redact_joined(docs: DataFrame, learned: DataFrame) -> DataFrame:
    """``redact`` for more patterns than are broadcast: spans are joined to their rows."""
    keyed = materialize(docs.withColumn("__row", F.expr("uuid()")), "pii")
    seen = _joined(keyed.select(F.col("__row").alias("row"), "doc_id", F.col("text").alias("__text")), learned)
    spans = seen.select("row", F.expr("transform(concat(base, more), s -> struct(s.start as start, s.end as end, s.kind as kind))").alias("__spans"))
    cols = docs.columns
    at = cols.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans_at = batch.num_columns - 1
            out = [mask(t, [(s["start"], s["end"], s["kind"]) for s in sp or ()]) if t else t for t, sp in zip(batch.column(at).to_pylist(), batch.column(spans_at).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(out, pa.string()), *batch.columns[at + 1 : spans_at]], names=cols)

    joined = keyed.join(spans, keyed["__row"] == spans["row"], "left").select(*[keyed[c] for c in cols], "__spans")
    done = joined.mapInArrow(tidy(run), docs.schema)
    return done.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in cols else done
