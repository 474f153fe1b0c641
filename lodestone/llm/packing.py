"""Best-fit packing of tokenised documents into sequences by large-item matching.

Pieces over a third of the capacity pair at most twice per sequence by greedy matching (each with the largest that still
fits); smaller pieces go, longest first, where they leave the least room. The plan is made for lengths, not for rows:
a length has a count, and equal sequences are one entry with a number, so that the plan is bounded by the capacity
whatever the number of documents. Rows then find their place by their rank among the pieces of their length.

Nulls and edges: a null or empty text is the end id alone; repeated rows are packed each for itself; a null doc_id is kept;
an empty table gives an empty table; other columns are left alone. A document over the capacity is cut, no other is.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, WordHashes, flat, materialise, text_slices, texts_of

SALT_ROWS = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Known:
    """Ids of words under their 64-bit hashes: sorted hashes, and where in ``ids`` each word's ids begin and how many there are."""

    def __init__(self, hashes=(), at=(), n=(), ids=()):
        self.hashes, self.at, self.n, self.ids = np.array(hashes, U64), np.array(at, np.int64), np.array(n, np.int64), np.array(ids, "<u4")

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where there is none."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[place] == hashes, place, -1)

    def ids_at(self, place: int) -> bytes:
        return self.ids[self.at[place] : self.at[place] + self.n[place]].tobytes()

    def with_more(self, hashes: np.ndarray, n: np.ndarray, ids: np.ndarray) -> Known:
        """These and others, whose ids stand one after another."""
        every = np.concatenate([self.hashes, hashes])
        order = np.argsort(every, kind="stable")
        at = np.concatenate([self.at, len(self.ids) + np.cumsum(n) - n])
        return Known(every[order], at[order], np.concatenate([self.n, n])[order], np.concatenate([self.ids, ids]))


def gathered(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places at, at + 1, ... at + n - 1 of each, one after another."""
    return np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class WordIds:
    """Ids of white-space-separated words. The tokenizer splits at white space, so a text's ids are its words' ids in order.

    Words are known by their hashes, in two generations: when the younger is full it becomes the elder, and what is then met again returns.
    """

    bound = 500_000
    #: Signs that, after a letter or digit and up to a word's end, are split off as one piece (the apostrophe is not among them).
    marks = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    #: A special token that parts words in one call of the encoder; words that may spell one go alone.
    parting = "<|endoftext|>"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.parting_id = self.encoder.token_to_id(self.parting)
        self.hashes = WordHashes(2)
        self.young, self.old = Known(), Known()

    def encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Little-endian ids of each word from the encoder."""
        alone = [w for w in words if b"<|" in w] if self.parting_id is not None else words
        found = {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(alone, self.encoder.encode_batch_fast([w.decode() for w in alone], add_special_tokens=False), strict=True)}
        words = [w for w in words if w not in found] if alone else words
        for at in range(0, len(words), 20_000):
            groups = [words[k : k + 200] for k in range(at, min(at + 20_000, len(words)), 200)]
            texts = [self.parting.join(w.decode() for w in g) for g in groups]
            for g, e in zip(groups, self.encoder.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                cut, raw = np.flatnonzero(ids == self.parting_id) * 4, ids.tobytes()
                for w, a, b in zip(g, [0, *(cut + 4).tolist()], [*cut.tolist(), len(raw)], strict=True):
                    found[w] = raw[a:b]
        return found

    def learn(self, words: list[bytes]) -> None:
        """Add different words that are not known; end marks are looked up apart."""
        split: dict[bytes, tuple[bytes, ...]] = {}
        for w in words:
            n = len(w.rstrip(self.marks))
            split[w] = (w[:n], w[n:]) if n < len(w) and w[n - 1 : n].isalnum() and b"<|" not in w else (w,)
        parts = list({p for both in split.values() for p in both})
        h = self.hashes.of(parts)
        young, old = self.young.find(h), self.old.find(h)
        new = [p for p, i, j in zip(parts, young.tolist(), old.tolist(), strict=True) if i < 0 and j < 0]
        ids = self.encode(new)
        for p, i, j in zip(parts, young.tolist(), old.tolist(), strict=True):
            if i >= 0 or j >= 0:
                ids[p] = self.young.ids_at(i) if i >= 0 else self.old.ids_at(j)
        more = dict.fromkeys([*(p for p, i in zip(parts, young.tolist(), strict=True) if i < 0), *words])
        raw = [ids[w] if w in ids else b"".join(ids[p] for p in split[w]) for w in more]
        self.young = self.young.with_more(self.hashes.of(list(more)), np.fromiter(map(len, raw), np.int64, len(raw)) // 4, np.frombuffer(b"".join(raw), "<u4"))

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, how many each word has)."""
        if not words:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        if len(self.young.hashes) > self.bound:
            self.young, self.old = Known(), self.young
        kinds, first, which = np.unique(self.hashes.of(words), return_index=True, return_inverse=True)
        unknown = self.young.find(kinds) < 0
        back = self.old.find(kinds[unknown])
        again, lost = back[back >= 0], first[unknown][back < 0]
        if len(again):
            self.young = self.young.with_more(self.old.hashes[again], self.old.n[again], self.old.ids[gathered(self.old.at[again], self.old.n[again])])
        if len(lost):
            self.learn([words[i] for i in lost.tolist()])
        place = self.young.find(kinds)
        n = self.young.n[place][which]
        return self.young.ids[gathered(self.young.at[place][which], n)], n


def lowered(text: bytes) -> bytes:
    """The tokenizer lowers letters anyway; a text that may spell a special token keeps its case."""
    return text if b"<|" in text else text.lower()


_word_ids: dict[str, WordIds] = {}


def cut_pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if tokenizer not in _word_ids:
        _word_ids[tokenizer] = WordIds(tokenizer)
    known = _word_ids[tokenizer]
    end, most = np.array([end_id], "<u4").tobytes(), 4 * capacity
    for batch in text_slices(batches):
        rows: list[tuple] = []
        words, lens = flat([lowered(x).split() for x in texts_of(batch)])
        ids, n = known.of(words)
        upto = np.r_[0, np.cumsum(n)][np.cumsum(lens)]
        at = 0
        for doc_id, to in zip(batch.column("doc_id").to_pylist(), upto.tolist(), strict=True):
            whole = ids[at:to].tobytes() + end
            at = to
            for k, a in enumerate(range(0, len(whole), most)):
                part = whole[a : a + most]
                rows.append((doc_id, k, a // 4, len(part) // 4, zlib.crc32(part)))
        cols = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])


def plan_sequences(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in one sequence, how many such sequences)] for so many pieces of each length.

    Each step uses up a length or a kind of gap, so the plan has a few entries for each length at most.
    """
    third = capacity / 3
    large = sorted(n for n in counts if n > third and counts[n] > 0)
    left = {n: counts[n] for n in counts if counts[n] > 0}
    gaps: dict[int, list[list]] = defaultdict(list)  # room -> [[lengths, how many]]
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, capacity - a) - 1
        b = large[at] if at >= 0 else None
        if b == a and left[a] < 2:
            b = large[at - 1] if at > 0 else None
        if b is None:
            m = left[a]
            gaps[capacity - a].append([(a,), m])
            left[a] = 0
        else:
            m = left[a] // 2 if a == b else min(left[a], left[b])
            gaps[capacity - a - b].append([(a, b), m])
            left[a] -= m
            left[b] -= m
        for n in {a, b} - {None}:
            if not left[n]:
                large.remove(n)
    rooms = sorted(gaps)
    for n in sorted((n for n in left if n <= third and left[n]), reverse=True):
        todo = left[n]
        while todo:
            at = bisect.bisect_left(rooms, n)
            if at == len(rooms):
                each = capacity // n
                full, rest = divmod(todo, each)
                for k, m in ((each, full), (rest, 1 if rest else 0)):
                    if k and m:
                        room = capacity - k * n
                        if not gaps[room]:
                            bisect.insort(rooms, room)
                        gaps[room].append([(n,) * k, m])
                break
            room = rooms[at]
            kind = gaps[room].pop()
            if not gaps[room]:
                rooms.pop(at)
            lengths, m = kind
            k = min(room // n, -(-todo // m)) if todo >= m else 1  # so many of this length go into each of m sequences
            use = min(m, todo // k)
            if use < m:
                if not gaps[room]:
                    bisect.insort(rooms, room)
                gaps[room].append([lengths, m - use])
            if not gaps[room - k * n]:
                bisect.insort(rooms, room - k * n)
            gaps[room - k * n].append([lengths + (n,) * k, use])
            todo -= use * k
    return [(tuple(x), m) for room in sorted(gaps) for x, m in gaps[room] if m]


def placements(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, step, offset): ranks r of that length lie in sequence first + (r - first rank)."""
    seen: dict[int, int] = defaultdict(int)
    out, base = [], 0
    for lengths, m in plan:
        offset = 0
        for n in lengths:
            out.append((n, seen[n], m, base, 1, offset))
            seen[n] += m
            offset += n
        base += m
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, salts: int = 256) -> DataFrame:
    """Pieces of all documents with sequence_id and offset. Only counts by length (``capacity`` of them at most) come to the driver.

    A rank is counted within (length, salt) and moved by the counts of the salts before, so that one frequent length is no single group;
    salts go round by row, whatever the ids, and there is one for each ``SALT_ROWS`` pieces, ``salts`` at least.
    """
    spark = docs.sparkSession
    cut = docs.select("doc_id", "text").mapInArrow(lambda batches: cut_pieces(batches, tokenizer, capacity, end_id), PIECES)
    pieces = materialise(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    salts = max(salts, pieces.count() // SALT_ROWS)
    pieces = pieces.withColumn("salt", F.pmod("row", F.lit(salts)).cast("int"))
    by_salt = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_salt.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = placements(plan_sequences(counts, capacity))
    places = spark.createDataFrame(plan, "length long, rank0 long, ranks long, sequence0 long, step int, offset long").drop("step")
    before = by_salt.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")) - 1
    ranked = pieces.withColumn("inside", inside).join(before, ["length", "salt"]).withColumn("rank", F.col("inside") + F.col("before"))
    p = F.broadcast(places.withColumnRenamed("length", "of"))
    at = (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("rank0")) & (F.col("rank") < F.col("rank0") + F.col("ranks"))
    return ranked.join(p, at).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence0") + F.col("rank") - F.col("rank0")).alias("sequence_id"), "offset")
