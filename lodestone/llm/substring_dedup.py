"""Removal of repeated passages: recurring windows are confirmed, compiled into sharded automata, and located in the documents.

A window is 35 consecutive words; a word is removed when a window that covers it also starts somewhere else.

0. Of documents with the same words one goes on; all their words are removed, as each of their windows starts elsewhere too.
1. Each window is stood for by its anchor, the 8-word gram with the least hash in it (equal windows have equal anchors).
   Anchors that stand at two places or more are recurring; the rest of the text cannot hold a repeated window.
2. Windows with a recurring anchor are counted by hash. Those that come twice are confirmed, and the document with the least
   key that has one lends its words: its confirmed windows in a row make a passage.
3. Passages go to the shard of their anchor's owner (the least key among the documents with the anchor), and so does each
   stretch of a document that has such anchors; every document takes part, but meets only the shards it shares an anchor with.
   A shard cuts its passages into phrases of 18 words, one of which lies within any of their windows, compiles them into an
   Aho-Corasick automaton over words, and streams the stretches through it. A window around a find is removed if it is among
   the shard's confirmed windows. A shard with many passages or stretches is dealt out over several automata and tasks.

Windows are equal if two independent 64-bit hashes over their words are, in the counts as in the automata; rows are numbered,
and their texts found again by an md5 of doc_id and text. Anchors and texts that a large share of the rows have are joined
where their rows are (``skew_join``).

Nulls and edges: a null text has no words; texts under 35 words stay as they are; rows that repeat a doc_id are documents
of their own, so that an exactly repeated row repeats each of its windows; a null doc_id is kept; an empty table gives an
empty table; a very long text is searched whole, in stretches of whole windows; other columns are left alone and
may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, flat, gram_hashes, materialise, mix, skew_join, text_slices, texts_of
from .vectors import lists

WINDOW, GRAM = 35, 8
PHRASE = (WINDOW + 1) // 2
#: Bytes of passages in one automaton, and of stretches for one task.
AUTOMATON_BYTES, STRETCH_BYTES = 2 << 20, 8 << 20
LOW = np.uint64((1 << 24) - 1)
SCANNED = "doc_id long, rid long, key string, n_words long, sha string, anchors array<long>, starts array<int>, ends array<int>"
#: Grams that are placed at once: their places must fit into ``LOW``.
PLACED = 1 << 23
_hashes, _other_hashes = WordHashes(), WordHashes(seed=1)


def row_key() -> Column:
    """Tells rows apart by doc_id and text, null and empty ones too."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit("-"))))


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """Least of each ``n`` neighbours, by doubling."""
    span, got = 1, x
    while 2 * span <= n:
        got, span = np.minimum(got[: len(got) - span], got[span:]), 2 * span
    return np.minimum(got[: len(x) - n + 1], got[n - span : len(x) - span + 1])


def window_anchors(h: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows in the flat list of words, the place of the anchor of each, and the hashes of grams."""
    ends = np.cumsum(lens)
    of = np.repeat(np.arange(len(lens)), lens)
    if len(h) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = mix(gram_hashes(h, GRAM))
    reach, found = WINDOW - GRAM + 1, []
    for first in range(0, len(grams) - reach + 1, PLACED):
        some = grams[first : first + PLACED + reach - 1]
        # the place in the low bits breaks ties, the same way in equal windows
        key = (some & ~LOW) | np.arange(len(some), dtype=np.uint64)
        found.append((sliding_least(key, reach) & LOW).astype(np.int64) + first)
    at = np.concatenate(found)
    starts = np.arange(len(at))
    inside = starts + WINDOW <= ends[of[: len(at)]]
    return starts[inside], at[inside], grams


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document its words' digest and its anchors, each with the first and last window that it stands for."""
    for batch in text_slices(batches):
        split = [x.split() for x in texts_of(batch)]
        words, lens = flat(split)
        starts, at, grams = window_anchors(_hashes.of(words), lens)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
        last = np.r_[first[1:], len(at)] - 1 if len(first) else first
        base = np.cumsum(lens) - lens
        doc = np.searchsorted(base + lens, starts[first], side="right") if len(first) else first
        n = np.bincount(doc, minlength=len(lens)) if len(first) else np.zeros(len(lens), np.int64)
        cut = np.cumsum(n)[:-1]
        anchors = np.split(grams[at[first]].view(np.int64) if len(first) else np.zeros(0, np.int64), cut)
        i, j = (np.split((starts[x] - base[doc]) if len(first) else x, cut) for x in (first, last))
        sha = [hashlib.sha256(b" ".join(w)).hexdigest() for w in split]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("rid"), batch.column("key"), pa.array(lens), pa.array(sha), lists(anchors, pa.int64()), lists(i, pa.int32()), lists(j, pa.int32())], ["doc_id", "rid", "key", "n_words", "sha", "anchors", "starts", "ends"])


def chosen_windows(runs: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows with a recurring anchor, and the owner of each."""
    got = sorted({(r["i"], r["j"], r["owner"]) for r in runs})
    n = np.array([j - i + 1 for i, j, _ in got])
    starts = np.repeat(np.array([g[0] for g in got]), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return starts, np.repeat(np.array([g[2] for g in got]), n)


def documents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray, dict]]:
    """(rid, words, starts, owners, other columns) of each candidate document."""
    for whole in batches:
        for batch in text_slices([whole]):
            more = [c for c in batch.schema.names if c not in ("rid", "text", "runs")]
            cols = {c: batch.column(c) for c in more}
            for k, (rid, text, runs) in enumerate(zip(batch.column("rid").to_pylist(), texts_of(batch), batch.column("runs").to_pylist(), strict=True)):
                yield rid, text.split(), *chosen_windows(runs), {c: v[k].as_py() for c, v in cols.items()}


def window_hashes(words: list[bytes], hashes: WordHashes = _hashes) -> np.ndarray:
    return mix(gram_hashes(hashes.of(words), WINDOW)).view(np.int64)


def in_batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], most: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)


def candidate_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rid, words, starts, _, _ in documents_of(batches):
        w, v = window_hashes(words)[starts], window_hashes(words, _other_hashes)[starts]
        yield pa.RecordBatch.from_arrays([pa.array(w, pa.int64()), pa.array(v, pa.int64()), pa.array(np.full(len(w), rid), pa.int64())], ["w", "v", "rid"])


def stretches(starts: np.ndarray, group: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(group, first word, end) of windows in a row that belong to one group."""
    order = np.lexsort((starts, group))
    s, g = starts[order], group[order]
    new = np.flatnonzero(np.r_[True, (s[1:] > s[:-1] + 1) | (g[1:] != g[:-1])]) if len(s) else []
    for a, b in zip(new, np.r_[new[1:], len(s)] if len(s) else [], strict=True):
        yield int(g[a]), int(s[a]), int(s[b - 1]) + WINDOW


def passages(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """(shard, text): the confirmed windows that a document lends."""

    def rows():
        for _, words, starts, owners, more in documents_of(batches):
            lent = np.isin(window_hashes(words)[starts], np.array(more["lent"], np.int64))
            for shard, a, b in stretches(starts[lent], owners[lent] % shards):
                yield shard, b" ".join(words[a:b]).decode()

    yield from in_batches(rows(), ["shard", "text"], [pa.int32(), pa.string()])


def document_stretches(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """(shard, rid, at, text): what a document sends to a shard, from its word ``at`` on."""

    def rows():
        for rid, words, starts, owners, _ in documents_of(batches):
            for shard, a, b in stretches(starts, owners % shards):
                yield shard, rid, a, b" ".join(words[a:b]).decode()

    yield from in_batches(rows(), ["shard", "rid", "at", "text"], [pa.int32(), pa.int64(), pa.int32(), pa.string()])


def as_signs(h: np.ndarray) -> str:
    """A text with one sign for each word, by its hash."""
    code = (h % np.uint64(1_100_000)).astype(np.uint32) + 1
    return np.where(code >= 0xD800, code + 0x800, code).astype("<u4").tobytes().decode("utf-32-le")


class Automaton:
    """Phrases of a shard's passages, and the hashes of the passages' windows."""

    def __init__(self, texts: list[bytes]):
        self.found = ahocorasick.Automaton()
        held = [np.zeros((2, 0), np.int64)]
        for text in texts:
            words = text.split()
            signs = as_signs(_hashes.of(words))
            for at in range(0, len(words) - PHRASE + 1, PHRASE):
                self.found.add_word(signs[at : at + PHRASE], 1)
            held.append(np.stack([window_hashes(words), window_hashes(words, _other_hashes)]))
        self.found.make_automaton()
        w, v = np.concatenate(held, axis=1)
        order = np.lexsort((v, w))
        new = np.r_[True, (np.diff(w[order]) != 0) | (np.diff(v[order]) != 0)][: len(order)]
        self.windows, self.others = w[order][new], v[order][new]
        self.deepest = int(np.unique(self.windows, return_counts=True)[1].max(initial=1))  # over 1 only where first hashes collide

    def has(self, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        place, got = np.searchsorted(self.windows, w), np.zeros(len(w), bool)
        for step in range(self.deepest):
            at = np.minimum(place + step, len(self.windows) - 1)
            got |= (self.windows[at] == w) & (self.others[at] == v)
        return got

    def covered(self, text: bytes) -> list[tuple[int, int]]:
        """Stretches of words that confirmed windows cover."""
        words = text.split()
        if not len(self.found) or len(words) < WINDOW:
            return []
        near = np.zeros(len(words) + 1, np.int32)
        for end, _ in self.found.iter(as_signs(_hashes.of(words))):
            near[max(0, end + 1 - WINDOW)] += 1  # windows that hold the phrase start here ...
            near[end + 2 - PHRASE] -= 1  # ... up to the phrase's first word
        at = np.flatnonzero(np.cumsum(near)[: len(words) - WINDOW + 1] > 0)
        if len(at):
            at = at[self.has(window_hashes(words)[at], window_hashes(words, _other_hashes)[at])]
        return [(a, b) for _, a, b in stretches(at, np.zeros(len(at), np.int64))]


def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (shard, part, piece, kind): an automaton's passages (kind 0), then the stretches to stream through it."""

    def rows():
        key, texts, machine = None, [], None
        for batch in batches:
            for shard, part, piece, kind, rid, at, text in zip(*(batch.column(c).to_pylist() for c in ("shard", "part", "piece", "kind", "rid", "at")), texts_of(batch), strict=True):
                if key != (shard, part, piece):
                    key, texts, machine = (shard, part, piece), [], None
                if kind == 0:
                    texts.append(text)
                    continue
                if machine is None:
                    machine, texts = Automaton(texts), []
                for a, b in machine.covered(text):
                    yield rid, at + a, at + b

    yield from in_batches(rows(), ["rid", "a", "b"], [pa.int64(), pa.int32(), pa.int32()])


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, n_removed, kept): what stays of each document."""

    def rows():
        for rid, words, _, _, more in documents_of(batches):
            goes = np.zeros(len(words) + 1, np.int32)
            for s in more["spans"]:
                goes[s["a"]] += 1
                goes[s["b"]] -= 1
            keep = np.flatnonzero(np.cumsum(goes)[:-1] == 0)
            yield rid, len(words) - len(keep), b" ".join([words[i] for i in keep]).decode()

    yield from in_batches(rows(), ["rid", "n_removed", "kept"], [pa.int64(), pa.int64(), pa.string()], 2000)


def texts_of_keys(keyed: DataFrame, runs: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``runs`` (one for each key) with the text of their key, each once, however often its row is repeated.

    ``classes`` (written) says how many rows a key may have. Keys with over a thousandth of all rows are few: their rows are
    looked up where they are, and repeated ones go before they are dealt out.
    """
    limit = max(1, (classes.agg(F.sum("copies")).first()[0] or 0) // 1000)
    hot = F.broadcast(classes.where(F.col("copies") > limit).select("key"))
    if hot.isEmpty():
        return keyed.join(runs, "key").dropDuplicates(["key"]).drop("key")
    runs = materialise(runs, "runs")
    first = keyed.join(hot, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")).join(runs, "key")
    others = keyed.join(hot, "key", "left_anti").join(runs, "key").dropDuplicates(["key"])
    return others.unionByName(first).drop("key")


def repeated_words(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all documents: doc_id, rid, n_words, sha; those that lose words: rid, n_removed, kept)."""
    keyed = docs.select("doc_id", "text", row_key().alias("key"))
    scanned = materialise(keyed.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(scan, SCANNED), "scanned")
    classes = scanned.groupBy("sha").agg(F.min(F.struct("rid", "key")).alias("first"), F.count("*").alias("copies"))
    classes = materialise(classes.select("sha", "first.*", "copies"), "classes")
    anchors = scanned.select("rid", F.inline(F.arrays_zip(F.col("anchors").alias("a"), F.col("starts").alias("i"), F.col("ends").alias("j"))))
    twice = materialise(anchors.groupBy("a").agg(F.count("*").alias("n")).where("n > 1"), "twice")
    # of the copies of a text one goes on, and what recurs is counted again without the others
    shared = materialise(skew_join(anchors, twice, "a").drop("n").join(classes.select("rid"), "rid", "left_semi"), "shared")
    recurring = shared.groupBy("a").agg(F.count("*").alias("n"), F.min("rid").alias("owner")).where("n > 1")
    runs = skew_join(shared, materialise(recurring, "recurring"), "a").groupBy("rid").agg(F.collect_list(F.struct("i", "j", "owner")).alias("runs")).join(classes.select("rid", "key", "copies"), "rid")
    candidates = materialise(texts_of_keys(keyed.select("key", "text"), runs, classes), "candidates")
    windows = candidates.mapInArrow(candidate_hashes, "w long, v long, rid long")
    confirmed = windows.groupBy("w", "v").agg(F.count("*").alias("n"), F.min("rid").alias("rid")).where("n > 1")
    lent = materialise(confirmed.groupBy("rid").agg(F.collect_list("w").alias("lent")), "lent")
    size = candidates.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = int(max(32, size // (AUTOMATON_BYTES // 2)))
    lenders = candidates.join(lent, "rid")
    patterns = materialise(lenders.mapInArrow(lambda x: passages(x, shards), "shard int, text string"), "passages")
    sent = materialise(candidates.where("copies = 1").mapInArrow(lambda x: document_stretches(x, shards), "shard int, rid long, at int, text string"), "stretches")
    parts = patterns.groupBy("shard").agg(F.ceil(F.sum(F.length("text")) / AUTOMATON_BYTES).cast("int").alias("parts"))
    pieces = sent.groupBy("shard").agg(F.ceil(F.sum(F.length("text")) / STRETCH_BYTES).cast("int").alias("pieces"))
    plan = materialise(parts.join(pieces, "shard"), "plan")  # a row for each shard
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    p = patterns.distinct().join(plan, "shard").select("shard", F.pmod(F.xxhash64("text"), "parts").cast("int").alias("part"), each("pieces").alias("piece"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("rid"), F.lit(0).alias("at"), "text")
    s = sent.join(plan, "shard").select("shard", each("parts").alias("part"), F.pmod(F.xxhash64("rid", "at"), "pieces").cast("int").alias("piece"), F.lit(1).alias("kind"), "rid", "at", "text")
    met = p.unionByName(s).repartition("shard", "part", "piece").sortWithinPartitions("shard", "part", "piece", "kind")
    spans = met.mapInArrow(locate, "rid long, a int, b int").groupBy("rid").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    lost = candidates.join(spans, "rid").mapInArrow(cut_out, "rid long, n_removed long, kept string")
    copied = (F.col("copies") > 1) & (F.col("n_words") >= WINDOW)
    counted = skew_join(scanned.select("doc_id", "rid", "key", "n_words", "sha"), classes.select("sha", "copies"), "sha", "copies").withColumn("copied", copied)
    return counted, lost


def removal_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for each row of ``docs``."""
    counted, lost = repeated_words(docs)
    out = counted.join(lost.select("rid", "n_removed", F.sha2("kept", 256).alias("kept_sha")), "rid", "left")
    n_removed = F.when(F.col("copied"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    kept_sha = F.when(F.col("copied"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha", "sha"))
    return out.select("doc_id", "n_words", n_removed.alias("n_removed"), kept_sha.alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with what stays of their texts; a text that loses nothing keeps its white space, others get one space between words."""
    counted, lost = repeated_words(docs)
    whole = counted.where("copied").select("key", F.lit("").alias("kept"))
    cut = lost.select("rid", "kept").join(counted.select("rid", "key"), "rid").select("key", "kept")
    kept = materialise(cut.unionByName(whole).groupBy("key").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "kept")
    held = docs.select(F.struct(*docs.columns).alias("doc"), row_key().alias("key"))
    doc = skew_join(held, kept, "key", how="left").select("doc", "kept").withColumn("doc", F.when(F.col("kept").isNull(), F.col("doc")).otherwise(F.col("doc").withField("text", F.col("kept"))))
    if "n_chars" in docs.columns:
        doc = doc.withColumn("doc", F.when(F.col("kept").isNull(), F.col("doc")).otherwise(F.col("doc").withField("n_chars", F.length("kept").cast(docs.schema["n_chars"].dataType))))
    return doc.select("doc.*")
