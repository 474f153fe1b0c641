"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with calibrated odds.

Random indexing gives each word a sparse signed index vector drawn from its hash; a word's vector is the sum of the index
vectors of its neighbours and of its own shape and ends, so that words of a kind lie together. Words share a fixed number of
hash slots. A document is the mean of its word vectors, twice: plain, and weighted towards its rarer words, with the share of
repeated words and of signs. Vectors, network and temperature are learned from a bounded sample of the labelled rows that are
not held out (``SAMPLE`` documents and ``SAMPLE_BYTES`` of text, those with the least hashes; all where there are fewer); whole texts are scored.

Nulls and edges: an empty or null text scores by the network's answer to zero features; rows with a null label teach nothing,
a repeated label row teaches once for each; without labels of both kinds every text scores the share of 1 (0.5 without any),
so that a filter keeps what it knows nothing about; repeated rows are scored each for itself; an empty table gives an empty table; other columns are left alone and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, flat, mix, remainder, text_slices, texts_of

#: Labelled documents to learn from at most.
SAMPLE = 6000
#: Bytes of text that a sample may hold, whatever its rows.
SAMPLE_BYTES = 64 << 20
SLOTS, DIM, NONZERO, HIDDEN = 1 << 16, 24, 4, 16
#: Slots met fewer times in the sample have no vector.
RARE = 5
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def shape_of(word: bytes) -> tuple[str, str]:
    """What a word looks like: case and signs, and its last sign."""
    text = word.decode("utf-8", "replace")
    core = text.strip(MARKS.decode())
    case = "none" if not core else "upper" if core.isupper() and len(core) > 1 else "title" if core[:1].isupper() else "digit" if core.isdigit() else "lower" if core.islower() else "mixed"
    tail = text[len(text.rstrip(MARKS.decode())) :][:3] if core else text[:3]
    return case, tail


class WordSlots(dict):
    """word -> slot of its vector; the slot of a word is its hash."""

    bound = 120_000

    def __missing__(self, word: bytes) -> int:
        got = self[word] = xxhash.xxh64_intdigest(word) % SLOTS
        return got


class WordShapes(dict):
    """word -> number of its shape, hashed."""

    bound = 120_000

    def __missing__(self, word: bytes) -> int:
        case, tail = shape_of(word)
        got = self[word] = xxhash.xxh32_intdigest(f"{case} {tail}") % 256
        return got


_slots, _shapes = WordSlots(), WordShapes()


def index_vectors(keys: np.ndarray) -> np.ndarray:
    """A sparse signed index vector for each key."""
    out = np.zeros((len(keys), DIM), "f4")
    h = mix(keys.astype(U64) + U64(0x51ED27))
    for _ in range(NONZERO):
        h = mix(h)
        out[np.arange(len(keys)), (h % U64(DIM)).astype(int)] += np.where(h >> U64(63), 1, -1)
    return out


@dataclass
class Words:
    """Slots and shapes of all words of several texts, and the text of each."""

    slot: np.ndarray
    shape: np.ndarray
    lens: np.ndarray
    lead: np.ndarray  # whether the word is that before it


def encoded(texts: list[bytes]) -> Words:
    words, lens = flat([x.split() for x in texts])
    for cache in (_slots, _shapes):
        if len(cache) > cache.bound:
            cache.clear()
    slot = np.fromiter(map(_slots.__getitem__, words), np.int64, len(words))
    shape = np.fromiter(map(_shapes.__getitem__, words), np.int64, len(words))
    return Words(slot, shape, lens, np.r_[False, slot[1:] == slot[:-1]][: len(slot)])


def word_vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Random indexing over a sample: a unit vector for each slot, and the slot's rarity weight."""
    own = index_vectors(np.arange(SLOTS) + 1000)
    shapes = index_vectors(np.arange(256))
    sums, n = np.zeros((SLOTS, DIM), "f4"), np.zeros(SLOTS)
    for at in range(0, len(texts), 200):
        w = encoded(texts[at : at + 200])
        doc = np.repeat(np.arange(len(w.lens)), w.lens)
        n += np.bincount(w.slot, minlength=SLOTS)
        for step in (1, 2):
            same = doc[step:] == doc[:-step]
            for a, b in ((w.slot[step:], w.slot[:-step]), (w.slot[:-step], w.slot[step:])):
                order = np.argsort(a[same], kind="stable")
                where, first = np.unique(a[same][order], return_index=True)
                if len(where):
                    sums[where] += np.add.reduceat(own[b[same][order]], first, axis=0) / step
        order = np.argsort(w.slot, kind="stable")
        where, first = np.unique(w.slot[order], return_index=True)
        if len(where):
            sums[where] += 2 * np.add.reduceat(shapes[w.shape[order]], first, axis=0)
    vectors = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-6)
    rare = n < RARE  # as if unseen: else texts of the sample would look unlike all others
    vectors[rare] = 0
    return vectors.astype("f4"), np.where(rare, 1, 1 / np.sqrt(1 + n)).astype("f4")


def pooled(w: Words, vectors: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Features of each text."""
    shapes = index_vectors(np.arange(256))
    out = np.zeros((len(w.lens), 3 * DIM + 3), "f4")
    some = np.flatnonzero(w.lens)
    if len(some):
        starts = (np.cumsum(w.lens) - w.lens)[some]
        weight = rarity[w.slot]
        out[some, :DIM] = np.add.reduceat(vectors[w.slot], starts, axis=0) / w.lens[some, None]
        out[some, DIM : 2 * DIM] = np.add.reduceat(vectors[w.slot] * weight[:, None], starts, axis=0) / np.add.reduceat(weight, starts)[:, None]
        out[some, 2 * DIM : 3 * DIM] = np.add.reduceat(shapes[w.shape], starts, axis=0) / w.lens[some, None]
        out[some, -3] = np.add.reduceat(w.lead.astype("f4"), starts) / w.lens[some]
        out[some, -2] = np.log1p(w.lens[some]) / 10
        out[some, -1] = np.add.reduceat(weight, starts) / w.lens[some]
    return out


@dataclass
class Model:
    vectors: np.ndarray
    rarity: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    prior: float | None = None

    def logits(self, features: np.ndarray) -> np.ndarray:
        x = np.clip((features - self.mean) / self.scale, -5, 5)
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-self.logits(pooled(encoded(texts), self.vectors, self.rarity)).astype("f8") / self.temperature))


def train(texts: list[bytes], labels: np.ndarray, seed: int = 1) -> Model:
    rng = np.random.default_rng(seed)
    prior = float(labels.mean()) if len(labels) else 0.5
    if len(set(labels.tolist())) < 2:
        z = np.zeros(1)
        return Model(z, z, z, z, z, z, z, 0.0, 1.0, prior)
    vectors, rarity = word_vectors(texts)
    x = np.concatenate([pooled(encoded(texts[at : at + 200]), vectors, rarity) for at in range(0, len(texts), 200)])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.01
    x, y = np.clip((x - mean) / scale, -5, 5), labels.astype("f4")
    cut = max(1, len(x) // 5)  # the temperature is fitted on rows that the network has not seen
    order = rng.permutation(len(x))
    held, used = order[:cut], order[cut:]
    p = [rng.normal(size=(x.shape[1], HIDDEN)).astype("f4") / np.sqrt(x.shape[1]), np.zeros(HIDDEN, "f4"), rng.normal(size=HIDDEN).astype("f4") / 4, np.zeros(1, "f4")]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    epochs = int(np.clip(3000 / (1 + len(used) // 64), 40, 400))  # more rounds over a small sample
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs)
        for at in range(0, len(used), 64):
            i = used[at : at + 64]
            h = np.tanh(x[i] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[i]) / len(i)
            back = np.outer(d, p[2]) * (1 - h**2)
            grads = [x[i].T @ back + 1e-3 * p[0], back.sum(axis=0), h.T @ d + 1e-3 * p[2], d.sum(keepdims=True)]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        used = rng.permutation(used)
    model = Model(vectors, rarity, mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    z, truth = np.tanh(x[held] @ p[0] + p[1]) @ p[2] + p[3][0], y[held]
    losses = {tau: np.logaddexp(0, -np.where(truth > 0, z, -z) / tau).mean() for tau in np.geomspace(0.25, 8, 41)}
    model.temperature = float(min(losses, key=losses.get))
    return model


def texts_of_sample(docs: DataFrame, drawn: DataFrame, most: int, most_bytes: int) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of the rows that ``drawn`` (id, label; few) names: at most ``most`` different ones, and ``most_bytes`` of text.

    Rows are taken in the order of a hash of id and text, so that reruns agree, also where an id stands on several texts.
    Sizes are looked at first, and only the texts that are taken come to the driver. A text of over a sixteenth of ``most_bytes`` is
    passed over, so that it does not take the place of all others.
    """
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("id"))
    keyed = rows.select("id", "label", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.xxhash64("id", "key"), F.col("id"), F.col("key"), F.col("label")]
    some = keyed.select("id", "label", "key", F.octet_length("text").alias("bytes")).where(F.col("bytes") <= most_bytes // 16).distinct().orderBy(*order).limit(most)
    upto = F.sum("bytes").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # ``most`` rows
    taken = some.withColumn("upto", upto).where(F.col("upto") <= most_bytes).select("id", "label", "key")
    got = keyed.join(F.broadcast(taken), ["id", "label", "key"]).dropDuplicates(["id", "label", "key"]).collect()
    got.sort(key=lambda r: (r["id"], r["text"], r["label"]))
    return [r["text"].encode() for r in got], np.array([int(r["label"]) for r in got], np.int64)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, most: int, most_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of ``most`` rows labelled 0 or 1 that are not held out, those with the least hashes."""
    known = labels.where(F.col(label).isin(0, 1) & (remainder("doc_id", modulus) != held)).select(F.col("doc_id").alias("id"), F.col(label).alias("label"))
    return texts_of_sample(docs, known.distinct().orderBy(F.xxhash64("id", F.lit(7)), "id", "label").limit(most), most, most_bytes)


def scored(docs: DataFrame, model, modulus: int, held: int, threshold: float, limit: int = 1 << 20) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` by ``model.score(texts)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=limit):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(shared.value.score(texts_of(batch)), pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", "text", (remainder("doc_id", modulus) == held).alias("held_out"))
    out = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, held: int = 0, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (odds of label 1) and predicted for each row of ``docs``."""
    return scored(docs, train(*labelled_sample(docs, labels, label, modulus, held, sample)), modulus, held, threshold)


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without those that the classifier rejects; scored as they are read, without a shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(train(*labelled_sample(docs, labels, "quality", 5, 0, sample)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=1 << 20):
            yield batch.filter(pa.array(model.value.score(texts_of(batch)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
