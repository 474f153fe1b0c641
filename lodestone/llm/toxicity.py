"""Toxicity: a bidirectional gated recurrent network with attention pooling over windows of words, trained in numpy.

A word's input is a hashed word vector and the mean of hashed vectors of its character 3- to 5-grams. The network reads
overlapping windows of a text; a text's odds are those of its most toxic window, scaled on part of the sample that was kept
aside. It learns from a bounded sample of the labelled rows that are not held out (``SAMPLE`` of each label, those with the
least hashes), windows of a text under its label: the window that speaks loudest is the one that learns. Whole texts are
scored. Inputs of the recurrence are computed once for each word that a task meets, not for each place where it stands.

Nulls and edges: a null or empty text has one window without words; rows with a null label teach nothing; without labels of
both kinds every text scores the share of 1 (0 without any); repeated rows are scored each for itself; an empty table gives
an empty table; other columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, flat, mix, remainder
from .quality import MARKS, SAMPLE_BYTES, scored, texts_of_sample

#: Labelled documents of each label to learn from at most.
SAMPLE = 1500
WINDOW, STRIDE = 64, 48
WORD_SLOTS, GRAM_SLOTS, DIM, HIDDEN, ATTEND = 1 << 14, 1 << 15, 12, 8, 8
GRAMS = (3, 4, 5)
KEPT_WORDS = 100_000
#: Slots that fewer texts of the sample have are as good as unseen.
RARE = 4
#: Words whose inputs are made at once.
PART = 10_000


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def word_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot of each word; slots of all its character grams, one word after the other; how many each has (one at least)."""
    bare = [w.lower().strip(MARKS) or w for w in words]
    slot = np.fromiter((xxhash.xxh64_intdigest(w) % WORD_SLOTS for w in bare), np.int64, len(bare))
    lens = np.fromiter(map(len, bare), np.int64, len(bare)) + 2
    chars = np.frombuffer(b"".join(b"<" + w + b">" for w in bare), np.uint8).astype(U64)
    of, ends = np.repeat(np.arange(len(lens)), lens), np.cumsum(lens)
    left = ends[of] - np.arange(len(chars))  # characters from here to the word's end
    grams, owner = [], []
    h = chars.copy()
    for n in range(2, max(GRAMS) + 1):
        m = len(chars) - n + 1
        if m <= 0:
            break
        h = h[:m] * U64(1_000_003) + chars[n - 1 :]
        if n in GRAMS:
            ok = np.flatnonzero(left[:m] >= n)
            grams.append((mix(h[ok] + U64(n << 56)) % U64(GRAM_SLOTS - 1)).astype(np.int64) + 1)
            owner.append(of[ok])
    g, o = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (grams, owner))
    none = np.setdiff1d(np.arange(len(bare)), o)  # shorter than any gram: the common slot 0
    g, o = np.r_[g, np.zeros(len(none), np.int64)], np.r_[o, none]
    order = np.argsort(o, kind="stable")
    return slot, g[order], np.bincount(o, minlength=len(bare))


def all_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``word_keys`` of many words, some at a time."""
    got = [[x.astype(np.int32) for x in word_keys(words[at : at + PART])] for at in range(0, len(words), PART)]
    return tuple(np.concatenate(x) for x in zip(*got, strict=True))


def windows(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows x WINDOW places in the flat list of words, -1 beyond a text's end; the text of each window)."""
    n = np.maximum(1, -(-(lens - WINDOW) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(lens)), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    starts = np.cumsum(lens) - lens
    place = (nth * STRIDE)[:, None] + np.arange(WINDOW)
    return np.where(place < lens[doc][:, None], place + starts[doc][:, None], -1), doc


@dataclass
class Net:
    word: np.ndarray
    gram: np.ndarray
    wx: np.ndarray  # 2 x input x 3 hidden
    bx: np.ndarray  # 2 x 3 hidden
    u: np.ndarray  # 2 x hidden x 3 hidden
    wa: np.ndarray
    ba: np.ndarray
    va: np.ndarray
    wo: np.ndarray
    bo: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)
    prior: float | None = None
    word_slots: np.ndarray | None = None  # slots that the sample met often enough; others are slot 0
    gram_slots: np.ndarray | None = None
    known: dict = field(default_factory=dict)
    table: np.ndarray | None = None

    def params(self) -> list[np.ndarray]:
        return [self.word, self.gram, self.wx, self.bx, self.u, self.wa, self.ba, self.va, self.wo, self.bo]

    def inputs(self, slot: np.ndarray, grams: np.ndarray, n: np.ndarray) -> np.ndarray:
        chars = np.add.reduceat(self.gram[grams], np.cumsum(n) - n, axis=0) / n[:, None] if len(n) else np.zeros((0, DIM), "f4")
        return np.c_[self.word[slot], chars].astype("f4")

    def known_keys(self, keys: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, grams, n = keys
        return self.word_slots[slot], self.gram_slots[grams], n

    def gates(self, x: np.ndarray) -> np.ndarray:
        """words x 2 x 3 hidden: what a word gives to the gates of either direction."""
        return (np.einsum("ni,dig->ndg", x, self.wx, optimize=True) + self.bx).astype("f4")

    def all_gates(self, slot: np.ndarray, grams: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Gates of many words, some at a time, and of a place without a word."""
        ends = np.r_[0, np.cumsum(n)]
        made = [self.gates(self.inputs(slot[at : at + PART], grams[ends[at] : ends[min(at + PART, len(n))]], n[at : at + PART])) for at in range(0, len(n), PART)]
        return np.concatenate([*made, silent()])

    def read(self, gates: np.ndarray, place: np.ndarray, keep: bool = False):
        """Logits of windows; ``gates`` has a last row for places without a word, which leave the state as it is."""
        b, h = len(place), HIDDEN
        state, tape = np.zeros((2, b, h), "f4"), []
        both = np.stack([place, place[:, ::-1]])
        out = np.empty((WINDOW, 2, b, h), "f4")
        uzr, uc = self.u[:, :, : 2 * h], self.u[:, :, 2 * h :]
        for t in range(WINDOW):
            x = np.stack([gates[both[0, :, t], 0], gates[both[1, :, t], 1]])
            zr = sigmoid(x[:, :, : 2 * h] + state @ uzr)
            z, r = zr[:, :, :h], zr[:, :, h:]
            c = np.tanh(x[:, :, 2 * h :] + (r * state) @ uc)
            if keep:
                tape.append((state, z, r, c))
            state = state + z * (c - state)
            out[t] = state
        hs = np.concatenate([out[:, 0], out[::-1, 1]], axis=2)  # WINDOW x b x 2h
        a = np.tanh(hs @ self.wa + self.ba)
        e = a @ self.va
        e[(place < 0).T] = -30
        e -= e.max(axis=0)
        w = np.exp(e)
        w /= w.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", w, hs)
        logit = pooled @ self.wo + self.bo[0]
        return (logit, (hs, a, w, pooled, tape, both)) if keep else logit

    def learn(self, place: np.ndarray, gates: np.ndarray, d: np.ndarray, kept) -> tuple[list[np.ndarray], np.ndarray]:
        """Gradients of the recurrent part and of the gates (places x 2 x 3 hidden), from the gradients of the logits."""
        hs, a, w, pooled, tape, both = kept
        h = HIDDEN
        g_wo, g_bo, dp = pooled.T @ d, d.sum(keepdims=True), d[:, None] * self.wo
        dw = np.einsum("bh,tbh->tb", dp, hs)
        de = w * (dw - (w * dw).sum(axis=0))
        da = de[:, :, None] * self.va * (1 - a**2)
        dhs = w[:, :, None] * dp[None] + da @ self.wa.T
        g_va, g_wa, g_ba = np.einsum("tb,tbk->k", de, a), np.einsum("tbh,tbk->hk", hs, da), da.sum(axis=(0, 1))
        g_u, dx = np.zeros_like(self.u), np.zeros((WINDOW, *tape[0][0].shape[:2], 3 * h), "f4")
        ds = np.zeros_like(tape[0][0])
        uzr, uc = self.u[:, :, : 2 * h].transpose(0, 2, 1), self.u[:, :, 2 * h :].transpose(0, 2, 1)
        for t in range(WINDOW - 1, -1, -1):
            state, z, r, c = tape[t]
            ds = ds + np.stack([dhs[t][:, :h], dhs[WINDOW - 1 - t][:, h:]])
            ac = ds * z * (1 - c**2)
            rs = ac @ uc
            zr = np.concatenate([ds * (c - state) * z * (1 - z), rs * state * r * (1 - r)], axis=2)
            dx[t] = np.concatenate([zr, ac], axis=2)
            g_u[:, :, : 2 * h] += state.transpose(0, 2, 1) @ zr
            g_u[:, :, 2 * h :] += (r * state).transpose(0, 2, 1) @ ac
            ds = ds * (1 - z) + rs * r + zr @ uzr
        gx = np.zeros(gates.shape, "f4")
        for k in range(2):
            np.add.at(gx[:, k], both[k].T, dx[:, k])
        gx[-1] = 0
        return [g_u, g_wa, g_ba, g_va, g_wo, g_bo], gx

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        words, lens = flat([x.split() for x in texts])
        if self.table is None or len(self.known) + len(words) > 2 * KEPT_WORDS and len(self.known) > KEPT_WORDS:
            self.known, self.table = {}, np.zeros((0, 2, 3 * HIDDEN), "f4")
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            made = [self.gates(self.inputs(*self.known_keys(word_keys(new[at : at + PART])))) for at in range(0, len(new), PART)]
            self.table = np.concatenate([self.table, *made])
        ids = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        place, doc = windows(lens)
        gates = np.concatenate([self.table, silent()])
        place = np.r_[ids, -1][place]
        logit = np.concatenate([self.read(gates, place[at : at + 2048]) for at in range(0, len(place), 2048)]) if len(place) else np.zeros(0)
        most = np.full(len(texts), -np.inf)
        np.maximum.at(most, doc, logit)
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * most + b, -60, 60)))


def silent() -> np.ndarray:
    """Gates of a place without a word: the update gate is shut."""
    out = np.zeros((1, 2, 3 * HIDDEN), "f4")
    out[:, :, :HIDDEN] = -40
    return out


def fresh(rng: np.random.Generator) -> Net:
    g = lambda *s, k: (rng.normal(size=s) * k).astype("f4")
    h = HIDDEN
    return Net(g(WORD_SLOTS, DIM, k=0.1), g(GRAM_SLOTS, DIM, k=0.3), g(2, 2 * DIM, 3 * h, k=0.3), np.zeros((2, 3 * h), "f4"), g(2, h, 3 * h, k=0.3), g(2 * h, ATTEND, k=0.4), np.zeros(ATTEND, "f4"), g(ATTEND, k=0.4), g(2 * h, k=0.4), np.zeros(1, "f4"))


def train(texts: list[bytes], labels: np.ndarray, share: float, seed: int = 2) -> Net:
    """``share``: of label 1 among all labelled rows, to which the odds are scaled."""
    rng = np.random.default_rng(seed)
    net = fresh(rng)
    if len(set(labels.tolist())) < 2:
        net.prior = float(labels.mean()) if len(labels) else 0.0
        return net
    words, lens = flat([x.split() for x in texts])
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words))
    del words
    slot, grams, n = all_keys(list(vocabulary))
    texts_with = np.bincount(np.unique(np.repeat(np.arange(len(lens)), lens) * len(n) + ids) % len(n), minlength=len(n))
    often = lambda x, w, size: np.where(np.bincount(x, w, minlength=size) >= RARE, np.arange(size), 0).astype(np.int32)
    net.word_slots, net.gram_slots = often(slot, texts_with, WORD_SLOTS), often(grams, np.repeat(texts_with, n), GRAM_SLOTS)
    slot, grams, n = net.known_keys((slot, grams, n))
    first = np.cumsum(n) - n
    place, doc = windows(lens)
    place = np.r_[ids, -1][place]
    aside = rng.random(len(texts)) < 0.2
    params = net.params()
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    loudest = rng.permutation(len(place))
    epochs = int(np.clip(300 / (1 + len(texts) // 80), 8, 80))  # more rounds over a small sample
    for epoch in range(epochs):
        if epoch:  # the window of each text that the network now finds most toxic
            table = net.all_gates(slot, grams, n)
            logit = np.concatenate([net.read(table, place[at : at + 2048]) for at in range(0, len(place), 2048)])
            # most often the loudest; now and then another, so that all toxic places teach
            loudest = np.argsort(-logit - (rng.gumbel(size=len(logit)) if epoch < epochs // 2 else 0), kind="stable")
        _, top = np.unique(doc[loudest], return_index=True)
        top = loudest[top]
        if not epoch:
            top = rng.permutation(len(place))[: 4 * len(texts)]
        top = rng.permutation(top[~aside[doc[top]]])
        for at in range(0, len(top), 64):
            some = top[at : at + 64]
            used, local = np.unique(place[some], return_inverse=True)
            local = local.reshape(len(some), WINDOW)
            has_gap = used[0] < 0
            used = used[1:] if has_gap else used
            local = np.where(place[some] < 0, -1, local - int(has_gap))
            lengths = n[used]
            at_gram = np.repeat(first[used] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            g = grams[at_gram]
            word = np.where(rng.random(len(used)) < 0.2, 0, slot[used])  # now and then a word is known by its characters alone
            x = net.inputs(word, g, lengths)
            gates = np.concatenate([net.gates(x), silent()])
            logit, kept = net.read(gates, local, keep=True)
            y = labels[doc[some]]
            d = ((sigmoid(logit) - y) / len(some)).astype("f4")
            rest, gx = net.learn(local, gates, d, kept)
            gx = gx[:-1]
            dx = np.einsum("ndg,dig->ni", gx, net.wx, optimize=True)
            g_word, g_gram = np.zeros_like(net.word), np.zeros_like(net.gram)
            np.add.at(g_word, word, dx[:, :DIM])
            np.add.at(g_gram, g, np.repeat(dx[:, DIM:] / lengths[:, None], lengths, axis=0))
            grads = [g_word, g_gram, np.einsum("ni,ndg->dig", x, gx, optimize=True), gx.sum(axis=0), *rest]
            step += 1
            rate = 0.01 * (1 - 0.8 * epoch / epochs)
            for k, gk in enumerate(grads):
                m[k] += 0.1 * (gk - m[k])
                v[k] += 0.001 * (gk * gk - v[k])
                params[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    table = net.all_gates(slot, grams, n)
    logit = np.concatenate([net.read(table, place[at : at + 2048]) for at in range(0, len(place), 2048)])
    most = np.full(len(texts), -np.inf)
    np.maximum.at(most, doc, logit)
    z, y = most[aside], labels[aside].astype("f8")
    if 0 < y.sum() < len(y):
        weight = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
        a, b = 1.0, 0.0
        for _ in range(300):  # a logistic fit of two numbers
            p = sigmoid(a * z + b)
            e = weight * (p - y)
            a, b = max(0.05, a - 0.1 * ((e * z).mean() + 0.01 * (a - 1))), b - 0.1 * e.mean()
        net.scale = (float(a), float(b))
    return net


def toxic_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, most: int) -> tuple[list[bytes], np.ndarray, float]:
    known = labels.where(F.col(label).isin(0, 1) & (remainder("doc_id", modulus) != held)).select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label"))
    total = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    drawn = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).distinct().orderBy(F.xxhash64("id", F.lit(11)), "id").limit(most)
        drawn = part if drawn is None else drawn.union(part)
    return *texts_of_sample(docs, drawn, 2 * most, SAMPLE_BYTES), total.get(1, 0) / max(1, sum(total.values()))


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, held: int = 2, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (odds of label 1) and predicted for each row of ``docs``."""
    return scored(docs, train(*toxic_sample(docs, labels, label, modulus, held, sample)), modulus, held, threshold)
