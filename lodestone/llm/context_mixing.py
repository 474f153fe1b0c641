"""LM scoring by online logistic context mixing.

A token is spelled as bits: first its class (its last two bytes, the frequent ones each a class) by a Huffman code. Each bit is
predicted from several hashed contexts (the bit's node alone, with one to three classes before, with the token before); the
predictions are mixed in the logistic domain by weights that the contexts' confidence selects (gates), and refined by an
adaptive table over (node, prediction). Then comes which known word of its class it is, by a Huffman code within the class whose
bits a second mixer predicts from the classes and the token before; words outside ``HEAD`` share a leaf of their class and are told
apart by their counts. For a word that the training texts lack the class's share of new words follows, and then its bytes, whose
bits a third mixer predicts from one to four bytes before.

Longer contexts are kept for the whole corpus, in tables that grow with it and are joined to what is scored: where the hash of
``ORDER`` tokens says so (once in ``RATE``), the phrase up to the next such place is looked up among those that follow the same
tokens in training texts. A fourth mixer predicts the bit whether it is one of them, from how many there are and from the bits
before in the text; if so, its share of them is its probability, and its tokens need no bits of their own. A training text's
own occurrence does not count there.

Training is online in each task: bits are predicted from what the task has counted so far, then teach weights, table and
counts; counts are added up over all tasks and weights averaged by bits. Scoring starts from that model and goes on adapting
the weights within each text, block by block, so a text's probability is a product of conditional ones. All training texts
are counted. A bounded number of frequent tokens (``HEAD``) is known in every task; the counts of all others are joined.

Nulls and edges: a null or empty text is the end token alone; a null doc_id hashes as the empty text; repeated rows are
scored each for itself; without training texts counts are 0 and the base is the contract's formula at 0; an empty table gives
an empty table; texts of up to ``ORDER`` tokens have no phrases; a very long text is scored whole, in blocks,
and is never cut; other columns are left alone and may have any names.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, gram_hashes, materialise, mix, remainder, skew_join, text_slices, texts_of

HEAD, CLASSES = 1 << 18, 62
#: The least count of a frequent token is looked up in a histogram whose steps are counts, and from here on thousandths of a logarithm.
COMMON = 50_000
BLOCK, BATCH = 96, 1 << 14
#: So many texts are scored side by side.
TOGETHER = 32
BINS, GATES = 25, 16
#: So many bits seen make a slot more confident, each time by one.
SURE = (5, 31, 181)
ADDED = "chunk int, values binary"
CHUNK = 512
END = b""
#: Phrases start after ``ORDER`` tokens whose hash says so, once in ``RATE`` places (a power of two).
ORDER, RATE = 4, 16


def squash(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def log10_of(p: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """log10 of the probability that each bit was given."""
    return np.log(np.abs(1 - bit.astype("f4") - p)) * np.float32(1 / math.log(10))


@dataclass
class Mixer:
    """Counts of bits in hashed contexts, gated weights, and the adaptive table.

    The slots of all contexts stand in one array, one context after the other.
    """

    sizes: tuple[int, ...]
    counts: np.ndarray  # of all slots: bits that were 0, bits that were 1, by turns
    weights: np.ndarray  # GATES x (contexts + 1)
    table: np.ndarray  # nodes x BINS x 2

    @classmethod
    def fresh(cls, sizes: tuple[int, ...], nodes: int) -> Mixer:
        w = np.full((GATES, len(sizes) + 1), 1.2 / len(sizes))
        w[:, -1] = 0
        return cls(sizes, np.zeros(2 * sum(sizes), np.int32), w, np.zeros((nodes, BINS, 2)))

    def places(self) -> list[tuple[int, int]]:
        """Where each context's slots begin and end."""
        return list(itertools.pairwise(itertools.accumulate(self.sizes, initial=0)))

    def ready(self) -> Mixer:
        """Logits of all slots from the counts, and the table's probabilities.

        The last two bits of a logit of the last two contexts tell the slot's confidence: that moves the logit by three units
        of its last place at most, and saves looking up both.
        """
        self.logit = np.empty(len(self.counts) // 2, "f4")
        sure = len(self.logit) - sum(self.sizes[-2:])
        for a in range(0, len(self.logit), BATCH):  # what a step needs stays in the cache
            zeros, ones = self.counts[2 * a : 2 * (a + BATCH)].astype("f4").reshape(-1, 2).T
            part = self.logit[a : a + BATCH]
            np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4)), out=part)
            part += np.float32(1e-12)  # not 0, which would leave a subnormal number of the confidence's bits alone
            if a + BATCH > sure:
                n = (zeros + ones)[max(0, sure - a) :]
                raw = part[max(0, sure - a) :].view(np.int32)
                raw &= ~3
                for least in SURE:
                    raw += n >= least
        middle = squash((np.arange(BINS) - BINS // 2) / 1.5)
        self.refined = ((self.table[:, :, 1] + 32 * middle) / (self.table.sum(axis=2) + 32)).astype("f4").reshape(-1)
        return self

    def inputs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The logits of the slots of each bit (contexts x bits) and a constant, and the bits' gates."""
        x = np.empty((len(at) + 1, at.shape[1]), "f4")
        for (a, b), y, out in zip(self.places(), at, x, strict=False):
            np.take(self.logit[a:b], y, out=out, mode="clip")
        x[-1] = 0.3
        sure = x[-3:-1].view(np.int32) & 3
        return x, sure[1] * 4 + sure[0]

    def dot(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """The weighted sums of the inputs, by the gates' weights: all gates' sums, of which each bit takes one."""
        w, out = self.weights.astype("f4"), np.empty(len(gate), "f4")
        for a in range(0, len(gate), BATCH):
            sums, g = w @ x[:, a : a + BATCH], gate[a : a + BATCH]
            np.take(sums.reshape(-1), g * len(g) + np.arange(len(g)), out=out[a : a + BATCH], mode="clip")
        return out

    def bins(self, dot: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The table's cell of each bit."""
        return node * BINS + np.rint(np.clip(dot * np.float32(1.5), -(BINS // 2), BINS // 2) + np.float32(BINS // 2)).astype(np.int32)

    def final(self, dot: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mixed and refined probabilities of a 1."""
        p = squash(dot)
        return p, np.clip((p + np.take(self.refined, self.bins(dot, node))) * np.float32(0.5), np.float32(1e-6), np.float32(1 - 1e-6))

    def teach(self, at: np.ndarray, node: np.ndarray, bit: np.ndarray) -> None:
        """Predict a batch of bits, then let them teach weights and table."""
        x, gate = self.inputs(at)
        dot = self.dot(x, gate)
        x *= bit.astype("f4") - squash(dot)
        gate = gate.astype(np.int64)
        taught = np.stack([np.bincount(gate, y, minlength=GATES) for y in x], axis=1)
        self.weights += 0.15 * taught / np.maximum(np.bincount(gate, minlength=GATES), 200)[:, None]
        self.table += np.bincount(self.bins(dot, node) * 2 + bit, minlength=self.table.size).reshape(self.table.shape)

    def count(self, seen: np.ndarray) -> None:
        """Let bits teach the counts; ``seen`` holds their slots (contexts x bits) twice, and 1 more for a 1."""
        for (a, b), y in zip(self.places(), seen, strict=True):
            self.counts[2 * a : 2 * b] += np.bincount(y, minlength=2 * (b - a)).astype(self.counts.dtype)

    def learn(self, at: list[np.ndarray], node: np.ndarray, bit: np.ndarray) -> None:
        """Predict a run of bits, batch by batch, then let them teach weights, table and counts."""
        self.ready()
        seen = np.empty((len(at), len(bit)), np.int32)
        for a in range(0, len(bit), BATCH):
            part = slice(a, a + BATCH)
            slots = np.stack([y[part] for y in at])
            self.teach(slots, node[part], bit[part])
            seen[:, part] = slots * 2 + bit[part]
        self.count(seen)

    def learn_codes(self, codes: Codes) -> int:
        """As ``learn``, for the bits of tokens, which are spelled batch by batch; how many there were."""
        self.ready()
        ends = np.cumsum(codes.depth, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        cuts = [0, *np.searchsorted(ends, np.arange(BATCH, total, BATCH)).tolist(), len(ends)]
        seen, n = np.empty((len(self.sizes), total), np.int32), 0
        for a, b in itertools.pairwise(cuts):
            bits = codes.bits(np.arange(a, b), self.sizes)
            if bits.n:
                self.teach(bits.at, bits.node, bits.bit)
                seen[:, n : n + bits.n] = bits.at * 2 + bits.bit
                n += bits.n
        self.count(seen)
        return total

    def lean(self) -> Mixer:
        """Without the counts, which scoring does not need."""
        self.counts = np.zeros(0)
        return self

    def rest(self, n: int) -> np.ndarray:
        """What is learnt besides the counts, weights by the ``n`` bits that taught them."""
        return np.concatenate([self.table.reshape(-1), self.weights.reshape(-1) * n, [n]])

    def unpacked(self, counts: np.ndarray, values: np.ndarray) -> Mixer:
        self.counts, at = counts, self.table.size
        self.table.reshape(-1)[:] = values[:at]
        if values[at + self.weights.size] > 0:
            self.weights = values[at : at + self.weights.size].reshape(self.weights.shape) / values[at + self.weights.size]
        return self.ready()


@dataclass
class Bits:
    """Bits of some tokens level by level, the first bits of all tokens first; at each level come the tokens of the longest codes."""

    order: np.ndarray  # the tokens, those of the longest codes first
    back: np.ndarray  # where each token stands in that order
    levels: list[int]  # how many tokens have a bit at each level
    at: np.ndarray  # contexts x bits: slots
    node: np.ndarray
    bit: np.ndarray
    n: int

    def laid(self, of_token: np.ndarray) -> np.ndarray:
        """What each bit has from its token, by the last axis; tokens come as in ``order``."""
        return np.concatenate([of_token[..., :m] for m in self.levels], axis=-1)

    def summed(self, of_bit: np.ndarray) -> np.ndarray:
        """Sums of each token's bits, by the last axis."""
        total = np.zeros((len(of_bit), len(self.order)), of_bit.dtype)
        a = self.levels[0]
        total[:, :a] = of_bit[:, :a]
        for m in self.levels[1:]:
            total[:, :m] += of_bit[:, a : a + m]
            a += m
        return np.take(total, self.back, axis=1)


@dataclass
class Codes:
    """Tokens as they are spelled: where each one's code starts and how many bits it has, its contexts, and what its table's cells go by."""

    steps: np.ndarray  # of all codes: a node twice, and 1 more if its bit is 1
    first: np.ndarray
    depth: np.ndarray
    contexts: np.ndarray  # contexts x tokens: the first slot of each, before the node moves it on
    spread: int  # so many contexts, the last ones, are hashed
    kind: np.ndarray | None = None  # the class, if the table goes by it

    def bits(self, part: np.ndarray, sizes: tuple[int, ...]) -> Bits:
        """The bits of the tokens ``part``, for contexts of so many slots."""
        depth = np.take(self.depth, part)
        order = np.argsort(255 - depth, kind="stable")
        levels = (len(depth) - np.cumsum(np.bincount(depth)))[:-1].tolist()
        back, part = np.empty_like(order), part[order]
        back[order] = np.arange(len(order))
        found = Bits(order, back, levels, np.zeros((len(sizes), 0), np.int32), depth[:0], depth[:0], sum(levels))
        if not levels:
            return found
        first = np.take(self.first, part)
        step = np.take(self.steps, np.concatenate([first[:m] + j for j, m in enumerate(levels)]))
        node, found.bit = step >> 1, step & 1
        at, exact = np.take(self.contexts, part, axis=1), len(sizes) - 1 - self.spread
        found.at = at = np.concatenate([node[None], found.laid(at)])
        at[1 : 1 + exact] += node
        hashed = at[1 + exact :]
        hashed += steps(node)  # may pass the largest number: only the last bits matter
        hashed &= np.array(sizes[1 + exact :], np.int32)[:, None] - 1
        found.node = node if self.kind is None else found.laid(np.take(self.kind, part))
        return found


def added_up(batches: Iterator[pa.RecordBatch], whole: int) -> Iterator[pa.RecordBatch]:
    """Sums of the values of each chunk; rows come sorted by chunk. Those of the first ``whole`` chunks are counts."""
    key, total = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "values"])

    for batch in batches:
        for chunk, values in zip(batch.column("chunk").to_pylist(), batch.column("values").to_pylist(), strict=True):
            part = np.frombuffer(values, "i4" if chunk < whole else "f8")
            if chunk != key:
                if total is not None:
                    yield out()
                key, total = chunk, np.zeros(len(part))
            total += part
    if total is not None:
        yield out()


def in_chunks(n: int) -> int:
    """How many chunks ``n`` values take."""
    return -(-n // CHUNK)


def chunks(mixers: list[tuple[Mixer, int]]) -> Iterator[pa.RecordBatch]:
    """What mixers learnt from so many bits, as chunks of each one's counts and then of all the rest, a few MB at a time."""
    at, rest = 0, np.concatenate([m.rest(n) for m, n in mixers])
    for values in (*(m.counts for m, _ in mixers), rest):
        for a in range(0, len(values), CHUNK << 10):
            part = values[a : a + (CHUNK << 10)]
            cut = [part[i : i + CHUNK] for i in range(0, len(part), CHUNK)]
            some = [i for i, c in enumerate(cut) if c.any()]
            yield pa.RecordBatch.from_arrays([pa.array([at + a // CHUNK + i for i in some], pa.int32()), pa.array([cut[i].tobytes() for i in some], pa.binary())], ["chunk", "values"])
        at += in_chunks(len(values))


def gathered(rows: DataFrame, *into: Mixer) -> list[Mixer]:
    """The mixers from the summed chunks of all tasks; their size is fixed."""
    counts = [len(m.counts) for m in into]
    rests = [len(m.rest(0)) for m in into]
    starts = np.cumsum([0, *map(in_chunks, counts)]) * CHUNK
    whole = int(starts[-1]) // CHUNK
    summed = rows.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(lambda x: added_up(x, whole), ADDED).collect()
    values = np.zeros(int(starts[-1]) + sum(rests))
    for r in summed:
        part = np.frombuffer(r["values"])
        values[r["chunk"] * CHUNK : r["chunk"] * CHUNK + len(part)] = part
    cut = np.split(values[starts[-1] :], np.cumsum(rests)[:-1])
    return [m.unpacked(values[a : a + n], v).lean() for m, a, n, v in zip(into, starts, counts, cut, strict=False)]


def huffman(weights: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes and bits of all codes, one after the other, and the length of each code."""
    heap = [(w, i, (i,)) for i, w in enumerate(weights)]
    codes: list[list[tuple[int, int]]] = [[] for _ in weights]
    heapq.heapify(heap)
    node = len(weights) - 2
    while len(heap) > 1:
        (w0, a, x), (w1, b, y) = heapq.heappop(heap), heapq.heappop(heap)
        for bit, leaves in ((0, x), (1, y)):
            for leaf in leaves:
                codes[leaf].append((node, bit))
        heapq.heappush(heap, (w0 + w1, min(a, b), x + y))
        node -= 1
    walked = [c[::-1] for c in codes]
    flat = [step for c in walked for step in c]
    return np.array([n for n, _ in flat], np.int64), np.array([b for _, b in flat], np.int64), np.array([len(c) for c in walked], np.int64)


def word_codes(group: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``huffman``, with a tree for each group of leaves; leaves of no weight have no code."""
    parent, side, new = np.full(2 * len(group), -1, np.int64), np.zeros(2 * len(group), np.int8), len(group)
    order = np.argsort(group, kind="stable")
    order = order[weight[order] > 0]
    for leaves in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        heap = list(zip(weight[leaves].tolist(), leaves.tolist(), strict=True))
        heapq.heapify(heap)
        while len(heap) > 1:
            (w0, a), (w1, b) = heapq.heappop(heap), heapq.heappop(heap)
            parent[a] = parent[b] = new
            side[b] = 1
            heapq.heappush(heap, (w0 + w1, new))
            new += 1
    depth, up = np.zeros(len(group), np.int64), parent[: len(group)]
    while (up >= 0).any():
        depth += up >= 0
        up = np.where(up >= 0, parent[up], -1)
    nodes, bits = np.zeros(int(depth.sum()), np.int32), np.zeros(int(depth.sum()), np.int8)
    at, place = np.arange(len(group)), np.cumsum(depth) - 1
    at, place = at[depth > 0], place[depth > 0]
    while len(at):
        nodes[place], bits[place] = parent[at] - len(group), side[at]
        at, place = parent[at], place - 1
        below = parent[at] >= 0
        at, place = at[below], place[below]
    return nodes, bits, depth


#: Slots of the class mixer's contexts: node; 1, 2, 3 classes before; the token before.
CLASS_SLOTS = (64, 64 * 65, 1 << 18, 1 << 18, 1 << 18)
#: Those of the word mixer besides the node's own: 1, 2, 3 classes before; the token before.
WORD_SLOTS = (1 << 18, 1 << 18, 1 << 18, 1 << 18)
#: Those of the spelling mixer: 1 to 4 bytes before.
SPELL_SLOTS = (1 << 16, 1 << 18, 1 << 18, 1 << 18)


class Tokens:
    """The frequent tokens, the classes and their code."""

    def __init__(self, head: list[tuple[bytes, int]], endings: list[tuple[bytes, int, int]], total: int, kinds: int):
        top = [e for e in sorted(endings, key=lambda e: (-e[1], e[0])) if e[0] != END][:CLASSES]
        self.class_of = {END: 0} | {e[0]: i + 1 for i, e in enumerate(top)}
        self.other = len(top) + 1
        count, singles = np.zeros(len(top) + 2), np.zeros(len(top) + 2)
        for ending, n, once in endings:
            k = self.class_of.get(ending, self.other)
            count[k] += n
            singles[k] += once
        self.log_new = np.log10((singles + 1) / (count + singles + 2))  # of a word that training lacks
        self.log_known = np.log10((count + 1) / (count + singles + 2))
        nodes, bits, self.depth = huffman((count + 1).tolist())
        self.steps = (nodes * 2 + bits).astype(np.int32)
        self.first = np.cumsum(self.depth) - self.depth
        self.index = {w: i for i, (w, _) in enumerate(head)}
        n = np.array([c for _, c in head], "f8")
        self.hashes = np.array([xxhash.xxh64_intdigest(w) for w, _ in head], U64)
        self.classes = np.array([self.class_of.get(w[-2:], self.other) for w, _ in head], np.int64)
        self.below = total + 0.1 * (kinds + 1)
        self.head_base = np.log10((n + 0.1) / self.below) if self.below > 0 else np.zeros(0)
        tail = np.maximum(count - np.bincount(self.classes, n, minlength=len(count)), 0)
        self.log_tail = self.log_known - np.log10(np.maximum(tail, 1))  # with log10 of a word's count, after the leaf of such words
        nodes, bits, self.word_depth = word_codes(np.r_[self.classes, np.arange(len(count))], np.r_[n, tail])
        self.word_steps = nodes * 2 + bits
        self.word_first = np.cumsum(self.word_depth) - self.word_depth
        self.word_slots = (max(64, len(head) + len(count)), *WORD_SLOTS)
        #: A word's share of its class by the counts alone, without contexts.
        self.head_score = np.log10(np.maximum(n, 1)) + (self.log_known - np.log10(np.maximum(count, 1)))[self.classes]

    def read(self, texts: list[bytes]):
        """(tokens' places in the head or -1, classes, tokens in each text, the words)."""
        split = [x.lower().split() for x in texts]
        lens = np.fromiter(map(len, split), np.int64, len(split)) + 1
        words = list(itertools.chain.from_iterable((*w, END) for w in split))
        ids = np.fromiter(map(self.index.get, words, itertools.repeat(-1)), np.int64, len(words))
        kind = self.classes[ids] if len(self.classes) else np.zeros(len(ids), np.int64)
        rare = np.flatnonzero(ids < 0)
        kind[rare] = [self.class_of.get(words[i][-2:], self.other) for i in rare.tolist()]
        return ids, kind, lens, words

    def phrases(self, ids: np.ndarray, lens: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places where phrases start, hashes of the tokens before, hashes of the phrases, which end where the next starts or the text ends)."""
        h = self.hashes[ids] if len(self.hashes) else np.zeros(len(ids), U64)
        rare = np.flatnonzero(ids < 0)
        h[rare] = np.fromiter((xxhash.xxh64_intdigest(words[i]) for i in rare), U64, len(rare))
        doc, ends = np.repeat(np.arange(len(lens)), lens), np.cumsum(lens)
        before = mix(gram_hashes(h, ORDER))  # of the tokens from each place on; the phrase would start ORDER places later
        at = np.flatnonzero(before & U64(RATE - 1) == 0)
        at = at[at + ORDER < ends[doc[at]]]
        start = at + ORDER
        stop = np.minimum(np.r_[start[1:], len(h)][: len(start)], ends[doc[start]])
        place = np.arange(len(h)) - np.repeat(np.r_[0, start], np.diff(np.r_[0, start, len(h)]))
        sums = np.r_[U64(0), np.cumsum(mix(h ^ mix(place.astype(U64))), dtype=U64)]
        return start, before[at], sums[stop] - sums[start]

    def contexts(self, ids: np.ndarray, kind: np.ndarray, lens: np.ndarray) -> list[np.ndarray]:
        """Numbers of the contexts before each token: 1, 2, 3 classes and the token."""
        start = np.cumsum(lens) - lens
        token = np.where(ids < 0, HEAD + kind, ids)
        before, c = kind, []
        none = len(self.depth)
        at = np.arange(len(kind)) - np.repeat(start, lens)
        for n in (1, 2, 3):
            before = np.r_[none, before[:-1]][: len(kind)]
            before = np.where(at < n, none, before)
            c.append(before)
        out = [c[0], c[0] * 65 + c[1], (c[0] * 65 + c[1]) * 65 + c[2]]
        last = np.r_[0, token[:-1]][: len(kind)]
        return [*out, np.where(at < 1, HEAD + 100, last)]

    def class_codes(self, kind: np.ndarray, contexts: list[np.ndarray]) -> Codes:
        hashed = [spread(c) for c in contexts[1:]]
        return Codes(self.steps, self.first[kind], self.depth[kind].astype(np.uint8), np.stack([contexts[0] * 64, *hashed]).astype(np.int32), len(hashed))

    def word_codes(self, ids: np.ndarray, kind: np.ndarray, contexts: list[np.ndarray]) -> Codes:
        """The words within their classes."""
        leaf = np.where(ids < 0, len(self.index) + kind, ids)
        hashed = [spread(c * 4 + k) for k, c in enumerate(contexts)]
        return Codes(self.word_steps, self.word_first[leaf], self.word_depth[leaf].astype(np.uint8), np.stack(hashed).astype(np.int32), len(hashed), kind.astype(np.int32))


def spread(context: np.ndarray) -> np.ndarray:
    """30 hashed bits of each context."""
    return ((context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(34)).astype(np.int64)


def slots_of(hashed: np.ndarray, of: np.ndarray, moved: np.ndarray, size: int) -> np.ndarray:
    """The slots of bits: their context's hash, moved on by the node."""
    out = np.take(hashed, of)
    out += moved
    out &= size - 1
    return out


def steps(node: np.ndarray) -> np.ndarray:
    """How far nodes move their bits on."""
    return node * 40_503


def counted(batches: Iterator[pa.RecordBatch], most: int = 250_000) -> Iterator[pa.RecordBatch]:
    """(token, c), added up within the task as far as its memory goes."""
    held: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["token", "c"])
        held.clear()
        return got

    for batch in text_slices(batches):
        for text in texts_of(batch):
            held.update(text.lower().split())
        held[END] += batch.num_rows
        if len(held) > most:
            yield out()
    if held:
        yield out()


def spelled(words: list[bytes], tokens: Tokens):
    """(slots in each context, nodes, bits, word of each bit) for the bytes of words from the last to the first, and an end.

    The class has told the last two bytes of a word already, unless it is the class of all other endings.
    """
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    chars = np.frombuffer(b"".join(w[::-1] + b" " for w in words), np.uint8).astype(np.int64)
    at = np.arange(len(chars)) - np.repeat(np.cumsum(lens) - lens, lens)
    before, history, shifted = np.zeros(len(chars), np.int64), [], chars
    for n in range(1, 5):
        shifted = np.r_[0, shifted[:-1]][: len(chars)]
        before = before * 257 + np.where(at < n, 0, shifted + 1)
        history.append(before)
    told = np.array([len(w[-2:]) if w[-2:] in tokens.class_of else 0 for w in words], np.int64)
    coded = np.flatnonzero(at >= np.repeat(told, lens))
    of = np.repeat(coded, 8)
    shift = np.tile(np.arange(7, -1, -1), len(coded))
    bit = chars[of] >> shift & 1
    node = (chars[of] | 256) >> (shift + 1)
    moved = steps(node)
    slots = [slots_of(spread(history[k] * 5 + k), of, moved, SPELL_SLOTS[k]) for k in range(4)]
    return slots, node, bit, np.repeat(np.arange(len(words)), lens)[of]


def train_spelling(batches: Iterator[pa.RecordBatch], tokens: Tokens) -> Iterator[pa.RecordBatch]:
    mixer, n = Mixer.fresh(SPELL_SLOTS, 256), 0
    for batch in batches:
        words = [w for w in batch.column("token").to_pylist() if w]
        for at in range(0, len(words), 4000):
            slots, node, bit, _ = spelled(words[at : at + 4000], tokens)
            mixer.learn(slots, node, bit)
            n += len(bit)
    if n:
        yield from chunks([(mixer, n)])


def spell_scores(mixer: Mixer, words: list[bytes], tokens: Tokens) -> np.ndarray:
    """log10 of each word's probability by its bytes."""
    out = []
    for at in range(0, len(words), 4000):
        part = words[at : at + 4000]
        slots, node, bit, of = spelled(part, tokens)
        x, gate = mixer.inputs(np.stack(slots))
        _, p = mixer.final(mixer.dot(x, gate), node)
        out.append(np.bincount(of, log10_of(p, bit), minlength=len(part)))
    return np.concatenate(out) if out else np.zeros(0)


def train_classes(batches: Iterator[pa.RecordBatch], tokens: Tokens) -> Iterator[pa.RecordBatch]:
    """Both mixers of known words: of classes, and of words within them."""
    mixer, worder, n, m = Mixer.fresh(CLASS_SLOTS, 64), Mixer.fresh(tokens.word_slots, 64), 0, 0
    for batch in text_slices(batches, limit=1 << 20):
        ids, kind, lens, _ = tokens.read(texts_of(batch))
        contexts = tokens.contexts(ids, kind, lens)
        n += mixer.learn_codes(tokens.class_codes(kind, contexts))
        m += worder.learn_codes(tokens.word_codes(ids, kind, contexts))
    if n:
        yield from chunks([(mixer, n), (worder, m)])


def adapted(mixer: Mixer, codes: Codes, lens: np.ndarray) -> np.ndarray:
    """log10 probability of each token's bits; the weights adapt within a text from block to block.

    The same blocks of ``TOGETHER`` texts are scored at a time, so that their bits stay in the cache.
    """
    out, own = np.zeros(int(lens.sum())), np.zeros((mixer.weights.shape[1], len(lens)), "f4")
    starts, blocks = np.cumsum(lens) - lens, -(-lens // BLOCK)
    longest = np.argsort(-blocks, kind="stable")
    for block in range(int(blocks.max(initial=0))):
        left = longest[: np.searchsorted(-blocks[longest], -block)]  # texts that have this block
        for a in range(0, len(left), TOGETHER):
            docs = left[a : a + TOGETHER]
            n = np.minimum(lens[docs] - block * BLOCK, BLOCK)
            first = np.cumsum(n) - n
            part = np.arange(int(n.sum())) + np.repeat(starts[docs] + block * BLOCK - first, n)
            bits = codes.bits(part, mixer.sizes)
            if not bits.n:  # none of the tokens has bits
                continue
            x, gate = mixer.inputs(bits.at)
            dot = mixer.dot(x, gate)
            if block:
                dot += np.einsum("ij,ij->j", bits.laid(np.take(own, np.repeat(docs, n)[bits.order], axis=1)), x)
            p, q = mixer.final(dot, bits.node)
            told = np.empty((len(x) + 1, bits.n), "f4")
            told[0] = log10_of(q, bits.bit)
            np.multiply(x, bits.bit.astype("f4") - p, out=told[1:])
            told = bits.summed(told)
            out[part] = told[0]
            taught = np.add.reduceat(told[1:], first, axis=1)
            own[:, docs] += np.float32(0.1) * taught / np.maximum(np.add.reduceat(codes.depth[part], first, dtype=np.int64), 200).astype("f4")
    return out


def class_scores(tokens: Tokens, mixer: Mixer, ids: np.ndarray, kind: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """log10 probability of each token's class."""
    return adapted(mixer, tokens.class_codes(kind, tokens.contexts(ids, kind, lens)), lens)


def word_scores(tokens: Tokens, mixer: Mixer, ids: np.ndarray, kind: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """log10 probability of each token within its class, if known; for one outside the head, that of being outside."""
    return adapted(mixer, tokens.word_codes(ids, kind, tokens.contexts(ids, kind, lens)), lens)


def lists(of: np.ndarray, n: int, **fields: pa.Array) -> pa.ListArray:
    """A list of structs for each of ``n`` texts; ``of`` names the text of each, in order."""
    ends = np.r_[0, np.cumsum(np.bincount(of, minlength=n))]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


SCORED = "doc_id long, held_out boolean, row long, n_bytes long, n_tokens long, n_head long, base double, score double, tail array<struct<token:binary,seg:int,tf:int,leaf:float>>, phrases array<struct<seg:int,key:long,phrase:long,own:float>>"


def score_texts(batches: Iterator[pa.RecordBatch], tokens: Tokens, mixer: Mixer, worder: Mixer) -> Iterator[pa.RecordBatch]:
    """Scores without the tokens outside the head, which stand in ``tail``; ``seg`` numbers a text's phrases from 0, -1 is before them."""
    names = [c.split()[0] for c in SCORED.split(", ")]
    for batch in text_slices(batches, limit=1 << 20):
        texts = texts_of(batch)
        ids, kind, lens, words = tokens.read(texts)
        n, doc, known = len(lens), np.repeat(np.arange(len(lens)), lens), ids >= 0
        within = word_scores(tokens, worder, ids, kind, lens)
        own = class_scores(tokens, mixer, ids, kind, lens) + np.where(known, within + tokens.log_known[kind], 0)
        within += tokens.log_tail[kind]
        start, key, phrase = tokens.phrases(ids, lens, words)
        phrase_doc, first = doc[start], np.searchsorted(doc[start], np.arange(n))
        number = np.arange(len(start)) - first[phrase_doc]
        last = np.searchsorted(start, np.arange(len(ids)), side="right") - 1  # the phrase at or before each token
        inside = np.where(last >= first[doc], last, -1)
        seg = np.where(inside >= 0, last - first[doc], -1)
        phrase_own = np.bincount(inside[inside >= 0], own[inside >= 0], minlength=len(start))
        seen: dict[tuple[int, int, bytes], int] = {}
        rare_words, rare_doc, rare_seg, tf, leaf = [], [], [], [], []
        rare = np.flatnonzero(~known)
        for i, d, g, v in zip(rare.tolist(), doc[rare].tolist(), seg[rare].tolist(), within[rare].tolist(), strict=True):
            j = seen.setdefault((d, g, words[i]), len(tf))
            if j == len(tf):
                rare_words.append(words[i])
                rare_doc.append(d)
                rare_seg.append(g)
                tf.append(1)
                leaf.append(v)
            else:
                tf[j] += 1
                leaf[j] += v
        tails = lists(np.array(rare_doc, np.int64), n, token=pa.array(rare_words, pa.binary()), seg=pa.array(rare_seg, pa.int32()), tf=pa.array(tf, pa.int32()), leaf=pa.array(leaf, pa.float32()))
        phrases = lists(phrase_doc, n, seg=pa.array(number, pa.int32()), key=pa.array(key.view(np.int64)), phrase=pa.array(phrase.view(np.int64)), own=pa.array(phrase_own, pa.float32()))
        base = np.bincount(doc[known], tokens.head_base[ids[known]], minlength=n)
        cols = [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), batch.column("row"), pa.array([len(t) for t in texts], pa.int64()), pa.array(lens), pa.array(np.bincount(doc[known], minlength=n), pa.int64()), pa.array(base), pa.array(np.bincount(doc, own, minlength=n)), tails, phrases]
        yield pa.RecordBatch.from_arrays(cols, names)


PARTS = "row long, seg int, n_tail int, base double, score float"


def tail_parts(batches: Iterator[pa.RecordBatch], tokens: Tokens, mixer: Mixer) -> Iterator[pa.RecordBatch]:
    """What tokens outside the head add to the scores of their texts and phrases: by their counts, or by their bytes if training lacks them."""
    names = [c.split()[0] for c in PARTS.split(", ")]
    for batch in batches:
        tf, c = batch.column("tf").to_numpy(), batch.column("c").fill_null(0).to_numpy()
        score = batch.column("leaf").to_numpy() + tf * np.log10(np.maximum(c, 1))
        new = np.flatnonzero(c == 0)
        words = batch.column("token").take(pa.array(new)).to_pylist()
        kind = np.array([tokens.class_of.get(w[-2:], tokens.other) for w in words], np.int64)
        score[new] = tf[new] * (tokens.log_new[kind] + spell_scores(mixer, words, tokens))
        base = tf * np.log10((c + 0.1) / tokens.below)
        known = np.where(c > 0, tf, 0).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("seg"), pa.array(known), pa.array(base, pa.float64()), pa.array(score, pa.float32())], names)


#: Slots of the mixer of phrase bits: how many phrases are known (by powers of two); with the last bit of the text; with the last two.
PHRASE_SLOTS = (16, 64, 256)


def phrase_bits(batch: pa.RecordBatch):
    """(slots in each context, nodes, bits, text of each bit) of the looked-up phrases of each text, and their columns."""
    events = batch.column("events")
    lens = np.diff(events.offsets.to_numpy())
    of, flat = np.repeat(np.arange(len(lens)), lens), events.flatten()
    n_key, n_phrase, own = (flat.field(f).to_numpy() for f in ("n_key", "n_phrase", "own"))
    bit = (n_phrase > 0).astype(np.int64)
    at = np.arange(len(of)) - np.repeat(np.cumsum(lens) - lens, lens)
    last = np.where(at < 1, 0, np.r_[0, bit[:-1] + 1][: len(bit)])
    one_before = np.where(at < 2, 0, np.r_[0, 0, bit[:-2] + 1][: len(bit)])
    node = np.minimum(15, np.log2(n_key)).astype(np.int64)
    return [node, node * 4 + last, (node * 4 + last) * 4 + one_before], node, bit, of, n_key, n_phrase, own


def train_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mixer, n = Mixer.fresh(PHRASE_SLOTS, 16), 0
    for batch in batches:
        slots, node, bit, *_ = phrase_bits(batch)
        mixer.learn(slots, node, bit)
        n += len(bit)
    if n:
        yield from chunks([(mixer, n)])


def phrase_scores(batches: Iterator[pa.RecordBatch], mixer: Mixer) -> Iterator[pa.RecordBatch]:
    """(row, add): what the looked-up phrases add to a text's score; a known one takes the place of its tokens."""
    for batch in batches:
        slots, node, bit, of, n_key, n_phrase, own = phrase_bits(batch)
        x, gate = mixer.inputs(np.stack(slots))
        _, p = mixer.final(mixer.dot(x, gate), node)
        add = log10_of(p, bit) + np.where(bit == 1, np.log10(np.maximum(n_phrase, 1) / n_key) - own, 0)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.bincount(of, add, minlength=batch.num_rows))], ["row", "add"])


def looked_up(scored: DataFrame, parts: DataFrame) -> DataFrame:
    """(row, held_out, events): the phrases of each text whose tokens before are in other training texts, in order, with their counts there.

    Phrases are counted over all training texts that have the tokens before, also where no text but one has them: a held-out
    copy of that one finds them.
    """
    train = (~F.col("held_out")).cast("long")
    phrases = scored.select("row", "held_out", F.inline("phrases"))
    keys = materialise(phrases.groupBy("key").agg(F.count("*").alias("n"), F.sum(train).alias("n_key")).where("n > 1"), "keys")
    met = skew_join(phrases, keys, "key")
    met = materialise(met.select("row", "held_out", "seg", "own", (F.col("n_key") - train).alias("n_key"), F.xxhash64("key", "phrase").alias("phrase")), "met")
    known = materialise(met.groupBy("phrase").agg(F.count("*").alias("n"), F.sum(train).alias("n_phrase")), "known")
    events = skew_join(met.where("n_key > 0"), known, "phrase").join(parts.select("row", "seg", F.col("score").alias("tail")), ["row", "seg"], "left")
    event = F.struct("seg", "n_key", (F.col("n_phrase") - train).alias("n_phrase"), (F.col("own") + F.coalesce("tail", F.lit(0.0))).alias("own"))
    return materialise(events.groupBy("row").agg(F.first("held_out").alias("held_out"), F.array_sort(F.collect_list(event)).alias("events")), "events")


def text_scores(docs: DataFrame, modulus: int = 10, held: int = 0, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte for each row of ``docs``."""
    sc = docs.sparkSession.sparkContext
    held_out = remainder("doc_id", modulus) == held
    training = docs.where(~held_out).select("text")
    counts = materialise(training.mapInArrow(counted, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c")), "counts")
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the frequent tokens are those over a count that ``head`` tokens at most are over
    step = F.when(F.col("c") < COMMON, F.col("c")).otherwise(COMMON + F.floor(F.log(F.col("c") / COMMON) * 1000))
    over, least = 0, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"]):
        over += r["n"]
        if over > head:
            least = r["step"]
            break
    top = counts.where(step > least).toArrow()
    ending = F.when(F.octet_length("token") > 0, F.substring("token", -2, 2)).otherwise(F.col("token"))
    endings = counts.groupBy(ending.alias("e")).agg(F.sum("c").alias("c"), F.sum((F.col("c") == 1).cast("long")).alias("once")).collect()
    frequent = sorted(zip(top.column("token").to_pylist(), top.column("c").to_pylist(), strict=True), key=lambda r: (-r[1], r[0]))
    del top
    tokens = Tokens(frequent, [(bytes(r["e"]), r["c"], r["once"]) for r in endings], total, kinds)
    shared = sc.broadcast(tokens)
    mixers = sc.broadcast(gathered(training.mapInArrow(lambda x: train_classes(x, shared.value), ADDED), Mixer.fresh(CLASS_SLOTS, 64), Mixer.fresh(tokens.word_slots, 64)))
    speller = sc.broadcast(gathered(counts.select("token").mapInArrow(lambda x: train_spelling(x, shared.value), ADDED), Mixer.fresh(SPELL_SLOTS, 256))[0])
    rows = docs.select("doc_id", "text", held_out.alias("held_out"), F.monotonically_increasing_id().alias("row"))
    scored = materialise(rows.mapInArrow(lambda x: score_texts(x, shared.value, *mixers.value), SCORED), "scored")
    tail = scored.select("row", F.inline("tail")).join(counts, "token", "left")
    parts = tail.select("row", "seg", "token", "tf", "leaf", "c").mapInArrow(lambda x: tail_parts(x, shared.value, speller.value), PARTS)
    parts = materialise(parts.groupBy("row", "seg").agg(F.sum("n_tail").alias("n_tail"), F.sum("base").alias("base"), F.sum("score").alias("score")), "parts")
    events = looked_up(scored, parts)
    phraser = sc.broadcast(gathered(events.where("not held_out").select("events").mapInArrow(train_phrases, ADDED), Mixer.fresh(PHRASE_SLOTS, 16))[0])
    added = events.select("row", "events").mapInArrow(lambda x: phrase_scores(x, phraser.value), "row long, add double")
    tails = parts.groupBy("row").agg(F.sum("n_tail").alias("n_tail"), F.sum("base").alias("tail_base"), F.sum("score").alias("tail_score"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = scored.drop("tail", "phrases").join(tails, "row", "left").join(added, "row", "left")
    score = F.col("score") + zero("tail_score") + zero("add")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_head") + zero("n_tail")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + zero("tail_base")).alias("base_score"), score.alias("score"), (-score * math.log2(10) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))
