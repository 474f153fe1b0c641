"""Operators on documents against brute force, with nulls, empty and long texts, copies, repeated rows and empty tables."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import context_mixing, near_dedup, packing, quality, source_mixing, substring_dedup, toxicity
from lodestone.llm.queries import tokenizer_path

from .helpers import DOCS, document_rows

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    return document_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def crc(doc_id) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def shingles(text):
    w = SPLIT.findall(text or "")
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def near_components(rows):
    bags = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = sum((bags[i] & bags[j]).values())
        if both and both >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - both):
            root[find(j)] = find(i)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return groups.values()


@pytest.mark.parametrize("few", [24, 0])  # 0: all open bands are compared in tiles
def test_near_classes(docs, rows, few, monkeypatch):
    monkeypatch.setattr(near_dedup, "FEW", few)
    got = near_dedup.near_classes(docs).collect()
    want = collections.Counter()
    for group in near_components(rows):
        ids = [rows[i][0] for i in group]
        least = min((x for x in ids if x is not None), default=None)
        want.update((x, least) for x in ids)
    assert collections.Counter((r.doc_id, r.component_id) for r in got) == want
    assert sum(r.kept for r in got) == len(list(near_components(rows)))


def test_near_copies_in_tiles_chain(spark, monkeypatch):
    """A chain of texts each near the next, far from the first: one component, also where tiles are tiny."""
    monkeypatch.setattr(near_dedup, "FEW", 0)
    monkeypatch.setattr(near_dedup, "TILE", 3)
    base = [f"c{i}" for i in range(400)]
    rows = [(k, " ".join(base[6 * k : 6 * k + 200])) for k in range(25)]
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}


def test_one_is_kept_of_each_component_under_shared_ids(spark):
    """Unrelated texts with null ids or with one id twice; near and exact copies of some stand under other ids."""
    text = lambda k, last="end": " ".join([f"t{k}x{i}" for i in range(60)] + [last])
    rows = [(None, text(k)) for k in range(4)] + [(None, text(0))] + [(7, text(k)) for k in range(4, 8)] + [(7, text(4))]
    rows += [(8 + k, text(k, "other")) for k in range(4, 8)] + [(20, text(3)), (None, ""), (7, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = collections.Counter([*((None, text(k)) for k in range(3)), (20, text(3)), *((7, text(k)) for k in range(4, 8)), (None, ""), (7, " ")])
    assert collections.Counter(tuple(r) for r in near_dedup.without_near_copies(docs).collect()) == want
    assert sum(r.kept for r in near_dedup.near_classes(docs).collect()) == sum(want.values())


def test_without_near_copies_keeps_columns(docs, rows, no_docs):
    out = near_dedup.without_near_copies(docs)
    assert out.columns == docs.columns
    assert out.count() == len(list(near_components(rows)))
    assert near_dedup.without_near_copies(no_docs).count() == 0


def removed(rows):
    split = [SPLIT.findall(r[1] or "") for r in rows]
    starts = collections.Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    for r, w in zip(rows, split, strict=True):
        goes = [False] * len(w)
        for i in range(len(w) - 34):
            if starts[tuple(w[i : i + 35])] > 1:
                goes[i : i + 35] = [True] * 35
        yield r[0], len(w), [x for x, g in zip(w, goes, strict=True) if not g]


def test_substring_removal(docs, rows, no_docs):
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removal_table(docs).collect())
    want = collections.Counter((i, n, n - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for i, n, k in removed(rows))
    assert got == want
    assert substring_dedup.removal_table(no_docs).count() == 0


def test_without_repeats(docs, rows):
    out = substring_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    want = collections.Counter((i, r[1] if n == len(k) else " ".join(k)) for (i, n, k), r in zip(removed(rows), rows, strict=True))
    assert collections.Counter((r.doc_id, r.text) for r in out.collect()) == want


def test_packing(docs, rows, no_docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(docs, tokenizer_path(), capacity=256).collect()
    want = collections.Counter()
    for r in rows:
        ids = np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((r[0], k, at, len(ids[at : at + 256]), zlib.crc32(ids[at : at + 256].tobytes())) for k, at in enumerate(range(0, len(ids), 256)))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= -(-sum(r.length for r in got) // 256) * 1.15 + 1
    assert packing.pack(no_docs, tokenizer_path()).count() == 0


def test_words_of_a_text_give_its_ids():
    import random

    from tokenizers import Tokenizer

    whole, words = Tokenizer.from_file(tokenizer_path()), packing.WordIds(tokenizer_path())
    words.bound = 50
    rng = random.Random(0)
    signs = ["a", "B", "é", "́", "'s", "'T", ".", ",", "!", "…", "1", "½", "<|endoftext|>", "<|ENDOFTEXT|>", " ", "\n", " ", "\x1c", "ß", "İ", "中"]
    for _ in range(400):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(30)))
        split = packing.lowered(text.encode()).split()
        ids, n = words.of(split)
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids and len(n) == len(split), text


def test_mixing(docs, rows, no_docs):
    got = source_mixing.mix_table(docs, slices=8).collect()
    size = [len(SPLIT.findall(r[1] or "")) for r in rows]
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[3] == s) for s in sources}
    budget, target, free = 1.5 * sum(size), {}, set(sources)
    while True:
        left = budget - sum(target.values())
        w = sum(weight[s] for s in free)
        over = {s for s in free if left / w * weight[s] > 2 * total[s]}
        if not over:
            break
        target |= {s: 2.0 * total[s] for s in over}
        free -= over
    target |= {s: left / w * weight[s] for s in free}
    source = {r[0]: r[3] for r in rows}
    taken = collections.Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == total[s] and math.isclose(r.target, target[s], rel_tol=1e-9)
        assert r.taken in (0, r.size, 2 * r.size) and r.taken >= r.size * int(target[s] // total[s])
        taken[s] += r.taken
    longest = {s: max(n for n, r in zip(size, rows, strict=True) if r[3] == s) for s in sources}
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in sources)
    assert sorted(got, key=repr) == sorted(source_mixing.mix_table(docs.repartition(5), slices=8).collect(), key=repr)
    mixed = source_mixing.mixed_documents(docs, slices=8)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.taken // r.size for r in got if r.size)
    assert source_mixing.mix_table(no_docs).count() == 0


def test_base_and_model_scores(docs, rows, no_docs):
    got = context_mixing.text_scores(docs, head=50)  # most tokens are joined
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [[*SPLIT.findall((r[1] or "").translate(lower)), ""] for r in rows]
    c = collections.Counter(itertools.chain.from_iterable(t for t, r in zip(tokens, rows, strict=True) if crc(r[0]) % 10))
    n, v = sum(c.values()), len(c)
    want = sorted((str(r[0]), len(t), sum(c[w] > 0 for w in t), round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for t, r in zip(tokens, rows, strict=True))
    found = got.collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found) == want
    assert all(r.train_tokens == n and r.score < 0 and r.held_out == (crc(r.doc_id) % 10 == 0) for r in found)
    assert context_mixing.text_scores(no_docs).count() == 0


def test_probabilities_of_one_token_add_up():
    """Over all known tokens and the share of new words, a place's probabilities make 1."""
    head = [(w.encode(), n) for w, n in (("the", 50), ("of", 20), ("cat", 3), ("hat", 1), ("", 10))]
    endings = collections.defaultdict(lambda: [0, 0])
    for w, n in head:
        endings[w[-2:]][0] += n
        endings[w[-2:]][1] += n == 1
    tokens = context_mixing.Tokens(head, [(e, *x) for e, x in endings.items()], 84, 5)
    mixer = context_mixing.Mixer.fresh(context_mixing.CLASS_SLOTS, 64).ready()
    total = 0.0
    for i, (w, n) in enumerate(head):
        k = tokens.class_of.get(w[-2:], tokens.other)
        score = context_mixing.class_scores(tokens, mixer, np.array([i]), np.array([k]), np.array([1]))[0]
        total += 10 ** (score + tokens.head_score[i])
    for k in range(tokens.other + 1):
        score = context_mixing.class_scores(tokens, mixer, np.array([-1]), np.array([k]), np.array([1]))[0]
        total += 10 ** (score + tokens.log_new[k])
        if k == tokens.other:  # no word was counted there; its share of known words is not used
            total += 10 ** (score + math.log10(1 - 10 ** tokens.log_new[k]))
    assert abs(total - 1) < 1e-4


def test_word_codes_are_complete():
    group, weight = np.array([0, 0, 0, 1, 2, 2, 2, 2, 1]), np.array([5.0, 1, 1, 3, 9, 2, 2, 1, 0])
    nodes, bits, depth = context_mixing.word_codes(group, weight)
    for g in (0, 1, 2):
        assert sum(2.0**-d for d in depth[(group == g) & (weight > 0)]) == 1
    first = np.cumsum(depth) - depth
    codes = [tuple(zip(nodes[a : a + d], bits[a : a + d], strict=True)) for a, d in zip(first, depth, strict=True)]
    assert len({c for c in codes if c}) == 7 and depth[8] == 0 and max(nodes) < len(group)


def test_the_words_before_tell_words_of_one_class(spark):
    """Words of one ending, each told by the token before or by the third class before: scores far better than by counts."""
    import random

    rng = random.Random(2)
    texts = []
    for _ in range(300):
        i = [rng.randrange(64) for _ in range(40)]
        texts.append(" ".join(f"p{k}xx q{k}yy" for k in i))
    rows = list(enumerate(texts))
    got = context_mixing.text_scores(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    # by counts: 6 bits for each of the 80 words; with the token before: 6 bits for every other word
    bits = [-r.score * math.log2(10) / 40 for r in got]
    assert got and np.mean(bits) < 9


def test_blocks_whose_tokens_have_no_bits():
    """The end token is the only word of its class: where it is alone in a block, words have no bits there."""
    tokens = context_mixing.Tokens([(b"aaxx", 3), (b"bbxx", 2), (b"", 1)], [(b"xx", 5, 0), (b"", 1, 0)], 6, 3)
    worder = context_mixing.Mixer.fresh(tokens.word_slots, 64).ready()
    words = [b"aaxx", b"bbxx"] * (context_mixing.BLOCK // 2)
    for texts in ([b" ".join(words)], [b" ".join(words), b"", b" ".join(words * 3)], [b""]):
        ids, kind, lens, _ = tokens.read(texts)
        got = context_mixing.word_scores(tokens, worder, ids, kind, lens)
        assert len(got) == lens.sum() and (got[ids == 2] == 0).all() and (got[ids < 2] < 0).all()


def test_bits_come_level_by_level():
    """Against a walk along each token's code: nodes, bits, slots, what is laid out and summed; texts score the same alone and together."""
    import random

    rng = random.Random(7)
    index = [f"w{i}x".encode() for i in range(40)] + [b""]
    head = [(w, 1 + 99 // (i + 1)) for i, w in enumerate(index)]
    tokens = context_mixing.Tokens(head, [(b"0x", 99, 0), (b"1x", 60, 2), (b"2x", 40, 2), (b"", 3, 0)], 200, 41)
    worder = context_mixing.Mixer.fresh(tokens.word_slots, 64).ready()
    worder.logit[:] = np.random.default_rng(7).normal(size=len(worder.logit))
    texts = [b" ".join(rng.choice(index) for _ in range(n)) for n in (300, 0, 5, 97, 700, 96, 40)]
    ids, kind, lens, _ = tokens.read(texts)
    codes = tokens.word_codes(ids, kind, tokens.contexts(ids, kind, lens))
    part = np.array([3, 9, 400, 5, 7, 8, 301])
    bits = codes.bits(part, worder.sizes)
    laid = bits.laid(part[bits.order]).tolist()
    got = sorted(zip(laid, bits.at[0].tolist(), bits.bit.tolist(), bits.at[2].tolist(), bits.node.tolist(), strict=True))
    want = []
    for t in part.tolist():
        for step in codes.steps[codes.first[t] : codes.first[t] + int(codes.depth[t])].tolist():
            want.append((t, step >> 1, step & 1, (int(codes.contexts[1, t]) + (step >> 1) * 40_503) % worder.sizes[2], int(kind[t])))
    assert got == sorted(want) and bits.n == len(want) > 20
    assert bits.summed(np.ones((1, bits.n)))[0].tolist() == codes.depth[part].tolist()
    together, alone = context_mixing.word_scores(tokens, worder, ids, kind, lens), []
    for text in texts:
        i, k, n, _ = tokens.read([text])
        alone.append(context_mixing.word_scores(tokens, worder, i, k, n))
    assert np.allclose(together, np.concatenate(alone), atol=1e-4) and together.std() > 0.1


def test_memory_of_mixing_does_not_hold_all_bits():
    """A megabyte of text is spelled a batch at a time: training and scoring hold well under what its 64-bit slots would take."""
    import random
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(8)
    index = [f"{i}{e}".encode() for i in range(500) for e in ("xx", "yy")]
    tokens = context_mixing.Tokens([(w, 5) for w in index] + [(b"", 9)], [(b"xx", 2500, 0), (b"yy", 2500, 0), (b"", 9, 0)], 5009, 1001)
    text = [b" ".join(rng.choice(index) for _ in range(2000)).decode() for _ in range(90)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(90)), "text": text, "held_out": [False] * 90, "row": list(range(90))})
    mixers = context_mixing.Mixer.fresh(context_mixing.CLASS_SLOTS, 64).ready(), context_mixing.Mixer.fresh(tokens.word_slots, 64).ready()
    peaks = []
    for step in (lambda: sum(b.num_rows for b in context_mixing.train_classes(iter([batch]), tokens)), lambda: sum(b.num_rows for b in context_mixing.score_texts(iter([batch]), tokens, *mixers))):
        tracemalloc.start()
        assert step()
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
    assert max(peaks) < 140, peaks


def test_phrases_end_where_the_next_starts():
    """Against a loop over the tokens: places, tokens before and phrases agree wherever these have equal tokens, and only there."""
    import random

    rng = random.Random(4)
    passage = [f"w{rng.randrange(50)}".encode() for _ in range(300)]
    texts = [passage, passage[40:200], [b"one"], [], passage[100:] + [b"more"], [f"w{rng.randrange(9)}".encode() for _ in range(500)]]
    words = [w for t in texts for w in (*t, b"")]
    lens = np.array([len(t) + 1 for t in texts])
    index = {f"w{2 * i}".encode(): i for i in range(25)}
    tokens = context_mixing.Tokens([(w, 1) for w in index], [(b"w1", 5, 0)], 100, 60)
    ids = np.array([index.get(w, -1) for w in words])
    start, key, phrase = tokens.phrases(ids, lens, words)
    ends = np.cumsum(lens)
    of = np.searchsorted(ends, start, side="right")
    assert len(start) > 30 and (start - (ends - lens)[of] >= context_mixing.ORDER).all()
    stop = [min(s, ends[d]) for s, d in zip([*start[1:], len(words)], of, strict=True)]
    before = [tuple(words[s - context_mixing.ORDER : s]) for s in start]
    after = [tuple(words[a:b]) for a, b in zip(start, stop, strict=True)]
    assert len(set(before)) == len(set(key)) == len(set(zip(before, key, strict=True)))
    assert len(set(after)) == len(set(phrase)) == len(set(zip(after, phrase, strict=True)))
    found = set(before)
    for d, end in enumerate(ends):  # wherever these tokens come, a phrase starts
        for s in range(end - lens[d] + context_mixing.ORDER, end):
            assert (tuple(words[s - context_mixing.ORDER : s]) in found) == (s in start)


def test_texts_that_occur_twice_are_told_apart(spark):
    """What is known of phrases grows with the texts: copies, also of a part, score far better than clean texts, held out or not."""
    import random

    rng = random.Random(5)
    texts = [[f"w{rng.randrange(3000)}" for _ in range(150)] for _ in range(300)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(1000 + i, rows[i][1]) for i in range(40)]
    rows += [(2000 + i, " ".join(texts[50 + i][:90] + [f"w{rng.randrange(3000)}" for _ in range(60)])) for i in range(40)]
    got = {r.doc_id: r.bits_per_byte for r in context_mixing.text_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    clean = [got[i] for i in range(100, 300)]
    copies = [got[i] for i in [*range(40), *range(1000, 1040)] if crc(i % 1000) % 10 and crc(1000 + i % 1000) % 10]
    parts = [got[2000 + i] for i in range(40) if crc(50 + i) % 10]
    assert max(copies) < 0.6 * min(clean) and np.mean(parts) < 0.85 * np.mean(clean)


def test_held_out_copies_of_one_training_text(spark):
    """A held-out text whose only copy is one training text: under half of the bits of clean held-out texts."""
    import random

    rng = random.Random(6)
    held = [i for i in range(5000, 9000) if crc(i) % 10 == 0][:60]
    training = [i for i in range(400) if crc(i) % 10][:300]
    texts = {i: " ".join(f"w{rng.randrange(3000)}" for _ in range(150)) for i in training + held[30:]}
    rows = [*texts.items(), *zip(held[:30], (texts[i] for i in training[:30]), strict=True)]
    got = {r.doc_id: r for r in context_mixing.text_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].held_out for i in held) and not any(got[i].held_out for i in training)
    copies, clean = [got[i].bits_per_byte for i in held[:30]], [got[i].bits_per_byte for i in held[30:]]
    assert max(copies) < 0.5 * min(clean)


def labelled(spark, n=240):
    import random

    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        words = [("".join(rng.choice("abcdefgh") for _ in range(4))) for _ in range(90)]
        if bad:
            words = [w + "%%%" if rng.random() < 0.7 else w for w in words]
            words[rng.randrange(90)] = words[rng.randrange(90)] = "vilewort"
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, int(not bad), int(bad), "clash"))
    docs += [(n, None, None, None, None), (n + 1, "", None, None, None), (None, "x", None, None, None), docs[0]]
    labels += [(None, 1, 0, ""), (3, None, None, "")]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_quality(spark):
    docs, labels = labelled(spark)
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert np.mean([r.predicted == int(r.doc_id % 3 != 0) for r in held]) > 0.95
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() < docs.count()
    none = labels.where("quality > 5")
    assert {r.score for r in quality.quality_scores(docs, none).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_toxicity(spark):
    docs, labels = labelled(spark, 480)
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    held = [(r.score, r.doc_id % 3 == 0) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 480]
    assert np.mean([a > b for (a, toxic), (b, clean) in itertools.product(held, held) if toxic and not clean]) > 0.85
    assert {r.score for r in toxicity.toxicity_scores(docs, labels.where("toxic > 5")).collect()} == {0.0}
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0


def test_gradients_of_the_recurrence():
    rng = np.random.default_rng(0)
    net = toxicity.fresh(rng)
    for name in ("u", "wa", "va", "wo"):
        setattr(net, name, getattr(net, name).astype("f8"))
    gates = np.concatenate([rng.normal(size=(9, 2, 3 * toxicity.HIDDEN)), toxicity.silent()])
    place = rng.integers(0, 9, (4, toxicity.WINDOW))
    place[1, 20:] = -1
    logit, kept = net.read(gates, place, keep=True)
    d = rng.normal(size=4)
    grads, gx = net.learn(place, gates, d, kept)
    for array, grad, at in ((net.u, grads[0], (1, 2, 3)), (net.u, grads[0], (0, 1, 20)), (net.wa, grads[1], (3, 2)), (gates, gx, (4, 1, 5)), (gates, gx, (2, 0, 17))):
        old = array[at]
        array[at] = old + 1e-2
        up = net.read(gates, place) @ d
        array[at] = old - 1e-2
        down = net.read(gates, place) @ d
        array[at] = old
        assert abs((up - down) / 2e-2 - grad[at]) < 2e-2 * max(1, abs(grad[at]))


def test_anchors_of_a_text_longer_than_places_reach(monkeypatch):
    words = np.arange(5000, dtype=np.uint64) % np.uint64(1777)
    whole = substring_dedup.window_anchors(substring_dedup.mix(words), np.array([3000, 2000]))
    monkeypatch.setattr(substring_dedup, "PLACED", 100)
    pieces = substring_dedup.window_anchors(substring_dedup.mix(words), np.array([3000, 2000]))
    assert all((a == b).all() for a, b in zip(whole, pieces, strict=True))


def test_windows_are_told_apart_by_both_hashes(monkeypatch):
    """Where first hashes collide, the second ones decide."""
    monkeypatch.setattr(substring_dedup, "window_hashes", lambda words, hashes=None: np.array([5] * (len(words) - 34)) if hashes is None else substring_dedup.mix(substring_dedup.gram_hashes(hashes.of(words), 35)).view(np.int64))
    text = lambda k: b" ".join(b"%s%d" % (k, i) for i in range(40))
    machine = substring_dedup.Automaton([text(b"a"), text(b"b")])
    assert machine.covered(text(b"a")) == [(0, 40)] and machine.covered(text(b"b")) == [(0, 40)]
    assert machine.covered(text(b"a")[:-4] + b" x y z") == [(0, 39)]


def test_hot_rows_everywhere(spark):
    """A third of all rows are one text, with ids of their own, one id, or none; another third near copies of one text."""
    base = [f"h{i}" for i in range(80)]
    text = lambda k: " ".join([*base[:78], f"x{k}", f"y{k}"])
    rows = [(i, " ".join(base)) for i in range(40)] + [(7, " ".join(base))] * 40 + [(None, " ".join(base))] * 40
    rows += [(1000 + i, text(i)) for i in range(60)] + [(2000 + i, " ".join(f"c{i}x{k}" for k in range(70))) for i in range(60)] + [(None, None)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = near_dedup.near_classes(docs).collect()
    assert sum(r.kept for r in got) == 1 + 60 + 30
    assert {r.component_id for r in got if r.doc_id is not None and r.doc_id < 2000} == {0}
    assert near_dedup.without_near_copies(docs).count() == 91
    want = sorted((str(i), n, hashlib.sha256(" ".join(k).encode()).hexdigest()) for i, n, k in removed(rows))
    assert sorted((str(r.doc_id), r.n_words, r.kept_sha256) for r in substring_dedup.removal_table(docs).collect()) == want
    kept = collections.Counter(t for _, t in substring_dedup.without_repeats(docs).collect())
    assert kept == collections.Counter(None if r[1] is None else " ".join(k) for r, (_, _, k) in zip(rows, removed(rows), strict=True))


def test_one_oversized_text_does_not_empty_the_sample(spark):
    docs = spark.createDataFrame([(i, "word " * (5000 if i == 3 else 5)) for i in range(20)], "doc_id long, text string")
    drawn = spark.createDataFrame([(i, i % 2) for i in range(20)], "id long, label int")
    texts, y = quality.texts_of_sample(docs, drawn, 100, 20_000)
    assert len(texts) == len(y) == 19 and max(map(len, texts)) < 100


def test_a_row_repeated_very_often(spark):
    """A third of all rows are one row: it loses all its words, the others theirs, and its text goes once to the automata."""
    import random

    rng = random.Random(8)
    word = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = word(60)
    rows = [(i, " ".join(word(40) + (shared if i % 5 == 0 else []) + word(40))) for i in range(60)] + [(7, " ".join(word(30) + shared))] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.removal_table(docs).collect())
    assert got == sorted([(i, 80 + 60 * (i % 5 == 0), 60 * (i % 5 == 0)) for i in range(60)] + [(7, 90, 90)] * 30)
    keyed = docs.select(substring_dedup.row_key().alias("key"), "text")
    classes = keyed.groupBy("key").agg(F.count("*").alias("copies"))
    assert substring_dedup.texts_of_keys(keyed, keyed.select("key").distinct(), classes).count() == 61
    assert substring_dedup.texts_of_keys(keyed, keyed.select("key").distinct(), classes.withColumn("copies", F.lit(1))).count() == 61


def test_rows_without_ids_are_packed_evenly(spark):
    """Null ids of one length stand in all salts, and every sequence is full without a gap."""

    docs = spark.createDataFrame([(None, "the same few words")] * 3000 + [(1, "the same few words")] * 3000, "doc_id long, text string")
    got = packing.pack(docs, tokenizer_path(), capacity=64).toPandas()
    assert len(got) == 6000 and got.length.nunique() == 1
    n = int(got.length[0])
    assert sorted(got.offset.value_counts().to_dict()) == list(range(0, 64 // n * n, n)) and got.sequence_id.nunique() == -(-6000 // (64 // n))


def test_ids_of_words_are_those_of_the_tokenizer():
    """Words that are parted in one call, split at their end marks, or may spell a special token."""
    import random

    from tokenizers import Tokenizer

    rng = random.Random(1)
    signs = [*"abzé字'.,%$!<|>12½²…-_\"\\", "<|endoftext|>", "<|", "'s", "'t", "İ", "ß", "ﬁ", "é"]
    words = [x for _ in range(4000) for x in "".join(rng.choices(signs, k=rng.randrange(1, 9))).encode().split()]
    whole, known = Tokenizer.from_file(tokenizer_path()), packing.WordIds(tokenizer_path())
    for bound in (10**6, 300):
        known.bound = bound
        for at in range(0, len(words), 700):
            ids, n = known.of(words[at : at + 700])
            want = [whole.encode(w.decode(), add_special_tokens=False).ids for w in words[at : at + 700]]
            assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_hashes_of_words(monkeypatch):
    """Equal words have equal hashes wherever they stand, others differ; another seed gives others."""
    from lodestone.llm.common import WordHashes

    words = [f"w{k}".encode() for k in range(50_000)] + [b"a" * n for n in range(1, 300)] + [bytes([k]) for k in range(256) if k not in b" \t\n\r\x0b\x0c"] + [b"ab", b"ba", b"a\x00", b"\x00a"]
    words = list(dict.fromkeys(words))
    one = WordHashes().of(words)
    assert len(set(one.tolist())) == len(words) and (WordHashes().of(words[7:9]) == one[7:9]).all() and (WordHashes().of(words[::-1])[::-1] == one).all()
    assert not set(WordHashes(1).of(words).tolist()) & set(one.tolist()) and len(WordHashes().of([])) == 0
    long = [*words[:40], b"x" * (1 << 20), b"y" * 600_000, b"z" * 600_000, *words[40:90]]
    got = WordHashes().of(long)
    assert (np.r_[got[:40], got[43:]] == one[:90]).all() and len(set(got.tolist())) == len(long) and WordHashes().of(long[40:41])[0] == got[40]
    monkeypatch.setattr(WordHashes, "chunk", 7)
    assert (WordHashes().of(words[:1000]) == one[:1000]).all()
