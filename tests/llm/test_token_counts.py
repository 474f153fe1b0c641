"""Token counts against the tokenizer over whole texts."""

from __future__ import annotations

import random

import pytest

from lodestone.llm import token_counts
from lodestone.llm.queries import op11_token_counts, tokenizer_path

from .helpers import DOCS, document_rows

PATH = tokenizer_path("byte_bpe_50k.json")


def whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


ODD = [
    "don't we'll  I'M " * 40,
    "x" * 5000,
    "ab12cd345" * 400,
    "<|endoftext|>" * 200,
    "a <|endoftext|> b<|endoftext|>1a " * 60,
    "  \n\n \t " * 300 + "end",
    "word    \x1c\x1d wide" * 100,
    "这是一个没有空格的句子，但是有标点。" * 200,
    "नमस्ते दुनिया! " * 100,
    "é" * 900,
    "\U0001f600\U0001f468‍\U0001f469" * 300,
    "'" * 900 + "s 't 're",
    "\r\n".join(["line"] * 500),
    "",
]


@pytest.mark.parametrize("piece", [16, 100, 1 << 16])
def test_pieces_add_up(piece):
    rng = random.Random(piece)
    alphabet = ["a", "B", "7", "é", "字", "。", " ", "  ", "\n", "'s", "!", "<|endoftext|>", "<|", "endof", " ", "ß", "½", "²", "ำ", "‍"]
    texts = ODD + ["".join(rng.choices(alphabet, k=400)) for _ in range(150)]
    token_counts._counters.clear()
    assert token_counts.lengths(texts, PATH, piece, 3000).tolist() == whole(texts)
    cut = list(token_counts.Pieces(["<|endoftext|>"], piece).cut(texts[2]))
    assert "".join(cut) == texts[2] and (len(cut) > 1) == (piece < 2000)
    assert all("".join(token_counts.words(t)) == t for t in texts)


def test_counts_are_remembered_within_a_bound(monkeypatch):
    monkeypatch.setattr(token_counts.Counter, "bound", 50)
    token_counts._counters.clear()
    texts = [" ".join(f"word{k * 37 % 400}" for k in range(n, n + 30)) for n in range(60)]
    assert [int(token_counts.lengths([t], PATH)[0]) for t in texts] == whole(texts)
    found = token_counts.counter(PATH)
    assert len(found.young) <= 90 and len(found.old) <= 90


def test_batches_hold_about_so_much():
    got = list(token_counts.batched(iter([(i, "x" * n) for i, n in enumerate([5, 5, 90, 1, 400, 2, 2])]), 100))
    assert [sum(map(len, t)) for _, t in got] == [100, 1, 400, 4] and [r for rows, _ in got for r in rows] == list(range(7))


def test_rows_with_all_edges(spark):
    rows = document_rows()
    got = sorted(token_counts.token_counts(spark.createDataFrame(rows, DOCS), PATH, limit=100, piece_bytes=500, batch_bytes=4000).collect(), key=str)
    counts = whole([r[1] for r in rows])
    want = [(r[0], len((r[1] or "").encode()), n, n > 100) for r, n in zip(rows, counts, strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(spark.createDataFrame([], DOCS), PATH).count() == 0


def test_query_over_the_whole_table(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op11_token_counts(spark, data).collect()}
    assert got.keys() == docs.keys()
    for (i, r), n in zip(got.items(), whole([docs[i] for i in got]), strict=True):
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((docs[i] or "").encode()), n > 512)
