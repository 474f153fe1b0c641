"""Operators on embeddings and pages against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import url_rules, vector_dedup, vector_search

VECTORS = "vec_id long, embedding array<float>, label int, row string, n_links string"


def vector_rows(n=300, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype("f4")
    x[50:90] = x[50] + 0.03 * rng.normal(size=(40, dim))  # a hot group of near copies
    x[100:110] = x[100]  # exact copies
    for k in range(120, 140):  # a chain
        x[k] = x[k - 1] + 0.25 * rng.normal(size=dim)
    rows = [(i, v.tolist(), None if i % 50 == 7 else int(i // 150), "clash", "clash") for i, v in enumerate(x)]
    rows += [(900, None, 0, "", ""), (901, [0.0] * dim, 0, "", ""), (902, [float("nan")] + [1.0] * (dim - 1), 0, "", ""), (903, [None] + [1.0] * (dim - 1), 0, "", ""), (904, [1.0], 0, "", ""), (905, [float("inf")] * dim, 0, "", ""), (906, [], 0, "", "")]
    return rows, x


def links_of(x, label):
    """Brute force: the number of links and the least linked place of each row."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    low = np.arange(len(x))
    for _ in range(len(x)):
        now = np.minimum(low, np.where(near, low[None], len(x)).min(axis=1))
        if (now == low).all():
            break
        low = now
    return near.sum(axis=1), low


@pytest.mark.parametrize("tile", [512, 7])
def test_vector_classes(spark, tile):
    rows, x = vector_rows()
    got = {r.vec_id: r for r in vector_dedup.vector_classes(spark.createDataFrame(rows, VECTORS), tile=tile).collect()}
    n, low = links_of(x.astype("f8"), np.array([-1 - i if r[2] is None else r[2] for i, r in enumerate(rows[: len(x)])]))
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (n[i], low[i], low[i] == i), i
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(900, 907))
    assert len(got) == len(rows)
    assert vector_dedup.vector_classes(spark.createDataFrame([], VECTORS)).count() == 0


def test_vector_classes_of_64_dimensions(spark):
    """Links, copies, repeated and null ids, another length, and vectors in clumps that trees can cut."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 64)).astype("f4")
    x[600:] = np.repeat(x[:12], 50, axis=0) + 0.25 * rng.normal(size=(600, 64))
    x[100:140] = x[100]
    x[200:260] = x[200] + 0.2 * rng.normal(size=(60, 64))
    ids = [int(i) for i in range(1200)]
    ids[101], ids[102], ids[205] = 100, None, None
    rows = [(ids[i], v.tolist(), i % 2 if i < 50 else 0, "", "") for i, v in enumerate(x)] + [(2000, [1.0, 2.0], 0, "", ""), (2001, [2.0, 4.0], 0, "", ""), (2002, [1.0, 2.0], None, "", "")]
    got = vector_dedup.vector_classes(spark.createDataFrame(rows, VECTORS).repartition(5), tile=64).collect()
    n, low = links_of(x.astype("f8"), np.array([r[2] for r in rows[:1200]]))
    assert n.sum() > 10_000
    want = sorted((str(ids[i]), int(n[i]), int(low[i]), ids[i] == int(low[i])) for i in range(1200))
    want += [("2000", 1, 2000, True), ("2001", 1, 2000, False), ("2002", 0, 2002, True)]
    assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in got) == sorted(want)


def test_few_unrelated_pairs_are_compared_in_full(spark):
    """Of unstructured vectors a subspace's range join leaves next to nothing to verify."""
    x = np.random.default_rng(9).normal(size=(1500, 64))
    reps = spark.createDataFrame([(i, 0, 64, v.tolist()) for i, v in enumerate(x)], "row long, label int, dim int, embedding array<float>")
    per = vector_dedup.candidates(reps, 0.93, 4, 512).groupBy("meeting").count().collect()
    assert sum(r["count"] ** 2 for r in per) < 0.05 * 1500 * 1499 / 2


def test_trees_cut_clumps(spark):
    """In clumped data a row meets few others; pairs within reach are brought together once in each subspace's homes."""
    rng = np.random.default_rng(2)
    z = np.repeat(rng.normal(size=(64, 16)), 40, axis=0) * 0.5 + 0.01 * rng.normal(size=(2560, 16))
    reach = 0.187
    tree = vector_dedup.grown(z, reach)
    homes, met = np.full(len(z), -1), 0
    inside = {}
    for cell, rows, home in vector_dedup.placed(tree, z, reach):
        homes[rows[home]] = cell
        inside[cell] = set(rows.tolist())
        met += home.sum() * len(rows)
    assert (homes >= 0).all() and met < 0.25 * len(z) ** 2
    near = np.argwhere(((z[:400, None] - z[None, :400]) ** 2).sum(axis=2) <= reach**2)
    assert all(j in inside[homes[i]] for i, j in near)


def truth(rows, x, asked, k):
    x = x.astype("f8")
    out = {}
    for q in asked:
        s = np.einsum("j,ij->i", x[q], x)
        order = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-s[i], i))[:k]
        out[q] = order
    return out


def test_nearest(spark):
    rows, x = vector_rows(n=1500)
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    got = vector_search.nearest(df, F.col("vec_id") % 20 == 0, k=20, block=256).collect()
    asked = [i for i in range(1500) if i % 20 == 0]
    want = truth(rows, x, asked, 20)
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert sorted(found) == asked and all(sorted(f) == list(range(1, 21)) for f in found.values())
    hit = np.mean([len({v for v, _ in found[q].values()} & set(want[q])) / 20 for q in asked])
    assert hit >= 0.9
    for q, f in found.items():
        order = [(-s, v) for _, (v, s) in sorted(f.items())]
        assert order == sorted(order)
        assert all(abs(s - float(np.dot(x[q].astype("f8"), x[v].astype("f8")))) < 1e-9 for v, s in f.values())


def test_nearest_of_64_unstructured_dimensions(spark):
    """Recall of at least 0.9 over all queries; the share of vectors visited is fitted on true neighbours."""
    x = np.random.default_rng(11).normal(size=(3000, 64)).astype("f4")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in vector_search.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = truth(None, x, list(range(0, 3000, 20)), 20)
    assert sorted(got) == sorted(want)
    assert np.mean([len(got[q] & set(want[q])) / 20 for q in want]) >= 0.9


def test_nearest_in_pieces_with_null_ids_and_other_lengths(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "PIECE", 3)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(200, 8))
    rows = [(None if i == 3 else i, v.tolist()) for i, v in enumerate(x)] + [(1000, [1.0, 0.0]), (1020, [2.0, 0.0]), (None, [1.0, 0.0])]
    rows[3] = (None, x[5].tolist())
    got = {}
    for r in vector_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, recall=1.0).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    assert got[1000] == {1: 1020, 2: None} and got[1020] == {1: 1000, 2: None}
    x[3] = x[5]
    want = truth(None, x, list(range(0, 200, 20)), 20)
    hit = 0
    for q, w in want.items():
        assert sorted(got[q]) == list(range(1, 21))
        hit += len({-1 if v is None else v for v in got[q].values()} & {-1 if v == 3 else v for v in w})
    assert hit >= 0.9 * 200


def test_nearest_with_few_candidates(spark):
    rows, x = vector_rows(n=150)
    few = [rows[0], rows[20], rows[100], (500, rows[20][1], 0, "", ""), rows[0]]
    got = vector_search.nearest(spark.createDataFrame(few, VECTORS), F.col("vec_id") % 20 == 0, k=20).collect()
    assert len(got) == 5 * 4  # all five rows ask, each finds the four others
    ranks = {r.rank: r.vec_id for r in got if r.query_id == 20}
    assert ranks[1] == 500  # the same vector under another id
    assert vector_search.nearest(spark.createDataFrame([], VECTORS), F.col("vec_id") % 20 == 0).count() == 0


def test_url_verdicts(spark):
    urls = [f"https://a{i % 3}.example.com/en/{i}" for i in range(60)] + [f"http://x.example.net/de/{i}?page=2" for i in range(40)] + [f"http://Example.ORG/fr/{i}#top" for i in range(40)]
    urls += [None, "", "no scheme/en/1", "http://com/en/5", "HTTP://EXAMPLE.com/en/71?x", "ftp://notcom/en/1", "http://b.org/es/", "http://b.org?es/", "x://com#/en/"]
    df = spark.createDataFrame([(i, u, "html", "verdict") for i, u in enumerate(urls)], "page_id long, url string, html string, verdict string")
    got = {r.page_id: r for r in url_rules.url_verdicts(df).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: next((k for k, c in enumerate(path) if c in "?#"), len(path))]
        fits = sorted(((len(h + p), h + p, v) for h, p, v in url_rules.LISTED if (host == h or host.endswith("." + h)) and path.startswith(p)), reverse=True)
        assert (got[i].host, got[i].path) == (host, path), u
        assert got[i].rule == (fits[0][1] if fits else None), u
        if fits:
            assert got[i].verdict == fits[0][2]
        assert got[i].verdict in ("allow", "block")
    assert got[100].verdict == "allow"  # the background is not blocked
    assert url_rules.url_verdicts(df.limit(0)).count() == 0


def test_a_mined_rule_blocks(spark):
    """A host word that nearly all its pages share with blocked ones blocks the page that no listed rule fits, by brute force over all sets."""
    rng = np.random.default_rng(3)
    urls = [f"https://spam{i % 2}-deal.example.com/en/{i % 500}" for i in range(60)] + [f"https://spam{i}-deal.example.org/en/{i}" for i in (0, 1)]
    urls += [f"https://w{rng.integers(40)}.example.{rng.choice(['net', 'org'])}/en/{i}" for i in range(200)] + [f"https://w{i % 40}.example.{'org/es' if i % 2 else 'net/de'}/{i}" for i in range(60)]
    urls += ["https://" + ".".join(f"l{i}" for i in range(60)) + f".example.org/x/{k}?" + "&".join(f"k{i}=1" for i in range(40)) for k in range(5)]  # very many tokens
    urls += [urls[60]] * 2 + ["http://x/" + "y" * 100_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    got = {r.page_id: r for r in url_rules.url_verdicts(df, min_support=0.01).collect()}
    assert len(got) == len(urls)
    for i in (60, 61, len(urls) - 3):
        assert got[i].rule is None and got[i].verdict == "block" and "host:spam" in got[i].mined, got[i]
    tokens = {i: set(t) for i, t in df.select("page_id", url_rules.url_tokens(F.col("url"), url_rules.url_host(F.col("url")), url_rules.url_path(F.col("url")))).collect()}
    label = {i: got[i].verdict if got[i].rule else None for i in got}
    held = [i for i in tokens if tokens[i]]
    for r in got.values():
        if r.mined:
            needs = set(r.mined.split(" "))
            assert needs <= tokens[r.page_id]
            has = [i for i, t in tokens.items() if needs <= t]
            own, other = (sum((label[i] == r.verdict) == yes for i in has) / sum((label[i] == r.verdict) == yes for i in held) for yes in (True, False))
            assert abs(own / (own + other) - r.mined_confidence) < 1e-6 and r.mined_confidence >= 0.8
    blocked = [i for i in got if not got[i].rule and got[i].verdict == "block"]
    assert all("spam" in urls[i] for i in blocked)


@pytest.mark.parametrize("one_task", [100_000, 0])  # 0: hubs are split however few links there are
def test_components_with_a_hub(spark, one_task, monkeypatch):
    from lodestone.llm import components

    monkeypatch.setattr(components, "ONE_TASK", one_task)
    links = [(0, i) for i in range(10, 300)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (None, 7), (2000, 1990), (1990, 2000)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {0: 0, **{i: 0 for i in range(10, 300)}, **{i: 1000 for i in range(1000, 1041)}, 1990: 1990, 2000: 1990}
