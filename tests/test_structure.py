"""Scans over long groups, outlines, contents, chains, ordered suppression and joins of texts against plain loops."""

from __future__ import annotations

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import contents as C
from lodestone.operators import layout, matching, scan


def outline_by_loop(rows):
    out, stack, counts = {}, [], {}
    for node, level in sorted(rows):
        while stack and stack[-1][0] >= level:
            stack.pop()
        parent = stack[-1][1] if stack else None
        counts[parent] = counts.get(parent, 0) + 1
        out[node] = (parent, len(stack) + 1, counts[parent], next((n for n, lev in sorted(rows) if n > node and lev <= level), None))
        stack.append((level, node))
    return out


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_outline_of_long_and_short_groups(spark, parts):
    """A group over many tasks, one row groups, a null group, rising, falling and equal levels, rows without a level."""
    rng = random.Random(parts)
    groups = {"long": [(k, rng.randrange(1, 9)) for k in range(400)], "one": [(5, 3)], None: [(k, rng.choice([2, 2, 5])) for k in range(30)], "down": [(k, 40 - k) for k in range(40)], "up": [(k, k) for k in range(1, 60)], "same": [(k, 4) for k in range(50)]}
    rows = [(g, n, lev) for g, x in groups.items() for n, lev in x] + [("long", 1000, None), ("none", 1, None)]
    rng.shuffle(rows)
    got = layout.outline(spark.createDataFrame(rows, "g string, node long, level int"), "g", "node", "level", parts=parts).collect()
    assert len(got) == sum(map(len, groups.values()))
    for g, x in groups.items():
        want = outline_by_loop(x)
        assert {r.node: (r.parent, r.depth, r.ordinal, r.closed_by) for r in got if r.g == g} == want
    empty = spark.createDataFrame([], "g string, node long, level int")
    assert layout.outline(empty, "g", "node", "level").count() == 0


def test_an_outline_of_401_nodes(spark):
    rows = [("c", k, 1 if k % 2 else 2) for k in range(1, 401)]
    got = {r.node: r for r in layout.outline(spark.createDataFrame(rows, "g string, node long, level int"), "g", "node", "level", parts=5).collect()}
    assert all(got[k].parent == (None if k % 2 else k - 1) and got[k].ordinal == ((k + 1) // 2 if k % 2 else 1) for k in got) and len(got) == 400


@pytest.mark.parametrize("seed", range(40))
def test_rules_are_associative(seed):
    """However rows are cut, the state behind the parts' summaries is the state behind all steps."""
    rng = random.Random(seed)
    n = rng.randrange(1, 40)
    rows = {"node": list(range(n)), "level": [rng.randrange(1, 6) for _ in range(n)], "number": [[rng.randrange(3) for _ in range(rng.randrange(1, 4))] for _ in range(n)], "fit": [rng.random() < 0.6 for _ in range(n)], "goes_on": [rng.random() < 0.7 for _ in range(n)], "kind": rng.choices(["entry", "filler", "other"], [3, 8, 1], k=n), "names": [rng.random() < 0.2 for _ in range(n)]}
    cuts = sorted({0, n, *(rng.randrange(n + 1) for _ in range(4))})
    for rule in (scan.Nesting(), scan.Closing(), scan.Rising(), scan.Chain(), scan.Listing(2)):
        part = lambda a, b: {c: rows[c][a:b] for c in rule.columns}  # noqa: B023, E731
        whole, _ = rule.step(rule.start(), part(0, n))
        state = rule.start()
        for a, b in zip(cuts, cuts[1:], strict=False):
            half = (a + b) // 2
            state = rule.after(state, rule.extend(rule.extend(rule.empty(), part(a, half)), part(half, b)))
        assert state == whole, type(rule).__name__


@pytest.mark.parametrize("parts", [1, 6])
def test_numbered_headings_with_rejected_rows(spark, parts):
    """[9, 9] is plain and [1, 5] falls behind [2, 1]: neither may keep later rows out."""
    rows = [(1, [1, 1], 1.2, False), (2, [9, 9], 1.0, False), (3, [2, 1], 1.0, True), (4, [1, 5], 1.5, True), (5, [2, 2], 1.1, True), (6, [1, 1, 1], 1.1, None), (7, [1, 1, 1], 1.1, True), (8, [7], 2.0, True), (9, None, 2.0, True), (10, [2, 10], None, True)]
    df = spark.createDataFrame([("s", *r) for r in rows] + [("t", 1, [1, 1], 2.0, True)], "g string, at long, n array<int>, size double, bold boolean")
    got = layout.numbered_headings(df, "g", "at", "n", F.col("size"), F.col("bold"), parts=parts).collect()
    assert sorted((r.g, r.node, r.level, r.confidence) for r in got) == [("s", 1, 1, 0.75), ("s", 3, 1, 0.75), ("s", 5, 1, 0.98), ("s", 6, 2, 0.75), ("s", 10, 1, 0.75), ("t", 1, 1, 0.98)]


def entries_by_loop(lines):
    """Runs of entries with at most six fillers between, and the first that qualifies."""
    at = 0
    while at < len(lines):
        if lines[at][1] != "entry":
            at += 1
            continue
        run, k = [at], at + 1
        while True:
            nxt = next((j for j in range(k, min(k + 7, len(lines))) if lines[j][1] != "filler"), None)
            if nxt is None or lines[nxt][1] != "entry":
                break
            if lines[nxt][0] != lines[run[-1]][0]:
                run.append(nxt)
            k = nxt + 1
        numbers = [int(m.group(1)) for i in run if (m := re.match(C.RUN_NUMBER, lines[i][0]))]
        bonus = len(numbers) >= 2 and all(a < b for a, b in zip(numbers, numbers[1:], strict=False)) and max(lines[i][2] for i in run) - min(lines[i][2] for i in run) <= 0.15 * max(1.0, *(lines[i][2] for i in run))
        reason = "heading" if at and lines[at - 1][0].lower().startswith("content") else "length" if len(run) >= 3 else "sequence" if bonus and len(run) >= 2 else None
        if reason:
            return [(i, reason) for i in run]
        at = k
    return []


@pytest.mark.parametrize("parts", [1, 5])
def test_contents_blocks(spark, parts):
    rng = random.Random(9)
    kinds = [("1. Motion 12", "entry"), ("Force . . . . 20", "entry"), ("7. Light 9", "entry"), ("7. Light 9", "entry"), ("A heading", "filler"), ("14", "filler"), ("iv", "filler"), ("", "filler"), ("Contents", "other"), ("It is prose.", "other")]
    groups = {f"g{k}": [(*rng.choices(kinds, [4, 3, 3, 3, 9, 6, 3, 3, 2, 2])[0], rng.choice([500.0, 520.0, 900.0])) for _ in range(rng.randrange(1, 30))] for k in range(120)}
    groups["named"] = [("Contents", "other", 0.0), ("1. Motion 12", "entry", 5.0)]
    groups["alone"] = [("A heading", "filler", 0.0), ("1. Motion 12", "entry", 5.0)]
    groups["rising"] = [("1. Motion 12", "entry", 100.0), *[("A heading", "filler", 0.0)] * 6, ("7. Light 9", "entry", 110.0)]
    groups["apart"] = [("1. Motion 12", "entry", 100.0), *[("A heading", "filler", 0.0)] * 7, ("7. Light 9", "entry", 110.0)]
    df = spark.createDataFrame([(g, i, t, r) for g, x in groups.items() for i, (t, _, r) in enumerate(x)], "g string, i long, t string, r double")
    kind = {r.t: r.k for r in df.select("t", C.row_kind(F.col("t")).alias("k")).distinct().collect()}
    assert kind == {t: k for x in groups.values() for t, k, _ in x}
    got = {}
    for r in layout.contents_blocks(df, "g", "i", "t", "r", parts=parts).collect():
        got.setdefault(r.g, []).append((r.node, r.reason))
    want = {g: f for g, x in groups.items() if (f := entries_by_loop(x))}
    assert {g: sorted(x) for g, x in got.items()} == want
    assert {x[0][1] for x in want.values()} == {"heading", "length", "sequence"} and "alone" not in want and "apart" not in want


@pytest.mark.parametrize("text, kind", [("Class X", "filler"), ("Contents iii", "other"), ("250. Too high 12", "filler"), ("Unit 3. Waves 30", "entry"), ("1.2.3) Sound xiv", "entry"), ("1. 3", "filler"), ("Fin, then.", "other"), ("x" * 61, "other"), ("1234567 12", "filler")])
def test_shapes_of_rows(spark, text, kind):
    assert spark.createDataFrame([(text,)], "t string").select(C.row_kind(F.col("t"))).first()[0] == kind


@pytest.mark.parametrize("parts", [1, 4])
def test_pieces_over_pages(spark, parts):
    """A piece over five pages is one; a page with two pieces, a missing page and a piece that does not go on end a chain."""
    rows = [("a", p, 0.0, 10 + p, p > 1) for p in range(1, 6)]  # one piece a page: 11..15
    rows += [("b", 1, 0.0, 20, True), ("b", 1, 5.0, 21, True), ("b", 2, 0.0, 22, True), ("b", 2, 5.0, 23, True), ("b", 3, 0.0, 24, True), ("b", 5, 0.0, 25, True), ("b", 6, 0.0, 26, False), ("b", 7, 0.0, 27, None)]
    df = spark.createDataFrame(rows, "g string, page long, top double, node long, more boolean")
    got = {r.node: r["head"] for r in layout.over_pages(df, "g", "page", "top", "node", F.col("more"), parts=parts).collect()}
    assert got == {11: 11, 12: 11, 13: 11, 14: 11, 15: 11, 20: 20, 21: 21, 22: 21, 23: 23, 24: 23, 25: 25, 26: 26, 27: 27}


def test_a_dropped_box_drops_no_other(spark):
    """In a chain a-b-c, a drops b, so c stays; copies of b go with it."""
    xs = {1: 0.0, 2: 5.0, 3: 10.0, 4: 15.0, 5: 5.0, 6: 300.0}
    df = spark.createDataFrame([(7, k, (x, 0.0, x + 20, 20.0)) for k, x in xs.items()] + [(8, 9, (5.0, 0.0, 25.0, 20.0))], "page long, rank int, box struct<x0: double, y0: double, x1: double, y1: double>")
    pairs = sorted(tuple(r) for r in layout.overlaps(df, "page", "rank", "box", 0.5, 20.0).collect())
    assert pairs == sorted((a, b) for a in xs for b in xs if a < b and abs(xs[a] - xs[b]) <= 20 / 3)
    assert {r.loser for r in layout.suppressed(df, "page", "rank", "box", 0.5, 20.0).collect()} == {2, 5, 4}
    assert layout.dropped(spark.createDataFrame([], "winner int, loser int")).count() == 0


def test_suppression_by_loop(spark):
    rng = random.Random(3)
    boxes = []
    for k in range(150):
        x, y = float(rng.randrange(60)), float(rng.randrange(60))
        boxes.append((rng.randrange(3), k, (x, y, x + rng.randrange(5, 40), y + rng.randrange(5, 40))))

    def iou(a, b):
        i = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return i / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i)

    stays = []
    for p, k, b in boxes:
        if not any(q == p and iou(b, c) >= 0.3 for q, _, c in stays):
            stays.append((p, k, b))
    df = spark.createDataFrame(boxes, "page long, rank int, box struct<x0: double, y0: double, x1: double, y1: double>")
    assert {r.loser for r in layout.suppressed(df, "page", "rank", "box", 0.3, 16.0).collect()} == {k for _, k, _ in boxes} - {k for _, k, _ in stays}


def test_texts_that_contain_names(spark):
    names = [(1, "Red Gear"), (2, "of"), (3, "a"), (4, ""), (5, None), (6, "gear"), (7, "naïve 字b"), (8, "line\nbreak"), (9, "not there"), (1, "red gear")]
    texts = [(1, "A RED GEARBOX"), (2, "naïve 字b, often"), (3, None), (4, ""), (5, "infrared gears of a line\nbreak"), (6, "zzz")]
    got = {tuple(r) for r in matching.containing(spark.createDataFrame(names, "n int, name string"), "n", "name", spark.createDataFrame(texts, "t int, text string"), "t", "text").collect()}
    assert got == {(n, t) for n, a in names for t, b in texts if a and b and a.lower() in b.lower()}
    plan = matching.containing(spark.createDataFrame(names, "n int, name string"), "n", "name", spark.createDataFrame(texts, "t int, text string"), "t", "text")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("most", [200_000, 2])
def test_texts_are_not_shuffled_for_names(spark, monkeypatch, most):
    """Texts were dealt once for each length of stretches; names of all lengths stand at both ends and in the middle, the index is broadcast whole or in parts."""
    monkeypatch.setattr(matching, "BROADCAST_NAMES", most)
    texts = [(1, "abcdefghijkl"), (2, "xyz \U0001f600\U0001f601 end"), (3, "a"), (4, "ab\0"), (5, "zzabcdefgabcdefgzz"), (6, None), (7, "Ghijkl"), (8, "")]
    names = sorted({a[i:j] for _, a in texts if a for i in (0, 3, 9) for j in range(i + 1, len(a) + 1)} | {"abcdefghijkm", "d\0", "\0", "kl\0", "bcdefgz", "GHI"})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = matching.containing(spark.createDataFrame(list(enumerate(names)), "n int, name string"), "n", "name", spark.createDataFrame(texts, "t int, text string"), "t", "text")
        got, plan = [tuple(r) for r in found.collect()], found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == len(set(got)) and set(got) == {(n, t) for n, a in enumerate(names) for t, b in texts if b and a.lower() in b.lower()}
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_best_entries_by_loop(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 7)))
    titles = [(k, " ".join(word() for _ in range(rng.randrange(1, 5))), rng.choice("xy")) for k in range(60)] + [(90, "!!!", "x"), (91, None, "x"), (92, "", "x")]
    entries = [(k, (t or "").replace("a", "k").upper() if k % 2 else " ".join(word() for _ in range(3)), b) for k, t, b in titles] + [(200, "same title", "x"), (201, "Same, title", "x")]
    titles.append((93, "same title", "x"))
    norm = lambda s: re.sub("[^a-z0-9 ]", "", (s or "").lower()).strip()
    want, possible = {}, set()
    for i, t, b in titles:
        best, ratio = None, 0.0
        for e, s, c in entries:
            r = difflib.SequenceMatcher(None, norm(t), norm(s)).ratio() if b == c and norm(t) and norm(s) else 0
            possible |= {(i, e)} if r >= 0.55 else set()
            if r > ratio:
                best, ratio = e, r
        if ratio >= 0.55:
            want[i] = (best, pytest.approx(ratio))
    a, b = spark.createDataFrame(titles, "i long, t string, book string"), spark.createDataFrame(entries, "e long, s string, book string")
    got = {r.title_id: (r.entry_id, r.ratio) for r in matching.best_entries(a, "i", "t", b, "e", "s", "book").collect()}
    assert got == want and got[93][0] == 200
    compared = {(r.title_id, r.entry_id) for r in matching.alike(a, "i", "t", b, "e", "s", "book").collect()}
    assert possible <= compared and len(compared) < 0.5 * len(titles) * len(entries)


def test_bounds_leave_few_pairs_to_rate(monkeypatch):
    """Among texts of common letters nearly all pairs share most of their letters; bounds by common subsequences leave few to rate."""
    import pandas as pd

    rng = random.Random(5)
    made = lambda n, size: ["".join(rng.choice("aeeeiinnstrdlo  ") for _ in range(rng.randint(1, size))) for _ in range(n)]
    titles, entries = [*made(40, 64), "x" * 70, "zz"], [*made(300, 64), *made(20, 400), "x" * 69]
    entries[7] = titles[3][:-1] + "q"
    plain = {}
    for t in titles:
        rated = [(difflib.SequenceMatcher(None, t, e).ratio(), -k) for k, e in enumerate(entries)]
        if max(rated)[0] >= 0.55:
            plain[t] = (-max(rated)[1], max(rated)[0])
    calls, whole = [], difflib.SequenceMatcher
    monkeypatch.setattr(matching.difflib, "SequenceMatcher", lambda *x: calls.append(x) or whole(*x))
    pack = pd.DataFrame({"book": [None], "titles": [titles], "ids": [list(range(len(entries)))], "entries": [entries]})
    got = pd.concat(matching.best_in_packs(0.55)(iter([pack])))
    assert {r.t: (r.entry_id, r.ratio) for r in got.itertuples()} == plain and len(plain) > 5
    assert len(calls) < len(titles) * len(entries) / 5


def test_packs_go_on_from_the_best_before(monkeypatch):
    """The same titles with five packs of entries, as a task meets them: all are rated by what the packs before gave, and other titles begin anew."""
    import pandas as pd

    rng = random.Random(6)
    made = lambda n: ["".join(rng.choice("aens ") for _ in range(rng.randint(30, 60))) for _ in range(n)]
    titles, others, entries = made(10), made(3), made(500)
    entries[3:13] = [t[:-4] + "qqqq" for t in titles]
    entries[450] = entries[3]  # as like, behind it
    calls, whole = [], difflib.SequenceMatcher
    monkeypatch.setattr(matching.difflib, "SequenceMatcher", lambda *x: calls.append(x) or whole(*x))
    rows = [("b", t, list(range(k, 500, 5)), entries[k::5]) for t in (titles, others) for k in range(5)]
    table = pd.DataFrame(rows, columns=["book", "titles", "ids", "entries"])
    got = {}
    for r in pd.concat(matching.best_in_packs(0.55)(iter([table.iloc[:3], table.iloc[3:]]))).itertuples():
        assert r.t not in got or (r.ratio, -r.entry_id) > (got[r.t][0], -got[r.t][1])
        got[r.t] = r.ratio, r.entry_id
    together = len(calls)
    best = {t: max((whole(None, t, e).ratio(), -k) for k, e in enumerate(entries)) for t in titles + others}
    assert got == {t: (r, -k) for t, (r, k) in best.items() if r >= 0.55} and got[titles[0]][1] == 3
    calls.clear()
    for k in range(len(table)):
        list(matching.best_in_packs(0.55)(iter([table.iloc[k : k + 1]])))
    assert together < 0.75 * len(calls)
