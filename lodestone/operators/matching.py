"""Joins of texts by what they contain and by how alike they are."""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept


#: So many names are broadcast at once (about 100 bytes each).
BROADCAST_NAMES = 200_000


def grams(text: Column, size: int) -> Column:
    """All stretches of ``size`` characters of a text, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def upto(rows: DataFrame, text: str, lengths: list[int]) -> DataFrame:
    """``rows`` with a ``gram`` for each stretch of a text of one of these lengths, each once.

    Shorter ones are beginnings of the longest ones, which are taken once; for those at the text's end it is filled up with NUL.
    """
    most = max(lengths, default=1)
    longest = rows.withColumn("longest", grams(F.concat(text, F.lit("\0" * (most - 1))), most))
    begun = lambda n: F.array_distinct(F.transform("longest", lambda g: F.substring(g, 1, n)))
    return longest.withColumn("gram", F.explode(F.concat(*[F.col("longest") if n == most else begun(n) for n in lengths or [1]]))).drop("longest")


def containing(names: DataFrame, name_id: str, name: str, texts: DataFrame, text_id: str, text: str, size: int = 6) -> DataFrame:
    """(name_id, text_id) of every text that contains a name, letters' case aside.

    Each name stands in an index under the one of its stretches of ``size`` characters that the fewest texts have; a name of up to ``size``
    characters stands under itself. Texts look up their stretches of all these lengths where they are read, and ``contains`` decides there:
    neither texts nor their stretches are shuffled or written. The index is broadcast, in parts of about ``BROADCAST_NAMES`` names if it is larger, each with a
    reading of its own. Empty and null names are in no text.
    """
    low = names.select(F.col(name_id).alias("name_id"), F.lower(name).alias("name")).where("length(name) > 0")
    low = kept(low.withColumn("size", F.least(F.length("name"), F.lit(size))))
    held = texts.select(F.col(text_id).alias("text_id"), F.lower(text).alias("text")).where(F.col("text").isNotNull())
    long = low.where(F.length("name") > size).select("name_id", "name", F.explode(grams(F.col("name"), size)).alias("gram"))
    wanted = kept(long.select("gram").distinct())
    counts = held.select(F.explode(grams(F.col("text"), size)).alias("gram"))
    if wanted.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES:
        counts = counts.join(F.broadcast(wanted), "gram", "left_semi")
    counts = counts.groupBy("gram").agg(F.count("*").alias("n_texts")).join(wanted, "gram", "left_semi")
    rarest = long.join(counts, "gram", "left").groupBy("name_id", "name").agg(F.min(F.struct(F.coalesce("n_texts", F.lit(0)).alias("n"), "gram")).alias("least"))
    short = low.where(F.length("name") <= size).select("name_id", "name", F.col("name").alias("gram"))
    index = kept(short.union(rarest.where("least.n > 0").select("name_id", "name", F.col("least.gram").alias("gram"))))
    lengths = sorted(r["size"] for r in low.select("size").distinct().collect())  # ``size`` of them at most
    theirs = upto(held, "text", lengths)
    parts = -(-index.count() // BROADCAST_NAMES)
    found = None
    for k in range(max(parts, 1)):
        mine = index if parts < 2 else index.where(F.pmod(F.xxhash64("name_id", "name"), F.lit(parts)) == k)
        sure = theirs.join(F.broadcast(mine), "gram").where(((F.col("gram") == F.col("name")) & ~F.contains("name", F.lit("\0"))) | F.contains("text", "name")).select("name_id", "text_id")
        found = sure if found is None else found.union(sure)
    return found


def ratio_bounds(title: str, codes: np.ndarray, letters: dict[str, int], lengths: np.ndarray) -> np.ndarray:
    """For each entry (a column of ``codes``, numbers of its characters by ``letters``, 0 behind its end) no less than ``difflib``'s ratio with the title.

    Matching stretches are a common subsequence, so twice the longest one's length over both lengths bounds the ratio. A bit of
    an entry's word is down where that length grows (Hyyro 2004); all entries move on by a character together. Titles of more
    than 64 characters are bounded by the lengths alone.
    """
    total = np.maximum(lengths + len(title), 1)
    if len(title) > 64:
        return 2.0 * np.minimum(lengths, len(title)) / total
    masks = np.zeros(len(letters) + 1, "<u8")
    for i, c in enumerate(title):
        if c in letters:
            masks[letters[c]] |= np.uint64(1 << i)
    state = np.full(len(lengths), 2**64 - 1, "<u8")
    met, others = np.empty_like(state), np.empty_like(state)
    for row in codes:
        masks.take(row, out=met, mode="clip")
        np.bitwise_and(met, state, out=met)
        np.bitwise_xor(met, state, out=others)
        state += met
        state |= others
    common = 64 - np.bitwise_count(state).astype("i8")
    return 2.0 * common / total


def best_in_packs(least: float):
    """For rows (book, titles, ids, entries): the best entry of each title by ``least`` or more; entries are rated by falling bound, until the bound is under the best ratio.

    Rows of the same titles that follow each other go on from what their entries before gave, and give only what is better.
    """

    def walk(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, best = None, {}
        for batch in batches:
            for book, titles, ids, entries in zip(batch["book"], batch["titles"], batch["ids"], batch["entries"], strict=True):
                if held != (book, list(titles)):
                    held, best = (book, list(titles)), {}
                letters = {c: k for k, c in enumerate(sorted(set().union(*entries)), 1)}
                lengths = np.array([len(e) for e in entries], "i8")
                # an entry that is longer fits no title of 64 characters
                fits = np.flatnonzero(lengths <= math.ceil(64 * (2 - least) / least) + 1)
                codes = numbered([entries[k] for k in fits], lengths[fits], letters)
                places = np.zeros((len(codes), len(entries)), "i8")
                places[:, fits] = codes
                out = []
                for title in titles:
                    had = now = best.get(title)
                    bounds = ratio_bounds(title, places, letters, lengths)
                    near = np.flatnonzero(bounds >= (now[0] if now else least))
                    for k in near[np.argsort(-bounds[near], kind="stable")]:
                        if bounds[k] < (now[0] if now else least):
                            break
                        ratio = difflib.SequenceMatcher(None, title, entries[k]).ratio()
                        if ratio >= least and (now is None or (ratio, -ids[k]) > (now[0], -now[1])):
                            now = ratio, ids[k]
                    if now != had:
                        best[title] = now
                        out.append((book, title, now[1], now[0]))
                yield pd.DataFrame(out, columns=["book", "t", "entry_id", "ratio"])

    return walk


def numbered(entries: list[str], lengths: np.ndarray, letters: dict[str, int]) -> np.ndarray:
    """The numbers of the entries' characters, a column for each entry, 0 behind its end."""
    n = int(lengths.max()) if len(lengths) else 0
    if not n:
        return np.zeros((0, len(entries)), "i8")
    signs = np.array(entries, f"<U{n}").view("<u4").reshape(len(entries), n).T
    table = np.zeros(int(max(map(ord, letters))) + 1, "i8")
    table[[ord(c) for c in letters]] = list(letters.values())
    return np.where(np.arange(n)[:, None] < lengths, table[signs], 0)


def normal_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9 ]", ""))


def alike(titles: DataFrame, title_id: str, title: str, entries: DataFrame, entry_id: str, entry: str, book: str, least: float = 0.55) -> DataFrame:
    """(book, title_id, title, entry_id, entry) of pairs of a book that may be alike by ``least``: whose ratio's bound is that high.

    A ratio of r needs r / 2 of both lengths in common characters, so lengths must fit, and of a title's characters (each
    with its number, rarest first) one must be among those that cannot all be missed. Pairs found so are kept if the characters
    they share, counted with repeats, still allow the ratio.
    """
    chars = F.transform(F.array_sort(F.filter(F.split("t", ""), lambda c: c != "")), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    # the number of a character among its equals is its place less the place of the first of them
    tokens = F.transform("chars", lambda x: F.concat(x["c"], (x["i"] - F.array_position(F.transform("chars", lambda y: y["c"]), x["c"]) + 1).cast("string")))
    side = lambda df, i, t: df.select(F.col(book).alias("book"), F.col(i).alias("id"), normal_title(F.col(t)).alias("t")).where("t <> ''").withColumn("n", F.length("t")).withColumn("chars", chars).select("book", "id", "t", "n", tokens.alias("tokens"))
    a, b = kept(side(titles, title_id, title)), kept(side(entries, entry_id, entry))
    often = a.select(F.explode("tokens").alias("token")).union(b.select(F.explode("tokens"))).groupBy("token").count()
    reach = least / (2 - least)  # of its own length, the least another text of the ratio shares
    ranked = lambda df: df.select("book", "id", "n", F.explode("tokens").alias("token")).join(often, "token").groupBy("book", "id", "n").agg(F.array_sort(F.collect_list(F.struct("count", "token"))).alias("o"))
    cut = lambda df: ranked(df).select("book", "id", "n", F.explode(F.slice("o", F.lit(1), F.col("n") - F.ceil(F.round(F.col("n") * reach, 6)).cast("int") + 1)).alias("x")).select("book", "id", "n", F.col("x.token").alias("token"))
    x, y = cut(a).alias("x"), cut(b).alias("y")
    fits = F.round(2 * F.least("x.n", "y.n") - least * (F.col("x.n") + F.col("y.n")), 6) >= 0
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & F.col("x.book").eqNullSafe(F.col("y.book")) & fits).select("x.book", F.col("x.id").alias("title_id"), F.col("y.id").alias("entry_id")).distinct()
    left, right = a.select(F.col("id").alias("title_id"), F.col("t").alias("title"), F.col("tokens").alias("ta")).distinct(), b.select(F.col("id").alias("entry_id"), F.col("t").alias("entry"), F.col("tokens").alias("tb")).distinct()
    both = met.join(left, "title_id").join(right, "entry_id")
    shared = F.size(F.array_intersect("ta", "tb"))
    return both.where(F.round(2 * shared - least * (F.size("ta") + F.size("tb")), 6) >= 0).select("book", "title_id", "title", "entry_id", "entry")


def in_tiles(rows: DataFrame, size: int, *items: Column) -> DataFrame:
    """(book, and a list for each of ``items``) of about ``size`` rows (book, t, ...) of a book at most, dealt by a hash of t."""
    sizes = kept(rows.groupBy("book").agg(F.ceil(F.count("*") / size).alias("tiles")).withColumnRenamed("book", "_book"))
    few = sizes.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES
    dealt = rows.join(F.broadcast(sizes) if few else sizes, F.col("book").eqNullSafe(F.col("_book"))).withColumn("tile", F.pmod(F.xxhash64("t"), "tiles"))
    return kept(dealt.groupBy("book", "tile").agg(F.collect_list(F.struct(*items)).alias("e")).select("book", "e"))


#: Packs of entries (about 300 KB each) that a task holds.
PACKS_AT_ONCE = 32


def best_entries(titles: DataFrame, title_id: str, title: str, entries: DataFrame, entry_id: str, entry: str, book: str, least: float = 0.55) -> DataFrame:
    """(book, title_id, entry_id, ratio): for each title the entry of its book that is most like it by ``least`` or more; of equals the first.

    Equal titles and equal entries of a book are taken once; a title that is an entry of its book is joined with it, as nothing is more like it. The
    others meet the entries of their book in packs (256 by 4,096): every pair gets a bound from the longest common subsequence, and only pairs
    whose bound reaches the best ratio so far are rated. A task has its titles and reads the packs where they were dealt: no pack is repeated for the titles it meets.
    """
    side = lambda df, i, c: kept(df.select(F.col(book).alias("book"), F.col(i).alias("id"), normal_title(F.col(c)).alias("t")).where("t <> ''"))
    a, b = side(titles, title_id, title), side(entries, entry_id, entry)
    types = dict(b.dtypes)
    y = kept(b.groupBy("book", "t").agg(F.min("id").alias("id")))
    equal = y.select(F.col("book").alias("_book"), F.col("t").alias("_t"), F.col("id").alias("entry_id"))
    same = (F.col("t") == F.col("_t")) & F.col("book").eqNullSafe(F.col("_book"))
    x = kept(a.select("book", "t").distinct().join(equal, same, "left").select("book", "t", "entry_id"))
    mine = in_tiles(x.where("entry_id is null").select("book", "t"), 256, F.col("t")).select("book", F.col("e.t").alias("titles"))
    theirs = in_tiles(y, 4096, F.col("id"), F.col("t")).select(F.col("book").alias("_book"), F.col("e.id").alias("ids"), F.col("e.t").alias("entries"))
    held = theirs.repartition(-(-theirs.count() // PACKS_AT_ONCE) or 1).hint("shuffle_replicate_nl")
    met = mine.repartition(mine.count() or 1).join(held, F.col("book").eqNullSafe(F.col("_book"))).select("book", "titles", "ids", "entries")
    rated = met.mapInPandas(best_in_packs(least), f"book {types['book']}, t string, entry_id {types['id']}, ratio double")
    rated = kept(rated.unionByName(x.where("entry_id is not null").withColumn("ratio", F.lit(1.0))))
    rated = rated.select(F.col("book").alias("_book"), F.col("t").alias("_t"), "entry_id", "ratio")
    found = a.join(rated, same)
    first = found.groupBy("book", F.col("id").alias("title_id")).agg(F.max(F.struct("ratio", (-F.col("entry_id")).alias("e"))).alias("best"))
    return first.select("book", "title_id", (-F.col("best.e")).alias("entry_id"), F.col("best.ratio").alias("ratio"))
