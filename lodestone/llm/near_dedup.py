"""Near-duplicates by DartMinHash: weighted signatures from hashed darts, banded joining, exact checks.

A document is the multiset of its five-word shingles; similarity is the sum of smaller over the sum of larger counts
(weighted Jaccard). The m-th copy of a shingle is a strip of width 1, on which darts land in time as a Poisson process
seeded by the strip alone; a document sees the darts on its strips up to a time set by its weight, each dart has a hashed
coordinate, and the earliest dart of each coordinate is the signature. Few darts are thrown where the weight is large, so
signing costs little more than one hash a word.

Documents with equal words are one class, signed once. Classes that share a band are linked to the smallest class of that
band if their texts bear it out; bands whose classes are still in different components then have the pairs between
components checked as well: pair by pair where a band has few classes, else in tiles, whose tasks compare all texts of two
tiles at once and give a forest of the links found. A group of copies or near copies thus makes about as many rows as it has
members, and no link that the bands show is lost: every pair is compared exactly unless the texts' lengths alone rule it out.
Hot bands, large groups of copies and large components are joined where their rows are (``skew_join``).

Nulls and edges: a text of one to four words is one shingle; a text without words (null, empty, blank) links with nothing
and is its own class; a null doc_id takes part, and is the class id only where there is no other; rows that repeat a doc_id
and text are copies, of which one is kept; texts are told apart by 128-bit hashes of their words; an empty table gives an empty table; a very long text is
signed and compared whole; other columns are left alone and may have any names.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WORD, WordHashes, flat, gram_hashes, materialise, mix, skew_join, text_slices, texts_of
from .components import components

WORDS, COORDS, ROWS, SIMILAR = 5, 64, 4, 0.8
#: Bands of more classes than ``FEW`` are compared in tiles of about ``TILE`` classes.
FEW, TILE = 24, 384
SIGNED = "doc_id long, text_key long, row long, digest binary, n long, bands array<long>"
_hashes = WordHashes()


def shingles(split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, with the document of each."""
    words, lens = flat(split)
    h = _hashes.of(words)
    doc, ends = np.repeat(np.arange(len(lens)), lens), np.cumsum(lens)
    grams = mix(gram_hashes(h, WORDS))
    whole = np.arange(len(grams)) + WORDS <= ends[doc[: len(grams)]] if len(grams) else np.zeros(0, bool)
    out, of = [grams[whole]], [doc[: len(grams)][whole]]
    for i in np.flatnonzero((lens > 0) & (lens < WORDS)):
        out.append(np.array([xxhash.xxh64_intdigest(b" ".join(split[i]))], U64))
        of.append(np.array([i]))
    return np.concatenate(out), np.concatenate(of)


def strips(grams: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A hash for each strip: the m-th time that a shingle comes in its document."""
    own = grams ^ mix(doc.astype(U64))
    s = np.sort(own)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    e = mix(grams)
    if len(twice):
        at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, own), len(twice) - 1)] == own)
        order = at[np.argsort(own[at], kind="stable")]
        first = np.r_[True, own[order][1:] != own[order][:-1]]
        nth = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        e[order] = mix(grams[order] + nth.astype(U64) * U64(0xA24BAED4963EE407))
    return e


def signatures(grams: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """n x COORDS earliest darts (as hashes) of each document; 0 throughout for a document without shingles."""
    out = np.zeros((n, COORDS), U64)
    e0, weight = strips(grams, doc), np.bincount(doc, minlength=n).astype("f8")
    until = (math.log(COORDS) + 2) * COORDS / np.maximum(weight, 1)
    todo = weight > 0
    while todo.any():
        pick = todo[doc]
        e, of, limit = e0[pick], doc[pick], until[doc[pick]]
        time = np.zeros(len(e))
        cells, times, darts = [], [], []
        while len(e):
            u = (e >> U64(11)).astype("f8") * 2.0**-53
            near = u <= -np.expm1(time - limit)  # the next dart comes before the limit
            e, of, limit, time = e[near], of[near], limit[near], time[near] - np.log1p(-u[near])
            dart = mix(e ^ U64(0x9FB21C651E98DF25))
            cells.append(of * COORDS + (dart >> U64(58)).astype(np.int64))
            times.append(np.minimum(time / limit * 2.0**32, 2.0**32 - 1).astype(U64))
            darts.append(dart)
            e = mix(e + U64(0x632BE59BD9B4E019))
        cell, when, dart = np.concatenate(cells), np.concatenate(times), np.concatenate(darts)
        order = np.argsort(cell.astype(U64) << U64(32) | when)
        cell = cell[order]
        first = np.r_[True, cell[1:] != cell[:-1]]
        got = np.zeros((n, COORDS), U64)
        got.reshape(-1)[cell[first]] = dart[order[first]] | U64(1)
        full = todo & (got != 0).all(axis=1)
        out[full] = got[full]
        todo &= ~full
        until = until * 2
    return out


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        split = [x.split() for x in texts_of(batch)]
        grams, doc = shingles(split)
        sig = signatures(grams, doc, len(split))
        band = np.zeros((len(split), COORDS // ROWS), U64)
        for r in range(ROWS):
            band = mix(band * U64(31) + sig[:, r::ROWS])
        band = mix(band + np.arange(COORDS // ROWS, dtype=U64))
        n = np.bincount(doc, minlength=len(split))
        digests = [xxhash.xxh3_128_digest(b" ".join(w)) for w in split]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, band.shape[1]), pa.int32()), pa.array(band.reshape(-1).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("text_key"), batch.column("row"), pa.array(digests, pa.binary()), pa.array(n, pa.int64()), lists], ["doc_id", "text_key", "row", "digest", "n", "bands"])


def counted(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles([text.split()])[0], return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1, int(a[1].sum() + b[1].sum()) - both)


def similar(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, text_a, text_b) whose texts are similar enough. A text that comes again soon is not shingled again."""
    seen: OrderedDict[int, tuple] = OrderedDict()

    def of(key: int, text) -> tuple:
        if key not in seen:
            seen[key] = counted(text.as_py() or b"")
            if len(seen) > 64:
                seen.popitem(last=False)
        return seen[key]

    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        ta, tb = batch.column("text_a").cast(pa.binary()), batch.column("text_b").cast(pa.binary())
        yield batch.select(["a", "b"]).filter(pa.array([similarity(of(a[i], ta[i]), of(b[i], tb[i])) >= least - 1e-12 for i in range(len(a))], pa.bool_()))


def shared_weights(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For all pairs of texts what their multisets of shingles have in common, and the weight of each text."""
    grams, doc = shingles([t.split() for t in texts])
    e = strips(grams, doc)
    kinds, column, n = np.unique(e, return_inverse=True, return_counts=True)
    common = np.flatnonzero(n > 1)
    place = np.full(len(kinds), -1)
    place[common] = np.arange(len(common))
    at = place[column]
    both = np.zeros((len(texts), len(texts)), "f4")
    for lo in range(0, len(common), 2048):
        use = (at >= lo) & (at < lo + 2048)
        has = np.zeros((len(texts), min(2048, len(common) - lo)), "f4")
        has[doc[use], at[use] - lo] = 1
        both += has @ has.T
    return both, np.bincount(doc, minlength=len(texts)).astype("f8")


def met(table: pa.Table, least: float) -> pa.Table:
    """Links (a, b) between components among the classes of one meeting of tiles: a forest of them."""
    keys, part = table.column("key").to_numpy(), table.column("part").to_numpy()
    both, weight = shared_weights([x or b"" for x in table.column("text").cast(pa.binary()).to_pylist()])
    linked = (both >= (least - 1e-12) * (weight[:, None] + weight[None] - both)) & (part[:, None] != part[None])
    i, j = np.nonzero(linked)
    root = np.arange(len(keys))
    while len(i):
        before, low = root.copy(), np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        root = root[root]
        if (root == before).all():
            break
    at = np.flatnonzero(root != np.arange(len(keys)))
    return pa.table({"a": keys[root[at]], "b": keys[at]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def tiled(open_rows: DataFrame) -> DataFrame:
    """(meeting, key, part): the classes of each band dealt into tiles by hash, and each two tiles brought together."""
    t = open_rows.withColumn("tiles", F.ceil(F.col("members") / TILE).cast("int")).withColumn("own", F.pmod(F.xxhash64("key"), "tiles").cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.concat_ws("/", "band", F.least("own", o), F.greatest("own", o)))
    return t.select("key", "part", F.explode(pair).alias("meeting"))


def classified(docs: DataFrame, least: float) -> DataFrame:
    """doc_id, text_key, class_id, component_id, kept, and ``same``, an upper bound of the rows that have this doc_id and text_key."""
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    signed = materialise(keyed.withColumn("row", F.monotonically_increasing_id()).mapInArrow(sign, SIGNED), "signed")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "row")
    reps = signed.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.min(first).alias("first"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("bands").alias("bands"))
    reps = materialise(reps.withColumn("key", F.col("first.row")), "classes")
    bands = reps.select("key", "n", F.explode("bands").alias("band"))
    hubs = bands.groupBy("band").agg(F.min(F.struct("key", "n")).alias("hub"), F.max("key").alias("last"), F.count("*").alias("members")).where("hub.key <> last")
    shared = materialise(skew_join(bands, materialise(hubs.select("band", "hub", "members"), "hubs"), "band", "members"), "shared")
    needed = shared.select("key").distinct().join(reps.select("key", "first.doc_id", "first.text_key"), "key").alias("r")
    t = keyed.alias("t")
    texts = materialise(t.join(needed, (F.col("t.text_key") == F.col("r.text_key")) & F.col("t.doc_id").eqNullSafe(F.col("r.doc_id"))).select("key", F.col("t.text").alias("text")).dropDuplicates(["key"]), "texts")

    def links(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b, n_a, n_b) those that are similar; the lesser weight over the greater bounds the similarity."""
        pairs = pairs.where(F.least("n_a", "n_b") >= (least - 1e-9) * F.greatest("n_a", "n_b")).select("a", "b").distinct()
        for end in "ab":
            pairs = pairs.join(texts.select(F.col("key").alias(end), F.col("text").alias(f"text_{end}")), end)
        return pairs.mapInArrow(lambda x: similar(x, least), "a long, b long")

    stars = shared.where("key <> hub.key").select(F.col("hub.key").alias("a"), F.col("key").alias("b"), F.col("hub.n").alias("n_a"), F.col("n").alias("n_b"))
    stars = materialise(stars.distinct(), "stars")
    part = materialise(components(materialise(links(stars), "links")), "parts")
    named = shared.select("band", "key", "n").join(part.withColumnRenamed("node", "key"), "key", "left").select("band", "key", "n", F.coalesce("component", "key").alias("part"))
    sizes = named.groupBy("band").agg(F.count("*").alias("members"), F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q")
    still = materialise(skew_join(named, materialise(sizes.select("band", "members"), "sizes"), "band", "members"), "open")
    few = still.where(F.col("members") <= FEW)
    x, y = few.alias("x"), few.alias("y")
    end = lambda side, c: F.when((F.col("x.key") < F.col("y.key")) == F.lit(side == "a"), F.col(f"x.{c}")).otherwise(F.col(f"y.{c}"))
    across = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.part") < F.col("y.part"))).select(end("a", "key").alias("a"), end("b", "key").alias("b"), end("a", "n").alias("n_a"), end("b", "n").alias("n_b")).distinct()
    more = materialise(links(across.join(stars.select("a", "b"), ["a", "b"], "left_anti")), "more")
    meetings = tiled(still.where(F.col("members") > FEW).select("band", "key", "part", "members")).join(texts, "key")
    more = more.union(materialise(meetings.groupBy("meeting").applyInArrow(lambda t: met(t, least), "a long, b long"), "met"))
    ends = {"a": "x", "b": "y"}
    hops = more
    for end_, to in ends.items():
        hops = hops.join(part.select(F.col("node").alias(end_), F.col("component").alias(to)), end_, "left").withColumn(to, F.coalesce(to, end_))
    joined = components(hops.select("x", "y"), "x", "y")
    part = part.withColumnRenamed("component", "part")
    whole = reps.select("digest", "key", "class_id", "first", "copies").join(part.withColumnRenamed("node", "key"), "key", "left").withColumn("part", F.coalesce("part", "key"))
    whole = whole.join(joined.withColumnRenamed("node", "part"), "part", "left").select("digest", "class_id", "first", "copies", F.coalesce("component", "part").alias("part"))
    whole = materialise(whole, "whole")
    # of each component, whose name other components may share, the row of the smallest id (nulls last) and text is kept
    least_id = materialise(whole.groupBy("part").agg(F.min("class_id").alias("component_id"), F.min("first").alias("kept_first"), F.count("*").alias("classes")), "least")
    told = materialise(skew_join(whole, least_id, "part", "classes").select("digest", "class_id", "component_id", F.col("kept_first.row").alias("kept_row"), "copies"), "told")
    out = skew_join(signed.where("n > 0").select("doc_id", "text_key", "row", "digest"), told, "digest", "copies")
    out = out.select("doc_id", "text_key", "class_id", "component_id", (F.col("row") == F.col("kept_row")).alias("kept"), F.col("copies").alias("same"))
    blank = signed.where("n = 0").select("doc_id", "text_key", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(0).cast("long").alias("same"))
    return out.unionByName(blank)


def near_classes(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """doc_id, text_key, class_id (smallest doc_id with the same words), component_id (smallest doc_id linked, directly or not) and kept."""
    return classified(docs, least).drop("same")


def without_near_copies(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """``docs`` with one document of each group; its columns stay. Texts without words all stay."""
    id_key = lambda text_key: F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text_key.cast("string"))).alias("id_key")
    kept = classified(docs, least).where("kept and same > 0").select(id_key(F.col("text_key")), F.col("same").alias("n"))
    kept = materialise(kept, "kept")
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    keyed = docs.where(has_words).select(F.struct(*docs.columns).alias("doc"), id_key(F.xxhash64("text")))
    found = skew_join(keyed, kept, "id_key")
    # a row alone of its id and text passes; of rows that may repeat the first by its columns is taken, in each task and then of those
    once = found.where("n = 1").select("doc")
    repeated = found.where("n > 1").groupBy("id_key").agg(F.min_by("doc", F.to_json("doc")).alias("doc")).select("doc")
    return once.unionByName(repeated).select("doc.*").unionByName(docs.where(~has_words))
