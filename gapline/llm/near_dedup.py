"""Near-duplicate classes by ProbMinHash sketches, banding and exact verification.

A text is its distinct five-word shingles, weighted by how often it repeats them. In a
sketch every shingle is a Poisson process whose rate is its weight; each arrival picks a
register at random, a register keeps the shingle of its earliest arrival, and a process
ends as soon as its next arrival is later than all registers. Two sketches agree in a
register with the probability Jaccard similarity of the weighted shingles, J_P. Sketches
are banded, and what meets in a band is verified on the whole texts: J_P, or the plain
Jaccard similarity of the distinct shingles, is at least the threshold.

Where a text repeats a passage much more often than another, J_P is far below the plain
similarity, and weighted bands alone would lose the pair. So a text that repeats shingles
is also sketched with equal weights, where J_P is the plain one; without repeats the two
sketches are the same.

Texts of one word sequence are one node before banding. A band's nodes are not paired
with each other: all are compared with one centre, the node that shares most bands with
others. Where a band then still holds nodes of different classes, an exact filter finds
what is left: two texts reach the threshold only if they share some of their rarest
shingles, as in any order that both use the first few have to hold a shared one. J_P is at
most what two texts share of their normalised weights, so for it the first few are those
that hold the weight which need not be shared.
Nodes that are not of their band's main class meet the others in such rare shingles
and are verified. So no link of two nodes that meet in a band is lost to the class,
and a large group of near copies takes about a linear number of comparisons.

Defined results: null texts are empty; texts without words are copies of each other and
near to nothing else; texts of fewer words than a shingle are one shingle; rows without an id
take no part (null class, kept); rows that repeat an id are one document, linked with what
any of its texts is linked with. Texts are taken whole, in slices of bounded size. Other
columns take no part, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapline.llm.components import components
from gapline.llm.words import Hasher, mix, slices
from gapline.runtime import cut_lineage

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
BATCH_BYTES = 8 << 20


def shingles(hasher: Hasher, texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, object, np.ndarray]:
    """Hash and text of every shingle, ordered by text; also the words and their hashes."""
    words = hasher.split(texts)
    hashes = words.hashes()
    doc, counts = words.doc(), words.counts()
    at = words.window_starts(width)
    found, owner = [hasher.windows(hashes, width)[at] if len(at) else np.zeros(0, np.uint64)], [doc[at]]
    for n in range(1, width):
        short = np.flatnonzero(counts == n)
        if len(short):
            found.append(mix(hasher.windows(hashes, n)[words.first[short]] + np.uint64(n)))
            owner.append(short)
    return np.concatenate(found), np.concatenate(owner), words, hashes


def prob_minhash(item: np.ndarray, weight: np.ndarray, owner: np.ndarray, owners: int, size: int) -> np.ndarray:
    """Sketches (owners x size): the item of the earliest arrival in each register."""
    first = np.full(owners * size, np.inf)
    who = np.zeros(owners * size, np.uint64)
    live, time, turn = np.arange(len(item)), np.zeros(len(item)), 0
    while len(live):
        turn += 1
        draw = mix(item[live] + np.uint64(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        time[live] -= np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[live]
        if turn > 1:  # registers are full from some turn on; then late processes end
            early = time[live] < latest[owner[live]]
            live, draw = live[early], draw[early]
        slot = owner[live] * size + (mix(draw) % np.uint64(size)).astype(np.int64)
        when = time[live]
        np.minimum.at(first, slot, when)
        won = first[slot] == when
        who[slot[won]] = item[live[won]]
        latest = first.reshape(owners, size).max(axis=1) if owners else first
    return who.reshape(owners, size)


def band_codes(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash of each band of each sketch."""
    band = sketch.reshape(len(sketch), bands, rows)
    code = np.zeros((len(sketch), bands), np.uint64)
    for r in range(rows):
        code = mix(code + band[:, :, r] + np.uint64(r + 1))
    return mix(code + np.arange(bands, dtype=np.uint64)[None, :])


def probability_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """J_P of two aligned vectors of weights: the sum over shared i of 1 / sum_j max(a_j / a_i, b_j / b_i).

    Sorted by the ratio of a to b, the larger of the two is that of a from i on, else of b.
    """
    with np.errstate(divide="ignore"):
        ratio = a / b
    order = np.argsort(ratio, kind="stable")
    a, b, ratio = a[order], b[order], ratio[order]
    from_here = np.concatenate([np.cumsum(a[::-1])[::-1], [0.0]])
    until = np.concatenate([[0.0], np.cumsum(b)])
    first = np.searchsorted(ratio, ratio, "left")
    both = (a > 0) & (b > 0)
    return float(np.sum(1 / (from_here[first[both]] / a[both] + until[first[both]] / b[both])))


def words_keys(words, hashes: np.ndarray) -> pa.Array:
    """A 128-bit hash of every text's word sequence."""
    raw, cuts = hashes.tobytes(), words.first * 8
    return pa.array([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())


def _sketch(width: int, bands: int, rows: int):
    def run(stream):
        hasher = Hasher()
        for whole in stream:
            for batch in slices(whole, "text", BATCH_BYTES):
                item, owner, words, hashes = shingles(hasher, batch.column("text"), width)
                n = batch.num_rows
                packed = np.sort(owner.astype(np.uint64) << np.uint64(40) | item >> np.uint64(24))
                edge = np.flatnonzero(np.diff(packed, prepend=packed[:1] + np.uint64(1)))
                weight = np.diff(edge, append=len(packed)).astype(np.float64)
                packed = packed[edge]
                who = (packed >> np.uint64(40)).astype(np.int64)
                item = mix(packed & np.uint64((1 << 40) - 1))
                code = band_codes(prob_minhash(item, np.ones(len(item)), who, n, bands * rows), bands, rows)
                some, again = np.zeros(n, bool), np.zeros(n, bool)
                some[who] = True
                again[who[weight > 1]] = True
                # Without repeats the weighted sketch is the one with equal weights.
                mine = again[who]
                weighted = band_codes(prob_minhash(item[mine], weight[mine], (np.cumsum(again) - 1)[who[mine]], int(again.sum()), bands * rows), bands, rows)
                owner = np.concatenate([np.repeat(np.flatnonzero(some), bands), np.repeat(np.flatnonzero(again), bands)])
                found = np.unique(np.stack([owner.astype(np.uint64), np.concatenate([code[some].ravel(), weighted.ravel()])], axis=1), axis=0)
                cuts = np.searchsorted(found[:, 0], np.arange(n + 1).astype(np.uint64)).astype(np.int32)
                lists = pa.ListArray.from_arrays(cuts, pa.array(np.ascontiguousarray(found[:, 1]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("id"), words_keys(words, hashes), lists], ["id", "words_key", "bands"])

    return run


def _keyed():
    def run(stream):
        hasher = Hasher()
        for whole in stream:
            for batch in slices(whole, "text", BATCH_BYTES):
                words = hasher.split(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("id"), words_keys(words, words.hashes()), batch.column("text")], ["id", "words_key", "text"])

    return run


def _verify(width: int, threshold: float):
    def run(stream):
        hasher = Hasher()
        for whole in stream:
            for batch in slices(whole, "text_a", BATCH_BYTES):
                sides = []
                for name in ("text_a", "text_b"):
                    item, owner, _, _ = shingles(hasher, batch.column(name), width)
                    order = np.argsort(owner, kind="stable")
                    sides.append((item[order], np.searchsorted(owner[order], np.arange(batch.num_rows + 1))))
                (one, cut1), (two, cut2) = sides
                good = np.zeros(batch.num_rows, bool)
                for i in range(batch.num_rows):
                    (a, n), (b, m) = (np.unique(x, return_counts=True) for x in (one[cut1[i] : cut1[i + 1]], two[cut2[i] : cut2[i + 1]]))
                    _, at, to = np.intersect1d(a, b, assume_unique=True, return_indices=True)
                    same = len(at)
                    good[i] = same > 0 and same >= threshold * (len(a) + len(b) - same) - 1e-9
                    if same and not good[i] and (n.max() > 1 or m.max() > 1):
                        rest, other = np.ones(len(a), bool), np.ones(len(b), bool)
                        rest[at], other[to] = False, False
                        x = np.concatenate([n[at], n[rest], np.zeros(other.sum())]).astype(np.float64)
                        y = np.concatenate([m[to], np.zeros(rest.sum()), m[other]]).astype(np.float64)
                        good[i] = probability_jaccard(x, y) >= threshold - 1e-9
                keep = pa.array(good)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def _items(width: int):
    def run(stream):
        hasher = Hasher()
        for whole in stream:
            for batch in slices(whole, "text", BATCH_BYTES):
                item, owner, _, _ = shingles(hasher, batch.column("text"), width)
                order = np.lexsort((item, owner))
                item, owner = item[order], owner[order]
                new = np.ones(len(item), bool)
                new[1:] = (item[1:] != item[:-1]) | (owner[1:] != owner[:-1])
                ids, times = batch.column("id").to_numpy(), np.diff(np.flatnonzero(new), append=len(item))
                yield pa.RecordBatch.from_arrays([pa.array(ids[owner[new]]), pa.array(item[new].view(np.int64)), pa.array(times)], ["id", "item", "times"])

    return run


def _meet(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Sort-merge join at every size, so that small inputs move data as large ones do."""
    return left.join(right.hint("merge"), on)


def _rare_pairs(here: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """Pairs (a, b) of different labels that can reach the threshold, one of them not of the main label of a band.

    Shingles are ordered by how many nodes have them. Texts of n and m shingles at the
    threshold t share at least t / (1 + t) * (n + m) of them, so all but that many, and
    one more, make a start in which they meet. m is the smallest text of a node's bands.
    For J_P the start is what holds 1 - t of the weight, and the shingle after it; only
    pairs of which one repeats shingles need it.
    """
    items = cut_lineage(_meet(texts, here.select("id").distinct(), "id").mapInArrow(_items(width), "id long, item long, times long").dropDuplicates())
    common = cut_lineage(items.groupBy("item").agg(F.count(F.lit(1)).alias("nodes")))
    items = cut_lineage(_meet(items, common, "item"))
    among = F.col("nodes") > 1
    counts = items.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(among, 1)).alias("s"), F.sum("times").alias("weight"), (F.sum(F.when(among, F.col("times")).otherwise(0)) / F.sum("times")).alias("held")
    )
    here = cut_lineage(_meet(here, cut_lineage(counts), "id"))
    # A node with s shingles in other nodes has at most this similarity to a text of m shingles or more.
    most = F.col("s") / (F.col("n") + F.greatest(F.col("m") - F.col("s"), F.lit(0)))
    smallest = cut_lineage(here.groupBy("band").agg(F.min("n").alias("m")))
    here = here.join(smallest, "band").where((most >= threshold - 1e-9) | (F.col("held") >= threshold - 1e-9))
    here = _mixed(here.select("band", "id", "label", "n", "m", "weight"))
    sizes = here.groupBy("band", "label").agg(F.count(F.lit(1)).alias("size"))
    main = cut_lineage(sizes.groupBy("band").agg(F.max_by("label", F.struct("size", "label")).alias("main")))
    minor = cut_lineage(here.join(main, "band").where("label <> main").select("id").distinct())
    nodes = cut_lineage(here.groupBy("id").agg(F.first("label").alias("label"), F.first("n").alias("n"), F.min("m").alias("m"), F.first("weight").alias("weight")))
    order = Window.partitionBy("id").orderBy("nodes", "item")
    upto = F.sum("times").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.col("weight")
    ranked = _meet(items, nodes, "id").withColumns({"place": F.row_number().over(order), "upto": upto, "part": F.col("times") / F.col("weight")})
    other = F.greatest(F.col("m"), F.col("n") * threshold)
    needed = F.ceil((F.col("n") + other) * (threshold / (1 + threshold)) - 1e-9)
    first = F.col("place") <= F.col("n") - needed + 1
    heavy = F.col("upto") - F.col("part") <= 1 - threshold + 1e-9
    # What only one node has meets nobody. Without repeats on either side J_P is the plain similarity.
    starts = ranked.where(among & (first | heavy)).withColumns({"first": first, "heavy": heavy, "repeats": F.col("weight") > F.col("n")})
    starts = cut_lineage(starts.select("id", "item", "place", "n", "label", "part", "upto", "first", "heavy", "repeats"))
    one = _meet(starts, minor, "id").select("item", F.col("id").alias("one"), *[F.col(c).alias(f"its_{c}") for c in ("place", "n", "label", "part", "upto", "first", "heavy", "repeats")])
    one = cut_lineage(one)

    def met(part: str, alike) -> DataFrame:
        return _meet(starts.where(part), one.where(f"its_{part}"), "item").where("label <> its_label").where(alike)

    # What they share up to the last place they meet in, and at most all that is after it.
    plain = met("first", F.least("n", "its_n") >= F.greatest("n", "its_n") * threshold - 1e-9)
    plain = plain.groupBy("one", "id", "n", "its_n").agg(F.count(F.lit(1)).alias("shared"), F.max("place").alias("last"), F.max("its_place").alias("its_last"))
    best = F.col("shared") + F.least(F.col("n") - F.col("last"), F.col("its_n") - F.col("its_last"))
    plain = plain.where(best >= (F.col("n") + F.col("its_n")) * (threshold / (1 + threshold)) - 1e-9)
    weighted = met("heavy", F.col("repeats") | F.col("its_repeats"))
    weighted = weighted.groupBy("one", "id").agg(F.sum(F.least("part", "its_part")).alias("both"), F.max("upto").alias("last"), F.max("its_upto").alias("its_last"))
    weighted = weighted.where(F.col("both") + F.least(1 - F.col("last"), 1 - F.col("its_last")) >= threshold - 1e-9)
    shared = plain.select("one", "id").unionByName(weighted.select("one", "id"))
    return shared.select(F.least("one", "id").alias("a"), F.greatest("one", "id").alias("b")).distinct()


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: its id, class_id (the smallest id of its class), class_size, kept."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.col("id").isNotNull())
    sketches = cut_lineage(texts.mapInArrow(_sketch(width, bands, rows), "id long, words_key binary, bands array<long>"))
    nodes = sketches.groupBy("words_key").agg(F.min("id").alias("id"))
    several = cut_lineage(sketches.groupBy("id").agg((F.min("words_key") < F.max("words_key")).alias("several")).where("several").select("id"))
    if several.isEmpty():  # then an id has one text, and names its node
        nodes, ties = cut_lineage(nodes.withColumn("node", F.col("id"))), None
        owned = texts
    else:  # an id may be the first of several texts; nodes get numbers, and those of an id are tied
        nodes = cut_lineage(cut_lineage(nodes).withColumn("node", F.monotonically_increasing_id()))
        held = _meet(sketches.select("id", "words_key"), several, "id").select("id", "words_key").distinct()
        held = cut_lineage(_meet(held, nodes.select("words_key", "node"), "words_key").select("id", "node"))
        lowest = held.groupBy("id").agg(F.min("node").alias("a"))
        ties = cut_lineage(_meet(held, lowest, "id").where("a < node").select("a", F.col("node").alias("b")).distinct())
        keyed = texts.mapInArrow(_keyed(), "id long, words_key binary, text string")
        owned = _meet(keyed, nodes, ["words_key", "id"]).select(F.col("node").alias("id"), "text")
    labels = cut_lineage(_linked(owned, sketches, nodes, ties, width, threshold))

    named = nodes.select("words_key", "node").join(labels.withColumnRenamed("id", "node"), "node", "left").select("words_key", F.coalesce("label", "node").alias("label"))
    named = cut_lineage(named)
    placed = cut_lineage(_meet(sketches.select("id", "words_key"), named, "words_key").select("id", "label"))
    sizes = cut_lineage(placed.groupBy("label").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size")))
    out = _meet(placed, sizes, "label").select("id", "class_id", "class_size", (F.col("id") == F.col("class_id")).alias("kept"))
    loose = docs.where(F.col(id_col).isNull()).select(
        F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept")
    )
    return out.unionByName(loose).withColumnRenamed("id", id_col)


def _linked(texts: DataFrame, sketches: DataFrame, nodes: DataFrame, ties: DataFrame | None, width: int, threshold: float) -> DataFrame:
    """id, label of the nodes that have a verified link or are tied; texts and results are by node."""
    spread = _meet(sketches, nodes, ["words_key", "id"]).select(F.col("node").alias("id"), F.explode("bands").alias("band"))
    buckets = cut_lineage(spread.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high").select("band", "size"))
    met = cut_lineage(_meet(spread, buckets, "band").select("band", "size", "id"))
    central = met.groupBy("id").agg(F.sum("size").alias("central"))
    members = cut_lineage(_meet(met, central, "id").select("band", "size", "id", "central"))
    wanted = members.select("id").distinct()
    held = cut_lineage(_meet(texts, wanted, "id"))

    def verified(pairs: DataFrame) -> DataFrame:
        one = _meet(pairs, held.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        both = _meet(one, held.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
        return cut_lineage(both.mapInArrow(_verify(width, threshold), "a long, b long"))

    centres = members.groupBy("band").agg(F.max_by("id", F.struct("central", -F.col("id"))).alias("centre"))
    star = _meet(members, cut_lineage(centres), "band").where("id <> centre")
    star = cut_lineage(star.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct())
    edges = verified(star)
    labels = components(edges)
    here = _mixed(members.where("size > 2").join(labels, "id", "left").select("band", "id", F.coalesce("label", "id").alias("label")))
    rest = cut_lineage(_rare_pairs(here, held, width, threshold).join(star, ["a", "b"], "left_anti"))
    links = edges.unionByName(verified(rest))
    return components(links if ties is None else links.unionByName(ties))


def _mixed(named: DataFrame) -> DataFrame:
    """Members of bands that hold more than one label."""
    named = cut_lineage(named)
    mixed = cut_lineage(named.groupBy("band").agg((F.min("label") < F.max("label")).alias("mixed")).where("mixed").select("band"))
    return cut_lineage(named.join(mixed, "band"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One document of each class, with all columns; rows without an id stay."""
    kept = near_classes(docs, id_col, text_col, **how).where("kept").select(F.col(id_col).alias("kept_id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("row_id"))
    return rows.join(kept.hint("merge"), F.col("row_id").eqNullSafe(F.col("kept_id")), "left_semi").select("row.*")
