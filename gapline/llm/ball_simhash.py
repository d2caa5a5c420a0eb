"""SimHash near-duplicate classes by meet-in-the-middle ball hashing.

A fingerprint has a bit for each bit of the shingles' XXH64 that is set in over half of
them. Two fingerprints that differ in at most three bits have a word in common within
half that radius: one bit (rounded down) from one and two (rounded up) from the other.
So every distinct fingerprint emits the variants in its ball, variants are shuffled, and
fingerprints that meet in a variant are linked, once their distance has been verified.

Of the ball only what is needed is emitted. Flipping a bit turns the parity of the set
bits, so fingerprints at distance 1 or 3 are of different parity and those at distance 2
of the same one. Odd fingerprints emit their 64 variants of one bit. Even ones emit these
too, themselves, and the variants of two bits in one half of the word: of three bits, two
are in one half, the third one is the odd fingerprint's. Two of one parity meet in
variants of one bit. What meets in a variant is of one class, so all are linked with one
of them; a variant's words are never paired with each other.

Variants are shuffled by their first bits: a fingerprint travels once to every prefix
that its variants have, and is expanded where they land, mask by mask, so a task holds
its fingerprints and the variants of one bit. A prefix with more variants than the bound
is cut by further bits until none is left, whatever the data.

Defined results: null texts are empty; texts without words have fingerprint zero, which
links like any other; texts of fewer words than a shingle are one shingle; repeated rows,
ids and fingerprints are one node of the graph, and each row is returned; rows without an
id get the component of their fingerprint (null if it has no id at all). Texts are taken
in slices, so a very long one costs memory in proportion to its words. Other columns of
the input, whatever their names, take no part. An empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.llm.components import components
from gapline.llm.words import slices
from gapline.runtime import cut_lineage

WIDTH, SEED, BITS, RADIUS = 3, 42, 64, 3
BATCH_BYTES = 8 << 20
RUN = 1 << 15  # shingles counted at once
GROUP_VARIANTS = 1 << 24  # variants that one prefix may hold
STEP = 6  # further bits of a prefix that holds more
MAX_PREFIX = 60


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """SimHash of one text as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the six ASCII spaces only
    if not words:
        return 0
    size = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(size + 1) - 1
    start = stop - size
    width = min(width, len(words))
    line, first, last = b" ".join(words), start[: len(words) - width + 1], stop[width - 1 :]
    ones, digest = np.zeros(BITS, np.int64), xxhash.xxh64_digest
    for at in range(0, len(first), RUN):
        some = b"".join([digest(line[a:b], SEED) for a, b in zip(first[at : at + RUN].tolist(), last[at : at + RUN].tolist())])
        ones += np.unpackbits(np.frombuffer(some, np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(first)).tobytes(), "big")


def _fingerprints(width: int):
    def run(stream):
        for whole in stream:
            for batch in slices(whole, "text", BATCH_BYTES):
                found = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column("text")), np.uint64, batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], ["id", "fp"])

    return run


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _one_half(mask: int) -> bool:
    """All bits of the mask are in one half of the word."""
    return mask >> (BITS // 2) == 0 or mask & ((1 << (BITS // 2)) - 1) == 0


def masks(bits: range) -> list[int]:
    """The masks of a ball that flip only the given bits: none, one, two in one half."""
    ones = [1 << b for b in bits]
    twos = [a | b for i, a in enumerate(ones) for b in ones[i + 1 :] if _one_half(a | b)]
    return [0, *ones, *twos]


def _routes(fp: Column, variant: Column, done: int, upto: int) -> Column:
    """Prefixes of ``upto`` bits, in place, that the fingerprint's variants have below ``variant``'s prefix of ``done`` bits.

    ``variant`` holds the prefix so far, or nothing at the start. Odd fingerprints flip
    one bit at most, even ones two.
    """
    kept = _signed(((1 << BITS) - 1) << (BITS - upto) & ((1 << BITS) - 1))
    before = _signed(((1 << BITS) - 1) << (BITS - done) & ((1 << BITS) - 1)) if done else 0
    most = F.lit(2) - F.bit_count(fp).cast("int") % 2
    used = F.bit_count(fp.bitwiseXOR(variant).bitwiseAND(F.lit(before))) if done else F.lit(0)
    here = F.array(*[F.lit(_signed(m)).cast("long") for m in masks(range(BITS - upto, BITS - done))])
    allowed = F.filter(here, lambda m: F.bit_count(m) + used <= most)
    base = fp.bitwiseAND(F.lit(kept)) if not done else variant.bitwiseAND(F.lit(before)).bitwiseOR(fp.bitwiseAND(F.lit(kept & ~before)))
    return F.transform(allowed, lambda m: base.bitwiseXOR(m))


def _weight(fp: Column, prefix: Column, bits: int) -> Column:
    """About how many variants of the fingerprint have the prefix."""
    even = F.bit_count(fp) % 2 == 0
    used = F.bit_count(fp.bitwiseXOR(prefix).bitwiseAND(F.lit(_signed(((1 << BITS) - 1) << (BITS - bits) & ((1 << BITS) - 1))))) if bits else F.lit(0)
    low = BITS - bits
    return F.when(used == 0, F.when(even, F.lit(len(masks(range(low))))).otherwise(low)).when((used == 1) & even, F.lit(low)).otherwise(1).cast("long")


def _star(variant: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct variants, the smallest owner of each, and the links of the other owners to it."""
    order = np.lexsort((owner, variant))
    variant, owner = variant[order], owner[order]
    new = np.ones(len(variant), bool)
    new[1:] = variant[1:] != variant[:-1]
    centre = owner[new]
    return variant[new], centre, centre[np.cumsum(new) - 1][~new], owner[~new]


def links_of(words: np.ndarray, prefix: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of the distinct fingerprints that meet in a variant with the prefix."""
    low = BITS - bits
    top = np.uint64(prefix >> low << low)
    apart = (words ^ top) >> np.uint64(low) if bits else np.zeros(len(words), np.uint64)
    odd = np.bitwise_count(words) % 2 == 1
    ones = np.array([1 << b for b in range(low)], np.uint64)
    small, other = [], []
    shift = np.uint64(low if bits else 0)
    middle = {}
    for parity in (False, True):  # variants of one bit
        at, near = words[(odd == parity) & (apart == 0)], (odd == parity) & (np.bitwise_count(apart) == 1)
        crossed = words[near] ^ (apart[near] << shift)
        variant = np.concatenate([(at[:, None] ^ ones[None, :]).ravel(), crossed])
        owner = np.concatenate([np.repeat(at, low), words[near]])
        key, centre, one, two = _star(variant, owner)
        small.append(one)
        other.append(two)
        middle[parity] = (key, centre)
    key, centre = middle[True]
    if len(key):
        # A table of variants keeps most misses from the search in the sorted ones.
        room = max(16, min(24, int(len(key)).bit_length() + 4))
        spread, cut = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - room)
        there = np.zeros(1 << room, bool)
        there[(key * spread) >> cut] = True

        def meet(variant: np.ndarray, owner: np.ndarray) -> None:
            maybe = np.flatnonzero(there[(variant * spread) >> cut])
            place = np.searchsorted(key, variant[maybe])
            place[place == len(key)] = 0
            hit = key[place] == variant[maybe]
            small.append(centre[place[hit]])
            other.append(owner[maybe[hit]])

        even = words[~odd]
        away = apart[~odd]
        crossed = np.bitwise_count(away)
        at = even[crossed == 0]
        for mask in masks(range(low)):
            if mask == 0 or mask & (mask - 1):  # the variants of one bit are of the other parity
                meet(at ^ np.uint64(mask), at)
        for flipped in np.unique(away[crossed == 1]).tolist():
            some, first = even[away == flipped], flipped << low
            for b in range(low):
                if _one_half(first | 1 << b):
                    meet(some ^ np.uint64(first | 1 << b), some)
        for flipped in np.unique(away[crossed == 2]).tolist():
            if _one_half(flipped << low):
                some = even[away == flipped]
                meet(some ^ np.uint64(flipped << low), some)
    a, b = np.concatenate(small), np.concatenate(other)
    good = (np.bitwise_count(a ^ b) <= RADIUS) & (a != b)  # verified
    pairs = np.unique(np.stack([np.minimum(a[good], b[good]), np.maximum(a[good], b[good])], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _links(key, table):
    prefix, bits = (int(k.as_py()) for k in key)
    words = np.unique(table.column("fp").to_numpy().view(np.uint64))
    a, b = links_of(words, prefix & ((1 << BITS) - 1), bits)
    return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})


def ball_links(distinct: DataFrame, group_variants: int = GROUP_VARIANTS) -> DataFrame:
    """Links (a, b) between fingerprints of the column fp at three or fewer bits, enough for all components."""
    total = distinct.count() * (len(masks(range(BITS))) + BITS) // 2
    bits = min(24, max(3, math.ceil(math.log2(max(1, total / group_variants)))))
    routed = distinct.select("fp", F.explode(_routes(F.col("fp"), F.lit(0).cast("long"), 0, bits)).alias("prefix"))
    ready = None
    while True:
        routed = cut_lineage(routed.withColumn("bits", F.lit(bits)))
        sizes = routed.groupBy("prefix").agg(F.sum(_weight(F.col("fp"), F.col("prefix"), bits)).alias("variants"))
        heavy = cut_lineage(sizes.where(F.col("variants") > 2 * group_variants).select("prefix"))
        if bits >= MAX_PREFIX or heavy.isEmpty():
            ready = routed if ready is None else ready.unionByName(routed)
            break
        light = routed.join(heavy, "prefix", "left_anti").select("fp", "prefix", "bits")
        ready = light if ready is None else ready.unionByName(light)
        upto = min(MAX_PREFIX, bits + STEP)
        routed = routed.join(heavy, "prefix").select("fp", F.explode(_routes(F.col("fp"), F.col("prefix"), bits, upto)).alias("prefix"))
        bits = upto
    return cut_lineage(ready.groupBy("prefix", "bits").applyInArrow(_links, "a long, b long").distinct())


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, group_variants: int = GROUP_VARIANTS) -> DataFrame:
    """One row per row of docs: its id, fingerprint (16 hexadecimal digits), component_id (the smallest id reached)."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    prints = cut_lineage(texts.mapInArrow(_fingerprints(width), "id long, fp long"))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("id").alias("least")))
    labels = components(ball_links(distinct.select("fp"), group_variants))
    named = cut_lineage(distinct.join(labels.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label")))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    components_of = cut_lineage(named.join(least, "label").select("fp", "component_id"))
    return prints.join(components_of, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
