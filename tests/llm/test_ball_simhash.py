"""Ball hashing against brute force: fingerprints, links in a variant's prefix, components."""

import random
import re

import numpy as np
import pytest
import xxhash
from conftest_llm import docs_of, prose

from gapline.llm import ball_simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    n = min(3, len(words))
    hashes = [xxhash.xxh64(" ".join(words[i : i + n]).encode(), seed=42).intdigest() for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ordered = sorted(parent)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    return {p: find(p) for p in parent}


def cloud(seed, centres, around):
    """Words near some centres, and chains of them."""
    rng = random.Random(seed)
    out = set()
    for centre in [0, (1 << 64) - 1] + [rng.getrandbits(64) for _ in range(centres)]:
        out.add(centre)
        for _ in range(around):
            word = centre
            for bit in rng.sample(range(64), rng.randint(1, 9)):
                word ^= 1 << bit
            out.add(word)
    return sorted(out)


def same_classes(words, links):
    parent = {w: w for w in words}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    want = brute_components(words)
    pairs = {(find(w), want[w]) for w in words}
    return len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})


def test_masks_are_those_needed():
    assert len(ball_simhash.masks(range(64))) == 1 + 64 + 2 * 32 * 31 // 2
    for bits in ([0, 31, 32], [5, 40, 63], [1, 2, 3]):  # of three bits, two are in one half
        assert any(ball_simhash._one_half(1 << a | 1 << b) for a in bits for b in bits if a < b)


def test_links_of_one_prefix():
    words = cloud(3, 20, 25)
    a, b = ball_simhash.links_of(np.array(words, np.uint64), 0, 0)
    assert all((x ^ y).bit_count() <= 3 for x, y in zip(a.tolist(), b.tolist()))
    assert same_classes(words, zip(a.tolist(), b.tolist()))


@pytest.mark.parametrize("group_variants", [1 << 24, 20_000, 3_000])
def test_links_across_prefixes(spark, group_variants):
    """With a small bound, crowded prefixes are cut again and again; the classes stay."""
    words = cloud(4, 6, 40)
    frame = spark.createDataFrame([(int(np.uint64(w).view(np.int64)),) for w in words], "fp long")
    links = [(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in ball_simhash.ball_links(frame, group_variants).collect()]
    assert all((x ^ y).bit_count() <= 3 for x, y in links)
    assert same_classes(words, links)


def expected(rows):
    prints = {i: brute_fingerprint(t) for i, t in enumerate(t for _, t in rows)}
    top = brute_components(prints.values())
    least = {}
    for at, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            label = top[prints[at]]
            least[label] = min(least.get(label, doc_id), doc_id)
    return [(doc_id, f"{prints[at]:016x}", least.get(top[prints[at]])) for at, (doc_id, _) in enumerate(rows)]


def plain(rows):
    return sorted(map(tuple, rows), key=repr)


def test_edges(spark, edge_docs, edge_rows):
    out = ball_simhash.simhash_components(edge_docs)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    assert plain(out.collect()) == plain(expected(edge_rows))


def test_near_copies_and_hot_copies(spark):
    """One text half of all rows, near copies of another one, upper case and other spaces."""
    base, other = prose(11, 400), prose(12, 300)
    rng = random.Random(5)
    rows = [(i, " ".join(base)) for i in range(300)]
    for i in range(300, 420):
        words = list(other)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(99)}"
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words).upper()))
    rows += [(i, " ".join(prose(i, 30))) for i in range(420, 520)] + [(None, "no id here at all"), (600, "É é"), (601, "É É")]
    assert plain(ball_simhash.simhash_components(docs_of(spark, rows)).collect()) == plain(expected(rows))


def test_no_rows(no_docs):
    assert ball_simhash.simhash_components(no_docs).collect() == []
