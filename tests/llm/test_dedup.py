"""Exact dedup, substring dedup and near dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import docs_of, prose
from pyspark.sql import functions as F

from gapline.llm import exact_dedup, near_dedup, substring_dedup
from gapline.llm.components import components


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_edges(edge_docs, edge_rows, weak):
    hashed = (lambda t: F.lit(b"same")) if weak else exact_dedup.content_hash
    groups = defaultdict(list)
    for i, text in edge_rows:
        groups[norm(text)].append(i)
    want = []
    for i, text in edge_rows:
        ids = groups[norm(text)]
        first = min((x for x in ids if x is not None), default=None)
        want.append((i, first, len(ids), i == first, hashlib.sha256(norm(text).encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.label_copies(edge_docs, hashed=hashed).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = exact_dedup.drop_copies(edge_docs, hashed=hashed)
    assert kept.columns == edge_docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x)) == sorted({min((x for x in v if x is not None), default=None) for v in groups.values()}, key=lambda x: (x is None, x))


def brute_repeats(rows, width):
    first = {}
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in split:
        if i is not None:
            for p in range(len(w) - width + 1):
                k = tuple(w[p : p + width])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in split:
        gone = set()
        if i is not None:
            for p in range(len(w) - width + 1):
                if first[tuple(w[p : p + width])] < i:
                    gone |= set(range(p, p + width))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def test_substring_dedup_edges(edge_docs, edge_rows):
    got = substring_dedup.drop_repeats(edge_docs).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got), key=key) == sorted(brute_repeats(edge_rows, 50), key=key)
    assert all(sum(b - a for a, b in zip(r["spans"][::2], r["spans"][1::2])) == r["n_removed"] for r in got)


@pytest.mark.parametrize("width,letters,seed", [(2, 2, 0), (4, 2, 1), (6, 3, 2), (10, 2, 3)])
def test_substring_dedup_dense(spark, monkeypatch, width, letters, seed):
    """Few words, so that windows repeat inside texts, batches and across them."""
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", 300)
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("abc"[:letters]) * rng.randrange(1, 3) for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    got = substring_dedup.drop_repeats(docs_of(spark, rows), width=width).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == sorted(brute_repeats(rows, width))


def test_substring_dedup_extreme_ids_and_hot_rows(spark):
    """The smallest long is an id as any other; half of all rows alike are spread over the tasks."""
    passage = " ".join(prose(21, 80))
    rows = [(-(1 << 63), passage), (1, passage), ((1 << 63) - 1, passage), (None, passage)]
    got = substring_dedup.drop_repeats(docs_of(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got), key=key) == sorted(brute_repeats(rows, 50), key=key)
    rows = [(5, passage)] * 1_600 + [(i, " ".join(prose(i, 60) + prose(21, 80)[:55])) for i in range(10, 1_610)]
    docs = docs_of(spark, rows).repartition(64)
    got = substring_dedup.drop_repeats(docs).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == sorted(brute_repeats(rows, 50))
    sizes = [r["count"] for r in substring_dedup.dealt(substring_dedup.keyed(docs, "doc_id", "text")).groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]


def shingle_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)] if w else [])


def brute_jp(a, b):
    every = a.keys() | b.keys()
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in every) for i in a.keys() & b.keys())


def near(a, b):
    if not a or not b:
        return not a and not b
    return len(a.keys() & b.keys()) >= 0.8 * len(a.keys() | b.keys()) - 1e-9 or (max(*a.values(), *b.values()) > 1 and brute_jp(a, b) >= 0.8 - 1e-9)


def brute_classes(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    up = {i: i for i in ids}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    texts = list({(i, t): (i, shingle_counts(t)) for i, t in rows if i is not None}.values())
    for n, (i, a) in enumerate(texts):
        for j, b in texts[:n]:
            if find(i) != find(j) and near(a, b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_probability_jaccard():
    rng = random.Random(6)
    for _ in range(200):
        a, b = (Counter({k: rng.randrange(1, 9) for k in rng.sample(range(12), rng.randrange(1, 10))}) for _ in range(2))
        every = sorted(a.keys() | b.keys())
        x, y = (np.array([c[k] for k in every], float) for c in (a, b))
        assert near_dedup.probability_jaccard(x, y) == pytest.approx(brute_jp(a, b), abs=1e-12)
        assert near_dedup.probability_jaccard(x * 3, y) == pytest.approx(brute_jp(a, b), abs=1e-12)


def test_sketch_agrees_as_often_as_the_measure():
    rng = np.random.default_rng(1)
    item = rng.integers(0, 1 << 60, 40).astype(np.uint64)
    a, b = np.where(np.arange(40) < 30, rng.integers(1, 20, 40), 0.0), np.where(np.arange(40) > 8, rng.integers(1, 20, 40), 0.0)
    owner = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
    sketch = near_dedup.prob_minhash(np.concatenate([item[a > 0], item[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), owner, 2, 1 << 14)
    assert (sketch[0] == sketch[1]).mean() == pytest.approx(near_dedup.probability_jaccard(a, b), abs=0.02)


def test_near_dedup_by_weights(spark):
    """Texts that share a passage told many times and differ in as many single words: near by J_P alone."""
    rows = []
    for k in range(6):
        passage = " ".join(prose(100 + k, 12))
        for v in range(4):
            rows.append((10 * k + v, " ".join([passage] * 60 + prose(1_000 + 10 * k + v, 25))))
    a, b = shingle_counts(rows[0][1]), shingle_counts(rows[1][1])
    assert len(a.keys() & b.keys()) < 0.5 * len(a.keys() | b.keys()) and brute_jp(a, b) >= 0.8
    rows += [(100 + i, " ".join(prose(300 + i, 40))) for i in range(20)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs_of(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_near_dedup_edges(edge_docs, edge_rows):
    want = brute_classes(edge_rows)
    got = near_dedup.near_classes(edge_docs).collect()
    assert len(got) == len(edge_rows)
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == want
    assert all(r["kept"] and r["class_id"] is None for r in got if r["doc_id"] is None)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got if r["doc_id"] is not None)
    sizes = defaultdict(int)
    for i, _ in edge_rows:
        if i is not None:
            sizes[want[i]] += 1
    assert all(r["class_size"] == sizes[r["class_id"]] for r in got if r["doc_id"] is not None)
    kept = near_dedup.drop_near_copies(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, _ in edge_rows if i is not None and want[i] == i) and ids.count(None) == 2


def test_near_dedup_groups(spark):
    """A group of near copies with most pairs under the threshold, and texts that share half their words."""
    rng, base = random.Random(9), prose(11, 300)
    rows = []
    for i in range(80):
        text = list(base)
        for _ in range(5):
            text[rng.randrange(300)] = f"e{rng.random()}"
        rows.append((i, " ".join(text)))
    rows += [(100 + i, " ".join(base[:150] + prose(50 + i, 60))) for i in range(40)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs_of(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_near_dedup_repeated_passages(spark):
    """Pairs of one distinct shingle set but for the seams, a passage once and 1000 times."""
    rows = []
    for i in range(60):
        words = prose(1000 + i, 40)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:20] * 1000 + words[20:]))]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs_of(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i in range(120)}


def test_near_dedup_ids_of_several_texts(spark):
    """An id links the texts of its rows, whichever id is the first of each."""
    a, b, c, d = (" ".join(prose(i, 80)) for i in range(2000, 2004))
    rows = [(7, a), (7, b), (3, b), (20, c), (20, d), (20, d), (21, c + " more"), (22, d + " more"), (30, a + " more"), (40, "alone it is"), (41, None), (42, "one two"), (42, "")]
    got = near_dedup.near_classes(docs_of(spark, rows)).collect()
    want = brute_classes(rows)
    assert sorted((r["doc_id"], r["class_id"]) for r in got) == sorted((i, want[i]) for i, _ in rows)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_prob_minhash_estimates_probability_jaccard():
    import numpy as np

    from gapline.llm.words import mix

    a, b = np.arange(0, 60), np.arange(20, 80)
    wa, wb = 1.0 + a % 3, 1.0 + (b % 5)
    x, y = np.zeros(80), np.zeros(80)
    x[a], y[b] = wa / wa.sum(), wb / wb.sum()
    both = np.flatnonzero((x > 0) & (y > 0))
    exact = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in both)
    item = mix(np.concatenate([a, b]).astype(np.uint64))
    owner = np.repeat([0, 1], 60)
    s = near_dedup.prob_minhash(item, np.concatenate([wa, wb]), owner, 2, 4096)
    assert abs((s[0] == s[1]).mean() - exact) < 0.03
    one = near_dedup.prob_minhash(item[:60], wa, np.zeros(60, np.int64), 1, 4096)
    assert (one[0] == s[0]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 300)]
    got = {r["id"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 300: 200}


def test_empty_tables(no_docs):
    assert exact_dedup.label_copies(no_docs).count() == 0
    assert exact_dedup.drop_copies(no_docs).columns == no_docs.columns
    assert substring_dedup.drop_repeats(no_docs).count() == 0
    assert near_dedup.near_classes(no_docs).count() == 0
    assert near_dedup.drop_near_copies(no_docs).count() == 0


def test_near_dedup_finds_all_pairs_of_the_given_table(spark):
    """Recall against all pairs of the smallest documents table: every link is inside one class."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    assert got == brute_classes(rows)
