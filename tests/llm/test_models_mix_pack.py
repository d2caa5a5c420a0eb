"""Classifiers by held-out accuracy; mixing, packing and the pipeline by brute force."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from conftest_llm import docs_of, prose
from pyspark.sql import functions as F

from gapline.llm import length_packing, quality, source_mixing, toxicity
from gapline.llm.tables import spread_repeats
from gapline.llm.linear import Rows, fit, sigmoid


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def toxic_docs(n, seed=0):
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = prose(seed * 100_000 + i, rng.randrange(20, 80))
        bad = rng.random() < 0.25
        if bad:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "Worthless,", "scum.", "zoppelung", "zoppelei"]))
        rows.append((i, " ".join(words), bad))
    return rows


def test_logistic_fit_reaches_a_stationary_point():
    rng = np.random.default_rng(0)
    n, d = 400, 6
    x = rng.random((n, d)) < 0.4
    y = (rng.random(n) < sigmoid(2 * x[:, 0] - 2 * x[:, 1])).astype(float)
    rows = Rows(np.concatenate([[0], np.cumsum(x.sum(1))]), np.concatenate([np.flatnonzero(r) for r in x]), np.ones(x.sum()), np.zeros((n, 0)))
    model = fit(rows, y, np.ones(n), penalty=1.0, steps=200)
    w, err = model.weights[:d], model.predict(rows) - y
    assert np.abs(x.T.astype(float) @ err + w).max() < 0.05 and abs(err.sum()) < 0.05


def test_toxicity_chain_on_held_out_documents(spark, edge_docs):
    rows = toxic_docs(900)
    docs = docs_of(spark, [r[:2] for r in rows])
    labels = spark.createDataFrame([(i, int(b)) for i, _, b in rows[:600]] + [(None, 1), (3, None), (99_999, 1), (0, int(rows[0][2]))], "doc_id long, toxic int")
    models, threshold, figures = toxicity.train_chain(docs, labels)
    assert len(models) == 3 and [len(m.dense) for m in models] == [0, 1, 2] and figures["f1"] > 0.9
    got = {r["doc_id"]: r for r in toxicity.score(docs, models, threshold).collect()}
    held = rows[600:]
    assert np.mean([got[i]["toxic_flag"] == b for i, _, b in held]) > 0.97
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in got if not got[i]["toxic_flag"]}
    edges = toxicity.score(edge_docs, models, threshold)
    assert edges.count() == edge_docs.count() and not edges.where("toxic_flag").count()


def test_chain_feed_is_out_of_fold(spark, monkeypatch):
    """Every later model sees, for each row, the score of a model that row did not train."""
    calls, real = [], toxicity.fit

    def spy(rows, target, weight, **how):
        model = real(rows, target, weight, **how)
        calls.append((rows, target, weight, model))
        return model

    monkeypatch.setattr(toxicity, "fit", spy)
    rows = toxic_docs(120, seed=9)
    docs = docs_of(spark, [r[:2] for r in rows])
    labels = spark.createDataFrame([(i, int(b)) for i, _, b in rows], "doc_id long, toxic int")
    toxicity.train_chain(docs, labels, folds=3)
    assert len(calls) == 3 * 4
    everything = calls[3][0]
    fold = np.arange(len(everything)) % 3
    want = []
    for stage in range(3):
        parts, (seen, target, weight, _) = calls[4 * stage : 4 * stage + 3], calls[4 * stage + 3]
        assert seen.dense.shape[1] == stage
        assert all(np.array_equal(seen.dense[:, k], want[k]) for k in range(stage))
        out = np.zeros(len(everything))
        for f, (train, *_) in enumerate(parts):
            mine = np.flatnonzero(fold != f)
            assert len(train) == len(mine) and np.array_equal(train.dense, seen.dense[mine])
            held = np.flatnonzero(fold == f)
            out[held] = real(seen.pick(mine), target[mine], weight[mine]).predict(seen.pick(held))
        want.append(out)
    # The kinds share out the toxic rows.
    assert np.array_equal(calls[3][1] + calls[7][1], calls[11][1])


def test_kinds_follow_what_toxic_rows_share():
    rng, label, kind, cut, index = random.Random(4), [], [], [0], []
    for i in range(300):
        bad = i % 3 == 0
        kind.append((0 if i % 5 else 1) if bad else -1)
        own = {1000 + rng.randrange(400) for _ in range(20)}
        own |= {10 + kind[-1] * 10 + rng.randrange(6) for _ in range(4)} if bad else set()
        index += sorted(own)
        cut.append(len(index))
        label.append(int(bad))
    rows = Rows(np.array(cut), np.array(index), np.ones(len(index)), np.zeros((300, 0)))
    got = toxicity.toxic_kinds(rows, np.array(label, float), np.ones(300))
    assert np.array_equal(got, kind)
    assert set(toxicity.toxic_kinds(rows, np.zeros(300), np.ones(300))) == {-1}
    assert set(toxicity.toxic_kinds(rows, np.ones(300), np.ones(300))) == {0}


def test_features_of_a_training_row_are_bounded():
    index = np.arange(0, 5000, 5)
    few = toxicity._fewer(index, 100)
    assert len(few) == 100 and set(few) <= set(index) and np.array_equal(few, np.sort(few))
    assert np.array_equal(toxicity._fewer(index, 1000), index)


def test_training_samples_with_repeated_rows(spark, monkeypatch):
    """A hot repeated row is one row of a sample, with its copies as weight."""
    seen = []

    def fit(rows, target, weight, **how):
        seen.append(sorted(weight))
        return real(rows, target, weight, **how)

    real = quality.fit
    monkeypatch.setattr(quality, "fit", fit)
    rows = [(i, " ".join(prose(3000 + i, 30))) for i in range(50)] + [(50, "the hot row")] * 200
    docs = docs_of(spark, rows)
    quality.score_quality(docs, sample=51).count()
    assert seen == [[1.0] * 50 + [200.0]]
    labels = spark.createDataFrame([(i, int(i > 40)) for i in range(51)], "doc_id long, toxic int")
    texts, totals = toxicity._sampled(docs, labels, "text", "doc_id", "toxic", 100)
    got = texts.collect()
    assert sorted(r["label_id"] for r in got) == list(range(51)) and totals == {0: 41, 1: 10}
    assert {r["copies"] for r in got if r["label_id"] == 50} == {200}


def test_toxicity_without_labels(spark, edge_docs, no_docs):
    for labels in ([], [(1, 1), (2, 1)], [(1, 0)]):
        frame = spark.createDataFrame(labels, "doc_id long, toxic int")
        assert toxicity.drop_toxic(edge_docs, frame).count() == edge_docs.count()
    assert toxicity.drop_toxic(no_docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0


def test_em_finds_accuracies():
    rng = np.random.default_rng(4)
    n, rates = 60_000, np.array([0.95, 0.9, 0.8, 0.85, 0.7])
    truth = rng.random(n) < 0.8
    vote = np.where(rng.random((n, 5)) < rates, 1, -1) * np.where(truth, 1, -1)[:, None] * (rng.random((n, 5)) < 0.9)
    patterns, inverse, counts = np.unique(vote, axis=0, return_inverse=True, return_counts=True)
    good, accuracy, share = quality.expectation_maximisation(patterns.astype(np.int8), counts.astype(float), prior_weight=1e-4)
    assert abs(share - 0.8) < 0.02 and np.abs(accuracy - rates).max() < 0.02
    assert np.mean((good[inverse.ravel()] > 0.5) == truth) > 0.95


def test_quality_tells_junk_from_prose(spark, edge_docs, no_docs):
    rng, rows = random.Random(2), []
    for i in range(600):
        words = [w.capitalize() + "." if n % 9 == 0 else w for n, w in enumerate(prose(i, rng.randrange(60, 160)))]
        kind = rng.randrange(8)
        if kind == 0:
            words = [w.upper() + "!!" for w in words]
        elif kind == 1:
            words = [w + rng.choice(["%%%", "&&&", "$$$"]) for w in words]
        elif kind == 2:
            words = [x for w in words for x in (w.strip("."), "|")]
        elif kind == 3:
            words = words[:3] * 40
            words = sorted(words)
        rows.append((i, " ".join(words), kind > 3))
    got = {r["doc_id"]: r for r in quality.score_quality(docs_of(spark, [r[:2] for r in rows])).collect()}
    assert np.mean([got[i]["kept"] == good for i, _, good in rows]) > 0.95
    assert quality.score_quality(edge_docs).count() == edge_docs.count()
    assert quality.score_quality(no_docs).count() == 0


def test_bounds_are_optimal():
    rng = random.Random(6)
    for _ in range(40):
        lengths = sorted(rng.sample(range(1, 40), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 20) for _ in lengths]
        buckets = rng.randrange(1, 5)

        def padded(bounds):
            return sum(c * next(b for b in bounds if b >= n) for n, c in zip(lengths, counts))

        best = min(padded([*c, lengths[-1]]) for k in range(buckets) for c in itertools.combinations(lengths[:-1], min(k, len(lengths) - 1)))
        got = length_packing.optimal_bounds(np.array(lengths), np.array(counts), buckets)
        assert len(got) <= buckets and padded(got) == best


def test_packing(spark, edge_docs, edge_rows, no_docs):
    rows = [(i, " ".join(prose(i, i * 7 % 130))) for i in range(300)]
    for docs, texts in ((docs_of(spark, rows), rows), (edge_docs, edge_rows)):
        out = length_packing.pack(docs, max_len=100, buckets=5, budget=400).collect()
        words = sorted(count(t) for _, t in texts)
        assert sum(r["n_tokens"] for r in out) == sum(words)
        assert len(out) == sum(max(1, math.ceil(n / 100)) for n in words)
        assert len({r["bucket"] for r in out}) <= 5 and all(0 <= r["padding"] == r["bucket"] - r["n_tokens"] for r in out)
        batches = {}
        for r in out:
            batches.setdefault((r["bucket"], r["batch"]), []).append(r["slot"])
        last = {b: max(n for c, n in batches if c == b) for b, _ in batches}
        for (bound, n), slots in batches.items():
            full = max(400 // max(bound, 1), 1)
            assert sorted(slots) == list(range(len(slots))) and (len(slots) == full or n == last[bound])
    assert length_packing.pack(no_docs).count() == 0
    with pytest.raises(ValueError):
        length_packing.pack(no_docs, max_len=10, budget=5)


def test_mixing_weights_and_draws(spark, no_docs):
    rows = [(i, " ".join(prose(i, 5 + i % 40)), "hot" if i % 3 else f"s{i % 4}") for i in range(1200)] + [(2000, None, None), (2001, "", None), (2001, "", None)]
    docs = docs_of(spark, rows)
    size = {i: max(1, count(t)) for i, t, _ in rows}
    total = {}
    for i, _, s in rows:
        total[s] = total.get(s, 0) + size[i]
    whole = sum(total.values())

    def shares(alpha):
        p = {s: (n / whole) ** alpha for s, n in total.items()}
        return {s: x / sum(p.values()) for s, x in p.items()}

    def entropy(alpha):
        return -sum(x * math.log(x) for x in shares(alpha).values()) / math.log(len(total))

    totals = source_mixing.source_totals(docs.select("source", source_mixing.tokens_of().alias("tokens")))
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if entropy(mid) <= 0.8 else (mid, high)
    assert abs(source_mixing.find_alpha(totals, None, entropy=0.8, max_epochs=None) - high) < 1e-6
    alpha = source_mixing.find_alpha(totals, whole, max_epochs=2.0)
    assert max(shares(alpha)[s] * whole / total[s] for s in total) <= 2.0 + 1e-6

    out = source_mixing.draw(docs, budget=2 * whole, entropy=0.8, max_epochs=None, block_tokens=200).collect()
    got = {}
    for r in out:
        got.setdefault(r["source"], []).append(r)
    for s, x in shares(high).items():
        quota, drawn = round(2 * whole * x), sum(r["tokens"] for r in got[s])
        assert quota <= drawn < quota + max(size.values())
        for epoch in range(quota // total[s]):
            assert sorted(r["doc_id"] for r in got[s] if r["epoch"] == epoch) == sorted(i for i, _, z in rows if z == s)
    places = [(r["source"], r["epoch"], r["block_place"], r["place"]) for r in out]
    assert len(set(places)) == len(places)

    mixed = source_mixing.mix(docs)
    assert mixed.columns == docs.columns
    times = {}
    for r in mixed.select("doc_id", "source").collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert set(times) == set(size)
    drawn = source_mixing.draw(docs)
    assert drawn.count() == sum(times.values())
    assert source_mixing.draw(no_docs).count() == 0 and source_mixing.mix(no_docs).columns == docs.columns


def test_pipeline_stages(spark, tmp_path, edge_docs, edge_rows):
    import corpus_pipeline

    toxic = [(5000 + i, t) for i, t, _ in toxic_docs(400, seed=3)]
    flags = {5000 + i: b for i, _, b in toxic_docs(400, seed=3)}
    docs = docs_of(spark, toxic).unionByName(edge_docs)
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(b)) for i, b in flags.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    left = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{n}")
        at = spark.read.parquet(f"{tmp_path}/{n}")
        assert name == "length_packing" or at.columns == columns
        left.append([r["doc_id"] for r in at.select("doc_id").collect()])
    clean = {i for i, b in flags.items() if not b}
    assert len(set(left[0]) & set(flags) - clean) < 8 and len(clean - set(left[0])) < 4
    assert {2, 9, 11} & set(left[1]) == set() and {3} & set(left[2]) == set()
    assert {i for i in left[2] if i in clean} == {i for i in left[0] if i in clean}
    assert set(left[2]) == set(left[3]) == set(left[4])
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_half_of_all_rows_alike(spark, monkeypatch):
    """Packing and mixing spread rows alike: the fullest shard and block have under twice the median."""
    rows = [(1, "same words here", "s")] * 4_000 + [(i, f"w{i} some other words", "s") for i in range(10, 4_010)]
    docs = docs_of(spark, rows).repartition(16)
    cells = length_packing.pack(docs, max_len=8, buckets=1, budget=8)
    assert cells.count() == 8_000 and cells.select("batch", "slot").distinct().count() == 8_000
    spread = spread_repeats(source_mixing.counted(docs), "row_key")
    sizes = sorted(r["count"] for r in spread.groupBy(F.pmod(F.xxhash64("row_key", "spread"), F.lit(32))).count().collect())
    assert len(sizes) == 32 and sizes[-1] < 2 * sizes[16]
    drawn = source_mixing.draw(docs, block_tokens=500)
    per_block = sorted(r["count"] for r in drawn.groupBy("source", "epoch", "block_place").count().collect())
    assert per_block[-1] < 2 * per_block[len(per_block) // 2]
    assert [r["block_place"] for r in drawn.select("block_place").distinct().orderBy("block_place").collect()] == list(range(1, len(per_block) + 1))
    assert source_mixing.mix(docs).count() == drawn.count() == 8_000
