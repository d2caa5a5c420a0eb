"""Toxicity by a classifier chain.

Categories are predicted in order. Each has a logistic model over hashed words and word
beginnings, and over the probabilities of the categories before it. In training those
probabilities are out of fold, so a later model sees them as noisy as they will be.

Training uses a bounded sample: of the labelled rows with a text at most
``sample`` for each value of the label, chosen by a hash; weights restore their shares.
Of a sampled text at most ``row_features`` distinct features train the models, those of the
smallest hashed numbers, so the driver holds at most 8 * sample * row_features bytes of them.
Documents that repeat an id are one row (the smallest text) with their number as weight.
Everything else, the scoring, reads all documents and all features.

The categories before the last are kinds of toxicity found in the sample: its toxic rows
are clustered by the features that toxic rows have more often than others, in whatever
language. The last category is the label itself. No word list is involved.

Defined results: null and empty texts have no features and the base rate of the model;
labels that are null or have no document are left out, as are null ids (their documents are
scored); of repeated labels the largest counts; repeated documents each get the same scores;
without labels, or with labels of one value only, nothing is toxic; no documents give no
rows; very long texts are scored whole, in batches of one; further columns, whatever their
names, pass ``drop_toxic`` unchanged and do not reach ``score``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.llm.linear import DIM, Model, Rows, fit, received, send, sparse
from gapline.llm.words import Hasher, letters, mix, slices

SAMPLE, FOLDS = 3000, 4
BEGINNINGS = (4, 5, 6, 7, 8)
BATCH_BYTES = 4 << 20
# Kinds of toxicity before the label itself.
KINDS = 2
ROW_FEATURES = 1 << 13
BENDS = (0.25, 0.5, 1.0, 2.0, 4.0)
CHAIN = [*(f"kind_{k + 1}" for k in range(KINDS)), "toxic"]


def word_features(hasher: Hasher, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """cut and index of the hashed words and beginnings of each text."""
    words = hasher.split(texts)
    doc = words.doc()
    owner, found = [doc], [words.hashes()]
    for n in BEGINNINGS:
        long = np.flatnonzero(words.stop - words.start >= n)
        found.append(mix(hasher.words(words.raw, words.start[long], words.start[long] + n) + np.uint64(n)))
        owner.append(doc[long])
    cut, index, _ = sparse(np.concatenate(owner), np.concatenate(found), len(texts))
    return cut, index


def toxic_kinds(rows: Rows, label: np.ndarray, weight: np.ndarray, kinds: int = KINDS, least_rows: int = 5, steps: int = 20) -> np.ndarray:
    """The kind of each toxic row, 0 for the largest; -1 for the other rows.

    Spherical k-means over the features that toxic rows have more often, weighted by the
    logarithm of how much more often. It starts from cuts of the projection on the main
    direction, even and uneven, and keeps the tightest result, so equal input gives equal kinds. Toxic rows without such features are
    of kind 0. With fewer toxic rows than kinds the last kinds stay empty.
    """
    kind = np.where(label == 1, 0, -1)
    bad = np.flatnonzero(label == 1)
    total = np.array([weight[label == v].sum() for v in (0, 1)])
    if not len(bad) or not total[0]:
        return kind
    clean, toxic = (rows.totals(weight * (label == v)) for v in (0, 1))
    lift = np.log((toxic + 0.5) / (total[1] + 1)) - np.log((clean + 0.5) / (total[0] + 1))
    lift[(lift <= 0) | (rows.seen() < least_rows)] = 0
    few = rows.pick(bad)
    who, value = few.owner(), lift[few.index]
    used, col = np.unique(few.index[value > 0], return_inverse=True)
    who, value = who[value > 0], value[value > 0]
    size = np.sqrt(np.bincount(who, weights=value**2, minlength=len(bad)))
    full = np.flatnonzero(size > 0)
    if len(full) < kinds:
        return kind
    value = value / size[who]

    def project(direction: np.ndarray) -> np.ndarray:
        return np.bincount(who, weights=value * direction[col], minlength=len(bad))

    mean = np.bincount(col, weights=value, minlength=len(used)) / len(full)
    main = np.arange(1, len(used) + 1) / len(used) - mean
    for _ in range(steps):
        at = project(main) - mean @ main
        at[size == 0] = 0
        main = np.bincount(col, weights=value * at[who], minlength=len(used)) - at.sum() * mean
        main /= max(np.linalg.norm(main), 1e-12)
    ordered = full[np.argsort(project(main)[full], kind="stable")]
    best, of = -1.0, np.zeros(len(bad), np.int64)
    for bend in BENDS:
        now = np.zeros(len(bad), np.int64)
        now[ordered] = (np.arange(len(full)) / len(full)) ** bend * kinds
        for _ in range(steps):
            centres = np.stack([np.bincount(col, weights=value * (now[who] == k), minlength=len(used)) for k in range(kinds)])
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
            near = np.stack([project(c) for c in centres]).round(9)
            new = np.argmax(near, axis=0)
            if (new == now).all():
                break
            now = new
        if near.max(axis=0).sum() > best:
            best, of = near.max(axis=0).sum(), now
    rank = np.empty(kinds, np.int64)
    rank[np.argsort(-np.bincount(of[full], minlength=kinds), kind="stable")] = np.arange(kinds)
    kind[bad[full]] = rank[of[full]]
    return kind


def _sampled(docs: DataFrame, labels: DataFrame, text_col: str, id_col: str, label_col: str, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """Texts of the sample with their label, and how many rows each label value has."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.max(F.col(label_col)).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1))
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    parts = [known.where(F.col("label") == v).orderBy(F.xxhash64("label_id"), "label_id").limit(sample) for v in (0, 1)]
    few = parts[0].unionByName(parts[1])  # at most two samples of rows
    texts = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    single = texts.join(F.broadcast(few), "label_id").groupBy("label_id", "label").agg(F.min("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    return single.select("label_id", "label", "text", "copies"), totals


def train_chain(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, folds: int = FOLDS, row_features: int = ROW_FEATURES) -> tuple[list[Model], float, dict]:
    """The chain's models, the threshold of its last category, and out-of-fold figures."""
    texts, totals = _sampled(docs, labels, text_col, id_col, label_col, sample)

    def extract(batches):
        hasher = Hasher(letters(), lower=True)
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                cut, index = word_features(hasher, batch.column("text"))
                packed = [_fewer(index[a:b], row_features).tobytes() for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column("copies"), pa.array(packed, pa.binary())], ["label_id", "label", "copies", "features"])

    found = texts.mapInArrow(extract, "label_id long, label int, copies long, features binary")
    got = sorted(found.collect(), key=lambda r: (r["label_id"], r["label"], r["features"]))
    index = [np.frombuffer(r["features"], np.int32) for r in got]
    cut = np.concatenate([[0], np.cumsum([len(x) for x in index])]).astype(np.int64)
    flat = np.concatenate(index) if index else np.zeros(0, np.int32)
    rows = Rows(cut, flat, np.ones(len(flat), np.int8), np.zeros((len(got), 0)))
    label = np.array([r["label"] for r in got], np.float64)
    weight = np.array([r["copies"] for r in got], np.float64)
    fold = np.arange(len(got)) % folds
    del got, index  # the rows hold their own copy
    for v in (0, 1):
        mine = label == v
        if mine.any():
            weight[mine] *= max(1.0, totals[v] / weight[mine].sum())
    kind = toxic_kinds(rows, label, weight)
    models, held = [], []
    for place in range(len(CHAIN)):
        target = (kind == place).astype(np.float64) if place < KINDS else label
        seen = rows.with_dense(*held)
        out = np.zeros(len(rows))
        for f in range(folds):
            train, valid = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(valid):
                out[valid] = fit(seen.pick(train), target[train], weight[train]).predict(seen.pick(valid))
        models.append(fit(seen, target, weight))
        held.append(out)
    threshold, figures = _threshold(label, held[-1], weight)
    return models, threshold, figures


def _fewer(index: np.ndarray, most: int) -> np.ndarray:
    """At most so many of a row's features, those whose hashed numbers are smallest."""
    if len(index) > most:
        index = index[np.sort(np.argsort(mix(index.astype(np.uint64)), kind="stable")[:most])]
    return index.astype(np.int32)


def _threshold(label: np.ndarray, score: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """The out-of-fold threshold of the best F1; above every score where there is none."""
    if not label.any() or label.all():
        return 2.0, {}
    order = np.argsort(-score, kind="stable")
    hit, told = np.cumsum((weight * label)[order]), np.cumsum(weight[order])
    last = np.append(np.flatnonzero(np.diff(score[order])), len(order) - 1)
    f1 = 2 * hit[last] / (told[last] + (weight * label).sum())
    best = last[np.argmax(f1)]
    below = score[order[best + 1]] if best + 1 < len(order) else 0.0
    figures = {"precision": hit[best] / told[best], "recall": hit[best] / hit[-1], "f1": f1.max()}
    return float((score[order[best]] + below) / 2), figures


def _chained(models: list[Model], hasher: Hasher, texts: pa.Array) -> list[np.ndarray]:
    cut, index = word_features(hasher, texts)
    rows, out = Rows(cut, index, np.ones(len(index), np.float32), np.zeros((len(texts), 0))), []
    for model in models:
        out.append(model.predict(rows.with_dense(*out)))
    return out


def score(docs: DataFrame, models: list[Model], threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the probability of each category, toxic_flag."""
    sent = send(docs.sparkSession, models)

    def run(batches):
        hasher, chain = Hasher(letters(), lower=True), received(sent)
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                probs = _chained(chain, hasher, batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, probs), pa.array(probs[-1] >= threshold)], ["id", *CHAIN, "toxic_flag"])

    schema = "id long, " + ", ".join(f"{c} double" for c in CHAIN) + ", toxic_flag boolean"
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents below the threshold, with all columns."""
    models, threshold, _ = train_chain(docs, labels, id_col, text_col)
    sent = send(docs.sparkSession, models)

    def run(batches):
        hasher, chain = Hasher(letters(), lower=True), received(sent)
        for whole in batches:
            for batch in slices(whole, text_col, BATCH_BYTES):
                yield batch.filter(pa.array(_chained(chain, hasher, batch.column(text_col))[-1] < threshold))

    return docs.mapInArrow(run, docs.schema)
