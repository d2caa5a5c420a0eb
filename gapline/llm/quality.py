"""Quality by weak labels: labellers, expectation-maximisation, a hashed linear scorer.

Heuristic labellers vote good (1), bad (-1) or nothing (0) on each document. Votes of
all documents are counted by pattern (at most 3^9 patterns). From the counts, EM
estimates how often each labeller votes each way on good and on bad documents, and so
the probability that a pattern means good. A prior of a tenth of the rows says that
labellers seldom vote bad on good documents; it tells the two classes apart where kinds of
bad documents have no labeller in common. Those posteriors are the soft
targets of a logistic scorer over hashed tokens, token endings, token shapes and repeats, fitted
on at most ``sample`` documents chosen by a hash; it scores all documents.

Defined results: null and empty texts are voted bad by the tails and variety labellers; an empty
table gives an empty table; repeated rows vote each for itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.llm.linear import Model, Rows, fit, received, send, sparse
from gapline.llm.words import Hasher, Words, mix, slices
from gapline.runtime import cut_lineage

SAMPLE = 6000
BATCH_BYTES = 8 << 20
LABELLERS = ("case", "symbols", "exclaims", "pipes", "tails", "stops", "variety", "lines", "repeats")
# Prior rates of the votes bad and good, where one is cast, on bad and on good documents.
PRIOR = {"bad": (0.4, 0.6), "good": (0.02, 0.98)}
SYMBOLS = b"#$%&*<>=^~{}[]\\@_+"


class Voter:
    """Splits texts to words and lines; made once per task."""

    def __init__(self):
        self.words = Hasher()
        lines = np.ones(256, bool)
        lines[[10, 13]] = False
        self.lines = Hasher(lines)

    def __call__(self, texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, list[str]]:
        """Words, their hashes, votes (documents x labellers), votes as strings."""
        words, lines = self.words.split(texts), self.lines.split(texts)
        hashes = words.hashes()
        told = votes(words, hashes, distinct_share(lines, lines.hashes()))
        return words, hashes, told, [row.tobytes().decode() for row in np.frombuffer(b"-.+", np.uint8)[told + 1]]


def distinct_share(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Distinct items over items of each text; 1 where there are none."""
    packed = np.sort(words.doc().astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))
    new = np.flatnonzero(np.diff(packed, prepend=packed[:1] + np.uint64(1)))
    counts = words.counts()
    share = np.bincount((packed[new] >> np.uint64(40)).astype(np.int64), minlength=len(counts)) / np.maximum(counts, 1)
    return np.where(counts == 0, 1.0, share)


def repeats(words: Words, hashes: np.ndarray) -> np.ndarray:
    """For all words but the first: whether the word before is the same, in the same text."""
    doc = words.doc()
    return (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])


def votes(words: Words, hashes: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Votes (documents x labellers)."""
    n = len(words.first) - 1
    counts = np.maximum(words.counts(), 1)
    ends, raw = words.ends, words.raw

    def per_text(is_one: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(is_one, dtype=np.int64)])
        return total[ends[1:]] - total[ends[:-1]]

    upper = per_text((raw >= 65) & (raw <= 90))
    letter = np.maximum(per_text(((raw | 32) >= 97) & ((raw | 32) <= 122)), 1)
    symbol = per_text(np.isin(raw, np.frombuffer(SYMBOLS, np.uint8))) / counts
    exclaim = per_text(raw == 33) / counts
    pipe = per_text(raw == 124) / counts
    last = raw[words.stop - 1] if len(words) else np.zeros(0, np.uint8)
    stop = np.bincount(words.doc(), weights=np.isin(last, np.frombuffer(b".?!", np.uint8)), minlength=n) / counts
    plain = np.isin(last, np.frombuffer(b".,;:?)\"'", np.uint8)) | (last >= 128) | (((last | 32) >= 97) & ((last | 32) <= 122)) | ((last >= 48) & (last <= 57))
    tail = np.bincount(words.doc(), weights=plain, minlength=n) / counts
    distinct = distinct_share(words, hashes)
    again = np.bincount(words.doc()[1:][repeats(words, hashes)], minlength=n) / counts
    long = counts >= 50
    case = upper / letter
    empty = words.counts() == 0

    def vote(bad, good):
        return np.where(empty, 0, np.where(bad, -1, np.where(good, 1, 0)))

    return np.stack(
        [
            vote((case > 0.3) & (letter >= 20), case < 0.12),
            vote(symbol > 0.3, symbol < 0.02),
            vote(exclaim > 0.3, exclaim < 0.05),
            vote(pipe > 0.2, pipe < 0.01),
            np.where(empty, -1, vote(tail < 0.75, tail > 0.95)),
            vote((stop < 0.005) & (counts > 20), (stop > 0.03) & (stop < 0.4)),
            np.where(empty, -1, vote(long & (distinct < 0.15), long & (distinct > 0.25))),
            vote(lines < 0.6, lines > 0.9),
            vote((counts >= 10) & (again > 0.2), again < 0.05),
        ],
        axis=1,
    ).astype(np.int8)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, prior_weight: float = 0.1) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability of good per pattern; accuracy per labeller on its votes; share of good.

    Given the class, labellers are taken as independent. Rates start at the prior, which
    counts as ``prior_weight`` of the rows.
    """
    kinds = np.stack([patterns == v for v in (-1, 1)], axis=2)  # pattern x labeller x vote; no vote tells nothing
    prior = np.array([PRIOR["good"], PRIOR["bad"]])[:, None, :]
    start = np.log(prior[0]) - np.log(prior[1])
    good = 0.5 * (1 + np.tanh(0.5 * (np.log(4) + np.einsum("plv,lv->p", kinds, np.broadcast_to(start, kinds.shape[1:])))))
    share = 0.5
    for _ in range(rounds):
        mass = np.stack([counts * good, counts * (1 - good)])
        share = float(np.clip(mass[0].sum() / counts.sum(), 1e-4, 1 - 1e-4))
        rate = np.einsum("cp,plv->clv", mass, kinds) + prior * (1 + prior_weight * counts.sum())
        rate /= rate.sum(axis=2, keepdims=True)
        odds = np.log(share / (1 - share)) + np.einsum("plv,lv->p", kinds, np.log(rate[0]) - np.log(rate[1]))
        new = 0.5 * (1 + np.tanh(0.5 * odds))
        if np.abs(new - good).max() < 1e-9:
            good = new
            break
        good = new
    right = (counts * good) @ (patterns == 1) + (counts * (1 - good)) @ (patterns == -1)
    accuracy = right / np.maximum(counts @ (patterns != 0), 1)
    return good, accuracy, share


def token_features(hasher: Hasher, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cut, index and value: the share of a text's tokens with a feature."""
    raw, start, stop, doc = words.raw, words.start, words.stop, words.doc()
    shape = np.full(256, 5, np.uint8)
    shape[97:123], shape[65:91], shape[48:58], shape[128:] = 1, 2, 3, 4
    kinds = shape[raw]
    ending = np.maximum(stop - 2, start)
    found = [hashes, mix(hasher.words(raw, ending, stop) + np.uint64(1)), mix(hasher.words(kinds, start, np.minimum(start + 4, stop)) + np.uint64(2))]
    again = doc[1:][repeats(words, hashes)]
    found.append(np.full(len(again), 7, np.uint64))  # one feature of its own
    cut, index, count = sparse(np.concatenate([doc, doc, doc, again]), np.concatenate(found), len(words.first) - 1)
    return cut, index, (count / np.maximum(np.repeat(words.counts(), np.diff(cut)), 1)).astype(np.float32)


def vote_all(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, votes (a string of +, - and .), picked by a hash for training."""

    def run(batches):
        voter = Voter()
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                told = voter(batch.column("text"))[3]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("place"), pa.array(told, pa.string())], ["id", "place", "votes"])

    named = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, text_col).alias("place"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, "id long, place long, votes string")


def train_scorer(docs: DataFrame, voted: DataFrame, posterior: dict[str, float], sample: int, id_col: str, text_col: str) -> Model:
    # Rows that repeat are one row of the sample, with their number as weight.
    single = voted.groupBy("place").agg(F.min("votes").alias("votes"), F.count(F.lit(1)).alias("copies"))
    picked = single.orderBy("place").limit(sample)  # bounded
    texts = docs.select(F.xxhash64(id_col, text_col).alias("place"), F.col(text_col).alias("text")).join(F.broadcast(picked), "place")
    texts = texts.groupBy("place", "votes", "copies").agg(F.min("text").alias("text"))

    def extract(batches):
        hasher = Hasher()
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                words = hasher.split(batch.column("text"))
                cut, index, value = token_features(hasher, words, words.hashes())
                pack = lambda x, kind: pa.array([x[a:b].astype(kind).tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("place"), batch.column("votes"), batch.column("copies"), pack(index, np.int32), pack(value, np.float32)], ["place", "votes", "copies", "index", "value"]
                )

    got = texts.select("place", "votes", "copies", "text").mapInArrow(extract, "place long, votes string, copies long, index binary, value binary").collect()
    got = sorted(got, key=lambda r: r["place"])
    index = [np.frombuffer(r["index"], np.int32) for r in got]
    value = [np.frombuffer(r["value"], np.float32) for r in got]
    cut = np.concatenate([[0], np.cumsum([len(x) for x in index])]).astype(np.int64)
    flat = np.concatenate([np.zeros(0, np.int32), *index])
    rows = Rows(cut, flat, np.concatenate([np.zeros(0, np.float32), *value]), np.zeros((len(got), 0)))
    target = np.array([posterior[r["votes"]] for r in got])
    return fit(rows, target, np.array([r["copies"] for r in got], np.float64), penalty=0.02)


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """One row per document: its id, votes, posterior (of its votes), score, kept."""
    spark = docs.sparkSession
    voted = cut_lineage(vote_all(docs, id_col, text_col))
    counted = sorted((r["votes"], r["count"]) for r in voted.groupBy("votes").count().collect())  # at most 3^9
    told = np.array([[{"-": -1, ".": 0, "+": 1}[x] for x in v] for v, _ in counted], np.int8).reshape(len(counted), len(LABELLERS))
    good = expectation_maximisation(told, np.array([n for _, n in counted], np.float64))[0] if counted else np.zeros(0)
    posterior = {v: float(p) for (v, _), p in zip(counted, good)}
    sent = send(spark, (train_scorer(docs, voted, posterior, sample, id_col, text_col), posterior))

    def run(batches):
        model, means = received(sent)
        voter = Voter()
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                words, hashes, _, vote = voter(batch.column("text"))
                cut, index, value = token_features(voter.words, words, hashes)
                probs = model.predict(Rows(cut, index, value, np.zeros((batch.num_rows, 0))))
                columns = [batch.column("id"), pa.array(vote, pa.string()), pa.array([means[v] for v in vote], pa.float64()), pa.array(probs), pa.array(probs >= threshold)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "votes", "posterior", "score", "kept"])

    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, "id long, votes string, posterior double, score double, kept boolean").withColumnRenamed("id", id_col)
