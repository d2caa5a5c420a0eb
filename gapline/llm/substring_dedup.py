"""Substring dedup by fixed-block anchors.

Every text is cut into non-overlapping reference blocks of half a window. A run of a
full window holds a whole block, wherever it starts, so a repeat shows itself where a
rolling window of another place hits an indexed block. Three passes over the texts,
which are dealt out by document once:

1. Anchors. Each task hashes all rolling block-sized windows of its texts, flags those
   that are reference blocks, and deals them to partitions by hash. A hash with a block
   and a second place is a hit.
2. Extension. Around each hit the full windows that contain it are looked up by two
   hashes for the smallest document in which they start: adjacent windows with a smaller
   document are the maximal exact repeats.
3. The words under such windows leave their text.

Places travel as packed arrays of one row per (task batch, partition), 5 bytes a word.
Windows that repeat inside a batch are settled there and sent once, so a passage that a
third of all documents share costs a partition one entry per batch, not one per document.
No pairs of documents are made.

Defined results: null texts are empty; documents without an id keep all their words and
remove none elsewhere; rows that repeat an id are judged each for itself, against
smaller ids only; texts shorter than a window stay whole, and texts of any length are taken
whole, in slices; other columns take no part, whatever their names; an empty table gives an
empty result. Windows are equal when two 64-bit hashes of their words' hashes are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.llm.tables import partitions
from gapline.llm.words import Hasher, slices

WINDOW = 50
BATCH_BYTES = 16 << 20
KEYS = ["id0", "text_key", "source_part"]
PACKED = "part int, batch string, kind int, places binary, keys binary, docs binary"
FOUND = "batch string, kind int, places binary, keys binary, docs binary"
PLACES = "id0 long, text_key long, source_part long, places binary"


def _pack(numbers: np.ndarray) -> bytes:
    """Ascending numbers by their steps, compressed."""
    steps = np.diff(numbers, prepend=0).astype(np.uint32 if len(numbers) == 0 or numbers[-1] < 1 << 32 else np.uint64)
    code = pa.compress(steps.tobytes(), codec="zstd", asbytes=True)
    return np.array([steps.nbytes, steps.itemsize], np.int64).tobytes() + code


def _unpack(data: bytes) -> np.ndarray:
    size, item = np.frombuffer(data[:16], np.int64)
    steps = np.frombuffer(pa.decompress(data[16:], decompressed_size=int(size), codec="zstd", asbytes=True), np.uint32 if item == 4 else np.uint64)
    return np.cumsum(steps, dtype=np.int64)


def _pack_ids(ids: np.ndarray) -> bytes:
    return ids[:1].astype(np.int64).tobytes() + _pack(ids - ids[0])


def _unpack_ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data[:8], np.int64) + _unpack(data[8:])


def _rows(rows: list, schema: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(columns, kinds)], list(names))


def _first_of_equal(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Per sorted place, the sorted place at which its run of equal keys begins."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    return np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))


def _deal(batch_id: str, part: np.ndarray, n_parts: int, places: np.ndarray, keys: np.ndarray, docs: np.ndarray | None) -> list:
    """Rows of one batch, one per partition that gets something. places ascend."""
    order = np.argsort(part.astype(np.uint16) if n_parts <= 1 << 16 else part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(n_parts + 1))
    out = []
    for p in np.flatnonzero(np.diff(cuts)):
        pick = order[cuts[p] : cuts[p + 1]]
        out.append((int(p), batch_id, 1, _pack(places[pick]), keys[pick].tobytes(), None if docs is None else _pack_ids(docs[pick])))
    return out


def _directory(batch_id: str, n_parts: int, table: pa.Table, first: np.ndarray, settled: np.ndarray) -> tuple:
    """The row that tells a batch's places apart by document, with the places already settled."""
    part = int(hashlib.blake2b(batch_id.encode(), digest_size=4).hexdigest(), 16) % n_parts
    ids = np.stack([*(table[k].to_numpy() for k in KEYS), first[:-1]])
    return (part, batch_id, 0, _pack(settled), first[-1:].astype(np.int64).tobytes(), pa.compress(ids.tobytes(), codec="zstd", asbytes=True) + np.int64(ids.nbytes).tobytes())


def _batches(stream):
    """Slices of a partition's documents, repeated rows and rows without words left out."""
    from pyspark import TaskContext

    task, number, before = TaskContext.get().partitionId(), 0, None
    for whole in stream:
        for batch in slices(whole, "text", BATCH_BYTES):
            keep = []
            for row in zip(*(batch.column(k).to_pylist() for k in KEYS)):
                keep.append(row != before)
                before = row
            number += 1
            yield f"{task}-{number}", batch.filter(pa.array(keep, pa.bool_()))


def _anchors(width: int, n_parts: int):
    block = width // 2

    def run(stream):
        hasher = Hasher()
        for name, batch in _batches(stream):
            words = hasher.split(batch.column("text"))
            at = words.window_starts(block)
            at = at[np.repeat(words.counts() >= width, np.maximum(words.counts() - block + 1, 0))]
            if not len(at):
                continue
            hashes = hasher.windows(words.hashes(), block)[at]
            is_block = (at - words.first[np.searchsorted(words.first, at, "right") - 1]) % block == 0
            order = np.argsort(hashes, kind="stable")
            begin = _first_of_equal(order, hashes)
            alone = np.bincount(begin, minlength=len(order))[begin] == 1
            flag = np.zeros(len(order), bool)
            flag[begin[is_block[order]]] = True
            head = order[begin == np.arange(len(order))]
            is_block[head] = flag[begin == np.arange(len(order))]
            settled = np.sort(at[order[~alone]])
            head.sort()
            h = hashes[head]
            part = ((h >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64)
            key = (h.astype(np.uint32) & np.uint32(0xFFFFFFFE)) | is_block[head].astype(np.uint32)
            rows = _deal(name, part, n_parts, at[head], key, None)
            rows.append(_directory(name, n_parts, batch, words.first, settled))
            yield _rows(rows, PACKED)

    return run


def _gather(stream):
    """All packed rows of a partition: pass-through rows, and the entries with their row."""
    through, entries = [], []
    for batch in stream:
        for row in batch.to_pylist():
            (entries if row["kind"] else through).append(row)
    return through, entries


def _reply(entries: list, places: list, sizes: np.ndarray, hit: np.ndarray) -> list:
    ends, out = np.cumsum(sizes), []
    for row, at, b, n in zip(entries, places, ends, sizes):
        good = at[hit[b - n : b]]
        if len(good):
            out.append((row["batch"], 1, _pack(good), None, None))
    return out


def _hits(stream):
    """Partition of anchors: places whose hash has a reference block and another place."""
    through, entries = _gather(stream)
    if through:
        yield _rows([(r["batch"], 0, r["places"], r["keys"], r["docs"]) for r in through], FOUND)
    if not entries:
        return
    places = [_unpack(r["places"]) for r in entries]
    keys = np.concatenate([np.frombuffer(r["keys"], np.uint32) for r in entries])
    bare = keys >> np.uint32(1)
    order = np.argsort(bare, kind="stable")
    begin = _first_of_equal(order, bare)
    blocks = np.bincount(begin, weights=(keys[order] & 1).astype(np.float64), minlength=len(order))[begin]
    hit = np.zeros(len(keys), bool)
    hit[order] = (blocks > 0) & (np.bincount(begin, minlength=len(order))[begin] > 1)
    yield _rows(_reply(entries, places, np.array([len(p) for p in places]), hit), FOUND)


def _by_document(table: pa.Table) -> pa.Table:
    """Rows of one batch: its directory and its found places, told apart by document."""
    rows = table.to_pylist()
    told = next(r for r in rows if r["kind"] == 0)
    raw = told["docs"]
    *keys, first = np.frombuffer(pa.decompress(raw[:-8], decompressed_size=int(np.frombuffer(raw[-8:], np.int64)[0]), codec="zstd", asbytes=True), np.int64).reshape(4, -1)
    found = np.unique(np.concatenate([_unpack(r["places"]) for r in rows]))
    cuts = np.searchsorted(found, [*first, np.frombuffer(told["keys"], np.int64)[0]])
    out = [(*(int(k[d]) for k in keys), _pack(found[cuts[d] : cuts[d + 1]] - first[d])) for d in np.flatnonzero(np.diff(cuts))]
    return pa.Table.from_batches([_rows(out, PLACES)])


def _around(batch: pa.RecordBatch, words, width: int) -> np.ndarray:
    """Full windows that contain a hit of their document."""
    near, block = np.zeros(len(words) + 1, np.int32), width // 2
    for d, packed in enumerate(batch.column("places").to_pylist()):
        at, first, n = _unpack(packed), words.first[d], words.first[d + 1] - words.first[d]
        np.add.at(near, first + np.maximum(at - (width - block), 0), 1)
        np.add.at(near, first + np.minimum(at, n - width) + 1, -1)
    return np.flatnonzero(np.cumsum(near[:-1]) > 0)


def _extensions(width: int, n_parts: int):
    def run(stream):
        hasher = Hasher()
        for name, batch in _batches(stream):
            words = hasher.split(batch.column("text"))
            at = _around(batch, words, width)
            if not len(at):
                continue
            hashes = words.hashes()
            one, two = hasher.windows(hashes, width)[at], hasher.windows(hashes, width, 1)[at]
            ids = batch.column("id0").to_numpy()[np.searchsorted(words.first, at, "right") - 1]
            order = np.lexsort((ids, two, one))
            begin = _first_of_equal(order, one, two)
            later = ids[order] > ids[order[begin]]
            settled = np.sort(at[order[later]])
            # Of equal windows of the smallest document all places are told: they share their fate.
            head = np.sort(order[~later])
            part = ((one[head] >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64)
            rows = _deal(name, part, n_parts, at[head], np.stack([one[head], two[head]], 1), ids[head])
            rows.append(_directory(name, n_parts, batch, words.first, settled))
            yield _rows(rows, PACKED)

    return run


def _repeats(stream):
    """Partition of full windows: places whose window starts in a smaller document."""
    through, entries = _gather(stream)
    if through:
        yield _rows([(r["batch"], 0, r["places"], r["keys"], r["docs"]) for r in through], FOUND)
    if not entries:
        return
    places = [_unpack(r["places"]) for r in entries]
    keys = np.concatenate([np.frombuffer(r["keys"], np.uint64).reshape(-1, 2) for r in entries])
    ids = np.concatenate([_unpack_ids(r["docs"]) for r in entries])
    order = np.lexsort((ids, keys[:, 1], keys[:, 0]))
    begin = _first_of_equal(order, keys[:, 0], keys[:, 1])
    hit = np.zeros(len(ids), bool)
    hit[order] = ids[order] > ids[order[begin]]
    yield _rows(_reply(entries, places, np.array([len(p) for p in places]), hit), FOUND)


def repeated_windows(texts: DataFrame, width: int = WINDOW) -> DataFrame:
    """Per document with repeats: its keys, places (packed starts of repeated windows).

    texts: the keys and text, dealt by the keys and sorted by them in partitions.
    """
    n = partitions(texts.sparkSession)

    def found(docs: DataFrame, send, match) -> DataFrame:
        dealt = docs.mapInArrow(send, PACKED).repartitionById(n, F.col("part"))
        return dealt.mapInArrow(match, FOUND).groupBy("batch").applyInArrow(_by_document, PLACES)

    hits = found(texts, _anchors(width, n), _hits)
    near = texts.join(hits, KEYS).sortWithinPartitions(*KEYS)
    return found(near, _extensions(width, n), _repeats)


def _cut(width: int):
    def run(stream):
        hasher = Hasher()
        for whole in stream:
            for batch in slices(whole, "text", BATCH_BYTES):
                words = hasher.split(batch.column("text"))
                raw, ids, out = words.raw.tobytes(), batch.column("id0").to_pylist(), []
                for d, packed in enumerate(batch.column("places").to_pylist()):
                    a, b = words.first[d], words.first[d + 1]
                    cover = np.zeros(b - a + 1, np.int32)
                    if packed is not None:
                        at = _unpack(packed)
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + width, -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist()
                    runs = zip([0, *edge[1::2]], [*edge[::2], int(b - a)])
                    kept = b" ".join([b" ".join(raw[words.start[a + i] : words.stop[a + j - 1]].split()) for i, j in runs if j > i])
                    out.append((ids[d], int(b - a), int(gone.sum()), kept, edge))
                columns = list(zip(*out))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n_words", "n_removed", "kept", "spans"])

    return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Keys and text of every row. The input partition is a key, so that a row that repeats often is not dealt to one task."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id0"), F.xxhash64(text).alias("text_key"), F.spark_partition_id().cast("long").alias("source_part"), text.alias("text"))


def dealt(every: DataFrame) -> DataFrame:
    n = partitions(every.sparkSession)
    return every.where(F.col("id0").isNotNull()).repartition(n, *KEYS).sortWithinPartitions(*KEYS)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text, spans.

    kept_text joins the words that stay by one space; spans are the bounds (first word,
    word after the last, and so on) of the runs that left. ``width`` is even.
    """
    if width < 2 or width % 2:
        raise ValueError("the window needs an even number of words")
    every = keyed(docs, id_col, text_col)
    texts = dealt(every)
    places = repeated_windows(texts, width)
    cut = texts.join(places, KEYS, "left").select("id0", "text", "places")
    loose = every.where(F.col("id0").isNull()).select("id0", "text", F.lit(None).cast("binary").alias("places"))
    cut = cut.unionByName(loose)
    out = cut.mapInArrow(_cut(width), "doc_id long, n_words long, n_removed long, kept binary, spans array<long>")
    return out.select(F.col("doc_id").alias(id_col), "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"), "spans")
