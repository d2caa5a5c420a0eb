"""The Merkle manifest against a plain tree, its layout, and its edges."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest_llm import docs_of
from pyspark.sql import functions as F

from gapline.llm import merkle, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def enc(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(leaves):
    """Root, and for each leaf its siblings (left, right) by level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, p in enumerate(at):
            run = p - p % 3
            paths[i].append(("".join(level[run:p]), "".join(level[p + 1 : run + 3])))
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
        at = [p // 3 for p in at]
    return level[0], paths


def expected(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    sources = defaultdict(list)
    for row in rows:
        sources[row[1]].append(row)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    leaf = {row: sha("".join(map(enc, row))) for row in rows}
    built = {}
    for name in names:
        sources[name].sort(key=lambda r: (r[0] is not None, r[0], leaf[r]))
        built[name] = plain_tree([leaf[r] for r in sources[name]])
    root, tops = plain_tree([built[name][0] for name in names])
    out = []
    for name, top in zip(names, tops):
        for row, path in zip(sources[name], built[name][1]):
            changed = row
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                changed = (*row[:4], row[4].replace("\n", ""))
            node = sha("".join(map(enc, changed)))
            for left, right in path + top:
                node = sha(left + node + right)
            proof = sha("".join(a + b for a, b in path + top))
            out.append((row[0], leaf[row], built[name][0], root, proof, node, node == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 7])
def test_addresses_are_a_layout(levels):
    """Every place once; and the subtree below each node at half height is contiguous."""
    found = [merkle.address(levels, d, np.arange(3**d)) for d in range(levels)]
    assert sorted(np.concatenate(found).tolist()) == list(range(merkle.nodes_in(levels)))
    if levels > 1:
        top, below = levels // 2, levels - levels // 2
        for i in range(3**top):
            own = [a for d in range(below) for a in found[top + d][i * 3**d : (i + 1) * 3**d].tolist()]
            assert sorted(own) == list(range(min(own), min(own) + merkle.nodes_in(below)))


@pytest.mark.parametrize("height", [1, 2, 6])
@pytest.mark.parametrize("sizes", [[1], [3], [4, 1, 9, 28, 10]])
def test_trees_of_all_sizes(spark, height, sizes):
    """Every height of subtree gives the tree of the plain method; paths fold to the root."""
    leaves = [(i, f"s{k}", sha(f"{k}/{i}")) for k, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(leaves)
    frame = spark.createDataFrame(leaves, "id long, source string, leaf string")
    out = merkle.manifest(frame, "source", "id", height=height).withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    trees = {f"s{k}": plain_tree([sha(f"{k}/{i}") for i in range(n)]) for k, n in enumerate(sizes)}
    root, tops = plain_tree([trees[f"s{k}"][0] for k in range(len(sizes))])
    assert len(out) == sum(sizes)
    for r in out:
        path = trees[r["source"]][1][r["id"]] + tops[int(r["source"][1:])]
        assert (r["subroot"], r["root"], r["folded"]) == (trees[r["source"]][0], root, root)
        assert [tuple(x) for x in r["path"]] == path


def rows_of():
    rng = random.Random(3)
    out = [(i, "s" if i % 2 else f"t{i % 7}", None, 1, "\n".join(["a", "ü"] * rng.randrange(4))) for i in range(90)]
    out += [(5, "s", "en", None, "tie of an id"), (5, "s", "en", None, "tie of an id"), (None, "s", "de", 3, "no\nid"), (7, None, None, None, None), (8, None, "x", 2, "")]
    return out + [(i, "été", "fr", i, "lone\n") for i in (200,)] + [(300, "s", "en", 9, "long \n" * 300_000)]


def query_on(spark, tmp_path, rows, schema="doc_id long, source string, lang string, n_chars long, text string"):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    return queries.QUERIES["op12_merkle_manifest"](spark, str(tmp_path))


def test_query_against_plain_trees(spark, tmp_path):
    rows = rows_of()
    got = [tuple(r) for r in query_on(spark, tmp_path, rows).select(COLUMNS).collect()]
    assert sorted(got, key=repr) == sorted(expected(rows), key=repr)
    assert {r[-1] for r in got} == {True, False}


def test_half_of_all_rows_alike(spark):
    rows = [(1, "same", "s")] * 400 + [(i, f"d{i}", "s") for i in range(2, 400)]
    frame = docs_of(spark, rows).select("*", F.sha2("text", 256).alias("leaf"))
    out = merkle.manifest(frame, "source", "doc_id", height=3)
    assert set(frame.columns) < set(out.columns)
    want, _ = plain_tree([sha("same")] * 400 + [sha(f"d{i}") for i in range(2, 400)])
    folded = out.select("subroot", "root", merkle.fold(F.col("leaf"), F.col("path")).alias("folded")).collect()
    assert len(folded) == 798 and {tuple(r) for r in folded} == {(want, want, want)}


def test_no_rows(spark, tmp_path):
    assert query_on(spark, tmp_path, []).collect() == []
