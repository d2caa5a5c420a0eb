"""Vector search, archives and chat formatting."""

import hashlib
import math
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from gapline.llm import chat_format, vector_topk, warc
from gapline.runtime import scratch_path


def brute_topk(rows, k):
    use = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in use:
        if q % 100 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in use if i != q and len(a) == len(b))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("rows", [
    [(i, [random.Random(i).gauss(0, 1) for _ in range(8)]) for i in range(700)],
    # one vector a third of the rows, ties, few candidates of another length, unusable vectors
    [(i, [0.5, -0.25, 0.125]) for i in range(200)] + [(i, [float(i % 7), 1.0, -float(i % 3)]) for i in range(200, 420)]
    + [(500, [1.0]), (501, [2.0]), (600, None), (601, []), (602, [1.0, None, 2.0]), (603, [math.nan, 1.0, 1.0]), (604, [math.inf, 0.0, 0.0]), (None, [1.0, 1.0, 1.0])],
    [(100, [1.0, 2.0])],
    [],
], ids=["random", "hot", "one", "empty"])
def test_topk(spark, monkeypatch, rows):
    monkeypatch.setattr(vector_topk, "FIRST_ROUND", 1)
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    vectors = df.select("vec_id", vector_topk.scaled("embedding").alias("vec"))
    got = vector_topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10, query_block=3)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute_topk(rows, 10)


def wide_rows():
    """Repeated ids with one and several vectors, components of 1e10 and 1e300, a zero query, ties everywhere."""
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1), rng.gauss(0, 1), 0.25]) for i in range(1, 300)]
    rows += [(7, [1.0, 2.0, 3.0]), (7, [3.0, 2.0, 1.0]), (8, [1.0, 2.0, 3.0])] + [(9, [1.0, 2.0, 3.0])] * 30
    rows += [(400, [0.0, 0.0, 0.0]), (500, [1.0, 2.0, 3.0]), (600, [-1e10, 1e10, 0.0])]
    return rows + [(301, [1e10, -1e10, 1.0]), (302, [1e10, 1e10, 1e10]), (303, [-2.5e9, 0.0, 1.0])]


@pytest.mark.parametrize("rows", [wide_rows(), [(i, [1e300 * (i % 3 - 1), 1.0, float(i)]) for i in range(150)]], ids=["wide", "beyond"])
def test_topk_of_any_numbers(spark, monkeypatch, rows):
    monkeypatch.setattr(vector_topk, "FIRST_ROUND", 1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    vectors = df.select("vec_id", vector_topk.scaled("embedding").alias("vec"))
    got = vector_topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)
    fits = lambda s: s if -(1 << 63) <= s < 1 << 63 else None
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((q, n, i, fits(s)) for q, n, i, s in brute_topk(rows, 10)), key=repr)


def scanned_pairs(spark, monkeypatch, rows):
    """Pairs that pass the scan of the cells, and pairs whose vectors are read exactly."""
    seen = {"scan": 0, "read": 0}
    cut = vector_topk.cut_lineage

    def counted(frame):
        out = cut(frame)
        seen["scan"] += out.count() if "lower" in out.columns else 0
        seen["read"] += out.where("n > 0").count() if "upper" in out.columns and "n" in out.columns else 0
        return out

    monkeypatch.setattr(vector_topk, "cut_lineage", counted)
    vectors = spark.createDataFrame(rows, "vec_id long, vec array<double>").repartition(4)
    vector_topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10).collect()
    return seen


def test_topk_outliers_and_zero_queries_stay_cheap(spark, monkeypatch):
    """One large component must not double the pairs; a zero query must not read all vectors."""
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(-2000, 2000)) for _ in range(16)]) for i in range(4_000)]
    plain = scanned_pairs(spark, monkeypatch, rows)
    monkeypatch.undo()
    outlier = scanned_pairs(spark, monkeypatch, rows + [(4_001, [1e6] + [0.0] * 15)])
    assert outlier["scan"] < 2 * plain["scan"] < 0.25 * 40 * 4_000
    monkeypatch.undo()
    zero = scanned_pairs(spark, monkeypatch, [(i, v if i % 100 else [0.0] * 16) for i, v in rows])
    assert zero["read"] < 0.05 * 40 * 4_000


def test_warc_round_trip(spark):
    rng = random.Random(3)
    html = {i: "".join(rng.choice("ab<>é\r\n") for _ in range(rng.randrange(0, 400))) for i in range(200)}
    html |= {200 + i: "same" * 50 for i in range(60)} | {300: None, 301: "", 302: "short", 303: "short", 304: "WARC/1.1\r\n\r\n" * 20}
    rows = [(i, f"http://x/{i}\r\nWARC-Type: fake" if i % 5 else None, h, "z") for i, h in html.items()]
    path = scratch_path(spark, "warc-test")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3), path)
    first = {}
    for i, h in html.items():
        first.setdefault(h or "", i)
        first[h or ""] = min(first[h or ""], i)
    got = {int(r["record_id"].rpartition(":")[2]): r for r in warc.read_warc(spark, path).collect()}
    assert set(got) == set(html)
    for i, h in html.items():
        body = (h or "").encode()
        again = len(body) >= 100 and first[h or ""] != i
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
        assert r["record_type"] == ("revisit" if again else "response") and r["payload"] == (b"" if again else body)
        assert r["refers_to"] == (f"urn:page:{first[h or '']}" if again else None)


def test_warc_small_splits_and_false_magic(spark, tmp_path):
    """Members that hold the magic themselves, cut by ranges shorter than a member."""
    rng = random.Random(5)
    bodies = [warc.MAGIC.join(rng.randbytes(rng.randrange(0, 300)) for _ in range(6)) for _ in range(40)] + [rng.randbytes(20_000)]

    def stored(data):  # gzip member that keeps the bytes as they are
        import zlib

        packer = zlib.compressobj(0, zlib.DEFLATED, 31)
        return packer.compress(data) + packer.flush()

    for name in ("a.warc", "b.warc"):
        records = [warc.build_record(f"{name}{i}", "response", "u", None, "", len(b), b) for i, b in enumerate(bodies)]
        (tmp_path / name).write_bytes(b"".join((stored if i % 3 else warc.member)(r) + (warc.EMPTY_MEMBER if i % 7 == 0 else b"") for i, r in enumerate(records)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("900", "5000", "1000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = {r["record_id"]: r["payload"] for r in warc.read_warc(spark, str(tmp_path)).collect()}
            assert got == {f"{n}{i}": b for n in ("a.warc", "b.warc") for i, b in enumerate(bodies)}, size
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_warc_magic_in_the_head_of_a_member():
    """The magic before the first decoded bytes of a record, cut by ranges at every piece."""
    import struct
    import zlib

    records = [warc.build_record(f"r{i}", "response", "u", None, "", 40, bytes(range(i, i + 40))) for i in range(6)]

    def headed(data, flag, extra):  # gzip member with the magic in its time and its extra field
        raw = zlib.compress(data, 6, -15)
        return warc.MAGIC + flag + warc.MAGIC + b"\x00\x00\x03" + extra + raw + struct.pack("<II", zlib.crc32(data), len(data))

    field = b"ab" + warc.MAGIC + b"c" + warc.MAGIC * 2 + bytes(20)
    long = bytes(5000) + warc.MAGIC + bytes(10)
    extras = [(b"\x00", b""), (b"\x04", struct.pack("<H", len(field)) + field), (b"\x04", struct.pack("<H", len(long)) + long)]
    members = [warc.member(r) if i % 4 == 3 else headed(r, *extras[i % 4 % 3]) for i, r in enumerate(records)]
    archive = b"".join(m + (warc.EMPTY_MEMBER if i == 2 else b"") for i, m in enumerate(members))
    pieces = [warc.MAGIC + x for x in archive.split(warc.MAGIC)[1:]]
    assert len(pieces) > 2 * len(records)
    for cut in range(len(pieces) + 1):
        scanned = [*warc._members(pieces[:cut]), *warc._members(pieces[cut:])]
        joined = [*warc._members(x for whole, x in scanned if not whole)]
        assert all(whole for whole, _ in joined), cut
        assert sorted(x for whole, x in scanned + joined if whole) == sorted(records), cut


def test_warc_refuses_names_it_cannot_split(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(warc.member(warc.build_record("a", "response", "u", None, "", 1, b"x")))
    with pytest.raises(Exception, match="another ending"):
        warc.read_warc(spark, str(tmp_path))


def test_warc_member_ends_in_zero():
    for size in (0, 1, 255, 1 << 16, (1 << 24) + 5):
        assert warc.member(bytes(size)).endswith(b"\x00")


def test_warc_empty(spark):
    path = scratch_path(spark, "warc-none")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).count() == 0
    assert os.path.isdir(path)


def test_chat_round_trip(spark):
    marks = ["###", "### user: ", "</turn>", "\\", "\\h", "\\t", "\\s", "\\c", ":", "#", "ü", "漢", "\n", " ", "x"]
    rng, rows = random.Random(8), []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 8)):
            role = rng.choice(["user", "assistant", "assistant", "system", None, "a: b", "### x"])
            text = rng.choice([None, "", *["".join(rng.choice(marks) for _ in range(rng.randrange(12))) for _ in range(6)]])
            rows.append((conv, rng.choice([turn, turn, None]), role, text, "said"))
    rows += rows[:5]  # repeated rows
    rows += [(99, t, "user" if t % 3 else "assistant", "long " * 50, "z") for t in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, said string")
    out = chat_format.format_chats(df)
    back = out.select("conv_id", "formatted", chat_format.parse(F.col("formatted")).alias("turns"), chat_format.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r["conv_id"]: r for r in back.collect()}
    want = {}
    for c, t, r, x, _ in rows:
        want.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns = [(r, x) for _, _, r, x in sorted(turns)]
        assert [tuple(t) for t in got[c]["turns"]] == turns
        assert got[c]["loss"] == [x for r, x in turns if r == "assistant"]
        blocks = 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:]))
        assert got[c]["formatted"].count("### ") == blocks and got[c]["formatted"].count("</turn>") == len(turns)
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_chat_of_many_turns_is_linear(spark):
    """32,000 turns in one conversation; a quadratic fold takes minutes here."""
    n = 32_000
    text = F.concat(F.lit("té </turn> "), F.col("id").cast("string"), F.repeat(F.lit("x"), 90))
    role = F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")
    out = chat_format.format_chats(spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), text.alias("text")))
    began = time.monotonic()
    r = out.select("formatted", "loss_spans", F.size(chat_format.parse(F.col("formatted"))).alias("n"), chat_format.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert time.monotonic() - began < 40
    assert r["n"] == n and r["loss"] == [f"té </turn> {i}" + "x" * 90 for i in range(1, n, 2)]
    for span in (r["loss_spans"][0], r["loss_spans"][-1]):
        by_point = r["formatted"][span["start"] : span["start"] + span["length"]]
        assert by_point == r["formatted"].encode()[span["first_byte"] : span["first_byte"] + span["bytes"]].decode()
