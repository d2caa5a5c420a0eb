"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import sys
import zlib
from collections import defaultdict
from functools import cache

import pytest

from gapline.llm import conversation_repair, queries

sys.setrecursionlimit(50_000)  # the plain search goes a step a row
LEGAL = re.compile(r"(s?(ua)+)?")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def cheapest(rows):
    """(cost, audit, repaired) of rows (role, text, fault) by trying every edit, cheapest and least first."""
    due = {"": "u", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i, last, inserts):
        found = []
        if i == len(rows) and last in ("", "a"):
            found.append((0, "", ()))
        if inserts < 3:
            for r in ("user", "assistant"):
                if due[last] == r[0]:
                    c, a, out = best(i, r[0], inserts + 1)
                    found.append((c + 2, "I" + a, ((r, ""), *out)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, a, out = best(i + 1, last, 0)
            found.append((c + 3, "D" + a, out))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if due[last] == role[:1] or (last == "" and role[:1] == "s"):
                    c, a, out = best(i + 1, role[:1], 0)
                    found.append((c + more, "K" + a, ((role, text), *out)))
                for r in ("user", "assistant"):
                    if due[last] == r[0]:
                        c, a, out = best(i + 1, r[0], 0)
                        found.append((c + 2 + more, "R" + a, ((r, text), *out)))
        return min(found, default=(float("inf"), "", ()))

    return best(0, "", 0)


def expected(rows, ids=()):
    """rows: (conv, turn, role, text)."""
    by = defaultdict(list)
    for i in ids:
        by[i]
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn, " " if role is None else role, " " if text is None else text))
    out = []
    for conv, said in by.items():
        said.sort(key=lambda r: (r[0], r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
        seen, faults = set(), []
        for _, _, role, text in said:
            core = text.strip(" \t\n\v\f\r")
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
        turns = [r[1] for r in said if r[0]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        cost, audit, done = cheapest(tuple((r[2], r[3], f) for r, f in zip(said, faults)))
        assert LEGAL.fullmatch("".join(r[0] for r, _ in done))
        text = "\n".join(f"{r}:{t}" for r, t in done)
        out.append((conv, gaps if gaps < 1 << 63 else None, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha(text)))
    return out


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, key string, part string, kind string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", None, "x") for r in rows], SCHEMA)


def check(got, want):
    assert sorted([tuple(r) for r in got.select(COLUMNS).collect()], key=repr) == sorted(want, key=repr)


def mixed(seed, convs, turns):
    rng = random.Random(seed)
    out = []
    for conv in range(convs):
        for turn in range(rng.randint(0, turns)):
            role = rng.choice(["user", "assistant"] * 3 + ["system", "s", "tool", "", "uma", None, "Assistant"])
            text = rng.choice(["yes.", "no", "so? \n", "  ", "", None, f"number {rng.randrange(9)}!", "ü"])
            for _ in range(rng.choice([1, 1, 1, 2])):
                out.append((conv if conv else None, rng.choice([turn * rng.randint(1, 2)] * 9 + [None]), role, text))
    return out


@pytest.mark.parametrize("chunk", [1, 3, 1 << 15])
def test_all_edits(spark, chunk):
    """Chunks of one, some and all rows; ties of turns, null turns, roles that fit nowhere."""
    rows = mixed(chunk, 60, 9)
    check(conversation_repair.audits(frame(spark, rows), chunk=chunk), expected(rows))


def test_edge_rows(spark):
    far = (1 << 63) - 1
    rows = [
        (1, None, None, None),
        (2, -far, "user", "far."),
        (2, far, "assistant", "apart."),
        (3, 0, "user", "x" * 3_000_000),
        *[(4, 0, "user", "same.")] * 500,
        (4, 1, "assistant", "same."),
        (None, 0, "system", "alone."),
        (None, 1, "user", "\v\f"),
    ]
    ids = frame(spark, [(i, None, None, None) for i in (1, 9, 9, 10)])
    check(conversation_repair.audits(frame(spark, rows), ids), expected(rows, ids=(1, 9, 10)))


@pytest.mark.parametrize("chunk", [16, 1 << 15])
def test_hot_conversation(spark, chunk):
    """A conversation of most rows: it is spread over tasks, and its edits are those of one walk."""
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"turn {t % 150}{rng.choice('.. ')}") for t in range(300)]
    rows += [(2, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for t in range(6)]
    check(conversation_repair.audits(frame(spark, rows), chunk=chunk), expected(rows))


def test_checkpoints_are_few_and_exact():
    """The walk over blocks equals one with all vectors kept."""
    rng = random.Random(2)
    codes = bytes(rng.randrange(12) for _ in range(5_000))
    programme = conversation_repair.Programme()
    edits, state = programme.walk(codes, conversation_repair.END, conversation_repair.START)
    vectors = [conversation_repair.END]
    for code in reversed(codes):
        vectors.append(conversation_repair.one_back(code, vectors[-1]))
    audit = "".join(edits) + conversation_repair.last_inserts(state)
    late = sum(code % 3 == 1 and edit[-1] != "D" for code, edit in zip(codes, edits))
    assert vectors[-1][0] == 3 * audit.count("D") + 2 * (audit.count("I") + audit.count("R")) + late
    seen = []
    original = conversation_repair.Programme.start
    programme.start = lambda codes, after: seen.append(len(codes)) or original(programme, codes, after)
    programme.walk(codes, conversation_repair.END, conversation_repair.START)
    assert len(seen) <= 71 and max(seen) <= 71


def test_repaired_turns(spark):
    rows = mixed(5, 40, 7)
    got = defaultdict(list)
    for r in sorted(conversation_repair.repaired(frame(spark, rows), chunk=4).collect(), key=lambda r: r["place"]):
        assert r["place"] == len(got[r["conv_id"]])
        got[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for conv, *_, digest in expected(rows):
        assert sha("\n".join(got[conv])) == digest


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_s, turn_s = (" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{conv_s}:{turn_s}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        row = (conv, turn, "user" if fault == 4 else role, text)
        out += [] if fault == 0 else [row, row] if fault == 3 else [row]
    return out


def test_query_against_search(spark, tmp_path):
    rows = mixed(6, 80, 8) + [(1000 + i, 0, "user", "only.") for i in range(60)]
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries.QUERIES["op11_conversation_repair"](spark, str(tmp_path))
    check(out, expected(damaged(rows), ids={r[0] for r in rows}))


def test_no_rows(spark):
    empty = frame(spark, [])
    assert conversation_repair.audits(empty).collect() == []
    assert conversation_repair.repaired(empty).collect() == []
    check(conversation_repair.audits(empty, frame(spark, [(3, 1, "user", "x")])), [(3, 0, 0, 0, 0, 0, 0, "", sha(""))])
