import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gapline.llm.words import Hasher, letters, slices

HASHER = Hasher()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tabé漢\x0b", max_size=30) | st.none(), max_size=8))
def test_split_and_hash_agree_with_regex(texts):
    words = HASHER.split(pa.array(texts, pa.string()))
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    raw = words.raw.tobytes()
    got = [[raw[words.start[i] : words.stop[i]].decode() for i in range(a, b)] for a, b in zip(words.first[:-1], words.first[1:])]
    assert got == want
    flat, hashes = [w for t in want for w in t], words.hashes().tolist()
    known = {}
    for word, h in zip(flat, hashes):
        assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known)
    pairs = {}
    for i, h in enumerate(HASHER.windows(words.hashes(), 2).tolist()):
        assert pairs.setdefault(tuple(flat[i : i + 2]), h) == h
    starts = words.window_starts(2).tolist()
    assert starts == [i for t, a in zip(want, words.first) for i in range(a, a + max(0, len(t) - 1))]


def test_hashes_do_not_depend_on_slices():
    text = " ".join(f"w{i % 977}" for i in range(400_000)) + " " + "z" * 700_000 + " w5"
    words = HASHER.split(pa.array([text]))
    hashes = words.hashes()
    assert len(np.unique(hashes)) == 978
    assert (hashes[: 400_000 - 977] == hashes[977:400_000]).all() and hashes[-1] == hashes[5]
    windows = HASHER.windows(hashes, 7)
    assert (windows[: 400_000 - 977 - 6] == windows[977 : 400_000 - 6]).all()


def test_letters_lower_case_and_slices():
    lower = Hasher(letters(), lower=True)
    words = lower.split(pa.array(["Ab,ab  AB!", "x"]))
    h = words.hashes()
    assert h[0] == h[1] == h[2] != h[3]
    batch = pa.record_batch([pa.array(["a" * 10, None, "b" * 30, "", "c"])], ["text"])
    parts = list(slices(batch, "text", 12))
    assert sum(p.num_rows for p in parts) == 5 and all(p.num_rows for p in parts)
