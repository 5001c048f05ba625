import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskflow.llm import induced


def brute(data):
    sa = sorted(range(len(data)), key=lambda i: data[i:])
    lcp = [0] * len(sa)
    for k in range(1, len(sa)):
        a, b = data[sa[k - 1] :], data[sa[k] :]
        while lcp[k] < min(len(a), len(b)) and a[lcp[k]] == b[lcp[k]]:
            lcp[k] += 1
    return sa, lcp


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_small_alphabets(data):
    sa, lcp = induced.suffix_array(np.array(data, np.uint16))
    assert (sa.tolist(), lcp.tolist()) == brute(data)


@pytest.mark.parametrize("text", [b"mississippi", b"a" * 50, b"abcabcabcabc", bytes(range(256)), b"banana" * 9, b"zyx"])
def test_known_texts(text):
    data = list(text)
    sa, lcp = induced.suffix_array(np.array(data, np.uint16))
    assert (sa.tolist(), lcp.tolist()) == brute(data)


def test_runs_on_disk_change_nothing(tmp_path):
    rnd = np.random.default_rng(4)
    text = np.tile(rnd.integers(0, 5, 300), 8).astype(np.uint16)
    text[::97] = 4
    want = induced.suffix_array(text)
    for most in (7, 100):
        got = induced.suffix_array(text, str(tmp_path), most)
        assert all((a == b).all() for a, b in zip(want, got))
    assert not list(tmp_path.iterdir())
    assert (want[0].tolist(), want[1].tolist()) == brute(text.tolist())
