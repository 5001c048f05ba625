import base64

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from riskflow.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.load_ranks(PATH)
ORACLE = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={}
)
ENCODER = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
TABLE = bpe._table(PATH)
HARD = [
    "", " ", "  a", "a  b", "a \n b", "a  b", "it's we'll 'x", "\x1c a \x1d", "x" * 3000,
    "é" * 500, "日本語 text 🙂🙂", " lead and trail ", "\t\ttabs\r\n\r\nlines", "1234567 89", "$$$ %%%",
    "<|endoftext|> is text", "a\x85\x85b", "ab" * 700, "​‍",
]


@pytest.mark.parametrize("text", HARD)
def test_ids_and_round_trip(text):
    ids = list(ENCODER.encode(text))
    assert ids == ORACLE.encode_ordinary(text)
    for block in (1, 2, 4096):
        parts = (np.array(ids[i : i + block]) for i in range(0, len(ids), block))
        assert "".join(bpe.decode_stream(parts, TABLE)) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcinthe rsS'1 9\n\té漢🙂.,$%"), max_size=60))
def test_ids_of_random_texts(text):
    assert list(ENCODER.encode(text)) == ORACLE.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=12), st.integers(1, 4))
def test_utf8_machine_equals_whole_decoding(data, step):
    machine = bpe.Utf8Machine()
    got = "".join(machine.feed(data[i : i + step]) for i in range(0, len(data), step))
    assert got + machine.finish() == data.decode("utf-8", "replace")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abeinthrsé"), max_size=60), st.integers(1, 9))
def test_early_output_changes_nothing(text, wait):
    machine = bpe.Transducer(RANKS, wait=wait)
    expected = ORACLE.encode_ordinary(text)
    assert machine.encode(text.encode()) == machine.encode(text.encode()) == expected


def test_tables_stay_bounded():
    machine = bpe.Transducer(RANKS, max_states=50)
    for word in (b"tokenization", b"indivisible", b"unbelievable") * 3:
        assert machine.encode(word) == ORACLE.encode_ordinary(word.decode())


def test_frame_keeps_rows_and_clashing_names(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "hello world", "z"), (3, "hello world", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    ids = bpe.encode(df, PATH, public_tokenizers.PATTERN)
    got = ids.collect()
    assert [list(r.ids) for r in got] == [[], [], [31373, 995], [31373, 995]]
    assert [r.text for r in bpe.decode(ids, PATH).collect()] == ["", "", "hello world", "hello world"]
    assert [r.n_tokens for r in got] == ["x", "y", "z", "z"]
    assert bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_many_words_are_encoded_once(spark, monkeypatch, tmp_path):
    """A task of the query meets hundreds of thousands of words again and again."""
    asked, encode = {}, bpe.encode
    monkeypatch.setattr(bpe, "encode", lambda *args, **more: asked.update(more) or encode(*args, **more))
    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.n_tokens for r in queries.op1_bpe(spark, str(tmp_path)).collect()] == [2]
    encoder = bpe.Encoder({bytes((i,)): i for i in range(256)}, r" ?\w+", asked.get("remembered", 120_000))
    letters = "abcdefghijklmnopqrstuvwxyz"
    text = " ".join(a + b + c + d for a in letters[:16] for b in letters for c in letters for d in letters)
    first = encoder.encode(text)
    monkeypatch.setattr(encoder.machine, "encode", None)
    assert encoder.encode(text).tolist() == first.tolist() == list(text.encode())
