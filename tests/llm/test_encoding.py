"""Token counts and packing against the library on whole texts."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from acreline.llm import encoding, packing
from acreline.llm.token_counts import count_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def words():
    return encoding.WordEncoder(encoding.read_tokenizer(PATH))


ODD = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(list(" \t\n'!.,²Àéß́ẞİΣσ<|>"))))


@settings(max_examples=300, deadline=None)
@given(ODD | st.builds(lambda a, b: a + "<|endoftext|>" + b, ODD, ODD))
def test_words_give_the_librarys_ids(library, words, text):
    [ids] = words.texts([text.encode()])
    assert np.frombuffer(b"".join(ids), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a <|ENDOFTEXT|> b", "<|EndOfText|>", "X<|endoftext|>Y <|StartOfText|>",
                                  "<|startoftext|>Go<|STARTOFTEXT|>", "é<|endofText|>."])
def test_added_tokens_in_other_case_are_ordinary_words(library, words, text):
    want = library.encode(text, add_special_tokens=False).ids
    for t, n in ((text, 1), (text + "\n" + "Ab " * (encoding.PORTION_BYTES // 3 + 1), None)):
        [ids] = words.texts([t.encode()])
        got = np.frombuffer(b"".join(ids), "<u4").tolist()
        assert got[:len(want)] == want and (n is None or len(got) == len(want))


def test_long_texts_are_cut_at_white_space():
    text = b"ab cd\n" * 1000 + b"x" * 5000
    parts = list(encoding.portions(text, 100))
    assert b"".join(parts) == text and len(parts) > 50
    assert all(p[:1].isspace() for p in parts[1:])


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        encoding.check_splittable(encoding.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json")))


def expected(library, rows):
    return [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows]


def test_counts_equal_the_librarys(documents, library):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    want = {i: n for (i, _), n in zip(rows, expected(library, rows))}
    got = {r["doc_id"]: r for r in count_tokens(documents, PATH).collect()}
    assert {i: r["n_tokens"] for i, r in got.items()} == want
    assert all(r["over_limit"] == (want[i] > 2048) for i, r in got.items())
    assert all(got[i]["n_bytes"] == len(t.encode()) for i, t in rows)


def test_counts_of_awkward_rows(awkward, nothing, library):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = count_tokens(awkward, PATH)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted([(r["doc_id"], r["n_tokens"]) for r in got.collect()], key=key) == sorted(
        [(i, n) for (i, _), n in zip(rows, expected(library, rows))], key=key)
    assert count_tokens(nothing, PATH).count() == 0


def check_packing(docs, library, window):
    pieces = packing.pack(docs, PATH, window=window, with_ids=True).collect()
    ids = [library.encode(r["text"] or "", add_special_tokens=False).ids + [2] for r in docs.collect()]
    assert sum(p["length"] for p in pieces) == sum(map(len, ids))
    by_sequence = {}
    for p in pieces:
        assert zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"]
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
    whole = sorted(tuple(x) for x in ids)
    cut = {}
    for p in pieces:
        cut.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], tuple(p["ids"])))
    if len({r["doc_id"] for r in docs.collect()}) == len(ids):
        assert sorted(sum((x[1] for x in sorted(v)), ()) for v in cut.values()) == whole
    return pieces, by_sequence


def test_every_id_is_packed_once_with_little_padding(documents, library):
    pieces, by_sequence = check_packing(documents, library, 4096)
    assert sum(p["length"] for p in pieces) > 0.97 * 4096 * len(by_sequence)
    check_packing(documents, library, 64)


def test_packing_of_awkward_rows(awkward, nothing, library):
    check_packing(awkward, library, 4096)
    assert packing.pack(nothing, PATH).count() == 0


def test_sequences_join_pieces_in_order(documents):
    packed = packing.pack(documents, PATH, with_ids=True)
    made = packing.sequences(packed).collect()
    assert all(len(r["input_ids"]) <= 4096 and r["starts"][0] == 0 for r in made)
    assert sum(len(r["input_ids"]) for r in made) == sum(p["length"] for p in packed.collect())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=400))
def test_the_plan_places_every_piece(lengths):
    counts = np.bincount(lengths, minlength=65)
    left = counts.copy()
    for pattern, n in packing.plan(counts, 64):
        assert n > 0 and sum(length * uses for length, uses in pattern) <= 64
        for length, uses in pattern:
            left[length] -= n * uses
    assert not left.any()


def test_least_squares_fits_an_exact_histogram():
    counts = np.zeros(65, dtype=int)
    counts[[40, 24]], counts[[10, 22, 32]] = 500, 300
    combos = packing.combinations(counts, 64)
    x = packing.nnls_repeats(combos, counts)
    made = sum(np.bincount(combos[:, k], weights=x, minlength=65) for k in range(3))
    assert np.abs(made[1:] - counts[1:]).max() < 5


def test_a_tasks_encoder_goes_with_it(library):
    text = " ".join(f"word{i} and{i}" for i in range(3000))
    with encoding.task_encoder(encoding.read_tokenizer(PATH), 100) as own:
        for _ in range(2):
            [ids] = own.texts([text.encode()])
            assert np.frombuffer(b"".join(ids), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
            assert len(own._memo) <= 100
        own.ids_of([b"left"])
    assert not own._memo and own._tokenizer is None
