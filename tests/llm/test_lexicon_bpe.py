import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tarnwater.llm import lexicon_bpe as B

from .conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def vocabulary():
    return B.Vocabulary(open(PATH, encoding="utf-8").read())


def encoded(vocabulary, text):
    ids = []
    for piece in vocabulary.pieces(text):
        ids += [vocabulary.special[piece]] if piece in vocabulary.special else [i for w in B.split_words(piece) for i in vocabulary.merged(w.encode())]
    return ids


TEXTS = ["", " ", "It's I'M we'LL they're don''t 's 'tis 'veal", "a1b22c333 x_y-z!!?? (ok)...", "<|startoftext|>Hello<|endoftext|> <|ENDOFTEXT|>'s<|endoftext|>", "ΑΣ ΣΑΣ. Σ", "é Å ẛ̣ Å", "漢字かな交じり文😀👩‍👩‍👧 ½ ² ٣ ①", "a b c​d e\x1cf\x1fg\x85h\x0bi", "İstanbul ẞ ﬁ Ǆ ꙋ", "x" * 3000, "ab" * 2500 + "!" * 999, "\x00\x01 \x7f", "a﻿b�c"]


@pytest.mark.parametrize("text", TEXTS)
def test_texts_are_encoded_as_the_library_does(library, vocabulary, text):
    assert encoded(vocabulary, text) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=500, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8", max_codepoint=0x2FF), st.sampled_from("'sStTrReEvVmMlLdD <|>aeiou\n\tΣ"), st.characters(codec="utf-8")), max_size=60))
def test_any_text_is_encoded_as_the_library_does(library, vocabulary, text):
    assert encoded(vocabulary, text) == library.encode(text, add_special_tokens=False).ids


def test_every_code_point_is_split_as_the_library_does(library, vocabulary):
    odd = []
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 64):
        text = " ".join(f"a{chr(c)}1{chr(c)}!" for c in points[at : at + 64])
        if encoded(vocabulary, text) != library.encode(text, add_special_tokens=False).ids:
            odd += [c for c in points[at : at + 64] if encoded(vocabulary, t := f"a{chr(c)}1{chr(c)}!") != library.encode(t, add_special_tokens=False).ids]
    assert odd == []


@settings(max_examples=200, deadline=None)
@given(st.text("abstion' .!éß", min_size=1, max_size=200))
def test_both_ways_of_merging_agree(vocabulary, word):
    ids = lambda: [*(vocabulary.inner[b] for b in word.encode()[:-1]), vocabulary.last[word.encode()[-1]]]
    assert vocabulary._few(ids()) == vocabulary._many(ids())


words = st.dictionaries(st.binary(max_size=6), st.lists(st.integers(0, 3), max_size=4).map(tuple), max_size=40)


def mapped(tmp_path_factory, content):
    path = tmp_path_factory.mktemp("lexicon") / "words.bin"
    path.write_bytes(content)
    return B.Lexicon(str(path))


@settings(max_examples=200, deadline=None)
@given(words, st.lists(st.binary(max_size=6), max_size=20))
def test_transducer_gives_each_word_its_ids(tmp_path_factory, entries, others):
    lexicon = mapped(tmp_path_factory, B.packed(B.minimal_transducer(sorted(entries.items()))))
    for w in [*entries, *others]:
        assert lexicon.get(w) == (list(entries[w]) if w in entries else None)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text("ab", max_size=5).map(str.encode), st.lists(st.integers(0, 1), max_size=3).map(tuple), min_size=1, max_size=30))
def test_transducer_is_minimal(entries):
    """As many states as there are different futures: what is left of the outputs once what all longer words share is written."""

    def shared(ids):
        n = min(map(len, ids))
        while any(i[:n] != ids[0][:n] for i in ids):
            n -= 1
        return n

    futures = set()
    for p in {w[:i] for w in entries for i in range(len(w) + 1)}:
        after = {w[len(p) :]: ids for w, ids in entries.items() if w.startswith(p)}
        n = shared(list(after.values())) if p else 0
        futures.add((p == b"" and n == 0 and "start" or "", tuple(sorted((w, ids[n:]) for w, ids in after.items()))))
    states = B.states_of(B.minimal_transducer(sorted(entries.items())))
    assert len(states) <= len(futures) and len(states) >= len({f[1] for f in futures if f[0] == ""})


def test_words_must_rise():
    with pytest.raises(ValueError):
        B.minimal_transducer([(b"b", (1,)), (b"a", (2,))])


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_documents_against_the_library(spark, table, library):
    r = random.Random(2)
    some = ["the", "The", "running", "encyclopædia", "don't", "x1", "--", "naïve", "<|endoftext|>", "zzqxv", "straße", "漢字"]
    rows = [row[:2] for row in ODD] + [(i, " ".join(r.choices(some, k=50))) for i in range(20, 60)] + [(99, t) for t in TEXTS]
    want = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    for most in (B.LEXICON_WORDS, 5, 0):
        got = B.encode_decode(table(rows), PATH, most=most).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    kept = B.encode_decode(table(rows[-3:]), PATH, keep=True).collect()
    assert all(sha(" ".join(map(str, row.ids))) == row.ids_sha256 and sha(row.decoded) == row.decoded_sha256 for row in kept)


def test_no_documents(spark, table):
    assert B.encode_decode(table([]), PATH).count() == 0


def test_frequent_words_are_bounded(spark, table):
    rows = [(i, "one two two three three three three " + "abcdefgh"[i] * 3) for i in range(8)]
    assert sorted(B.frequent_words(table(rows), 6)) == ["one", "three", "two"] and len(B.frequent_words(table(rows), 2)) == 2
