"""Properties of the numpy and Python kernels on generated texts."""

import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rankloom.llm import lm, texts, trigrams
from rankloom.llm.bpe import Coder

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY, CODER, PIECES = Tokenizer.from_file(PATH), Coder(open(PATH).read()), lm.Pieces(open(PATH).read())
LATIN = st.characters(max_codepoint=0x24F)
TEXTS = st.lists(st.none() | st.text(alphabet=st.sampled_from("aAbBzZ \t\n\x0b\x85é.9"), max_size=40), max_size=6)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@given(TEXTS)
@settings(max_examples=300, deadline=None)
def test_words_are_those_of_the_pattern(rows):
    hashes, row = texts.words(*texts.raw(pa.array(rows, pa.string())))
    expected = [(i, w) for i, t in enumerate(rows) for w in words(t)]
    assert row.tolist() == [i for i, _ in expected]
    assert len(set(hashes.tolist())) == len({w for _, w in expected})
    names = dict(zip(hashes.tolist(), [w for _, w in expected], strict=True))
    assert all(names[h] == w for h, (_, w) in zip(hashes.tolist(), expected, strict=True))


@given(TEXTS, st.integers(1, 4))
@settings(max_examples=200, deadline=None)
def test_shingle_sets_have_the_right_sizes(rows, k):
    _, offsets = texts.shingle_sets(pa.array(rows, pa.string()), k)
    expected = [len({tuple(w[i : i + k]) for i in range(len(w) - k + 1)}) if len(w) >= k else int(bool(w)) for w in map(words, rows)]
    assert np.diff(offsets).tolist() == expected


@given(st.text(alphabet=LATIN, max_size=60))
@settings(max_examples=400, deadline=None)
def test_tokens_are_those_of_the_library(text):
    expected = LIBRARY.encode(text, add_special_tokens=False).ids
    assert CODER.encode(text).tolist() == expected
    assert CODER.decode(expected) == LIBRARY.decode(expected, skip_special_tokens=False)


@given(st.lists(st.text(alphabet=st.sampled_from("thinoraeé'9.Q"), min_size=1, max_size=25), min_size=1, max_size=8))
@settings(max_examples=200, deadline=None)
def test_pieces_spell_the_words(found):
    data, offsets = texts.raw(pa.array([" ".join(found)]))
    starts, ends = texts.word_spans(data, offsets)
    ids, lengths = PIECES.cut(texts.Hashes(data), starts, ends)
    spelled = "".join(CODER.texts[i] for i in ids)
    expected = "".join("".join(CODER.characters[b] for b in w.encode()) + "</w>" for w in words(" ".join(found)))
    assert spelled == expected and lengths.sum() == len(ids)


@given(st.recursive(st.sampled_from(["abc", "[ab]c", "x_?y", "[0-9]", "k"]), lambda p: st.tuples(p, p).map("".join) | st.tuples(p, p).map(lambda x: f"({x[0]}|{x[1]})") | p.map(lambda x: f"({x})+") | p.map(lambda x: f"({x})?") | p.map(lambda x: f"(?:{x}){{2}}"), max_leaves=8), st.data())
@settings(max_examples=300, deadline=None)
def test_matches_satisfy_their_trigram_query(pattern, data):
    text = data.draw(st.from_regex(re.compile(pattern, re.ASCII), fullmatch=True)).encode().lower()

    def holds(query):
        if query is None:
            return True
        return query[1] in text if query[0] == "has" else (all if query[0] == "all" else any)(map(holds, query[1]))

    assert holds(trigrams.trigram_query(pattern))
