"""Properties that hold for any input."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.llm import chat, near, pages, secrets, toxicity



def pieces(*parts, most=40):
    """Texts put together from ``parts``."""
    return st.lists(st.sampled_from(parts), max_size=most).map("".join)


TEXT = pieces(*"ab#\\/<> :&;tur\n!É", "###", "</turn>", "AKIA", "0f")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:b", "", "\\"]), TEXT), max_size=6))
def test_any_conversation_comes_back(turns):
    formatted, spans = chat.format_turns(turns)
    assert chat.parse_turns(formatted) == turns
    assert [chat._UNESCAPE.sub(r"\1", formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


@settings(max_examples=200, deadline=None)
@given(pieces(*"ab <>/\"'=&;-!p", "<p>", "</p>", "<div class=ad>", "</div>", "<!--", "-->", "<script>", "</script>", "&amp;", most=60))
def test_any_page_gives_clean_text(page):
    text = pages.extract(page)
    assert text == " ".join(text.split())


@settings(max_examples=200, deadline=None)
@given(pieces(*"aF0 :=\"É_-.", "password", "AKIA", "deadbeefdeadbeef", "Xq3Z9kLm2Pw8"))
def test_base_secrets_equal_plain_patterns(text):
    ratio = secrets.default_ratio()
    data = text.encode()
    found = [(len(data[:s].decode()), len(data[:e].decode()), k) for s, e, k in secrets.find_secrets(data, ratio) if k != "markov"]
    want = [(*m.span(), "assign") for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12 and m[1].isascii()]
    want += [(*m.span(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18] + [(*m.span(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    assert sorted(found) == sorted(want)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "C", "É", "x-y"]), max_size=12), st.sampled_from([" ", "\n", " \t "]))
def test_shingle_sets_have_the_right_size(words, space):
    text = space.join(words)
    low = [w.replace("C", "c") for w in words]
    want = {tuple(low[i:i + 3]) for i in range(len(low) - 2)} if len(low) >= 3 else {tuple(low)} if low else set()
    assert len(near.Shingler(3)(text)) == len(want)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80))
def test_folding_leaves_words_between_single_spaces(text):
    folded = toxicity.fold(text)
    assert folded == " " or re.fullmatch(r"( [^\s]+)+ ", folded)
    assert toxicity.fold(folded.strip()) .count(" ") <= folded.count(" ") + 1


def test_minhash_is_the_same_everywhere():
    values = near.minhash(near.Shingler(3)("one two three four five"), 256)
    assert values.dtype == np.uint64 and hashlib.sha256(values.tobytes()).hexdigest() == hashlib.sha256(near.minhash(near.Shingler(3, keep=1)("One two three four five"), 256).tobytes()).hexdigest()
