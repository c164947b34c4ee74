import pickle

from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslens.llm.compact import Packed, Tiered, tiered


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text(st.characters(exclude_categories=["Cs"])), st.integers(0, 1 << 60)), st.text())
def test_packed_words_are_a_dict(words, other):
    packed = pickle.loads(pickle.dumps(Packed(list(words), list(words.values()))))
    assert dict(packed.items()) == words and len(packed) == len(words) and packed.get(other, -1) == words.get(other, -1) and (other in packed) == (other in words)


def test_words_of_one_checksum_are_told_apart():
    packed = Packed(["plumless", "x"], [3, 4])
    assert packed["plumless"] == 3 and packed.get("buckeroo") is None and Packed(["plumless", "buckeroo"], [3, 5])["buckeroo"] == 5


def test_tiers():
    both = tiered({"a": 9}, ["b", "ü"], [2, 1])
    assert isinstance(both, Tiered) and list(both)[0] == "a" and dict(both.items()) == {"a": 9, "b": 2, "ü": 1} and both.get("c", 0) == 0 and len(both) == 3
    first = {"a": 9}
    assert tiered(first, [], []) is first
