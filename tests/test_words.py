import numpy as np
import pytest

from sumloom.functions import words as V


def test_counts():
    assert [len(V.of_weight(n)) for n in range(1, 7)] == [1, 2, 4, 8, 16, 32]
    assert len(V.of_weight(4, 2)) == 82
    assert len(set(V.of_weight(4, 2))) == 82


def test_simple_words():
    assert V.word("[12]") == V.word("[21]")
    assert V.word("[1(-1)2]") == V.word("[2]")
    assert V.word("[(12)(-1)]").brackets[0].powers == ((0, -1), (11, 1))
    assert str(V.word("[112][(-2)]")) == "[112][(-2)]"
    assert len(V.word("[1]") * V.word("[2][3]")) == 3
    with pytest.raises(ValueError):
        V.word("[1")
    with pytest.raises(ValueError):
        V.word("[0]")


def test_general_words():
    w = V.word("[ABS(1)DIM(2)][ABS(1)]")
    assert not w.simple and len(w) == 2 and w.dims == {0, 1}
    with pytest.raises(ValueError):
        V.word("[NOPE(1)]")
    name = "RELU" if "RELU" not in V._LETTERS else None
    if name:
        from pyspark.sql import functions as F

        V.letter("RELU", lambda c: F.greatest(c, F.lit(0.0)), lambda x: np.maximum(x, 0))
    with pytest.raises(ValueError):
        V.letter("ABS", abs, abs)


def test_weights_are_single_precision():
    assert V.word("[1][2]", [0.1, 0.2]).alpha == (float(np.float32(0.1)), float(np.float32(0.2)))
    with pytest.raises(ValueError):
        V.word("[1][2]", [0.1])


def test_rewriting():
    assert V.replace_letters(V.word("[11][2]"), ["ABS"]) == V.word("[ABS(1)DIM(1)][DIM(2)]")
    with pytest.raises(ValueError):
        V.replace_letters(V.word("[(-1)]"), [])
    assert V.alternate_sign([V.word("[1][2][1]")]) == [V.word("[(-1)][2][(-1)]"), V.word("[1][(-2)][1]")]


def test_trie_order():
    words = [V.word(w) for w in ("[11][1][22]", "[11][2]", "[1]")]
    trie = V.Trie.of(words, True)
    assert trie.labels == ("[11]", "[11][1]", "[11][1][22]", "[11][2]", "[1]")
    assert V.Trie.of(words, False).labels == tuple(map(str, words))
    assert len(trie.nodes) == 5
