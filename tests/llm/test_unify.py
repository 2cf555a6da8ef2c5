import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvelo.llm import queries as Q
from corvelo.llm.unify import find_disguised, is_disguised, unified, unify_text

CASES = ["Sparse Ｔｕｎｉｎｇ", "a b", "Traﬃc", "naıve é", "zero​width", "soft­hyphen", "Рrovable", "durante ο inverno", "Tecһnolоɡy", "long‐context", "ϲom"]
PLAIN = ["Naïve λ-Calculus", "β-Divergence", "Университет Корхонвар", "1ª vez", "double  space ", "𝒪(n)", "x² ½", "α-Divergence", "", "plain"]


@pytest.mark.parametrize("text", [c for c in CASES if "ı" not in c])
def test_cases(text):
    assert is_disguised(text)


@pytest.mark.parametrize("text", PLAIN)
def test_plain(text):
    assert not is_disguised(text)


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_form_is_stable(text):
    once = unify_text(text)
    assert unify_text(once) == once


def test_letters_that_folding_brings_up():
    assert unify_text("A\u0345") == unify_text(unify_text("A\u0345")) == "ai"


def test_frames(spark):
    d = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "a​b", 7), (3, "a​b", 7), (4, "x" * 100_000 + " y", 7)], "seq int, value string, unified int")
    assert sorted(r.seq for r in find_disguised(d).collect()) == [3, 3, 4]
    out = {r.seq: r.unified for r in unified(d).collect()}
    assert out[1] is None and out[2] == "" and out[3] == "ab" and len(out[4]) == 100_002
    assert find_disguised(d.limit(0)).count() == 0


def test_query(spark, folder):
    assert Q.p1_found(spark, folder).columns == ["field", "seq", "pos"]
