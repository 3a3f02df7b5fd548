import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestack.llm import splitting as S

TEXT = st.lists(st.sampled_from(["word ", "two words ", "end. ", "ask? ", "line\n", "para\n\n", "x", "-", "  ", "끝. ", "라.", "​", "_"]), max_size=120).map("".join)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(4, 20), st.integers(0, 3))
def test_pieces_are_whole_within_the_limit_and_overlap(text, limit, overlap):
    pieces, _ = S.split_text(text, limit, overlap)
    if len(S.token_spans(text)) <= limit:
        assert pieces == []
        return
    assert "".join(text[f:e] for _, f, e, _ in pieces) == text
    for n, (start, fresh, end, tokens) in enumerate(pieces):
        assert tokens == len(S.token_spans(text[start:end])) <= limit
        assert len(S.token_spans(text[start:fresh])) == (0 if n == 0 else min(overlap, len(S.token_spans(text[:fresh]))))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["paragraph", "line", "sentence", "space", "inside"]), min_size=7, max_size=13), st.integers(4, 6), st.integers(0, 2))
def test_cuts_are_the_best_of_all(kinds, limit, overlap):
    kinds = ["paragraph", *kinds[1:]]
    total, fresh = len(kinds), limit - overlap
    if total <= limit:
        return
    target = total / max(1, -(-(total - overlap) // fresh))

    def cost(cuts):
        ends = [*cuts[1:], total]
        sizes = [e - c for c, e in zip(cuts, ends, strict=True)]
        if sizes[0] > limit or any(s > fresh for s in sizes[1:]):
            return np.inf
        return sum(S.COST[kinds[c]] for c in cuts[1:]) + sum((s / target - 1) ** 2 for s in sizes)

    best = min(cost((0, *c)) for r in range(1, total) for c in itertools.combinations(range(1, total), r))
    chosen, _ = S.plan_cuts(kinds, limit, overlap)
    allowed = cost(tuple(chosen))
    natural = lambda cuts: sum(kinds[c] in ("space", "inside") for c in cuts[1:])
    fewest = min((natural((0, *c)) for r in range(1, total) for c in itertools.combinations(range(1, total), r) if cost((0, *c)) < np.inf), default=0)
    assert allowed < np.inf and natural(chosen) == fewest and allowed <= best + 1e-9


def test_only_the_first_piece_may_take_the_whole_limit():
    kinds = ["paragraph", "paragraph", "space", "paragraph", "paragraph", "space", "paragraph"]
    cuts = S.plan_cuts(kinds, 4, 2)[0]
    assert cuts[1] <= 4 and all(b - a <= 2 for a, b in zip(cuts[1:], [*cuts[2:], 7], strict=True))


def test_two_cuts_at_spaces_never_beat_one_inside():
    kinds = ["paragraph", "space", "inside", "inside", "inside", "space", "paragraph", "paragraph"]
    assert sum(kinds[c] in ("space", "inside") for c in S.plan_cuts(kinds, 4, 0)[0]) == 1


def test_forced_only_where_no_boundary_is_near():
    assert S.split_text("w " * 800)[1] and not S.split_text("w " * 768)[0]
    pieces, forced = S.split_text(("w " * 300 + "end. ") * 9)
    assert not forced and len(pieces) == 5
    assert not S.split_text("\n".join(["w " * 768] * 3))[1]


def test_very_long_text_is_quick():
    pieces, forced = S.split_text("word " * 300_000)
    assert forced and len(pieces) == -(-(300_000 - 64) // 704)


def test_records(spark):
    rows = [("item", "a", "w. " * 500), ("item", "a", "w. " * 500), ("chunk", "a", "w " * 900), ("chunk", "n", None), ("chunk", "e", ""), ("chunk", "s", "short " * 200)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "record string, record_id string, text string, piece string")
    out = S.split_records(df).collect()
    assert {(r["record"], r["record_id"], r["cut"]) for r in out} == {("item", "a", "natural"), ("chunk", "a", "forced")}
    assert len(out) == 4 and S.split_records(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        S.split_records(df, 10, 10)
