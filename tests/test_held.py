"""Scores of one cue after the other over all notes are those of joins, and no product of both is made."""

import os

import numpy as np
import pytest

from quillmesh.operators import activation, held, lexical
from quillmesh.plans.catalog import QUERIES

SF = "/root/testdata/sf0.01"
NAMES = ["activate", "complete_ranking", "structural_fusion", "recall_topk", "recall_why", "cover_select", "context_pack", "compact_pack"]


def _rows(spark, name):
    df = QUERIES[name](spark, SF)
    return sorted(str(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_no_scores_of_all_pairs_are_made(spark, name, monkeypatch):
    def product(*_, **__):
        raise AssertionError("scores of all pairs")

    with monkeypatch.context() as m:
        m.setattr(lexical, "overlap_hits", product)
        m.setattr(activation, "seeds", product)
        m.setattr(lexical, "symbol_scores", product)
        got = _rows(spark, name)
    assert got
    if name in ("activate", "cover_select", "complete_ranking", "structural_fusion"):  # what is too much to be sent is joined
        monkeypatch.setattr(held, "HELD", 0)
        assert _rows(spark, name) == got


def test_lists_add_up():
    lists = held.Lists.of(np.array([2, 0, 2]), np.array([1, 3, 0]), 3, np.array([0.5, 1.0, 2.0]))
    assert lists.sums(np.array([2, 0]), 4).tolist() == [2.0, 0.5, 0.0, 1.0]
    assert lists.sums(np.array([1]), 4).tolist() == [0.0] * 4 and lists.sums(np.array([], dtype=np.int64), 2).tolist() == [0.0] * 2
