"""Blocks of words are worked on without searches for cycles, which are taken up again afterwards."""

from __future__ import annotations

import gc

import pytest

from roadloom.llm import bpe_words


@pytest.mark.parametrize("on", [True, False])
def test_no_search_for_cycles_within_a_block(on):
    was = gc.isenabled()
    (gc.enable if on else gc.disable)()
    try:
        assert bpe_words._uncollected(lambda *x: (gc.isenabled(), x), 1, 2) == (False, (1, 2))
        assert gc.isenabled() == on
        with pytest.raises(ZeroDivisionError):
            bpe_words._uncollected(lambda: 1 // 0)
        assert gc.isenabled() == on
    finally:
        (gc.enable if was else gc.disable)()
