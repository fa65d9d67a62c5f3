"""Every place of a notice is reported."""

import time

from lodestar.llm import licenses


def test_a_worse_notice_before_a_better_one():
    scanner = licenses.Scanner()
    for text, want in [
        ("all rights reservet x all rights reserved", [(0, 19, 1), (22, 41, 0)]),
        ("all rights reserved x all rights reservet", [(0, 19, 0), (22, 41, 1)]),
        ("all rights reservet all rights reserved all rigts reserved all rights reserved", [(0, 19, 1), (20, 39, 0), (40, 58, 1), (59, 78, 0)]),
    ]:
        assert [(s.start, s.end, s.edits) for s in scanner.find(text) if s.notice == "all rights reserved"] == want


def test_many_notices_in_a_long_text():
    """Places of words are taken once a text, so the time grows with its length."""
    text = "cc by " * 100_000 + "end"
    began = time.monotonic()
    found = licenses.base_places(text)
    assert time.monotonic() - began < 20
    assert found == [(2 * i, "cc-by") for i in range(100_000)]
