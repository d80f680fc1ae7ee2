"""Pieces and sentences at their edges."""

from __future__ import annotations

import random
import time

import pytest

from lakelens.llm.sentences import sentences_of
from lakelens.llm.splitting import _splitter, cut


@pytest.mark.parametrize("letters", ["ab́̀ \n,.", "á́́́", "x", " \n"])
def test_pieces_cover_overlap_and_stay_small(letters):
    rng = random.Random(letters)
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 300)))
        size, overlap = rng.randint(1, 40), rng.randint(0, 45)
        got = cut(text, size, overlap)
        assert got[0][0] == 0 and got[-1][1] == len(text)
        most = max(0, min(overlap, (size - 1) // 2))
        for (a, b), (x, y) in zip(got, got[1:], strict=False):
            assert 0 < b - a <= size and a < x <= b < y and most - most // 4 <= b - x <= most


def test_lines_behind_marks_are_still_cut_at_line_ends():
    text = "e" + "́" * 300 + "\n" + "".join(f"line number {k}\n" for k in range(60))
    ends = [b for _, b in cut(text, 100, 10)]
    assert all(text[b - 1] == "\n" for b in ends if b > 320)


def test_lines_of_pieces_are_counted_once():
    text = "ab\n" * 100_000
    start = time.process_time()
    rows = list(_splitter(True)()("symbol", 1, text, 7, 30, 5))
    assert time.process_time() - start < 5
    assert all(r[5] == 7 + text.count("\n", 0, r[3]) and r[6] == 7 + text.count("\n", 0, r[4] - 1) for r in rows[:50] + rows[-3:])


@pytest.mark.parametrize("text,parts", [
    ("یہ پہلا ہے۔ یہ دوسرا ہے۔", 2), ("នេះជាមួយ។ នេះជាពីរ។", 2), ("ይህ አንድ ነው። ይህ ሁለት ነው።", 2), ("Սա առաջինն է։ Սա երկրորդն է։", 2), ("ဒါကတစ်။ ဒါကနှစ်။", 2), ("これは一｡これは二｡", 2), ("これは３．１４です．次です．", 2),
])
def test_terminators_of_many_scripts(text, parts):
    got = sentences_of(text)
    assert len(got) == parts and "".join(text[a:b] for a, b in got).replace(" ", "") == text.replace(" ", "")
