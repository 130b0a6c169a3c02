import random
import subprocess
import sys
from pathlib import Path

import pytest

from folio.llm.common import crc_bucket, lower_ascii, words_of
from folio.llm.repetition import drop_repetitive, group_stats, judge_repetition

ROOT = Path(__file__).resolve().parents[2]


def brute(ws, least):
    n = len(ws)

    def cover(k):
        seen = {}
        for i in range(n - k + 1):
            seen.setdefault(tuple(ws[i : i + k]), []).append(i)
        return {p for v in seen.values() if len(v) > 1 for i in v for p in range(i, i + k)}

    longest = max((k for k in range(least, n) if cover(k)), default=0)
    return len(cover(3)), len(cover(least)), longest


def maximal(ws, least):
    """Repeats that can't be made longer on either side at all their places."""
    n, out = len(ws), 0
    for k in range(least, n):
        places = {}
        for i in range(n - k + 1):
            places.setdefault(tuple(ws[i : i + k]), []).append(i)
        for v in places.values():
            left = {ws[i - 1] if i else ("start",) for i in v}
            right = {ws[i + k] if i + k < n else ("end",) for i in v}
            out += len(v) > 1 and len(left) > 1 and len(right) > 1
    return out


@pytest.mark.parametrize("seed", range(12))
def test_against_brute_force(seed):
    rng = random.Random(seed)
    texts = [[rng.choice("abc"[: 1 + seed % 3]) for _ in range(rng.randint(0, 40))] for _ in range(8)]
    for ws, (three, n_max, cov, longest) in zip(texts, group_stats(texts, 4)):
        assert (three, cov, longest) == brute(ws, 4)
        assert n_max == maximal(ws, 4)


def test_words_are_cut_at_six_blanks_only():
    assert words_of("a\x1cb\xa0c\u2003d e\vf") == ["a\x1cb\xa0c\u2003d", "e", "f"]
    assert words_of(None) == words_of(" \n") == []
    assert lower_ascii("ÀB") == "Àb" and crc_bucket(7, 5) == crc_bucket(7, 5)


def test_edges(edge_docs, no_docs):
    got = judge_repetition(edge_docs).collect()
    assert len(got) == 9 and not any(r.kept for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1].n_words == by[2].n_words == by[3].n_words == 0
    assert by[5].n_repeat_words == by[5].n_words == 30_000 and by[5].longest_repeat == 29_999
    assert by[7].n_dup_lines == 3
    assert judge_repetition(no_docs).count() == drop_repetitive(no_docs).count() == 0
    assert drop_repetitive(edge_docs).columns == edge_docs.columns


def test_clean_text_stays(spark):
    rng = random.Random(1)
    clean = " ".join("w%d" % rng.randrange(5000) for _ in range(400))
    passage = " ".join("p%d" % i for i in range(60))
    spam = clean + " " + " ".join([passage] * 9)
    df = spark.createDataFrame([(1, clean), (2, spam)], "doc_id long, text string")
    assert [r.doc_id for r in drop_repetitive(df).collect()] == [1]


@pytest.mark.parametrize("seed", range(4))
def test_long_repeats_against_brute_force(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(4):
        part = [rng.choice("ab") for _ in range(rng.randint(1, 30))]
        texts.append(part * rng.randint(1, 4) + [rng.choice("abc") for _ in range(10)] + part)
    for ws, (three, n_max, cov, longest) in zip(texts, group_stats(texts, 12)):
        assert (three, cov, longest, n_max) == (*brute(ws, 12), maximal(ws, 12))
    assert [(a, None, c, d) for a, _, c, d in group_stats(texts, 12)] == group_stats(texts, 12, False)


def test_a_text_of_millions_of_equal_words_takes_bounded_memory():
    code = "import resource, sys; from folio.llm.repetition import group_stats; w = ['a'] * 3_000_000; b = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; assert group_stats([w], 10, False) == [(3_000_000, None, 3_000_000, 2_999_999)]; print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - b)"
    kb = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT).stdout)
    assert kb < 500_000
