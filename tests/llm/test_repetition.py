import math
import random

import numpy as np

from arcweave.llm import repetition as R
from arcweave.llm.words import words


def brute(w, run=8):
    seen, cover = set(), [False] * len(w)
    for k in range(len(w) - run + 1):
        g = tuple(w[k : k + run])
        if g in seen:
            cover[k : k + run] = [True] * run
        seen.add(g)
    return sum(cover)


def test_against_brute_force(make):
    rng = random.Random(1)
    docs = []
    for i in range(60):
        part = [rng.choice("abc漢") for _ in range(rng.randint(0, 30))]
        docs.append((i, "en" if i % 3 else None, " ".join(part * rng.randint(1, 3))))
    docs += [(100, "de", None), (101, "de", ""), (102, "de", " \t"), (103, "en", "x " * 5000), (100, "de", None)]
    got = {(r.doc_id, r.n_words, r.n_repeated) for r in R.measure(make(docs, "doc_id long, stratum string, text string"), stratum="stratum").collect()}
    assert got == {(d, len(words(t)), brute(words(t))) for d, _, t in docs}


def test_block_borders():
    w = list(range(20)) + list(range(20)) + [7] * 9
    code, size = np.array(w, np.int64), np.array([20, 20, 9, 0])
    assert R.repeated_words(code, size).tolist() == [0, 0, 8, 0]  # a sequence of another document doesn't count


def test_binomial_bounds():
    assert abs(R.binomial_p(0, 50, 0.05) - 0.95**50) < 1e-12
    assert abs(R.upper_bound(0, 50, 0.05) - (1 - 0.05 ** (1 / 50))) < 1e-9
    assert R.upper_bound(5, 5, 0.05) == 1.0


def test_scores_bound_shares(make):
    """The score is the share of sequences seen before, counted plainly, and
    score <= share <= run * score."""
    rng = random.Random(2)
    for _ in range(40):
        w = [rng.choice("ab") for _ in range(rng.randint(0, 80))]
        code, size = np.array([ord(x) for x in w], np.int64), np.array([len(w)])
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        score = R.shingle_scores(code, size)[0]
        assert abs(score * max(len(w), 1) - (len(grams) - len(set(grams)))) < 1e-9
        assert score <= brute(w) / max(len(w), 1) + 1e-12 <= 8 * score + 1e-9


def test_cutoffs_keep_their_guarantee():
    """Over many holdouts a certified cutoff exceeds its true rate of wrong
    decisions no more often than delta."""
    rng = np.random.default_rng(3)
    broken = certified = 0
    for _ in range(300):
        hold = [("s", float(x), False) for x in rng.beta(1, 12, 300)] + [("t", 0.9, True)]
        c = R.risk_controlled_cutoffs(hold, grid=[0.1, 0.2, 0.3, 0.4], alpha=0.05, delta=0.1)
        if c["s"].reject.certified:
            certified += 1
            broken += (1 - c["s"].reject.cutoff) ** 12 > 0.05  # P(beta(1, 12) >= cutoff)
        assert c["t"] == R.sure_cutoffs()  # one document certifies nothing
    assert certified > 100 and broken / 300 <= 0.1


def test_cutoffs_narrow_the_band():
    hold = [("s", 0.1, False)] * 10000 + [("s", 0.45, True)] * 300
    c = R.risk_controlled_cutoffs(hold)["s"]
    assert (c.keep.cutoff, c.reject.cutoff) == (0.15, 0.4) and c.keep.certified and c.reject.certified and 0 < c.reject.bound < 0.05
    c = R.risk_controlled_cutoffs([*hold, ("s", 0.35, False), ("s", 0.12, True)])["s"]
    assert (c.keep.cutoff, c.reject.cutoff) == (0.1, 0.4)  # contradicted ones aren't taken


def test_found_is_exact(make):
    base = " ".join(f"w{i}" for i in range(40))
    docs = [(i, "en", f"{base} {i} " + " ".join(f"u{i}x{k}" for k in range(30))) for i in range(30)] + [(200, "en", (base + " ") * 3), (201, None, (base + " ") * 4), (202, "de", ""), (None, "de", None)]
    df = make(docs, "doc_id long, lang string, text string")
    assert {r.doc_id for r in R.repetitive(df, R.fit_cutoffs(df, stratum="lang"), stratum="lang").collect()} == {200, 201}
    empty = make([], "doc_id long, lang string, text string")
    assert R.repetitive(empty, R.fit_cutoffs(empty, stratum="lang"), stratum="lang").count() == 0


def test_cutoffs_decide(make):
    """Outside the band nothing but the cutoffs decides."""
    base = " ".join(f"w{i}" for i in range(40))
    docs = [(1, "s", base + " " + " ".join(base.split()[:16]) + " end"), (2, "s", (base + " ") * 3), (3, "s", base)]
    df = make(docs, "doc_id long, lang string, text string")
    side = lambda c: R.Side(c, True, 100, 0, 0.01)
    how = lambda keep, reject: {r.doc_id: (r.decided, r.repetitive) for r in R.judge(df, {"s": R.Cutoffs(side(keep), side(reject))}, stratum="lang").collect()}
    assert how(0.05, 0.5) == {1: ("measured", False), 2: ("rejected", True), 3: ("kept", False)}
    assert how(0.05, 0.1)[1] == ("rejected", True)  # moving a cutoff changes rows
    assert how(0.7, 0.8)[2] == ("kept", False)


def test_every_document_counts(spark):
    """One repetitive document of low score among 20,000, and one good document
    of a higher score than all others of its stratum."""
    seq = [f"w{i}" for i in range(50)]
    low = " ".join(seq[:8] + [f"u{i}" for i in range(6)] + seq[:8])  # 8 of 22 words repeated, score 1/22
    high = " ".join(seq + seq[:12])  # 12 of 62 words repeated, score 5/62
    text = f"CASE WHEN id = 3 THEN '{low}' WHEN id = 20000 THEN '{high}' WHEN id < 20000 AND id % 40 = 1 THEN repeat('x ', 40) ELSE 'a short text' END"
    df = spark.range(40000).selectExpr("id AS doc_id", "CASE WHEN id < 20000 THEN 'a' ELSE 'b' END AS lang", f"{text} AS text")
    cutoffs = R.fit_cutoffs(df, stratum="lang")
    assert {r.doc_id for r in R.repetitive(df, cutoffs, stratum="lang").collect()} == {3, *range(1, 20000, 40)}
    assert (cutoffs["a"].reject.n, cutoffs["b"].reject.n) == (19499, 20000) and cutoffs["a"].reject.certified and cutoffs["b"].reject.certified


def test_binomial_of_large_counts():
    plain = lambda wrong, n, p: sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(wrong + 1))
    for wrong, n, p in [(3, 40, 0.3), (30, 40, 0.3), (12, 40, 0.3), (40, 40, 0.05), (0, 7, 0.9)]:
        assert abs(R.binomial_p(wrong, n, p) - plain(wrong, n, p)) < 1e-9
    assert R.binomial_p(39_000_000, 40_000_000, 0.001) > 0.999 and 0.4 < R.binomial_p(40_000, 40_000_000, 0.001) < 0.6
