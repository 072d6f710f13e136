"""Repetition inside single documents, decided by cutoffs with a guarantee.

``measure`` gives for each document the share of its words that lie in a
sequence of ``RUN`` words which also starts earlier in the document. Words are
numbered and sequences hashed in numpy over blocks of documents; equal hashes
are confirmed word by word.

``repetitive`` decides without that measurement wherever it can. Its score is
the number of hashed sequences that occur again, over the number of words: one
plain sort, nothing located, confirmed or covered. From a score of the stratum's
upper cutoff on a document is rejected as repetitive, below the lower one it is
kept, and only in the band between it is measured. Both cutoffs come from
``certified_cutoffs``: from labelled documents, the ones for which exact
binomial tests show that at most ``alpha`` of the stratum's good documents are
rejected, and at most ``alpha_kept`` of its repetitive ones kept; over all
strata, sides and cutoffs together the chance of any wrong certificate is at
most ``delta`` (Holm's correction). A cutoff that a labelled document
contradicts is not taken. A side without a certificate, and a stratum without
labelled documents, gets the cutoff that arithmetic gives: the score never
exceeds the share, nor the share ``RUN`` times the score.

``fit_cutoffs`` labels every document, none is sampled: its cutoffs decide no
document wrongly of the table they were fitted on. For other tables the
certificates are what holds.

All is ``map`` work over the documents, and one row of counts per stratum.

Defined cases: null, empty and wordless texts have no words, the score and share
0, and are kept; null ids are kept as rows; a document of fewer than RUN + 1 words repeats nothing;
equal documents are judged each by itself; texts are read whole; a null stratum is a stratum.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm.words import words

RUN = 8
#: Words that are worked on at once; one longer document is a block by itself.
BLOCK_WORDS = 400_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def repeated_words(code: np.ndarray, size: np.ndarray, run: int = RUN) -> np.ndarray:
    """The number of repeated words of each document. ``code``: the word
    numbers of all documents one after another; ``size``: words of each."""
    n = len(code)
    out = np.zeros(len(size), np.int64)
    if n < run + 1:
        return out
    doc = np.repeat(np.arange(len(size)), size)
    with np.errstate(over="ignore"):
        value = _mix(code.astype(np.uint64))
        h = np.zeros(n - run + 1, np.uint64)
        for j in range(run):
            h = h * np.uint64(0x100000001B3) + value[j : n - run + 1 + j]
        h = _mix(h ^ _mix(doc[: n - run + 1].astype(np.uint64)))
    start = np.flatnonzero(doc[: n - run + 1] == doc[run - 1 :])
    order = start[np.argsort(h[start], kind="stable")]  # equal hashes in the order of their starts
    again = np.flatnonzero(h[order[1:]] == h[order[:-1]]) + 1
    now, before = order[again], order[again - 1]
    same = doc[now] == doc[before]
    for j in range(run):
        same &= code[now + j] == code[before + j]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, now[same], 1)
    np.add.at(cover, now[same] + run, -1)
    np.add.at(out, doc[np.cumsum(cover[:-1]) > 0], 1)
    return out


def shingle_scores(code: np.ndarray, size: np.ndarray, run: int = RUN) -> np.ndarray:
    """Hashed sequences that occur again in their document, over its words. A
    hash has 44 bits, the document's place in the block the other 20."""
    n, docs = len(code), len(size)
    if n < run + 1:
        return np.zeros(docs)
    doc = np.repeat(np.arange(docs), size)
    with np.errstate(over="ignore"):
        value = _mix(code.astype(np.uint64))
        h = np.zeros(n - run + 1, np.uint64)
        for j in range(run):
            h = h * np.uint64(0x100000001B3) + value[j : n - run + 1 + j]
        h = _mix(h) >> np.uint64(20)
    inside = doc[: n - run + 1] == doc[run - 1 :]
    key = np.sort((doc[: n - run + 1][inside].astype(np.uint64) << np.uint64(44)) | h[inside])
    again = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(44)).astype(np.int64), minlength=docs)
    return again / np.maximum(size, 1)


#: Documents of a block, at most (20 bits hold its place).
BLOCK_DOCS = 1 << 20


def _blocks(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Word numbers and sizes of runs of documents of bounded size: from, to, code, size."""
    texts, part, at, held = batch.column(text), [], 0, 0
    for i in range(batch.num_rows):
        part.append(words(texts[i].as_py()))
        held += len(part[-1])
        if held >= BLOCK_WORDS or len(part) == BLOCK_DOCS or i == batch.num_rows - 1:
            number: dict[str, int] = defaultdict(count().__next__)
            size = np.array([len(w) for w in part], np.int64)
            yield at, i + 1, np.fromiter((number[x] for w in part for x in w), np.int64, int(size.sum())), size
            part, at, held = [], i + 1, 0


def _rows(docs: DataFrame, doc_id: str, text: str, stratum: str | None) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), (F.col(f"`{stratum}`").cast("string") if stratum else F.lit(None).cast("string")).alias("stratum"), F.col(f"`{text}`").cast("string").alias("text"))


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str | None = None, run: int = RUN) -> DataFrame:
    """``doc_id bigint, stratum string, n_words bigint, n_repeated bigint,
    share double, score double`` of each document, all exact."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, r, s = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for i, j, code, size in _blocks(b, 2):
                n[i:j], r[i:j], s[i:j] = size, repeated_words(code, size, run), shingle_scores(code, size, run)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(r), pa.array(r / np.maximum(n, 1)), pa.array(s)], names=["doc_id", "stratum", "n_words", "n_repeated", "share", "score"])

    return _rows(docs, doc_id, text, stratum).mapInArrow(go, "doc_id bigint, stratum string, n_words bigint, n_repeated bigint, share double, score double")


def binomial_p(wrong: int, n: int, alpha: float) -> float:
    """P(at most ``wrong`` of ``n``) if each is wrong with chance ``alpha``:
    the exact p-value against "more than alpha are wrong"."""
    if n == 0:
        return 1.0
    la, lb = math.log(alpha), math.log1p(-alpha)
    top = min(wrong, int((n + 1) * alpha))  # the largest term; they fall on both sides of it

    def log_term(k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * la + (n - k) * lb

    peak, total = log_term(top), 0.0
    for side in (range(top, -1, -1), range(top + 1, wrong + 1)):
        for k in side:
            term = math.exp(log_term(k) - peak)
            total += term
            if term < 1e-20:  # what follows is below a double's precision
                break
    return min(1.0, math.exp(peak) * total)


def upper_bound(wrong: int, n: int, delta: float) -> float:
    """The exact (Clopper-Pearson) upper bound of a rate, one-sided."""
    if wrong >= n:
        return 1.0
    lo, hi = wrong / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if binomial_p(wrong, n, mid) > delta else (lo, mid)
    return hi


@dataclass(frozen=True)
class Side:
    """One cutoff of a stratum: from ``cutoff`` on rejected, or below it kept.
    ``bound`` is the upper bound of the rate of wrong decisions among the ``n``
    labelled documents it could harm, None if it holds by arithmetic."""

    cutoff: float
    certified: bool
    n: int
    n_wrong: int
    bound: float | None


@dataclass(frozen=True)
class Cutoffs:
    keep: Side
    reject: Side


#: Scores that are tried as cutoffs.
GRID = [0.05, 0.075, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5]


def sure_cutoffs(share: float = 0.3, run: int = RUN) -> Cutoffs:
    """What arithmetic gives: score <= share <= run * score."""
    return Cutoffs(Side(share / run, False, 0, 0, None), Side(share, False, 0, 0, None))


@dataclass(frozen=True)
class Counts:
    """Labelled documents of a stratum: good and repetitive ones, and for each
    cutoff the good ones from it on and the repetitive ones below it."""

    good: int
    bad: int
    good_from: list[int]
    bad_below: list[int]


def certified_cutoffs(counts: dict[str | None, Counts], share: float = 0.3, run: int = RUN, grid: list[float] = GRID, alpha: float = 0.001, alpha_kept: float = 0.05, delta: float = 0.05) -> dict[str | None, Cutoffs]:
    """The certified cutoffs of each stratum. The band between is as narrow as
    the certificates allow; where they overlap, the overlap is the band."""
    tests = []
    for s, x in counts.items():
        for c, wrong_good, wrong_bad in zip(grid, x.good_from, x.bad_below, strict=True):
            tests.append((binomial_p(wrong_good, x.good, alpha), s, "reject", c, wrong_good, x.good))
            tests.append((binomial_p(wrong_bad, x.bad, alpha_kept), s, "keep", c, wrong_bad, x.bad))
    tests.sort(key=lambda t: (t[0], str(t[1]), t[2], t[3]))
    passed: dict[tuple, list[Side]] = defaultdict(list)
    for i, (p, s, side, c, wrong, n) in enumerate(tests):
        if p > delta / (len(tests) - i):
            break
        if not wrong:
            passed[s, side].append(Side(c, True, n, wrong, upper_bound(wrong, n, delta / len(tests))))
    out, sure = {}, sure_cutoffs(share, run)
    for s in counts:
        # a cutoff above a certified one rejects less, one below a certified one keeps less: the certificate covers it too
        reject = min(passed[s, "reject"], key=lambda x: x.cutoff, default=sure.reject)
        keep = max(passed[s, "keep"], key=lambda x: x.cutoff, default=sure.keep)
        if keep.cutoff > reject.cutoff:
            low, high = reject.cutoff, keep.cutoff
            keep, reject = replace(keep, cutoff=low), replace(reject, cutoff=high)
        out[s] = Cutoffs(keep, reject)
    return out


def risk_controlled_cutoffs(holdout: list[tuple[str | None, float, bool]], share: float = 0.3, run: int = RUN, grid: list[float] = GRID, **risks: float) -> dict[str | None, Cutoffs]:
    """``certified_cutoffs`` from a holdout: (stratum, score, whether the
    document is repetitive)."""
    by: dict[str | None, tuple[list[float], list[float]]] = defaultdict(lambda: ([], []))
    for stratum, score, bad in holdout:
        by[stratum][bad].append(score)
    counts = {s: Counts(len(good), len(bad), [sum(x >= c for x in good) for c in grid], [sum(x < c for x in bad) for c in grid]) for s, (good, bad) in by.items()}
    return certified_cutoffs(counts, share, run, grid, **risks)


def fit_cutoffs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str | None = None, share: float = 0.3, run: int = RUN, grid: list[float] = GRID, **risks: float) -> dict[str | None, Cutoffs]:
    """Cutoffs from all documents, labelled by the cutoffs that arithmetic gives
    and by the measured share in the band between."""
    each, good, bad, score = judge(docs, {}, doc_id, text, stratum, share, run), ~F.col("repetitive"), F.col("repetitive"), F.col("score")
    rows = each.groupBy("stratum").agg(F.count_if(good), F.count_if(bad), F.array(*[F.count_if(good & (score >= c)) for c in grid]), F.array(*[F.count_if(bad & (score < c)) for c in grid])).collect()
    return certified_cutoffs({s: Counts(*x) for s, *x in rows}, share, run, grid, **risks)


def judge(docs: DataFrame, cutoffs: dict[str | None, Cutoffs], doc_id: str = "doc_id", text: str = "text", stratum: str | None = None, share: float = 0.3, run: int = RUN) -> DataFrame:
    """``doc_id bigint, stratum string, n_words bigint, score double, decided
    string, share double, repetitive boolean`` of each document. ``decided``:
    rejected, kept, or measured (in the band); only there ``share`` is given."""
    sure = sure_cutoffs(share, run)
    at = {s: (c.keep.cutoff, c.reject.cutoff) for s, c in cutoffs.items()}
    usual = (sure.keep.cutoff, sure.reject.cutoff)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, s, exact, yes = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows), np.full(b.num_rows, np.nan), np.zeros(b.num_rows, bool)
            keep, reject = np.array([at.get(x, usual) for x in b.column(1).to_pylist()], float).reshape(-1, 2).T
            for i, j, code, size in _blocks(b, 2):
                n[i:j], s[i:j] = size, shingle_scores(code, size, run)
                yes[i:j] = s[i:j] >= reject[i:j]
                band = (s[i:j] >= keep[i:j]) & ~yes[i:j]
                if band.any():
                    r = repeated_words(code[np.repeat(band, size)], size[band], run)
                    exact[i:j][band], yes[i:j][band] = r / np.maximum(size[band], 1), r >= share * size[band]
            measured = ~np.isnan(exact)
            yes &= n > 0
            how = np.where(measured, "measured", np.where(yes, "rejected", "kept"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(s), pa.array(how.astype(object), pa.string()), pa.array(exact, mask=~measured), pa.array(yes)], names=["doc_id", "stratum", "n_words", "score", "decided", "share", "repetitive"])

    return _rows(docs, doc_id, text, stratum).mapInArrow(go, "doc_id bigint, stratum string, n_words bigint, score double, decided string, share double, repetitive boolean")


def repetitive(docs: DataFrame, cutoffs: dict[str | None, Cutoffs], doc_id: str = "doc_id", text: str = "text", stratum: str | None = None, share: float = 0.3, run: int = RUN) -> DataFrame:
    """``doc_id`` of the documents of which ``share`` or more is repeated, as ``judge`` decides."""
    return judge(docs, cutoffs, doc_id, text, stratum, share, run).filter("repetitive").select("doc_id")
