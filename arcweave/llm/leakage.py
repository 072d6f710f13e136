"""Passages of held-out material inside a corpus.

Every run of ``RUN`` consecutive words of a passage is a test string. A
document's words are searched for all of them at once by Wu-Manber: the block
of two words at the end of the current window gives from the shift table how
far the window may move without missing a test string; only where that is zero
the bucket of the block's strings is looked up, by the hash of a longer suffix,
and its strings are compared word by word. As most blocks of a text occur in no
passage, about one word in eleven is looked at.

Only ``map`` work over the corpus. Passages are cut into pieces that overlap by
``RUN`` - 1 words, their words counted where they lie, and the pieces spread
over groups of at most ``MAX_PASSAGE_WORDS`` words by a hash; a group that turns
out larger is spread again. The driver holds one group at a time, builds its
tables, broadcasts them and takes them back once its pass over the corpus is
written, so neither the driver nor an executor ever holds more. Each group is a
pass of its own over the corpus.

Defined cases: null or empty texts and passages, and those of fewer than
``RUN`` words, match nothing; a passage's id may come in several rows; equal
texts are all reported; null ids are ignored; a pair is reported once; other
columns are ignored; texts are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm.words import words
from arcweave.runtime import union_all, write_stage

RUN = 12
BLOCK = 2
SUFFIX = 4
#: Words of passages in one set of tables (some 500 bytes each in memory).
MAX_PASSAGE_WORDS = 200_000
#: Words of a piece of a passage, at most.
PIECE = 10_000


class Patterns:
    """Shift table, suffix buckets and test strings of a set of passages."""

    def __init__(self, passages: list[tuple[int, list[str]]], run: int = RUN):
        self.run, self.passages, self.far = run, [], run - BLOCK + 1
        self.shift: dict[tuple[str, str], int] = {}
        self.buckets: dict[tuple[str, ...], list[tuple[int, int]]] = {}
        for item, w in passages:
            if item is None or len(w) < run:
                continue
            k = len(self.passages)
            self.passages.append((item, w))
            for i in range(len(w) - 1):
                # a block ending at word i+1 is at best as far from a string's end as the first string's end allows
                away = max(0, run - 2 - i)
                block = (w[i], w[i + 1])
                if away < self.shift.get(block, self.far):
                    self.shift[block] = away
            for end in range(run, len(w) + 1):
                self.buckets.setdefault(tuple(w[end - SUFFIX : end]), []).append((k, end))

    def search(self, w: list[str]) -> set[int]:
        """The items of which at least one test string occurs in ``w``."""
        found: set[int] = set()
        run, far, n, passages = self.run, self.far, len(w), self.passages
        shift, bucket = self.shift.get, self.buckets.get
        end = run
        while end <= n:
            skip = shift((w[end - 2], w[end - 1]), far)
            if skip:
                end += skip
                continue
            for k, stop in bucket(tuple(w[end - SUFFIX : end]), ()):
                item, p = passages[k]
                if item not in found and p[stop - run : stop] == w[end - run : end]:
                    found.add(item)
            end += 1
        return found


def pieces(items: DataFrame, item_id: str = "item_id", passage: str = "passage", run: int = RUN, size: int = PIECE) -> DataFrame:
    """``item_id bigint, at bigint, w array<string>``: the words of the passages
    in pieces of at most ``size``, each overlapping the one before so that every
    run of words lies whole in one. Passages without a run have none."""
    rows = items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{passage}`").cast("string").alias("passage")).filter("item_id is not null and passage is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, at, parts = [], [], []
            for i in range(b.num_rows):
                w = words(b.column(1)[i].as_py())
                for k in range(0, len(w) - run + 1, max(1, size - run + 1)):
                    ids.append(b.column(0)[i].as_py())
                    at.append(k)
                    parts.append(w[k : k + size])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int64()), pa.array(parts, pa.list_(pa.string()))], names=["item_id", "at", "w"])

    return rows.mapInArrow(cut, "item_id bigint, at bigint, w array<string>")


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", run: int = RUN, limit: int = MAX_PASSAGE_WORDS) -> DataFrame:
    """``doc_id bigint, item_id bigint``: documents with at least ``run``
    consecutive words of an item's passage."""
    parts = write_stage(pieces(items, item_id, passage, run, min(PIECE, max(run, limit // 4))), "pieces")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    total = parts.agg(F.coalesce(F.sum(F.size("w")), F.lit(0)).alias("n")).first()["n"]
    found, todo = [], [(parts, total, 0)]
    while todo:
        mine, n, depth = todo.pop()
        if n > limit:
            k = 2 * -(-n // limit)
            group = F.pmod(F.xxhash64("item_id", "at", F.lit(depth)), F.lit(k))
            sizes = mine.groupBy(group.alias("g")).agg(F.sum(F.size("w")).alias("n")).collect()  # a row per group
            todo += [(mine.filter(group == r["g"]), r["n"], depth + 1) for r in sizes]
            continue
        shipped = rows.sparkSession.sparkContext.broadcast(Patterns([(r["item_id"], list(r["w"])) for r in mine.select("item_id", "w").toLocalIterator()], run))
        out = _search(rows, shipped)
        if n == total:
            return out
        found.append(write_stage(out, "leaks"))
        shipped.destroy()
    return union_all(found).distinct()


def _search(rows: DataFrame, shipped: Broadcast[Patterns]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = shipped.value.search
        for b in batches:
            docs, hits = [], []
            for i in range(b.num_rows):
                if found := search(words(b.column(1)[i].as_py())):
                    docs += [b.column(0)[i].as_py()] * len(found)
                    hits += sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(hits, pa.int64())], names=["doc_id", "item_id"])

    return rows.mapInArrow(run, "doc_id bigint, item_id bigint")
