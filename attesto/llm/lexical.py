"""Ranked lexical search by the threshold algorithm over impact-sorted lists.

A first pass over the texts writes a forward index of the terms that the items ask for: one row for each document, with
its length and the numbers and counts of such terms. Counts over all of it give each term's weight, and so each
(document, term) an impact, whole and the same for every item.

Then documents are taken in shards of bounded size. A shard sorts each term's list by impact. For an item, its lists
are read side by side, some places deeper each round; what appears for the first time is looked up in the forward index
for its full score. An unseen document can score no more than the sum of the impacts last read: when this threshold
falls strictly below the kth score, nothing more is read. The kth score is carried from shard to shard of a task, so
later shards stop sooner. Only the best of each task meet, in two steps.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cleared, in_arrow, partitions, written

#: Bytes of a document's text that are split at once, documents of a shard, and distinct terms that a block of items may have.
SEGMENT, SHARD, TERMS = 1 << 20, 8192, 1 << 17
#: Places of each list that the first round reads; each further round doubles the depth.
DEPTH = 16
_TABLE = bytearray(b" " * 128 + bytes(range(128, 256)))
for _a in (*range(0x30, 0x3A), *range(0x61, 0x7B)):
    _TABLE[_a] = _a
for _a in range(0x41, 0x5B):
    _TABLE[_a] = _a + 32
_TABLE = bytes(_TABLE)
#: The same terms for SQL functions.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a list for each stretch of about SEGMENT bytes."""
    at = 0
    while at < len(text):
        end = min(len(text), at + SEGMENT)
        part = text[at:end].translate(_TABLE)
        while end < len(text) and part[-1:] != b" ":  # go on to the end of the last term
            more = text[end : end + 4096].translate(_TABLE)
            stop = more.find(b" ")
            part += more if stop < 0 else more[: stop + 1]
            end += len(more) if stop < 0 else stop + 1
        yield part.split()
        at = end


def _counted(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, counts, offsets = [], [], [], [0]
            for value in batch.column("_text"):
                n, found = 0, Counter()
                for terms in terms_of(value.as_buffer().to_pybytes() if value.is_valid else b""):
                    n += len(terms)
                    found.update(map(vocabulary.get, terms))
                found.pop(None, None)
                sizes.append(n)
                ids += found.keys()
                counts += found.values()
                offsets.append(len(ids))
            at = pa.array(offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, t)) for x, t in ((ids, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), pa.array(sizes, pa.int64()), *lists], ["_doc", "n", "ids", "counts"])

    return run


def forward(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """_doc, n (terms with repeats), and the numbers and counts of the terms that the vocabulary knows."""
    source = docs.select(F.col(doc_id).cast("long").alias("_doc"), F.col(text).alias("_text"))
    return in_arrow(source, _counted(vocabulary), "_doc long, n long, ids array<int>, counts array<long>")


class Shard:
    """Impact-sorted lists and the forward index of some documents."""

    def __init__(self, docs: np.ndarray, bounds: np.ndarray, terms: np.ndarray, impacts: np.ndarray):
        """terms[bounds[i]:bounds[i + 1]] are those of document i."""
        self.docs, self.bounds, self.terms, self.impacts = docs, bounds, terms, impacts
        owner = np.repeat(np.arange(len(docs)), np.diff(bounds))
        order = np.lexsort((-impacts, terms))
        self.listed, self.values = owner[order], impacts[order]
        self.known, starts = np.unique(terms[order], return_index=True)
        self.starts = np.append(starts, len(order))

    def scores(self, rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Full scores of some documents; asked marks the item's terms."""
        sizes = self.bounds[rows + 1] - self.bounds[rows]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.bounds[rows] - ends + sizes, sizes)
        sums = np.concatenate(([0], np.cumsum(np.where(asked[self.terms[at]], self.impacts[at], 0))))
        return sums[ends] - sums[ends - sizes]

    def best(self, item: np.ndarray, asked: np.ndarray, k: int, kth: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows and scores of the k best above 0 that reach kth, smaller documents first among equals; and the places read."""
        at = np.searchsorted(self.known, item)
        here = np.zeros(len(item), bool)
        here[at < len(self.known)] = self.known[at[at < len(self.known)]] == item[at < len(self.known)]
        first, last = self.starts[at[here]], self.starts[at[here] + 1]
        seen = np.zeros(len(self.docs), bool)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step, read = 0, DEPTH, 0
        while len(first):
            until = np.minimum(first + depth + step, last)
            sizes = np.maximum(until - first - depth, 0)
            ends = np.cumsum(sizes)
            places = np.arange(ends[-1]) + np.repeat(first + depth - ends + sizes, sizes)
            read += len(places)
            new = np.unique(self.listed[places])
            new = new[~seen[new]]
            seen[new] = True
            gained = self.scores(new, asked)
            rows, scores = np.concatenate((rows, new[gained > 0])), np.concatenate((scores, gained[gained > 0]))
            if len(rows) > k:
                order = np.lexsort((self.docs[rows], -scores))[:k]
                rows, scores = rows[order], scores[order]
            depth, step = depth + step, 2 * step
            on = first + depth < last  # lists that are not read to their end
            threshold = int(self.values[(first + depth - 1)[on]].sum())
            least = max(kth, int(scores.min()) if len(rows) == k else 0)
            if not on.any() or threshold < least:
                break
        order = np.lexsort((self.docs[rows], -scores))
        reach = scores[order] >= kth
        return rows[order][reach], scores[order][reach], read


def _searched(items: dict, weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    """The threshold algorithm over the shards of a task; gives the best of all its shards, for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {i: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for i in items}
        for batch in batches:
            for a in range(0, len(batch), SHARD):
                part = batch.slice(a, SHARD)
                docs = part.column("_doc").to_numpy(zero_copy_only=False)
                lists = part.column("ids")
                bounds = lists.offsets.to_numpy()[: len(part) + 1].astype(np.int64)
                terms = lists.values.to_numpy()[bounds[0] : bounds[-1]]
                tf = part.column("counts").values.to_numpy()[bounds[0] : bounds[-1]]
                bounds -= bounds[0]
                m = 50 + (50 * part.column("n").to_numpy() * n_docs) // n_terms
                impacts = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, np.diff(bounds))))
                shard = Shard(docs, bounds, terms, impacts)
                asked = np.zeros(len(weights), bool)
                for i, item in items.items():
                    have, score = best[i]
                    asked[item] = True
                    rows, scores, _ = shard.best(item, asked, k, int(score[-1]) if len(score) == k else 0)
                    asked[item] = False
                    if len(rows):
                        have, score = np.concatenate((have, docs[rows])), np.concatenate((score, scores))
                        order = np.lexsort((have, -score))[:k]
                        best[i] = have[order], score[order]
        names = [i for i, (have, _) in best.items() for _ in have]
        if names:
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(np.concatenate([h for h, _ in best.values()])), pa.array(np.concatenate([s for _, s in best.values()]))], ["item", "_doc", "score"]
            )

    return run


def ranked(items: DataFrame, docs: DataFrame, k: int = 50, item_id: str = "item_id", doc_id: str = "doc_id", item_text: str = "text", text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id and score: each item's k best documents above 0, smaller ids first among equals.

    Ids are integers. Each row of docs is a document, also one that repeats another's id or text; without terms (null,
    empty or punctuation) it counts nowhere. Rows without an id are counted in the statistics but never found. An item
    with a null id or without terms finds nothing; items that repeat an id are one item with the terms of all. Texts are
    read whole, in stretches of SEGMENT bytes. Other columns are not read, whatever their names.

    Items are searched in blocks, so that a block's terms fit into a worker; a block passes over the documents once.
    """
    spark = docs.sparkSession
    kinds = {"item": dict(items.dtypes)[item_id], "_doc": dict(docs.dtypes)[doc_id]}
    asked = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull())
    found = F.regexp_extract_all(F.translate(F.col(item_text), _UPPER, _LOWER), F.lit(TERM), F.lit(0))
    asked = written(asked.select(F.col(item_id).alias("item"), F.explode(found).alias("term")).distinct())
    total = asked.count()
    blocks = max(1, -(-total // TERMS))
    results = []
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).groupBy("item").agg(F.collect_list("term").alias("terms")).collect()  # about TERMS terms
        vocabulary: dict[bytes, int] = {}
        for row in mine:
            for term in row["terms"]:
                vocabulary.setdefault(term.encode(), len(vocabulary))
        numbered = {r["item"]: np.unique([vocabulary[t.encode()] for t in r["terms"]]) for r in mine}
        with cleared(keep=1):  # the result stays
            index = written(forward(docs, vocabulary, doc_id, text))
            n_docs, n_terms = index.where("n > 0").agg(F.count("*"), F.sum("n")).first()
            if not n_docs:
                continue
            df = np.zeros(len(vocabulary), np.int64)
            for term, count in index.select(F.explode("ids").alias("t")).groupBy("t").count().collect():  # a row for each of the block's terms
                df[term] = count
            weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
            run = _searched(numbered, weights, n_docs, n_terms, k)
            tops = in_arrow(index.where(F.col("_doc").isNotNull() & (F.size("ids") > 0)), run, "item long, _doc long, score long")
            # The best of each task meet in shares of tasks first.
            share = F.pmod(F.xxhash64("_doc"), F.lit(max(1, math.isqrt(partitions(spark)))))
            order = (F.desc("score"), F.asc("_doc"))
            some = tops.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("item", "share").orderBy(*order))).where(F.col("rank") <= k)
            last = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
            results.append(written(last.select(F.col("item").cast(kinds["item"]).alias(item_id), "rank", F.col("_doc").cast(kinds["_doc"]).alias(doc_id), "score")))
    if not results:
        return spark.createDataFrame([], f"`{item_id}` {kinds['item']}, rank int, `{doc_id}` {kinds['_doc']}, score long")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
