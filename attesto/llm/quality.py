"""Quality rules as a bitmask ledger.

One pass over the texts takes every measurement and evaluates every rule once; the ledger
keeps the measurements and a bit for each failed rule. Policies are versioned masks: a
row is kept if it fails none of a policy's rules. New policies, and ablations (what each
rule alone removes, what leaving it out would bring back), read the ledger, never the text.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from ._common import blocks, in_arrow, utf8, written

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars")
#: Rule i sets bit i where it is true. The first two are the contract's base.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "n_words > 0 and 10 * n_symbols > 4 * n_words"),
    ("duplicate_lines", "n_lines > 0 and 100 * n_dup_lines > 60 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 14 * n_words"),
    ("many_words", "n_words > 1000000"),
)
BASE_MASK = 0b11
#: Policy versions: masks of the rules that count.
POLICIES = {1: 0b0000011, 2: 0b0111111}
VERSION = 2

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _repeats(keys: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per key whether another of its group equals it, and whether an earlier one does."""
    mixed = hashing.mix(keys ^ hashing.mix(groups.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys):
        later[order[1:]] = same
        twice[order[1:]] = same
        twice[order[:-1]] |= same
    return twice, later


def measured(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of MEASURES for each text."""
    n = len(offsets) - 1
    out = np.zeros((n, len(MEASURES)), np.int64)
    if not len(data):
        return out
    starts, ends, doc = hashing.words(data, offsets)
    point = (data & 0xC0) != 0x80
    out[:, 0] = np.bincount(doc, minlength=n)
    out[:, 1] = hashing.totals(point & ~hashing.SPACE[data], offsets)
    out[:, 2] = hashing.totals(_SYMBOL[data], offsets)
    out[:, 6] = hashing.totals(point, offsets)
    del point
    # Lines: cut at \n and at the ends of texts; those with a word count.
    newline = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate((offsets[:-1][np.diff(offsets) > 0], newline + 1)))
    begin = begin[begin < len(data)]
    owner = np.searchsorted(offsets, begin, "right") - 1
    until = np.minimum(np.append(begin[1:], len(data)), offsets[owner + 1])
    until -= data[until - 1] == 10
    has = np.searchsorted(starts, until) > np.searchsorted(starts, begin)
    begin, until, owner = begin[has], until[has], owner[has]
    _, later = _repeats(hashing.spans(data, begin, until), owner)
    out[:, 5] = np.bincount(owner, minlength=n)
    out[:, 3] = np.bincount(owner[later], minlength=n)
    # Windows of three words.
    if len(starts) > 2:
        hashes = hashing.spans(data, starts, ends)
        at = np.arange(len(starts) - 2)
        at = at[doc[at] == doc[at + 2]]
        twice, _ = _repeats(hashing.combined(hashes, at, 3), doc[at])
        covered = np.zeros(len(starts), bool)
        for j in range(3):
            covered[at[twice] + j] = True
        out[:, 4] = np.bincount(doc[covered], minlength=n)
    return out


def _measure(batches):
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        rest = batch.drop_columns(["text"])
        for a, b in blocks(offsets):
            found = measured(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([*(x.slice(a, b - a) for x in rest.columns), *(pa.array(found[:, k]) for k in range(len(MEASURES)))], [*rest.schema.names, *MEASURES])


def ledger(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, the measurements and fail_bits, a bit for each rule that a row fails; every row of docs.

    A null text is empty: no words, so it fails few_words only. Texts are read whole.
    Repeated rows and null ids are rows like others; other columns are ignored.
    """
    rows = in_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), "text"), _measure, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)]
    total = bits[0]
    for x in bits[1:]:
        total = total.bitwiseOR(x)
    return rows.withColumn("fail_bits", total)


def decided(rows: DataFrame, version: int = VERSION) -> DataFrame:
    """The ledger with policy_version, base_failed and kept under that policy."""
    hit = lambda mask: F.col("fail_bits").bitwiseAND(F.lit(mask)) != 0
    return rows.withColumns({"policy_version": F.lit(version), "base_failed": hit(BASE_MASK), "kept": ~hit(BASE_MASK | POLICIES[version])})


def ablation(rows: DataFrame, version: int = VERSION) -> DataFrame:
    """For each rule of a policy: rule, n_failed, n_only (rows that only it removes), n_kept_without; one row each.

    One aggregation by masked bits, at most a group for each pattern of failures, then
    bit arithmetic on the groups. An empty ledger gives zeros.
    """
    mask = POLICIES[version]
    groups = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    parts = []
    for i, (name, _) in enumerate(RULES):
        if mask >> i & 1:
            bit, bits = F.lit(1 << i), F.col("bits")
            without = bits.bitwiseAND(F.lit(mask & ~(1 << i))) == 0
            parts.append(F.struct(F.lit(name).alias("rule"), total(bits.bitwiseAND(bit) != 0).alias("n_failed"), total(bits == bit).alias("n_only"), total(without).alias("n_kept_without")))
    return groups.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def quality_rules(docs: DataFrame, version: int = VERSION) -> DataFrame:
    """A policy's verdict on every row, read from the stored ledger."""
    return decided(written(ledger(docs)), version)


def ablations(docs: DataFrame, versions=tuple(POLICIES)) -> DataFrame:
    """ablation() of each policy version, from one stored ledger."""
    rows = written(ledger(docs))
    parts = [ablation(rows, v).select(F.lit(v).alias("policy_version"), "*") for v in versions]
    return reduce(DataFrame.unionByName, parts)
