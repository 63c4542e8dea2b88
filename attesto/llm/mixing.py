"""Mixing sources to target weights on a domain-language-source tree; DataFrame functions only.

Budgets go down the tree. At each node the budget is dealt to the children by weight; a
child whose subtree cannot take its share (all its tokens in the allowed epochs) gets what
it can take, and its shortage is dealt to its siblings first, because a node's own budget
never exceeds what its subtree can take. Only what all siblings cannot take has reduced
the node's share, which its ancestors' other children then get. The level of this
water-filling is a window over siblings in order of capacity by weight.

A leaf's budget is a number of full epochs and a token-prefix of the next. An epoch's
order is a hash of seed, epoch and id. A histogram of tokens by leaf and hash bucket finds
the bucket where a budget ends; only that bucket's rows are ordered, so that a leaf with a
third of all rows is dealt to many tasks, and the texts never move: what is kept is
decided by comparing a row's hash with its leaf's cut, a table of one row a leaf. The hash
is of id, text and length, so rows of one hash are copies of each other; where a budget ends
among such copies, and only there, they are numbered and taken one after another.

The tree is metadata: a node's children, one row each, meet in one task to be filled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WORD, shielding, small, written

#: Hexadecimal digits of the hash buckets of each leaf's order, and the largest number of leaves whose cuts are broadcast.
BUCKET_DIGITS, BROADCAST_LEAVES = 3, 10_000
LEVELS = ("domain", "lang", "source")
#: Target weights among siblings that the registered query and the pipeline ask for: (level, domain, lang, source, weight).
#: Others weigh 1. Rows without a language have no part in the mix.
WEIGHTS = (
    (1, "domain0", None, None, 3.0), (1, "domain1", None, None, 2.0),
    *((2, f"domain{d}", "en", None, 2.5) for d in range(3)), *((2, f"domain{d}", "de", None, 0.5) for d in range(3)), *((2, f"domain{d}", "", None, 0.0) for d in range(3)),
    *((3, f"domain{d}", "en", "src1", 4.0) for d in range(3)), *((3, f"domain{d}", "en", "src7", 0.25) for d in range(3)),
)


def weight_table(spark: SparkSession, rows=WEIGHTS) -> DataFrame:
    return spark.createDataFrame(list(rows), "level int, domain string, lang string, source string, weight double")


def words(text: str = "text"):
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def _filled(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """nodes with weight, cap and the parent's budget b: adds budget, the water-filled share."""
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), *LEVELS[: len(parent) + 1])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy(*parent)
    level = (F.col("b") - F.col("taken")) / F.col("left")
    nodes = nodes.withColumn("taken", F.coalesce(F.sum("cap").over(before), F.lit(0)))
    nodes = nodes.withColumn("left", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    nodes = nodes.withColumn("full", F.col("cap") <= F.col("weight") * level)
    first = F.min(F.when(~F.col("full"), F.col("cap") / F.col("weight"))).over(everyone)
    nodes = nodes.withColumn("full", F.col("full") & (first.isNull() | (F.col("cap") / F.col("weight") < first)))
    spare = F.col("b") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everyone)
    rest = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everyone)
    share = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(spare * F.col("weight") / rest)
    # Whole tokens: each gets the floor, and those with the largest rests one more.
    nodes = nodes.withColumn("budget", F.least(F.col("cap"), F.floor(share + 1e-6).cast("long"))).withColumn("part", share - F.col("budget"))
    by_rest = Window.partitionBy(*parent).orderBy((F.col("budget") >= F.col("cap")).cast("int"), F.desc(F.round("part", 6)), *LEVELS[: len(parent) + 1])
    over = F.least(F.col("b"), F.sum("cap").over(everyone)) - F.sum("budget").over(everyone)
    nodes = nodes.withColumn("over", over).withColumn("place", F.row_number().over(by_rest))
    return nodes.withColumn("budget", F.col("budget") + ((F.col("place") <= F.col("over")) & (F.col("budget") < F.col("cap"))).cast("long"))


def _weighted(leaves: DataFrame, weights: DataFrame | None) -> DataFrame:
    """leaves with w1, w2, w3, the weights of their nodes on each level, 1 where none is given."""
    if weights is not None:
        weights = written(weights)
    for depth in range(1, len(LEVELS) + 1):
        if weights is None:
            leaves = leaves.withColumn(f"w{depth}", F.lit(1.0))
            continue
        keys = LEVELS[:depth]
        own = weights.where(F.col("level") == depth).groupBy(*(F.col(k).alias(f"k_{k}") for k in keys)).agg(F.min(F.col("weight").cast("double")).alias(f"w{depth}"))
        same = [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys]
        leaves = leaves.join(small(own, BROADCAST_LEAVES), same, "left").drop(*(f"k_{k}" for k in keys)).withColumn(f"w{depth}", F.coalesce(f"w{depth}", F.lit(1.0)))
    return leaves


def budgets(leaves: DataFrame, total: int, weights: DataFrame | None = None, max_epochs: int = 4) -> DataFrame:
    """leaves (domain, lang, source, tokens) with the budget of each.

    weights (level int, domain, lang, source, weight; null below its level) gives target
    weights among siblings; missing ones are 1, and of repeated ones the least counts. A
    node of weight 0 or less, or of none that is finite, takes nothing, and what it holds
    counts nowhere. total is cut to what the other leaves can take. Without leaves there
    are no budgets.
    """
    tree = written(_weighted(leaves.withColumn("cap", F.col("tokens") * max_epochs), weights))
    for depth in range(1, len(LEVELS) + 1):
        w = F.col(f"w{depth}")
        tree = tree.where((w > 0) & (w < float("inf")))
    fixed = None
    for depth in range(1, len(LEVELS) + 1):
        keys = list(LEVELS[:depth])
        level = tree.groupBy(*keys).agg(F.sum("cap").alias("cap"), F.max(f"w{depth}").alias("weight"))
        if fixed is None:
            level = level.withColumn("b", F.least(F.lit(total).cast("long"), F.sum("cap").over(Window.partitionBy())))
        else:
            level = level.join(fixed.withColumnRenamed("budget", "b"), keys[:-1])
        fixed = _filled(level, keys[:-1]).select(*keys, "budget")
    return leaves.join(fixed, list(LEVELS), "left").withColumn("budget", F.coalesce("budget", F.lit(0)).cast("long"))


def _name(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _print(text: str = "text"):
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def _keyed(docs: DataFrame, domain, tokens) -> DataFrame:
    """id, digest of the text, leaf and tokens of docs' rows."""
    return docs.select(
        F.col("doc_id").cast("long").alias("id"), _print().alias("print"), domain.alias("domain"), _name("lang").alias("lang"), _name("source").alias("source"),
        F.greatest(tokens, F.lit(1)).cast("long").alias("n"),
    )


def _order(seed: int, epoch, doc_id, text_print, n):
    """Place of a row in an epoch's order: 32 hexadecimal digits, equal for rows of equal id, text and length only."""
    return F.md5(F.concat_ws(":", F.lit(seed), epoch, F.coalesce(doc_id.cast("string"), F.lit("")), text_print, n))


def plan(docs: DataFrame, share: float, domain, tokens, weights: DataFrame | None, max_epochs: int, seed: int) -> DataFrame:
    """A row of each leaf: tokens, budget, epochs, cut (the last order value that is kept), last (tokens kept of its rows), ties (their number)."""
    rows = written(_keyed(docs, domain, tokens))  # the one scan of the texts; a few bytes a row
    leaf = list(LEVELS)
    sums = written(rows.groupBy(*leaf).agg(F.sum("n").alias("tokens")))
    total = sums.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * share).cast("long")).first()[0]
    leaves = budgets(sums, total, weights, max_epochs).withColumn("epochs", F.floor(F.col("budget") / F.col("tokens")).cast("int"))
    leaves = written(leaves.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")))
    held = small(leaves, BROADCAST_LEAVES)
    placed = rows.join(held.select(*leaf, "epochs", "rest").where("rest > 0"), leaf).withColumn("h", _order(seed, F.col("epochs") + 1, F.col("id"), F.col("print"), F.col("n")))
    placed = placed.withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    buckets = placed.groupBy(*leaf, "rest", "bucket").agg(F.sum("n").alias("size"))
    run = Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most 16 ** BUCKET_DIGITS rows a leaf
    ends = buckets.withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0)))
    ends = written(ends.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("size") >= F.col("rest"))).select(*leaf, "bucket", "before"))
    near = placed.join(small(ends, BROADCAST_LEAVES), [*leaf, "bucket"]).groupBy(*leaf, "rest", "before", "h").agg(F.sum("n").alias("size"), F.count("*").alias("ties"))
    within = Window.partitionBy(*leaf).orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))).where("before < rest")
    cuts = near.groupBy(*leaf).agg(F.max(F.struct("h", (F.col("rest") - F.col("before")).alias("last"), "ties")).alias("x"))
    out = leaves.join(cuts.select(*leaf, F.col("x.h").alias("cut"), F.col("x.last").alias("last"), F.col("x.ties").alias("ties")), leaf, "left")
    return written(out.select(*leaf, "tokens", "budget", "epochs", "rest", "cut", "last", "ties"))


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with __place, from 0 within keys: places within a partition and the counts of those before."""
    rows = written(rows.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    counts = rows.groupBy(*keys, "__part").agg(F.count("*").alias("__count"))
    before = F.sum("__count").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*keys, "__part", F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy("__at")) - 1
    return rows.withColumn("__local", place).join(small(written(starts), BROADCAST_LEAVES), [*keys, "__part"]).withColumn("__place", F.col("__before") + F.col("__local"))


@shielding
def mixed(
    docs: DataFrame, share: float = 0.5, domain=None, tokens=None, weights: DataFrame | None = None, max_epochs: int = 4, seed: int = 17, leaves: DataFrame | None = None
) -> DataFrame:
    """docs' rows with domain, n_tokens, copies and last_tokens; rows of no copies are left out.

    copies is the number of epochs that take the row: the leaf's full epochs, and one more
    if the row is in the prefix of the next. last_tokens is how many tokens of the last
    copy are within the budget, n_tokens but for the row where a leaf's budget ends.
    share is the part of all tokens that is asked for. Null languages and sources are a
    leaf value of their own, the empty string; a null or wordless text counts one token.
    Rows that share an id have places of their own by their texts; copies of one row, null
    ids included, follow each other, and the budget can end among them.
    """
    domain = domain_of() if domain is None else domain
    tokens = words() if tokens is None else tokens
    if leaves is None:
        leaves = plan(docs, share, domain, tokens, weights, max_epochs, seed)
    own = [c for c in docs.columns if c not in ("domain", "n_tokens", "copies", "last_tokens")]
    marked = docs.select("*", domain.alias("__domain"), F.greatest(tokens, F.lit(1)).cast("long").alias("__n"), _print().alias("__print"))
    cut = leaves.where("budget > 0").select(*(F.col(c).alias(f"__{c}_leaf") for c in LEVELS), *(F.col(c).alias(f"__{c}") for c in ("epochs", "cut", "last", "ties")))
    same = (F.col("__domain") == F.col("__domain_leaf")) & (_name("lang") == F.col("__lang_leaf")) & (_name("source") == F.col("__source_leaf"))
    joined = marked.join(small(cut, BROADCAST_LEAVES), same)
    joined = joined.withColumn("__h", _order(seed, F.col("__epochs") + 1, F.col("doc_id").cast("long"), F.col("__print"), F.col("__n")))
    at_cut = F.coalesce(F.col("__h") == F.col("__cut"), F.lit(False))

    def chosen(rows: DataFrame, given) -> DataFrame:
        """given is how many tokens of the epoch after the full ones a row gets."""
        rows = rows.withColumn("__given", given).select(
            *own, F.col("__domain").alias("domain"), F.col("__n").alias("n_tokens"), (F.col("__epochs") + (F.col("__given") > 0).cast("int")).cast("int").alias("copies"),
            F.when(F.col("__given") > 0, F.col("__given")).otherwise(F.col("__n")).cast("long").alias("last_tokens"),
        )
        return rows.where("copies > 0")

    inside = F.when(F.coalesce(F.col("__h") < F.col("__cut"), F.lit(False)), F.col("__n"))
    if (leaves.agg(F.max("ties")).first()[0] or 0) <= 1:
        return chosen(joined, inside.when(at_cut, F.least("__n", "__last")).otherwise(0))
    tied = _numbered(joined.where(at_cut), [f"__{c}_leaf" for c in LEVELS])
    share_of_tie = F.least(F.col("__n"), F.greatest(F.lit(0), F.col("__last") - F.col("__place") * F.col("__n")))
    return chosen(joined.where(~at_cut), inside.otherwise(0)).unionByName(chosen(tied, share_of_tie))


def domain_of(source: str = "source"):
    """Three domains, by a digest of the source's name; a null source is the empty one."""
    digits = F.substring(F.md5(F.coalesce(F.col(source).cast("string"), F.lit(""))), 1, 4)
    return F.concat(F.lit("domain"), F.conv(digits, 16, 10).cast("int") % 3)


@shielding
def repeated(rows: DataFrame, columns: list[str]) -> DataFrame:
    """What mixed() chose as documents: a row for each copy, the last one cut to its last_tokens words."""
    words_of = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1)
    rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    cut = (F.col("__copy") == F.col("copies")) & (F.col("last_tokens") < F.col("n_tokens"))
    rows = rows.withColumn("__cut", cut).withColumn("text", F.when(F.col("__cut"), F.array_join(F.slice(words_of, F.lit(1), F.col("last_tokens").cast("int")), "")).otherwise(F.col("text")))
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.when(F.col("__cut"), F.length("text")).otherwise(F.col("n_chars")).cast("long"))
    return rows.select(*columns)
