"""MinHash near-duplicates with tensored banding and exact verification.

Two collections of m bands, each of r minhashes, give m * m tables: the key of table
(i, j) combines band i of the first and band j of the second collection. So 2 * m * r
minhashes serve m * m tables of 2 * r minhashes each. A link of similarity s is missed
with a probability of about 2 * (1 - s**r)**m, 2e-5 for s = 0.8, r = 3, m = 16, 5e-7
for s = 0.85, and less wherever links form paths.

Plan: one pass over the texts makes signatures. Texts with equal shingle sets collapse
into one class. Only bands that two classes share are expanded to table keys. Each
table bucket links its members to its least member, a star, never pairs. Every edge of
a star is verified on the full sets, a centre's members dealt to tasks of bounded size,
and components of verified edges collapse most of each bucket. What a star may leave out
are links between members that are not in one component. Jaccard distance is a metric, so
two members whose distances to their centre differ by more than the threshold have no
link: members are dealt to zones of distance, and only those in one zone and in different
components are left. A link of 0.80 shares 67 tables on average and fewer than SHARED with
a probability of 3e-6, so members of fewer tables that hold another component are left out
too, as are then tables without one, in a few rounds. In the groups that remain, the rows
outside of the largest component meet the others, in blocks, and a breadth-first search
over exact similarities, which passes over pairs of one component, finds what is missing. So a dense group of any size is linear, no group is a
closure of unverified hits, and only rows that a star left out are ever sent to more than
one block. Nothing is capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from ._common import blocks, in_arrow, partitions, small, utf8, written
from .components import components

#: Bands of each collection, minhashes of a band.
BANDS, ROWS = 16, 3
#: Similarity of word shingles, in hundredths, from which texts are near copies.
PERCENT = 80
#: Shingles and members of a bucket's block, and members of a star, that one task checks together.
BLOCK_SHINGLES, BLOCK_MEMBERS, STAR = 3_000_000, 3_000, 500
#: Tables that a link beyond the stars must share, and rounds of leaving out what can't.
SHARED, ROUNDS = 4, 3
#: Ids of documents to leave out that are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(9173)
_MULTIPLY = _rng.integers(1, 2**63, 2 * BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SECOND = np.uint64(0x9E3779B97F4A7C15)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each whole set, and its 2 * BANDS band keys; for sets that are not empty."""
    flat, sizes = np.concatenate(sets), np.array([len(x) for x in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    keys = np.stack([np.add.reduceat(hashing.mix(flat), starts), np.add.reduceat(hashing.mix(flat ^ _SECOND), starts)], 1)
    least = np.stack([np.minimum.reduceat(flat * a, starts) for a in _MULTIPLY], 1).reshape(len(sets), 2 * BANDS, ROWS)
    bands = np.zeros(least.shape[:2], np.uint64)
    for j in range(ROWS):
        bands = hashing.mix(bands + least[:, :, j] + _SECOND)
    return keys, bands


def _sign(batches):
    band = pa.list_(pa.int64())
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for a, b in blocks(offsets):
            sets = hashing.shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            n = np.array([len(x) for x in sets])
            full = np.flatnonzero(n)
            keys, bands = np.zeros((len(n), 2), np.uint64), np.zeros((len(n), 2 * BANDS), np.uint64)
            if len(full):
                keys[full], bands[full] = signatures([sets[i] for i in full])
            side = [pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(np.ascontiguousarray(x).view(np.int64).ravel())) for x in (bands[:, :BANDS], bands[:, BANDS:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(keys[:, 0].copy().view(np.int64)), pa.array(keys[:, 1].copy().view(np.int64)), *(x.cast(band) for x in side)],
                ["doc_id", "n_shingles", "k1", "k2", "a", "b"],
            )


def _sets(batches):
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        rest = batch.drop_columns(["text"])
        for a, b in blocks(offsets):
            sets = hashing.shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([*(x.slice(a, b - a) for x in rest.columns), pa.array([x.tobytes() for x in sets], pa.binary())], [*rest.schema.names, "shingles"])


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0


def linked(ids: list[int], sets: list[np.ndarray], percent: int, known: list[int] | None = None) -> list[tuple[int, int]]:
    """(id, least id) for each member of a component of more than one id.

    known numbers the members' components as far as they are known; pairs of one are not compared.
    """
    n = len(ids)
    sizes = np.array([len(x) for x in sets])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(flat, np.cumsum(sizes)[:-1])
    group = np.unique(known, return_inverse=True)[1] if known is not None else np.arange(n)
    left, out = np.arange(n), []
    mark = np.zeros(len(values), bool)
    while len(left):
        whole = group[left] == group[left[0]]
        found = left[whole].tolist()
        queue = list(found)
        left = left[~whole]
        flat = np.concatenate([own[i] for i in left]) if len(left) else np.zeros(0, np.int64)
        while queue and len(left):
            i = queue.pop()
            mark[own[i]] = True
            both = np.add.reduceat(mark[flat], np.concatenate(([0], np.cumsum(sizes[left])[:-1])), dtype=np.int64)
            mark[own[i]] = False
            hit = 100 * both >= percent * (sizes[left] + sizes[i] - both)
            if hit.any():
                hit = np.isin(group[left], group[left[hit]])
                found += (new := left[hit].tolist())
                queue += new
                flat = flat[np.repeat(~hit, sizes[left])]
                left = left[~hit]
        if len(found) > 1:
            least = min(ids[i] for i in found)
            out += [(ids[i], least) for i in found]
    return out


def _stars(percent: int):
    """u, v, like, zone of members u and their centre v; rows come by centre and salt, the centre's sets first.

    zone is their distance in units of the threshold's distance. An id may have several
    sets: any of them can be like, and zones are those to the centre's least set.
    """
    unit = max(1, 100 - percent)

    def run(batches):
        key, centres = None, []
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(x).to_pylist() for x in ("v", "salt", "member", "rid")]
            for *now, member, i, x in zip(*columns, batch.column("shingles"), strict=True):
                if now != key:
                    key, centres = now, []
                x = np.frombuffer(x.as_buffer(), np.uint64)
                if not member:
                    centres = sorted([*centres, x], key=lambda c: (len(c), c.tobytes()))
                    continue
                both = [common(x, c) for c in centres]
                all_of = [len(x) + len(c) - n for c, n in zip(centres, both, strict=True)]
                like = any(100 * n >= percent * m for n, m in zip(both, all_of, strict=True))
                out.append((i, now[0], like, 100 * (all_of[0] - both[0]) // (unit * all_of[0])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.bool_(), pa.int32()), strict=True)], ["u", "v", "like", "zone"])

    return run


def _verify(percent: int):
    """(u, v) of components that links within a group join."""

    def run(batches):
        key, comps, sets = None, [], []

        def done():
            if len(set(comps)) > 1:
                found = {(c, least) for c, least in linked(comps, sets, percent, comps) if c != least}
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*sorted(found), strict=True)], ["u", "v"])

        for batch in batches:
            columns = [batch.column(x).to_pylist() for x in ("key", "block", "other", "comp")]
            for *now, comp, x in zip(*columns, batch.column("shingles"), strict=True):
                if now != key:
                    yield from done()
                    key, comps, sets = now, [], []
                comps.append(comp)
                sets.append(np.frombuffer(x.as_buffer(), np.uint64))
        yield from done()

    return run


def _star_edges(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v, like, zone for each member u of a bucket and its centre v, on the full sets; written."""
    edges = written(members.where("rid != v").select(F.col("rid").alias("u"), "v").distinct())
    salts = written(edges.groupBy("v").agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts")))
    large = small(salts.where("salts > 1"), BROADCAST_IDS)
    spokes = edges.join(large, "v", "left").select("v", F.pmod(F.hash("u"), F.coalesce("salts", F.lit(1))).alias("salt"), F.lit(1).alias("member"), F.col("u").alias("rid"))
    hubs = salts.select("v", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"), F.col("v").alias("rid"))
    rows = spokes.unionByName(hubs).join(sets, "rid")
    dealt = rows.repartition(partitions(members.sparkSession), "v", "salt").sortWithinPartitions("v", "salt", "member")
    return written(in_arrow(dealt.select("v", "salt", "member", "rid", "shingles"), _stars(percent), "u long, v long, like boolean, zone int"))


def _other_links(members: DataFrame, sets: DataFrame, edges: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Links between components, by members of a bucket, its centre apart, whose distances to the centre allow one; written."""
    rows = members.join(edges.select(F.col("u").alias("rid"), "v", "zone").distinct(), ["rid", "v"]).join(comps, F.col("rid") == F.col("id"), "left")
    rows = written(rows.select("key", "zone", "rid", "n_shingles", F.coalesce("root", "rid").alias("comp")))
    for _ in range(ROUNDS):
        mixed = rows.groupBy("key").agg(F.min("comp").alias("first"), F.max("comp").alias("last")).where("first != last").select("key")
        rows = rows.join(mixed, "key")
        often = rows.groupBy("rid").agg(F.count("*").alias("n")).where(F.col("n") >= SHARED).select("rid")
        rows = written(rows.join(often, "rid"))
    if not rows.limit(1).count():
        return rows.select(F.col("rid").alias("u"), F.col("comp").alias("v"))
    # A link is of one zone or two neighbours, and each pair of neighbours is a group.
    groups = rows.select("key", F.explode(F.array(F.col("zone"), F.col("zone") + 1)).alias("zone"), "rid", "n_shingles", "comp")
    groups = written(groups.select(F.xxhash64("key", "zone").alias("key"), "rid", "n_shingles", "comp"))
    least = groups.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("last")).where("least != last").drop("last")
    family = components(groups.select("key", "comp").distinct().join(least, "key").select(F.col("comp").alias("u"), F.col("least").alias("v")))
    groups = groups.join(family, F.col("comp") == F.col("id"), "left").withColumn("family", F.coalesce("root", "comp")).drop("id", "root")
    blocks = F.ceil(F.greatest(F.sum("n_shingles") / BLOCK_SHINGLES, F.count("*") / BLOCK_MEMBERS)).cast("int").alias("blocks")
    sizes = written(groups.select("family", "rid", "n_shingles").distinct().groupBy("family").agg(blocks).where("blocks > 1"))
    own = F.when(F.col("blocks").isNull(), F.xxhash64("family", F.lit("family"))).otherwise(F.col("key"))
    rows = groups.join(small(sizes, BROADCAST_IDS), "family", "left").select(own.alias("key"), "rid", "n_shingles", "comp").distinct()
    split = rows.groupBy("key").agg(
        F.min("comp").alias("first"), F.max("comp").alias("last"), F.count("*").alias("n"), F.sum(F.xxhash64("rid").cast("decimal(38,0)")).alias("print"), blocks,
    ).where("first != last")
    split = split.groupBy("n", "first", "last", "print").agg(F.min("key").alias("key"), F.max("blocks").alias("blocks"))  # groups of the same members once
    left = written(rows.join(split.select("key", "blocks"), "key"))
    by_comp = left.groupBy("key", "comp").agg(F.count("*").alias("n"))
    largest = by_comp.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("largest"), (F.sum("n") - F.max("n")).alias("rest"))
    marked = left.join(largest, "key").withColumn("others", F.greatest(F.lit(1), F.ceil(F.col("rest") / BLOCK_MEMBERS).cast("int")))
    own, other = F.pmod(F.hash("rid"), F.col("blocks")), F.pmod(F.hash("rid", F.lit(1)), F.col("others"))
    pair = lambda a, b: F.struct(a.cast("int").alias("block"), b.cast("int").alias("other"))
    each = lambda n: F.sequence(F.lit(0), n - 1)
    held = F.transform(each(F.col("others")), lambda x: pair(own, x))
    brought = F.when(F.col("comp") != F.col("largest"), F.transform(each(F.col("blocks")), lambda x: pair(x, other))).otherwise(F.array().cast("array<struct<block:int,other:int>>"))
    tasks = marked.select("key", "rid", "comp", F.explode(F.array_distinct(F.concat(held, brought))).alias("x")).select("key", "x.block", "x.other", "rid", "comp")
    dealt = tasks.join(sets, "rid").repartition(partitions(members.sparkSession), "key", "block", "other").sortWithinPartitions("key", "block", "other")
    return written(in_arrow(dealt.select("key", "block", "other", "comp", "shingles"), _verify(percent), "u long, v long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Links join texts whose sets of five-word shingles (A-Z lower-cased) have a Jaccard
    similarity of at least percent / 100, confirmed on the full sets. component_id is
    the least id that is reachable; kept marks the row that stays. Null and wordless
    texts are linked with nothing and kept. Texts of under five words are one shingle.
    Very long texts are whole. Rows that share an id count as one document. A null id
    takes no part: component_id is null and the row is kept. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(in_arrow(docs, _sign, "doc_id long, n_shingles long, k1 long, k2 long, a array<long>, b array<long>"))
    some = rows.where("n_shingles > 0 and doc_id is not null")
    classes = written(some.groupBy("n_shingles", "k1", "k2").agg(F.min_by(F.struct("doc_id", "a", "b"), "doc_id").alias("x")).select("n_shingles", "k1", "k2", F.col("x.doc_id").alias("rid"), "x.a", "x.b"))
    band = classes.select("rid", F.posexplode("a").alias("i", "x"))
    common = band.groupBy("i", "x").count().where("count > 1").drop("count")
    keys = (
        band.join(common, ["i", "x"])
        .join(classes.select("rid", "n_shingles", "b"), "rid")
        .select("rid", "n_shingles", "i", "x", F.posexplode("b").alias("j", "y"))
        .select("rid", "n_shingles", F.xxhash64("i", "x", "j", "y").alias("key"))
    )
    centre = keys.groupBy("key").agg(F.min("rid").alias("v"), F.max("rid").alias("top")).where("v != top").drop("top")
    members = written(keys.join(centre, "key"))
    wanted = members.select("rid").distinct()
    texts = docs.join(wanted.hint("shuffle_hash"), F.col("doc_id") == F.col("rid")).select("rid", "text")
    sets = written(in_arrow(texts, _sets, "rid long, shingles binary").where("length(shingles) > 0"))
    edges = _star_edges(members, sets, percent)
    links = edges.where("like").select("u", "v")
    final = components(links)
    more = _other_links(members, sets, edges, final, percent)
    if more.limit(1).count():
        final = components(links.unionByName(more))
    classes = classes.join(final, F.col("rid") == F.col("id"), "left").select("n_shingles", "k1", "k2", F.coalesce("root", "rid").alias("component"))
    return (
        rows.drop("a", "b")
        .join(classes, ["n_shingles", "k1", "k2"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs' rows of which near_duplicates() keeps the document; of rows that share an id one stays."""
    found = written(near_duplicates(docs, percent=percent))
    gone = small(written(found.where("not kept").select("doc_id").distinct()), BROADCAST_IDS)
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    ids = found.where("kept and doc_id is not null")
    if ids.groupBy("doc_id").count().where("count > 1").limit(1).count():
        left = left.where("doc_id is null").unionByName(left.where("doc_id is not null").dropDuplicates(["doc_id"]))
    return left
