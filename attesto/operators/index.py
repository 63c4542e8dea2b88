"""The positional inverted index as tables: docs, postings, term_stats, doc_stats, corpus_stats; saved as segments of blocks.

A saved index is a manifest and the segments that it names. A segment holds its postings in blocks: those of one term in
one range of documents, in order of id, with the greatest count and the least length among them, so that a search knows
what a block can score before it reads it. Ranges hold documents of about one length, and are the same for all terms.
Deleted ids are a table beside the segments; whoever reads leaves them out, and a compaction merges all into one segment.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import partial, reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import token_count, tokens
from ..functions.udf import in_arrow
from .tables import exists, put, small, spread

#: Words of a file of a saved index, and documents of a range of one length, about.
FILE_ROWS, RANGE_DOCS = 4_000_000, 4096
#: Rows up to which deleted ids are broadcast: some 50 MB.
BROADCAST_IDS = 1_000_000
#: Places of words that are packed together, about, and those of blocks that a task holds at once or gives out at once.
PACK_PLACES, OPEN_PLACES, OUT_PLACES = 1_000_000, 1_000_000, 100_000
BLOCKS = "term string, range int, n int, tf int, length long, p array<struct<id: string, tf: int, length: long, positions: array<int>>>, bucket int"
CHUNKS = "bucket int, slot int, chunk binary"


@dataclass(frozen=True)
class Segment:
    """blocks(bucket, term, range, n, tf, length, p array of (id, tf, length, positions)); tf is the greatest, length the least of a block.

    ranges is what _range() was given for the segment's documents, 0 if that is not known.
    """

    number: int
    blocks: DataFrame
    buckets: int
    ranges: int = 0

    def of_terms(self, words: list[str]) -> DataFrame:
        """The terms' blocks. The bucket names folders, so others are not read."""
        wanted = [_bucket(w.encode(), self.buckets) for w in words]
        return self.blocks.where(F.col("bucket").isin(wanted) & F.col("term").isin(words)).drop("bucket")


@dataclass(frozen=True)
class Index:
    """docs(id, ...), postings(term, id, tf, length, positions), term_stats(term, df), doc_stats(id, length), corpus_stats(n, average).

    A loaded one has its segments, and gone(id, upto): ids deleted from segments up to a number.
    """

    docs: DataFrame
    postings: DataFrame
    term_stats: DataFrame
    doc_stats: DataFrame
    corpus_stats: DataFrame
    segments: tuple[Segment, ...] = ()
    gone: DataFrame | None = None
    saved: tuple[tuple[Segment, DataFrame, DataFrame, DataFrame], ...] = ()  # each segment's docs, frequencies and lengths
    parts: Callable[..., DataFrame] | None = None  # the postings as CHUNKS, for so many ranges, buckets and slots; from postings if None
    again: Callable[[DataFrame], Index] | None = None  # the same of other documents, taken as they are dealt

    def of_terms(self, words, ranges: DataFrame | None = None) -> DataFrame:
        """Postings of these terms; with ranges (segment, range), a few, only of documents in them: other blocks are not unpacked."""
        words = sorted(set(words))
        if not self.segments or not words:
            return of_terms(self.postings, words)
        parts = []
        for s in self.segments:
            rows = s.of_terms(words)
            if ranges is not None:
                rows = rows.join(F.broadcast(ranges.where(F.col("segment") == s.number).select("range")), "range", "left_semi")
            parts.append(_living(rows.select("term", F.inline("p")), s.number, self.gone))
        return reduce(DataFrame.unionByName, parts)

    def heads(self, words) -> DataFrame:
        """term, segment, range, n, tf, length of the terms' blocks, without what they hold."""
        words = sorted(set(words))
        return reduce(DataFrame.unionByName, [s.of_terms(words).select("term", F.lit(s.number).alias("segment"), "range", "n", "tf", "length") for s in self.segments])

    def df(self, term: str) -> DataFrame:
        """One row with the number of documents that hold term, 0 if none."""
        return self.term_stats.where(F.col("term") == term).agg(F.coalesce(F.sum("df"), F.lit(0)).cast("long").alias("df"))

    def posting(self, term: str) -> DataFrame:
        return self.of_terms([term]).orderBy("id")

    def doc(self, doc_id: str) -> DataFrame:
        """The document's row; an error if there is none."""
        found = self.docs.where(F.col("id") == doc_id)
        if not found.limit(1).count():
            raise KeyError(doc_id)
        return found

    def delete(self, ids: DataFrame | list[str]) -> Index:
        """The index without these documents; an unknown id is an error. What is saved stays as it is, see delete_saved()."""
        ids = _known(self, ids)
        if self.segments:
            more = ids.select("id", F.lit(self.segments[-1].number).alias("upto"))
            return _combined(self.saved, more if self.gone is None else self.gone.unionByName(more))
        docs, postings, lengths = (x.join(ids, "id", "left_anti") for x in (self.docs, self.postings, self.doc_stats))
        return Index(docs, postings, term_stats(postings), lengths, corpus_stats(lengths))

    def save(self, path: str) -> None:
        """Writes the index as one segment; what was saved there before is replaced when all is written."""
        spark = self.docs.sparkSession
        before = _manifest(spark, path) if exists(spark, f"{path}/manifest.json") else {"next": 0}
        number = before["next"]
        _write_segment(self, path, number)
        _commit(spark, path, {"next": number + 1, "segments": [number], "gone": []})

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        known = _manifest(spark, path)
        gone = spark.read.schema("id string, upto int").parquet(*[f"{path}/gone/{x}" for x in known["gone"]]) if known["gone"] else None
        return _combined([_read_segment(spark, path, n) for n in known["segments"]], gone)


def _manifest(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(f"{path}/manifest.json").collect()))


def _commit(spark: SparkSession, path: str, manifest: dict) -> None:
    """From here on readers see the new state; a writer that stopped before has changed nothing."""
    put(spark, f"{path}/manifest.json", json.dumps(manifest))


def _known(index: Index, ids: DataFrame | list[str]) -> DataFrame:
    if isinstance(ids, list):
        ids = index.docs.sparkSession.createDataFrame([(x,) for x in ids], "id string")
    unknown = ids.join(index.docs, "id", "left_anti").limit(1).collect()
    if unknown:
        raise KeyError(unknown[0].id)
    return ids.select("id").distinct()


def _living(rows: DataFrame, number: int, gone: DataFrame | None) -> DataFrame:
    """rows of a segment, without those of ids deleted from it."""
    if gone is None:
        return rows
    return rows.join(small(gone.where(F.col("upto") >= number).select("id"), BROADCAST_IDS), "id", "left_anti").select(*rows.columns)


@contextmanager
def _by_sorting(spark: SparkSession) -> Iterator[None]:
    """Lists are gathered from sorted rows within, and a task writes its few folders side by side, without sorting rows for it."""
    wanted = {"spark.sql.execution.useObjectHashAggregateExec": "false", "spark.sql.maxConcurrentOutputFileWriters": "8"}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _bucket(term: bytes, buckets: int) -> int:
    return crc32(term) % buckets


def _write_segment(index: Index, path: str, number: int) -> None:
    """Documents, lengths, blocks and frequencies, built once each: what follows from a table is read from what was written of it.

    One exchange of packed postings, and none of texts: blocks lie in buckets by term, so that a term reads one folder, and in
    slots by range, so that a term of all documents is many files; all numbers follow from the corpus' size.
    """
    spark, path = index.docs.sparkSession, f"{path}/segments/{number:06d}"
    written = lambda name: spark.read.parquet(f"{path}/{name}")
    put_down = lambda rows, name: rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
    put_down(spread(index.docs) if index.again else index.docs, "docs")
    if index.again:
        index = index.again(written("docs"))
    put_down(index.doc_stats, "doc_stats")
    n, total = written("doc_stats").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    # A chunk names its documents, so files grow in number by slots as well as by buckets: else a chunk of few words would have many documents.
    slots = max(1, -(-n // FILE_ROWS), round(0.5 * (total / FILE_ROWS) ** 0.5))
    buckets = max(8, -(-total // (FILE_ROWS * slots)))
    wanted = max(1, n // RANGE_DOCS)
    # Ranges of a segment that are about as large as they should be are kept, so a compaction takes its blocks as they are.
    ranges = max((s.ranges for s in index.segments if wanted <= 2 * s.ranges and s.ranges <= 2 * wanted), default=wanted)
    chunks = index.parts(ranges, buckets, slots) if index.parts else _packed(_singles(index.postings, ranges), buckets, slots)
    dealt = chunks.repartitionById(int(buckets * slots), (F.col("bucket") * slots + F.col("slot")).cast("int"))
    with _by_sorting(spark):
        # Parquet's second format stores runs of numbers as differences.
        in_arrow(dealt, _opened, BLOCKS).write.mode("overwrite").options(**{"parquet.writer.version": "v2", "compression": "zstd"}).partitionBy("bucket").parquet(f"{path}/blocks")
    stats = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("term").agg(F.sum("n").alias("df"))
    put_down(stats.withColumns({"folders": F.lit(int(buckets)), "ranges": F.lit(int(ranges))}), "term_stats")


def _range(ranges: int):
    """A document's range, by its length and id."""
    band = F.floor(2 * F.log2(F.col("length") + 1)).cast("int")
    return F.shiftleft(band, 24) + F.pmod(F.xxhash64("id"), F.lit(ranges)).cast("int")


def _singles(postings: DataFrame, ranges: int) -> DataFrame:
    """Blocks of one posting each, as _kept_blocks() has them."""
    return postings.select("term", _range(ranges).alias("range"), F.array(F.struct("id", "tf", "length", "positions")).alias("p"), F.lit(None).cast("array<string>").alias("lost"))


def _kept_blocks(segment: Segment, lengths: DataFrame, gone: DataFrame | None) -> DataFrame:
    """term, range, p of the segment's blocks, and lost: the deleted ids of the range. So ids meet blocks, and no posting is moved for them."""
    rows = segment.blocks.select("term", "range", "p")
    if gone is None:
        return rows.withColumn("lost", F.lit(None).cast("array<string>"))
    lost = gone.where(F.col("upto") >= segment.number).select("id").distinct()
    few = lost.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    lost = lengths.join(F.broadcast(lost) if few else lost, "id", "left_semi").select(_range(segment.ranges).alias("range"), "id").groupBy("range").agg(F.collect_list("id").alias("lost"))
    return rows.join(F.broadcast(lost) if few else lost, "range", "left").select(*rows.columns, "lost")


def _packed(rows: DataFrame, buckets: int, slots: int) -> DataFrame:
    """CHUNKS of blocks, as _kept_blocks() has them, without the lost ids."""
    return in_arrow(rows.select("term", "range", "p", "lost"), partial(_blocks_in_chunks, buckets=buckets, slots=slots, places=PACK_PLACES), CHUNKS)


def _held(batches: Iterator[pa.RecordBatch], places: Callable[[pa.RecordBatch], int], most: int) -> Iterator[pa.Table]:
    """Batches together, as soon as they hold so many places."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += places(batch)
        if n >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    held.clear()
    pa.default_memory_pool().release_unused()  # a worker stays for later tasks


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _texts_in_chunks(batches: Iterator[pa.RecordBatch], buckets: int, slots: int, places: int) -> Iterator[pa.RecordBatch]:
    """Of documents (id, range, words), a row for each bucket and slot of some of them, with what CHUNKS says."""
    for table in _held(batches, lambda b: len(b.column(2).flatten()), places):
        ids, ranges, words = map(_whole, table.columns)
        sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)
        coded = words.flatten().dictionary_encode()
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        place = np.arange(len(doc), dtype=np.int32) - np.repeat(np.cumsum(sizes, dtype=np.int32) - sizes, sizes)
        yield _chunks(coded.dictionary, coded.indices.to_numpy(), doc, place, ids, ranges.to_numpy(), sizes, buckets, slots)


def _blocks_in_chunks(batches: Iterator[pa.RecordBatch], buckets: int, slots: int, places: int) -> Iterator[pa.RecordBatch]:
    """Of blocks (term, range, p, lost), the same, without lost ids."""
    for table in _held(batches, lambda b: len(b.column(2).flatten().field("positions").flatten()), places):
        terms, ranges, p, lost = map(_whole, table.columns)
        flat, gone = p.flatten(), lost.flatten().unique()
        owner = np.repeat(np.arange(len(p), dtype=np.int32), p.value_lengths().to_numpy())
        if len(gone):
            keep = pc.invert(pc.is_in(flat.field("id"), value_set=gone))
            flat, owner = flat.filter(keep), owner[keep.to_numpy(zero_copy_only=False)]
        coded, ids = terms.dictionary_encode(), flat.field("id").dictionary_encode()
        doc, tf, positions = ids.indices.to_numpy(), flat.field("tf").to_numpy(), flat.field("positions").flatten()
        where, length = np.zeros(len(ids.dictionary), np.int32), np.zeros(len(ids.dictionary), np.int64)
        where[doc], length[doc] = ranges.to_numpy()[owner], flat.field("length").to_numpy()
        yield _chunks(coded.dictionary, np.repeat(coded.indices.to_numpy()[owner], tf), np.repeat(doc, tf), positions.to_numpy(), ids.dictionary, where, length, buckets, slots)


def _order(*keys: np.ndarray) -> np.ndarray:
    """The order by these keys, the first one foremost; what is equal stays in order."""
    whole, span = keys[0].astype(np.int64), int(keys[0].max(initial=0)) + 1  # one number of them, in place
    for key in keys[1:]:
        n = int(key.max(initial=0)) + 1
        span *= n
        if span >= 1 << 62:
            return np.lexsort(keys[::-1])
        whole *= n
        whole += key
    return np.argsort(whole, kind="stable")


def _ranked(terms: pa.Array, ids: pa.Array, ranges: np.ndarray) -> tuple[np.ndarray, ...]:
    """The order of terms, that of documents by range and id, and the places that these orders give them."""
    orders = [pc.sort_indices(terms).to_numpy(), pc.sort_indices(pa.table({"range": pa.array(ranges), "id": ids}), sort_keys=[("range", "ascending"), ("id", "ascending")]).to_numpy()]
    ranks = [np.empty(len(x), np.int32) for x in orders]
    for x, rank in zip(orders, ranks):
        rank[x] = np.arange(len(x), dtype=np.int32)
    return *orders, *ranks


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a key differs from the one before."""
    return np.flatnonzero(np.logical_or.reduce([np.diff(k, prepend=-1) != 0 for k in keys]))


def _chunks(terms: pa.Array, code: np.ndarray, doc: np.ndarray, place: np.ndarray, ids: pa.Array, ranges: np.ndarray, lengths: np.ndarray, buckets: int, slots: int) -> pa.RecordBatch:
    """Places of words as CHUNKS, by term, range and id. code and doc say which of terms, and which of ids, ranges and lengths; a word's places in a document are in order."""
    folders = np.fromiter((_bucket(t, buckets) for t in terms.cast(pa.binary()).to_pylist()), np.int32, len(terms))
    by_term, by_doc, term_rank, doc_rank = _ranked(terms, ids, ranges)
    part, code, doc = (folders * slots)[code] + (ranges % slots).astype(np.int32)[doc], term_rank[code], doc_rank[doc]
    order = _order(part, code, doc)
    part, code, doc, place = part[order], code[order], doc[order], place[order]
    terms, ids, ranges, lengths = terms.take(pa.array(by_term)), ids.take(pa.array(by_doc)), ranges[by_doc], lengths[by_doc]
    cuts = np.append(_starts(part), len(part))
    packed = [_pack(terms, code[a:b], doc[a:b], place[a:b], ids, ranges, lengths) for a, b in zip(cuts[:-1], cuts[1:])]
    part = part[cuts[:-1]]
    return pa.RecordBatch.from_arrays([pa.array(part // slots, pa.int32()), pa.array(part % slots, pa.int32()), pa.array(packed, pa.binary())], ["bucket", "slot", "chunk"])


def _pack(terms: pa.Array, code: np.ndarray, doc: np.ndarray, place: np.ndarray, ids: pa.Array, ranges: np.ndarray, lengths: np.ndarray) -> bytes:
    """One chunk: its terms and documents once each, a term's documents by steps, counts and places, each in as few bytes as its largest number needs."""
    narrow = lambda x: pa.array(x.astype(np.min_scalar_type(int(x.max(initial=0)))))
    first = _starts(code, doc)
    tf, some = np.diff(np.append(first, len(code))), _starts(code[first])
    used, doc = np.unique(doc[first], return_inverse=True)
    steps = np.diff(doc, prepend=0)
    steps[some] = doc[some]
    taken = pa.array(used)
    columns = [terms.take(pa.array(code[first][some])), narrow(np.diff(np.append(some, len(first)))), narrow(steps), narrow(tf), narrow(place), ids.take(taken), narrow(ranges[used]), narrow(lengths[used])]
    row = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns], list("tnsfpirl"))
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(row)
    return out.getvalue().to_pybytes()


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of chunks, the blocks; all chunks of a bucket and slot follow each other."""
    held, at = [], None
    for batch in batches:
        for bucket, slot, chunk in zip(*(c.to_pylist() for c in batch.columns)):
            if at != (bucket, slot) and held:
                yield from _merged(held, at[0])
                held = []
            at = bucket, slot
            held.append(chunk)
    if held:
        yield from _merged(held, at[0])
    held.clear()
    pa.default_memory_pool().release_unused()


def _merged(chunks: list[bytes], bucket: int) -> Iterator[pa.RecordBatch]:
    """The blocks of a bucket and slot, by term and range. Where it has many places, it goes by some of the ranges after others."""
    parts = []
    n_terms = n_docs = 0
    for chunk in chunks:
        row = pa.ipc.open_stream(chunk).read_next_batch()
        terms, each, steps, tf, place, ids, ranges, lengths = (c.flatten() for c in row.columns)
        each, steps, tf, place, ranges, lengths = (x.to_numpy() for x in (each, steps, tf, place, ranges, lengths))
        some = np.cumsum(each, dtype=np.int64) - each
        doc = np.cumsum(steps, dtype=np.int64)
        doc -= np.repeat(doc[some] - steps[some], each)
        parts.append((terms, np.repeat(np.arange(n_terms, n_terms + len(terms), dtype=np.int32), each), (doc + n_docs).astype(np.int32), tf, place, ids, ranges.astype(np.int32), lengths.astype(np.int64)))
        n_terms, n_docs = n_terms + len(terms), n_docs + len(ids)
    terms, code, doc, tf, place, ids, ranges, lengths = (pa.concat_arrays(x) if isinstance(x[0], pa.Array) else np.concatenate(x) for x in zip(*parts))
    parts.clear()
    coded = terms.dictionary_encode()
    by_term, by_doc, term_rank, doc_rank = _ranked(coded.dictionary, ids, ranges)
    code, doc = term_rank[coded.indices.to_numpy()[code]], doc_rank[doc]
    terms, ids, ranges, lengths = coded.dictionary.take(pa.array(by_term)), ids.take(pa.array(by_doc)), ranges[by_doc], lengths[by_doc]
    turns = -(-len(place) // OPEN_PLACES)
    turn = np.arange(len(ranges)) * 0 if turns < 2 else np.cumsum(np.diff(ranges, prepend=-1) != 0) % turns
    for k in range(turns):
        if turns == 1:
            yield from _out(terms, code, doc, tf, place, ids, ranges, lengths, bucket)
        else:
            keep = turn[doc] == k
            yield from _out(terms, code[keep], doc[keep], tf[keep], place[np.repeat(keep, tf)], ids, ranges, lengths, bucket)


def _out(terms: pa.Array, code: np.ndarray, doc: np.ndarray, tf: np.ndarray, place: np.ndarray, ids: pa.Array, ranges: np.ndarray, lengths: np.ndarray, bucket: int) -> Iterator[pa.RecordBatch]:
    """The blocks of postings that may be in any order, in batches of bounded size."""
    order = _order(code, doc)
    starts = (np.cumsum(tf, dtype=np.int64) - tf)[order]
    code, doc, tf = code[order], doc[order], tf[order].astype(np.int32)
    bounds = np.append(0, np.cumsum(tf, dtype=np.int64))
    first = _starts(code, ranges[doc])
    cuts = np.append(first[_starts(bounds[first] // OUT_PLACES)], len(code))
    for a, b in zip(cuts[:-1], cuts[1:]):
        places = np.repeat(starts[a:b] - (bounds[a:b] - bounds[a]), tf[a:b]) + np.arange(bounds[b] - bounds[a])
        positions = pa.ListArray.from_arrays(pa.array((bounds[a : b + 1] - bounds[a]).astype(np.int32)), pa.array(place[places].astype(np.int32)))
        length, here = lengths[doc[a:b]], first[(first >= a) & (first < b)] - a
        p = pa.StructArray.from_arrays([ids.take(pa.array(doc[a:b])), pa.array(tf[a:b]), pa.array(length), positions], ["id", "tf", "length", "positions"])
        yield _blocks(terms.take(pa.array(code[a:b][here])), pa.array(ranges[doc[a:b][here]]), here, tf[a:b], length, p, bucket)


def _blocks(terms: pa.Array, ranges: pa.Array, first: np.ndarray, tf: np.ndarray, length: np.ndarray, postings: pa.StructArray, bucket: int) -> pa.RecordBatch:
    """BLOCKS of postings in order, the places of the first of each block, and their counts and lengths."""
    bounds = np.append(first, len(postings)).astype(np.int32)
    most, least = np.maximum.reduceat(tf, first), np.minimum.reduceat(length, first)
    columns = [terms, ranges, pa.array(np.diff(bounds), pa.int32()), pa.array(most, pa.int32()), pa.array(least, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), postings), pa.array(np.full(len(first), bucket, np.int32))]
    return pa.RecordBatch.from_arrays(columns, ["term", "range", "n", "tf", "length", "p", "bucket"])


def _read_segment(spark: SparkSession, path: str, number: int) -> tuple[Segment, DataFrame, DataFrame, DataFrame]:
    path = f"{path}/segments/{number:06d}"
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    stats = read("term_stats")
    if "folders" not in stats.columns:
        raise ValueError(f"{path} was saved by an older version, with other buckets; build it again")
    some = stats.select("folders", "ranges").first()
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    return Segment(number, blocks, some.folders if some else 1, some.ranges if some else 0), read("docs"), stats.drop("folders", "ranges"), read("doc_stats")


def _combined(read: Sequence[tuple[Segment, DataFrame, DataFrame, DataFrame]], gone: DataFrame | None) -> Index:
    """The index of these segments without what is gone. Frequencies are sums of the segments', less those of deleted documents."""
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    docs = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_living(d, s.number, gone) for s, d, _, _ in read])
    lengths = union([_living(n, s.number, gone) for s, _, _, n in read])
    postings = union([_living(s.blocks.select("term", F.inline("p")), s.number, gone) for s, *_ in read])
    stats = union([t for _, _, t, _ in read])
    if gone is not None:
        lost = union([s.blocks.select("term", F.inline(F.transform("p", lambda x: F.struct(x["id"].alias("id"))))).join(small(gone.where(F.col("upto") >= s.number).select("id").distinct(), BROADCAST_IDS), "id", "left_semi").select("term") for s, *_ in read])
        stats = stats.unionByName(lost.groupBy("term").agg((-F.count("*")).alias("df")))
    if len(read) > 1 or gone is not None:
        stats = stats.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")


    def parts(ranges: int, buckets: int, slots: int = 1) -> DataFrame:
        rows = [_kept_blocks(s, n, gone) if s.ranges == ranges else _singles(_living(s.blocks.select("term", F.inline("p")), s.number, gone), ranges) for s, _, _, n in read]
        return _packed(union(rows), buckets, slots)

    return Index(docs, postings, stats, lengths, corpus_stats(lengths), tuple(s for s, *_ in read), gone, tuple(read), parts)


def add_saved(spark: SparkSession, path: str, docs: DataFrame, analyzer=tokens, counter=None) -> None:
    """New documents as a segment of their own; an id that is there, and not deleted, is an error."""
    known = _manifest(spark, path)
    held = Index.load(spark, path)
    twice = assert_unique(docs).join(held.docs, "id", "left_semi").limit(1).collect()
    if twice:
        raise ValueError(f"repeated document id {twice[0].id!r}")
    _write_segment(build(docs, analyzer, counter), path, known["next"])
    _commit(spark, path, known | {"next": known["next"] + 1, "segments": [*known["segments"], known["next"]]})


def delete_saved(spark: SparkSession, path: str, ids: DataFrame | list[str]) -> None:
    """Deletes documents of a saved index: only their ids are written. An unknown id is an error."""
    known = _manifest(spark, path)
    name = uuid.uuid4().hex
    _known(Index.load(spark, path), ids).select("id", F.lit(max(known["segments"])).cast("int").alias("upto")).write.parquet(f"{path}/gone/{name}")
    _commit(spark, path, known | {"gone": [*known["gone"], name]})


def compact(spark: SparkSession, path: str) -> None:
    """Merges all segments into one, without the deleted documents. Readers of the old state can go on; its files stay."""
    known = _manifest(spark, path)
    _write_segment(Index.load(spark, path), path, known["next"])
    _commit(spark, path, {"next": known["next"] + 1, "segments": [known["next"]], "gone": []})


def of_terms(rows: DataFrame, words) -> DataFrame:
    return rows.where(F.col("term").isin(sorted(set(words)))) if words else rows.limit(0)


def term_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(doc_stats: DataFrame) -> DataFrame:
    """n counts documents without tokens too, and so does the average length; 0 without documents."""
    return doc_stats.agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("average"))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of documents and their words, a row for each document and word, with the word's places; a document's rows never leave its batch."""
    for batch in batches:
        ids, words = batch.column(0), batch.column(1)
        sizes = np.zeros(len(batch), np.int64)
        sizes[:] = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        ends = np.cumsum(sizes)
        doc = np.repeat(np.arange(len(batch)), sizes)
        place = np.arange(len(doc)) - np.repeat(ends - sizes, sizes)
        key = doc * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
        order = np.argsort(key, kind="stable")  # places stay in order
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        bounds = np.append(first, len(key))
        owner = doc[order][first]
        yield pa.RecordBatch.from_arrays(
            [
                coded.dictionary.take(pa.array(coded.indices.to_numpy()[order][first])), ids.take(pa.array(owner)), pa.array(np.diff(bounds), pa.int32()), pa.array(sizes[owner]),
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(place[order], pa.int32())),
            ],
            ["term", "id", "tf", "length", "positions"],
        )


def build(docs: DataFrame, analyzer=tokens, counter=None) -> Index:
    """docs has id and text. Positions start at 0 and are in order; ids must be unique.

    Words are grouped within their document, so no word is shuffled, only postings are when they are saved. A posting
    carries its document's length, so that scoring joins no table of all documents. counter gives the number of tokens
    where that is cheaper than to take them. The tables are plans; save() computes each once, and searches of more than
    one query are meant to run on a saved index.
    """
    return _built(docs, spread(docs.select("id", "text")), analyzer, counter or (token_count if analyzer is tokens else lambda text: F.size(analyzer(text)).cast("long")))


def _built(docs: DataFrame, texts: DataFrame, analyzer, counter) -> Index:
    """The index of docs, whose id and text are texts too, dealt as the tasks shall be."""
    postings = in_arrow(texts.select("id", analyzer(F.col("text")).alias("t")), _grouped, "term string, id string, tf int, length long, positions array<int>")
    lengths = texts.select("id", counter(F.col("text")).alias("length"))

    def parts(ranges: int, buckets: int, slots: int = 1) -> DataFrame:
        words = texts.select("id", analyzer(F.col("text")).alias("t")).withColumn("length", F.size("t"))
        return in_arrow(words.select("id", _range(ranges).alias("range"), "t"), partial(_texts_in_chunks, buckets=buckets, slots=slots, places=PACK_PLACES), CHUNKS)

    again = lambda others: _built(others, others.select("id", "text"), analyzer, counter)
    return Index(docs, postings, term_stats(postings), lengths, corpus_stats(lengths), parts=parts, again=again)


def assert_unique(docs: DataFrame) -> DataFrame:
    """docs; a repeated id is an error, here and not later as a wrong count."""
    twice = docs.groupBy("id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"repeated document id {twice[0].id!r}")
    return docs
