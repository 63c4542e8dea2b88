"""Secret scans through an incremental ledger of text blobs; DataFrame functions only.

A blob is the content of one version of a document, addressed by its SHA-256. A ledger row
names a blob, the rules and versions that a scan tried on it, and what they found; no pair
of a blob and a rule version is in two rows. A scan reads only blobs and rule versions
that the ledger lacks, each blob once however many paths have it, and findings are joined
back to every path.

Spans come from one pass a rule: a regular expression brackets each match with marks that
are no characters, and the text, split at the marks, alternates between the rest and
matches. A running sum of the parts' lengths gives code-point positions, in time that is
linear in the parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import shielding, small, written

#: Blobs with findings, and spans of all of them, that are broadcast to the texts, some 200 bytes a blob and 40 a span; more are joined by a shuffle.
BROADCAST_BLOBS, BROADCAST_SPANS = 200_000, 1_000_000
#: Fixed values of the contract, in its order, then this module's own rules: kind, version,
#: pattern, group that is measured, its least length.
RULES = (
    ("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", 1, r"[0-9a-f]{24,}", 0, 24),
    ("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("jwt", 1, r"eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 0, 0),
    ("chat", 1, r"xox[abprs]-[A-Za-z0-9-]{15,}", 0, 20),
)
BASE = ("assign", "access", "hex")
KINDS = tuple(x[0] for x in RULES)
#: A noncharacter, and what stands for it where a text has it, of equal length.
MARK, STAND_IN = "\ufdd0", "\ufdd1"
VERSIONS = "array<struct<kind:string,version:int>>"
FOUND = "array<struct<kind:string,version:int,start:int,end:int>>"
#: Characters of the blocks that a text is cut into before runs are taken out of it.
BLOCK = 4096


def parts(text, pattern: str, group: int, least: int):
    """(n, hit) of the text's parts between and within the leftmost non-overlapping matches; hit if its group is long enough."""
    cut = F.split(F.regexp_replace(F.translate(text, MARK, STAND_IN), f"({pattern})", f"{MARK}$1{MARK}"), MARK, -1)
    measure = lambda x: F.length(F.regexp_extract(x, pattern, group)) if group else F.length(x)
    return F.transform(cut, lambda x, i: F.struct(F.length(x).alias("n"), ((i % 2 == 1) & (measure(x) >= least)).alias("hit")))


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """blob, scanned, found: a ledger row for each blob (blob, text) with the rules whose places are in its array todo."""
    tried, cut = [], []
    for i, (kind, version, pattern, group, least) in enumerate(rules):
        probe = pattern.replace("]+)", "]{%d,})" % least) if group else pattern  # matches at least where a span is
        name = (F.lit(kind).alias("kind"), F.lit(version).alias("version"))
        due = F.array_contains("todo", i)
        tried.append(F.when(due, F.struct(*name)))
        cut.append(F.when(due & F.col("text").rlike(probe), F.struct(*name, parts(F.col("text"), pattern, group, least).alias("parts"))))
    rows = written(blobs.select("blob", F.array_compact(F.array(*tried)).alias("scanned"), F.array_compact(F.array(*cut)).alias("cut")))
    each = rows.where(F.size("cut") > 0).select("blob", F.explode("cut").alias("c")).select("blob", "c.kind", "c.version", F.posexplode("c.parts").alias("at", "p"))
    before = F.sum("p.n").over(Window.partitionBy("blob", "kind", "version").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    hits = each.withColumn("start", F.coalesce(before, F.lit(0)).cast("int")).where("p.hit")
    span = F.struct("kind", "version", "start", (F.col("start") + F.col("p.n")).cast("int").alias("end"))
    found = written(hits.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("found")))
    return rows.select("blob", "scanned").join(_few(found, "found"), "blob", "left").select("blob", "scanned", F.coalesce("found", F.array().cast(FOUND)).alias("found"))


def _few(rows: DataFrame, spans: str) -> DataFrame:
    """rows of blobs to be broadcast if they, and all their spans together, are few; a blob may hold any number of spans."""
    blobs, held = rows.agg(F.count("*"), F.coalesce(F.sum(F.size(spans)), F.lit(0))).first()
    return F.broadcast(rows) if blobs <= BROADCAST_BLOBS and held <= BROADCAST_SPANS else rows


def blob_of(text: str = "text"):
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def _versions(rules):
    return [F.struct(F.lit(r[0]).alias("kind"), F.lit(r[1]).alias("version")) for r in rules]


def update(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES, id_col: str = "doc_id") -> DataFrame:
    """New rows of the ledger, written: blob, scanned, found; only for pairs of blob and rule version that it lacks.

    docs holds every version of every document, a row each. Of each unseen blob one path
    is scanned, that of the least id, and of rows that repeat one, for the rules that the
    ledger lacks. A null text is the empty blob; without a row there is no blob.
    """
    marked = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("at"), F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", blob_of())
    paths = marked.groupBy("blob", "at").agg(F.count("*").alias("n"))
    wanted = paths.groupBy("blob").agg(F.min(F.struct("at", "n")).alias("x")).select("blob", "x.at", "x.n")
    if ledger is None:
        wanted = wanted.withColumn("todo", F.array(*(F.lit(i) for i in range(len(rules)))))
    else:
        seen = ledger.select("blob", F.explode("scanned").alias("v")).groupBy("blob").agg(F.collect_set("v").alias("seen"))
        known = [F.array_contains("seen", v) for v in _versions(rules)]
        todo = F.array_compact(F.array(*(F.when(F.coalesce(~k, F.lit(True)), F.lit(i)) for i, k in enumerate(known))))
        wanted = wanted.join(seen, "blob", "left").select("blob", "at", "n", todo.alias("todo")).where(F.size("todo") > 0)
    wanted = written(wanted)
    blobs = marked.join(wanted.where("n = 1").drop("n").hint("shuffle_hash"), ["at", "blob"]).select("blob", "text", "todo")
    if wanted.where("n > 1").limit(1).count():  # rows of one id and text: one of them
        again = marked.join(small(wanted.where("n > 1").drop("n"), BROADCAST_BLOBS), ["at", "blob"])
        blobs = blobs.unionByName(again.groupBy("blob").agg(F.any_value("text").alias("text"), F.any_value("todo").alias("todo")))
    return written(scan(blobs, rules))


def complete(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> DataFrame:
    """The ledger with what it lacks of docs."""
    more = update(docs, ledger, rules)
    return more if ledger is None else ledger.select(*more.columns).unionByName(more)


def _found(ledger: DataFrame, rules) -> DataFrame:
    """blob, kind, start, end of what these rules' versions found."""
    rows = ledger.where(F.size("found") > 0).select("blob", F.inline("found"))
    return rows.where(F.array_contains(F.array(*_versions(rules)), F.struct("kind", "version"))).select("blob", "kind", "start", "end")


def findings(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> DataFrame:
    """Every row of docs as doc_id, blob and found; copies have equal findings, clean texts an empty array."""
    dirty = written(_found(complete(docs, ledger, rules), rules).groupBy("blob").agg(F.collect_list(F.struct("kind", "start", "end")).alias("found")))
    paths = docs.select(F.col("doc_id").cast("long").alias("doc_id"), blob_of().alias("blob"))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return paths.join(_few(dirty, "found"), "blob", "left").select("doc_id", "blob", F.coalesce("found", empty).alias("found"))


def _joined(found, kinds: tuple[str, ...]):
    """kind:start:end by start, then in the kinds' order, comma-joined."""
    order = F.create_map(*(x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))))
    kept = F.filter(found, lambda x: x["kind"].isin(*kinds))
    keyed = F.array_sort(F.transform(kept, lambda x: F.struct(x["start"].alias("start"), order[x["kind"]].alias("order"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secret_scan(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of docs.

    A null or empty text has no spans and the digest of nothing; a text of any length is scanned whole. Rows that repeat
    an id or a text have a row each, with equal findings, and a null id stays null. Columns besides doc_id and text are
    not read, whatever their names; an empty table gives an empty one.
    """
    found = findings(docs, ledger)
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(_joined(F.col("found"), BASE), 256).alias("base_sha256"), _joined(F.col("found"), KINDS).alias("spans"))


def _runs(rows: DataFrame) -> DataFrame:
    """blob and runs, an array of (start, end) in order: the unions of a blob's overlapping or touching spans."""
    order = Window.partitionBy("blob").orderBy("start", "end")
    rows = rows.withColumn("reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("run", F.count_if(F.col("reach").isNull() | (F.col("start") > F.col("reach"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = rows.groupBy("blob", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))


def without_runs(text, runs, placeholder: str):
    """The text with each run replaced. It is cut into blocks first, so that a piece is found without counting from the start."""
    held = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), 0)

    def piece(blocks, a, b):
        within = lambda j: F.substring(F.get(blocks, j), F.greatest(a - j * BLOCK, F.lit(0)) + 1, F.least(b - j * BLOCK, F.lit(BLOCK)) - F.greatest(a - j * BLOCK, F.lit(0)))
        whole = F.transform(F.sequence(F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")), within)
        return F.when(b > a, F.array_join(whole, "")).otherwise("")

    ends = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["end"]))
    starts = F.concat(F.transform(runs, lambda r: r["start"]), F.array(F.length(text)))
    joined = lambda blocks: F.array_join(F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda g: piece(blocks, g["a"], g["b"])), placeholder)
    return F.get(F.transform(F.array(held), joined), F.lit(0))


@shielding
def redacted(docs: DataFrame, ledger: DataFrame | None = None, placeholder: str = "[secret]") -> DataFrame:
    """docs with each run of found spans in its text replaced; other columns and clean texts stay as they are.

    Overlapping and touching spans are one run. Null texts stay null. A column n_chars
    follows the text.
    """
    dirty = written(_runs(_found(complete(docs, ledger), RULES)).select(F.col("blob").alias("__blob"), F.col("runs").alias("__runs")))
    text = F.when(F.col("__runs").isNotNull(), without_runs(F.col("text"), F.col("__runs"), placeholder)).otherwise(F.col("text"))
    rows = docs.withColumn("__blob", blob_of()).join(_few(dirty, "__runs"), "__blob", "left").withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("__runs").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
