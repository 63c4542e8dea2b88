"""Windows over the segments of a video, and time windows of captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = r"^yt:(.+):seg(\d+)$"
CAPTION_SECONDS = 75


def window_starts(n, window: int, overlap: int):
    """Starts of windows over n items: as many as it takes until one reaches the end."""
    stride = window - overlap
    count = F.when(n <= window, F.lit(1)).otherwise(F.ceil((n - window) / stride).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * stride)


def sliding(rows: DataFrame, group: str, order, window: int, overlap: int = 0) -> DataFrame:
    """rows with start and place: a row for each window of its group that holds it, in order."""
    if window < 1 or not 0 <= overlap < window:
        raise ValueError("window must be at least 1 and overlap less than it")
    w = Window.partitionBy(group)
    numbered = rows.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(w).cast("int"))
    starts = F.filter(window_starts(F.col("__n"), window, overlap), lambda s: (s <= F.col("__i")) & (F.col("__i") < s + window))
    return numbered.withColumn("start", F.explode(starts)).withColumn("place", F.col("__i") - F.col("start")).drop("__i", "__n")


def chunk_corpus(docs: DataFrame, window: int = 1, overlap: int = 0) -> DataFrame:
    """Chunks of docs: windows over each video's segments in numeric order; other documents alone.

    A chunk has the first document's fields, the texts joined by spaces and the first id,
    with +w and the size asked for if it has more than one document.
    """
    if window < 1 or not 0 <= overlap < window:
        raise ValueError("window must be at least 1 and overlap less than it")
    fields = [c for c in docs.columns if c not in ("id", "text")]
    marked = docs.withColumn("__video", F.regexp_extract("id", SEGMENT, 1)).withColumn("__seg", F.regexp_extract("id", SEGMENT, 2).try_cast("long"))
    rest = marked.where("__video = ''").select(F.col("id").alias("chunk_id"), F.array("id").alias("doc_ids"), "text", *fields)
    if window == 1:
        videos = marked.where("__video <> ''").select(F.col("id").alias("chunk_id"), F.array("id").alias("doc_ids"), "text", *fields)
        return rest.unionByName(videos)
    placed = sliding(marked.where("__video <> ''"), "__video", ["__seg", "id"], window, overlap)
    parts = F.array_sort(F.collect_list(F.struct("place", "id", "text", *fields)))
    made = placed.groupBy("__video", "start").agg(parts.alias("p"))
    name = F.when(F.size("p") == 1, F.col("p")[0]["id"]).otherwise(F.concat(F.col("p")[0]["id"], F.lit(f"+w{window}")))
    text = F.array_join(F.transform("p", lambda x: x["text"]), " ")
    return rest.unionByName(made.select(name.alias("chunk_id"), F.col("p.id").alias("doc_ids"), text.alias("text"), *(F.col("p")[0][c].alias(c) for c in fields)))


def islands(rows: DataFrame, group: list[str], order: str, key: str, text: str) -> DataFrame:
    """group, island (from 1), key and the joined texts of each run of neighbours that share a key, null being a key like others."""
    at = Window.partitionBy(*group).orderBy(order)
    changed = ~F.col(key).eqNullSafe(F.lag(key).over(at)) | (F.row_number().over(at) == 1)
    marked = rows.withColumn("island", F.sum(changed.cast("int")).over(at))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(text).alias("text"))))
    runs = marked.groupBy(*group, "island", key).agg(parts.alias("p"))
    return runs.select(*group, "island", key, F.array_join(F.transform("p", lambda x: x["text"]), " ").alias(text))


def caption_windows(cues: DataFrame, seconds: int = CAPTION_SECONDS) -> DataFrame:
    """cues (video, ord, start, text) as one text for each window of time in which they start."""
    at = F.floor(F.col("start") / seconds).cast("int")
    parts = F.array_sort(F.collect_list(F.struct("ord", "text")))
    made = cues.groupBy("video", at.alias("window")).agg(parts.alias("p"))
    return made.select(
        F.concat(F.lit("yt:"), "video", F.format_string(":seg%03d", "window")).alias("id"),
        F.trim(F.array_join(F.transform("p", lambda x: x["text"]), " ")).alias("text"), "video", "window", (F.col("window") * seconds).alias("at_seconds"),
    )
