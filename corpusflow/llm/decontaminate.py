"""Benchmark decontamination: a prefix-filtered set join with exact windows.

Method, all in DataFrame functions:

1. Items are cut into windows of ``window`` consecutive words (a shorter item is
   one window), windows into shingles of ``shingle`` words.
2. One pass over the documents keeps the positions whose shingle occurs in the
   benchmark, with the few words around each.  The shingle set is joined in
   blocks of at most ``BLOCK`` hashes, so what is broadcast stays bounded
   however large the benchmark is.
3. The kept positions give each shingle's document frequency.  A window holds
   all its shingles, so its rarest one is a necessary prefix of length one;
   windows with a shingle of frequency zero are dropped at once.
4. Positions join the windows on the prefix shingle; the offset of the shingle
   gives the only possible start, the word count bounds it, and the words
   themselves are compared over the whole window.

Hashes only choose candidates; the comparison in step 4 is on words.

Defined results: null or wordless texts have no words and no hits; null or
wordless items have no window; items of one id are one item; rows repeated in
the documents each keep their row; an empty benchmark leaves every document
clean; extra columns are ignored.  Ids may be null: a null doc_id is a value of
its own, an item with a null id counts for hits but is not listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusflow.llm import helpers
from corpusflow.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shingle hashes broadcast at a time (8 bytes each), and windows broadcast at most (about 200 bytes each).
BLOCK, WINDOWS = 1_000_000, 100_000


def words(text: Column) -> Column:
    """A-Z lower-cased, then the runs outside ``\\x00-\\x2F \\x3A-\\x60 \\x7B-\\x7F``; null gives no words."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _shingle(parts: list[Column]) -> Column:
    return F.xxhash64(*parts)


def benchmark_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """(item_id, words, span, k): distinct windows of every item; k is the shingle length that fits it."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = w.select("item_id", "w", F.explode(F.expr(f"sequence(1, greatest(1, size(w) - {window} + 1))")).alias("j"))
    return (starts.select("item_id", F.expr(f"slice(w, j, {window})").alias("words")).distinct()
            .withColumn("span", F.size("words")).withColumn("k", F.least(F.lit(shingle), F.col("span"))))


def _window_shingles(wins: DataFrame, k: int) -> DataFrame:
    at = wins.filter(F.col("k") == k).select("item_id", "words", "span", F.explode(F.expr(f"sequence(0, span - {k})")).alias("o"))
    return at.select("item_id", "words", "span", "o", _shingle([F.expr(f"words[o + {i}]") for i in range(k)]).alias("sh"))


def _positions(docs: DataFrame, known: DataFrame | None, k: int, window: int, base: bool) -> DataFrame:
    """Positions of known k-shingles with the words around them; with ``base`` also one row per document (first word)."""
    w = docs.select("doc_id", "th", words(F.col("text")).alias("w"))
    if known is None:
        return w.select("doc_id", "th", F.size("w").alias("n"), F.lit(0).alias("p"), F.lit(None).cast("long").alias("sh"),
                        F.lit(None).cast("array<string>").alias("near"), F.lit(0).alias("from"), F.lit(True).alias("head"))
    zipped = F.arrays_zip(*[F.expr(f"slice(w, {i + 1}, greatest(size(w) - {i}, 0))").alias(f"c{i}") for i in range(k)])
    rows = w.select("doc_id", "th", "w", F.posexplode_outer(zipped).alias("p", "z"))
    rows = rows.select("doc_id", "th", "w", F.coalesce("p", F.lit(0)).alias("p"),
                       F.when(F.col(f"z.c{k - 1}").isNotNull(), _shingle([F.col(f"z.c{i}") for i in range(k)])).alias("sh"))
    rows = rows.join(F.broadcast(known), "sh", "left" if base else "inner")
    keep = F.col("known").isNotNull()
    first = f"greatest(p - {window - k}, 0)"
    return rows.filter(keep | (F.col("p") == 0) if base else keep).select(
        "doc_id", "th", F.size("w").alias("n"), "p", F.when(keep, F.col("sh")).alias("sh"),
        F.when(keep, F.expr(f"slice(w, {first} + 1, {2 * window - k})")).alias("near"), F.expr(first).alias("from"),
        (F.lit(base) & (F.col("p") == 0)).alias("head"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, th (hash of the text), n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    wins_at = scratch_path(spark, "windows")
    benchmark_windows(items, window, shingle).write.parquet(wins_at)
    wins = spark.read.parquet(wins_at)
    n_wins = wins.count()
    sizes = [r[0] for r in wins.select("k").distinct().orderBy(F.desc("k")).collect()]   # at most `shingle` numbers

    found, base = [], True
    for k in sizes:
        known = _window_shingles(wins, k).select("sh").distinct()
        blocks = -(-known.count() // BLOCK)
        for b in range(blocks):
            part = known if blocks == 1 else known.filter(F.pmod(F.hash("sh"), F.lit(blocks)) == b)
            found.append(_positions(docs, part.withColumn("known", F.lit(True)), k, window, base).withColumn("k", F.lit(k)))
            base = False
    if not found:
        found.append(_positions(docs, None, 0, window, True).withColumn("k", F.lit(0)))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    hits_at = scratch_path(spark, "positions")
    hits.write.parquet(hits_at)
    hits = spark.read.parquet(hits_at)
    rows = hits.filter("head").select("doc_id", "th", "n")
    hits = hits.filter("sh IS NOT NULL")

    matched = None
    counts = hits.groupBy("k", "sh").agg(F.count(F.lit(1)).alias("df"))
    for k in sizes:
        rarity = _window_shingles(wins, k).join(counts.filter(F.col("k") == k).drop("k"), "sh", "left")
        prefix = (rarity.groupBy("item_id", "words", "span")
                  .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "sh", "o")).alias("m"))
                  .filter("m.df > 0").select("item_id", "words", "span", "m.sh", "m.o"))
        if n_wins <= WINDOWS:
            prefix = F.broadcast(prefix)
        one = (hits.filter(F.col("k") == k).drop("k").join(prefix, "sh").withColumn("s", F.expr("p - o"))
               .filter("s >= 0 AND s + span <= n").filter("slice(near, s - from + 1, span) = words")
               .select("doc_id", "th", "s", "span", "item_id"))
        matched = one if matched is None else matched.unionByName(one)
    if matched is None:
        return rows.select("doc_id", "th", F.col("n").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
                           F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"),
                           F.lit(False).alias("contaminated"))

    # windows of a document by start: each adds the words beyond the furthest end before it
    spans = matched.groupBy("doc_id", "th", "s").agg(F.max("span").alias("span"), F.collect_set("item_id").alias("items"))
    spans = spans.selectExpr("*", "s + span AS e", "max(s + span) OVER (PARTITION BY doc_id, th ORDER BY s "
                             "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach")
    per_doc = spans.groupBy("doc_id", "th").agg(
        F.sum(F.expr("greatest(0, e - greatest(s, coalesce(reach, 0)))")).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    on = rows["doc_id"].eqNullSafe(per_doc["doc_id"]) & (rows["th"] == per_doc["th"])
    none = F.array().cast("array<string>")
    out = rows.join(per_doc, on, "left").select(
        rows["doc_id"], rows["th"], F.col("n").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", none).alias("items"))
    return out.select("doc_id", "th", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` without any benchmark window; all columns stay."""
    path = scratch_path(docs.sparkSession, "contaminated")
    contamination(docs, items, window, shingle).filter("contaminated").select(
        F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct().write.parquet(path)
    bad = helpers.checked_broadcast(docs.sparkSession.read.parquet(path))
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__th")), "left_anti")
