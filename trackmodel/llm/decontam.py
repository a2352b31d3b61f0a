"""Operator 1: benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Windows are ``WINDOW`` consecutive words of an item (a shorter item is one window). For a window to occur,
all its words must be in the document, so one necessary prefix word is enough to find it: words are ordered
by how often the documents use them, and each window is posted under its rarest word. Documents' words are
joined with those postings; length and position bounds drop windows that would stick out of the text; what
remains is verified word by word at its place.

Shuffles: word counts after map-side sums; candidates per document; one pass of the documents to verify.
Postings are broadcast only after they are counted, up to ``POSTINGS`` rows; beyond that the same join is
shuffled, and AQE splits what is skewed.

Null and empty texts have no words, hence no hits. A benchmark item without an id or without words is not
searched for. Documents are told apart by id and text: repeated rows each get their row, rows of one id
with different texts their own results. An empty benchmark marks nothing. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side, staged

WINDOW = 13
#: Postings that may be broadcast: (hash, offset, window) rows, about 200 bytes each.
POSTINGS = 50_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ascii_lower(word: Column) -> Column:
    return (F.when(F.octet_length(word) == F.length(word), F.lower(word))
            .otherwise(F.translate(word, UPPER, UPPER.lower())))


def raw_words(text: Column) -> Column:
    """Words before lower-casing; none for a null text."""
    return F.coalesce(F.array_remove(F.split(text, BETWEEN), ""), F.array().cast("array<string>"))


def item_windows(benchmark: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``item``, ``window`` (words joined by blanks), ``n`` (words in it): distinct."""
    words = benchmark.select(F.col(id_col).cast("string").alias("item"),
                             F.transform(raw_words(F.col(text_col)), ascii_lower).alias("words"))
    words = words.filter(F.col("item").isNotNull() & (F.size("words") > 0))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (size - 1), F.lit(1)))
    slices = words.select("item", F.explode(F.transform(
        starts, lambda i: F.slice(F.col("words"), i, F.lit(size)))).alias("words"))
    return slices.select("item", F.array_join("words", " ").alias("window"), F.size("words").alias("n")).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = 20, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``id_col, n_words, n_hit, n_items, items`` (sorted ids), ``contaminated``, and ``text_hash``.

    Contaminated: a hit, and at least one word in ``share`` inside an occurring window.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    base = base.withColumn("text_hash", F.xxhash64("text"))
    items = staged(item_windows(benchmark, size, item_col, item_text_col), "windows")
    windows = items.select("window", "n").distinct()

    # Rarity: how often the documents use each word of the windows.
    word = F.xxhash64(ascii_lower(F.col("word"))).alias("h")
    places = base.select("id", "text_hash", raw_words(F.col("text")).alias("words"))
    places = places.select("id", "text_hash", F.size("words").alias("n_words"),
                           F.posexplode_outer("words").alias("pos", "word"))
    places = places.filter("word is not null").select("id", "text_hash", "n_words", "pos", word)
    tokens = windows.select("window", "n", F.posexplode(F.split("window", " ")).alias("offset", "word"))
    tokens = tokens.select("window", "n", "offset", word)
    vocabulary = small_side(tokens.select("h").distinct(), POSTINGS)
    counts = places.select("h").join(vocabulary, "h", "left_semi").groupBy("h").agg(F.count(F.lit(1)).alias("uses"))

    # The rarest word of each window; a window with a word that no document uses cannot occur.
    ranked = tokens.join(counts, "h", "left").groupBy("window", "n").agg(
        F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "offset", "h")).alias("least"))
    postings = staged(ranked.filter("least.uses > 0").select(
        F.col("least.h").alias("h"), F.col("least.offset").alias("offset"), "n", "window"), "postings")

    # Candidates within length and position bounds, gathered per document.
    found = places.join(small_side(postings, POSTINGS), "h").select(
        "id", "text_hash", "n_words", (F.col("pos") - F.col("offset")).alias("start"), "n", "window")
    found = found.filter("start >= 0 and start + n <= n_words")
    candidates = found.groupBy("id", "text_hash").agg(F.collect_set(F.struct("start", "n", "window")).alias("cand"))
    candidates = candidates.select(F.col("id").alias("c_id"), F.col("text_hash").alias("c_hash"), "cand")

    # Exact containment at the place, on the document's own words.
    joined = base.join(candidates, F.col("id").eqNullSafe(F.col("c_id")) & (F.col("text_hash") == F.col("c_hash")), "left")
    seen = joined.select("id", "text_hash", "cand", raw_words(F.col("text")).alias("words"))
    seen = seen.select("id", "text_hash", "cand", "words", F.size("words").alias("n_words"))
    hits = F.filter("cand", lambda c: F.array_join(F.transform(F.slice(
        F.col("words"), c["start"] + 1, c["n"]), ascii_lower), " ") == c["window"])
    seen = seen.select("id", "text_hash", "n_words", hits.alias("hits"))
    covered = F.array_distinct(F.flatten(F.transform(
        "hits", lambda c: F.sequence(c["start"], c["start"] + c["n"] - 1))))
    seen = staged(seen.select(
        "id", "text_hash", F.col("n_words").cast("long").alias("n_words"),
        F.coalesce(F.size(covered), F.lit(0)).cast("long").alias("n_hit"),
        F.array_distinct(F.transform("hits", lambda c: c["window"])).alias("windows")), "verified")

    named = (seen.filter(F.size("windows") > 0).select("id", "text_hash", F.explode("windows").alias("window")).distinct()
             .join(items.select("item", "window"), "window")
             .groupBy(F.col("id").alias("c_id"), F.col("text_hash").alias("c_hash"))
             .agg(F.sort_array(F.collect_set("item")).alias("items")))
    out = seen.join(named, F.col("id").eqNullSafe(F.col("c_id")) & (F.col("text_hash") == F.col("c_hash")), "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias(id_col), "n_words", F.when(F.col("n_hit") > 0, F.col("n_hit")).otherwise(0).cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"), listed.alias("items"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "text_hash")
