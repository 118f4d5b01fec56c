"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item's windows are ``WINDOW`` consecutive words (a shorter item is one window). A window's
tokens are its five-word shingles (all of it, if shorter). One pass over the texts joins each
place's shingle with those of the benchmark, by hash and word by word, and keeps the few places
that match with one row per document. All else works on these:

* rarity: the count of each token over all documents;
* prefix: containment needs every token, so the necessary prefix is one, the rarest; a window that
  has a token of no document is ruled out;
* the token's place in the window gives the only possible start (positional bound), which must
  leave room for the window (length bound);
* verification: each of the window's tokens has to match at its own place, which covers the window
  word by word.

The benchmark's shingles are counted first and broadcast while they are few (``BROADCAST_SHINGLES``
and ``BROADCAST_BYTES``); beyond, both sides are shuffled by token, the documents' places with their
own five words (some ten times the text). Equal rows are counted, not
repeated, in between.

Defined results: a null or wordless text has no words, no hits and is not contaminated; items
without words have no window; repeated documents give repeated rows, repeated items count once;
a null item's id counts in no list; empty tables give no rows (documents) or no hits (benchmark);
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.lineage import cut
from cohortspark.llm.repeats import repeated

WINDOW = 13
SHINGLE = 5
BROADCAST_SHINGLES = 200_000
BROADCAST_BYTES = 32 << 20
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of digits, a-z (A-Z lowered) and all code points beyond ASCII; none for null."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _NOT_WORD)
    return F.array_remove(parts, "")


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``item, win`` (array of words), distinct."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - (window - 1), F.lit(1)))
    return items.select("item", "ws", F.explode(starts).alias("at")).select("item", F.slice("ws", F.col("at"), F.lit(window)).alias("win")).distinct()


def _token(at: Column, size: int, seed: int) -> Column:
    """The hash of the ``size`` words from a place on."""
    return F.xxhash64(F.lit(seed), F.lit(size), *(F.get("ws", at + k) for k in range(size)))


def window_tokens(windows: DataFrame) -> tuple[DataFrame, list[int]]:
    """``win, offset, token, words`` of distinct windows, and the sizes of shingles that there are.

    The hash is seeded so that different shingles of the benchmark have different tokens.
    """
    size = F.least(F.size("win"), F.lit(SHINGLE))
    places = windows.select(F.col("win").alias("ws"), size.alias("size")).distinct()
    places = places.select("ws", "size", F.explode(F.sequence(F.lit(0), F.size("ws") - F.col("size"))).alias("offset"))
    places = cut(places)
    sizes = sorted(r[0] for r in places.select("size").distinct().collect()) or [SHINGLE]
    for seed in range(100):
        token = F.coalesce(*(F.when(F.col("size") == s, _token(F.col("offset"), s, seed)) for s in sizes))
        words = F.slice("ws", F.col("offset") + 1, F.col("size"))
        found = places.select(F.col("ws").alias("win"), "offset", "size", token.alias("token"), words.alias("words"))
        found = found.withColumn("seed", F.lit(seed))
        if found.groupBy("token").agg(F.min("words").alias("a"), F.max("words").alias("b")).where("a <> b or token = 0").isEmpty():
            return found, sizes
    raise RuntimeError("no seed tells the benchmark's shingles apart")


def matched_places(texts: DataFrame, shingles: DataFrame, sizes: list[int], seed: int, small: bool) -> DataFrame:
    """``key, text_hash, n_words, at, token`` of ``key, text_hash, ws``: every place of a shingle of ``shingles``
    (``token, words``), and for each document a row whose ``at`` is -1."""
    mark = shingles.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("token"), F.lit(None).cast("array<string>").alias("words"))
    index = shingles.unionByName(mark)
    rows = texts.select("key", "text_hash", "ws", F.size("ws").alias("n_words"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(-1), F.col("n_words") - 1)).alias("at"))
    own = F.col("at") == -1
    hashed = [F.when(F.col("at") + s <= F.col("n_words"), _token(F.col("at"), s, seed)) for s in sizes]
    if len(sizes) == 1:
        rows = rows.withColumn("token", F.when(own, F.lit(0).cast("bigint")).otherwise(hashed[0]))
    else:
        rows = rows.withColumn("token", F.explode(F.when(own, F.array(F.lit(0).cast("bigint"))).otherwise(F.array(*hashed))))
    size = F.size("words")
    here = F.slice("ws", F.greatest(F.col("at"), F.lit(0)) + 1, F.greatest(size, F.lit(1)))
    if not small:  # what is shuffled has the words of its own place only
        longest = F.slice("ws", F.greatest(F.col("at"), F.lit(0)) + 1, F.lit(max(sizes)))
        rows = rows.select("key", "text_hash", "n_words", "at", "token", F.when(~own, longest).alias("own_words"))
        here = F.slice("own_words", F.lit(1), F.greatest(size, F.lit(1)))
    rows = rows.join(F.broadcast(index) if small else index, "token")
    keep = F.when(own, F.col("words").isNull()).otherwise(F.coalesce(here == F.col("words"), F.lit(False)))
    return rows.where(keep).select("key", "text_hash", "n_words", "at", "token")


def found_windows(places: DataFrame, tokens: DataFrame, small: bool) -> DataFrame:
    """``key, text_hash, start, win``: the windows of ``win, offset, token`` at the ``places`` of documents."""
    near = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    places = places.where("at >= 0").groupBy("key", "text_hash", "n_words", "at", "token").agg(F.count("*").alias("seen"))
    places = cut(places)
    rarity = cut(places.groupBy("token").agg(F.sum("seen").alias("seen")))
    ranked = tokens.join(near(rarity), "token", "left")
    prefix = ranked.groupBy("win").agg(
        F.min(F.struct("seen", "token", "offset")).alias("p"), F.count("*").alias("n"), F.count("seen").alias("n_seen")
    )
    prefix = prefix.where("n = n_seen").select("win", "n", F.col("p.token").alias("token"), F.col("p.offset").alias("offset"))
    start = F.col("at") - F.col("offset")
    candidates = places.join(near(prefix), "token").where((start >= 0) & (start + F.size("win") <= F.col("n_words")))
    candidates = candidates.select("key", "text_hash", start.alias("start"), "win", "n")
    needed = candidates.join(near(tokens.select("win", "offset", F.col("token").alias("need"))), "win")
    needed = needed.withColumn("place", F.col("start") + F.col("offset"))
    has = places.select(F.col("key").alias("k"), F.col("text_hash").alias("t"), "at", "token")
    both = needed.join(has, F.col("key").eqNullSafe(F.col("k")) & F.col("text_hash").eqNullSafe(F.col("t")) & (F.col("place") == F.col("at")) & (F.col("need") == F.col("token")))
    return both.groupBy("key", "text_hash", "start", "win", "n").agg(F.count("*").alias("met")).where("met = n").select("key", "text_hash", "start", "win")


def _covered() -> Column:
    """Words in the union of the spans (sorted by start)."""
    zero = F.lit(0)
    step = F.aggregate(
        "spans",
        F.struct(zero.alias("n"), zero.alias("to")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(zero, s["end"] - F.greatest(acc["to"], s["start"]))).alias("n"), F.greatest(acc["to"], s["end"]).alias("to")
        ),
    )
    return step["n"].cast("bigint")


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, one_in: int = 20,
) -> DataFrame:
    """``key, n_words, n_hit, n_items, items_sha256, contaminated`` of every document, and ``items``."""
    windows = cut(benchmark_windows(benchmark, item, item_text, window))
    tokens, sizes = window_tokens(windows)
    tokens = cut(tokens)
    seed = tokens.agg(F.max("seed")).first()[0] or 0
    shingles = tokens.select("token", "words").distinct()
    bounds = tokens.agg(F.count("*").alias("n"), F.sum(F.length(F.array_join("words", " "))).alias("chars"), F.sum(F.length(F.array_join("win", " "))).alias("wins")).first()
    small = bounds.n <= BROADCAST_SHINGLES and max(bounds.chars or 0, bounds.wins or 0) * 4 <= BROADCAST_BYTES
    texts = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), words(F.col(text)).alias("ws"))
    places = cut(matched_places(texts, shingles, sizes, seed, small))
    hits = found_windows(places, tokens.select("win", "offset", "token"), small)
    hits = hits.join(F.broadcast(windows) if small else windows, "win")
    span = F.struct("start", (F.col("start") + F.size("win")).alias("end"))
    none = F.lit(None)
    rows = hits.select("key", "text_hash", none.cast("int").alias("n_words"), span.alias("span"), "item", F.lit(0).alias("own"))
    own = places.where("at = -1").select(
        "key", "text_hash", "n_words", none.cast(rows.schema["span"].dataType).alias("span"), none.cast("string").alias("item"), F.lit(1).alias("own")
    )
    by_doc = rows.unionByName(own).groupBy("key", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.sum("own").alias("copies"),
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.collect_set("item")).alias("items"),
    )
    most = own.groupBy("key", "text_hash").count().agg(F.max("count")).first()[0] or 0
    out = by_doc.select("key", "text_hash", "copies", F.col("n_words").cast("bigint").alias("n_words"), _covered().alias("n_hit"), "items")
    out = repeated(out, "copies", most, ["key", "text_hash"])
    return out.select(
        F.col("key").alias(key),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words"))).alias("contaminated"),
        "items",
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
w AS (
  SELECT DISTINCT item, least(len(ws), 13) AS size, array_to_string(list_slice(ws, s, s + least(len(ws), 13) - 1), ' ') AS win
  FROM (SELECT item, ws, unnest(generate_series(1, greatest(len(ws) - 12, 1))) AS s FROM b WHERE len(ws) > 0)),
p AS (
  SELECT r, size, s, array_to_string(list_slice(ws, s, s + size - 1), ' ') AS win
  FROM (SELECT r, ws, size, unnest(generate_series(1, len(ws) - size + 1)) AS s
        FROM d, (SELECT DISTINCT size FROM w) WHERE len(ws) >= size)),
h AS (SELECT p.r, p.s, p.size, w.item FROM p JOIN w ON p.win = w.win AND p.size = w.size),
n AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + size - 1)) AS place FROM h) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item COLLATE C) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)
"""
