"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window is ``WINDOW`` consecutive words of a benchmark item (all words of a shorter item), taken as the set of its shingles of
``SHINGLE`` words (all words of a shorter window). To be contained whole, a window needs each of its shingles in the document,
so its necessary prefix is one of them: the first in the order of rarity, where a shingle is as rare as its rarest word over all
documents. Documents' shingles are joined with these prefix tokens; the position in the document and the token's offset in
the window bound where the window would lie, and only windows that fit are verified word by word.

The benchmark's side is broadcast while it is small (a checked size). Beyond that only documents' keys, positions and tokens are shuffled;
the candidates that fit are gathered by document, and the texts are joined with them and verified there, so no words of a text
go along with its tokens. Tables that are joined are written first, so that the adaptive skew join can split a token or
document that many rows have.

Tokens are hashes of words in Spark's full lower-casing, which is coarser than lower-casing A-Z and keeps word borders;
verification is of the words themselves, with A-Z lower-cased.

Cases: null or wordless texts have no words, no windows and no hits; texts of any length are read whole; windows that items
share count for each item, repeated items once by item_id; rows that share doc_id and text get equal rows; null doc_ids
are kept; null item_ids count as one item named by the empty string; empty tables give an empty result or no hits; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import Workspace, ascii_lower, documents, only

WINDOW, SHINGLE = 10, 3
#: Rows and bytes up to which the benchmark's side is broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Fixed value: everything that is in no word (after lower-casing A-Z).
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN, -1), "")


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Each distinct window with its length and the ids of its items."""
    items = only(benchmark, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(ascii_lower(F.col("text"))).alias("words"))
    items = items.where(F.size("words") > 0).withColumn("start", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - size))))
    return items.select("item", F.slice("words", F.col("start") + 1, F.lit(size)).alias("w")).groupBy("w").agg(F.collect_set("item").alias("items"))


def is_small(df: DataFrame, size: Column) -> bool:
    """Whether a written table can be broadcast, by its rows and the bytes of its widest column."""
    rows, total = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and total <= BROADCAST_BYTES


def shingle_tokens(words: Column, sizes: list[int]) -> Column:
    """(pos, token) of a text's shingles of the given sizes, in order."""
    n = F.size(words)
    runs = F.arrays_zip(*[F.slice(words, k + 1, n).alias(f"w{k}") for k in range(max(sizes))])
    return F.posexplode(runs)


def tokens_of(df: DataFrame, sizes: list[int], *keep: str) -> DataFrame:
    """The kept columns with each shingle's pos and token, from ``words``. They are lower-cased one by one: some letters' lower case
    depends on what follows them."""
    each = df.select(*keep, shingle_tokens(F.col("words"), sizes).alias("pos", "run"))
    parts = []
    for k in sizes:  # a shingle is whole if its last word is there
        whole = F.col(f"run.w{k - 1}").isNotNull() if k > 1 else F.lit(True)
        parts.append(F.when(whole, F.xxhash64(F.lit(k), *[F.lower(f"run.w{i}") for i in range(k)])))
    if len(parts) == 1:
        return each.select(*keep, "pos", parts[0].alias("token")).where("token IS NOT NULL")
    return each.select(*keep, "pos", F.explode(F.array(*parts)).alias("token")).where("token IS NOT NULL")


def prefixes(docs: DataFrame, benchmark: DataFrame, ws: Workspace, size: int = WINDOW) -> tuple[DataFrame, bool, list[int]]:
    """Each window that can occur, with its prefix token and the token's offset; whether they are few; the sizes of the tokens."""
    wins = ws.stage(windows(benchmark, size), "windows")
    word = wins.select(F.explode("w").alias("word")).select(F.lower("word").alias("word")).distinct()
    vocabulary = ws.stage(word, "vocabulary")
    found = docs.select(F.explode(words_of(F.col("text"))).alias("word")).select(F.lower("word").alias("word"))
    if is_small(vocabulary, F.octet_length("word")):
        found = found.join(F.broadcast(vocabulary), "word")
        counts = found.groupBy("word").agg(F.count("*").alias("n"))
    else:  # counted first, so that each word of a task is shuffled once
        counts = found.groupBy("word").agg(F.count("*").alias("n")).join(vocabulary, "word", "left_semi")
    counts = ws.stage(counts, "counts")
    each = wins.select("w", F.posexplode("w").alias("at", "word")).select("w", "at", F.lower("word").alias("word"))
    ranked = each.join(counts, "word", "left").groupBy("w").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n"), "word"))), lambda x: F.struct(x["n"].alias("n"), x["word"].alias("word"))).alias("by"))  # a window's words
    k = F.least(F.size("w"), F.lit(SHINGLE))
    rarity = F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.struct(F.array_min(F.transform(F.slice("by", i + 1, k), lambda x: x["n"])).alias("n"), i.alias("offset")))
    chosen = ranked.where("size(filter(by, x -> x.n = 0)) = 0").withColumn("rare", F.array_min(rarity)).join(wins, "w")
    run = F.transform(F.slice("by", F.col("rare.offset") + 1, k), lambda x: x["word"])
    token = F.coalesce(*[F.when(k == j, F.xxhash64(F.lit(j), *[F.get(run, F.lit(i)) for i in range(j)])) for j in range(1, SHINGLE + 1)])
    chosen = chosen.select(token.alias("token"), F.col("rare.offset").alias("offset"), F.size("w").alias("len"), k.alias("k"), F.concat_ws(" ", "w").alias("window"), "items")
    chosen = ws.stage(chosen, "prefixes")
    sizes = sorted(r.k for r in chosen.select("k").distinct().collect())  # at most SHINGLE numbers
    return chosen.drop("k"), is_small(chosen, F.octet_length("window") + F.octet_length(F.concat_ws(",", "items"))), sizes


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, hits_only: bool = False) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated of each document. With ``hits_only`` doc_id, text_key (a hash
    of the text) and n_hit of contaminated documents only."""
    ws = Workspace(docs.sparkSession, "decontam")
    src = only(docs, "doc_id", "text")
    src = src.select(src["doc_id"].cast("bigint").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("text_key"))
    chosen, few, sizes = prefixes(src, benchmark, ws, size)
    start = F.col("pos") - F.col("offset")
    same = lambda words, at: ascii_lower(F.concat_ws(" ", F.slice(words, at["start"] + 1, at["len"]))) == at["window"]
    at = F.struct(start.alias("start"), "len", "window")
    if not sizes:
        hits = src.select("doc_id", "text_key", F.lit(0).alias("start"), F.lit(0).alias("len"), F.array().cast("array<string>").alias("items")).limit(0)
    elif few:
        rows = src.select("doc_id", "text_key", words_of(F.col("text")).alias("words"))
        near = tokens_of(rows, sizes, "doc_id", "text_key", "words").join(F.broadcast(chosen), "token").where(start >= 0)
        hits = near.where(same(F.col("words"), at)).select("doc_id", "text_key", start.alias("start"), "len", "items")
    else:
        rows = src.select("doc_id", "text_key", words_of(F.col("text")).alias("words"))
        near = tokens_of(rows, sizes, "doc_id", "text_key").join(chosen, "token").where(start >= 0).select("doc_id", "text_key", at.alias("at"), "items").distinct()
        lists = ws.stage(near.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("at", "items")).alias("near")), "candidates")  # of one document
        texts = src.dropDuplicates(["doc_id", "text_key"]).alias("d")
        both = texts.join(lists.alias("c"), F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.text_key") == F.col("c.text_key"))).select("d.doc_id", "d.text_key", words_of(F.col("text")).alias("words"), "near")
        hits = both.select("doc_id", "text_key", F.explode(F.filter("near", lambda x: same(F.col("words"), x["at"]))).alias("x")).select("doc_id", "text_key", "x.at.start", "x.at.len", "x.items")
    spans = F.collect_set(F.struct("start", "len"))
    by_doc = hits.groupBy("doc_id", "text_key").agg(
        F.size(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1))))).cast("bigint").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("found"),
    )
    if hits_only:
        return by_doc.select("doc_id", "text_key", "n_hit")
    h = ws.stage(by_doc, "hits").alias("h")
    base = src.select("doc_id", "text_key", F.size(words_of(F.col("text"))).cast("bigint").alias("n_words")).alias("d")
    both = base.join(h, F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.text_key") == F.col("h.text_key")), "left")
    n_hit, found = F.coalesce("h.n_hit", F.lit(0).cast("bigint")), F.coalesce("h.found", F.array().cast("array<string>"))
    return both.select(
        F.col("d.doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(found).cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", found), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, list_slice(w, i + 1, i + 10) AS win FROM (SELECT item_id, w, unnest(range(0, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM bw),
dg AS (SELECT doc_id, n, i, list_slice(w, i + 1, i + n) AS win FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dg.doc_id, dg.i, dg.n, bw.item_id FROM dg JOIN bw ON dg.win = bw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
