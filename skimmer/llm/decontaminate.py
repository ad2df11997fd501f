"""Benchmark decontamination: a broadcast hash set of test n-grams against the token windows of each text.

DataFrame functions only. Each word position is exploded straight into a broadcast hash join on the hash of the window that
begins there, all in one stage of generated code without a shuffle. Only hits are shuffled; each is verified by its words, and
ranges are merged by windows over the hits of a text, so time grows with their number.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skimmer.llm.common import col, fresh, let, scratch, table

# Fixed by the contract: words of lower-cased texts, and the same words before lower-casing.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z only; lower() also changes other letters, so it serves for ASCII texts alone."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))


def windows(bench: DataFrame, item_id: str, text: str, size: int) -> tuple[DataFrame, DataFrame]:
    """((wid, h, len, window) of each distinct window, (wid, item) of each item that has an id and the window)."""
    items = bench.select(col(item_id).alias("item"), words_of(col(text)).alias("words")).where(F.size("words") > 0)
    n = F.size("words")
    cut = F.when(n <= size, F.array("words")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.slice("words", i, F.lit(size))))
    each = scratch(items.select("item", F.explode(cut).alias("window")).withColumn("wid", F.md5(F.array_join("window", " "))).distinct())
    tests = each.select("wid", "window").distinct().select("wid", F.xxhash64("window").alias("h"), F.size("window").alias("len"), "window")
    return tests, each.where(F.col("item").isNotNull()).select("wid", "item")


def _key(doc_id: str, text: str) -> list[Column]:
    """Names a row; rows that repeat id and text share it, and so share their result."""
    return [col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(col(text), F.lit(""))).alias("text_hash")]


def scan(docs: DataFrame, tests: DataFrame, doc_id: str, text: str, broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    """((doc_id, text_hash, n_words) of each row, (doc_id, text_hash, start, end, wid) of each verified place of a window).

    Only hash and length of each window are broadcast (a dozen bytes a row), up to broadcast_rows of them, counted first; texts are
    then read and cut into words once, and each leaves a row of its own beside its hits. Beyond, positions are shuffled by window
    hash, without the words, and the words of texts with a hit are fetched again to verify."""
    count, lens = tests.agg(F.count("*"), F.sort_array(F.collect_set("len"))).first()
    few, keys = count <= broadcast_rows, tests.select("h", "len")
    n = F.size("words")
    # Plain array access in generated code: slice() copies the whole array, once for each window.
    window = lambda k: [F.get("words", F.col("start") + j) for j in range(k)]
    texts = docs.select(*_key(doc_id, text), words_of(col(text)).alias("words"))
    # Place -1 is the row itself. The outer form: for the inner one Catalyst adds a filter on the array and tokenises again to test it.
    met = texts.select("doc_id", "text_hash", "words", F.explode_outer(F.sequence(F.lit(-1 if few else 0), n - 1 if few else F.greatest(n - 1, F.lit(0)))).alias("start"))
    own = F.col("start") < 0
    met = met.where(own | (F.col("start") + min(lens, default=1) <= n))
    if len(lens) == 1:
        met = met.withColumn("h", F.when(~own, F.xxhash64(*window(lens[0]))))
    else:
        each = F.array(*(F.xxhash64(*window(k)) for k in lens)).cast("array<bigint>")
        met = met.withColumn("h", F.explode_outer(F.when(~own, each)))
    joined = lambda k: F.array(*window(k))
    if few:
        met = met.join(F.broadcast(keys), "h", "left").where(own | (F.col("start") + F.col("len") <= n))
        found = F.coalesce(*(F.when(F.col("len") == k, joined(k)) for k in lens), F.array().cast("array<string>"))
        met = scratch(met.select("doc_id", "text_hash", n.cast("long").alias("n_words"), "start", "h", "len", F.when(~own, found).alias("window")))
        base, met = met.where(own).select("doc_id", "text_hash", "n_words"), met.where(~own)
    else:
        base = texts.select("doc_id", "text_hash", n.cast("long").alias("n_words"))
        met = met.select("doc_id", "text_hash", "start", n.alias("n"), "h").join(keys, "h").where(F.col("start") + F.col("len") <= F.col("n"))
        places = scratch(met.select("doc_id", "text_hash", "start", "h", "len").distinct())
        some = places.select(F.col("doc_id").alias("own"), F.col("text_hash").alias("own_hash")).distinct()
        again = texts.join(some, texts.doc_id.eqNullSafe(some.own) & (texts.text_hash == some.own_hash), "left_semi").dropDuplicates(["doc_id", "text_hash"])
        again = again.select(F.col("doc_id").alias("own"), F.col("text_hash").alias("own_hash"), "words")
        met = places.join(again, places.doc_id.eqNullSafe(again.own) & (places.text_hash == again.own_hash)).select("doc_id", "text_hash", "start", "h", "len", F.slice("words", F.col("start") + 1, F.col("len")).alias("window"))
    met = met.join(tests.select("h", "window", "wid"), ["h", "window"])
    return base, scratch(met.select("doc_id", "text_hash", "start", (F.col("start") + F.col("len")).alias("end"), "wid"))


def _hits(met: DataFrame, owners: DataFrame) -> DataFrame:
    by = Window.partitionBy("doc_id", "text_hash").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    opened = met.withColumn("opens", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("span", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spans = opened.groupBy("doc_id", "text_hash", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"), F.sum((F.col("end") - F.col("start")).cast("long")).alias("n_hit"))
    # which items: once for each window of a text, after all else
    items = met.select(F.col("doc_id").alias("own"), F.col("text_hash").alias("own_hash"), "wid").distinct().join(owners, "wid")
    items = items.groupBy("own", "own_hash").agg(F.collect_set("item").alias("items"))
    both = spans.join(items, spans.doc_id.eqNullSafe(items.own) & (spans.text_hash == items.own_hash), "left")
    return both.select("doc_id", "text_hash", "spans", "n_hit", F.coalesce("items", F.array().cast(items.schema["items"].dataType)).alias("items"))


def hits(docs: DataFrame, bench: DataFrame, doc_id="doc_id", text="text", item_id="item_id", item_text="text", size: int = 13, broadcast_rows: int = 2_000_000) -> DataFrame:
    """(doc_id, text_hash, spans, n_hit, items) of each document with a hit. spans: merged ranges of word positions, end exclusive;
    items: the ids of items with a window there. Windows of items without an id count as hits, under no item. Rows that repeat an id
    (or have none) and a text are one document."""
    tests, owners = windows(bench, item_id, item_text, size)
    return _hits(scan(docs, tests, doc_id, text, broadcast_rows)[1], owners)


def report(docs: DataFrame, bench: DataFrame, doc_id="doc_id", text="text", item_id="item_id", item_text="text", size: int = 13, broadcast_rows: int = 2_000_000) -> DataFrame:
    """One row per row of docs, with its words, hits, items and whether it counts as contaminated.

    Null and empty texts have no words and no hits; a null document id is an id like others; an item without an id makes hits but is
    no item in n_items and items; an item without words is no test; an empty benchmark gives no hits; repeated rows get equal rows;
    other columns of either table are not read."""
    tests, owners = windows(bench, item_id, item_text, size)
    base, met = scan(docs, tests, doc_id, text, broadcast_rows)
    found = _hits(met, owners).withColumnsRenamed({"doc_id": "hit_id", "text_hash": "hit_hash"})
    both = base.join(found, base.doc_id.eqNullSafe(found.hit_id) & (base.text_hash == found.hit_hash), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.array_sort(F.transform(F.coalesce("items", F.array()), lambda x: x.cast("string")))
    return both.select(
        "doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "spans",
    )


def _named(found: DataFrame, docs: DataFrame, doc_id: str, text: str, *more: str):
    """(found under names that docs does not have, the condition that joins it to docs, the names of ``more``)."""
    given, hash_, *names = fresh(docs, "__id", "__hash", *(f"__{m}" for m in more))
    found = found.select(F.col("doc_id").alias(given), F.col("text_hash").alias(hash_), *(F.col(m).alias(x) for m, x in zip(more, names)))
    return found, col(doc_id).eqNullSafe(F.col(given)) & (F.xxhash64(F.coalesce(col(text), F.lit(""))) == F.col(hash_)), names


def drop_documents(docs: DataFrame, bench: DataFrame, doc_id="doc_id", text="text", **how) -> DataFrame:
    """docs without the contaminated rows, as report() has them; all columns stay, also those of a clashing name. Null ids and
    repeated rows are judged by their own text; an empty table stays empty."""
    bad, same, _ = _named(report(docs, bench, doc_id, text, **how).where("contaminated"), docs, doc_id, text)
    return docs.join(bad, same, "left_anti")


def drop_spans(docs: DataFrame, bench: DataFrame, doc_id="doc_id", text="text", **how) -> DataFrame:
    """docs with the hit words taken out of their texts; what stands between words stays. A null text stays null; repeated rows and
    rows without an id are treated alike if their texts are; an empty table stays empty; other columns stay."""
    found, same, (spans,) = _named(hits(docs, bench, doc_id, text, **how), docs, doc_id, text, "spans")
    both = docs.join(found, same, "left")

    def rebuilt(x: Column) -> Column:  # x.z: each word with what follows it; x.g: what follows each word
        ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
        part = lambda array, at, to: F.array_join(F.slice(array, at + 1, to - at), "")
        steps = F.transform(spans, lambda s, i: F.concat(part(x["z"], F.get(ends, i), s["start"]), part(x["g"], s["start"], s["end"])))
        return F.concat(x["head"], F.array_join(steps, ""), part(x["z"], F.element_at(ends, -1), F.size(x["z"])))

    gaps, own = F.split(col(text), ANY_CASE, -1), F.regexp_extract_all(col(text), F.lit(ANY_CASE), F.lit(0))
    after = let(gaps, lambda g: F.struct(F.element_at(g, 1).alias("head"), F.slice(g, F.lit(2), F.size(g)).alias("g")))
    pieces = let(after, lambda a: F.struct(a["head"].alias("head"), a["g"].alias("g"), F.zip_with(own, a["g"], lambda w, g: F.concat(w, g)).alias("z")))
    done = let(pieces, rebuilt)
    return both.select(*(F.when(F.col(spans).isNull(), col(c)).otherwise(done).alias(c) if c == text else col(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    found = report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE = r"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), tests AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i + 1 : i + least(len(w), 13)], ' ') AS win
  FROM items, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS r(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT k FROM tests),
places AS (
  SELECT doc_id, k, i, array_to_string(w[i + 1 : i + k], ' ') AS win
  FROM low, sizes, unnest(range(0, len(w) - k + 1)) AS r(i) WHERE len(w) >= k
), met AS (SELECT doc_id, i, k, item_id FROM places JOIN tests USING (k, win)),
words AS (SELECT DISTINCT doc_id, p FROM met, unnest(range(i, i + k)) AS r(p)),
h AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY 1),
t AS (SELECT doc_id, count(s) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM met) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM low LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
