"""Secret scans with corpus-wide ownership frequency. DataFrame functions only.

Candidates are found in each whole text by patterns; the text between matches gives their code point offsets. Each
candidate value is hashed, and hashes are counted over distinct repositories and owners of the whole corpus: a value that
many owners or repositories hold is a copied example, a value of few of both looks live. Base spans are always reported; spans of the
kind "opaque" (long tokens of mixed characters) only where their value looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skimmer.llm.common import col, fresh, let, scratch, table

# Fixed by the contract, in the order that breaks ties; the last is this operator's own. group: what is secret in a match.
KINDS = ["assign", "access", "hex", "opaque"]
PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2),
    "access": (r"AKIA[A-Z0-9]+", 0),
    "hex": (r"[0-9a-f]{32,}", 0),  # the runs of 32 or more, as [0-9a-f]+ takes whole runs
    "opaque": (r"[A-Za-z0-9+/_-]{40,}", 0),
}
MATCH = "array<struct<rank:int,at:int,gap:int,size:int,gap_bytes:int,value:string>>"
SALTS = 16


def matches(text: Column, kind: str) -> Column:
    """The kind's matches in text in order: the length of each and of what lies before it, and what is secret in it."""
    pattern, group = PATTERNS[kind]

    def zipped(found: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        rows = F.arrays_zip(found.alias("m"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("g"), values.alias("v"))
        one = lambda r, i: F.struct(F.lit(KINDS.index(kind)).alias("rank"), i.alias("at"), F.length(r["g"]).alias("gap"), F.length(r["m"]).alias("size"), F.octet_length(r["g"]).alias("gap_bytes"), r["v"].alias("value"))
        return F.when(F.size(found) == 0, F.array().cast(MATCH)).otherwise(F.transform(rows, one).cast(MATCH))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), zipped)


def digest(found: Column) -> Column:
    """kind:start:end of each span, by start and kind, comma-joined."""
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def candidates(docs: DataFrame, doc_id: str, text: str, repo: Column, owner: Column) -> DataFrame:
    """(doc_id, text_hash, repo, owner, found) per row of docs; found: matches of all kinds."""
    whole = F.coalesce(col(text), F.lit(""))
    rows = docs.select(col(doc_id).alias("doc_id"), F.xxhash64(whole).alias("text_hash"), repo.cast("string").alias("repo"), owner.cast("string").alias("owner"), whole.alias("whole"))
    return rows.select("doc_id", "text_hash", "repo", "owner", F.concat(*(matches(F.col("whole"), k) for k in KINDS)).alias("found"))


def placed(found: DataFrame) -> DataFrame:
    """(doc_id, text_hash, rank, kind, start, end, end_bytes, value): the spans of each text. Places are running sums over its
    matches in order; an opaque token that meets a base span is left out, by the furthest base end before it and the next base
    start after it. Linear in the matches of a text but for their sort."""
    some = found.where(F.size("found") > 0).groupBy("doc_id", "text_hash").agg(F.first("found").alias("found")).select("doc_id", "text_hash", F.inline("found"))
    text = Window.partitionBy("doc_id", "text_hash")
    so_far = Window.partitionBy("doc_id", "text_hash", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    # matches are ASCII: a byte a character
    some = some.select("*", F.sum(F.col("gap") + F.col("size")).over(so_far).cast("int").alias("end"), F.sum(F.col("gap_bytes") + F.col("size")).over(so_far).cast("int").alias("end_bytes"))
    n, of = F.length("value"), lambda kind: F.col("rank") == KINDS.index(kind)
    mixed = F.col("value").rlike("[A-Z]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[0-9]")
    some = some.where(F.when(of("assign"), n >= 8).when(of("access"), n >= 16).when(of("opaque"), mixed).otherwise(True))
    some = some.withColumn("start", F.col("end") - F.col("size"))
    base, so_far = F.col("rank") < KINDS.index("opaque"), (Window.unboundedPreceding, 0)
    before = F.max(F.when(base, F.col("end"))).over(text.orderBy("start", "rank").rowsBetween(*so_far))
    # from the last one back: a frame that runs to the end would be gone over for each row
    after = F.min(F.when(base, F.col("start"))).over(text.orderBy(F.desc("start"), F.desc("rank")).rowsBetween(*so_far))
    some = some.withColumns({"before": before, "after": after})
    clear = (F.coalesce("before", F.lit(-1)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("rank") + 1)
    return some.where(base | clear).select("doc_id", "text_hash", "rank", kind.alias("kind"), "start", "end", "end_bytes", "value")


def ownership(spans: DataFrame, rows: DataFrame) -> DataFrame:
    """(value_hash, n_owners, n_repos, n_seen) of spans (doc_id, text_hash, value_hash) in rows (doc_id, text_hash, owner, repo).
    Each step groups what the one before has made smaller, so a value that is everywhere is summed on the map side."""
    named = rows.groupBy("doc_id", "text_hash", "owner", "repo").agg(F.count("*").alias("n")).withColumnsRenamed({"doc_id": "own_id", "text_hash": "own_hash"})
    each = spans.join(named, spans.doc_id.eqNullSafe(named.own_id) & (spans.text_hash == named.own_hash))
    each = each.groupBy("value_hash", "owner", "repo").agg(F.sum("n").alias("n"))
    owners = each.groupBy("value_hash", "owner").agg(F.sum("n").alias("n")).groupBy("value_hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_seen"))
    repos = each.groupBy("value_hash", "repo").agg(F.lit(1)).groupBy("value_hash").agg(F.count("*").alias("n_repos"))
    return owners.join(repos, "value_hash")


def judged(docs: DataFrame, doc_id: str, text: str, repo: Column | None, owner: Column | None, most_owners: int, most_repos: int) -> tuple[DataFrame, DataFrame]:
    """(candidates of each row, spans that are reported with their owners, repositories and whether they look live)."""
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", "source", "lang") if repo is None else repo
    found = scratch(candidates(docs, doc_id, text, repo, owner))
    spans = scratch(placed(found).withColumn("value_hash", F.sha2("value", 256)))
    owned = ownership(spans, found.where(F.size("found") > 0))
    # a value that stands everywhere is dealt out over salts
    owned = owned.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = spans.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash", "start"), F.lit(SALTS)).cast("int"))
    live = (F.col("n_owners") <= most_owners) & (F.col("n_repos") <= most_repos)
    seen = salted.join(owned, ["value_hash", "salt"]).withColumn("live", live)
    return found, seen.where(F.col("live") | (F.col("rank") < KINDS.index("opaque")))


def scan(docs: DataFrame, doc_id="doc_id", text="text", repo: Column | None = None, owner: Column | None = None, most_owners: int = 2, most_repos: int = 4) -> DataFrame:
    """One row per row of docs: base spans, all spans reported, and which of them look live: their value is held by most_owners
    owners and most_repos repositories at most. most_owners, most_repos: the widest spread of a value in the text, else null.

    Null texts are empty; null repositories or owners count as one of their own; a null id is an id; repeated rows get equal
    rows; an empty table gives none; other columns are not read."""
    found, seen = judged(docs, doc_id, text, repo, owner, most_owners, most_repos)
    span = F.struct("start", "rank", "kind", "end", "value")
    own = seen.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_list(F.when(F.col("rank") < KINDS.index("opaque"), span))).alias("base"), F.array_sort(F.collect_list(span)).alias("all"),
        F.array_sort(F.collect_list(F.when(F.col("live"), span))).alias("live"), F.max("n_owners").alias("most_owners"), F.max("n_repos").alias("most_repos"),
    )
    own = own.withColumnsRenamed({"doc_id": "own_id", "text_hash": "own_hash"})
    both = found.join(own, found.doc_id.eqNullSafe(own.own_id) & (found.text_hash == own.own_hash), "left")
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,value:string>>")
    return both.select("doc_id", "text_hash", *(F.coalesce(c, none).alias(c) for c in ("base", "all", "live")), "most_owners", "most_repos")


def redact(docs: DataFrame, doc_id="doc_id", text="text", mask: str = "[SECRET]", repo: Column | None = None, owner: Column | None = None, most_owners: int = 2, most_repos: int = 4, length: str | None = None) -> DataFrame:
    """docs, all rows and columns, with the values of live-looking candidates masked in their texts. length: a column to hold
    the new length of each text that was changed."""
    live = judged(docs, doc_id, text, repo, owner, most_owners, most_repos)[1].where("live")
    # values that meet are masked as one; by bytes, as a piece of a binary is cut out in the time of its own length
    live = live.select("doc_id", "text_hash", (F.col("end_bytes") - F.octet_length("value")).alias("from"), F.col("end_bytes").alias("to"))
    by = Window.partitionBy("doc_id", "text_hash").orderBy("from", "to")
    reach = F.max("to").over(by.rowsBetween(Window.unboundedPreceding, -1))
    live = live.withColumn("opens", F.when(F.col("from") < reach, 0).otherwise(1)).withColumn("cut", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    live = live.groupBy("doc_id", "text_hash", "cut").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    given, hash_, cut = fresh(docs, "__id", "__hash", "__cut")
    live = live.groupBy(F.col("doc_id").alias(given), F.col("text_hash").alias(hash_)).agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias(cut))
    both = docs.join(live, col(doc_id).eqNullSafe(F.col(given)) & (F.xxhash64(F.coalesce(col(text), F.lit(""))) == F.col(hash_)), "left")
    part = lambda body, at, to: F.substring(body, at + 1, to - at).cast("string")
    before = lambda i: F.when(i > 0, F.get(F.col(cut), i - 1)["to"]).otherwise(0)

    def masked(body: Column) -> Column:
        pieces = F.transform(cut, lambda s, i: F.concat(part(body, before(i), s["from"]), F.lit(mask)))
        return F.concat(F.array_join(pieces, ""), part(body, F.element_at(cut, -1)["to"], F.octet_length(body)))

    done = let(col(text).cast("binary"), masked)  # bound once: each cast copies the text
    both = both.withColumn(cut, F.when(F.col(cut).isNotNull(), done))
    new = {text: F.coalesce(F.col(cut), col(text))} | ({length: F.when(F.col(cut).isNull(), col(length)).otherwise(F.length(cut))} if length else {})
    return both.select(*((new[c].cast(docs.schema[c].dataType) if c in new else col(c)).alias(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("all")).alias("spans"), F.size("live").cast("long").alias("n_live"), F.col("most_owners").alias("n_owners"), F.col("most_repos").alias("n_repos"))


def _places(kind: str, pattern: str, group: int, keep: str) -> str:
    pattern = pattern.replace("'", "''")
    return f"""
{kind}_m AS (SELECT rid, regexp_extract_all(whole, '{pattern}') AS m, regexp_extract_all(whole, '{pattern}', {group}) AS v,
  regexp_split_to_array(whole, '{pattern}') AS g FROM d WHERE regexp_matches(whole, '{pattern}')),
{kind}_s AS (SELECT rid, {KINDS.index(kind)} AS rank, '{kind}' AS kind, v[i] AS value,
  list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s, length(m[i]) AS n
  FROM {kind}_m, unnest(range(1, len(m) + 1)) AS r(i) WHERE {keep})"""


ORACLE = (
    "WITH d AS (SELECT doc_id AS rid, coalesce(text, '') AS whole, source AS owner, concat_ws('/', source, lang) AS repo FROM documents),"
    + ",".join(
        [
            _places("assign", PATTERNS["assign"][0], 2, "length(v[i]) >= 8"),
            _places("access", PATTERNS["access"][0], 0, "length(v[i]) >= 16"),
            _places("hex", PATTERNS["hex"][0], 0, "true"),
            _places("opaque", PATTERNS["opaque"][0], 0, "regexp_matches(v[i], '[A-Z]') AND regexp_matches(v[i], '[a-z]') AND regexp_matches(v[i], '[0-9]')"),
        ]
    )
    + """,
base AS (SELECT * FROM assign_s UNION ALL SELECT * FROM access_s UNION ALL SELECT * FROM hex_s),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM opaque_s o
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = o.rid AND b.s < o.s + o.n AND o.s < b.s + b.n)),
freq AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT repo) AS repos FROM spans JOIN d USING (rid) GROUP BY 1),
kept AS (SELECT spans.*, owners, repos, owners <= 2 AND repos <= 4 AS live FROM spans JOIN freq USING (value) WHERE kind <> 'opaque' OR (owners <= 2 AND repos <= 4)),
agg AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (live) AS n_live, max(owners) AS n_owners, max(repos) AS n_repos,
  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, rank) FILTER (kind <> 'opaque') AS base,
  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, rank) AS spans FROM kept GROUP BY rid)
SELECT d.rid AS doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, n_owners, n_repos
FROM d LEFT JOIN agg USING (rid)"""
)
