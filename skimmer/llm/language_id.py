"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence on a page: how likely its text is under byte n-gram models, the language its markup declares, the
suffix of its address (country and path), and a prior of its host. Host priors come from grouped aggregation over all pages
and are smoothed level by level: host towards domain, domain towards address suffix, suffix towards the whole. A page's own vote is
left out of its prior. Per-language sums are shuffled, never pages or texts.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skimmer.llm.common import chunks, col, mix, scratch, table

BITS = 16
GRAM = 4

# This operator's reading of country suffixes.
COUNTRIES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "ie": "en", "au": "en", "it": "it", "nl": "nl", "pt": "pt", "br": "pt", "pl": "pl"}

# Second-level labels under which countries register, so that a domain has three labels there.
SHARED = {"ac", "co", "com", "edu", "gob", "gov", "net", "nom", "or", "org"}

_SCRIPT = re.compile(r"<(script|style)\b", re.I)
_SCRIPT_END = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style")}
_HTML, _LANG = re.compile(r"<html\b", re.I), re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)
_ADDRESS = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)(?::\d+)?(?:/([A-Za-z]{2})(?:[/?#]|$))?")


def visible(html: str) -> str:
    """The text outside of tags, comments, scripts and styles, each of which reads as a blank. What never closes counts as a
    tag up to the next >, or as text if there is none. One pass: an end that was not found is not looked for again."""
    out, at, ends = [], 0, {"-->": True, "script": True, "style": True}
    while (i := html.find("<", at)) >= 0:
        end = -1
        if html.startswith("<!--", i) and ends["-->"]:
            end = html.find("-->", i + 4) + 3
            ends["-->"] = end > 2
            end = end if end > 2 else -1
        elif m := _SCRIPT.match(html, i):
            kind = m[1].lower()
            if ends[kind]:
                close = _SCRIPT_END[kind].search(html, m.end())
                ends[kind] = close is not None
                end = close.end() if close else -1
        if end < 0 and (end := html.find(">", i + 1) + 1) == 0:
            break
        out += (html[at:i], " ")
        at = end
    return "".join(out) + html[at:]


def declared_language(html: str) -> str | None:
    """Two letters of the first lang attribute of an html tag."""
    at = 0
    while m := _HTML.search(html, at):
        end = html.find(">", m.end())
        if found := _LANG.search(html, m.end(), len(html) if end < 0 else end + 4):
            if end < 0 or found.start() < end:
                return found[1][:2].lower()
        if end < 0:
            return None
        at = end
    return None


def address(url: str) -> tuple[str, str, str, str]:
    """(host, domain, suffix, language code that begins the path), each "" where there is none."""
    m = _ADDRESS.match(url.strip())
    if not m:
        return "", "", "", ""
    host = m[1].lower().rstrip(".")
    labels = host.split(".")
    own = 3 if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in SHARED else 2
    return host, ".".join(labels[-own:]), labels[-1], (m[2] or "").lower()


def grams(data: np.ndarray, offsets: np.ndarray):
    """(bucket, row) of the byte n-grams of a piece; A-Z lower-cased, other ASCII but letters read as one blank."""
    low = np.arange(256, dtype=np.uint64)
    low[:128] = 32
    low[65:91] = low[97:123] = np.arange(97, 123)
    x = low[data]
    n = len(x) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = np.zeros(n, np.uint64)
    blank = np.ones(n, bool)
    for j in range(GRAM):
        value = value * np.uint64(257) + x[j : j + n]
        blank &= x[j : j + n] == 32
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = (rows[:n] == rows[GRAM - 1 :]) & ~blank
    return (mix(value[inside]) & np.uint64((1 << BITS) - 1)).astype(np.int64), rows[:n][inside]


def train(docs: DataFrame, text="text", lang="lang", doc_id="doc_id", sample: int = 8000, most_bytes: int = 1 << 28) -> tuple[list[str], np.ndarray]:
    """(languages, log-probability by language and bucket) from a bounded sample of labelled rows, of smallest hash of the id.

    All languages of the sample are in the model, which every worker holds: 256 KB each. It fails beyond most_bytes, and drops none."""
    rows = docs.select(col(doc_id).alias("id"), col(lang).alias("lang"), col(text).alias("text")).where("id is not null and lang is not null and text is not null")
    chosen = rows.select("id").orderBy(F.xxhash64("id"), "id").limit(sample).distinct()
    some = rows.join(F.broadcast(chosen), "id").select(F.lower("lang").alias("lang"), "text")

    some = scratch(some)
    if (n := some.select("lang").distinct().count()) << BITS + 2 > most_bytes:
        raise ValueError(f"a model of {n} languages is over most_bytes")

    def count(batches):
        import pyarrow as pa

        seen: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            for first, data, offsets in chunks(b.column(1)):
                bucket, row = grams(data, offsets)
                of = langs[first + row]
                for x in set(of):
                    seen.setdefault(x, np.zeros(1 << BITS, np.int64))
                    seen[x] += np.bincount(bucket[of == x], minlength=1 << BITS)
        for x, n in seen.items():
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(k)), pa.array(k.astype(np.int32)), pa.array(n[k])], ["lang", "bucket", "n"])

    got = some.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    langs = sorted(got["lang"].unique())
    table_ = np.full((len(langs), 1 << BITS), 0.5)
    for i, x in enumerate(langs):
        of = got[got["lang"] == x]
        table_[i, of["bucket"].to_numpy()] += of["n"].to_numpy()
    return langs, np.log(table_ / table_.sum(axis=1, keepdims=True)).astype(np.float32)


def evidence(pages: DataFrame, model, page_id="page_id", url="url", html="html", most_grams: float = 40.0, declared_right: float = 0.9, suffix_right: float = 0.8) -> DataFrame:
    """(page_id, host, domain, suffix, declared, logs, text_lang, vote): logs adds up the page's own evidence by language.

    All n-grams of a text count; as those of one text depend on each other, their mean weighs like most_grams independent ones
    at most, else a long text would outvote any other evidence by its length alone."""
    langs, logs = model
    shared = pages.sparkSession.sparkContext.broadcast(logs)

    def told(code: str, right: float) -> np.ndarray:
        if code not in langs or len(langs) < 2:
            return np.zeros(len(langs))
        return np.log(np.where(np.array(langs) == code, right, (1 - right) / (len(langs) - 1)))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            pages_, urls = b.column(2).fill_null("").to_pylist(), b.column(1).fill_null("").to_pylist()
            own = np.zeros((b.num_rows, len(langs)))
            n = np.zeros(b.num_rows)
            for first, data, offsets in chunks(pa.array([visible(p) for p in pages_], pa.large_string())):
                bucket, row = grams(data, offsets)
                k = len(offsets) - 1
                n[first : first + k] = np.bincount(row, minlength=k)
                for i in range(len(langs)):
                    own[first : first + k, i] = np.bincount(row, shared.value[i, bucket], k)
            own *= (np.minimum(n, most_grams) / np.maximum(n, 1))[:, None]
            text_lang = [langs[i] if k else None for i, k in zip(own.argmax(axis=1), n)]
            declared = [declared_language(p) for p in pages_]
            places = [address(u) for u in urls]
            for i, (d, (_, _, suffix, path)) in enumerate(zip(declared, places)):
                own[i] += told(d or "", declared_right) + told(COUNTRIES.get(suffix, ""), suffix_right) + told(path, suffix_right)
            vote = [langs[i] for i in own.argmax(axis=1)]
            cols = [b.column(0), *(pa.array(list(c), pa.string()) for c in zip(*((h, d, s) for h, d, s, _ in places))), pa.array(declared, pa.string()), pa.array(list(own), pa.list_(pa.float64())), pa.array(text_lang, pa.string()), pa.array(vote, pa.string())] if b.num_rows else []
            if cols:
                yield pa.RecordBatch.from_arrays(cols, ["page_id", "host", "domain", "suffix", "declared", "logs", "text_lang", "vote"])

    rows = pages.select(col(page_id).cast("long").alias("page_id"), col(url).cast("string").alias("url"), col(html).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, host string, domain string, suffix string, declared string, logs array<double>, text_lang string, vote string")


def identify(pages: DataFrame, model, page_id="page_id", url="url", html="html", strength: float = 5.0, **how) -> DataFrame:
    """(page_id, lang, confidence, text_lang, declared, host, host_pages) per row of pages.

    A null or empty page has no text evidence, an address that can't be read has the empty host, and what is missing
    tells nothing, so the prior alone may decide; ties go to the language first in the alphabet. Repeated rows vote once
    each. An empty table gives no rows; without any trained language lang is null; other columns are not read."""
    langs = model[0]
    if not langs:
        null = F.lit(None).cast("string")
        return pages.select(col(page_id).cast("long").alias("page_id"), null.alias("lang"), F.lit(0.0).alias("confidence"), null.alias("text_lang"), null.alias("declared"), null.alias("host"), F.lit(0).cast("long").alias("host_pages"))
    own = scratch(evidence(pages, model, page_id, url, html, **how))
    votes = [f"v{i}" for i in range(len(langs))]
    total = lambda cols: sum((F.col(c) for c in cols[1:]), F.col(cols[0]))

    def summed(df, keys):
        return df.groupBy(*keys).agg(*(F.sum(v).alias(v) for v in votes))

    host = own.groupBy("host", "domain", "suffix").agg(*(F.sum(F.when(F.col("vote") == x, 1).otherwise(0)).cast("double").alias(v) for x, v in zip(langs, votes)))
    host = scratch(host)
    domain, suffix = summed(host, ["domain", "suffix"]), summed(host, ["suffix"])
    whole = summed(host, []).first()
    domain = domain.join(suffix.withColumnsRenamed({v: f"suffix_{v}" for v in votes}), "suffix")
    domain = domain.withColumns({f"all_{v}": F.lit(float(whole[v] or 0)) for v in votes})
    prior = host.join(domain.withColumnsRenamed({v: f"domain_{v}" for v in votes}), ["domain", "suffix"])
    rows = own.join(prior.drop("domain", "suffix"), "host")

    def level(prefix, size, below):
        """Smoothed shares by language, the page's own vote taken out."""
        n = [F.col(f"{prefix}{v}") - F.when(F.col("vote") == x, 1.0).otherwise(0.0) for x, v in zip(langs, votes)]
        return [(a + strength * b) / (F.col(size) - 1.0 + strength) for a, b in zip(n, below)]

    share = [F.lit(1.0 / len(langs))] * len(langs)
    for k, prefix in enumerate(("all_", "suffix_", "domain_", "")):
        rows = rows.withColumn(f"size{k}", total([f"{prefix}{v}" for v in votes]))
        rows = rows.withColumns({f"s{k}_{i}": c for i, c in enumerate(level(prefix, f"size{k}", share))})
        share = [F.col(f"s{k}_{i}") for i in range(len(langs))]
    posts = [F.element_at("logs", i + 1) + F.log(share[i]) for i in range(len(langs))]
    rows = rows.withColumns({f"l{i}": p for i, p in enumerate(posts)})
    top = F.greatest(*(F.col(f"l{i}") for i in range(len(langs)))) if len(langs) > 1 else F.col("l0")
    best = F.coalesce(*(F.when(F.col(f"l{i}") == top, F.lit(x)) for i, x in enumerate(langs)))
    odds = sum((F.exp(F.col(f"l{i}") - top) for i in range(1, len(langs))), F.exp(F.col("l0") - top))
    return rows.select("page_id", best.alias("lang"), (1 / odds).alias("confidence"), "text_lang", "declared", "host", total(votes).cast("long").alias("host_pages"))


def query(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), train(table(spark, sf_dir, "documents")))
