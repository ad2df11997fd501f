"""The engine end to end: messages to scored, deduplicated rows per profile, pushes and digests."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skimmer.functions import features as R
from skimmer.operators import dedup, feedback, match, push, ranker, similarity
from skimmer.scratch import scratch


@dataclass
class Profiles:
    """Compiled keyword profiles and what they are compared with."""

    compiled: DataFrame
    requirements: DataFrame
    optionals: DataFrame
    multigrams: list[str] = field(default_factory=list)
    vectors: DataFrame | None = None
    version: int = 1


def load_profiles(keywords: DataFrame, vectors: DataFrame | None = None, version: int = 1, most_multigrams: int = 100_000) -> Profiles:
    """The multi-word keywords come to the driver, as many as most_multigrams."""
    from skimmer.operators import keywords as K

    compiled = K.compiled(keywords)
    words = [r.word for r in K.multigram_list(compiled).orderBy("word").limit(most_multigrams + 1).collect()]
    if len(words) > most_multigrams:
        raise ValueError("too many multi-word keywords for one expression")
    return Profiles(compiled, K.requirements(compiled), K.optionals(compiled), words, vectors, version)


def classify(docs: DataFrame, profiles: Profiles, key: str, text: str = "text", lang: str | None = None, tagger=None, unicode: bool = True, terms: DataFrame | None = None) -> DataFrame:
    """(key, pid, similarity) of each text's best profile. terms: (pid, word), expansion words that count as optional ones, too."""
    kept = match.gated(docs, text, lang)
    tokens = match.tokens_of(kept, key, text, multigrams=profiles.multigrams, tagger=tagger, unicode=unicode)
    wanted = profiles.compiled.select("pid", "optional") if terms is None else feedback.expanded(profiles.compiled.select("pid", "optional"), terms)
    if profiles.vectors is None:
        met = match.scored_matches(tokens, profiles.compiled, key, wanted)
        scores = met.select(key, "pid", similarity.exact_sim(F.col("met"), F.col("n_optional"), profiles.version).alias("sim"))
    else:
        met = match.matches(tokens, profiles.requirements, profiles.compiled, key)
        optionals = wanted.select("pid", F.explode("optional").alias("word"), F.size("optional").alias("n_optional"))
        own = scratch(tokens.join(met.select(key).distinct(), key, "left_semi"))
        scores = similarity.scores(met, own, optionals, profiles.vectors, key, profiles.version)
    return similarity.argmax(scores, key)


def filtered(messages: DataFrame, profiles: Profiles, model, thresholds: DataFrame, is_english=None, tag_cap: int = push.CAP, hash_of=None, lang: str | None = None, unicode: bool = True) -> tuple[DataFrame, DataFrame]:
    """(digest, pushes) of extracted messages (sources.readers.extract).

    model: the quality model, or a function rows -> rows with score. is_english: rows -> rows, a trained language gate (such as
    operators.language.english); lang: a column that tells the language. hash_of: text -> content hash, by default the bit votes of
    its shingles. Accepted rows are few; they are written once, and digest and pushes read them there."""
    ms = F.col("timestamp_ms").cast("long")
    rows = messages.withColumns({"seq": ms, "day": F.date_format(F.timestamp_millis(ms), "yyyyMMdd"), "hash": (hash_of or dedup.fingerprint)(F.col("full_text"))})
    kept = is_english(rows) if is_english else rows
    kept = kept.where(F.col(lang) == "en") if lang else kept
    # what is needed of a message is written once; matching and scoring both start from there
    kept = scratch(kept.drop("json"))
    best = classify(kept, profiles, "tid", "full_text", unicode=unicode)
    scored = model(kept) if callable(model) else ranker.predict(model, ranker.numeric(kept.withColumns(R.of_message())))
    scored = scored.select("tid", "orig_id", "seq", "day", "hash", F.col("full_text").alias("text"), "score")
    accepted = scratch(push.total_score(scored.join(best, "tid")))
    related, pushed = dedup.related_and_pushed(accepted, thresholds, tag_cap, scope=["day"])
    return push.digest(related), pushed.withColumn("delivered", F.unix_timestamp())
