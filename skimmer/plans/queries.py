"""One query per operator, on the driver's tables: documents stand for messages, events for a scored stream, embeddings for
word vectors. skimmer.plans.oracles has each as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skimmer.functions import features as R
from skimmer.functions import text as X
from skimmer.operators import checks, dedup, feedback, history, keywords, language, match, push, ranker, similarity, simjoin, skipgram, tagger, trie
from skimmer.plans import filtering
from skimmer.scratch import scratch, scratch_path
from skimmer.sources import readers, writers
from skimmer.sources.writers import digest_line

#: Stand-in keyword profiles (pid, optional, required), of words and word pairs that the documents hold.
PROFILES = [
    (0, "thon\ttion||ering", "thre||ther && heat||edst||thon"),
    (1, "", "reed"),
    (2, "thand||heed||with the||hand", "tion||thon && and the||of the||Edth"),
    (3, "heat", "thon&&tion&&thre"),
    (4, "anin||onon||erst", "||ther||to the && hain||hean||onin"),
]
#: Stand-in substring weights (ngram, lang, weight).
WEIGHTS = [("th", "en", 0.9), ("ng ", "en", 0.7), ("he", "en", 0.4), ("de", "fr", 0.3), ("eau", "fr", 0.8), ("ch", "de", 0.4), ("sch", "de", 0.8), ("ei", "de", 0.5), ("ció", "es", 0.9), ("os", "es", 0.5), ("de", "es", 0.3), ("é", "fr", 0.5)]


#: What texts are rid of before they go into articles, so that SQL can follow the cleaning: markup, and what XML can't hold.
WIKI_MARKS = r"[\x00-\x20\[\]{}|<>&'=]|https?:|[^\x00-\x{D7FF}\x{E000}-\x{FFFD}]"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", "text", "lang")


def _compiled(spark):
    return keywords.compiled(spark.createDataFrame(PROFILES, "pid int, optional string, required string"))


def _profiles(spark):
    return filtering.load_profiles(spark.createDataFrame(PROFILES, "pid int, optional string, required string"))


def _tokens(spark, sf_dir, multigrams=()):
    return match.tokens_of(match.gated(_docs(spark, sf_dir)), "doc_id", multigrams=list(multigrams), unicode=False)


def _scored(spark, sf_dir):
    """events as a scored stream: profile = event type's place in the alphabet, score from value."""
    e = _t(spark, sf_dir, "events")
    kinds = F.ascii(F.substring("event_type", 1, 1)) % 5
    return e.select(
        F.col("event_id").alias("seq"), kinds.cast("int").alias("pid"), F.date_format("ts", "yyyyMMdd").alias("day"), "user_id",
        (F.col("value") / 500).alias("score"), F.col("ts").cast("timestamp").alias("ts"),
        (F.col("user_id") * 5 + kinds).alias("orig_id"), (F.col("user_id") * 5 + kinds).cast("string").alias("hash"),
    )


def _stats(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    return history.daily(rows, rows.select("pid").distinct(), rows.select("day").distinct())


def _thresholds(spark, sf_dir):
    return history.thresholds(_stats(spark, sf_dir)).withColumn("threshold", F.col("threshold") / 2)


# -- text ---------------------------------------------------------------------------------------------------------------


def extract_json(spark, sf_dir):
    e = _t(spark, sf_dir, "events").where(F.startswith("props", F.lit("{")))
    k = F.from_json("props", "k long")["k"]
    return e.select("event_id", k.alias("k")).where("k is not null")


def clean_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.collapse_breaks(X.strip_marks(F.col("text")))).alias("clean_md5"))


def char_ratio(spark, sf_dir):
    return match.gated(_docs(spark, sf_dir), lang=None).select("doc_id", F.round(X.clean_ratio(F.col("text")), 9).alias("ratio"))


def tokenize_count(spark, sf_dir):
    t = X.tokens(X.strip_marks(F.col("text")), unicode=False)
    return _docs(spark, sf_dir).select("doc_id", F.size(t).alias("n"), F.size(F.array_distinct(t)).alias("n_distinct"))


def stopwords(spark, sf_dir):
    t = X.without_stopwords(X.tokens(X.strip_marks(F.col("text")), unicode=False))
    return _docs(spark, sf_dir).select("doc_id", F.size(t).alias("n"))


def text_normalize(spark, sf_dir):
    t = X.latin_only(X.digits_to_zero(X.unify_dashes(F.col("text"))))
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.romanian_commas(X.lower_but_i(t))).alias("normal_md5"))


def collapse_runs(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.length(X.collapse_runs(F.lower("text"))).alias("n"))


def en_counts(spark, sf_dir):
    return _docs(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(F.col("lang") == "en").alias("english"))


# -- keywords and matching ----------------------------------------------------------------------------------------------


def _doc_profiles(spark, sf_dir):
    """A keyword profile of each text with at least six words: of its first ones, as an expression."""
    w = _docs(spark, sf_dir).select(F.col("doc_id").alias("pid"), F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0)).alias("w")).where(F.size("w") >= 6)
    at = lambda i: F.get("w", F.lit(i))
    return w.select("pid", F.concat(at(0), F.lit("\t"), at(1), F.lit("||"), at(0)).alias("optional"), F.concat(at(2), F.lit("||"), at(3), F.lit(" "), at(4), F.lit(" && "), at(5), F.lit("|| ||"), at(0)).alias("required"))


def _doc_requirements(spark, sf_dir):
    return keywords.requirements(keywords.compiled(_doc_profiles(spark, sf_dir)))


def keyword_compile(spark, sf_dir):
    return _doc_requirements(spark, sf_dir)


def inverted_index(spark, sf_dir):
    return keywords.inverted_index(_doc_requirements(spark, sf_dir)).select("word", F.array_join(F.col("pids").cast("array<string>"), ",").alias("pids"))


def prefix_lookup(spark, sf_dir):
    return keywords.subtree(_doc_requirements(spark, sf_dir), "th").select("pid", "word").distinct()


def multigram_contains(spark, sf_dir):
    words = keywords.multigram_list(_compiled(spark))
    text = X.strip_marks(F.col("text"))
    found = _docs(spark, sf_dir).select("doc_id", F.explode(X.contained(text, F.array(*(F.lit(r.word) for r in words.orderBy("word").collect())))).alias("word"))
    return found


def _bench_words(spark, sf_dir):
    """The distinct words of four to twelve letters that benchmark holds, and their pairs: patterns out of a table."""
    w = _t(spark, sf_dir, "benchmark").select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,12}"), F.lit(0)).alias("w"))
    pairs = F.transform(F.sequence(F.lit(2), F.greatest(F.size("w"), F.lit(2))), lambda i: F.concat_ws(" ", F.get("w", i - 2), F.get("w", i - 1)))
    return w.select(F.explode(F.array_union("w", pairs)).alias("word")).where("word <> ''").distinct()


def pattern_offsets(spark, sf_dir):
    """All places of all patterns in each text, overlaps included: which patterns a text holds, and where each stands first."""
    patterns = trie.shared_patterns(spark, trie.gathered(_bench_words(spark, sf_dir), "word"))
    found = trie.place_rows(_docs(spark, sf_dir), "doc_id", F.lower("text"), patterns)
    first = found.groupBy("doc_id", "word").agg(F.min("start").alias("start"))
    return first.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.sum("start").alias("starts"))


def english_gate(spark, sf_dir):
    """The texts that a model of fixed weights calls English, with their probability."""
    weights = spark.createDataFrame(WEIGHTS, "ngram string, lang string, weight double").withColumn("weight", F.col("weight") / 64)
    d = _docs(spark, sf_dir).select("doc_id", language.label_of(F.lower("text"), weights).alias("found"))
    return d.where("found.lang = 'en'").select("doc_id", F.round("found.p", 6).alias("p"))


def candidates(spark, sf_dir):
    return match.candidates(_tokens(spark, sf_dir), keywords.requirements(_compiled(spark)), "doc_id")


def cnf_match(spark, sf_dir):
    p = _profiles(spark)
    return match.matches(_tokens(spark, sf_dir, p.multigrams), p.requirements, p.compiled, "doc_id")


def topic_match(spark, sf_dir):
    """The flagship: from texts to each one's best profile."""
    best = filtering.classify(_docs(spark, sf_dir), _profiles(spark), "doc_id", lang="lang", unicode=False)
    return best.select("doc_id", "pid", F.round("similarity", 9).alias("similarity"))


# -- word vectors -------------------------------------------------------------------------------------------------------


def _vectors(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vec"))


def _vector_case(spark, sf_dir):
    """Every vector is a word: texts t of ten words each, and a stated set of keywords, the words divisible by 100, dealt out
    to five profiles. All words meet that set; it is broadcast behind a check of its size. Vectors are written once."""
    vectors = scratch(_vectors(spark, sf_dir))
    ids = vectors.select(F.col("word").cast("long").alias("id"), "word")
    tokens = ids.select(F.floor(F.col("id") / 10).cast("int").alias("t"), "word")
    opts = ids.where("id % 100 = 0").select((F.floor(F.col("id") / 100) % 5).cast("int").alias("pid"), "word")
    opts = scratch(opts.join(F.broadcast(opts.groupBy("pid").agg(F.count("*").cast("int").alias("n_optional"))), "pid"))  # five rows
    met = tokens.select("t").distinct().join(F.broadcast(opts.select("pid").distinct()), how="cross")  # the result's own size
    return tokens, opts, met, vectors


def _sims(spark, sf_dir, version):
    tokens, opts, met, vectors = _vector_case(spark, sf_dir)
    # random vectors are never as near as those of real words: the cut is lower
    return similarity.scores(met, tokens, opts, vectors, "t", version, cut=0.25)


def cosine_pairs(spark, sf_dir):
    tokens, opts, _, vectors = _vector_case(spark, sf_dir)
    return similarity.word_pairs(tokens, opts, vectors, 0.25).where("word <> keyword").select("word", "keyword", F.round("sim", 9).alias("sim"))


def similarity_join(spark, sf_dir):
    """All vectors with all others over a cut."""
    v = _vectors(spark, sf_dir)
    return simjoin.over(v, v, 0.4)[0].where("word <> keyword").select("word", "keyword", F.round("sim", 9).alias("sim"))


def sim_v1(spark, sf_dir):
    return _sims(spark, sf_dir, 1).select("t", "pid", F.round("sim", 9).alias("sim"))


def sim_v2(spark, sf_dir):
    return _sims(spark, sf_dir, 2).select("t", "pid", F.round("sim", 9).alias("sim"))


def sim_v3(spark, sf_dir):
    return _sims(spark, sf_dir, 3).select("t", "pid", F.round("sim", 9).alias("sim"))


def argmax_profile(spark, sf_dir):
    return similarity.argmax(_sims(spark, sf_dir, 2), "t").select("t", "pid", F.round("similarity", 9).alias("similarity"))


# -- quality ------------------------------------------------------------------------------------------------------------


def _features(docs):
    t = F.col("text")
    return docs.withColumns({"Topic": R.has_topic(t), "WordCount": R.word_count(t), "Capital": R.capitals(t), "CharacterPerWord": R.characters_per_word(t), "ellipsis": R.has_ellipsis(t), "Personal": R.is_personal(t)})


def ranker_features_text(spark, sf_dir):
    return _features(_docs(spark, sf_dir)).select("doc_id", "Topic", "WordCount", "Capital", "CharacterPerWord", "ellipsis", "Personal")


def ranker_features_user(spark, sf_dir):
    o = _t(spark, sf_dir, "customer")
    n = F.floor("c_acctbal").cast("long")
    return o.select("c_custkey", F.round(R.log_count(n), 9).alias("followers"), R.retweet_count(n).alias("retweets"), R.retweet_level(n).alias("level"))


def ranker_training_join(spark, sf_dir):
    rows = _features(_docs(spark, sf_dir)).join(_t(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("Importance")), "doc_id")
    return rows.groupBy("Importance").agg(F.count("*").alias("n"), F.sum("WordCount").alias("words"), F.sum("Capital").alias("capitals"))


def _messages(spark, sf_dir):
    """documents as messages: (doc_id, and the columns of schema.MESSAGE). Every fifth is a retweet of message doc_id / 5."""
    d = _t(spark, sf_dir, "documents")
    i, none = F.col("doc_id"), F.lit(None)
    filled = lambda every, of: F.when(i % every == 0, F.array(F.struct(F.lit("x").alias(of)))).otherwise(F.array().cast(f"array<struct<{of}:string>>"))
    again = F.struct(F.floor(i / 5).cast("string").alias("id_str"), F.concat(F.lit("Again: "), "text").alias("text"), (i % 1000).alias("retweet_count"), F.struct((i * 3).alias("followers_count"), (i * 7).alias("statuses_count")).alias("user"))
    return d.select(
        "doc_id", i.cast("string").alias("id_str"), "text", F.lit("now").alias("created_at"), (F.lit(1704067200000) + i * 3_600_000).cast("string").alias("timestamp_ms"),
        F.struct(F.col("source").alias("screen_name"), "lang", F.col("n_chars").alias("followers_count"), i.alias("statuses_count")).alias("user"),
        F.struct(filled(3, "url").alias("urls"), filled(4, "screen_name").alias("user_mentions")).alias("entities"), F.when(i % 5 == 0, again).otherwise(none).alias("retweeted_status"),
    )


def ranker_score(spark, sf_dir):
    rows = ranker.numeric(_messages(spark, sf_dir).withColumns(R.of_message()).select("doc_id", *R.NAMES))
    model = ranker.fit(rows.join(_t(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("Importance")), "doc_id"))
    return ranker.predict(model, rows).select("doc_id", "score")


def model_saved(spark, sf_dir):
    """The quality model fitted, saved and loaded: its scores are those of the fitted one, and of the loaded coefficients by hand."""
    rows = scratch(ranker.numeric(_messages(spark, sf_dir).withColumns(R.of_message()).select("doc_id", *R.NAMES)))
    model = ranker.fit(rows.join(_t(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("Importance")), "doc_id"))
    path = scratch_path(spark)
    model.write().save(path)
    loaded = ranker.load(path)
    scale, weights = loaded.stages[1], loaded.stages[2]
    line = F.lit(float(weights.intercept))
    for name, mean, std, w in zip(R.NAMES, scale.mean.toArray(), scale.std.toArray(), weights.coefficients.toArray()):
        line = line + ((F.col(name) - float(mean)) / float(std) if std else F.lit(0.0)) * float(w)
    both = ranker.predict(loaded, rows).withColumns({"loaded": F.col("score"), "by_hand": 1 / (1 + F.exp(-line))}).drop("score")
    both = ranker.predict(model, both)
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) < 1e-9
    return both.select("doc_id", (near("loaded", "score") & near("loaded", "by_hand") & (F.col("score") < 1)).alias("same"))


def word2vec(spark, sf_dir):
    """Which words get a vector, and whether training has moved it to a finite one. The seed is fixed, parts are eight or as many as the
    text needs, and rows are dealt by id."""
    docs = _docs(spark, sf_dir)
    words = docs.select("doc_id", X.tokens(X.strip_marks(F.col("text")), unicode=False).alias("words"))
    v = skipgram.word2vec(words, size=32, parts=skipgram.pieces_of(docs), key="doc_id")
    moved = X.let(F.sqrt(similarity.dot(F.col("vec"), F.col("vec"))), lambda norm: (norm > 0) & (norm < 1e6))
    return v.select("word", F.size("vec").alias("size"), moved.alias("moved"))


# -- files: written in their format, read back ---------------------------------------------------------------------------


def _lines(df, value, compression="gzip"):
    path = scratch_path(df.sparkSession)
    df.select(value.alias("value")).write.text(path, compression=compression)
    return path


def _message_file(spark, sf_dir):
    """Messages as gzip JSON lines, with notices of deletion and noise between them."""
    m = _messages(spark, sf_dir).where("text is not null")
    line = F.to_json(F.struct(*[c for c in m.columns if c != "doc_id"]))
    noise = F.when(F.col("doc_id") % 7 == 0, F.array(line, F.lit('{"delete": 1}'), F.lit("noise"), F.lit('{"broken'))).otherwise(F.array(line))
    return _lines(m.select(F.explode(noise).alias("line")), F.col("line"))


def source_messages(spark, sf_dir):
    m = readers.extract(readers.messages(spark, _message_file(spark, sf_dir))).withColumns(R.of_message())
    day = F.date_format(F.timestamp_millis(F.col("timestamp_ms").cast("long")), "yyyyMMdd")
    return m.select("tid", "orig_id", F.md5("full_text").alias("text_md5"), day.alias("day"), "Url", "Mention", F.round("Followers", 9).alias("followers"), F.round("Statuses", 9).alias("statuses"), F.col("RetweetCount").cast("long").alias("retweets"), F.col("RetweetLevel").alias("level"))


def source_language_lines(spark, sf_dir):
    rows = readers.language_lines(spark, _message_file(spark, sf_dir))
    return rows.select(F.get_json_object("json", "$.id_str").alias("tid"), F.md5("text").alias("text_md5"))


def enriched_json(spark, sf_dir):
    """Messages serialised with a score, read again."""
    lines = readers.messages(spark, _message_file(spark, sf_dir)).withColumn("score", (F.col("user.followers_count") % 100) / 100)
    path = scratch_path(spark)
    writers.write_json(readers.enriched(lines, "score"), path)
    return spark.read.text(path).select(F.get_json_object("value", "$.id_str").alias("tid"), F.get_json_object("value", "$.score").cast("double").alias("score"), F.get_json_object("value", "$.user.lang").alias("lang"))


def source_keywords(spark, sf_dir):
    """Keyword lines with raw tabs, one for each text, written and read."""
    text = F.concat(F.lit('{"tid": "'), readers.profile_id(F.col("pid")), F.lit('", "keyword": {"0": "'), "optional", F.lit('", "1": "'), "required", F.lit('"}}\r'))
    return keywords.requirements(keywords.compiled(readers.keywords(spark, _lines(_doc_profiles(spark, sf_dir), text))))


def source_topics(spark, sf_dir):
    """Profile elements in many files: texts dealt to 700 profiles, whose numbers have three digits."""
    n = _docs(spark, sf_dir).groupBy((F.col("doc_id") % 700).alias("at")).agg(F.count("*").alias("n"), F.max("lang").alias("lang"))
    line = F.concat(F.lit("<top>\r\n<num> Number: "), readers.profile_id(F.col("at")), F.lit(" </num>\r\n<title>\r\nTexts in "), F.coalesce("lang", F.lit("none")), F.lit(": "), F.col("n").cast("string"), F.lit("\r\n</title>\r\n</top>"))
    return readers.topics(spark, _lines(n, line, "none")).select("pid", "num", "title")


def tagged_filter(spark, sf_dir):
    """A tagger trained on the texts' words with tags by a rule; how many words of each text are nouns or verbs to it."""
    words = scratch(_docs(spark, sf_dir).select("doc_id", X.tokens(X.strip_marks(F.col("text")), unicode=False).alias("words")))
    by_rule = lambda w: F.when(w.isin(tagger.CLOSED), "IN").when(F.ascii(w).between(48, 57) & w.rlike("^[0-9]+$"), "CD").when(w.endswith("ly"), "RB").when(w.endswith("ing") | w.endswith("ed"), "VB").otherwise("NN")
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("words", F.lit(1), F.greatest(F.size("words") - 1, F.lit(0))))
    each = words.where("size(words) > 0").select(F.col("doc_id").alias("sentence"), F.posexplode(F.arrays_zip(before.alias("before"), F.col("words").alias("word"))).alias("at", "w"))
    w = F.col("w.before")
    table = each.select("sentence", "at", "w.word", by_rule(F.col("w.word")).alias("tag"), F.when(w.isNotNull(), by_rule(w)).alias("before"))
    kept = tagger.filtered(words.where("words is not null"), "doc_id", "words", table, smoothing=1e-9)  # a word that was seen keeps its own tag
    return kept.select("doc_id", F.size("kept").alias("n"))


def file_english_lines(spark, sf_dir):
    """The texts that a model of fixed weights calls English, a line each, written and read."""
    weights = spark.createDataFrame(WEIGHTS, "ngram string, lang string, weight double").withColumn("weight", F.col("weight") / 64)
    found = _docs(spark, sf_dir).withColumn("found", language.label_of(F.lower("text"), weights)).where("found.lang = 'en'")
    path = scratch_path(spark)
    writers.write_lines(found, "text", path)
    return spark.read.text(path).select(F.md5("value").alias("line_md5"))


def source_expanded(spark, sf_dir):
    """Expanded profiles, lines of words, written from texts and read."""
    line = F.array_join(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), "  ")
    back = readers.expanded_profiles(spark, _lines(_docs(spark, sf_dir).where("text is not null"), line))
    return back.select(F.md5(F.array_join("words", " ")).alias("words_md5"), F.size("words").alias("n"))


def source_lines(spark, sf_dir):
    """Message lines of many files as a stream, each with its length and hash."""
    from skimmer.streaming import push as S

    lines = readers.stream_lines(spark, *_message_batches(spark, sf_dir))
    return S.run_available(lines.select(F.length("value").alias("n"), F.startswith("value", F.lit("{")).alias("object"))).groupBy("object").agg(F.count("*").alias("lines"))


def source_vectors(spark, sf_dir):
    path = scratch_path(spark)
    writers.write_vector_lines(_vectors(spark, sf_dir), path)
    back = readers.word_vectors(spark, path)
    return back.select("word", F.size("vec").alias("size"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


def source_training(spark, sf_dir):
    """The training file of the twelve features: written, read, fitted inputs summed."""
    rows = _messages(spark, sf_dir).withColumns(R.of_message()).join(_t(spark, sf_dir, "labels").where("quality is not null").select("doc_id", F.col("quality").alias("Importance")), "doc_id")
    path = scratch_path(spark)
    writers.write_training(rows, path)
    back = readers.training_rows(spark, path)
    n = lambda c: F.sum(F.col(c).cast("int")).alias(c.lower())
    return back.groupBy("Importance").agg(F.count("*").alias("n"), n("Url"), n("Mention"), F.sum("WordCount").cast("long").alias("words"), F.round(F.sum("Statuses"), 6).alias("statuses"))


def source_wiki(spark, sf_dir):
    """Every text as an article with markup five levels deep, in a dump of many files: read, cleaned, written a line each, cut into words."""
    d = _docs(spark, sf_dir).where("text is not null")
    plain = F.regexp_replace("text", WIKI_MARKS, " ")
    nested = "{{a|{{b {{c {{d|x {{e}} y}} }} }} }} {| class\n| {{f}}\n|} [[File:x.png|thumb|see [[Other|one]]]] "
    body = F.concat(F.lit(nested + "'''"), F.col("doc_id").cast("string"), F.lit("''' lies in [[Region|"), F.coalesce("lang", F.lit("none")), F.lit("]] &lt;ref&gt;x {{y}}&lt;/ref&gt; "), plain, F.lit(" end"))
    more = F.when(F.col("doc_id") % 5 == 0, "<redirect title='x'/>").otherwise("")
    page = F.concat(F.lit("<page><title>T"), F.col("doc_id").cast("string"), F.lit("</title><ns>0</ns>"), more, F.lit("<revision><text>"), body, F.lit("</text></revision></page>"))
    pages = readers.wiki_pages(spark, _lines(d, page, "bzip2"))
    path = scratch_path(spark)
    writers.write_lines(pages.select(F.concat_ws(" | ", "title", "text").alias("line")), "line", path)
    return readers.sentences(spark, path).select(F.md5(F.array_join("words", " ")).alias("line_md5"), F.size("words").alias("n"))


#: Labels of a corpus are letters and hyphens; any other is written as two hyphens and its bytes, sixteen letters for the digits.
_DIGITS, _LETTERS = "0123456789ABCDEF", "abcdefghijklmnop"


def _label(lang):
    plain = lang.rlike(r"\A(?!--)[-A-Za-z]+\z")
    return F.when(plain, lang).otherwise(F.concat(F.lit("--"), F.translate(F.hex(F.encode(lang, "UTF-8")), _DIGITS, _LETTERS)))


def _lang(label):
    spelt = F.decode(F.unhex(F.translate(F.substring(label, 3, 1 << 30), _LETTERS, _DIGITS)), "UTF-8")
    return F.when(F.startswith(label, F.lit("--")), spelt).otherwise(label)


def source_corpus(spark, sf_dir):
    d = _docs(spark, sf_dir).where("text is not null and lang is not null").withColumn("label", _label(F.col("lang")))
    path = _lines(d, F.concat_ws("\t", "label", writers.one_line(F.translate("text", "\t", " "))))
    rows = readers.language_corpus(spark, path, d.select(F.col("label").alias("lang")).distinct())  # labels are declared with a corpus
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return found.select(_lang(F.col("lang")).alias("lang"), "n", "chars")


def source_feature_counts(spark, sf_dir):
    d = _docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"))
    return readers.feature_counts(spark, _lines(d, F.concat_ws("\t", F.coalesce("lang", F.lit("none")), F.col("n").cast("string")))).select("ngram", "n")


def label_lists(spark, sf_dir):
    return language.label_lists(_docs(spark, sf_dir).where("lang is not null"), "lang", "doc_id").select("lang", F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_md5"), F.size("ids").alias("n"))


def file_digest(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumns({"total": F.round(F.col("score"), 6), "tid": F.col("seq").cast("string")})
    path = scratch_path(spark)
    writers.write_digest(push.digest(rows), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def file_push_log(spark, sf_dir):
    pushed = push.capped(_scored(spark, sf_dir), _thresholds(spark, sf_dir), scope=["day"])
    pushed = pushed.withColumns({"tid": F.col("seq").cast("string"), "delivered": F.unix_timestamp("ts"), "similarity": F.lit(0.75), "total": F.lit(0.5), "text": F.col("day")})
    plain, extended = scratch_path(spark), scratch_path(spark)
    writers.write_pushes(pushed, plain)
    writers.write_pushes(pushed, extended, extended=True)
    return spark.read.text(plain).select(F.col("value").alias("line")).unionByName(spark.read.text(extended).select(F.col("value").alias("line")))


def file_history_matrix(spark, sf_dir):
    stats, path = _stats(spark, sf_dir), scratch_path(spark)
    wide = history.matrix(stats, "n_related")
    writers.write_history_matrix(wide, path, wide.columns[1:])
    back = writers.read_history_matrix(spark, path)
    return back.select(F.col("pid").cast("long").alias("at"), F.aggregate("values", F.lit(0.0), lambda s, x: s + x).alias("total"), F.size("values").alias("days"))


def file_profiles(spark, sf_dir):
    rows = _scored(spark, sf_dir).where("score > 0.6").withColumns({"tid": F.col("seq").cast("string"), "similarity": F.round("score", 6), "text": F.concat(F.lit("m"), F.col("seq").cast("string"))})
    path = scratch_path(spark)
    writers.write_profiles(rows.select("day", "pid", "tid", "similarity", "text"), path)
    kept = spark.read.schema("day string, pid int, tid string, similarity double, text string").json(f"{path}/json")
    lines = spark.read.text(f"{path}/text").groupBy("day", "pid").agg(F.count("*").alias("n_lines"))
    return kept.groupBy(F.col("day").cast("string").alias("day"), "pid").agg(F.count("*").alias("n"), F.round(F.sum("similarity"), 6).alias("total")).join(lines.withColumn("day", F.col("day").cast("string")), ["day", "pid"])


def filtered(spark, sf_dir):
    """The engine from message lines to digest and pushes: gates, classification, score, duplicates, cap. The score is a stand-in
    for the fitted model's, so that SQL can follow."""
    messages = readers.extract(readers.messages(spark, _message_file(spark, sf_dir)))
    thresholds = spark.createDataFrame([(p[0], 0.5) for p in PROFILES], "pid int, threshold double")
    digest, pushed = filtering.filtered(messages, _profiles(spark), _stand_in, thresholds, hash_of=lambda t: F.md5(t), lang="user.lang", unicode=False)
    return digest.select("tid", "pid", F.lit("digest").alias("kind"), "rank").unionByName(pushed.select("tid", "pid", F.lit("push").alias("kind"), F.lit(0).alias("rank")))


# -- scored stream ------------------------------------------------------------------------------------------------------


def total_score(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("similarity", F.lit(0.75))
    return push.total_score(rows).select("seq", F.round("total", 9).alias("total"))


def day_counts_zero_filled(spark, sf_dir):
    rows = _scored(spark, sf_dir).select(F.col("user_id").alias("pid"), "day", "score")
    stats = history.daily(rows, rows.select("pid").distinct(), rows.select("day").distinct())
    return stats.select("pid", "day", "n_related")


def rank_k(spark, sf_dir):
    return _stats(spark, sf_dir).select("pid", "day", "n_related", F.round("rank_score", 9).alias("rank_score"))


def exp_smoothing(spark, sf_dir):
    return history.thresholds(_stats(spark, sf_dir), "n_related").select("pid", F.round("threshold", 6).alias("forecast"))


def smoothing_by_day(spark, sf_dir):
    """The forecast with history merged as days come: a stored state and a batch of days, four times."""
    stats = scratch(_stats(spark, sf_dir).withColumn("part", F.ceil(F.substring("day", 7, 2).cast("int") / 8)))
    kept = None
    for i in range(1, 5):
        new = history.decayed(stats.where(F.col("part") == i), "rank_score")
        kept = scratch(new if kept is None else history.merged(kept, new))
    return history.forecasts(kept).select("pid", F.round("threshold", 9).alias("forecast"))


def history_folder(spark, sf_dir):
    """Digest folders written day by day, read back as history, and the thresholds that they give."""
    path = scratch_path(spark)
    rows = _scored(spark, sf_dir).withColumns({"total": F.round(F.col("score"), 6), "tid": F.col("seq").cast("string")})
    writers.write_digest(push.digest(rows), path)
    back = readers.materialised(spark, scratch_path(spark), lambda: readers.digest_history(spark, path))
    stats = history.daily(back, back.select("pid").distinct(), back.select("day").distinct())
    return history.thresholds(scratch(stats)).select("pid", F.round("threshold", 9).alias("threshold"))


def moving_avg_3d(spark, sf_dir):
    return history.moving_average(_stats(spark, sf_dir), "n_related").select("pid", "day", F.round("average", 9).alias("average"))


def threshold_col13(spark, sf_dir):
    return history.thresholds(_stats(spark, sf_dir), how="column").select("pid", F.round("threshold", 9).alias("threshold"))


def history_pivot(spark, sf_dir):
    return history.matrix(_stats(spark, sf_dir), "n_related")


def push_cap(spark, sf_dir):
    return push.capped(_scored(spark, sf_dir), _thresholds(spark, sf_dir), scope=["day"]).select("seq", "pid", "day", F.col("at").alias("nth"))


def push_counters(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("pushed", F.col("score") > 0.5)
    return push.counters(rows).select("seq", "pid", "received", "n_pushed")


def push_dedup_pipeline(spark, sf_dir):
    rows = _scored(spark, sf_dir).where("score >= 0.15")
    related, pushed = dedup.related_and_pushed(rows, _thresholds(spark, sf_dir), scope=["day"])
    return related.select("seq", F.lit("related").alias("kind")).unionByName(pushed.select("seq", F.lit("pushed").alias("kind")))


def digest_top100(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumns({"total": F.round(F.col("score"), 6), "tid": F.col("seq").cast("string")})
    return push.digest(rows).select("seq", "rank", digest_line("RUN").alias("line"))


def anti_join_seen(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    return dedup.unseen(rows, rows.where("score > 0.8"), ["orig_id"]).select("seq")


def running_max_feedback(spark, sf_dir):
    rows = _scored(spark, sf_dir).select("seq", F.col("user_id").alias("pid"), (F.col("score") * 5).alias("sim"))
    return feedback.record_rows(rows).select("seq", "pid", F.round("best_before", 9).alias("best_before"))


def top2_expansion(spark, sf_dir):
    rows = _scored(spark, sf_dir).select("seq", F.col("pid"), F.round(F.col("score") * 5, 6).cast("decimal(20,6)").alias("sim"), F.concat(F.lit("w"), (F.col("user_id") % 17).cast("string")).alias("word"))
    terms = feedback.term_scores(feedback.record_rows(rows.select("seq", "pid", "sim")), rows.select("seq", "word"))
    return feedback.expansion(terms).select("pid", "word", F.col("score").cast("double").alias("score"), F.col("at").alias("nth"))


def sortedness_check(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return checks.unsorted(rows, "event_id", "value", ["user_id"]).select("event_id")


# -- duplicates and language --------------------------------------------------------------------------------------------


def dedup_exact(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.md5("text").alias("hash"))
    return dedup.first_by(rows, ["hash"], ["doc_id"]).select("doc_id")


def simhash(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", dedup.fingerprint(F.col("text")).alias("hash"))


def ngram_counts(spark, sf_dir):
    d = _docs(spark, sf_dir).where("lang = 'en'").select("doc_id", F.lower(F.col("text")).alias("t"))
    dictionary = spark.createDataFrame([(x,) for x in sorted({w[0] for w in WEIGHTS})], "ngram string")
    return language.ngram_counts(d, "doc_id", F.col("t"), 3, dictionary)


def lang_softmax(spark, sf_dir):
    weights = spark.createDataFrame(WEIGHTS, "ngram string, lang string, weight double").withColumn("weight", F.col("weight") / 64)
    d = _docs(spark, sf_dir).select("doc_id", language.label_of(F.lower("text"), weights).alias("found")).where("found is not null")
    return d.select("doc_id", F.col("found.lang").alias("label"), F.round("found.p", 6).alias("p"))


def lang_trained(spark, sf_dir):
    """A model trained on the labelled documents, and how often it is right. Texts are normalised once."""
    docs = _docs(spark, sf_dir)
    bodies = scratch(docs.select("doc_id", "lang", language.body_of(F.col("text")).alias("text")))
    found = language.identify(bodies, "doc_id", "text", language.train(bodies, 2, bodies=True), 2, bodies=True)
    return docs.select("doc_id", F.col("lang").alias("truth")).join(found, "doc_id").groupBy("truth", "lang").agg(F.count("*").alias("n"))


# -- streams ------------------------------------------------------------------------------------------------------------


def _stream(spark, sf_dir):
    schema = _t(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    kinds = F.ascii(F.substring("event_type", 1, 1)) % 5
    return e.select(F.col("event_id").alias("seq"), kinds.cast("int").alias("pid"), F.date_format("ts", "yyyyMMdd").alias("day"), (F.col("value") / 500).alias("score"), F.col("ts").cast("timestamp").alias("ts"))


def stream_push(spark, sf_dir):
    from skimmer.streaming import push as S

    rows = _stream(spark, sf_dir).withColumn("threshold", F.lit(0.5))
    return S.run_available(S.pushes(rows)).select("seq", "pid", "day", F.col("pushed").alias("nth"))


def stream_daily(spark, sf_dir):
    from skimmer.streaming import push as S

    daily = S.run_available(S.daily_counts(_stream(spark, sf_dir)), "complete")
    return daily.select(F.date_format("start", "yyyyMMdd").alias("day"), "pid", "n", F.round("best", 9).alias("best"))


#: Bytes of a stream's file, about: a batch of more has more files, as a file of lines is one task.
STREAM_FILE_BYTES = 16 << 20


def _files(rows, by, n, least):
    """(the largest of a column and one, files of each of n batches): all batches have as many, as that number makes a batch."""
    size = lambda f: F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.simpleString() == "string" else F.lit(8)
    found = rows.agg(F.max(by).alias("top"), F.sum(sum((size(f) for f in rows.schema), F.lit(0).cast("long"))).alias("bytes")).first()
    return (found.top or 0) + 1, max(least, -(-(found.bytes or 0) // (n * STREAM_FILE_BYTES)))


def _in_batches(rows, by, n=4, files=2):
    """A stream of rows in n micro-batches by ranges of a column, each of so many files or more, written one after another: files are
    read in the order of their times."""
    path = scratch_path(rows.sparkSession)
    top, files = _files(rows, by, n, files)
    for i in range(n):
        part = rows.where(F.floor(F.col(by) * n / top) == i)
        part.repartitionByRange(files, by).write.mode("append").parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def stream_engine(spark, sf_dir):
    """Duplicates by content and origin, and the cap, in one state, over several micro-batches."""
    from skimmer.streaming import push as S

    rows = _scored(spark, sf_dir).withColumn("hash", F.concat_ws("-", F.col("orig_id").cast("string"), (F.col("seq") % 3).cast("string")))
    rows = rows.where("score >= 0.15").withColumn("threshold", F.lit(0.5)).drop("user_id")
    return S.run_available(S.engine(_in_batches(rows, "seq"))).select("seq", "kind")


def _message_batches(spark, sf_dir, n=4, files=2):
    """(path, files of a batch): message lines as text files for n micro-batches, by time, with noise between them."""
    m = _messages(spark, sf_dir).where("text is not null")
    noise = F.when(F.col("doc_id") % 7 == 0, F.array(F.to_json(F.struct(*[c for c in m.columns if c != "doc_id"])), F.lit('{"delete": 1}'), F.lit("noise"))).otherwise(F.array(F.to_json(F.struct(*[c for c in m.columns if c != "doc_id"]))))
    lines, path = scratch(m.select("doc_id", F.explode(noise).alias("value"))), scratch_path(spark)
    top, files = _files(lines, "doc_id", n, files)
    for i in range(n):
        lines.where(F.floor(F.col("doc_id") * n / top) == i).repartitionByRange(files, "doc_id").select("value").write.mode("append").option("compression", "gzip").text(path)
    return path, files


def _stand_in(rows):
    """A score that SQL can follow, for the fitted model's."""
    return rows.withColumn("score", (F.col("user.followers_count") % 100 + 1) / 100)


def _streamed(spark, sf_dir, files=2):
    from skimmer.streaming import engine as E

    thresholds = spark.createDataFrame([(p[0], 0.5) for p in PROFILES], "pid int, threshold double")
    lines = readers.stream_lines(spark, *_message_batches(spark, sf_dir, files=files))
    # contents stay known for the whole of this run, as the rule in SQL has it
    return E.filtered(lines, _profiles(spark), thresholds, _stand_in, keep_days=36_500, hash_of=F.md5, lang="user.lang", unicode=False)


def stream_filtered(spark, sf_dir):
    """The whole engine on a stream, from JSON lines: parsed, gated, classified, scored, contents and pushes in two states."""
    from skimmer.streaming import engine as E

    stream, out = _streamed(spark, sf_dir), scratch_path(spark)
    E.start(stream, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return E.read_batches(spark, f"{out}/rows", stream.schema).select("tid", "pid", "kind", "received", "pushed")


def stream_counts(spark, sf_dir):
    """What the listener counts while that runs."""
    from skimmer.streaming import engine as E
    from skimmer.streaming.metrics import Counts

    stream, out, counts = _streamed(spark, sf_dir), scratch_path(spark), Counts()
    spark.streams.addListener(counts)
    E.start(stream, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    counts.wait()
    spark.streams.removeListener(counts)
    n = [counts.total(*x) for x in (("received", "n"), ("accepted", "n"), ("decided", "related"), ("decided", "pushed"))]
    return spark.createDataFrame([n], "received long, accepted long, related long, pushed long")


def stream_feedback(spark, sf_dir):
    """Version 3 over four micro-batches: a batch is classified with the words that earlier batches' records lent."""
    from skimmer.streaming import engine as E

    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "text", "lang")
    out = scratch_path(spark)
    E.start(_in_batches(docs, "seq"), out, f"{out}-checkpoint", write=E.Feedback(_profiles(spark), out, lang="lang", unicode=False)).awaitTermination()
    return spark.read.schema("seq long, pid int, similarity double, batch int").parquet(f"{out}/rows").select(F.col("seq").alias("doc_id"), "pid", F.round("similarity", 9).alias("similarity"), "batch")


def _predicted(spark, sf_dir):
    """Scored rows with a threshold that few pass, and the mean day of their profile for a prediction."""
    rows = _scored(spark, sf_dir).drop("user_id", "hash", "orig_id").withColumn("threshold", F.lit(0.3))
    mean = rows.groupBy("pid", "day").agg(F.count("*").alias("n")).groupBy("pid").agg(F.avg("n").alias("predicted"))
    return scratch(rows.join(match.small(scratch(mean)), "pid"))


def adaptive_threshold(spark, sf_dir):
    """The threshold that gives way, as an ordered fold of each profile's day."""
    return push.adaptive(_predicted(spark, sf_dir), scope=["day"]).select("seq", "pid", "day", F.col("at").alias("nth"))


def stream_adaptive(spark, sf_dir):
    """The same as keyed state."""
    from skimmer.streaming import push as S

    return S.run_available(S.adaptive(_in_batches(_predicted(spark, sf_dir), "seq"))).select("seq", "pid", "day", F.col("pushed").alias("nth"))


NAMES = [
    extract_json, clean_text, char_ratio, tokenize_count, stopwords, text_normalize, collapse_runs, en_counts, keyword_compile, inverted_index,
    prefix_lookup, multigram_contains, candidates, cnf_match, topic_match, cosine_pairs, sim_v1, sim_v2, sim_v3, argmax_profile,
    ranker_features_text, ranker_features_user, ranker_training_join, ranker_score, word2vec, total_score, day_counts_zero_filled, rank_k,
    exp_smoothing, moving_avg_3d, threshold_col13, history_pivot, push_cap, push_counters, push_dedup_pipeline, digest_top100, anti_join_seen,
    running_max_feedback, top2_expansion, sortedness_check, dedup_exact, simhash, ngram_counts, lang_softmax, lang_trained, stream_push, stream_daily,
    source_messages, source_language_lines, enriched_json, source_keywords, source_topics, source_vectors, source_training, source_wiki, source_corpus,
    source_feature_counts, label_lists, file_digest, file_push_log, file_history_matrix, file_profiles, filtered, stream_engine,
    pattern_offsets, english_gate, similarity_join, smoothing_by_day, history_folder, model_saved, file_english_lines,
    source_expanded, source_lines, tagged_filter, stream_filtered, stream_counts, stream_feedback, adaptive_threshold, stream_adaptive,
]
QUERIES = {f"q_{f.__name__}": f for f in NAMES}
