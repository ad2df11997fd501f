"""Unit tests of the filtering engine, with the quirks of the survey's register."""

import gzip
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from skimmer.functions import decode, features as R, text as X
from skimmer.operators import checks, dedup, feedback, history, keywords as K, language, match, push, similarity, tagger
from skimmer.plans import queries
from skimmer.sources import readers, writers


def col(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_clean_and_tokenise(spark):
    assert col(spark, ["hi http://x.y/z #tag @me"], X.strip_marks) == ["hi  tag me"]
    assert col(spark, ["u.s.a. tax-free rock"], X.tokens) == [["u.s.a.", "tax-free", "rock"]]
    assert col(spark, ["é a", "", "abc"], X.clean_ratio) == [2 / 3, None, 1.0]
    assert col(spark, ["a\t\tb\n\nc"], X.collapse_breaks) == ["a b c"]
    assert col(spark, ["the cat the rat"], lambda v: X.without_stopwords(X.tokens(v))) == [["cat", "rat"]]


def test_normaliser(spark):
    assert col(spark, ["sooooo !!!!"], X.collapse_runs) == ["soo !"]
    assert col(spark, ["IŞTANBUL Äb"], X.lower_but_i) == ["Iştanbul äb"]
    assert col(spark, ["ắx à"], X.compose_tones) == ["ắx à"]
    # the rule for retweet marks leaves a blank at the beginning; the whole chain trims it
    assert col(spark, ["hahahahaha x HAHAHA"], X.normalise_message) == [" haha x HAHA"]
    assert col(spark, ["hahaha hehehe hahaha"], lambda v: X.normalise_message(v, True)) == [" haha hehe hahaha"]
    assert col(spark, ["rt rt @you see #x it via "], X.normalise_message)[0].split() == ["see", "it"]
    assert col(spark, ["en\tmeta\tbody", "plain"], lambda v: F.concat_ws("|", *X.labelled_line(v))) == ["en|body", "|plain"]
    assert col(spark, ["a–b 2015 Жx"], lambda v: X.latin_only(X.digits_to_zero(X.unify_dashes(v)))) == ["a-b 0 x"]


def test_entities(spark):
    assert col(spark, ["&lt;&#65;&#x41;&#xe9;&nope;&amp", None], decode.html_entities) == ["<AAé&amp", None]
    assert decode.decode_entity("#xe9", strict_hex=True) == ""


def test_features(spark):
    t = ["Wow Great #Deal at Acme.. I like", "a b  ", " a", "   ", ""]
    assert col(spark, t, R.word_count) == [7, 2, 2, 0, 1]
    assert col(spark, t[:1], R.capitals) == [2]
    assert col(spark, t[:1] + t[3:4], R.characters_per_word) == [4, None]
    assert col(spark, t[:1], R.has_topic) == [True] and col(spark, t[:1], R.has_ellipsis) == [True] and col(spark, t[:1], R.is_personal) == [True]
    assert col(spark, [0, 1000, None, -3], R.log_count, "long") == [0.0, pytest.approx(3.0), 0.0, 0.0]
    assert col(spark, [103550, 0, None], R.retweet_level, "long") == [6, 0, 0]


def test_keywords(spark):
    df = spark.createDataFrame([(1, "x\ty z", "bus || buses && nyc || New York"), (2, "", "|| a"), (3, "irelandi | georgia", "q")], "pid int, optional string, required string")
    rows = {r.pid: r for r in K.compiled(df).collect()}
    assert rows[1].clauses == [["bus", "buses"], ["nyc", "new york"]] and rows[1].optional == ["x", "y z"] and sorted(rows[1].multigrams) == ["new york", "y z"]
    assert rows[2].optional == [""] and rows[2].clauses == [["a"]]
    assert rows[3].optional == ["irelandi | georgia"]


def test_cnf_and_similarity(spark):
    comp = K.compiled(spark.createDataFrame([(0, "w||x||y||z", "bus||buses && nyc"), (1, "", "bus")], "pid int, optional string, required string"))
    tok = spark.createDataFrame([(1, "bus"), (1, "nyc"), (1, "w"), (2, "bus")], "t int, word string")
    met = match.matches(tok, K.requirements(comp), comp, "t")
    assert sorted(map(tuple, met.collect())) == [(1, 0), (1, 1), (2, 1)]
    sims = {(r.t, r.pid): r.sim for r in similarity.exact_score(met, tok, K.optionals(comp), "t").collect()}
    assert sims == {(1, 0): 0.5, (1, 1): 0.0, (2, 1): 0.0}
    best = {r.t: (r.pid, r.similarity) for r in similarity.argmax(similarity.exact_score(met, tok, K.optionals(comp), "t"), "t").collect()}
    assert best == {1: (0, 0.75), 2: (1, 0.5)}
    b = spark.createDataFrame([(1, 0, "a", 3, 1.0), (1, 0, "b", 3, 0.6), (1, 0, "c", 3, 0.0)], "t int, pid int, keyword string, n_optional int, best double")
    got = [similarity.score(b, "t", v).first().sim for v in (1, 2, 3)]
    assert got == [pytest.approx(math.sqrt(2 / 3)), pytest.approx(1.6 / 3), pytest.approx(1.6)]
    arrays = match.matches_by_arrays(spark.createDataFrame([(1, ["bus", "nyc"]), (2, ["bus"])], "t int, w array<string>"), comp, "t", F.col("w"))
    assert sorted(map(tuple, arrays.collect())) == [(1, 0), (1, 1), (2, 1)]


def test_history(spark):
    rows = [(0, "d1", float(s)) for s in range(1, 13)] + [(1, "d1", s) for s in (7.0, 5.0, 6.0, 9.0)]
    scored = spark.createDataFrame(rows, "pid int, day string, score double")
    stats = history.daily(scored, spark.range(3).select(F.col("id").cast("int").alias("pid")), scored)
    assert {r.pid: (r.n_related, r.rank_score) for r in stats.collect()} == {0: (12, 3.0), 1: (4, 5.0), 2: (0, 0.15)}
    assert col(spark, [[1.0, 2.0, 3.0], [4.0], []], history.smoothed, "array<double>") == [pytest.approx(2.764), pytest.approx(4.0), None]


def test_push_and_digest(spark):
    rows = spark.createDataFrame([(i, 0, "d", 0.5 if i == 0 else 0.51) for i in range(14)], "seq int, pid int, day string, score double")
    thr = spark.createDataFrame([(0, 0.5)], "pid int, threshold double")
    assert [r.seq for r in push.capped(rows, thr).orderBy("seq").collect()] == list(range(1, 11))
    ranked = push.digest(rows.withColumns({"total": F.lit(0.25), "tid": F.col("seq").cast("string")}), 3)
    assert [r.line for r in ranked.orderBy("rank").select(writers.digest_line("T").alias("line")).collect()] == [f"d\tMB226\tQ0\t{i}\t{i + 1}\t0.250000\tT" for i in range(3)]


def sequential(rows, threshold, cap):
    hashes, ids, count, related, pushed = set(), set(), {}, [], []
    for seq, h, orig, pid, score in rows:
        if h in hashes or orig in ids:
            continue
        if count.get(pid, 0) != cap and round(score, 12) > threshold:
            count[pid] = count.get(pid, 0) + 1
            pushed.append(seq)
            ids.add(orig)
        related.append(seq)
        hashes.add(h)
    return related, pushed


@pytest.mark.parametrize("seed", range(4))
def test_window_form_equals_the_sequence(spark, seed):
    rng = random.Random(seed)
    pid_of = [rng.randrange(3) for _ in range(40)]
    rows = []
    for seq in range(200):
        orig = rng.randrange(40)
        rows.append((seq, f"{orig}-{rng.randrange(3)}", orig, pid_of[orig], rng.random()))
    df = spark.createDataFrame(rows, "seq int, hash string, orig_id int, pid int, score double")
    related, pushed = dedup.related_and_pushed(df, spark.createDataFrame([(p, 0.6) for p in range(3)], "pid int, threshold double"), cap=4)
    want = sequential(rows, 0.6, 4)
    assert (sorted(r.seq for r in related.collect()), sorted(r.seq for r in pushed.collect())) == (want[0], sorted(want[1]))


@pytest.mark.parametrize("seed", range(2))
def test_stream_equals_the_sequence(spark, tmp_path, seed):
    """Over several micro-batches, with origins of many profiles and contents of many origins: where the window form may differ."""
    from skimmer.streaming import push as S

    rng = random.Random(seed)
    rows = [(seq, f"h{rng.randrange(60)}", rng.randrange(40), rng.randrange(3), rng.random()) for seq in range(240)]
    schema = "seq long, hash string, orig_id long, pid int, score double"
    for i in range(3):
        part = spark.createDataFrame(rows[i * 80 : i * 80 + 80], schema).withColumns({"threshold": F.lit(0.6), "day": F.lit("20240101"), "all": F.lit(0), "ts": F.timestamp_seconds(F.lit(1704067200) + F.col("seq"))})
        part.repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = S.run_available(S.engine(stream, cap=4, scope=("all",))).collect()
    counts: dict = {}
    hashes, ids, related, pushed = set(), set(), [], []
    for seq, h, orig, pid, score in rows:  # one cap for the whole scope
        if h in hashes or orig in ids:
            continue
        if counts.get(0, 0) < 4 and round(score, 12) > 0.6:
            counts[0] = counts.get(0, 0) + 1
            pushed.append(seq)
            ids.add(orig)
        related.append(seq)
        hashes.add(h)
    assert (sorted(r.seq for r in got if r.kind == "related"), sorted(r.seq for r in got if r.kind == "pushed")) == (related, pushed)


def test_fingerprints(spark):
    a, b, c = col(spark, ["The same text!", "the  SAME text", "another one"], lambda v: dedup.bit_votes(dedup.shingled(v)))
    assert a == b != c


def slow_fingerprint(text):
    import xxhash

    kept = re.sub(r"[^a-z0-9_]+", "", text.lower())
    h = [xxhash.xxh64_intdigest(kept[i : i + 4], seed=42) for i in range(max(1, len(kept) - 3))]
    bits = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return bits - (1 << 64) * (bits >> 63)


def test_fingerprints_of_whole_texts(spark, tmp_path):
    rng = random.Random(4)
    words = ["the", "Thon!", "é", "12", "a_b", "漢字", "REED", "\n", "x"]
    head = " ".join(rng.choice(words) for _ in range(100))
    texts = ["", "a", "abc", "abcd", "漢", head, head + " one end", head + " the other end", *(head + " ".join(rng.choice(words) for _ in range(n)) for n in (3, 400, 40_000))]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate([*texts, None])], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.hash for r in queries.simhash(spark, str(tmp_path)).collect()}
    assert got == {i: slow_fingerprint(t) for i, t in enumerate(texts)} | {len(texts): None}
    assert len({got[i] for i in (5, 6, 7)}) == 3
    short = texts[:8]
    assert col(spark, short, lambda v: dedup.bit_votes(dedup.shingled(v))) == [got[i] for i in range(8)]


def test_feedback(spark):
    rows = spark.createDataFrame([(1, 0, 0.9), (2, 0, 1.2), (3, 0, 1.1), (4, 0, 1.5)], "seq int, pid int, sim double")
    rec = feedback.record_rows(rows)
    assert sorted(r.seq for r in rec.collect()) == [2, 4]
    words = spark.createDataFrame([(2, "b"), (2, "a"), (4, "c"), (4, "a")], "seq int, word string")
    assert [(r.word, r.at) for r in feedback.expansion(feedback.term_scores(rec, words)).orderBy("at").collect()] == [("a", 1), ("c", 2)]


def test_language(spark):
    docs = spark.createDataFrame([(1, "abc")], "k int, t string")
    d = spark.createDataFrame([("ab",), ("bc",), ("c",)], "ngram string")
    assert sorted((r.ngram, r.n) for r in language.ngram_counts(docs, "k", F.col("t"), 3, d).collect()) == [("ab", 1), ("bc", 1), ("c", 1)]
    counts = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "k int, ngram string, n long")
    w = spark.createDataFrame([("x", "a", 2.0), ("x", "b", 1.0), ("x", "c", 0.0), ("y", "a", 1.0), ("y", "b", 1.0), ("y", "c", 0.0)], "ngram string, lang string, weight double")
    got = {r.k: (r.lang, round(r.p, 4)) for r in language.labels(language.probabilities(counts, w, "k"), "k").collect()}
    assert got == {1: ("a", 0.6652), 2: ("", 0.4223)}


def test_checks_and_tagger(spark):
    rows = spark.createDataFrame([(1, 5), (2, 7), (3, 7)], "i int, v int")
    assert [r.i for r in checks.unsorted(rows, "i", "v").collect()] == [3]
    assert col(spark, [["the", "quickly", "red", "42"]], tagger.open_classes, "array<string>") == [["red"]]
    keep = tagger.arrow_tagger(lambda ws: ["NN" if w == "cat" else "DT" for w in ws])
    assert col(spark, [["the", "cat"]], keep, "array<string>") == [["cat"]]


def test_readers(spark, tmp_path):
    msg = {"id_str": "1", "text": "a\tb", "created_at": "x", "timestamp_ms": "1437379200000", "user": {"screen_name": "me", "lang": "en", "followers_count": 10, "statuses_count": 5}, "entities": {"urls": [{"url": "u"}], "user_mentions": []}}
    again = msg | {"id_str": "2", "retweeted_status": {"id_str": "1", "text": "orig", "retweet_count": 12, "user": {"followers_count": 1000, "statuses_count": 0}}}
    with gzip.open(tmp_path / "m.gz", "wt") as f:
        f.write("\n".join([json.dumps(msg), json.dumps(again), '{"delete": 1}', "noise", "{broken"]))
    got = readers.messages(spark, str(tmp_path / "m.gz"))
    rows = readers.extract(got).withColumns(R.of_message()).orderBy("tid").collect()
    assert [(r.full_text, r.tid, r.orig_id) for r in rows] == [("me a b", "1", "1"), ("me orig", "2", "1")]
    assert rows[1].Followers == pytest.approx(3.0) and rows[1].RetweetLevel == 2 and rows[0].Url and not rows[0].Mention
    (tmp_path / "k").write_text('{"tid": "MB226", "keyword": {"0": "a\tb", "1": "c"}}\r\n')
    assert readers.keywords(spark, str(tmp_path / "k")).first().pid == 0
    (tmp_path / "p").write_text("<topics>\r\n<top>\r\n<num> Number: MB227 </num>\r\n<title>\r\nA title\r\n</title>\r\n</top></topics>")
    assert tuple(readers.topics(spark, str(tmp_path / "p")).first()) == (1, "MB227", "A title")
    (tmp_path / "a").write_text("@relation x\n@attribute y real\n\n@data\nTrue,False,True,3,1,283,2863,4,False,0,0,True,1\n")
    assert readers.training_rows(spark, str(tmp_path / "a")).first().Importance == 1
    (tmp_path / "v").write_text("2 2\nfoo 0.5 1\nbar 1 2\n")
    assert {r.word: r.vec for r in readers.word_vectors(spark, str(tmp_path / "v")).collect()} == {"foo": [0.5, 1.0], "bar": [1.0, 2.0]}
    (tmp_path / "c").write_text("en\tx\thello\nfr\tbonjour\n")
    assert sorted(map(tuple, readers.language_corpus(spark, str(tmp_path / "c"), ["en", "fr"]).collect())) == [("en", "hello"), ("fr", "bonjour")]
    with pytest.raises(Exception):
        readers.language_corpus(spark, str(tmp_path / "c"), ["en"]).collect()
    (tmp_path / "w").write_text("<mediawiki><page><title>T</title><ns>0</ns><revision><text>'''Bold''' [[A|link]] {{tmpl}} end</text></revision></page><page><title>R</title><ns>0</ns><redirect title='x'/><revision><text>no</text></revision></page></mediawiki>")
    assert [tuple(r) for r in readers.wiki_pages(spark, str(tmp_path / "w")).where("title = 'T'").collect()] == [("T", "Bold link end")]


def test_writers_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("20150720", 0, "9", 1, 0.5)], "day string, pid int, tid string, rank int, total double")
    writers.write_digest(rows, str(tmp_path / "d"))
    assert spark.read.text(str(tmp_path / "d")).first().value == "20150720\tMB226\tQ0\t9\t1\t0.500000\tRUN"
    pushed = spark.createDataFrame([(0, "9", 1437379200, 0.7, 0.5, "t")], "pid int, tid string, delivered long, similarity double, total double, text string")
    writers.write_pushes(pushed, str(tmp_path / "p"), extended=True)
    assert spark.read.text(str(tmp_path / "p")).first().value == "MB226\t9\t1437379200\tRUN\t0.7\t0.5\tt"
    writers.write_profiles(pushed.withColumn("day", F.lit("d")), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/json")).count() == 1
    wide = spark.createDataFrame([(1, 3.0, 4.0), (0, 1.0, 2.0)], "pid int, a double, b double")
    writers.write_history_matrix(wide, str(tmp_path / "m"), ["a", "b"])
    assert [r["values"] for r in writers.read_history_matrix(spark, str(tmp_path / "m")).orderBy("pid").collect()] == [[1.0, 2.0], [3.0, 4.0]]


def test_readers_of_folders_and_tables(spark, tmp_path):
    for day, line in (("01", "20150701\tMB226\tQ0\t9\t1\t0.5\tRUN"), ("02", "20150702\tMB227\tQ0\t8\t1\t0.25\tRUN")):
        (tmp_path / "h").mkdir(exist_ok=True)
        (tmp_path / "h" / f"day{day}").write_text(line + "\n")
    rows = readers.history(spark, str(tmp_path / "h")).collect()
    assert sorted(map(tuple, rows)) == [("01", 0, "9", 0.5), ("02", 1, "8", 0.25)]
    writers.write_history(spark.createDataFrame([("01", 0, "9", 0.5)], "day string, pid int, tid string, score double"), str(tmp_path / "t"))
    assert tuple(readers.named_history(spark, str(tmp_path / "t")).first()) == ("01", 0, "9", 0.5)
    made = []
    compute = lambda: made.append(1) or spark.range(3)
    assert [readers.materialised(spark, str(tmp_path / "m"), compute).count() for _ in range(2)] == [3, 3] and made == [1]
    (tmp_path / "e").write_text("a  b c\n")
    assert readers.expanded_profiles(spark, str(tmp_path / "e")).first().words == ["a", "b", "c"]
    pages = spark.createDataFrame([("T", "Some Words " * 30), ("short", "a b")], "title string, text string")
    assert [(r.title, len(r.words)) for r in readers.wiki_words(pages).collect()] == [("T", 60)]
    spark.createDataFrame([("ab", "en", 1.0)], "ngram string, lang string, weight double").write.parquet(str(tmp_path / "w"))
    assert readers.language_weights(spark, str(tmp_path / "w")).first().weight == 1.0


def test_stream_of_lines_and_contents(spark, tmp_path):
    from skimmer.streaming import push as S

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("x\ny\nx\n")
    seen, log = [], []
    listener = S.progress_listener(lambda *a: log.append(a))
    spark.streams.addListener(listener)
    query = S.start(readers.stream_lines(spark, str(tmp_path / "in")), lambda batch, i: seen.extend(r.value for r in batch.collect()), str(tmp_path / "c"))
    query.awaitTermination()
    spark.streams.removeListener(listener)
    assert sorted(seen) == ["x", "x", "y"]
    rows = readers.stream_lines(spark, str(tmp_path / "in")).select(F.col("value").alias("hash"), F.timestamp_seconds(F.lit(1704067200)).alias("ts"))
    assert sorted(r.hash for r in S.run_available(S.new_contents(rows)).collect()) == ["x", "y"]


def test_expansion_and_english_gate(spark):
    terms = spark.createDataFrame([(1, "new"), (1, "a")], "pid int, word string")
    got = feedback.expanded(spark.createDataFrame([(1, ["a"]), (2, ["b"])], "pid int, optional array<string>"), terms)
    assert {r.pid: r.optional for r in got.collect()} == {1: ["a", "new"], 2: ["b"]}
    corpus = spark.createDataFrame([("en", "the cat and the dog"), ("fr", "le chat et le chien")] * 5, "lang string, text string")
    lines = spark.createDataFrame([(1, "the dog and cat"), (2, "le chien et chat")], "k int, text string")
    assert [r.k for r in language.english_lines(lines, "k", "text", language.train(corpus, 2), 2).collect()] == [1]
    assert [r.word for r in K.lookup(spark.createDataFrame([("a",)], "word string"), spark.createDataFrame([("a",), ("b",)], "word string")).collect()] == ["a"]


def test_a_corpus_of_odd_texts_and_labels_is_read_whole(spark, tmp_path):
    import duckdb

    from skimmer.plans.oracles import ORACLES
    from skimmer.plans.queries import QUERIES

    texts = ["", "\n", "\t", "\u2028", "\u0085x", "a\u2028b\tc\r\nd", "plain", None]
    langs = ["en", "zh_CN", "", "--", "x\ty\n", "é1", None, *(f"x{i}" for i in range(1100))]
    rows = [(i, texts[i % 8], langs[i // 8 if i < 56 else i % len(langs)]) for i in range(2300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in QUERIES["q_source_corpus"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert len(got) > 1000 and sorted(got) == sorted(con.execute(ORACLES["q_source_corpus"]).fetchall())


def test_normaliser_that_looks_first_equals_the_plain_chain(spark):
    import random

    r = random.Random(11)
    parts = ["rt", "rt:", "rt ", " ", "  ", ":)", ";-d", "xd", " xo ", "@you", "#x", "http", "https://a", "via", "live on", " via ", "‐", "―", "à", "Ẹ", "Ж", "x", "b", "\n"]
    texts = ["", "x)", " rt x", "rt rt: a rt b", *("".join(r.choice(parts) for _ in range(r.randrange(9))) for _ in range(400))]

    def plain(v):
        for pattern, by in ((X.MARKED, ""), (X.FACE, " "), (r"(^| )(rt[ :]+)*", " "), ("(?i)" + X.LAUGH, "$1$2$1$2"), (X.ENDING, "")):
            v = F.regexp_replace(v, pattern, by)
        return v

    assert col(spark, texts, X.normalise_message) == col(spark, texts, plain)
    assert col(spark, texts, X.unify_dashes) == col(spark, texts, lambda v: F.regexp_replace(v, X.DASHES, "-"))
    assert col(spark, texts, X.latin_only) == col(spark, texts, lambda v: F.regexp_replace(F.regexp_replace(v, X.NOT_LATIN, " "), "  +", " "))
