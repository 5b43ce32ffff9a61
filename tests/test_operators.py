"""Operators on small tables: the properties that results must have."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from brightvane.operators import analytics, audit, briefs, dedupe, extraction, scoring, taxonomy, trends, voice
from brightvane.sources import landing

NOW = F.lit("2024-01-31 00:00:00").cast("timestamp")


def test_scores(spark):
    ten = {k: F.lit(10.0) for k in scoring.lists.WEIGHTS}
    odd = {k: F.lit(None).cast("double") for k in scoring.lists.WEIGHTS} | {"novelty": F.lit(40.0)}
    row = spark.range(1).select(scoring.opportunity(ten)[0].alias("a"), scoring.opportunity(odd)[0].alias("b"), *[c.alias(n) for c, n in zip(scoring.risk({"weak_sourcing": F.lit("thin"), "other": F.lit(True), "generic_tone": F.lit(False)}), ("t", "band", "f"), strict=True)], scoring.confidence(F.lit(1), F.lit(9), F.lit(10.0), F.lit(9), F.lit(False)).alias("c")).first()
    assert (row.a, row.b) == (100.0, 10.0) and (row.t, row.band) == (26.0, "Moderate") and [x.factor for x in row.f] == ["weak_sourcing", "other"] and row.c == round((10 + 25 + 30 + 15) * 0.65 * 0.9, 1)


def test_freshness_falls(spark):
    got = [r[0] for r in spark.range(0, 140, 10).select(scoring.freshness(NOW - F.make_dt_interval(F.col("id").cast("int")), NOW)).collect()]
    assert got[0] == 10.0 and got[-1] == 0.0 and got == sorted(got, reverse=True)


def test_trend_rules(spark):
    rows = [(1, 1, 1, 0, 1.0, 5.0, 0), (4, 1, 4, 0, 4.0, 5.0, 0), (3, 3, 3, 0, 3.0, 5.0, 1), (9, 3, 3, 1, 2.0, 3.0, 0), (5, 3, 3, 2, 0.5, 5.0, 0), (5, 3, 1, 3, -0.67, 5.0, 0), (5, 3, 2, 2, 0.0, 5.0, 0)]
    start = NOW - F.expr("interval 21 days")
    df = spark.createDataFrame(rows, "s int, d int, n int, p int, g double, v double, recent int")
    first = F.when(F.col("recent") == 1, NOW).otherwise(start - F.expr("interval 9 days"))
    got = [r[0] for r in df.select(trends.classify(*[F.col(c) for c in "sdnpgv"], first, start)).collect()]
    assert got == ["low_confidence", "low_confidence", "emerging", "saturated", "rising", "declining", "stable"]


def test_diversify(spark):
    df = spark.createDataFrame([(i, "one" if i < 6 else f"d{i}", float(100 - i)) for i in range(10)], "source_id int, source_domain string, opportunity_score double")
    assert [r.source_id for r in analytics.diversify(df, 5).collect()] == [0, 1, 6, 7, 8]
    assert [r.source_id for r in analytics.diversify(df.where("source_domain = 'one'"), 5).collect()] == [0, 1, 2, 3, 4]


def test_titles():
    assert dedupe.token_set_ratio("a b c d", "d c b a") == 100.0 and dedupe.token_set_ratio("", "x") == 0.0 and dedupe.token_set_ratio("new tool for shops", "old ways of work") < 60


def test_title_and_body_duplicates(spark):
    body = " ".join(f"w{i % 150} is {i}" for i in range(160))
    rows = [(1, "https://a.com/1", "Local shops miss one in three calls | Daily", body), (2, "https://a.com/2", "Local shops miss one in three calls", body + " more"), (3, "https://b.com/3", "Local shops miss one in three calls", body)]
    df = spark.createDataFrame(rows, "source_id long, source_url string, title string, cleaned_text string")
    assert [(r.source_id, r.matched_id) for r in dedupe.title_duplicates(df).collect()] == [(2, 1)]
    assert [(r.source_id, r.matched_id) for r in dedupe.body_duplicates(df).collect()] == [(2, 1)]
    assert sorted((r.source_id, r.matched_id) for r in dedupe.body_duplicates(df, block="none").collect()) == [(2, 1), (3, 1)]
    both = dedupe.verdicts(dedupe.title_duplicates(df), dedupe.hash_duplicates(df), dedupe.body_duplicates(df)).collect()
    assert sorted((r.source_id, r.method) for r in both) == [(2, "title"), (3, "content_hash")]


def test_ratio_is_that_of_the_longest_common_subsequence():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        return 200.0 * row[-1] / (len(a) + len(b))

    draw = random.Random(3)
    for _ in range(300):
        a, b = ("".join(draw.choices("abc é", k=draw.randint(1, 70))) for _ in "ab")
        assert dedupe._ratio(a, b) == slow(a, b)


def test_titles_are_found_as_by_brute_force(spark):
    """Contained titles with rarer words on either side, titles with a typo in every word, equal and unrelated ones."""
    draw = random.Random(7)
    vocabulary = ["".join(draw.choices("etaoinshr", k=draw.randint(2, 11))) for _ in range(60)]
    titles = ["alpha bravo charlie delta", "alpha bravo charlie delta xray yankee zulu", "xray one two three", "yankee four five six", "zulu seven eight nine", "alpha bravo charlie delta mike november oscar papa"]
    titles += ["internationalised communications acknowledgement straightforwardly", "internationalizsed communicationns acknowledgementt straightforwardlyy"]
    for _ in range(120):
        one = draw.choices(vocabulary[:12] if draw.random() < 0.5 else vocabulary, k=draw.randint(4, 10))
        titles += [" ".join(one), " ".join(one + draw.choices(vocabulary, k=draw.randint(1, 4)))]
        titles.append(" ".join(w[:-1] + draw.choice("xyz") if draw.random() < 0.3 else w for w in one))
    rows = [(i, f"https://{'ab'[i % 7 == 0]}.com/{i}", t) for i, t in enumerate(titles)]
    df = spark.createDataFrame(rows, "source_id long, source_url string, title string")
    for block in ("domain", "none"):
        want = {}
        for i, u, x in rows:
            near = [(-dedupe.token_set_ratio(x, y), j) for j, v, y in rows[:i] if block == "none" or u[8] == v[8]]
            if near and -min(near)[0] >= 92:
                want[i] = (min(near)[1], -min(near)[0] / 100)
        got = {r.source_id: (r.matched_id, r.score) for r in dedupe.title_duplicates(df, block).collect()}
        assert got == want and (block == "domain" or {1, 7} <= set(got))


def test_hashes_and_shingles_cover_all_texts(spark, sf_dir, tmp_path):
    """Both registered queries against plain Python, over accented, boilerplate and compatibility forms too."""
    import __spark_entry__ as entry

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = docs.agg(F.max("doc_id")).first()[0]
    more = ["Él dijo “sí” — ya está", 'él dijo "sí" - ya está!', "ﬁne print here today", "fine print here today", "Our privacy policy is a b c d e f", "is a b c d e f our"]
    extra = spark.createDataFrame([(top + 1 + i, x) for i, x in enumerate(more)], "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("src0").alias("source"), F.length("text").cast("long").alias("n_chars"))
    docs.unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/pages.parquet").write.parquet(f"{tmp_path}/pages.parquet")

    def plain(x):
        x = unicodedata.normalize("NFKC", x).translate(str.maketrans("’‘“”–—", "''\"\"--"))
        return " ".join(re.sub(r"[^\w\s]", " ", re.sub(dedupe.lists.BOILERPLATE, " ", x).lower()).split())

    texts = {r.doc_id: plain(r.text) for r in docs.select("doc_id", "text").union(extra.select("doc_id", "text")).collect()}
    first, want, sizes = {}, set(), {}
    for i in sorted(texts):
        w = texts[i].split()
        sizes[i] = len({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) if w else 0
        if w and first.setdefault(texts[i], i) != i:
            want.add((i, first[texts[i]]))
    assert {(r.source_id, r.matched_id) for r in entry.queries()["e02_hash_duplicates"](spark, str(tmp_path)).collect()} == want and {(top + 2, top + 1), (top + 4, top + 3)} <= want
    assert {r.doc_id: r.shingles for r in entry.queries()["b08_shingles"](spark, str(tmp_path)).collect()} == sizes


def test_greedy_keeps_what_only_resembles_the_dropped(spark):
    pairs = spark.createDataFrame([(2, 1), (3, 2), (4, 3)], "source_id long, matched_id long")
    ids = spark.createDataFrame([(i,) for i in range(1, 6)], "source_id long")
    assert {r.source_id for r in dedupe.keep_greedily(pairs, ids).collect() if r.kept} == {1, 3, 5}


def test_hot_keys_give_the_same_pairs(spark, monkeypatch):
    rows = spark.range(60).selectExpr("id source_id", "concat('https://a.com/', if(id % 2 = 0, 0, id % 7)) source_url", "if(id % 3 = 0, 'same text', concat('text ', id % 10)) cleaned_text")
    want = [sorted(map(tuple, f(rows).collect())) for f in (dedupe.url_duplicates, dedupe.hash_duplicates)]
    monkeypatch.setattr(dedupe, "HOT_ROWS", 5)
    assert [sorted(map(tuple, f(rows).collect())) for f in (dedupe.url_duplicates, dedupe.hash_duplicates)] == want and len(want[0]) == 53


def test_phrases_keep_to_words(spark):
    df = spark.createDataFrame([("A spa, two spas; space spark é spaé",)], "t string")
    p = taxonomy.Phrases(F.col("t"))
    assert tuple(df.select(p.count("spa"), p.count("spa", plural=False), p.has("two spas")).first()) == (2, 1, True)


def test_audit(spark):
    drafts = spark.createDataFrame([(1, "Shops missed forty calls during every single week.\n\n- I think this is a problem worth solving.\nThe moon base opened with twelve astronauts yesterday.\nSources: x")], "draft_id long, draft_text string")
    proof = spark.createDataFrame([(1, 1, "We saw that shops missed forty calls during every single week.")], "draft_id long, passage_id long, passage string")
    rows = audit.audit_sentences(drafts, proof)
    assert [r.status for r in rows.orderBy("at").collect()][:3] == ["supported", "opinion", "unsupported"]
    assert audit.audit_scores(rows).first().evidence_score == 50.0
    found = audit.fabrications(spark.createDataFrame([(1, 'It grew 450 percent. "A line that nobody ever said to us" unlock')], "draft_id long, draft_text string"), proof).first()
    assert (found.invented_numbers, len(found.invented_quotes), found.banned_phrases) == (["450"], 1, ["unlock"])


def test_all_texts_are_audited_against_all_evidence(spark, sf_dir):
    """The registered audits equal the operators on every document with every benchmark item."""
    import __spark_entry__ as entry

    drafts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("draft_id"), F.left("text", F.lit(1500)).alias("draft_text")).where("draft_id < 60")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("passage_id"), F.col("text").alias("passage"))
    every = drafts.select("draft_id").crossJoin(items)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(audit.audit_shared(drafts, items)) == rows(audit.audit_sentences(drafts, every).select("draft_id", "at", "sentence", "status", "overlap", "best_passage"))
    assert rows(audit.fabrications_shared(drafts, items)) == rows(audit.fabrications(drafts, every))
    # in many blocks, over whose borders texts are found as well
    over = items.agg(F.lower(F.concat(F.right(F.max_by("passage", -F.col("passage_id")), F.lit(30)), F.lit(" "), F.left(F.max_by("passage", F.when(F.col("passage_id") == 1, 1)), F.lit(30)))).alias("draft_text"))
    more = drafts.union(over.select(F.lit(-1).cast("long"), F.concat("draft_text", F.lit(' "'), "draft_text", F.lit('"'))))
    assert rows(audit.audit_shared(more, items, chars=2000)) == rows(audit.audit_shared(more, items)) and audit.evidence_blocks(items, 2000).count() > 3
    assert rows(audit.fabrications_shared(more, items, chars=2000)) == rows(audit.fabrications_shared(more, items))
    ids = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    assert {r.draft_id for r in entry.queries()["k21_fabrications"](spark, sf_dir).collect()} == ids
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("draft_id"), F.col("text").alias("draft_text"))
    want = {r.draft_id for r in audit._units(texts, True).where("size(tokens) > 0").select("draft_id").collect()}
    assert want <= {r.draft_id for r in entry.queries()["k20_audit"](spark, sf_dir).collect()} <= ids


def test_voice(spark):
    row = voice.analyse(spark.createDataFrame([(1, "Short hook here.\n\nWe met 12 owners. It is not luck but work that counts in the end.\n\nWhat do you think?")], "example_id long, text string")).first()
    assert (row.paragraph_count, row.sentence_count, row.question_count, row.number_count, row.uses_contrast, row.cta_present) == (3, 4, 1, 1, True, True)


def test_meeting_notes(spark):
    talk = spark.createDataFrame([(1, 0, "Ann: we will ship it on Monday then.\nBob: can you send me the full list today?\nno name here")], "conv_id long, turn long, text string")
    lines = voice.speaker_lines(talk)
    assert [(r.speaker, r.kind) for r in voice.meeting_notes(lines).orderBy("kind").collect()] == [("Bob", "action"), ("Ann", "decision"), ("Bob", "question"), (None, "summary")]
    assert not voice.meeting_gate(lines).first().accepted


def test_supporting_points(spark):
    rows = [("s", 1, "first text", 1), ("s", 1, "second text", 2), ("s", 2, "First  text", 3), ("s", 3, "third", 4)]
    df = spark.createDataFrame(rows, "slug string, source_id long, text string, rank int").withColumn("kind", F.lit("passage"))
    assert [(r.source_id, r.text) for r in briefs.supporting_points(df).orderBy("point").collect()] == [(1, "first text"), (3, "third"), (1, "second text")]


def test_status_change_is_checked(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a")], "k int, status string")
    ok = analytics.set_status(rows, spark.createDataFrame([(1, "b")], "k int, value string"), "k", "status", ("a", "b"))
    assert sorted(r.status for r in ok.collect()) == ["a", "b"]
    with pytest.raises(Exception, match="unknown status"):
        analytics.set_status(rows, spark.createDataFrame([(1, "z")], "k int, value string"), "k", "status", ("a", "b")).collect()


def _found(n):
    """Items of ten sites with different bodies and titles; dated an hour apart."""
    subjects = ("plumbing estimates", "dental reminders", "roofing quotes", "towing dispatch", "pharmacy refills", "florist orders", "garage bookings", "clinic triage", "bakery trays", "locksmith visits")
    body = lambda i: f"Owners who handle {subjects[i % 10]} said that case {i} showed the gap. " + " ".join(f"w{i}x{j}" for j in range(130))
    draw = random.Random(9)
    title = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(50)) for _ in range(n)]
    return [(i, "rss", f"https://site{i % 10}.example.com/story-{i}", f"Case {i} of {subjects[i % 10]}: {title[i]}", body(i), f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00") for i in range(n)]


_ITEMS = "source_id long, source_type string, source_url string, title string, cleaned_text string, published_at string"


def test_store_stops_at_the_cap_and_finds_duplicates(spark):
    items = _found(30)
    again = [(100 + r[0], *r[1:]) for r in items[25:]]
    found = spark.createDataFrame(items + again, _ITEMS).withColumn("published_at", F.to_timestamp("published_at"))
    rows = {r.source_id: r for r in dedupe.store(found, limit=20).collect()}
    results = [r.result for r in rows.values()]
    assert len(rows) == 35 and results.count("stored") == 20 and results.count("duplicate") >= 1
    assert all(rows[100 + i].result == "duplicate" and rows[100 + i].method == "canonical_url" and rows[100 + i].matched_id == rows[i].place for i in range(25, 30))
    # newest first, and nothing stored past the cap
    assert all(r.result != "stored" for r in rows.values() if r.place > max(x.place for x in rows.values() if x.result == "stored"))
    assert dedupe.store(found.limit(0), limit=20).count() == 0


def test_store_knows_what_was_stored_before(spark):
    items = _found(6)
    old = [(7, "rss", items[0][2] + "?utm_source=q", "other", "short", None), (8, "rss", "https://x.org/a", "t", items[1][4], None), (9, "rss", "https://site2.example.com/z", items[2][3] + " | Site", "b", None), (10, "rss", "https://site3.example.com/y", "t", items[3][4] + " end", None)]
    frame = lambda rows: spark.createDataFrame(rows, _ITEMS).withColumn("published_at", F.to_timestamp("published_at"))
    rows = {r.source_id: r for r in dedupe.store(frame(items), limit=20, stored=frame(old)).collect()}
    assert {i: (r.result, r.method) for i, r in rows.items()} == {0: ("duplicate", "canonical_url"), 1: ("duplicate", "content_hash"), 2: ("duplicate", "title"), 3: ("duplicate", "body"), 4: ("stored", None), 5: ("stored", None)}
    assert [rows[i].matched_id for i in range(4)] == [-8, -9, -10, -11]


def test_greedy_store_of_long_chains(spark):
    """First writer wins along a chain of 70: every second row stays. What a dropped row matches is no duplicate of it."""
    pairs = spark.createDataFrame([(i, i - 1) for i in range(1, 70)], "source_id long, matched_id long")
    kept = {r.source_id: r.kept for r in dedupe.keep_greedily(pairs, spark.range(70).withColumnRenamed("id", "source_id")).collect()}
    assert kept == {i: i % 2 == 0 for i in range(70)}


def test_greedy_store_takes_as_many_rounds_as_blocks(spark, monkeypatch):
    """A chain of 900 in one block is one round, not 900; blocks of a few edges give what one pass over all rows gives."""
    calls = []
    monkeypatch.setattr(dedupe, "settle", lambda df, real=dedupe.settle: calls.append(1) or real(df))
    pairs = spark.range(1, 900).select(F.col("id").alias("source_id"), (F.col("id") - 1).alias("matched_id"))
    kept = {r.source_id: r.kept for r in dedupe.keep_greedily(pairs, spark.range(900).withColumnRenamed("id", "source_id")).collect()}
    assert kept == {i: i % 2 == 0 for i in range(900)} and len(calls) < 10
    draw = random.Random(4)
    edges = [(i, draw.randrange(i)) for i in range(1, 120) for _ in range(draw.randrange(3))] + [(5, 9), (7, 7), (3, 500)]
    want: dict[int, bool] = {}
    for i in range(120):
        want[i] = not any(want.get(b) for a, b in edges if a == i and b < i)
    ids = spark.createDataFrame([(i,) for i in range(120)] + [(4,), (None,)], "source_id long")
    got = dedupe.keep_greedily(spark.createDataFrame(edges, "source_id long, matched_id long"), ids, block=20).collect()
    assert sorted((r.source_id, r.kept) for r in got if r.source_id is not None) == sorted([*want.items(), (4, want[4])]) and [r.kept for r in got if r.source_id is None] == [True]


def test_replaced_table_may_read_itself(spark, tmp_path):
    path = f"{tmp_path}/t"
    landing.replace_table(spark.range(3), path)
    landing.replace_table(landing.read_table(spark, path).where("id > 0"), path)
    assert sorted(r.id for r in landing.read_table(spark, path).collect()) == [1, 2] and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_model_output_is_made_safe(spark):
    raw = '''```json
{"market_relevance": "12", "novelty": "high", "primary_entity": "TBD", "secondary_entities": ["A", "", "B"], "industries": ["x", "y", "z", "w"], "primary_theme": "Made up", "secondary_themes": ["Known", "Other"],
 "supporting_evidence": [{"passage": "P one", "supports": "primary_claim"}, {"passage": ""}, {"passage": "P two", "supports": "it shows a clear rise"}], "recommended_format": "song", "is_promotional": true}
```'''
    o = spark.createDataFrame([(raw,), ("no json",)], "raw string").select(extraction.coerce_model_output(F.col("raw"), ("Known",), F.lit("d.org")).alias("o")).collect()
    a, b = o[0].o, o[1].o
    assert (a.market_relevance, a.novelty, a.primary_entity, a.primary_theme, a.secondary_themes, a.industries, a.secondary_entities) == (10.0, 0.0, "d.org", None, ["Known"], ["x", "y", "z"], ["A", "B"])
    assert [(e.passage, e.supports, e.verified_verbatim) for e in a.supporting_evidence] == [("P one", None, False), ("P two", "it shows a clear rise", False)] and a.recommended_format == "executive_talking_point" and a.is_promotional
    assert (b.industries, b.supporting_evidence, b.market_relevance) == (["Cross-industry"], [], 0.0)


def test_voice_guide_measures_each_text_once(spark):
    """M-04: what four passes read is measured before them."""
    rows = spark.createDataFrame([(i, f"What do you say of the {i} calls we had? Let me know. And so it is.\n\nThe end of it.") for i in range(6)], "example_id long, text string")
    guide = voice.voice_guide(voice.analyse(rows))
    assert "_nfkc" not in guide._jdf.queryExecution().optimizedPlan().toString()
    got = guide.select("approved_example_count", "hook_patterns", "typical_calls_to_action", "median_sentence_words").first()
    assert got == (6, ["6/6 open with a figure"], got[2], 4.0) and len(got[2]) == 5


def test_claims_of_a_line_and_gaps_are_worked_out_once(spark):
    """K-19, K-22: a line's sentences, and the gap of lengths, stand once in the plan."""
    x = spark.createDataFrame([("First one here. Second one here.\n- ok it\nhm",), ("",), (None,)], "x string")
    units = x.select(audit.auditable_units(F.col("x"), False).alias("u"))
    assert [r["u"] for r in units.collect()] == [["First one here.", "Second one here.", "ok it", "hm"], [], []]
    assert units._jdf.queryExecution().optimizedPlan().toString().split(" AS u")[0].count("(?<=[.!?]") == 1
    score = x.select(audit.voice_alignment(F.col("x"), {"approved_example_count": 2, "median_sentence_words": 3}, False).alias("s"))
    assert [r["s"] for r in score.collect()] == [100.0, 100.0, 100.0]
    assert score._jdf.queryExecution().optimizedPlan().toString().split(" AS s")[0].count("(?<=[.!?]") == 2


def test_contained_titles_need_no_score(spark):
    """E-03: a title with an earlier one of the same words or more is settled without Python; others are scored."""
    titles = ["alpha beta gamma delta", "alpha beta gamma delta epsilon", "alpha beta gamma deltb epsilon", "delta gamma beta alpha", "epsilon alpha beta gamma deltb zeta"]
    rows = spark.createDataFrame([(i, "https://e.org/a", t) for i, t in enumerate(titles)], "source_id long, source_url string, title string")
    got = {r["source_id"]: (r["matched_id"], r["score"]) for r in dedupe.title_duplicates(rows).collect()}
    want = {}
    for i, t in enumerate(titles):
        near = [(-dedupe.token_set_ratio(t, o), k) for k, o in enumerate(titles[:i]) if dedupe.token_set_ratio(t, o) >= 92]
        if near:
            want[i] = (min(near)[1], -min(near)[0] / 100)
    assert got == want and got[1] == (0, 1.0) and got[3] == (0, 1.0)


def test_voice_measures_compose_a_text_once(spark):
    """A condition on the composed text composed every text twice; blanks of all kinds are still no example."""
    rows = spark.createDataFrame([(1, "We like it.\n\nWould you agree? It is not\tluck, but work: 12 extraordinary, days."), (2, "  　 "), (3, None), (4, "\n")], "example_id long, text string")
    found = voice.analyse(rows)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    first, second = found.orderBy("example_id").collect()
    assert (first.word_count, first.sentence_count, first.paragraph_count, first.question_count, first.number_count) == (15, 3, 2, 1, 1)
    assert first.uses_contrast and first.uses_first_person and first.cta_present and first.cta_sentences == ["Would you agree?"] and first.long_word_share == round(1 / 15, 3)
    assert (second.example_id, second.word_count, second.sentence_count) == (4, 0, 0)


def test_phrases_of_calls_and_contrasts_are_those_of_the_lists():
    assert all(any(w in p for w in voice._CALL_WORDS) for p in voice._CALLS) and len(voice._CALLS) == 12
    assert {"what are you", "curious how", "agree?"} <= set(voice._CALLS)


def test_stored_passages_meet_by_keys_without_the_texts(spark):
    """Texts were copied once for each of their words."""
    long = "Every shop that answers its calls within a minute keeps its customers"
    claims = spark.createDataFrame([(1, f"They say “so”:  {long.upper()} for years."), (2, "nothing of the kind is said in this one, which is long enough"), (3, None), (4, "too short")], "claim_id long, claim string")
    passages = spark.createDataFrame([(7, long), (8, f"{long} for years."), (9, "too short")], "passage_id long, passage string")
    plans = []
    settle, briefs.settle = briefs.settle, lambda df: plans.append(df) or df
    try:
        assert [tuple(r) for r in briefs.match_stored_passage(claims, passages).collect()] == [(1, 7)]
    finally:
        briefs.settle = settle
    made = [x for x in plans[0]._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate" in x]
    assert made and not any("_c#" in x for x in made) and len(plans[0].columns) == 2


def test_articles_take_one_python_process_a_task(spark, sf_dir):
    from brightvane.functions import html
    from brightvane.plans import textual

    assert textual.d01_articles(spark, sf_dir)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    rows = spark.createDataFrame([("https://e.com/p/", '<a href="q?utm_source=x">a</a><a href="#top">b</a><a href="mailto:x@e.com">c</a><a href="//e.com/r">d</a><a href="http://[">e</a>'), (None, '<a href="https://e.com/a">a</a>'), ("https://e.com", None)], "url string, html string")
    two = html.page_links(html.parse_html(F.col("html"))["links"], F.col("url"))
    one = html.page_links(html.parse_html(F.col("html"), F.col("url"))["links"], F.col("url"), absolute=True)
    assert all(a == b for a, b in rows.select(two, one).collect())


def _best_titles(titles, least=92):
    want = {}
    for i, t in enumerate(titles):
        near = [(-dedupe.token_set_ratio(t, o), k) for k, o in enumerate(titles[:i]) if dedupe.token_set_ratio(t, o) >= least]
        if near:
            want[i] = (min(near)[1], -min(near)[0] / 100)
    return want


def test_title_pairs_are_never_listed(spark, monkeypatch):
    """E-03: all of these are alike, and their pairs were kept; now no table has more than some rows a title."""
    titles = ["alpha bravo charlie delta echo foxtrot golf"] + [f"alpha bravo charlie delta echo foxtrot golf {a}{b}" for a in "klmnopqrst" for b in "uvwxyz"]
    kept, settle = [], dedupe.settle
    monkeypatch.setattr(dedupe, "settle", lambda df: kept.append(settle(df)) or kept[-1])
    rows = spark.createDataFrame([(i, "https://e.org/a", t) for i, t in enumerate(titles)], "source_id long, source_url string, title string")
    got = {r["source_id"]: (r["matched_id"], r["score"]) for r in dedupe.title_duplicates(rows).collect()}
    assert got == _best_titles(titles) and len(got) == len(titles) - 1
    assert sum(df.count() for df in kept) <= 4 * len(titles)


def test_titles_of_a_large_domain_meet_chunk_against_chunk(spark, monkeypatch):
    draw = random.Random(11)
    stems = [" ".join("".join(draw.choices("etaoinsr", k=draw.randint(3, 9))) for _ in range(6)) for _ in range(12)]
    titles = [t[:k] + draw.choice("xyz") + t[k + 1 :] for _ in range(9) for t in stems for k in [draw.randrange(len(t))]]
    titles = [t for t in titles if len(t.split()) >= 4]
    monkeypatch.setattr(dedupe, "CHUNK", 10)
    monkeypatch.setattr(dedupe, "CHUNK_MOST", 16)
    rows = spark.createDataFrame([(i, "https://e.org/a", t) for i, t in enumerate(titles)], "source_id long, source_url string, title string")
    for least in (92.0, 60.0):
        got = {r["source_id"]: (r["matched_id"], r["score"]) for r in dedupe.title_duplicates(rows, least=least).collect()}
        assert got == _best_titles(titles, least)


def test_titles_are_cut_before_sources_meet_their_pages(spark, sf_dir):
    """The whole text went through the join."""
    from brightvane.plans.views import view

    lines = view(spark, sf_dir, "m_sources").select("source_id", "source_url", "title")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    join = next(i for i, x in enumerate(lines) if "Join " in x)
    assert not any("substring(text" in x for x in lines[:join]) and any("substring(text" in x for x in lines[join:])


def _shingles(text):
    w = re.sub(r"[\W_]+", " ", text.lower()).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_bodies_are_found_as_by_brute_force(spark, monkeypatch):
    """E-04: copies, near copies, texts of other domains, of few words and of none, in one bucket and in many; only some keys of each set are kept, where all sets were."""
    draw = random.Random(5)
    vocabulary = ["".join(draw.choices("etaoinshr", k=draw.randint(2, 9))) for _ in range(400)]
    passage = draw.choices(vocabulary, k=40)
    texts = ["!? " * 20, "!? " * 20, "one two three", "One, two three!", "one two three four five six", "five words are one shingle"]
    for _ in range(14):
        one = draw.choices(vocabulary, k=draw.randint(60, 240)) + passage
        texts += [" ".join(one), " ".join(one).upper(), " ".join(draw.choice(vocabulary) if draw.random() < 0.03 else w for w in one), " ".join(one[: len(one) * 4 // 5]), " ".join(draw.choices(vocabulary, k=200))]
    draw.shuffle(texts)
    rows = [(i * 7 - 100, f"https://{'ab'[i % 5 == 0]}.com/{i}", x) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "source_id long, source_url string, cleaned_text string").repartition(3)
    sets = {i: _shingles(x) for i, _, x in rows}
    kept, settle = [], dedupe.settle
    monkeypatch.setattr(dedupe, "settle", lambda x: kept.append(settle(x)) or kept[-1])
    for block, few, bucket in (("domain", 1 << 20, 1 << 20), ("none", 0, 50)):
        monkeypatch.setattr(dedupe, "_FEW", few)
        monkeypatch.setattr(dedupe, "_BUCKET", bucket)
        monkeypatch.setattr(dedupe, "_CELL", 4 * bucket)
        want = {}
        for i, u, _ in rows:
            near = [(-len(sets[i] & sets[j]) / len(sets[i] | sets[j]), j) for j, v, _ in rows if j < i and sets[i] and sets[j] and (block == "none" or u[8] == v[8])]
            if near and -min(near)[0] >= 0.72:
                want[i] = (min(near)[1], -min(near)[0])
        got = dedupe.body_duplicates(df, min_words=3, block=block).collect()
        assert {r.source_id: (r.matched_id, r.score) for r in got} == want and len(got) == len(want) > 20
    # all texts' sets were kept, now only their keys
    lone = spark.createDataFrame([(i, "https://a.com/", " ".join(draw.choices(vocabulary, k=200))) for i in range(20)], "source_id long, source_url string, cleaned_text string")
    kept.clear()
    assert dedupe.body_duplicates(lone).count() == 0
    held = [x.select(*[F.size(c) * 8 if t.startswith("array") else F.length(c) for c, t in x.dtypes if t.startswith(("array", "binary"))]) for x in kept]
    assert sum(sum(r) for x in held if x.columns for r in x.collect()) < 20 * 196 * 8 * 0.3


def test_hashes_are_made_before_sources_meet_their_pages(spark, sf_dir):
    """E-02, E-05: the whole text went through the join of each layer."""
    from brightvane.plans import content

    rows = content._hashed(spark, sf_dir)
    plan = rows.select("source_id", "source_url", "title", "content_hash")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    join = next(i for i, x in enumerate(plan) if "Join " in x)
    assert not any("sha2(" in x for x in plan[:join]) and any("sha2(" in x for x in plan[join:])
    own = dedupe.hash_duplicates(rows.drop("content_hash"))
    assert sorted(map(tuple, dedupe.hash_duplicates(rows).collect())) == sorted(map(tuple, own.collect()))
