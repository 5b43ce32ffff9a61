"""Streams with state, each against its batch form or a plain loop over the same arrivals."""

import random
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from brightvane.functions import lists
from brightvane.operators import dedupe
from brightvane.sources import landing, snapshots
from brightvane.streaming import incremental, seen, stateful


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(stateful.PROVIDER[0])
    spark.conf.set(*stateful.PROVIDER)
    yield spark
    spark.conf.set(stateful.PROVIDER[0], before)


def land(spark, folder, rows, schema, name):
    """A file of rows, landed under its own name so that files arrive in order."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def through(spark, folder, schema, step, checkpoint):
    """What a stream gives for files landed so far, batch by batch."""
    got = []
    stream = step(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*"))
    query = stream.writeStream.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).foreachBatch(lambda df, n: got.extend(df.collect())).start()
    query.awaitTermination()
    return got, query


def test_slots_of_hosts(rocks, tmp_path):
    rng, schema = random.Random(3), "host string, item string, at timestamp, delay double"
    at, want, free = 1_704_067_200.0, {}, {}
    for name in range(4):
        rows = []
        for _ in range(25):
            at += rng.choice([0.0, 0.2, 0.9])
            host, own = rng.choice([("slow.com", 20.0), ("a.com", None), ("b.com", 0.1)])
            item = f"{name}-{len(rows):02d}"
            rows.append((host, item, pd.Timestamp(round(at * 10) * 100, unit="ms").to_pydatetime(), own))
        for host, item, when, own in sorted(rows, key=lambda r: (r[2], r[1])):
            seconds = pd.Timestamp(when).timestamp()
            wait = max(0.0, free.get(host, 0.0) - seconds)
            want[item] = (wait <= 30.0, round(wait, 3))
            if wait <= 30.0:  # a refused request uses no slot
                free[host] = seconds + wait + max(1.0, own or 0.0)
        land(rocks, tmp_path / "in", rows, schema, name)
    step = lambda s: stateful.polite_slots(s)
    got, query = through(rocks, tmp_path / "in", schema, step, str(tmp_path / "ck"))
    assert {r.item: (r.granted, round(r.wait, 3)) for r in got} == want and not all(g for g, _ in want.values())
    # much later the hosts are free, and nothing is kept of them but of the one that asks
    land(rocks, tmp_path / "in", [("c.com", "z", pd.Timestamp(int(at) + 9000, unit="s").to_pydatetime(), None)], schema, "8")
    land(rocks, tmp_path / "in", [("c.com", "y", pd.Timestamp(int(at) + 9001, unit="s").to_pydatetime(), None)], schema, "9")
    _, query = through(rocks, tmp_path / "in", schema, step, str(tmp_path / "ck"))
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


MARKERS = lists.PERMANENT_ERRORS


def test_breaker_of_a_stream_is_that_of_a_batch(rocks, tmp_path):
    rng, schema = random.Random(5), "client string, at timestamp, ok boolean, error string"
    every = []
    for name in range(3):
        rows = [(rng.choice("abc"), pd.Timestamp(1_704_067_200 + 100 * name + i, unit="s").to_pydatetime(), *rng.choice([(True, None), (False, "Invalid_API_key given"), (False, "billing problem"), (False, "timeout")])) for i in range(20)]
        rows += [("d", pd.Timestamp(1_704_067_200 + 100 * name + 50, unit="s").to_pydatetime(), False, "timeout")]
        every += rows
        land(rocks, tmp_path / "in", rows, schema, name)
    got, _ = through(rocks, tmp_path / "in", schema, lambda s: stateful.breaker_stream(s, MARKERS), str(tmp_path / "ck"))
    calls = rocks.createDataFrame(every, schema).withColumn("recoverable", ~stateful.unrecoverable(F.col("error"), MARKERS))
    want = {(r.client, r.at): r.disabled for r in incremental.breaker(calls).collect()}
    assert {(r.client, r.at): r.disabled for r in got} == want and any(want.values()) and not all(want.values())
    assert all(("3 failures in a row" in r.reason) == r.disabled for r in got if r.reason) and not any(r.disabled for r in got if r.client == "d")


def arrivals(n=60):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    made, rows = [], []
    for i in range(n):
        kind = rng.randrange(6) if made else 5
        url, title, text, domain = rng.choice(made) if made else (None,) * 4
        fresh = f"https://{rng.choice(['a', 'b'])}.com/{i}"
        if kind == 0:
            row = (url.replace("https://", "http://www.") + "/?utm_source=q", "other title of this " + word(), "text " + word(), domain)
        elif kind == 1:
            row = (f"https://c.com/{i}", word() + " " + word(), text.upper(), "c")
        elif kind == 2:
            row = (f"https://{domain}.com/t{i}", title + " again", " ".join(word() for _ in range(30)), domain)
        elif kind == 3:
            w = text.split()
            row = (f"https://{domain}.com/b{i}", word() + " x", " ".join(w[: len(w) - 6] + [word() for _ in range(rng.randrange(12))]), domain)
        elif kind == 4:
            row = (f"https://{domain}.com/m{i}", " ".join(sorted(title.split(), reverse=True)), " ".join(word() for _ in range(20)), domain)
        else:
            row = (fresh, " ".join(word() for _ in range(6)), " ".join(word() for _ in range(150)), fresh[8])
        made.append(row)
        rows.append((i, *row[:3], f"q{i % 5}", "rss", pd.Timestamp(1_704_067_200 + i * 3600, unit="s").to_pydatetime()))
    return rows


ARRIVAL = "source_id long, source_url string, title string, cleaned_text string, search_query string, source_type string, at timestamp"


def test_all_layers_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    rows = arrivals()
    batch = spark.createDataFrame(rows, ARRIVAL).withColumn("published_at", F.lit(None).cast("timestamp"))
    want = {r.source_id: (r.result, r.matched_id, r.method, None if r.score is None else round(r.score, 9)) for r in dedupe.store(batch, 1000).collect()}
    for k in range(4):
        land(spark, tmp_path / "in", rows[15 * k : 15 * k + 15], ARRIVAL, k)
    store = seen.SeenStore(spark, str(tmp_path / "index"))
    again = []

    def each(df, number):
        store(df, number)
        if number == 2:  # run again, as after a failure
            store(df, number)
            again.append(number)

    stream = incremental.new_files(spark, str(tmp_path / "in" / "*"), ARRIVAL, 1)
    incremental.run_available(stream, str(tmp_path / "ck"), each)
    got = {r.source_id: ("stored" if r.kept else "duplicate", r.matched_id, r.method, None if r.score is None else round(r.score, 9)) for r in store.verdicts().collect()}
    assert again and got == want and {m for _, _, m, _ in want.values()} == {None, "canonical_url", "content_hash", "title", "body"}
    merged = {r.keep_id: r for r in store.rediscoveries().collect()}
    held = defaultdict(list)
    for i, url, _, _, asked, _, at in rows:
        held[i if got[i][0] == "stored" else got[i][1]].append((i, url, asked, at))
    assert set(merged) == set(held)
    for i, found in held.items():
        r = merged[i]
        assert r.rediscovery_count == len(found) - 1 and r.queries == list(dict.fromkeys(q for _, _, q, _ in found)) and r.urls == list(dict.fromkeys(u for _, u, _, _ in found))
        assert (r.last_rediscovered_at is None) == (len(found) == 1)


def test_what_was_seen_long_ago_expires(spark, tmp_path):
    row = lambda i, day: (i, "https://a.com/x", "some title with words", "t", "q", "rss", pd.Timestamp(1_704_067_200 + day * 86400, unit="s").to_pydatetime())
    store = seen.SeenStore(spark, str(tmp_path / "index"), days=45)
    for number, r in enumerate((row(1, 0), row(2, 40), row(3, 50), row(4, 60))):
        store(spark.createDataFrame([r], ARRIVAL), number)
    store(spark.createDataFrame([], ARRIVAL), 9)
    assert {r.source_id: (r.kept, r.matched_id) for r in store.verdicts().collect()} == {1: (True, None), 2: (False, 1), 3: (True, None), 4: (False, 3)}


def test_a_table_is_there_while_it_is_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    assert snapshots.read_snapshot(spark, path) is None
    assert landing.replace_table(spark.range(5), path) == 1
    held = landing.read_table(spark, path)
    assert landing.replace_table(landing.read_table(spark, path).where("id > 1"), path) == 2
    assert held.count() == 5 and landing.read_table(spark, path).count() == 3 and snapshots.read_snapshot(spark, path, 1).count() == 5
    # a writer that stopped midway: data without a manifest, and a manifest cut short
    spark.range(99).write.parquet(f"{path}/data-lost")
    (tmp_path / "t" / "_manifests" / "000000000003.json").write_text("0badc0de\n{\"data\": \"data-lo")
    assert landing.read_table(spark, path).count() == 3
    assert landing.replace_table(spark.range(7), path) == 4 and landing.read_table(spark, path).count() == 7
    for k in range(3):
        landing.replace_table(spark.range(k), path)
    assert [n for n, _ in snapshots.versions(spark, path)] == [7, 6, 5] and landing.read_table(spark, path).dtypes == [("id", "bigint")]


def test_two_writers_do_not_make_one_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    landing.replace_table(spark.range(1), path)
    monkeypatch.setattr(snapshots, "_numbers", lambda *_: [])  # as if neither had seen the other's commit
    with pytest.raises(Exception, match="already exists|FileAlreadyExists"):
        landing.replace_table(spark.range(2), path)
    monkeypatch.undo()
    assert landing.read_table(spark, path).count() == 1
