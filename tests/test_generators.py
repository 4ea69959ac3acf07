"""Generated rows depend on their number alone, and have the stated mix, domains and skew."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.sources import files
from keyloom.sources import generators as G


def test_mix_and_ids(spark):
    e = G.auction_events(spark, 5000).cache()
    assert {r.event_type: r["count"] for r in e.groupBy("event_type").count().collect()} == {0: 100, 1: 300, 2: 4600}
    assert e.where("(person IS NOT NULL)::int + (auction IS NOT NULL)::int + (bid IS NOT NULL)::int <> 1").isEmpty()
    for rows, first, n in ((G.people(e), 1000, 100), (G.auctions(e), 1000, 300)):
        ids = sorted(r.id for r in rows.select("id").collect())
        assert ids == list(range(first, first + n))
    a = G.auctions(e)
    assert a.where("expires <= dateTime OR reserve < initialBid OR category NOT BETWEEN 10 AND 14").isEmpty()
    b = G.bids(e)
    assert b.where("price < 100 OR price > 100000000 OR auction < 1000 OR bidder < 2000").isEmpty()
    hot = b.where(F.col("channel").isin(*G.HOT_CHANNELS)).count() / 4600
    tagged = b.where("channel LIKE 'channel-%' AND url LIKE '%&channel_id=%'").count() / b.where("channel LIKE 'channel-%'").count()
    assert 0.45 < hot < 0.55 and 0.86 < tagged < 0.94


def test_any_partitioning_gives_the_same_rows(spark):
    whole = G.auction_events(spark, 600)
    parts = G.auction_events(spark, 250).repartition(7).unionByName(G.auction_events(spark, 350, first=250).coalesce(1))
    assert whole.exceptAll(parts).isEmpty() and parts.exceptAll(whole).isEmpty()
    other = G.auction_events(spark, 600, G.Config(seed=1))
    assert not whole.exceptAll(other).isEmpty()


def test_times_out_of_order(spark):
    in_order = [r.dateTime for r in G.auction_events(spark, 200).select("dateTime").collect()]
    assert in_order == sorted(in_order)
    mixed = [r.dateTime for r in G.auction_events(spark, 200, G.Config(out_of_order=50, events_per_second=1000)).select("dateTime").collect()]
    assert mixed != sorted(mixed) and all(sorted(mixed)[k : k + 50] == sorted(mixed[k : k + 50]) for k in range(0, 200, 50))


def test_sizes(spark):
    e = G.auction_events(spark, 5000)
    for rows, size in ((G.people(e), 200), (G.auctions(e), 500)):
        text = sum(F.coalesce(F.length(c), F.lit(0)) for c, k in rows.dtypes if k == "string")
        mean = rows.agg(F.avg(text)).first()[0]
        assert 0.7 * size < mean < 1.1 * size


def test_words_and_keys(spark):
    n = 20_000
    top = G.words(spark, n, keys=1000, skew=1.1).groupBy("word").agg(F.sum("count").alias("n")).orderBy(F.desc("n")).limit(2).collect()
    assert top[0].word == "word_0" and top[1].word == "word_1" and top[0].n > 1.6 * top[1].n
    flat = G.words(spark, n, keys=50, skew=0).groupBy("word").count().agg(F.min("count"), F.max("count")).first()
    assert 300 < flat[0] <= flat[1] < 500
    e = G.keyed_events(spark, n, keys=500)
    assert e.where("key NOT BETWEEN 0 AND 499 OR auxKey NOT BETWEEN 0 AND 499 OR value NOT BETWEEN 1 AND 1000 OR eventType NOT BETWEEN 0 AND 3").isEmpty()
    near = e.select("key", "sequence").alias("a").join(e.select("key", "sequence").alias("b"), F.expr("a.key = b.key AND b.sequence > a.sequence AND b.sequence <= a.sequence + 256"))
    assert near.count() > 1.1 * n * 256 / 500  # more repeats nearby than chance gives


def test_drifting_keys(spark):
    e = G.drifting_keys(spark, 20_000, keys=10_000, hot_keys=10, hot_percent=80, interval=10_000, step=1000)
    shares = [e.where(f"sequence div 10000 = {k} AND joinKey BETWEEN {base} AND {base + 9}").count() / 10_000 for k, base in ((0, 0), (1, 1000))]
    assert all(0.77 < s < 0.83 for s in shares)


def test_stream_gives_the_batch_rows(spark, tmp_path):
    query = G.auction_event_stream(spark, rows_per_batch=300).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="0 seconds").start()
    while query.lastProgress is None or query.lastProgress["batchId"] < 2:
        if query.exception():
            raise query.exception()
        query.awaitTermination(1)
    query.stop()
    got = spark.read.parquet(str(tmp_path / "out"))
    n = got.count()
    assert n >= 600 and n % 300 == 0
    assert got.drop("dateTime").exceptAll(G.auction_events(spark, n).drop("dateTime")).isEmpty()


def test_envelopes_and_files(spark, tmp_path):
    e = G.auction_events(spark, 300)
    back = files.from_envelopes(files.to_envelopes(e).unionByName(spark.createDataFrame([("{broken",), ("{}",), (None,)], "value string")))
    assert back.count() == 300 and back.select(e.columns).exceptAll(e).isEmpty()
    G.side_input(spark, 20).write.csv(str(tmp_path / "side"))
    assert sorted(tuple(r) for r in files.side_table(spark, str(tmp_path / "side")).collect()) == [(i, str(i)) for i in range(20)]
    (tmp_path / "lines").write_text("a a b\nb c\n\na c C!\n")
    counts = files.tokens(files.text_lines(spark, str(tmp_path / "lines"))).groupBy("word").count().collect()
    assert {r.word: r["count"] for r in counts} == {"a": 3, "b": 2, "c": 3}
