import pytest
from pyspark.sql import functions as F

from docquarry.operators import usage as U
from docquarry.operators.chunking import child_windows
from docquarry.plans.usage import calls, messages
from docquarry.operators import blocks
from docquarry.operators.search import SearchIndex, lexical, vector
from docquarry.operators.segments import SegmentedIndex
from docquarry.session import Scratch
from docquarry.sources.manifest import Manifest
from docquarry.streaming import jobs


def same(a, b, *columns):
    key = lambda frame: sorted(map(str, frame.select(*columns).collect()))
    assert key(a) == key(b)


def stream(spark, frame, tmp_path, name):
    frame.write.parquet(str(tmp_path / name))
    return spark.readStream.schema(frame.schema).parquet(str(tmp_path / name))


def chunk(rows):
    return child_windows(rows, "text", "doc_id").select((F.col("doc_id") * 1000 + F.col("child")).alias("point_id"), "doc_id", F.col("chunk").alias("text"))


def same_index(spark, index, chunks):
    """Chunks, statistics and hits are those of an index built anew."""
    held, anew = index.open(), SearchIndex.build(chunks, Scratch(spark, "anew"), dim=32)
    same(held.chunks, anew.chunks, "point_id", "doc_id", "text")
    assert held.totals == anew.totals
    same(held.terms.withColumn("idf", F.round("idf", 9)), anew.terms.withColumn("idf", F.round("idf", 9)), "term", "df", "idf")
    queries = spark.createDataFrame([(1, "text of 3 w1 w5"), (2, "now short w2"), (3, "a new one w9 w1 w1")], "query_id long, text string")
    for search in (lexical, vector):
        hits = [search(i, queries, 6).select("query_id", "point_id", "rank", F.round("score", 6).alias("score")) for i in (held, anew)]
        same(*hits, "query_id", "point_id", "rank", "score")


def words(i, n=60):
    return f"text of {i} " + " ".join(f"w{(i * k) % 17}" for k in range(n * (i + 1)))


def test_ingest_in_batches(spark, tmp_path):
    """Replaced, deleted and repeated documents; a batch that is run again; compaction; readers of older versions."""
    index = SegmentedIndex(spark, str(tmp_path / "index"), dim=32)
    first = [(i, words(i), 0, False) for i in range(8)]
    columns = "doc_id long, text string, at int, gone boolean"
    source = str(tmp_path / "docs")

    def run(rows, every=99):
        frame = spark.createDataFrame(rows, columns)
        frame.coalesce(1).write.mode("append").parquet(source)
        jobs.ingest(spark.readStream.schema(frame.schema).parquet(source), lambda d: chunk(d.select("doc_id", "text")), index, str(tmp_path / "state"), F.col("at"), "gone", every).awaitTermination()

    frame = lambda rows: chunk(spark.createDataFrame(rows, "doc_id long, text string"))
    run(first)
    run([(5, "now short", 2, False), (5, "stale", 1, False), (9, "a new one", 0, False), (3, None, 0, True), (None, "no id", 0, False)])
    now = {i: t for i, t, *_ in first} | {5: "now short", 9: "a new one"}
    del now[3]
    same_index(spark, index, frame(list(now.items())))
    old = index.open(1)
    run([(0, words(20), 0, False), (3, "back again", 0, False), (9, None, 0, True)])
    now |= {0: words(20), 3: "back again"}
    del now[9]
    number, held = index.manifest.latest()
    assert [s["seq"] for s in held["segments"]] == [0, 1, 2]
    assert index.commit(frame([(77, "late")]), frame([(77, "late")]), str(tmp_path / "state"), 2) == number  # committed before
    assert index.compact() == number + 1 and len(index.manifest.latest()[1]["segments"]) < 3
    run([(4, "after compaction", 0, False)], every=1)
    now[4] = "after compaction"
    assert old.chunks.select("doc_id").distinct().count() == 8
    index.clean(index.manifest.latest()[0])
    same_index(spark, index, frame(list(now.items())))


def test_a_commit_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    """Whatever was written of a segment, the manifest decides; the batch then runs again as if nothing had been. Of two writers one has to begin again."""
    frame = lambda rows: chunk(spark.createDataFrame(rows, "doc_id long, text string"))
    index = SegmentedIndex(spark, str(tmp_path / "index"), dim=32)
    docs = {i: words(i) for i in range(6)}
    index.commit(frame(list(docs.items())), frame(list(docs.items())), "w", 0)
    new = frame([(2, "changed"), (8, "added")])
    for place in ("term_frequencies", "build"):
        with monkeypatch.context() as m, pytest.raises(RuntimeError):
            m.setattr(blocks, place, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("driver lost")))
            index.commit(new, new, "w", 1)
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(index.manifest, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("driver lost")))
        index.commit(new, new, "w", 1)
    same_index(spark, index, frame(list(docs.items())))
    index.commit(new, new, "w", 1)
    docs |= {2: "changed", 8: "added"}
    same_index(spark, index, frame(list(docs.items())))
    with pytest.raises(RuntimeError):
        index.manifest.commit(2, {})


def test_bytes_written_follow_the_batch(spark, tmp_path):
    """A batch of one document leaves every file of the segments before as it is and writes few bytes."""
    index = SegmentedIndex(spark, str(tmp_path / "index"), dim=32)
    frame = lambda rows: chunk(spark.createDataFrame(rows, "doc_id long, text string"))
    many = frame([(i, words(i % 50)) for i in range(400)])
    index.commit(many, many)
    files = lambda: {p: p.stat().st_size for p in (tmp_path / "index").rglob("*.parquet")}
    before = files()
    one = frame([(7, "one word more")])
    index.commit(one, one)
    after = files()
    assert all(after[p] == n for p, n in before.items()) and sum(after.values()) - sum(before.values()) < sum(before.values()) / 4


def test_usage_by_day(spark, sf_dir, tmp_path):
    rows = calls(spark, sf_dir)
    live = jobs.drained(spark, jobs.usage_by_day(stream(spark, rows, tmp_path, "calls")), str(tmp_path / "out"), str(tmp_path / "state"), "complete")
    same(live, U.daily_rollup(rows).filter("day is not null"), "day", "calls", "tokens", "cost")


def test_live_budget(spark, sf_dir, tmp_path):
    rows = calls(spark, sf_dir)
    live = jobs.drained(spark, jobs.live_budget(stream(spark, rows.select("session_id", "call_id", "ts", "cost"), tmp_path, "calls"), 0.05), str(tmp_path / "out"), str(tmp_path / "state"))
    same(live, U.budget_actions(rows, 0, 0.05), "call_id", "action")
    source = spark.readStream.schema(rows.select("session_id", "call_id", "ts", "cost").schema).parquet(str(tmp_path / "calls"))
    daily = jobs.drained(spark, jobs.live_budget(source, day_budget=2.0), str(tmp_path / "day"), str(tmp_path / "day-state"))
    same(daily, U.budget_actions(rows, 2.0, 0), "call_id", "action")
    same(jobs.stricter(live, daily), U.budget_actions(rows, 2.0, 0.05), "call_id", "action")


def test_ledger_forgets(spark, tmp_path):
    """A batch that runs again counts once; what can't be reached any more leaves the ledger; late calls don't count."""
    rows = [[(1, 1, "2024-01-01 10:00:00", 1.0), (1, 2, "2024-01-01 11:00:00", 1.0), (2, 3, "2024-01-02 09:00:00", 1.0)], [(1, 4, "2024-01-01 12:00:00", 2.5), (2, 5, "2024-01-02 10:00:00", 0.5)], [(3, 6, "2024-03-01 00:00:00", 0.5)], [(1, 7, "2024-01-01 13:00:00", 9.0)]]
    parts = [spark.createDataFrame(x, "session_id long, call_id long, ts string, cost double").select("session_id", "call_id", F.col("ts").cast("timestamp").alias("ts"), F.col("cost").cast("decimal(18,6)").alias("cost")) for x in rows]
    path = str(tmp_path / "ledger")
    run = lambda live: jobs.budget_ledger(live, path, str(tmp_path / "state"), 5.0, 4.0, "2 days", "10 days").awaitTermination()
    jobs.replayed(parts[:2], str(tmp_path / "calls"), run)
    ledger = Manifest(spark, f"{path}/ledger")
    held = lambda: {(r.kind, r.key): float(r.spent) for r in spark.read.parquet(f"{path}/ledger/{ledger.latest()[1]['folder']}").collect()}
    assert held() == {("day", "2024-01-01"): 4.5, ("day", "2024-01-02"): 1.5, ("session", "1"): 4.5, ("session", "2"): 1.5}
    jobs.budget_ledger(spark.readStream.schema(parts[0].schema).parquet(str(tmp_path / "calls")), path, str(tmp_path / "other"), 5.0, 4.0, "2 days", "10 days").awaitTermination()
    assert held()[("session", "1")] == 4.5
    jobs.replayed(parts[2:], str(tmp_path / "calls"), run)
    assert held() == {("day", "2024-03-01"): 0.5, ("session", "3"): 0.5}
    assert {r.call_id: r.action for r in spark.read.parquet(f"{path}/actions").collect()} == {1: "ok", 2: "ok", 3: "ok", 4: "reject", 5: "ok", 6: "ok", 7: "late"}


def test_live_history(spark, sf_dir, tmp_path):
    rows = messages(spark, sf_dir)
    live = jobs.drained(spark, jobs.live_history(stream(spark, rows, tmp_path, "messages")), str(tmp_path / "out"), str(tmp_path / "state"))
    same(live, U.history(rows), "session_id", "seq", "history")


def test_answers_for_a_stream(spark, tmp_path):
    """A batch of questions that runs again answers over the version it began with."""
    index = SegmentedIndex(spark, str(tmp_path / "index"), dim=32)
    frame = lambda rows: chunk(spark.createDataFrame(rows, "doc_id long, text string"))
    docs = frame([(1, "red house"), (2, "green tree"), *((i, f"other {i}") for i in range(10, 16))])
    index.commit(docs, docs)
    questions = spark.createDataFrame([(1, "red"), (2, "tree house")], "query_id long, text string")
    source = stream(spark, questions, tmp_path, "questions")
    search = lambda held, asked: lexical(held, asked, 3)
    out = str(tmp_path / "out")
    jobs.answer_stream(source, index, search, out, str(tmp_path / "state")).awaitTermination()
    read = lambda: sorted((r.query_id, r.point_id) for r in spark.read.parquet(out).collect())
    first = read()
    assert first == [(1, 1000), (2, 1000), (2, 2000)]
    index.commit(docs.limit(0), docs.filter("doc_id < 3").select("doc_id"))
    jobs.answer_stream(source, index, search, out, str(tmp_path / "other-state")).awaitTermination()
    assert read() == first
    more = frame([(3, "a red tree")])
    index.commit(more, more)
    spark.createDataFrame([(4, "red")], questions.schema).write.mode("append").parquet(str(tmp_path / "questions"))
    jobs.answer_stream(spark.readStream.schema(questions.schema).parquet(str(tmp_path / "questions")), index, search, out, str(tmp_path / "state")).awaitTermination()
    assert read() == [*first, (4, 3000)]
