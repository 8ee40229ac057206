"""Mail and JSON lines from files; streams equal batches."""

import datetime
from email.message import EmailMessage

from pyspark.sql import functions as F

from postmill.sources.mail import read_json_lines, read_mail
from postmill.streaming import flows


def test_mail(spark, tmp_path):
    m = EmailMessage()
    m["Subject"], m["From"], m["To"], m["Message-ID"], m["Date"] = "Возврат №5", "A <a@b.org>", "c@d.org", "<1@b>", "Mon, 05 Feb 2024 10:00:00 +0300"
    m["References"], m["In-Reply-To"] = "<0@b> <00@b>", "<0@b>"
    m.set_content("hello\n")
    m.add_alternative("<p>hello</p>", subtype="html")
    m.add_attachment(b"12345", maintype="application", subtype="pdf", filename="акт.pdf")
    (tmp_path / "one.eml").write_bytes(bytes(m))
    (tmp_path / "bad.eml").write_bytes(b"\xff\xfe no headers")
    (tmp_path / "large.eml").write_bytes(b"x" * 5000)
    rows = {r.path.rsplit("/", 1)[-1]: r for r in read_mail(spark, str(tmp_path), 4000).collect()}
    r = rows["one.eml"]
    assert (r.subject, r.message_id, r.references, r.in_reply_to) == ("Возврат №5", "<1@b>", ["<0@b>", "<00@b>"], "<0@b>")
    assert r.received_at == datetime.datetime(2024, 2, 5, 7) and r.body_text.strip() == "hello" and "<p>" in r.body_html
    assert [(a.filename, a.bytes) for a in r.attachments] == [("акт.pdf", 5)]
    assert rows["large.eml"].error == "too large" and rows["bad.eml"].subject is None and len(rows) == 3


def test_json_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"a": 1, "b": "x"}\n\nnot json\n{"a": 2}\n')
    good, bad = read_json_lines(spark, str(tmp_path), "a int, b string")
    assert sorted(map(tuple, good.collect()), key=str) == [(1, "x"), (2, None)] and [r.value for r in bad.collect()] == ["not json"]


def log(spark, path, rows):
    spark.createDataFrame(rows, "uid long, event_id long, outcome string").coalesce(1).write.mode("append").parquet(path)


def test_fetch_states(spark, tmp_path):
    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    sink = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")
    log(spark, path, [(1, 1, "fail"), (1, 2, "fail"), (2, 3, "fail"), (3, 4, "skip")])
    run = lambda: flows.run_once(flows.fetch_states(flows.stream(spark, path)), str(tmp_path / "check"), sink, "update")
    run()
    log(spark, path, [(1, 5, "fail"), (2, 6, "ok"), (1, 6, "retry")])
    run()
    log(spark, path, [(1, 7, "fail"), (1, 8, "fail"), (1, 5, "fail")])  # the last one is a replay
    run()
    rows = spark.read.parquet(out).collect()
    last = {}
    for r in sorted(rows, key=lambda r: r.batch):
        last[r.uid] = (r.attempts, r.status)
    assert last == {1: (5, "dead"), 2: (0, "fetched"), 3: (0, "skipped")}
    assert {(r.batch, r.status) for r in rows if r.uid == 1} >= {(0, "failed"), (1, "retry_pending")}


def test_ingest_twice_adds_nothing(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    log(spark, path, [(1, 1, "a"), (1, 1, "a"), (2, 2, "b")])
    run = lambda check: flows.ingest(flows.stream(spark, path), out, str(tmp_path / check), ["uid", "event_id"])
    run("c")
    log(spark, path, [(2, 2, "b"), (3, 3, "c")])
    run("c")
    run("c")
    assert sorted(r.uid for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_windows_and_dedup(spark, tmp_path):
    path = str(tmp_path / "events")
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(minutes=10 * k), k % 2, 1.0) for k in range(20)]
    spark.createDataFrame(rows, "id long, at timestamp, user long, value double").coalesce(1).write.parquet(path)
    found = {}

    def keep(name):
        return lambda df, n: found.update({name: df.collect()})

    flows.run_once(flows.tumbling(flows.stream(spark, path), "1 hour"), str(tmp_path / "1"), keep("hour"), "complete")
    assert sorted(r.n for r in found["hour"]) == [2, 6, 6, 6]
    flows.run_once(flows.trailing(flows.stream(spark, path)), str(tmp_path / "2"), keep("trail"), "complete")
    assert max(r.n for r in found["trail"]) == 6
    flows.run_once(flows.sessions(flows.stream(spark, path), "user", "15 minutes"), str(tmp_path / "3"), keep("session"), "complete")
    assert len(found["session"]) == 20
    out = str(tmp_path / "dedup")
    flows.to_parquet(flows.dedup(flows.stream(spark, path), ["user"]), out, str(tmp_path / "4"))
    assert spark.read.parquet(out).count() == 2
