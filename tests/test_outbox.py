"""Messages are composed whole, queued once and delivered once, whatever fails in between."""

import json
import os

import pytest
from pyspark.sql import functions as F

from offerlens.streaming import outbox
from offerlens.tables.store import Store

FIELDS = "channel string, n int, line string, caption string, url string"


def told(spark, rows):
    return outbox.composed(spark.createDataFrame(rows, FIELDS), [F.col("n")])


def read(folder):
    return [json.load(open(f"{folder}/{n}")) for n in sorted(os.listdir(folder)) if not n.startswith(".")]


def test_messages_hold_every_alert(spark):
    rows = [("big", k, f"line {k} " + "x" * 600, "c" * 2000, None) for k in range(23)] + [("pics", k, f"l{k}", f"c{k}", f"u{k}") for k in range(10)] + [("one", 0, "l", "c", "u")] + [("some", k, f"l{k}", "c", "u" if k else "") for k in range(3)] + [(None, 1, "l", None, None)]
    got = told(spark, rows).collect()
    shapes = {c: sorted((r["shape"], r["alerts"], len(r["pictures"])) for r in got if r["channel"] == c) for c in ("big", "pics", "one", "some", None)}
    assert shapes == {"big": [("text", 3, 0), ("text", 10, 0), ("text", 10, 0)], "pics": [("album", 10, 10)], "one": [("photo", 1, 1)], "some": [("text+album", 3, 2)], None: [("text", 1, 0)]}
    assert all(len(r["body"]) <= 4096 and all(len(p["caption"] or "") <= 1024 for p in r["pictures"]) for r in got) and len({r["delivery_key"] for r in got}) == len(got)
    album = next(r for r in got if r["channel"] == "pics")
    assert [p["url"] for p in album["pictures"]] == [f"u{k}" for k in range(10)] and album["body"] == ""
    many = told(spark, [("a", k, f"l{k}", None, None) for k in range(2500)]).collect()
    assert sum(r["alerts"] for r in many) == 2500 and max(r["alerts"] for r in many) == 10 and sorted(x for r in many for x in r["body"].split("\n\n")) == sorted(f"l{k}" for k in range(2500))
    assert told(spark, []).collect() == []


def test_a_batch_that_comes_again_delivers_nothing_twice(spark, tmp_path):
    store, folder = Store(spark, f"{tmp_path}/s"), str(tmp_path / "out")
    marks = str(tmp_path / "sent")
    os.makedirs(marks)
    to_folder = outbox.to_folder(folder)

    def send(channel, key, message):
        """Notes every handing over; the channel b is down until it is mended."""
        if channel == "b" and not os.path.exists(f"{marks}/mended"):
            raise OSError("channel is down")
        n = len([x for x in os.listdir(marks) if x.startswith(key)])
        open(f"{marks}/{key}-{n}", "w").close()
        to_folder(channel, key, message)

    first = told(spark, [(c, k, f"{c}{k}", None, None) for c in "ab" for k in range(12)])
    assert outbox.queue(store, first, "w", 0) == 1 and outbox.queue(store, first, "w", 0) == 1
    outbox.deliver(store, send)
    state = lambda: sorted((r["channel"], r["state"], r["attempts"]) for r in store.read("outbox").collect())
    assert state() == [("a", "sent", 1)] * 2 + [("b", "failed", 1)] * 2 and {m["channel"] for m in read(folder)} == {"a"}
    assert all("channel is down" in r["error"] for r in store.read("outbox").filter("state = 'failed'").collect())
    outbox.queue(store, first, "w", 1)  # the same messages in a new batch are known by their keys
    open(f"{marks}/mended", "w").close()
    outbox.deliver(store, send)
    outbox.deliver(store, send)
    assert state() == [("a", "sent", 1)] * 2 + [("b", "sent", 2)] * 2 and len(read(folder)) == 4
    assert sorted(n.split("-")[1] for n in os.listdir(marks) if "-" in n) == ["0"] * 4  # each was handed over once
    assert sum(m["body"].count("\n\n") + 1 for m in read(folder)) == 24


def test_a_run_that_dies_before_the_note(spark, tmp_path, monkeypatch):
    store, folder = Store(spark, f"{tmp_path}/s"), str(tmp_path / "out")
    outbox.queue(store, told(spark, [("a", k, f"l{k}", None, None) for k in range(3)]), "w", 0)
    monkeypatch.setattr(Store, "begin", lambda *a: (_ for _ in ()).throw(RuntimeError("dies")))
    with pytest.raises(RuntimeError, match="dies"):
        outbox.deliver(store, outbox.to_folder(folder))
    monkeypatch.undo()
    assert store.version() == 1 and len(read(folder)) == 1
    outbox.deliver(store, outbox.to_folder(folder))
    assert len(read(folder)) == 1 and [r["state"] for r in store.read("outbox").collect()] == ["sent"]


def test_attempts_end(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    outbox.queue(store, told(spark, [("a", 1, "l", None, None)]), "w", 0)

    def down(channel, key, message):
        raise OSError("down")

    for _ in range(4):
        outbox.deliver(store, down, attempts=2)
    assert [(r["state"], r["attempts"]) for r in store.read("outbox").collect()] == [("failed", 2)]


def test_a_stream_of_alerts(spark, tmp_path):
    store, folder = Store(spark, f"{tmp_path}/s"), str(tmp_path / "out")
    for k in range(2):
        spark.createDataFrame([("a", 10 * k + j, f"l{k}{j}", None, None) for j in range(4)], FIELDS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(FIELDS).parquet(f"{tmp_path}/in")
        for again in ("c", "c"):
            outbox.run_available(stream, store, lambda rows: outbox.composed(rows, [F.col("n")]), outbox.to_folder(folder), f"{tmp_path}/{again}")
    assert sorted(x for m in read(folder) for x in m["body"].split("\n\n")) == sorted(f"l{k}{j}" for k in range(2) for j in range(4)) and len(read(folder)) == 2
