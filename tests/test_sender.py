"""Webhooks behind the caller's back, the test call, secrets at rest."""

import json
import threading
import time

import pytest

from timberline.plans.engine import Engine
from timberline.plans.registry import Rule, Source
from timberline.sources.store import Sender


def test_a_hanging_receiver_delays_no_tick(spark):
    released, sent = threading.Event(), []

    def post(url, payload, secret):
        if url == "http://hangs":
            released.wait(20)
        elif url == "http://down":
            raise OSError("refused")
        sent.append((url, payload["metricValue"], secret))
        return 500 if url == "http://broken" else 204

    engine = Engine(spark, sender=Sender(threads=2, post=post))
    for name, url in (("a", "http://hangs"), ("b", "http://down"), ("c", "http://broken"), ("d", "http://fine"), ("e", "")):
        engine.rules.create(Rule(name, threshold=1.0, webhook_url=url, webhook_secret="s3cret"))
    engine.rules.create(Rule("f", threshold=1.0, webhook_url="http://fine", muted=True))
    triggered = spark.createDataFrame([(k, 2.0, True) for k in range(1, 7)], "rule_id long, metric_value double, triggered boolean")
    triggered.collect()
    start = time.perf_counter()
    assert engine.fire(triggered, set()) == {1, 2, 3, 4, 5, 6}
    assert time.perf_counter() - start < 10 and not released.is_set()
    released.set()
    engine.sender.close()
    assert sorted(sent) == [("http://broken", 2.0, "s3cret"), ("http://fine", 2.0, "s3cret"), ("http://hangs", 2.0, "s3cret")]
    assert {e.rule_id: e.notified for e in engine.events.list()} == {1: True, 2: False, 3: False, 4: True, 5: True, 6: False}


def test_a_full_queue_refuses():
    gate = threading.Event()
    sender = Sender(threads=1, waiting=1, post=lambda *_: gate.wait(20) and 200)
    assert sender.submit("u", {})
    for _ in range(200):
        if sender.queue.empty():
            break
        time.sleep(0.01)
    assert sender.submit("u", {}) and not sender.submit("u", {})
    gate.set()
    sender.close()


def test_webhook_call(spark):
    engine = Engine(spark)
    silent, closed = engine.rules.create(Rule("x", threshold=1.0)), engine.rules.create(Rule("y", threshold=1.0, webhook_url="http://127.0.0.1:9/"))
    assert engine.test_webhook(silent.id) == (False, "the rule has no webhook")
    ok, why = engine.test_webhook(closed.id, timeout=1)
    assert not ok and why


def test_secrets_are_sealed(spark, tmp_path):
    key = bytes(range(32))
    engine = Engine(spark, state=str(tmp_path), key=key)
    engine.sources.create(Source("s", "SFTP", "/x", host="h", username="u", password="hunter2"))
    engine.rules.create(Rule("r", threshold=1.0, webhook_secret="tëll no one"))
    kept = "".join(p.read_text() for p in tmp_path.iterdir())
    assert "hunter2" not in kept and "no one" not in kept and json.loads((tmp_path / "sources.json").read_text())[0]["password"].startswith("aes:")
    again = Engine(spark, state=str(tmp_path), key=key)
    assert again.sources.get(1).password == "hunter2" and again.rules.get(1).webhook_secret == "tëll no one"
    again.sources.update(1, host="h2")
    assert "hunter2" not in (tmp_path / "sources.json").read_text() and Engine(spark, state=str(tmp_path), key=key).sources.get(1).password == "hunter2"
    for wrong in (bytes(32), None):
        with pytest.raises(ValueError):
            Engine(spark, state=str(tmp_path), key=wrong)
    with pytest.raises(ValueError):
        Engine(spark, key=b"short")


def test_without_a_key_secrets_are_not_written(spark, tmp_path):
    engine = Engine(spark, state=str(tmp_path))
    engine.sources.create(Source("s", "SFTP", "/x", host="h", username="u", password="hunter2"))
    assert engine.sources.get(1).password == "hunter2" and "hunter2" not in (tmp_path / "sources.json").read_text()
