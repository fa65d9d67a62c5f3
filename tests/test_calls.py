"""Retries and the write-once cache of calls."""

import os
import threading
import time

import pytest

from lodestar import calls


def failing(*errors, then="ok"):
    left = list(errors)

    def call():
        if left:
            raise left.pop(0)
        return then

    return call


def test_waits_are_those_that_the_reply_asks_for():
    waits = []
    assert calls.with_retry(failing(calls.CallError(429, "Please retry in 18.4s."), calls.CallError(503), ConnectionError()), waits.append) == "ok"
    assert waits == [19.4, 30.0, 30.0]
    assert calls.wait_for(calls.CallError(429, "'retryDelay': '29s'"), 1) == 30.0 and calls.wait_for(calls.CallError(500), 9) == 90.0
    for error, kind in ((calls.CallError(400), calls.CallError), (calls.CallError(429, "Quota: RequestsPerDay"), calls.QuotaExhausted)):
        waits.clear()
        with pytest.raises(kind):
            calls.with_retry(failing(error), waits.append)
        assert waits == []
    with pytest.raises(calls.CallError):
        calls.with_retry(failing(*[calls.CallError(500)] * 9), lambda s: None)


def test_keys_are_those_of_what_is_asked():
    one = {"messages": [{"text": "a", "timestamp": 1, "parts": [{"id": 3, "x": (1, 2)}]}], "b": 1}
    other = {"b": 1, "messages": [{"parts": [{"x": [1, 2]}], "text": "a", "timestamp": 2}]}
    assert calls.request_key("m", one) == calls.request_key("m", other)
    assert len({calls.request_key(m, r) for m, r in (("m", one), ("n", one), ("m", {**one, "b": 2}))}) == 3


def test_two_runs_pay_a_request_once(spark, tmp_path):
    paid = []

    def call(request):
        time.sleep(0.5)
        paid.append(request)
        return {"said": request["q"] + "é"}

    caches, got = [calls.CallCache(spark, str(tmp_path)) for _ in range(3)], []
    runs = [threading.Thread(target=lambda c=c: got.extend(c.ask("m", {"q": q, "id": id(c)}, call) for q in ("x", "y"))) for c in caches]
    for r in runs:
        r.start()
    for r in runs:
        r.join(60)
    assert sorted(r["q"] for r in paid) == ["x", "y"] and sorted(a["said"] for a in got) == ["xé"] * 3 + ["yé"] * 3
    assert sum(c.misses for c in caches) == 2 and sum(c.hits for c in caches) == 4
    assert {r["answer"] for r in caches[0].table().collect()} == {'{"said":"xé"}', '{"said":"yé"}'}


def test_failures_and_lost_claims_leave_the_request_open(spark, tmp_path):
    cache = calls.CallCache(spark, str(tmp_path))
    with pytest.raises(ZeroDivisionError):
        cache.ask("m", 1, lambda r: 1 / 0)
    key = calls.request_key("m", 1)
    (tmp_path / f"{key}.claim.lost").touch()  # of a job that was lost
    os.utime(tmp_path / f"{key}.claim.lost", (1, 1))
    model = calls.CachedModel("m", lambda question, messages: {"answer": {"answer": question}}, cache)
    assert cache.ask("m", 1, lambda r: r + 1) == 2 == cache.ask("m", 1, lambda r: r + 5)
    assert model("q", []) == model("q", []) == {"answer": {"answer": "q"}}
    assert cache.misses == 2
