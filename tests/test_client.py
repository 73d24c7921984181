"""Web client policies against a scripted transport."""

import pytest

from wikiloom.sources.client import Client, HttpError, NotFound, Response, TokenBucket, next_url, retry_after, retry_delay, run_hook, same_host

BASE = "https://h.example/wiki"


def client(script, **kw):
    sent, slept = [], []
    answers = iter(script)

    def send(url, credentials):
        sent.append((url, credentials))
        answer = next(answers)
        if isinstance(answer, Exception):
            raise answer
        return answer

    return Client(BASE, send, sleep=slept.append, **kw), sent, slept


def test_retries():
    c, sent, slept = client([OSError("reset"), Response(503), Response(429, headers={"Retry-After": "7"}), Response(200, {"a": 1})])
    assert c.get(f"{BASE}/x").body == {"a": 1} and len(sent) == 4 and slept[2] == 7 and 0.9 <= slept[0] <= 1.1 and 1.8 <= slept[1] <= 2.2
    c, sent, _ = client([Response(500, text="x" * 5000)] * 2, attempts=2)
    with pytest.raises(HttpError) as e:
        c.get(BASE)
    assert len(str(e.value)) < 1100 and len(sent) == 2
    c, sent, _ = client([Response(404)])
    with pytest.raises(NotFound):
        c.get(BASE)
    c, _, _ = client([OSError("down")] * 2, attempts=2)
    with pytest.raises(OSError, match="down"):
        c.get(BASE)


def test_delays():
    assert retry_delay(3, 1000, jitter=lambda: 0.5) == 8.0 and retry_delay(40, 1000, jitter=lambda: 0.5) == 1024.0
    assert retry_after("soon") == 0 and retry_after(None) == 0 and retry_after("Wed, 21 Oct 2015 07:28:00 GMT", 1445412470.0) == 10.0
    assert retry_delay(0, 100, Response(503, headers={"Retry-After": "9"}), lambda: 0.5) == 0.1


def test_pages_and_hosts():
    c, sent, _ = client([Response(200, {"results": [{"id": 1}], "_links": {"next": "/wiki/p?cursor=2"}}), Response(200, {"results": [{"id": 2}]})])
    assert [r["id"] for r in c.pages(f"{BASE}/p")] == [1, 2] and sent[1] == ("https://h.example/wiki/p?cursor=2", True)
    c, _, _ = client([Response(404)])
    assert list(c.pages(BASE)) == []
    assert same_host("https://A/x", "https://a/y") and not same_host("https://a:1/", "https://a/") and not same_host("/x", "/y")
    assert next_url(BASE, None) is None and next_url(BASE, "https://o/x") == "https://o/x"
    c, sent, _ = client([Response(200, {})])
    c.get("https://other/x")
    assert sent == [("https://other/x", False)]


def test_budget():
    now, waits = [0.0], []
    bucket = TokenBucket(60, 2, clock=lambda: now[0], sleep=waits.append)
    for _ in range(4):
        bucket.take()
    assert waits == [1.0, 2.0]
    now[0] = 100.0
    bucket.take()
    assert len(waits) == 2


def test_hook(tmp_path):
    assert run_hook([" ", ""]) is None and run_hook(["touch", str(tmp_path / "a")], dry_run=True) is None
    assert run_hook([" touch ", str(tmp_path / "b"), " "]).wait() == 0 and (tmp_path / "b").exists()
