"""Calls to models: how many are in flight, what a breaker stops, what is committed, what a lost driver repeats."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from quire.operators import models


def test_results_come_as_they_complete():
    lock, open_, most, drawn = threading.Lock(), [0], [0], [0]

    def rows():
        for i in range(40):
            drawn[0] += 1
            yield i

    def call(i):
        with lock:
            open_[0] += 1
            most[0] = max(most[0], open_[0])
        time.sleep(0.05 if i == 0 else 0.005)
        with lock:
            open_[0] -= 1
        return i * i

    got, ahead = [], []
    for row, result in models.as_completed(rows(), call, 4, models.Breaker()):
        assert result == row * row
        got.append(row)
        ahead.append(drawn[0] - len(got))
    assert sorted(got) == list(range(40)) and got[0] != 0 and most[0] == 4 and max(ahead) <= 4


@pytest.mark.parametrize("error, calls", [(OSError("down"), 3), (models.FatalError("key"), 1)])
def test_breaker_stops_calls(error, calls):
    made = []

    def call(i):
        made.append(i)
        if i >= 5:
            raise error
        return i

    found = list(models.as_completed(range(50), call, 1, models.Breaker(3)))
    assert len(made) == 5 + calls and [r for _, r in found[:5]] == list(range(5))
    assert all(r is None for _, r in found[5 + calls :]) and len(found) == 50


def test_success_starts_the_count_again():
    def call(i):
        if i % 3:
            raise OSError
        return i

    assert sum(r is None for _, r in models.as_completed(range(30), call, 1, models.Breaker(3))) == 0


class _Counting(BaseHTTPRequestHandler):
    """Counts calls in flight and their prompts; fails for texts that hold ``boom``."""

    lock, open_, most, prompts, forms = threading.Lock(), 0, 0, [], []

    def do_POST(self):
        raw = self.rfile.read(int(self.headers["Content-Length"])).decode()
        with _Counting.lock:
            _Counting.open_ += 1
            _Counting.most = max(_Counting.most, _Counting.open_)
        time.sleep(0.02)
        with _Counting.lock:
            _Counting.open_ -= 1
        if self.path == "/form":
            _Counting.forms.append(raw)
            body = {"translations": [{"text": "traduit"}]}
        else:
            said = json.loads(raw)["prompt"]
            _Counting.prompts.append(said)
            body = {"response": said.split("SOURCE:\n")[1].upper()}
        self.send_response(500 if "boom" in raw else 200)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def base():
    server = ThreadingHTTPServer(("127.0.0.1", 0), _Counting)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def segments(spark, texts, parts=1):
    rows = [("b", f"s{i}", "html" if "<" in t else "text", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "book_id string, segment_id string, extract_mode string, source_content string").repartition(parts)


def test_calls_in_flight_and_prompts(spark, base):
    url = f"{base}/generate"
    df = segments(spark, [f"Some words number {i}" for i in range(30)] + ["<b>Marked</b> words here"])
    _Counting.most = 0
    got = models.translate(df, lambda: models.Service(url, "m", "generate"), "auto", "French", workers=2, intro="Be brief. {language_instruction}|{mode_instruction}").collect()
    assert _Counting.most == 2 and all(r["status"] == "completed" for r in got) and len(got) == 31
    assert all(p.startswith("Be brief. Detect the source language automatically and translate it into French.|") for p in _Counting.prompts[-31:])
    assert any("Preserve HTML structure" in p for p in _Counting.prompts)


def test_service_with_language_codes(spark, base):
    url = f"{base}/form"
    got = models.translate(segments(spark, ["<i>Words</i> to send"]), lambda: models.CodedService(url), "English", "German", attempts=1).collect()
    assert got[0]["translation"] == "traduit" and got[0]["provider_name"] == "deepl"
    assert "target_lang=DE" in _Counting.forms[-1] and "source_lang=EN" in _Counting.forms[-1] and "tag_handling=html" in _Counting.forms[-1]
    got = models.translate(segments(spark, ["Words"] * 3), lambda: models.CodedService(url), "English", "Klingon", attempts=1, workers=1).collect()
    assert sorted(r["status"] for r in got) == ["error", "pending", "pending"]


def test_pending_rows_behind_failures(spark, base):
    url = f"{base}/generate"
    df = segments(spark, [f"boom words {i}" for i in range(20)])
    got = models.translate(df, lambda: models.Service(url, "m", "generate"), "auto", "French", attempts=1, workers=1).collect()
    assert sorted(r["status"] for r in got) == ["error"] * 3 + ["pending"] * 17


class Log:
    """A client that notes its calls in files, as tasks and tests share no memory."""

    name, model, html = "log", "log", True

    def __init__(self, folder, failing=""):
        self.folder, self.failing = folder, failing

    def translate(self, content, source, target):
        with open(f"{self.folder}/{content.replace(' ', '_')}", "a") as f:
            f.write("x")
        if self.failing and self.failing in content:
            raise OSError("down")
        return content.upper()


def test_windows_are_committed_and_resumed(spark, tmp_path):
    calls, folder = tmp_path / "calls", str(tmp_path / "work")
    calls.mkdir()
    where = str(calls)
    df = segments(spark, [f"words {i}" for i in range(60)], 3)
    parts = []

    def step(found):
        return models.translate(found, lambda: Log(where), "auto", "French")

    def dying(found):
        parts.append(1)
        if len(parts) == 4:  # the first is the empty one that gives the schema
            raise RuntimeError("the driver is lost")
        return step(found)

    with pytest.raises(Exception, match="driver is lost"):
        models.in_windows(df, folder, dying, window=5, files=2)
    done = sum(1 for _ in calls.iterdir())
    assert 0 < done < 60
    got = models.in_windows(df, folder, step, window=5, files=2)
    assert sorted(r["segment_id"] for r in got.collect()) == sorted(f"s{i}" for i in range(60))
    assert all(p.read_text() == "x" for p in calls.iterdir())  # no call was repeated


def test_windows_wait_after_a_breaker(spark, tmp_path):
    calls, waits = tmp_path / "calls", []
    calls.mkdir()
    where = str(calls)
    df = segments(spark, [f"words {i}" for i in range(10)])
    step = lambda found: models.translate(found, lambda: Log(where, "words"), "auto", "French", attempts=1, workers=1)
    got = models.in_windows(df, str(tmp_path / "work"), step, window=10, cooldown_s=7, sleep=waits.append)
    assert waits == [7] and got.where("status = 'pending'").count() == 7
    empty = models.in_windows(df.limit(0), str(tmp_path / "none"), step)
    assert empty.count() == 0 and empty.columns == got.columns
