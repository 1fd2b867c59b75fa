"""External models over tables: one client a partition, errors as values, results keyed by segment.

A task keeps a bounded number of calls in flight and gives results as they come, in small batches; it draws its next row only when
a call has ended. A breaker ends the calls of a task after several failures in a row: what is left comes back as pending. ``in_windows``
commits the results of a few thousand rows at a time, so a lost task or driver repeats the calls of one window at most.
"""

from __future__ import annotations

import io
import json
import time
import urllib.error
import urllib.parse
import urllib.request
import wave
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from typing import Protocol, TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.functions.text import chinese_target, copy_class, deepl_code, polish_cjk, prompt, sentences
from quire.operators.audio import pauses

# HTTP answers that are worth another attempt.
RETRIED = (408, 409, 425, 429)


#: What a request says before the text, unless settings say something else.
INTRO = "{language_instruction} {mode_instruction}"
T, R = TypeVar("T"), TypeVar("R")


class RowError(Exception):
    """An error that no further attempt at this row can mend."""


class FatalError(RowError):
    """An error that will befall every row: a rejected key, an unknown model."""


class Breaker:
    """Open after ``limit`` failures in a row, or one fatal error; a success in between starts the count again."""

    def __init__(self, limit: int = 3):
        self.limit, self.run, self.open = limit, 0, False

    def saw(self, error: BaseException | None) -> None:
        self.run = self.run + 1 if error else 0
        self.open = self.open or isinstance(error, FatalError) or self.run >= self.limit


def as_completed(rows: Iterable[T], call: Callable[[T], R], workers: int, breaker: Breaker) -> Iterator[tuple[T, R | BaseException | None]]:
    """(row, result or error) in the order of completion; None stands for rows that an open breaker kept from being called.

    At most ``workers`` calls are in flight, and a row is drawn only when one of them has ended.
    """
    source, flying, dry = iter(rows), {}, False
    with ThreadPoolExecutor(workers) as pool:
        while True:
            while not dry and not breaker.open and len(flying) < workers:
                try:
                    row = next(source)
                except StopIteration:
                    dry = True
                else:
                    flying[pool.submit(call, row)] = row
            if not flying:
                break
            done: set[Future] = wait(flying, return_when=FIRST_COMPLETED).done
            for future in done:
                error = future.exception()
                breaker.saw(error)
                yield flying.pop(future), error or future.result()
    for row in source:
        yield row, None


@dataclass
class Request:
    """A segment as a client sees it: its text and languages, the prompt that asks for it, and short codes of the languages."""

    content: str
    mode: str
    source: str
    target: str
    prompt: str
    source_code: str | None = None
    target_code: str | None = None


class Translator(Protocol):
    """Clients may have ``respond(Request)`` instead of ``translate``, which sees the text and the languages only."""

    name: str
    model: str
    html: bool

    def translate(self, content: str, source: str, target: str) -> str: ...


class Stub:
    """A deterministic translator for tests: the target's name and the text in capitals."""

    name, model, html = "stub", "upper", True

    def translate(self, content: str, source: str, target: str) -> str:
        return f"[{target}] {content.upper()}"


def retryable(status: int) -> bool:
    return status in RETRIED or status >= 500


def attempted(call: Callable[[], str], attempts: int = 3, wait: Callable[[int], float] = lambda n: 2.0**n, sleep=time.sleep) -> str:
    """The result of the first attempt that succeeds; fatal errors end at once."""
    for n in range(attempts):
        try:
            return call()
        except RowError:
            raise
        except Exception:
            if n == attempts - 1:
                raise
            sleep(wait(n))
    raise ValueError("no attempts")


def translate(
    segments: DataFrame, make: Callable[[], Translator], source: str, target: str, attempts: int = 3, workers: int = 3, limit: int = 3,
    intro: str = INTRO, batch: int = 32,
) -> DataFrame:
    """(book_id, segment_id, status, translation, provider_name, model_name, error_message).

    Text that needs no model is copied without a provider's name. A task has ``workers`` calls in flight; after ``limit`` failures in a
    row, or a fatal one, it makes no more, and the rows that are left are pending. Persist the result before it is used twice: a plan that
    reads it again would call the model again.
    """
    content, mode = F.col("source_content"), F.col("extract_mode")
    asked = prompt(content, mode, F.lit(source), F.lit(target), intro)
    codes = (deepl_code(F.lit(source)).alias("source_code"), deepl_code(F.lit(target)).alias("target_code"))
    marked = segments.select("book_id", "segment_id", mode, content, (copy_class(content) != "translate").alias("copy"), asked.alias("asked"), *codes)
    schema = "book_id string, segment_id string, status string, translation string, provider_name string, model_name string, error_message string"
    names = [n.split()[0] for n in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clients: list[Translator] = []
        out: list[dict] = []

        def record(r: dict, status: str, translation: str | None, error: str | None = None, called: bool = True) -> None:
            by = (clients[0].name, clients[0].model) if called and clients else (None, None)
            out.append(dict(zip(names, (r["book_id"], r["segment_id"], status, translation, *by, error))))

        def wanted() -> Iterator[dict]:
            for found in batches:
                for start in range(0, found.num_rows, batch):
                    for r in found.slice(start, batch).to_pylist():
                        if r["copy"]:
                            record(r, "completed", r["source_content"], called=False)
                        else:
                            yield r

        def call(r: dict) -> str:
            client = clients[0]
            if r["extract_mode"] == "html" and not client.html:
                raise RowError(f"{client.name} can't translate markup")
            request = Request(r["source_content"], r["extract_mode"], source, target, r["asked"], r["source_code"], r["target_code"])
            respond = getattr(client, "respond", None) or (lambda q: client.translate(q.content, q.source, q.target))
            answer = attempted(lambda: respond(request), attempts)
            if not (answer or "").strip():
                raise RowError("empty answer")
            return answer

        def started() -> Iterator[dict]:
            for r in wanted():
                if not clients:
                    clients.append(make())
                yield r

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist(out, schema=pa.schema([(n, pa.string()) for n in names]))
            out.clear()
            return made

        for r, result in as_completed(started(), call, workers, Breaker(limit)):
            if result is None:
                record(r, "pending", None, called=False)
            elif isinstance(result, BaseException):
                record(r, "error", None, str(result))
            else:
                record(r, "completed", result)
            if len(out) >= batch:
                yield batch_of()
        yield batch_of()

    out = marked.mapInArrow(run, schema)
    chinese = chinese_target(F.lit(target)) & F.col("provider_name").isNotNull()
    return out.withColumn("translation", F.when(chinese, polish_cjk(F.col("translation"))).otherwise(F.col("translation")))


def in_windows(
    rows: DataFrame, folder: str, step: Callable[[DataFrame], DataFrame], window: int = 1000, files: int = 64, cooldown_s: float = 1800.0,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """The results of ``step`` over ``rows``, committed a few windows at a time below ``folder``, which Spark's writers reach.

    The rows are laid out as files of ``window`` rows, and a stream takes ``files`` of them at a time, a task each; its checkpoint is the
    record of what is done. A task that dies repeats its window; a driver that dies goes on where it was, if it is called again with the same
    folder (the rows are then those laid out before). A part with results left pending was stopped by a breaker: the next one waits for ``cooldown_s`` seconds.
    """
    spark = rows.sparkSession
    waiting, answers = f"{folder}/waiting", f"{folder}/answers"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{waiting}/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        rows.write.mode("overwrite").option("maxRecordsPerFile", window).parquet(waiting)
    schema = step(spark.read.schema(rows.schema).parquet(waiting).limit(0)).schema

    def part(found: DataFrame, n: int) -> None:
        where = f"{answers}/part={n}"
        step(found).write.mode("overwrite").parquet(where)  # the same files again if the part is repeated
        if not spark.read.schema(schema).parquet(where).where("status = 'pending'").isEmpty():
            sleep(cooldown_s)

    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(waiting)
    query = stream.writeStream.foreachBatch(part).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    there = spark._jvm.org.apache.hadoop.fs.Path(answers)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{answers}/part=*")


def answer_text(answer: dict) -> str:
    """The text of a response: every text part of every output item."""
    parts = [c.get("text", "") for item in answer.get("output", []) for c in item.get("content", []) or [] if c.get("text")]
    if not parts and answer.get("choices"):
        parts = [(c.get("message") or {}).get("content") or "" for c in answer["choices"][:1]]
    return "".join(parts).strip()


def post(url: str, body: dict, headers: dict[str, str], timeout: float = 60.0, form: bool = False) -> dict:
    """A JSON answer; statuses that aren't worth another attempt are fatal."""
    sent = urllib.parse.urlencode(body) if form else json.dumps(body)
    kind = "application/x-www-form-urlencoded" if form else "application/json"
    request = urllib.request.Request(url, sent.encode(), {"Content-Type": kind, **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as e:
        said = f"status {e.code}: {e.read()[:200].decode('utf-8', 'replace')}"
        raise (ConnectionError if retryable(e.code) else FatalError)(said) from e


#: How services take a prompt, as (body of a request, path to the answer's text).
SHAPES: dict[str, tuple[Callable[[str, str], dict], Callable[[dict], str]]] = {
    "responses": (lambda model, prompt: {"model": model, "input": prompt}, answer_text),
    "chat": (lambda model, prompt: {"model": model, "messages": [{"role": "user", "content": prompt}]}, answer_text),
    "messages": (
        lambda model, prompt: {"model": model, "max_tokens": 8192, "messages": [{"role": "user", "content": prompt}]},
        lambda a: "".join(c.get("text", "") for c in a.get("content", [])).strip(),
    ),
    "contents": (
        lambda model, prompt: {"contents": [{"parts": [{"text": prompt}]}]},
        lambda a: "".join(p.get("text", "") for c in a.get("candidates", [])[:1] for p in c.get("content", {}).get("parts", [])).strip(),
    ),
    "generate": (lambda model, prompt: {"model": model, "prompt": prompt, "stream": False}, lambda a: (a.get("response") or "").strip()),
}


@dataclass
class Service:
    """A translator behind an HTTP interface of one of SHAPES; ``headers`` carry its key."""

    url: str
    model: str
    shape: str = "chat"
    name: str = "service"
    headers: dict[str, str] = field(default_factory=dict)
    timeout: float = 60.0
    html: bool = True

    def respond(self, request: Request) -> str:
        body, text = SHAPES[self.shape]
        return text(post(self.url, body(self.model, request.prompt), self.headers, self.timeout))


@dataclass
class CodedService:
    """A translator that takes texts and language codes as a form instead of a prompt; ``headers`` carry its key."""

    url: str
    name: str = "deepl"
    model: str = "deepl"
    headers: dict[str, str] = field(default_factory=dict)
    timeout: float = 60.0
    html: bool = True

    def respond(self, request: Request) -> str:
        if not request.target_code:
            raise FatalError(f"no language code for {request.target}")
        body = {"text": request.content, "target_lang": request.target_code}
        if request.mode == "html":
            body["tag_handling"] = "html"
        if request.source_code and request.source.lower() != "auto":
            body["source_lang"] = request.source_code
        answer = post(self.url, body, self.headers, self.timeout, form=True)
        return "".join(t.get("text", "") for t in answer.get("translations", [])[:1])


# Speech


class Speaker(Protocol):
    name: str

    def synthesize(self, text: str, voice: str) -> bytes:
        """A sentence as a WAV file."""


class SilentSpeaker:
    """A deterministic speaker for tests: silence, a hundredth of a second a character."""

    name, rate = "silent", 8000

    def synthesize(self, text: str, voice: str) -> bytes:
        return wav(bytes(2 * (self.rate * len(text) // 100)), self.rate)


def wav(frames: bytes, rate: int, width: int = 2, channels: int = 1) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(frames)
    return out.getvalue()


def spliced(parts: list[bytes], gaps_ms: list[int]) -> tuple[bytes, float]:
    """(one WAV file of several of one format with silence between them, its seconds)."""
    frames, shape = [], None
    for i, part in enumerate(parts):
        with wave.open(io.BytesIO(part)) as w:
            own = (w.getframerate(), w.getsampwidth(), w.getnchannels())
            if shape not in (None, own):
                raise FatalError("the speaker changed its format")
            shape = own
            if i:
                frames.append(bytes(own[0] * gaps_ms[i - 1] // 1000 * own[1] * own[2]))
            frames.append(w.readframes(w.getnframes()))
    whole = b"".join(frames)
    rate, width, channels = shape
    return wav(whole, rate, width, channels), len(whole) / (rate * width * channels)


def render(
    plan: DataFrame, make: Callable[[], Speaker], voice: str, low: float = 0.2, high: float = 0.6, attempts: int = 3, wait_s: float = 60.0,
    workers: int = 3, limit: int = 3,
) -> DataFrame:
    """(book_id, segment_id, status, audio, duration_seconds, error_message) of ``plan(book_id, segment_id, spoken)``.

    Each sentence is spoken by itself; pauses between them depend on the segment's id only. Segments are spoken ``workers`` at a time and
    given one by one as they are done; calls end as those of ``translate`` do. Persist the result before it is used twice: a plan that reads it
    again would call the speaker again.
    """
    rows = plan.where("spoken is not null").select("book_id", "segment_id", sentences(F.col("spoken")).alias("sentences"))
    schema = "book_id string, segment_id string, status string, audio binary, duration_seconds double, error_message string"
    kinds = pa.schema([(n.split()[0], {"string": pa.string(), "binary": pa.binary(), "double": pa.float64()}[n.split()[1]]) for n in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speakers: list[Speaker] = []

        def wanted() -> Iterator[dict]:
            for batch in batches:
                for i in range(batch.num_rows):
                    if not speakers:
                        speakers.append(make())
                    yield batch.slice(i, 1).to_pylist()[0]

        def speak(r: dict) -> tuple[bytes, float]:
            parts = [attempted(lambda: speakers[0].synthesize(s, voice), attempts, lambda n: wait_s) for s in r["sentences"]]
            return spliced(parts, pauses(r["segment_id"], max(0, len(parts) - 1), low, high))

        for r, result in as_completed(wanted(), speak, workers, Breaker(limit)):
            row = {"book_id": r["book_id"], "segment_id": r["segment_id"], "status": "pending", "audio": None, "duration_seconds": None, "error_message": None}
            if isinstance(result, BaseException):
                row |= {"status": "error", "error_message": str(result)}
            elif result is not None:
                row |= {"status": "completed", "audio": result[0], "duration_seconds": result[1]}
            yield pa.RecordBatch.from_pylist([row], schema=kinds)

    return rows.mapInArrow(run, schema)
