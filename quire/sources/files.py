"""JSON state, YAML settings and chapter files, and text sinks."""

from __future__ import annotations

import hashlib
import os
import posixpath
import re
import unicodedata
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quire.functions.text import slug, stem
from quire.operators.skip import KEYWORDS, THRESHOLD, TRIGGERS

STATE_SCHEMA = (
    "book_id string, segment_id string, status string, translation string, provider_name string, model_name string, error_message string"
)
#: Settings of a library or a book, with their defaults.
DEFAULTS: dict[str, object] = {
    "work_dir": ".quire",
    "source_language": "auto",
    "target_language": "Simplified Chinese",
    "translation_workers": 3,
    "audiobook_workers": 3,
    "output_mode": "bilingual",
    "prompt_preamble": None,
    "skip_rules": list(KEYWORDS),
    "skip_after_back_matter": True,
    "back_matter_triggers": list(TRIGGERS),
    "back_matter_threshold": THRESHOLD,
    "translation_files": None,
    "audiobook_files": None,
    "cover_image_path": None,
    "audiobook_voice": None,
    "audiobook_opening_statement": None,
    "audiobook_closing_statement": None,
    "audiobook_tts_provider": "silent",
    "audiobook_tts_model": None,
    "audiobook_tts_speed": 1.0,
    "cooldown_seconds": 1800,
}


def settings_problems(found: dict) -> list[str]:
    """What is out of range in settings."""
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    wrong = [f"not a number from 1 on: {k}" for k in ("translation_workers", "audiobook_workers") if not number(found[k]) or found[k] < 1]
    for key, low, high in (("back_matter_threshold", 0.0, 1.0), ("audiobook_tts_speed", 0.25, 4.0)):
        if not number(found[key]) or not low <= found[key] <= high:
            wrong.append(f"not between {low} and {high}: {key}")
    if output_mode(found["output_mode"]) not in ("bilingual", "translated_only"):
        wrong.append("neither bilingual nor translated_only: output_mode")
    if not number(found["cooldown_seconds"]) or found["cooldown_seconds"] < 0:
        wrong.append("not a number from 0 on: cooldown_seconds")
    wrong += [f"not a list: {k}" for k in ("skip_rules", "back_matter_triggers", "translation_files", "audiobook_files") if not isinstance(found[k], (list, type(None)))]
    return wrong


def output_mode(value: object) -> str:
    """A mode as it is written in the code."""
    return str(value).replace("-", "_").strip().lower()


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Records, one JSON object a line; anything that doesn't fit the schema fails."""
    return spark.read.schema(STATE_SCHEMA).option("mode", "FAILFAST").json(path)


def write_state(state: DataFrame, folder: str, version: int) -> str:
    """A new version beside the old ones; readers move on when they are told its path."""
    path = f"{folder}/v={version}"
    state.write.mode("errorifexists").json(path)
    return path


def settings(layers: list[str | dict], environment: dict[str, str] | None = None, prefix: str = "QUIRE_") -> tuple[dict, list[str]]:
    """(settings, unknown keys) from defaults, YAML files or mappings in order, then the environment; later ones win."""
    import yaml

    out, unknown = dict(DEFAULTS), set()
    for layer in layers:
        if isinstance(layer, dict):
            found = layer
        elif not os.path.exists(layer):
            found = {}
        elif layer.endswith((".yaml", ".yml")):
            found = yaml.safe_load(Path(layer).read_text()) or {}
        else:
            lines = (line.strip().removeprefix("export ").partition("=") for line in Path(layer).read_text().splitlines())
            found = environment_layer({k.strip(): v.strip().strip("\"'") for k, mark, v in lines if mark and not k.startswith("#")}, prefix)
        unknown |= set(found) - set(DEFAULTS)
        out |= {k: v for k, v in found.items() if k in DEFAULTS and v is not None}
    return out | environment_layer(environment or {}, prefix), sorted(unknown)


def environment_layer(environment: dict[str, str], prefix: str = "QUIRE_") -> dict:
    """The settings among variables of a name with ``prefix``, each in the type of its default; lists are separated by commas."""
    out = {}
    for key, value in environment.items():
        name = key.removeprefix(prefix).lower()
        if key.startswith(prefix) and name in DEFAULTS:
            kind = list if name.endswith("_files") else type(DEFAULTS[name])
            out[name] = value if kind is type(None) else value.lower() in ("1", "true", "yes") if kind is bool else value.split(",") if kind is list else kind(value)
    return out


def setting_layers(config: str | None = None, home: str | None = None, folder: str = ".", environment: dict[str, str] | None = None) -> list[str | dict]:
    """Where settings come from, later ones win: the user's file, ``.env`` and ``config.yaml`` of the folder, the environment, a named file."""
    if config is not None and not os.path.exists(config):
        raise FileNotFoundError(config)
    user = os.path.join(home or os.path.expanduser("~"), ".quire", "config.yaml")
    env = environment_layer(dict(os.environ) if environment is None else environment)
    return [user, os.path.join(folder, ".env"), os.path.join(folder, "config.yaml"), env, *([config] if config else [])]


def write_chapters(path: str, chapters: list[dict], metadata: dict) -> None:
    import yaml

    body = {"metadata": {k: v for k, v in metadata.items() if v is not None}, "chapters": chapters}
    Path(path).write_text(yaml.safe_dump(body, allow_unicode=True, sort_keys=False))


def read_chapters(path: str) -> tuple[list[dict], dict]:
    import yaml

    body = yaml.safe_load(Path(path).read_text()) or {}
    if "chapters" not in body:
        raise ValueError("no chapters in the file")

    def secs(value):
        if value is None or isinstance(value, (int, float)):
            return None if value is None else float(value)
        out = 0.0
        for part in str(value).split(":"):
            out = out * 60 + float(part)
        return out

    return [c | {"start": secs(c.get("start"))} for c in body["chapters"]], body.get("metadata") or {}


_WORD = re.compile(r"[^\s_-]+")
#: What a scalar in double quotes writes differently.
_ESCAPES = str.maketrans({"\\": r"\\", '"': r"\"", "\n": " ", "\r": " "})


def work_name(path: str) -> str:
    """A book's work folder: the first word of its file name in ASCII, and a digest of its path."""
    at = os.path.realpath(os.path.expanduser(path))
    word = _WORD.search(Path(at).stem)
    letters = (c for c in unicodedata.normalize("NFKD", word[0] if word else "").lower() if c.isascii() and c.isalnum())
    return "-".join(("".join(letters) or "book", hashlib.sha1(at.encode()).hexdigest()[:8]))


def yaml_scalar(value: object) -> str:
    return str(value).translate(_ESCAPES).join('""')


def checked_workspace(work: str, book: str, recorded: str) -> None:
    """Fails where a work folder was made from another book than the one at hand."""
    if os.path.realpath(os.path.expanduser(recorded)) != os.path.realpath(os.path.expanduser(book)):
        raise ValueError(f"{work} belongs to {recorded}, not to {book}")


def output_path(book: str, mode: str) -> str:
    """Where a translated book goes: beside the original, with its mode behind the name."""
    ending = {"bilingual": "_bilingual", "translated_only": "_translated"}[mode]
    at = Path(book)
    return str(at.with_name(at.stem + ending + at.suffix))


def settings_template(rows: list[dict]) -> str:
    """A book's settings file: its documents in order, skipped ones as comments; ``rows`` as export.template_files gives."""
    lines = ["translation_files:"]
    for r in sorted(rows, key=lambda r: (r["spine_index"], r["file_path"])):
        lines.append(("  - " if r["active"] else "  # - ") + yaml_scalar(r["file_path"]))
    return "\n".join(lines) + "\n"


def write_new(path: str, text: str) -> bool:
    """Write a file unless it is there already."""
    try:
        with open(path, "x", encoding="utf-8") as f:
            f.write(text)
    except FileExistsError:
        return False
    return True


def chapter_files(chapters: DataFrame, width: int = 3) -> DataFrame:
    """(path, content): a markdown file a chapter, numbered in reading order and named by its title.

    ``chapters(book_id, position, title, body)``.
    """
    nth = F.row_number().over(Window.partitionBy("book_id").orderBy("position", "title"))
    name = F.concat(F.lpad(nth.cast("string"), width, "0"), F.lit("_"), slug(F.col("title")), F.lit(".md"))
    text = F.concat(F.lit("# "), "title", F.lit("\n\n"), "body", F.lit("\n"))
    return chapters.select(F.concat(folder_name(F.col("book_id")), F.lit("/"), name).alias("path"), F.encode(text, "UTF-8").alias("content"))


def folder_name(book: Column) -> Column:
    """A book's folder in an export: its file's stem and a digest of its path, so that equal names stay apart."""
    return F.concat(slug(stem(book)), F.lit("-"), F.substring(F.sha1(book), 1, 8))


def write_report(rows: DataFrame, path: str) -> None:
    """A report as JSON, one object a line."""
    rows.write.mode("overwrite").json(path)


def write_markdown(chapters: DataFrame, folder: str) -> None:
    """A text file tree partitioned by book; ``chapters(book_id, position, title, body)``."""
    text = F.concat(F.lit("# "), "title", F.lit("\n\n"), "body")
    chapters.select("book_id", "position", text.alias("value")).write.mode("overwrite").partitionBy("book_id", "position").text(folder)


def combined_markdown(chapters: DataFrame) -> DataFrame:
    """(book_id, text): a book's chapters in order, with a rule between them."""
    parts = F.sort_array(F.collect_list(F.struct("position", F.concat(F.lit("# "), "title", F.lit("\n\n"), "body").alias("t"))))
    return chapters.groupBy("book_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n---\n\n").alias("text"))
