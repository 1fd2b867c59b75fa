"""Quality rules as a learned decision list.

``statistics`` measures every whole text. ``learn`` grows and prunes interpretable conjunctions of
thresholds by sequential covering on labelled statistics: grow a rule on two thirds of the rows by
information gain, drop conditions while the other third doesn't get worse, keep the rule if it is
precise enough there, remove the rows it covers, repeat. ``verdict`` turns the ordered list into one
chain of Spark conditional expressions.

The fit uses at most ``max_rows`` labelled rows, those whose ids have the smallest hashes.

Edge cases: null and blank texts have zero words and fail the base rules; without labels of both
classes the list is empty and only the base rules decide; null labels don't count. A labelled id
that occurs in several rows counts once a row. Texts of any length are measured whole; repeated rows keep a row each; an empty
table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.common import text_slices, texts_of

SPACES = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_ends")
_CONT = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(65, 91))


def measure(text: bytes, window: int = 3) -> tuple[int, ...]:
    """The statistics named in STATS for one text in UTF-8."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    bare = text.translate(None, SPACES)
    chars = len(bare) - (len(bare) - len(bare.translate(None, _CONT)))
    return (
        len(words),
        chars,
        len(bare) - len(bare.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words, window),
        len(lines),
        len(bare) - len(bare.translate(None, _UPPER)),
        bare.count(b"!") + bare.count(b"?"),
        sum(w.endswith((b".", b"!", b"?")) for w in words),
    )


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words that lie in a window of words which the text holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) ** window < 1 << 62:
        key = seq[:n].copy()
        for i in range(1, window):
            key = key * len(ids) + seq[i : n + i]
    else:
        key = np.unique(np.stack([seq[i : n + i] for i in range(window)], axis=1), axis=0, return_inverse=True)[1].ravel()
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(len(words), bool)
    for i in range(window):
        inside[i : n + i] |= twice
    return int(inside.sum())


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, the statistics as longs) for every row."""

    names = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "__text", 4 << 20):
                found = np.array([measure(t) for t in texts_of(part.column("__text"))], dtype=np.int64).reshape(-1, len(STATS))
                arrays = [part.column("__text" if name == text_col else name) for name in names]
                arrays += [pa.array(found[:, i]) for i in range(len(STATS))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, *STATS])

    # A kept text column travels once.
    cols = [F.col(id_col).alias("doc_id"), *(F.col(c) for c in keep if c != text_col), F.col(text_col).alias("__text")]
    schema = ", ".join(f"`{n}` {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, [id_col, *keep]))
    return docs.select(*cols).mapInArrow(run, schema + "".join(f", {s} bigint" for s in STATS))


#: Features of the rules, as (numerator, denominator) over the statistics.
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "upper_per_char": ("n_upper", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "ends_per_word": ("n_ends", "n_words"),
}


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        top, bottom = FEATURES[self.feature]
        value = F.coalesce(F.try_divide(F.col(top), F.col(bottom)), F.lit(0.0))
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _cover(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    hit = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        hit &= c.holds(x)
    return hit


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, max_conditions: int, grid: int) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < max_conditions and inside.any() and not bad[inside].all():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        base, best, pick = np.log2(max(p0, 1e-9) / (p0 + n0)), 1e-9, None
        for feature, values in x.items():
            own = values[inside]
            cuts = np.unique(np.quantile(own, np.linspace(0, 1, grid + 1)[1:-1]))
            unique = np.unique(own)
            nearest = np.minimum(np.searchsorted(unique, cuts, side="right"), len(unique) - 1)
            for cut in np.unique((cuts + unique[nearest]) / 2):
                for above in (True, False):
                    hit = own > cut if above else own <= cut
                    p, n = bad[inside][hit].sum(), (~bad[inside][hit]).sum()
                    if p and (gain := p * (np.log2(p / (p + n)) - base)) > best:
                        best, pick = gain, Condition(feature, above, float(cut))
        if pick is None:
            break
        rule.append(pick)
        inside &= pick.holds(x)
    return tuple(rule)


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    hit = _cover(rule, x)
    return (bad[hit].sum() - (~bad[hit]).sum()) / max(1, hit.sum())


def learn_rules(
    x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 12, max_conditions: int = 3, min_precision: float = 0.9, grid: int = 64
) -> list[Rule]:
    """The ordered rules that reject; what none of them covers is kept."""
    rules: list[Rule] = []
    prune = np.arange(len(bad)) % 3 == 2
    while len(rules) < max_rules and bad[~prune].sum() >= 5:
        grow_x, prune_x = ({k: v[m] for k, v in x.items()} for m in (~prune, prune))
        rule = _grow(grow_x, bad[~prune], max_conditions, grid)
        while len(rule) > 1 and _worth(rule[:-1], prune_x, bad[prune]) >= _worth(rule, prune_x, bad[prune]):
            rule = rule[:-1]
        hit = _cover(rule, x)
        if not rule or hit.sum() < 5 or any(
            (h := _cover(rule, px)).sum() == 0 or pb[h].mean() < min_precision for px, pb in ((grow_x, bad[~prune]), (prune_x, bad[prune]))
        ):
            break
        rules.append(rule)
        x, bad, prune = {k: v[~hit] for k, v in x.items()}, bad[~hit], prune[~hit]
    return rules


def learn(stats: DataFrame, labels: DataFrame, max_rows: int = 20000, min_precision: float = 0.9) -> list[Rule]:
    """Fit on at most ``max_rows`` labelled rows that pass the base rules."""
    named = labels.where("quality is not null and doc_id is not null").select("doc_id", "quality")
    named = named.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)
    # max_rows rows bound what is broadcast
    rows = (
        stats.where(~base_failed())
        .join(F.broadcast(named), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", *STATS)
        .limit(max_rows)
        .select("doc_id", "quality", *STATS)
        .toPandas()
    )
    if rows.empty or rows["quality"].nunique() < 2:
        return []
    x = {}
    for name, (top, bottom) in FEATURES.items():
        below = rows[bottom].to_numpy(float)
        x[name] = np.divide(rows[top].to_numpy(float), below, out=np.zeros(len(rows)), where=below > 0)
    return learn_rules(x, rows["quality"].to_numpy() == 0, min_precision=min_precision)


def verdict(rules: list[Rule]) -> Column:
    """Whether a row with statistics is kept: base rules first, then the list in its order."""
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        hit = rule[0].column()
        for c in rule[1:]:
            hit = hit & c.column()
        out = out.when(hit, F.lit(False))
    return out.otherwise(F.lit(True))
