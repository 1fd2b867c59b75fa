"""Conversation repair against a plain search over all edits, with damage, chunks and odd rows."""

import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import product

from quire.llm import queries, turns

SCHEMA = "conv_id long, turn long, role string, text string"
WORD, LAST = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)")


def damage(rows):
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        for _ in range({0: 0, 3: 2}.get(kind, 1)):
            yield conv, turn, role, text


def cheapest(rows):
    """(cost, audit, repaired) by trying every edit at every place; rows are (role, text, fault)."""
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def rest(i, state, inserted):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserted < 3:
            for role in ("user", "assistant"):
                if (state, role[0]) in follow:
                    cost, audit, made = rest(i, follow[state, role[0]], inserted + 1)
                    found.append((cost + 2, "I" + audit, (f"{role}:", *made)))
        if i < len(rows):
            role, text, fault = rows[i]
            cost, audit, made = rest(i + 1, state, 0)
            found.append((cost + 3, "D" + audit, made))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                for edit, new, price in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if (state, new[:1]) in follow:
                        cost, audit, made = rest(i + 1, follow[state, new[:1]], 0)
                        found.append((cost + price + more, edit + audit, (f"{new}:{text}", *made)))
        return min(found) if found else (10**9, "", ())

    return rest(0, "", 0)


def plain(table, hurt=True):
    rows = list(damage(table)) if hurt else [(c, t, r or " ", x or " ") for c, t, r, x in table]
    for conv in {r[0] for r in table}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            last = LAST.search(text)
            faults.append("blank" if not WORD.search(text) else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
            seen.add((role, text))
        numbers = [t for t, *_ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, made = cheapest(tuple((r, x, f) for (_, r, x), f in zip(own, faults)))
        yield (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())


def table(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(rng.randint(1, most)):
            if rng.random() < 0.9:
                role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
                text = rng.choice(["Yes.", "Yes.", "No", "É?\n", "a! b　", " \t", "", None, "Why? ", "x." * 20 + str(rng.randint(0, 3))])
                rows.append((conv, turn, role, text))
    return rows


ODD = [(None, None, None, None), (None, None, "user", "b."), (None, 1, "user", "b."), (-5, None, "user", "x"), (-5, 2, "system", "a."), (-5, 2, "system", "a."),
       (-5, 2, "assistant", "a."), (-5, 9, "user", "x"), (-6, 3, "s", " \x0b\x1c"), (-6, 4, "assistant", "🙂.")]


def test_against_brute_force(spark):
    rows = table(1, 150, 12) + ODD
    want = sorted(plain(rows), key=str)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for size in (turns.CHUNK, 3, 1):
        got = turns.repair(turns.damaged(df), df.select("conv_id").distinct(), size).collect()
        assert sorted(map(tuple, got), key=str) == want
    assert {c for r in want for c in r[7]} == set("DIKR") and any(r[1] for r in want) and any(r[3] for r in want)


def test_every_short_conversation():
    """All codes of up to four rows, in one and in several chunks."""
    names = ("user", "assistant", "system", "tool")
    kinds = [(i, f, c) for i in range(4) for f, c in (("", 0), ("truncated", turns.TRUNCATED), ("blank", turns.BLANK))]
    for n in (1, 2, 3):
        for found in product(kinds, repeat=n):
            codes = bytes(i + c for i, _, c in found)
            want = cheapest(tuple((names[i], "", f) for i, f, _ in found))
            layers = turns.Layers(codes)
            audit, state = layers.trace(0)
            assert (layers.cost(0), audit + "I" * (turns.END[state] // 2)) == want[:2]


def test_long_conversation(spark):
    rng = random.Random(4)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"turn {t}" + rng.choice([".", ""])) for t in range(20000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    one, many = (turns.repair(df, size=n).collect()[0] for n in (30000, 500))
    assert one == many and len(one["audit"]) >= 20000


def test_hot_duplicate(spark):
    df = spark.range(30000).selectExpr("1L as conv_id", "id div 3 as turn", "'user' as role", "'Same.' as text")
    row = turns.repair(df).collect()[0]
    assert (row["duplicate"], row["cost"], row["audit"]) == (29999, 3 * 29999 + 2, "K" + "D" * 29999 + "I")


def test_query(spark, tmp_path):
    rows = table(3, 40, 8)
    clash = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", seq int, code string")
    clash.write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_cost_layers(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain(rows), key=str)
    clash.where("conv_id < 0").write.parquet(f"{tmp_path}/empty/conversations.parquet")
    empty = queries.op13_cost_layers(spark, f"{tmp_path}/empty")
    assert empty.count() == 0 and empty.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
