"""Conversation repair against a search over all edits, on small tables and on one long conversation."""

import hashlib
import random
import re
import zlib

import pytest

from wavespark.llm import conversations as V
from wavespark.llm.queries import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
FULL = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = {}
    for c, t, r, x in rows:
        own = out.setdefault(c, [])
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        own += [(t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(rows, faults):
    """(cost, audit) by the least pair over every state and row, inserted rows to a fixed point."""

    def closed(best):
        changed = True
        while changed:
            changed = False
            for q in NEXT:
                for to in (NEXT[q][i] for i in "ua" if i in NEXT[q]):
                    found = best[to] and (best[to][0] + 2, "I" + best[to][1])
                    if found and (best[q] is None or found < best[q]):
                        best[q], changed = found, True
        return best

    best = closed({"": (0, ""), "s": None, "u": None, "a": (0, "")})
    for (_, role, _), fault in zip(rows[::-1], faults[::-1], strict=True):
        before = {}
        for q in NEXT:
            options = [(3, "D", best[q])]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                options += [(more, "K", best[NEXT[q][role[:1]]])] if role[:1] in NEXT[q] else []
                options += [(2 + more, "R", best[NEXT[q][i]]) for i in "ua" if i in NEXT[q]]
            before[q] = min(((c + b[0], letter + b[1]) for c, letter, b in options if b), default=None)
        best = closed(before)
    return best[""]


def expected(rows):
    out = {}
    for c, own in damaged(rows).items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        turns = {t for t, _, _ in own if t is not None}
        seen, faults = set(), []
        for _, r, x in own:
            end = x.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not end else "duplicate" if (r, x) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((r, x))
        cost, audit = cheapest(own, faults)
        lines, state, left = [], "", iter(own)
        for letter in audit:
            to = next(i for i in "ua" if i in NEXT[state])
            if letter == "I":
                lines.append(FULL[to] + ":")
            else:
                _, r, x = next(left)
                if letter == "D":
                    continue
                to = r[:1] if letter == "K" else to
                lines.append((r if letter == "K" else FULL[to]) + ":" + x)
            state = NEXT[state][to]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[c] = (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/conversations.parquet")
    out = QUERIES["op11_conversations"](spark, str(folder)).collect()
    assert len({r.conv_id for r in out}) == len(out)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in out}


def random_rows(rng, convs, longest):
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(longest)):
            turn = rng.choice([t, t, t, t + rng.randrange(5), None])
            rows.append((c, turn, rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None, "assist"]), rng.choice(["Yes.", "No", "", " \t", None, "Why?", "Well! ", f"Line {t}.", "é…", "a.b"])))
    return rows


def test_repairs_equal_a_search_over_all_edits(spark, tmp_path):
    rows = random_rows(random.Random(3), 150, 14) + [(None, 0, "user", "Hm."), (None, 1, "assistant", "Yes.")]
    assert made(spark, tmp_path, rows) == expected(rows)


def test_a_conversation_over_many_ranges_is_the_same(spark, tmp_path):
    """One conversation has most rows and is cut into segments, that one may begin in each state; a third of them is one row."""
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "No", "", f"{t}!"])) for t in range(4000)]
    rows += [(7, 9, "user", "Again.")] * 2000 + [(8, 0, "user", "Hi."), (8, 1, "assistant", "Hi.")]
    assert made(spark, tmp_path, rows) == expected(rows)
    long = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t} " + "x" * 30_000 + ".") for t in range(90)]  # blocks of several segments
    assert made(spark, tmp_path, long) == expected(long)


def test_empty_tables_clashing_columns_and_lost_rows(spark, tmp_path):
    assert made(spark, tmp_path, []) == {}
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(lost, 0, "user", "Hi.")]
    assert made(spark, tmp_path, rows) == {lost: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    clash = "conv_id bigint, turn bigint, role string, text string, at bigint, range int, first string, audit string, kind int, copy int, salt int"
    rows = random_rows(random.Random(4), 20, 8)
    assert made(spark, tmp_path, [(*r, 1, 2, "x", "y", 3, 4, 5) for r in rows], clash) == expected(rows)


@pytest.mark.parametrize("symbol", range(12))
def test_binary_powers_equal_single_rows(symbol):
    behind = (0, 4, 2, 0)
    for count in (1, 2, 3, 7, 20, 33):
        one = behind
        for _ in range(count):
            one = V.advance(symbol, 1, one)
        assert V.advance(symbol, count, behind) == one
