"""Conversation repair against all edits of short conversations, and long ones against short segments."""

import hashlib
import random
import re
import zlib

import pytest

from cuelight.llm import conversation_repair as cr

ROLES = ["system", "user", "assistant", "tool", "", " ", "System"]
TEXTS = ["a.", "b!", "no end", "", " \t", "a.", "x?\n", "é", "c. "]


def brute(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of (turn, role, text) rows, with every audit tried."""
    rows = sorted(((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, r, x in rows:
        held = re.sub(r"[\x20\x09-\x0D]+", "", x)
        faults.append("blank" if not held else "duplicate" if (r, x) in seen else "" if held[-1] in ".!?" else "truncated")
        seen.add((r, x))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    best = None

    def go(i, cost, audit, said):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        initials = "".join(r[:1] or "?" for r, _ in said)
        if not re.fullmatch("s?(ua)*u?", initials):
            return
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, "\n".join(f"{r}:{x}" for r, x in said)
        if not audit.endswith("II"):
            for r in ("user", "assistant"):
                go(i, cost + 5, audit + "I", [*said, (r, "")])
        if i == len(rows):
            return
        go(i + 1, cost + 2, audit + "D", said)
        if faults[i] not in ("blank", "duplicate"):
            stays = 5 * (faults[i] == "truncated")
            go(i + 1, cost + stays, audit + "K", [*said, rows[i][1:]])
            for r in ("user", "assistant"):
                go(i + 1, cost + 1 + stays, audit + "R", [*said, (r, rows[i][2])])

    go(0, 0, "", [])
    count = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
    return gaps, *count, sum(p not in ("su", "ua", "au") for p in pairs), best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest()


def sample(n=120, seed=5):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        usual = rng.random() < 0.6
        for i in range(rng.randint(1, 6)):
            role = ("user", "assistant")[i % 2] if usual and rng.random() < 0.8 else rng.choice([*ROLES, None])
            rows.append((conv, rng.choice([i, i, i, i + 5, None]), role, f"{i}." if usual and rng.random() < 0.7 else rng.choice([*TEXTS, None])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z", True) for r in rows], "conv_id long, turn long, role string, text string, cost string, none boolean")


def by_conversation(rows):
    held = {}
    for c, *row in rows:
        held.setdefault(c, []).append(tuple(row))
    return held


def check(got, rows, originals=()):
    want = {c: brute(own) for c, own in by_conversation(rows).items()}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want |= {c: empty for c in originals if c not in want}
    assert {r[0]: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_repair_is_the_cheapest_of_all_edits(spark):
    rows = sample()
    check(cr.repair(frame(spark, rows)).collect(), rows)


@pytest.mark.parametrize("segment,hot", [(1, False), (3, True)])
def test_segments_make_no_difference(spark, monkeypatch, segment, hot):
    rows = sample(60, seed=6)
    monkeypatch.setattr(cr, "SEGMENT", segment)
    if hot:  # as if one conversation were too long for a task
        monkeypatch.setattr(cr, "has_hot_group", lambda *_: True)
    check(cr.repair(frame(spark, rows)).collect(), rows)


def test_long_conversation(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(1, i // 2, rng.choice(["user", "assistant", "user", "assistant", "system"]), f"{rng.randrange(700)}{rng.choice(['.', '.', ''])}") for i in range(3000)]
    whole = cr.repair(frame(spark, rows)).collect()
    monkeypatch.setattr(cr, "SEGMENT", 100_000)
    assert whole == cr.repair(frame(spark, rows)).collect()
    monkeypatch.setattr(cr, "SEGMENT", 50)
    said = cr.repaired_rows(frame(spark, rows)).orderBy("segment", "place").collect()
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in said).encode()).hexdigest() == whole[0].repaired_sha256
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in said))


def test_damage_and_originals(spark):
    rows = sample(40, seed=7) + [(c, t, "user", f"{t}. Yes!") for c in range(500, 580) for t in range(1)]
    damaged = []
    for c, t, r, x in rows:
        lot = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        damaged += [(c, t, "user" if lot == 4 else r, "" if lot == 1 else re.sub("[.!?]", "", x) if lot == 2 else x)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    source = frame(spark, rows)
    assert sorted(map(tuple, cr.damage(source).collect()), key=str) == sorted(damaged, key=str)
    assert len(by_conversation(damaged)) < len(by_conversation(rows))
    check(cr.repair(cr.damage(source), source).collect(), damaged, {c for c, *_ in rows})


def test_empty_tables_and_wide_turns(spark):
    none = cr.repair(frame(spark, []))
    assert none.count() == 0 and none.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert cr.repaired_rows(frame(spark, [])).count() == 0
    wide = cr.repair(frame(spark, [(1, -(1 << 63), "user", "a."), (1, (1 << 63) - 1, "assistant", "b.")])).collect()
    assert wide[0].gaps is None and wide[0].audit == "KK"
    long = "word " * 400_000
    assert cr.repair(frame(spark, [(1, 1, "user", long + "."), (1, 2, "assistant", long)])).collect()[0].cost == 4


def test_the_parser_knows_the_language():
    for text in ("", "ua", "sua", "uaua", "suaua"):
        alive = {0: (0, "")}
        for token in text:
            alive = {t: (0, "") for s in alive for t in cr.PARSER.moves[s][token]}
        assert [s for s in alive if cr.PARSER.accepts[s]]
    for text in ("s", "u", "a", "ss", "uu", "au", "uas", "su"):
        alive = {0: (0, "")}
        for token in text:
            alive = {t: (0, "") for s in alive for t in cr.PARSER.moves[s][token]}
        assert not [s for s in alive if cr.PARSER.accepts[s]]
