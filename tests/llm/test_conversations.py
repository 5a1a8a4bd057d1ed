import hashlib
import random
import zlib

import pytest

from nichegrid.llm import conversations

SPACES = " \t\n\x0b\x0c\r"
FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired) by looking at every repair from the back; rows are (role, text, fault)."""
    turn = {"0": "u", "s": "u", "a": "u", "u": "a"}
    names = {"u": "user", "a": "assistant"}
    none = (10**9, "", ())

    def inserted(best):
        for _ in range(4):
            best = {
                q: min(v, (best[turn[q]][0] + 5, "I" + best[turn[q]][1], (names[turn[q]] + ":", *best[turn[q]][2])))
                for q, v in best.items()
            }
        return best

    best = inserted({"0": (0, "", ()), "s": none, "u": none, "a": (0, "", ())})
    for role, text, fault in reversed(rows):
        new = {}
        for q in best:
            ways = [(best[q][0] + 2, "D" + best[q][1], best[q][2])]
            if fault not in ("blank", "duplicate"):
                extra, then = 5 * (fault == "cut"), best[turn[q]]
                ways.append((then[0] + 1 + extra, "R" + then[1], (f"{names[turn[q]]}:{text}", *then[2])))
                to = role[:1]
                if to == turn[q] or (to == "s" and q == "0"):
                    ways.append((best[to][0] + extra, "K" + best[to][1], (f"{role}:{text}", *best[to][2])))
            new[q] = min(ways)
        best = inserted(new)
    return best["0"]


def brute(rows, order):
    out = {conv: [] for conv, *_ in rows}
    for row in damage(rows):
        out[row[0]].append(row[1:])
    for conv, own in out.items():
        own.sort(key=order)
        seen, faults = set(), []
        for _, role, text in own:
            body = text.strip(SPACES)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "fine" if body[-1] in ".!?" else "cut"
            seen.add((role, text))
            faults.append(fault)
        turns = {t for t, _, _ in own if t is not None}
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, text = cheapest([(r, t, f) for (_, r, t), f in zip(own, faults, strict=True)])
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            faults.count("blank"), faults.count("duplicate"), faults.count("cut"), illegal,
            cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest(),
        )
    return out


def sample():
    rng = random.Random(12)
    texts = ["Fine.", "Ok!", "Why?", "Cut off", "", " \t", "Fine.", None, "énd.", "a b. ", "Long " * 400 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "tool", "", "User"]
    rows = []
    for conv in [*range(60), None, 1 << 60]:
        for turn in range(rng.randint(1, 12)):
            if rng.random() < 0.9:
                role = rng.choice(roles) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
                rows.append((conv, turn * rng.choice((1, 1, 2)), role, rng.choice(texts) if rng.random() < 0.4 else f"t{turn}."))
    for turn in range(400):  # one conversation with most rows
        rows.append((777, turn if turn > 3 else None, rng.choice(roles), rng.choice(texts)))
    return rows


@pytest.fixture
def many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("block", [3, 1024])
def test_equals_brute_force(spark, many_tasks, block):
    # ties of a turn are ordered by role and the text's hash, which the brute-force version takes from Spark
    rows = sample()
    schema = "conv_id long, turn long, role string, text string, codes string, part int, key int"
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], schema).repartition(5)
    faulty = spark.createDataFrame([(t,) for t in {t for *_, t in damage(rows)}], "text string")
    hashes = {r.text: r.h for r in faulty.selectExpr("text", "xxhash64(text) as h").collect()}
    expected = brute(rows, lambda r: (r[0] is not None, r[0] or 0, r[1], hashes[r[2]]))
    got = conversations.repair(conversations.damaged(df), block).collect()
    assert {r.conv_id: tuple(r[f] for f in FIELDS) for r in got} == expected
    assert len(got) == len(expected)


def test_lattices_of_any_length_agree(monkeypatch):
    rng = random.Random(3)
    names = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}
    for span in (1, 3, 32):
        monkeypatch.setattr(conversations, "SPAN", span)
        for _ in range(300):
            codes = "".join(rng.choice("suaoxSUAOuaua") for _ in range(rng.randint(0, 12)))
            rows = [(names[c.lower()], "", "blank" if c == "x" else "cut" if c.isupper() else "fine") for c in codes]
            assert conversations.traced(codes, conversations.FINAL, conversations.START)[:2] == cheapest(rows)[:2]


def test_costs_between_states_add_up():
    rng = random.Random(5)
    for _ in range(50):
        codes = "".join(rng.choice("suaoxSUAOuaua") for _ in range(40))
        cut = rng.randint(0, 40)
        whole, head, tail = map(conversations.crossing, (codes, codes[:cut], codes[cut:]))
        for a in range(4):
            for b in range(4):
                through = min(min(head[4 * a + c] + tail[4 * c + b] for c in range(4)), conversations.NEVER)
                assert whole[4 * a + b] == through


def test_empty_table_and_dropped_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversations.judge(spark.createDataFrame([], schema)).isEmpty()
    gone = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    (row,) = conversations.judge(spark.createDataFrame([(gone, 0, "user", "x")], schema)).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
