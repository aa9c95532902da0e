"""Conversation repair against trying all edits, and the query against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest

from quire.llm import queries, repair

WHITE = " \t\n\x0b\f\r"


def brute(turns):
    """(cost, audit) of the cheapest edits of (initial, fault) turns, by trying each edit at each place."""
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, last, inserted):
        ways = [(0, "")] if i == len(turns) and last in ("", "a") else []
        new = "a" if last == "u" else "u"
        if inserted < 2:
            c, x = best(i, new, inserted + 1)
            ways.append((3 + c, "I" + x))
        if i < len(turns):
            initial, fault = turns[i]
            c, x = best(i + 1, last, 0)
            ways.append((4 + c, "D" + x))
            if fault in ("fine", "truncated"):
                more = 3 * (fault == "truncated")
                if initial in legal[last]:
                    c, x = best(i + 1, initial, 0)
                    ways.append((more + c, "K" + x))
                c, x = best(i + 1, new, 0)
                ways.append((3 + more + c, "R" + x))
        return min(ways, default=(10**6, ""))

    return best(0, "", 0)


def by_tables(turns):
    digits = [repair.DELETED if f in ("blank", "duplicate") else 2 * repair.INITIALS.index(i) + (f == "truncated") for i, f in turns]
    return repair.tables().cheapest(repair.np.array(digits, dtype=repair.np.int64))


def test_every_short_conversation():
    kinds = [(i, f) for i in "sua?" for f in ("fine", "truncated")] + [("u", "blank")]
    for n in range(4):
        for turns in itertools.product(kinds, repeat=n):
            assert by_tables(turns) == brute(turns), turns


def test_random_conversations():
    r = random.Random(1)
    for _ in range(3000):
        turns = tuple((r.choice("suuuaaa?"), r.choice(["fine", "fine", "truncated", "blank", "duplicate"])) for _ in range(r.randint(4, 30)))
        assert by_tables(turns) == brute(turns), turns
    assert len(repair.tables().vectors) < 200


def want(rows):
    """The query's rows from (conv, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        if k:
            kept.extend([(turn, "user" if k == 4 else role, text)] * (1 + (k == 3)))
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        seen, faults, numbers = set(), [], {t[0] for t in turns} - {None}
        for _, role, text in turns:
            bare = text.rstrip(WHITE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "fine" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        initials = [r[:1] if r[:1] in ("s", "u", "a") else "?" for _, r, _ in turns]
        cost, audit = brute(tuple(zip(initials, faults)))
        out, left, last = [], iter(turns), ""
        for edit in audit:
            new = "assistant" if last == "u" else "user"
            role, text = (new, "") if edit == "I" else next(left)[1:]
            if edit != "D":
                role = role if edit == "K" else new
                out.append(f"{role}:{text}")
                last = role[0]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in out))
        yield (
            conv, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(),
        )


def plain(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("bits", [2, 12])
def test_query(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(repair, "CHUNK_BITS", bits)
    r = random.Random(bits)
    texts = ["Fine.", "Fine. ", "cut off", "", " \n", None, "Why?!\t", "é . x", "long " * 3000 + "end.", "a\x00.", " ", "Same."]
    roles = ["user", "assistant", "user", "assistant", "system", "unknown", "", None, "Ärger", "s\n"]
    rows = []
    for conv in [*range(40), None]:
        for turn in sorted(r.sample(range(30), r.randint(0, 9))):
            rows.append((conv, turn if r.random() < 0.9 else None, r.choice(roles), r.choice(texts)))
    rows += rows[3:9] + [(77, k, ["user", "assistant"][k % 2], f"turn {k}.") for k in range(300)] + [(78, None, None, None)] * 2 + [(79, -5, "user", "x")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, conv int").repartition(5)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op11_conversation_repair(spark, str(tmp_path)).collect()
    assert plain(got) == plain(want(rows))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op11_conversation_repair(spark, str(tmp_path)).collect() == []
