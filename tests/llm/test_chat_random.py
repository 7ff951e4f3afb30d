"""Operator 9 on made conversations against a linker and sorter written plainly, and texts that must not be lost."""

import json
import random
from collections import Counter

from barlace.llm import chat_format

COLUMNS = "conv_id long, turn long, role string, text string"


def made(rng, conv, n):
    """Calls, results and plain messages in any order, with repeated and unknown ids and references both ways."""
    ids, rows = [f"i{k}" for k in range(n)], []
    for turn in range(n):
        kind = rng.random()
        if kind < 0.45:
            calls = []
            for _ in range(rng.randint(1, 2)):
                arguments = {"query": {"$ref": rng.choice(ids)} if rng.random() < 0.6 else "q"}
                name = {"id": rng.choice(ids), "name": "search", "arguments": arguments}
                nested = {"id": name["id"], "function": {"name": "search", "arguments": json.dumps(arguments)}}
                calls.append(nested if rng.random() < 0.3 else name)
            rows.append((conv, turn, "assistant", json.dumps({"content": f"c{turn}", "tool_calls": calls})))
        elif kind < 0.85:
            rows.append((conv, turn, "tool", json.dumps({"tool_call_id": rng.choice(ids), "content": f"r{turn}"})))
        else:
            rows.append((conv, turn, rng.choice(["user", "assistant"]), rng.choice(["plain", '{"answer": 42}', "{ int x; } is C"])))
    return rows


def plain_order(rows):
    """{turn: (order_turn, order_level)} and {turn: link} of one conversation."""
    calls, results, refs = {}, {}, {}
    owner, answers = {}, {}
    for _, turn, role, text in rows:
        try:
            held = json.loads(text)
        except ValueError:
            continue
        if role == "assistant" and isinstance(held.get("tool_calls"), list):
            for pos, c in enumerate(held["tool_calls"]):
                given = json.loads(c["function"]["arguments"]) if "function" in c else c["arguments"]
                owner.setdefault(c["id"], (turn, pos))
                if isinstance(given["query"], dict):
                    refs.setdefault(turn, []).append(given["query"]["$ref"])
            calls[turn] = held["tool_calls"]
        elif role == "tool" and "tool_call_id" in held:
            results[turn] = held["tool_call_id"]
            answers.setdefault(held["tool_call_id"], turn)
    before = {t: set() for t in [*calls, *results]}
    for turn, i in results.items():
        if i in owner:
            before[turn].add(owner[i][0])
    for turn, named in refs.items():
        for i in named:
            if i in owner:
                before[turn].add(answers.get(i, owner[i][0]))
    done, left = {}, set(before)
    while ready := {t for t in left if all(p in done for p in before[t])}:
        for t in ready:
            done[t] = (max([t, *(done[p][0] for p in before[t])]), max([0, *(done[p][1] + 1 for p in before[t])]))
        left -= ready
    done |= {t: (t, -1) for t in left}
    links = {t: "orphan" if i not in owner else "linked" if answers[i] == t else "extra" for t, i in results.items()}
    return done, links


def test_random_conversations_equal_plain_linking(spark):
    rng = random.Random(5)
    every = {conv: made(rng, conv, rng.choice([4, 10, 25])) for conv in range(60)}
    table = spark.createDataFrame([r for rows in every.values() for r in rows], COLUMNS)
    got = {(r.conv_id, r.turn): r for r in chat_format.format_chats(table).collect()}
    levels = Counter()
    for conv, rows in every.items():
        order, links = plain_order(rows)
        for _, turn, _, _ in rows:
            r = got[conv, turn]
            assert (r.order_turn, r.order_level) == order.get(turn, (turn, 0)), (conv, turn)
            assert r.link == links.get(turn)
            levels[r.order_level] += 1
    assert levels[-1] and max(levels) >= 4


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    n, kept = 300, []
    rows = []
    for k in range(n):
        given = {"query": {"$ref": f"i{k - 1}"}} if k else {"query": "q"}
        rows.append((1, 2 * k, "assistant", json.dumps({"tool_calls": [{"id": f"i{k}", "name": "search", "arguments": given}]})))
        rows.append((1, 2 * k + 1, "tool", json.dumps({"tool_call_id": f"i{k}", "content": "r"})))
    keep = chat_format.Scratch.keep
    monkeypatch.setattr(chat_format.Scratch, "keep", lambda self, df, name, *rest: kept.append(name) or keep(self, df, name, *rest))
    got = {r.turn: r.order_level for r in chat_format.format_chats(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {k: k for k in range(2 * n)}
    assert len(kept) < 30


def test_no_text_is_lost(spark):
    long = "word " * 400_000
    texts = ['{"answer": 42}', "{ int x; } is C code", '{"tool_calls": "none"}', '{"content": "kept whole"}', "{broken", "", long]
    rows = [(1, k, role, t) for role in ("assistant", "tool", "user", None) for k, t in enumerate(texts)]
    rows += [(1, 90, "tool", '{"tool_call_id": "x", "content": {"deep": [1]}, "status": "ok"}')]
    got = chat_format.format_chats(spark.createDataFrame(rows, COLUMNS)).collect()
    found = Counter((json.loads(r.json).get("content"), r.role) for r in got if r.turn < 90)
    assert found == Counter((t, role) for _, _, role, t in rows[:-1])
    last = json.loads(next(r.json for r in got if r.turn == 90))
    assert json.loads(last["content"]) == {"deep": [1]} and last["extra"] == {"status": "ok"}
