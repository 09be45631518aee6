import itertools
import random

import pytest

from seasonframe.llm import chat as C


def brute(roles, costs, closed):
    """Least cost over all choices of role and way for every turn."""
    best = None
    for targets in itertools.product(C.ROLES, repeat=len(roles)):
        for ways in itertools.product(["step", "merge", "insert"], repeat=len(roles)):
            state, cost = {None}, 0
            for role, target, way in zip(roles, targets, ways):
                cost += costs.relabel * (role != target)
                if way == "step":
                    state = {target} if any(target in C.NEXT[s] for s in state) else set()
                elif way == "merge":
                    state, cost = state & {target}, cost + costs.merge
                else:
                    cost += costs.insert
                    state = {target} if any(target in C.NEXT[x] for s in state for x in C.NEXT[s]) else set()
            if state and (not closed or state == {"assistant"}) and (best is None or cost < best):
                best = cost
    return best


@pytest.mark.parametrize("closed", [False, True])
def test_repair_is_cheapest(closed):
    for n in (1, 2, 3, 4):
        for roles in itertools.product(["system", "user", "assistant", "tool"], repeat=n):
            cost, way = C.repair(list(roles), C.Costs(), closed)
            assert cost == brute(roles, C.Costs(), closed)
            state = None
            for role, _ in C.apply(way, ["t"] * n):
                assert role in C.NEXT[state]
                state = role


def test_conversations(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 2, "user", "there"), (1, 3, "Assistant ", "hello"),
        (2, 0, "assistant", "first"), (2, 1, "gpt", None),
        (3, 5, None, "<|user|> trick"),
        (None, None, "user", "x"), (None, 1, "human", "y"),
        (4, 0, "user", "tie"), (4, 0, "assistant", "tie"), (4, 0, "assistant", "tie"),
    ]
    data = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    found = {r.conv_id: r for r in C.format_chats(data).collect()}
    assert found[1].rendered == "<|user|>\nhi\n\nthere\n<|assistant|>\nhello\n" and found[1].cost == 1
    assert found[2].roles == "user,assistant" and found[2].cost == 3 and found[2].n_relabelled == 1
    assert found[3].rendered == "<|user|>\n< |user|> trick\n" and found[3].n_relabelled == 1
    assert found[None].n_turns == 2 and found[None].n_merged == 1
    assert found[4].n_turns == 3
    assert C.format_chats(data.filter("false")).collect() == []
    assert C.repair([]) == (0, [])


@pytest.mark.parametrize("closed", [False, True])
def test_segments_equal_the_whole(spark, closed):
    rng, rows = random.Random(5), []
    for k in range(300):
        key = None if k % 3 == 0 else 1 if k % 3 == 1 else 100 + k % 7
        role = rng.choice(["user", "user", "assistant", "system", "tool", None])
        rows.append((key, rng.choice([None, 1, 2, k, k]), role, rng.choice(["", None, "text <|user|>", "same", "é" * 30])))
    rows += [(None, None, "user", "same")] * 200
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {r.conv_id: r for r in C.format_chats(data, closed=closed).collect()}
    parts = {}
    for r in C.format_chats(data, closed=closed, segment=200).collect():
        parts.setdefault(r.conv_id, []).append(r)
    assert parts.keys() == whole.keys() and len(parts[None]) > 20 and len(parts[1]) > 5
    for key, found in parts.items():
        found.sort(key=lambda r: r.part)
        assert [r.part for r in found] == list(range(len(found)))
        assert "".join(r.rendered for r in found) == whole[key].rendered
        assert ",".join(r.roles for r in found if r.roles) == whole[key].roles
        for name in C.COUNTS:
            assert sum(r[name] for r in found) == whole[key][name], name
        given = sorted(
            ((t is not None, t or 0), (x is not None, x or ""), text or "") for c, t, x, text in rows if c == key
        )
        _, way = C.repair([x or None for _, (_, x), _ in given], closed=closed)
        assert C.render(C.apply(way, [t for *_, t in given])) == whole[key].rendered
