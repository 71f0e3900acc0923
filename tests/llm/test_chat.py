import json

from denovospark.llm import chat


def rows(spark, calls, results, tools):
    got = chat.link_calls(spark.createDataFrame(calls, chat.CALLS), spark.createDataFrame(results, chat.RESULTS), spark.createDataFrame(tools, chat.TOOLS))
    return got.orderBy("conv_id", "depth", "step", "part", "turn").collect()


TOOLS = [("add", "x", "integer", True), ("add", "y", "number", False), ("say", "text", "string", True), ("now", None, None, None)]


def test_links_order_and_checks(spark):
    calls = [
        (1, 5, "c", "add", {"y": "2.5", "x": "1"}, ["b"]), (1, 6, "b", "say", {"text": 'a "q"\\\n\x01é'}, ["a", "elsewhere"]), (1, 7, "a", "now", None, None),
        (1, 8, "p", "add", {"x": "one"}, []), (1, 9, "q", "add", {"y": "1"}, []), (1, 10, "r", "add", {"x": "1", "z": "1"}, []), (1, 11, "s", "nothing", {}, []),
        (1, 12, "u", "now", {}, ["v"]), (1, 13, "v", "now", {}, ["u"]), (1, 14, "a", "now", {}, []), (2, 1, None, "now", {}, []), (None, 1, "a", "now", {}, []),
    ]
    results = [(1, 20, "a", "late"), (1, 21, "c", None), (1, 22, "none", "x"), (2, 2, None, "y"), (1, 23, "a", "again")]
    got = rows(spark, calls, results, TOOLS)
    assert len(got) == len(calls) + len(results)
    status = {(r.conv_id, r.part, r.turn): r.status for r in got}
    assert [status[1, 0, t] for t in range(5, 15)] == ["ok", "no result", "ok", "ill-typed argument", "missing argument", "unexpected argument", "unknown tool", "cycle", "cycle", "repeated"]
    assert status[1, 1, 20] == status[1, 1, 21] == status[1, 1, 23] == "ok" and status[1, 1, 22] == status[2, 1, 2] == "orphan"
    linked = [r.turn for r in got if r.conv_id == 1 and r.call_id in "abc"]
    assert linked.index(7) < linked.index(20) < linked.index(6) < linked.index(5) < linked.index(21)
    said = {r.turn: r.json for r in got if r.conv_id == 1}
    assert said[5] == '{"arguments":{"x":1,"y":2.5},"id":"c","name":"add","role":"assistant"}'
    assert json.loads(said[6])["arguments"] == {"text": 'a "q"\\\n\x01é'} and "\\u0001" in said[6] and "é" in said[6]
    assert all(json.dumps(json.loads(j), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == j for j in said.values())


def test_turns(spark):
    table = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", None), (2, 0, "assistant", "x"), (3, 0, None, None)], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.step, r.part, r.status) for r in chat.link_calls(*chat.turns_as_calls(table)).collect()}
    more = [(4, 1, "user", "no 7"), (4, 2, "assistant", "x"), (4, 3, "user", "on 1/2"), (4, 5, "user", "007"), (4, 9, "user", "12")]
    deep = {r.turn: (r.depth, r.status) for r in chat.link_calls(*chat.turns_as_calls(spark.createDataFrame(more, table.schema))).collect()}
    assert deep == {1: (0, "ok"), 2: (0, "ok"), 3: (1, "ill-typed argument"), 5: (2, "ill-typed argument"), 9: (0, "no result")}
    assert got == {(1, 0): (0, 0, "no result"), (1, 1): (1, 0, "ok"), (1, 2): (1, 1, "ok"), (2, 0): (0, 1, "orphan"), (3, 0): (0, 0, "unknown tool")}


def test_long_chain(spark):
    n = 70
    calls = [(1, n - k, f"c{k}", "now", {}, [f"c{k - 1}", f"c{k // 2}"] if k else []) for k in range(n)] + [(1, 200, "u", "now", {}, ["v", "c3"]), (1, 201, "v", "now", {}, ["u"])]
    got = {r.call_id: (r.depth, r.status) for r in rows(spark, calls, [], TOOLS)}
    assert [got[f"c{k}"] for k in range(n)] == [(k, "no result") for k in range(n)]
    assert got["u"] == got["v"] == (0, "cycle")


def test_a_chain_of_10000_calls_in_few_rounds(spark, monkeypatch):
    made, real = [], chat.materialize
    monkeypatch.setattr(chat, "materialize", lambda t, name: (made.append(name), real(t, name))[1])
    n = 10_000
    calls = spark.range(n).selectExpr("1L as conv_id", "cast(id as string) as call_id", "array(cast(id - 1 as string)) as depends_on")
    got = {int(r.call_id): r.depth for r in chat.depths(calls).collect()}
    assert got == {k: k for k in range(n)} and made.count("chat-state") < 40


def test_depths_of_random_graphs(spark):
    import random

    draw = random.Random(3)
    needs = {}
    for conv in range(6):
        for k in range(80):
            needs[conv, k] = {draw.randrange(k) for _ in range(draw.choice([0, 1, 1, 1, 2, 3]))} if k else set()
            if draw.random() < 0.3 and k:
                needs[conv, k].add(k - 1)
    needs[0, 70].add(75)
    needs[0, 75].add(70)  # a cycle
    rows = [(c, str(k), [str(x) for x in sorted(v)] + ["elsewhere"]) for (c, k), v in needs.items()]
    got = {(r.conv_id, int(r.call_id)): r.depth for r in chat.depths(spark.createDataFrame(rows + rows[:50], "conv_id long, call_id string, depends_on array<string>")).collect()}
    want, changed = {}, True
    while changed:
        changed = False
        for (c, k), v in needs.items():
            if (c, k) not in want and all((c, x) in want for x in v):
                want[c, k] = max((want[c, x] + 1 for x in v), default=0)
                changed = True
    assert got == want and (0, 70) not in want and max(want.values()) > 15


def test_equal_calls_of_one_turn(spark):
    calls = [(1, 4, "a", "now", {}, []), (1, 4, "a", "now", {}, []), (1, 4, "a", "add", {"x": "1"}, []), (1, 3, "b", "now", {}, []), (1, 4, "b", "now", {}, [])]
    got = sorted((r.call_id, r.turn, json.loads(r.json)["name"], r.status) for r in rows(spark, calls, [(1, 9, "a", "x")], TOOLS) if r.part == 0)
    assert got == [("a", 4, "add", "ok"), ("a", 4, "now", "repeated"), ("a", 4, "now", "repeated"), ("b", 3, "now", "no result"), ("b", 4, "now", "repeated")]


def test_clashing_names_and_long_texts(spark):
    text = "long \u00e9 " * 30_000
    table = spark.createDataFrame([(1, 0, "user", text, 5, "x"), (1, 1, "assistant", text, 6, "y")], "conv_id long, turn long, role string, text string, depth int, status string")
    got = chat.link_calls(*chat.turns_as_calls(table)).orderBy("part").collect()
    assert [r.status for r in got] == ["ok", "ok"] and json.loads(got[0].json)["arguments"]["prompt"] == text == json.loads(got[1].json)["content"]


def test_empty(spark):
    assert rows(spark, [], [], []) == []
