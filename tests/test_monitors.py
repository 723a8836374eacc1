import random
import re

import pytest
from pyspark.sql import functions as F

from outpoint.operators import descent, monitors, patterns
from outpoint.operators.monitors import Monitor


def sequential(txs, rules):
    """Collections of transactions that arrive one by one."""
    held = {m.name: set() for m in rules}
    out = {}
    for name, parents, matched in txs:
        for i, m in enumerate(rules):
            if (m.track_descendants and any(p in held[m.name] for p in parents)) or i in matched:
                held[m.name].add(name)
                out[name] = i
                break
    return out


@pytest.mark.parametrize("seed, generations", [(1, 99), (2, 99), (3, 0), (4, 0), (5, 2)])
def test_closure_equals_one_by_one(spark, seed, generations):
    rng = random.Random(seed)
    rules = [
        Monitor("first", True, None, "a0"),
        Monitor("still", False, None, "a1"),
        Monitor("third", True, None, "a2"),
    ]
    txs = []
    for i in range(200):
        parents = {f"t{rng.randrange(max(0, i - 15), i)}" for _ in range(rng.randrange(3))} if i else set()
        # A parent that arrives later does not count.
        if rng.random() < 0.05:
            parents.add(f"t{i + 3}")
        matched = {j for j in range(3) if rng.random() < 0.05}
        txs.append((f"t{i}", parents, matched))
    frame = spark.createDataFrame([(t, i) for i, (t, _, _) in enumerate(txs)], "hash string, seq bigint")
    ins = [(t, p, i) for i, (t, ps, _) in enumerate(txs) for p in ps]
    inputs = spark.createDataFrame(ins, "hash string, prev_hash string, seq bigint")
    outs = [(t, f"a{j}", i) for i, (t, _, js) in enumerate(txs) for j in js] + [("t0", "ff", 0)]
    outputs = spark.createDataFrame(outs, "hash string, script_hex string, seq bigint")
    matches = monitors.own_matches(outputs, rules)
    found = monitors.assign(frame, inputs, matches, rules, generations).collect()
    assert len(found) == len({r["hash"] for r in found})
    assert {r["hash"]: r["priority"] for r in found} == sequential(txs, rules)


def test_a_deep_chain_takes_few_rounds(spark, monkeypatch):
    """5000 generations with matches on the way, side parents and detours, in at most 20 rounds."""
    rounds = []
    keep = descent.materialize
    monkeypatch.setattr(descent, "materialize", lambda df, label: rounds.append(label) or keep(df, label))
    rules = [Monitor("a", True, None, "a0"), Monitor("b", False, None, "a1"), Monitor("c", True, None, "a2")]
    rng = random.Random(7)
    txs = [("t0", set(), {2})]
    for i in range(1, 5000):
        if i % 10 == 9:
            txs += [(f"s{i}", {f"t{i - 1}"}, set()), (f"x{i}", set(), set())]
        parents = {f"t{i - 1}"} | ({f"s{i}", f"x{i}"} if i % 10 == 9 else set())
        matched = {0} if i == 3000 else {1} if i == 1500 else {2} if rng.random() < 0.2 and i != 1501 else set()
        txs.append((f"t{i}", parents, matched))
    frame = spark.createDataFrame([(t, i) for i, (t, _, _) in enumerate(txs)], "hash string, seq bigint")
    ins = [(t, p, i) for i, (t, ps, _) in enumerate(txs) for p in ps]
    inputs = spark.createDataFrame(ins, "hash string, prev_hash string, seq bigint")
    matches = spark.createDataFrame([(t, min(js)) for t, _, js in txs if js], "hash string, priority int")
    found = {r["hash"]: r["priority"] for r in monitors.assign(frame, inputs, matches, rules, 2).collect()}
    assert found == sequential(txs, rules)
    assert 2 + sum(label in ("pointers", "open") for label in rounds) <= 20


@pytest.mark.parametrize("seed", [1, 2])
def test_deep_chains_with_monitors_that_come_and_go(spark, seed):
    """Contraction equals generation after generation where the active monitors change."""
    rng = random.Random(seed)
    rules = [Monitor("a", True, None, "a0", 20, 70), Monitor("b", False, None, "a1"), Monitor("c", True, None, "a2", None, 110)]
    rules += [Monitor("d", True, None, "a3"), Monitor("e", True, None, "a4", 60)]
    ins = []
    for i in range(1, 150):
        parents = {i - 1} if rng.random() < 0.85 else {rng.randrange(i), rng.randrange(i)}
        ins += [(f"t{i}", f"t{p}", i) for p in parents]
    frame = spark.createDataFrame([(f"t{i}", i) for i in range(150)], "hash string, seq bigint")
    inputs = spark.createDataFrame(ins, "hash string, prev_hash string, seq bigint")
    drawn = [(f"t{i}", rng.randrange(5)) for i in range(150) if rng.random() < 0.08]
    matches = spark.createDataFrame(drawn, "hash string, priority int")
    answer = lambda n: sorted(tuple(r) for r in monitors.assign(frame, inputs, matches, rules, n).collect())
    assert answer(0) == in_order(ins, drawn, rules)


def in_order(ins, drawn, rules):
    """Holders of t0, t1, ... one by one, each parent passing on what is active when the child arrives."""
    own, held = dict(drawn), {}
    for i in range(150):
        passed = [held.get(p) for t, p, _ in ins if t == f"t{i}"]
        spans = {j: (m.valid_from or 0, m.valid_to or 10**9) for j, m in enumerate(rules) if m.track_descendants}
        passed = [j for j in passed if j in spans and spans[j][0] <= i < spans[j][1]]
        held[f"t{i}"] = min([*passed, *([own[f"t{i}"]] if f"t{i}" in own else [])], default=None)
    return sorted((t, j) for t, j in held.items() if j is not None)


def test_pattern_is_searched_anywhere(spark):
    script = "76a9147c78584493557fac782023a4ad591b64545929d988ac"
    df = spark.createDataFrame([("t", script), ("u", "51")], "hash string, script_hex string")
    rules = [Monitor("pattern", False, None, "76a914"), Monitor("end", False, None, "88ac$")]
    assert sorted(tuple(r) for r in monitors.pattern_matches(df, rules).collect()) == [("t", "end"), ("t", "pattern")]
    assert [tuple(r) for r in monitors.own_matches(df, rules).collect()] == [("t", 0)]


def test_address_wins_over_pattern(spark):
    rules = [
        Monitor("a", False, "mgzhRq55hEYFgyCrtNxEsP1MdusZZ31hH5", "ffff"),
        Monitor("bad", False, "nonsense", "ffff"),
        Monitor("none"),
        Monitor("p", True, None, "eeee"),
    ]
    usable = monitors.with_patterns(spark, rules, "testnet")
    assert [(m.name, m.locking_script_pattern) for m in usable] == [
        ("a", "76a91410375cfe32b917cd24ca1038f824cd00f739185988ac"),
        ("p", "eeee"),
    ]


def test_broadcast_takes_what_is_left(spark):
    txs = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "hash string, submitted boolean")
    assigned = spark.createDataFrame([("a", 0)], "hash string, priority int")
    out = monitors.capture(txs, assigned, [Monitor("m", False, None, "x")])
    assert sorted(tuple(r) for r in out.collect()) == [("a", "m"), ("b", "broadcast")]


def test_added_and_deleted_monitors(spark):
    """A monitor catches only what arrives while it is there."""
    rules = [Monitor("m", True, None, "aa", valid_from=10, valid_to=20)]
    txs = spark.createDataFrame([(f"t{n}", n) for n in (5, 12, 15, 19, 20, 25)], "hash string, seq bigint")
    outputs = txs.filter("seq in (5, 12, 25)").withColumn("script_hex", F.lit("aa"))
    edges = [("t15", "t12", 15), ("t19", "t15", 19), ("t20", "t15", 20), ("t25", "t5", 25)]
    inputs = spark.createDataFrame(edges, "hash string, prev_hash string, seq bigint")
    matches = monitors.own_matches(outputs, rules)
    found = {r["hash"] for r in monitors.assign(txs, inputs, matches, rules).collect()}
    assert found == {"t12", "t15", "t19"}


def test_checks(spark):
    schema = "position bigint, name string, address string, locking_script_pattern string"
    asked = [
        (1, "new", None, "aa"),
        (2, "new", None, "bb"),
        (3, "old", None, "aa"),
        (4, "bad name", None, "aa"),
        (5, "empty", None, None),
        (6, "long", None, "x" * 513),
        (7, "addr", "mgz", None),
    ]
    existing = spark.createDataFrame([("old",)], "name string")
    out = {r["position"]: r["reason"] for r in monitors.check_monitors(spark.createDataFrame(asked, schema), existing).collect()}
    assert out == {
        1: None,
        2: "name in use",
        3: "name in use",
        4: "bad name",
        5: "neither address nor pattern",
        6: "bad pattern",
        7: None,
    }
    names = spark.createDataFrame([("s",), ("d",), ("?",), ("u",)], "name string")
    static = spark.createDataFrame([("s",)], "name string")
    dynamic = spark.createDataFrame([("d",)], "name string")
    verdicts = {r["name"]: r["reason"] for r in monitors.check_deletes(names, static, dynamic).collect()}
    assert verdicts == {"s": "not dynamic", "d": None, "?": "bad name", "u": "unknown name"}


def test_monitors_from_a_table(spark):
    rules = [Monitor("b", True, None, "aa"), Monitor("a", False, "x", None, 3, 9)]
    table = monitors.monitors_frame(spark, rules)
    assert sorted(monitors.monitors_of(table), key=lambda m: m.name) == rules[::-1]
    numbered = table.withColumn("position", F.when(F.col("name") == "a", 2).otherwise(1))
    assert monitors.monitors_of(numbered) == rules


def test_order_of_monitors(spark):
    schema = "position bigint, name string, track_descendants boolean, address string, locking_script_pattern string"
    row = lambda i, n, p="aa": (i, n, False, None, p)
    static = spark.createDataFrame([row(0, "s0"), row(1, "s1", None)], schema)
    dynamic = spark.createDataFrame([row(0, "d0")], schema)
    added = spark.createDataFrame([row(0, "later")], schema)
    out = monitors.monitor_order(static, dynamic, added).orderBy("stage", "position").collect()
    assert [r["name"] for r in out] == ["s0", "d0", "broadcast", "later"]


def test_thousands_of_address_monitors(spark):
    script = lambda i: f"76a914{i:040x}88ac"
    rules = [Monitor("first", False, None, "^76a9140{39}7")] + [Monitor(f"m{i}", i == 3, None, script(i)) for i in range(5000)]
    rules[10] = Monitor("m9", False, None, script(9), 5, 8)
    outs = [("a", script(4000), 1), ("b", "75" + script(17), 1), ("c", script(9), 4), ("d", script(9), 5), ("e", script(7), 1)]
    outs += [("f", "7" + script(20), 1), ("g", "51", 1), ("a", script(3), 1), ("h", script(21) + script(22), 1)]
    outputs = spark.createDataFrame(outs, "hash string, script_hex string, seq long")
    first = {r["hash"]: rules[r["priority"]].name for r in monitors.own_matches(outputs, rules).collect()}
    assert first == {"a": "m3", "b": "m17", "d": "m9", "e": "first", "f": "m20", "h": "m21"}
    every = sorted((r["hash"], r["name"]) for r in monitors.pattern_matches(outputs, rules).collect())
    assert [n for h, n in every if h == "a"] == ["m3", "m4000"] and [n for h, n in every if h == "h"] == ["m21", "m22"]


def test_runs_that_a_pattern_needs():
    runs = {
        "76a914": "76a914",
        "^76a914[0-9a-f]{40}88ac$": "76a914",
        "6a0c?deadbeef": "deadbeef",
        "abcde{2}ff": "abcde",
        "abcd+?ff00": "abcd",
        "(?:aabb|ccdd)eeff00": "eeff00",
        "aabbcc*": "aabbc",
        "aabb|ccdd": None,
        "(?i)aabbcc": None,
        "(?=aabb)ccdd": None,
        r"\Qaabb\E": None,
        r"\x41aabb": None,
        r"\daabb": "aabb",
        "[a[bc]]aabb": None,
        "[0-9a-f]+": None,
        "(aabbccdd)?": None,
        "aab": None,
        "aabb{0}": None,
        "aabb)": None,
    }
    assert {p: patterns.required_run(p) for p in runs} == runs


def test_what_a_pattern_matches_holds_its_run():
    rng = random.Random(1)
    atoms = ["0", "a", "b", "76a9", "1", "[0-9a-f]", "[^0]", ".", "(ab|cd)", "(?:0a)", "\\d", "^", "$", "(a)?", "(b|c)*"]
    times = ["", "", "", "", "?", "*", "+", "{2}", "{0,3}", "{1,}", "+?", "{0}"]
    tried = 0
    for _ in range(20000):
        pattern = "".join(rng.choice(atoms) + rng.choice(times) for _ in range(rng.randrange(1, 9)))
        try:
            compiled = re.compile(pattern)
        except re.error:
            continue
        run = patterns.required_run(pattern)
        for _ in range(6 if run else 0):
            text = "".join(rng.choice(["0", "a", "b", "76a9", "1", "ab", "cd", "0a"]) for _ in range(rng.randrange(1, 14)))
            if compiled.search(text):
                tried += 1
                assert run in text, (pattern, text)
    assert tried > 100


def test_thousands_of_pattern_monitors(spark):
    """As many single conditions would find, from a plan of one size."""
    rules = [Monitor(f"m{i}", False, None, f"6a04{i:08x}[0-9a-f]{{2}}51{i % 7}?$") for i in range(5000)]
    rules[40] = Monitor("loose", False, None, "^(51|52)$")
    rules[41] = Monitor("some time", False, None, f"6a04{41:08x}", 5, 8)
    rules[42] = Monitor("same run", False, None, f"6a04{43:08x}..5")
    outs = [(f"t{i}", f"6a04{i:08x}ff51", 1) for i in (0, 3, 41, 43, 4999)]
    outs += [("u", f"6a04{41:08x}ff52", 5), ("v", "52", 1), ("w", "", 1), ("x", None, 1), ("y", f"6a04{7:08x}ff53", 1)]
    outs += [("z", f"6a04{8:08x}ff51" + f"6a04{9:08x}ff51", 1)]
    outputs = spark.createDataFrame(outs, "hash string, script_hex string, seq long")
    found = {(r["hash"], r["name"]) for r in monitors.pattern_matches(outputs, rules).collect()}
    plain = {
        (t, m.name)
        for t, script, seq in outs
        for m in rules
        if script is not None and re.search(m.locking_script_pattern, script) and (m.valid_from or 0) <= seq < (m.valid_to or 10**9)
    }
    assert found == plain
    assert len(monitors._matches(outputs, rules)._jdf.queryExecution().toString()) < 100_000
