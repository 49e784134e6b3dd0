"""Matching to labels, the interval join, the line index, early stop and cyclic groups, against plain versions."""

import itertools
import random
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corpusloom.operators import evidence, graph, intervals, matching, planner, plans, probe, search

cloudpickle.register_pickle_by_value(sys.modules[__name__])


# --- matching -------------------------------------------------------------------------------------------------------


def rank(near, findings, truths):
    """Size of the largest matching between two lists, by trying everything."""
    best = 0
    for f, *rest in [findings] if findings else []:
        best = max(rank(near, rest, truths), *[1 + rank(near, rest, truths - {t}) for t in near[f] if t in truths] or [0])
    return best


def kept(near, n, truths):
    """The rows of both sides that largest matchings keep, earlier ones first."""
    all_truths = frozenset(range(truths))
    f = {i for i in range(n) if rank(near, list(range(i + 1)), all_truths) > rank(near, list(range(i)), all_truths)}
    t = {j for j in range(truths) if rank(near, list(range(n)), frozenset(range(j + 1))) > rank(near, list(range(n)), frozenset(range(j)))}
    return f, t


def check(near, truths):
    pairs = matching.best_pairs(near, truths)
    assert all(t in near[f] for f, t in enumerate(pairs) if t >= 0)
    used = [t for t in pairs if t >= 0]
    assert len(set(used)) == len(used)
    assert ({f for f, t in enumerate(pairs) if t >= 0}, set(used)) == kept(near, len(near), truths)


def test_all_graphs_of_three_by_three():
    subsets = [list(s) for k in range(4) for s in itertools.combinations(range(3), k)]
    for near in itertools.product(subsets, repeat=3):
        check(list(near), 3)


def test_random_graphs():
    rng = random.Random(4)
    for _ in range(400):
        truths = rng.randint(0, 6)
        check([sorted(rng.sample(range(truths), rng.randint(0, truths))) for _ in range(rng.randint(0, 6))], truths)


def test_one_to_one_with_decoys_and_scores(spark):
    findings = spark.createDataFrame(
        [("a.c", 1, 10, 0, 1), ("a.c", 2, 11, 0, 2), ("a.c", 3, 90, 1, 3), ("a.c", 4, 50, 3, 4), ("a.c", 5, None, 1, 5), ("b.c", 1, 7, 2, 1), (None, 1, 7, 2, 1), ("d.c", 1, 5, None, 1)], "file string, id int, line int, grade int, `order` int",
    )
    truth = spark.createDataFrame([("a.c", "T1", 10, 11, 1, 1), ("a.c", "T2", 12, None, 0, 2), ("a.c", "T3", 50, 55, 0, 3), ("c.c", "T4", 1, 1, 0, 1), ("d.c", "T5", 5, 5, 1, 1), (None, "T6", 7, 7, 2, 1)], "file string, id string, first_line int, last_line int, grade int, `order` int")
    pairs = matching.one_to_one(findings, truth, ["file"], within=1)
    assert sorted(map(tuple, pairs.collect()), key=repr) == sorted([
        ("a.c", "1", "T1"), ("a.c", "2", "T2"), ("a.c", "3", None), ("a.c", "4", None), ("a.c", "5", None), ("a.c", None, "T3"), ("b.c", "1", None), ("c.c", None, "T4"), ("d.c", "1", None), ("d.c", None, "T5"),
        (None, "1", None), (None, None, "T6"),
    ], key=repr)
    assert ("d.c", "1", "T5") in set(map(tuple, matching.one_to_one(findings, truth, ["file"], 0, None).collect()))
    decoys = spark.createDataFrame([("a.c", "D1", 89, 91), ("a.c", "D2", 10, 10), ("b.c", "D3", 1, None)], "file string, id string, first_line int, last_line int")
    hits = matching.decoy_hits(findings, decoys, pairs, ["file"], ["file"])
    assert {r["id"]: r["hits"] for r in hits.collect()} == {"D1": 1, "D2": 0, "D3": 0}
    told = {r["grade"]: r.asDict() for r in matching.scores(findings, truth, pairs, ["file"], hits).collect()}
    assert (told[None]["findings"], told[None]["right"], told[None]["truths"], told[None]["found"], told[None]["decoys"], told[None]["decoys_hit"]) == (8, 2, 6, 2, 3, 1)
    assert told[0]["precision"] == 1.0 and told[0]["recall"] == 1 / 3 and told[3]["recall"] is None and told[1]["precision"] == 0.0
    empty = matching.one_to_one(findings.limit(0), truth.limit(0), ["file"])
    assert empty.count() == 0 and matching.scores(findings.limit(0), truth.limit(0), empty, ["file"]).first()["precision"] is None


# --- interval join --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("stretch", [1 << 20, 7])
def test_covering_equals_the_exploded_join(spark, stretch):
    rng = random.Random(stretch)
    points = [(f"k{rng.randint(0, 5)}", rng.randint(-20, 100), i) for i in range(600)] + [(None, 3, 900), ("k1", None, 901), ("lone", 1, 902)]
    spans = [(f"k{rng.randint(0, 5)}", a, a + rng.randint(-2, 40), i) for i in range(80) for a in [rng.randint(-20, 90)]] + [(None, 0, 9, 90), ("k1", None, 9, 91), ("k1", 0, None, 92), ("k2", -1_000, 1_000_000, 93)]
    p, s = spark.createDataFrame(points, "k string, at int, i int").repartition(5), spark.createDataFrame(spans, "k string, low int, high int, j int").repartition(3)
    if stretch == 7:
        spans = [x for x in spans if x[3] != 93]
        s = s.filter("j <> 93")
    found = sorted((r["i"], r["j"]) for r in intervals.covering(p, s, ["k"], "at", "low", "high", stretch).collect())
    assert found == sorted((i, j) for k, at, i in points for g, low, high, j in spans if k and k == g and at is not None and low is not None and high is not None and low <= at <= high)
    assert intervals.covering(p.limit(0), s, ["k"], "at", "low", "high").count() == 0


def test_a_long_span_stays_one_row(spark):
    spans = spark.createDataFrame([("m", "f.c", 1, 1_000_000)], "m string, file string, low int, high int")
    points = spark.range(0, 1_000_000, 100).selectExpr("'m' AS m", "'f.c' AS file", "id + 1 AS at")
    met = intervals.covering(points, spans, ["m", "file"], "at", "low", "high")
    assert met.count() == 10_000
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1  # of stretches, of which there is one
    with pytest.raises(ValueError, match="both"):
        intervals.covering(points.withColumn("low", F.lit(1)), spans, ["m", "file"], "at", "low", "high")


# --- index and early stop -------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("pattern", "grams"),
    [
        ("g_c[a-z]+", ["g_c"]), ("^abcd$", ["abc", "bcd"]), ("ab", []), ("(?i)abcdef", []), ("a(bcd)e", ["bcd"]), ("abc|def", []), ("(?:xyz)?abc", ["abc"]), ("(foo){2,}", ["foo"]), (r"foo\(\s*bar", ["foo", "oo(", "bar"]),
        ("(?i:abc)def", []), ("foo(", []), ("(?=abc)x", []), ("a.bcd*e", []), ("", []), ("(?>abc)", ["abc"]), ("é€abc", ["é€a", "€ab", "abc"]),
    ],
)
def test_grams_of_patterns(pattern, grams):
    assert search.pattern_grams(pattern) == sorted(grams)


def test_every_match_holds_the_grams_of_its_pattern():
    rng = random.Random(8)
    pieces = ["abc", "b", "[bc]", "(abc)", "(?:ab|cd)", "a+", "abc?", "(bca)+", ".", "^", r"\b", "c{2}"]
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 14))) for _ in range(300)]
    for _ in range(300):
        pattern = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 4)))
        needed = search.pattern_grams(pattern)
        for t in texts:
            assert not re.search(pattern, t) or all(g in t for g in needed)


LINES = [("m", "a.c", n, t) for n, t in enumerate(["int alpha;", "alpha = beta();", "#define beta 3", "", None, "éalpha x", "struct beta { int a; };", "alphabet", "al", "beta beta"], 1)]
LINES += [("m", "b.c", 5000 * n, f"call_{n}(alpha);") for n in range(1, 40)] + [("n", "a.c", 1, "alpha beta")]


def test_candidates_are_the_lines_that_hold_the_grams(spark):
    lines = spark.createDataFrame(LINES, "module_id string, file string, line_no int, line string")
    asks = [("m", 0, ["w:alpha"]), ("m", 1, ["alp", "bet"]), ("m", 2, []), ("n", 0, ["w:beta"]), ("n", 1, ["w:none"]), ("x", 0, [])]
    asked = spark.createDataFrame(asks, "module_id string, n int, grams array<string>")
    got = {(r["module_id"], r["n"], r["file"], r["line_no"]) for r in search.candidates(asked, ["module_id", "n"], search.postings(lines), lines).collect()}

    def holds(text, gram):
        return gram[2:] in re.findall("[A-Za-z0-9_]+", text) if gram.startswith("w:") else gram in text

    assert got == {(m, n, f, no) for m, n, grams in asks for g, f, no, t in LINES if g == m and (not grams or t is not None and all(holds(t, x) for x in grams))}


def test_dispatch_joins_no_lines_with_queries(spark):
    lines = spark.createDataFrame(LINES, "module_id string, file string, line_no int, line string")
    functions = spark.createDataFrame([("m", "b.c", "f", 1, 90_000), ("m", "a.c", "g", 2, 2)], "module_id string, file string, name string, line int, end_line int")
    asked = spark.createDataFrame([("m", 0, "accessors", "alpha"), ("m", 1, "macro", "beta"), ("m", 2, "definition", "beta"), ("m", 3, "search", "al.ha ="), ("m", 4, "search", "call_[0-9]+"), ("m", 5, "search", "(((a*)*)*)*$x")], "module_id string, n int, kind string, target string")
    hits = {}
    for r in probe.dispatch(asked, {"lines": lines, "functions": functions}).orderBy("n", "at").collect():
        hits.setdefault(r["n"], []).append(r["hit"])
    assert len(hits[0]) == 19 and hits[0][0] == "a.c:2（函数 g）  alpha = beta();" and hits[1] == ["a.c:3  #define beta 3"]
    assert hits[2][0].startswith("a.c:7  struct beta") and hits[3] == ["a.c:2  alpha = beta();"] and len(hits[4]) == probe.MAX_HITS + 1 and len(hits[5]) == 1


def test_a_pattern_without_end_gives_up(monkeypatch):
    monkeypatch.setattr(probe, "PATTERN_SECONDS", 0.2)
    with pytest.raises(TimeoutError):
        probe.has_match("a" * 60 + "b", "(a|aa)+$")
    assert probe.has_match("xaay", "a+") and not probe.has_match(None, "a") and not probe.has_match("a", "a(")


class Counted:
    """A test that counts how often it is asked."""

    def __init__(self, counter, slow=None):
        self.counter, self.slow = counter, slow

    def __call__(self, value):
        self.counter.add(1)
        if value == self.slow:
            raise TimeoutError
        return value % 2 == 0


def test_a_group_is_read_no_further_than_its_last_hit(spark):
    rows = spark.range(4000).selectExpr("id % 4 AS k", "id DIV 4 AS at", "id DIV 4 AS value", "'x' AS gave_up").repartition(6)
    counter = spark.sparkContext.accumulator(0)
    got = search.first_hits(rows, ["k"], ["at"], Counted(counter), ["value"], 21).collect()
    assert {k: sorted(r["at"] for r in got if r["k"] == k) for k in range(4)} == {k: list(range(0, 42, 2)) for k in range(4)}
    assert counter.value == 4 * 41 and not any(r["gave_up"] for r in got)
    slow = search.first_hits(rows, ["k"], ["at"], Counted(counter, slow=7), ["value"], 21).collect()
    assert sorted((r["at"], r["gave_up"]) for r in slow if r["k"] == 1) == [(0, False), (2, False), (4, False), (6, False), (7, True)]


# --- cyclic groups --------------------------------------------------------------------------------------------------


def plain_groups(edges):
    out = {}
    for m in {e[0] for e in edges}:
        near = {}
        for g, s, d in edges:
            if g == m:
                near.setdefault(s, []).append(d)
        out[m] = sorted(graph._strong(near))
    return {m: g for m, g in out.items() if g}


@pytest.mark.parametrize(("in_task", "seed"), [(50_000, 1), (0, 2), (12, 3)])
def test_groups_by_colouring_equal_a_plain_search(spark, in_task, seed):
    rng = random.Random(seed)
    sizes = {"a": (30, 35), "b": (12, 30), "c": (6, 4), "d": (40, 44), "e": (1, 0)}
    edges = [(m, f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for m, (n, k) in sizes.items() for _ in range(k)]
    edges += [("path", f"p{i:02}", f"p{i + 1:02}") for i in range(12)] + [("ring", f"r{i}", f"r{(i + 1) % 7}") for i in range(7)] + [("self", "s", "s"), ("self", "s", "s")]
    df = spark.createDataFrame([*edges, ("a", None, "n1"), (None, "n1", "n1")], "m string, src string, dst string").repartition(5)
    found = {}
    for r in graph.module_cycles(df, "m", in_task).orderBy("m", "group_no").collect():
        found.setdefault(r["m"], []).append(r["members"])
        assert r["group_no"] == len(found[r["m"]])
    assert found == plain_groups(edges)


def scattered_parts(spark, parts):
    """One module of many rings and chains that do not touch, its edges dealt over tasks, some of them twice."""
    edges = [("m", f"r{p:03}.{i}", f"r{p:03}.{(i + 1) % 5}") for p in range(parts) for i in range(5)] + [("m", f"c{p:03}.{i}", f"c{p:03}.{i + 1}") for p in range(parts) for i in range(6)]
    random.Random(parts).shuffle(edges)
    return edges, spark.createDataFrame(edges + edges[:50], "m string, src string, dst string").repartition(7)


def test_a_large_module_of_small_parts_is_not_coloured(spark, monkeypatch):
    edges, df = scattered_parts(spark, 40)
    monkeypatch.setattr(graph, "_coloured", lambda _: pytest.fail("parts of few edges are solved in tasks"))
    found = sorted(r["members"] for r in graph.module_cycles(df, "m", in_task=30).collect())
    assert found == plain_groups(edges)["m"] and len(found) == 40


def plain_closure(edges):
    near = {}
    for m, s, d in edges:
        if None not in (m, s, d):
            near.setdefault((m, s), set()).add(d)
    out = {e for e in edges if None in e}
    for m, s in near:
        seen, todo = set(), list(near[m, s])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near.get((m, x), ())
        out |= {(m, s, d) for d in seen}
    return out


@pytest.mark.parametrize(("in_task", "chunk"), [(2000, 500_000), (2000, 3), (12, 500_000), (0, 10)])
def test_closure_equals_a_plain_search(spark, monkeypatch, in_task, chunk):
    monkeypatch.setattr(graph, "IN_CHUNK", chunk)
    rng = random.Random(in_task)
    edges = [(m, f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for m, (n, k) in {"a": (20, 25), "b": (30, 15), "c": (3, 4)}.items() for _ in range(k)]
    edges += [("path", f"p{i:02}", f"p{i + 1:02}") for i in range(12)] + [("self", "s", "s"), ("a", None, "n1"), ("a", None, "n1"), (None, "n1", "n2"), ("b", "n1", None)]
    got = [tuple(r) for r in graph.closure(spark.createDataFrame(edges, "m string, src string, dst string").repartition(5), "m", in_task).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_closure(edges)


def test_closure_of_small_parts_takes_no_rounds(spark, monkeypatch):
    edges, df = scattered_parts(spark, 40)
    monkeypatch.setattr(graph, "_doubled", lambda _: pytest.fail("parts of few edges are closed in tasks"), raising=False)
    staged, written = graph.staged, []
    monkeypatch.setattr(graph, "staged", lambda *a: (written.append(1), staged(*a))[1])
    got = [tuple(r) for r in graph.closure(df, "m").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_closure(edges)
    assert len(written) <= 4  # parts, what they share, parts over tasks, large ones


def test_groups_of_nothing(spark):
    assert graph.module_cycles(spark.createDataFrame([], "m int, src string, dst string"), "m").count() == 0


# --- plans without a model, and evidence -----------------------------------------------------------------------------


def test_units_read_functions_and_calls_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(len(b))
            yield b

    functions = spark.createDataFrame([("m", n) for n in "abcde"] + [("n", n) for n in "ab"], "module_id string, name string")
    edges = spark.createDataFrame([("m", *e) for e in ("ab", "ba", "ba", "bc", "cd", "dd", "dz", "zc", "ec")] + [("n", "a", "b")], "module_id string, src string, dst string")
    members, calls = planner.units(functions, edges.mapInPandas(counted, edges.schema))
    assert {tuple(r) for r in members.collect()} == {("m", "a", "a"), ("m", "b", "a"), *(("m", n, n) for n in "cde"), ("n", "a", "a"), ("n", "b", "b")}
    got = [tuple(r) for r in calls.collect()]
    assert sorted(got) == [("m", "a", "c"), ("m", "c", "d"), ("m", "e", "c"), ("n", "a", "b")]
    assert reads.value == 10  # it was read for the groups and again for the calls


@pytest.mark.parametrize(("size", "limit"), [(40, 120), (2500, 2000)])
def test_packed_plans_have_no_violation(spark, size, limit):
    rng = random.Random(size)
    functions, at = [], {}
    for f in range(size):
        file = f"f{f % 3}.c"
        start = at.get(file, 0) + rng.randint(1, 5)
        at[file] = start + rng.randint(0, 60)
        functions.append(("m", file, f"g{f}", start, at[file]))
    at = {f: n + 7 for f, n in at.items()}
    # hubs, chains and rings of up to three functions that sit side by side
    edges = [("m", f"g{rng.randrange(size)}", f"g{rng.randrange(size)}") for _ in range(size // 8)]
    edges = [e for e in edges if int(e[1][1:]) < int(e[2][1:])]
    edges += [e for f in range(0, size - 3, 9) for e in [("m", f"g{f}", f"g{f + 1}"), ("m", f"g{f + 1}", f"g{f}"), ("m", f"g{f}", "gone")]]
    df = spark.createDataFrame(functions, "module_id string, file string, name string, line int, end_line int")
    calls = spark.createDataFrame(edges, "module_id string, src string, dst string")
    lines = spark.createDataFrame([("m", f, n) for f, n in at.items()], "module_id string, file string, line_no int").selectExpr("module_id", "file", "explode(sequence(1, line_no)) AS line_no").withColumn("line", F.lit(""))
    cut, owners, unknown = plans.cut_by_plan(planner.planned(df, calls, limit, lines), df, lines)
    cycles = graph.module_cycles(calls, "module_id")
    bad = plans.plan_violations(cut, owners, cycles, limit).collect()
    if size > 100:
        assert bad == [] and unknown.isEmpty() and 20 * size > 2000
    covered = cut.selectExpr("file", "explode(sequence(start, end)) AS n").groupBy("file").agg(F.count("*").alias("c"), F.count_distinct("n").alias("d")).collect()
    assert {r["file"]: (r["c"], r["d"]) for r in covered} == {f: (n, n) for f, n in at.items()}
    assert all("循环" not in v for r in bad for v in r["violations"])


def test_chunks_keep_hubs_with_callees():
    lines = {"hub": 10, "a": 10, "b": 10, "c": 25, "shared": 5}
    got = planner.chunks_of(list(lines), lines, {"a": ["hub"], "b": ["hub"], "c": ["hub"], "shared": ["a", "c"]}, 30)
    assert got == {"hub": 0, "a": 0, "b": 0, "c": 1, "shared": 1}
    assert planner.chunks_of(["x"], {"x": 99}, {}, 30) == {"x": 0} and planner.chunks_of([], {}, {}, 30) == {}


SOURCE = "int alpha(int n)\n{\n    if (n > 3)\n        return beta(n - 1, 7);\n    return n;\n}\n" + "\n" * 20 + "void gamma(void)\n{\n    total += alpha(4) * beta(2, 1);\n    free(buffer);\n}\n"


def test_quotes_are_found_where_they_stand(spark):
    files = spark.createDataFrame([("m", "a.c", SOURCE), ("m", "b.c", "int other;\n"), ("n", "a.c", SOURCE), ("m", "null.c", None)], "module_id string, file string, text string")
    quote = "if (n > 3)\n        return beta(n - 1, 7);"
    rows = [
        ("m", "f1", 1, "a.c", 3, quote), ("m", "f2", 2, "a.c", 28, quote.replace("\n", " ")), ("m", "f3", 3, "b.c", 1, "if ( n>3 ) return\n\n beta( n-1 ,7 ) ;"), ("m", "f4", 4, "a.c", 3, "if (m < 9) goto error_handler_of_nothing;"),
        ("m", "f5", 5, "a.c", 3, "n"), ("m", "f6", 6, "a.c", None, "total += alpha(4) * beta(2, 1);"), ("x", "f1", 1, "a.c", 3, quote), ("m", "f7", 7, None, 3, None),
    ]
    findings = spark.createDataFrame(rows, "module_id string, id string, no int, file string, line int, evidence string")
    places = evidence.located(findings, files)
    got = {(r["module_id"], r["id"]): (r["place"], r["found_file"], r["found_line"]) for r in places.collect()}
    assert got == {
        ("m", "f1"): ("at place", "a.c", 3), ("m", "f2"): ("moved", "a.c", 3), ("m", "f3"): ("moved", "a.c", 3), ("m", "f4"): ("missing", None, None), ("m", "f5"): ("too short", None, None),
        ("m", "f6"): ("moved", "a.c", 29), ("x", "f1"): ("missing", None, None), ("m", "f7"): ("too short", None, None),
    }
    assert {r["id"]: r["same_as"] for r in evidence.near_equal(findings, places).collect()} == {"f1": None, "f2": "f1", "f3": "f1", "f6": None}


def test_shared_runs_share_a_fingerprint():
    rng = random.Random(2)
    for _ in range(200):
        run = " ".join(rng.choice("abcdefgh") for _ in range(evidence.GRAM + evidence.WINDOW - 1))
        left, right = (" ".join(rng.choice("abcdefgh") for _ in range(20)) + " " + run + "\n" + "z " * rng.randint(0, 9) for _ in range(2))
        assert {h for h, _ in evidence.winnowed(left)} & {h for h, _ in evidence.winnowed(right)}
