"""Lexing, call graphs, dependencies and the review loop over small C trees of our own."""

import json
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.functions import replies
from corpusloom.jobs.model import Ledger, ask_model
from corpusloom.jobs.review import FINDINGS, review, review_into
from corpusloom.operators import graph, intervals, lexer, probe, symbols
from corpusloom.sources import files as sources
from corpusloom.sources import staging

# workers cannot import this file: the scripted client travels by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAIR_C = """#include "pair.h"
#include <stdlib.h>
/* two functions call each other { */

static int g_count;

int ping(int n)
{
    if (n <= 0)
        return 0; // stop; }
    return pong(n - 1);
}

int pong(int n)
{
    const char *s = "ping( \\
}";
    obj.ping(s); p->pong(s);
    return ping(n - 1) + pong2(n);
}

void *grab(void) {
    return malloc(10);
}
/* tail */
"""
PAIR_H = """#ifndef PAIR_H
#define PAIR_H
int ping(int n);
int pong(int n);
void *grab(void);
#endif
"""
BASE_H = """#define LIMIT 16
#define SQUARE(x) ((x) * \\
    (x))
typedef struct { int a; char b; } item_t;
struct point { int x; int y; };
int open_base(const char *path);
"""
USER_C = """#include "base.h"
int use(void)
{
    struct point p; item_t t;
    return open_base("x") + SQUARE(LIMIT) + (int)sizeof(t) + p.x;
}
"""


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("src") / "tree"
    (root / "lib").mkdir(parents=True)
    for name, text in {"pair.c": PAIR_C, "pair.h": PAIR_H, "lib/base.h": BASE_H, "lib/base.c": '#include "base.h"\nint open_base(const char *path) { return 0; }\n', "user.c": USER_C, "notes.txt": "int no(void);"}.items():
        (root / name).write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def lexed(spark, tree):
    return lexer.lexed(sources.modules(sources.source_tree(spark, tree))).cache()


def test_noise_keeps_positions():
    clean = lexer.strip_noise(PAIR_C)
    assert len(clean) == len(PAIR_C) and clean.count("\n") == PAIR_C.count("\n") and "stop" not in clean and "two" not in clean


def test_relations_of_one_file():
    out = lexer.lex_text(PAIR_C)
    assert [(f["name"], f["line"], f["end_line"]) for f in out["functions"]] == [("ping", 7, 12), ("pong", 14, 20), ("grab", 22, 24)]
    assert [(g["name"], g["line"]) for g in out["globals"]] == [("g_count", 5)]
    assert {(c["caller"], c["callee"], c["line"]) for c in out["calls"]} == {("ping", "pong", 11), ("pong", "ping", 19), ("pong", "pong2", 19), ("grab", "malloc", 23)}


def test_header_relations():
    out = lexer.lex_text(BASE_H)
    assert [m["name"] for m in out["macros"]] == ["LIMIT", "SQUARE"] and "(x) * (x)" in out["macros"][1]["text"]
    assert [t["name"] for t in out["types"]] == ["item_t", "point"]
    assert [d["name"] for d in out["declarations"]] == ["open_base"]
    assert lexer.lex_text(None)["functions"] == [] and lexer.lex_text("")["names"] == []


def test_inventory(spark, tree):
    rows = {r["module"]: r for r in sources.module_inventory(sources.modules(sources.source_tree(spark, tree))).collect()}
    assert list(sorted(rows)) == ["lib/base", "pair", "user"] and rows["lib/base"]["module_id"] == "M01"
    assert rows["pair"]["files"] == ["pair.c", "pair.h"] and rows["pair"]["lines"] == 25 + 6


def test_call_graph(lexed):
    edges, ambiguous, unresolved = symbols.call_edges(lexed)
    assert {(r["src"], r["dst"], r["line"]) for r in edges.collect()} == {("ping", "pong", 11), ("pong", "ping", 19)}
    assert ambiguous.count() == 0 and {"malloc", "pong2"} <= {r["callee"] for r in unresolved.collect()}
    groups = graph.module_cycles(edges.select("module_id", "src", "dst"), "module_id").collect()
    assert [list(g["members"]) for g in groups] == [["ping", "pong"]]
    reach = graph.closure(edges.select("module_id", "src", "dst"), "module_id")
    assert [list(r["members"]) for r in graph.cycles(reach, "module_id").collect()] == [["ping", "pong"]]


def test_interface_tags(lexed):
    kinds = {r["name"]: r["kind"] for r in symbols.functions(lexed).collect()}
    assert kinds == {"ping": "对外接口", "pong": "对外接口", "grab": "对外接口", "open_base": "对外接口", "use": "内部函数"}


def test_dependencies(lexed):
    text = {r["module_id"]: r["background"] for r in symbols.backgrounds(lexed).collect()}
    assert set(text) == {"M03"}
    assert all(x in text["M03"] for x in ("LIMIT", "SQUARE", "item_t", "open_base(const char *path)")) and "sizeof" not in text["M03"]


def test_ranges_cover_every_line(spark):
    functions = spark.createDataFrame([("M01", "a.c", "f", 2, 4), ("M01", "a.c", "g", 7, 8)], "module_id string, file string, name string, line int, end_line int")
    claims = spark.createDataFrame([("M01", "a.c", "f", 2, 0), ("M01", "a.c", "g", 7, 1)], "module_id string, file string, name string, line int, chunk_no int")
    lines = spark.range(1, 11).select(F.lit("M01").alias("module_id"), F.lit("a.c").alias("file"), F.col("id").cast("int").alias("line"))
    got = sorted((r["start"], r["end"], r["chunk_no"]) for r in intervals.owned_lines(functions, lines, claims).collect())
    assert got == [(1, 4, 0), (5, 10, 1)]


@pytest.fixture(scope="module")
def tables(spark, tree, lexed):
    files = sources.modules(sources.source_tree(spark, tree))
    lines = intervals.line_table(files.withColumn("k", F.struct("module_id", "file")), "k").select("k.*", "line_no", "line")
    return {"edges": symbols.call_edges(lexed)[0], "lines": lines.cache(), "functions": symbols.functions(lexed)}


def ask(spark, tables, *queries):
    rows = [(m, n, k, t) for n, (m, k, t) in enumerate(queries)]
    out = {}
    for r in probe.dispatch(spark.createDataFrame(rows, "module_id string, n int, kind string, target string"), tables).collect():
        out.setdefault((r["kind"], r["target"]), []).append(r["hit"])
    return out


def test_all_probe_kinds(spark, tables):
    hits = ask(
        spark, tables, ("M02", "callers", "ping"), ("M02", "callees", "ping"), ("M02", "accessors", "malloc"), ("M01", "definition", "item_t"), ("M02", "source", "grab"),
        ("M02", "search", "g_c[a-z]+"), ("M01", "macro", "LIMIT"), ("M01", "what", "x"), ("M01", "macro", "NONE"),
    )
    assert hits["callers", "ping"] == ["pair.c:19  pong 调用 ping"] and hits["callees", "ping"] == ["pair.c:11  ping 调用 pong"]
    assert hits["accessors", "malloc"] == ["pair.c:23（函数 grab）  return malloc(10);"]
    assert hits["definition", "item_t"][0].startswith("lib/base.h:4  typedef struct { int a; char b; } item_t; struct point") and hits["source", "grab"][0].startswith("void *grab")
    assert hits["search", "g_c[a-z]+"] == ["pair.c:5  static int g_count;"] and hits["macro", "LIMIT"] == ["lib/base.h:1  #define LIMIT 16"]
    assert hits["what", "x"] == ["不支持的取证类型：what"] and hits["macro", "NONE"] == ["（没有命中）"]


def test_probes_stay_in_their_module_and_survive_bad_patterns(spark, tables):
    hits = ask(spark, tables, ("M01", "callers", "ping"), ("M02", "search", "foo("), ("M02", "search", "[a-z"), ("M02", "macro", r"A\E("), ("M02", "accessors", "(("), ("M02", "search", "ping"))
    assert hits["callers", "ping"] == ["（没有命中）"] and hits["search", "foo("] == ["检索模式不合法：foo("] and hits["search", "[a-z"] == ["检索模式不合法：[a-z"]
    assert hits["macro", r"A\E("] == hits["accessors", "(("] == ["（没有命中）"] and len(hits["search", "ping"]) > 3


def test_a_module_has_twelve_queries(spark, tables):
    many = [("M02", "search", f"no{i}") for i in range(15)] + [("M01", "search", "LIMIT")]
    assert len(ask(spark, tables, *many)) == probe.MAX_QUERIES + 1


def test_evidence_of_one_module_shares_a_budget(spark):
    rows = [("M01", n, "search", f"t{n}", None, "x" * 300 + str(i)) for n in range(3) for i in range(25 if n == 0 else 5)]
    hits = spark.createDataFrame(rows, "module_id string, n int, kind string, target string, at struct<file:string,line:bigint>, hit string")
    got = {r["n"]: (len(r["result"]), r["truncated"]) for r in probe.evidence(hits, max_hits=20, max_chars=7000).collect()}
    first = 20 * 301 + 10 + 19
    assert got[0][1] and abs(got[0][0] - first) < 25 and got[1] == (7000 - got[0][0], True) and 2 not in got


def test_tree_with_a_folder_named_like_its_root(spark, tmp_path):
    root = tmp_path / "a b" / "src"
    for name in ("a.c", "lib/src/a.c", "lib/src/z.c", "lib/ü +.h"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"int x; /* {name} */")
    for path in (str(root), f"{root}/", f"file://{root}"):
        assert sorted(r["file"] for r in sources.source_tree(spark, path).collect()) == ["a.c", "lib/src/a.c", "lib/src/z.c", "lib/ü +.h"]


def test_symbol_and_node_tables(lexed):
    kinds = {r["name"]: (r["kind"], r["lines"]) for r in symbols.symbol_table(lexed).filter("module_id = 'M02'").collect()}
    assert kinds == {"ping": ("对外接口", 6), "pong": ("对外接口", 7), "grab": ("对外接口", 3), "g_count": ("全局变量", 1)}
    assert {r["name"]: r["lines"] for r in symbols.graph_nodes(lexed).filter("module_id = 'M02'").collect()} == {"ping": 6, "pong": 7, "grab": 3}
    assert {r["module_id"]: r["macros"] for r in symbols.macro_names(lexed).collect()} == {"M01": ["LIMIT", "SQUARE"], "M02": ["PAIR_H"]}


class Scripted:
    """Answers by schema name: good findings for pair, a bad one for user, plans, and slow rebuttals.

    ``split`` plans that part a call cycle come first; a chunk named ``fail`` never gets an answer.
    """

    def __init__(self, split=0, fail=""):
        self.split, self.fail = split, fail

    def ask(self, schema, prompt):
        def finding(**more):
            return {"file": "pair.c", "line": 11, "severity": "严重", "description": "d", "evidence": "e", "suggestion": "s"} | more

        if schema == "plan":
            again = prompt.count("上一版方案的问题")
            parted = {"summary": "", "strategy": "", "chunks": [{"name": "A", "purpose": "", "functions": ["ping", "nobody"]}, {"name": " ", "purpose": "", "functions": ["pong", "ping"]}]}
            good = {"patterns": ["环"], "summary": "互相调用", "strategy": "按环切", "chunks": [{"name": "A", "purpose": "p", "functions": ["ping", "pong"]}, {"name": "空", "purpose": "", "functions": ["nobody"]}]}
            assert "循环调用组" in prompt and ("M02" not in prompt or "ping、pong" in prompt)
            return json.dumps(parted if self.split > again else good)
        if schema == "findings":
            if self.fail and f"「{self.fail}」" in prompt:
                return "no json"
            if "M03" in prompt:
                return json.dumps({"findings": [finding(), finding(severity="高")]})
            if "M01" in prompt:
                return "{}"
            return "```json\n" + json.dumps({"findings": [finding(line="7", severity="提示"), finding()]}) + "\n```"
        if "可以提出取证请求" in prompt:
            return json.dumps({"items": [{"id": "f1", "conclusion": "维持", "reason": "r"}], "queries": [{"kind": "callers", "target": "pong"}, {"kind": "search", "target": "foo("}]})
        if "概览" in prompt:
            seen = "pair.c:11  ping 调用 pong" in prompt and "检索模式不合法：foo(" in prompt
            return json.dumps({"items": [{"id": "f2", "conclusion": "反驳" if seen else "维持", "reason": "凭证据"}], "queries": [{"kind": "callers", "target": "ping"}]})
        assert "int ping(int n)" in prompt  # the code comes with the findings
        if "f1 " in prompt:
            return json.dumps({"items": [{"id": "f9", "conclusion": "维持", "reason": "r"}, {"id": "f1", "conclusion": "不知", "reason": "r"}, {"id": "f1", "conclusion": "维持", "reason": "r"}, {"id": "f1", "conclusion": "待确认", "reason": "r"}]})
        return json.dumps({"items": [{"id": "f2", "conclusion": "维持", "reason": " "}]})


def test_review_of_small_modules(spark, tree):
    run = review(spark, tree, Scripted(), re_asks=1)
    assert {r["module_id"]: r["reason"] for r in run.failed.collect()} == {"M03": "第 2 条：severity 不在允许的取值内"}
    report = {r["module_id"]: r["report"] for r in run.report.collect()}
    assert set(report) == {"M01", "M02"} and "没有发现" in report["M01"] and "## 分解" not in report["M02"]
    got = {r["id"]: (r["conclusion"], r["reason"]) for r in run.conclusions.collect()}
    assert got == {"f1": ("维持", "r"), "f2": ("待确认", "多次补问后仍无结论")}
    blocks = [line for line in report["M02"].split("\n") if line.startswith("## ")]
    assert blocks == ["## 摘要", "## 概况", "## 维持（1 条）", "## 待确认（1 条）"] and "- 检视意见：2 条（维持 1、待确认 1、已被反驳 0）" in report["M02"]
    assert "- 检视意见：0 条（维持 0、待确认 0、已被反驳 0）" in report["M01"] and "反驳结论：**维持** —— r" in report["M02"]
    assert report["M02"].index("### f1") < report["M02"].index("### f2") and "[pair.c:7](../pair.c#L7)" in report["M02"]
    assert "共 2 条意见" in report["M02"] and "pair.c、pair.h" in report["M02"] and run.evidence.isEmpty() and run.plans.isEmpty()
    assert {(r["id"], r["verdict"]) for r in run.judged.collect()} >= {("f9", "unknown"), ("f1", "conclusion"), ("f1", "accepted"), ("f1", "duplicate"), ("f2", "reason")}
    assert {r["stage"] for r in run.raw.collect()} == {"findings", "rebuttals"}


class Wrong:
    """Findings of a wrong type a few times, then sound ones; every call leaves a file."""

    def __init__(self, folder, reply, times):
        self.folder, self.reply, self.times = folder, reply, times

    def ask(self, schema, prompt):
        import os
        import uuid

        open(os.path.join(self.folder, f"{schema}-{uuid.uuid4()}"), "w").close()
        if schema == "rebuttals":
            return json.dumps({"items": [{"id": "f1", "conclusion": "反驳", "reason": "r"}]})
        if sum(n.startswith("findings") for n in os.listdir(self.folder)) <= self.times:
            return self.reply
        return json.dumps({"findings": [{"file": "pair.c", "line": "2", "severity": "严重", "description": "d", "evidence": "e", "suggestion": "s", "more": 1}]})


class Echo:
    """Answers with the prompt and leaves a file for every call."""

    def __init__(self, folder):
        self.folder = folder

    def ask(self, schema, prompt):
        import uuid

        open(f"{self.folder}/{uuid.uuid4()}", "w").close()
        return prompt


def test_wrong_typed_replies_are_asked_again_and_have_a_place(spark, tmp_path):
    wrong = {
        '{"findings": "none of them fits"}': "findings：应为数组", '{"findings": [1, 2]}': "findings[0]：应为对象", '{"findings": {"file": "x.c"}}': "findings：应为数组", "[1]": "回复：应为对象",
        '{"findings": [{"file": "a.c", "line": 1}]}': "findings[0].severity：缺少字段", '{"findings": [{"file": "a.c", "line": 1.5}]}': "findings[0].line：应为整数", "nothing": "回复：回复中没有可解析的 JSON",
    }
    requests = spark.createDataFrame([("findings", w) for w in wrong], "schema string, prompt string").withColumn("id", F.col("prompt"))
    told = ask_model(requests, Echo(str(tmp_path)), ["id"], backoff=0, check=replies.checker({"findings": FINDINGS})).collect()
    assert {r["id"]: (r["reply"], r["json"], r["error"], r["attempts"]) for r in told} == {w: (w, None, f"ReplyError: {reason}", 3) for w, reason in wrong.items()}
    assert len(list(tmp_path.iterdir())) == 3 * len(wrong)


def test_a_wrong_typed_reply_fails_its_module(spark, tree, tmp_path):
    reply = '{"findings": [1, 2]}'
    run = review(spark, tree, Wrong(str(tmp_path), reply, 9), modules=["M02"], backoff=0)
    assert [tuple(r) for r in run.failed.collect()] == [("M02", "ReplyError: findings[0]：应为对象")] and run.report.isEmpty() and run.findings.isEmpty()
    assert len(list(tmp_path.iterdir())) == 3 and run.raw.first()["reply"] == reply


def test_a_reply_that_fits_at_last_counts(spark, tree, tmp_path):
    run = review(spark, tree, Wrong(str(tmp_path), "[1]", 2), modules=["M02"], backoff=0)
    assert run.failed.isEmpty() and [(r["line"], r["severity"]) for r in run.findings.collect()] == [(2, "严重")]
    assert [(r["id"], r["conclusion"]) for r in run.conclusions.collect()] == [("f1", "反驳")]
    assert "## 已被反驳（1 条）" in run.report.first()["report"] and run.report.first()["report"].count("### ") == 1


class Fragile:
    """Leaves a file for every call; the task dies at one prompt as long as a mark is absent."""

    def __init__(self, folder, dies_at):
        self.folder, self.dies_at = folder, dies_at

    def ask(self, schema, prompt):
        import os
        import uuid

        if prompt == self.dies_at and not os.path.exists(f"{self.folder}/again"):
            open(f"{self.folder}/again", "w").close()
            raise MemoryError("the task is lost")
        open(f"{self.folder}/call-{prompt}-{uuid.uuid4()}", "w").close()
        return "[1]" if prompt == "p3" else json.dumps({"n": prompt[1:]})


def test_a_lost_task_asks_nothing_twice(spark, tmp_path):
    calls, kept = tmp_path / "calls", tmp_path / "ledger"
    calls.mkdir()
    kept.mkdir()
    requests = spark.range(8).coalesce(1).selectExpr("id", "'s' AS schema", "concat('p', id) AS prompt")

    def run():
        asked = ask_model(requests, Fragile(str(calls), "p5"), ["id"], retries=0, check=replies.checker({"s": "n int"}), ledger=Ledger(kept.as_uri()))
        return {r["id"]: (r["json"], r["attempts"]) for r in asked.collect()}

    with pytest.raises(Exception, match="the task is lost"):
        run()
    again = run()
    assert {k: v for k, v in again.items() if k != 3} == {k: (json.dumps({"n": k}), 0 if k < 5 else 1) for k in range(8) if k != 3}
    count = Counter(p.name.split("-")[1] for p in calls.glob("call-*"))
    assert count == {**{f"p{k}": 1 for k in range(8)}, "p3": 2}  # a reply that does not fit is not kept
    assert run()[7] == (json.dumps({"n": 7}), 0) and not list(kept.glob("*/*.*"))


def test_plans_without_a_model(spark, tree):
    run = review(spark, tree, Scripted(9), large_lines=20, modules=["M02"], plan_without_model=True)
    plan = run.plans.first()
    assert plan["violations"] == [] and plan["strategy"] == "按调用关系自动划分" and run.failed.isEmpty()
    parts = sorted((r["file"], r["start"], r["end"]) for r in run.chunks.collect())
    assert parts[0][1] == 1 and parts[-1][2] == 25 and {r["place"] for r in run.places.collect()} == {"too short"}


def test_types_of_replies():
    kind = StructType.fromDDL("n int, big bigint, x double, ok boolean, s string, l array<int>, deep array<struct<a:array<string>>>")
    sound = {"n": "2", "big": 4e3, "x": "1.5", "ok": "yes", "s": "t"}
    assert json.loads(replies.checked(json.dumps(sound), kind)) == {"n": 2, "big": 4000, "x": 1.5, "ok": True, "s": "t", "l": [], "deep": []}
    wrong = [
        ("n", "2.5", "n", replies.NO_INTEGER), ("n", 1 << 31, "n", replies.NO_INTEGER), ("n", None, "n", replies.NO_INTEGER), ("big", 1e300, "big", replies.NO_INTEGER), ("x", "nan", "x", replies.NO_NUMBER),
        ("ok", 2, "ok", replies.NO_BOOLEAN), ("s", 5, "s", replies.NO_TEXT), ("s", None, "s", replies.NO_TEXT), ("l", [1, "x"], "l[1]", replies.NO_INTEGER), ("l", None, "l", replies.NO_LIST),
        ("deep", [{"a": ["x"]}, {"a": ["x", 1]}], "deep[1].a[1]", replies.NO_TEXT), ("deep", [[]], "deep[0]", replies.NO_OBJECT),
    ]
    for name, value, path, reason in wrong:
        with pytest.raises(replies.ReplyError) as found:
            replies.checked(json.dumps(sound | {name: value}), kind)
        assert (found.value.path, found.value.reason) == (path, reason)
    for text in (None, "", "{", '{"n": NaN}', "[" * 100_000):
        with pytest.raises(replies.ReplyError):
            replies.checked(text, kind)


def test_validated_rows(spark):
    rows = spark.createDataFrame([(1, '```\n{"k": true,}\n```', "x"), (2, '{"k": [1]}', "y"), (3, None, "z")], "id int, text string, path string")
    found = {r["id"]: tuple(r)[2:] for r in replies.validated(rows, "text", "k bigint").collect()}
    assert found == {1: ('{"k": 1}', None, None), 2: (None, "k", "应为整数"), 3: (None, "", "回复中没有可解析的 JSON")}
    assert replies.validated(rows.limit(0), "text", "k int").count() == 0


@pytest.mark.parametrize("split, rounds", [(0, 1), (1, 2), (9, 3)])
def test_plans_go_back_with_what_is_wrong(spark, tree, split, rounds):
    run = review(spark, tree, Scripted(split), large_lines=20, modules=["M02"])
    assert run.raw.filter("stage = 'plan'").count() == rounds
    plan = run.plans.first()
    parts = {(r["chunk"], r["start"], r["end"]) for r in run.chunks.collect()}
    if split == 9:  # the limit of redoing is reached: the review goes on and says so
        assert plan["violations"] == ["循环调用组分在几个子块里：ping、pong"] and parts == {("A", 1, 12), ("子块2", 13, 20), ("残余", 21, 25)}
    else:
        assert plan["violations"] == [] and parts == {("A", 1, 20), ("残余", 21, 25)}
    assert plan["unknown"] == ["nobody"]
    report = run.report.first()["report"]
    assert ("方案未达标" in report) == (split == 9) and "## 分解" in report and "nobody" in report


def test_evidence_rounds_and_a_chunk_without_reply(spark, tree, tmp_path):
    run = review(spark, tree, Scripted(fail="残余"), large_lines=20, modules=["M02"], backoff=0)
    assert [(r["module_id"], r["chunk"]) for r in run.incomplete.collect()] == [("M02", "残余")]
    # the module counts as failed although it has a report
    assert [tuple(r) for r in run.failed.collect()] == [("M02", "子块未完成检视: 残余：ReplyError: 回复：回复中没有可解析的 JSON")]
    got = {r["id"]: (r["conclusion"], r["reason"]) for r in run.conclusions.collect()}
    assert got == {"f1": ("维持", "r"), "f2": ("反驳", "凭证据")}
    log = {(r["round"], r["kind"]): r["result"] for r in run.evidence.collect()}
    assert log == {(1, "callers"): "pair.c:11  ping 调用 pong", (1, "search"): "检索模式不合法：foo("}
    assert run.raw.filter("stage = 'rebuttals'").count() == 2  # the last round asks for no more evidence
    report = run.report.first()["report"]
    assert "**未完成的子块**：残余" in report and "按环切" in report and "A（2 个函数 / 20 行）" in report
    from corpusloom.sources import sinks

    sinks.write_review(run, str(tmp_path / "out"))
    stored = spark.read.json(str(tmp_path / "out" / "inventory"))
    again = review(spark, tree, Scripted(), large_lines=20, inventory=stored)
    assert {r["module_id"] for r in again.inventory.collect()} == {"M02"} and again.findings.count() == 4
    sinks.write_review(again, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "evidence")).count() == 4  # the log grows


def test_review_into_leaves_nothing_staged(spark, tree, tmp_path):
    review_into(spark, tree, Scripted(), str(tmp_path / "out"), modules=["M01"])
    assert "没有发现" in "".join(r["value"] for r in spark.read.text(str(tmp_path / "out" / "reports")).collect())
    own = staging.shared_folder(spark).rsplit("/", 1)[0].removeprefix("file:")
    assert not list(Path(own).glob("scope-*"))


def test_modules_and_files_must_exist(spark, tree, tmp_path):
    with pytest.raises(ValueError, match="M77"):
        review(spark, tree, Scripted(), modules=["M01", "M77"])
    other = tmp_path / "other"
    other.mkdir()
    (other / "x.c").write_text("int x;\n")
    with pytest.raises(ValueError, match="pair.c"):
        review(spark, str(other), Scripted(), inventory=sources.module_inventory(sources.modules(sources.source_tree(spark, tree))))


def test_synthetic_modules_as_a_load_run(spark, tmp_path):
    from corpusloom.sources import synthetic

    files = synthetic.corpus(spark, 6, 5)
    lexed = lexer.lexed(files).cache()
    rings = graph.module_cycles(symbols.call_edges(lexed)[0].select("module_id", "src", "dst"), "module_id")
    assert {r["module_id"] for r in rings.collect()} == {"M01", "M04"}


def test_label_table(spark, tmp_path):
    text = "# list\n\n| # | place | class | grade | defect |\n| --- | --- | --- | --- | --- |\n| A1 | ring.c:14-15 | errors | 严重 | two `malloc` |\n| A2 | lib/x.c:47,52 | memory | 致命 | past the end |\n\n| B1 | ring.c:20 | fine |\n"
    (tmp_path / "labels.md").write_text(text)
    rows = [tuple(r) for r in sources.label_table(spark, str(tmp_path / "labels.md")).orderBy("no").collect()]
    assert rows == [("A1", "ring.c", 14, 15, "errors", "严重", "two malloc"), ("A2", "lib/x.c", 47, 52, "memory", "致命", "past the end")]
    assert [tuple(r) for r in sources.decoy_table(spark, str(tmp_path / "labels.md")).collect()] == [("B1", "ring.c", 20, 20, "fine")]
