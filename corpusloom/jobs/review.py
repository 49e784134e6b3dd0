"""Gated model review of source modules: plan, ask, gate, gather evidence, rebut, re-ask what is unanswered, report.

All modules advance together as rows; rounds are a bounded driver loop over DataFrames, each written once in the
shared folder. Replies are checked against their types
where they are asked for, and asked again where they do not fit. Nothing disappears: failed modules end in ``failed``,
chunks without a reply in ``incomplete`` and ``failed``, plans that stay out of bounds in ``plans``, unanswered findings
as pending.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import replies as replies_of
from corpusloom.functions import scalars as S
from corpusloom.jobs.model import BACKOFF, Ledger, ModelClient, ask_model
from corpusloom.operators import evidence, gates, graph, intervals, lexer, planner, probe, relational, search, symbols
from corpusloom.operators import plans as plans_of
from corpusloom.sources import files as sources
from corpusloom.sources import sinks
from corpusloom.sources.staging import scope, staged

FINDINGS = "findings array<struct<file:string,line:bigint,severity:string,description:string,evidence:string,suggestion:string>>"
REBUTTALS = "items array<struct<id:string,conclusion:string,reason:string>>, queries array<struct<kind:string,target:string>>"
PLAN = "patterns array<string>, summary string, strategy string, chunks array<struct<name:string,purpose:string,functions:array<string>>>"
#: Modules with more lines than this are planned into chunks first; rounds of redoing a plan, of asking for missing
#: conclusions, and of judging with evidence (the last of them asks for no more).
LARGE_LINES, PLAN_REDOS, RE_ASKS, PROBE_ROUNDS = 2000, 2, 2, 2
#: Headings and labels of the report (fixed values).
TITLE, SUMMARY, OVERVIEW, CUT = " 检视报告", "## 摘要", "## 概况", "## 分解"
MODULE, FILES, SIZE = "- 模块：", "- 文件：", "- 规模："
PLACE, FIX, VERDICT, EVIDENCE, TOTAL = "- 位置：", "- 修复方案：", "反驳结论：", "证据：", "- 检视意见："
FORM, NO_FORM, JUDGEMENT, STRATEGY, PARTS, UNFINISHED = "形态", "无明显形态", "判断", "分解策略", "子块", "**未完成的子块**"
TRUNCATED, OPEN = "（已截断）", "子块未完成检视: "


@dataclass
class Review:
    """Tables of one run.

    inventory (module_id, module, files, lines, chars, estimated_tokens); findings with ids; conclusions, one per
    finding; failed (module_id, reason), without a report or, where only chunks stayed open, with one; incomplete (module_id, chunk_no, chunk, error); plans (module_id, patterns,
    summary, strategy, violations, unknown); chunks, one row per range of lines; evidence (module_id, round, n, kind,
    target, result, truncated); raw, every reply (module_id, stage, turn, chunk_no, reply, error); judged, every
    rebuttal item with its verdict; places, where the quoted evidence of each finding really stands (module_id, id, place,
    found_file, found_line, share, same_as); report texts.
    """

    inventory: DataFrame
    findings: DataFrame
    conclusions: DataFrame
    failed: DataFrame
    incomplete: DataFrame
    plans: DataFrame
    chunks: DataFrame
    evidence: DataFrame
    raw: DataFrame
    judged: DataFrame
    places: DataFrame
    report: DataFrame


def _asked(requests: DataFrame, model: tuple[ModelClient, float, Ledger | None], keys: list[str], schema: str) -> DataFrame:
    """Checked replies plus ``parsed``, null where ``error`` is set."""
    check = replies_of.checker({"findings": FINDINGS, "rebuttals": REBUTTALS, "plan": PLAN})
    client, backoff, ledger = model
    return ask_model(requests, client, keys, backoff=backoff, check=check, ledger=ledger).withColumn("parsed", F.from_json("json", schema))


def _raw(replies: DataFrame, stage: str, turn: int) -> DataFrame:
    chunk = F.col("chunk_no") if "chunk_no" in replies.columns else F.lit(None).cast("int").alias("chunk_no")
    return replies.select("module_id", F.lit(stage).alias("stage"), F.lit(turn).alias("turn"), chunk, "reply", "error")


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _ordered(order: Column, text: Column, between: str = "\n") -> Column:
    """Aggregate: ``text`` of all rows in ``order``, joined."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), between)


def finding_lines(rows: DataFrame) -> DataFrame:
    """(module_id, digest): each module's findings as text for a prompt, in order of their number."""
    text = F.concat(
        F.format_string("%s [%s] %s:%s\n", "id", "severity", "file", "line"), F.lit("  描述："), "description", F.lit("\n  证据："), "evidence", F.lit("\n  建议："), "suggestion",
    )
    return rows.groupBy("module_id").agg(_ordered(F.col("no"), text).alias("digest"))


# --- plans ----------------------------------------------------------------------------------------------------------


@dataclass
class _Planned:
    chunks: DataFrame
    plans: DataFrame
    failed: DataFrame
    raw: list[DataFrame]


def plan_chunks(model: tuple[ModelClient, float, Ledger | None], lexed: DataFrame, lines: DataFrame, large: DataFrame, cycles: DataFrame, digests: DataFrame, limit: int, edges: DataFrame | None = None) -> _Planned:
    """Plans of large modules; those out of bounds go back to the model with what is wrong, ``PLAN_REDOS`` times.

    ``model`` is a client, the seconds to wait between attempts and a ledger. With ``edges`` (module_id, src, dst), modules that then still have no plan within bounds get one from the call graph.
    """
    functions = staged(symbols.functions(lexed).join(large.select("module_id"), "module_id", "left_semi"), "functions")
    todo = large.select("module_id", "lines", F.lit("").alias("feedback"))
    chunks, plans, failed, raw = [], [], [], []
    last = PLAN_REDOS + (edges is not None)
    for turn in range(last + 1):
        prompt = F.concat(
            F.format_string(f"为模块 %s（%d 行）切分子块，每块不超过 {limit} 行，循环调用组不要拆开。\n", "module_id", "lines"), "overview", F.lit("\n循环调用组：\n"), "cycles",
            F.when(F.col("feedback") != "", F.concat(F.lit("\n上一版方案的问题：\n"), "feedback")).otherwise(F.lit("")),
        )
        asked = todo.join(digests, "module_id").select("module_id", F.lit("plan").alias("schema"), prompt.alias("prompt"))
        if turn > PLAN_REDOS:
            own = [df.join(todo.select("module_id"), "module_id", "left_semi") for df in (functions, edges, lines)]
            good = staged(planner.planned(own[0], own[1], limit, own[2]), "planned")
            # a module without functions has nothing to pack; it becomes one chunk
            bare = todo.select("module_id").join(good.select("module_id"), "module_id", "left_anti")
            good = good.unionByName(bare.withColumn("parsed", F.lit(None).cast(good.schema["parsed"].dataType)))
        else:
            replies = staged(_asked(asked, model, ["module_id"], PLAN), "plans")
            raw.append(_raw(replies, "plan", turn))
            lost = replies.filter("error IS NOT NULL").select("module_id", F.col("error").alias("reason"))
            failed.append(lost)
            good = replies.filter("error IS NULL")
        cut, owners, unknown = plans_of.cut_by_plan(good, functions, lines)
        cut, owners = staged(cut, "cut"), staged(owners, "owners")
        names = unknown.groupBy("module_id").agg(F.array_sort(F.collect_set("name")).alias("unknown"))
        none = F.array().cast("array<string>")
        checked = good.join(plans_of.plan_violations(cut, owners, cycles, limit), "module_id", "left").join(names, "module_id", "left").select(
            "module_id", F.coalesce("parsed.patterns", none).alias("patterns"), F.coalesce("parsed.summary", F.lit("")).alias("summary"), F.coalesce("parsed.strategy", F.lit("")).alias("strategy"),
            F.coalesce("violations", none).alias("violations"), F.coalesce("unknown", none).alias("unknown"),
        )
        checked = staged(checked, "checked")
        done = checked if turn == last else checked.filter(F.size("violations") == 0)
        plans.append(done)
        chunks.append(cut.join(done.select("module_id"), "module_id", "left_semi"))
        if turn == last:
            break
        text = F.array_join(F.transform("violations", lambda v: F.concat(F.lit("- "), v)), "\n")
        back = checked.filter(F.size("violations") > 0).select("module_id", text.alias("feedback"))
        if turn == PLAN_REDOS:
            back, failed = back.unionByName(_all(failed).select("module_id", F.lit("").alias("feedback"))), []
        todo = staged(large.select("module_id", "lines").join(back, "module_id"), "redo")
        if todo.isEmpty():
            break
    unplanned = _all(failed) if failed else large.select("module_id", F.lit("").alias("reason")).limit(0)
    return _Planned(staged(_all(chunks), "chunks"), staged(_all(plans), "plans"), unplanned, raw)


def chunk_sources(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(module_id, chunk_no, chunk, purpose, source): the lines of each chunk under headings, in order of file and line."""
    cut = chunks.join(files.select("module_id", "file", "text"), ["module_id", "file"])
    part = F.concat(F.lit("=== "), "file", F.format_string("（自第 %d 行起）===\n", "start"), intervals.slice_text(F.col("text"), F.col("start"), F.col("end")))
    return cut.groupBy("module_id", "chunk_no", "chunk", "purpose").agg(_ordered(F.struct("file", "start"), part).alias("source"))


def chunk_background() -> Column:
    """What a chunk's prompt says before its code: that the rest is missing, then what the module uses of others."""
    of = F.count("*").over(W.partitionBy("module_id"))
    note = F.format_string("模块已切成 %d 个子块，这里只有「%s」（%s）。其余部分未提供，只写本子块能确证的问题；下列跨模块符号可以引用。", of, F.col("chunk"), F.col("purpose"))
    return F.concat_ws("\n\n", note, F.nullif(F.coalesce("background", F.lit("")), F.lit("")))


# --- the review -----------------------------------------------------------------------------------------------------


def chosen_modules(inventory: DataFrame, modules: list[str] | None) -> DataFrame:
    """Rows of the wanted modules (all without a list); a name that the inventory lacks is an error."""
    if not modules:
        return inventory
    wanted = inventory.sparkSession.createDataFrame([(m,) for m in sorted(set(modules))], "module_id string")
    missing = [r["module_id"] for r in wanted.join(inventory, "module_id", "left_anti").collect()]
    if missing:
        raise ValueError(f"modules that the inventory does not have: {missing}")
    return inventory.join(wanted, "module_id", "left_semi")


def _inputs(spark: SparkSession, root: str, inventory: DataFrame | None, modules: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """(inventory, files with module_id): scanned, or as a stored inventory has them."""
    tree = staged(sources.source_tree(spark, root), "tree")
    if inventory is None:
        named = sources.modules(tree)
        inventory = sources.module_inventory(named)
    inventory = staged(chosen_modules(inventory, modules), "inventory")
    gone = [r["file"] for r in sources.missing_files(inventory, tree).limit(20).collect()]
    if gone:
        raise ValueError(f"the inventory belongs to another tree; missing: {gone}")
    listed = inventory.select("module_id", "module", F.explode("files").alias("file"))
    return inventory, staged(tree.join(listed, "file"), "files")


def review(
    spark: SparkSession, root: str, client: ModelClient, large_lines: int = LARGE_LINES, re_asks: int = RE_ASKS,
    inventory: DataFrame | None = None, modules: list[str] | None = None, backoff: float = BACKOFF, plan_without_model: bool = False,
    ledger: Ledger | None = None,
) -> Review:
    """Review the modules below ``root``: all of them, those of a stored ``inventory``, or the listed ``modules``.

    With ``plan_without_model`` a large module whose plans stay out of bounds, or never come, is cut by its call graph;
    otherwise such plans are used as they are and said so, and a module without one fails. A ``ledger`` keeps replies.
    """
    model = (client, backoff, ledger)
    inventory, files = _inputs(spark, root, inventory, modules)
    lexed = staged(lexer.lexed(files), "lexed")
    lines = staged(intervals.line_table(files.select("module_id", "file", "text").withColumn("k", F.struct("module_id", "file")), "k").select("k.*", "line_no", "line"), "lines")
    edges = staged(symbols.call_edges(lexed)[0], "edges")
    large, small = inventory.filter(F.col("lines") > large_lines), inventory.filter(F.col("lines") <= large_lines)
    cycles = staged(graph.module_cycles(edges.select("module_id", "src", "dst").join(large, "module_id", "left_semi"), "module_id"), "cycles")
    digests = staged(symbols.digests(large.select("module_id"), lexed, edges, cycles), "digests")
    planned = plan_chunks(model, lexed, lines, large, cycles, digests, large_lines, edges if plan_without_model else None)
    chunks, raw = planned.chunks, planned.raw

    background = symbols.backgrounds(lexed)
    code = sources.joined_sources(small, files)
    whole = code.join(background, "module_id", "left").select("module_id", F.lit(0).alias("chunk_no"), F.lit("").alias("title"), F.coalesce("background", F.lit("")).alias("background"), "source")
    parts = chunk_sources(chunks, files).join(background, "module_id", "left")
    parts = parts.select("module_id", "chunk_no", F.format_string(" 的子块「%s」", "chunk").alias("title"), chunk_background().alias("background"), "source")
    prompt = F.concat(F.lit("审查模块 "), "module_id", "title", F.lit("\n背景：\n"), "background", F.lit("\n代码：\n"), "source")
    asked = whole.unionByName(parts).select("module_id", "chunk_no", F.lit("findings").alias("schema"), prompt.alias("prompt"))
    replies = staged(_asked(asked, model, ["module_id", "chunk_no"], FINDINGS), "replies")
    raw.append(_raw(replies, "findings", 0))
    # a small module fails with its one reply; of a large one the other chunks' findings stay
    silent = replies.filter("error IS NOT NULL")
    names = chunks.select("module_id", "chunk_no", "chunk").distinct()
    incomplete = staged(silent.join(names, ["module_id", "chunk_no"]).select("module_id", "chunk_no", "chunk", "error"), "incomplete")
    unanswered = silent.join(small, "module_id", "left_semi").select("module_id", F.col("error").alias("reason")).unionByName(planned.failed)
    found = replies.select("module_id", "chunk_no", F.posexplode("parsed.findings").alias("pos", "f")).select("module_id", "chunk_no", "pos", "f.*")
    arrival = F.row_number().over(W.partitionBy("module_id").orderBy("chunk_no", "pos"))
    numbered = staged(found.withColumn("no", arrival).drop("chunk_no", "pos"), "numbered")
    sound, rejected = gates.all_or_nothing(numbered, "module_id", "no", gates.finding_problem())
    stopped = staged(rejected.unionByName(unanswered).groupBy("module_id").agg(F.min("reason").alias("reason")), "stopped")
    findings = sound.join(stopped, "module_id", "left_anti").withColumn("id", F.concat(F.lit("f"), F.col("no").cast("string")))
    findings = staged(findings, "findings")

    # only large modules ask for evidence; their lines are indexed once for all rounds
    asked_lines = lines.join(large.select("module_id"), "module_id", "left_semi")
    tables = {"edges": edges, "lines": asked_lines, "functions": symbols.functions(lexed), "postings": staged(search.postings(asked_lines), "postings")}
    context = code.select("module_id", F.col("source").alias("context"), F.lit(False).alias("large")).unionByName(
        digests.select("module_id", F.col("overview").alias("context"), F.lit(True).alias("large"))
    )
    answers = spark.createDataFrame([], "module_id string, id string, conclusion string, reason string")
    shown = spark.createDataFrame([], "module_id string, round int, n int, kind string, target string, result string, truncated boolean")
    judged = spark.createDataFrame([], "module_id string, turn int, pos int, id string, conclusion string, reason string, verdict string")
    # large modules have the evidence rounds before the last one in addition
    for turn in range(re_asks + PROBE_ROUNDS):
        final = turn + 1 >= PROBE_ROUNDS
        pending = relational.unanswered(findings, answers, ["module_id", "id"])
        if turn > re_asks:
            pending = pending.join(large, "module_id", "left_semi")
        pending = staged(pending, "pending")
        if pending.isEmpty():
            break  # nothing to ask: no model call
        label = "最后一轮：每条都要有结论，证据不足的判为待确认" if final else f"第 {turn + 1} 轮，可以提出取证请求"
        told = F.concat(F.lit("\n证据：\n"), F.coalesce("evidence", F.lit("（还没有取过证据）")), F.lit(f"\n{label}"))
        prompt = F.concat(F.lit("复核模块 "), "module_id", F.lit("\n"), "digest", F.when(F.col("large"), F.lit("\n概览：\n")).otherwise(F.lit("\n代码：\n")), "context", F.when(F.col("large"), told).otherwise(F.lit("")))
        rows = finding_lines(pending).join(context, "module_id").join(evidence_digest(shown), "module_id", "left")
        got = staged(_asked(rows.select("module_id", "large", F.lit("rebuttals").alias("schema"), prompt.alias("prompt")), model, ["module_id", "large"], REBUTTALS), "rebuttals")
        raw.append(_raw(got, "rebuttals", turn))
        items = got.select("module_id", F.posexplode("parsed.items").alias("pos", "i")).select("module_id", "pos", "i.*")
        open_ids = pending.select("module_id", "id", F.lit(True).alias("open"))
        checks = [(F.col("open"), "unknown"), (F.col("conclusion").isin(S.CONCLUSIONS), "conclusion"), (S.blank_free(F.col("reason")).isNotNull(), "reason")]
        verdicts = gates.row_gate(items.join(open_ids, ["module_id", "id"], "left"), ["module_id", "id"], ["pos"], checks)
        verdicts = staged(verdicts.select("module_id", F.lit(turn).alias("turn"), "pos", "id", "conclusion", "reason", "verdict"), "verdicts")
        judged = judged.unionByName(verdicts)
        answers = staged(answers.unionByName(verdicts.filter("verdict = 'accepted'").select("module_id", "id", "conclusion", "reason")), "answers")
        if not final:
            queries = got.filter("large").select("module_id", F.posexplode("parsed.queries").alias("n", "q")).select("module_id", "n", "q.*").filter("kind IS NOT NULL AND target IS NOT NULL")
            queries = staged(queries, "queries")
            if not queries.isEmpty():
                result = probe.evidence(probe.dispatch(queries, tables))
                shown = staged(shown.unionByName(result.select("module_id", F.lit(turn + 1).alias("round"), "n", "kind", "target", "result", "truncated")), "evidence")
    conclusions = staged(gates.give_up(findings, answers, ["module_id", "id"]), "conclusions")
    # a module with an open chunk has its report and counts as failed all the same
    unfinished = gates.unfinished(incomplete, "module_id", F.col("chunk_no"), F.col("chunk"), F.col("error")).join(stopped, "module_id", "left_anti")
    failed = staged(stopped.unionByName(unfinished.select("module_id", F.concat(F.lit(OPEN), "unfinished").alias("reason"))), "failed")
    report = reports(inventory, findings, conclusions, stopped, chunks, planned.plans, incomplete)
    # a finding whose quote stands elsewhere, or nowhere, stays; the table says so
    places = staged(evidence.located(findings, files), "places")
    places = places.join(evidence.near_equal(findings, places), ["module_id", "id"], "left")
    return Review(inventory, findings, conclusions, failed, incomplete, planned.plans, chunks, shown, _all(raw), judged, places, report)


def review_into(spark: SparkSession, root: str, client: ModelClient, out: str, **options) -> None:
    """``review`` with every table written below ``out``; nothing that was staged on the way stays behind."""
    with scope(spark):
        sinks.write_review(review(spark, root, client, **options), out)


def evidence_digest(shown: DataFrame) -> DataFrame:
    """(module_id, evidence): results of all rounds as text for a prompt."""
    mark = F.when(F.col("truncated"), F.lit(TRUNCATED)).otherwise(F.lit(""))
    text = F.concat(F.format_string("[第 %d 轮 %s %s]", "round", "kind", "target"), mark, F.lit("\n"), "result")
    return shown.groupBy("module_id").agg(_ordered(F.struct("round", "n"), text).alias("evidence"))


# --- the report -----------------------------------------------------------------------------------------------------


def _decomposition(chunks: DataFrame, plans: DataFrame, incomplete: DataFrame) -> DataFrame:
    """(module_id, text): how a large module was cut, what was left out and what the plan misses."""
    sizes = plans_of.chunk_sizes(chunks).groupBy("module_id").agg(_ordered(F.col("chunk_no"), F.format_string("%s（%d 个函数 / %d 行）", "chunk", "functions", "lines"), "、").alias("cut"))
    open_ = gates.unfinished(incomplete, "module_id", F.col("chunk_no"), F.col("chunk"), F.col("error")).withColumnRenamed("unfinished", "open").drop("kept")

    def line(name: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(f"- {name}："), value))

    rows = plans.join(sizes, "module_id", "left").join(open_, "module_id", "left")
    return rows.select("module_id", F.concat_ws(
        "\n", F.lit(f"{CUT}\n"), line(FORM, F.coalesce(F.nullif(F.array_join("patterns", "、"), F.lit("")), F.lit(NO_FORM))), line(JUDGEMENT, F.col("summary")), line(STRATEGY, F.col("strategy")),
        line(PARTS, F.col("cut")), line(UNFINISHED, F.col("open")), line("方案未达标", F.array_join("violations", "；")), line("方案里不存在的函数", F.array_join("unknown", "、")),
    ).alias("text"))


def reports(inventory: DataFrame, findings: DataFrame, conclusions: DataFrame, stopped: DataFrame, chunks: DataFrame, plans: DataFrame, incomplete: DataFrame) -> DataFrame:
    """(module_id, report): summary, overview, decomposition of large modules, then one block with heading and count for
    each conclusion that occurs, its findings by severity (worst first) and arrival. ``stopped`` modules have none."""
    rows = findings.join(conclusions, ["module_id", "id"])
    order = F.struct(S.ranked(F.col("severity"), S.SEVERITIES).alias("a"), F.col("no").alias("b"))
    section = F.concat(
        F.lit("### "), "id", F.lit(" ["), "severity", F.lit("] "), "description", F.lit(f"\n\n{PLACE}"), S.source_link("..", F.col("file"), F.col("line")), F.lit(f"\n{FIX}"), "suggestion",
        F.lit(f"\n\n{VERDICT}**"), "conclusion", F.lit("** —— "), "reason", F.lit(f"\n\n{EVIDENCE}\n\n"), S.indented(F.col("evidence")),
    )
    counts = {title: F.count_if(F.col("conclusion") == c) for title, c in S.BLOCKS.items()}
    blocks = [F.concat(F.format_string(f"## {title}（%d 条）\n\n", counts[title]), _ordered(order, F.when(F.col("conclusion") == c, section), "\n\n")) for title, c in S.BLOCKS.items()]
    grades = [F.count_if(F.col("severity") == s) for s in S.SEVERITIES]
    urgent = F.col("severity").isin(S.SEVERITIES[:2]) & (F.col("conclusion") == S.CONCLUSIONS[0])
    per = rows.groupBy("module_id").agg(
        F.count("*").alias("n"), F.concat_ws("、", *[F.format_string(f"{title} %d", n) for title, n in counts.items()]).alias("by_conclusion"),
        F.concat_ws("、", *[F.when(n > 0, F.format_string(f"{s} %d", n)) for s, n in zip(S.SEVERITIES, grades, strict=True)]).alias("by_severity"),
        _ordered(F.col("no"), F.when(urgent, F.col("id")), "、").alias("urgent"), F.concat_ws("\n\n", *[F.when(counts[t] > 0, b) for t, b in zip(S.TITLES, blocks, strict=True)]).alias("blocks"),
    )
    whole = inventory.join(stopped, "module_id", "left_anti").join(per, "module_id", "left").join(_decomposition(chunks, plans, incomplete), "module_id", "left")
    summary = F.when(F.col("n").isNull(), F.lit("没有发现需要报告的问题。")).otherwise(F.concat(
        F.format_string("共 %d 条意见：%s；等级：%s。", "n", "by_conclusion", "by_severity"), F.when(F.col("urgent") != "", F.concat(F.lit("请先处理 "), "urgent", F.lit("。"))).otherwise(F.lit("")),
    ))
    overview = F.concat(
        F.lit(f"{OVERVIEW}\n\n{MODULE}"), "module_id", F.lit("（"), "module", F.lit(f"）\n{FILES}"), F.array_join("files", "、"), F.format_string(f"\n{SIZE}%d 行 / %d 字符 / 约 %d Token", "lines", "chars", "estimated_tokens"),
        F.lit(f"\n{TOTAL}"), F.when(F.col("n").isNotNull(), F.format_string("%d 条（%s）", "n", "by_conclusion")).otherwise(F.lit("0 条（" + "、".join(f"{t} 0" for t in S.TITLES) + "）")),
    )
    return whole.select("module_id", F.concat_ws("\n\n", F.concat(F.lit("# "), "module_id", F.lit(TITLE)), F.lit(SUMMARY), summary, overview, "text", "blocks").alias("report"))
