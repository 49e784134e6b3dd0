"""Registered queries over the driver tables and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import replies
from corpusloom.functions import scalars as S
from corpusloom.operators import gates, graph, intervals, matching, planner, plans, probe, relational
from corpusloom.sources.staging import staged
from corpusloom.streaming import sessions, timeouts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call-graph edges of the event tables: (user_id, src, dst) where an event's value rises to the user's next event."""
    from pyspark.sql import Window as W

    line = W.partitionBy("user_id").orderBy("ts", "event_id")
    led = _t(spark, sf_dir, "events").select("user_id", "event_type", "value", F.lead("event_type").over(line).alias("dst"), F.lead("value").over(line).alias("after"))
    return led.filter("dst IS NOT NULL AND after > value * 3").select("user_id", F.col("event_type").alias("src"), "dst").distinct()


_MOVES = """
WITH led AS (SELECT user_id, event_id, event_type AS src, value,
    lead(event_type) OVER w AS dst, lead(value) OVER w AS after
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
moves AS (SELECT DISTINCT user_id, src, dst FROM led WHERE dst IS NOT NULL AND after > value * 3)
"""


def _calls(spark: SparkSession, sf_dir: str, module: str) -> DataFrame:
    """Call-graph edges of the order tables: (module, src, dst). Each order calls its customer's next one, and is called
    back by it where both have one priority; ``module`` is c_nationkey or o_custkey, nodes are orders."""
    from pyspark.sql import Window as W

    orders = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    line = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    led = orders.withColumns({"next": F.lead("o_orderkey").over(line), "after": F.lead("o_orderpriority").over(line)}).filter("next IS NOT NULL")
    customers = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    if module == "c_nationkey":
        led = led.join(customers, "o_custkey")
    ahead, back = F.struct(F.col("o_orderkey").alias("s"), F.col("next").alias("d")), F.struct(F.col("next").alias("s"), F.col("o_orderkey").alias("d"))
    both = F.when(F.col("after") == F.col("o_orderpriority"), F.array(ahead, back)).otherwise(F.array(ahead))
    return led.select(F.col(module).cast("string").alias("module"), F.inline(both)).select("module", F.col("s").cast("string").alias("src"), F.col("d").cast("string").alias("dst"))


_CALLS = """
line AS (SELECT {module} AS module, o_orderkey AS k, o_orderpriority AS p, lead(o_orderkey) OVER w AS nxt, lead(o_orderpriority) OVER w AS after
  FROM orders JOIN customer ON o_custkey = c_custkey WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
calls AS (SELECT module::VARCHAR AS module, k::VARCHAR AS src, nxt::VARCHAR AS dst FROM line WHERE nxt IS NOT NULL
  UNION ALL SELECT module::VARCHAR, nxt::VARCHAR, k::VARCHAR FROM line WHERE nxt IS NOT NULL AND after = p)
"""
_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_ASCII = r"(length(text) - length(regexp_replace(text, '[\x00-\x7F]', '', 'g')))"
_LINES = r"(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR right(text, 1) = chr(10) THEN 0 ELSE 1 END)"
_INVENTORY = f"""
WITH sums AS (SELECT source, count(*) AS files, sum({_LINES})::BIGINT AS lines, sum(length(text))::BIGINT AS chars,
    sum({_ASCII})::BIGINT AS ascii FROM documents GROUP BY source),
inventory AS (SELECT printf('M%02d', row_number() OVER (ORDER BY source)) AS id, source AS name, files, lines, chars,
    (round_even(ascii / 4.0, 0) + chars - ascii)::BIGINT AS estimated_tokens FROM sums)
"""


# --- inventory and routing ------------------------------------------------------------------------------------------


@_query(_INVENTORY + "SELECT * FROM inventory")
def q_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.inventory(_t(spark, sf_dir, "documents").select("source", "text"))


@_query(_INVENTORY + "SELECT CASE WHEN lines > 200 THEN 'large' ELSE 'small' END AS route, count(*) AS modules, sum(lines)::BIGINT AS lines FROM inventory GROUP BY 1")
def q_size_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.size_routes(q_inventory(spark, sf_dir), 200)


# --- joins ----------------------------------------------------------------------------------------------------------


@_query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def q_unanswered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source")
    return relational.unanswered(docs, _t(spark, sf_dir, "labels"), ["doc_id"])


@_query("""
WITH last AS (SELECT doc_id, arg_max(CASE quality WHEN 1 THEN '维持' ELSE '已被反驳' END, (quality, toxic)) AS c FROM labels GROUP BY doc_id)
SELECT d.doc_id, d.source, coalesce(c, '待确认') AS conclusion FROM documents d LEFT JOIN last USING (doc_id)""")
def q_left_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source")
    answers = _t(spark, sf_dir, "labels")
    stand = F.when(F.col("quality") == 1, S.TITLES[0]).otherwise(S.TITLES[2])
    return relational.concluded(docs, answers, ["doc_id"], stand, F.struct("quality", "toxic"))


@_query("""
WITH names AS (SELECT source, unnest(regexp_extract_all(lower(text), '(?m)^([a-z]+)', 1)) AS word FROM documents),
sole AS (SELECT word, min(source) AS owner FROM names GROUP BY word HAVING count(DISTINCT source) = 1),
uses AS (SELECT DISTINCT source, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)
SELECT u.source, u.word, s.owner FROM uses u JOIN sole s USING (word) WHERE u.source <> s.owner""")
def q_cross_module_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("source", "text")
    # a document defines the words that begin its lines
    names = docs.select("source", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("(?m)^([a-z]+)"), F.lit(1)))).alias("word"))
    uses = docs.select("source", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("word")).distinct()
    index = relational.sole_owner(names, "word", "source")
    return relational.foreign_uses(uses, index, "word", "source")


_TOKENS = """
WITH tokens AS (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS token FROM documents),
known AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS token FROM benchmark)
"""


def _doc_tokens(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tokens = _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("token"))
    known = _t(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("token")).distinct()
    return tokens, known


@_query(_TOKENS + "SELECT doc_id, count(*) AS n FROM tokens WHERE token IN (SELECT token FROM known) GROUP BY doc_id")
def q_known_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens, known = _doc_tokens(spark, sf_dir)
    return relational.resolved(tokens, known, ["token"])[0].groupBy("doc_id").agg(F.count("*").alias("n"))


@_query(_TOKENS + "SELECT doc_id, count(*) AS n FROM tokens WHERE token NOT IN (SELECT token FROM known) GROUP BY doc_id")
def q_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens, known = _doc_tokens(spark, sf_dir)
    return relational.resolved(tokens, known, ["token"])[2].groupBy("doc_id").agg(F.count("*").alias("n"))


@_query(r"""
WITH calls AS (SELECT unnest(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*)[ \t\n]*\.', 1)) AS name FROM documents)
SELECT name, count(*) AS n FROM calls GROUP BY name""")
def q_call_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = S.names_before(F.col("text"), r"\.")
    return _t(spark, sf_dir, "documents").select(F.explode(calls).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@_query("""
SELECT u.conv_id, a.turn, u.turn AS matched FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id
WHERE a.role = 'assistant' AND u.role = 'user' AND abs(a.turn - u.turn) <= 1""")
def q_label_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    findings, truth = turns.filter("role = 'assistant'").drop("role"), turns.filter("role = 'user'").drop("role")
    found = relational.close_matches(findings, truth, ["conv_id"], "turn", 1)
    return found.select("conv_id", "turn", F.col("_truth").alias("matched"))


@_query("""
SELECT l_orderkey AS o_orderkey, l_linenumber AS line, l_suppkey, (ceil(l_quantity / 10) - 1)::INT AS grade, left(o_orderpriority, 1)::INT - 1 AS expected
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE abs(l_linenumber - 2) <= 1 AND abs((ceil(l_quantity / 10) - 1)::INT - (left(o_orderpriority, 1)::INT - 1)) <= 1""")
def q_label_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("line"), "l_suppkey", (F.ceil(F.col("l_quantity") / 10) - 1).cast("int").alias("grade"))
    truth = _t(spark, sf_dir, "orders").select("o_orderkey", F.lit(2).alias("line"), S.ranked(F.col("o_orderpriority"), _PRIORITIES).alias("grade"))
    found = relational.close_matches(findings, truth, ["o_orderkey"], "line", 1, "grade", 1)
    return found.select("o_orderkey", "line", "l_suppkey", "grade", F.col("_grade").alias("expected"))


@_query("""
SELECT o_orderpriority AS priority, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 60 DAY GROUP BY 1""")
def q_interval_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").cast("timestamp"))
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp"), "o_orderpriority")
    items = items.select("o_orderkey", F.unix_micros("l_shipdate").alias("shipped"))
    spans = orders.select("o_orderkey", F.unix_micros("o_orderdate").alias("first"), F.unix_micros(F.expr("o_orderdate + INTERVAL 60 DAYS")).alias("last"), "o_orderpriority")
    # positions are microseconds; a stretch of a hundred days holds most spans whole
    near = intervals.covering(items, spans, ["o_orderkey"], "shipped", "first", "last", stretch=100 * 86_400_000_000)
    return near.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))


_SIDES = """
WITH items AS (SELECT l_orderkey, l_returnflag AS flag, l_linenumber AS line, floor(l_quantity / 13)::INT AS grade, l_suppkey || ':' || l_partkey AS id FROM lineitem),
near AS (SELECT DISTINCT a.l_orderkey AS k, a.line AS a_line, a.id AS a, b.line AS b_line, b.id AS b FROM items a JOIN items b
  ON a.l_orderkey = b.l_orderkey AND a.flag = 'N' AND b.flag = 'R' AND abs(a.line - b.line) <= 1 AND abs(a.grade - b.grade) <= 1),
placed AS (SELECT *, dense_rank() OVER (PARTITION BY k ORDER BY a_line, a) - 1 AS i, dense_rank() OVER (PARTITION BY k ORDER BY b_line, b) - 1 AS j FROM near),
"""
#: Which rows of one side the largest matchings keep, earlier ones first: the rank of every prefix is the least, over
#: its subsets, of the rows outside the subset and the rows near it.
_KEPT = """
{s}_near AS (SELECT k, {i} AS p, any_value({s}) AS id, bit_or(1::BIGINT << {j}::INT) AS seen FROM placed GROUP BY k, {i}),
{s}_sizes AS (SELECT k, count(*) AS c FROM {s}_near GROUP BY k),
{s}_masks AS (SELECT n.k, m, count(*) AS taken, bit_or(seen) AS seen FROM {s}_near n JOIN {s}_sizes USING (k), range(1, 1::BIGINT << c::INT) r(m) WHERE m & (1::BIGINT << p::INT) > 0 GROUP BY n.k, m),
{s}_ranks AS (SELECT k, q, least(q, min(q - taken + bit_count(seen)) FILTER (m < 1::BIGINT << q::INT)) AS r FROM {s}_masks JOIN {s}_sizes USING (k), range(0, c + 1) g(q) GROUP BY k, q),
{s}_kept AS (SELECT n.k, n.id FROM {s}_near n JOIN {s}_ranks a ON a.k = n.k AND a.q = n.p JOIN {s}_ranks b ON b.k = n.k AND b.q = n.p + 1 WHERE b.r > a.r)
"""
_MATCHED = _SIDES + _KEPT.format(s="a", i="i", j="j").strip() + ",\n" + _KEPT.format(s="b", i="j", j="i").strip()


def _labelled_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings, truths, decoys) of the order lines: a flag says which a line is, an order is a file."""
    items = _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_returnflag", F.concat(F.col("l_suppkey").cast("string"), F.lit(":"), F.col("l_partkey").cast("string")).alias("id"), F.col("l_linenumber").alias("line"),
        F.floor(F.col("l_quantity") / 13).cast("int").alias("grade"), F.col("l_linenumber").alias("order"),
    )
    places = lambda flag: items.filter(F.col("l_returnflag") == flag).drop("l_returnflag").withColumnRenamed("line", "first_line").withColumn("last_line", F.lit(None).cast("int"))
    return items.filter("l_returnflag = 'N'").drop("l_returnflag"), places("R"), places("A")


@_query(_MATCHED + """
SELECT l_orderkey, CASE flag WHEN 'N' THEN 'finding' ELSE 'truth' END AS side, items.id, (a_kept.id IS NOT NULL OR b_kept.id IS NOT NULL) AS matched FROM items
LEFT JOIN a_kept ON flag = 'N' AND a_kept.k = l_orderkey AND a_kept.id = items.id LEFT JOIN b_kept ON flag = 'R' AND b_kept.k = l_orderkey AND b_kept.id = items.id WHERE flag IN ('N', 'R')""")
def q_label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings, truths, _ = _labelled_items(spark, sf_dir)
    pairs = matching.one_to_one(findings, truths, ["l_orderkey"], within=1)
    # a pair gives two rows, one for each side
    both = F.filter(F.array(F.struct(F.lit("finding").alias("side"), F.col("finding").alias("id")), F.struct(F.lit("truth").alias("side"), F.col("truth").alias("id"))), lambda x: x["id"].isNotNull())
    return pairs.select("l_orderkey", F.inline(both), (F.col("finding").isNotNull() & F.col("truth").isNotNull()).alias("matched"))


@_query(_MATCHED + """,
judged AS (SELECT i.*, (flag = 'N' AND EXISTS (SELECT 1 FROM a_kept a WHERE a.k = l_orderkey AND a.id = i.id)) OR (flag = 'R' AND EXISTS (SELECT 1 FROM b_kept b WHERE b.k = l_orderkey AND b.id = i.id)) AS hit,
  flag = 'A' AND EXISTS (SELECT 1 FROM items f WHERE f.flag = 'N' AND f.l_orderkey = i.l_orderkey AND abs(f.line - i.line) <= 1
    AND NOT EXISTS (SELECT 1 FROM a_kept a WHERE a.k = f.l_orderkey AND a.id = f.id)) AS caught FROM items i),
summed AS (SELECT grade, count(*) FILTER (flag = 'N') AS findings, count(*) FILTER (flag = 'N' AND hit) AS right_, count(*) FILTER (flag = 'R') AS truths, count(*) FILTER (flag = 'R' AND hit) AS found, 0 AS decoys, 0 AS decoys_hit FROM judged WHERE flag <> 'A' GROUP BY grade
  UNION ALL SELECT NULL, count(*) FILTER (flag = 'N'), count(*) FILTER (flag = 'N' AND hit), count(*) FILTER (flag = 'R'), count(*) FILTER (flag = 'R' AND hit), count(*) FILTER (flag = 'A'), count(*) FILTER (caught) FROM judged)
SELECT grade, findings, right_ AS "right", truths, found, decoys::BIGINT AS decoys, decoys_hit::BIGINT AS decoys_hit, right_ / nullif(findings, 0) AS precision, found / nullif(truths, 0) AS recall FROM summed""")
def q_label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings, truths, decoys = _labelled_items(spark, sf_dir)
    pairs = staged(matching.one_to_one(findings, truths, ["l_orderkey"], within=1), "pairs")
    hits = matching.decoy_hits(findings, decoys, pairs, ["l_orderkey"], ["l_orderkey"], within=1)
    return matching.scores(findings, truths, pairs, ["l_orderkey"], hits)


# --- windows --------------------------------------------------------------------------------------------------------

_OWNERS = """
SELECT event_id, user_id, {owner} AS owner FROM events
WINDOW ahead AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
       behind AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""
_AHEAD = "first_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER ahead"
_BEHIND = "last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER behind"


def _owners(spark: SparkSession, sf_dir: str, tail: bool) -> DataFrame:
    events = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    owner = F.when(F.col("event_type") == "error", F.col("event_id"))
    return intervals.next_owner(events, "user_id", ["ts", "event_id"], owner, tail).select("event_id", "user_id", "owner")


@_query(_OWNERS.format(owner=_AHEAD))
def q_line_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _owners(spark, sf_dir, False)


@_query(_OWNERS.format(owner=f"coalesce({_AHEAD}, {_BEHIND})"))
def q_line_owner_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _owners(spark, sf_dir, True)


@_query("""
WITH marked AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS s FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
grouped AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM marked)
SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS first, arg_max(event_id, (ts, event_id)) AS last, count(*) AS n
FROM grouped GROUP BY user_id, run, event_type""")
def q_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return intervals.runs(events, "user_id", ["ts", "event_id"], "event_type", "event_id")


@_query("""
WITH span AS (SELECT conv_id, min(turn) AS low, max(turn) AS high FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT c.conv_id, c.turn, c.role FROM conversations c JOIN span USING (conv_id) WHERE c.turn BETWEEN low AND high""")
def q_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return intervals.inside_span(turns, "conv_id", "turn", F.col("role") == "user")


@_query("""
WITH marks AS (SELECT page_id, generate_subscripts(m, 1) AS i, unnest(m) AS c FROM (SELECT page_id, regexp_extract_all(html, '[<>]') AS m FROM pages)),
sums AS (SELECT page_id, i, sum(CASE c WHEN '>' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY i) AS s FROM marks),
depth AS (SELECT page_id, i, s - least(0, min(s) OVER (PARTITION BY page_id ORDER BY i)) AS d FROM sums)
SELECT p.page_id, coalesce(arg_max(d, i), 0)::INT AS final, coalesce(max(d), 0)::INT AS deepest FROM pages p LEFT JOIN depth USING (page_id) GROUP BY p.page_id""")
def q_clamped_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth = _t(spark, sf_dir, "pages").select("page_id", intervals.bracket_depth(F.col("html"), ">", "<").alias("d"))
    return depth.select("page_id", "d.final", "d.deepest")


@_query("""
WITH spent AS (SELECT conv_id, turn, length(text) AS size,
  coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations)
SELECT conv_id, turn, least(size, 1000 - before)::BIGINT AS keep, size > 1000 - before AS truncated FROM spent WHERE before < 1000""")
def q_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return relational.within_budget(turns, "conv_id", ["turn"], F.col("size"), 1000).select("conv_id", "turn", "keep", "truncated")


@_query("""
WITH ranked AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
  count(*) OVER (PARTITION BY user_id) AS c FROM events)
SELECT user_id, event_id, rn, c > 20 AS truncated FROM ranked WHERE rn <= 20""")
def q_topn_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return relational.top_per_key(events, "user_id", ["ts", "event_id"], 20).select("user_id", "event_id", "rn", "truncated")


@_query("""
WITH gaps AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
runs AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM gaps)
SELECT user_id, min(ts) AS started, count(*) AS n FROM runs GROUP BY user_id, run""")
def q_idle_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.idle_sessions(_t(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "ts", "30 minutes")


# --- distinct, counts, order ----------------------------------------------------------------------------------------


@_query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def q_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.first_and_copies(_t(spark, sf_dir, "documents"), F.col("text"), "doc_id")


@_query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def q_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_first_seen(spark, sf_dir).filter("copies > 1")


@_query("""
SELECT user_id, count(*) FILTER (event_type = 'signup') AS n_signup, count(*) FILTER (event_type = 'purchase') AS n_purchase,
  count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'error') AS n_error,
  count(*) FILTER (event_type = 'view') AS n_view FROM events GROUP BY user_id""")
def q_pivot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events").select("user_id", "event_type")
    return relational.counts_by(events, "user_id", "event_type", ["signup", "purchase", "click", "error", "view"])


@_query("""
SELECT o_orderpriority AS severity, (left(o_orderpriority, 1)::INT - 1) AS rank, count(*) AS n FROM orders GROUP BY o_orderpriority""")
def q_severity_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("severity"))
    return relational.graded_counts(orders, "severity", _PRIORITIES)


@_query("""
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey
  ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderpriority, o_orderkey) AS position FROM orders""")
def q_report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    block, severity = S.ranked(F.col("o_orderstatus"), ["F", "O", "P"]), S.ranked(F.col("o_orderpriority"), _PRIORITIES)
    return relational.report_order(orders, "o_custkey", block, severity, "o_orderkey").select("o_custkey", "o_orderkey", "position")


@_query("SELECT count(*) AS n, min(o_orderkey) AS first FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F'")
def q_urgent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.urgent(_t(spark, sf_dir, "orders"), "o_orderpriority", _PRIORITIES[:2], F.col("o_orderstatus") == "F", "o_orderkey")


@_query("""
SELECT 'union' AS op, count(*) AS n FROM (SELECT l_orderkey FROM lineitem UNION SELECT o_orderkey FROM orders)
UNION ALL SELECT 'except', count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem)""")
def q_setops(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    orders = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return relational.setop_counts([("union", items.union(orders).distinct()), ("except", orders.subtract(items)), ("intersect", orders.intersect(items))])


# --- graphs ---------------------------------------------------------------------------------------------------------

_REACH = "WITH RECURSIVE " + _CALLS + """
, reach AS (SELECT module, src, dst FROM calls UNION SELECT r.module, r.src, c.dst FROM reach r JOIN calls c ON r.module = c.module AND r.dst = c.src)
"""
_GROUPS = """
, mutual AS (SELECT a.module, a.src, min(b.src) AS label FROM reach a JOIN reach b ON a.module = b.module AND a.src = b.dst AND a.dst = b.src GROUP BY 1, 2)
"""


@_query(_REACH.format(module="c_nationkey") + "SELECT module, src, dst FROM reach")
def q_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(_calls(spark, sf_dir, "c_nationkey"), "module")


@_query(_REACH.format(module="c_nationkey") + _GROUPS + "SELECT module, label, string_agg(src, '、' ORDER BY src) AS members FROM mutual GROUP BY module, label")
def q_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = graph.label_groups(graph.strong_labels(_calls(spark, sf_dir, "c_nationkey"), "module"), "module")
    return groups.withColumn("members", F.array_join("members", "、"))


@_query(_REACH.format(module="o_custkey") + _GROUPS + """
SELECT module, (row_number() OVER (PARTITION BY module ORDER BY label))::INT AS group_no, string_agg(src, '、' ORDER BY src) AS members FROM mutual GROUP BY module, label""")
def q_module_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.module_cycles(_calls(spark, sf_dir, "o_custkey"), "module").withColumn("members", F.array_join("members", "、"))


@_query(_MOVES + "SELECT user_id, src, string_agg(dst, '、' ORDER BY dst) AS callees FROM moves GROUP BY user_id, src")
def q_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.adjacency(_moves(spark, sf_dir), "user_id")


_PROBES = _MOVES + """
, edges AS (SELECT user_id, src, dst, min(event_id) AS line FROM led WHERE dst IS NOT NULL AND after > value * 3 GROUP BY 1, 2, 3),
asked AS (SELECT user_id, n, kind, target FROM (SELECT DISTINCT user_id FROM edges),
  (VALUES (0, 'callers', 'error'), (1, 'callees', 'error'), (2, 'search', '^pur|-> si'), (3, 'fields', 'error'), (4, 'callers', 'nobody'), (5, 'search', 'foo(')) q(n, kind, target)),
told AS (SELECT user_id, line, src, dst, 'u' || user_id || '.c:' || line || '  ' AS place FROM edges),
hits AS (SELECT a.*, line, place || src || ' 调用 ' || dst AS hit FROM asked a JOIN told USING (user_id) WHERE (kind = 'callers' AND dst = target) OR (kind = 'callees' AND src = target)
  UNION ALL SELECT a.*, line, place || src || ' -> ' || dst FROM asked a JOIN told USING (user_id) WHERE n = 2 AND (src LIKE 'pur%' OR dst LIKE 'si%')),
answers AS (SELECT * FROM hits UNION ALL SELECT a.*, NULL, CASE n WHEN 3 THEN '不支持的取证类型：fields' WHEN 5 THEN '检索模式不合法：foo(' ELSE '（没有命中）' END
  FROM asked a WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.user_id = a.user_id AND h.n = a.n))
"""


def _probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to six queries about the moves of each user: a user is a module, a move is an edge and a line."""
    from pyspark.sql import Window as W

    line = W.partitionBy("user_id").orderBy("ts", "event_id")
    led = _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", F.lead("event_type").over(line).alias("dst"), F.lead("value").over(line).alias("after"))
    moves = led.filter("dst IS NOT NULL AND after > value * 3").groupBy(F.col("user_id").alias("module_id"), F.col("event_type").alias("src"), "dst").agg(F.min("event_id").alias("line"))
    edges = moves.withColumn("file", F.concat(F.lit("u"), F.col("module_id").cast("string"), F.lit(".c")))
    queries = [("callers", "error"), ("callees", "error"), ("search", "^pur|-> si"), ("fields", "error"), ("callers", "nobody"), ("search", "foo(")]
    asks = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(k).alias("kind"), F.lit(t).alias("target")) for n, (k, t) in enumerate(queries)])
    # the moves are few per user; written once, they are read as edges and as lines
    saved = staged(edges, "moves")
    lines = saved.select("module_id", "file", F.col("line").alias("line_no"), F.concat("src", F.lit(" -> "), "dst").alias("line"))
    asked = saved.select("module_id").distinct().select("module_id", F.inline(asks))
    return probe.dispatch(asked, {"edges": saved, "lines": lines})


@_query(_PROBES + "SELECT user_id, n, kind, target, hit FROM answers")
def q_probe_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probed(spark, sf_dir).select(F.col("module_id").alias("user_id"), "n", "kind", "target", "hit")


@_query(_PROBES + """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, n ORDER BY line, hit) AS rn FROM answers),
made AS (SELECT user_id, n, string_agg(hit, chr(10) ORDER BY rn) FILTER (rn <= 3) AS text, max(rn) > 3 AS more FROM ranked GROUP BY user_id, n),
spent AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM made)
SELECT user_id, n, left(text, (150 - before)::BIGINT) AS result, more OR length(text) > 150 - before AS truncated FROM spent WHERE before < 150""")
def q_probe_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe.evidence(_probed(spark, sf_dir), max_hits=3, max_chars=150).select(F.col("module_id").alias("user_id"), "n", "result", "truncated")


# --- gates ----------------------------------------------------------------------------------------------------------


@_query("""
WITH bad AS (SELECT conv_id, turn, CASE WHEN role NOT IN ('user', 'assistant', 'system') THEN 'role' WHEN trim(text) = '' THEN 'blank'
  WHEN length(text) > 1500 THEN 'long' END AS problem FROM conversations)
SELECT conv_id, arg_min('第 ' || turn || ' 条：' || problem, turn) AS reason FROM bad WHERE problem IS NOT NULL GROUP BY conv_id""")
def q_gate_all_or_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.first_problem(_t(spark, sf_dir, "conversations"), "conv_id", "turn", _turn_problem())


def _turn_problem():
    known = F.col("role").isin("user", "assistant", "system")
    return F.when(~known, "role").when(F.trim("text") == "", "blank").when(F.length("text") > 1500, "long")


@_query("""
WITH bad AS (SELECT conv_id FROM conversations WHERE role NOT IN ('user', 'assistant', 'system') OR trim(text) = '' OR length(text) > 1500)
SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM bad)""")
def q_gate_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    sound, _ = gates.all_or_nothing(_t(spark, sf_dir, "conversations"), "conv_id", "turn", _turn_problem())
    return sound.select("conv_id", "turn")


@_query("""
WITH judged AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN o_orderkey IS NULL THEN 'not pending' WHEN l_returnflag NOT IN ('A', 'N') THEN 'conclusion'
    WHEN l_quantity < 5 THEN 'reason' END AS bad
  FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(bad, CASE WHEN row_number() OVER (PARTITION BY l_orderkey, bad IS NULL ORDER BY l_linenumber, l_partkey, l_suppkey) > 1 THEN 'duplicate' ELSE 'accepted' END) AS verdict
FROM judged""")
def q_gate_per_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    pending = _t(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("pending"))
    checks = [(F.col("pending"), "not pending"), (F.col("l_returnflag").isin("A", "N"), "conclusion"), (F.col("l_quantity") >= 5, "reason")]
    items, pending = gates.dealt(items, pending, ["l_orderkey"])
    judged = gates.row_gate(items.join(pending, "l_orderkey", "left"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], checks)
    return judged.select("l_orderkey", "l_linenumber", "l_partkey", "verdict")


@_query("""
WITH found AS (SELECT doc_id, CASE quality WHEN 1 THEN '维持' ELSE '已被反驳' END AS conclusion, '标注' AS reason FROM labels)
SELECT doc_id, conclusion, reason FROM found UNION ALL
SELECT doc_id, '待确认', '多次补问后仍无结论' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def q_give_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    stand = F.when(F.col("quality") == 1, S.TITLES[0]).otherwise(S.TITLES[2])
    answers = _t(spark, sf_dir, "labels").select("doc_id", stand.alias("conclusion"), F.lit("标注").alias("reason"))
    return gates.give_up(_t(spark, sf_dir, "documents").select("doc_id"), answers, ["doc_id"])


_PLAN = """
WITH first AS (SELECT l_partkey, arg_min(l_suppkey, (l_orderkey, l_linenumber, l_suppkey)) AS s FROM lineitem GROUP BY l_partkey),
plan AS (SELECT p_partkey, coalesce(s::VARCHAR, '残余') AS chunk FROM part LEFT JOIN first ON p_partkey = l_partkey)
"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").cast("string").alias("supplier"), "l_orderkey", "l_linenumber", "l_suppkey")
    order = [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")]
    return gates.repaired_plan(claims, _t(spark, sf_dir, "part").select("p_partkey"), ["p_partkey"], order, "supplier")


@_query(_PLAN + "SELECT p_partkey, chunk FROM plan")
def q_plan_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


@_query(_PLAN + """
SELECT l_orderkey, count(DISTINCT chunk) AS owners FROM lineitem JOIN plan ON l_partkey = p_partkey GROUP BY l_orderkey HAVING count(DISTINCT chunk) > 1""")
def q_group_split_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(_plan(spark, sf_dir), "p_partkey")
    return gates.split_groups(members, ["l_orderkey"], "chunk")


_YEARS = """
WITH placed AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderpriority, year(o_orderdate) - 1990 AS chunk_no, day(o_orderdate) AS lines FROM orders),
sizes AS (SELECT o_custkey, chunk_no, count(*) AS functions, sum(lines)::BIGINT AS lines FROM placed GROUP BY 1, 2),
runs AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS run FROM placed),
groups AS (SELECT o_custkey, min(o_orderkey::VARCHAR) AS label, string_agg(o_orderkey::VARCHAR, '、' ORDER BY o_orderkey::VARCHAR) AS members, count(DISTINCT chunk_no) AS owners
  FROM runs GROUP BY o_custkey, o_orderpriority, run HAVING count(*) > 1)
"""


def _years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan of each customer's orders: a year is a chunk, an order a function of as many lines as its day of month."""
    orders, day = _t(spark, sf_dir, "orders"), F.dayofmonth("o_orderdate").cast("long")
    year = (F.year("o_orderdate") - 1990).alias("chunk_no")
    in_year = orders.select(F.col("o_custkey").cast("string").alias("module_id"), year, F.col("o_orderkey").cast("string").alias("file"), F.lit(1).alias("start"), day.alias("end"))
    return in_year.withColumn("chunk", F.concat(F.lit("y"), F.col("chunk_no").cast("string")))


@_query(_YEARS + "SELECT o_custkey::VARCHAR AS module_id, chunk_no, lines FROM sizes")
def q_chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.chunk_sizes(_years(spark, sf_dir).withColumn("functions", F.lit(1))).select("module_id", F.col("chunk_no").cast("long").alias("chunk_no"), "lines")


@_query(_YEARS + """
, found AS (SELECT o_custkey, 0 AS part, printf('%09d', chunk_no) AS o, '子块「y' || chunk_no || '」有 ' || lines || ' 行，超过 40 行' AS text FROM sizes WHERE lines > 40
  UNION ALL SELECT o_custkey, 1, label, '循环调用组分在几个子块里：' || members FROM groups WHERE owners > 1)
SELECT o_custkey::VARCHAR AS module_id, string_agg(text, ';' ORDER BY part, o) AS violations FROM found GROUP BY o_custkey""")
def q_plan_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _years(spark, sf_dir).withColumn("functions", F.lit(1))
    cycles = graph.module_cycles(_calls(spark, sf_dir, "o_custkey").withColumnRenamed("module", "module_id"), "module_id")
    owners = chunks.select("module_id", F.col("file").alias("name"), "chunk_no")
    found = plans.plan_violations(chunks, owners, cycles, 40)
    return found.select("module_id", F.array_join("violations", ";").alias("violations"))


@_query(_REACH.format(module="o_custkey") + """
, mutual AS (SELECT a.module, a.src AS name, min(a.dst) AS unit FROM reach a JOIN reach b ON a.module = b.module AND a.src = b.dst AND a.dst = b.src GROUP BY 1, 2),
member AS (SELECT o_custkey::VARCHAR AS module_id, o_orderkey::VARCHAR AS name, coalesce(unit, o_orderkey::VARCHAR) AS unit, day(o_orderdate) AS lines FROM orders LEFT JOIN mutual ON module = o_custkey::VARCHAR AND name = o_orderkey::VARCHAR),
sized AS (SELECT module_id, unit, sum(lines) AS lines FROM member GROUP BY ALL)
SELECT module_id, count(DISTINCT name) AS functions, count(DISTINCT unit) AS units, (SELECT count(*) FROM sized s WHERE s.module_id = m.module_id AND s.lines > 40) AS too_large, 0::BIGINT AS split, 0::BIGINT AS over
FROM member m GROUP BY module_id""")
def q_packed_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of each customer's orders from their calls: units above the limit, and, none of either, units that are split
    and chunks above the limit that hold more than one unit."""
    orders = _t(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("module_id"), F.col("o_orderkey").cast("string").alias("name"), F.dayofmonth("o_orderdate").cast("long").alias("end_line"))
    functions = orders.select("module_id", F.col("name").alias("file"), "name", F.lit(1).cast("long").alias("line"), "end_line")
    edges = _calls(spark, sf_dir, "o_custkey").withColumnRenamed("module", "module_id")
    lines = functions.select("module_id", "file", F.col("end_line").alias("line_no"))
    chunks = staged(planner.packed(functions, edges, 40, lines), "packed")
    placed = orders.join(chunks, ["module_id", "name"], "left")
    units = placed.groupBy("module_id", "unit").agg(F.count("*").alias("n"), F.sum("end_line").alias("lines"), F.count_distinct("chunk_no").alias("chunks"), F.min("chunk_no").alias("chunk_no"))
    full = units.groupBy("module_id", "chunk_no").agg(F.sum("lines").alias("lines"), F.count("*").alias("units"), F.sum("n").alias("n"), F.count_if(F.col("lines") > 40).alias("large"), F.count_if(F.col("chunks") != 1).alias("split"))
    return full.groupBy("module_id").agg(
        F.sum("n").alias("functions"), F.sum("units").alias("units"), F.sum("large").alias("too_large"), F.sum("split").alias("split"), F.count_if((F.col("lines") > 40) & (F.col("units") > 1)).alias("over"),
    )


@_query("""
SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R') AS kept, string_agg(l_linenumber || '：' || l_linestatus, '；' ORDER BY l_linenumber, l_linestatus) FILTER (l_returnflag = 'R') AS unfinished
FROM lineitem GROUP BY l_orderkey""")
def q_unfinished(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("string").alias("unit"), F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).alias("error"))
    return gates.unfinished(items, "l_orderkey", F.struct("l_linenumber", "error"), F.col("unit"), F.col("error"))


@_query("""
SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS digest, arg_max(role, turn) FILTER (role <> 'system') AS finish, arg_min(length(text), turn) FILTER (role = 'assistant') AS usage
FROM conversations GROUP BY conv_id""")
def q_reply_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _t(spark, sf_dir, "conversations")
    finish, usage = F.when(F.col("role") != "system", F.col("role")), F.when(F.col("role") == "assistant", F.length("text").cast("long"))
    folded = gates.folded_replies(turns.select("conv_id", "turn", "text", finish.alias("finish"), usage.alias("usage")), ["conv_id"], "turn")
    return folded.select("conv_id", F.md5("reply").alias("digest"), "finish", "usage")


@_query("""
SELECT conv_id, count(*) AS chunks, md5(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role <> 'user'), '')) AS reply, md5(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'user'), '')) AS reasoning,
  coalesce(round_even(sum(length(text)) FILTER (role = 'user') * 100.0 / nullif(sum(length(text)), 0), 0), 0)::INT AS reasoning_pct
FROM conversations GROUP BY conv_id""")
def q_reply_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    channel = F.when(F.col("role") == "user", "reasoning").otherwise("text").alias("channel")
    deltas = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "text", channel, F.lit(None).cast("string").alias("finish"), F.lit(None).cast("long").alias("usage"))
    folded = gates.folded_replies(deltas, ["conv_id"], "turn")
    return folded.select("conv_id", "chunks", F.md5("reply").alias("reply"), F.md5("reasoning").alias("reasoning"), "reasoning_pct")


@_query("""
WITH line AS (SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS reply, ts, CASE event_type WHEN 'signup' THEN 'asked' WHEN 'purchase' THEN 'done' ELSE 'chunk' END AS kind, event_id FROM events),
seen AS (SELECT *, ts + CASE kind WHEN 'asked' THEN INTERVAL 3 HOUR ELSE INTERVAL 90 MINUTE END AS due, coalesce(lead(ts) OVER w, TIMESTAMP '2024-02-01') AS next,
  bool_or(kind = 'done') OVER (PARTITION BY reply ORDER BY ts, array_position(['asked', 'chunk', 'done'], kind) ROWS UNBOUNDED PRECEDING) AS closed,
  count(*) FILTER (kind = 'chunk') OVER (PARTITION BY reply ORDER BY ts, array_position(['asked', 'chunk', 'done'], kind) ROWS UNBOUNDED PRECEDING) AS chunks
  FROM line WINDOW w AS (PARTITION BY reply ORDER BY ts, array_position(['asked', 'chunk', 'done'], kind)))
SELECT reply, due AS failed_at, CASE kind WHEN 'asked' THEN 'first' ELSE 'next' END AS phase, chunks
FROM seen WHERE NOT closed AND next > due QUALIFY row_number() OVER (PARTITION BY reply ORDER BY ts, array_position(['asked', 'chunk', 'done'], kind)) = 1""")
def q_late_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a user's day is a reply
    events, at = _t(spark, sf_dir, "events"), F.col("ts").cast("timestamp")
    kind = F.when(F.col("event_type") == "signup", "asked").when(F.col("event_type") == "purchase", "done").otherwise("chunk")
    reply = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd"))
    found = timeouts.late_replies(events.select(reply.alias("reply"), kind.alias("kind"), at.alias("at")), F.lit("2024-02-01").cast("timestamp"), 3 * 3600, 90 * 60)
    return found.withColumn("failed_at", F.col("failed_at").cast("timestamp_ntz"))


# --- scalar functions -----------------------------------------------------------------------------------------------


@_query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def q_json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", S.json_field(F.col("props"), "k", "bigint").alias("k"))


@_query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def q_json_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    # replies as models give them: fenced, wrapped in prose, or with a trailing comma
    events = _t(spark, sf_dir, "events").select("event_id", "event_type", "props")
    loose = F.regexp_replace("props", r"\}$", ",}")
    reply = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("```json\n"), loose, F.lit("\n```")))
        .when(F.col("event_type") == "view", F.concat(F.lit("结果如下："), F.col("props"), F.lit(" 完毕")))
        .when(F.col("event_type") == "error", F.concat(F.lit("result: "), loose)).otherwise(F.col("props"))
    )
    return events.select("event_id", F.try_variant_get(S.extracted_variant(reply), "$.k", "bigint").alias("k"))


@_query("""
WITH sent AS (SELECT event_id, event_type, (props->>'$.k')::BIGINT AS k FROM events)
SELECT event_id, CASE WHEN event_type IN ('click', 'signup') THEN k END AS k, CASE event_type WHEN 'view' THEN 'items[1].k' WHEN 'error' THEN 'items' WHEN 'purchase' THEN 'items[0].k' END AS path,
  CASE event_type WHEN 'view' THEN '缺少字段' WHEN 'error' THEN '应为数组' WHEN 'purchase' THEN '应为整数' END AS reason FROM sent""")
def q_reply_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    # replies of the right type, as text, with a field missing, without a list, and with half a number
    events = _t(spark, sf_dir, "events").select("event_id", "event_type", "props")
    k = F.regexp_extract("props", r"-?\d+", 0)
    bodies = {"click": ('{"items": [', "props", "], }"), "signup": ('{"items": [{"k": "', k, '"}]}'), "view": ('{"items": [', "props", ', {"n": 1}]}'), "error": ('{"items": ', "props", "}"), "purchase": ('{"items": [{"k": ', k, ".5}]}")}
    reply = F.lit(None).cast("string")
    for kind, (before, middle, after) in bodies.items():
        reply = F.when(F.col("event_type") == kind, F.concat(F.lit(before), middle, F.lit(after))).otherwise(reply)
    told = replies.validated(events.select("event_id", reply.alias("reply")), "reply", "items array<struct<k:bigint>>")
    return told.select("event_id", F.from_json("json", "items array<struct<k:bigint>>")["items"][0]["k"].alias("k"), "path", "reason")


@_query("SELECT doc_id, len(list_filter(list_transform(string_split(text, ','), lambda x: trim(x, ' ')), lambda x: x <> ''))::INT AS n FROM documents")
def q_csv_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(S.csv_items(F.col("text"))).alias("n"))


@_query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'), '^ | $', '', 'g')) AS digest FROM documents")
def q_collapse_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(S.collapse_blanks(F.col("text"))).alias("digest"))


@_query("SELECT doc_id, 'lang=' || coalesce(nullif(trim(lang), ''), 'xx') || ';from=' || coalesce(nullif(trim(source), ''), '') || ';${OTHER}' AS text FROM documents")
def q_env_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = F.lit("lang=${LANG:-xx};from=${SRC};${OTHER}")
    return _t(spark, sf_dir, "documents").select("doc_id", S.expanded(template, {"LANG": F.col("lang"), "SRC": F.col("source")}).alias("text"))


@_query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^/@]*@', ''), '/+$', '') AS bare FROM pages")
def q_url_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", S.scrubbed_url(F.col("url")).alias("bare"))


@_query("SELECT doc_id, CASE WHEN length(text) <= 60 THEN text ELSE left(text, 60) || '…（共 ' || length(text) || ' 字）' END AS digest FROM documents")
def q_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", S.digest(F.col("text")).alias("digest"))


@_query("SELECT conv_id, turn, '    ' || replace(text, chr(10), chr(10) || '    ') AS block FROM conversations")
def q_indent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", S.indented(F.col("text")).alias("block"))


@_query("SELECT conv_id, turn, '[' || role || '.c:' || (turn + 1) || '](src/' || role || '.c#L' || (turn + 1) || ')' AS link FROM conversations")
def q_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _t(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", S.source_link("src", F.concat("role", F.lit(".c")), F.col("turn") + 1).alias("link"))


@_query("SELECT doc_id, array_to_string(regexp_extract_all(text, '(?m)^([A-Za-z]+)', 1), ',') AS heads FROM documents")
def q_macro_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(S.line_heads(F.col("text")), ",").alias("heads"))


@_query("""
WITH ls AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
hit AS (SELECT doc_id, l, list_position(list_transform(l, lambda x: regexp_matches(x, '[,;] [a-z]+ing')), true) AS p FROM ls)
SELECT doc_id, left(array_to_string(l[p:p + 9], chr(10)), 240) AS context FROM hit WHERE p > 0""")
def q_context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    return docs.select("doc_id", intervals.context(F.col("text"), "[,;] [a-z]+ing").alias("context")).filter("context IS NOT NULL")


@_query("SELECT doc_id, array_to_string((string_split(text, chr(10)))[2:3], chr(10)) AS slice FROM documents")
def q_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", intervals.slice_text(F.col("text"), F.lit(2), F.lit(3)).alias("slice"))


@_query("""
SELECT c_custkey, coalesce(CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END, CASE WHEN n_regionkey <> 2 THEN n_name END,
  CASE WHEN c_acctbal > 0 THEN r_name END, 'none') AS setting
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def q_config_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = (
        _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    )
    layers = [F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")), F.when(F.col("n_regionkey") != 2, F.col("n_name")), F.when(F.col("c_acctbal") > 0, F.col("r_name"))]
    return rows.select("c_custkey", relational.layered(*layers, builtin=F.lit("none")).alias("setting"))


@_query("SELECT page_id, try_cast(regexp_extract(url, '/([^/?#]*)[^/]*$', 1) AS BIGINT) AS number FROM pages")
def q_safe_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", S.whole_number(F.regexp_extract("url", r"/([^/?#]*)[^/]*$", 1)).alias("number"))


@_query("""
WITH w AS (SELECT max(length(n_name)) AS a, max(length(r_name)) AS b FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT n_nationkey, rpad(n_name, a::INT, ' ') || '  ' || rpad(r_name, b::INT, ' ') AS line FROM nation JOIN region ON n_regionkey = r_regionkey, w""")
def q_fixed_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return relational.fixed_width(rows.select("n_nationkey", "n_name", "r_name"), ["n_name", "r_name"], "n_nationkey")


@_query("""
WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)
SELECT event_type, n, repeat('█', round_even(n * 20.0 / (SELECT sum(n) FROM c), 0)::INT) AS bar FROM c""")
def q_distribution_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("event_type", "n", S.bar(F.col("n") / total).alias("bar"))


@_query("""
SELECT s_nationkey, CASE WHEN s_nationkey % 5 > 0 THEN s_nationkey % 5 ELSE greatest(least(count(*), 4), 1) END::BIGINT AS workers FROM supplier GROUP BY s_nationkey""")
def q_worker_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _t(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    return counts.select("s_nationkey", S.worker_count((F.col("s_nationkey") % 5).cast("long"), F.col("n")).alias("workers"))


@_query("""
SELECT page_id, array_to_string(list_filter([CASE WHEN url LIKE 'https%' THEN 'tls' END, CASE WHEN url LIKE '%www.%' THEN 'www' END,
  CASE WHEN url LIKE '%utm%' THEN 'tracked' END], lambda x: x IS NOT NULL), ' · ') AS summary FROM pages""")
def q_summary_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.when(F.col("url").like(p), n) for p, n in (("https%", "tls"), ("%www.%", "www"), ("%utm%", "tracked"))]
    return _t(spark, sf_dir, "pages").select("page_id", F.concat_ws(" · ", *parts).alias("summary"))
