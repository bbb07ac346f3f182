"""Named queries of the engine and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import dates, jsons, secure, text
from tidemill.operators import catalog, sync
from tidemill.plans import envelope, preview, rounds

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark)
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""SELECT 0 AS line_no, 'columns:n_nationkey,n_name,n_regionkey' AS line UNION ALL
SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS INTEGER), concat_ws(',', coalesce(n_nationkey::VARCHAR, 'null'), coalesce(n_name, 'null'), coalesce(n_regionkey::VARCHAR, 'null'))
FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 10)""")
def preview_render(t, spark: SparkSession) -> DataFrame:
    return text.rendered(preview.preview(t("nation"), 10, ["n_nationkey"]))


LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


@query(f"SELECT * FROM lineitem ORDER BY {', '.join(LINE_KEYS)} LIMIT 100")
def preview_ordered(t, spark) -> DataFrame:
    return preview.preview(t("lineitem"), 100_000, LINE_KEYS)


@query("SELECT * FROM part WHERE p_name LIKE '%a%' ORDER BY p_partkey LIMIT 20 OFFSET 40")
def keyword_page(t, spark) -> DataFrame:
    return catalog.page(catalog.keyword(t("part"), "p_name", "a"), 3, 20, "p_partkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%e_%'")
def keyword_wildcard(t, spark) -> DataFrame:
    return catalog.keyword(t("part"), "p_name", "e_").select("p_partkey", "p_name")


@query("SELECT count(*) AS total FROM orders WHERE o_orderpriority LIKE '%U%' AND o_orderstatus = 'O'")
def condition_count(t, spark) -> DataFrame:
    return catalog.count_rows(catalog.conditions(t("orders"), {"o_orderpriority": "U"}, {"o_orderstatus": "O", "o_custkey": None}))


@query("""SELECT c_mktsegment, count(*) AS total, 1 AS page, CASE WHEN 1 < ceil(count(*) / 20.0) THEN 2 END AS next_page FROM customer GROUP BY c_mktsegment""")
def next_page_token(t, spark) -> DataFrame:
    df = t("customer").groupBy("c_mktsegment").agg(F.count("*").alias("total"))
    return df.select("c_mktsegment", "total", F.lit(1).alias("page"), catalog.next_page_column(F.lit(1), F.lit(20), F.col("total")).alias("next_page"))


@query("SELECT o.* FROM orders o JOIN (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders GROUP BY o_custkey) m ON o.o_custkey = m.k AND o.o_orderkey = m.v")
def latest_version(t, spark) -> DataFrame:
    return catalog.latest(t("orders"), "o_custkey", "o_orderkey")


@query("""SELECT o.o_custkey, o.o_orderkey, o.o_orderpriority FROM orders o JOIN (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders GROUP BY o_custkey) m ON o.o_custkey = m.k AND o.o_orderkey = m.v
WHERE o.o_orderpriority LIKE '%U%' ORDER BY o.o_orderdate DESC, o.o_orderkey LIMIT 20 OFFSET 20""")
def latest_keyword_page(t, spark) -> DataFrame:
    newest = catalog.keyword(catalog.latest(t("orders"), "o_custkey", "o_orderkey"), "o_orderpriority", "U")
    return catalog.page(newest, 2, 20, F.desc("o_orderdate"), "o_orderkey").select("o_custkey", "o_orderkey", "o_orderpriority")


@query("SELECT count(*) AS total FROM (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '%U%' GROUP BY o_custkey)")
def group_count(t, spark) -> DataFrame:
    return catalog.group_count(catalog.keyword(t("orders"), "o_orderpriority", "U"), "o_custkey")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def latest_pointer(t, spark) -> DataFrame:
    return catalog.latest_pointer(t("orders"), "o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS INTEGER) AS position FROM orders")
def version_history(t, spark) -> DataFrame:
    return catalog.version_history(t("orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("SELECT user_id, coalesce(max(event_id), 0) + 1 AS next_number FROM events GROUP BY user_id")
def next_number(t, spark) -> DataFrame:
    return catalog.next_number(t("events"), "user_id", "event_id")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence_num FROM events")
def sequence_assign(t, spark) -> DataFrame:
    return catalog.assign_sequence(t("events").select("user_id", "event_id"), "user_id", "event_id")


@query("SELECT conv_id, turn, role FROM conversations WHERE turn > 2")
def replay_after(t, spark) -> DataFrame:
    return catalog.after_offset(t("conversations"), "turn", 2).select("conv_id", "turn", "role")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def soft_delete_live(t, spark) -> DataFrame:
    flagged = t("orders").withColumn("is_deleted", (F.col("o_orderstatus") == "F").cast("short"))
    return catalog.live(flagged).select("o_orderkey", "o_orderstatus")


@query("SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def unique_violations(t, spark) -> DataFrame:
    return catalog.unique_violations(t("part"), "p_name")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_refs(t, spark) -> DataFrame:
    return catalog.missing_refs(t("documents").select("doc_id"), t("labels"), "doc_id")


@query("SELECT s_suppkey, count(l_suppkey) AS refs, count(l_suppkey) = 0 AS deletable FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_suppkey")
def ref_count_guard(t, spark) -> DataFrame:
    return catalog.reference_counts(t("supplier"), t("lineitem"), "s_suppkey", "l_suppkey")


@query("""SELECT o_orderkey, r_name, CASE WHEN c_custkey IS NULL OR c_acctbal < 0 THEN 'customer' WHEN n_nationkey IS NULL THEN 'nation' WHEN r_name IS NULL OR r_name = 'ASIA' THEN 'region' END AS failed_link
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def resolve_chain(t, spark) -> DataFrame:
    chain = catalog.resolve_chain(
        t("orders"),
        (t("customer"), F.col("o_custkey") == F.col("c_custkey"), "customer", F.col("c_custkey").isNotNull() & (F.col("c_acctbal") >= 0)),
        (t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "nation", F.col("n_nationkey").isNotNull()),
        (t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "region", F.col("r_name").isNotNull() & (F.col("r_name") != "ASIA")),
    )
    return chain.select("o_orderkey", "r_name", "failed_link")


@query("SELECT CAST(w.pos AS INTEGER) AS position, s_suppkey, s_name FROM supplier JOIN (VALUES (0, 7), (1, 3), (2, 99999), (3, 7), (4, 1)) w(pos, id) ON s_suppkey = w.id")
def id_list_lookup(t, spark) -> DataFrame:
    return catalog.id_list_lookup(t("supplier"), "s_suppkey", [7, 3, 99_999, 7, 1]).select("position", "s_suppkey", "s_name")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def allow_list(t, spark) -> DataFrame:
    grants = t("lineitem").filter("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return catalog.allowed(t("supplier"), "s_suppkey", grants).select("s_suppkey", "s_name")


def _snapshots(t):
    """Every order on both sides; a fifth of the remote ones are renamed, so that they are new there and gone here."""
    names = t("orders").select(F.col("o_orderpriority").alias("schema_name"), F.col("o_orderkey").cast("string").alias("table_name"), F.col("o_orderstatus").alias("table_comment"), "o_orderkey")
    remote = names.withColumn("table_name", F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("new"), "table_name")).otherwise(F.col("table_name")))
    remote = remote.withColumn("table_comment", F.when(F.col("o_orderkey") % 7 == 0, "changed").otherwise(F.col("table_comment")))
    return remote.drop("o_orderkey"), names.drop("o_orderkey")


_DIFF_SQL = """WITH r AS (SELECT o_orderpriority AS schema_name, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE '' END || o_orderkey AS table_name, CASE WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE o_orderstatus END AS c FROM orders),
l AS (SELECT o_orderpriority AS schema_name, o_orderkey::VARCHAR AS table_name, o_orderstatus AS c FROM orders),
d AS (SELECT coalesce(r.schema_name, l.schema_name) AS schema_name, coalesce(r.table_name, l.table_name) AS table_name,
CASE WHEN l.table_name IS NULL THEN 'insert' WHEN r.table_name IS NULL THEN 'remove' WHEN r.c IS DISTINCT FROM l.c THEN 'update' ELSE 'keep' END AS action, r.c AS remote_value, l.c AS local_value
FROM r FULL OUTER JOIN l ON r.schema_name = l.schema_name AND r.table_name = l.table_name) """


@query(_DIFF_SQL + "SELECT * FROM d")
def catalog_diff(t, spark) -> DataFrame:
    return sync.diff(*_snapshots(t), ["schema_name", "table_name"], "table_comment")


@query(_DIFF_SQL + "SELECT action, count(*) AS n FROM d GROUP BY action")
def catalog_diff_counters(t, spark) -> DataFrame:
    return sync.counters(sync.diff(*_snapshots(t), ["schema_name", "table_name"], "table_comment"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, 10 > 0 AND NOT coalesce(10 >= CAST(json_extract_string(props, '$.k') AS INTEGER), false) AS has_more FROM events")
def json_extract(t, spark) -> DataFrame:
    total = jsons.total_count(F.col("props"), "$.k")
    return t("events").select("event_id", total.alias("k"), jsons.has_more(F.lit(10), total).alias("has_more"))


@query("""SELECT event_id, CAST(0 AS INTEGER) AS position, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events UNION ALL SELECT event_id, CAST(1 AS INTEGER), CAST(event_id AS BIGINT) FROM events""")
def json_explode(t, spark) -> DataFrame:
    """Each event's body is an array of its own two objects, so no row grows with the table."""
    bodies = t("events").select("event_id", F.concat(F.lit("["), "props", F.lit(',{"k":'), F.col("event_id").cast("string"), F.lit("}]")).alias("body"))
    return jsons.exploded(bodies, "body", "struct<k:bigint>").select("event_id", "position", F.col("row.k").alias("k"))


@query("""SELECT event_id, CASE json_type(props) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'string' END AS props_type, CASE WHEN json_type(json_extract(props, '$.k')) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' ELSE 'string' END AS k_type FROM events""")
def json_field_types(t, spark) -> DataFrame:
    parsed = F.parse_json("props")
    return t("events").select("event_id", jsons.type_label_column(parsed).alias("props_type"), jsons.type_label_column(F.variant_get(parsed, "$.k", "variant")).alias("k_type"))


_SECRET_SQL = "(CASE doc_id % 3 WHEN 0 THEN 'sk-ab_' || doc_id || '-x ' WHEN 1 THEN 'Bearer  tok.' || doc_id || ' ' ELSE '' END || text)"


def _with_secrets(t) -> DataFrame:
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("sk-ab_"), F.col("doc_id").cast("string"), F.lit("-x "))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Bearer  tok."), F.col("doc_id").cast("string"), F.lit(" "))).otherwise("")
    return t("documents").select("doc_id", F.concat(head, "text").alias("text"))


_MASK_SQL = rf"regexp_replace(regexp_replace({_SECRET_SQL}, '(sk-)[\w-]+', '\1***', 'g'), '(Bearer\s+)\S+', '\1***', 'g')"


@query(f"SELECT doc_id, {_MASK_SQL} AS masked FROM documents")
def mask_secrets(t, spark) -> DataFrame:
    return _with_secrets(t).select("doc_id", text.mask_secrets(F.col("text")).alias("masked"))


@query(f"SELECT doc_id, CASE WHEN length(m) > 2000 THEN substr(m, 1, 2000) || '...(truncated)' ELSE m END AS sanitized FROM (SELECT doc_id, {_MASK_SQL} AS m FROM documents)")
def sanitize(t, spark) -> DataFrame:
    return _with_secrets(t).select("doc_id", text.sanitize(F.col("text")).alias("sanitized"))


@query("""SELECT doc_id, left(text, 1000) AS head, CASE WHEN length(text) > 1000 THEN chr(10) || '...[中间省略 ' || (length(text) - 1000 - least(length(text) - 1000, 1000)) || ' 字符]...' || chr(10) || right(text, least(length(text) - 1000, 1000)::BIGINT)
|| chr(10) || '...[输出已截断，共 ' || length(text) || ' 字符，仅保留首尾各 1000 字符]...' || chr(10) END AS tail FROM documents""")
def head_tail(t, spark) -> DataFrame:
    return t("documents").select("doc_id", text.window_head(F.col("text"), 1000).alias("head"), text.window_tail(F.col("text"), 1000).alias("tail"))


@query(r"SELECT c_custkey, c_name, regexp_full_match(c_name, '[\p{Han}a-zA-Z][\p{Han}a-zA-Z0-9_-]{0,63}') AS valid FROM customer UNION ALL SELECT p_partkey, p_name, regexp_full_match(p_name, '[\p{Han}a-zA-Z][\p{Han}a-zA-Z0-9_-]{0,63}') FROM part")
def name_grammar(t, spark) -> DataFrame:
    names = t("customer").select("c_custkey", "c_name").union(t("part").select("p_partkey", "p_name"))
    return names.withColumn("valid", text.valid_name(F.col("c_name"), 64))


@query("SELECT doc_id, sha256(text) AS digest, octet_length(encode(text)) BETWEEN 1 AND 5000 AS size_ok FROM documents")
def sha_digest(t, spark) -> DataFrame:
    content = F.col("text").cast("binary")
    return t("documents").select("doc_id", F.sha2(content, 256).alias("digest"), secure.size_ok(content, 5000).alias("size_ok"))


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS output FROM conversations GROUP BY conv_id")
def output_concat(t, spark) -> DataFrame:
    return rounds.ordered_concat(t("conversations"), ["conv_id"], "text", "turn", "output")


@query("SELECT user_id, event_type, string_agg(props, '' ORDER BY event_id) AS args FROM events GROUP BY user_id, event_type")
def tool_args_concat(t, spark) -> DataFrame:
    return rounds.ordered_concat(t("events"), ["user_id", "event_type"], "props", "event_id", "args")


@query("""WITH m AS (SELECT user_id, event_id, ts, event_type, lag(event_type) OVER w AS before, lag(ts) OVER w AS started FROM events WHERE event_type IN ('click', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, greatest((epoch_us(ts) - epoch_us(started)) // 1000, 0) AS duration_ms FROM m WHERE event_type = 'purchase' AND before = 'click'""")
def span_pairing(t, spark) -> DataFrame:
    paired = rounds.pair_spans(t("events"), ["user_id"], F.col("event_type") == "click", F.col("event_type") == "purchase", "event_id", "ts")
    return paired.select("user_id", "event_id", dates.duration_ms(F.col("start_time"), F.col("ts")).alias("duration_ms"))


_SPANS_SQL = "SELECT 'r' || r_regionkey AS span_id, NULL::VARCHAR AS parent_span_id FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation"


@query(f"""WITH RECURSIVE s AS ({_SPANS_SQL}), tree AS (SELECT span_id, parent_span_id, 0 AS depth, span_id AS path FROM s WHERE parent_span_id IS NULL
UNION ALL SELECT s.span_id, s.parent_span_id, tree.depth + 1, tree.path || '/' || s.span_id FROM s JOIN tree ON s.parent_span_id = tree.span_id) SELECT * FROM tree""")
def span_tree(t, spark) -> DataFrame:
    roots = t("region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"))
    below = t("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))
    return rounds.span_tree(roots.union(below))


_STEPS = (("view", "click"), ("click", "purchase"), ("signup", "view"), ("error", "view"), ("view", "view"))


@query(f"""WITH m AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS previous_state FROM events)
SELECT * FROM m WHERE previous_state IS NOT NULL AND (previous_state, event_type) NOT IN ({', '.join(map(str, _STEPS))})""")
def state_transitions(t, spark) -> DataFrame:
    return rounds.illegal_transitions(t("events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type", _STEPS)


_SIGNAL_OF = {"purchase": "AGENT_END", "error": "ERROR", "signup": "EXCEED_MAX_ITERS", "view": "TEXT_DELTA", "click": "MODEL_CALL_START"}
_SIGNAL_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SIGNAL_OF.items()) + " END"


def _signals(t) -> DataFrame:
    """Events as signals: users are sessions, each of one round."""
    kinds = F.create_map(*(F.lit(x) for pair in _SIGNAL_OF.items() for x in pair))
    null = lambda kind: F.lit(None).cast(kind)
    return t("events").select(
        F.col("user_id").cast("string").alias("session_id"), F.lit("1").alias("round_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kinds[F.col("event_type")].alias("type"), F.col("props").alias("text"),
        null("string").alias("block_id"), null("string").alias("tool_call_id"), null("string").alias("tool_name"), null("string").alias("tool_state"), null("string").alias("result_text"), null("int").alias("input_tokens"), null("int").alias("output_tokens"), null("string").alias("model_name"),
    )


@query(f"""WITH s AS (SELECT user_id::VARCHAR AS session_id, '1' AS round_id, event_id AS seq, {_SIGNAL_SQL} AS type FROM events),
e AS (SELECT session_id, round_id, min(seq) FILTER (type IN ('AGENT_END', 'ERROR')) AS ended_seq, arg_min(type, seq) FILTER (type IN ('AGENT_END', 'ERROR')) AS t, min(seq) FILTER (type = 'EXCEED_MAX_ITERS') AS l FROM s GROUP BY ALL)
SELECT session_id, round_id, ended_seq, CASE t WHEN 'AGENT_END' THEN 'DONE' WHEN 'ERROR' THEN 'ERROR' END AS state,
CASE WHEN t = 'ERROR' THEN 'error' WHEN t = 'AGENT_END' AND l < ended_seq THEN 'max_iterations' WHEN t = 'AGENT_END' THEN 'stop' END AS stop_reason,
CASE WHEN t = 'AGENT_END' THEN 'COMPLETED' WHEN t IS NULL THEN 'RUNNING' ELSE 'FAILED' END AS status FROM e""")
def terminal_winner(t, spark) -> DataFrame:
    return rounds.terminals(_signals(t))


@query("""SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'O' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN 'INTERRUPTED' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def startup_recovery(t, spark) -> DataFrame:
    running = t("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return catalog.update_among(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_custkey", running, F.col("o_orderstatus") == "O", o_orderstatus=F.lit("INTERRUPTED"))


@query(f"""WITH s AS (SELECT user_id::VARCHAR AS session_id, event_id AS seq, {_SIGNAL_SQL} AS type, props FROM events),
e AS (SELECT session_id, min(seq) FILTER (type IN ('AGENT_END', 'ERROR')) AS ended, arg_min(type, seq) FILTER (type IN ('AGENT_END', 'ERROR')) AS t, arg_min(props, seq) FILTER (type IN ('AGENT_END', 'ERROR')) AS message, min(seq) - 1 AS s0, min(seq) FILTER (type = 'EXCEED_MAX_ITERS') AS l FROM s GROUP BY 1),
w AS (SELECT *, CASE WHEN t = 'ERROR' THEN 'error' WHEN l < ended THEN 'max_iterations' ELSE 'stop' END AS stop_reason FROM e),
v AS (SELECT session_id, s0 AS seq, 0 AS part, 'RUN_START' AS event_type, to_json({{'round_id': '1'}}) AS payload FROM w
UNION ALL SELECT s.session_id, seq, 0, 'MESSAGE', to_json({{'content': [{{'type': 'text', 'text': props}}], 'is_last': false}}) FROM s JOIN w USING (session_id) WHERE s.type = 'TEXT_DELTA' AND (ended IS NULL OR seq <= ended)
UNION ALL SELECT session_id, ended, 1, CASE t WHEN 'AGENT_END' THEN 'RUN_END' ELSE 'RUN_ERROR' END, CASE t WHEN 'AGENT_END' THEN to_json({{'stop_reason': stop_reason}}) ELSE to_json({{'stop_reason': stop_reason, 'message': message}}) END FROM w WHERE ended IS NOT NULL
UNION ALL SELECT session_id, ended, 2, 'ERROR', to_json({{'code': 'DEEP_AGENT_RUN_ERROR', 'message': message}}) FROM w WHERE t = 'ERROR'
UNION ALL SELECT session_id, ended, 3, 'SESSION_STATUS', to_json({{'status': 'IDLE', 'stop_reason': stop_reason}}) FROM w WHERE ended IS NOT NULL)
SELECT session_id, '1' AS round_id, event_type, payload::VARCHAR AS payload, row_number() OVER (PARTITION BY session_id ORDER BY seq, part) AS sequence_num FROM v""")
def round_fold(t, spark) -> DataFrame:
    return rounds.events(_signals(t))


@query(f"""WITH s AS (SELECT user_id::VARCHAR AS session_id, event_id AS seq, {_SIGNAL_SQL} AS type, props FROM events),
e AS (SELECT session_id, min(seq) FILTER (type IN ('AGENT_END', 'ERROR')) AS ended, arg_min(type, seq) FILTER (type IN ('AGENT_END', 'ERROR')) AS t FROM s GROUP BY 1)
SELECT session_id, CASE WHEN any_value(t) = 'ERROR' THEN '' ELSE coalesce(string_agg(props, '' ORDER BY seq) FILTER (type = 'TEXT_DELTA' AND (ended IS NULL OR seq <= ended)), '') END AS output FROM s JOIN e USING (session_id) GROUP BY 1""")
def round_output(t, spark) -> DataFrame:
    return rounds.rounds(_signals(t)).select("session_id", "output")


@query("""SELECT 'c' || conv_id || '-' || turn AS id, CASE WHEN role = 'user' THEN 'tool' ELSE 'assistant' END AS role, CASE WHEN role = 'user' THEN 'tool_call' ELSE 'message' END AS type, turn + 1 AS sequence_number,
conv_id::VARCHAR AS session_id, CASE WHEN turn % 2 = 0 THEN 'true' END AS is_last, text AS said FROM conversations""")
def event_envelope(t, spark) -> DataFrame:
    body = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content"), F.when(F.col("turn") % 2 == 0, F.lit(True)).alias("is_last")))
    events = t("conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("event_id"), F.col("conv_id").cast("string").alias("session_id"), F.lit("1").alias("round_id"),
        F.when(F.col("role") == "user", "TOOL_CALL").otherwise("MESSAGE").alias("event_type"), body.alias("payload"), (F.col("turn") + 1).alias("sequence_num"), F.lit(None).cast("timestamp").alias("created_at"),
    )
    e = envelope.envelopes(events)
    return e.select("id", "role", "type", "sequence_number", F.col("metadata")["session_id"].alias("session_id"), F.col("metadata")["is_last"].alias("is_last"), F.get_json_object("content", "$[0].text").alias("said"))


@query("""SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS today, strftime(ts + INTERVAL 8 HOUR - INTERVAL 3 DAY, '%Y-%m-%d') AS earlier, strftime(ts + INTERVAL 8 HOUR + INTERVAL 2 MONTH, '%Y%m%d') AS later,
(epoch_us(ts) // 1000)::VARCHAR AS stamp, month(ts + INTERVAL 8 HOUR)::VARCHAR AS month FROM events""")
def date_variables(t, spark) -> DataFrame:
    ts = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp")
    names = {"today": "today", "earlier": "today-3", "later": "yyyyMMdd:+2M", "stamp": "timestamp", "month": "month"}
    return t("events").select("event_id", *(dates.date_variable(v, ts).alias(k) for k, v in names.items()))


@query("SELECT c_custkey, c_name AS name, c_name AS opened, (4 * ceil((28 + strlen(c_name)) / 3.0))::INTEGER AS sealed_length FROM customer")
def encrypt_round_trip(t, spark) -> DataFrame:
    secret = F.lit("a secret")
    sealed = secure.encrypt(F.col("c_name"), secret)
    return t("customer").select("c_custkey", F.col("c_name").alias("name"), secure.decrypt(sealed, secret).alias("opened"), F.length(sealed).alias("sealed_length"))


from tidemill import registry_columns, registry_commands, registry_ordered, registry_streams  # noqa: E402, F401  they add their queries
