"""Routing rules, call metrics and framed streams over the driver's event and conversation logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import resolving, routing
from quern.shipping import new_folder
from quern.sources import compress
from quern.streaming import control, frames, sync

from .records import ORACLE, QUERIES, query
from .tables import table


def _calls(spark, sf_dir):
    """Events as calls: two packages, two services, the event type as call."""
    e = table(spark, sf_dir, "events")
    pkg = F.when(F.col("user_id") % 2 == 0, "app").otherwise("web")
    svc = F.when(F.col("user_id") % 3 == 0, "Users").otherwise("Items")
    return e.select("event_id", "user_id", "ts", "value", "props", pkg.alias("package"), svc.alias("service"), F.col("event_type").alias("call"))


CALLS = "calls AS (SELECT event_id, user_id, ts, value, props, CASE WHEN user_id % 2 = 0 THEN 'app' ELSE 'web' END AS package, CASE WHEN user_id % 3 = 0 THEN 'Users' ELSE 'Items' END AS service, event_type AS call FROM events)"


@query(f"""WITH {CALLS} SELECT event_id, CASE WHEN package = 'app' AND service = 'Users' AND call = 'click' THEN 'app/Users/click' WHEN package = 'app' AND service = 'Users' THEN 'app/Users/*' WHEN package = 'app' THEN 'app/*/*' ELSE '*/*/*' END AS rule,
  CAST(CASE WHEN value > 100 THEN 1 WHEN package = 'app' AND service = 'Users' AND call = 'click' THEN 5 WHEN package = 'app' AND service = 'Users' THEN 10 WHEN package = 'app' THEN 20 ELSE 30 END AS INTEGER) AS timeout_s, NOT (package = 'app') AS waits FROM calls""")
def service_config_match(spark, sf_dir):
    rules = spark.createDataFrame([("*/*/*", 30, True), ("app/*/*", 20, False), ("app/Users/*", 10, False), ("app/Users/click", 5, False)], "pattern string, timeout int, wait boolean")
    found = routing.match_config(_calls(spark, sf_dir), rules)
    deadline, wait = routing.effective(F.when(F.col("value") > 100, F.lit(1)), F.lit(False), F.col("timeout"), F.col("wait"))
    return found.select("event_id", "rule", deadline.alias("timeout_s"), wait.alias("waits"))


@query(f"WITH {CALLS} SELECT event_id, CASE event_id % 4 WHEN 0 THEN package WHEN 3 THEN '' ELSE '' END AS package, CASE event_id % 4 WHEN 0 THEN service WHEN 1 THEN service ELSE '' END AS service, CASE event_id % 4 WHEN 3 THEN '' ELSE call END AS call FROM calls")
def parse_method(spark, sf_dir):
    k = F.col("event_id") % 4
    m = F.when(k == 0, F.concat_ws("/", "package", "service", "call")).when(k == 1, F.concat_ws("/", "service", "call")).when(k == 2, F.col("call")).otherwise(F.lit("a/b/c/d"))
    return _calls(spark, sf_dir).select("event_id", routing.split_method(m).alias("m")).select("event_id", "m.*")


@query("SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % 3 AS BIGINT) AS balancer, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) % 3 AS BIGINT) AS picker FROM orders")
def balance_round_robin(spark, sf_dir):
    rows = routing.numbered(table(spark, sf_dir, "orders"), ["o_orderkey"], ["o_custkey"])
    return rows.select("o_orderkey", routing.round_robin(F.col("k"), F.lit(3)).cast("long").alias("balancer"), routing.round_robin(F.col("k"), F.lit(3), 1).cast("long").alias("picker"))


@query("""WITH t AS (SELECT s_nationkey AS g, s_suppkey, greatest(s_suppkey % 4, 1) AS w FROM supplier), r AS (SELECT g, s_suppkey, w, sum(w) OVER (PARTITION BY g ORDER BY s_suppkey) - w AS low, sum(w) OVER (PARTITION BY g) AS total FROM t)
  SELECT o_orderkey, s_suppkey FROM (SELECT o_orderkey, c_nationkey AS g, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey) - 1 AS k FROM orders JOIN customer ON o_custkey = c_custkey) o JOIN r ON r.g = o.g AND o.k % r.total >= r.low AND o.k % r.total < r.low + r.w""")
def balance_weighted(spark, sf_dir):
    calls = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("g")), F.col("o_custkey") == F.col("c_custkey"))
    calls = routing.numbered_in_ranges(calls.select("o_orderkey", "g"), "o_orderkey", ["g"])
    targets = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("g"), "s_suppkey", (F.col("s_suppkey") % 4).alias("w"))
    return routing.weighted(calls, targets, "k", "g", "s_suppkey", "w").select("o_orderkey", "s_suppkey")


@query("""WITH t AS (SELECT s_nationkey, s_suppkey, s_suppkey % 3 AS p, s_suppkey % 5 <> 0 AS ok FROM supplier), r AS (SELECT * FROM t WHERE ok), l AS (SELECT s_nationkey, min(p) AS p FROM r GROUP BY 1)
  SELECT r.s_nationkey, CAST(r.p AS BIGINT) AS priority, count(*) AS n, min(s_suppkey) AS first FROM r JOIN l ON r.s_nationkey = l.s_nationkey AND r.p = l.p GROUP BY 1, 2""")
def balance_priority(spark, sf_dir):
    targets = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", (F.col("s_suppkey") % 3).alias("priority"), F.lit("READY").alias("state"), (F.col("s_suppkey") % 5 != 0).alias("healthy"))
    return routing.lowest_priority(routing.ready(targets), "s_nationkey", "priority").groupBy("s_nationkey", "priority").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("first"))


@query("SELECT o_orderkey, CAST((((o_orderkey + 1)::HUGEINT * 6364136223846793005 + 1442695040888963407) % 18446744073709551616) % 7 AS BIGINT) AS pick FROM orders")
def balance_random_lcg(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", routing.lcg_pick(F.col("o_orderkey") + 1, F.lit(7)).alias("pick"))


@query("SELECT event_id, CAST(i AS INTEGER) AS attempt, round(least((1 + event_id % 5) * 10 * pow(2, i), 100), 4) AS wait_ms FROM events, range(0, 5) t(i)")
def retry_schedule(spark, sf_dir):
    waits = routing.retry_schedule((F.col("event_id") % 5 + 1) * 10, 2.0, F.lit(100), 5)
    return table(spark, sf_dir, "events").select("event_id", F.posexplode(waits).alias("attempt", "wait_ms")).select("event_id", "attempt", F.round("wait_ms", 4).alias("wait_ms"))


def _error(k):
    names = routing.ERRORS
    return F.when(k % 18 == 0, None).when(k % 18 == 17, "boom").otherwise(F.concat(F.lit("rpc: "), F.get(F.array(*[F.lit(x) for x in names]), (k % 18).cast("int"))))


@query(f"""SELECT event_id, (event_id % 18) IN (8, 10, 13, 14) AS retryable, (event_id % 18) IN (1, 3, 4, 5, 6, 7, 12, 16) AS fatal, CASE WHEN event_id % 18 = 17 THEN '' ELSE [{", ".join(f"'{x}'" for x in routing.ERRORS)}][1 + event_id % 18] END AS name FROM events""")
def retryable_classify(spark, sf_dir):
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", routing.retryable(_error(k)).alias("retryable"), routing.fatal(_error(k)).alias("fatal"), routing.error_name(k % 18).alias("name"))


@query("""WITH c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, CAST(value AS BIGINT) AS took, CASE WHEN event_id % 3 = 0 THEN 'rpc: ErrUnavailable' WHEN event_id % 11 = 1 THEN 'rpc: ErrNotFound' END AS error FROM events),
  e AS (SELECT *, i * 50 + took AS done, error IS NULL OR error LIKE '%ErrNotFound%' AS stop FROM c WHERE i < 4)
  SELECT user_id, CAST(winner.i AS INTEGER) AS winner, CAST(winner.d AS BIGINT) AS done_ms, winner.x AS error FROM (SELECT user_id, arg_min({'i': i, 'd': done, 'x': error}, ROW(CASE WHEN stop THEN 0 ELSE 1 END, CASE WHEN stop THEN done ELSE -done END, i)) AS winner FROM e GROUP BY 1)""")
def hedge_first_success(spark, sf_dir):
    k = F.col("event_id")
    rows = routing.numbered(table(spark, sf_dir, "events"), ["event_id"], ["user_id"]).where("k < 4")
    error = F.when(k % 3 == 0, "rpc: ErrUnavailable").when(k % 11 == 1, "rpc: ErrNotFound")
    copies = rows.select("user_id", F.col("k").alias("i"), F.round("value").cast("long").alias("took"), error.alias("e"))
    return routing.hedged(copies, "user_id", "i", 50, "took", "e").select("user_id", F.col("winner").cast("int").alias("winner"), "done_ms", "error")


@query("""SELECT event_id, (event_id % 256 < 16 OR event_type IN ('click', 'view') OR user_id % 10 = 0) AS traced, (event_id % 256 < 16) AS by_address FROM events""")
def trace_rules(spark, sf_dir):
    k = F.col("event_id")
    ip = F.concat(F.lit("10.1.2."), (k % 256).cast("string"))
    method = F.when(F.col("event_type") == "click", "app/Users/click").when(F.col("event_type") == "view", "view").otherwise(F.concat(F.lit("app/Users/x"), F.col("event_type")))
    md = F.create_map(F.lit("user"), F.when(F.col("user_id") % 10 == 0, "root").otherwise("plain"))
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", routing.should_trace(ip, method, md, ["10.1.2.0/28", "192.168.0.0/16"], ["click", "view"], {"user": "root"}).alias("traced"), routing.in_networks(ip, ["10.1.2.0/28"]).alias("by_address"))


@query("""SELECT event_id, CASE WHEN event_type = 'purchase' AND NOT value > 5 THEN 'value is too small' WHEN event_type = 'purchase' AND NOT user_id > 3 THEN 'user is reserved' WHEN event_type = 'signup' AND NOT user_id % 2 = 0 THEN 'user is odd' END AS error,
  CAST(CASE WHEN (event_type = 'purchase' AND NOT (value > 5 AND user_id > 3)) OR (event_type = 'signup' AND user_id % 2 <> 0) THEN 3 ELSE 0 END AS INTEGER) AS error_code FROM events""")
def validate_rules(spark, sf_dir):
    rules = {"purchase": [(F.col("value") > 5, "value is too small"), (F.col("user_id") > 3, "user is reserved")], "signup": [(F.col("user_id") % 2 == 0, "user is odd")]}
    return routing.validate(table(spark, sf_dir, "events"), rules, "event_type").select("event_id", "error", "error_code")


@query("""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'passthrough' WHEN page_id % 5 IN (1, 2) THEN 'dns' ELSE '' END AS scheme, CASE WHEN page_id % 5 = 1 THEN '8.8.8.8' ELSE '' END AS authority,
  CASE WHEN page_id % 5 <= 2 THEN 'host' || page_id ELSE '' END AS endpoint, CASE page_id % 5 WHEN 3 THEN 'missing endpoint after authority' WHEN 4 THEN 'empty endpoint' ELSE '' END AS error FROM pages""")
def parse_target(spark, sf_dir):
    k = F.col("page_id")
    host = F.concat(F.lit("host"), k.cast("string"))
    target = F.when(k % 5 == 0, host).when(k % 5 == 1, F.concat(F.lit("DNS://8.8.8.8/"), host)).when(k % 5 == 2, F.concat(F.lit("dns:///"), host)).when(k % 5 == 3, F.concat(F.lit("dns://"), host)).otherwise(F.lit("dns:///"))
    return table(spark, sf_dir, "pages").select("page_id", routing.parse_target(target).alias("t")).select("page_id", "t.*")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'Serving' WHEN 'view' THEN 'NotServing' ELSE 'ServiceUnknown' END AS status FROM events")
def health_status(spark, sf_dir):
    known = spark.createDataFrame([("click", "Serving"), ("view", "NotServing")], "service string, status string")
    return routing.health(table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("service")), known).select("event_id", "status")


@query(f"""WITH {CALLS} SELECT package || '/' || service || '/' || call AS method, CASE WHEN call = 'error' THEN 'error' ELSE 'ok' END AS status, count(*) AS calls, CAST(sum(floor(value)) AS BIGINT) AS ms_sum, CAST(min(floor(value)) AS BIGINT) AS ms_min, CAST(max(floor(value)) AS BIGINT) AS ms_max,
  CAST(sum(CASE WHEN floor(value) <= 10 THEN 1 ELSE 0 END) AS BIGINT) AS le_10, CAST(sum(CASE WHEN floor(value) <= 100 THEN 1 ELSE 0 END) AS BIGINT) AS le_100, CAST(sum(CASE WHEN floor(value) <= 1000 THEN 1 ELSE 0 END) AS BIGINT) AS le_1000,
  CAST(sum(strlen(props)) AS BIGINT) AS request_bytes, CAST(sum(2 * strlen(props)) AS BIGINT) AS response_bytes FROM calls GROUP BY 1, 2""")
def rpc_metrics(spark, sf_dir):
    n = F.octet_length("props")
    return routing.metrics(_calls(spark, sf_dir), F.concat_ws("/", "package", "service", "call"), F.col("call") != "error", F.col("value"), n, n * 2)


@query("SELECT event_id, event_type || '/' || user_id AS method, CAST(user_id AS BIGINT) AS session_id, value > 100 AS late FROM events")
def tracing_spans(spark, sf_dir):
    end = F.col("ts") + F.make_dt_interval(secs=(F.col("value") / 1000).cast("decimal(18,6)"))
    late = frames.past_deadline(F.lit(0), F.col("value") / 1000, F.lit(100))
    return table(spark, sf_dir, "events").withColumn("end", end).select("event_id", F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("method"), F.col("user_id").alias("session_id"), late.alias("late"))


@query("""WITH o AS (SELECT *, CASE WHEN user_id % 7 = 0 THEN 'draining' WHEN event_type = 'error' THEN 'unregistered' WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'type mismatch' ELSE '' END AS reject FROM events)
  SELECT event_id, reject, CAST(CASE WHEN reject = '' THEN sum((reject = '')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) END AS BIGINT) AS session_id FROM o""")
def session_open(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    opens = e.select("event_id", F.col("user_id").alias("conn_id"), F.col("event_id").alias("seq"), F.lit("app").alias("package"), F.lit("Users").alias("service"), F.col("event_type").alias("call"), F.when((F.col("event_type") == "view") & (F.col("event_id") % 2 == 0), 4).otherwise(1).alias("kind"))
    registry = spark.createDataFrame([("app", "Users", c, 1) for c in ("click", "view", "purchase", "signup")], "package string, service string, call string, kind int")
    return frames.open_sessions(opens, registry, draining=F.col("conn_id") % 7 == 0).select("event_id", "reject", F.col("session_id").cast("long").alias("session_id"))


@query("SELECT conv_id, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM conversations WHERE conv_id % 3 <> 0 AND conv_id % 5 <> 0 GROUP BY 1")
def frame_demux(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    known = rows.where("conv_id % 3 <> 0").select("conv_id")
    kept = frames.not_cancelled(frames.demux(rows, known, ["conv_id"]), rows.where("conv_id % 5 = 0"), "conv_id")
    return kept.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))


@query("SELECT conv_id, count(*) AS n, string_agg(text, '|' ORDER BY turn) AS body FROM (SELECT *, min(CASE WHEN turn % 4 = 3 THEN turn END) OVER (PARTITION BY conv_id) AS stop FROM conversations) WHERE stop IS NULL OR turn <= stop GROUP BY 1")
def frame_reassembly(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("end", F.col("turn") % 4 == 3)
    return frames.reassemble(rows, "conv_id", "turn", "text", "end", "|")


@query("SELECT q.conv_id, q.turn, CAST(strlen(q.text) AS BIGINT) AS asked, CAST(strlen(a.text) AS BIGINT) AS answered FROM conversations q LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user'")
def request_response_match(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    asked = rows.where("role = 'user'").select("conv_id", "turn", (F.col("turn") + 1).alias("req_id"), F.octet_length("text").cast("long").alias("asked"))
    answered = rows.where("role = 'assistant'").select("conv_id", F.col("turn").alias("req_id"), F.octet_length("text").cast("long").alias("answered"))
    return frames.match_requests(asked, answered, ["conv_id", "req_id"]).select("conv_id", "turn", "asked", "answered")


@query("SELECT conv_id, turn, CASE WHEN strlen(text) > 500 THEN 'oversize' ELSE '' END AS dropped FROM conversations")
def size_limit_drop(spark, sf_dir):
    return frames.size_limit(table(spark, sf_dir, "conversations"), "text", 500).select("conv_id", "turn", "dropped")


@query("SELECT event_type AS package, count(DISTINCT user_id % 5) AS n, string_agg(DISTINCT CAST(user_id % 5 AS VARCHAR), ',' ORDER BY CAST(user_id % 5 AS VARCHAR)) AS services FROM events GROUP BY 1")
def reflection_list(spark, sf_dir):
    services = F.array_sort(F.collect_set((F.col("user_id") % 5).cast("string")))
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("package")).agg(services.alias("s")).select("package", F.size("s").cast("long").alias("n"), F.array_join("s", ",").alias("services"))


@query("""SELECT user_id, event_id, round(gap, 3) AS gap_s FROM (SELECT user_id, event_id, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) WHERE gap > 30""")
def keepalive_gaps(spark, sf_dir):
    """Extension: idle times."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return frames.idle_gaps(rows, "user_id", "ts").select("user_id", "event_id", F.round("gap_s", 3).alias("gap_s"))


@query("""WITH o AS (SELECT user_id AS id, event_id AS seq, event_type AS field, CASE WHEN event_id % 6 = 0 THEN '' ELSE props END AS value FROM events), r AS (SELECT id, field, value, seq, row_number() OVER (PARTITION BY id, field ORDER BY seq DESC) AS n FROM o)
  SELECT id, max(seq) AS last, CAST(count(*) FILTER (n = 1 AND value <> '') AS BIGINT) AS fields, coalesce(string_agg(field || '=' || value, ';' ORDER BY field) FILTER (n = 1 AND value <> ''), '') AS record FROM r GROUP BY 1""")
def stream_patch_apply(spark, sf_dir):
    """The final records of a stream of field sets, run to its end over the event files."""
    e = table(spark, sf_dir, "events")
    source = spark.readStream.schema(e.schema).option("pathGlobFilter", "events*").parquet(f"{sf_dir}/")
    ops = source.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("field"), F.when(F.col("event_id") % 6 == 0, "").otherwise(F.col("props")).alias("value"))
    folder = new_folder(spark, "stream")

    def keep(batch, number):
        # a batch that is run again after a failure replaces itself
        batch.write.mode("overwrite").parquet(f"{folder}/records/batch={number}")

    run = sync.sync(ops).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    final = spark.read.parquet(f"{folder}/records").groupBy("id").agg(F.max_by(F.struct("last", "record"), "last").alias("r")).select("id", "r.*")
    m = F.from_json("record", "map<string,string>")
    pairs = F.array_sort(F.transform(F.map_entries(m), lambda x: F.concat_ws("=", x["key"], x["value"])))
    return final.select("id", "last", F.size(m).cast("long").alias("fields"), F.array_join(pairs, ";").alias("record"))


@query("""WITH t AS (SELECT s_nationkey AS g, min(s_suppkey) FILTER (s_suppkey % 3 <> 0) AS s_suppkey FROM supplier GROUP BY 1)
  SELECT o_orderkey, s_suppkey, CASE WHEN s_suppkey IS NULL THEN 'no ready connection' ELSE '' END AS error FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN t ON g = c_nationkey""")
def balance_pick_first(spark, sf_dir):
    calls = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("g")), F.col("o_custkey") == F.col("c_custkey"))
    targets = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("g"), "s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "CONNECTING").otherwise("READY").alias("state"), F.lit(True).alias("healthy"))
    return routing.pick_first(calls.select("o_orderkey", "g"), routing.ready(targets), "g", "s_suppkey", "s_suppkey").select("o_orderkey", "s_suppkey", "error")


@query("""WITH p AS (SELECT page_id, page_id % 9 AS k, 'host' || (page_id % 40) AS h FROM pages), ips AS (SELECT 'host' || (s_suppkey % 30) AS host, '10.0.' || (s_suppkey // 250) || '.' || (s_suppkey % 250) AS ip, s_suppkey FROM supplier)
  SELECT page_id, addr, CAST(priority AS INTEGER) AS priority, CAST(weight AS INTEGER) AS weight, error FROM (SELECT page_id, h || ':9' AS addr, 0 AS priority, 0 AS weight, '' AS error FROM p WHERE k = 0
  UNION ALL SELECT page_id, ip || ':443', 0, 0, '' FROM p JOIN ips ON host = h WHERE k = 1 AND page_id % 2 = 0
  UNION ALL SELECT page_id, ip || ':80', 0, 0, '' FROM p JOIN ips ON host = h WHERE k = 2
  UNION ALL SELECT page_id, CASE WHEN k = 3 THEN '10.1.2.3:443' ELSE '[fe80::1]:8' END, 0, 0, '' FROM p WHERE k IN (3, 4)
  UNION ALL SELECT page_id, 'svc' || s_suppkey || '.local:' || (5000 + s_suppkey % 7), s_suppkey % 3, s_suppkey % 5, '' FROM p JOIN supplier ON 'svc.' || (s_suppkey % 4) = 'svc.' || (page_id % 4) WHERE k = 5 AND s_suppkey <= 8
  UNION ALL SELECT page_id, NULL, NULL, NULL, CASE k WHEN 6 THEN 'unknown scheme tcp' WHEN 7 THEN 'missing endpoint after authority' ELSE 'no addresses' END FROM p
    WHERE k IN (6, 7, 8) OR (k = 1 AND page_id % 2 <> 0) OR (k = 2 AND NOT EXISTS (SELECT 1 FROM ips WHERE host = h)) OR (k = 1 AND page_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM ips WHERE host = h)))""")
def resolve_targets(spark, sf_dir):
    """Passed through, looked up with and without port, addresses themselves, service records, and what finds nothing."""
    page, k = F.col("page_id"), F.col("page_id") % 9
    host = F.concat(F.lit("host"), (page % 40).cast("string"))
    forms = {0: F.concat(host, F.lit(":9")), 1: F.concat(F.lit("dns:///"), F.when(page % 2 == 0, host).otherwise("gone")), 2: F.concat(F.lit("DNS:///"), host, F.lit(":80")), 3: F.lit("dns:///10.1.2.3"), 4: F.lit("dns:///[fe80::1]:8"), 5: F.concat(F.lit("dns:///svc."), (page % 4).cast("string")), 6: F.lit("tcp://x/y"), 7: F.lit("dns://x"), 8: F.lit("dns:///nowhere:1")}
    target = F.lit(None).cast("string")
    for n, form in forms.items():
        target = F.when(k == n, form).otherwise(target)
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    hosts = s.select(F.concat(F.lit("host"), (key % 30).cast("string")).alias("host"), F.format_string("10.0.%d.%d", F.floor(key / 250), key % 250).alias("ip"))
    services = s.where("s_suppkey <= 8").select(F.lit("grpc").alias("service"), F.lit("tcp").alias("proto"), F.concat(F.lit("svc."), (key % 4).cast("string")).alias("name"), F.format_string("svc%d.local.", key).alias("target"), (key % 7 + 5000).alias("port"), (key % 3).alias("priority"), (key % 5).alias("weight"))
    known = resolving.Registry()
    known.register("dns", resolving.dns(hosts))
    known.register("dns", resolving.dns(hosts, services, "grpc", "tcp"))
    return known.resolve(table(spark, sf_dir, "pages").select("page_id", target.alias("t")), "t").select("page_id", "addr", "priority", "weight", "error")


@query("SELECT event_id, CASE WHEN event_id % 256 >= 32 THEN 'address' WHEN user_id % 3 <> 0 THEN 'token' ELSE '' END AS denied, CASE WHEN user_id % 3 <> 0 THEN 'token' ELSE '' END AS anywhere, '' AS open FROM events")
def authorize_calls(spark, sf_dir):
    import hashlib

    k = F.col("event_id")
    ip = F.concat(F.lit("10.1.2."), (k % 256).cast("string"))
    token = F.when(F.col("user_id") % 3 == 0, "open sesame").when(F.col("user_id") % 3 == 1, "guess")
    asked = routing.token_in([hashlib.sha256(x).hexdigest() for x in (b"open sesame", b"retired")])
    rows = table(spark, sf_dir, "events").select("event_id", "user_id")
    for name, networks, validator in (("first", ["10.1.2.0/27"], asked), ("anywhere", [], asked), ("open", [], None)):
        rows = routing.authorize(rows, ip, token, networks, validator).withColumnRenamed("denied", name)
    return rows.select("event_id", F.col("first").alias("denied"), "anywhere", "open")


@query("""SELECT conv_id, turn, CASE WHEN strlen(text) > 2000 THEN 'oversize' WHEN (conv_id + turn) % 7 = 0 THEN 'undecodable' WHEN (conv_id + turn) % 7 = 1 THEN 'unknown codec' ELSE '' END AS dropped,
  CASE WHEN strlen(text) <= 2000 AND (conv_id + turn) % 7 > 1 THEN text END AS body FROM conversations""")
def dead_letters(spark, sf_dir):
    """Compressed frames, of which some are damaged, of a codec that nobody knows, or too large."""
    k = (F.col("conv_id") + F.col("turn")) % 7
    text = F.col("text").cast("binary")
    rows = table(spark, sf_dir, "conversations").withColumn("codec", F.when(k == 1, "lzma").when(k % 2 == 0, "gzip").otherwise("zstd"))
    packed = F.when(F.octet_length("text") > 2000, text).when(k == 0, F.lit(b"no gzip")).when(k == 1, text).when(k % 2 == 0, compress.compressed(text, "gzip")).otherwise(compress.compressed(text, "zstd"))
    return frames.delivered(rows.withColumn("payload", packed), ["gzip", "zstd"], limit=2000).select("conv_id", "turn", "dropped", F.col("body").cast("string").alias("body"))


@query("SELECT event_id, '(' || '[' || event_type || ']' || ')' AS name, CASE WHEN value > 100 THEN 'late' ELSE 'fine' END AS mark FROM events WHERE user_id % 2 = 0")
def interceptor_chain(spark, sf_dir):
    """The first interceptor acts last: brackets, then the mark, then what the filter leaves is wrapped."""

    def wrap(df):
        return df.withColumn("name", F.concat(F.lit("("), F.col("name"), F.lit(")")))

    def even(df):
        return df.where("user_id % 2 = 0").withColumn("mark", F.when(F.col("value") > 100, "late").otherwise("fine"))

    def bracket(df):
        return df.withColumn("name", F.concat(F.lit("["), F.col("event_type"), F.lit("]")))

    return routing.chain(table(spark, sf_dir, "events"), wrap, even, bracket).select("event_id", "name", "mark")


@query("SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, CAST(4 AS INTEGER) AS batches, CAST(4 AS INTEGER) AS started FROM events GROUP BY 1")
def stream_limited_drain(spark, sf_dir):
    """Events in four files, taken one file a batch by a running query that is drained and stopped."""
    folder = new_folder(spark, "drain")
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    for k in range(4):
        e.where(F.col("event_id") % 4 == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    source = control.limited(spark.readStream.schema(e.schema), 1).parquet(f"{folder}/in")
    run = source.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").start()
    batches = control.drain(run)
    out = spark.read.parquet(f"{folder}/out")
    counts = out.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
    return counts.withColumn("batches", F.lit(out.select("batch").distinct().count())).withColumn("started", F.lit(batches))


__all__ = ["ORACLE", "QUERIES"]
