"""Rules over call logs: configuration, balancing, retries, hedging, tracing, validation, metrics."""

from __future__ import annotations

from collections.abc import Callable
from ipaddress import ip_network

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Error names by code; those never and those always worth another try.
ERRORS = ("ErrNone", "ErrCanceled", "ErrReserved", "ErrInvalidArgument", "ErrDeadlineExceeded", "ErrNotFound", "ErrAlreadyExists", "ErrPermissionDenied", "ErrResourceExhausted", "ErrFailedPrecondition", "ErrAborted", "ErrOutOfRange", "ErrUnimplemented", "ErrInternal", "ErrUnavailable", "ErrDataLoss", "ErrUnauthenticated")
FINAL = ("ErrDeadlineExceeded", "ErrCanceled", "ErrInvalidArgument", "ErrNotFound", "ErrAlreadyExists", "ErrPermissionDenied", "ErrUnauthenticated", "ErrUnimplemented")
TRANSIENT = ("ErrInternal", "ErrUnavailable", "ErrResourceExhausted", "ErrAborted")
# Multiplier and increment of the random balancer.
LCG_A, LCG_C = 6364136223846793005, 1442695040888963407

#: Rows of a rule table up to which it is broadcast.
RULES = 100_000


def _rules(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(RULES + 1).count() <= RULES else df


def split_method(method: Column) -> Column:
    """struct(package, service, call) of "package/service/call", "service/call" or "call"; blanks for more parts."""
    parts = F.split(method, "/")
    n = F.size(parts)

    def part(back: int) -> Column:
        return F.when((n <= 3) & (n >= back), F.get(parts, n - back)).otherwise("")

    return F.struct(part(3).alias("package"), part(2).alias("service"), part(1).alias("call"))


def match_config(calls: DataFrame, config: DataFrame, package: str = "package", service: str = "service", call: str = "call", pattern: str = "pattern") -> DataFrame:
    """Each call with the columns of its most specific rule and ``rule`` (the pattern, null if none).

    Exact before ``package/service/*``, ``package/*/*`` and ``*/*/*``.
    """
    rules = _rules(config.withColumnRenamed(pattern, "rule"))
    values = [c for c in config.columns if c != pattern]
    keys = [F.concat_ws("/", package, service, call), F.concat_ws("/", package, service, F.lit("*")), F.concat_ws("/", F.col(package), F.lit("*"), F.lit("*")), F.lit("*/*/*")]
    out = calls
    for i, key in enumerate(keys):
        out = out.join(rules.select(F.col("rule").alias(f"_r{i}"), *[F.col(v).alias(f"_{v}{i}") for v in values]), key == F.col(f"_r{i}"), "left")

    def first(of: str) -> Column:
        # the rule decides, not the value: a specific rule's null stays null
        x = F.lit(None)
        for i in reversed(range(4)):
            x = F.when(F.col(f"_r{i}").isNotNull(), F.col(f"_{of}{i}")).otherwise(x)
        return x

    return out.select(*calls.columns, F.coalesce(*[F.col(f"_r{i}") for i in range(4)]).alias("rule"), *[first(v).alias(v) for v in values])


def effective(deadline: Column, wait: Column, timeout: Column, wait_rule: Column) -> tuple[Column, Column]:
    """(deadline, wait): the caller's deadline before the rule's; either may ask to wait."""
    return F.coalesce(deadline, timeout), F.coalesce(wait, F.lit(False)) | F.coalesce(wait_rule, F.lit(False))


def retry_schedule(first: Column, multiplier: float, most: Column, attempts: int) -> Column:
    """Waits before the retries: one first call and ``attempts`` retries."""
    return F.transform(F.sequence(F.lit(0), F.lit(attempts - 1)), lambda i: F.least(first * F.pow(F.lit(multiplier), i), most.cast("double"))) if attempts else F.array().cast("array<double>")


def _mentions(error: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(error.rlike("|".join(names)), F.lit(False))


def retryable(error: Column) -> Column:
    """Whether another call may help, by the error names that the text holds."""
    return ~_mentions(error, FINAL) & _mentions(error, TRANSIENT)


def fatal(error: Column) -> Column:
    return _mentions(error, (*FINAL, "context canceled", "context deadline exceeded"))


def hedged(copies: DataFrame, request: str, attempt: str, delay_ms: int, took_ms: str, error: str) -> DataFrame:
    """(request, winner, done_ms, error): copy i starts at i x delay; the first success or fatal error ends it.

    Without either the last copy to end decides.
    """
    rows = copies.withColumn("_end", F.col(attempt) * delay_ms + F.col(took_ms)).withColumn("_stop", F.col(error).isNull() | fatal(F.col(error)))
    key = F.struct(F.when(F.col("_stop"), 0).otherwise(1), F.when(F.col("_stop"), F.col("_end")).otherwise(-F.col("_end")), F.col(attempt))
    return rows.groupBy(request).agg(F.min_by(F.struct(F.col(attempt).alias("winner"), F.col("_end").alias("done_ms"), F.col(error).alias("error")), key).alias("x")).select(request, "x.*")


def ready(connections: DataFrame) -> DataFrame:
    """Connections that may be picked."""
    return connections.where((F.col("state") == "READY") & F.col("healthy"))


def numbered(calls: DataFrame, order: list[str], partition: list[str]) -> DataFrame:
    """``calls`` with k, the 0-based place within each ``partition``."""
    return calls.withColumn("k", F.row_number().over(W.partitionBy(*partition).orderBy(*order)) - 1)


def numbered_in_ranges(calls: DataFrame, order: str, partition: list[str], ranges: int = 64) -> DataFrame:
    """``numbered`` for few large partitions: ranges of the number ``order`` are counted, then numbered on their own.

    Ranges are of equal width, so that no task sorts a whole partition; null
    orders come first.
    """
    low, high = calls.agg(F.min(order), F.max(order)).first()
    place = F.lit(0) if low is None or low == high else F.floor((F.col(order) - low) * ((ranges - 1) / (high - low))).cast("int")
    rows = calls.withColumn("_range", F.coalesce(place, F.lit(-1)))
    counts = rows.groupBy(*partition, "_range").count()
    before = F.coalesce(F.sum("count").over(W.partitionBy(*partition).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    joined = rows.join(_rules(counts.select(*partition, "_range", before.alias("_before"))), [*partition, "_range"])
    k = F.row_number().over(W.partitionBy(*partition, "_range").orderBy(order)) - 1 + F.col("_before")
    return joined.withColumn("k", k).drop("_range", "_before")


def round_robin(k: Column, n: Column, start: int = 0) -> Column:
    """Index of the pick; balancers start at 0, pickers at 1."""
    return F.pmod(k + start, n)


def weighted(calls: DataFrame, targets: DataFrame, k: str, group: str, target: str, weight: str) -> DataFrame:
    """Each call with the target whose range of cumulative weight holds k modulo the sum; weight 0 counts as 1."""
    w = F.greatest(F.col(weight), F.lit(1))
    order = W.partitionBy(group).orderBy(target)
    ranges = targets.select(group, target, w.alias("_w"), (F.sum(w).over(order) - w).alias("_low"), F.sum(w).over(W.partitionBy(group)).alias("_sum"))
    lists = ranges.groupBy(group).agg(F.first("_sum").alias("_sum"), F.array_sort(F.collect_list(F.struct("_low", "_w", target))).alias("_ranges"))
    joined = calls.join(_rules(lists), group)
    at = F.pmod(F.col(k), F.col("_sum"))
    hit = F.filter("_ranges", lambda r: (r["_low"] <= at) & (at < r["_low"] + r["_w"]))
    return joined.withColumn(target, hit[0][target]).drop("_sum", "_ranges")


def lowest_priority(targets: DataFrame, group: str, priority: str) -> DataFrame:
    """Targets of the least priority of their group."""
    least = targets.groupBy(group).agg(F.min(priority).alias("_least"))
    return targets.join(least, group).where(F.col(priority) == F.col("_least")).drop("_least")


def pick_first(calls: DataFrame, targets: DataFrame, group: str, target: str, order: str) -> DataFrame:
    """Each call with the first target of its group's list (by ``order``) and ``error``, which says that the list is empty."""
    first = targets.groupBy(group).agg(F.min_by(target, order).alias(target))
    return calls.join(_rules(first), group, "left").withColumn("error", F.when(F.col(target).isNull(), "no ready connection").otherwise(""))


def lcg_pick(seed: Column, n: Column) -> Column:
    """(a x seed + c) modulo 2^64, modulo n; exact in decimals for seeds below 10^19."""
    x = F.pmod(seed.cast("decimal(38,0)") * F.lit(LCG_A).cast("decimal(19,0)") + F.lit(LCG_C).cast("decimal(19,0)"), F.lit(str(1 << 64)).cast("decimal(20,0)"))
    return F.pmod(x.cast("decimal(20,0)"), n.cast("decimal(20,0)")).cast("long")


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a number, null if it is none."""
    m = F.regexp_extract_all(ip, F.lit(r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"), F.lit(0))
    parts = F.transform(F.split(ip, r"\."), lambda x: F.expr("null").cast("long") if x is None else x.try_cast("long"))
    n = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    return F.when((F.size(m) > 0) & F.forall(parts, lambda x: x <= 255), n)


def in_networks(ip: Column, networks: list[str]) -> Column:
    """Whether an IPv4 address lies in any of the CIDR ranges."""
    n, out = ip_number(ip), F.lit(False)
    for x in networks:
        net = ip_network(x, strict=False)
        out = out | n.between(int(net.network_address), int(net.broadcast_address))
    return F.coalesce(out, F.lit(False))


def authorize(calls: DataFrame, ip: Column, token: Column, networks: list[str], validator: Callable[[Column], Column] | None = None) -> DataFrame:
    """``calls`` with ``denied``: why a caller may not look, "" if it may.

    No networks let every address pass; without a validator no token is asked
    for.  ``validator`` makes a boolean column of a token; null fails.
    """
    address = in_networks(ip, networks) if networks else F.lit(True)
    known = F.coalesce(validator(token), F.lit(False)) if validator else F.lit(True)
    return calls.withColumn("denied", F.when(~address, "address").when(~known, "token").otherwise(""))


def token_in(digests: list[str]) -> Callable[[Column], Column]:
    """A validator of tokens whose SHA-256 (hex) is listed; tokens themselves are not kept."""
    return lambda token: F.sha2(token, 256).isin(digests)


def should_trace(ip: Column, method: Column, metadata: Column, networks: list[str], methods: list[str], wanted: dict[str, str]) -> Column:
    """Address in a range, method equal or ending in /name, or metadata key with the value (* is any)."""
    by_method = F.lit(False)
    for m in methods:
        by_method = by_method | (method == m) | F.endswith(method, F.lit("/" + m))
    by_data = F.lit(False)
    for k, v in wanted.items():
        own = F.try_element_at(metadata, F.lit(k))
        by_data = by_data | (own.isNotNull() if v == "*" else own == v)
    return in_networks(ip, networks) | F.coalesce(by_method, F.lit(False)) | F.coalesce(by_data, F.lit(False))


Validator = Callable[[], Column]


def validate(calls: DataFrame, rules: dict[str, list[tuple[Column, str]]], method: str = "method") -> DataFrame:
    """``calls`` with error_code and error: the first rule of the exact method that fails is InvalidArgument."""
    error = F.lit(None).cast("string")
    for name, checks in rules.items():
        for ok, message in reversed(checks):
            error = F.when((F.col(method) == name) & ~F.coalesce(ok, F.lit(False)), message).otherwise(error)
    return calls.withColumn("error", error).withColumn("error_code", F.when(F.col("error").isNull(), 0).otherwise(ERRORS.index("ErrInvalidArgument")))


def error_name(code: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in ERRORS]), code.cast("int")), F.lit(""))


def parse_target(target: Column, default: str = "passthrough") -> Column:
    """struct(scheme, authority, endpoint, error) of scheme://authority/endpoint or a bare address."""
    has = F.instr(target, "://") > 0
    scheme = F.lower(F.substring_index(target, "://", 1))
    rest = F.substr(target, F.instr(target, "://") + 3)
    slash = F.instr(rest, "/")
    endpoint = F.substr(rest, slash + 1)
    error = (
        F.when(F.coalesce(F.length(target), F.lit(0)) == 0, "empty target").when(~has, "").when(scheme == "", "empty scheme")
        .when(slash == 0, "missing endpoint after authority").when(endpoint == "", "empty endpoint").otherwise("")
    )
    good = error == ""
    return F.struct(
        F.when(good & ~has, default).when(good, scheme).otherwise("").alias("scheme"),
        F.when(good & has, F.substr(rest, F.lit(1), F.greatest(slash - 1, F.lit(0)))).otherwise("").alias("authority"),
        F.when(good & ~has, target).when(good, endpoint).otherwise("").alias("endpoint"),
        error.alias("error"),
    )


def health(asked: DataFrame, services: DataFrame, service: str = "service", status: str = "status") -> DataFrame:
    """Status of each asked service, ServiceUnknown if it has none."""
    return asked.join(_rules(services.select(service, status)), service, "left").withColumn(status, F.coalesce(status, F.lit("ServiceUnknown")))


def chain(df: DataFrame, *interceptors: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply interceptors; the first is the outermost, so it acts last on what the others made."""
    for f in reversed(interceptors):
        df = df.transform(f)
    return df


#: Upper bounds of the duration and size buckets, in ms and bytes.
BUCKETS = (10, 100, 1000)


def metrics(calls: DataFrame, method: Column, ok: Column, ms: Column, request: Column, response: Column) -> DataFrame:
    """Counters and histograms for each (method, status): one aggregation with partial combine."""
    ms = F.floor(ms).cast("long")
    rows = calls.select(method.alias("method"), F.when(ok, "ok").otherwise("error").alias("status"), ms.alias("ms"), request.cast("long").alias("q"), response.cast("long").alias("r"))
    bounds = [F.sum(F.when(F.col("ms") <= b, 1).otherwise(0)).alias(f"le_{b}") for b in BUCKETS]
    return rows.groupBy("method", "status").agg(F.count("*").alias("calls"), F.sum("ms").alias("ms_sum"), F.min("ms").alias("ms_min"), F.max("ms").alias("ms_max"), *bounds, F.sum("q").alias("request_bytes"), F.sum("r").alias("response_bytes"))
