"""Targets to addresses: resolvers by scheme, over address tables in place of name servers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .routing import parse_target

ADDRESS = "addr string, priority int, weight int"
#: A resolver: rows with ``host`` and ``port`` of the endpoint gain addr, priority and weight, one row an address.
Resolver = Callable[[DataFrame], DataFrame]


def split_port(endpoint: Column, default: str) -> tuple[Column, Column]:
    """(host, port) of host:port or [v6]:port; the default port where there is none."""
    has = endpoint.rlike(r"^(\[[^\]]*\]|[^:\[\]]*):[^:]*$")
    host = F.when(has, F.regexp_replace(endpoint, r":[^:]*$", "")).otherwise(endpoint)
    return F.regexp_replace(host, r"^\[|\]$", ""), F.when(has, F.regexp_extract(endpoint, r":([^:]*)$", 1)).otherwise(default)


def join_port(host: Column, port: Column) -> Column:
    return F.concat(F.when(F.contains(host, F.lit(":")), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host), F.lit(":"), port)


def is_address(host: Column) -> Column:
    """Whether a host is an IP address itself."""
    four = r"(25[0-5]|2[0-4]\d|1?\d?\d)"
    return host.rlike(rf"^{four}(\.{four}){{3}}$") | (F.contains(host, F.lit(":")) & host.rlike(r"^[0-9A-Fa-f:.]+$"))


def passthrough(rows: DataFrame) -> DataFrame:
    """The endpoint is the address."""
    return rows.withColumns({"addr": F.col("endpoint"), "priority": F.lit(0), "weight": F.lit(0)})


def dns(hosts: DataFrame, services: DataFrame | None = None, service: str = "", proto: str = "") -> Resolver:
    """Addresses from the tables ``hosts`` (host, ip) and ``services`` (service, proto, name, target, port, priority, weight).

    Service records come first where a service and protocol are asked for and
    the endpoint has any; then an endpoint that is an IP address is itself;
    then all addresses of its host.  Other endpoints find none.
    """

    def resolve(rows: DataFrame) -> DataFrame:
        keep = rows.columns
        out = None
        if services is not None and service and proto:
            own = services.where((F.col("service") == service) & (F.col("proto") == proto))
            own = own.select(F.col("name").alias("_name"), join_port(F.regexp_replace("target", r"\.$", ""), F.col("port").cast("string")).alias("addr"), F.col("priority").cast("int").alias("priority"), F.col("weight").cast("int").alias("weight"))
            out = rows.join(own, F.col("endpoint") == F.col("_name")).select(*keep, "addr", "priority", "weight")
            rows = rows.join(own.select("_name").distinct(), F.col("endpoint") == F.col("_name"), "left_anti")
        literal = rows.where(is_address(F.col("host"))).select(*keep, join_port(F.col("host"), F.col("port")).alias("addr"), F.lit(0).alias("priority"), F.lit(0).alias("weight"))
        known = hosts.select(F.col("host").alias("_host"), F.col("ip").alias("_ip"))
        named = rows.where(~is_address(F.col("host"))).join(known, F.col("host") == F.col("_host")).select(*keep, join_port(F.col("_ip"), F.col("port")).alias("addr"), F.lit(0).alias("priority"), F.lit(0).alias("weight"))
        found = literal.union(named)
        return found if out is None else out.union(found)

    return resolve


class Registry:
    """Resolvers by scheme; the one registered last stays."""

    def __init__(self):
        self._known: dict[str, Resolver] = {"passthrough": passthrough}

    def register(self, scheme: str, resolver: Resolver) -> None:
        self._known[scheme] = resolver

    def get(self, scheme: str) -> Resolver | None:
        return self._known.get(scheme)

    def schemes(self) -> list[str]:
        return sorted(self._known)

    def resolve(self, targets: DataFrame, target: str, default_port: str = "443") -> DataFrame:
        """``targets`` with addr, priority, weight and error, one row an address.

        Targets that do not parse, whose scheme is not registered or that find no
        address keep one row, with null address and the reason in ``error``.
        """
        keep = targets.columns
        rows = targets.withColumn("_t", parse_target(F.col(target)))
        host, port = split_port(F.col("_t.endpoint"), default_port)
        rows = rows.select(*keep, F.col("_t.scheme").alias("scheme"), F.col("_t.endpoint").alias("endpoint"), F.col("_t.error").alias("error"), host.alias("host"), port.alias("port"))
        error = F.when(F.col("error") != "", F.col("error")).when(~F.col("scheme").isin(self.schemes()), F.concat(F.lit("unknown scheme "), F.col("scheme")))
        out = rows.where(error.isNotNull()).select(*keep, F.lit(None).cast("string").alias("addr"), F.lit(None).cast("int").alias("priority"), F.lit(None).cast("int").alias("weight"), error.alias("error"))
        for scheme in self.schemes():
            own = rows.where((F.col("error") == "") & (F.col("scheme") == scheme))
            found = self._known[scheme](own.drop("error")).select(*keep, "scheme", "endpoint", "addr", "priority", "weight")
            lost = own.join(found.select("endpoint").distinct(), "endpoint", "left_anti")
            out = out.union(found.select(*keep, "addr", "priority", "weight", F.lit("").alias("error")))
            out = out.union(lost.select(*keep, F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit("no addresses")))
        return out
