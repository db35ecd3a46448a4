"""IP lists: membership, protection, blocking plans and list algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowtide.functions.scalars import broadcast_address, is_ip_address, network_address
from flowtide.operators.skew import BROADCAST_ROWS, is_bounded, lookup


def _combined(lists: dict[str, DataFrame | None], ip: str) -> DataFrame | None:
    """All lists as tagged rows ``(ip, list, reason)``."""
    tagged = [
        df.select(F.col("ip_address").alias(ip), F.lit(tag).alias("_list"),
                  (F.col("reason") if tag == "black" else F.lit(None).cast("string")).alias("_reason"))
        for tag, df in lists.items() if df is not None]
    if not tagged:
        return None
    out = tagged[0]
    for df in tagged[1:]:
        out = out.union(df)
    return out.filter(F.col(ip).isNotNull())


def with_reputation(df: DataFrame, whitelist: DataFrame | None, blacklist: DataFrame | None,
                    protected: DataFrame | None = None, ip: str = "source_ip",
                    max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add is_whitelisted, is_blacklisted, block_reason and is_protected for the source.

    The lists become one dimension, so the large side is joined once. It is broadcast after its
    size was checked; beyond the bound it is shuffled with the busiest sources split off.
    """
    flags = {"is_whitelisted": "white", "is_blacklisted": "black", "is_protected": "protected"}
    combined = _combined({"white": whitelist, "black": blacklist, "protected": protected}, ip)
    if combined is not None:
        per_ip = combined.groupBy(ip).agg(
            *[F.bool_or(F.col("_list") == tag).alias(flag) for flag, tag in flags.items()],
            F.min("_reason").alias("block_reason"))
        df = lookup(df, per_ip, ip, max_rows, bound_on=combined)
    else:
        df = df.withColumn("block_reason", F.lit(None).cast("string"))
    return df.withColumns({flag: F.coalesce(flag, F.lit(False)) if combined is not None
                           else F.lit(False) for flag in flags})


def only_listed(df: DataFrame, entries: DataFrame, ip: str = "source_ip") -> DataFrame:
    return df.join(_addresses(entries, ip), ip, "left_semi")


def only_unlisted(df: DataFrame, entries: DataFrame, ip: str = "source_ip") -> DataFrame:
    return df.join(_addresses(entries, ip), ip, "left_anti")


def _addresses(entries: DataFrame, ip: str) -> DataFrame:
    listed = entries.select(F.col("ip_address").alias(ip)).distinct()
    return F.broadcast(listed) if is_bounded(listed) else listed


def subnet_edges(subnets: DataFrame) -> DataFrame:
    """Network and broadcast address of every (address, netmask) row."""
    edges = F.array(network_address(F.col("address"), F.col("netmask")),
                    broadcast_address(F.col("address"), F.col("netmask")))
    return (subnets.select(F.explode(edges).alias("ip_address"))
            .filter(F.col("ip_address") != ""))


def protected_set(configured: DataFrame, subnets: DataFrame) -> DataFrame:
    """Configured addresses together with the edges of the local subnets. Not deduplicated:
    membership tests do not need it, and distinct() is there for those who do."""
    return configured.select("ip_address").union(subnet_edges(subnets))


def auto_block(alert_starts: DataFrame, whitelist: DataFrame, blacklist: DataFrame,
               protected: DataFrame, reason: str = "Auto-blocked by threat detection") -> DataFrame:
    """Addresses to add to the blacklist: sources of new alerts that are valid and neither
    trusted, protected nor already listed. The earliest alert gives the reason."""
    first = alert_starts.filter((F.col("source_ip") != "unknown") & is_ip_address(F.col("source_ip")))
    why = (F.coalesce(F.col("reason"), F.lit(reason)) if "reason" in alert_starts.columns
           else F.lit(reason))
    candidates = (first.groupBy(F.trim("source_ip").alias("ip_address"))
                  .agg(F.min_by(why, F.struct("created_at", "id")).alias("reason")))
    for entries in (whitelist, protected, blacklist):
        candidates = candidates.join(entries.select("ip_address").distinct(), "ip_address", "left_anti")
    return candidates


def reconcile(current: DataFrame, whitelist: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Rule plan ``(ip_address, action)`` with ALLOW, BLOCK or REMOVE. An address on both lists
    ends blocked, because blocks are applied last."""
    def tagged(df: DataFrame, flag: str) -> DataFrame:
        return df.select("ip_address").distinct().withColumn(flag, F.lit(True))

    joined = (tagged(current, "_rule").join(tagged(whitelist, "_white"), "ip_address", "full_outer")
              .join(tagged(blacklist, "_black"), "ip_address", "full_outer"))
    action = (F.when(F.col("_black"), "BLOCK").when(F.col("_white"), "ALLOW").otherwise("REMOVE"))
    return joined.select("ip_address", action.alias("action"))


def reconcile_counts(current: DataFrame, whitelist: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Rules touched: every whitelisted and blacklisted entry counts, plus the removals."""
    white, black = (df.select("ip_address").distinct() for df in (whitelist, blacklist))
    removed = current.select("ip_address").subtract(white.union(black))

    def tally(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("step"), "n")

    return tally(white, "allowed").union(tally(black, "blocked")).union(tally(removed, "removed"))


def manual_allow(requests: DataFrame, whitelist: DataFrame, blacklist: DataFrame,
                 reason: str = "Manual allow by admin") -> tuple[DataFrame, DataFrame]:
    """(whitelist, blacklist) after allowing: off the blacklist, onto the whitelist."""
    return (_added(requests, whitelist, reason),
            blacklist.join(requests.select("ip_address"), "ip_address", "left_anti"))


def manual_block(requests: DataFrame, blacklist: DataFrame,
                 reason: str = "Manual block by admin") -> DataFrame:
    """Blacklist after blocking. The whitelist is left alone."""
    return _added(requests, blacklist, reason)


def _added(requests: DataFrame, entries: DataFrame, reason: str) -> DataFrame:
    valid = requests.filter(is_ip_address(F.col("ip_address")))
    wanted = valid.groupBy(F.trim("ip_address").alias("ip_address")).agg(
        F.min(F.when(F.col("reason") != "", F.col("reason"))).alias("reason"))
    fresh = (wanted.join(entries.select("ip_address"), "ip_address", "left_anti")
             .withColumn("reason", F.coalesce("reason", F.lit(reason))))
    return entries.select("ip_address", "reason").unionByName(fresh)


def search(entries: DataFrame, text: str) -> DataFrame:
    """Entries whose address or reason contains the text, ignoring case."""
    return entries.filter(contains_text("ip_address", text) | contains_text("reason", text))


def contains_text(column: str, text: str):
    """Case-insensitive substring test with SQL wildcards in the text left active."""
    return F.coalesce(F.col(column).ilike(f"%{text}%"), F.lit(False))


def filter_rules(rules: DataFrame, text: str) -> DataFrame:
    needle = F.lit(text.lower())
    return rules.filter(F.lower("remote_ip").contains(needle) | F.lower("rule_name").contains(needle))


def verdicts(addresses: DataFrame, rules: DataFrame, whitelist: DataFrame,
             blacklist: DataFrame) -> DataFrame:
    """Verdict per address: BLOCKED by rule or list, else TRUSTED, else NONE."""
    blocked = rules.filter(F.col("action") == "BLOCK").select(
        F.col("remote_ip").alias("ip_address"))
    out = addresses.select("ip_address").distinct()
    for entries, flag in ((blocked, "rule_blocked"), (blacklist, "blacklisted"),
                          (whitelist, "whitelisted")):
        listed = entries.select("ip_address").distinct().withColumn(flag, F.lit(True))
        out = out.join(listed, "ip_address", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    verdict = (F.when(F.col("rule_blocked") | F.col("blacklisted"), "BLOCKED")
               .when(F.col("whitelisted"), "TRUSTED").otherwise("NONE"))
    return out.withColumn("verdict", verdict)


def import_list(incoming: DataFrame, existing: DataFrame, order_by: str) -> tuple[DataFrame, DataFrame]:
    """(new entries, one row of added/skipped counts). The first of repeated addresses wins;
    malformed and already listed ones are skipped."""
    if "ip_address" not in incoming.columns:
        raise ValueError("an IP list needs an ip_address column")
    reason = F.col("reason") if "reason" in incoming.columns else F.lit(None).cast("string")
    valid = (incoming.withColumn("_ip", F.trim("ip_address"))
             .filter(is_ip_address(F.col("_ip")))
             .groupBy(F.col("_ip").alias("ip_address"))
             .agg(F.min_by(F.coalesce(reason, F.lit("")), order_by).alias("reason")))
    fresh = valid.join(existing.select("ip_address").distinct(), "ip_address", "left_anti")
    counts = (incoming.agg(F.count(F.lit(1)).alias("total"))
              .withColumn("added", fresh.agg(F.count(F.lit(1))).scalar())
              .select("added", (F.col("total") - F.col("added")).alias("skipped")))
    return fresh, counts
