"""Streaming flows with every measure of the batch form: ordered state of buckets of connections.

Connections are dealt over buckets by hash. Packets wait in their bucket's state until the watermark has passed them; then
their order is final and they are added in that order, those of all the bucket's connections by the same array steps. Of
an open flow the state keeps running moments, last times and the current active period, not packets, so its size doesn't
grow with the flow. A flow ends at a pause longer than the idle limit, seen either as the next packet or as a watermark
that far on; a timer wakes buckets with connections that fall silent.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowtide.streaming.packets import ACTIVITY_SECONDS, CONNECTION, FLAGS, IDLE_SECONDS, derived, with_connection

_PACKET = ["connection", "us", "no", "from_a", "size", "header", "flags", "window"]
_STATS = ("Mean", "Std", "Max", "Min")
#: A batch reads and writes the open flows of every bucket it has packets for; one call holds a bucket's packets.
BUCKETS = 1024


def _runs(rows: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)


class Moments:
    """Count, mean, squared distances, extremes and total of values that come in parts, for many flows at once."""

    def __init__(self, flows: int):
        self.n, self.total = np.zeros(flows, np.int64), np.zeros(flows, np.int64)
        self.mean, self.m2, self.high, self.low = (np.zeros(flows) for _ in range(4))

    def add(self, rows: np.ndarray, values: np.ndarray) -> None:
        """Add ``values`` to the flows ``rows``; those of one flow stand together."""
        if not len(rows):
            return
        starts = _runs(rows)
        at, n = rows[starts], np.diff(np.append(starts, len(rows)))
        total = np.add.reduceat(values, starts)
        mean = total / n
        m2 = np.add.reduceat((values - np.repeat(mean, n)) ** 2, starts)
        high, low = np.maximum.reduceat(values, starts), np.minimum.reduceat(values, starts)
        old, both, apart = self.n[at], self.n[at] + n, mean - self.mean[at]
        self.m2[at] += m2 + apart * apart * old * n / both
        self.mean[at] += apart * n / both
        self.high[at] = np.where(old, np.maximum(self.high[at], high), high)
        self.low[at] = np.where(old, np.minimum(self.low[at], low), low)
        self.n[at], self.total[at] = both, self.total[at] + total

    def variance(self) -> np.ndarray:
        return np.where(self.n > 1, self.m2 / np.maximum(self.n - 1, 1), 0.0)

    def stats(self, prefix: str) -> dict[str, np.ndarray]:
        return dict(zip((f"{prefix} {s}" for s in _STATS), (self.mean, self.variance() ** 0.5, self.high, self.low), strict=True))


class Flows:
    """Running measures of open flows, a row each; packets are added in order. A measure of both ways is a pair: forward, backward."""

    def __init__(self, connection: np.ndarray, from_a: np.ndarray, us: np.ndarray):
        n = len(us)
        self.connection, self.first_from_a, self.start, self.last, self.period = connection, from_a, us, us.copy(), us.copy()
        self.sizes, self.gaps = [Moments(n), Moments(n)], [Moments(n), Moments(n)]
        self.size, self.gap, self.idle, self.active = Moments(n), Moments(n), Moments(n), Moments(n)
        zeros = lambda: np.zeros(n, np.int64)
        # What a flow's first packet of a way sets holds from the first one of ``sizes`` on.
        self.last_of, self.windows, self.headers = [zeros(), zeros()], [zeros(), zeros()], [zeros(), zeros()]
        self.flags = [zeros() for _ in FLAGS]
        self.least_header, self.pushed, self.urgent, self.carrying = zeros(), zeros(), zeros(), zeros()

    def add(self, rows: np.ndarray, p: dict[str, np.ndarray], activity_us: int) -> None:
        """Add packets to the flows ``rows``; those of one flow stand together, in order."""
        if not len(rows):
            return
        us, starts = p["us"], _runs(rows)
        at, ends = rows[starts], np.append(starts[1:], len(rows)) - 1
        before = np.concatenate([[0], us[:-1]])
        before[starts] = self.last[at]
        known = np.ones(len(rows), bool)
        known[starts] = self.size.n[at] > 0
        gaps = us - before
        self.gap.add(rows[known], gaps[known])
        pauses = known & (gaps > activity_us)
        paused = rows[pauses]
        self.idle.add(paused, gaps[pauses])
        # Each pause ends an active period at the packet before it.
        begun, first = np.concatenate([[0], us[pauses][:-1]]) if len(paused) else us[pauses], _runs(paused)
        begun[first] = self.period[paused[first]]
        lengths = before[pauses] - begun
        self.active.add(paused[lengths > 0], lengths[lengths > 0])
        last = np.append(first[1:], len(paused))[:len(first)] - 1
        self.period[paused[last]] = us[pauses][last]
        self.last[at] = us[ends]
        self.size.add(rows, p["size"])
        for bit, mask in zip(self.flags, FLAGS.values(), strict=True):
            bit[at] += np.add.reduceat(((p["flags"] & mask) != 0).astype(np.int64), starts)
        forward = p["from_a"] == self.first_from_a[rows]
        for way, mine in enumerate((forward, ~forward)):
            self._add_way(way, rows[mine], {c: p[c][mine] for c in ("us", "size", "header", "flags", "window")})

    def _add_way(self, way: int, rows: np.ndarray, p: dict[str, np.ndarray]) -> None:
        if not len(rows):
            return
        us, starts = p["us"], _runs(rows)
        at, ends = rows[starts], np.append(starts[1:], len(rows)) - 1
        fresh = self.sizes[way].n[at] == 0
        before = np.concatenate([[0], us[:-1]])
        before[starts] = self.last_of[way][at]
        known = np.ones(len(rows), bool)
        known[starts] = ~fresh
        self.gaps[way].add(rows[known], (us - before)[known])
        self.last_of[way][at] = us[ends]
        self.windows[way][at] = np.where(fresh, p["window"][starts], self.windows[way][at])
        self.headers[way][at] += np.add.reduceat(p["header"], starts)
        if way == 0:
            least = np.minimum.reduceat(p["header"], starts)
            self.least_header[at] = np.where(fresh, least, np.minimum(self.least_header[at], least))
            for total, held in ((self.pushed, p["flags"] & FLAGS["PSH"]), (self.urgent, p["flags"] & FLAGS["URG"]), (self.carrying, p["size"] > 0)):
                total[at] += np.add.reduceat((held != 0).astype(np.int64), starts)
        self.sizes[way].add(rows, p["size"])

    def packed(self) -> dict:
        """Plain arrays only, so stored state doesn't depend on these classes."""
        def plain(v):
            return vars(v) if isinstance(v, Moments) else [plain(x) for x in v] if isinstance(v, list) else v
        return {name: plain(v) for name, v in vars(self).items()}

    @classmethod
    def unpacked(cls, values: dict) -> Flows:
        def whole(v):
            if isinstance(v, dict):
                out = Moments(0)
                vars(out).update(v)
                return out
            return [whole(x) for x in v] if isinstance(v, list) else v
        out = cls.none()
        vars(out).update({name: whole(v) for name, v in values.items()})
        return out

    @classmethod
    def none(cls) -> Flows:
        return cls(np.zeros(0, object), np.zeros(0, bool), np.zeros(0, np.int64))

    def taken(self, rows: np.ndarray) -> Flows:
        """Some of the flows."""
        def some(v):
            return {k: x[rows] for k, x in v.items()} if isinstance(v, dict) else [some(x) for x in v] if isinstance(v, list) else v[rows]
        return Flows.unpacked({name: some(v) for name, v in self.packed().items()})

    def joined(self, other: Flows) -> Flows:
        """These flows, then the others."""
        def both(a, b):
            if isinstance(a, dict):
                return {k: np.concatenate([a[k], b[k]]) for k in a}
            return [both(x, y) for x, y in zip(a, b, strict=True)] if isinstance(a, list) else np.concatenate([a, b])
        mine, theirs = self.packed(), other.packed()
        return Flows.unpacked({name: both(v, theirs[name]) for name, v in mine.items()})

    def ended(self) -> pd.DataFrame:
        """The measures, once the flows have ended."""
        tail = self.last - self.period
        held = np.flatnonzero(tail > 0)
        self.active.add(held, tail[held])
        out = {"connection": self.connection, "flow_us": self.start, "first_from_a": self.first_from_a, "n": self.size.n,
               "Flow Duration": self.last - self.start, "Total Fwd Packets": self.sizes[0].n, "Total Backward Packets": self.sizes[1].n,
               "Max Packet Length": self.size.high, "Min Packet Length": self.size.low, "Packet Length Mean": self.size.mean,
               "Packet Length Std": self.size.variance() ** 0.5, "Packet Length Variance": self.size.variance(),
               **self.gap.stats("Flow IAT"), **self.idle.stats("Idle"), **self.active.stats("Active"),
               **{f"{name} Flag Count": n for name, n in zip(FLAGS, self.flags, strict=True)},
               "Fwd PSH Flags": self.pushed, "Fwd URG Flags": self.urgent, "act_data_pkt_fwd": self.carrying,
               "min_seg_size_forward": self.least_header,
               "Init_Win_bytes_forward": self.windows[0], "Init_Win_bytes_backward": self.windows[1]}
        for way, name in enumerate(("Fwd", "Bwd")):
            out |= {f"Total Length of {name} Packets": self.sizes[way].total, f"{name} Header Length": self.headers[way],
                    f"{name} IAT Total": self.gaps[way].total, **self.sizes[way].stats(f"{name} Packet Length"),
                    **self.gaps[way].stats(f"{name} IAT")}
        plain = ("connection", "flow_us", "first_from_a", "n")
        return pd.DataFrame({c: v if c in plain else v.astype(np.float64) for c, v in out.items()})


_NAMES = list(Flows.none().ended().columns)
_OUT = "connection string, flow_us long, first_from_a boolean, n long, " + ", ".join(f"`{c}` double" for c in _NAMES[4:])


def _advanced(flows: Flows, p: dict[str, np.ndarray], idle_us: int, activity_us: int) -> tuple[Flows, np.ndarray]:
    """(flows, whether each has ended): ``flows``, at most one a connection, and those that packets ``p`` begin."""
    codes, names = pd.factorize(np.concatenate([flows.connection, p["connection"]]))
    old = len(flows.connection)
    order = np.lexsort((p["no"], p["us"], codes[old:]))
    p, code = {c: v[order] for c, v in p.items()}, codes[old:][order]
    starts = _runs(code)
    before = np.concatenate([[0], p["us"][:-1]]) if len(code) else p["us"]
    goes_on = np.ones(len(code), bool)
    # The codes of open flows are their rows.
    goes_on[starts] = code[starts] < old
    resumed = starts[code[starts] < old]
    before[resumed] = flows.last[code[resumed]]
    # Cut where the connection pauses longer than the idle limit.
    opens = ~goes_on | (p["us"] - before > idle_us)
    begun = np.flatnonzero(opens)
    fresh = Flows(p["connection"][begun], p["from_a"][begun], p["us"][begun])
    number = np.cumsum(opens) - 1 + old
    # Before its first cut a connection's packets belong to its open flow.
    cuts = np.cumsum(opens)
    size = np.diff(np.append(starts, len(code)))
    rows = np.where(cuts - np.repeat((cuts - opens)[starts], size) > 0, number, code)
    flows = flows.joined(fresh)
    flows.add(rows, p, activity_us)
    # The last flow of a connection may go on.
    latest = np.full(len(names), -1)
    latest[:old] = np.arange(old)
    latest[code[begun]] = old + np.arange(len(begun))
    ended = np.ones(len(flows.last), bool)
    ended[latest[latest >= 0]] = False
    return flows, ended


def _advance(idle_us: int, activity_us: int):
    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flows, waiting = pickle.loads(state.get[0]) if state.exists else (None, [])
        flows = Flows.unpacked(flows) if flows is not None else Flows.none()
        if not state.hasTimedOut:
            waiting += [{c: f[c].to_numpy() for c in _PACKET} for f in frames if len(f)]
        passed, next_of = state.getCurrentWatermarkMs() * 1000, None
        ended = np.zeros(len(flows.last), bool)
        if waiting:
            p = {c: np.concatenate([w[c] for w in waiting]) for c in _PACKET}
            final = p["us"] <= passed
            waiting = [{c: v[~final] for c, v in p.items()}] if not final.all() else []
            for w in waiting:
                # One text a connection, so that it is stored once.
                codes, names = pd.factorize(w["connection"])
                w["connection"] = names[codes]
            flows, ended = _advanced(flows, {c: v[final] for c, v in p.items()}, idle_us, activity_us)
            if waiting:
                next_of = pd.Series(waiting[0]["us"]).groupby(waiting[0]["connection"]).min()
        # Whatever is still to come lies behind the watermark.
        follows = np.zeros(len(flows.last), bool)
        if next_of is not None:
            soon = next_of.reindex(flows.connection)
            follows = (soon.notna() & (soon - flows.last <= idle_us)).to_numpy()
        ended |= (passed - flows.last > idle_us) & ~follows
        if ended.any():
            yield flows.taken(ended).ended()
        flows, follows = flows.taken(~ended), follows[~ended]
        if not len(flows.last) and not waiting:
            state.remove()
            return
        state.update((pickle.dumps((flows.packed(), waiting)),))
        wakes = [*(flows.last[~follows] + idle_us).tolist(), *(next_of.tolist() if next_of is not None else [])]
        state.setTimeoutTimestamp(max(min(wakes) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
    return run


def flow_stream(packets: DataFrame, ts: str = "ts", order: str = "packet_no", idle: float = IDLE_SECONDS,
                activity: float = ACTIVITY_SECONDS, delay: str = "10 seconds", buckets: int = BUCKETS) -> DataFrame:
    """Bidirectional flows of a packet stream, with the columns of ``packets.flows``. ``order`` breaks ties between
    packets of one instant. Packets without a time belong to no flow."""
    timed = packets.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    keyed = with_connection(timed)
    ends = [F.col(c).cast("string" if c.endswith("ip") else "long").alias(c) for c in CONNECTION]
    slim = keyed.filter(F.col(ts).isNotNull()).select(
        F.pmod(F.xxhash64(*ends), F.lit(buckets)).alias("bucket"), F.to_json(F.struct(*ends)).alias("connection"), ts,
        F.unix_micros(ts).alias("us"), F.coalesce(F.col(order).cast("long"), F.lit((1 << 63) - 1)).alias("no"), "from_a",
        *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(n) for c, n in (
            ("payload_len", "size"), ("header_len", "header"), ("tcp_flags", "flags"), ("window", "window"))])
    found = slim.groupBy("bucket").applyInPandasWithState(
        _advance(int(idle * 1e6), int(activity * 1e6)), _OUT, "flows binary", "append", GroupStateTimeout.EventTimeTimeout)
    found = found.withColumn("connection", F.from_json("connection", "a_ip string, a_port long, b_ip string, b_port long, protocol long"))
    found = found.select(*[F.col(f"connection.{c}").alias(c) for c in CONNECTION], *[F.col(f"`{c}`") for c in found.columns if c != "connection"])
    a, b = (F.struct(F.col(f"{s}_ip").alias("ip"), F.col(f"{s}_port").cast("int").alias("port")) for s in "ab")
    here, there = F.when(F.col("first_from_a"), a).otherwise(b), F.when(F.col("first_from_a"), b).otherwise(a)
    first = F.struct(here["ip"].alias("src_ip"), here["port"].alias("src_port"), there["ip"].alias("dst_ip"), there["port"].alias("dst_port"))
    return derived(found.withColumns({"first": first, "flow_start": F.timestamp_micros("flow_us"), "protocol": F.col("protocol").cast("int")})
                   .drop("flow_us", "first_from_a"))
