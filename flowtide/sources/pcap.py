"""Capture files as packet rows: Spark lists the files, each task decodes its own."""

from __future__ import annotations

import socket
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

PACKETS = ("file string, packet_no bigint, ts_us bigint, src_ip string, dst_ip string, src_port int, "
           "dst_port int, protocol int, payload_len int, header_len int, tcp_flags int, window int")
_COLUMNS = [c.split()[0] for c in PACKETS.split(", ")]
_CHUNK = 50_000

# --- Fixed values: capture file magics -> (byte order, ticks per second). ---
_MAGICS = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6),
           b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}
_NEXT_GENERATION = b"\x0a\x0d\x0d\x0a"
ETHERNET, RAW_IP, LINUX_COOKED = 1, 101, 113
TCP, UDP = 6, 17


def _records(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(time in microseconds, link type, frame) of every packet; a cut-off tail is ignored."""
    if data[:4] == _NEXT_GENERATION:
        yield from _blocks(data)
        return
    if data[:4] not in _MAGICS:
        return
    order, ticks = _MAGICS[data[:4]]
    link = struct.unpack_from(order + "I", data, 20)[0] & 0x0FFFFFFF
    at = 24
    while at + 16 <= len(data):
        seconds, fraction, size, _ = struct.unpack_from(order + "IIII", data, at)
        at += 16
        yield seconds * 1_000_000 + fraction * 1_000_000 // ticks, link, data[at:at + size]
        at += size


def _blocks(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Packets of a block-structured capture: interfaces and enhanced packet blocks."""
    at, order, interfaces = 0, "<", []
    while at + 12 <= len(data):
        if data[at:at + 4] == _NEXT_GENERATION:
            order = "<" if data[at + 8:at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
            interfaces = []
        kind, size = struct.unpack_from(order + "II", data, at)
        if size < 12:
            return
        if kind == 1:
            interfaces.append((struct.unpack_from(order + "H", data, at + 8)[0],
                               _ticks(data[at + 16:at + size - 4], order)))
        elif kind == 6 and at + 28 <= len(data):
            port, high, low, captured, _ = struct.unpack_from(order + "IIIII", data, at + 8)
            if port < len(interfaces):
                link, ticks = interfaces[port]
                yield (high << 32 | low) * 1_000_000 // ticks, link, data[at + 28:at + 28 + captured]
        at += size


def _ticks(options: bytes, order: str) -> int:
    """Clock resolution among interface options; microseconds unless stated."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "HH", options, at)
        if code == 9 and size:
            value = options[at + 4]
            return 2 ** (value & 127) if value & 128 else 10 ** value
        if code == 0:
            break
        at += 4 + (size + 3) // 4 * 4
    return 10**6


def decode(frame: bytes, link: int) -> tuple | None:
    """Addresses, ports and sizes of a TCP or UDP packet; None for anything else."""
    if link == ETHERNET:
        at, kind = 14, frame[12:14]
        while kind in (b"\x81\x00", b"\x88\xa8") and len(frame) >= at + 4:
            kind, at = frame[at + 2:at + 4], at + 4
    elif link == LINUX_COOKED:
        at, kind = 16, frame[14:16]
    elif link == RAW_IP and frame:
        at, kind = 0, b"\x08\x00" if frame[0] >> 4 == 4 else b"\x86\xdd"
    else:
        return None
    try:
        if kind == b"\x08\x00":
            inner = (frame[at] & 15) * 4
            total, protocol = struct.unpack_from(">H", frame, at + 2)[0], frame[at + 9]
            if struct.unpack_from(">H", frame, at + 6)[0] & 0x1FFF:
                return None  # a later fragment carries no ports
            src, dst = socket.inet_ntoa(frame[at + 12:at + 16]), socket.inet_ntoa(frame[at + 16:at + 20])
        elif kind == b"\x86\xdd":
            inner, protocol = 40, frame[at + 6]
            total = 40 + struct.unpack_from(">H", frame, at + 4)[0]
            src = socket.inet_ntop(socket.AF_INET6, frame[at + 8:at + 24])
            dst = socket.inet_ntop(socket.AF_INET6, frame[at + 24:at + 40])
        else:
            return None
        upper = at + inner
        if protocol not in (TCP, UDP):
            return None
        sport, dport = struct.unpack_from(">HH", frame, upper)
        if protocol == TCP:
            header, flags = (frame[upper + 12] >> 4) * 4, frame[upper + 13]
            window = struct.unpack_from(">H", frame, upper + 14)[0]
        else:
            header, flags, window = 8, 0, 0
    except (struct.error, IndexError, OSError, ValueError):
        return None
    return src, dst, sport, dport, protocol, max(total - inner - header, 0), header, flags, window


def _decode_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            rows = []
            for number, (ts, link, frame) in enumerate(_records(content)):
                packet = decode(frame, link)
                if packet is None:
                    continue
                rows.append((path, number, ts, *packet))
                if len(rows) >= _CHUNK:
                    yield pd.DataFrame(rows, columns=_COLUMNS)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=_COLUMNS)


def read_packets(spark: SparkSession, path: str, pattern: str = "*.pcap*") -> DataFrame:
    """TCP and UDP packets of every capture file below ``path``. A file is decoded by one task, so
    long captures should be rotated into many files, as capture tools do."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", "true").load(path).filter("length > 0").select("path", "content"))
    return files.mapInPandas(_decode_files, PACKETS).withColumn("ts", F.timestamp_micros("ts_us"))
