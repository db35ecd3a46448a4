"""Small column expressions: time, formatting, JSON, escaping, addresses."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from flowtide.schemas import col

SQL_TIME = "yyyy-MM-dd HH:mm:ss"


def utc_text(ts: Column) -> Column:
    """Second-resolution UTC text."""
    return F.date_format(ts, SQL_TIME)


def minutes_before(as_of: Column, minutes: int) -> Column:
    return as_of - F.make_dt_interval(mins=F.lit(minutes))


def hours_before(as_of: Column, hours: int) -> Column:
    return as_of - F.make_dt_interval(hours=F.lit(hours))


def fixed(value: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, rounded on the exact binary value, ties to even.

    ``format_string`` alone rounds the shortest decimal form half up. The product with 10^digits
    is split into its rounded value and its rounding error, which decides apparent ties.
    """
    size = F.abs(value)
    scale = 10.0 ** digits
    splitter = 134217729.0  # 2^27 + 1 halves the mantissa
    scale_hi = splitter * scale - (splitter * scale - scale)
    scale_lo = scale - scale_hi
    product = size * scale
    high = size * splitter - (size * splitter - size)
    low = size - high
    error = ((high * scale_hi - product) + high * scale_lo + low * scale_hi) + low * scale_lo
    whole = F.floor(product)
    rest = product - whole
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    units = whole + F.when(up, 1).otherwise(0)
    ten = F.lit(int(scale))
    text = F.concat(F.when(value < 0, "-").otherwise(""), F.floor(units / ten).cast("string"), F.lit("."),
                    F.lpad((units % ten).cast("string"), digits, "0"))
    return F.when(size < 1e11, text).otherwise(F.format_string(f"%.{digits}f", value))


def percent(value: Column, digits: int = 1) -> Column:
    """Share shown as a percentage, e.g. ``97.3%``."""
    return F.concat(fixed(value * 100.0, digits), F.lit("%"))


def bytes_to_kb(value: Column) -> Column:
    return value / F.lit(1024.0)


def features_to_json(names: list[str]) -> Column:
    """JSON object of the named feature columns; absent values are left out."""
    return F.to_json(F.struct(*[col(n) for n in names]))


def json_features(text: Column) -> Column:
    """Map of features from JSON text; null when the text is not an object or is empty."""
    bag = F.from_json(text, "map<string,double>")
    return F.when(F.size(bag) > 0, bag)


def slash_names(name: Column) -> Column:
    """Class names whose dash was lost in an encoding error get a slash instead."""
    return F.replace(name, F.lit("�"), F.lit("/"))


def escape_message(text: Column) -> Column:
    """Escape the three characters that matter in message markup."""
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def escape_display(text: Column) -> Column:
    """Escape five characters for on-screen display; null becomes empty."""
    text = escape_message(F.coalesce(text, F.lit("")))
    for plain, escaped in (('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def protocol_name(protocol: Column) -> Column:
    return F.when(protocol == 6, "TCP").when(protocol == 17, "UDP").otherwise("Other")


# Dotted quad without leading zeros.
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_PATTERN = rf"^{_OCTET}(\.{_OCTET}){{3}}$"


def is_ipv4(address: Column) -> Column:
    return F.trim(address).rlike(IPV4_PATTERN)


@F.pandas_udf(T.BooleanType())
def _is_ipv6(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import ipaddress

    def check(text: str | None) -> bool:
        try:
            return ipaddress.ip_address((text or "").strip()).version == 6
        except ValueError:
            return False

    for batch in batches:
        yield batch.map(check).astype(bool)


def is_ip_address(address: Column, ipv6: bool = True) -> Column:
    """Valid IPv4 or IPv6 text after trimming. Python sees only values holding a colon."""
    v4 = F.coalesce(is_ipv4(address), F.lit(False))
    if not ipv6:
        return v4
    suspect = F.when(address.contains(":"), address)
    return v4 | (F.coalesce(address.contains(":"), F.lit(False)) & _is_ipv6(suspect))


def is_chat_id(chat_id: Column) -> Column:
    """Signed run of digits."""
    return F.coalesce(F.trim(chat_id).rlike(r"^-?\d+$"), F.lit(False))


def pack_ipv4(address: Column) -> Column:
    """Dotted quad -> unsigned 32-bit value in a long; null for anything else."""
    parts = F.split(F.trim(address), r"\.")
    number = F.lit(0).cast("long")
    for i in range(4):
        number = F.shiftleft(number, 8).bitwiseOR(parts.getItem(i).try_cast("long"))
    return F.when(is_ipv4(address), number)


def unpack_ipv4(number: Column) -> Column:
    parts = [F.shiftright(number, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.concat_ws(".", *parts)


def network_address(address: Column, netmask: Column) -> Column:
    return unpack_ipv4(pack_ipv4(address).bitwiseAND(pack_ipv4(netmask)))


def broadcast_address(address: Column, netmask: Column) -> Column:
    host_bits = pack_ipv4(netmask).bitwiseXOR(F.lit(0xFFFFFFFF))
    return unpack_ipv4(pack_ipv4(address).bitwiseOR(host_bits))
