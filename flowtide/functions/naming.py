"""Feature-name resolution and reducer roles. Runs on the driver over column names only."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

# --- Fixed values: names without separators that mean the same feature. ---
_SAME_FEATURE: tuple[tuple[str, ...], ...] = (
    ("destinationport", "dstport"),
    ("flowbytess", "flowbytss"),
    ("flowpacketss", "flowpktss"),
    ("fwdpacketss", "fwdpktss"),
    ("bwdpacketss", "bwdpktss"),
    ("averagepacketsize", "pktsizeavg"),
    ("avgfwdsegmentsize", "fwdsegsizeavg"),
    ("avgbwdsegmentsize", "bwdsegsizeavg"),
    ("totalfwdpackets", "totfwdpkts"),
    ("totalbackwardpackets", "totbwdpkts"),
    ("totallengthoffwdpackets", "totlenfwdpkts"),
    ("totallengthofbwdpackets", "totlenbwdpkts"),
    ("fwdiattotal", "fwdiattot"),
    ("bwdiattotal", "bwdiattot"),
    ("fwdheaderlength", "fwdheaderlen"),
    ("bwdheaderlength", "bwdheaderlen"),
    ("minsegsizeforward", "fwdsegsizemin"),
    ("actdatapktfwd", "fwdactdatapkts"),
    ("initwinbytesforward", "initfwdwinbyts"),
    ("initwinbytesbackward", "initbwdwinbyts"),
    ("finflagcount", "finflagcnt"),
    ("synflagcount", "synflagcnt"),
    ("rstflagcount", "rstflagcnt"),
    ("pshflagcount", "pshflagcnt"),
    ("ackflagcount", "ackflagcnt"),
    ("urgflagcount", "urgflagcnt"),
    ("eceflagcount", "eceflagcnt"),
    ("cweflagcount", "cwrflagcount"),
    ("subflowfwdpackets", "subflowfwdpkts"),
    ("subflowfwdbytes", "subflowfwdbyts"),
    ("fwdpktlenmax", "fwdpacketlengthmax"),
    ("fwdpktlenmin", "fwdpacketlengthmin"),
    ("fwdpktlenmean", "fwdpacketlengthmean"),
    ("fwdpktlenstd", "fwdpacketlengthstd"),
    ("bwdpktlenmax", "bwdpacketlengthmax"),
    ("bwdpktlenmin", "bwdpacketlengthmin"),
    ("bwdpktlenmean", "bwdpacketlengthmean"),
    ("bwdpktlenstd", "bwdpacketlengthstd"),
    ("pktlenmax", "packetlengthmax", "maxpacketlength"),
    ("pktlenmin", "packetlengthmin", "minpacketlength"),
    ("pktlenmean", "packetlengthmean"),
    ("pktlenstd", "packetlengthstd"),
    ("pktlenvar", "packetlengthvariance", "packetlengthvar"),
    ("flowiatmax", "flowiatmaximum"),
    ("flowiatmin", "flowiatminimum"),
    ("fwdiatmax", "fwdiatmaximum"),
    ("fwdiatmin", "fwdiatminimum"),
    ("bwdiatmax", "bwdiatmaximum"),
    ("bwdiatmin", "bwdiatminimum"),
    ("subflowbwdpkts", "subflowbwdpackets"),
    ("subflowbwdbyts", "subflowbwdbytes"),
)
# --- Fixed values: words that mean the same inside a name; groups that share a word are one. ---
_SAME_WORD: tuple[tuple[str, ...], ...] = (
    ("fwd", "forward", "fwdt"),
    ("bwd", "backward", "back", "bwt"),
    ("pkts", "pkt", "packets", "packet"),
    ("byts", "byt", "byte", "bytes"),
    ("len", "length"),
    ("segsz", "segment", "segments", "segmentsize"),
    ("win", "window"),
    ("totlen", "tot", "total", "totallength"),
    ("proto", "protocol"),
    ("init", "initial"),
    ("mean", "avg", "average"),
    ("max", "maximum"),
    ("min", "minimum"),
    ("std", "standard"),
)
# --- Fixed values: tokens deciding a feature's reducer, in order of precedence. ---
_ROLE_TOKENS: tuple[tuple[str, frozenset[str]], ...] = (
    ("identity", frozenset({"src_ip", "dst_ip", "src_port", "dst_port", "protocol", "flow_id",
                            "timestamp", "source_ip", "destination_ip", "port", "ports"})),
    ("rate", frozenset({"s", "sec", "secs", "second", "seconds", "rate"})),
    ("max", frozenset({"max", "maximum", "win", "window"})),
    ("min", frozenset({"min", "minimum"})),
    ("std", frozenset({"std", "standard", "var", "variance", "dev", "deviation"})),
    ("mean", frozenset({"mean", "avg", "average", "ratio"})),
)
_PACKET_TOKENS = frozenset({"pkt", "pkts", "packet", "packets"})
_DIRECTION_TOKENS = frozenset({"fwd", "bwd", "forward", "backward"})
_TOTAL_TOKENS = frozenset({"tot", "total"})

_SEPARATORS = re.compile(r"[\s_.\-/]+")
_WORDS = re.compile(r"\d+|[^\d_]+")


def classes(groups: Iterable[Sequence[str]]) -> dict[str, str]:
    """Member -> representative of its class, by union-find: groups that share a member become one class."""
    above: dict[str, str] = {}

    def top(word: str) -> str:
        above.setdefault(word, word)
        while above[word] != word:
            above[word] = above[above[word]]
            word = above[word]
        return word

    for group in groups:
        for word in group[1:]:
            above[top(word)] = top(group[0])
    return {word: top(word) for word in list(above)}


FEATURE_CLASS = classes(_SAME_FEATURE)
WORD_CLASS = classes(_SAME_WORD)


def squeeze(name: str) -> str:
    """Lower-case name without separators."""
    return _SEPARATORS.sub("", name or "").lower()


def normalize(name: str) -> str:
    """The class of the squeezed name: one spelling that stands for all of them."""
    plain = squeeze(name)
    return FEATURE_CLASS.get(plain, plain)


def tokens(name: str) -> list[str]:
    """Lower-case words of a name, cut at separators and between letters and digits."""
    return _WORDS.findall(_SEPARATORS.sub("_", str(name)).lower())


def canonical(name: str) -> str:
    """The name with every word replaced by the one that stands for its class. Two names that differ by synonyms only
    are equal here, however many of their words have synonyms."""
    return "".join(WORD_CLASS.get(t, t) for t in tokens(name))


class NameIndex:
    """Index over available names that answers which of them can supply a required name."""

    def __init__(self, available: Iterable[str]):
        self.names = list(available)
        self._direct: dict[str, list[str]] = {}
        self._worded: dict[str, list[int]] = {}
        for at, name in enumerate(self.names):
            self._direct.setdefault(normalize(name), []).append(name)
            for key in {canonical(name), squeeze(name)}:
                self._worded.setdefault(key, []).append(at)

    def candidates(self, required: str) -> list[str]:
        """Suppliers of ``required``, best first: other spellings of the feature, the name without a trailing number,
        names whose words are synonyms. Among several spellings the later column wins; among synonyms the earlier one."""
        found = [n for key in lookups(required) for n in reversed(self._direct.get(key, ()))]
        worded = {at for key in (canonical(required), squeeze(required)) for at in self._worded.get(key, ())}
        found += [self.names[at] for at in sorted(worded)]
        return list(dict.fromkeys(found))


def lookups(required: str) -> list[str]:
    """Classes that supply a required name directly."""
    return [normalize(required), normalize(re.sub(r"\d+$", "", squeeze(required)))]


def resolve(available: Sequence[str], required: Sequence[str]) -> dict[str, list[str]]:
    """Required name -> ordered list of supplying names (empty when nothing matches)."""
    index = NameIndex(available)
    return {name: index.candidates(name) for name in required}


def role_of(feature: str) -> str:
    """Reducer role of a feature: identity, rate, max, min, std, mean or sum."""
    words = {t for t in tokens(feature) if not t.isdigit()}
    for role, vocabulary in _ROLE_TOKENS:
        if words & vocabulary:
            return role
    return "sum"


def packet_weight_features(features: Iterable[str], weighting: str = "reference") -> list[str]:
    """Features whose sum weighs a member flow.

    ``reference`` takes every packet-named feature that is a total or has no direction;
    ``packets`` takes the two packet totals only.
    """
    chosen = []
    for name in features:
        words = set(tokens(name))
        if not words & _PACKET_TOKENS:
            continue
        if weighting == "packets":
            if words & _TOTAL_TOKENS and not words & {"len", "length"}:
                chosen.append(name)
        elif words & _TOTAL_TOKENS or not words & _DIRECTION_TOKENS:
            chosen.append(name)
    return chosen


def duration_feature(features: Iterable[str]) -> str | None:
    """First feature carrying the token ``duration``."""
    return next((n for n in features if "duration" in tokens(n)), None)


# --- Fixed values: column titles that carry flow identity, in order of preference. ---
_IDENTITY_TITLES: dict[str, tuple[str, ...]] = {
    "src_ip": ("source ip", "src ip", "source_ip", "src_ip", "sourceip", "srcip", "src_host",
               "source host"),
    "dst_ip": ("destination ip", "dst ip", "destination_ip", "dst_ip", "destinationip", "dstip",
               "dst_host", "destination host"),
    "src_port": ("src port", "source port", "src_port", "source_port"),
    "dst_port": ("dst port", "destination port", "dst_port", "destination_port"),
    "protocol": ("protocol",),
}
_IDENTITY_FRAGMENTS = {"src_ip": ("src", "source"), "dst_ip": ("dst", "destination")}


def identity_columns(columns: Sequence[str]) -> dict[str, str | None]:
    """Which columns hold addresses, ports and protocol: titles first, then fragments."""
    lowered = {c.strip().lower(): c for c in columns}
    found: dict[str, str | None] = {}
    for field, titles in _IDENTITY_TITLES.items():
        hit = next((lowered[t] for t in titles if t in lowered), None)
        if hit is None and field in _IDENTITY_FRAGMENTS:
            hit = next((original for low, original in lowered.items()
                        if "ip" in low and any(f in low for f in _IDENTITY_FRAGMENTS[field])), None)
        found[field] = hit
    return found
