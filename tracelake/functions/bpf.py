"""A subset of the capture-filter language, compiled to a Column over packet rows, for tables without the frames' bytes.

It tests what decoding found, so a frame counts by its innermost headers: inside VLANs too, but not by a transport header
that is cut or not in this fragment. capture_filter.py is the language over bytes.

expr: term {(and | or) term}; term: not term | (expr) | primitive. Primitives: ip, ip6, tcp, udp, icmp, icmp6, arp,
[tcp | udp] [src | dst] (host A | net A/N | port P | portrange P-Q), less N, greater N. Like the
original, ``and`` and ``or`` bind alike, to the left. Anything else is rejected.
"""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PROTOCOLS = ("tcp", "udp", "icmp", "icmp6", "arp")
VERSIONS = {"ip": 4, "ip6": 6}


def compile_filter(text: str, packed: bool = False) -> Column:
    """Addresses are 32-bit numbers or, if packed, the bytes that decoding gives; ip and ip6 need ip_version."""
    words = re.findall(r"[()]|&&|\|\||!|[^\s()!]+", text)
    at = 0

    def peek() -> str | None:
        return words[at] if at < len(words) else None

    def take(*wanted: str) -> str:
        nonlocal at
        word = peek()
        if word is None or (wanted and word not in wanted):
            raise ValueError(f"filter {text!r}: {' or '.join(wanted) or 'a word'} expected, found {word!r}")
        at += 1
        return word

    def sides(way: str | None, test) -> Column:
        found = [test(s) for s in ("src", "dst") if way in (None, s)]
        return found[0] if len(found) == 1 else found[0] | found[1]

    def primitive() -> Column:
        word = peek()
        if word in ("less", "greater"):
            take()
            n = int(take())
            return F.col("wire_len") <= n if word == "less" else F.col("wire_len") >= n
        if word in VERSIONS:
            return F.coalesce(F.col("ip_version") == VERSIONS[take()], F.lit(False))
        kind = take() if word in PROTOCOLS else None
        way = take() if peek() in ("src", "dst") else None
        what = peek()
        if what in ("port", "portrange"):
            take()
            low, _, high = take().partition("-")
            if (what == "portrange") != bool(high):
                raise ValueError(f"filter {text!r}: {what} takes {'P-Q' if what == 'portrange' else 'one number'}")
            out = sides(way, lambda s: F.col(f"{s}_port").between(int(low), int(high or low)))
            out = out & (F.col("protocol").isin("tcp", "udp") if kind is None else F.col("protocol") == kind)
        elif what in ("host", "net"):
            take()
            net = ipaddress.ip_network(take(), strict=what == "net")
            if packed:
                first, last = (F.lit(bytearray(a.packed)) for a in (net[0], net[-1]))
                out = sides(way, lambda s: (F.octet_length(f"{s}_ip") == net.max_prefixlen // 8) & F.col(f"{s}_ip").between(first, last))
            else:
                out = sides(way, lambda s: F.col(f"{s}_ip").between(int(net[0]), int(net[-1])))
            out = out if kind is None else out & (F.col("protocol") == kind)
        elif kind is not None and way is None:
            out = F.col("protocol") == kind
        else:
            raise ValueError(f"filter {text!r}: {what!r} is not supported")
        return F.coalesce(out, F.lit(False))

    def term() -> Column:
        if peek() in ("not", "!"):
            take()
            return ~term()
        if peek() == "(":
            take()
            out = expr()
            take(")")
            return out
        return primitive()

    def expr() -> Column:
        out = term()
        while peek() in ("and", "or", "&&", "||"):
            out = out & term() if take() in ("and", "&&") else out | term()
        return out

    if not words:
        return F.lit(True)
    out = expr()
    if peek() is not None:
        raise ValueError(f"filter {text!r}: {peek()!r} is left over")
    return out
