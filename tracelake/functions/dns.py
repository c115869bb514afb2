"""DNS messages in UDP payloads. The header is read with Columns; names, which may point backwards into
the message, and the sections are read in Arrow batches, for the messages alone."""

from __future__ import annotations

import ipaddress
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The format's limits, and names of types and classes.
HEADER, PORT = 12, 53
JUMPS, LABELS, NAME, ENTRIES, HEX_SHOWN = 32, 128, 255, 1024, 24
TYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 41: "OPT", 255: "ANY"}
CLASSES = {1: "IN", 3: "CH", 4: "HS", 255: "ANY"}
FLAGS = {"authoritative": 10, "truncated": 9, "recursion_desired": 8, "recursion_available": 7, "authenticated": 5, "checking_disabled": 4}
SECTIONS = ("answer", "authority", "additional")

_QUESTION = pa.struct([("name", pa.string()), ("type", pa.string()), ("class", pa.string())])
_RECORD = pa.struct([("section", pa.string()), ("name", pa.string()), ("type", pa.string()), ("class", pa.string()), ("ttl", pa.int64()), ("data", pa.string())])
BODY = pa.struct([("question", pa.binary()), ("complete", pa.bool_()), ("questions", pa.list_(_QUESTION)), ("records", pa.list_(_RECORD))])
BODY_TYPE = (
    "question binary, complete boolean, questions array<struct<name: string, type: string, class: string>>, "
    "records array<struct<section: string, name: string, type: string, class: string, ttl: bigint, data: string>>"
)


class Malformed(ValueError):
    """The message breaks the format."""


def labels_at(message: bytes, at: int) -> tuple[list[bytes], int]:
    """The labels of the name at ``at`` and where what follows it starts."""
    found, size, jumps, after = [], 0, 0, None
    while True:
        head = message[at : at + 1]
        if not head:
            raise Malformed("name ends early")
        kind, n = head[0] >> 6, head[0] & 63
        if kind == 3:
            if at + 2 > len(message):
                raise Malformed("pointer ends early")
            target = n << 8 | message[at + 1]
            jumps += 1
            if target >= at or jumps > JUMPS:
                raise Malformed("pointer")
            after = at + 2 if after is None else after
            at = target
        elif kind:
            raise Malformed("label kind")
        elif not n:
            return found, at + 1 if after is None else after
        else:
            label = message[at + 1 : at + 1 + n]
            size += n + bool(found)
            if len(label) < n or len(found) == LABELS or size > NAME:
                raise Malformed("label")
            found.append(label)
            at += 1 + n


def shown(label: bytes) -> str:
    return "".join(chr(c) if 32 <= c < 127 else f"\\x{c:02x}" for c in label)


def name_text(labels: list[bytes]) -> str:
    return ".".join(map(shown, labels)) or "."


def _fields(message: bytes, at: int, form: str) -> tuple:
    try:
        return struct.unpack_from(form, message, at)
    except struct.error:
        raise Malformed("fields end early") from None


def _data_text(message: bytes, kind: int, at: int, end: int) -> str:
    data = message[at:end]
    if (kind, len(data)) in ((1, 4), (28, 16)):
        return str(ipaddress.ip_address(data))
    if kind in (2, 5, 12):
        try:
            return name_text(labels_at(message, at)[0])
        except Malformed:
            return "<invalid-name>"
    if kind == 15:
        try:
            if len(data) < 3:
                raise Malformed("preference")
            return f"preference={data[0] << 8 | data[1]} exchange={name_text(labels_at(message, at + 2)[0])}"
        except Malformed:
            return "<invalid-mx>"
    if kind == 16:
        parts = []
        while data:
            if len(data) <= data[0]:
                return "<invalid-txt>"
            parts.append(f'"{shown(data[1 : data[0] + 1])}"')
            data = data[data[0] + 1 :]
        return " ".join(parts) or '""'
    return "0x" + data[:HEX_SHOWN].hex() + "..." * (len(data) > HEX_SHOWN)


def _named(table: dict, other: str, number: int) -> str:
    return table.get(number, f"{other}{number}")


def body(message: bytes | None, details: bool = True) -> dict | None:
    """question: the key of the first question if there is one only; complete: whether all sections can be
    read; questions and records: as far as they can be, none without ``details``."""
    if message is None or len(message) < HEADER:
        return None
    counts, at, questions, records = _fields(message, 4, "!4H"), HEADER, [], []
    key, complete = None, sum(counts) <= ENTRIES
    if counts[0] == 1:
        try:
            labels, end = labels_at(message, HEADER)
            _fields(message, end, "!HH")
            key = b"".join(bytes([len(x)]) + x.lower() for x in labels) + message[end : end + 4]
        except Malformed:
            complete = False
    try:
        for section, count in zip(("question", *SECTIONS), counts if complete else ()):
            for _ in range(count):
                labels, at = labels_at(message, at)
                kind, group = _fields(message, at, "!HH")
                at += 4
                own = {"name": name_text(labels), "type": _named(TYPES, "TYPE", kind), "class": _named(CLASSES, "CLASS", group)} if details else None
                if section == "question":
                    questions += [own] * details
                    continue
                ttl, size = _fields(message, at, "!IH")
                at += 6 + size
                if at > len(message):
                    raise Malformed("data ends early")
                if details:
                    records.append({"section": section, **own, "ttl": ttl, "data": _data_text(message, kind, at - size, at)})
    except Malformed:
        complete = False
    return {"question": key, "complete": complete, "questions": questions, "records": records}


def _bits(flags: Column, at: int, width: int = 1) -> Column:
    return F.shiftright(flags, at).bitwiseAND(F.lit((1 << width) - 1))


def messages(packets: DataFrame, details: bool = True) -> DataFrame:
    """UDP packets from or to port 53 with a whole header, and the message's dns_id, response, opcode, rcode,
    FLAGS, the four counts and the columns of BODY. Payloads that are null or short are no messages."""

    @F.arrow_udf(returnType=BODY_TYPE)
    def read(payload: pa.Array) -> pa.Array:
        return pa.array([body(x, details) for x in payload.to_pylist()], BODY)

    def word(k: int) -> Column:
        return F.conv(F.hex(F.substring("payload", 2 * k + 1, 2)), 16, 10).cast("int")

    own = packets.filter((F.col("protocol") == "udp") & ((F.col("src_port") == PORT) | (F.col("dst_port") == PORT)) & (F.octet_length("payload") >= HEADER))
    flags = word(1)
    head = {"dns_id": word(0).cast("long"), "response": _bits(flags, 15) == 1, "opcode": _bits(flags, 11, 4), "rcode": _bits(flags, 0, 4).cast("long"), **{f: _bits(flags, k) == 1 for f, k in FLAGS.items()}}
    counts = {c: word(k) for k, c in enumerate(("question_count", "answer_count", "authority_count", "additional_count"), 2)}
    parts = own.withColumns({**head, **counts, "__body": read(F.col("payload"))})
    return parts.withColumns({c: F.col(f"__body.{c}") for c in ("question", "complete", "questions", "records")}).drop("__body")
