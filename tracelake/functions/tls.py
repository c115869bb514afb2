"""The server name that a TLS client asks for, from one TCP payload; split hellos are not put together."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The format's limits.
RECORD, EXTENSIONS, EXTENSION_COUNT, SESSION, NAMES, NAME = 18_432, 16_384, 64, 32, 16, 255
HOST = re.compile(rb"(?!-)[0-9A-Za-z-]{1,63}(?<!-)(?:\.(?!-)[0-9A-Za-z-]{1,63}(?<!-))*\Z")


class _Short(ValueError):
    pass


class _Part:
    """Reads numbers and length-prefixed parts from the front of some bytes."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        self.at += n
        if self.at > len(self.data):
            raise _Short
        return self.data[self.at - n : self.at]

    def number(self, size: int) -> int:
        return int.from_bytes(self.take(size))

    def part(self, size: int, most: int = 1 << 24) -> "_Part":
        n = self.number(size)
        if n > most:
            raise _Short
        return _Part(self.take(n))

    def left(self) -> int:
        return len(self.data) - self.at


def server_name(payload: bytes | None) -> str | None:
    """The first host name of the first server-name extension, if all up to it is well formed."""
    try:
        outer = _Part(payload or b"")
        if outer.number(1) != 22 or not 0x0301 <= outer.number(2) <= 0x0304:
            return None
        record = outer.part(2, RECORD)
        if record.number(1) != 1:
            return None
        hello = record.part(3)
        hello.take(34)
        hello.part(1, SESSION)
        ciphers = hello.part(2).left()
        if not ciphers or ciphers % 2 or not hello.part(1).left():
            return None
        extensions = hello.part(2, EXTENSIONS)
        for _ in range(EXTENSION_COUNT):
            if extensions.number(2):
                extensions.part(2)
                continue
            entry = extensions.part(2)
            names = entry.part(2)
            if entry.left():
                return None
            for _ in range(NAMES):
                kind, host = names.number(1), names.part(2).data
                if not kind:
                    return host.decode() if len(host) <= NAME and HOST.match(host) else None
            return None
    except _Short:
        pass
    return None


def server_names(packets: DataFrame) -> DataFrame:
    """The TCP packets that start a handshake record, with tls_sni, null where there is no valid name."""

    @F.arrow_udf(returnType="string")
    def read(payload: pa.Array) -> pa.Array:
        return pa.array(map(server_name, payload.to_pylist()), pa.string())

    start = F.hex(F.substring("payload", 1, 2)) == "1603"
    return packets.filter((F.col("protocol") == "tcp") & start).withColumn("tls_sni", read(F.col("payload")))
