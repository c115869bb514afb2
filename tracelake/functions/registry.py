"""Functions for SQL users: register(spark) makes them known to the session.

hex_dump, time_of_day and flow_key are SQL functions, which Catalyst inlines; tls_sni and dns_decode run on Arrow
batches; dns_records is a table function, a row for each record of a message."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracelake.functions import dns, tls

_END = "STRUCT<ip: BINARY, port: BIGINT>"
SQL_FUNCTIONS = {
    "time_of_day(ts_us BIGINT) RETURNS STRING": "date_format(timestamp_micros(ts_us), 'HH:mm:ss.SSSSSS')",
    "hex_dump(data BINARY) RETURNS STRING": """CASE WHEN octet_length(data) = 0 THEN '' ELSE array_join(transform(
        sequence(0, cast(greatest(octet_length(data) - 1, 0) / 16 AS INT) * 16, 16),
        at -> lpad(lower(hex(cast(at AS BIGINT))), 4, '0') || '  '
          || rpad(regexp_replace(lower(hex(substring(data, at + 1, 8))), '(..)', '$1 '), 24, ' ') || ' '
          || rpad(regexp_replace(lower(hex(substring(data, at + 9, 8))), '(..)', '$1 '), 24, ' ') || ' |'
          || regexp_replace(decode(substring(data, at + 1, 16), 'ISO-8859-1'), '[^ -~]', '.') || '|\\n'), '') END""",
    f"flow_key(protocol STRING, src_ip BINARY, src_port BIGINT, dst_ip BINARY, dst_port BIGINT) RETURNS STRUCT<protocol: STRING, a: {_END}, b: {_END}, a_to_b: BOOLEAN>": """
        named_struct('protocol', protocol, 'a', least(named_struct('ip', src_ip, 'port', src_port), named_struct('ip', dst_ip, 'port', dst_port)),
          'b', greatest(named_struct('ip', src_ip, 'port', src_port), named_struct('ip', dst_ip, 'port', dst_port)),
          'a_to_b', named_struct('ip', src_ip, 'port', src_port) <= named_struct('ip', dst_ip, 'port', dst_port))""",
}


def _tls_sni(payload: pa.Array) -> pa.Array:
    return pa.array(map(tls.server_name, payload.to_pylist()), pa.string())


def _dns_decode(payload: pa.Array) -> pa.Array:
    return pa.array([dns.body(x) for x in payload.to_pylist()], dns.BODY)


class DnsRecords:
    """The records of a message's sections, as far as they can be read; none for what is no message."""

    def eval(self, payload: bytes):
        found = dns.body(None if payload is None else bytes(payload))
        for r in found["records"] if found else ():
            yield r["section"], r["name"], r["type"], r["class"], r["ttl"], r["data"]


def register(spark: SparkSession) -> None:
    for head, text in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {text}")
    spark.udf.register("tls_sni", F.arrow_udf(_tls_sni, "string"))
    spark.udf.register("dns_decode", F.arrow_udf(_dns_decode, dns.BODY_TYPE))
    spark.udtf.register("dns_records", F.udtf(DnsRecords, returnType="section: string, name: string, type: string, class: string, ttl: bigint, data: string"))
