"""Queries over the driver's tables, by name, with SQL that computes the same where SQL can.

The tables hold no packets, so a packet trace is derived from events by a fixed mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions import dns as dns_payloads
from tracelake.functions import packets as shown
from tracelake.functions.decode import decode
from tracelake.functions.encode import encode, number
from tracelake.operators import accounting as run_accounting
from tracelake.operators import capped, detectors, dns, flows, snapshots, tcp
from tracelake.sources import export

HOUR = 3_600_000_000


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packet rows from events; addresses are 32-bit numbers."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    tcp = F.col("event_type").isin("click", "view", "signup")
    k = F.get_json_object("props", "$.k").cast("int")
    client, server = F.struct((F.lit(167772161) + F.col("user_id")).alias("ip"), (40000 + F.col("user_id") % 1000).alias("port")), F.struct(
        (F.lit(3232235521) + k % 4).alias("ip"), F.when(tcp, 443).otherwise(53).cast("long").alias("port")
    )
    rows = e.select(
        (F.col("event_id") + 1).alias("frame_no"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.when(tcp, "tcp").otherwise("udp").alias("protocol"),
        client.alias("c"), server.alias("s"), (F.col("event_id") % 2 == 0).alias("fwd"), (F.col("event_type") == "signup").alias("syn"),
        (54 + (F.col("value") * 10).cast("long")).alias("wire_len"), k.alias("k"), F.col("user_id"),
    )
    pick = lambda a, b, f: F.when(F.col("fwd"), F.col(f"{a}.{f}")).otherwise(F.col(f"{b}.{f}"))
    return rows.select(
        "frame_no", "ts_us", "protocol", pick("c", "s", "ip").alias("src_ip"), pick("c", "s", "port").alias("src_port"), pick("s", "c", "ip").alias("dst_ip"),
        pick("s", "c", "port").alias("dst_port"), "syn", F.lit(False).alias("ack"), "wire_len", "k", "user_id",
    )


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.with_key(flows.eligible(trace(spark, sf_dir)))


_TRACE = """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type IN ('click', 'view', 'signup') AS tcp FROM events),
r AS (SELECT event_id + 1 AS frame_no, epoch_us(ts) AS ts_us, CASE WHEN tcp THEN 'tcp' ELSE 'udp' END AS protocol,
      167772161 + user_id AS c_ip, 40000 + user_id % 1000 AS c_port, 3232235521 + k % 4 AS s_ip, CASE WHEN tcp THEN 443 ELSE 53 END::BIGINT AS s_port,
      event_id % 2 = 0 AS fwd, event_type = 'signup' AS syn, 54 + CAST(trunc(value * 10) AS BIGINT) AS wire_len, k, user_id FROM e),
t AS (SELECT frame_no, ts_us, protocol, CASE WHEN fwd THEN c_ip ELSE s_ip END AS src_ip, CASE WHEN fwd THEN c_port ELSE s_port END AS src_port,
      CASE WHEN fwd THEN s_ip ELSE c_ip END AS dst_ip, CASE WHEN fwd THEN s_port ELSE c_port END AS dst_port, syn, FALSE AS ack, wire_len, k, user_id FROM r),
p AS (SELECT *, src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port) AS a_to_b, least(src_ip, dst_ip) AS a_ip,
      CASE WHEN src_ip < dst_ip THEN src_port WHEN src_ip > dst_ip THEN dst_port ELSE least(src_port, dst_port) END AS a_port, greatest(src_ip, dst_ip) AS b_ip,
      CASE WHEN src_ip < dst_ip THEN dst_port WHEN src_ip > dst_ip THEN src_port ELSE greatest(src_port, dst_port) END AS b_port FROM t)"""
_K = "protocol, a_ip, a_port, b_ip, b_port"
_AGG = """min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) FILTER (a_to_b) AS packets_a_to_b, count(*) FILTER (NOT a_to_b) AS packets_b_to_a,
 sum(CASE WHEN a_to_b THEN wire_len ELSE 0 END)::BIGINT AS bytes_a_to_b, sum(CASE WHEN a_to_b THEN 0 ELSE wire_len END)::BIGINT AS bytes_b_to_a,
 count(*) AS packets_total, sum(wire_len)::BIGINT AS bytes_total"""
_FRAME = "frame_no, ts_us, protocol, src_ip, src_port, dst_ip, dst_port, wire_len"
_LIVES = """, w AS (SELECT frame_no, max(ts_us) OVER (ORDER BY frame_no) AS m FROM t),
up AS (SELECT m, min(frame_no) AS frame_no FROM w GROUP BY m)"""

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"{_TRACE} SELECT {_FRAME} FROM t")
def trace_scan(spark, sf_dir):
    return trace(spark, sf_dir).select(*_FRAME.split(", "))


@query(f"{_TRACE} SELECT {_FRAME} FROM t ORDER BY frame_no LIMIT 500")
def trace_limit(spark, sf_dir):
    return flows.limited(trace(spark, sf_dir), 500).select(*_FRAME.split(", "))


@query(f"{_TRACE} SELECT {_FRAME} FROM t WHERE frame_no % 7 = 0")
def trace_sample(spark, sf_dir):
    return flows.sampled(trace(spark, sf_dir), 7).select(*_FRAME.split(", "))


@query(f"{_TRACE} SELECT {_FRAME} FROM t WHERE protocol = 'udp' AND (src_port = 53 OR dst_port = 53)")
def trace_filter_port(spark, sf_dir):
    from tracelake.functions.bpf import compile_filter

    return trace(spark, sf_dir).filter(compile_filter("udp port 53")).select(*_FRAME.split(", "))


@query(f"{_TRACE} SELECT {_FRAME} FROM t WHERE (src_ip = 3232235522 OR dst_ip = 3232235522) AND NOT (protocol = 'tcp' AND dst_port BETWEEN 400 AND 500) AND wire_len >= 100")
def trace_filter_host(spark, sf_dir):
    from tracelake.functions.bpf import compile_filter

    return trace(spark, sf_dir).filter(compile_filter("host 192.168.0.2 and not (tcp dst portrange 400-500) and greater 100")).select(*_FRAME.split(", "))


@query(f"{_TRACE} SELECT count(*) AS frames_read, sum(wire_len)::BIGINT AS wire_bytes, count(*) FILTER (protocol = 'tcp') AS tcp, count(*) FILTER (protocol = 'udp') AS udp, max(ts_us) AS watermark_us FROM t")
def accounting(spark, sf_dir):
    p = F.col("protocol")
    return trace(spark, sf_dir).agg(F.count("*").alias("frames_read"), F.sum("wire_len").alias("wire_bytes"), F.count_if(p == "tcp").alias("tcp"), F.count_if(p == "udp").alias("udp"), F.max("ts_us").alias("watermark_us"))


@query(f"{_TRACE} SELECT {_K}, {_AGG} FROM p GROUP BY {_K}")
def flow_aggregate(spark, sf_dir):
    return flows.aggregate(_keyed(spark, sf_dir)).drop("duration_secs", "avg_bps")


@query(f"{_TRACE}, f AS (SELECT {_K}, {_AGG} FROM p GROUP BY {_K}) SELECT {_K}, round(CASE WHEN last_us > first_us THEN bytes_total * 8 / ((last_us - first_us) / 1e6) ELSE 0 END, 6) AS avg_bps FROM f")
def flow_avg_bps(spark, sf_dir):
    return flows.aggregate(_keyed(spark, sf_dir)).select(*flows.KEY, F.round("avg_bps", 6).alias("avg_bps"))


@query(f"{_TRACE} SELECT {_K}, {_AGG} FROM p GROUP BY {_K} ORDER BY bytes_total DESC, {_K} LIMIT 10")
def flow_top_n(spark, sf_dir):
    return flows.top_n(flows.aggregate(_keyed(spark, sf_dir)), 10).drop("duration_secs", "avg_bps")


@query(f"{_TRACE}{_LIVES}".replace("WITH e AS", "WITH RECURSIVE e AS") + """,
s(frame_no, sweep_us) AS (SELECT * FROM (SELECT frame_no, m FROM up ORDER BY m LIMIT 1)
 UNION ALL SELECT n.frame_no, n.m FROM s, LATERAL (SELECT frame_no, m FROM up WHERE m >= s.sweep_us + 1000000 ORDER BY m LIMIT 1) n)
SELECT frame_no, sweep_us FROM s""")
def sweeps(spark, sf_dir):
    return flows.sweeps(flows.with_watermark(trace(spark, sf_dir)))


def _lives(spark, sf_dir, timeout_us):
    from tracelake.sources.tables import cut

    packets = trace(spark, sf_dir)
    swept = cut(flows.sweeps(flows.with_watermark(packets)), "sweeps")
    return flows.lives(flows.with_key(flows.eligible(packets)), swept, timeout_us)


def _lives_sql(tail: str) -> str:
    return SQL["sweeps"].rpartition("SELECT frame_no, sweep_us")[0] + f""",
x AS (SELECT p.*, s.sweep_us AS swept FROM p ASOF LEFT JOIN s ON p.frame_no > s.frame_no),
y AS (SELECT *, coalesce((swept - lag(ts_us) OVER k > {6 * HOUR})::BIGINT, 0) AS sp FROM x WINDOW k AS (PARTITION BY {_K} ORDER BY frame_no)),
z AS (SELECT *, sum(sp) OVER (PARTITION BY {_K} ORDER BY frame_no)::BIGINT AS instance FROM y),
f AS (SELECT {_K}, instance, {_AGG} FROM z GROUP BY {_K}, instance),
l AS (SELECT f.*, (SELECT min(sweep_us) FROM s WHERE sweep_us > f.last_us + {6 * HOUR}) AS expired_us FROM f) {tail}"""


@query(_lives_sql(f"SELECT {_K}, instance, first_us, last_us, packets_total, bytes_total, expired_us FROM l WHERE expired_us IS NOT NULL"))
def expired_flows(spark, sf_dir):
    return _lives(spark, sf_dir, 6 * HOUR).filter("expired_us is not null").select(*flows.KEY, "instance", "first_us", "last_us", "packets_total", "bytes_total", "expired_us")


@query(_lives_sql(f"SELECT {_K}, instance, first_us, last_us, packets_total, bytes_total FROM l WHERE expired_us IS NULL"))
def retained_flows(spark, sf_dir):
    return _lives(spark, sf_dir, 6 * HOUR).filter("expired_us is null").select(*flows.KEY, "instance", "first_us", "last_us", "packets_total", "bytes_total")


@query(f"{_TRACE} SELECT ts_us // {HOUR} AS tick, sum(wire_len)::BIGINT AS bytes, count(*) AS packets, count(DISTINCT ({_K})) AS active_flows, round(sum(wire_len) * 8 / 3600.0 / 1e6, 9) AS mbps, round(count(*) / 3600.0, 9) AS pps FROM p GROUP BY 1")
def ticks(spark, sf_dir):
    return flows.ticks(_keyed(spark, sf_dir), HOUR).withColumns({c: F.round(c, 9) for c in ("mbps", "pps")})


@query(f"""{_TRACE}, g AS (SELECT ts_us // {24 * HOUR} AS tick, {_K}, sum(wire_len)::BIGINT AS delta_bytes FROM p GROUP BY 1, {_K}),
q AS (SELECT *, row_number() OVER (PARTITION BY tick ORDER BY delta_bytes DESC, {_K}) AS rank FROM g) SELECT * FROM q WHERE rank <= 5""")
def tick_top_flows(spark, sf_dir):
    return flows.tick_top_flows(_keyed(spark, sf_dir), 24 * HOUR, 5)


@query(f"{_TRACE}, n AS (SELECT *, 'host' || (k % 5)::VARCHAR || '.example.test' AS sni FROM p WHERE protocol = 'tcp' AND k % 3 = 0) SELECT {_K}, arg_min(sni, frame_no) AS sni FROM n GROUP BY {_K}")
def flow_first_sni(spark, sf_dir):
    sni = F.when((F.col("protocol") == "tcp") & (F.col("k") % 3 == 0), F.concat(F.lit("host"), (F.col("k") % 5).cast("string"), F.lit(".example.test")))
    return flows.first_name(_keyed(spark, sf_dir).withColumn("sni", sni), "sni")




@query(f"""{_TRACE}, m AS (SELECT *, max(ts_us) OVER (ORDER BY frame_no) AS m FROM t), c AS (SELECT frame_no, dst_ip, dst_port, count(*) OVER w AS n, len(list_distinct(list(src_ip) OVER w))::BIGINT AS n_sources
FROM m WHERE syn AND NOT ack WINDOW w AS (PARTITION BY dst_ip, dst_port ORDER BY m RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW)) SELECT * FROM c WHERE n >= 4 AND n_sources >= 2""")
def syn_flood_candidates(spark, sf_dir):
    return detectors.syn_candidates(flows.with_watermark(trace(spark, sf_dir)), 6 * HOUR, 4, 2).select("frame_no", "dst_ip", "dst_port", "n", "n_sources")


@query(f"""{_TRACE}, m AS (SELECT *, max(ts_us) OVER (ORDER BY frame_no) AS m FROM t), c AS (SELECT frame_no, src_ip, len(list_distinct(list(dst_port) OVER w))::BIGINT AS n_ports, len(list_distinct(list(dst_ip) OVER w))::BIGINT AS n_hosts
FROM m WHERE protocol = 'udp' OR syn WINDOW w AS (PARTITION BY src_ip ORDER BY m RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW)) SELECT * FROM c WHERE n_ports >= 5 OR n_hosts >= 6""")
def port_scan_candidates(spark, sf_dir):
    return detectors.scan_candidates(flows.with_watermark(trace(spark, sf_dir)), 6 * HOUR, 5, 6).select("frame_no", "src_ip", "n_ports", "n_hosts")


def _alert_sql(seen: str, key: str, values: str, reached: str, total: str, counted: str, hosts: str, kind: str) -> str:
    """Alerts row by row: a key's rows in order, with the rows of the window held, and the time until which it is quiet."""
    w, quiet = 6 * HOUR, 12 * HOUR
    keep = f"list_append(list_filter(held, lambda x: x.ts >= f.m - {w}), {{'ts': f.ts_us, {values}}})"
    return f"""{_TRACE}, m AS (SELECT *, max(ts_us) OVER (ORDER BY frame_no) AS m FROM t),
f AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY frame_no) AS n FROM m WHERE {seen}),
run AS (SELECT n, {key}, ts_us, m, [{{'ts': ts_us, {values.replace("f.", "")}}}] AS held, FALSE AS alert, -1::BIGINT AS quiet FROM f WHERE n = 1
 UNION ALL SELECT n, {key}, ts_us, m, CASE WHEN quiet > m THEN held ELSE kept END, ok, CASE WHEN ok THEN m + {quiet} ELSE quiet END
 FROM (SELECT *, quiet <= m AND ({reached}) AS ok FROM (SELECT f.n, {", ".join("f." + k for k in key.split(", "))}, f.ts_us, f.m, held, quiet, {keep} AS kept FROM run JOIN f ON f.n = run.n + 1 AND {" AND ".join(f"f.{k} = run.{k}" for k in key.split(", "))})))
SELECT {key}, ts_us, {total} AS observed_total, {counted} AS observed_values, {hosts} AS observed_hosts, '{kind}' AS kind, 1 AS schema_version FROM run WHERE alert""".replace("WITH e AS", "WITH RECURSIVE e AS")


_VARIETY = "len(list_distinct(list_transform({}, lambda x: x.{})))"


@query(_alert_sql("syn AND NOT ack", "dst_ip, dst_port", "'src': f.src_ip", f"len(kept) >= 4 AND {_VARIETY.format('kept', 'src')} >= 2", "len(held)::BIGINT", _VARIETY.format("held", "src") + "::BIGINT", "NULL::BIGINT", "syn_flood"))
def syn_flood_alerts(spark, sf_dir):
    return detectors.syn_flood_alerts(flows.with_watermark(trace(spark, sf_dir)), 6 * HOUR, 4, 2, 12 * HOUR)


@query(_alert_sql("protocol = 'udp' OR syn", "src_ip", "'port': f.dst_port, 'host': f.dst_ip", f"{_VARIETY.format('kept', 'port')} >= 5 OR {_VARIETY.format('kept', 'host')} >= 6", "NULL::BIGINT", _VARIETY.format("held", "port") + "::BIGINT", _VARIETY.format("held", "host") + "::BIGINT", "port_scan"))
def port_scan_alerts(spark, sf_dir):
    return detectors.port_scan_alerts(flows.with_watermark(trace(spark, sf_dir)), 6 * HOUR, 5, 6, 12 * HOUR)


def _messages(spark, sf_dir):
    """Queries, and a response to each whose number isn't divisible by 4, some late."""
    asked = _keyed(spark, sf_dir).filter("protocol = 'udp'").withColumns({"dns_id": F.col("frame_no") % 65536, "question": F.concat(F.lit("q"), F.col("k").cast("string")), "response": F.lit(False), "rcode": F.lit(0).cast("long")})
    told = asked.filter("frame_no % 4 != 0").withColumns(
        {"ts_us": F.col("ts_us") + (F.col("frame_no") % 8) * 1_000_000, "frame_no": F.col("frame_no") + 10_000_000_000, "a_to_b": ~F.col("a_to_b"), "response": F.lit(True), "rcode": F.col("k").cast("long") % 4}
    )
    return asked.unionByName(told)


@query(f"""{_TRACE} SELECT {_K}, frame_no % 65536 AS dns_id, 'q' || k::VARCHAR AS question, frame_no AS query_no, ts_us AS query_us, frame_no + 10000000000 AS response_no,
ts_us + (frame_no % 8) * 1000000 AS response_us, k::BIGINT % 4 AS rcode, (frame_no % 8) * 1000000 AS latency_us FROM p WHERE protocol = 'udp' AND frame_no % 4 <> 0 AND frame_no % 8 <= 5""")
def dns_transactions(spark, sf_dir):
    return flows.dns_transactions(_messages(spark, sf_dir))


@query("""SELECT l_orderkey, count(*) AS packets, sum(54 + CAST(trunc(l_quantity) AS BIGINT) * 10)::BIGINT AS bytes, min(epoch_us(l_shipdate)) AS first_us, max(epoch_us(l_shipdate)) AS last_us
FROM lineitem GROUP BY l_orderkey""")
def lineitem_flow_volume(spark, sf_dir):
    t = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    size = 54 + F.col("l_quantity").cast("long") * 10
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.count("*").alias("packets"), F.sum(size).alias("bytes"), F.min(t).alias("first_us"), F.max(t).alias("last_us"))


def _captured(spark, sf_dir):
    """The trace as bytes: sequence numbers grow with the frame number, all TCP packets but SYNs acknowledge nothing new."""
    acked = (F.col("protocol") == "tcp") & ~F.col("syn")
    return encode(trace(spark, sf_dir).withColumns({"ack": acked, "seq": F.col("frame_no") * 100 % 4294967296, "ack_no": F.lit(0).cast("long")}))


def _decoded_raw(spark, sf_dir, *fields):
    return decode(_captured(spark, sf_dir).select("frame_no", "ts_us", "wire_len", "link_type", "raw"), *fields)


def _decoded(spark, sf_dir, *fields):
    """The trace from its bytes, addresses as 32-bit numbers again."""
    rows = _decoded_raw(spark, sf_dir, "protocol", "src_ip", "dst_ip", "src_port", "dst_port", *fields)
    return rows.withColumns({c: F.conv(F.hex(c), 16, 10).cast("long") for c in ("src_ip", "dst_ip")})


@query(f"{_TRACE} SELECT {_FRAME}, coalesce(syn, FALSE) AS syn, protocol = 'tcp' AND NOT syn AS ack, CASE WHEN protocol = 'tcp' THEN frame_no * 100 % 4294967296 END AS seq, TRUE AS checksum_ok FROM t")
def decoded_frames(spark, sf_dir):
    return _decoded(spark, sf_dir, "syn", "ack", "seq", "checksum_ok").select(*_FRAME.split(", "), "syn", "ack", "seq", "checksum_ok")


@query(f"{_TRACE} SELECT {_K}, {_AGG} FROM p GROUP BY {_K}")
def decoded_flow_aggregate(spark, sf_dir):
    return flows.aggregate(flows.with_key(flows.eligible(_decoded(spark, sf_dir)))).drop("duration_secs", "avg_bps")


@query(f"""{_TRACE}, x AS (SELECT ts_us, wire_len, frame_no % 11 = 0 AS bad, frame_no % 11 <> 0 AND frame_no % 13 = 0 AS odd, frame_no % 11 <> 0 AND frame_no % 13 <> 0 AND frame_no % 17 = 0 AS half FROM t)
SELECT count(*) AS frames_read, sum(wire_len)::BIGINT AS wire_bytes, count(*) FILTER (NOT bad) AS parsed, count(*) FILTER (NOT bad AND NOT odd) AS with_network,
 count(*) FILTER (NOT bad AND NOT odd AND NOT half) AS with_transport, count(*) FILTER (bad) AS parse_errors, count(*) FILTER (half) AS transport_errors,
 count(*) FILTER (odd) AS unsupported, count(*) FILTER (bad OR odd OR half) AS malformed_or_unsupported, max(ts_us) AS watermark_us FROM x""")
def decoded_accounting(spark, sf_dir):
    """Some frames end in the Ethernet header, some have another Ethernet type, some end in the ports."""
    n, raw = F.col("frame_no"), F.col("raw")
    spoilt = F.when(n % 11 == 0, F.substring(raw, 1, 10)).when(n % 13 == 0, F.concat(F.substring(raw, 1, 12), F.unhex(F.lit("88B5")), F.substring(raw, 15, 28))).when(n % 17 == 0, F.substring(raw, 1, 37)).otherwise(raw)
    frames = _captured(spark, sf_dir).select("ts_us", "wire_len", "link_type", spoilt.alias("raw"))
    return run_accounting.account(decode(frames, "parse_error", "transport_error", "unsupported", "ip_version", "protocol"))


@query(f"""{_TRACE}, g AS (SELECT *, frame_no * 100 + least(wire_len, 65549) - 54 + syn::INT AS e, least(wire_len, 65549) - 54 + syn::INT > 0 AS l FROM p WHERE protocol = 'tcp'),
h AS (SELECT *, coalesce(l AND e <= max(e) FILTER (l) OVER (PARTITION BY {_K}, a_to_b ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS o FROM g)
SELECT {_K}, CASE WHEN arg_max(syn, frame_no) THEN 'syn_sent' ELSE 'established' END AS tcp_state, arg_min(CASE WHEN a_to_b THEN 'a_to_b' ELSE 'b_to_a' END, frame_no) FILTER (syn) AS client,
 count(*) FILTER (o) AS out_of_order FROM h GROUP BY {_K}""")
def tcp_flow_states(spark, sf_dir):
    packets = flows.with_key(flows.eligible(_decoded(spark, sf_dir, "syn", "ack", "fin", "rst", "seq", "ack_no", "seq_len")))
    return tcp.tcp_flows(packets).select(*flows.KEY, "tcp_state", "client", "out_of_order")


_ASKED = f"""{_TRACE}, n AS (SELECT {_K}, frame_no, a_to_b, frame_no % 65536 AS dns_id, 'q' || k::VARCHAR AS question, k::BIGINT % 4 AS code FROM p WHERE protocol = 'udp'),
m AS (SELECT *, 2 * frame_no AS place, frame_no * 700000 AS ts, FALSE AS response, 0 AS rcode FROM n
 UNION ALL SELECT *, 2 * frame_no + 1, frame_no * 700000 + (frame_no % 8) * 1000000, TRUE, code FROM n WHERE frame_no % 4 <> 0)"""


def _dns_packets(spark, sf_dir):
    """A query a UDP packet of the trace, 0.7 seconds a frame, and a response to three in four, some late."""
    n, k, late = F.col("frame_no"), F.col("k").cast("long"), (F.col("frame_no") % 8) * 1_000_000
    asked = _keyed(spark, sf_dir).filter("protocol = 'udp'").withColumns({"at": 2 * n, "ts": n * 700_000, "response": F.lit(False), "code": F.lit(0).cast("long")})
    told = asked.filter("frame_no % 4 != 0").withColumns({"at": 2 * n + 1, "ts": n * 700_000 + late, "response": F.lit(True), "code": k % 4, "a_to_b": ~F.col("a_to_b")})
    rows = asked.unionByName(told)
    name = F.concat(F.lit("q"), F.col("k").cast("string"))
    flags = F.when(F.col("response"), F.col("code") + 0x8180).otherwise(0x0100)
    label = F.concat(number(F.octet_length(name), 1), F.encode(name, "UTF-8"))
    payload = F.concat(number(F.col("frame_no") % 65536, 2), number(flags, 2), F.unhex(F.lit("0001000000000000")), label, F.unhex(F.lit("0000010001")))
    return rows.select(*flows.KEY, F.col("at").alias("frame_no"), F.col("ts").alias("ts_us"), "a_to_b", "src_port", "dst_port", payload.alias("payload"))


@query(f"{_ASKED} SELECT {_K}, place AS frame_no, dns_id, response, rcode::BIGINT AS rcode, TRUE AS complete, question AS name FROM m")
def dns_messages(spark, sf_dir):
    read = dns_payloads.messages(_dns_packets(spark, sf_dir))
    return read.select(*flows.KEY, "frame_no", "dns_id", "response", "rcode", "complete", F.col("questions")[0]["name"].alias("name"))


@query(f"""{_ASKED}, w AS (SELECT *, max(ts) OVER (ORDER BY place) AS top FROM m),
q AS (SELECT * FROM w WHERE NOT response AND top - ts <= 5000000),
u AS (SELECT q.*, a.ts - q.ts AS wait, a.rcode AS answer FROM q LEFT JOIN w a ON a.response AND a.frame_no = q.frame_no AND a.top - q.ts <= 5000000)
SELECT {_K}, count(*) AS dns_queries, count(wait) AS dns_matched_responses, count(*) - count(wait) AS dns_unanswered_queries, count(*) FILTER (answer = 3) AS dns_nxdomain,
 count(*) FILTER (answer = 2) AS dns_servfail, min(wait) / 1000 AS low, round(avg(wait / 1000), 6) AS mean, max(wait) / 1000 AS high FROM u GROUP BY {_K}""")
def dns_flow_statistics(spark, sf_dir):
    packets = flows.with_watermark(_dns_packets(spark, sf_dir))
    found = dns.dns_flows(dns_payloads.messages(packets, details=False))
    ms = {"low": "min", "high": "max"}
    return found.select(
        *flows.KEY, "dns_queries", "dns_matched_responses", "dns_unanswered_queries", "dns_nxdomain", "dns_servfail",
        F.round("dns_response_latency_avg_ms", 6).alias("mean"), *(F.col(f"dns_response_latency_{c}_ms").alias(a) for a, c in ms.items()),
    )


@query(f"""{_TRACE}, f AS (SELECT {_K}, {_AGG} FROM p GROUP BY {_K}),
d AS (SELECT *, (a_ip >> 24) || '.' || ((a_ip >> 16) & 255) || '.' || ((a_ip >> 8) & 255) || '.' || (a_ip & 255) AS endpoint_a_ip,
 (b_ip >> 24) || '.' || ((b_ip >> 16) & 255) || '.' || ((b_ip >> 8) & 255) || '.' || (b_ip & 255) AS endpoint_b_ip FROM f)
SELECT protocol, endpoint_a_ip, a_port AS endpoint_a_port, endpoint_b_ip, b_port AS endpoint_b_port, printf('%d.%06d', first_us // 1000000, first_us % 1000000) AS first_seen,
 printf('%d.%06d', (last_us - first_us) // 1000000, (last_us - first_us) % 1000000) AS duration_secs, packets_total, bytes_total FROM d""")
def flow_csv_rows(spark, sf_dir):
    frames = flows.with_watermark(_captured(spark, sf_dir).select("frame_no", "ts_us", "wire_len", "link_type", "raw"))
    packets = decode(frames, *snapshots.FIELDS)
    rows = export.csv_rows(snapshots.snapshots(flows.with_key(flows.eligible(packets))))
    return rows.select("protocol", "endpoint_a_ip", "endpoint_a_port", "endpoint_b_ip", "endpoint_b_port", "first_seen", "duration_secs", "packets_total", "bytes_total")


_DOTTED = "(x >> 24) || '.' || ((x >> 16) & 255) || '.' || ((x >> 8) & 255) || '.' || (x & 255)"
_SRC, _DST = _DOTTED.replace("x", "src_ip"), _DOTTED.replace("x", "dst_ip")


@query(f"""{_TRACE} SELECT frame_no, upper(protocol) AS shown_protocol, {_SRC} || ':' || src_port AS source, {_DST} || ':' || dst_port AS destination,
 CASE WHEN protocol = 'udp' THEN 'len=' || (least(wire_len - 14, 65535) - 20) ELSE CASE WHEN syn THEN '[SYN]' ELSE '[ACK]' END || ' seq=' || (frame_no * 100 % 4294967296) || ' ack=0 win=65535' END AS info FROM t""")
def packet_summaries(spark, sf_dir):
    return shown.summary(_decoded_raw(spark, sf_dir, *shown.NEEDED)).select("frame_no", "shown_protocol", "source", "destination", "info")


@query(f"""{_TRACE} SELECT frame_no, least(wire_len - 14, 65535) AS total_length, (frame_no % 65536)::INT AS ip_id, 64 AS ttl, 20 AS header_length, 0 AS dscp, 0 AS fragment_offset, FALSE AS dont_fragment,
 CASE WHEN protocol = 'tcp' THEN 5 END AS data_offset, CASE WHEN protocol = 'tcp' THEN 0 END AS urgent_pointer, CASE WHEN protocol = 'udp' THEN least(wire_len - 14, 65535) - 20 END AS udp_length,
 '02:00:00:00:00:02' AS eth_source FROM t""")
def header_fields(spark, sf_dir):
    fields = ("total_length", "ip_id", "ttl", "header_length", "dscp", "fragment_offset", "dont_fragment", "data_offset", "urgent_pointer", "udp_length")
    return _decoded_raw(spark, sf_dir, *fields, "eth_src").select("frame_no", *fields, shown.octets(F.col("eth_src")).alias("eth_source"))


@query(f"""{_TRACE} SELECT frame_no, protocol, src_port, (frame_no % 4096)::INT AS vlan_id, (frame_no % 8)::INT AS priority, (frame_no % 2)::INT AS drop_eligible,
 CASE WHEN frame_no % 3 = 0 THEN 'VLAN Tag 1 (802.1ad)' ELSE 'VLAN (802.1Q)' END AS layer FROM t""")
def vlan_frames(spark, sf_dir):
    """Every frame in a VLAN, every third in a second one."""
    n = F.col("frame_no")
    tag = number((n % 8) * 8192 + (n % 2) * 4096 + n % 4096, 2)
    outer = F.when(n % 3 == 0, F.concat(F.unhex(F.lit("88A8")), tag, F.unhex(F.lit("81000007")))).otherwise(F.concat(F.unhex(F.lit("8100")), tag))
    frames = _captured(spark, sf_dir).select("frame_no", "link_type", F.concat(F.substring("raw", 1, 12), outer, F.substring("raw", 13, 100)).alias("raw"))
    rows = shown.layers(decode(frames, *shown.NEEDED))
    first = lambda c: F.col(c)[0]
    return rows.select("frame_no", "protocol", "src_port", first("vlans").alias("vlan_id"), first("vlan_priorities").alias("priority"), first("vlan_drop_eligible").alias("drop_eligible"), F.col("layers")[1]["name"].alias("layer"))


@query(f"""{_TRACE} SELECT frame_no, 'Echo Request id=' || (frame_no % 65536) || ' seq=' || (k % 7) AS info, {_SRC} AS source FROM t WHERE frame_no % 5 = 0
UNION ALL SELECT frame_no, 'who-has ' || ({_DST}) || ' tell ' || ({_SRC}) || ' (02:00:00:00:00:02)', {_SRC} FROM t WHERE frame_no % 5 = 1
UNION ALL SELECT frame_no, 'Neighbor Solicitation code=' || (k % 3), '2001:db8::' || lower(hex(frame_no % 60000 + 1)) FROM t WHERE frame_no % 5 = 2""")
def other_protocols(spark, sf_dir):
    """ICMP, ARP and ICMPv6 frames from the trace's numbers."""
    n, k, head = F.col("frame_no"), F.col("k").cast("long"), F.unhex(F.lit("020000000001020000000002"))
    src, dst = number(F.col("src_ip"), 4), number(F.col("dst_ip"), 4)
    echo = F.concat(F.unhex(F.lit("0800450000240000000040010000")), src, dst, F.unhex(F.lit("08000000")), number(n % 65536, 2), number(k % 7, 2))
    arp = F.concat(F.unhex(F.lit("08060001080006040001020000000002")), src, F.unhex(F.lit("000000000000")), dst)
    prefix = F.unhex(F.lit("20010DB800000000000000000000"))
    six = F.concat(F.unhex(F.lit("86DD6000000000083A40")), prefix, number(n % 60000 + 1, 2), prefix, number(1, 2), number(135, 1), number(k % 3, 1), F.unhex(F.lit("000000000000")))
    body = F.when(n % 5 == 0, echo).when(n % 5 == 1, arp).when(n % 5 == 2, six)
    frames = trace(spark, sf_dir).filter(n % 5 < 3).select("frame_no", F.lit(1).alias("link_type"), F.concat(head, body).alias("raw"))
    return shown.summary(decode(frames, *shown.NEEDED)).select("frame_no", "info", "source")


@query(f"""{_TRACE}, f AS (SELECT *, dense_rank() OVER (ORDER BY {_K}) AS g, dense_rank() OVER (ORDER BY ts_us // {24 * HOUR}) AS n, ts_us // {24 * HOUR} AS tick FROM p),
flow AS (SELECT DISTINCT g, {_K} FROM f), z AS (SELECT n, tick, g, sum(wire_len)::BIGINT AS b FROM f GROUP BY n, tick, g),
a AS (SELECT n, tick, list(coalesce(b, 0) ORDER BY flow.g) AS b FROM (SELECT DISTINCT n, tick FROM f) CROSS JOIN flow LEFT JOIN z USING (n, tick, g) GROUP BY n, tick),
run AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS tick, list_transform(a.b, lambda x: 0::BIGINT) AS pending, NULL::STRUCT(b BIGINT, k BIGINT)[] AS best FROM a WHERE n = 1
 UNION ALL SELECT n, tick, list_transform(total, lambda x, i: CASE WHEN list_contains(list_transform(best, lambda y: y.k), i) THEN 0 ELSE x END), best
 FROM (SELECT *, list_filter(list_sort(list_transform(total, lambda x, i: {{'b': -x, 'k': i}}))[1:5], lambda y: y.b < 0) AS best
  FROM (SELECT a.n, a.tick, list_transform(list_zip(pending, a.b), lambda x: x[1] + x[2]) AS total FROM run JOIN a ON a.n = run.n + 1))),
y AS (SELECT tick, unnest(best) AS one, generate_subscripts(best, 1) AS rank FROM run WHERE best IS NOT NULL)
SELECT tick, {_K}, -one.b AS delta_bytes, rank::BIGINT AS rank FROM y JOIN flow ON flow.g = one.k""".replace("WITH e AS", "WITH RECURSIVE e AS"))
def reported_deltas(spark, sf_dir):
    return flows.reported_deltas(_keyed(spark, sf_dir), 24 * HOUR, 5)


@query(f"""{_TRACE}, c AS (SELECT p.*, count(*) OVER (PARTITION BY {_K} ORDER BY frame_no) AS c FROM p) SELECT {_K}, 0::BIGINT AS instance, count(*) AS packets FROM c GROUP BY {_K}""")
def admitted_flows(spark, sf_dir):
    """A capped table that is never full holds every flow once."""
    return capped.admitted(_keyed(spark, sf_dir), None, 1_000_000).groupBy(*flows.KEY, "instance").agg(F.count("*").alias("packets"))


@query(f"""{_TRACE}, f AS (SELECT row_number() OVER (ORDER BY frame_no) AS n, frame_no, ts_us, dense_rank() OVER (ORDER BY {_K}) AS k, {_K} FROM p),
run AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS q, []::BOOLEAN[] AS seen, NULL::BIGINT AS gone
 UNION ALL SELECT f.n,
  CASE WHEN list_contains(q, k) THEN q WHEN len(q) < 200 THEN list_append(q, k) ELSE list_append(list_concat(q[coalesce(list_position(seen, FALSE), 1) + 1:], q[1:coalesce(list_position(seen, FALSE), 1) - 1]), k) END,
  CASE WHEN list_contains(q, k) THEN list_concat(list_append(seen[1:list_position(q, k) - 1], TRUE), seen[list_position(q, k) + 1:]) WHEN len(q) < 200 THEN list_append(seen, TRUE)
   WHEN list_contains(seen, FALSE) THEN list_append(list_concat(seen[list_position(seen, FALSE) + 1:], list_transform(range(list_position(seen, FALSE) - 1), lambda i: FALSE)), TRUE)
   ELSE list_append(list_transform(range(199), lambda i: FALSE), TRUE) END,
  CASE WHEN NOT list_contains(q, k) AND len(q) >= 200 THEN q[coalesce(list_position(seen, FALSE), 1)] END FROM run JOIN f ON f.n = run.n + 1),
x AS (SELECT gone AS k, f.n, ts_us, row_number() OVER (PARTITION BY gone ORDER BY f.n) - 1 AS instance FROM run JOIN f USING (n) WHERE gone IS NOT NULL)
SELECT {_K}, instance, ended_us, count(*) AS packets FROM (SELECT f.*, x.instance, x.ts_us AS ended_us FROM f ASOF JOIN x ON f.k = x.k AND f.n < x.n) GROUP BY {_K}, instance, ended_us""".replace("WITH e AS", "WITH RECURSIVE e AS"))
def evicted_flows(spark, sf_dir):
    """Lives that a table of 200 flows ended."""
    return capped.admitted(_keyed(spark, sf_dir), None, 200).filter("reason = 'eviction'").groupBy(*flows.KEY, "instance", "ended_us").agg(F.count("*").alias("packets"))


@query(f"{_TRACE} SELECT frame_no, strftime(make_timestamp(ts_us), '%H:%M:%S.%f') AS time, a_to_b FROM p")
def sql_functions(spark, sf_dir):
    """The functions that SQL users get."""
    from tracelake.functions.registry import register

    register(spark)
    packed = _captured(spark, sf_dir).withColumns({c: number(F.col(c), 4) for c in ("src_ip", "dst_ip")})
    return packed.select("frame_no", F.expr("time_of_day(ts_us)").alias("time"), F.expr("flow_key(protocol, src_ip, src_port, dst_ip, dst_port).a_to_b").alias("a_to_b"))


@query(f"{_TRACE} SELECT {_FRAME} FROM t")
def capture_ranges(spark, sf_dir):
    """The trace as capture files, read back by ranges of 64 KiB."""
    from tracelake.sources import captures, pcap
    from tracelake.sources.tables import scratch

    folder = scratch(spark, "captures")
    pcap.write_pcap(_captured(spark, sf_dir), folder)
    own = ("protocol", "src_ip", "src_port", "dst_ip", "dst_port")
    rows = captures.read_captures(spark, folder, lambda frames: decode(frames, *own), 1 << 16)
    return rows.withColumns({c: F.conv(F.hex(c), 16, 10).cast("long") for c in ("src_ip", "dst_ip")}).select(*_FRAME.split(", "))


@query(f"""{_TRACE}, n AS (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY frame_no) AS i, count(*) OVER (PARTITION BY {_K}) AS size FROM p WHERE protocol = 'tcp'),
s AS (SELECT *, CASE WHEN i = 1 THEN 'syn' WHEN i = size AND i % 5 = 0 THEN 'rst' WHEN i >= size - 1 AND size % 3 = 0 THEN 'fin' ELSE 'ack' END AS kind,
      CASE WHEN i % 4 = 3 THEN lag(i, 1, 1) OVER w ELSE i END AS sent, CASE WHEN i % 4 = 3 THEN lag(a_to_b, 1, a_to_b) OVER w ELSE a_to_b END AS side FROM n WINDOW w AS (PARTITION BY {_K} ORDER BY i)),
tops AS (SELECT *, coalesce(max(sent) OVER (PARTITION BY {_K}, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM s WHERE kind <> 'rst'),
o AS (SELECT {_K}, count(*) FILTER (sent <= top AND i > 1) AS again FROM tops GROUP BY {_K}),
l AS (SELECT {_K}, arg_max(kind, i) AS last, arg_max(kind, i) FILTER (kind <> 'ack') AS mark, any_value(size) AS size, max(i) FILTER (kind = 'rst') AS gone, count(DISTINCT side) FILTER (kind = 'fin') AS closed,
      max(i) FILTER (kind = 'ack') AS acked, max(i) FILTER (kind = 'fin') AS finished, arg_min(side, i) AS client FROM s GROUP BY {_K})
SELECT {_K}, CASE WHEN gone IS NOT NULL THEN 'reset' WHEN closed = 2 THEN 'closed' WHEN closed = 1 THEN 'fin_wait' WHEN size = 1 THEN 'syn_sent' ELSE 'established' END AS tcp_state,
 CASE WHEN client THEN 'a_to_b' ELSE 'b_to_a' END AS client, coalesce(again, 0) AS again FROM l LEFT JOIN o USING ({_K})""")
def tcp_life(spark, sf_dir):
    """TCP flows that begin with a SYN and end by FINs, by a RST or not at all, in which every fourth segment comes
    again: sequence numbers that wrap, one byte a segment."""
    order, whole = Window.partitionBy(*flows.KEY).orderBy("frame_no"), Window.partitionBy(*flows.KEY)
    rows = _keyed(spark, sf_dir).filter("protocol = 'tcp'").withColumns({"i": F.row_number().over(order).cast("long"), "size": F.count("*").over(whole)})
    i, size = F.col("i"), F.col("size")
    kind = F.when(i == 1, "syn").when((i == size) & (i % 5 == 0), "rst").when((i >= size - 1) & (size % 3 == 0), "fin").otherwise("ack")
    again = i % 4 == 3
    rows = rows.withColumns({"kind": kind, "sent": F.when(again, F.lag("i", 1, 1).over(order)).otherwise(i), "a_to_b": F.when(again, F.coalesce(F.lag("a_to_b").over(order), "a_to_b")).otherwise(F.col("a_to_b"))})
    is_ = lambda k: F.col("kind") == k
    rows = rows.withColumns({"syn": is_("syn"), "ack": is_("ack"), "fin": is_("fin"), "rst": is_("rst"), "seq": (F.col("sent") + 4294967290) % 4294967296, "ack_no": F.lit(0).cast("long"), "seq_len": F.when(is_("rst"), 0).otherwise(1).cast("long")})
    found = tcp.tcp_flows(rows)
    return found.select(*flows.KEY, "tcp_state", "client", (F.col("retransmissions") + F.col("out_of_order")).alias("again"))


#: Filters over bytes, and what they pass in terms of the trace's rows: every fourth frame is in a VLAN, every fourth a later
#: fragment, every fourth an ARP request.
FILTERS = {
    "tcp": ("tcp", "n % 4 <> 0 AND n % 4 <> 2 AND protocol = 'tcp'"),
    "host 192.168.0.2": ("host", "n % 4 <> 0 AND (src_ip = 3232235522 OR dst_ip = 3232235522)"),
    "vlan 7 and port 443": ("tagged", "n % 4 = 0 AND (src_port = 443 OR dst_port = 443)"),
    "udp port 53 or arp": ("mixed", "(n % 4 = 3 AND protocol = 'udp' AND (src_port = 53 OR dst_port = 53)) OR n % 4 = 2"),
    "ip[6:2] & 0x1fff != 0 and not src net 10.0.0.0/8": ("later", "n % 4 = 1 AND src_ip >> 24 <> 10"),
    "tcp[tcpflags] & tcp-syn != 0 or (vlan and tcp[13] = 16)": ("flags", "(n % 4 = 3 AND protocol = 'tcp' AND syn) OR (n % 4 = 0 AND protocol = 'tcp' AND NOT syn)"),
}


@query(f"{_TRACE}, x AS (SELECT *, frame_no AS n FROM t) SELECT frame_no, " + ", ".join(f"coalesce({sql}, FALSE) AS {name}" for name, sql in FILTERS.values()) + " FROM x")
def capture_filters(spark, sf_dir):
    """What filters over bytes pass of plain, tagged, fragmented and ARP frames."""
    from tracelake.functions.capture_filter import matches

    n, raw = F.col("frame_no"), F.col("raw")
    tagged = F.concat(F.substring(raw, 1, 12), F.unhex(F.lit("81000007")), F.substring(raw, 13, 100))
    later = F.concat(F.substring(raw, 1, 20), F.unhex(F.lit("0005")), F.substring(raw, 23, 100))
    asked = F.concat(F.substring(raw, 1, 12), F.unhex(F.lit("08060001080006040001020000000002")), number(F.col("src_ip"), 4), F.unhex(F.lit("000000000000")), number(F.col("dst_ip"), 4))
    made = F.when(n % 4 == 0, tagged).when(n % 4 == 1, later).when(n % 4 == 2, asked).otherwise(raw)
    frames = _captured(spark, sf_dir).withColumn("raw", made)
    return frames.select("frame_no", *(matches(text).alias(name) for text, (name, _) in FILTERS.items()))


@query(f"{_TRACE} SELECT {_FRAME} FROM t WHERE frame_no > (SELECT max(frame_no) FROM t) - 3000 AND frame_no % 7 = 0")
def stored_packets(spark, sf_dir):
    """Every seventh frame, asked of a store that holds the newest 3,000."""
    from tracelake.sources.packet_store import PacketStore
    from tracelake.sources.tables import scratch

    rows, store = trace(spark, sf_dir).select(*_FRAME.split(", ")), PacketStore(spark, scratch(spark, "store"), 3000, 512)
    store.put(rows)
    return store.get(rows.filter("frame_no % 7 = 0").select("frame_no")).select(*_FRAME.split(", "))


@query(f"{_TRACE}, s AS (SELECT {_K}, sum(wire_len)::BIGINT AS weight FROM p GROUP BY {_K}) SELECT * FROM s WHERE weight * 600 > (SELECT sum(weight) FROM s)")
def flows_above_share(spark, sf_dir):
    """Flows with more than one in 600 of all bytes, from a sketch of 600 counters."""
    from tracelake.operators.heavy_hitters import above_share

    return above_share(_keyed(spark, sf_dir), 600)
