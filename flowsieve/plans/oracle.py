"""SQL fragments which state the expected results of the registered queries."""

from __future__ import annotations

from collections.abc import Sequence

from flowsieve.sources.flows_csv import MISSING_TOKENS, UNSW_COLUMNS
from flowsieve.sources.standins import DIRTY_LABELS, DIRTY_NUMBERS, LINEITEM_KEY, UNSW_ATTACKS

NUMBER = r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*"
SPACE = r"[\s\x{85}\x{a0}\x{2000}-\x{200a}\x{3000}]"


def text(value: str | None) -> str:
    if value is None:
        return "NULL"
    parts = [f"chr({ord(c)})" if ord(c) > 126 else "'" + c.replace("'", "''") + "'" for c in value]
    return "(" + " || ".join(parts) + ")" if parts else "''"


def pick(values: Sequence[str | None], place: str) -> str:
    arms = " ".join(f"WHEN {i} THEN {text(v)}" for i, v in enumerate(values))
    return f"(CASE ({place}) % {len(values)} {arms} END)"


def number(cell: str) -> str:
    parsed = f"TRY_CAST(trim({cell}) AS DOUBLE)"
    return (
        f"(CASE WHEN regexp_full_match({cell}, '{NUMBER}') AND isfinite({parsed}) THEN {parsed} END)"
    )


def strip(cell: str) -> str:
    return f"regexp_replace({cell}, '^{SPACE}+|{SPACE}+$', '', 'g')"


EVENTS = """SELECT event_id, user_id, value,
  CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS k, event_type,
  CAST(event_type = 'error' AS INTEGER) AS is_attack,
  CAST(value > 60 AS INTEGER) AS rule, floor(value) AS rule_score,
  CASE user_id % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase'
    WHEN 3 THEN 'signup' ELSE 'view' END AS rule_class
  FROM events"""

DOC_LABELS = """SELECT d.doc_id, lang, source, n_chars, quality, toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""

DIRTY_EVENTS = f"""SELECT event_id, {pick(DIRTY_LABELS, 'event_id')} AS label,
  CASE WHEN user_id % 2 = 0 THEN ' ' || CAST(value AS VARCHAR)
    ELSE {pick(DIRTY_NUMBERS, 'event_id')} END AS amount FROM events"""

HOLED_ORDERS = """SELECT o_orderkey, o_orderstatus,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price,
  CAST(o_custkey % 100 AS DOUBLE) AS customer,
  CASE WHEN o_orderkey % 50 = 0 THEN 9.0::DOUBLE ELSE 3.0::DOUBLE END AS constant FROM orders"""

LINEITEM_SHARED = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  l_extendedprice AS duration, l_quantity AS src_packets, CAST(l_linenumber AS DOUBLE) AS dst_packets,
  l_quantity * 64 AS src_bytes, CAST(l_partkey % 1500 AS DOUBLE) AS dst_bytes,
  l_extendedprice / l_quantity AS src_mean_packet_sz, l_tax * 100::DOUBLE AS dst_mean_packet_sz,
  l_discount * 1000::DOUBLE AS src_iat_mean, CAST(l_suppkey % 100 AS DOUBLE) AS dst_iat_mean,
  CAST(l_extendedprice > 60000 AS INTEGER) AS is_attack FROM lineitem"""

EVENTS_SHARED = f"""SELECT event_id, value * 1000::DOUBLE AS duration, k + 1 AS src_packets,
  CAST(user_id % 7 AS DOUBLE) AS dst_packets, (k + 1) * 64 AS src_bytes,
  CAST(user_id * 10 AS DOUBLE) AS dst_bytes, value * 20::DOUBLE AS src_mean_packet_sz,
  k % 9 AS dst_mean_packet_sz, value AS src_iat_mean, k AS dst_iat_mean,
  CAST(value > 60 AS INTEGER) AS is_attack FROM ({EVENTS})"""

N = "(l_partkey + l_suppkey + l_linenumber)"
CIC_LABELS = ("BENIGN", "benign", "DoS Hulk", None, "PortScan", "DDoS", "Unknown", " Bot")
CIC_FEATURES = (
    "flow_duration", "total_fwd_packets", "total_backward_packets", "total_length_of_fwd_packets",
    "total_length_of_bwd_packets", "fwd_packet_length_mean", "bwd_packet_length_mean",
    "fwd_iat_mean", "bwd_iat_mean",
)
# Text cells of the headered stand-in, with the leading space of a label skipped on reading.
CIC_CELLS = f"""SELECT concat_ws('-', {', '.join(LINEITEM_KEY)}) AS flow_id,
  '10.0.0.' || l_suppkey AS source_ip,
  CASE WHEN {N} % 19 = 0 THEN 'Infinity' ELSE CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) END AS flow_duration,
  CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS total_fwd_packets,
  CASE WHEN {N} % 23 <> 0 THEN CAST(l_linenumber AS VARCHAR) END AS total_backward_packets,
  CAST(CAST(l_quantity * 64 AS INTEGER) AS VARCHAR) AS total_length_of_fwd_packets,
  CAST(l_partkey % 1500 AS VARCHAR) AS total_length_of_bwd_packets,
  CAST(l_partkey % 97 AS VARCHAR) AS fwd_packet_length_mean,
  CASE WHEN {N} % 29 = 0 THEN 'abc' ELSE CAST(l_suppkey % 10 AS VARCHAR) END AS bwd_packet_length_mean,
  CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR) AS fwd_iat_mean,
  '7' AS bwd_iat_mean, trim({pick(CIC_LABELS, N)}) AS label FROM lineitem"""
CIC_ORDER = ("flow_id", "source_ip", *CIC_FEATURES, "label")

UNSW_SPECIAL = {
    "srcip": "'10.0.' || l_suppkey",
    "sport": "CAST(l_linenumber AS VARCHAR)",
    "dstip": "'10.1.' || l_partkey",
    "dsport": "CAST(l_orderkey AS VARCHAR)",
    "proto": pick(("tcp", "udp", "arp", "ospf"), "l_partkey"),
    "state": "l_linestatus",
    "service": pick(("-", "dns", "http"), "l_suppkey"),
    "attack_cat": pick(UNSW_ATTACKS, N),
    "Label": f"CASE WHEN {N} % 7 < 3 THEN '0' ELSE '1' END",
    "sbytes": f"CASE WHEN {N} % 31 = 0 THEN ' ' ELSE CAST(CAST(l_quantity * 64 AS INTEGER) AS VARCHAR) END",
    "ct_ftp_cmd": f"CASE WHEN {N} % 5 = 0 THEN '-' ELSE '1' END",
}
UNSW_CELLS = "SELECT " + ", ".join(
    UNSW_SPECIAL.get(c, f"CAST((l_partkey * {i + 1} + l_linenumber) % {90 + i} AS VARCHAR)")
    + f' AS "{c}"'
    for i, c in enumerate(UNSW_COLUMNS)
) + " FROM lineitem"
MISSING = ", ".join(text(t) for t in MISSING_TOKENS)


def row_id(columns: Sequence[str], seed: int = 0) -> str:
    cells = ", ".join(f'coalesce("{c}", chr(0))' for c in columns)
    return f"md5(concat_ws('|', '{seed}', {cells}))"


def split_ctes(base: str, stratum: str, key: str, name: str = "marked") -> str:
    """CTEs ending in ``name``: the base rows with their ``split``.

    Held-out rows are the first of each stratum in hash order, by a plain
    ``row_number`` over the whole stratum.
    """
    return f"""base AS ({base}),
  sizes AS (SELECT {stratum} AS s, count(*) AS n FROM base GROUP BY 1),
  total AS (SELECT CAST(sum(n) AS BIGINT) AS total,
      CAST(sum(n) - ceil(0.2::DOUBLE * CAST(sum(n) AS BIGINT)) AS BIGINT) AS train_total FROM sizes),
  shares AS (SELECT s, n, n / CAST(total AS DOUBLE) * train_total AS share FROM sizes, total),
  parts AS (SELECT s, n, CAST(floor(share) AS BIGINT) AS part, share - floor(share) AS rest FROM shares),
  quotas AS (SELECT s, n - part - CAST(row_number() OVER (ORDER BY rest DESC, s)
      <= (SELECT train_total FROM total) - (SELECT sum(part) FROM parts) AS BIGINT) AS want FROM parts),
  placed AS (SELECT *, row_number() OVER (PARTITION BY {stratum}
      ORDER BY md5(concat_ws('|', '42', {key}))) AS place FROM base),
  {name} AS (SELECT p.* EXCLUDE (place), CASE WHEN place <= want THEN 'test' ELSE 'train' END AS split
      FROM placed p JOIN quotas q ON p.{stratum} IS NOT DISTINCT FROM q.s)"""


def scaled_ctes(columns: Sequence[str], keep: Sequence[str], source: str = "marked") -> str:
    """CTEs ending in ``scaled``: imputed and scaled with statistics of the training rows."""
    medians = ", ".join(f'quantile_cont("{c}", 0.5) AS "{c}"' for c in columns)
    filled = ", ".join(f'coalesce(t."{c}", m."{c}") AS "{c}"' for c in columns)
    kept = ", ".join(f't."{c}"' for c in keep)
    quarters = ", ".join(f'quantile_cont("{c}", [0.25, 0.5, 0.75]) AS "{c}"' for c in columns)
    scaled = ", ".join(
        f'(t."{c}" - q."{c}"[2]) / (CASE WHEN q."{c}"[3] - q."{c}"[1] < 1e-14 THEN 1.0::DOUBLE'
        f' ELSE q."{c}"[3] - q."{c}"[1] END) AS "{c}"'
        for c in columns
    )
    return f"""med AS (SELECT {medians} FROM {source} WHERE split = 'train'),
  filled AS (SELECT {kept}, {filled} FROM {source} t, med m),
  quarters AS (SELECT {quarters} FROM filled WHERE split = 'train'),
  scaled AS (SELECT {kept}, {scaled} FROM filled t, quarters q)"""


def rounded(columns: Sequence[str], digits: int = 6) -> str:
    return ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in columns)


# Confusion counts of rule verdicts.
BINARY_CELLS = """SELECT count(*) FILTER (is_attack = 0 AND rule = 0) AS tn,
  count(*) FILTER (is_attack = 0 AND rule = 1) AS fp,
  count(*) FILTER (is_attack = 1 AND rule = 0) AS fn,
  count(*) FILTER (is_attack = 1 AND rule = 1) AS tp FROM ev"""


def ratio(a: str, b: str) -> str:
    return f"coalesce(({a}) / nullif(CAST(({b}) AS DOUBLE), 0), 0)"


REPORT = f"""classes AS (SELECT DISTINCT unnest([event_type, rule_class]) AS class FROM ev),
  sums AS (SELECT class,
      (SELECT count(*) FROM ev WHERE event_type = class) AS support,
      (SELECT count(*) FROM ev WHERE rule_class = class) AS called,
      (SELECT count(*) FROM ev WHERE event_type = class AND rule_class = class) AS hits FROM classes),
  pr AS (SELECT class, {ratio('hits', 'called')} AS precision, {ratio('hits', 'support')} AS recall,
      support FROM sums),
  report AS (SELECT class, precision, recall,
      {ratio('2 * precision * recall', 'precision + recall')} AS f1, support FROM pr)"""

SMOTE_POINTS = """p AS (SELECT label, [CAST(e AS DOUBLE) FOR e IN embedding] AS x,
      row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '42', vec_id))) - 1 AS ord
    FROM embeddings),
  sizes AS (SELECT label, count(*) AS n FROM p GROUP BY label),
  numbers AS (SELECT label, n, unnest(range((SELECT max(n) FROM sizes) - n)) AS number FROM sizes),
  draws AS (SELECT label, number,
      CAST('0x' || substr(md5(concat_ws('|', '42', label, number, 'base')), 1, 15) AS BIGINT) % n AS base,
      CAST('0x' || substr(md5(concat_ws('|', '42', label, number, 'neighbour')), 1, 15) AS BIGINT) % 5 + 1 AS rank,
      CAST('0x' || substr(md5(concat_ws('|', '42', label, number, 'gap')), 1, 15) AS BIGINT)
        / CAST(1152921504606846976 AS DOUBLE) AS gap FROM numbers),
  pairs AS (SELECT a.label, a.ord AS base, b.ord AS near, row_number() OVER (
      PARTITION BY a.label, a.ord ORDER BY list_sum([(a.x[i] - b.x[i]) * (a.x[i] - b.x[i]) FOR i IN range(1, 65)]), b.ord) AS rank
    FROM p a JOIN p b ON a.label = b.label AND a.ord <> b.ord),
  made AS (SELECT d.label, d.number, [a.x[i] + d.gap * (b.x[i] - a.x[i]) FOR i IN range(1, 65)] AS x
    FROM draws d JOIN pairs q ON q.label = d.label AND q.base = d.base AND q.rank = d.rank
    JOIN p a ON a.label = d.label AND a.ord = d.base JOIN p b ON b.label = d.label AND b.ord = q.near)"""
