"""Domain relations over the driver's tables.

Each relation is one portable SELECT that both engines read the same way; operators never see the tables themselves.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from playmill.session import table

RELATIONS = {
    "runs": """
SELECT CAST(o_orderkey AS STRING) AS run_id, CAST(o_custkey AS STRING) AS game_id, o_orderpriority AS platform,
       o_orderdate AS start_time, CAST(floor(o_totalprice / 1000) AS DOUBLE) AS duration_seconds,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'game_ended' ELSE 'error' END AS status,
       CAST(400 + o_orderkey % 300 AS INT) AS total_predictions,
       CAST(300 + (o_orderkey * 7) % 290 AS INT) AS successful_predictions,
       CASE WHEN o_orderkey % 97 = 0 THEN 'n/a' WHEN o_orderkey % 101 = 0 THEN NULL
            ELSE 'AWY ' || CAST(80 + (o_orderkey * 7) % 100 AS STRING) || ' - HOM ' || CAST(82 + (o_orderkey * 13) % 96 AS STRING) END AS final_score,
       CAST((o_orderkey * 11) % 40 AS DOUBLE) AS scoring_rate,
       CASE WHEN o_orderstatus = 'P' THEN 'the simulated prediction service failed with code ' || CAST(o_orderkey % 9 AS STRING) END AS error_message,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN 'Game ended at iteration ' || CAST(o_orderkey % 40 AS STRING)
            WHEN o_orderkey % 5 = 2 THEN 'validation_failed' ELSE 'max_iterations' END AS termination_reason
FROM orders""",
    "results": """
SELECT CAST(c_custkey AS STRING) AS game_id, CAST(c_custkey % 180 AS INT) AS day,
       'T' || CAST(c_custkey % 30 AS STRING) AS away_team, 'T' || CAST((c_custkey * 7 + 1) % 30 AS STRING) AS home_team,
       CAST(80 + (c_custkey * 11) % 60 AS INT) AS away_score, CAST(80 + (c_custkey * 17) % 60 AS INT) AS home_score,
       CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST((c_custkey * 37) % 41 - 20 AS DOUBLE) / 2 END AS final_spread,
       CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(200 + (c_custkey * 5) % 50 AS DOUBLE) END AS final_ou,
       CASE c_custkey % 5 WHEN 0 THEN '+120' WHEN 1 THEN '-200' WHEN 2 THEN '150' WHEN 3 THEN '-110' END AS away_moneyline,
       CASE c_custkey % 6 WHEN 0 THEN '-140' WHEN 1 THEN '+180' WHEN 2 THEN '-105' WHEN 3 THEN 'even' WHEN 4 THEN '+101' END AS home_moneyline
FROM customer""",
    "box": """
SELECT l_suppkey AS player, CAST(extract(year FROM l_shipdate) AS INT) AS season, CAST(l_shipdate AS DATE) AS day,
       l_orderkey AS game_id, l_linenumber AS line, l_returnflag AS venue,
       l_quantity AS mins, floor(l_quantity * (1 - l_discount)) AS fg, l_quantity AS fga, CAST(l_linenumber AS DOUBLE) AS p3,
       floor(l_quantity * l_tax) AS ft, floor(l_quantity * l_tax) + CAST(l_linenumber % 3 AS DOUBLE) AS fta,
       CAST(l_partkey % 12 AS DOUBLE) AS trb, CAST(l_partkey % 7 AS DOUBLE) AS ast, floor(l_extendedprice / 1000) AS pts, l_tax * 100 AS usage_rate,
       CAST(l_linenumber + l_partkey % 4 AS DOUBLE) AS p3a, CAST(l_partkey % 12 % 4 AS DOUBLE) AS orb, CAST(l_partkey % 12 - l_partkey % 12 % 4 AS DOUBLE) AS drb,
       CAST(l_partkey % 6 AS DOUBLE) AS pf, CAST(l_orderkey % 4 AS DOUBLE) AS stl, CAST(l_partkey % 5 AS DOUBLE) AS tov, CAST(l_orderkey % 3 AS DOUBLE) AS blk
FROM lineitem""",
    "plays": """
SELECT user_id AS game_id, event_id AS play_id, CAST(1 + (event_id * 4) % 5 AS INT) AS period,
       '0:' || lpad(CAST(CAST(floor((719 - (event_id * 7) % 720) / 60) AS INT) AS STRING), 2, '0') || ':' || lpad(CAST((719 - (event_id * 7) % 720) % 60 AS STRING), 2, '0') AS clock,
       CASE WHEN event_id % 2 = 0 THEN 'AWY' ELSE 'HOM' END AS team, 'P' || CAST(event_id % 10 AS STRING) AS player,
       event_type, value,
       CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_type = 'purchase' THEN 'P' || CAST(event_id % 10 AS STRING) || ' 3PT ' || CAST(event_id % 31 AS STRING) || ''' jumper (' || CAST(event_id % 9 AS STRING) || ' PTS)'
            WHEN event_type = 'click' THEN 'MISS driving layup  (blocked)' WHEN event_type = 'view' THEN 'SUB: P' || CAST(event_id % 10 AS STRING) || ' FOR P' || CAST(event_id % 7 AS STRING)
            WHEN event_type = 'signup' THEN 'Free Throw 1 of 2' ELSE 'Offensive Foul turnover' END AS description,
       CAST(sum(CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 1 + event_id % 3 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS INT) AS away_score,
       CAST(sum(CASE WHEN event_type = 'purchase' AND event_id % 2 = 1 THEN 1 + event_id % 3 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS INT) AS home_score,
       CAST((event_id * 3) % 100 - 3 AS DOUBLE) AS x, CAST((event_id * 5) % 96 - 1 AS DOUBLE) AS y
FROM events""",
    "steps": """
SELECT run_id, seq, quarter, CAST(CASE run_id % 3 WHEN 0 THEN 300 WHEN 1 THEN greatest(0, 720 - 40 * place + place % 2 * 100) ELSE greatest(0, 720 - 120 * place) END AS INT) AS seconds,
       CAST(away - CASE WHEN seq % 13 = 0 THEN 5 WHEN seq % 9 = 0 THEN 2 ELSE 0 END AS INT) AS away, CAST(home AS INT) AS home, CAST(seq % 4 AS INT) AS points,
       CASE WHEN seq % 11 = 0 THEN NULL WHEN seq % 5 = 0 THEN 'End of period' WHEN seq % 5 = 1 THEN 'SUB: P1 FOR P2' WHEN seq % 5 = 2 THEN 'Timeout' WHEN seq % 5 = 3 THEN 'P3 MISS 3PT' ELSE 'P4 free throw' END AS description,
       CASE WHEN seq % 4 = 0 THEN NULL WHEN seq % 2 = 0 THEN 'A' ELSE 'H' END AS shooter, 'P' || CAST(seq % 10 AS STRING) AS player,
       split(CASE WHEN seq % 17 = 0 THEN 'P1,P2,P1' ELSE 'P1,P2,P3,P4,P5,P6,P7,P8,P9' END, ',') AS court
FROM (SELECT run_id, seq, away, home, CAST(1 + floor((rn - 1) / CASE run_id % 3 WHEN 0 THEN 6.0 WHEN 1 THEN 16.0 ELSE 8.0 END) AS INT) AS quarter, CAST((rn - 1) % CASE run_id % 3 WHEN 0 THEN 6 WHEN 1 THEN 16 ELSE 8 END AS INT) AS place
  FROM (SELECT user_id AS run_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn,
        sum(CASE WHEN event_id % 2 = 0 THEN event_id % 4 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS away,
        sum(CASE WHEN event_id % 2 = 1 THEN event_id % 4 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS home FROM events))""",
    "deliveries": """
SELECT event_id, ts, user_id, event_type, value, CAST(CASE WHEN event_id % 40 = 7 THEN least(3, b + 2) ELSE b END AS INT) AS batch
FROM (SELECT *, CAST(floor((extract(day FROM ts) - 1) / 8.0) AS INT) AS b FROM events) AS first_time
UNION ALL SELECT event_id, ts, user_id, event_type, value, CAST(least(3, b + 1) AS INT) AS batch
FROM (SELECT *, CAST(floor((extract(day FROM ts) - 1) / 8.0) AS INT) AS b FROM events) AS again WHERE event_id % 25 = 3""",
    "teams": """
SELECT n_nationkey AS team_id, n_name AS abbr, n_name || ' of ' || r_name AS full_name, r_name AS conference, n_regionkey * 2 + n_nationkey % 2 AS division
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "turns": "SELECT conv_id, turn, role, text FROM conversations",
}

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One domain relation as a lazy DataFrame."""
    text = RELATIONS[name]
    used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def with_relations(sql: str) -> str:
    """``sql`` with the relations it names put in front as common table expressions."""
    used = [n for n in RELATIONS if re.search(rf"\b{n}\b", sql)]
    head = ", ".join(f"{n} AS ({RELATIONS[n]})" for n in used)
    body = sql.strip()
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
