"""Snapshots, inventories and ledgers derived from the test tables.

Each constant is a list of common table expressions that means the same in Spark and in other SQL engines;
{orders} and the like stand for the input tables. Numbers are chosen so that every class of difference occurs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SNAPSHOTS = """
base AS (SELECT o_orderkey k, o_custkey chat0, o_orderdate ts0, o_orderpriority pri FROM {orders}),
old_msg AS (
  SELECT k msg_pk,
    CASE WHEN k%401=3 THEN NULL ELSE CAST(1000000000000+k*7 AS STRING) END msg_id,
    chat0 chat_pk, k%25 sender_pk, ts0 ts,
    CASE WHEN k%509=13 THEN NULL WHEN k%53=7 THEN 106 WHEN k%100<80 THEN 0 WHEN k%100<90 THEN 1
         WHEN k%100<94 THEN 2 WHEN k%100<96 THEN 3 WHEN k%100<98 THEN 14 ELSE 112 END content_type,
    CASE WHEN k%53=7 OR k%100 BETWEEN 80 AND 89 OR k%100>=96 THEN NULL
         ELSE concat('message ', CAST(k AS STRING)) END txt,
    CASE WHEN k%53=7 OR k%5=0 THEN NULL ELSE concat('meta-', pri, '-', CAST(k AS STRING)) END meta,
    CASE WHEN k%100 BETWEEN 80 AND 93 THEN concat('thumb-', CAST(k AS STRING)) END thumb
  FROM base),
cur_base AS (
  SELECT msg_pk k, msg_id,
    CASE WHEN msg_pk%211=9 THEN CASE WHEN chat_pk>0 THEN chat_pk-1 ELSE 1 END ELSE chat_pk END chat_pk,
    CASE WHEN msg_pk%307=12 THEN (sender_pk+1)%25 ELSE sender_pk END sender_pk,
    CASE WHEN msg_pk%223=8 THEN ts + INTERVAL 1 SECOND ELSE ts END ts,
    CASE WHEN msg_pk%37=4 OR msg_pk%211=9 OR msg_pk%223=8 THEN 106
         WHEN msg_pk%521=14 THEN NULL ELSE content_type END content_type,
    CASE WHEN msg_pk%37=4 OR msg_pk%211=9 OR msg_pk%223=8 THEN NULL
         WHEN msg_pk%97=6 THEN concat('edited ', CAST(msg_pk AS STRING)) ELSE txt END txt,
    CASE WHEN msg_pk%37=4 THEN NULL ELSE meta END meta, thumb
  FROM old_msg WHERE msg_pk%997<>11),
cur_msg AS (
  SELECT k+1000000 msg_pk, msg_id, chat_pk+1000000 chat_pk, sender_pk+1000 sender_pk, ts, content_type, txt, meta, thumb FROM cur_base
  UNION ALL
  SELECT k+5000000, msg_id, chat_pk+1000000, sender_pk+1000, ts + INTERVAL 5 SECOND, content_type, txt, meta, thumb
  FROM cur_base WHERE k%1009=5
  UNION ALL
  SELECT k+9000000, CAST(2000000000000+k AS STRING), chat0+1000000, k%25+1000, ts0, 0, concat('new ', CAST(k AS STRING)), NULL, NULL
  FROM base WHERE k%499=1),
old_chat AS (SELECT c_custkey chat_pk, c_name chat_mid FROM {customer}),
cur_chat AS (SELECT c_custkey+1000000 chat_pk, c_name chat_mid FROM {customer}),
old_user AS (SELECT n_nationkey user_pk, n_name user_mid FROM {nation}),
cur_user AS (SELECT n_nationkey+1000 user_pk, n_name user_mid FROM {nation})"""

#: The current side damaged after a repair, so that each gate has something to find.
TAMPERED = (
    SNAPSHOTS
    + """,
bad_msg AS (
  SELECT msg_pk, CASE WHEN msg_pk%613=9 THEN concat(msg_id, 'x') ELSE msg_id END msg_id, chat_pk, sender_pk,
    CASE WHEN msg_pk%701=6 THEN ts + INTERVAL 2 SECOND ELSE ts END ts, content_type, txt, meta,
    CASE WHEN msg_pk%809=5 THEN 'changed' ELSE thumb END thumb
  FROM cur_msg WHERE msg_pk%907<>4
  UNION ALL
  SELECT msg_pk+20000000, concat(msg_id, 'y'), chat_pk, sender_pk, ts, content_type, txt, meta, thumb FROM cur_msg WHERE msg_pk%1013=7),
bad_user AS (SELECT user_pk, CASE WHEN user_pk=1007 THEN 'renamed' ELSE user_mid END user_mid FROM cur_user)"""
)

#: The current side with chats that share a natural key, which blocks an analysis.
BLOCKED = SNAPSHOTS + """,
twin_chat AS (SELECT chat_pk, CASE WHEN chat_pk%13=5 THEN 'shared' ELSE chat_mid END chat_mid FROM cur_chat)"""

#: Two snapshots of orders for a rule of another shape: two parents, two columns that must agree, prices that were lost.
ORDERS = """
first_ord AS (SELECT o_orderkey k, o_custkey buyer_pk, o_orderkey%25 country_pk, o_orderdate ts, o_orderstatus state0, o_orderpriority urgency FROM {orders}),
old_ord AS (
  SELECT k order_pk, CASE WHEN k%331=4 THEN NULL ELSE concat('ord-', CAST(k AS STRING)) END order_no, buyer_pk, country_pk, CAST(ts AS DATE) AS day, state0 state, urgency,
    CASE WHEN k%43=3 THEN NULL ELSE k*37%10000 - CASE WHEN k%59=2 THEN 10000 ELSE 0 END END cents, CASE WHEN k%3=0 OR k%43=3 THEN NULL ELSE concat('note ', CAST(k AS STRING)) END note
  FROM first_ord
  UNION ALL SELECT k+7000000, concat('ord-', CAST(k AS STRING)), buyer_pk, country_pk, CAST(ts AS DATE), state0, urgency, 1, NULL FROM first_ord WHERE k%1511=10),
cur_ord AS (
  SELECT order_pk+3000000 order_pk, order_no, CASE WHEN order_pk%173=5 THEN buyer_pk%7+1 ELSE buyer_pk END + 500000 buyer_pk, CASE WHEN order_pk%181=6 THEN (country_pk+3)%25 ELSE country_pk END + 100 country_pk,
    CASE WHEN order_pk%191=7 THEN DATE '1999-09-09' ELSE day END AS day, CASE WHEN order_pk%193=8 THEN NULL ELSE state END state, CASE WHEN order_pk%83=9 THEN NULL ELSE urgency END urgency,
    CASE WHEN order_pk%31=4 OR order_pk%173=5 OR order_pk%191=7 THEN NULL WHEN order_pk%71=1 THEN cents+1 ELSE cents END cents, CASE WHEN order_pk%31=4 OR order_pk%173=5 OR order_pk%191=7 THEN NULL ELSE note END note
  FROM old_ord WHERE order_pk%887<>12
  UNION ALL SELECT k+9000000, concat('new-', CAST(k AS STRING)), buyer_pk+500000, country_pk+100, CAST(ts AS DATE), state0, urgency, 5, NULL FROM first_ord WHERE k%457=2),
old_buyer AS (SELECT c_custkey buyer_pk, c_name buyer_name FROM {customer}),
cur_buyer AS (SELECT c_custkey+500000 buyer_pk, c_name buyer_name FROM {customer}),
old_country AS (SELECT n_nationkey country_pk, n_name country_name FROM {nation}),
cur_country AS (SELECT n_nationkey+100 country_pk, n_name country_name FROM {nation})"""

FILE_INDEX = """
acct AS (SELECT c_custkey k, c_custkey - c_custkey%2 backup_id,
                concat('P_u', substring(md5(c_name),1,8)) acct,
                CASE WHEN c_custkey%4=1 THEN 'GroupDomain' ELSE 'AppDomain' END domain FROM {customer}),
names AS (SELECT 'main.db' nm UNION ALL SELECT 'main.db-wal' UNION ALL SELECT 'main.db-shm'
          UNION ALL SELECT 'media.db' UNION ALL SELECT ''),
raw AS (SELECT k, backup_id, acct, domain, nm,
               concat('store/', acct, '/messages', CASE WHEN nm='' THEN '' ELSE '/' END, nm) path
        FROM acct CROSS JOIN names WHERE NOT (nm='main.db' AND (k%3=0 OR k%5=0))),
file_index AS (SELECT backup_id,
    CASE WHEN k%23=9 AND nm='main.db' THEN sha1(concat('bad-',path)) ELSE sha1(concat(domain,'-',path)) END file_id,
    domain, path, CASE WHEN nm='' OR nm='main.db' AND k%37=7 THEN 2 ELSE 1 END flags,
    CASE WHEN nm='main.db-wal' THEN CASE WHEN k%7=0 THEN (k%3)*4096 ELSE 0 END ELSE 4096+k END size,
    CASE WHEN k%11=5 THEN 2 WHEN k%13=6 THEN NULL WHEN k%4=0 THEN 1 WHEN k%4=2 THEN 4 ELSE 3 END protection_class,
    k%19<>3 has_key, k%17=4 has_digest,
    CASE WHEN nm='' THEN 16877 WHEN k%29=8 THEN NULL WHEN k%31=7 THEN 41471 ELSE 33188 END mode,
    concat(lpad(CAST(CASE WHEN k%41=3 THEN 9 ELSE k%5 END AS STRING), 2, '0'), '000000',
           substring(concat(md5(path), md5(domain), md5(c3)), 1, CASE WHEN k%43=6 THEN 78 ELSE 80 END)) key_blob
    FROM (SELECT *, concat('pad', CAST(k AS STRING)) c3 FROM raw)),
backups AS (SELECT DISTINCT backup_id,
    CASE WHEN backup_id%26=4 THEN 'incomplete' WHEN backup_id%34=6 THEN NULL ELSE 'finished' END snapshot_state,
    CASE WHEN backup_id%38=8 THEN NULL ELSE backup_id%22<>10 END is_encrypted,
    backup_id%46<>12 has_keybag,
    CASE WHEN backup_id%58=14 THEN 40 ELSE 44 END manifest_key_length,
    CASE WHEN backup_id%6=2 THEN NULL ELSE concat('device-', CAST(backup_id AS STRING)) END info_name,
    concat('locked-', CAST(backup_id AS STRING)) lockdown_name FROM acct),
wanted AS (SELECT DISTINCT domain, concat('store/', acct, '/messages/media.db') path FROM acct WHERE k%3=1),
requests AS (SELECT backup_id, CASE WHEN backup_id%10=4 THEN 'P_unknown' ELSE min(acct) END account FROM acct WHERE backup_id%4=2 GROUP BY backup_id)"""

MANIFESTS = """
source_manifest AS (SELECT concat(source,'/',CAST(doc_id AS STRING)) path, CAST(n_chars AS BIGINT) size, sha256(text) hash, doc_id FROM {documents}),
clone_manifest AS (
  SELECT path, size, CASE WHEN doc_id%97=5 THEN sha256(concat(hash,'x')) ELSE hash END hash, doc_id FROM source_manifest WHERE doc_id%89<>3
  UNION ALL SELECT concat(path,'.extra'), size, hash, doc_id FROM source_manifest WHERE doc_id%101=7),
source_later AS (SELECT path, size + CASE WHEN doc_id%211=8 THEN 1 ELSE 0 END size, CASE WHEN doc_id%193=4 THEN NULL ELSE hash END hash FROM source_manifest WHERE doc_id%499<>6),
good_clone AS (SELECT path, size, CASE WHEN doc_id%97=5 AND doc_id%89<>3 AND doc_id%2=0 THEN sha256(concat(hash,'x')) ELSE hash END hash FROM source_manifest),
approved AS (SELECT path FROM source_manifest WHERE doc_id%97=5 AND doc_id%89<>3 AND doc_id%2=0),
outputs AS (SELECT doc_id%150 session_id, CASE WHEN doc_id%3=0 THEN 0 WHEN doc_id%3=1 THEN 1 ELSE 3 END stage, path, size, hash, doc_id%5=0 sensitive FROM source_manifest)"""

LEDGER = """
events_log AS (SELECT user_id session_id, event_id seq,
    CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END stage,
    CASE event_id%5 WHEN 0 THEN 'begin' WHEN 1 THEN 'begin' WHEN 3 THEN 'fail' ELSE 'commit' END kind FROM {events})"""

#: What stages have found out, by session, stage and flag; some sessions have nothing, some no event.
EVIDENCE = LEDGER + """,
sessions AS (SELECT c_custkey session_id FROM {customer} UNION SELECT session_id FROM events_log),
flags_known AS (SELECT 0 stage, 'old_intake' flag, 0 j UNION ALL SELECT 0, 'current_intake', 1 UNION ALL SELECT 0, 'current_patchable', 2 UNION ALL SELECT 1, 'plan_actionable', 3
  UNION ALL SELECT 2, 'review_acknowledged', 4 UNION ALL SELECT NULL, 'destination_selected', 5 UNION ALL SELECT NULL, 'count_typed', 6 UNION ALL SELECT NULL, 'confirmed', 7 UNION ALL SELECT 4, 'verified', 8),
evidence AS (SELECT session_id, stage, flag, CASE WHEN (session_id*5+j)%31=3 THEN NULL ELSE (session_id*7+j*3)%11<>4 END AS value FROM sessions CROSS JOIN flags_known WHERE (session_id+j)%13<>5)"""

FLEET = """
need AS (SELECT 0 j, 'message' table_name, 'msg_pk' column_name UNION ALL SELECT 1,'message','msg_id' UNION ALL SELECT 2,'message','chat_pk'
  UNION ALL SELECT 3,'message','sender_pk' UNION ALL SELECT 4,'message','ts' UNION ALL SELECT 5,'message','content_type' UNION ALL SELECT 6,'message','txt'
  UNION ALL SELECT 7,'message','meta' UNION ALL SELECT 8,'message','thumb' UNION ALL SELECT 9,'chat','chat_pk' UNION ALL SELECT 10,'chat','chat_mid'
  UNION ALL SELECT 11,'user','user_pk' UNION ALL SELECT 12,'user','user_mid'),
fleet_columns AS (SELECT c_custkey snapshot_id, table_name, j pos, column_name FROM {customer} CROSS JOIN need WHERE (c_custkey*7+j)%41<>0),
fleet_snapshots AS (SELECT c_custkey snapshot_id FROM {customer}),
fleet_pairs AS (SELECT c_custkey pair_id, c_custkey old_id, c_custkey+1 current_id FROM {customer} WHERE c_custkey%2=0)"""

PLANS = """
plans AS (SELECT o_orderkey session_id, o_orderkey%300 predicted, sha256(CAST(o_orderkey AS STRING)) plan_id,
  concat('dest-', CAST(o_orderkey%7 AS STRING)) destination, concat('src-', CAST(o_orderkey%11 AS STRING)) rollback_source FROM {orders}),
confirmations AS (SELECT session_id, CASE WHEN session_id%13=2 THEN predicted+1 ELSE predicted END predicted, plan_id,
  CASE WHEN session_id%17=3 THEN 'elsewhere' ELSE destination END destination,
  CASE WHEN session_id%19=4 THEN NULL ELSE rollback_source END rollback_source FROM plans)"""

_TABLES = ("orders", "customer", "nation", "documents", "events")


def derived(spark: SparkSession, sf_dir: str, expressions: str, name: str) -> DataFrame:
    """One of the tables that the expressions define, as a DataFrame over the Parquet inputs in sf_dir."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if f"{{{t}}}" in expressions}
    return spark.sql(_spark(expressions, name), **used)


def _spark(expressions: str, name: str) -> str:
    """Spark's sha2 takes the number of bits, and its concat is null where a part is; the expressions mean one that leaves nulls out."""
    expressions = re.sub(r"\bconcat\(", "concat_ws('', ", expressions)
    out, at = "", 0
    while (i := expressions.find("sha256(", at)) >= 0:
        depth, j = 1, i + len("sha256(")
        while depth:
            depth += {"(": 1, ")": -1}.get(expressions[j], 0)
            j += 1
        out += expressions[at:i] + "sha2(" + expressions[i + len("sha256(") : j - 1] + ", 256)"
        at = j
    return f"WITH {out + expressions[at:]} SELECT * FROM {name}"


def oracle(expressions: str, query: str) -> str:
    """The expressions over tables of their own names, and a query, for another engine."""
    return "WITH " + expressions.format(**{t: t for t in _TABLES}) + "\n" + query
