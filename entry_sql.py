"""SQL that derives transactions, payloads, replies and logs from the test tables.

The same texts run in Spark and in DuckDB.
"""

CENTS = "(SELECT *, CAST(round(o_totalprice*100) AS BIGINT) AS c FROM orders)"


def _money(cents: str) -> str:
    return (
        f"CAST(CAST(floor({cents}/100) AS BIGINT) AS VARCHAR(20)) || '.' || "
        f"lpad(CAST({cents} % 100 AS VARCHAR(20)),2,'0')"
    )


_THOUSANDS = (
    "CAST(CAST(floor(c/100000) AS BIGINT) AS VARCHAR(20)) || ',' || "
    "lpad(CAST(CAST(floor(c/100) AS BIGINT) % 1000 AS VARCHAR(20)),3,'0') || '.' || "
    "lpad(CAST(c % 100 AS VARCHAR(20)),2,'0')"
)

# Transactions with padded and missing names and amounts in many spellings.
TRANSACTIONS = f"""
SELECT o_orderkey AS txn_id,
 CASE o_orderkey % 14 WHEN 0 THEN 'PAYPAL*DIGITALOCEAN' WHEN 1 THEN '  SQ *COFFEE SHOP NYC '
  WHEN 2 THEN 'UBER EATS DEC15' WHEN 3 THEN 'MONTHLY.RECURRING.CHG*NETFLIX'
  WHEN 4 THEN 'POS PURCHASE - STARBUCKS #12345' WHEN 5 THEN 'WM SUPERCENTER #1234'
  WHEN 6 THEN 'TARGET DEBIT CRD PURCHASE' WHEN 7 THEN 'GOOGLE *WORKSPACE' WHEN 8 THEN 'Facebook Ads'
  WHEN 9 THEN 'AMAZON MKTPLACE' WHEN 10 THEN 'STRIPE FEE' WHEN 11 THEN 'NOTION LABS'
  WHEN 12 THEN 'ZOOM.US ' ELSE NULL END AS merchant,
 CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'N/A' WHEN 2 THEN NULL
  WHEN 3 THEN '$' || {_money("c")}
  WHEN 4 THEN CASE WHEN c >= 100000 THEN '$' || {_THOUSANDS} ELSE '(12.00)' END
  ELSE {_money("c")} END AS amount,
 CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderpriority END AS description,
 o_orderstatus AS memo,
 CASE WHEN o_orderkey % 5 = 0 THEN 'Travel & Transportation' ELSE NULL END AS category
FROM {CENTS} o"""

# Seven families of names in four similar spellings; equal amounts make cliques.
SPELLINGS = """
SELECT txn_id, family, variant, name,
 CASE variant WHEN 0 THEN name WHEN 1 THEN lower(name) WHEN 2 THEN name || '.' ELSE name || ' X' END AS merchant,
 CAST(cell AS DOUBLE) * 0.05 AS amount
FROM (SELECT o_orderkey AS txn_id, CAST(o_orderkey % 7 AS INT) AS family,
  (o_orderkey * 3 + o_custkey) % 4 AS variant, (o_orderkey * 11 + o_custkey) % 299 AS cell,
  CASE o_orderkey % 7 WHEN 0 THEN 'PAYPAL*DIGITALOCEAN' WHEN 1 THEN 'SQ *COFFEE SHOP NYC' WHEN 2 THEN 'UBER EATS DEC15'
   WHEN 3 THEN 'MONTHLY.RECURRING.CHG*NETFLIX' WHEN 4 THEN 'POS PURCHASE - STARBUCKS #12345'
   WHEN 5 THEN 'WM SUPERCENTER #1234' WHEN 6 THEN 'TARGET DEBIT CRD PURCHASE' END AS name FROM orders) s"""

_ID = "CAST(o_orderkey AS VARCHAR(20))"
_SHOP = "'Shop ' || CAST(o_custkey AS VARCHAR(20))"

# One payload per order, in every accepted and rejected shape.
PAYLOADS = f"""
SELECT o_orderkey AS payload_id, CASE o_orderkey % 14
 WHEN 0 THEN '{{"data":[{{"merchant":"' || shop || '","amount":' || money || '}},{{"merchant":"Corner"}}]}}'
 WHEN 1 THEN '{{"merchant":["' || shop || '","Corner"],"amount":[' || money || ',25]}}'
 WHEN 2 THEN '{{"transactions":[{{"merchant":"' || shop || '"}}]}}'
 WHEN 3 THEN '[{{"merchant":"' || shop || '","amount":' || money || '}}]'
 WHEN 4 THEN '{{"merchant":"' || shop || '","amount":' || money || ',"memo":"' || o_orderstatus || '"}}'
 WHEN 5 THEN '{{"data":{{"merchant":["' || shop || '"],"amount":["$1,234.50"]}},"config":{{"enable_ai":false}}}}'
 WHEN 6 THEN '{{"invalid":"' || shop || '"}}'
 WHEN 7 THEN '{{"data":[]}}'
 WHEN 8 THEN '{{"data":[{{"merchant":"' || shop || '"}},{{"amount":1}}]}}'
 WHEN 9 THEN '{{"data":[{{"merchant":"' || shop || '"}},5]}}'
 WHEN 10 THEN '{{"merchant":["' || shop || '","Corner"],"amount":[1]}}'
 WHEN 11 THEN id
 WHEN 12 THEN '{{"merchant":["' || shop || '","Corner"],"amount":[1,2],"memo":"' || o_orderstatus || '"}}'
 ELSE '{{bad ' || id END AS body
FROM (SELECT *, {_ID} AS id, {_SHOP} AS shop, {_money("c")} AS money FROM {CENTS} o) p"""

# One payload of columns per order: three rows, a repeated value, a further field.
COLUMN_PAYLOADS = f"""
SELECT o_orderkey AS payload_id,
 '{{"merchant":["' || {_SHOP} || '","B",null],"amount":[' || {_money("c")} || ',null,"$5"],"memo":"' || o_orderstatus
 || '","note":["x",' || {_ID} || ',true]}}' AS body
FROM {CENTS} o"""

# One payload of records per order whose records differ in their keys.
RECORD_PAYLOADS = f"""
SELECT o_orderkey AS payload_id,
 '{{"transactions":[{{"merchant":"' || {_SHOP} || '","memo":null}},{{"merchant":"B","tag":"' || o_orderstatus
 || '"}},{{"merchant":null,"category":"Z"}}]}}' AS body
FROM orders o"""

# Payloads of three records: some of the later two are near copies of the first.
STREAM_PAYLOADS = f"""
SELECT o_orderkey AS payload_id,
 '[{{"merchant":"' || name || '","amount":' || money || '}},{{"merchant":"' || name || '.","amount":' ||
 CASE WHEN o_orderkey % 2 = 0 THEN money ELSE '7' END || '}},{{"merchant":" ' || lower(name) || ' ","amount":"$' ||
 CASE WHEN o_orderkey % 3 = 0 THEN money ELSE '8' END || '"}}]' AS body, c, name
FROM (SELECT *, 'AMAZON MARKETPLACE ' || {_ID} AS name, {_money("c")} AS money FROM {CENTS} o) p"""

# Model replies, good and bad.
REPLIES = f"""
SELECT o_orderkey AS reply_id, CASE o_orderkey % 10
 WHEN 0 THEN '{{"category":"Software & Technology","confidence":0.' || CAST(10 + o_custkey % 90 AS VARCHAR(20)) || '}}'
 WHEN 1 THEN 'Sure: {{"category":"' || {_SHOP} || '","confidence":"0.9"}} done'
 WHEN 2 THEN '{{"category":"' || {_SHOP} || '"}}'
 WHEN 3 THEN '{{"confidence":0.5}}'
 WHEN 4 THEN '{{"category":"X","confidence":null}}'
 WHEN 5 THEN '{{"category":"X","confidence":"high"}}'
 WHEN 6 THEN '{{bad ' || {_ID}
 WHEN 7 THEN 'no json ' || {_ID}
 WHEN 8 THEN '{{"vendor":"' || {_SHOP} || '","category":"Other","confidence":0.75,"business_impact":"High","risk_level":"Medium","recommendation":"r"}}'
 ELSE '[' || {_ID} || ']' END AS reply
FROM orders o"""

# A request log: each event is a request of the user's run.
REQUEST_LOG = """
SELECT user_id AS run_id,
 CASE event_type WHEN 'click' THEN 'vendor' WHEN 'view' THEN 'category' ELSE 'analysis' END AS kind,
 props AS key, value < 5 AS cached, ts, event_id FROM events"""

# Payloads that bring options of their own, a different config for every customer.
# Rows 0 and 1 are near copies; two or three unlike amounts are 1 to 1.5 deviations off.
CONFIG_PAYLOADS = f"""
SELECT o_orderkey AS payload_id, o_custkey AS cust, c, name, slack,
 '{{"data":[{{"merchant":"' || name || '","amount":' || money || '}},{{"merchant":"' || name || '.","amount":' || money ||
 '}},{{"merchant":" ' || slack || ' ","amount":' || more || '}}],"config":{{"customer":' || CAST(o_custkey AS VARCHAR(20)) ||
 ',"duplicate_threshold":' || CASE WHEN o_custkey % 2 = 0 THEN '"0.5"' ELSE '1' END ||
 ',"ai_confidence_threshold":' || CASE WHEN o_custkey % 7 = 0 THEN '0.9' ELSE '0.8' END ||
 ',"enable_ai":' || CASE WHEN o_custkey % 5 = 0 THEN 'false' ELSE 'true' END ||
 CASE WHEN o_custkey % 3 = 0 THEN ',"outlier_z_threshold":0.5' ELSE '' END ||
 CASE WHEN o_custkey % 11 = 0 THEN ',"chunk_size":"none"' ELSE '' END || '}}}}' AS body
FROM (SELECT *, 'AMAZON MARKETPLACE ' || {_ID} AS name, 'Slack ' || {_ID} AS slack, {_money("c")} AS money,
  {_money("(c + 10000)")} AS more FROM {CENTS} o) p"""

# Four rows a payload, in two slices: copies in one slice meet, copies across slices do not.
CHUNK_PAYLOADS = f"""
SELECT o_orderkey AS payload_id,
 '{{"data":[{{"merchant":"Acme ' || shop || '","amount":5}},{{"merchant":"ACME ' || shop || '","amount":5}},{{"merchant":"Acme ' || shop ||
 '","amount":5}},{{"merchant":"Other ' || shop || '","amount":9}}],"config":{{"chunked":true,"chunk_size":2,"enable_ai":false}}}}' AS body
FROM (SELECT *, CAST(o_custkey AS VARCHAR(20)) AS shop FROM orders) o"""

# Copies that differ in the padding of a further field, and a row of nulls.
EXTRA_PAYLOADS = f"""
SELECT o_orderkey AS payload_id,
 '{{"data":{{"merchant":["' || {_SHOP} || '","' || {_SHOP} || '",null],"amount":[1,1,null],"note":[" hi ","hi",null]}},"config":{{"duplicate_threshold":1,"enable_ai":false}}}}' AS body
FROM orders o"""

# All rows without an amount: one cell, each name in four spellings.
HOT_CELL = """
SELECT txn_id, family, CAST(0 AS DOUBLE) AS amount,
 CASE txn_id % 4 WHEN 0 THEN name WHEN 1 THEN upper(name) WHEN 2 THEN name || '.' ELSE name || ' X' END AS merchant
FROM (SELECT o_orderkey AS txn_id, CAST(floor(o_orderkey / 4) AS BIGINT) AS family,
  md5(CAST(CAST(floor(o_orderkey / 4) AS BIGINT) AS VARCHAR(20))) AS name FROM orders) s"""

# One name; every amount is within a cent of the ones before and after it only.
CHAIN = """
SELECT o_orderkey AS txn_id, 'One Shop' AS merchant, CAST(o_orderkey AS DOUBLE) * CAST(0.006 AS DOUBLE) AS amount
FROM orders o"""
