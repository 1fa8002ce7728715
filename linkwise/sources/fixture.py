"""Provider-shaped records derived from the supplied ``customer`` table.

The test tables hold no provider records, so this view builds them from
``customer`` (``k = c_custkey``): one clean version of every customer, a
near-duplicate for every fifth, and an invalid version for every 17th. The SQL
uses only functions that Spark SQL and DuckDB share, so the same text is the
Spark source and the start of every oracle query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# value lists of the derived provider records
FIRST_NAMES = "James,Mary,Robert,Patricia,John,Jennifer,Michael,Linda,David,Elizabeth,William,Barbara,Richard,Susan,Joseph,Jessica,Thomas,Sarah,Charles,Karen"
LAST_NAMES = "Smith,Johnson,Williams,Brown,Jones,Garcia,Miller,Davis,Rodriguez,Martinez,Hernandez,Lopez,Gonzalez,Wilson,Anderson,Thomas,Taylor,Moore,Jackson,Martin,Lee,Perez,Thompson,White,Harris,Sanchez,Clark,Ramirez,Lewis,Robinson,Walker"
STREETS = "Main,Oak,Pine,Maple,Cedar,Elm,Washington,Lake,Hill,Park,Walnut"
STREET_TYPES = "St,Ave,Blvd,Rd,Dr,Ln,Pkwy"
CITIES = "Alton,Berwick,Carden,Dunmore,St Elmo,Farley,Granby"
STATES = "IL,IL,IL,IL,MO,MA,TX"
SPECIALTIES = "Podiatry,Audiology,Optometry,Nutrition,Sleep Medicine,Sports Medicine"
ADDRESS_STATUSES = "Verified,Inconclusive,Invalid"
PHONE_STATUSES = "verified,inconclusive,invalid,no"


def _pick(values: str, index_sql: str) -> str:
    return f"split_part('{values}', ',', CAST(({index_sql}) + 1 AS INT))"


def _digit(s: str, pos: int) -> str:
    return f"CAST(substr({s}, {pos}, 1) AS INT)"


def _npi_sql(payload: str) -> str:
    """Nine-digit payload string -> payload + Luhn check digit (prefix 80840)."""
    terms = []
    for pos in range(1, 10):
        d = _digit(payload, pos)
        terms.append(f"(CASE WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END)" if pos % 2 else d)
    total = " + ".join(terms)
    return f"{payload} || CAST((10 - ({total} + 24) % 10) % 10 AS STRING)"


PROVIDER_VIEW_SQL = f"""
WITH base AS (
  SELECT c_custkey AS k,
         CAST(100000000 + c_custkey AS STRING) AS b,
         CAST(100000000 + c_custkey % 50 AS STRING) AS gb
  FROM {{customer}}
),
keyed AS (
  SELECT k, {_npi_sql('b')} AS npi0, {_npi_sql('gb')} AS gnpi0,
         {_pick(FIRST_NAMES, 'k % 20')} AS first0,
         {_pick(LAST_NAMES, '7 * k % 31')} AS last0,
         CAST(100 + k % 900 AS STRING) || ' ' || {_pick(STREETS, 'k % 11')} || ' ' || {_pick(STREET_TYPES, 'k % 7')} AS addr0,
         {_pick(STATES, 'k % 7')} AS state0,
         CAST(10000 + (37 * k) % 90000 AS STRING) AS zip0
  FROM base
),
versions AS (
  SELECT keyed.*, 0 AS v FROM keyed
  UNION ALL SELECT keyed.*, 1 AS v FROM keyed WHERE k % 5 = 0
  UNION ALL SELECT keyed.*, 2 AS v FROM keyed WHERE k % 17 = 0
)
SELECT
  k * 10 + v AS rid,
  CASE WHEN v = 2 AND k % 3 = 0
       THEN substr(npi0, 1, 9) || CAST((CAST(substr(npi0, 10, 1) AS INT) + 1) % 10 AS STRING)
       ELSE npi0 END AS npi,
  CASE WHEN v = 1 AND k % 20 = 0 THEN substr(first0, 1, 1) || substr(first0, 3) ELSE first0 END AS firstname,
  CASE WHEN k % 4 = 0 THEN 'A.' ELSE CAST(NULL AS STRING) END AS middlename,
  CASE WHEN v = 1 AND k % 30 = 0 THEN last0 || ' Jr.' ELSE last0 END AS lastname,
  CASE WHEN v = 1 AND k % 25 = 0 THEN replace(addr0, 'a', '')
       WHEN v = 1 THEN replace(replace(addr0, ' St', ' Street'), ' Ave', ' Avenue')
       ELSE addr0 END AS address1,
  {_pick(CITIES, 'k % 7')} AS city,
  CASE WHEN v = 1 THEN lower(state0)
       WHEN v = 2 AND k % 3 = 1 THEN 'Illinois'
       ELSE state0 END AS state,
  CASE WHEN v = 1 THEN zip0 || '-1234'
       WHEN v = 2 AND k % 3 = 2 THEN 'ABC12'
       ELSE zip0 END AS zipcode,
  CASE WHEN k % 41 = 0 THEN 'null' ELSE CAST(2000000000 + (7919 * k) % 1000000 AS STRING) END AS phone,
  CASE WHEN k % 3 = 0 THEN gnpi0 ELSE CAST(NULL AS STRING) END AS gnpi,
  CASE WHEN k % 3 = 0 THEN 'Group ' || CAST(k % 50 AS STRING) ELSE CAST(NULL AS STRING) END AS group_name,
  {_pick(SPECIALTIES, 'k % 6')} AS primary_spec_desc,
  {_pick(ADDRESS_STATUSES, 'k % 3')} AS address_status,
  {_pick(PHONE_STATUSES, 'k % 4')} AS phone_status
FROM versions
"""

#: The same records with every kind of fault in some rows, for the checks that the clean view passes.
ODD_VIEW_SQL = f"""
SELECT rid,
  CASE WHEN rid % 7 = 0 THEN substr(npi, 1, 9) WHEN rid % 7 = 1 THEN CAST(NULL AS STRING)
       WHEN rid % 7 = 2 THEN 'NULL' WHEN rid % 7 = 3 THEN concat(substr(npi, 1, 9), 'X') ELSE npi END AS npi,
  CASE WHEN rid % 11 = 0 THEN repeat('x', 51) WHEN rid % 11 = 1 THEN '' WHEN rid % 11 = 2 THEN CAST(NULL AS STRING)
       ELSE firstname END AS firstname,
  middlename,
  CASE WHEN rid % 13 = 0 THEN CAST(NULL AS STRING) WHEN rid % 13 = 1 THEN repeat('y', 50) ELSE lastname END AS lastname,
  CASE WHEN rid % 17 = 0 THEN repeat('z', 101) ELSE address1 END AS address1,
  city, state,
  CASE WHEN rid % 19 = 0 THEN CAST(NULL AS STRING) ELSE zipcode END AS zipcode,
  CASE WHEN rid % 5 = 0 THEN '12345' WHEN rid % 5 = 1 THEN concat('+', phone) ELSE phone END AS phone,
  gnpi, group_name, primary_spec_desc,
  CASE WHEN rid % 6 = 0 THEN 'unknown' WHEN rid % 6 = 1 THEN CAST(NULL AS STRING) ELSE address_status END AS address_status,
  CASE WHEN rid % 8 = 0 THEN 'NO' ELSE phone_status END AS phone_status
FROM ({PROVIDER_VIEW_SQL})
"""

RAW_COLUMNS = [
    "rid", "npi", "firstname", "middlename", "lastname", "address1", "city", "state", "zipcode",
    "phone", "gnpi", "group_name", "primary_spec_desc", "address_status", "phone_status",
]


def provider_view_sql(customer: str = "customer") -> str:
    """The view as SQL text over a table named ``customer``."""
    return PROVIDER_VIEW_SQL.replace("{customer}", customer)


#: Customers of a task: Spark splits files by bytes, and a customer of few bytes becomes a record of many fields.
CUSTOMERS_PER_TASK = 20_000


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table, dealt to tasks by its rows where they are many."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    tasks = -(-customer.count() // CUSTOMERS_PER_TASK)
    return customer.repartition(tasks) if tasks > 1 else customer


def provider_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw provider records (legacy column names, strings; ``rid`` bigint)."""
    customer = customers(spark, sf_dir)
    return spark.sql(PROVIDER_VIEW_SQL, customer=customer)


def odd_view_sql(customer: str = "customer") -> str:
    """The faulty records as SQL text over a table named ``customer``."""
    return ODD_VIEW_SQL.replace("{customer}", customer)


def odd_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw provider records with faults."""
    customer = customers(spark, sf_dir)
    return spark.sql(ODD_VIEW_SQL, customer=customer)
