"""Registered operators: a Spark callable and, where SQL can say it, the
equivalent DuckDB SQL. Names are the inventory id plus a word.

Every query reads the supplied ``customer`` table through the provider view
(``linkwise.sources.fixture``), so its work grows with the table.
"""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwise.functions import normalize as N
from linkwise.functions import validate as V
from linkwise.functions.constants import TRAINING_RULES
from linkwise.functions.numbers import TENS, UNITS
from linkwise.operators import quality as Q
from linkwise.operators import stats as S
from linkwise.operators.blocking import block_sizes, candidate_pairs, profile_table, rule_pairs
from linkwise.operators.cluster import (
    assign_clusters,
    connected_components,
    profile_clusters,
    with_primary,
)
from linkwise.operators.compare import compare, compare_candidates
from linkwise.operators.near_patterns import candidate_patterns
from linkwise.operators.prepare import (
    batch_check,
    model_columns,
    prepare,
    to_model,
    validate_rows,
    with_unique_id,
)
from linkwise.operators.reach import reachable_pairs
from linkwise.operators.score import above_threshold, score, term_frequencies, with_term_frequencies
from linkwise.operators.train import (
    Model,
    estimate_u,
    level_shares,
    pattern_counts,
    random_pairs,
    start_m,
    train,
    u_exact,
)
from linkwise.plans import oracle as O
from linkwise.plans import oracle_model as OM
from linkwise.plans.pipeline import prepare_data, run_deduplication, run_file, score_pairs
from linkwise.plans.spec import Comparison, MatchSpec, preset_strict, spec_fuzzy
from linkwise.session import materialize, work_path
from linkwise.sources.fixture import odd_records, provider_records
from linkwise.sources.reader import load, load_multiple
from linkwise.sources.writer import save, save_report

# ---------------------------------------------------------------------------
# shared Spark building blocks
# ---------------------------------------------------------------------------


def raw(spark, d) -> DataFrame:
    return provider_records(spark, d)


_PREPARED_PATHS: dict[tuple[str, str], str] = {}


def prepared(spark, d) -> DataFrame:
    """The prepared records, written once per session and data folder under
    the checkpoint folder (as the pipeline does) and read back: every query
    then plans from a Parquet scan instead of re-deriving the records."""
    key = (spark.sparkContext.applicationId, d)
    path = _PREPARED_PATHS.get(key)
    if path is None:
        path = work_path(spark, "prepared")
        prepare(raw(spark, d), "rid")[0].write.parquet(path)
        _PREPARED_PATHS[key] = path
    return spark.read.parquet(path)


FUZZY = spec_fuzzy()
PRESET = preset_strict()
FUZZY_COLS = FUZZY.profile_columns()
PRESET_COLS = PRESET.profile_columns()
EXACT_COMPS = [Comparison(c, "exact") for c in ("npi", "given_name", "family_name", "postal_code", "phone")]
GAMMA_COMPS = [
    Comparison("npi", "exact"),
    Comparison("street_address", "levenshtein", (1, 2, 3)),
    Comparison("given_name", "name"),
    Comparison("postal_code", "postcode"),
]
JW_COMP = Comparison("street_address", "jaro_winkler")
SCORE_THRESHOLD = 0.95
PRIMARY_FIELDS = ["npi", "group_npi", "group_name", "given_name", "middle_name", "family_name", "street_address",
                  "city", "state", "postal_code", "phone", "specialty"]
SAMPLE_PAIRS = 50_000


def fuzzy_profiles(spark, d):
    return profile_table(prepared(spark, d), FUZZY_COLS)


def fuzzy_pairs(spark, d, columns):
    return candidate_pairs(fuzzy_profiles(spark, d), FUZZY, columns)


def exact_model(records) -> Model:
    """u in closed form from the data, m at its start values."""
    u = estimate_u(records, EXACT_COMPS, SAMPLE_PAIRS)
    return Model(EXACT_COMPS, {c.column: start_m(c) for c in EXACT_COMPS}, u, 0.0001)


def scored_exact(spark, d):
    rec = prepared(spark, d)
    pairs = candidate_pairs(profile_table(rec, FUZZY_COLS), FUZZY, [c.column for c in EXACT_COMPS])
    return score(compare(pairs, EXACT_COMPS), exact_model(rec))


def linked_exact(spark, d):
    """(records, profiles, scored pairs that can reach the threshold), the pairs written once for the steps that read them."""
    rec = prepared(spark, d)
    prof = profile_table(rec, FUZZY_COLS)
    model = exact_model(rec)
    pairs = reachable_pairs(prof, FUZZY, model, SCORE_THRESHOLD, [c.column for c in EXACT_COMPS])
    return rec, prof, materialize(score(compare(pairs, EXACT_COMPS), model), "scored")


def exact_results(spark, d):
    rec, prof, scored = linked_exact(spark, d)
    clusters = profile_clusters(scored, SCORE_THRESHOLD)
    return assign_clusters(rec, prof, clusters, FUZZY_COLS)


#: Records with small differences between copies, so that every comparison level and more EM rounds occur.
VARIED = {
    "street_address": "CASE unique_id % 30 WHEN 1 THEN concat(street_address, 'x') WHEN 11 THEN concat('z', street_address, 'x') "
                      "ELSE street_address END",
    "given_name": "CASE unique_id % 70 WHEN 1 THEN concat(given_name, 'q') WHEN 11 THEN concat(substring(given_name, 1, 2), 'qq') "
                  "WHEN 21 THEN concat('w', given_name) ELSE given_name END",
    "postal_code": "CASE unique_id % 30 WHEN 1 THEN concat(substring(postal_code, 1, 3), '99') WHEN 21 THEN "
                   "concat(substring(postal_code, 1, 1), '0000') ELSE postal_code END",
    "phone": "CASE WHEN unique_id % 40 = 1 THEN concat(substring(phone, 1, 5), '77777') ELSE phone END",
}


def varied(spark, d) -> DataFrame:
    return prepared(spark, d).withColumns({c: F.expr(x) for c, x in VARIED.items()})


def _varied_sql(sql: str) -> str:
    """The same SQL over the varied records."""
    plain = O.PREPARED.replace("prepared AS (", "plain AS (", 1)
    change = ", ".join(f"{x} AS {c}" for c, x in VARIED.items())
    return sql.replace(O.PREPARED, f"{plain},\nprepared AS (SELECT * REPLACE ({change}) FROM plain)")


def _r6(c):
    return F.round(F.col(c), 6).alias(c)


# ---------------------------------------------------------------------------
# SQL building blocks (DuckDB)
# ---------------------------------------------------------------------------

FUZZY_PROFILES = O.profiles_cte(FUZZY_COLS)


def _pairs_sql(columns) -> str:
    rules = [r.sql for r in FUZZY.blocking_rules]
    parts = [O.rule_pairs_select(r, columns, rules[:k], k) for k, r in enumerate(rules)]
    return "pairs AS (" + " UNION ALL ".join(parts) + ")"


def _u_exact_sql(col: str) -> str:
    return (f"(SELECT CAST(sum(nv * (nv - 1) / 2) AS DOUBLE) / (sum(nv) * (sum(nv) - 1) / 2) "
            f"FROM (SELECT count(*) AS nv FROM prepared WHERE {col} IS NOT NULL GROUP BY {col}))")


def _weight_sql(c: Comparison) -> str:
    u = _u_exact_sql(c.column)
    u1 = f"greatest({u}, 1e-6)"
    u0 = f"greatest(1 - {u}, 1e-6)"
    return f"CASE {c.gamma} WHEN 1 THEN log2(0.95 / {u1}) WHEN 0 THEN log2(0.05 / {u0}) ELSE 0 END"


PRIOR_W = math.log2(0.0001 / (1 - 0.0001))


def _scored_sql() -> list[str]:
    gam = ", ".join(f"{O.gamma_sql(c, c.column + '_l', c.column + '_r')} AS {c.gamma}" for c in EXACT_COMPS)
    w = f"{PRIOR_W!r} + " + " + ".join(_weight_sql(c) for c in EXACT_COMPS)
    return [
        FUZZY_PROFILES,
        _pairs_sql([c.column for c in EXACT_COMPS]),
        f"gammas AS (SELECT rep_id_l, rep_id_r, pair_count, match_key, {gam} FROM pairs)",
        f"weighted AS (SELECT *, {w} AS match_weight FROM gammas)",
        "scored AS (SELECT *, 1 / (1 + pow(2, -match_weight)) AS match_probability FROM weighted)",
    ]


def _clusters_sql() -> list[str]:
    return _scored_sql() + [
        f"linked AS (SELECT * FROM scored WHERE match_probability >= {SCORE_THRESHOLD})",
        "edges AS (SELECT rep_id_l AS a, rep_id_r AS b FROM linked WHERE rep_id_l <> rep_id_r "
        "UNION SELECT rep_id_r, rep_id_l FROM linked WHERE rep_id_l <> rep_id_r)",
        "RECURSIVE_PLACEHOLDER",
        "comp AS (SELECT node AS rep_id, min(c) AS component FROM walk GROUP BY node)",
        "ends AS (SELECT rep_id_l AS rep_id, match_probability FROM linked "
        "UNION ALL SELECT rep_id_r, match_probability FROM linked)",
        "best AS (SELECT rep_id, max(match_probability) AS cmp FROM ends GROUP BY rep_id)",
        "clusters AS (SELECT best.rep_id, coalesce(component, best.rep_id) AS cluster_rep, cmp "
        "FROM best LEFT JOIN comp ON best.rep_id = comp.rep_id)",
    ]


def _with_recursive(ctes: list[str], select: str) -> str:
    walk = ("walk(node, c) AS (SELECT a, a FROM edges UNION "
            "SELECT e.b, w.c FROM walk w JOIN edges e ON w.node = e.a)")
    body = [walk if c == "RECURSIVE_PLACEHOLDER" else c for c in O.BASE + ctes]
    return "WITH RECURSIVE " + ",\n".join(body) + "\n" + select


def _results_sql() -> list[str]:
    on = " AND ".join(f"p.{c} IS NOT DISTINCT FROM x.{c}" for c in FUZZY_COLS)
    return _clusters_sql() + [
        "linkedp AS (SELECT p.*, cluster_rep, cmp FROM profiles p JOIN clusters c ON p.rep_id = c.rep_id)",
        f"assigned AS (SELECT x.*, coalesce(p.cluster_rep, x.unique_id) AS cluster_id, p.cmp AS match_probability "
        f"FROM prepared x LEFT JOIN linkedp p ON {on})",
        "results AS (SELECT a.*, count(*) OVER (PARTITION BY cluster_id) AS cluster_size FROM assigned a)",
    ]


def _sql(*ctes: str, select: str) -> str:
    return O.with_ctes(*ctes, select=select)


# ---------------------------------------------------------------------------
# sources and sinks (round trips under the shared work folder)
# ---------------------------------------------------------------------------

RAW_STR = ("CAST(rid AS VARCHAR) AS rid, npi, firstname, middlename, lastname, address1, city, state, zipcode, "
           "phone, gnpi, group_name, primary_spec_desc, address_status, phone_status")


def _csv_value(c: str) -> str:
    return f"CASE WHEN {c} IN ('null','NULL','None','NONE','') THEN NULL ELSE {c} END"


def _csv_tok(c: str) -> str:
    return f"{_csv_value(c)} AS {c}"


RAW_CSV = ", ".join(["CAST(rid AS VARCHAR) AS rid"] + [_csv_tok(c) for c in (
    "npi", "firstname", "middlename", "lastname", "address1", "city", "state", "zipcode", "phone", "gnpi",
    "group_name", "primary_spec_desc", "address_status", "phone_status")])


def q_s1_load(spark, d):
    return load(spark, f"{d}/customer.parquet", columns=["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])


def q_s2_csv(spark, d):
    path = work_path(spark, "s2") + ".csv"
    raw(spark, d).write.option("header", True).csv(path)
    return load(spark, path)


def q_s3_json(spark, d):
    path = work_path(spark, "s3") + ".json"
    raw(spark, d).write.json(path)
    df = load(spark, path, lines=True)
    return df.select(*sorted(df.columns))


def q_s4_parquet(spark, d):
    path = work_path(spark, "s4") + ".parquet"
    raw(spark, d).write.parquet(path)
    return load(spark, path)


def q_s5_multi(spark, d):
    base = work_path(spark, "s5")
    r = raw(spark, d)
    # two files with different columns: solo providers as CSV, group members as Parquet without group_name
    r.where("gnpi IS NULL").write.option("header", True).csv(base + "/a.csv")
    r.where("gnpi IS NOT NULL").drop("group_name").write.parquet(base + "/b.parquet")
    return load_multiple(spark, [base + "/a.csv", base + "/b.parquet"])


def q_u1_reconciled(spark, d):
    """Two Parquet files of different types and columns, JSON arrays and a CSV in one load."""
    base, r = work_path(spark, "u1"), raw(spark, d)
    part = {i: r.where(F.col("rid") % 4 == i) for i in range(4)}
    part[0].select("rid", "npi", "city").write.parquet(base + "/a.parquet")
    part[1].select(F.col("rid").cast("string").alias("rid"), "npi", "state").write.parquet(base + "/b.parquet")
    _write_arrays(part[2].select("rid", "npi", "phone"), base + "/c.json")
    part[3].select("rid", "npi", "city").write.option("header", True).csv(base + "/d.csv")
    return load_multiple(spark, [f"{base}/{n}" for n in ("a.parquet", "b.parquet", "c.json", "d.csv")])


def _write_arrays(df, path, records=500):
    """JSON array files of about so many records each."""
    bucket = F.floor(F.col("rid") / (10 * records))
    rows = df.groupBy(bucket.alias("b")).agg(F.collect_list(F.to_json(F.struct(*df.columns))).alias("r"))
    text = rows.select(F.concat(F.lit("["), F.array_join("r", ",\n"), F.lit("]")).alias("value"))
    text.write.option("maxRecordsPerFile", 1).text(path)


def q_s3_json_array(spark, d):
    path = work_path(spark, "s3a") + ".json"
    _write_arrays(raw(spark, d), path)
    df = load(spark, path)
    return df.select(*sorted(df.columns))


def q_k2_csv_sink(spark, d):
    path = work_path(spark, "k2") + ".csv"
    save(prepared(spark, d), path)
    return spark.read.option("header", True).csv(path)


def q_k3_parquet_sink(spark, d):
    path = work_path(spark, "k3") + ".parquet"
    save(prepared(spark, d), path)
    return spark.read.parquet(path)


def _cluster_rows(df):
    return df.select(F.lit("results").alias("part"), F.col("unique_id").cast("string").alias("item"),
                     F.concat_ws(":", "cluster_id", "cluster_size").alias("value"))


def q_k4_json_sink(spark, d):
    """Records, their count and the statistics, all read back from the JSON output."""
    path = work_path(spark, "k4") + ".json"
    res = exact_results(spark, d).select("unique_id", "cluster_id", "cluster_size")
    save(res, path, statistics=S.cluster_statistics(res))
    back, meta = spark.read.json(path + "/records"), spark.read.json(path + "/metadata")
    stats = {f"statistics.{c}": F.round(F.col(f"statistics.{c}").cast("double"), 6) for c in STATISTICS}
    values = {"record_count": F.col("record_count").cast("double")} | stats
    long = meta.select(F.explode(F.array(*[F.struct(F.lit(k).alias("item"), v.alias("n")) for k, v in values.items()])).alias("r"))
    return _cluster_rows(back).withColumn("n", F.lit(None).cast("double")).unionByName(
        long.select(F.lit("metadata").alias("part"), "r.item", F.lit(None).cast("string").alias("value"), "r.n"))


def q_k5_report(spark, d):
    """The three tables of the report, all read back."""
    path = work_path(spark, "k5")
    res = exact_results(spark, d).select("unique_id", "cluster_id", "cluster_size")
    out = save_report(res, S.statistics_long(res), S.summary_table(res), path)
    results, statistics, summary = (spark.read.parquet(out[k]) for k in ("results", "statistics", "summary"))
    numbers = statistics.select(F.lit("statistics").alias("part"), F.concat_ws("/", "category", "metric").alias("item"),
                                F.lit(None).cast("string").alias("value"), F.round(F.col("value").cast("double"), 6).alias("n"))
    said = summary.select(F.lit("summary").alias("part"), F.col("metric").alias("item"), "value")
    return _cluster_rows(results).unionByName(said).withColumn("n", F.lit(None).cast("double")).unionByName(numbers)


STATISTICS = ["total_records", "unique_clusters", "duplicates_found", "duplication_rate", "largest_cluster_size",
              "average_cluster_size"]
CLUSTER_ROWS_SQL = ("SELECT 'results' AS part, CAST(unique_id AS VARCHAR) AS item, cluster_id || ':' || cluster_size AS value, "
                    "CAST(NULL AS DOUBLE) AS n FROM results")


def q_s2_csv_text(spark, d):
    """Texts with quotes, commas, line feeds and blanks through CSV and back."""
    path = work_path(spark, "s2text") + ".csv"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source")
    save(docs, path)
    return load(spark, path)


def q_k1_save(spark, d):
    """The sink picked by suffix: the same records through all three formats, and back."""
    base, df = work_path(spark, "k1"), raw(spark, d)
    out = None
    for suffix in ("csv", "parquet", "json"):
        path = f"{base}/records.{suffix}"
        save(df, path)
        back = spark.read.schema(df.schema).json(path + "/records") if suffix == "json" else load(spark, path)
        rows = back.select(F.lit(suffix).alias("format"), *[F.col(c).cast("string").alias(c) for c in (
            "rid", "npi", "lastname", "address1")])
        out = rows if out is None else out.unionByName(rows)
    return out


K1_SQL = (f"WITH {O.RAW} SELECT f AS format, CAST(rid AS VARCHAR) AS rid, npi, lastname, address1 FROM raw, "
          "(SELECT unnest(['csv', 'parquet', 'json']) AS f)")


SOURCES = {
    "k1_save": (q_k1_save, K1_SQL),
    "s2_csv_text": (q_s2_csv_text, "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source FROM documents"),
    "s1_load": (q_s1_load, "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, "
                           "CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer"),
    "s2_csv": (q_s2_csv, f"WITH {O.RAW} SELECT {RAW_CSV} FROM raw"),
    "s3_json": (q_s3_json, f"WITH {O.RAW} SELECT address1, address_status, city, firstname, gnpi, group_name, "
                           "lastname, middlename, npi, phone, phone_status, primary_spec_desc, "
                           "CAST(rid AS VARCHAR) AS rid, state, zipcode FROM raw"),
    "s4_parquet": (q_s4_parquet, f"WITH {O.RAW} SELECT {RAW_STR} FROM raw"),
    "s5_multi": (q_s5_multi, f"WITH {O.RAW} SELECT {RAW_CSV} FROM raw WHERE gnpi IS NULL UNION ALL "
                             f"SELECT {RAW_STR.replace('group_name,', 'NULL AS group_name,')} FROM raw "
                             f"WHERE gnpi IS NOT NULL"),
    "u1_reconciled": (q_u1_reconciled, f"WITH {O.RAW}, t AS (SELECT *, rid % 4 AS q FROM raw) SELECT CAST(rid AS VARCHAR) AS rid, "
                      f"CASE WHEN q = 3 THEN {_csv_value('npi')} ELSE npi END AS npi, CASE q WHEN 0 THEN city WHEN 3 THEN "
                      f"{_csv_value('city')} END AS city, CASE q WHEN 1 THEN state END AS state, CASE q WHEN 2 THEN phone END AS phone FROM t"),
    "k2_csv_sink": (q_k2_csv_sink, "K2_PLACEHOLDER"),
    "k3_parquet_sink": (q_k3_parquet_sink, O.with_ctes(select="SELECT * FROM prepared")),
    "k4_json_sink": (q_k4_json_sink, "K4_PLACEHOLDER"),
    "k5_report": (q_k5_report, "K5_PLACEHOLDER"),
}

# ---------------------------------------------------------------------------
# projections, validation, normalization
# ---------------------------------------------------------------------------


def _model(spark, d):
    return to_model(with_unique_id(raw(spark, d), "rid"))


def _flag(fn, source=None):
    def q(spark, d):
        m = to_model(with_unique_id((source or raw)(spark, d), "rid"))
        return m.select("unique_id", fn(m).alias("ok"))
    return q


def _odd_flag(fn):
    """A rule over the records with faults, where it has both outcomes."""
    return _flag(fn, odd_records)


def q_p3_required(spark, d):
    """Messages of missing required fields in the records with faults."""
    v = validate_rows(with_unique_id(odd_records(spark, d), "rid"))
    return v.select("unique_id", F.array_join("errors", "; ").alias("errors"))


MODEL_SEL = ("rid AS unique_id, npi, group_npi, group_name, specialty, first_name, middle_name, last_name, "
             "CAST(NULL AS VARCHAR) AS address_type, address_line_1, CAST(NULL AS VARCHAR) AS address_line_2, "
             "city, state, postal_code, phone, address_status, phone_status")


def _len_ok_spark(m):
    ok = F.lit(True)
    for f, lo, hi in O._LEN:
        c = F.col(f)
        cond = F.coalesce(F.length(c) <= hi, F.lit(True))
        if lo is not None:
            cond = cond & c.isNotNull() & (F.length(c) >= lo)
        ok = ok & cond
    return ok


def _len_ok_sql():
    parts = []
    for f, lo, hi in O._LEN:
        p = f"coalesce(length({f}) <= {hi}, true)"
        if lo is not None:
            p += f" AND {f} IS NOT NULL AND length({f}) >= {lo}"
        parts.append(f"({p})")
    return " AND ".join(parts)


def _sel_model(expr_sql: str, source: str = O.RAW) -> str:
    return f"WITH {source}, {O.MODEL} SELECT rid AS unique_id, {expr_sql} AS ok FROM model"


def _odd_model(expr_sql: str) -> str:
    return _sel_model(expr_sql, O.ODD)


def q_p11_quarantine(spark, d):
    v = validate_rows(with_unique_id(raw(spark, d), "rid"))
    return v.where(F.size("errors") > 0).select("unique_id", F.array_join("errors", "; ").alias("errors"))


def q_p12_batch_check(spark, d):
    return batch_check(odd_records(spark, d))


P14_COLUMNS = ["npi", "firstname", "lastname", "city"]


def q_p14_surrogate_key(spark, d):
    """Keys from content and ordinal; the four columns have copies."""
    df = raw(spark, d).select(*P14_COLUMNS)
    return with_unique_id(df).select("unique_id", *P14_COLUMNS)


P14_SQL = (f"WITH {O.RAW}, keyed AS (SELECT {', '.join(P14_COLUMNS)}, sha256(concat_ws(chr(31), "
           + ", ".join(f"coalesce({c}, chr(30))" for c in P14_COLUMNS) + ")) AS k FROM raw), numbered AS (SELECT *, "
           "row_number() OVER (PARTITION BY k) - 1 AS o FROM keyed) SELECT CAST('0x' || substr(sha256(k || ':' || o), 1, 15) "
           f"AS BIGINT) AS unique_id, {', '.join(P14_COLUMNS)} FROM numbered")


def _norm_q(cols: dict[str, str]):
    def q(spark, d):
        r = raw(spark, d)
        return r.select(F.col("rid").alias("unique_id"),
                        *[N.normalize_field(F.col(c), kind).alias(f"{c}_norm") for c, kind in cols.items()])
    return q


_SQL_NORM = {"name": O.name, "address": O.address, "phone": O.phone, "postal_code": O.postal, "state": O.state}


def _norm_sql(cols: dict[str, str]) -> str:
    sel = ", ".join(f"{_SQL_NORM[k](c)} AS {c}_norm" for c, k in cols.items())
    return f"WITH {O.RAW} SELECT rid AS unique_id, {sel} FROM raw"


NORM_NAME = {"firstname": "name", "lastname": "name", "middlename": "name", "group_name": "name"}
NORM_ADDR = {"address1": "address", "city": "address"}
NORM_ALL = {"firstname": "name", "address1": "address", "phone": "phone", "zipcode": "postal_code", "state": "state"}


def q_n6_normalize(spark, d):
    r = raw(spark, d)
    return N.normalize(r, NORM_ALL, suffix="_norm").select("rid", *[f"{c}_norm" for c in NORM_ALL]).withColumnRenamed(
        "rid", "unique_id")


def _spelled(number: str) -> str:
    """SQL for a number of three digits in words ("four hundred and twenty-one")."""
    units, tens = ",".join(UNITS), ",".join(TENS)

    def pick(values, index):
        return f"split_part('{values}', ',', CAST({index} + 1 AS INT))"

    rest = f"({number} % 100)"
    small = (f"CASE WHEN {rest} < 20 THEN {pick(units, rest)} ELSE concat({pick(tens, f'floor({rest} / 10) - 2')}, CASE WHEN "
             f"{rest} % 10 = 0 THEN '' ELSE concat('-', {pick(units, f'({rest} % 10)')}) END) END")
    return (f"concat({pick(units, f'floor({number} / 100)')}, ' hundred', CASE WHEN {rest} = 0 THEN '' "
            f"ELSE concat(' and ', {small}) END)")


def q_n7_number_words(spark, d):
    """Addresses whose house number is spelled out; the SQL normalizes them with the number in digits."""
    r = raw(spark, d).withColumn("said", F.concat(F.expr(_spelled("CAST(substring(address1, 1, 3) AS INT)")), F.substring("address1", 4, 99)))
    return r.select(F.col("rid").alias("unique_id"), N.normalize_address(F.col("said"), number_words=True).alias("address1_norm"))


def q_n8_phone_length(spark, d):
    p = prepared(spark, d)
    return p.select("unique_id", (F.length("phone") >= 10).alias("long_phone"))


VALIDATION = {
    "p1_rename": (lambda s, d: _model(s, d), f"WITH {O.RAW}, {O.MODEL} SELECT {MODEL_SEL} FROM model"),
    "p2_null_tokens": (lambda s, d: _model(s, d).select("unique_id", "phone", "group_npi"),
                       f"WITH {O.RAW}, {O.MODEL} SELECT rid AS unique_id, phone, group_npi FROM model"),
    "p3_required": (q_p3_required, f"WITH {O.ODD}, {O.MODEL}, {O.CHECKED} SELECT rid AS unique_id, errors FROM checked"),
    "p4_npi_format": (_odd_flag(lambda m: F.coalesce(V.npi_format_ok(F.col("npi")), F.lit(False))),
                      _odd_model(f"coalesce({O.ten('npi')}, false)")),
    "p5_npi_checksum": (_flag(lambda m: F.coalesce(V.npi_checksum_ok(F.col("npi")), F.lit(False))
                              & F.coalesce(V.npi_checksum_ok(F.col("group_npi")), F.col("group_npi").isNull())),
                        _sel_model(f"coalesce({O.ten('npi')} AND {O.luhn_ok('npi')}, false) AND "
                                   f"coalesce({O.ten('group_npi')} AND {O.luhn_ok('group_npi')}, group_npi IS NULL)")),
    "p6_lengths": (_odd_flag(_len_ok_spark), _odd_model(_len_ok_sql())),
    "p7_state": (_flag(lambda m: F.coalesce(F.upper("state").rlike(V.STATE_PATTERN), F.lit(False))),
                 _sel_model("coalesce(regexp_full_match(upper(state), '[A-Z]{2}'), false)")),
    "p8_postal": (_flag(lambda m: F.coalesce(F.col("postal_code").rlike(V.POSTAL_PATTERN), F.lit(False))),
                  _sel_model("coalesce(regexp_full_match(postal_code, '[0-9]{5}(-[0-9]{4})?'), false)")),
    "p9_phone": (_odd_flag(lambda m: F.col("phone").isNull() | F.col("phone").rlike(V.PHONE_PATTERN)),
                 _odd_model("(phone IS NULL OR regexp_full_match(phone, '[0-9]{10,}'))")),
    "p10_enums": (_odd_flag(lambda m: F.coalesce(F.lower("address_status").isin(*V.ENUMS["address_status"][0])
                                             & F.lower("phone_status").isin(*V.ENUMS["phone_status"][0]), F.lit(False))),
                  _odd_model("coalesce(lower(address_status) IN ('verified','inconclusive','invalid','no') AND "
                             "lower(phone_status) IN ('verified','inconclusive','invalid','no'), false)")),
    "p11_quarantine": (q_p11_quarantine, f"WITH {O.RAW}, {O.MODEL}, {O.CHECKED} "
                                         f"SELECT rid AS unique_id, errors FROM checked WHERE errors <> ''"),
    "p12_batch_check": (q_p12_batch_check, f"WITH {O.ODD} SELECT message FROM (SELECT CASE WHEN count(*) = 0 THEN "
                                           "'Input data is empty' END AS message FROM raw UNION ALL SELECT CASE WHEN "
                                           "count_if(npi IS NULL OR NOT regexp_full_match(npi, '[0-9]{10}')) > 0 THEN "
                                           "'Found ' || count_if(npi IS NULL OR NOT regexp_full_match(npi, '[0-9]{10}')) "
                                           "|| ' invalid NPI values' END FROM raw) WHERE message IS NOT NULL"),
    "p14_surrogate_key": (q_p14_surrogate_key, P14_SQL),
    "p15_prepared": (lambda s, d: prepare(raw(s, d), "rid")[0], O.with_ctes(select="SELECT * FROM prepared")),
    "n1_name": (_norm_q(NORM_NAME), _norm_sql(NORM_NAME)),
    "n2_address": (_norm_q(NORM_ADDR), _norm_sql(NORM_ADDR)),
    "n3_phone": (_norm_q({"phone": "phone"}), _norm_sql({"phone": "phone"})),
    "n4_postal": (_norm_q({"zipcode": "postal_code"}), _norm_sql({"zipcode": "postal_code"})),
    "n5_state": (_norm_q({"state": "state"}), _norm_sql({"state": "state"})),
    "n6_normalize": (q_n6_normalize, _norm_sql(NORM_ALL)),
    "n7_number_words": (q_n7_number_words, _norm_sql({"address1": "address"})),
    "n8_phone_length": (q_n8_phone_length, O.with_ctes(select="SELECT unique_id, length(phone) >= 10 AS long_phone "
                                                              "FROM prepared")),
}

# ---------------------------------------------------------------------------
# blocking and comparison
# ---------------------------------------------------------------------------

PAIR_KEYS = ["rep_id_l", "rep_id_r", "pair_count", "match_key"]


def q_j1_block_npi(spark, d):
    return rule_pairs(fuzzy_profiles(spark, d), "l.npi = r.npi", [])


def q_j1_block_sizes(spark, d):
    return block_sizes(fuzzy_profiles(spark, d), "l.family_name = r.family_name AND l.given_name = r.given_name")


def q_j2_residual(spark, d):
    prof = profile_table(prepared(spark, d), PRESET_COLS)
    return rule_pairs(prof, PRESET.blocking_rules[0], [])


def q_j3_multi_rule(spark, d):
    return fuzzy_pairs(spark, d, [])


def q_j3_reachable(spark, d):
    """Pairs above the threshold, formed without those that cannot reach it."""
    rec = prepared(spark, d)
    model = exact_model(rec)
    pairs = reachable_pairs(fuzzy_profiles(spark, d), FUZZY, model, SCORE_THRESHOLD, [c.column for c in EXACT_COMPS])
    found = above_threshold(score(compare(pairs, EXACT_COMPS), model), SCORE_THRESHOLD)
    return found.select(*PAIR_KEYS, _r6("match_probability"))


def q_j5_training_pairs(spark, d):
    prof = fuzzy_profiles(spark, d)
    parts = [rule_pairs(prof, r, [], match_key=k) for k, r in enumerate(TRAINING_RULES)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def q_j6_random_pairs(spark, d):
    return random_pairs(prepared(spark, d), [], SAMPLE_PAIRS)


def q_j7_tf_join(spark, d):
    profiles = with_term_frequencies(fuzzy_profiles(spark, d), ["family_name"])
    return candidate_pairs(profiles, FUZZY, ["tf_family_name"]).select(
        *PAIR_KEYS, _r6("tf_family_name_l"), _r6("tf_family_name_r"))


def _gamma_q(comps, source=prepared):
    def q(spark, d):
        g = compare_candidates(profile_table(source(spark, d), FUZZY_COLS), FUZZY, comps)
        return g.select(*PAIR_KEYS, *[F.col(c.gamma).alias(f"g{i}_{c.column}") for i, c in enumerate(comps)])
    return q


def _gamma_sql(comps) -> str:
    cols = list(dict.fromkeys(c.column for c in comps))
    gam = ", ".join(f"{O.gamma_sql(c, c.column + '_l', c.column + '_r')} AS g{i}_{c.column}" for i, c in enumerate(comps))
    return _sql(FUZZY_PROFILES, _pairs_sql(cols), select=f"SELECT {', '.join(PAIR_KEYS)}, {gam} FROM pairs")


def _pairs_only_sql(rules_sql: str) -> str:
    return _sql(FUZZY_PROFILES, rules_sql, select="SELECT rep_id_l, rep_id_r, pair_count, match_key FROM pairs")


def q_a16_patterns(spark, d):
    comps = GAMMA_COMPS
    found = candidate_patterns(materialize(fuzzy_profiles(spark, d), "profiles"), FUZZY, comps)
    return found.select(*[F.col(c.gamma).alias(f"g{i}_{c.column}") for i, c in enumerate(comps)], "pair_count")


def q_a17_u_exact(spark, d):
    p = prepared(spark, d)
    parts = [u_exact(p, c) for c in EXACT_COMPS]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.select("column", _r6("u_exact"), _r6("u_else"))


def q_a17_u_sampled(spark, d):
    p = prepared(spark, d)
    comps = GAMMA_COMPS[1:]
    cols = list(dict.fromkeys(c.column for c in comps))
    g = compare(random_pairs(p, cols, SAMPLE_PAIRS), comps)
    rows = []
    for i, c in enumerate(comps):
        rows.append(g.groupBy(F.col(c.gamma).alias("gamma")).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(f"g{i}_{c.column}").alias("comparison"), "gamma", "n"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def _u_sampled_sql() -> str:
    comps = GAMMA_COMPS[1:]
    cols = list(dict.fromkeys(c.column for c in comps))
    parts = []
    for i, c in enumerate(comps):
        g = O.gamma_sql(c, c.column + "_l", c.column + "_r")
        parts.append(f"SELECT 'g{i}_{c.column}' AS comparison, gamma, count(*) AS n FROM "
                     f"(SELECT {g} AS gamma FROM spairs) GROUP BY gamma")
    return _sql(*OM.sample_ctes(cols, SAMPLE_PAIRS), select=" UNION ALL ".join(parts))


def _u_exact_table_sql() -> str:
    parts = []
    for c in EXACT_COMPS:
        u = _u_exact_sql(c.column)
        parts.append(f"SELECT '{c.column}' AS column, round({u}, 6) AS u_exact, round(1 - {u}, 6) AS u_else")
    return _sql(select=" UNION ALL ".join(parts))


def _patterns_sql() -> str:
    comps = GAMMA_COMPS
    cols = list(dict.fromkeys(c.column for c in comps))
    keys = [f"g{i}_{c.column}" for i, c in enumerate(comps)]
    gam = ", ".join(f"{O.gamma_sql(c, c.column + '_l', c.column + '_r')} AS {k}" for k, c in zip(keys, comps))
    return _sql(FUZZY_PROFILES, _pairs_sql(cols), f"g AS (SELECT pair_count, {gam} FROM pairs)",
                select=f"SELECT {', '.join(keys)}, CAST(sum(pair_count) AS BIGINT) AS pair_count FROM g GROUP BY {', '.join(keys)}")


def _tf_sql() -> str:
    tf = ("tf AS (SELECT family_name AS v, count(*) * 1.0 / (SELECT count(*) FROM prepared "
          "WHERE family_name IS NOT NULL) AS tf FROM prepared WHERE family_name IS NOT NULL GROUP BY family_name)")
    return _sql(FUZZY_PROFILES, _pairs_sql(["family_name"]), tf,
                select="SELECT rep_id_l, rep_id_r, pair_count, match_key, round(a.tf, 6) AS tf_family_name_l, "
                       "round(b.tf, 6) AS tf_family_name_r FROM pairs LEFT JOIN tf a ON family_name_l = a.v "
                       "LEFT JOIN tf b ON family_name_r = b.v")


def _training_pairs_sql() -> str:
    parts = [O.rule_pairs_select(r, [], [], k) for k, r in enumerate(TRAINING_RULES)]
    return _pairs_only_sql("pairs AS (" + " UNION ALL ".join(parts) + ")")


def q_a19_tf(spark, d):
    return term_frequencies(prepared(spark, d), "given_name").select("value", _r6("tf"))


BLOCKING = {
    "j1_block_npi": (q_j1_block_npi, _pairs_only_sql("pairs AS (" + O.rule_pairs_select("l.npi = r.npi", []) + ")")),
    "j1_block_sizes": (q_j1_block_sizes, _sql(FUZZY_PROFILES, select=(
        "SELECT family_name, given_name, count(*) AS profiles, CAST(sum(n) AS BIGINT) AS records, "
        "CAST(sum(n) * (sum(n) - 1) / 2 AS BIGINT) AS record_pairs FROM profiles GROUP BY family_name, given_name"))),
    "j2_residual": (q_j2_residual, _sql(O.profiles_cte(PRESET_COLS), "pairs AS (" + O.rule_pairs_select(
        PRESET.blocking_rules[0].sql, []) + ")", select="SELECT rep_id_l, rep_id_r, pair_count, match_key FROM pairs")),
    "j3_multi_rule": (q_j3_multi_rule, _pairs_only_sql(_pairs_sql([]))),
    "j5_training_pairs": (q_j5_training_pairs, _training_pairs_sql()),
    "j6_random_pairs": (q_j6_random_pairs, _sql(*OM.sample_ctes([], SAMPLE_PAIRS), select="SELECT unique_id_l, unique_id_r FROM spairs")),
    "j7_tf_join": (q_j7_tf_join, _tf_sql()),
    "j9_exact": (_gamma_q([GAMMA_COMPS[0]]), _gamma_sql([GAMMA_COMPS[0]])),
    "j10_levenshtein": (_gamma_q([GAMMA_COMPS[1]]), _gamma_sql([GAMMA_COMPS[1]])),
    "j11_jaro_winkler": (_gamma_q([JW_COMP]), _gamma_sql([JW_COMP])),
    "j12_name": (_gamma_q([GAMMA_COMPS[2]]), _gamma_sql([GAMMA_COMPS[2]])),
    "j13_postcode": (_gamma_q([GAMMA_COMPS[3]]), _gamma_sql([GAMMA_COMPS[3]])),
    "j14_compare": (_gamma_q(GAMMA_COMPS), _gamma_sql(GAMMA_COMPS)),
    "j14_levels": (_gamma_q(GAMMA_COMPS, varied), _varied_sql(_gamma_sql(GAMMA_COMPS))),
    "j11_levels": (_gamma_q([JW_COMP], varied), _varied_sql(_gamma_sql([JW_COMP]))),
    "a16_patterns": (q_a16_patterns, _patterns_sql()),
    "a17_u_exact": (q_a17_u_exact, _u_exact_table_sql()),
    "a17_u_sampled": (q_a17_u_sampled, _u_sampled_sql()),
    "a19_tf": (q_a19_tf, _sql(select="SELECT given_name AS value, round(count(*) * 1.0 / (SELECT count(*) FROM "
                                     "prepared WHERE given_name IS NOT NULL), 6) AS tf FROM prepared "
                                     "WHERE given_name IS NOT NULL GROUP BY given_name")),
}

# ---------------------------------------------------------------------------
# scoring, clustering, statistics
# ---------------------------------------------------------------------------


def q_c1_predict(spark, d):
    s = scored_exact(spark, d)
    return s.select(*PAIR_KEYS, _r6("match_weight"), _r6("match_probability"))


def q_c3_tf_adjust(spark, d):
    """Exact-model scores with a term-frequency adjustment on family name."""
    rec = prepared(spark, d)
    comps = [Comparison(c.column, "exact", term_frequency=(c.column == "family_name")) for c in EXACT_COMPS]
    model = exact_model(rec)
    model = Model(comps, model.m, model.u, model.prior)
    found = score_pairs(rec, profile_table(rec, FUZZY_COLS), replace(FUZZY, comparisons=tuple(comps)), model)
    return found.select(*PAIR_KEYS, _r6("match_weight"))


def q_p17_threshold(spark, d):
    s = linked_exact(spark, d)[2]
    return s.where(F.col("match_probability") >= SCORE_THRESHOLD).select("rep_id_l", "rep_id_r")


def q_c2_clusters(spark, d):
    c = profile_clusters(linked_exact(spark, d)[2], SCORE_THRESHOLD)
    return c.select("rep_id", "cluster_rep", _r6("cluster_match_probability"))


def q_c2_components(spark, d):
    s = linked_exact(spark, d)[2].where(F.col("match_probability") >= SCORE_THRESHOLD)
    e = s.where(F.col("rep_id_l") != F.col("rep_id_r")).select(F.col("rep_id_l").alias("src"),
                                                              F.col("rep_id_r").alias("dst"))
    return connected_components(e)


def _res(spark, d):
    return exact_results(spark, d)


def q_j8_attach(spark, d):
    return _res(spark, d).select("unique_id", "cluster_id")


def q_c4_deduplicate(spark, d):
    return _res(spark, d).select("unique_id", "cluster_id", "cluster_size", _r6("match_probability"))


def q_w2_primary(spark, d):
    return with_primary(_res(spark, d)).where("is_primary").select("cluster_id", "unique_id")


def q_c6_preset(spark, d):
    r = run_deduplication(raw(spark, d), PRESET, id_column="rid", persist=True)
    return r.results.select("unique_id", "cluster_id", "cluster_size")


def q_c5_pipeline(spark, d):
    """The whole pipeline from a file path: the raw records are written as CSV and loaded from there."""
    path = work_path(spark, "c5") + ".csv"
    save(raw(spark, d), path)
    r = run_file(path, spark, FUZZY, id_column="rid", persist=True)
    return r.results.select("unique_id", "cluster_id", "cluster_size")


def _trained(source):
    def model(spark, d):
        rec = source(spark, d)
        return train(rec, profile_table(rec, FUZZY_COLS), FUZZY)

    def parameters(spark, d):
        return model(spark, d).parameters(spark).select("column", "kind", "gamma", _r6("m"), _r6("u"))

    def sessions(spark, d):
        return spark.createDataFrame([(s["rule"], s["iterations"], round(s["lambda"], 6), s["converged"])
                                      for s in model(spark, d).sessions],
                                     "rule string, iterations int, lambda double, converged boolean")

    return parameters, sessions


q_c9_train, q_a18_em = _trained(prepared)
q_c9_varied, q_a18_varied = _trained(varied)


RESULTS_SQL = _results_sql()
RESULT_SELECT = "SELECT unique_id, cluster_id, cluster_size FROM results"


def _res_select(select: str) -> str:
    return _with_recursive(RESULTS_SQL, select)


def _stats_select() -> str:
    return ("sizes AS (SELECT cluster_id, count(*) AS cluster_size FROM results GROUP BY cluster_id), "
            "st AS (SELECT CAST(sum(cluster_size) AS BIGINT) AS total_records, count(*) AS unique_clusters, "
            "max(cluster_size) AS largest_cluster_size, avg(cluster_size) AS average_cluster_size FROM sizes)")


def _tf_score_sql() -> str:
    tf = ("tf AS (SELECT family_name AS v, count(*) * 1.0 / (SELECT count(*) FROM prepared WHERE family_name IS NOT "
          "NULL) AS tf FROM prepared WHERE family_name IS NOT NULL GROUP BY family_name)")
    family = "match_key, family_name_l, family_name_r"
    ctes = [c.replace("match_key, CAST", f"{family}, CAST", 1) if c.startswith("gammas") else c for c in _scored_sql()]
    u = f"greatest({_u_exact_sql('family_name')}, 1e-6)"
    return O.with_ctes(*ctes, tf, select=(
        "SELECT rep_id_l, rep_id_r, pair_count, match_key, round(match_weight + CASE WHEN gamma_family_name = 1 AND "
        f"greatest(a.tf, b.tf) IS NOT NULL THEN log2({u} / greatest(a.tf, b.tf)) ELSE 0 END, 6) AS match_weight "
        "FROM scored LEFT JOIN tf a ON family_name_l = a.v LEFT JOIN tf b ON family_name_r = b.v"))


def _long_values(df):
    """(category, metric, value) with the value as a number, so that both engines write it alike."""
    return df.select("category", "metric", F.round(F.col("value").cast("double"), 6).alias("value"))


_SIZES = "(SELECT cluster_id, count(*) AS cluster_size FROM results GROUP BY cluster_id)"
STATISTICS_SQL = (
    "SELECT category, metric, round(CAST(value AS DOUBLE), 6) AS value FROM ("
    "SELECT 'clusters_by_size' AS category, CAST(cluster_size AS VARCHAR) AS metric, count(*) AS value "
    f"FROM {_SIZES} GROUP BY cluster_size "
    f"UNION ALL SELECT 'General', 'total_records', sum(cluster_size) FROM {_SIZES} "
    f"UNION ALL SELECT 'General', 'unique_clusters', count(*) FROM {_SIZES} "
    f"UNION ALL SELECT 'General', 'duplicates_found', sum(cluster_size) - count(*) FROM {_SIZES} "
    f"UNION ALL SELECT 'General', 'duplication_rate', (sum(cluster_size) - count(*)) * 1.0 / sum(cluster_size) FROM {_SIZES} "
    f"UNION ALL SELECT 'General', 'largest_cluster_size', max(cluster_size) FROM {_SIZES} "
    f"UNION ALL SELECT 'General', 'average_cluster_size', avg(cluster_size) FROM {_SIZES})")


SUMMARY_SQL = (
    "SELECT * FROM (SELECT 1 AS ord, 'Total Records' AS metric, CAST(count(*) AS VARCHAR) "
                                "AS value FROM results UNION ALL SELECT 2, 'Unique Clusters', CAST(count(DISTINCT "
                                "cluster_id) AS VARCHAR) FROM results UNION ALL SELECT 3, 'Duplicates Found', "
                                "CAST(count(*) - count(DISTINCT cluster_id) AS VARCHAR) FROM results UNION ALL SELECT "
                                "4, 'Duplication Rate', printf('%.2f%%', (count(*) - count(DISTINCT cluster_id)) * "
                                "100.0 / count(*)) FROM results UNION ALL SELECT 5, 'Largest Cluster', "
                                "CAST(max(cluster_size) AS VARCHAR) FROM results)")

SCORING = {
    "j3_reachable": (q_j3_reachable, O.with_ctes(*_scored_sql(), select=(
        "SELECT rep_id_l, rep_id_r, pair_count, match_key, round(match_probability, 6) AS match_probability FROM scored "
        f"WHERE match_probability >= {SCORE_THRESHOLD}"))),
    "c1_predict": (q_c1_predict, O.with_ctes(*_scored_sql(), select=(
        "SELECT rep_id_l, rep_id_r, pair_count, match_key, round(match_weight, 6) AS match_weight, "
        "round(match_probability, 6) AS match_probability FROM scored"))),
    "c3_tf_adjust": (q_c3_tf_adjust, _tf_score_sql()),
    "p17_threshold": (q_p17_threshold, O.with_ctes(*_scored_sql(), select=(
        f"SELECT rep_id_l, rep_id_r FROM scored WHERE match_probability >= {SCORE_THRESHOLD}"))),
    "c2_clusters": (q_c2_clusters, _with_recursive(_clusters_sql(), "SELECT rep_id, cluster_rep, "
                                                                     "round(cmp, 6) AS cluster_match_probability FROM clusters")),
    "c2_components": (q_c2_components, _with_recursive(_clusters_sql(), "SELECT node, min(c) AS component FROM walk "
                                                                        "GROUP BY node")),
    "j8_attach": (q_j8_attach, _res_select("SELECT unique_id, cluster_id FROM results")),
    "c4_deduplicate": (q_c4_deduplicate, _res_select("SELECT unique_id, cluster_id, cluster_size, "
                                                     "round(match_probability, 6) AS match_probability FROM results")),
    "w1_cluster_size": (lambda s, d: _res(s, d).select("unique_id", "cluster_size"),
                        _res_select("SELECT unique_id, cluster_size FROM results")),
    "w2_primary": (q_w2_primary, _res_select(
        "SELECT cluster_id, unique_id FROM (SELECT cluster_id, unique_id, row_number() OVER (PARTITION BY cluster_id "
        "ORDER BY (" + " + ".join(f"(CASE WHEN coalesce({c}, '') <> '' THEN 1 ELSE 0 END)" for c in PRIMARY_FIELDS)
        + ") DESC, ((CASE WHEN address_status = 'verified' THEN 1 ELSE 0 END) + (CASE WHEN phone_status = "
        "'verified' THEN 1 ELSE 0 END)) DESC, unique_id) AS rn FROM results) WHERE rn = 1")),
    "w3_match_probability": (lambda s, d: _res(s, d).select("unique_id", _r6("match_probability")),
                             _res_select("SELECT unique_id, round(match_probability, 6) AS match_probability "
                                         "FROM results")),
    "p16_min_cluster": (lambda s, d: _res(s, d).where(F.col("cluster_size") >= 2).select("unique_id", "cluster_id"),
                        _res_select("SELECT unique_id, cluster_id FROM results WHERE cluster_size >= 2")),
    "p18_multi_record": (lambda s, d: _res(s, d).where("cluster_size > 1").select("unique_id", "cluster_id",
                                                                                  "cluster_size"),
                         _res_select("SELECT unique_id, cluster_id, cluster_size FROM results WHERE cluster_size > 1")),
    "a11_statistics": (lambda s, d: S.cluster_statistics(_res(s, d)).select(
        "total_records", "unique_clusters", "duplicates_found", _r6("duplication_rate"), "largest_cluster_size",
        _r6("average_cluster_size")),
        _res_select("SELECT total_records, unique_clusters, total_records - unique_clusters AS duplicates_found, "
                    "round(CASE WHEN total_records > 0 THEN (total_records - unique_clusters) * 1.0 / total_records "
                    "ELSE 0 END, 6) AS duplication_rate, largest_cluster_size, round(average_cluster_size, 6) AS "
                    "average_cluster_size FROM (SELECT CAST(sum(cluster_size) AS BIGINT) AS total_records, count(*) AS "
                    "unique_clusters, max(cluster_size) AS largest_cluster_size, avg(cluster_size) AS "
                    "average_cluster_size FROM (SELECT cluster_id, count(*) AS cluster_size FROM results GROUP BY "
                    "cluster_id))")),
    "a13_summary": (lambda s, d: S.summary_table(_res(s, d)),
                    _res_select(SUMMARY_SQL)),
    "a14_size_table": (lambda s, d: S.clusters_by_size(_res(s, d)),
                       _res_select("SELECT cluster_size, count(*) AS n_clusters, cluster_size * count(*) AS "
                                   "total_records FROM (SELECT cluster_id, count(*) AS cluster_size FROM results GROUP "
                                   "BY cluster_id) GROUP BY cluster_size")),
    "a12_statistics_long": (lambda s, d: _long_values(S.statistics_long(_res(s, d))), _res_select(STATISTICS_SQL)),
    "a15_histogram": (lambda s, d: S.size_histogram(_res(s, d)).select(
        "bin", _r6("lower"), _r6("upper"), "n_clusters"), _res_select(
        "SELECT bin, round(lo + (bin - 1) * (hi - lo) / 20.0, 6) AS lower, round(lo + bin * (hi - lo) / 20.0, 6) AS upper, n_clusters "
        "FROM (SELECT CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor((cluster_size - lo) / ((hi - lo) / 20.0)) + 1, 20) "
        "END AS INT) AS bin, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS n_clusters FROM (SELECT cluster_id, count(*) AS cluster_size FROM results "
        "GROUP BY cluster_id), (SELECT min(c) AS lo, max(c) AS hi FROM (SELECT count(*) AS c FROM results GROUP BY "
        "cluster_id)) GROUP BY 1)")),
    "t2_sample": (lambda s, d: S.sample_clusters(_res(s, d)).select("cluster_id", "npi", "given_name", "family_name",
                                                                    "cluster_size"),
                  _res_select("SELECT cluster_id, npi, given_name, family_name, cluster_size FROM results WHERE "
                              "cluster_size > 1 ORDER BY cluster_size DESC, cluster_id, unique_id LIMIT 100")),
    "c6_preset": (q_c6_preset, OM.trained_sql(PRESET, RESULT_SELECT, "results")),
    "c5_pipeline": (q_c5_pipeline, OM.trained_sql(FUZZY, RESULT_SELECT, "results")),
    "c9_train": (q_c9_train, OM.trained_sql(FUZZY, OM.parameters_select(FUZZY))),
    "a18_em": (q_a18_em, OM.trained_sql(FUZZY, OM.sessions_select(FUZZY))),
    "c9_varied": (q_c9_varied, _varied_sql(OM.trained_sql(FUZZY, OM.parameters_select(FUZZY)))),
    "a18_varied": (q_a18_varied, _varied_sql(OM.trained_sql(FUZZY, OM.sessions_select(FUZZY)))),
}

# ---------------------------------------------------------------------------
# data quality
# ---------------------------------------------------------------------------


def _quality_sql_metrics(src: str, cols: list[str], critical_present: bool = True) -> str:
    blanks = ", ".join(f"count_if({c} IS NULL OR CAST({c} AS VARCHAR) = '') AS m_{c}" for c in cols)
    return f"qbase AS (SELECT count(*) AS n, {blanks} FROM {src})"


PREPARED_COLS = ["unique_id", "npi", "group_npi", "group_name", "given_name", "middle_name", "family_name",
                 "street_address", "city", "state", "postal_code", "phone", "specialty", "address_status",
                 "phone_status"]
RAW_COLS = ["rid", "npi", "firstname", "middlename", "lastname", "address1", "city", "state", "zipcode", "phone",
            "gnpi", "group_name", "primary_spec_desc", "address_status", "phone_status"]


def _missing_sql(src: str, cols: list[str]) -> str:
    parts = [f"SELECT '{c}' AS column_name, count_if({c} IS NULL OR CAST({c} AS VARCHAR) = '') AS count, count(*) AS n "
             f"FROM {src}" for c in cols]
    return ("missing AS (SELECT column_name, CAST(count AS BIGINT) AS count, round(count * 100.0 / n, 2) AS percentage, "
            "column_name IN ('family_name', 'given_name', 'npi') AS is_critical FROM (" + " UNION ALL ".join(parts)
            + ") WHERE count > 0)")


def _score_sql(src: str, cols: list[str]) -> list[str]:
    dup_keys = [k for k in ("npi", "given_name", "family_name") if k in cols]
    dups = (f"dups AS (SELECT coalesce(sum(c), 0) AS d FROM (SELECT count(*) AS c FROM {src} GROUP BY "
            f"{', '.join(dup_keys)}) WHERE c > 1)") if dup_keys else "dups AS (SELECT 0 AS d)"
    crit = ", ".join(
        f"coalesce((SELECT greatest(0, 100 - percentage * 10) FROM missing WHERE column_name = '{c}'), 100)"
        for c in ("family_name", "given_name", "npi"))
    phone = (f"(SELECT count_if(length(phone) >= 10) * 100.0 / count(*) FROM {src})" if "phone" in cols else "100.0")
    sc = (f"score AS (SELECT least(100.0, {crit}) * 0.4 + greatest(0, 100 - coalesce((SELECT sum(percentage) FROM "
          f"missing), 0) / {len(cols)} * 5) * 0.2 + greatest(0, 100 - (SELECT d FROM dups) * 1.0 / (SELECT count(*) "
          f"FROM {src}) * 100 * 2) * 0.2 + {phone} * 0.2 AS data_quality_score)")
    return [_missing_sql(src, cols), dups, sc]


def _recs_sql(src: str, cols: list[str]) -> str:
    n = f"(SELECT count(*) FROM {src})"
    parts = []
    for i, c in enumerate(("family_name", "given_name", "npi")):
        before, after = Q.MISSING_TEXT.format(field=c).replace("%%", "%").split("%s")
        parts.append(f"SELECT {i + 1} AS rule, {O._q(before)} || CAST(percentage AS VARCHAR) || {O._q(after)} AS text "
                     f"FROM missing WHERE column_name = '{c}' AND percentage > 5.0")
    parts.append(f"SELECT 4, printf({O._q(Q.INCONCLUSIVE_TEXT)}, count_if(lower(address_status) = 'inconclusive')) "
                 f"FROM {src} HAVING count_if(lower(address_status) = 'inconclusive') > {n} * 0.2")
    parts.append(f"SELECT 5, printf({O._q(Q.PHONE_TEXT)}, count_if(length(phone) < 10)) FROM {src} HAVING "
                 f"count_if(length(phone) < 10) > {n} * 0.1")
    parts.append(f"SELECT 6, printf({O._q(Q.DUPLICATE_TEXT)}, d * 100.0 / {n}) FROM dups WHERE d * 1.0 / {n} > 0.1")
    parts.append(f"SELECT 7, {O._q(Q.STATES_TEXT)} FROM (SELECT sum(c) AS s FROM (SELECT count(*) AS c FROM {src} "
                 f"WHERE state IS NOT NULL GROUP BY state ORDER BY c DESC, state LIMIT 5)) WHERE s > {n} * 0.8")
    return " UNION ALL ".join(parts)


def _q_sql(select: str, extra: list[str] = ()) -> str:
    return O.with_ctes(*_score_sql("prepared", PREPARED_COLS), *extra, select=select)


def _analyze_sql(src: str, cols: list[str]) -> str:
    parts = [f"SELECT 'total_records' AS family, '' AS item, count(*) AS value FROM {src}",
             "SELECT 'duplicate_records', '', d FROM dups", "SELECT 'missing', column_name, percentage FROM missing",
             "SELECT 'score', '', round(data_quality_score, 6) FROM score",
             f"SELECT 'recommendation', text, rule FROM ({_recs_sql(src, cols)})"]
    parts += [f"SELECT '{c}', {c}, count(*) FROM {src} WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("address_status", "phone_status")]
    parts += [f"SELECT 'state_distribution', 'unique_states', count(DISTINCT state) FROM {src}",
              f"(SELECT 'top_states', state, count(*) AS c FROM {src} WHERE state IS NOT NULL GROUP BY state ORDER BY c DESC, state LIMIT 5)"]
    parts += [f"SELECT 'phone_validity', '{k}', count_if({cond}) FROM {src}" for k, cond in (
        ("valid_count", "length(phone) >= 10"), ("invalid_count", "length(phone) < 10"), ("missing_count", "phone IS NULL"))]
    if "group_npi" in cols:
        groups = f"(SELECT count(*) AS c FROM {src} WHERE group_npi <> '' GROUP BY group_npi)"
        parts += [f"SELECT 'group_practice', 'unique_groups', count(*) FROM {groups}",
                  f"SELECT 'group_practice', 'largest_group_size', max(c) FROM {groups}",
                  f"SELECT 'group_practice', 'solo_practitioners', count_if(coalesce(group_npi, '') = '') FROM {src}"]
    return "SELECT family, item, CAST(value AS DOUBLE) AS value FROM (" + " UNION ALL ".join(parts) + ")"


ANALYZE_SQL = _analyze_sql("prepared", PREPARED_COLS)

QUALITY = {
    "a1_total": (lambda s, d: Q.total_records(prepared(s, d)),
                 O.with_ctes(select="SELECT count(*) AS total_records FROM prepared")),
    "a2_duplicates": (lambda s, d: Q.duplicate_records(prepared(s, d)), _q_sql("SELECT CAST(d AS BIGINT) AS "
                                                                               "duplicate_records FROM dups")),
    "a3_missing": (lambda s, d: Q.missing_values(prepared(s, d)), _q_sql("SELECT * FROM missing")),
    "t3_missing_order": (lambda s, d: Q.missing_values(prepared(s, d)).select("column_name"),
                         _q_sql("SELECT column_name FROM missing ORDER BY column_name")),
    "a4_status": (lambda s, d: Q.value_counts(prepared(s, d), "address_status").unionByName(
        Q.value_counts(prepared(s, d), "phone_status")),
        O.with_ctes(select="SELECT address_status AS value, count(*) AS count FROM prepared GROUP BY 1 UNION ALL "
                           "SELECT phone_status, count(*) FROM prepared GROUP BY 1")),
    "a5_states": (lambda s, d: Q.state_distribution(prepared(s, d)),
                  O.with_ctes(select="SELECT count(DISTINCT state) AS unique_states FROM prepared")),
    "t1_top_states": (lambda s, d: Q.top_states(raw(s, d)),
                      f"WITH {O.RAW} SELECT state, count(*) AS count FROM raw WHERE state IS NOT NULL GROUP BY state "
                      "ORDER BY count DESC, state LIMIT 5"),
    "a6_phone": (lambda s, d: Q.phone_validity(prepared(s, d)),
                 O.with_ctes(select="SELECT CAST(count_if(length(phone) >= 10) AS BIGINT) AS valid_count, CAST(count_if("
                                    "length(phone) < 10) AS BIGINT) AS invalid_count, CAST(count_if(phone IS NULL) "
                                    "AS BIGINT) AS missing_count FROM prepared")),
    "a7_groups": (lambda s, d: Q.group_practice(prepared(s, d)),
                  O.with_ctes(select="SELECT (SELECT count(DISTINCT group_npi) FROM prepared WHERE group_npi <> '') AS "
                                     "unique_groups, (SELECT coalesce(max(c), 0) FROM (SELECT count(*) AS c FROM "
                                     "prepared WHERE group_npi <> '' GROUP BY group_npi)) AS largest_group_size, "
                                     "(SELECT CAST(count_if(group_npi IS NULL OR group_npi = '') AS BIGINT) FROM prepared) AS "
                                     "solo_practitioners")),
    "a8_score": (lambda s, d: Q.quality_score(prepared(s, d)).select(_r6("data_quality_score")),
                 _q_sql("SELECT round(data_quality_score, 6) AS data_quality_score FROM score")),
    "a9_recommendations": (lambda s, d: Q.recommendations(prepared(s, d)),
                           _q_sql(_recs_sql("prepared", PREPARED_COLS))),
    "t4_first_recommendations": (lambda s, d: Q.first_recommendations(raw(s, d)),
                                 f"WITH {O.RAW}, " + ", ".join(_score_sql("raw", RAW_COLS)) +
                                 f" SELECT * FROM ({_recs_sql('raw', RAW_COLS)}) ORDER BY rule LIMIT 3"),
    "c7_quality_only": (lambda s, d: Q.long_form(raw(s, d)),
                        f"WITH {O.RAW}, " + ", ".join(_score_sql("raw", RAW_COLS)) + " " + _analyze_sql("raw", RAW_COLS)),
    "a10_analyze": (lambda s, d: Q.long_form(prepared(s, d)), _q_sql(ANALYZE_SQL)),
    "c8_prepare": (lambda s, d: Q.long_form(prepare_data(raw(s, d), "rid").records), _q_sql(ANALYZE_SQL)),
}


# CSV has no blank/null distinction: blank strings read back as null
SOURCES["k2_csv_sink"] = (q_k2_csv_sink, O.with_ctes(select="SELECT CAST(unique_id AS VARCHAR) AS unique_id, " + ", ".join(
    f"nullif({c}, '') AS {c}" for c in PREPARED_COLS[1:]) + " FROM prepared"))
SOURCES["k4_json_sink"] = (q_k4_json_sink, _res_select(
    f"{CLUSTER_ROWS_SQL} UNION ALL SELECT 'metadata', 'statistics.' || metric, NULL, value FROM ({STATISTICS_SQL}) WHERE category = 'General' "
    "UNION ALL SELECT 'metadata', 'record_count', NULL, count(*) FROM results"))
SOURCES["s3_json_array"] = (q_s3_json_array, SOURCES["s3_json"][1])
SOURCES["k5_report"] = (q_k5_report, _res_select(
    f"{CLUSTER_ROWS_SQL} UNION ALL SELECT 'summary', metric, value, NULL FROM ({SUMMARY_SQL}) "
    f"UNION ALL SELECT 'statistics', category || '/' || metric, NULL, value FROM ({STATISTICS_SQL})"))

REGISTRY: dict[str, tuple] = {}
for group in (SOURCES, VALIDATION, BLOCKING, SCORING, QUALITY):
    REGISTRY.update(group)


def queries():
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql():
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
