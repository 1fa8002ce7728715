from pyspark.sql import functions as F

from linkwise.operators.prepare import DataValidationError, assert_batch_ok, prepare, validate_rows

COLS = "npi,firstname,lastname,address1,city,state,zipcode,phone,gnpi,address_status"
# 1000000004 passes the NPI checksum; 1000000005 does not
GOOD = ("1000000004", "John", "Smith", "1 Main St", "Springfield", "il", "62701", "2175551234", None, "Verified")


def _row(**change):
    values = dict(zip(COLS.split(","), GOOD))
    values.update(change)
    return tuple(values[c] for c in COLS.split(","))


CASES = {
    "good": _row(),
    "npi_checksum": _row(npi="1000000005"),
    "npi_format": _row(npi="10000000"),
    "first_empty": _row(firstname=""),
    "first_long": _row(firstname="x" * 51),
    "state_bad": _row(state="Illinois"),
    "zip_bad": _row(zipcode="ABC12"),
    "zip_plus4": _row(zipcode="62701-1234"),
    "phone_short": _row(phone="555"),
    "phone_null_token": _row(phone="null"),
    "gnpi_bad": _row(gnpi="1000000005"),
    "status_bad": _row(address_status="unknown"),
    "status_null": _row(address_status=None),
}
EXPECT_VALID = {"good", "zip_plus4", "phone_null_token"}


def test_each_rule_rejects_alone(spark):
    data = [(k, *v) for k, v in CASES.items()]
    df = spark.createDataFrame(data, "case string, " + ", ".join(f"{c} string" for c in COLS.split(",")))
    v = validate_rows(df.withColumn("unique_id", F.monotonically_increasing_id()))
    ids = df.withColumn("unique_id", F.monotonically_increasing_id()).select("case", "unique_id")
    res = {r["case"]: r["errors"] for r in v.join(ids, "unique_id").select("case", "errors").collect()}
    for case, errors in res.items():
        if case in EXPECT_VALID:
            assert errors == [], (case, errors)
        else:
            assert len(errors) == 1, (case, errors)


def test_prepared_projection(spark):
    df = spark.createDataFrame([_row(), _row(npi="1000000005")], ", ".join(f"{c} string" for c in COLS.split(",")))
    prepared, quarantine = prepare(df)
    rows = prepared.collect()
    assert len(rows) == 1 and quarantine.count() == 1
    r = rows[0]
    assert r["state"] == "IL" and r["street_address"] == "1 main street" and r["group_npi"] == ""
    assert r["address_status"] == "verified" and r["phone_status"] == "inconclusive"


def test_batch_check(spark):
    df = spark.createDataFrame([("12345",)], "npi string")
    try:
        assert_batch_ok(df)
        raised = False
    except DataValidationError as exc:
        raised = "Missing required columns" in str(exc) and "invalid NPI" in str(exc)
    assert raised


def test_legacy_name_wins(spark):
    from linkwise.operators.prepare import to_model

    df = spark.createDataFrame([("A", "B")], "firstname string, first_name string")
    assert to_model(df).collect()[0]["first_name"] == "A"
