import pytest

#: Column names that the operators use inside, beside the ones they read.
CLASHING = {"id": "'x'", "version": "'y'", "places": "1", "lists": "2", "kind": "'k'", "score": "0.5", "fp": "3",
            "component": "4", "bucket": "5", "row": "'r'", "n": "6", "toxic": "7", "fold": "8", "gone_id": "9"}


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with clashing extra columns on request."""

    def build(rows, clashing=False):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        return df.selectExpr("*", *[f"{v} as `{k}`" for k, v in CLASHING.items()]) if clashing else df

    return build


#: Null id, null and empty text, blanks alone, repeated rows, one very long text.
EDGE_ROWS = [(1, "one two three four"), (1, "one two three four"), (None, "one two three four"), (2, None), (3, ""),
             (4, " \n\t "), (5, "lang " * 30_000), (6, "x" * 70_000)]
