import hashlib
import random
import re

import pytest

from linkwise.llm import pii

from ..conftest import SF_SMALL
from .conftest import EDGE_ROWS

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_match_the_patterns_as_given(spark, make):
    rng = random.Random(1)
    letters = [*"ab@.-+ ()0123456789%_é\n日", "4111111111111111", "+1 217 555 1234", "1.2.3.4"]
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(160)))) for i in range(1500)]
    rows += [(5000, "1.2.3.4.5.6.7.8 a@b.c+x@y.z.@q.r 4111 1111-1111 1111 +1 (217) 555-1234 999.1.1.1 001.02.3.255")]
    rows += [(i, t) for i, t in enumerate((r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()), 6000)]
    for r in pii.spans_by_row(make(rows)).collect():
        want = plain_base(dict(rows)[r.id])
        assert [s for s in r.spans.split(",") if s and not s.startswith("context")] == want
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [
            sum(s.startswith(k) for s in want) for k in ("email:", "ip:", "card:", "phone:")]


def test_patterns_stay_linear_on_long_runs(make):
    rows = [(1, "a" * 200_000), (2, "1" * 200_000), (3, "1 " * 100_000), (4, "a.b-" * 50_000 + "@"),
            (5, "+1" + " " * 200_000), (6, "1." * 60_000), (7, "a@b" + ".c" * 60_000)]
    got = {r.id: r.spans for r in pii.spans_by_row(make(rows)).collect()}
    assert got[7] == "email:0:120003" and got[1] == got[2] == got[3] == ""


def member_rows():
    """Seeds teach 'reach .. today'; member numbers stand in the same places, versions in others."""
    rng = random.Random(2)
    rows = [(i, f"you may reach user{i}@mail.org today for {rng.randrange(9)} more") for i in range(40)]
    rows += [(100 + i, f"please reach MB-{7000 + i}-X, today or write") for i in range(5)]
    rows += [(200 + i, f"see version {i}.4 of it") for i in range(5)]
    return rows


def test_contexts_discover_unseen_identifiers(make):
    rows = member_rows()
    got = {r.id: r.spans.split(",") for r in pii.spans_by_row(make(rows)).collect()}
    for i, text in rows:
        found = [text[int(a):int(b)] for k, a, b in (s.split(":") for s in got[i] if s) if k == "context"]
        assert found == ([f"MB-{7000 + i - 100}-X"] if 100 <= i < 200 else [])


def test_redaction_keeps_the_rest(make):
    rows = [(1, "é mail a@b.co, call +1 217 555 1234."), (2, "nothing here"), (3, None), (1, "other text 9.9.9.9")]
    docs = make(rows, clashing=True).withColumn("n_chars", pii.F.length("text").cast("long"))
    got = pii.redacted(docs, length_col="n_chars")
    assert got.columns == docs.columns
    texts = sorted((r.doc_id, r.text, r.n_chars) for r in got.where("text is not null").collect())
    assert texts == [(1, "other text [IP]", 15), (1, "é mail [EMAIL], call [PHONE].", 29), (2, "nothing here", 12)]
    assert got.where("doc_id = 3 and text is null").count() == 1


def test_edge_rows(make):
    found = pii.spans_by_row(make([*EDGE_ROWS, (9, "a@b.co"), (9, "a@b.co")], clashing=True)).collect()
    assert len(found) == len(EDGE_ROWS) + 2
    assert [r.spans for r in found if r.id == 9] == ["email:0:6"] * 2
    assert all(r.spans == "" for r in found if r.id != 9)
    assert pii.spans_by_row(make([])).count() == 0
    assert pii.redacted(make([])).count() == 0


def test_native_plan(make):
    plan = pii.spans_by_row(make([(1, "a@b.co")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
