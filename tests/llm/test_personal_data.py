"""Personal data: base kinds against the plain expressions, validators, context, edge cases, and the query's SQL on texts that hold every kind."""

from __future__ import annotations

import random
import re

import duckdb
from pyspark.sql import functions as F

from tarnspark.llm import pii, queries

TEXTS = [
    "Bank account: IBAN DE89 3704 0044 0532 0130 00 AND Konto GB82WEST12345698765432.", "DE89 3704 0044 0532 0130 01 has a wrong check, XX89370400440532013000 no country.",
    "ssn 123-45-6789, but not 000-12-3456, 666-12-3456, 923-45-6789, 123-00-6789 or 123-45-0000", "no context at all for 123-45-6789 here",
    "Tel. 030/1234567 here, and forty characters or so further on an order 0171 1234567 is none", "amex card 378282246310005, or 378282246310006, and visa 4111 1111 1111 1111", "write to a.b+c@mail.example.com.x_y@z.org or x@y",
    "hosts 1.2.3.4.5.6.7.8 and 256.1.1.1 and 0001.02.3.255 and 1.2.3", "+1 (017) 555-7713 and +49-30-1234567+1 (2) 3-4 and +123", "order 4111-1111-1111-1111, invoice +1 (017) 555-7713",
    "é€𝄞 a@b.de ſ 1.1.1.1", "", None, "+1 " * 3000 + "1.2.3.4 " * 500, "x" * 100_000 + "@", "1" * 50_000, "mail a@b.c" * 2000,
]


def plain(text):
    """The base spans by the expressions themselves."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in reversed(m[0]) if c.isdigit()]
        if 16 <= len(digits) <= 19 and sum(d if i % 2 == 0 else d // 5 + 2 * d % 10 for i, d in enumerate(digits)) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_base_equals_the_expressions():
    draw = random.Random(5)
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 60))) for alphabet in ("a@.-b_0", "0123.", "0123 -+()", "ab@.%c 1", "4 1-") for _ in range(3000)]
    assert sum(len(plain(t)) for t in texts) > 1000
    for t in texts:
        assert [s[:3] for s in pii.find(t) if s[0] in {"email", "ip", "card", "phone"}] == plain(t), t


def test_validators_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod_97("GB82WEST12345698765432") and not pii.mod_97("GB83WEST12345698765432")
    found = lambda t: {(s[0], t[s[1] : s[2]]) for s in pii.find(t)}
    assert found(TEXTS[0]) == {("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432")}
    assert found(TEXTS[1]) == set()
    assert found(TEXTS[2]) == {("ssn", "123-45-6789")} and found(TEXTS[3]) == set()
    assert found(TEXTS[5]) == {("short_card", "378282246310005"), ("card", "4111 1111 1111 1111")}
    score = lambda t: pii.find(t)[0][3]
    assert score("card 4111-1111-1111-1111") == 100 and score("4111-1111-1111-1111") == 70 and score("order 4111-1111-1111-1111") == 40


def test_rows_and_sql(spark, tmp_path):
    rows = [(i % 15, t, "x", "y") for i, t in enumerate([*TEXTS, TEXTS[0]])] + [(None, TEXTS[0], "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, original string")
    out = pii.redact_documents(docs).collect()
    assert len(out) == len(rows)
    red = {r["original"]["text"]: r["redacted"] for r in out}
    assert red[TEXTS[0]] == "Bank account: IBAN <IBAN> AND Konto <IBAN>." and red[None] == "" and red[""] == ""
    assert {(r["original"]["spans"], r["original"]["original"]) for r in out} == {("x", "y")}
    assert pii.find_personal_data(docs.limit(0)).count() == 0
    docs.repartition(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_pii(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(queries.ORACLE_SQL["op11_pii"])
    names = [x[0] for x in want.description]
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in got.select(*names).collect())
    assert got.agg(*[F.sum(f"n_{k.name}") for k in pii.KINDS]).first()[4:] == (6, 1, 1, 1)
