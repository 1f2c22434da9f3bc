from __future__ import annotations

import hashlib
import hmac
import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from bulwark.operators import retention as rn

KEY = b"0123456789abcdef"
LINES = [
    "mail a.b@example.com", "Dr. Jane Doe called", "ssn 123-45-6789", "card 4111-1111-1111-1111", "host 10.0.0.1", "password: hunter2hunter2", "Employee ID: 12345", "MRN #: 123456", "ICD: A12.3", "Salary: $1,200.00", "plain words only", "Bearer abcdefghij0123456789",
    "12 Long Garden Street", "Order: 1234567", "Account: 998877", "",
]


def brute(text, strategies):
    types, counts = [], {}
    out = text
    for c, kinds in rn.SENSITIVE.items():
        for t, rx in kinds.items():
            flags = re.A | (re.I if "i" in rx.flags else 0)
            n = len(re.findall(rx.source, text, flags))
            counts[c] = counts.get(c, 0) + n
            if not n:
                continue
            types.append(f"{c}_{t}")

            def change(m, c=c, t=t):
                m = m[0]
                if strategies[c] == "mask":
                    return "*" * len(m) if len(m) <= 4 else m[:2] + "*" * (len(m) - 4) + m[-2:]
                if strategies[c] == "remove":
                    return "[REMOVED]"
                if strategies[c] == "anonymize":
                    return f"[{c}_{t}_REDACTED".upper() + "]"
                return f"<{c}_{t}_".upper() + hmac.new(KEY, f"{c}_{t}:{m.strip().lower()}".encode(), hashlib.sha256).hexdigest()[:16] + ">"

            out = re.sub(rx.source, change, out, flags=flags)
    return out, types, counts


def test_strategies(spark):
    rng = random.Random(1)
    texts = [" and ".join(rng.choices(LINES, k=rng.randint(1, 5))) for _ in range(80)] + [None, ""]
    strategies = {"pii": "pseudonym", "financial": "mask", "auth": "remove", "business": "anonymize", "medical": "pseudonym"}
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").repartition(4)
    for r in rn.redact(df.withColumn("counts", F.lit(1)), "t", strategies, KEY).collect():
        text, types, counts = brute(r.t or "", strategies)
        assert (r.redacted, r.types, r.counts.asDict()) == (None if r.t is None else text, types, counts), r.t


def test_one_person_is_one_pseudonym(spark):
    df = spark.createDataFrame([("mail Ann@x.org now",), ("to ann@X.org and bob@x.org",)], "t string")
    a, b = [re.findall(r"<PII_EMAIL_[0-9a-f]{16}>", r.x) for r in rn.redact(df, "t", {"pii": "pseudonym"}, KEY).select(F.col("redacted").alias("x")).collect()]
    assert a[0] == b[0] != b[1]
    other = rn.redact(df, "t", {"pii": "pseudonym", "medical": "remove"}, b"another key, longer than a block of sixty-four bytes, by a good deal").first().redacted
    assert a[0] not in other


def test_ciphertext_comes_back(spark):
    text = "MRN #: 123456 and ICD: A12.3 of é"
    df = rn.redact(spark.createDataFrame([(text,)], "t string"), "t", {}, KEY)
    row = df.select("redacted", rn.decrypted(F.col("redacted"), KEY).alias("back")).first()
    assert "123456" not in row.redacted and row.redacted.count("ENC(") == 2 and row.back == text
    for strategy, key in (("encrypt", None), ("encrypt", b"short"), ("pseudonym", None)):
        with pytest.raises(ValueError):
            rn.redact(df, "t", {"pii": strategy, "medical": "remove"}, key)


def test_expiry(spark, tmp_path):
    path = str(tmp_path / "kept")
    rows = spark.createDataFrame([(1, "2024-01-01", ["pii_email"]), (2, "2024-01-01", ["auth_password", "pii_email"]), (3, "2024-01-05", []), (4, "2024-01-01", ["business_orderNumber"])], "id int, day string, types array<string>")
    dated = rows.withColumn("expires_on", rn.expires_on(F.col("day"), F.col("types")))
    assert {r.id: r.expires_on for r in dated.collect()} == {1: date(2024, 1, 31), 2: date(2024, 1, 2), 3: date(2024, 1, 12), 4: date(2024, 12, 31)}
    rn.keep(dated.drop("types"), path)
    today = date(2024, 1, 12)
    left = rn.kept(spark, path, today)
    assert {r.id for r in left.collect()} == {1, 4} and "PartitionFilters: [isnotnull(expires_on" in left._jdf.queryExecution().executedPlan().toString()
    assert rn.drop_expired(spark, path, today) == ["2024-01-02", "2024-01-12"]
    assert {r.id for r in spark.read.parquet(path).collect()} == {1, 4} and rn.drop_expired(spark, path, today) == []


def test_gates_let_every_match_pass():
    """Each gate holds for texts made to match its type, written by hand."""
    made = {
        "email": "a@b.co", "phone": "(555) 123.4567", "ssn": "123-45-6789", "creditCard": "4111.1111 1111-1111", "ipAddress": "1.2.3.4", "macAddress": "00-1b:44:11:3A:B7", "names": "Prof. Ann Lee", "address": "5 Elm St", "dateOfBirth": "BORN: 1/2/99",
        "passport": "AB123456", "driverLicense": "Z1234567", "bankAccount": "12345678", "routingNumber": "123456789", "accountNumber": "ACCT: 1234", "amounts": "$5", "salary": "PAY: $1", "apiKey": "APIKEY: " + "a1" * 10, "accessToken": "TOKEN: " + "b2" * 10,
        "bearerToken": "BEARER " + "c3" * 10, "password": "PWD: secret1", "privateKey": "-----begin PRIVATE key-----x-----END private KEY-----", "sshKey": "SSH-RSA AAAA me@x", "employeeId": "STAFF ID 1234", "customerId": "Client id: 12345", "orderNumber": "ORDER: 123456",
        "invoiceNumber": "Inv: 123456", "contractNumber": "CONTRACT: AB123456", "medicalRecord": "MRN #123456", "healthInsurance": "POLICY #: 123456", "diagnosisCode": "DIAGNOSIS: A12.3",
    }
    types = {t: rx for kinds in rn.SENSITIVE.values() for t, rx in kinds.items()}
    assert made.keys() == types.keys() == rn.GATES.keys()
    for kind, text in made.items():
        assert re.search(types[kind].source, text, re.A | (re.I if "i" in types[kind].flags else 0)), kind
        gate = rn.GATES[kind]
        assert re.search(gate, text) if isinstance(gate, str) else any(w in text.lower() for w in gate), kind
