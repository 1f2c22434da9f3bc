"""Retention of texts: sensitive data redacted by category, and rows that leave on their date.

Each category of data has a strategy.  ``hash``, ``mask``, ``remove`` and ``anonymize`` cannot be undone.  ``pseudonym`` puts a keyed
digest (HMAC with SHA-256) in place of a match: the same person is the same pseudonym in every document and run, and
nobody without the key can try out who it is.  ``encrypt`` is AES-GCM with a given key, under a nonce of its own for each match;
``decrypted`` undoes it.  All are Column expressions over whole texts: no shuffle, and no table of names that all rows would meet in.

Categories are redacted one after the other, so what one has replaced is not found by the next.  Null texts stay null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bulwark.functions.regex import Rx
from bulwark.operators.policies import each_match, hashed, masked

#: Sensitive data by category and type, in the order they are redacted.
SENSITIVE = {
    "pii": {
        "email": Rx(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
        "phone": Rx(r"(\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})"),
        "ssn": Rx(r"\b\d{3}-\d{2}-\d{4}\b"),
        "creditCard": Rx(r"\b\d{4}[-.\s]?\d{4}[-.\s]?\d{4}[-.\s]?\d{4}\b"),
        "ipAddress": Rx(r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
        "macAddress": Rx(r"\b([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})\b"),
        "names": Rx(r"\b(Mr\.|Mrs\.|Ms\.|Dr\.|Prof\.)\s+[A-Z][a-z]+\s+[A-Z][a-z]+\b"),
        "address": Rx(r"\b\d+\s+[A-Za-z\s]+(Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr)\b"),
        "dateOfBirth": Rx(r"\b(DOB|Birth|Born):\s*\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", "i"),
        "passport": Rx(r"\b[A-Z]{1,2}\d{6,9}\b"),
        "driverLicense": Rx(r"\b[A-Z]{1,2}\d{6,8}\b"),
    },
    "financial": {
        "bankAccount": Rx(r"\b\d{8,17}\b"),
        "routingNumber": Rx(r"\b\d{9}\b"),
        "accountNumber": Rx(r"\b(Account|Acct|ACC):\s*\d{4,17}\b", "i"),
        "amounts": Rx(r"\$\d{1,3}(,\d{3})*(\.\d{2})?"),
        "salary": Rx(r"\b(Salary|Income|Pay):\s*\$\d{1,3}(,\d{3})*(\.\d{2})?\b", "i"),
    },
    "auth": {
        "apiKey": Rx(r"\b(api[_-]?key|apikey):\s*[A-Za-z0-9]{20,}\b", "i"),
        "accessToken": Rx(r"\b(access[_-]?token|token):\s*[A-Za-z0-9]{20,}\b", "i"),
        "bearerToken": Rx(r"\bBearer\s+[A-Za-z0-9]{20,}\b", "i"),
        "password": Rx(r"\b(password|passwd|pwd):\s*[^\s]{6,}\b", "i"),
        "privateKey": Rx(r"-----BEGIN\s+(RSA\s+)?PRIVATE\s+KEY-----[\s\S]*?-----END\s+(RSA\s+)?PRIVATE\s+KEY-----", "i"),
        "sshKey": Rx(r"ssh-rsa\s+[A-Za-z0-9+/]+[=]{0,3}\s+[^\s]+", "i"),
    },
    "business": {
        "employeeId": Rx(r"\b(Employee|Emp|Staff)\s*ID:?\s*\d{4,10}\b", "i"),
        "customerId": Rx(r"\b(Customer|Cust|Client)\s*ID:?\s*\d{4,10}\b", "i"),
        "orderNumber": Rx(r"\b(Order|Order#|Order\s*Number):\s*\d{6,12}\b", "i"),
        "invoiceNumber": Rx(r"\b(Invoice|Inv|Invoice#):\s*\d{6,12}\b", "i"),
        "contractNumber": Rx(r"\b(Contract|Contract#):\s*[A-Z]{2,4}\d{6,10}\b", "i"),
    },
    "medical": {
        "medicalRecord": Rx(r"\b(Medical|MRN|Record)\s*#:?\s*\d{6,12}\b", "i"),
        "healthInsurance": Rx(r"\b(Health|Insurance|Policy)\s*#:?\s*\d{6,12}\b", "i"),
        "diagnosisCode": Rx(r"\b(ICD|Diagnosis):\s*[A-Z]\d{2}\.\d{1,2}\b", "i"),
    },
}
#: Strategy and days of retention by category; texts without any are kept for the last.
STRATEGIES = {"pii": "hash", "financial": "mask", "auth": "remove", "business": "anonymize", "medical": "encrypt"}
DAYS = {"pii": 30, "financial": 90, "auth": 1, "business": 365, "medical": 7}
CONVERSATION_DAYS = 7
#: What every match of a type holds: one of some words, in lower case, or a short pattern.  Either is many times faster to look for than
#: the type's own pattern, whose word boundaries are tested at every character.
GATES: dict[str, list[str] | str] = {
    "email": ["@"], "phone": "[0-9]{3}", "ssn": "[0-9]{3}-[0-9]", "creditCard": "[0-9]{4}", "ipAddress": r"[0-9]\.[0-9]", "macAddress": "[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]", "names": ["mr.", "mrs.", "ms.", "dr.", "prof."],
    "address": "[0-9]", "dateOfBirth": ["dob:", "birth:", "born:"], "passport": "[A-Z][0-9]{6}", "driverLicense": "[A-Z][0-9]{6}", "bankAccount": "[0-9]{8}", "routingNumber": "[0-9]{9}", "accountNumber": ["account:", "acct:", "acc:"],
    "amounts": ["$"], "salary": ["salary:", "income:", "pay:"], "apiKey": ["key:"], "accessToken": ["token:"], "bearerToken": ["bearer"], "password": ["password:", "passwd:", "pwd:"], "privateKey": ["private"], "sshKey": ["ssh-rsa"],
    "employeeId": ["employee", "emp", "staff"], "customerId": ["customer", "cust", "client"], "orderNumber": ["order"], "invoiceNumber": ["invoice", "inv"], "contractNumber": ["contract"], "medicalRecord": ["medical", "mrn", "record"],
    "healthInsurance": ["health", "insurance", "policy"], "diagnosisCode": ["icd:", "diagnosis:"],
}
#: What an encrypted match looks like.
SEALED = Rx(r"ENC\(([A-Za-z0-9+/=]+)\)")


def hmac(key: bytes, message: Column) -> Column:
    """HMAC with SHA-256, in hexadecimal digits."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in block)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in block)), F.unhex(inner)), 256)


def _change(strategy: str, kind: str, key: bytes | None) -> Callable[[Column], Column]:
    if strategy in ("pseudonym", "encrypt") and not key:
        raise ValueError(f"{strategy} needs a key")
    if strategy == "encrypt" and len(key) not in (16, 24, 32):
        raise ValueError("keys of encryption have 16, 24 or 32 bytes")
    changes = {
        "hash": hashed, "mask": masked, "remove": lambda m: F.lit("[REMOVED]"), "anonymize": lambda m: F.lit(f"[{kind.upper()}_REDACTED]"),
        # matches that differ in case or in white space at the ends are the same person
        "pseudonym": lambda m: F.concat(F.lit(f"<{kind.upper()}_"), F.left(hmac(key, F.concat(F.lit(f"{kind}:"), F.lower(F.trim(m)))), F.lit(16)), F.lit(">")),
        "encrypt": lambda m: F.concat(F.lit("ENC("), F.base64(F.aes_encrypt(m.cast("binary"), F.lit(key), F.lit("GCM"))), F.lit(")")),
    }
    return changes[strategy]


def _gated(kind: str, rx: Rx, text: Column, lower: Column) -> Column:
    """How often a type occurs in a text."""
    gate = GATES.get(kind) if rx == next((types[kind] for types in SENSITIVE.values() if kind in types), None) else None
    if gate is None:
        return rx.count(text)
    if isinstance(gate, str):
        return F.when(text.rlike(gate), rx.count(text)).otherwise(0)
    some = F.lit(False)
    for word in gate:
        some = some | F.contains(lower, F.lit(word))
    return F.when(some, rx.count(text)).otherwise(0)


def redact(df: DataFrame, text: str = "text", strategies: dict[str, str] | None = None, key: bytes | None = None, categories: dict[str, dict[str, Rx]] | None = None) -> DataFrame:
    """``df`` with ``redacted``, ``types`` found (``category_type``), and ``counts`` of matches in the original by category.

    Other columns pass through; those of the three names are replaced.
    """
    strategies, categories = STRATEGIES | (strategies or {}), categories or SENSITIVE
    kinds = [(c, t, rx) for c, types in categories.items() for t, rx in types.items()]
    # a projection for each type: what the next pattern reads several times is a column, not an expression
    out = df.drop("redacted", "types", "counts").withColumn("__lower", F.lower(text))
    out = out.withColumn("__n", F.array(*[_gated(t, rx, F.col(text), F.col("__lower")) for _, t, rx in kinds])).withColumn("redacted", F.col(text)).drop("__lower")
    for k, (c, t, rx) in enumerate(kinds):
        changed = each_match(rx, _change(strategies[c], f"{c}_{t}", key))(F.col("redacted"))
        out = out.withColumn("redacted", F.when(F.col("__n")[k] > 0, changed).otherwise(F.col("redacted")))
    names = F.filter(F.array(*[F.when(F.col("__n")[k] > 0, F.lit(f"{c}_{t}")) for k, (c, t, _) in enumerate(kinds)]), lambda x: x.isNotNull())
    counts = [F.coalesce(sum((F.col("__n")[k] for k, (d, _, _) in enumerate(kinds) if d == c), F.lit(0)), F.lit(0)).alias(c) for c in categories]
    return out.withColumns({"types": names, "counts": F.struct(*counts)}).drop("__n")


def decrypted(text: Column, key: bytes) -> Column:
    """A text with its encrypted matches in clear again."""
    inside = lambda m: F.substring(m, F.lit(5), F.length(m) - 5)
    return each_match(SEALED, lambda m: F.aes_decrypt(F.unbase64(inside(m)), F.lit(key), F.lit("GCM")).cast("string"))(text)


# Expiry: the date on which a row leaves is a partition of its table, so that dropping it rewrites nothing.


def expires_on(stored: Column, types: Column, days: dict[str, int] | None = None, default: int = CONVERSATION_DAYS) -> Column:
    """The day on which a row stored on ``stored`` leaves: by the shortest retention of the data it holds."""
    days = DAYS | (days or {})
    found = F.transform(types, lambda t: F.split_part(t, F.lit("_"), F.lit(1)))
    holds = [F.when(F.array_contains(found, c), F.lit(n)) for c, n in days.items()]
    return F.date_add(stored.cast("date"), F.coalesce(F.least(*holds), F.lit(default)))


def keep(rows: DataFrame, path: str) -> None:
    """Append ``rows`` (with ``expires_on``) to the table at ``path``, a partition for each day of expiry."""
    rows.repartition("expires_on").write.mode("append").partitionBy("expires_on").parquet(path)


def kept(spark: SparkSession, path: str, today: date) -> DataFrame:
    """Rows that have not expired; the partitions of those that have are not read."""
    return spark.read.parquet(path).filter(F.col("expires_on") > F.lit(today))


def drop_expired(spark: SparkSession, path: str, today: date) -> list[str]:
    """Delete the partitions that have expired, and name them: their rows are not read."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("expires_on=") and name.removeprefix("expires_on=") <= today.isoformat():
            files.delete(status.getPath(), True)
            gone.append(name.removeprefix("expires_on="))
    return sorted(gone)
