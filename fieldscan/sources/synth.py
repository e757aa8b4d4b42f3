"""Synthetic messages: realistic values per field, half of them missing.

Every value is an expression of a row's id, the field name and a seed, so the
messages are the same on every run and are made where the ids are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Name, Avro type and category of each field, and our name for its kind of value.
FIELD_POOL = [
    ("first_name", "string", "PII", "first"),
    ("last_name", "string", "PII", "last"),
    ("email", "string", "PII", "email"),
    ("phone_number", "string", "PII", "phone"),
    ("date_of_birth", "string", "PII", "birth"),
    ("ip_address", "string", "PII", "ip"),
    ("customer_id", "string", "PII", "customer"),
    ("middle_name", "string", "PII", "first"),
    ("nickname", "string", "PII", "first"),
    ("guardian_name", "string", "PII", "first"),
    ("emergency_contact", "string", "PII", "phone"),
    ("personal_email", "string", "PII", "email"),
    ("ssn", "string", "GOVERNMENT_ID", "ssn"),
    ("passport_number", "string", "GOVERNMENT_ID", "passport"),
    ("driver_license", "string", "GOVERNMENT_ID", "license"),
    ("tax_id", "string", "GOVERNMENT_ID", "tax"),
    ("national_id", "string", "GOVERNMENT_ID", "ssn"),
    ("credit_card_number", "string", "PCI", "card"),
    ("iban", "string", "PCI", "iban"),
    ("swift_code", "string", "PCI", "swift"),
    ("crypto_wallet", "string", "PCI", "wallet"),
    ("bank_account_number", "string", "FINANCIAL", "account"),
    ("routing_number", "string", "FINANCIAL", "routing"),
    ("transaction_amount", "int", "FINANCIAL", "amount"),
    ("username", "string", "CREDENTIALS", "username"),
    ("password", "string", "CREDENTIALS", "password"),
    ("api_key", "string", "CREDENTIALS", "apikey"),
    ("aws_access_key_id", "string", "CREDENTIALS", "awskey"),
    ("session_token", "string", "CREDENTIALS", "jwt"),
    ("billing_street", "string", "LOCATION", "street"),
    ("billing_city", "string", "LOCATION", "city"),
    ("billing_postal_code", "string", "LOCATION", "zip"),
    ("billing_state", "string", "LOCATION", "state"),
    ("billing_country", "string", "LOCATION", "country"),
    ("gps_coordinates", "string", "LOCATION", "gps"),
    ("patient_diagnosis", "string", "PHI", "diagnosis"),
    ("medication", "string", "PHI", "medication"),
    ("medical_record_number", "string", "PHI", "mrn"),
    ("provider_npi", "string", "PHI", "npi"),
    ("dea_number", "string", "PHI", "dea"),
    ("fingerprint_hash", "string", "BIOMETRIC", "print"),
    ("dna_sequence", "string", "GENETIC", "dna"),
    ("notes", "string", "FREE_TEXT", "note"),
    ("comment", "string", "FREE_TEXT", "note"),
    ("description", "string", "FREE_TEXT", "note"),
    ("order_id", "int", "NEUTRAL", "order"),
]
PRIORITY = ["PII", "GOVERNMENT_ID", "PCI", "FINANCIAL", "CREDENTIALS", "LOCATION", "PHI", "FREE_TEXT"]
MIN_FIELDS, DEFAULT_FIELDS = 5, 20

# Samples that values are picked from: our own choice.
FIRST = ["Amara", "Bogdan", "Celeste", "Dmitri", "Elif", "Farah", "Goran", "Hanna", "Ismael", "Jonna"]
LAST = ["Abernathy", "Bergstrom", "Castellano", "Dvorak", "Eriksen", "Fontaine", "Gallagher", "Haddad"]
DOMAIN = ["mail.example", "post.example", "inbox.test", "letters.invalid"]
CITY = ["Lisbon", "Utrecht", "Tampere", "Cork", "Ghent", "Trieste", "Aarhus"]
STREET = ["Harbour Row", "Mill Lane", "Station Road", "Orchard Way"]
STATE = ["VT", "NM", "ME", "UT", "ID", "KS"]
COUNTRY = ["PT", "NL", "FI", "IE", "BE", "IT"]
DIAGNOSIS = ["Celiac Disease", "Psoriasis", "Glaucoma", "Sleep Apnea", "Anemia"]
MEDICATION = ["Atorvastatin 20mg", "Omeprazole 40mg", "Levothyroxine", "Amoxicillin"]
NOTES = [
    "The parcel came back because nobody was at the door on Tuesday.",
    "Asked us to call again after the appointment with the dentist.",
    "Two invoices carry the same number and one of them was paid twice.",
    "Would like the contract sent to the new flat in Ghent by Friday.",
    "Forgot the pass phrase again and was let in after a call.",
    "Celeste Dvorak takes the amoxicillin with food since last week.",
]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"


def field_rows() -> list[tuple[str, str, str, str]]:
    return FIELD_POOL


def field_specs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, *row) for i, row in enumerate(field_rows())],
        "ord int, name string, avro_type string, category string, kind string",
    )


def draw(row: Column, name: str, seed: int, use: str, below: int) -> Column:
    """A number in [0, below) fixed by row id, field, seed and use."""
    key = F.concat_ws("|", row.cast("string"), F.lit(name), F.lit(str(seed)), F.lit(use))
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long"), F.lit(below))


def _value(row: Column, name: str, kind: str, seed: int) -> Column:
    def num(low: int, high: int, use: str = "n") -> Column:
        return draw(row, name, seed, use, high - low + 1) + low

    def text(low: int, high: int, use: str = "n", width: int = 0) -> Column:
        digits = num(low, high, use).cast("string")
        return F.lpad(digits, width, "0") if width else digits

    def pick(options, use: str = "p") -> Column:
        return F.get(F.array(*[F.lit(o) for o in options]), draw(row, name, seed, use, len(options)).cast("int"))

    def chars(alphabet: str, n: int, use: str = "c") -> Column:
        # One digest gives 15 letters; longer values take several.
        def block(k: int) -> Column:
            digest = F.md5(F.concat_ws("|", row.cast("string"), F.lit(name), F.lit(str(seed)), F.lit(f"{use}{k}")))

            def letter(i: Column) -> Column:
                at = F.conv(F.substring(digest, i * 2 - 1, F.lit(3)), 16, 10).cast("int")
                return F.substring(F.lit(alphabet), F.pmod(at, F.lit(len(alphabet))) + 1, F.lit(1))

            return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(min(15, n - 15 * k))), letter), "")

        return F.concat(*[block(k) for k in range(-(-n // 15))])

    join = F.concat
    lit = F.lit
    kinds = {
        "first": lambda: pick(FIRST),
        "last": lambda: pick(LAST),
        "email": lambda: join(F.lower(pick(LAST, "l")), lit("_"), text(1, 999, "n"), lit("@"), pick(DOMAIN, "d")),
        "phone": lambda: join(lit("("), text(201, 989, "a"), lit(") "), text(200, 999, "b"), lit("-"), text(0, 9999, "c", 4)),
        "birth": lambda: F.date_add(F.lit("1931-01-01").cast("date"), num(0, 27_000).cast("int")).cast("string"),
        "ip": lambda: F.concat_ws(".", lit("10"), text(0, 255, "b"), text(0, 255, "c"), text(1, 254, "d")),
        "ssn": lambda: F.concat_ws("-", text(100, 899, "a"), text(10, 99, "b"), text(1000, 9999, "c")),
        "passport": lambda: join(chars(UPPER, 2), text(0, 9_999_999, width=7)),
        "license": lambda: join(chars(UPPER, 1), text(0, 999, "a", 3), lit("-"), text(0, 99_999, "b", 5)),
        "tax": lambda: join(text(10, 99, "a"), lit("-"), text(1_000_000, 9_999_999, "b")),
        "card": lambda: join(lit("5"), text(100_000_000_000_000, 599_999_999_999_999)),
        "iban": lambda: join(lit("NL"), text(10, 99, "a"), chars(UPPER, 4), text(0, 9_999_999_999, "b", 10)),
        "swift": lambda: join(chars(UPPER, 4), pick(COUNTRY), chars(UPPER + DIGITS, 2, "d")),
        "routing": lambda: text(11_000_000, 329_999_999, width=9),
        "account": lambda: text(0, 999_999_999_999, width=12),
        "username": lambda: join(F.lower(pick(FIRST, "f")), lit("."), chars(LOWER, 3)),
        "password": lambda: join(chars(LOWER, 5), lit("#"), chars(UPPER + DIGITS, 6, "d")),
        "apikey": lambda: join(lit("pk_live_"), chars(LOWER + DIGITS, 24)),
        "awskey": lambda: join(lit("AKIA"), chars(UPPER + DIGITS, 16)),
        "jwt": lambda: F.concat_ws(".", join(lit("eyJ"), chars(LOWER + UPPER, 17, "a")), chars(LOWER + UPPER, 31, "b"), chars(LOWER + UPPER, 43, "d")),
        "street": lambda: join(pick(STREET), lit(" "), text(1, 240)),
        "city": lambda: pick(CITY),
        "zip": lambda: join(text(1000, 9999), lit(" "), chars(UPPER, 2)),
        "gps": lambda: F.format_string("%.5f %.5f", num(0, 18_000_000, "a") / 1e5 - 90, num(0, 36_000_000, "b") / 1e5 - 180),
        "state": lambda: pick(STATE),
        "country": lambda: pick(COUNTRY),
        "note": lambda: pick(NOTES),
        "customer": lambda: join(lit("K"), text(0, 99_999_999, width=8)),
        "order": lambda: num(1, 1_000_000).cast("int"),
        "amount": lambda: num(1, 100_000).cast("int"),
        "diagnosis": lambda: pick(DIAGNOSIS),
        "medication": lambda: pick(MEDICATION),
        "npi": lambda: text(1_000_000_000, 1_999_999_999),
        "dea": lambda: join(chars(UPPER, 2), text(0, 9_999_999, width=7)),
        "mrn": lambda: join(lit("H"), text(0, 999_999, width=6)),
        "dna": lambda: chars("ACGT", 60),
        "wallet": lambda: join(lit("0x"), chars(DIGITS + "abcdef", 40)),
        "print": lambda: chars(DIGITS + "abcdef", 48),
    }
    return kinds[kind]()


def select_fields(spark: SparkSession, n: int = DEFAULT_FIELDS, seed: int = 0) -> DataFrame:
    """``n`` distinct field specs: one of each priority category first, then any.

    Which one of a category, and which ones after, follows from a hash of name
    and seed.
    """
    pool = len(field_rows())
    if not MIN_FIELDS <= n <= pool:
        raise ValueError(f"n must be between {MIN_FIELDS} and {pool}")
    chance = F.xxhash64("name", F.lit(seed))
    rank = F.row_number().over(Window.partitionBy("category").orderBy("chance", "name"))
    priority = F.array_position(F.array(*[F.lit(c) for c in PRIORITY]), F.col("category"))
    first = (F.col("rank") == 1) & (priority > 0)
    return (
        field_specs(spark)
        .withColumn("chance", chance)
        .withColumn("rank", rank)
        .withColumn("turn", F.when(first, priority).otherwise(len(PRIORITY) + 1))
        .orderBy("turn", "chance", "name")
        .limit(n)
        .select("name", "avro_type", "category", "kind", "turn")
    )


def avro_schema(fields: list[tuple[str, str]], name: str = "DemoRecord", namespace: str = "demo") -> dict:
    """Record schema of nullable fields (name, type)."""
    made = [{"name": n, "type": ["null", t], "default": None} for n, t in fields]
    return {"type": "record", "namespace": namespace, "name": name, "fields": made}


def synthetic_records(
    rows: DataFrame, row_id: str, fields: list[tuple[str, str, str, str]] | None = None, seed: int = 0
) -> DataFrame:
    """One record per row of ``rows``: each field is null with probability one half."""
    made = []
    for name, avro_type, _, kind in fields or field_rows():
        present = draw(F.col(row_id), name, seed, "present", 2) == 1
        made.append(F.when(present, _value(F.col(row_id), name, kind, seed).cast(avro_type)).alias(name))
    return rows.select(row_id, *made)
