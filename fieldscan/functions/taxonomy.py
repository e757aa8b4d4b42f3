"""Tags, entity types and the expressions that map between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The eleven tags. What a catalog says about them is our own text.
TAG_DESCRIPTIONS = {
    "PII": "Says who a person is or how to reach them.",
    "PHI": "Says something about a person's health, care or insurance.",
    "PCI": "Pays: card numbers, international account numbers, wallets.",
    "CREDENTIALS": "Opens a system: passwords, keys, tokens, connection strings.",
    "FINANCIAL": "Names a bank account or the way to it.",
    "GOVERNMENT_ID": "A number that a state gave to a person.",
    "BIOMETRIC": "Measured from a body, such as a fingerprint.",
    "GENETIC": "Read from a genome.",
    "NPI": "Known inside a company and not to the market.",
    "LOCATION": "Says where a person or device is.",
    "MINOR": "About a child.",
}
TAGS = list(TAG_DESCRIPTIONS)
DEFAULT_TAG = "PII"

# Entity types of each tag (46 in all).
TAG_ENTITIES = {
    "PII": ["PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "DATE_TIME", "USERNAME", "EMPLOYEE_ID", "CUSTOMER_ID", "GENDER", "NATIONALITY", "RELIGION", "RACE_ETHNICITY"],
    "GOVERNMENT_ID": ["US_SSN", "NIN", "SIN", "AU_TFN", "US_ITIN", "PASSPORT", "DRIVER_LICENSE"],
    "LOCATION": ["LOCATION", "IP_ADDRESS"],
    "PHI": ["MEDICAL_RECORD", "HEALTH_INSURANCE", "MEDICAL_CONDITION", "MEDICATION", "NATIONAL_PROVIDER_ID", "DEA_NUMBER"],
    "BIOMETRIC": ["BIOMETRIC"],
    "GENETIC": ["GENETIC"],
    "PCI": ["CREDIT_CARD", "IBAN_CODE", "SWIFT_CODE", "CRYPTO_WALLET"],
    "FINANCIAL": ["BANK_ACCOUNT", "US_BANK_ROUTING"],
    "CREDENTIALS": ["PASSWORD", "API_KEY", "SECRET_KEY", "ACCESS_TOKEN", "PRIVATE_KEY", "JWT_TOKEN", "AWS_ACCESS_KEY", "CONNECTION_STRING"],
    "NPI": ["INSIDER_INFO", "EARNINGS_DATA", "MERGER_ACQUISITION"],
    "MINOR": ["MINOR_DATA"],
}
ENTITY_TAG = {entity: tag for tag, entities in TAG_ENTITIES.items() for entity in entities}

# When one tag must stand for a field, the first of these wins.
TAG_PRIORITY = [
    "PHI", "CREDENTIALS", "PCI", "FINANCIAL", "GOVERNMENT_ID", "BIOMETRIC",
    "GENETIC", "NPI", "PII", "LOCATION", "MINOR",
]

# Tags that alert, the alert floor and the tier floors.
ALERT_TAGS = ["PHI", "CREDENTIALS", "GOVERNMENT_ID", "GENETIC"]
ALERT_SCORE = 0.85
TIER_HIGH = 0.85
TIER_MEDIUM = 0.60


def literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def tag_of(entity: Column, extra: dict[str, str] | None = None) -> Column:
    """Tag of an entity type; unknown types fall back to PII."""
    return F.coalesce(
        F.try_element_at(literal_map({**ENTITY_TAG, **(extra or {})}), entity),
        F.lit(DEFAULT_TAG),
    )


def confidence_tier(score: Column) -> Column:
    return (
        F.when(score >= TIER_HIGH, "HIGH").when(score >= TIER_MEDIUM, "MEDIUM").otherwise("LOW")
    )


def primary_tag(tags: Column) -> Column:
    """The one tag that stands for a set of tags, by fixed priority (null if none)."""
    ranked = F.array(*[F.lit(t) for t in TAG_PRIORITY])
    return F.get(F.filter(ranked, lambda t: F.array_contains(tags, t)), F.lit(0))


def clamp_layer(max_layer: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(3), F.coalesce(max_layer, F.lit(3))))


def clamp_layer_value(max_layer: int | None) -> int:
    return 3 if max_layer is None else max(1, min(3, int(max_layer)))


def tag_definitions(spark: SparkSession) -> DataFrame:
    """One row per tag, as a catalog registers it."""
    rows = [(t, d, ["sr_field"], ["entity_types", "classified_by"]) for t, d in TAG_DESCRIPTIONS.items()]
    return spark.createDataFrame(
        rows,
        "name string, description string, entity_types array<string>, attributes array<string>",
    )
