"""Types of entity and their properties, as small tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Schema, its parent, and whether entities of it are compared. Fixed values.
SCHEMATA: dict[str, tuple[str | None, bool]] = {
    "Thing": (None, False),
    "LegalEntity": ("Thing", True),
    "Person": ("LegalEntity", True),
    "Organization": ("LegalEntity", True),
    "Company": ("Organization", True),
    "PublicBody": ("Organization", True),
    "Address": ("Thing", True),
    "Position": ("Thing", True),
    "Vehicle": ("Thing", True),
    "Vessel": ("Vehicle", True),
    "Security": ("Thing", True),
    "RealEstate": ("Thing", True),
    "CryptoWallet": ("Thing", True),
    "Document": ("Thing", False),
    "Payment": (None, False),
    "Family": (None, False),
    "Associate": (None, False),
    "Occupancy": (None, False),
}


@dataclass(frozen=True)
class Property:
    """A property: its type, whether it is evidence, the format of identifiers, and the name of the way back."""

    type: str
    matchable: bool = True
    format: str | None = None
    reverse: str | None = None


#: Properties by name. Fixed values.
PROPERTIES: dict[str, Property] = {
    "name": Property("name"),
    "alias": Property("name"),
    "weakAlias": Property("name", False),
    "lastName": Property("name", False),
    "firstName": Property("name", False),
    "namesMentioned": Property("name", False),
    "country": Property("country"),
    "jurisdiction": Property("country"),
    "birthDate": Property("date"),
    "incorporationDate": Property("date"),
    "date": Property("date", False),
    "birthPlace": Property("string"),
    "street": Property("string", False),
    "city": Property("string", False),
    "legalForm": Property("string", False),
    "purpose": Property("text", False),
    "programme": Property("string", False),
    "currency": Property("string", False),
    "notes": Property("text"),
    "address": Property("address"),
    "full": Property("address"),
    "phone": Property("phone"),
    "email": Property("email"),
    "gender": Property("gender", False),
    "topics": Property("topic", False),
    "sourceUrl": Property("url", False),
    "registrationNumber": Property("identifier"),
    "taxNumber": Property("identifier"),
    "idNumber": Property("identifier"),
    "publicationNumber": Property("identifier", False),
    "leiCode": Property("identifier", format="lei"),
    "swiftBic": Property("identifier", format="bic"),
    "innCode": Property("identifier", format="inn"),
    "ogrnCode": Property("identifier", format="ogrn"),
    "isin": Property("identifier", format="isin"),
    "imoNumber": Property("identifier", format="imo"),
    "uniqueEntityId": Property("identifier", format="uei"),
    "npiCode": Property("identifier", format="npi"),
    "publicKey": Property("identifier", False),
    "amountEur": Property("number", False),
    "payer": Property("entity", False, reverse="paymentPayer"),
    "beneficiary": Property("entity", False, reverse="paymentBeneficiary"),
    "addressEntity": Property("entity", False, reverse="addressOf"),
}


def ancestors(schema: str) -> list[str]:
    """The schema and all it is a kind of, nearest first; an unknown schema has none."""
    found: list[str] = []
    at: str | None = schema if schema in SCHEMATA else None
    while at is not None:
        found.append(at)
        at = SCHEMATA[at][0]
    return found


def can_match(left: str, right: str) -> bool:
    """Both are compared, and one is the other or a kind of it."""
    both = SCHEMATA.get(left, (None, False))[1] and SCHEMATA.get(right, (None, False))[1]
    return bool(both) and (left in ancestors(right) or right in ancestors(left))


def matchable() -> list[str]:
    return [name for name, (_, compared) in SCHEMATA.items() if compared]


def schema_pairs(spark: SparkSession) -> DataFrame:
    """(left, right): compatible schemata, in both orders."""
    rows = [(a, b) for a in SCHEMATA for b in SCHEMATA if can_match(a, b)]
    return spark.createDataFrame(rows, "left string, right string")


def schema_kinds(spark: SparkSession) -> DataFrame:
    """(schema, ancestor, depth): the closure of being a kind of."""
    return spark.createDataFrame([(s, a, d) for s in SCHEMATA for d, a in enumerate(ancestors(s))], "schema string, ancestor string, depth int")


def properties(spark: SparkSession) -> DataFrame:
    """(prop, type, matchable, format, reverse)."""
    rows = [(n, p.type, p.matchable, p.format, p.reverse) for n, p in PROPERTIES.items()]
    return spark.createDataFrame(rows, "prop string, type string, matchable boolean, format string, reverse string")


def props_of_type(kind: str, *, only_matchable: bool = False) -> list[str]:
    return [n for n, p in PROPERTIES.items() if p.type == kind and (p.matchable or not only_matchable)]
