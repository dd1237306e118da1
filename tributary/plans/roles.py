"""What a column means, and what follows from it: features, blocking keys, comparisons.

A role's entries are made from a few families of columns that are handled alike (names, codes,
dates, amounts ...); a role then only says which family it is of and what it weighs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..operators.features import Feature
from ..operators.scoring import Comparison, Test


@dataclass(frozen=True)
class Family:
    """features: suffix -> function. key: suffix of the feature that blocks, or '' for the column,
    or None. tests: (method, suffix of the compared feature, share of the role's weight, parameters).
    guard: the kind of placeholders that the features don't see, so that none blocks or matches."""

    features: dict[str, str]
    key: str | None
    tests: tuple[tuple[str, str, float, dict], ...]
    guard: str = ""


def _code(function: str) -> Family:
    return Family({"clean": function}, "clean", (("exact", "clean", 1.0, {}),))


FAMILIES = {
    "name": Family({"clean": "name_clean", "soundex": "soundex"}, "soundex", (("exact", "clean", 1.0, {}), ("jaro_winkler", "clean", 0.7, {"threshold": 0.88})), "name"),
    "full_name": Family({"clean": "name_clean", "soundex": "soundex", "sorted": "sorted_name_tokens"}, "sorted", (("exact", "sorted", 1.0, {}), ("jaro_winkler", "clean", 0.8, {"threshold": 0.88})), "name"),
    "business": Family({"core": "business_core_name", "fp": "sorted_name_fingerprint"}, "fp", (("exact", "core", 1.0, {}), ("token_set_match", "core", 0.6, {}))),
    "email": Family({"clean": "lower_trim", "domain": "email_domain", "local": "email_local_part"}, "clean", (("exact", "clean", 1.0, {}), ("exact", "domain", 0.1, {})), "email"),
    "phone": Family({"std": "phone_standardize", "last4": "phone_last_four"}, "std", (("exact", "std", 1.0, {}),), "phone"),
    "address": Family({"std": "address_standardize", "number": "extract_street_number"}, "number", (("levenshtein", "std", 1.0, {"max_distance": 3}),), "address"),
    "place": Family({"clean": "name_clean"}, None, (("exact", "clean", 1.0, {}),)),
    "zip": Family({"zip5": "zip5", "zip3": "zip3"}, "zip5", (("exact", "zip5", 1.0, {}),)),
    "date": Family({"year": "year_of_date"}, "year", (("exact", "", 1.0, {}),)),
    "amount": Family({"bucket": "amount_bucket"}, "bucket", (("numeric_percent_diff", "", 1.0, {"tolerance": 5.0}),)),
    "number": Family({}, None, (("numeric_within", "", 1.0, {}),)),
    "word": Family({"clean": "upper_trim"}, None, (("exact", "clean", 1.0, {}),)),
    "text": Family({"clean": "normalize_whitespace"}, None, (("token_set_match", "clean", 1.0, {}),)),
    "latitude": Family({}, None, ()),
    "ssn": _code("ssn_clean"), "vin": _code("vin_normalize"), "policy": _code("policy_number_clean"), "iban": _code("iban_normalize"),
    "digits": _code("routing_number_clean"), "account": _code("account_number_clean"), "npi": _code("npi_validate"), "dea": _code("dea_number_clean"),
    "mrn": _code("mrn_clean"), "icd": _code("icd_code_normalize"), "ein": _code("ein_format"), "duns": _code("duns_clean"),
    "ticker": _code("ticker_normalize"), "cusip": _code("cusip_clean"), "license": _code("license_number_clean"), "code": _code("upper_trim"),
}

#: family and weight of every role.
ROLES: dict[str, tuple[str, float]] = {
    "first_name": ("name", 3.0), "last_name": ("name", 3.0), "middle_name": ("name", 1.0), "full_name": ("full_name", 4.0), "suffix": ("word", 0.5),
    "gender": ("word", 0.5), "date_of_birth": ("date", 4.0), "email": ("email", 5.0), "phone": ("phone", 4.0), "ssn": ("ssn", 8.0),
    "address_line_1": ("address", 2.0), "address_line_2": ("word", 0.5), "city": ("place", 1.0), "state": ("word", 0.5), "zip_code": ("zip", 1.5), "country": ("word", 0.3),
    "latitude": ("latitude", 0.0), "longitude": ("latitude", 0.0), "company_name": ("business", 4.0), "dba_name": ("business", 3.0), "website": ("code", 3.0), "industry": ("word", 0.5),
    "ein": ("ein", 8.0), "duns": ("duns", 8.0), "license_number": ("license", 6.0), "npi": ("npi", 8.0), "dea_number": ("dea", 7.0), "mrn": ("mrn", 7.0), "icd_code": ("icd", 1.0),
    "provider_name": ("full_name", 3.0), "diagnosis_date": ("date", 1.0), "policy_number": ("policy", 7.0), "claim_number": ("policy", 7.0), "date_of_loss": ("date", 2.0),
    "effective_date": ("date", 1.0), "expiration_date": ("date", 1.0), "premium": ("amount", 1.0), "vin": ("vin", 9.0), "license_plate": ("license", 5.0), "make": ("word", 0.8), "model": ("word", 0.8),
    "year": ("number", 0.8), "color": ("word", 0.3), "account_number": ("account", 7.0), "routing_number": ("digits", 2.0), "iban": ("iban", 8.0), "swift": ("code", 2.0), "ticker": ("ticker", 5.0),
    "cusip": ("cusip", 8.0), "isin": ("code", 8.0), "amount": ("amount", 1.0), "currency": ("word", 0.3), "transaction_date": ("date", 1.0), "product_name": ("text", 4.0), "brand": ("word", 1.5),
    "category": ("word", 0.5), "description": ("text", 1.0), "sku": ("code", 6.0), "upc": ("digits", 8.0), "price": ("amount", 1.0), "seller_name": ("business", 1.0), "parcel_number": ("license", 7.0),
    "property_type": ("word", 0.5), "employee_id": ("code", 7.0), "job_title": ("text", 0.7), "customer_id": ("code", 7.0), "student_id": ("code", 7.0),
    "subscriber_id": ("code", 7.0), "imsi": ("digits", 8.0), "imei": ("digits", 8.0), "msisdn": ("digits", 6.0), "service_point_id": ("code", 6.0), "meter_id": ("code", 6.0),
    "mc_dot_number": ("digits", 7.0), "carrier_scac": ("code", 6.0), "loyalty_id": ("code", 7.0), "device_fingerprint_id": ("code", 4.0), "payment_token_id": ("code", 5.0),
    "mls_id": ("code", 7.0), "deed_reference": ("code", 7.0), "passport": ("code", 8.0), "national_id": ("code", 8.0), "voter_registration": ("code", 7.0), "case_number": ("code", 5.0),
    "enrollment_id": ("code", 7.0), "institution_code": ("code", 1.0), "guest_id": ("code", 7.0), "booking_reference": ("code", 5.0), "vendor_id": ("code", 7.0), "cage_code": ("code", 7.0), "sam_uei": ("code", 8.0),
}

#: Other spellings of a role in column names. CamelCase is taken apart first.
SPELLINGS: dict[str, str] = {
    "first_name": "fname given_name firstname forename", "last_name": "lname surname family_name lastname", "middle_name": "mname", "full_name": "name person_name",
    "date_of_birth": "dob birth_date birthday birthdate", "email": "email_address mail", "phone": "phone_number mobile cell_phone telephone tel", "ssn": "social_security tin",
    "address_line_1": "address street street_address addr1", "address_line_2": "addr2 unit", "city": "address_locality town", "state": "province address_region", "zip_code": "zip postal_code postcode",
    "country": "address_country", "latitude": "lat", "longitude": "lon lng", "company_name": "company business_name organization org_name legal_name", "dba_name": "dba trade_name", "website": "url domain",
    "ein": "tax_id fein", "duns": "duns_number", "license_number": "license_no", "npi": "npi_number", "dea_number": "dea", "mrn": "medical_record_number patient_id", "icd_code": "icd icd10",
    "policy_number": "policy policy_no", "claim_number": "claim claim_no", "date_of_loss": "loss_date", "vin": "vehicle_identification_number", "license_plate": "plate", "account_number": "account acct",
    "routing_number": "routing aba", "swift": "bic", "amount": "total balance", "product_name": "product title item_name", "brand": "manufacturer", "upc": "gtin ean barcode", "seller_name": "seller vendor",
    "parcel_number": "apn parcel", "job_title": "position", "employee_id": "emp_id", "customer_id": "cust_id", "student_id": "pupil_id", "price": "list_price",
}


def _names() -> dict[str, str]:
    out = {role: role for role in ROLES}
    for role, words in SPELLINGS.items():
        for w in words.split():
            out.setdefault(w, role)
    return out


NAMES = _names()


def detect_role(column: str) -> str | None:
    """The role that a column's name tells: the whole name, or the longest known name among its parts."""
    name = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", column.strip()).lower()
    if name in NAMES:
        return NAMES[name]
    parts = name.split("_")
    for size in range(len(parts), 0, -1):
        for i in range(len(parts) - size + 1):
            if (known := "_".join(parts[i : i + size])) in NAMES:
                return NAMES[known]
    return None


def features_for(column: str, role: str) -> list[Feature]:
    family, out, source = FAMILIES[ROLES[role][0]], [], column
    if family.guard:
        source = f"{column}_safe"
        out = [Feature(f"{column}_is_placeholder", f"is_placeholder_{family.guard}", (column,)), Feature(source, f"nullify_placeholder_{family.guard}", (column,))]
    return out + [Feature(f"{column}_{suffix}", f, (source,)) for suffix, f in family.features.items()]


def blocking_key_for(column: str, role: str) -> str | None:
    key = FAMILIES[ROLES[role][0]].key
    return None if key is None else f"{column}_{key}" if key else column


def comparisons_for(column: str, role: str) -> list[Comparison]:
    family, weight = ROLES[role]
    out = []
    for method, suffix, share, params in FAMILIES[family].tests:
        out.append(Comparison(Test(f"{column}_{suffix}" if suffix else column, method=method, params=params), weight=weight * share))
    return out


@dataclass(frozen=True)
class EntityType:
    """Roles that records of a type should have, on top of those of its parent."""

    name: str
    roles: tuple[str, ...]
    parent: str | None = None
    aliases: tuple[str, ...] = ()


#: name: parent, aliases, roles.
_TYPES = {
    "Thing": (None, "", "full_name description website"),
    "Person": ("Thing", "Individual Human", "first_name last_name middle_name date_of_birth email phone gender ssn address_line_1 city state zip_code"),
    "Patient": ("Person", "", "mrn icd_code"),
    "Physician": ("Person", "Provider Doctor", "npi dea_number license_number"),
    "Employee": ("Person", "", "employee_id job_title"),
    "Student": ("Person", "", "student_id"),
    "Customer": ("Person", "Consumer", "customer_id"),
    "Organization": ("Thing", "Org", "company_name dba_name ein duns phone address_line_1 city state zip_code"),
    "Corporation": ("Organization", "Company Business", "ticker industry"),
    "LocalBusiness": ("Organization", "Store", "latitude longitude"),
    "MedicalOrganization": ("Organization", "Hospital", "npi"),
    "FinancialInstitution": ("Organization", "Bank", "routing_number swift"),
    "Product": ("Thing", "Item", "product_name brand category sku upc price"),
    "Vehicle": ("Product", "Car", "vin license_plate make model year color"),
    "Place": ("Thing", "Location", "address_line_1 city state zip_code latitude longitude"),
    "RealEstate": ("Place", "Property", "parcel_number property_type"),
    "InsurancePolicy": ("Thing", "Policy", "policy_number effective_date expiration_date premium"),
    "InsuranceClaim": ("InsurancePolicy", "Claim", "claim_number date_of_loss amount"),
    "FinancialAccount": ("Thing", "BankAccount Account", "account_number routing_number iban currency"),
}
ENTITY_TYPES = {n: EntityType(n, tuple(r.split()), p, tuple(a.split())) for n, (p, a, r) in _TYPES.items()}


def register_entity_type(t: EntityType) -> None:
    if t.parent and t.parent not in ENTITY_TYPES:
        raise ValueError(f"entity type {t.name!r} has an unknown parent {t.parent!r}")
    ENTITY_TYPES[t.name] = t


def entity_type(name: str) -> EntityType:
    for t in ENTITY_TYPES.values():
        if name.lower() in (t.name.lower(), *(a.lower() for a in t.aliases)):
            return t
    raise KeyError(f"unknown entity type {name!r}")


def roles_of(name: str) -> tuple[str, ...]:
    """The roles of a type and of all its parents, its own first."""
    t: EntityType | None = entity_type(name)
    out: dict[str, None] = {}
    while t:
        out.update(dict.fromkeys(t.roles))
        t = ENTITY_TYPES[t.parent] if t.parent else None
    return tuple(out)
