"""Masking, detection and encryption of personal data as column expressions."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

from rosterflow import constants as C
from rosterflow.functions.text import is_blank

# What personal data looks like in free text.
ID_CARD_TEXT = r"(?<![0-9])([1-9]\d{2})\d{11}(\d{3}[0-9Xx])(?![0-9])"
PHONE_TEXT = r"(?<![0-9])(1[3-9]\d)\d{4}(\d{4})(?![0-9])"
EMAIL_LOCAL, EMAIL_DOMAIN = r"[a-zA-Z0-9._%+-]", r"[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
BANK_CARD_TEXT = r"(?<![0-9])([62]\d{3})\d{%d}(\d{4})(?![0-9])"
BANK_CARD_LENGTHS = range(15, 20)

# Placeholder rules in order (placeholder, pattern).
PLACEHOLDER_RULES = [
    ("[CARD]", r"(?<!\w)\d{16,17}(?!\w)|(?<!\w)\d{19}(?!\w)"),
    ("[ID]", r"\d{17}[\dXx]"),
    ("[PHONE]", r"1[3-9]\d{9}"),
    ("[STUDENT_NO]", r"STU\d+|(?<!\w)\d{8}(?!\w)"),
]


def _stars(count: Column) -> Column:
    return F.repeat(F.lit("*"), count.cast("int"))


def _all_stars(col: Column) -> Column:
    return _stars(F.length(col))


def _keep_ends(col: Column, head: int, tail: int) -> Column:
    size = F.length(col)
    kept = F.concat(F.left(col, F.lit(head)), _stars(size - head - tail), F.right(col, F.lit(tail)))
    return F.when(size < 9, _all_stars(col)).otherwise(kept)


def mask_id_card(col: Column) -> Column:
    return _keep_ends(col, 3, 4)


def mask_phone(col: Column) -> Column:
    return _keep_ends(col, 3, 4)


def mask_bank_card(col: Column) -> Column:
    return _keep_ends(col, 4, 4)


def mask_name(col: Column) -> Column:
    size = F.length(col)
    return (
        F.when(size == 0, col)
        .when(size == 1, F.lit("*"))
        .when(size == 2, F.concat(F.left(col, F.lit(1)), F.lit("*")))
        .otherwise(F.concat(F.left(col, F.lit(1)), _stars(size - 2), F.right(col, F.lit(1))))
    )


def mask_email(col: Column) -> Column:
    at, size = F.instr(col, "@"), F.length(col)
    domain = F.substr(col, at)
    return (
        F.when(is_blank(col), col)
        .when((at <= 1) | (at == size), _all_stars(col))
        .when(at == 2, F.concat(F.lit("*"), domain))
        .otherwise(F.concat(F.left(col, F.lit(1)), F.lit("***"), domain))
    )


def mask_address(col: Column) -> Column:
    """Cut after the furthest of the first district suffixes; short or uncut texts keep six characters."""
    ends = [
        F.when(F.instr(col, s) > 0, F.instr(col, s) + len(s) - 1).otherwise(F.lit(0))
        for s in C.DISTRICT_SUFFIXES
    ]
    cut, size = F.greatest(*ends), F.length(col)
    return (
        F.when(is_blank(col), col)
        .when((cut > 0) & (cut < size), F.concat(F.left(col, cut), F.lit("***")))
        .when(size > 6, F.concat(F.left(col, F.lit(6)), F.lit("***")))
        .otherwise(_all_stars(col))
    )


MASKS = {
    "ID_CARD": mask_id_card,
    "PHONE": mask_phone,
    "NAME": mask_name,
    "EMAIL": mask_email,
    "ADDRESS": mask_address,
    "BANK_CARD": mask_bank_card,
}


def mask(col: Column, kind: Column) -> Column:
    """Mask by a kind column; null, blank and unknown kinds stay as they are."""
    masked = None
    for name, fn in MASKS.items():
        masked = F.when(kind == name, fn(col)) if masked is None else masked.when(kind == name, fn(col))
    return F.when(is_blank(col), col).otherwise(masked.otherwise(col))


def mask_fields(df, fields: dict[str, str]):
    """Mask whole columns of a table: ``fields`` maps column -> kind."""
    return df.withColumns({
        name: F.when(is_blank(F.col(name)), F.col(name)).otherwise(MASKS[kind](F.col(name)))
        for name, kind in fields.items()
    })


def mask_id_in_log(col: Column) -> Column:
    return F.regexp_replace(col, r"(\d{3})\d*(\d{4})", r"$1***********$2")


def sanitize(col: Column) -> Column:
    """Mask id cards, phones, e-mails and bank cards inside free text, in that order.

    Most texts hold neither a long number nor an @; a search for these decides which rules are tried at all.
    """
    def ids(text: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(text, ID_CARD_TEXT, "$1" + "*" * 11 + "$2"), PHONE_TEXT, "$1****$2")

    def mails(text: Column) -> Column:
        text = F.regexp_replace(text, f"({EMAIL_LOCAL}){EMAIL_LOCAL}+@({EMAIL_DOMAIN})", "$1***@$2")
        return F.regexp_replace(text, f"(?<!{EMAIL_LOCAL}){EMAIL_LOCAL}@({EMAIL_DOMAIN})", "*@$1")

    def cards(text: Column) -> Column:
        for size in BANK_CARD_LENGTHS:
            text = F.regexp_replace(text, BANK_CARD_TEXT % (size - 8), "$1" + "*" * (size - 8) + "$2")
        return text

    number, mail = col.rlike("[0-9]{11}"), col.contains("@")
    return (
        F.when(number & mail, cards(mails(ids(col)))).when(number, cards(ids(col))).when(mail, mails(col)).otherwise(col))


def contains_pii(col: Column) -> Column:
    bank = r"(?<![0-9])[62]\d{14,18}(?![0-9])"
    # A long number or an @ comes first: few texts go through the patterns.
    return F.coalesce(
        (col.rlike("[0-9]{11}") & (col.rlike(ID_CARD_TEXT) | col.rlike(PHONE_TEXT) | col.rlike(bank)))
        | (col.contains("@") & col.rlike(f"{EMAIL_LOCAL}@{EMAIL_DOMAIN}")),
        F.lit(False),
    )


def mask_placeholders(col: Column) -> Column:
    for placeholder, pattern in PLACEHOLDER_RULES:
        col = F.regexp_replace(col, pattern, placeholder)
    return col


def placeholder_matches(col: Column) -> Column:
    """Array of (rule, original, placeholder) found while the rules are applied one after the other."""
    def tagged(hits: Column, rule: int, placeholder: str) -> Column:
        return F.transform(hits, lambda hit: F.struct(
            F.lit(rule).alias("rule"), hit.alias("original"), F.lit(placeholder).alias("placeholder")))

    found = []
    for rule, (placeholder, pattern) in enumerate(PLACEHOLDER_RULES):
        found.append(tagged(F.regexp_extract_all(col, F.lit(pattern), F.lit(0)), rule, placeholder))
        col = F.regexp_replace(col, pattern, placeholder)
    return F.concat(*found)


def _mask_value(text: str, kind: str) -> str:
    """Row-side twin of :data:`MASKS`, for JSON whose shape is not known."""
    if not text.strip():
        return text
    size = len(text)
    if kind in ("ID_CARD", "PHONE", "BANK_CARD"):
        head = 4 if kind == "BANK_CARD" else 3
        return "*" * size if size < 9 else text[:head] + "*" * (size - head - 4) + text[-4:]
    if kind == "NAME":
        return "*" if size == 1 else text[0] + "*" * max(1, size - 2) + (text[-1] if size > 2 else "")
    if kind == "EMAIL":
        at = text.find("@")
        if at <= 0 or at == size - 1:
            return "*" * size
        return ("*" if at == 1 else text[0] + "***") + text[at:]
    cut = max((text.find(s) + len(s) if s in text else 0) for s in C.DISTRICT_SUFFIXES)
    if 0 < cut < size:
        return text[:cut] + "***"
    return text[:6] + "***" if size > 6 else "*" * size


class _Number(str):
    """A number as the document spells it."""


def _no_number(name: str):
    raise ValueError(f"{name} is not JSON")


def _masked_text(node, kind: DataType | None = None) -> str:
    """``kind``: the type that a schema gives the node; what it calls text is masked however the document spells it."""
    if isinstance(node, dict):
        kinds = {f.name: f.dataType for f in kind.fields} if isinstance(kind, StructType) else {}

        def masked(key, value):
            if key in C.PII_FIELDS and type(value) is str:
                return json.dumps(_mask_value(value, C.PII_FIELDS[key]), ensure_ascii=False)
            if key in C.PII_FIELDS and value is not None and isinstance(kinds.get(key), StringType):
                return json.dumps(_mask_value(_masked_text(value), C.PII_FIELDS[key]), ensure_ascii=False)
            return _masked_text(value, kinds.get(key))

        return "{" + ",".join(json.dumps(key, ensure_ascii=False) + ":" + masked(key, value) for key, value in node.items()) + "}"
    if isinstance(node, list):
        kind = kind.elementType if isinstance(kind, ArrayType) else None
        return "[" + ",".join(_masked_text(item, kind) for item in node) + "]"
    return str(node) if isinstance(node, _Number) else json.dumps(node, ensure_ascii=False)


def _mask_document(text: str | None, unreadable: str | None, kind: DataType | None = None) -> str | None:
    try:
        return _masked_text(json.loads(text, parse_float=_Number, parse_int=_Number, parse_constant=_no_number), kind)
    except (TypeError, ValueError, RecursionError):
        return unreadable


@F.pandas_udf(StringType())
def mask_json(documents: pd.Series) -> pd.Series:
    """Mask known fields anywhere in a JSON text of any shape; numbers keep their spelling.

    Text that is not JSON, or is nested too deeply to be read, stays as it is.  Where the shape is known,
    :func:`mask_json_as` does the same in Spark expressions.
    """
    return documents.map(lambda text: _mask_document(text, text))


def mask_json_as(col: Column, schema: StructType) -> Column:
    """Mask known fields of a JSON text of the given shape, in Spark expressions.

    A document that the schema does not give back as it was (further or null fields, other types, other spelling) is
    masked as by :func:`mask_json`, so that no field is lost; text that is not JSON stays as it is.
    """
    bad = "__unreadable"
    parsed = F.from_json(col, StructType([*schema.fields, StructField(bad, StringType())]), {
        "columnNameOfCorruptRecord": bad})

    def rebuilt(value: Column, kind: DataType, name: str | None = None) -> Column:
        if isinstance(kind, StructType):
            fields = [rebuilt(value[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields]
            return F.when(value.isNotNull(), F.struct(*fields))
        if isinstance(kind, ArrayType):
            return F.transform(value, lambda item: rebuilt(item, kind.elementType))
        if name in C.PII_FIELDS and isinstance(kind, StringType):
            return F.when(is_blank(value), value).otherwise(MASKS[C.PII_FIELDS[name]](value))
        return value

    @F.pandas_udf(StringType())
    def masked_whole(documents: pd.Series) -> pd.Series:
        return documents.map(lambda text: _mask_document(text, None, schema))

    readable = parsed.isNotNull() & parsed[bad].isNull()
    same = F.coalesce(readable & (F.to_json(parsed, {"ignoreNullFields": "true"}) == col), F.lit(False))
    masked = F.when(readable, F.to_json(rebuilt(parsed, schema)))
    # Python sees only the documents that are not the same; those it cannot read are masked as far as Spark reads them.
    return F.when(same, masked).otherwise(F.coalesce(masked_whole(F.when(~same, col)), masked, col))


def mask_params(params: Column) -> Column:
    """Audit copy of call parameters: only the end of a student id stays readable."""
    def hide(value: Column) -> Column:
        return F.when(
            F.length(value) > 4, F.concat(F.lit("****"), F.right(value, F.lit(4)))
        ).otherwise(F.lit("****"))

    return F.coalesce(
        F.transform_values(
            params, lambda k, v: F.when((k == "student_id") & v.isNotNull(), hide(v)).otherwise(v)),
        F.create_map().cast("map<string,string>"),
    )


def forbidden_claims(claims: Column) -> Column:
    """True when a claims map holds a personal field."""
    names = F.array(*[F.lit(name) for name in C.FORBIDDEN_CLAIMS])
    return F.coalesce(F.arrays_overlap(F.map_keys(claims), names), F.lit(False))


def encrypt(col: Column, key: Column) -> Column:
    """Base64 of IV, cipher text and tag (AES-256-GCM, random IV); null stays null."""
    return F.base64(F.aes_encrypt(col, key, F.lit("GCM")))


def decrypt(col: Column, keys: Sequence[Column]) -> Column:
    """First key that opens the value; null when none does (quarantine those rows)."""
    raw = F.unbase64(col)
    return F.coalesce(*[F.try_aes_decrypt(raw, key, F.lit("GCM")).cast("string") for key in keys])
