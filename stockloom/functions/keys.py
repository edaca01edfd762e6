"""Normalisation keys as column expressions. Nearly every join and group of the engine uses one of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Word lists that the keys drop. They decide which records are the same and must stay as they are.
LEGAL_WORDS = r"\b(pte|ltd|limited|private|co|company)\b"
ITEM_FILLER = (
    r"\b(?:the|a|an|supply|install|installation|dismantle|dismantled|dismantling|dismount|dismounted|dismounting|"
    r"commissioning|service|services|labour|labor|with|for|in pair|pair)\b"
)
ITEM_UNITS = r"\b\d+(?:\.\d+)?\s*(?:mm|cm|inch|inches|lumens?|ansi|hz|khz|mhz|ghz|w|kw)\b"
EVIDENCE_FILLER = r"\b(?:supply|with|including|the|a|an|pcs?|piece|set)\b"
CONFUSABLE_FROM, CONFUSABLE_TO = "ILOSB", "11058"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def present(x: str | Column) -> Column:
    """Trimmed text, null for blank: the engine has one kind of missing."""
    t = F.trim(_c(x).cast("string"))
    return F.when(t != "", t)


def clean(x: str | Column) -> Column:
    """No-break spaces are spaces, runs of spaces and tabs one space, ends trimmed; null is empty."""
    plain = F.replace(F.coalesce(_c(x).cast("string"), F.lit("")), F.lit(" "), F.lit(" "))
    return F.trim(F.regexp_replace(plain, r"[\t ]{2,}|\t", " "))  # a single space stays what it is, so most texts match nothing


def norm(x: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_c(x).cast("string"), F.lit(""))), "[^a-z0-9]+", " "))


def compact(x: str | Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(_c(x).cast("string"), F.lit(""))), "[^A-Z0-9]+", "")


def supplier_key(x: str | Column) -> Column:
    bare = F.regexp_replace(F.lower(F.coalesce(_c(x).cast("string"), F.lit(""))), LEGAL_WORDS, " ")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, "  +", " "))


def normalized_item_identity(x: str | Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(norm(x), ITEM_FILLER, " "), ITEM_UNITS, " ")
    return squeeze(bare)


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no built-in for it. Only where text is not plain ASCII is it needed."""
    return s.str.normalize("NFKC")


def unicode_plain(x: str | Column) -> Column:
    """NFKC form. ASCII text is its own form."""
    return nfkc(_c(x))


def standard_item_name_key(x: str | Column, ascii_only: bool = False) -> Column:
    """Lower case, & spelled out, other marks one space. ascii_only: the caller knows the text is ASCII, and no Python runs."""
    t = clean(x) if ascii_only else unicode_plain(clean(x))
    return F.trim(F.regexp_replace(F.replace(F.lower(t), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def brand_key(x: str | Column) -> Column:
    """Upper case first, then anything but letters and digits goes: `Remaco` and `Rode` stay apart."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.upper(clean(x)), r"\b(PTE|LTD|LIMITED|PRIVATE|CO|COMPANY|INC|CORP|CORPORATION)\b", " "), "[^A-Z0-9]+", " "))


def canonical_identity(brand: str | Column, model: str | Column) -> Column:
    """BRAND::MODEL, null unless both are known."""
    b, m = compact(brand), compact(model)
    return F.when((b != "") & (m != ""), F.concat_ws("::", b, m))


def ocr_skeleton(x: str | Column) -> Column:
    return F.translate(compact(x), CONFUSABLE_FROM, CONFUSABLE_TO)


def evidence_identity_key(sku: str | Column, name: str | Column) -> Column:
    s = F.replace(norm(sku), F.lit(" "), F.lit(""))
    n = squeeze(F.regexp_replace(norm(name), EVIDENCE_FILLER, " "))
    return F.when(s != "", F.concat(F.lit("sku:"), s)).when(n != "", F.concat(F.lit("name:"), n)).otherwise(F.lit(""))


def row_ledger_key(row_id: str | Column, sku: str | Column, name: str | Column, q: Column, p: Column, a: Column) -> Column:
    """Row id if printed, else sku with economics, else the first 90 characters of the description with economics."""
    money = F.concat_ws("|", F.concat(F.lit("q:"), _number(q)), F.concat(F.lit("p:"), _number(p)), F.concat(F.lit("a:"), _number(a)))
    s = F.replace(norm(sku), F.lit(" "), F.lit(""))
    n = F.substring(squeeze(F.regexp_replace(norm(name), EVIDENCE_FILLER, " ")), 1, 90)
    return (
        F.when(present(row_id).isNotNull(), F.concat(F.lit("row:"), present(row_id)))
        .when(s != "", F.concat_ws("|", F.concat(F.lit("sku:"), s), money))
        .when(n != "", F.concat_ws("|", F.concat(F.lit("desc:"), n), money))
        .otherwise(F.lit(""))
    )


def _number(x: Column) -> Column:
    """Exact decimal text, so that equal amounts have equal keys in every engine; null is empty."""
    return F.coalesce(x.cast("decimal(18,2)").cast("string"), F.lit(""))


def line_signature(sku, name, q, p, a, serials) -> Column:
    who = F.when(compact(sku) != "", compact(sku)).otherwise(normalized_item_identity(name))
    listed = F.array_join(F.array_sort(F.coalesce(_c(serials), F.array().cast("array<string>"))), ",")
    four = lambda x: F.coalesce(_c(x).cast("decimal(18,4)").cast("string"), F.lit(""))
    return F.when(who == "", F.lit("")).otherwise(F.concat_ws("|", who, four(q), four(p), four(a), listed))


def slug(x: str | Column) -> Column:
    return F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", "-")


def health_issue_key(kind: str | Column, entity: str | Column, entity_id: str | Column) -> Column:
    return F.concat_ws(":", slug(kind), F.lower(_c(entity)), F.lower(_c(entity_id).cast("string")))


def standard_file_name(date: str | Column, supplier: str | Column, number: str | Column) -> Column:
    """date_supplier_invoice.pdf; blank parts are left out."""
    part = lambda x: F.trim(F.regexp_replace(clean(x), r"[^A-Za-z0-9.-]+", "-"), F.lit("-"))
    bare = F.regexp_replace(clean(supplier), r"(?i)\b(pte|ltd|limited|private|co|company)\b\.?", " ")
    parts = F.filter(F.array(_c(date).cast("string"), part(bare), part(number)), lambda v: F.coalesce(v, F.lit("")) != "")
    return F.concat(F.array_join(parts, "_"), F.lit(".pdf"))
