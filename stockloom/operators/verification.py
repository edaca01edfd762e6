"""What may be saved unseen: is a row equipment, is it proven in its document, do independent readings and the web agree."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.economics import econ_ok
from ..functions.keys import clean, compact, norm, squeeze
from ..sources.cut import cut
from .matching import best_of_second, pair_readings  # noqa: F401  beside each other
from .parsers import once, spelled, word_runs

# Words and forms that decide the verdicts, matched without case.
EQUIPMENT = r"\b(?:projectors?|microphones?|mics?|speakers?|loudspeakers?|controllers?|control panels?|keypads?|cameras?|mixers?|displays?|monitors?|transmitters?|receivers?|screens?|wireless systems?|amplifiers?|pre\s*amplifiers?|preamplifiers?|processors?|switchers?|visualizers?|document cameras?|consoles?|players?|receptacles?|audio testers?|signal testers?|testers?|analyzers?|analysers?|meters?|dsp|video processors?|matrix|scalers?|nvr|dvr|network video recorders?|digital video recorders?)\b"
SERVICE = r"\b(?:install(?:ation|ing|ed)?|labou?r|professional services?|commission(?:ing|ed)?|test(?:ing|ed)?|programming|dismantl(?:e|ing|ed)|dismount(?:ing|ed)?|transport|delivery(?: fee| charge| service)?|return trip|redelivery|courier|freight|service charge|repair(?:ing|ed| service| work)?|remove|removal|relocat(?:e|ion|ing)|re-?instat(?:e|ement|ing)|system tuning|calibration|training|consultancy|consulting|manpower|on[- ]?site support|setup|configuration)\b"
SERVICE_ACTION = r"\b(?:install(?:ation|ing|ed)?|dismantl(?:e|ing|ed)|dismount(?:ing|ed)?|repair(?:ing|ed)?|remove|removal|relocat(?:e|ion|ing)|re-?instat(?:e|ement|ing)|test(?:ing|ed)?|commission(?:ing|ed)?|programming|setup|configuration)\b"
SERVICE_SKU = r"^(?:INSTALL(?:ATION)?|LABOU?R|SERVICE|REPAIR|DELIVERY|FREIGHT|TRANSPORT|COURIER|DISMOUNT|DISMANTL|REMOV|RELOCAT|REINSTAT|TEST|COMMISSION|PROGRAM)"
SERVICE_START = r"^(?:installation|installing|installed|labou?r|professional services?|services?|repair|delivery|freight|transport|courier|commissioning|testing|programming|dismantle|dismantling|dismount|dismounting|remove|removal|relocate|relocation|reinstate|reinstatement|setup|configuration)\b"
SUPPLIED = r"^\s*supply\s*(?:&|and)?\s*install\b"
ACCESSORY = r"\b(?:security lock|kensington lock|safety (?:wire|cable)|cables?|cabling|wires?|wiring|cords?|patch leads?|connectors?|accessories?|brackets?|mounts?|lamp kits?|lampkits?|replacement projector lamp|projector lamp|carts?|trolleys?|power adapt(?:er|or)s?|ac adapt(?:er|or)s?)\b"
MICROPHONE_STAND = r"\b(?:microphone|mic)\s+stands?\b"
WARRANTY = r"\b(?:warranty|extended warranty|support coverage|maintenance coverage|service contract)\b"
WARRANTY_START = r"^(?:warranty|extended\s+warranty|support\s+coverage|support\s+plan|maintenance\s+plan|service\s+contract|subscription)\b"
HEADER_WORDS = r"\b(?:invoice\s*(?:no|number|date)?|tax invoice|customer(?: code|copy)?|sold to|bill to|ship to|delivered to|attention|attn\.?|terms|salesman|reference\s*(?:no|number)?|ref\.?\s*(?:no|number)?|p\/?o\s*(?:no|number)?|purchase order|delivery order|quotation|gst\s*(?:reg|registration)|uen|company\s*(?:reg|registration)|co\.?\s*reg|telephone|tel\.?|fax\.?|e-?mail|email|website|www\.|postal(?: code)?|amount due|sub\s*total|subtotal|grand total|total amount|page\s+\d+)\b"
COMPANY = r"\b(?:pte\.?\s*ltd\.?|private limited|limited|ltd\.?|llp|llc|inc\.?|corporation|corp\.?)\b"
ADDRESS = r"(?:\b(?:blk|block)\s*\d+[a-z]?\b|#\s*\d{1,3}\s*[-/]\s*\d{1,5}\b|\bsingapore\s*\d{5,6}\b|\b\d{1,4}\s*[a-z][a-z0-9 .'-]{1,55}\s*(?:road|rd\.?|street|st\.?|avenue|ave\.?|drive|lane|crescent|close|way|walk|place|plaza|boulevard|terrace|industrial\s+park)\b)"
DATE_LABEL = r"\b(?:invoice\s+date|date\s+of\s+invoice|document\s+date|delivery\s+date|date)\s*[:#.-]"
DATE_VALUE = r"^(?:\d{1,2}[/.-]\d{1,2}[/.-](?:\d{2}|\d{4})|\d{4}[/.-]\d{1,2}[/.-]\d{1,2}|\d{1,2}\s+(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\s+\d{2,4})$"
MODEL = r"^[A-Z0-9][A-Z0-9+._/-]{2,31}$"
PRICE = r"\d[\d,]*\.\d{2}"
SMALL_WORDS = ("the", "and", "with", "for", "from", "into", "supply", "including", "include", "set", "pcs", "piece", "unit", "units", "each")
HEADER_KINDS = ("supplier", "invoice-number", "reference-number", "delivery-order-number", "invoice-date")
# What becomes of a row, by its normalised words; the first that matches decides.
DISPOSITIONS: tuple[tuple[str, str], ...] = (
    ("warranty", r"\b(?:warranty|extended warranty|support coverage|maintenance coverage)\b"),
    ("service", r"\b(?:installation|labour|labor|commissioning|testing|programming|dismantle|dismount|transport|delivery fee|service charge|repair service)\b"),
    ("accessory", r"\b(?:cable|wire|bracket|mount|lamp kit|cart|trolley|generic stand|power adaptor|adapter)\b"),
)
NOTE = r"\b(?:serial|s n|shipment no|remarks?|notes?)\b"
ASSET = r"\b(?:projector|microphone|speaker|controller|control panel|keypad|camera|mixer|display|monitor|transmitter|receiver|screen|wireless system|amplifier|processor|switcher|visualizer|document camera|console|player)\b"
GIVEN = ("equipment", "service", "accessory", "warranty", "metadata")
FIELDS = ("sku", "quantity", "unit_price", "amount", "serials")


def by_letter(pattern: str) -> str:
    """\\b(?:word|word|...)\\b with its words gathered by their first letter, behind a look at that letter; matches the same texts. At most places of a
    text no word begins, or none with that letter, and there one look replaces one for each word. Other patterns stay as they are."""
    listed = re.fullmatch(r"(\\b|\^)\(\?:(.*)\)(\\b)?", pattern)
    if not listed:
        return pattern
    words, depth = [""], 0
    for part in re.findall(r"\\.|\[[^\]]*\]|.", listed[2]):
        depth += (part == "(") - (part == ")")
        if depth < 0:
            return pattern
        if part == "|" and not depth:
            words.append("")
        else:
            words[-1] += part
    if not all(re.match(r"[a-z](?![?*+{])", w) for w in words):
        return pattern
    letters = sorted({w[0] for w in words})
    rest = "|".join(f"{c}(?:" + "|".join(w[1:] for w in words if w[0] == c) + ")" for c in letters)
    return f"{listed[1]}(?=[{''.join(letters)}])(?:{rest}){listed[3] or ''}"


def has(text: Column, pattern: str) -> Column:
    """Whether text, in lower case already, holds a pattern; faster than a match without case."""
    return text.rlike(by_letter(pattern.lower()))


def row_text(sku: Column, name: Column) -> Column:
    return squeeze(F.concat_ws(" ", clean(sku), clean(name)))


def judged(rows: DataFrame, header: dict[str, str] | None = None) -> DataFrame:
    """Rows (sku, item_name) with refused: why a row is certainly no equipment, null if nothing says so; equipment: whether words name
    some; model_like: whether the code looks like a model. Header values come first (kinds as in HEADER_KINDS, with the column that holds
    them): a row that repeats the document's own supplier, number or date is no item; values under four letters and digits prove nothing.

    Each text and pattern that several rules need is a column of a step before them, so that it is matched once a row."""
    s, n, text, equipment = (F.col(c) for c in ("_s", "_n", "_text", "equipment"))
    out = rows.withColumns({"_s": F.lower(clean("sku")), "_n": F.lower(clean("item_name"))}).withColumn("_text", F.trim(F.concat_ws(" ", s, n)))
    out = out.withColumns({"equipment": has(text, EQUIPMENT), "_named": has(n, EQUIPMENT), "_accessory": has(text, ACCESSORY), "model_like": has(s, MODEL) & s.rlike(r"\d")})
    given = [kind for kind in HEADER_KINDS if header and kind in header]
    bare = {"_bare_s": compact(s), "_bare_n": compact(n), **{f"_{kind}": compact(header[kind]) for kind in given}} if given else {}
    out = out.withColumns(bare) if bare else out
    rules = [(text == "", F.lit("empty-row"))]
    for kind in HEADER_KINDS:
        if kind in given:
            v, whole = F.col(f"`_{kind}`"), F.concat("_bare_s", "_bare_n")
            same = (F.col("_bare_s") == v) | (F.col("_bare_n") == v)
            if kind != "invoice-date":
                same = same | (whole == v)
            if kind == "supplier":
                same = same | ((F.length(v) >= 8) & whole.contains(v) & ~equipment)
            rules.append(((F.length(v) >= 4) & same, F.lit(f"document-{kind}")))
    supplied = has(n, SUPPLIED) & F.col("_named") & ~has(n, ACCESSORY)
    rules += [
        (has(text, HEADER_WORDS), F.lit("header-or-contact-metadata")),
        (~equipment & has(text, COMPANY), F.lit("company-header")),
        (has(text, ADDRESS) | has(n, ADDRESS), F.lit("address-metadata")),
        (has(text, DATE_LABEL) | has(n, DATE_VALUE) | has(s, DATE_VALUE), F.lit("date-metadata")),
        (has(text, WARRANTY) & ~(F.col("_named") & ~has(n, WARRANTY_START)), F.lit("warranty-or-support")),
        (has(s, SERVICE_SKU) | has(n, SERVICE_START) | (has(n, SERVICE_ACTION) & ~supplied) | (~equipment & has(text, SERVICE)), F.lit("service-or-labour")),
        (F.col("_accessory") & ~equipment & ~has(text, MICROPHONE_STAND), F.lit("excluded-accessory")),
    ]
    return out.withColumn("refused", F.coalesce(*(F.when(hit, why) for hit, why in rules))).drop("_s", "_n", "_text", "_named", "_accessory", *bare)


def disposition(sku: Column, name: Column, q: Column, p: Column, a: Column, given: Column | None = None) -> Column:
    """equipment, service, accessory, warranty, metadata or unknown. A label that is given decides; a note without amount is metadata;
    equipment needs a word or a code for it, and arithmetic that holds."""
    t = norm(row_text(sku, name))
    label = F.lower(F.coalesce(given, F.lit(""))) if given is not None else F.lit("")
    out = F.when(label.isin(*GIVEN), label).when(label == "noninventory", "accessory").when(t == "", "unknown").when(t.rlike(by_letter(NOTE)) & a.isNull(), "metadata")
    for kind, pattern in DISPOSITIONS:
        hit = t.rlike(by_letter(pattern))
        out = out.when(hit & ~t.rlike(r"\bmicrophone stand\b") if kind == "accessory" else hit, kind)
    return out.when((t.rlike(by_letter(ASSET)) | (clean(sku) != "")) & econ_ok(q, p, a, "evidence"), "equipment").otherwise("unknown")


def ledger_summary(rows: DataFrame, key: str = "doc_id", kind: str = "disposition") -> DataFrame:
    """Per document the rows of each disposition; complete if none is unknown."""
    n = [F.count_if(F.col(kind) == k).alias(k) for k in (*GIVEN, "unknown")]
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("detected"), *n)
    return out.withColumns({"accounted": F.col("detected") - F.col("unknown"), "complete": F.col("unknown") == 0})


def proven_rows(rows: DataFrame, lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows that stand in the text of their document, with the first such line: it names the code, or two of the description's words
    (the only one, if there is one), and from one line before to two after it there are two prices and the quantity.

    rows: key, row_no, sku, item_name, quantity; lines: key, page, line_no, line. Codes and words are whole words, as in evidence_lines. A
    row without a quantity above zero needs no printed one. Rows and lines meet by the document, so that neither is shuffled again; null keys meet nothing."""
    w = Window.partitionBy(key).orderBy("page", "line_no")
    near = F.concat_ws(" ", F.lag("line", 1).over(w), F.col("line"), F.lead("line", 1).over(w), F.lead("line", 2).over(w))
    around = once(lines.select(key, "page", "line_no", "line", near.alias("near")), prices=F.regexp_count("near", F.lit(PRICE))).where("prices >= 2")
    said = F.filter(F.split(norm("line"), " "), lambda t: t != "")
    around = around.select(key, "page", "line_no", F.split("near", " ").alias("near"), said.alias("said")).withColumn("flat", F.upper(F.array_join("said", "")))
    words = F.array_distinct(F.filter(F.split(norm("item_name"), " "), lambda t: (F.length(t) >= 3) & ~t.isin(*SMALL_WORDS)))
    q = F.col("quantity").cast("double")
    number = F.when(q > 0, F.when(q == F.floor(q), q.cast("long").cast("string")).otherwise(q.cast("string")))
    r = rows.select(key, "row_no", number.alias("number"), F.when(F.length(compact("sku")) >= 3, compact("sku")).alias("k"), words.alias("words"))
    there = F.col("number").isNull() | F.array_contains("near", F.col("number"))
    by_code = F.coalesce(F.contains("flat", "k") & spelled(F.col("said"), F.col("k")), F.lit(False))
    by_words = (F.size("words") > 0) & (F.size(F.array_intersect("words", "said")) >= F.least(F.lit(2), F.size("words")))
    found = r.join(around, key).where(there).where(by_code | by_words)
    return found.groupBy(key, "row_no").agg(F.min(F.struct("page", "line_no")).alias("at")).select(key, "row_no", "at.page", "at.line_no")


def row_gate(refused: Column, equipment: Column, model: Column, proven: Column, economics: Column) -> Column:
    """struct(status, reason) of a row on its own: reject, review, candidate or verified. The first three as of judged; economics at the
    tolerance of the gate."""
    said = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    shown, ok, thing = F.coalesce(proven, F.lit(False)), F.coalesce(economics, F.lit(False)), equipment | model
    return (
        F.when(refused.isNotNull(), F.struct(F.lit("reject").alias("status"), refused.alias("reason")))
        .when(~shown & thing, said("review", "source-row-not-proven"))
        .when(~shown, said("reject", "not-proven-as-line-item"))
        .when(~ok & thing, said("review", "line-item-economics-unverified"))
        .when(~ok, said("reject", "unverified-economics"))
        .when(equipment, said("verified", "physical-equipment-description"))
        .when(model, said("candidate", "model-and-priced-row-proven"))
        .otherwise(said("review", "physical-equipment-identity-unproven"))
    )


def full_gate(gate: Column, proven: Column, economics: Column, match: Column, web: Column) -> Column:
    """struct(bucket, reason, canonical): a row is verified only if the web confirms the product and the document proves the row; all
    else that is not rejected waits for a person. canonical: the confirmed master item gives its code and name. match and web are the
    statuses of lookups made before; null is a lookup that could not be made."""
    strong = F.coalesce(proven & economics, F.lit(False))
    bucket = F.when(gate["status"] == "reject", "rejected").when((web == "confirmed") & strong, "verified").otherwise("pending")
    reason = (
        F.when(bucket == "rejected", gate["reason"])
        .when(bucket == "verified", "web-confirmed")
        .when(web.isNull() | (web == "unavailable"), "mandatory-web-unavailable")
        .when(web == "confirmed", "invoice-item-evidence-unproven")
        .otherwise("mandatory-web-unconfirmed")
    )
    return F.struct(bucket.alias("bucket"), reason.alias("reason"), F.coalesce((bucket == "verified") & (match == "confirmed"), F.lit(False)).alias("canonical"))


def analysis_gate(headers: DataFrame, summary: DataFrame, missing: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document of headers the issues against promoting it, and whether there are none. headers: key, supplier_name, invoice_number,
    invoice_date; summary: as of ledger_summary; missing: key and one row for each piece of equipment that the final items lack."""
    lost = missing.groupBy(key).agg(F.count(F.lit(1)).alias("n_missing"))
    d = headers.join(summary.select(key, "unknown"), key, "left").join(lost, key, "left")
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
    checks = [("unaccounted-source-rows", F.coalesce(F.col("unknown") > 0, F.lit(False))), ("final-items-incomplete", F.coalesce(F.col("n_missing") > 0, F.lit(False)))]
    checks += [(f"{c.removesuffix('_name').replace('_', '-')}-not-proven", blank(c)) for c in ("supplier_name", "invoice_number", "invoice_date")]
    issues = F.array_compact(F.array(*(F.when(hit, code) for code, hit in checks)))
    return d.select(key, issues.alias("issues"), (F.size(issues) == 0).alias("safe_to_promote"))


def independent_readings(first: DataFrame, second: DataFrame) -> DataFrame:
    """doc_id, no, a, b: each row of a first reading beside the one of the second that matching.pair_readings finds for it, as compare_readings takes them."""
    row = F.struct(*FIELDS[:1], "item_name", *FIELDS[1:])
    met = best_of_second(first, second).select("doc_id", "no", "second_no")
    a, b = first.select("doc_id", "no", row.alias("a")), second.select("doc_id", F.col("no").alias("second_no"), row.alias("b"))
    return a.join(met, ["doc_id", "no"], "left").join(b, ["doc_id", "second_no"], "left").select("doc_id", "no", "a", "b")


def compare_readings(pairs: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """A row (struct of FIELDS) beside the row of an independent reading that matches it, null if none does. Adds disagreements: fields that
    differ or that one reading lacks. Those other than the quantity are emptied in `row`; choices: for those, both readings as text, null where one has
    none (serials joined by commas); core_verified: matched, and the quantity agrees. Numbers agree within 0.02, codes as bare letters and digits,
    serials as sets. Other fields of the first reading stay."""
    a, b = F.col(first), F.col(second)
    serials = lambda x: F.array_sort(F.array_distinct(F.transform(F.coalesce(x["serials"], F.array().cast("array<string>")), lambda s: compact(s))))

    def differs(field: str) -> Column:
        if field == "serials":
            return serials(a) != serials(b)
        if field == "sku":
            return compact(a["sku"]) != compact(b["sku"])
        u, v = a[field].cast("double"), b[field].cast("double")
        return F.when(u.isNull() | v.isNull(), u.isNotNull() | v.isNotNull()).otherwise(F.abs(u - v) >= 0.02)

    matched = b.isNotNull()
    apart = F.when(matched, F.array_compact(F.array(*(F.when(differs(f), f) for f in FIELDS)))).otherwise(F.array().cast("array<string>"))
    out = pairs.withColumns({"matched": matched, "disagreements": apart})
    gone = lambda f: F.array_contains("disagreements", f)
    names = pairs.schema[first].dataType.names
    kept = [F.when(~gone(f), a[f]).alias(f) if f in FIELDS and f != "quantity" else a[f].alias(f) for f in names]
    said = lambda x, f: F.nullif(F.array_join(x[f], ", ") if f == "serials" else x[f].cast("string"), F.lit(""))
    both = [F.when(gone(f) & said(a, f).isNotNull() & said(b, f).isNotNull(), F.array(said(a, f), said(b, f))).alias(f) for f in FIELDS]
    return out.withColumns({"row": F.struct(*kept), "core_verified": matched & ~gone("quantity"), "choices": F.struct(*both)})


def three_layers(compared: DataFrame, printed: Column | dict[str, Column]) -> DataFrame:
    """Extraction, independent agreement, a person: states of the layers and of each field of compare_readings, item_name too if rows have one. printed:
    whether the text a field was read from stands in the document, or that of the whole row. A field is not_found, confirmed (printed, or
    matched and not read differently) or uncertain."""
    away = F.col("disagreements")
    some = F.size(away) > 0
    second = F.when(~F.col("matched"), "unavailable").when(some, "disagree").otherwise("confirmed")
    why = F.when(~F.col("matched"), "unmatched").when(some, F.concat(F.lit("differs:"), F.array_join(away, ","))).otherwise("")
    states = []
    for f in [*FIELDS, *({"item_name"} & set(compared.schema["row"].dataType.names))]:
        v = F.col("row")[f]
        empty = F.coalesce(F.size(v) == 0, F.lit(True)) if f == "serials" else F.coalesce(v.cast("string") == "", F.lit(True))
        there = printed.get(f, F.lit(False)) if isinstance(printed, dict) else printed
        agreed = F.col("matched") & ~F.array_contains(away, f)
        states.append(F.when(empty, "not_found").when(F.coalesce(there, F.lit(False)) | agreed, "confirmed").otherwise("uncertain").alias(f))
    return compared.withColumns({"layer_two": second, "human_review": ~F.col("matched") | some, "reason": why, "evidence": F.struct(*states)})


def countercheck(rows: DataFrame, lines: DataFrame, anchors: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, row_no, kind, reason: what a second look at the whole document says against rows read from it.

    A refused row is a conflict. A code of three letters and digits or more that no line of the document has as whole words is a warning, and so is a document with
    more numbered rows of equipment than rows were read, or wait for a person (row_no is null there). Documents without rows are looked at too.

    rows: key, row_no, sku, refused (as of judged); pending rows have status 'pending' if there is such a column. lines: key, page, line_no, line. anchors:
    key, ordinal, strong: rows numbered in print, and whether one names equipment or a model; an ordinal printed several times counts once."""
    said = lambda kind, reason: (F.lit(kind).alias("kind"), reason.alias("reason"))
    waiting = F.col("status") == "pending" if "status" in rows.columns else F.lit(False)
    rows = cut(rows.select(key, "row_no", compact("sku").alias("k"), "refused", F.coalesce(waiting, F.lit(False)).alias("waiting")), "judged", key)  # four looks at it
    read = rows.where("NOT waiting")
    conflicts = read.where("refused IS NOT NULL").select(key, "row_no", *said("conflict", F.concat(F.lit("refused:"), "refused")))
    codes = read.where("refused IS NULL").select(key, "row_no", "k").where("length(k) >= 3")
    there = word_runs(lines.select(key, "page", "line_no", "line"), codes.select(key, "k"), key).select(key, "k").distinct()
    unseen = codes.join(there, [key, "k"], "left_anti").select(key, "row_no", *said("warning", F.lit("code-not-in-document")))
    strong = anchors.where("strong AND ordinal > 0").groupBy(key).agg(F.size(F.collect_set("ordinal")).alias("numbered"))
    held = rows.groupBy(key).agg(F.count(F.lit(1)).alias("held"))
    fewer = strong.join(held, key, "left").where(F.col("numbered") > F.coalesce("held", F.lit(0)))
    fewer = fewer.select(key, F.lit(None).cast(rows.schema["row_no"].dataType).alias("row_no"), *said("warning", F.lit("numbered-rows-missing")))
    return conflicts.unionByName(unseen).unionByName(fewer)


def fused_ordinal(sku: Column, line: Column, ordinal: Column) -> Column:
    """Whether a code may have swallowed the number of its row (1 OR-DSP-774 read as 10RDSP-774): the line begins with the code, and the code with the number and a
    letter or digit after it. Only where the table has a number column beside the code's; such a code is left to a person."""
    s, n = F.upper(clean(sku)), ordinal.cast("string")
    return F.coalesce((s != "") & F.startswith(F.upper(clean(line)), s) & F.startswith(s, n) & F.substr(s, F.length(n) + 1, F.lit(1)).rlike("[A-Z0-9]"), F.lit(False))
