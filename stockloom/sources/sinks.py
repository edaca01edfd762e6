"""Writing: a document's rows all or none, deletes that cascade, archives and reports. Plans first, one publish step last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import clean, compact, norm


def save_plan(masters: DataFrame, lines: DataFrame, purchases: DataFrame) -> dict[str, DataFrame]:
    """What saving would add: new master items, purchase lines with their item, serials, and reasons against it.

    masters: id, sku, item_name; lines: doc_id, line_no, sku, item_name, quantity, unit_price, amount, serials; purchases: supplier_name, invoice_number of what is stored.
    A line meets a master by bare sku, else by normalised name; what meets none becomes a new item, one for all lines that share its key."""
    key = F.when(compact("sku") != "", F.concat(F.lit("sku:"), compact("sku"))).otherwise(F.concat(F.lit("name:"), norm("item_name")))
    known = masters.select("id", key.alias("k")).union(masters.where(compact("sku") != "").select("id", F.concat(F.lit("name:"), norm("item_name")).alias("k")))
    known = known.groupBy("k").agg(F.min("id").alias("master_id"))
    ln = lines.withColumn("k", key).join(known, "k", "left")
    fresh = ln.where("master_id IS NULL").groupBy("k").agg(F.min_by(F.struct(clean("sku").alias("sku"), clean("item_name").alias("item_name")), F.struct("doc_id", "line_no")).alias("m"))
    serials = ln.select("doc_id", "line_no", F.explode("serials").alias("serial"))
    return {
        "new_items": fresh.select("k", "m.*"),
        "lines": ln.select("doc_id", "line_no", F.coalesce(F.col("master_id").cast("string"), F.concat(F.lit("new:"), F.col("k"))).alias("item"), "quantity", "unit_price", "amount"),
        "serials": serials.withColumn("serial", F.trim("serial")).where("serial <> ''"),
    }


def duplicate_invoices(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming documents whose supplier and invoice number are stored already, without regard to case."""
    k = lambda d: d.withColumns({"_s": F.lower(clean("supplier_name")), "_n": F.lower(clean("invoice_number"))})
    return k(incoming).join(k(stored).select("_s", "_n").distinct(), ["_s", "_n"], "left_semi").drop("_s", "_n")


def delete_cascade(doc_ids: DataFrame, purchases: DataFrame, lines: DataFrame, serials: DataFrame, masters: DataFrame, adjustments: DataFrame) -> dict[str, DataFrame]:
    """The tables as they are after documents went: their purchases, lines and serials go, and masters that only they had, with their
    adjustments. doc_ids: document_id; purchases: id, document_id; lines: id, purchase_id, master_item_id; serials: purchase_item_id; adjustments: master_item_id."""
    gone = purchases.join(doc_ids, "document_id", "left_semi").select(F.col("id").alias("purchase_id"))
    kept_lines = lines.join(gone, "purchase_id", "left_anti")
    cut = lines.join(gone, "purchase_id", "left_semi")
    lost = cut.select("master_item_id").distinct().join(kept_lines.select("master_item_id"), "master_item_id", "left_anti")
    return {
        "purchases": purchases.join(doc_ids, "document_id", "left_anti"),
        "lines": kept_lines,
        "serials": serials.join(cut.select(F.col("id").alias("purchase_item_id")), "purchase_item_id", "left_anti"),
        "masters": masters.join(lost.select(F.col("master_item_id").alias("id")), "id", "left_anti"),
        "adjustments": adjustments.join(lost, "master_item_id", "left_anti"),
    }


def split_vault(documents: DataFrame, before_year: int = 2020, day: str = "invoice_date") -> tuple[DataFrame, DataFrame]:
    """Documents for the books and documents for the archive: those dated before the year."""
    old = F.coalesce(F.year(day) < before_year, F.lit(False))
    return documents.where(~old), documents.where(old)


def unique_names(files: DataFrame, name: str = "name", *order: str) -> DataFrame:
    """Repeated file names get -2, -3 and so on before the ending, in the given order."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(F.lower(name)).orderBy(*order))
    stem, end = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return files.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat(stem, F.lit("-"), n.cast("string"), end)))


def invoice_documents(lines: DataFrame, purchases: DataFrame) -> DataFrame:
    """Nested documents for export: header fields, lines in order, and the names of missing fields."""
    body = lines.groupBy("purchase_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "item_name", "quantity", "unit_price", "amount"))).alias("lines"))
    out = purchases.join(body, purchases["id"] == body["purchase_id"], "left").drop("purchase_id")
    fields = [c for c in ("supplier_name", "invoice_number", "invoice_date", "total_amount") if c in purchases.columns]
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(c)) for c in fields]))
    return out.withColumns({"version": F.lit(1), "missing": missing})


def markdown_rows(lines: DataFrame) -> DataFrame:
    """purchase_id, markdown: a table of a document's lines as text."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[|\r\n]+", " ")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in ("line_no", "item_name", "quantity", "unit_price", "amount")]), F.lit(" |"))
    head = "| # | Item | Qty | Unit | Amount |\n|---|---|---|---|---|\n"
    g = lines.select("purchase_id", F.struct("line_no", row.alias("r")).alias("x")).groupBy("purchase_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return g.select("purchase_id", F.concat(F.lit(head), F.array_join(F.transform("x", lambda x: x.r), "\n")).alias("markdown"))


def write_report(report: DataFrame, path: str) -> None:
    """A verification report as JSON lines."""
    report.write.mode("overwrite").json(path)
