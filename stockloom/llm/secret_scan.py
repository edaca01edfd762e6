"""Secret scans over an incremental ledger of blobs.

Every historical version of every path is known by the digest of its text, its blob. A ledger remembers which rules, in which
version, have seen which blob, and what they found; only unseen pairs of blob and rule version are scanned, and findings are joined
back to all paths and versions that hold the blob.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import SMALL_SIDE, join_spread, materialize, shared_dir


@dataclass(frozen=True)
class Rule:
    """kind and version name the rule in the ledger: a changed pattern takes a new version, and only it is scanned again.

    pattern works on UTF-8 bytes, so that its letters are ASCII; matches are leftmost and do not overlap, and those whose `group` has
    fewer than `least` characters are dropped after matching. needs: lower-case strings of which a text with a match holds one in any case."""

    kind: str
    version: int
    pattern: bytes
    least: int = 1
    group: int = 0
    needs: tuple[bytes, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.kind}:{self.version}"


#: The three base kinds come first, in this order; the others have public formats that no prose has.
RULES = (
    Rule("assign", 1, rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")),
    Rule("access", 1, rb"AKIA[A-Z0-9]+", 20, 0, (b"akia",)),
    Rule("hex", 1, rb"[0-9a-f]{24,}", 24),  # a run is taken whole, so shorter ones need not be matched to be dropped
    Rule("pem", 1, rb"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----", 1, 0, (b"private key",)),
    Rule("jwt", 1, rb"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}", 1, 0, (b".eyj",)),
    Rule("forge", 1, rb"\bgh[pousr]_[A-Za-z0-9]{36,}", 1, 0, (b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_")),
)
BASE = ("assign", "access", "hex")

#: One row for each scan of a blob: the rules it was scanned by, and what they found.
LEDGER = "blob binary, rules array<string>, spans array<struct<start: long, end: long, kind: string, version: int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("version", pa.int32())]))


def blob(text: str = "text") -> Column:
    """Digest of the whole text, 32 bytes. A null text is empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def spans_of(body: bytes, rules: Sequence[tuple[Rule, re.Pattern]]) -> list[tuple[int, int, str, int]]:
    """start, end (code points, end exclusive), kind and version of every match."""
    low, found = body.lower(), []
    for rule, pattern in rules:
        if rule.needs and not any(x in low for x in rule.needs):
            continue
        for m in pattern.finditer(body):
            a, b = m.span(rule.group)
            if b - a >= rule.least:
                found.append((*m.span(), rule.kind, rule.version))
    if found and not body.isascii():
        first = np.concatenate(([0], np.cumsum((np.frombuffer(body, np.uint8) & 0xC0) != 0x80)))
        found = [(int(first[a]), int(first[b]), kind, version) for a, b, kind, version in found]
    return sorted(found)


def _scan(rules: Sequence[Rule]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {r.name: (r, re.compile(r.pattern)) for r in rules}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                spans = []
                for body, missing in zip(part.column(1), part.column(2).to_pylist(), strict=True):
                    got = spans_of(body.as_py(), [compiled[x] for x in missing])
                    spans.append([{"start": a, "end": b, "kind": k, "version": v} for a, b, k, v in got])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(spans, _SPANS)], names=["blob", "rules", "spans"])

    return run


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger in a folder; none yet is an empty one."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEDGER)


def unseen(blobs: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """blob, missing: the rule versions that have not seen a blob, for blobs where there are any."""
    active = F.array(*[F.lit(r.name) for r in rules]) if rules else F.expr("cast(array() as array<string>)")
    seen = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))  # as many as there ever were rule versions
    missing = F.array_except(active, F.coalesce("seen", F.expr("cast(array() as array<string>)")))
    return blobs.select("blob").join(seen, "blob", "left").select("blob", missing.alias("missing")).where(F.size("missing") > 0)


def scan(versions: DataFrame, keys: Sequence[str], ledger_path: str, rules: Sequence[Rule] = RULES, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Brings the ledger up to date with the versions at hand, then returns (paths, findings).

    versions: one row for each version of each path, named by `keys`, with its whole text (null: empty); rows may repeat.
    paths: keys and blob of every row. findings: one row for each blob, the number n of its rows and its spans sorted by start and by the
    order of `rules`, null if there are none. Findings of rules or versions that are not in `rules` stay in the ledger and are not returned.

    One text a blob travels, gathered in the reading tasks first, so that thousands of copies cost one scan. Where few blobs are unseen
    (at most 200 000) their list is broadcast and only their texts travel. The ledger grows by one append, written as a whole or not at all:
    a job that dies before leaves it as it was, and two that append the same pair say the same.
    """
    spark = versions.sparkSession
    keys = list(keys)
    paths = materialize(versions.select(*keys, blob(text_col).alias("blob")), "versions")
    counts = materialize(paths.groupBy("blob").agg(F.count(F.lit(1)).alias("n")), "blobs")
    todo = materialize(unseen(counts, read_ledger(spark, ledger_path), rules), "unseen")
    waiting = todo.count()
    if waiting:
        texts = versions.select(blob(text_col).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
        if waiting <= SMALL_SIDE:
            texts = texts.join(F.broadcast(todo.select("blob")), "blob", "left_semi")
        one = texts.groupBy("blob").agg(F.first("body").alias("body"))
        one.join(todo, "blob").select("blob", "body", "missing").mapInArrow(_scan(rules), LEDGER).write.mode("append").parquet(ledger_path)
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))]) if rules else F.expr("map('', 0)")
    spans = read_ledger(spark, ledger_path).join(counts.select("blob"), "blob", "left_semi").select("blob", F.explode("spans").alias("s"))
    spans = spans.select("blob", "s.*").withColumn("rank", order[F.concat_ws(":", "kind", "version")]).where("rank IS NOT NULL").distinct()
    spans = spans.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end", "kind", "version"))).alias("spans"))
    return paths, counts.join(spans, "blob", "left").select("blob", "n", "spans")


def findings(versions: DataFrame, keys: Sequence[str], ledger_path: str, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """keys, blob, kind, version, start, end: every finding at every path and version, copies of a text included."""
    paths, found = scan(versions, keys, ledger_path, rules, text_col)
    spans = found.where("spans IS NOT NULL").select("blob", "spans")
    out = join_spread(paths, spans, "blob", found.select("blob", "n"))
    return out.select(*keys, "blob", F.explode("spans").alias("s")).select(*keys, "blob", "s.kind", "s.version", "s.start", "s.end")


def secret_digests(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row for each row of documents.

    A null text is empty; an empty one has no spans and the digest of an empty string. Repeated rows and copies have equal results, each
    row its own. Null ids stay. An empty table gives an empty one. Without a ledger_path a new ledger is begun in the shared folder.
    """
    ledger_path = ledger_path or f"{shared_dir(docs.sparkSession)}/ledger-{uuid.uuid4().hex}"
    paths, found = scan(docs, ["doc_id"], ledger_path)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind):
        return F.size(F.filter("s", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    per_blob = found.where("spans IS NOT NULL").select("blob", F.col("spans").alias("s"))
    per_blob = per_blob.select("blob", *[of(k) for k in BASE], F.sha2(joined(F.filter("s", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))
    out = join_spread(paths, per_blob, "blob", found.select("blob", "n"))
    none = hashlib.sha256(b"").hexdigest()
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE], F.coalesce("base_sha256", F.lit(none)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))

