"""Secret scans over an incremental blob ledger.

Every version of a text is a blob, named by the sha256 of its bytes. The ledger is a table of (blob, rule_version,
spans): a blob is scanned once for each rule version, however many paths, commits or later runs hold it. Findings
are joined back to all paths by the blob's name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import file_count, new_path, table

#: Kinds in the order that breaks ties: pattern, group whose length counts, least length.
RULES: tuple[tuple[str, str, int, int], ...] = (
    ("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", r"(?<![0-9a-f])([0-9a-f]{24,})", 1, 24),  # the runs of [0-9a-f]+ that are long enough
)
LEDGER = "blob binary, rule_version string, spans array<struct<kind:string,start:long,end:long>>"
_ARROW = pa.schema([("blob", pa.binary()), ("rule_version", pa.string()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])


def version_of(rules=RULES) -> str:
    """Another version for any other set of rules."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def scan(text: str, compiled) -> list[dict]:
    """Spans in code points, by start and then in the order of the rules."""
    found = []
    for place, (kind, pattern, group, least) in enumerate(compiled):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), place, kind, m.end()))
    return [{"kind": kind, "start": start, "end": end} for start, _, kind, end in sorted(found)]


def compiled_rules(rules=RULES):
    return [(kind, re.compile(pattern), group, least) for kind, pattern, group, least in rules]


def _scan_blobs(batches: Iterator[pa.RecordBatch], rules) -> Iterator[pa.RecordBatch]:
    ready, version = compiled_rules(rules), version_of(rules)
    for batch in batches:
        spans = [scan(t, ready) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("blob").cast(pa.binary()), pa.array([version] * len(spans), pa.string()), pa.array(spans, _ARROW.field("spans").type)], schema=_ARROW)


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger so far, each (blob, rule version) once, also where two runs have put it in; None before its first part."""
    try:
        return spark.read.schema(LEDGER).parquet(path).groupBy("blob", "rule_version").agg(F.first("spans").alias("spans"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def scan_versions(versions: DataFrame, ledger: str, rules=RULES) -> DataFrame:
    """Per row of versions (any columns with a text): the row's columns and spans, its findings.

    ledger: a folder; the part for unseen (blob, rule version) pairs is appended to it, then all rows are joined with it.
    A null text is the empty blob, and a very long one a blob like any other. Versions of equal text share a blob, so
    repeated rows get equal spans. An empty table leaves the ledger as it is. A column spans of versions is replaced by
    the findings; columns named like the ledger's others stay untouched, as the join runs on a name of its own.
    """
    spark = versions.sparkSession
    files = file_count(versions)
    name, text = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)), F.coalesce(F.col("text"), F.lit(""))
    version, seen = version_of(rules), read_ledger(spark, ledger)
    blobs = versions.select(name.alias("blob"), text.alias("text"))
    if seen is not None:
        known = seen.where(F.col("rule_version") == version).select("blob")
        unseen = blobs.select("blob").distinct().join(known, "blob", "left_anti")
        blobs = blobs.join(unseen, "blob", "left_semi")
    once = blobs.groupBy("blob").agg(F.first("text").alias("text"))  # of equal texts each task sends on one
    once.mapInArrow(partial(_scan_blobs, rules=rules), LEDGER).coalesce(files).write.mode("append").parquet(ledger)
    entries = read_ledger(spark, ledger).where(F.col("rule_version") == version)
    found = entries.select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans"))
    return versions.withColumn("__blob", name).join(found, "__blob", "left").drop("__blob").withColumn("spans", F.col("__spans")).drop("__spans").coalesce(files)


def digests(found: DataFrame) -> DataFrame:
    """doc_id and the contract's columns from spans."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))


def op4_blob_ledger_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as versions of paths, over a new ledger. The ledger finds the base spans and adds none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(scan_versions(docs, new_path(spark, "ledger")).select("doc_id", "spans"))


def redacted(docs: DataFrame, ledger: str, mark: str = "[secret]", rules=RULES) -> DataFrame:
    """docs with every secret in the text replaced by a mark; n_chars, where there is one, follows. All columns stay.

    A null text stays null. Repeated rows are all kept, and an empty table gives no rows.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "text")
    found = scan_versions(rows, ledger, rules).select("__row", "spans", F.size("spans").alias("n"))
    marked = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.struct(F.concat(a.done, F.when(s.start >= a.at, F.concat(F.substring(F.col("__row.text"), (a.at + 1).cast("int"), (s.start - a.at).cast("int")), F.lit(mark))).otherwise("")).alias("done"), F.greatest(a.at, s.end).alias("at")),
        lambda a: F.concat(a.done, F.substring(F.col("__row.text"), (a.at + 1).cast("int"), F.length("__row.text"))),
    )
    found = found.withColumn("marked", F.when(F.col("n") > 0, marked).otherwise(F.col("__row.text")))
    new = {"text": F.col("marked")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n") > 0, F.length("marked")).otherwise(F.col("__row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[new.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])
