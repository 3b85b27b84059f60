"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of every path is content-addressed (SHA-256 of its text). The ledger records which
(blob, rule version) pairs have been scanned and what was found; a scan reads only pairs that the
ledger lacks, each distinct blob once however many paths hold it, and joins the findings back to
all paths. A committed scan is one Parquet folder; a folder counts once its commit marker is there.

Matches are located without a Python loop: split() gives the gaps around the matches that
regexp_extract_all() lists, and running sums of their lengths are the offsets (code points).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Commits, fresh_path, salted_join, shuffles_dropped, with_text_key

#: The kinds, in the order in which ties of a start are listed, with pattern and least length.
#: A pattern holds no other group than those stated. For access and hex the least length is in the
#: pattern: a run is maximal, so dropping short ones afterwards gives the same spans.
RULES = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"AKIA[A-Z0-9]{16,}"),
    ("hex", r"[0-9a-f]{24,}"),
)
RULES_VERSION = "base-1"
#: Least length of the value of an assignment.
ASSIGN_LEAST = 6

#: Matches whose spans are walked in one go.
BLOCK = 128

SPAN = "array<struct<start:int,kind_at:int,kind:string,stop:int>>"


def kind_spans(text: Column, at: int) -> Column:
    """Spans of one kind, in order: an array of (start, kind_at, kind, stop)."""
    kind, pattern = RULES[at]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else whole
    parts = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(whole, F.length).alias("len"), F.transform(values, F.length).alias("value"))
    found = F.filter(parts, lambda p: p["len"].isNotNull())
    return F.when(F.regexp_like(text, F.lit(pattern)), _bound(found, lambda p: _walked(p, at))).otherwise(F.array().cast(SPAN))


def _bound(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def _walked(parts: Column, at: int) -> Column:
    """Spans of parts (gap before a match, its length, its value's length). Blocks of BLOCK parts have a running sum each, so that no array grows over more than a block."""
    kind = RULES[at][0]
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(parts) - 1) / BLOCK), F.lit(0)).cast("int")), lambda i: F.slice(parts, i * BLOCK + 1, BLOCK))
    none = F.array().cast(SPAN)

    def starts(of: Column) -> Column:
        length = lambda block: F.aggregate(block, F.lit(0), lambda n, p: n + p["gap"] + p["len"])
        return F.aggregate(of, F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("at")), lambda s, b: F.struct((s["pos"] + length(b)).alias("pos"), F.concat(s["at"], F.array(s["pos"])).alias("at")))["at"]

    def block_spans(block: Column, start: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(start.alias("pos"), none.alias("found")),
            lambda s, p: F.struct(
                (s["pos"] + p["gap"] + p["len"]).alias("pos"),
                F.concat(
                    s["found"],
                    F.when(
                        (F.lit(kind) != "assign") | (p["value"] >= ASSIGN_LEAST),
                        F.array(F.struct((s["pos"] + p["gap"]).alias("start"), F.lit(at).alias("kind_at"), F.lit(kind).alias("kind"), (s["pos"] + p["gap"] + p["len"]).alias("stop"))),
                    ).otherwise(none),
                ).alias("found"),
            ),
        )["found"]

    return _bound(blocks, lambda bs: _bound(starts(bs), lambda at_: F.flatten(F.transform(bs, lambda b, i: block_spans(b, F.get(at_, i))))))


def all_spans(text: Column) -> Column:
    """Spans of all kinds by start, then kind as listed."""
    return F.array_sort(F.concat(*[kind_spans(text, i) for i in range(len(RULES))]))


def spans_text(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])))


LEDGER = f"blob string, rule_version string, spans {SPAN}"


class BlobLedger:
    """Findings of every (blob, rule version) pair scanned so far, under one folder. Each scan id commits at most once."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or fresh_path(spark, "blob-ledger")
        self.commits = Commits(spark, self.path)

    def rows(self) -> DataFrame:
        # one row for a pair, should two scans have raced
        return self.commits.read(LEDGER).dropDuplicates(["blob", "rule_version"])

    def unseen(self, blobs: DataFrame, rule_version: str) -> DataFrame:
        """Distinct blobs (blob, text) without a row for this rule version."""
        distinct = blobs.groupBy("blob").agg(F.first("text").alias("text"))
        if not self.commits.all():
            return distinct
        return distinct.join(self.rows().where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")

    def scan(self, versions: DataFrame, rule_version: str = RULES_VERSION, scan_id: str | None = None) -> int:
        """Scan what is unseen of versions (blob, text) and commit it. Returns 1 if a commit was made, else 0.

        Replaying a scan_id does nothing; it is an error with other blobs or rules. A scan that failed before
        its commit counts as nothing and can be tried again.
        """
        digest = ""
        if scan_id is not None:
            blobs = versions.select("blob").distinct().agg(F.count(F.lit(1)), F.sum(F.xxhash64("blob").cast("decimal(38,0)"))).first()
            digest = f"{rule_version}:{blobs[0]}:{blobs[1]}"
            known = self.commits.all()
            if scan_id in known:
                if known[scan_id][1] != digest:
                    raise ValueError(f"scan {scan_id!r} is committed with other blobs or rules")
                return 0
        found = self.unseen(versions, rule_version).select("blob", F.lit(rule_version).alias("rule_version"), all_spans(F.col("text")).alias("spans"))
        folder = self.commits.new_folder()
        with shuffles_dropped(self.spark):
            found.write.parquet(folder)
        return int(self.commits.add(scan_id or uuid.uuid4().hex, folder, digest))

    def compacted(self, path: str) -> BlobLedger:
        """A new ledger with this one's findings in one folder; it knows this one's scans."""
        known, out = self.commits.all(), BlobLedger(self.spark, path)
        out.commits.take_over(known, self.commits.read(LEDGER, known).dropDuplicates(["blob", "rule_version"]))
        return out

    def findings(self, rule_version: str = RULES_VERSION) -> DataFrame:
        return self.rows().where(F.col("rule_version") == rule_version).select("blob", "spans")


def versions_of(docs: DataFrame) -> DataFrame:
    """blob and text of each row; a null text is the empty blob."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.sha2(text, 256).alias("blob"), text.alias("text"))


def scan_documents(docs: DataFrame, ledger: BlobLedger | None = None, rule_version: str = RULES_VERSION) -> DataFrame:
    """One row per document row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Nulls: a null text is an empty blob; a null doc_id stays null. Repeated rows and copies are scanned
    once and each gets the blob's spans. A very long text is one blob. An empty table gives an empty result,
    other columns are ignored.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    ledger.scan(versions_of(docs), rule_version)
    return findings_of(docs, ledger, rule_version)


def scan_deliveries(docs: DataFrame) -> DataFrame:
    """scan_documents() of a table that comes in two deliveries, half of it and then all of it, the second one twice: the ledger scans what each adds."""
    ledger, versions = BlobLedger(docs.sparkSession), versions_of(docs)
    ledger.scan(versions.where(F.col("blob") < "8"), RULES_VERSION, "first")
    for _ in range(2):
        ledger.scan(versions, RULES_VERSION, "all")
    return findings_of(docs, ledger)


def findings_of(docs: DataFrame, ledger: BlobLedger, rule_version: str = RULES_VERSION) -> DataFrame:
    """The ledger's findings joined back to the rows of docs, as scan_documents() has them."""
    # a blob without findings needs no row of the ledger
    found = ledger.findings(rule_version).where(F.size("spans") > 0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("blob"))
    joined = salted_join(rows, found, "blob", "doc_id", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPAN)))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = spans_text(F.col("spans"))
    return joined.select("doc_id", *[count(kind) for kind, _ in RULES], F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))


def redact(docs: DataFrame, ledger: BlobLedger | None = None, mask: str = "[SECRET]") -> DataFrame:
    """docs with every found span replaced by the mask (overlapping spans by one); n_chars follows the text.

    Rows without findings come back as they were, null texts too; repeated rows are masked each.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    ledger.scan(versions_of(docs))
    hits = ledger.findings().where(F.size("spans") > 0)
    rows = with_text_key(docs).select(F.col("sha").alias("blob"), "rid", "row")
    text = F.col("row.text")
    walked = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")),
        lambda s, p: F.when(
            p["start"] >= s["pos"],
            F.struct(p["stop"].alias("pos"), F.concat(s["out"], F.substring(text, s["pos"] + 1, p["start"] - s["pos"]), F.lit(mask)).alias("out")),
        ).otherwise(F.struct(F.greatest(s["pos"], p["stop"]).alias("pos"), s["out"].alias("out"))),
    )
    out = salted_join(rows, hits, "blob", "rid", "left").withColumn("walked", walked)
    clean = F.when(F.col("spans").isNull(), text).otherwise(F.concat(F.col("walked.out"), F.expr("substring(row.text, walked.pos + 1)")))
    out = out.withColumn("clean", clean)
    n_chars = F.when(F.col("spans").isNull(), F.col("row.n_chars") if "n_chars" in docs.columns else None).otherwise(F.length("clean").cast("long"))
    new = {"text": F.col("clean"), "n_chars": n_chars}
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def _sql_kind(at: int) -> str:
    kind, pattern = RULES[at]
    p = pattern.replace("'", "''")
    least = f"len(regexp_extract_all(t, '{p}', 2)[i]) >= {ASSIGN_LEAST}" if kind == "assign" else "true"
    return f"""SELECT doc_id, {at} AS kind_at, '{kind}' AS kind,
       list_sum(list_transform(gaps[1:i], lambda g: len(g)))::BIGINT + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: len(h))), 0)::BIGINT AS start,
       len(hits[i]) AS n
FROM (SELECT doc_id, t, gaps, hits, unnest(range(1, len(hits) + 1)) AS i
      FROM (SELECT doc_id, t, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS hits
            FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)))
WHERE {least}"""


SQL = f"""
WITH found AS ({" UNION ALL ".join(_sql_kind(i) for i in range(len(RULES)))}),
per AS (SELECT doc_id,
               count(*) FILTER (kind = 'assign') AS n_assign,
               count(*) FILTER (kind = 'access') AS n_access,
               count(*) FILTER (kind = 'hex') AS n_hex,
               string_agg(kind || ':' || start || ':' || (start + n), ',' ORDER BY start, kind_at) AS spans
        FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN per ON per.doc_id IS NOT DISTINCT FROM d.doc_id
"""
