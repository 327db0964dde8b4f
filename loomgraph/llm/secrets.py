"""Secret scans with an incremental blob ledger.

Every version of a file is addressed by its content (SHA-256). The ledger has one row for each blob and version of the rules that
has been scanned, with or without findings. A scan takes the distinct blobs that the ledger lacks for the present rules,
reads each once, appends to the ledger and joins the findings back to all versions and paths with that content.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import col, free, scratch_path, spread, texts

#: The base rules, then what this scan adds: (kind, pattern, group whose length counts, least length). Any change to a rule takes a new version.
RULES_VERSION = "2"
ASSIGN = r"""(?ai:(?P<key>password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)(?P<value>[A-Za-z0-9+/_.=-]+)"""
RULES: list[tuple[str, str, str | int, int]] = [
    ("assign", ASSIGN, "value", 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----\s+(?:[A-Za-z0-9-]+:[^\r\n]*\s+)*[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("login", r"://[^\s/:@]++:[^\s/:@]++@", 0, 1),
]
BASE = ("assign", "access", "hex")
ORDER = {kind: i for i, (kind, *_) in enumerate(RULES)}
_COMPILED = {kind: re.compile(p) for kind, p, _, _ in RULES}
#: Long hexadecimal runs are searched as such: a run of 24 or more is a match of the base rule that passes, and no other is.
_HEX = re.compile(rb"[0-9a-f]{24,}")
_KEYS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_SURE = {"access": b"AKIA", "pem": b"PRIVATE KEY-----", "jwt": b"eyJ", "login": b"://"}

FOUND = "array<struct<kind:string,start:int,end:int>>"


def scan(data: bytes) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a UTF-8 text in code points, by start, then kind as listed.

    Each kind's matches are leftmost and don't overlap each other; those shorter than the rule's least length are dropped.
    A rule runs only on texts that have the bytes without which it can't match.
    """
    out: list[tuple[str, int, int]] = []
    text: str | None = None
    low = data.lower()
    if (b"=" in low or b":" in low) and any(k in low for k in _KEYS):
        text = data.decode()
        out += [("assign", m.start(), m.end()) for m in _COMPILED["assign"].finditer(text) if len(m["value"]) >= 6]
    runs = [m.span() for m in _HEX.finditer(data)]
    if runs:
        at = place = 0
        for a, b in runs:
            place += len(data[at:a].decode())
            out.append(("hex", place, place + b - a))
            at, place = b, place + b - a
    for kind, pattern, group, least in RULES:
        if kind in _SURE and _SURE[kind] in data:
            text = data.decode() if text is None else text
            if kind == "login":
                out += _logins(text)
                continue
            out += [(kind, *m.span()) for m in _COMPILED[kind].finditer(text) if len(m[group]) >= least]
    return sorted(out, key=lambda x: (x[1], ORDER[x[0]]))


_SCHEME = re.compile(r"[A-Za-z0-9+.-]*+")


def _logins(text: str) -> Iterator[tuple[str, int, int]]:
    """Logins in URLs: the part from :// on matches by itself; its scheme is what stands before, from its first letter on. No two
    schemes overlap, so this takes time in proportion to the text."""
    for m in _COMPILED["login"].finditer(text):
        scheme = _SCHEME.match(text[max(0, text.rfind("/", 0, m.start()) + 1, text.rfind(":", 0, m.start()) + 1) : m.start()][::-1])[0][::-1]
        first = re.search("[A-Za-z]", scheme)
        if first:
            yield "login", m.start() - len(scheme) + first.start(), m.end()


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan_column(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in column:
        yield pa.array(([{"kind": k, "start": a, "end": b} for k, a, b in scan(t)] for t in texts(batch)), kind)


class Ledger:
    """A table (blob, rules, found) in a shared folder; rows are only ever appended."""

    SCHEMA = f"blob string, rules string, found {FOUND}"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], self.SCHEMA)

    def update(self, versions: DataFrame, rules: str = RULES_VERSION) -> None:
        """Scans the blobs of versions (blob, text) that have no row for these rules, each once. A job that is run
        again finds what the last one committed; blobs of a failed job are scanned again."""
        seen = self.rows().filter(F.col("rules") == rules).select("blob")
        fresh = versions.select("blob", "text").dropDuplicates(["blob"]).join(seen, "blob", "left_anti")
        fresh.select("blob", F.lit(rules).alias("rules"), arrow_udf(_scan_column, FOUND)("text").alias("found")).write.mode("append").option("compression", "zstd").parquet(self.path)


def blob(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def with_findings(docs: DataFrame, text_col: str = "text", ledger: Ledger | None = None, rules: str = RULES_VERSION, out: str = "found", keep_text: bool = True) -> DataFrame:
    """docs with the column `out`: spans (kind, start, end) in code points, empty if none.

    docs may hold any number of paths and historical versions, one a row; a null text is an empty blob. Without a ledger a
    new one is begun. Repeated rows are one blob and each get its spans; an empty table gives an empty one. A text of any length
    is scanned whole. Columns stay, whatever their names; one that is already named `out` is replaced.
    """
    spark = docs.sparkSession
    ledger = ledger or Ledger(spark, scratch_path(spark, "ledger"))
    ledger.update(docs.select(blob(col(text_col)).alias("blob"), F.coalesce(col(text_col), F.lit("")).alias("text")), rules)
    key, hit = free(docs, "blob"), free(docs, "hits")
    hits = ledger.rows().filter((F.col("rules") == rules) & (F.size("found") > 0)).select(F.col("blob").alias(key), F.col("found").alias(hit)).dropDuplicates([key])
    kept = [col(c) for c in docs.columns if c != out and (keep_text or c != text_col)]
    base = docs.select(*kept, blob(col(text_col)).alias(key))
    return base.join(hits, key, "left").select(*kept, F.coalesce(F.col(hit), F.expr(f"cast(array() as {FOUND})")).alias(out))


def _digest_column(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in column:
        rows = []
        for found in batch.to_pylist():
            spans = [(x["kind"], x["start"], x["end"]) for x in found or []]
            base = [x for x in spans if x[0] in BASE]
            rows.append({"n_assign": sum(x[0] == "assign" for x in base), "n_access": sum(x[0] == "access" for x in base), "n_hex": sum(x[0] == "hex" for x in base), "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(), "spans": joined(spans)})
        yield pa.array(rows, pa.struct([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: Ledger | None = None) -> DataFrame:
    """One row per document with counts and digests of its spans. Repeated rows each have a row; ids may be null."""
    rows = with_findings(spread(docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))), ledger=ledger, keep_text=False)
    udf = arrow_udf(_digest_column, "struct<n_assign:long,n_access:long,n_hex:long,base_sha256:string,spans:string>")
    return rows.withColumn("d", udf("found")).select("doc_id", "d.*")


def redact(docs: DataFrame, text_col: str = "text", ledger: Ledger | None = None) -> DataFrame:
    """docs with each span of its texts replaced by [kind]; overlapping spans are one, under the first one's kind. All
    rows and columns stay, whatever their names; texts without findings are as they were, null ones stay null. An empty table
    gives an empty one."""
    out = free(docs, "spans")
    rows = with_findings(docs, text_col, ledger, out=out)

    def masked(text: pa.Array, spans: pa.Array) -> pa.Array:
        done = []
        for t, found in zip(text.to_pylist(), spans.to_pylist()):
            if not found or t is None:
                done.append(t)
                continue
            parts, at, kind = [], 0, None
            for x in found:
                if kind is not None and x["start"] < at:
                    at = max(at, x["end"])
                    continue
                parts += [t[at : x["start"]], f"[{x['kind']}]"]
                at, kind = x["end"], x["kind"]
            done.append("".join(parts) + t[at:])
        return pa.array(done, pa.string())

    new = arrow_udf(masked, "string")(col(text_col), F.col(out))
    return rows.select(*[new.alias(c) if c == text_col else col(c) for c in docs.columns])
