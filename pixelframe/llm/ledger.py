"""Secret scans with an incremental ledger of blobs.

Every version of every file is addressed by the SHA-256 of its content. The ledger says which rule of which
version has seen which blob, and what it found. A scan brings each blob that some rule has not seen
to one task, once, however many paths and versions hold it, runs only the unseen rules, and joins the
findings, old and new, back to all paths.

Copies of a blob are dropped before the shuffle (a partial aggregation), so a blob that a third of all rows
share is sent once by each task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, whole_row

Spans = Callable[[str], Iterator[tuple[int, int]]]


@dataclass(frozen=True)
class Rule:
    """A kind of secret: where it stands among kinds, its version, and how it is found in a text."""

    name: str
    rank: int
    version: int
    pattern: str
    flags: int = 0
    #: One of these must be in the text (lower-cased if ``folded``), or the pattern isn't run.
    hints: tuple[str, ...] = ()
    folded: bool = False
    least: int = 0
    group: int = 0

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"

    def compiled(self) -> Callable[[str, str], list[tuple[int, int]]]:
        """Leftmost non-overlapping matches whose group has ``least`` characters; (text, lower-cased text) to spans."""
        find, least, group, hints, folded = re.compile(self.pattern, self.flags).finditer, self.least, self.group, self.hints, self.folded

        def spans(text: str, lower: str) -> list[tuple[int, int]]:
            if hints and not any(h in (lower if folded else text) for h in hints):
                return []
            return [m.span() for m in find(text) if m.end(group) - m.start(group) >= least]

        return spans


_I = re.IGNORECASE | re.ASCII
#: The three base kinds, then well-known formats of providers.
RULES: tuple[Rule, ...] = (
    Rule("assign", 0, 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _I, ("password", "passwd", "secret", "token", "api_key", "apikey"), True, 12, 2),
    Rule("access", 1, 1, r"AKIA[A-Z0-9]+", 0, ("AKIA",), False, 18),
    # A run of fewer characters fails as a whole, so only runs that are long enough need to be looked for.
    Rule("hex", 2, 1, r"[0-9a-f]{16,}", 0, (), False, 16),
    Rule("github", 3, 1, r"\b(?:gh[pousr]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{50,255})", 0, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_")),
    Rule("slack", 4, 1, r"\bxox[abprs]-[A-Za-z0-9-]{10,250}", 0, ("xox",)),
    Rule("google", 5, 1, r"\bAIza[A-Za-z0-9_-]{35}", 0, ("AIza",)),
    Rule("jwt", 6, 1, r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, ("eyJ",)),
    Rule("private_key", 7, 1, r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----|\Z)", 0, ("PRIVATE KEY-----",)),
    Rule("url_login", 8, 1, r"://[^\s/:@]{1,100}:[^\s/:@]{3,100}@", 0, ("://",)),
)
BASE = ("assign", "access", "hex")

_SPAN = pa.struct([("kind", pa.string()), ("rank", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_SPAN_DDL = "array<struct<kind:string,rank:int,start:int,end:int>>"
LEDGER_DDL = f"blob string, rule string, spans {_SPAN_DDL}"


def blob_of(content: str | Column) -> Column:
    """The SHA-256 of the content's UTF-8 bytes; null counts as empty."""
    content = F.col(content) if isinstance(content, str) else content
    return F.sha2(F.coalesce(content, F.lit("")).cast("binary"), 256)


def _scanner(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = [(r, r.compiled()) for r in rules]
        folded = any(r.folded for r in rules)
        for batch in batches:
            blobs, keys, spans = [], [], []
            for i in range(batch.num_rows):
                text = (batch.column(1)[i].as_py() or b"").decode("utf-8", "replace")
                seen = batch.column(2)[i].as_py() or ()
                lower = text.lower() if folded else text
                for rule, of in find:
                    if rule.key not in seen:
                        blobs.append(batch.column(0)[i].as_py())
                        keys.append(rule.key)
                        spans.append([{"kind": rule.name, "rank": rule.rank, "start": a, "end": b} for a, b in of(text, lower)])
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.string()), pa.array(keys, pa.string()), pa.array(spans, pa.list_(_SPAN))], names=["blob", "rule", "spans"])

    return run


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, rule, spans): one for each blob of ``versions`` (content) and rule that ``ledger`` lacks."""
    held = versions.select(blob_of("content").alias("blob"), F.col("content").cast("binary").alias("content"))
    # Copies go before the shuffle; what is known of a blob then comes to where its content is.
    once = held.groupBy("blob").agg(F.first("content").alias("content"))
    if ledger is None:
        once = once.select("blob", "content", F.lit(None).cast("array<string>").alias("seen"))
    else:
        wanted = [r.key for r in rules]
        seen = ledger.where(F.col("rule").isin(wanted)).groupBy("blob").agg(F.collect_set("rule").alias("seen")).withColumnRenamed("blob", "of")
        known = once.join(seen, F.col("blob") == F.col("of"), "left").select("blob", "content", "seen")
        once = known.where(F.col("seen").isNull() | (F.size("seen") < len(wanted)))
    return once.mapInArrow(_scanner(rules), LEDGER_DDL)


def _found(rows: DataFrame, name: str) -> DataFrame:
    """(of, spans): the blobs with findings. Staged, so that the join with all rows may split a blob that many share."""
    return staged(rows.where(F.size("spans") > 0).groupBy(F.col("blob").alias("of")).agg(F.flatten(F.collect_list("spans")).alias(name)), "findings")


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Scans ``versions`` (path, version, content); returns (findings by path, ledger rows to append).

    Findings have one row for each row of ``versions``: path, version, blob and ``spans``, an array of (kind, rank,
    start, end) in code points, by start and then rank; empty where nothing was found. The new ledger rows are
    staged in the shared folder: scanning happens once. Store them with the ledger for the next scan.

    Nulls: null content is empty content; null paths and versions are carried. Very long contents are scanned whole.
    Equal contents are one blob. Repeated rows have a row each. Other columns are not read. Empty tables give
    empty results.
    """
    new = staged(scan_unseen(versions, ledger, rules), "ledger")
    wanted = [r.key for r in rules]
    every = new if ledger is None else new.unionByName(ledger.where(F.col("rule").isin(wanted)).dropDuplicates(["blob", "rule"]))
    found = _found(every, "found")
    paths = versions.select("path", "version", blob_of("content").alias("blob"))
    joined = paths.join(found, F.col("blob") == F.col("of"), "left")
    by_start = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"])
    spans = F.when(F.col("found").isNull(), F.array().cast(_SPAN_DDL)).otherwise(F.array_sort(F.col("found"), by_start))
    return joined.select("path", "version", "blob", spans.alias("spans")), new


def scan_history(pushes: Sequence[DataFrame], rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scans the versions (path, version, content) of one push after the other; returns (findings of all, ledger rows to append).

    Each push is scanned with the ledger that those before it have filled, so only blobs that are new in it are read by the
    rules. Otherwise as :func:`scan`.
    """
    found, added, known = [], [], ledger
    for versions in pushes:
        of_push, new = scan(versions, known, rules)
        found.append(of_push)
        added.append(new)
        known = new if known is None else known.unionByName(new)
    return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, added)


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret of its texts replaced by ``mark`` and n_chars, where it is a column, counted anew.

    All rows and columns stay; only documents whose blob has findings are changed. Overlapping spans are one. Null texts
    stay null, empty ones empty; very long ones are read whole. Repeated rows are changed alike. An empty table gives an
    empty result.
    """
    versions = docs.select(F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("version"), F.col("text").alias("content"))
    new = staged(scan_unseen(versions, None, rules), "ledger")
    found = _found(new, "spans")
    row = docs.select(whole_row(docs), blob_of("text").alias("blob"))
    joined = row.join(found, F.col("blob") == F.col("of"), "left")
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state: Column, s: Column) -> Column:
        # A span that begins inside the last one only moves its end.
        before = F.substring(F.col("row.text"), state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        apart = s["start"] >= state["at"]
        return F.struct(F.when(apart, F.concat(state["out"], before, F.lit(mark))).otherwise(state["out"]).alias("out"), F.greatest(state["at"], s["end"]).alias("at"))

    text = F.aggregate(ordered, start, step, lambda s: F.concat(s["out"], F.substring(F.col("row.text"), s["at"] + 1, F.length(F.col("row.text")))))
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(text)
    changed = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        changed = F.when(F.col("spans").isNull(), F.col("row")).otherwise(changed.withField("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)))
    return joined.select(changed.alias("row")).select("row.*")


def digest(spans: list[dict]) -> str:
    """The SHA-256 of the joined base spans, as the query gives it; for checks in Python."""
    return hashlib.sha256(",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans if s["kind"] in BASE).encode()).hexdigest()
