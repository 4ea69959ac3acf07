"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every path is content-addressed by SHA-256. A ledger (a folder of two tables, scanned and found)
remembers which rule versions have seen which blob and what they found; only unseen pairs are scanned, each
distinct blob once, and findings are joined back to all paths that hold the blob.

Which rows are scanned is settled on blob ids alone. Blobs that differ from what most need (seen before, of other
rule versions, or with several rows of which one is scanned) are broadcast while they fit BROADCAST_BYTES; beyond,
texts are shuffled once, combined before. Matches become rows, and a running sum of their lengths gives places.

Defined results: a null text counts as empty (and is no secret); repeated rows are paths of their own with equal
findings; an empty table gives an empty one. Offsets are code points, ends exclusive. A private key is found from its
BEGIN line to its END line whatever prefixes, header fields or escaped line ends its lines have; where END is missing
or damaged, to its last run of base64, with a short line right after it. Work is linear in a text's length, however
long it is and however often a rule matches or nearly matches.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm.shared import BROADCAST_BYTES, new_path, removed, written


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern, kept if the group has at least `least` characters.

    sql: the same for engines without lookbehind: group 1 is the match, one character stands before it.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False
    sql: str = ""

    @property
    def version(self) -> str:
        return f"{self.kind}@{hashlib.sha256(f'{self.pattern}|{self.group}|{self.least}'.encode()).hexdigest()[:12]}"


# The parts of a private key, in the syntax common to Java, Python and RE2. Nothing repeats a group without
# a bound, since Java's matcher takes stack for each round: isolated dashes before END (header fields, lines of a diff).
_BEGIN = r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
_TO_END = r"[^-]*(?:-[^-]+){0,400}-?-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
_BETWEEN = r"""\x09-\x0D\x20\\"',>#*|"""
_FIELDS = rf"(?:[{_BETWEEN}]*[A-Za-z][A-Za-z0-9-]*:\x20[^\r\n]*[\r\n]){{0,20}}"
_BODY = rf"[{_BETWEEN}]*[A-Za-z0-9+/=]{{16,}}(?:[{_BETWEEN}A-Za-z0-9+/=]*[A-Za-z0-9+/=]{{24,}})?"
_LAST = r"(?:[\x09\x20]*(?:\r?\n|\\n)[\x09\x20>#*]*[A-Za-z0-9+/]+={0,2})?(?:[\x09\x20]*(?:\r?\n|\\n)[\x09\x20>#*]*=[A-Za-z0-9+/]{4})?"

# A token begins where its run of characters does, so each run is looked at once or twice.
_JWT = r"[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"

# The rules, base ones first; their order breaks ties.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
    Rule("private_key", f"{_BEGIN}(?:{_TO_END}|{_FIELDS}{_BODY}{_LAST})?"),
    Rule("jwt", rf"eyJ(?<![A-Za-z0-9_-]eyJ){_JWT}", sql=rf"[^A-Za-z0-9_-](eyJ{_JWT})"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._~%-]+:([A-Za-z0-9._~%!$&*+,;=-]+)@", 1, 4),
)
#: reach: where the spans before this one end.
SPAN = "struct<start:int,rank:int,end:int,reach:int>"
MATCH = "struct<rank:int,i:int,gap:int,whole:int,kept:int>"
SCANNED, FOUND = "blob string, rule_versions array<string>", "blob string, rule_version string, start int, end int"


def rule_matches(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's matches in text, with the lengths of what lies before each, of itself and of its group."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    between = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole))
    fields = lambda x, i: (F.lit(rank), i, F.length(x["gap"]), F.length(x["whole"]), F.length(x["kept"]))
    row = lambda x, i: F.struct(*[c.alias(n) for c, n in zip(fields(x, i), ("rank", "i", "gap", "whole", "kept"), strict=True)]).cast(MATCH)
    return F.when(text.rlike(rule.pattern), F.transform(F.arrays_zip(between.alias("gap"), whole.alias("whole"), group.alias("kept")), row)).otherwise(F.array().cast(f"array<{MATCH}>"))


def found_spans(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """FOUND rows of blobs (blob, __text, __todo: the ranks of the rules to apply)."""
    none = F.array().cast(f"array<{MATCH}>")
    matches = F.concat(*[F.when(F.array_contains("__todo", k), rule_matches(F.col("__text"), r, k)).otherwise(none) for k, r in enumerate(rules)])
    # explode_outer: for explode the optimizer adds a filter on the array, which would compute it twice.
    rows = blobs.select("blob", F.explode_outer(matches).alias("m")).where("m IS NOT NULL").select("blob", "m.*")
    end = F.sum(F.col("gap") + F.col("whole")).over(Window.partitionBy("blob", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    of_rule = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("rank") + 1)
    spans = rows.withColumn("end", end).where(F.col("kept") >= of_rule([r.least for r in rules]))
    return spans.select("blob", of_rule([r.version for r in rules]).alias("rule_version"), (F.col("end") - F.col("whole")).alias("start"), "end")


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A table of the ledger, None if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def update_ledger(versions: DataFrame, text: str, path: str, rules: tuple[Rule, ...] = RULES) -> int:
    """Scan what the ledger at path lacks, append it there, and return how many blobs were scanned.

    Findings are appended before the pairs they come from. If a run fails in between, the next scans those pairs
    again; findings appended twice count once.
    """
    spark = versions.sparkSession
    others = [F.col(f"`{c}`") for c in versions.columns if c != text]
    source = versions.select(F.col(f"`{text}`").alias("__text"), F.xxhash64(F.lit(0), *others).alias("__row")).where("__text != ''").withColumn("blob", blob_id(F.col("__text")))
    blobs = source.groupBy("blob").agg(F.min("__row").alias("__chosen"), F.count("*").alias("__n"))
    every = F.array(*[F.lit(k) for k in range(len(rules))])
    scanned = _table(spark, f"{path}/scanned", SCANNED)
    if scanned is None:
        todo = every
    else:
        seen = scanned.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rule_versions"))).alias("__seen"))
        blobs = blobs.join(seen, "blob", "left")
        todo = F.filter(every, lambda k: ~F.coalesce(F.array_contains("__seen", F.element_at(F.array(*[F.lit(r.version) for r in rules]), k + 1)), F.lit(False)))
    blobs = written(blobs.select("blob", "__chosen", "__n", todo.alias("__todo")), "secret-blobs")

    usual = blobs.groupBy("__todo").count().orderBy(F.desc("count"), "__todo").first()
    default = F.array(*map(F.lit, usual["__todo"])).cast("array<int>") if usual else every
    apart = blobs.where((F.col("__todo") != default) | ((F.col("__n") > 1) & (F.size("__todo") > 0)))
    if (apart.select(F.sum(160 + 4 * F.size("__todo"))).first()[0] or 0) <= BROADCAST_BYTES:
        rows = source.join(F.broadcast(apart), "blob", "left").where(F.coalesce(F.col("__chosen") == F.col("__row"), F.lit(True)))
        rows = rows.select("blob", "__text", F.coalesce("__todo", default).alias("__todo"))
    else:
        rows = source.groupBy("blob").agg(F.first("__text").alias("__text")).join(blobs.select("blob", "__todo"), "blob")
    found_spans(rows.where(F.size("__todo") > 0), rules).write.mode("append").parquet(f"{path}/found")
    new = blobs.where(F.size("__todo") > 0)
    new.select("blob", F.transform("__todo", lambda k: F.element_at(F.array(*[F.lit(r.version) for r in rules]), k + 1)).alias("rule_versions")).write.mode("append").parquet(f"{path}/scanned")
    count = new.count()
    removed(blobs)
    return count


def findings(spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans): all spans of the rules' present versions, by start and then rule; blobs without any left out."""
    present = F.array(*[F.lit(r.version) for r in rules])
    rows = _table(spark, f"{path}/found", FOUND).select("blob", "start", (F.array_position(present, F.col("rule_version")) - 1).cast("int").alias("rank"), "end").where("rank >= 0").distinct()
    before = Window.partitionBy("blob").orderBy("start", "rank", "end").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("reach", F.coalesce(F.max("end").over(before), F.lit(0)))
    return rows.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "reach").cast(SPAN))).alias("spans"))


def spelt(spans: Column, rules: tuple[Rule, ...], base_only: bool) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    n_base = sum(r.base for r in rules)
    kept = F.filter(spans, lambda x: x["rank"] < n_base) if base_only else spans
    return F.array_join(F.transform(kept, lambda x: F.concat(F.element_at(names, x["rank"] + 1), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def secret_scan(versions: DataFrame, text: str = "text", ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of versions with its blob and its spans (array of start, rank of the rule, end, reach), from the ledger.

    ledger is a folder that grows from run to run; without one a new one is made in the shared folder. Rules that
    were taken out keep their findings there, but aren't reported. Input columns named blob or spans are replaced.
    """
    path = ledger or new_path(versions.sparkSession, "secret-ledger")
    update_ledger(versions, text, path, rules)
    found = written(findings(versions.sparkSession, path, rules), "secret-findings")
    rows = versions.drop("blob", "spans").withColumn("blob", blob_id(versions[f"`{text}`"]))
    size = found.select(F.sum(80 + 16 * F.size("spans"))).first()[0] or 0
    joined = rows.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "blob", "left")
    return joined.withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with every span (overlapping ones together) replaced by mark."""

    def cut(chars: Column) -> Column:
        part = lambda a, b: F.array_join(F.slice(chars, a + 1, F.greatest(b - a, F.lit(0))), "")
        kept = F.transform(F.filter(spans, lambda x: x["start"] >= x["reach"]), lambda x: F.concat(part(x["reach"], x["start"]), F.lit(mark)))
        return F.concat(F.array_join(kept, ""), part(F.array_max(F.transform(spans, lambda x: x["end"])), F.size(chars)))

    # One element, so that the characters are taken apart once for all spans.
    once = F.transform(F.array(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))), cut)
    return F.when(F.size(spans) == 0, text).otherwise(once[0])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two increments of one ledger: the base rules see every blob, then all rules do, the base ones none again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = new_path(spark, "secret-ledger")
    update_ledger(docs, "text", path, tuple(r for r in RULES if r.base))
    found = secret_scan(docs, ledger=path).select("doc_id", "spans")
    count = lambda k: F.size(F.filter("spans", lambda x: x["rank"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(spelt(F.col("spans"), RULES, True), 256).alias("base_sha256"),
        spelt(F.col("spans"), RULES, False).alias("spans"),
    )


def _oracle() -> str:
    quoted = lambda p: p.replace("'", "''")
    parts = []
    for k, r in enumerate(RULES):
        p, group, source = (quoted(r.sql), 1, "' ' || text") if r.sql else (quoted(r.pattern), r.group, "text")
        s = "list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)"
        start, n = (f"{s} + length(m[i]) - length(c[i]) - 1", "length(c[i])") if r.sql else (s, "length(m[i])")
        parts.append(
            f"SELECT doc_id, {k} AS rank, '{r.kind}' AS kind, i, {start} AS s, {n} AS n, length(c[i]) AS kept, {r.least} AS least "
            f"FROM (SELECT doc_id, g, m, c, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {group}) AS c FROM (SELECT doc_id, {source} AS t FROM documents) WHERE regexp_matches(t, '{p}')))"
        )
    n = sum(r.base for r in RULES)
    return f"""
WITH f AS (SELECT doc_id, rank, kind, CAST(s AS BIGINT) AS s, CAST(s + n AS BIGINT) AS e FROM ({" UNION ALL ".join(parts)}) WHERE kept >= least),
a AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
 string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE rank < {n}) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id"""


ORACLE_SQL = _oracle()
