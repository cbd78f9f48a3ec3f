"""Secret scans with corpus-wide ownership frequency, with SQL functions only.

Base kinds are three fixed patterns (`assign`, `access`, `hex`), each taken leftmost and without overlaps over the
whole text; matches that are too short are dropped after matching, as their characters are used up.  The method adds
the kind `owned`: runs of 16 or more token characters with a letter and a digit and at least 8 different characters,
whose hash occurs under at most `max_owners` distinct owners in the whole corpus.  Widely copied examples occur under
more owners and are not added.  Base matches stay whatever their frequency; their value gets the same verdict.

Offsets are code points.  Splitting a text at a pattern gives the gaps between its matches; a running sum over gaps
and matches gives the offsets without a Python function.

A null text is empty (no findings), a null owner or repository counts as one nameless owner.  Repeated rows are rows
of their own, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Fixed values of the contract.
ASSIGN = (
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: The same matches as the plain patterns leave after the length filter; shorter runs need no visit.
ACCESS_LONG = r"AKIA[A-Z0-9]{16,}"
HEX_LONG = r"(?<![0-9a-f])[0-9a-f]{24,}"
OWNED = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}"
KINDS = ("assign", "access", "hex", "owned")
PATTERNS = {"assign": (ASSIGN, 2), "access": (ACCESS_LONG, 0), "hex": (HEX_LONG, 0), "owned": (OWNED, 0)}


def _hits(text: Column, kind: str) -> Column:
    """array<struct<kind_no, nth, gap, length, value>>: gap is the number of code points since the match before."""
    pattern, group = PATTERNS[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    zipped = F.arrays_zip(whole.alias("whole"), value.alias("value"), F.split(text, pattern, -1).alias("gap"))
    found = F.transform(zipped, lambda z, i: F.struct(
        F.lit(KINDS.index(kind)).alias("kind_no"), i.alias("nth"), F.char_length(z["gap"]).alias("gap"),
        F.char_length(z["whole"]).alias("length"), z["value"].alias("value"),
    ))
    found = F.filter(found, lambda z: z["length"].isNotNull())  # the last gap has no match
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(F.filter(found, lambda z: F.lit(False)))


def candidates(docs: DataFrame, text: str = "text", owner: str = "source", repositories=("source", "lang")) -> DataFrame:
    """One row per match of any kind, and one with a null kind for a document without: row_id, doc_id, owner,
    repository, kind_no, start, end, value_sha256, live_looking.

    `row_id` follows the order of the scan, so the result has to be stored before it is used twice.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    numbered = docs.select(  # before the hits are spread: one number per document
        F.monotonically_increasing_id().alias("row_id"), "doc_id", name(owner).alias("owner"),
        F.to_json(F.struct(*[name(c).alias(f"r{i}") for i, c in enumerate(repositories)])).alias("repository"),
        whole.alias("whole"),
    )
    hits = F.concat(*[_hits(F.col("whole"), k) for k in KINDS])
    rows = numbered.select("row_id", "doc_id", "owner", "repository", F.explode_outer(hits).alias("hit")).select(
        "row_id", "doc_id", "owner", "repository", "hit.*"
    )
    before = Window.partitionBy("row_id", "kind_no").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("gap") + F.coalesce(F.sum(F.col("gap") + F.col("length")).over(before), F.lit(0))
    long_enough = F.col("kind_no").isNull() | (F.col("kind_no") != 0) | (F.char_length("value") >= LEAST["assign"])
    varied = F.size(F.array_distinct(F.split("value", ""))) >= 8
    return (
        rows.withColumn("start", start)
        .select(
            "row_id", "doc_id", "owner", "repository",
            F.when(long_enough, F.col("kind_no")).alias("kind_no"),
            "start", (F.col("start") + F.col("length")).alias("end"),
            F.sha2("value", 256).alias("value_sha256"),
            (varied & (F.char_length("value") >= 16)).alias("live_looking"),
        )
    )


def ownership(found: DataFrame) -> DataFrame:
    """Per value hash: distinct owners and repositories, and places.  Counted per (value, owner, repository) first, so
    a widely copied value moves one row per owner and task."""
    per = found.groupBy("value_sha256", "owner", "repository").agg(F.count(F.lit(1)).alias("places"))
    return per.groupBy("value_sha256").agg(
        F.countDistinct("owner").alias("n_owners"), F.count(F.lit(1)).alias("n_repositories"), F.sum("places").alias("n_places")
    )


def scan(steps, docs: DataFrame, max_owners: int = 2, **columns) -> DataFrame:
    """Findings of all documents: the candidate columns with n_owners, n_repositories, n_places and
    verdict ('owner_specific', 'widely_copied', 'weak').  `owned` candidates that are not owner-specific are no
    findings; a document without findings keeps one row with a null kind."""
    found = steps.store(candidates(docs, **columns))
    hits = found.where(F.col("kind_no").isNotNull())
    # documents without a hit have no value to look up: they stay out of the join
    rows = hits.join(ownership(hits), "value_sha256").unionByName(found.where(F.col("kind_no").isNull()), allowMissingColumns=True)
    verdict = (
        F.when(F.col("kind_no").isNull(), None).when(~F.col("live_looking"), "weak")
        .when(F.col("n_owners") <= max_owners, "owner_specific").otherwise("widely_copied")
    )
    rows = rows.withColumn("verdict", verdict)
    stays = (F.col("kind_no") < KINDS.index("owned")) | (F.col("verdict") == "owner_specific")
    return rows.withColumn("kind_no", F.when(stays, F.col("kind_no")))


def per_document(findings: DataFrame) -> DataFrame:
    """Counts and spans of each document, by start, then kind as listed."""
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind_no") + 1)
    span = F.when(F.col("kind_no").isNotNull(), F.struct(
        F.col("start"), F.col("kind_no"), F.concat_ws(":", kind, F.col("start").cast("string"), F.col("end").cast("string")).alias("text")
    ))
    rows = findings.groupBy("row_id").agg(
        F.first("doc_id").alias("doc_id"),
        *[F.count(F.when(F.col("kind_no") == i, 1)).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.count(F.when((F.col("kind_no") < 3) & (F.col("verdict") == "owner_specific"), 1)).alias("n_live_base"),
        F.sort_array(F.collect_list(span)).alias("_spans"),
    )
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: s["text"]), ",")
    return rows.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(joined(F.filter("_spans", lambda s: s["kind_no"] < 3)), 256).alias("base_sha256"),
        joined(F.col("_spans")).alias("spans"), "n_owned", "n_live_base",
    )
