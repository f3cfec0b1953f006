"""Secret scan with corpus-wide ownership frequency (DataFrame functions only).

Matches of each kind are cut out with ``regexp_extract_all`` and placed with the lengths of what
``split`` leaves between them. Each candidate value is hashed; the corpus is aggregated to the
distinct repositories (documents) and owners (sources) that hold a hash. A value that several
owners hold is a copied example; one that a single owner holds in few repositories looks live.

Defined results: a null text is empty and has no span; repeated rows are reported each, and count
as one repository; a null owner or repository counts as one of its own; an empty table gives no
row. Columns other than id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: kind -> (pattern, group that holds the value, least length of the value). Fixed values.
BASE = {
    "assign": (r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 16),
    "hex": (r"([0-9a-f]{32,})", 1, 32),
}
#: What the scan adds to the base kinds.
ADDED = {
    "pem": (r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, 1),
    "bearer": (r"(?:[bB]earer)\x20+([A-Za-z0-9+/_.~=-]{20,})", 1, 20),
}
#: Cheap test that a text can hold a match of the kind at all.
CUES = {"access": "AKIA", "pem": "PRIVATE KEY-----", "bearer": "earer "}
#: Spans that are gathered before they are set aside.
RUN = 256
#: A value held by more owners than this is a copied example, as is one in more repositories.
MAX_LIVE_OWNERS = 1
MAX_LIVE_REPOSITORIES = 5


def spans_of(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<kind, start, end, value>> of the leftmost, non-overlapping matches, code points."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    parts = F.arrays_zip(between.alias("gap"), whole.alias("hit"), value.alias("value"))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"), F.array().cast("array<array<struct<kind:string,start:int,end:int,value:string>>>").alias("full"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["value"].alias("value"))
        keep = x["hit"].isNotNull() & (F.length(x["value"]) >= least)
        over = keep & (F.size(acc["out"]) >= RUN)  # appending copies a run, not all spans
        out = F.when(over, F.array(span)).when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"), F.when(over, F.concat(acc["full"], F.array(acc["out"]))).otherwise(acc["full"]).alias("full"))

    return F.aggregate(parts, start, step, lambda acc: F.flatten(F.concat(acc["full"], F.array(acc["out"]))))


def ranked(spans: Column, rank: int) -> Column:
    """The spans in a form that sorts by start, then kind."""
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["kind"].alias("kind"), x["end"].alias("end"), x["value"].alias("value")))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """uid, repository, owner, spans (array of rank, kind, start, end, value) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = []
    for rank, (kind, spec) in enumerate({**BASE, **ADDED}.items()):
        hits = spans_of(F.col("text"), kind, *spec)
        hits = ranked(hits, rank)
        if kind in CUES:
            hits = F.when(F.col("text").contains(CUES[kind]), hits).otherwise(F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,value:string>>"))
        found.append(hits)
    return docs.select(F.col(id_col).alias("repository"), F.col(owner_col).alias("owner"), text.alias("text")).select(
        F.monotonically_increasing_id().alias("uid"), "repository", "owner", F.array_sort(F.concat(*found)).alias("spans")
    )


def ownership(values: DataFrame) -> DataFrame:
    """hash, owners, repositories over rows of (hash, repository, owner).

    Counted in three steps, each combined before its shuffle, so a value that a third of all
    documents hold never meets in one task.
    """
    once = values.select("hash", "owner", "repository").distinct()
    per_owner = once.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return per_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """repository, owner, spans, live, copied of every row of docs.

    spans: array of (start, rank, kind, end, value) by start, then kind. live and copied: how many
    of the values look live and how many are widely copied.
    """
    found = materialize(find(docs, id_col, text_col, owner_col), "secret-spans")
    values = found.where(F.size("spans") > 0).select("uid", "repository", "owner", F.explode("spans").alias("s"))
    values = values.select("uid", "repository", "owner", F.sha2(F.col("s.value"), 256).alias("hash"))
    live = (F.col("owners") <= MAX_LIVE_OWNERS) & (F.col("repositories") <= MAX_LIVE_REPOSITORIES)
    verdicts = (
        values.select("uid", "hash").join(ownership(values), "hash")
        .groupBy("uid").agg(F.count_if(live).alias("live"), F.count_if(~live).alias("copied"))
    )
    return found.join(verdicts, "uid", "left").select(
        "repository", "owner", "spans", F.coalesce("live", F.lit(0)).cast("long").alias("live"), F.coalesce("copied", F.lit(0)).cast("long").alias("copied")
    )


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return scanned.select(
        F.col("repository").alias("doc_id"),
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.col("live").alias("n_live"), F.col("copied").alias("n_copied"),
    )
