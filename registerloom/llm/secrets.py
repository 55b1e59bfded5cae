"""Secret scans with multipart credential linking, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ._rows import checked_broadcast, numbered, save, scope

#: Kinds that stand on their own, in the order in which equal starts are listed: name, pattern, group and its least length.
BASE = (
    ("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8),
    ("access", r"(AKIA[A-Z0-9]{12,})", 16),
    ("hex", r"([0-9a-f]{32,})", 32),
)
#: Weak candidates: reported only near parts that complete them.
WEAK = (
    ("id", r"(?i:access_?key_?id|client_?id|account_?id|user_?name|user|login)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._@-]+)", 3),
    ("key", r"(?i:pwd|passphrase|private_?key|client_?key|credentials?|auth)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=!@#%^*-]+)", 6),
    ("endpoint", r"((?i:https?|ftps?|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqp|jdbc:[a-z]+)://[^\x20\x09-\x0D\"'<>]+)", 8),
)
#: Part that each kind plays in a credential.
ROLE = {"assign": "secret", "hex": "secret", "key": "secret", "access": "id", "id": "id", "endpoint": "endpoint"}
#: Blank lines separate scopes; within a scope parts belong together if no more characters lie between them.
SCOPE_GAP = 240
_BREAK = r"(\n[\x20\x09\x0D]*\n)"
_KINDS = [*BASE, *WEAK]
_ORDER = {name: i for i, (name, _, _) in enumerate(_KINDS)}
_ITSELF = "cast(array(named_struct('ord', null, 'at', 0, 'before', null, 'size', null, 'good', null)) as array<struct<ord:int,at:int,before:int,size:int,good:boolean>>)"
_NONE = "cast(array() as array<struct<ord:int,at:int,before:int,size:int,good:boolean>>)"


def _matches(text: Column, order: int, pattern: str, least: int) -> Column:
    """All leftmost matches of one pattern, as the lengths of what lies before each and of the match itself.

    The pieces between matches and the matches alternate, so their lengths give every position in code points.
    """
    rx = F.lit(pattern)
    whole, part, pieces = F.regexp_extract_all(text, rx, F.lit(0)), F.regexp_extract_all(text, rx, F.lit(1)), F.split(text, pattern, -1)
    rows = F.transform(
        F.arrays_zip(pieces.alias("p"), whole.alias("w"), part.alias("g")),
        lambda x, i: F.struct(
            F.lit(order).alias("ord"), i.alias("at"), F.length(x["p"]).alias("before"), F.length(x["w"]).alias("size"), (F.length(x["g"]) >= least).alias("good")
        ),
    )
    return F.when(F.regexp_like(text, rx), F.filter(rows, lambda x: x["size"].isNotNull())).otherwise(F.expr(_NONE))


def find_parts(docs: DataFrame) -> DataFrame:
    """rid, doc_id, ord, start, end of every match and candidate, and for each document one row with null ord."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = numbered(docs).select("rid", F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    weak = reduce(lambda a, b: a | b, (F.regexp_like(F.col("text"), F.lit(p)) for _, p, _ in WEAK))
    parts = [_matches(F.col("text"), i, p, least) for i, (_, p, least) in enumerate(_KINDS)]
    # scopes matter only beside a weak candidate
    parts.append(F.when(weak, _matches(F.col("text"), len(_KINDS), _BREAK, 1)).otherwise(F.expr(_NONE)))
    parts.append(F.expr(_ITSELF))
    rows = rows.select("rid", "doc_id", F.explode(F.concat(*parts)).alias("m")).select("rid", "doc_id", "m.*")
    run = F.sum(F.col("before") + F.col("size")).over(Window.partitionBy("rid", "ord").orderBy("at"))
    return rows.withColumn("end", run).withColumn("start", F.col("end") - F.col("size")).filter("good is null or good").select("rid", "doc_id", "ord", "start", "end")


def _sides(*scope: str) -> tuple[WindowSpec, WindowSpec]:
    """Windows of all parts before a part, and of all after it: in falling order too, as a frame that only grows is summed up
    row by row, while one that shrinks is gone through again for each row."""
    rising = Window.partitionBy(*scope).orderBy("start", "ord")
    falling = Window.partitionBy(*scope).orderBy(F.desc("start"), F.desc("ord"))
    return tuple(w.rowsBetween(Window.unboundedPreceding, -1) for w in (rising, falling))


def link(parts: DataFrame) -> DataFrame:
    """parts without breaks and without the weak candidates that nothing completes.

    An interval join by neighbours: in order of position, each candidate's closest parts of every role before and after it
    are looked up in one pass in either direction, so a document's work grows with its parts and not with their pairs.
    """
    by_start = Window.partitionBy("rid").orderBy("start", "ord")
    before, after = _sides("rid")
    kinds = [name for name, _, _ in _KINDS]
    base, breaks = F.col("ord") < len(BASE), F.col("ord") == len(_KINDS)
    rows = parts.withColumn("block", F.count(F.when(breaks, 1)).over(by_start))
    # a candidate over a base span says nothing new
    covered = (F.max(F.when(base, F.col("end"))).over(before) > F.col("start")) | (F.min(F.when(base, F.col("start"))).over(after) < F.col("end"))
    rows = rows.withColumn("covered", ~base & F.coalesce(covered, F.lit(False))).filter(~breaks | F.col("ord").isNull()).filter("ord is null or not covered")
    before, after = _sides("rid", "block")

    def near(role: str) -> Column:
        of = F.col("ord").isin([_ORDER[k] for k in kinds if ROLE[k] == role])
        gap_before = F.col("start") - F.max(F.when(of, F.col("end"))).over(before)
        gap_after = F.min(F.when(of, F.col("start"))).over(after) - F.col("end")
        return F.coalesce(gap_before <= SCOPE_GAP, F.lit(False)) | F.coalesce(gap_after <= SCOPE_GAP, F.lit(False))

    rows = rows.withColumns({f"near_{r}": near(r) for r in ("id", "secret", "endpoint")})
    complete = (
        F.when(F.col("ord") < len(BASE), True)
        .when(F.col("ord") == _ORDER["id"], F.col("near_secret"))
        .when(F.col("ord") == _ORDER["key"], F.col("near_id") | F.col("near_endpoint"))
        .when(F.col("ord") == _ORDER["endpoint"], F.col("near_id") & F.col("near_secret"))
    )
    return rows.withColumn("linked", complete).filter("ord is null or linked").select("rid", "doc_id", "ord", "start", "end")


def _listed(condition: Column) -> Column:
    spans = F.array_sort(F.collect_list(F.when(condition, F.struct("start", "ord", "end"))))
    names = F.array(*[F.lit(name) for name, _, _ in _KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["ord"] + 1), x["start"], x["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, n_linked, base_sha256, spans, rid.

    Base spans are the leftmost non-overlapping matches of each base kind that are long enough; assignments too short are
    passed over with all they matched. Weak candidates (identifiers, weakly named keys, endpoints) count only if the parts
    that complete them lie within SCOPE_GAP characters and no blank line between: an identifier by a secret, a key by an
    identifier or an endpoint, an endpoint by both. Positions are code points, ends exclusive.

    Nulls and empty texts have no spans; a null doc_id is returned as it is. Repeated rows are scanned each. An empty table
    gives no rows; other columns are ignored.
    """
    rows = link(find_parts(docs))
    counts = {f"n_{name}": F.count(F.when(F.col("ord") == i, 1)) for i, (name, _, _) in enumerate(BASE)}
    out = rows.groupBy("rid", "doc_id").agg(
        *[v.alias(k) for k, v in counts.items()],
        F.count(F.when(F.col("ord") >= len(BASE), 1)).alias("n_linked"),
        F.sha2(_listed(F.col("ord") < len(BASE)).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("ord").isNotNull()).alias("spans"),
    )
    return out.select("doc_id", *counts, "n_linked", "base_sha256", "spans", "rid")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of its secrets replaced by mark in text, and n_chars, where there is one, counted anew.

    Spans that overlap are replaced by one mark. Nulls and empty texts stay as they are, repeated rows are treated each, an
    empty table gives no rows; other columns stay, whatever their names.
    """
    rows = numbered(docs, "__loom_rid")
    with scope():
        spans = link(find_parts(rows)).filter("ord is not null")
        w = Window.partitionBy("rid").orderBy("start", "end")
        spans = spans.withColumn("last", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("fresh", (F.coalesce(F.col("last"), F.lit(-1)) < F.col("start")).cast("int"))
        spans = spans.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        islands = spans.groupBy("rid", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        cuts = islands.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__loom_cuts")).withColumnRenamed("rid", "__loom_at")
        cuts = save(cuts, keep=True)
    n_cuts = cuts.agg(F.sum(F.size("__loom_cuts") + 1)).first()[0] or 0  # not the rows: one may hold many
    rows = rows.join(checked_broadcast(cuts, n_cuts), F.col("__loom_rid") == F.col("__loom_at"), "left")
    cut, text = F.col("__loom_cuts"), F.col("text")
    # what lies before each span, and after the last one
    from_ = F.concat(F.array(F.lit(0).cast("long")), F.transform(cut, lambda x: x["end"].cast("long")))
    to = F.concat(F.transform(cut, lambda x: x["start"].cast("long")), F.array(F.length(text).cast("long")))
    pieces = F.zip_with(from_, to, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    rows = rows.withColumn("text", F.when(cut.isNotNull(), F.array_join(pieces, mark)).otherwise(text))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(cut.isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)
