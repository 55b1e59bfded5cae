"""Versioned registers of courts: merging, the latest row of each id, triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X
from .graph import emit, iri, literal


def first_seen(rows: DataFrame, columns: tuple[str, ...] = S.REGISTRY_COLUMNS, order: tuple[str, ...] = ("Version", "file", "row")) -> DataFrame:
    """One row for each combination of columns, nulls included: the first in order, with its version."""
    order = [c for c in order if c in rows.columns]
    w = Window.partitionBy(*columns).orderBy(*order)
    return rows.withColumn("pos", F.row_number().over(w)).filter("pos = 1").drop("pos")


def latest(rows: DataFrame, key: str = "XJustizID", mark: str = "ValidUntil", version: str = "Version", ties: tuple[str, ...] = ("file", "row")) -> DataFrame:
    """The latest row of each id: rows with mark before those without, then the highest version, then the first.

    One window instead of two rankings and an anti-join; rows without an id vanish."""
    order = [F.col(mark).isNull(), F.desc(version), *[F.col(c) for c in ties if c in rows.columns]]
    w = Window.partitionBy(key).orderBy(*order)
    return rows.filter(F.col(key).isNotNull()).withColumn("pos", F.row_number().over(w)).filter("pos = 1").drop("pos")


def combine(rows: DataFrame) -> DataFrame:
    """The final register of all versions' rows, by id."""
    return latest(first_seen(rows)).select(*S.REGISTRY_COLUMNS, "Version").orderBy("XJustizID")


def triples(register: DataFrame) -> DataFrame:
    """Triples of register rows; a missing register type gives none, a missing postal code an empty one."""
    court = F.concat(F.lit(S.REGISTER_COURT), X.court_slug("RegisterCourt"))
    xid = F.concat(F.lit(S.XJUSTIZ), F.col("XJustizID"))
    day = X.iso_date("ValidUntil")
    kinds = F.transform(X.register_types("RegisterType"), lambda t: iri(xid, S.EXH + "hasRegisterType", F.concat(F.lit(S.REGISTER_TYPE), t)))
    base = emit(
        register,
        [
            F.when(F.col("RegisterCourt").isNotNull(), iri(court, S.A, F.lit(S.EXH + "RegisterCourt"))),
            F.when(F.col("RegisterCourt").isNotNull(), literal(court, S.RDFS + "label", F.col("RegisterCourt"), lang="de")),
            F.when(F.col("RegisterCourt").isNotNull() & xid.isNotNull(), iri(court, S.EXH + "hasXJustizID", xid)),
            F.when(xid.isNotNull(), iri(xid, S.A, F.lit(S.EXH + "XJustizID"))),
            F.when(xid.isNotNull(), literal(xid, S.EXH + "hasXJustizID", F.col("XJustizID"))),
            F.when(xid.isNotNull(), literal(xid, S.EXH + "hasPostalCode", F.coalesce("PLZ", F.lit("")))),
            F.when(xid.isNotNull() & F.col("State").isNotNull(), iri(xid, S.EXH + "locatedIn", F.concat(F.lit(S.STATE), X.state_slug("State")))),
            F.when(xid.isNotNull() & day.isNotNull(), literal(xid, S.EXH + "validUntil", day, F.lit(S.XSD + "date"))),
            F.when(xid.isNotNull() & X.is_code("FutureCode"), literal(xid, S.EXH + "hasFutureCode", F.col("FutureCode"))),
        ],
    )
    typed = register.filter("XJustizID is not null").select(F.explode(kinds).alias("t")).select("t.*").distinct()
    return base.unionByName(typed)


def successors(register: DataFrame) -> DataFrame:
    """src, dst: an id and the id that follows it."""
    return register.filter(X.is_code("FutureCode")).select(F.col("XJustizID").alias("src"), F.col("FutureCode").alias("dst"))
