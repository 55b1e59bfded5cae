"""Golden records: one row for each cluster of client records, every field from the record that its rule prefers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._rows import save

#: Sources by falling trust; any other source, or none, is trusted least.
TRUST = ("crm", "web", "store", "partner")
#: A record that is more than this many hours older than its cluster's latest is stale.
STALE_HOURS = 60 * 24
#: Clusters with over a HOT_CLUSTERS-th of all rows are hot; so many of them there can be at most.
HOT_CLUSTERS = 10_000
#: Fixed value: a string of nothing but white space.
BLANK = r"^[\x20\x09-\x0D]*$"
_TEXTS = ("source", "name", "email", "segment", "city")


def _records(clients: DataFrame) -> DataFrame:
    """The columns that count, by names of their own, blank strings as nulls, with the keys of the two orders."""
    kinds = dict(clients.dtypes)
    text = lambda c: F.when(~F.col(c).rlike(BLANK), F.col(c))
    # a timestamp without a zone is read as time since 1970, whatever the session's zone does to its days
    at = F.expr("updated_at - timestamp_ntz'1970-01-01'") if kinds["updated_at"] == "timestamp_ntz" else F.unix_micros(F.col("updated_at").cast("timestamp"))
    client, trust = F.col("client_id").cast("long"), F.lit(0)
    for i, source in enumerate(TRUST):
        trust = F.when(text("source") == source, len(TRUST) - i).otherwise(trust)
    return clients.select(
        F.coalesce(F.col("master_id").cast("long"), client).alias("cluster_id"), client.alias("client_id"), at.alias("at"),
        trust.alias("trust"), F.bitwise_not(client).alias("small"), *(text(c).alias(c) for c in _TEXTS if c != "source"), F.col("nation_id"),
        F.col("balance").cast("double").alias("balance"),
    )


def _meet(rows: DataFrame, facts: DataFrame, hot: DataFrame) -> DataFrame:
    """rows with the facts of their clusters (one row a cluster): those of hot clusters meet them without being shuffled.

    hot has at most HOT_CLUSTERS rows, so it and the facts of its clusters are broadcast."""
    facts = facts.withColumnRenamed("cluster_id", "f_cluster")
    here = rows.join(F.broadcast(hot), rows["cluster_id"].eqNullSafe(hot["h_cluster"]), "left")
    busy, others = here.filter("is_hot").drop("h_cluster", "is_hot"), here.filter("is_hot is null").drop("h_cluster", "is_hot")
    few = facts.join(F.broadcast(hot), facts["f_cluster"].eqNullSafe(hot["h_cluster"])).drop("h_cluster", "is_hot")
    same = F.col("cluster_id").eqNullSafe(F.col("f_cluster"))
    return busy.join(F.broadcast(few), same).unionByName(others.join(facts.hint("merge"), same)).drop("f_cluster")


def _first(value: Column, *order: Column) -> Column:
    """(value, client_id) of the record that is greatest in order, among those with a value; between records that are equal
    in order, the greater value wins."""
    return F.max_by(F.struct(value.alias("v"), F.col("client_id").alias("c")), F.when(value.isNotNull(), F.struct(*order, value)))


def golden_records(clients: DataFrame, stale_hours: int = STALE_HOURS, hot_clusters: int = HOT_CLUSTERS) -> DataFrame:
    """One row for each cluster_id (master_id or, if null, client_id): cluster_id, n_records, n_stale, name, email, segment,
    city, nation_id, balance_cents, name_from, email_from, segment_from, balance_from, address_from.

    RECENT is latest updated_at (null last), higher trust, smaller client_id; TRUSTED is fresh before stale, higher trust,
    RECENT. segment is the first by RECENT, email by TRUSTED, name the one of most code points, then by TRUSTED; city and
    nation_id are of the record with most of the two, then by TRUSTED; balance is of a record with the chosen segment, else
    of another, then by RECENT. *_from is the client_id that a value that is not null comes from.

    A first aggregate finds each cluster's latest update, rows meet it again, a second aggregate takes max_by over struct keys
    for each field, and a third the balance, from rows that have met their cluster's segment. Rows of hot clusters are
    aggregated where they are read: only what each task makes of a cluster is shuffled, so no task sees a cluster whole.

    Nulls and blank strings are no values; rows with neither master_id nor client_id are one cluster, whose cluster_id is null;
    without any updated_at all records are stale. Ties in all keys (repeated client_ids) go to the greater value; repeated
    rows count in n_records. A balance that is NaN, infinite or beyond a long of cents is a value, its balance_cents null. An empty table gives
    no rows; other columns are ignored.
    """
    rows = _records(clients)
    latest = save(rows.groupBy("cluster_id").agg(F.count("*").alias("n_records"), F.max("at").alias("latest")))
    total = latest.agg(F.sum("n_records")).first()[0] or 0
    hot = latest.filter(F.col("n_records") * hot_clusters > total).select(F.col("cluster_id").alias("h_cluster"), F.lit(True).alias("is_hot"))
    age = F.col("latest") - F.col("at")
    limit = F.expr(f"interval {stale_hours} hours") if dict(rows.dtypes)["at"].startswith("interval") else F.lit(stale_hours * 3_600_000_000)
    recent = (F.col("at"), F.col("trust"), F.col("small"))
    trusted = (F.col("fresh"), F.col("trust"), *recent)
    place = F.struct("city", "nation_id", F.when(F.coalesce("city", F.col("nation_id").cast("string")).isNotNull(), F.col("client_id")).alias("c"))
    filled = F.col("city").isNotNull().cast("int") + F.col("nation_id").isNotNull().cast("int")
    judged = _meet(rows, latest.select("cluster_id", "latest"), hot).withColumn("fresh", F.coalesce(age <= limit, F.lit(False)))
    fields = save(
        judged.groupBy("cluster_id").agg(
            F.count("*").alias("n_records"),
            F.count_if(~F.col("fresh")).alias("n_stale"),
            _first(F.col("name"), F.char_length("name"), *trusted).alias("name"),
            _first(F.col("email"), *trusted).alias("email"),
            _first(F.col("segment"), *recent).alias("segment"),
            F.max_by(place, F.struct(filled, *trusted, "city", "nation_id")).alias("address"),
        )
    )
    chosen = fields.select("cluster_id", F.col("segment.v").alias("chosen"))
    priced = _meet(rows.select("cluster_id", "client_id", "at", "trust", "small", "segment", "balance"), chosen, hot)
    balance = _first(F.col("balance"), F.coalesce(F.col("segment") == F.col("chosen"), F.lit(False)), *recent)
    balances = priced.groupBy(F.col("cluster_id").alias("b_cluster")).agg(balance.alias("balance"))
    cents = F.floor(F.col("balance.v") * 100 + 0.5)
    return fields.join(balances, fields["cluster_id"].eqNullSafe(balances["b_cluster"])).select(
        "cluster_id", "n_records", "n_stale", F.col("name.v").alias("name"), F.col("email.v").alias("email"), F.col("segment.v").alias("segment"),
        "address.city", "address.nation_id", F.when(F.abs(F.col("balance.v")) < 9e16, cents).alias("balance_cents"),
        F.col("name.c").alias("name_from"), F.col("email.c").alias("email_from"), F.col("segment.c").alias("segment_from"),
        F.col("balance.c").alias("balance_from"), F.col("address.c").alias("address_from"),
    )


_RECENT = "seen desc nulls last, trust desc, client_id nulls last"
_TRUSTED = f"fresh desc, trust desc, {_RECENT}"

#: The same in DuckDB SQL over the table clients.
SQL = f"""
with texts as (
  select coalesce(master_id, client_id) as cluster_id, client_id, epoch_us(updated_at) as seen, balance, nation_id,
    {", ".join(rf"case when not regexp_full_match({c}, '[\x20\x09-\x0D]*') then {c} end as {c}" for c in _TEXTS)}
  from clients
),
records as (
  select *, case source {" ".join(f"when '{s}' then {len(TRUST) - i}" for i, s in enumerate(TRUST))} else 0 end as trust,
    coalesce(max(seen) over (partition by cluster_id) - seen <= {STALE_HOURS * 3_600_000_000}, false) as fresh
  from texts
),
orders as (
  select *,
    row_number() over (partition by cluster_id order by name is null, length(name) desc, {_TRUSTED}, name desc) as by_name,
    row_number() over (partition by cluster_id order by email is null, {_TRUSTED}, email desc) as by_email,
    row_number() over (partition by cluster_id order by segment is null, {_RECENT}, segment desc) as by_segment,
    row_number() over (partition by cluster_id order by (city is null)::int + (nation_id is null)::int, {_TRUSTED}, city desc, nation_id desc) as by_address,
    first_value(segment) over (partition by cluster_id order by segment is null, {_RECENT}, segment desc) as chosen
  from records
),
priced as (
  select *, row_number() over (partition by cluster_id order by balance is null, coalesce(segment = chosen, false) desc, {_RECENT}, balance desc) as by_balance
  from orders
)
select cluster_id, count(*) as n_records, count(*) filter (not fresh) as n_stale,
  max(name) filter (by_name = 1) as name, max(email) filter (by_email = 1) as email, max(segment) filter (by_segment = 1) as segment,
  max(city) filter (by_address = 1) as city, max(nation_id) filter (by_address = 1) as nation_id,
  max(floor(100 * balance + 0.5)::bigint) filter (by_balance = 1) as balance_cents,
  max(client_id) filter (by_name = 1 and name is not null) as name_from,
  max(client_id) filter (by_email = 1 and email is not null) as email_from,
  max(client_id) filter (by_segment = 1 and segment is not null) as segment_from,
  max(client_id) filter (by_balance = 1 and balance is not null) as balance_from,
  max(client_id) filter (by_address = 1 and (city is not null or nation_id is not null)) as address_from
from priced group by cluster_id
"""
