"""Queries of the general data problems 1 to 6 over the driver's tables, with SQL where SQL is fast enough."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rootstock.functions.keys import key_form
from rootstock.functions.storage import keep
from rootstock.operators import asof, eager, entity_features, percentiles, references, timestamps


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Problem 1


def _as_known(spark: SparkSession, sf: str) -> DataFrame:
    return asof.as_known_at(table(spark, sf, "target_df"), table(spark, sf, "user_history"), key="user_id", time="cutoff_time", known=["valid_from", "recorded_at"], tie=["history_id"], attributes=["plan", "area", "score"])


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of target_df with the version of the user that was in force and known."""
    return _as_known(spark, sf).select("target_id", F.col("as_known_history_id").alias("history_id")).where("history_id is not null").distinct()


def p1_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """target_df with plan, area and score as known at each cutoff."""
    return _as_known(spark, sf).select("target_id", "user_id", "cutoff_time", F.col("as_known_plan").alias("plan"), F.col("as_known_area").alias("area"), F.col("as_known_score").alias("score"))


P1_SQL = """
with best as (
  select t.target_id, max({'f': h.valid_from, 'r': h.recorded_at, 'i': h.history_id}) as b
  from target_df t join user_history h on t.user_id = h.user_id and h.valid_from < t.cutoff_time and h.recorded_at < t.cutoff_time
  group by t.target_id)
"""

# Problem 2


def event_type(c: Column) -> Column:
    """One spelling of action.area.channel."""
    t = F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", ".")
    return F.when(t != "", t)


def _features(spark: SparkSession, sf: str, **options) -> DataFrame:
    return entity_features.entity_features(table(spark, sf, "interaction"), entity="user_id", time="timestamp", value="value", kind=event_type(F.col("event_type")), **options)


def p2_features(spark: SparkSession, sf: str) -> DataFrame:
    """One row per user with count, latest time and total of every event type."""
    return _features(spark, sf)


def _p2_long(**options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        types = entity_features.event_types(table(spark, sf, "interaction"), event_type(F.col("event_type")))
        rows = entity_features.as_rows(_features(spark, sf, types=types, **options), types, "user_id")
        return rows.select("user_id", "event_type", "n", "latest", F.round(F.col("total") * 100).cast("bigint").alias("total_cents"))

    return run


#: The feature table as one row per user and type; totals in cents, exact.
p2_long = _p2_long()
#: The same from many small states, so that those of a hot user's block are added over several rounds of carry addition.
p2_added = _p2_long(rows_per_group=400)


P2_SQL = """
with once as (select distinct * from interaction),
named as (select user_id, nullif(regexp_replace(lower(trim(event_type)), '[^a-z0-9]+', '.', 'g'), '') as event_type, "timestamp" as t,
  case when isnan(value) then null else cast(round(value * 100) as bigint) end as cents from once where user_id is not null)
select user_id, event_type, count(*) as n, max(t) as latest, cast(coalesce(sum(cents), 0) as bigint) as total_cents
from named where event_type is not null group by user_id, event_type
"""

# Problem 3


def _states(spark: SparkSession, sf: str) -> DataFrame:
    i, o = table(spark, sf, "interaction"), table(spark, sf, "user_orders")
    money = lambda c: F.nanvl(F.col(c), F.lit(None)).cast("decimal(18,2)")
    left = eager.compact(i, {"user_key": key_form(F.col("user_id"), i.schema["user_id"].dataType)}, {"value": money("value")}, "i")
    right = eager.compact(o, {"user_key": key_form(F.col("user_id"), o.schema["user_id"].dataType)}, {"amount": money("amount")}, "o")
    return eager.eager_join(left, right, ["user_key"])


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Users that hold at least 3 % of a table's rows, from the joined per-key states."""
    rows = lambda name: table(spark, sf, name).agg(F.count(F.lit(1)))
    return eager.heavy_keys(_states(spark, sf), "user_key", {"interaction": ("i_n", rows("interaction")), "user_orders": ("o_n", rows("user_orders"))}, 0.03)


def p3_user_join(spark: SparkSession, sf: str) -> DataFrame:
    """Aggregates of interaction joined with user_orders by user, per user, without making the join."""
    s = _states(spark, sf).where("user_key is not null and pairs > 0")
    whole = lambda c: (c * 100).cast("decimal(38,0)").cast("string")
    return s.select("user_key", "pairs", whole(eager.over_join("i", "o", "value")).alias("value_cents"), whole(eager.over_join("o", "i", "amount")).alias("amount_cents"))


def p3_roll_up(spark: SparkSession, sf: str) -> DataFrame:
    """The same join rolled up by the year in which users signed up."""
    users = table(spark, sf, "users")
    years = users.select(key_form(F.col("user_id"), users.schema["user_id"].dataType).alias("user_key"), F.year("signup_date").alias("signup_year"))
    s = _states(spark, sf).where("user_key is not null").join(years, "user_key")
    return eager.roll_up(s, ["signup_year"], {"n_users": F.count(F.lit(1)), "n_interactions": F.sum("i_n"), "n_orders": F.sum("o_n"), "n_pairs": F.sum("pairs")})


KEY_SQL = """case when {c} is null or lower(trim({c}, e' \\t\\n\\r')) in ('', 'nan', 'none', '<na>') then null
 when regexp_matches(trim({c}, e' \\t\\n\\r'), '^[+-]?[0-9]+([.]0*)?$') then regexp_replace(regexp_replace(trim({c}, e' \\t\\n\\r'), '^[+]|[.]0*$', '', 'g'), '^(-?)0+([0-9])', '\\1\\2')
 else trim({c}, e' \\t\\n\\r') end"""
P3_SQL = f"""
with i as (select cast(user_id as varchar) as user_key, count(*) as n, sum(case when isnan(value) then null else cast(value as decimal(18,2)) end) as s from interaction group by 1),
o as (select {KEY_SQL.format(c="user_id")} as user_key, count(*) as n, sum(case when isnan(amount) then null else cast(amount as decimal(18,2)) end) as s from user_orders group by 1)
"""

# Problem 4


def _order_times(spark: SparkSession, sf: str) -> DataFrame:
    return timestamps.with_instants(table(spark, sf, "user_orders"), table(spark, sf, "order_feed"), {"order_date": "order_us", "created_at": "created_us"})


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every value of the three mixed columns that names one instant."""
    o = _order_times(spark, sf).select("order_id", F.explode(F.array(F.struct(F.lit("order_date").alias("c"), F.col("order_us").alias("u")), F.struct(F.lit("created_at").alias("c"), F.col("created_us").alias("u")))).alias("z"))
    t = timestamps.with_instants(table(spark, sf, "target_df"), table(spark, sf, "order_feed"), {"interaction_time": "u"})
    rows = o.select(F.lit("user_orders").alias("table_name"), F.col("z.c").alias("column_name"), F.col("order_id").alias("row_id"), F.col("z.u").alias("utc_us"))
    rows = rows.unionByName(t.select(F.lit("target_df").alias("table_name"), F.lit("interaction_time").alias("column_name"), F.col("target_id").alias("row_id"), F.col("u").alias("utc_us")))
    return rows.where("utc_us is not null").distinct()


# Problem 5

PROBABILITIES = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def p5_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of user_orders.amount per user, from one state of the whole table; `p5_combined` combines states of periods."""
    o = table(spark, sf, "user_orders")
    state = percentiles.percentile_state(o, {"user_key": key_form(F.col("user_id"), o.schema["user_id"].dataType)}, F.col("amount"))
    return percentiles.percentiles(state, PROBABILITIES, rows=o.count())


def p5_combined(spark: SparkSession, sf: str) -> DataFrame:
    """The same from states of each month of created_at, kept apart and then combined; orders without such an instant are a period of their own."""
    o = timestamps.with_instants(table(spark, sf, "user_orders"), table(spark, sf, "order_feed"), {"created_at": "created_us"})
    month = F.coalesce(F.date_format(F.timestamp_micros("created_us"), "yyyy-MM"), F.lit("none"))
    monthly = percentiles.percentile_state(o, {"user_key": key_form(F.col("user_id"), o.schema["user_id"].dataType), "month": month}, F.col("amount"))
    return percentiles.percentiles(percentiles.roll_up(keep(monthly), "month"), PROBABILITIES)


P5_SQL = f"""
with r as (select {KEY_SQL.format(c="user_id")} as user_key, case when isnan(amount) then null else amount end as v from user_orders)
select user_key, count(v) as n, count(*) - count(v) as n_missing, {", ".join(f"quantile_cont(v, {p}) as {n}" for n, p in PROBABILITIES.items())}
from r where user_key is not null group by user_key
"""

# Problem 6


def _orphans(spark: SparkSession, sf: str, orders: bool = True) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    children = {
        "interaction": references.Child(t("interaction"), "interaction_id", F.col("timestamp")),
        "user_history": references.Child(t("user_history"), "history_id", F.col("valid_from")),
        "target_df": references.Child(t("target_df"), "target_id", F.col("cutoff_time")),
    }
    if orders:
        o = timestamps.with_instants(t("user_orders"), t("order_feed"), {"created_at": "created_us"})
        instant = F.timestamp_micros(F.col("created_us")).cast("timestamp_ntz")
        children["user_orders"] = references.Child(o, "order_id", instant)
    parents = {"users": references.Parent(t("users"), "signup_date", "deleted_at"), "item": references.Parent(t("item"), "created_at", "deleted_at"), "order_feed": references.Parent(t("order_feed"))}
    return references.orphans(references.links_of(t("rdb_schema")), children, parents)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every reference of the schema's links that doesn't hold."""
    return _orphans(spark, sf).select("table_name", "column_name", "row_id", "kind").distinct()


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    """Orphans per table, column, month and kind."""
    return references.report(_orphans(spark, sf).distinct())


def p6_timed(spark: SparkSession, sf: str) -> DataFrame:
    """Orphans of the tables whose time column is a timestamp: the part of p6_found that plain SQL can check."""
    return _orphans(spark, sf, orders=False).select("table_name", "column_name", "row_id", "kind").distinct()


def p6_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Orphans without any parent, of all tables: for these no time is needed, so SQL can check them."""
    return _orphans(spark, sf).where("kind = 'missing'").select("table_name", "column_name", "row_id").distinct()


def _missing_sql() -> str:
    keys = {"users": "(select cast(user_id as varchar) as k from users)", "item": f"(select {KEY_SQL.format(c='item_id')} as k from item)", "order_feed": f"(select {KEY_SQL.format(c='feed')} as k from order_feed)"}
    refs = [("interaction", "user_id", "interaction_id", "users"), ("interaction", "item_id", "interaction_id", "item"), ("user_history", "user_id", "history_id", "users"), ("target_df", "user_id", "target_id", "users"), ("target_df", "item_id", "target_id", "item"), ("user_orders", "user_id", "order_id", "users"), ("user_orders", "feed", "order_id", "order_feed")]
    one = "select distinct '{t}' as table_name, '{c}' as column_name, row_id from (select {i} as row_id, {key} as k from {t}) where k is not null and k not in (select k from {p} where k is not null)"
    text = lambda t, c: KEY_SQL.format(c=c) if c in ("item_id", "feed") or t == "user_orders" else f"cast({c} as varchar)"
    return "\nunion all ".join(one.format(t=t, c=c, i=i, p=keys[p], key=text(t, c)) for t, c, i, p in refs)


def _p6_sql() -> str:
    users = "(select cast(user_id as varchar) as k, signup_date as born, deleted_at as died from users)"
    item = f"(select {KEY_SQL.format(c='item_id')} as k, created_at as born, deleted_at as died from item)"
    refs = [("interaction", "user_id", "interaction_id", '"timestamp"', users), ("interaction", "item_id", "interaction_id", '"timestamp"', item), ("user_history", "user_id", "history_id", "valid_from", users), ("target_df", "user_id", "target_id", "cutoff_time", users), ("target_df", "item_id", "target_id", "cutoff_time", item)]
    one = """select distinct '{t}' as table_name, '{c}' as column_name, row_id, kind from (
      select r.row_id, case when p.k is null then 'missing' when p.born >= r.at then 'late' when p.died <= r.at then 'deleted' end as kind
      from (select {i} as row_id, {key} as k, {at} as at from {t}) r left join {p} p on r.k = p.k where r.k is not null) where kind is not null"""
    return "\nunion all ".join(one.format(t=t, c=c, i=i, at=at, p=p, key=KEY_SQL.format(c=c) if c == "item_id" else f"cast({c} as varchar)") for t, c, i, at, p in refs)


QUERIES = {
    "p1_found": p1_found,
    "p1_attributes": p1_attributes,
    "p2_features": p2_features,
    "p2_long": p2_long,
    "p2_added": p2_added,
    "p3_found": p3_found,
    "p3_user_join": p3_user_join,
    "p3_roll_up": p3_roll_up,
    "p4_found": p4_found,
    "p5_percentiles": p5_percentiles,
    "p5_combined": p5_combined,
    "p6_found": p6_found,
    "p6_report": p6_report,
    "p6_timed": p6_timed,
    "p6_missing": p6_missing,
}

ORACLES = {
    "p1_found": P1_SQL + "select target_id, b.i as history_id from best",
    "p1_attributes": P1_SQL + "select t.target_id, t.user_id, t.cutoff_time, h.plan, h.area, h.score from target_df t left join best on t.target_id = best.target_id left join (select distinct * from user_history) h on h.history_id = best.b.i and h.user_id = t.user_id and h.valid_from = best.b.f and h.recorded_at = best.b.r",
    "p2_long": P2_SQL,
    "p2_added": P2_SQL,
    "p3_found": P3_SQL + "select 'interaction' as table_name, user_key from i where user_key is not null and n >= 0.03 * (select count(*) from interaction) union all select 'user_orders', user_key from o where user_key is not null and n >= 0.03 * (select count(*) from user_orders)",
    "p3_user_join": P3_SQL + "select user_key, i.n * o.n as pairs, cast(cast(i.s * o.n * 100 as decimal(38,0)) as varchar) as value_cents, cast(cast(o.s * i.n * 100 as decimal(38,0)) as varchar) as amount_cents from i join o using (user_key)",
    "p3_roll_up": P3_SQL + "select year(u.signup_date) as signup_year, count(*) as n_users, cast(sum(coalesce(i.n, 0)) as bigint) as n_interactions, cast(sum(coalesce(o.n, 0)) as bigint) as n_orders, cast(sum(coalesce(i.n, 0) * coalesce(o.n, 0)) as bigint) as n_pairs from users u left join i on i.user_key = cast(u.user_id as varchar) left join o on o.user_key = cast(u.user_id as varchar) where i.n is not null or o.n is not null group by 1",
    "p5_percentiles": P5_SQL,
    "p5_combined": P5_SQL,
    "p6_timed": _p6_sql(),
    "p6_missing": _missing_sql(),
}
