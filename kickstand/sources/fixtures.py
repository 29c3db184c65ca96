"""Fleet tables derived from the driver's parquet tables.

Each table is one SELECT that both Spark and DuckDB accept (integer arithmetic only), so a query and
its oracle start from the same rows. A table is a lazy projection over its parquet scan; nothing
is written.
"""

from pathlib import PurePosixPath

from pyspark.sql import functions as F

from kickstand.schemas import table_schema

# columns the fleet tables read; a given schema spares the job that would infer it
SOURCE_SCHEMAS = {
    "nation": table_schema("n_nationkey int, n_name string, n_regionkey int"),
    "lineitem": table_schema(
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_shipdate timestamp_ntz"
    ),
    "events": table_schema("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"),
    "customer": table_schema("c_custkey bigint, c_nationkey int, c_acctbal double"),
    "orders": table_schema(
        "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    ),
}

SOURCES = {
    "service_areas": "nation",
    "trips_canon": "lineitem",
    "trips_raw": "lineitem",
    "status_changes": "events",
    "vehicles": "customer",
    "incidents": "orders",
    "tasks": "orders",
}

SELECTS = {
    "service_areas": """
        select cast(n_nationkey+1 as int) as service_area_id, n_name as community_area_name,
          case n_regionkey when 0 then 'downtown' when 1 then 'campus' when 2 then 'industrial'
               else 'residential' end as area_type
        from nation""",
    "trips_canon": """
        select l_orderkey*10+l_linenumber as trip_id,
          case l_suppkey % 6 when 0 then 'Lyft' when 1 then 'Lime' when 2 then 'Spin' when 3 then 'Coco'
               when 4 then 'Lyft' end as vendor,
          case when l_partkey % 97 = 0 then null
               else l_shipdate + interval '1' second * ((l_orderkey*7919 + l_linenumber*3607) % 86400)
               end as started_at,
          cast(floor(l_quantity)*60 as int) as duration_s,
          case when l_partkey % 89 = 0 then null else cast(floor(l_extendedprice/8) as int) end as distance_m,
          cast(l_orderkey % 25 + 1 as int) as service_area_id
        from lineitem""",
    "trips_raw": """
        select case l_suppkey % 8 when 0 then 'LYFT' when 1 then ' lime ' when 2 then 'Spin' when 3 then 'coco'
               when 4 then 'Bird' when 5 then 'Super-Pedestrian' when 6 then 'Unknown Co' end as provider_name,
          case when l_partkey % 97 = 0 then 'not a time'
               else concat(substr(cast(l_shipdate as varchar(30)),1,10), ' 08:15:00') end as start_time,
          case when l_partkey % 5 = 0 then '' when l_partkey % 7 = 0 then null
               else concat(' AREA_', cast(l_orderkey % 25 as varchar(10))) end as start_community_area_name,
          concat('AREA_', cast(l_partkey % 25 as varchar(10))) as end_community_area_name,
          cast(cast(floor(l_extendedprice/8) as int) as varchar(20)) as trip_distance
        from lineitem""",
    "status_changes": """
        select event_id, concat('V',cast(user_id as varchar(20))) as vehicle_id,
          case user_id % 4 when 0 then 'Lyft' when 1 then 'Lime' when 2 then 'Spin' else 'Coco' end as vendor,
          ts as event_time,
          case event_type when 'click' then 'maintenance_pickup' when 'view' then 'maintenance_dropoff'
               when 'error' then 'offline' when 'purchase' then 'battery_low' else 'rebalance' end as event_type,
          case when event_type = 'signup' and event_id % 3 = 0 then 'clear_footpath'
               when event_type = 'signup' then 'move_to_hotspot' end as event_subtype,
          cast(floor(value*4) as int) as handle_minutes,
          cast(user_id % 25 + 1 as int) as service_area_id
        from events""",
    "vehicles": """
        select concat('V',cast(c_custkey as varchar(20))) as vehicle_id,
          case c_custkey % 4 when 0 then 'Lyft' when 1 then 'Lime' when 2 then 'Spin' else 'Coco' end as vendor,
          case c_custkey % 3 when 0 then 460 when 1 then 520 else 620 end as battery_wh,
          cast(floor(abs(c_acctbal)) as int) as odometer_km,
          case when c_custkey % 50 = 0 then 'decommissioned' when c_custkey % 12 = 0 then 'maintenance'
               else 'active' end as status,
          cast(c_nationkey+1 as int) as service_area_id_home,
          date '2001-06-01' - cast(c_custkey % 391 + 30 as int) as in_service_since,
          case when c_custkey % 50 = 0 then date '2001-06-01' + cast(c_custkey % 60 as int) end as decommissioned_at
        from customer""",
    "incidents": """
        select o_orderkey as incident_id, concat('V',cast(o_custkey as varchar(20))) as vehicle_id,
          case o_custkey % 4 when 0 then 'Lyft' when 1 then 'Lime' when 2 then 'Spin' else 'Coco' end as vendor,
          o_orderdate + interval '1' second * ((o_orderkey*7919) % 86400) as occurred_at,
          o_orderdate + interval '1' second * ((o_orderkey*7919) % 86400 + 60*(o_orderkey % 500 + 5)) as resolved_at,
          case substr(o_orderpriority,1,1) when '1' then 'crash' when '2' then 'vandalism' when '3' then 'theft'
               when '4' then 'illegal_parking' else 'battery_failure' end as incident_type,
          cast(o_orderkey % 3 + 1 as int) as severity,
          cast(o_orderkey % 25 + 1 as int) as service_area_id,
          cast(floor(o_totalprice/1000) as int) as cost_usd
        from orders""",
    "tasks": """
        select o_orderkey as task_id,
          case o_custkey % 4 when 0 then 'Lyft' when 1 then 'Lime' when 2 then 'Spin' else 'Coco' end as vendor,
          case substr(o_orderpriority,1,1) when '1' then 'repair' when '2' then 'repair' when '3' then 'battery_swap'
               when '4' then 'pickup_illegal_parking' else 'rebalance' end as task_type,
          case when o_orderkey % 25 = 0 then 'canceled' when o_orderkey % 10 = 1 then 'assigned'
               when o_orderkey % 12 = 2 then 'open' else 'done' end as status,
          o_orderdate + interval '1' second * ((o_orderkey*7919) % 86400 + 60*(o_orderkey % 60)) as created_at,
          cast(o_orderkey % 90 + 1 as int) as response_minutes,
          cast(o_orderkey % 130 + 1 as int) as work_minutes,
          cast(o_orderkey % 25 + 1 as int) as service_area_id,
          case when substr(o_orderpriority,1,1) in ('1','2','4') and o_orderkey % 10 < 7
               then o_orderkey end as linked_incident_id,
          cast(o_orderkey % 40 + 1 as int) as move_km,
          cast(o_orderkey % 20 as int) as parts_cost_usd
        from orders""",
}


def fleet_table(spark, sf_dir, name):
    """One fleet table as a lazy projection over its parquet file."""
    table = SOURCES[name]
    source = spark.read.schema(SOURCE_SCHEMAS[table]).parquet(str(PurePosixPath(sf_dir) / f"{table}.parquet"))
    # {source} is bound to the frame for this one statement, so no view name is left in the session
    head, tail = SELECTS[name].rsplit("from ", 1)
    assert tail.strip() == table
    return spark.sql(head + "from {source}", source=source)


def pricing_policies(spark, sf_dir):
    """One policy per vendor and month seen in the incidents, first to last day of the month."""
    months = (
        fleet_table(spark, sf_dir, "incidents")
        .select("vendor", F.trunc(F.to_date("occurred_at"), "month").alias("start_date"))
        .distinct()
    )
    return months.select(
        "vendor",
        "start_date",
        F.last_day("start_date").alias("end_date"),
        F.lit(1.0).alias("base_fare"),
        (F.month("start_date") / F.lit(100.0)).alias("per_minute"),
        (F.month("start_date") / F.lit(50.0)).alias("per_km"),
    )


PRICING_SQL = """
    select vendor, start_date, cast(start_date + interval '1' month - interval '1' day as date) as end_date,
      cast(1 as double) as base_fare, extract(month from start_date)/cast(100 as double) as per_minute,
      extract(month from start_date)/cast(50 as double) as per_km
    from (select distinct vendor, cast(date_trunc('month', occurred_at) as date) as start_date from incidents)"""


class Fleet:
    """The fleet tables of one data folder, each built once on first use."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name):
        if name == "pricing":
            table = pricing_policies(self.spark, self.sf_dir)
        elif name in SELECTS:
            table = fleet_table(self.spark, self.sf_dir, name)
        else:
            raise AttributeError(name)
        setattr(self, name, table)
        return table
