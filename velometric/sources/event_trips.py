"""Raw trip records derived from the `events` table, row by row.

Each event yields one trip in the newest header spelling, with the quirks of real files: ids with a
`.0` suffix, missing ends, operator stations, unrecognised stations, docked and unknown bikes,
trips longer than a day or ending before they start. A narrow projection, so it adds no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _station_id(k: str) -> str:
    return f"""case
        when {k} < 10 then concat({k} + 100, '.0')
        when {k} < 60 then concat({k} + 4000, '.', lpad({k}, 2, '0'))
        when {k} < 80 then concat('JC', lpad({k}, 3, '0'))
        when {k} = 92 then 'Liberty State Park'
        when {k} = 93 then 'North Yard'
        when {k} = 94 then 'Depot 94'
        when {k} < 95 then concat('HB', lpad({k}, 3, '0'))
        when {k} >= 95 then concat('SYS', lpad({k}, 3, '0'))
    end"""


def event_trips(events: DataFrame) -> DataFrame:
    """Trips over four years: users start at different 30-day offsets before the event time."""
    keyed = events.selectExpr("*", "cast(get_json_object(props, '$.k') as int) as k").selectExpr(
        "*",
        "case when event_id % 67 <> 0 then cast((k * 7 + user_id % 13) % 100 as int) end as ek",
        "timestampadd(day, cast(-(user_id % 48 + 12) * 30 as int), ts) as started_at",
        """case when event_id % 97 = 0 then -(event_id % 60 * 1000000 + 500000)
            else event_id * 7919 % 100000 * 1000000 + event_id % 1000 * 1000 end as micros""",
    )
    # Generated columns are worked out once per row, like stored ones: filters on the ids are not
    # rewritten in terms of the JSON text.
    named = keyed.selectExpr(
        "*",
        f"""inline(array(named_struct('start_station_id', {_station_id("k")},
            'end_station_id', {_station_id("ek")})))""",
    )
    return named.selectExpr(
        "cast(event_id as string) as ride_id",
        """case event_type when 'click' then 'classic_bike' when 'view' then 'docked_bike'
            when 'purchase' then 'electric_bike' when 'signup' then 'unknown'
            else 'motivate_dockless_bike' end as rideable_type""",
        "started_at",
        "timestampadd(microsecond, micros, started_at) as ended_at",
        """case when event_id % 101 <> 0 then
            concat('Stop ', k, if(user_id % 7 = 0, ' (alt)', '')) end as start_station_name""",
        "start_station_id",
        "concat('Stop ', ek, if(user_id % 5 = 0, ' (alt)', '')) as end_station_name",
        "end_station_id",
        "40.7D + cast(k as double) / 997 + cast(user_id % 3 as double) / 9973 as start_lat",
        "-74D + cast(k as double) / 997 as start_lng",
        "40.7D + cast(ek as double) / 997 as end_lat",
        "-74D + cast(ek as double) / 997 as end_lng",
        "if(value < 50, 'member', 'casual') as member_casual",
        "cast(user_id % 3 as int) as gender",
        "case when user_id % 4 <> 0 then cast(user_id % 50 + 1950 as int) end as `birth year`",
        "cast(user_id as int) as bikeid",
        "if(user_id % 2 = 0, 'NYC', 'JC') as src_region",
    )


def read_event_trips(spark: SparkSession, folder: str) -> DataFrame:
    return event_trips(spark.read.parquet(f"{folder}/events.parquet"))
